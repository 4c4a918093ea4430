"""Spelling variant grouping: words one edit apart meet in sorted permuterm rotations.

A word ends in a terminator and is rotated to start at each of its places. Two words that differ at
one place have rotations that agree up to their last code point, the one that differs; and if a code
point is left out of a word, the whole rotation of what remains is such a beginning. So each group of
neighbours is a range of the sorted rotations with a common prefix that skips the edited code point,
or is that prefix itself. A group holds at most one word per code point of the alphabet and one more.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labreports.llm.common import checkpointed, own_exchange, text_of

END = "$"
RUN = "[A-Za-zÀ-ÿ]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Rotations of more code points than this are sorted by a digest instead of their text.
_LONG = 48


def words_of(docs: DataFrame, least_length: int, least_count: int, every: int) -> DataFrame:
    """``word, n``: the words of all texts with how often each occurs."""
    runs = F.regexp_extract_all(text_of("text"), F.lit(RUN), F.lit(0))
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    found = docs.select(doc.alias("doc"), F.explode(runs).alias("run"))
    # A word can lose one code point only, so shorter runs never count.
    found = found.where(F.length("run") >= least_length)
    lower = F.translate("run", _UPPER, _UPPER.lower())
    found = found.select("doc", lower.alias("run"))
    mark = F.crc32(F.concat_ws(":", "doc", "run").cast("binary"))
    found = found.select("run", F.length("run").alias("size"), mark.alias("mark"))
    at = (F.col("mark") % F.col("size")).cast("int")
    shorter = F.concat(
        F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.col("size").cast("int"))
    )
    word = F.when(F.col("mark") % every == 0, shorter).otherwise(F.col("run"))
    counts = found.select(word.alias("word")).where(F.length("word") >= least_length)
    counts = counts.groupBy("word").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= least_count)


def rotations(words: DataFrame) -> DataFrame:
    """``id, n, key, whole, first``: the places of each word in the sorted rotations.

    ``key`` is a whole rotation, or one without its last code point, which is then the edited one.
    ``first`` is whether that code point differs from the one before it in the word: leaving out any
    code point of a run of equal ones gives the same word, which must count once.
    """
    size = F.length("word")
    places = words.select("id", "word", "n", F.explode(F.sequence(F.lit(0), size)).alias("at"))
    at = F.col("at")
    head = F.substring("word", F.lit(1), at)
    edited = F.struct(
        F.concat(F.substring("word", at + 2, size), F.lit(END), head).alias("key"),
        F.lit(False).alias("whole"),
        ((at == 0) | (F.substring("word", at + 1, F.lit(1)) != F.substring("word", at, F.lit(1)))).alias(
            "first"
        ),
    )
    whole = F.struct(
        F.concat(F.substring("word", at + 1, size), F.lit(END), head).alias("key"),
        F.lit(True).alias("whole"),
        (at == 0).alias("first"),
    )
    both = F.when(at < size, F.array(whole, edited)).otherwise(F.array(whole))
    keyed = places.select("id", "n", F.explode(both).alias("r")).select("id", "n", "r.*")
    short = F.length("key") <= _LONG
    return keyed.withColumn(
        "key", F.when(short, F.col("key")).otherwise(F.sha2(F.col("key").cast("binary"), 256))
    )


def neighbours(turned: DataFrame) -> DataFrame:
    """``id, n_near, best``: how many words are near each, and the best of them.

    One scan of the sorted rotations: each row looks at its group only, of which the two best rows
    and three counts are all that it needs, so no pairs are written.
    """
    group = Window.partitionBy("key")
    ranked = group.orderBy("whole", F.desc("n"), "id")
    every = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = F.struct((-F.col("n")).alias("less"), F.col("id").alias("id"))
    edited = ~F.col("whole")
    scanned = turned.repartitionByRange("key").select(
        "id",
        "whole",
        "first",
        F.count_if(edited).over(every).alias("edited"),
        F.count_if(edited & F.col("first")).over(every).alias("longer"),
        F.max(F.when(F.col("whole"), own)).over(every).alias("shorter"),
        F.row_number().over(ranked).alias("place"),
        F.first(F.when(edited, own)).over(ranked.rowsBetween(Window.unboundedPreceding, 0)).alias("top"),
        F.lead(F.when(edited, own), 1).over(ranked).alias("second"),
    )
    replaced = F.when(F.col("place") == 1, F.col("second")).otherwise(F.col("top"))
    near_edited = F.col("edited") - 1 + F.when(
        F.col("first") & F.col("shorter").isNotNull(), 1
    ).otherwise(0)
    part = F.when(F.col("whole"), F.col("longer")).otherwise(near_edited)
    best = F.when(F.col("whole"), F.col("top")).otherwise(F.least("shorter", replaced))
    # Every word has one whole rotation that is kept whatever it meets.
    kept = scanned.select("id", "whole", "first", part.alias("part"), best.alias("best")).where(
        (F.col("part") > 0) | F.col("best").isNotNull() | (F.col("whole") & F.col("first"))
    )
    return kept.groupBy("id").agg(F.sum("part").alias("n_near"), F.min("best").alias("best"))


def _followed(forms: DataFrame, rounds: int) -> DataFrame:
    """``id, root``: where the chain that starts with ``id, form`` ends, by doubling the steps."""
    current = forms.select("id", F.col("form").alias("root"))
    for _ in range(rounds):
        further = current.select(own_exchange("id").alias("key"), F.col("root").alias("next"))
        current = checkpointed(
            current.withColumn("key", own_exchange("root"))
            .join(further, "key", "left")
            .select("id", F.coalesce("next", "root").alias("root"))
        )
    return current


def spelling_variants(
    docs: DataFrame,
    least_length: int = 6,
    least_count: int = 5,
    ratio: int = 5,
    every: int = 199,
) -> DataFrame:
    """``word, form, root, n, n_near, form_n``: each word with the near word that it may stand for.

    Words are runs of letters, A to Z in lower case; of one occurrence in ``every``, chosen by the
    crc32 of id and word, a code point is left out. Two words are near if one inserted, deleted or
    replaced code point makes them equal. ``form`` is the near word with the largest ``n``, the
    smallest in code-point order among equals, if it occurs ``ratio`` times as often; ``root`` is
    where following forms ends. Null text has no words, a null id counts as an empty one, repeated
    rows count as often as they are given, and an empty table gives no rows.

    Long texts are taken whole. The work on a word grows with the square of its length, but what is
    shuffled does not: long rotations are sorted by their SHA-256. Numbers that keep the order of
    the words stand for them, so rows are small. ``ratio`` is 2 at least, so forms never lead back.
    """
    if ratio < 2:
        raise ValueError("following forms ends only if each occurs at least twice as often")
    counted = words_of(docs, least_length, least_count, every)
    words = checkpointed(
        counted.repartitionByRange("word")
        .sortWithinPartitions("word")
        .withColumn("id", F.monotonically_increasing_id())
    )
    near = neighbours(rotations(words))
    own = words.select("id", "n")
    stands = F.when(-F.col("best.less") >= ratio * F.col("n"), F.col("best.id"))
    judged = near.join(own, "id").select(
        "id", "n_near", stands.alias("form"), F.when(stands.isNotNull(), -F.col("best.less")).alias("form_n")
    )
    judged = checkpointed(judged)
    forms = judged.where("form is not null").select("id", "form")
    # A chain multiplies the count by the ratio at each step, which bounds its length.
    most = words.agg(F.max("n")).first()[0] or 1
    steps = max(1, math.floor(math.log(most, ratio) + 1e-9))
    roots = _followed(forms, math.ceil(math.log2(steps)) if steps > 1 else 0)
    spelled = words.select("id", "word")

    def named(column: str, name: str) -> tuple[DataFrame, Column]:
        other = spelled.select(F.col("id").alias(f"{column}_id"), F.col("word").alias(name))
        return other, F.col(column) == F.col(f"{column}_id")

    told = forms.join(roots, "id")
    told = told.join(*named("form", "form_word")).join(*named("root", "root_word"))
    told = told.select("id", "form_word", "root_word")
    return (
        words.join(judged.select("id", "n_near", "form_n"), "id")
        .join(told, "id", "left")
        .select(
            "word",
            F.col("form_word").alias("form"),
            F.coalesce("root_word", "word").alias("root"),
            "n",
            "n_near",
            "form_n",
        )
    )
