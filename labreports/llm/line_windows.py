"""Line dedup by overlapping three-line windows, with DataFrame functions only.

Every three consecutive lines are hashed. A window seen before, in the order of document id and
position, is a later occurrence; the lines that later occurrences cover are merged and removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labreports.llm.common import own_exchange, text_of

# A line that holds no visible character stays with the line before it.
_LINE_BREAK = r"\n(?=[^\S\n]*\S)"


def _lines(text: Column) -> Column:
    return F.split(text, _LINE_BREAK, -1)


def _hashes(lines: Column) -> Column:
    """Two independent 64-bit hashes of each line without white space at its end."""
    trimmed = F.transform(lines, lambda line: F.regexp_replace(line, r"(?<!\s)\s++\z", ""))
    return F.transform(
        trimmed,
        lambda line: F.struct(F.xxhash64(line).alias("a"), F.xxhash64(line, F.lit(17)).alias("b")),
    )


def _windows(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, position, a, b`` for each window of ``width`` lines."""
    hashed = docs.select("doc_id", _hashes(_lines(text_of("text"))).alias("lines"))
    starts = F.when(
        F.size("lines") >= width,
        F.transform(
            F.sequence(F.lit(0), F.size("lines") - width),
            lambda at: F.struct(
                at.alias("position"),
                *[
                    F.xxhash64(*[F.get("lines", at + k)[part] for k in range(width)]).alias(part)
                    for part in "ab"
                ],
            ),
        ),
    )
    return hashed.where("doc_id is not null").select("doc_id", F.inline(starts))


def _covered(starts: Column, width: int) -> Column:
    """One true or false per line, up to the last covered one, from ascending window starts."""

    def stretch(start: Column, at: Column) -> Column:
        end = F.when(at == 0, F.lit(0)).otherwise(F.get(starts, at - 1) + width)
        return F.concat(
            F.array_repeat(F.lit(False), F.greatest(F.lit(0), start - end)),
            F.array_repeat(F.lit(True), start + width - F.greatest(start, end)),
        )

    return F.flatten(F.transform(starts, stretch))


def dedup_lines(docs: DataFrame, width: int = 3) -> DataFrame:
    """Remove lines that repeat an earlier passage of ``width`` lines or more.

    Adds ``n_lines`` and ``n_removed`` and shortens ``text``; every row and column of ``docs`` stays
    (columns of these two names are replaced). A line is what stands between line breaks; one
    without visible characters belongs to the line before it, and white space at the end of a line
    doesn't count in comparisons. Of each distinct removed line an earlier copy stays.

    Null text counts as empty and stays null. Rows with a null id, and texts of fewer lines than
    ``width``, stay as they are. Rows that share a document id count as one place: what repeats
    only between them stays. A passage may stand in a third of all documents: the first place of a
    window is combined before the shuffle, and the join back can be split.
    """
    windows = _windows(docs, width)
    place = F.struct("doc_id", "position")
    first = (
        windows.groupBy("a", "b")
        .agg(F.min(place).alias("first"), F.max(place).alias("last"))
        .where("first <> last")
        .select(own_exchange("a", "b").alias("window"), "first")
    )
    later = (
        windows.select("doc_id", "position", own_exchange("a", "b").alias("window"))
        .join(first, "window")
        .where(F.struct("doc_id", "position") > F.col("first"))
    )
    removed = later.groupBy("doc_id").agg(F.array_sort(F.collect_set("position")).alias("starts"))
    # The row travels as one struct, so that no name of its columns can clash.
    rows = docs.select("doc_id", F.struct(*docs.columns).alias("row"))
    text, starts = F.col("row.text"), F.col("starts")
    joined = rows.join(removed.hint("shuffle_hash"), "doc_id", "left").select("row", "starts")
    marked = joined.withColumn("flags", _covered(starts, width)).withColumn(
        "lines", F.when(starts.isNotNull(), F.arrays_zip(_lines(text).alias("line"), F.col("flags").alias("gone")))
    )
    # One slot per line: lines after the last covered one have no flag and stay.
    stays = F.filter("lines", lambda x: ~F.coalesce(x["gone"], F.lit(False)))
    kept = F.when(starts.isNull(), text).otherwise(
        F.array_join(F.transform(stays, lambda x: x["line"]), "\n")
    )
    names = [c for c in docs.columns if c.lower() not in ("text", "n_lines", "n_removed")]
    return marked.select(
        *[F.col("row")[name].alias(name) for name in names],
        kept.alias("text"),
        F.size(_lines(F.coalesce(text, F.lit("")))).alias("n_lines"),
        F.coalesce(F.size(F.filter("flags", lambda gone: gone)), F.lit(0)).alias("n_removed"),
    )
