"""Secret scans over an incremental blob ledger, with DataFrame functions only.

Every version of a file is addressed by the SHA-256 of its content. A ledger remembers which rule
versions each blob has been scanned with and what they found. Only unseen pairs of blob and rule
version are scanned, each blob once, and findings are joined back to all places of the blob.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labreports.llm.common import own_exchange, text_of


@dataclass(frozen=True)
class Rule:
    """A pattern; ``secret`` is the group that must have ``least`` characters. Matches are taken
    leftmost and without overlap before that test, and a failing one isn't tried again. Texts
    without ``literal`` can't match."""

    name: str
    version: int
    pattern: str
    secret: int = 0
    least: int = 1
    literal: str | None = None


_ASSIGN = (
    r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
# The first three are the agreed base kinds, in their order.
RULES = (
    Rule("assign", 1, _ASSIGN, secret=2, least=8),
    Rule("access", 1, r"AKIA[A-Z0-9]++", least=16, literal="AKIA"),
    Rule("hex", 1, r"(?<![0-9a-f])[0-9a-f]{32,}+"),
    Rule("private_key", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", literal="PRIVATE KEY-----"),
    Rule("host_token", 1, r"gh[pousr]_[A-Za-z0-9]{36,}+", literal="gh"),
    Rule("chat_token", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}+", literal="xox"),
    Rule("signed_token", 1, r"eyJ[\w-]{8,}+\.[\w-]{8,}+\.[\w-]{8,}+", literal="eyJ"),
)
BASE = ("assign", "access", "hex")

_SPANS = "array<struct<start:bigint,end:bigint>>"
LEDGER_SCHEMA = f"blob_id binary, scans array<struct<rule:string,version:int,spans:{_SPANS}>>"


def _matches(text: Column, rule: Rule, order: int) -> Column:
    """An array of struct(order, nr, gap, size, secret) of one rule; sizes in code points."""
    pattern = F.lit(rule.pattern)
    found = rule.literal is None or F.contains(text, F.lit(rule.literal))
    found = F.rlike(text, pattern) if found is True else found & F.rlike(text, pattern)
    gaps, whole = F.split(text, rule.pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    secret = whole if rule.secret == 0 else F.regexp_extract_all(text, pattern, F.lit(rule.secret))
    parts = F.arrays_zip(F.slice(gaps, 1, F.size(whole)).alias("gap"), whole.alias("all"), secret.alias("secret"))
    sizes = F.transform(
        parts,
        lambda x, nr: F.struct(
            F.lit(order).alias("order"),
            nr.alias("nr"),
            F.length(x["gap"]).alias("gap"),
            F.length(x["all"]).alias("size"),
            F.length(x["secret"]).alias("secret"),
        ),
    )
    return F.when(found, sizes)


def _scanned(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``blob_id, order, start, end`` of each match that passes; ``texts`` has ``blob_id, text`` and
    ``todo``, the places of the rules to apply."""
    none = F.array().cast("array<struct<order:int,nr:int,gap:int,size:int,secret:int>>")
    found = [
        F.coalesce(F.when(F.array_contains("todo", k), _matches(F.col("text"), rule, k)), none)
        for k, rule in enumerate(rules)
    ]
    rows = texts.select("blob_id", F.inline(F.concat(*found)))
    # One text has all matches of a window, so its size is bounded by that text.
    order = Window.partitionBy("blob_id", "order").orderBy("nr")
    placed = rows.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(order))
    least = F.element_at(F.array(*[F.lit(rule.least) for rule in rules]), F.col("order") + 1)
    return placed.where(F.col("secret") >= least).select(
        "blob_id", "order", (F.col("end") - F.col("size")).alias("start"), "end"
    )


def blob_ids(versions: DataFrame) -> DataFrame:
    """Add ``blob_id``, the SHA-256 of the text; null counts as empty."""
    return versions.withColumn("blob_id", F.unhex(F.sha2(text_of("text"), 256)))


def scan_unseen(
    versions: DataFrame,
    place: str,
    ledger: DataFrame | None = None,
    rules: tuple[Rule, ...] = RULES,
) -> DataFrame:
    """Ledger rows (``LEDGER_SCHEMA``) for every pair of blob and rule version that ``ledger`` lacks.

    ``versions`` holds a ``place`` (an id or path) and a ``text`` per row, and may hold all history;
    append the result to the ledger. Each blob is read at its smallest place only, and whole however
    long it is. Blobs that have nothing left to scan give no row. Null text is the empty blob; a null
    place is a place like any other; repeated rows are one version; an empty table gives no rows.
    """
    keyed = blob_ids(versions.select(F.col(place).alias("place"), "text"))
    first = keyed.groupBy("blob_id").agg(F.min("place").alias("place"))
    every = F.array(*[F.lit(k) for k in range(len(rules))])
    if ledger is None:
        todo = first.withColumn("todo", every)
    else:
        seen = ledger.select("blob_id", F.explode("scans").alias("scan")).groupBy("blob_id").agg(
            F.collect_set(F.concat_ws(" ", "scan.rule", "scan.version")).alias("seen")
        )
        names = F.array(*[F.lit(f"{rule.name} {rule.version}") for rule in rules])
        left = F.filter(every, lambda k: ~F.array_contains(F.coalesce("seen", F.array().cast("array<string>")), F.get(names, k)))
        todo = (
            first.join(seen, "blob_id", "left")
            .select("blob_id", "place", left.alias("todo"))
            .where(F.size("todo") > 0)
        )
    wanted = todo.select(F.col("blob_id").alias("_blob_id"), F.col("place").alias("_place"), "todo")
    same = (F.col("blob_id") == F.col("_blob_id")) & F.col("place").eqNullSafe(F.col("_place"))
    texts = keyed.join(wanted.hint("shuffle_hash"), same).select(
        "blob_id", "todo", text_of("text").alias("text")
    )
    # Repeated rows are scanned alike; the set keeps each span once.
    spans = _scanned(texts, rules).groupBy("blob_id").agg(
        F.collect_set(F.struct("order", "start", "end")).alias("found")
    )

    def scan(k: Column) -> Column:
        own = F.filter(F.coalesce("found", F.array()), lambda x: x["order"] == k)
        spans = F.transform(F.array_sort(own), lambda x: F.struct(x["start"], x["end"]))
        rule = F.get(F.array(*[F.struct(F.lit(r.name), F.lit(r.version)) for r in rules]), k)
        return F.struct(
            rule["col1"].alias("rule"), rule["col2"].alias("version"), spans.alias("spans")
        )

    return todo.join(spans, "blob_id", "left").select(
        "blob_id", F.transform("todo", scan).cast(LEDGER_SCHEMA.partition("scans ")[2]).alias("scans")
    )


def findings(
    versions: DataFrame, place: str, ledger: DataFrame, rules: tuple[Rule, ...] = RULES
) -> DataFrame:
    """``place`` and ``found`` for every row of ``versions``: an array of struct(start, order, rule,
    end) by start and then by the order of ``rules``, empty if nothing was found. Positions count
    code points, the end is exclusive. Entries of other rule versions in the ledger are ignored.

    Empty tables give no rows; repeated rows come back as often as they were given, and a null place
    like any other. A blob may have any number of places: the join back can be split.
    """
    order = {f"{rule.name} {rule.version}": k for k, rule in enumerate(rules)}
    known = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])
    rows = (
        ledger.select("blob_id", F.explode("scans").alias("scan"))
        .withColumn("order", F.element_at(known, F.concat_ws(" ", "scan.rule", "scan.version")))
        .where("order is not null and size(scan.spans) > 0")
        .select("blob_id", "order", "scan.rule", F.explode("scan.spans").alias("span"))
    )
    entry = F.struct("span.start", "order", "rule", "span.end")
    found = rows.groupBy("blob_id").agg(F.array_sort(F.collect_set(entry)).alias("found"))
    empty = F.array().cast("array<struct<start:bigint,order:int,rule:string,end:bigint>>")
    return (
        blob_ids(versions.select(place, "text"))
        .select(place, own_exchange("blob_id").alias("blob"))
        .join(found.select(own_exchange("blob_id").alias("blob"), "found"), "blob", "left")
        .select(place, F.coalesce("found", empty).alias("found"))
    )
