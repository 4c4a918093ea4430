"""Counting, numbering and joining when one group may hold much of the table.

A window puts each of its groups into one task, and an outer join cannot split
a heavy key on its optional side. Both are the cheapest plan while groups are
small, so that is what runs by default. A sample of the keys, taken first,
shows whether any group is too large for one task; if so:

* a count is aggregated (which combines before the shuffle) and joined back,
* numbering takes the large groups apart from the others, cuts each into slices
  along its sort order, numbers within the slices, and adds the size of the
  earlier slices; copies of one row are counted, numbered together and written
  out again. All other groups keep the plain plan,
* the outer join becomes an inner join, which adaptive execution can split on
  either side, plus the rows that have no match.

Both ways give the same rows, as long as rows that tie in the sort order agree in
all columns. The sample is drawn by a hash of the rows' own values, so it does not
depend on how a table is laid out in files, and what it found for a table is
remembered for later calls in the session. A caller may also take it once, store
it (``large_keys``) and add it to the tables; then no sample is drawn.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labreports.functions.ordering import SortKey, orderings

#: One row in this many is looked at; a group seen SEEN times counts as large.
SAMPLE_EVERY_CONF = "spark.labreports.sampleEvery"
SAMPLE_EVERY = 1 << 18
SEEN = 3
#: About this many slices are cut from a large group.
SLICES = 256
#: Sort keys that a cut holds in any case.
LEADING = 4
#: Parts in which the rows of a large group meet its cuts.
PARTS = 64
#: Copies of one row that one task writes out.
COPIES_PER_PIECE = 1_000_000
#: Large groups that are split at most, the largest first.
MOST = 4096


def _sample_every(spark: SparkSession) -> int:
    return int(spark.conf.get(SAMPLE_EVERY_CONF, str(SAMPLE_EVERY)))


def least_large(spark: SparkSession) -> int:
    """About as many rows as the smallest group has that a sample calls large."""
    return SEEN * _sample_every(spark)


def sampled(rows: DataFrame, *identity: str) -> DataFrame:
    """One row in ``sampleEvery``, by a hash of the columns that tell rows apart (default: all)."""
    every = _sample_every(rows.sparkSession)
    place = F.pmod(F.xxhash64(*(identity or rows.columns)), F.lit(every))
    return rows if every == 1 else rows.filter(place == 0)


#: What samples have found, by the meaning of their plan.
_found: dict[tuple, list[tuple]] = {}


def large_values(sample: DataFrame, *keys: str) -> list[tuple]:
    """Key values seen often in a sample, each followed by its estimated row count.

    The ``MOST`` largest are listed; whatever else there is has fewer rows than
    each of those and keeps the plain plan.
    """
    spark = sample.sparkSession
    every = _sample_every(spark)
    known = (spark.sparkContext.applicationId, every, sample.semanticHash(), keys)
    if known not in _found:
        counts = sample.groupBy(*keys).count().filter(F.col("count") >= SEEN)
        rows = counts.orderBy(F.desc("count"), *keys).limit(MOST).collect()
        _found[known] = [(*row[:-1], row["count"] * every) for row in rows]
    return _found[known]


#: The table of stored findings, if the caller's tables hold one (``large_keys``), and its columns.
LARGE_KEYS = "large_keys"
LARGE_KEYS_SCHEMA = "statistic string, key string, order bigint, n bigint"


def stored_values(t: Mapping[str, DataFrame], statistic: str) -> list[tuple] | None:
    """What a stored table lists under ``statistic``, as key, order and rows; None without a table."""
    table = t.get(LARGE_KEYS)
    if table is None:
        return None
    rows = table.filter(F.col("statistic") == statistic).limit(2 * MOST).collect()
    return [(row["key"], row["order"], row["n"]) for row in rows]


def as_stored(sample: DataFrame, statistic: str, key: str, order: str | None = None) -> DataFrame:
    """The rows of a stored table that ``large_values`` would find in ``sample``."""
    columns = [key] if order is None else [key, order]
    counts = sample.groupBy(*columns).count().filter(F.col("count") >= SEEN)
    every = _sample_every(sample.sparkSession)
    return counts.orderBy(F.desc("count"), *columns).limit(MOST).select(
        F.lit(statistic).alias("statistic"),
        F.col(key).cast("string").alias("key"),
        (F.lit(None) if order is None else F.col(order)).cast("bigint").alias("order"),
        (F.col("count") * every).cast("bigint").alias("n"),
    )


class LargeGroups:
    """Groups of ``key`` too large for one task, with their estimated row counts.

    ``any`` may also be set for a large key of a joined table that belongs to
    no group.
    """

    def __init__(self, spark: SparkSession, key: str, found: list[tuple]):
        rows = Counter()
        for value, count in found:
            rows[value] += count
        self.any = bool(rows)
        rows.pop(None, None)
        self.count = len(rows)
        self._table = pa.table(
            {key: list(rows), "_rows": pa.array(rows.values(), pa.int64())}
        )
        self._spark = spark

    @classmethod
    def of(cls, sample: DataFrame, key: str, stored: list[tuple] | None = None) -> LargeGroups:
        """From a stored statistic if there is one, else from the sample."""
        if stored is None:
            found = large_values(sample, key)
        else:
            found = [(value, n) for value, _, n in stored]
        return cls(sample.sparkSession, key, found)

    def frame(self) -> DataFrame:
        return self._spark.createDataFrame(self._table)

    def holds(self, key: Column) -> Column:
        """Whether a row belongs to one of the groups."""
        values = self._table.column(0).to_pylist()
        return F.coalesce(key.isin(values), F.lit(False))


def own_shuffle(rows: DataFrame, on: list[str]) -> DataFrame:
    """Add ``_on``, the columns as one join key that nothing before has been shuffled by.

    Adaptive execution splits a hot key only where the join has shuffles of its own. Rows with a
    null in the key are dropped, as an inner join drops them.
    """
    present = F.lit(True)
    for column in on:
        present = present & F.col(column).isNotNull()
    return rows.filter(present).withColumn("_on", F.struct(*on))


def group_total(
    rows: DataFrame, keys: list[str], total: Column, name: str, large: LargeGroups
) -> DataFrame:
    """Add to each row an aggregate of its group."""
    if not large.any:
        return rows.withColumn(name, total.over(Window.partitionBy(*keys)))
    totals = rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(total.alias(name))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return rows.join(totals, same, "left").drop(*[f"_{k}" for k in keys])


def number_rows(
    rows: DataFrame, group: str, keys: list[SortKey], name: str, large: LargeGroups
) -> DataFrame:
    """Number the rows of each group 1, 2, 3... in the order of ``keys``."""
    window = Window.partitionBy(group).orderBy(*orderings(keys))
    number = F.row_number().over(window).cast("bigint")
    if not (large.any and large.count):
        return rows.withColumn(name, number)
    in_large = large.holds(F.col(group))
    ordinary = rows.filter(~in_large).withColumn(name, number)
    return ordinary.unionByName(_number_large(rows.filter(in_large), group, keys, name, large))


def _number_large(
    rows: DataFrame, group: str, keys: list[SortKey], name: str, large: LargeGroups
) -> DataFrame:
    # Copies of a row cannot be told apart by any slice, so they are numbered as
    # one row that stands for many.
    copies = rows.groupBy(*rows.columns).agg(F.count("*").alias("_copies"))
    sliced = _sliced(copies, group, keys, large)
    running = Window.partitionBy(group, "_slice").orderBy(*orderings(keys))
    before = Window.partitionBy(group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    earlier = (
        sliced.filter("_in_large_group")
        .groupBy(group, "_slice")
        .agg(F.sum("_copies").alias("_size"))
        .select(group, "_slice", F.sum("_size").over(before).alias("_earlier"))
    )
    up_to = F.sum("_copies").over(running.rowsBetween(Window.unboundedPreceding, 0))
    numbered = (
        sliced.withColumn("_up_to", up_to)
        .join(earlier, [group, "_slice"], "left")
        .withColumn("_last", F.col("_up_to") + F.coalesce("_earlier", F.lit(0)))
    )
    return _one_row_per_copy(numbered, rows.columns, name)


def _one_row_per_copy(numbered: DataFrame, columns: list[str], name: str) -> DataFrame:
    """Write each copy out with its own number, pieces of many copies in different tasks."""
    first = F.col("_last") - F.col("_copies") + 1 + F.col("_piece") * COPIES_PER_PIECE
    last = F.least(first + (COPIES_PER_PIECE - 1), F.col("_last"))
    pieces = F.sequence(F.lit(0), F.floor((F.col("_copies") - 1) / COPIES_PER_PIECE))
    return (
        numbered.select(*columns, "_copies", "_last", F.explode(pieces).alias("_piece"))
        .repartition(*columns, "_piece")
        .select(*columns, F.explode(F.sequence(first, last)).alias(name))
    )


def _sliced(rows: DataFrame, group: str, keys: list[SortKey], large: LargeGroups) -> DataFrame:
    """Give each row of a large group its slice along the sort order; other groups stay whole.

    Slices end at sampled rows. A cut holds the leading sort keys only, and all keys just where
    sampled rows agree in the leading ones, so that long texts behind them rarely travel. The slice of
    a row is found by halving, so it takes about eight comparisons.

    Rows meet the cuts of their group in parts, by a hash of their place, and not by the group alone,
    which would bring the whole group into one task, and keep it there for the windows that follow.
    """
    place = F.struct(*[F.col(k.column) for k in keys])
    part = F.pmod(F.xxhash64("_place"), F.lit(PARTS))
    placed = rows.withColumn("_place", place)
    every = F.greatest(F.col("_rows") / SLICES, F.lit(1)).cast("bigint")
    cuts = (
        placed.join(large.frame(), group)
        .filter(F.pmod(F.xxhash64("_place"), every) == 0)
        .groupBy(group)
        .agg(F.collect_set("_place").alias("_places"))
        .select(group, _ordered(F.col("_places"), keys).alias("_ordered"))
        .select(group, _cuts(F.col("_ordered"), keys).alias("_cuts"))
        .withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)).cast("array<bigint>")))
    )
    return (
        placed.withColumn("_part", part)
        .join(cuts, [group, "_part"], "left")
        .withColumn("_in_large_group", F.col("_cuts").isNotNull())
        .withColumn(
            "_slice",
            F.when(F.col("_in_large_group"), _passed(F.col("_cuts"), F.col("_place"), keys)).otherwise(0),
        )
        .drop("_cuts", "_place", "_part")
    )


def _ordered(places: Column, keys: list[SortKey]) -> Column:
    def compared(a: Column, b: Column) -> Column:
        return F.when(_before(a, b, keys), -1).when(_before(b, a, keys), 1).otherwise(0)

    return F.array_sort(places, compared)


def _cuts(ordered: Column, keys: list[SortKey]) -> Column:
    """Sampled places in their order, as their leading keys and, where those tie, all keys."""

    def leading(place: Column) -> Column:
        return F.struct(*[place[key.column].alias(key.column) for key in keys[:LEADING]])

    def cut(place: Column, at: Column) -> Column:
        own = leading(place)
        ties = own.eqNullSafe(leading(F.get(ordered, at - 1))) & (at > 0)
        ties = ties | (own.eqNullSafe(leading(F.get(ordered, at + 1))) & (at + 1 < F.size(ordered)))
        return F.struct(own.alias("lead"), F.when(ties, place).alias("all"))

    return F.transform(ordered, cut)


def _passed(cuts: Column, place: Column, keys: list[SortKey]) -> Column:
    """How many of the sorted cuts stand before a place, by halving the range that is left."""
    lead = keys[:LEADING]

    def stands_before(cut: Column) -> Column:
        return _before(cut["lead"], place, lead) | (
            _same(cut["lead"], place, lead)
            & F.coalesce(_before(cut["all"], place, keys), F.lit(False))
            & cut["all"].isNotNull()
        )

    def halved(low: Column, step: Column) -> Column:
        fits = low + step <= F.size(cuts)
        return F.when(fits & stands_before(F.get(cuts, low + step - 1)), low + step).otherwise(low)

    # Cuts are sampled, so there may be more than SLICES; twice eight steps find any of 65,535.
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(16))])
    return F.aggregate(F.filter(steps, lambda step: step <= F.size(cuts)), F.lit(0), halved)


def _same(a: Column, b: Column, keys: list[SortKey]) -> Column:
    same = F.lit(True)
    for key in keys:
        same = same & a[key.column].eqNullSafe(b[key.column])
    return same


def _before(a: Column, b: Column, keys: list[SortKey]) -> Column:
    """Whether place ``a`` sorts strictly before place ``b``."""
    before = F.lit(False)
    for key in reversed(keys):
        x, y = a[key.column], b[key.column]
        if key.descending:
            first = (x.isNull() & y.isNotNull()) | F.coalesce(x > y, F.lit(False))
        else:
            first = (x.isNotNull() & y.isNull()) | F.coalesce(x < y, F.lit(False))
        before = first | (x.eqNullSafe(y) & before)
    return before


def left_join_many(
    left: DataFrame, right: DataFrame, on: list[str], large: LargeGroups
) -> DataFrame:
    """Left outer join in which one left row may match very many right rows."""
    if not large.any:
        return left.join(right, on, "left")
    matched = left.join(right, on)
    alone = left.join(right.select(*on).distinct(), on, "left_anti")
    return matched.unionByName(alone, allowMissingColumns=True)
