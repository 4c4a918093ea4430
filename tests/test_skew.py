"""Splitting large groups gives the rows that the plain plans give."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from labreports.functions.ordering import SortKey
from labreports.plans.skew import LargeGroups, group_total, left_join_many, number_rows, sampled

KEYS = [SortKey("day", descending=True), SortKey("name"), SortKey("id")]


@pytest.fixture(scope="module")
def rows(spark):
    """A third of the rows in one group, many ties and some nulls in the sort keys."""
    frame = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot")
        .otherwise(F.concat(F.lit("g"), (F.col("id") % 100).cast("string")))
        .alias("grp"),
        F.when(F.col("id") % 7 != 0, F.col("id") % 5).alias("day"),
        F.when(F.col("id") % 11 != 0, F.concat(F.lit("n"), F.col("id") % 13)).alias("name"),
        "id",
    )
    return frame.cache()


def expected_numbers(rows):
    numbers = {}
    groups = {}
    for row in rows.collect():
        groups.setdefault(row["grp"], []).append(row)

    def place(row):
        day, name = row["day"], row["name"]
        return (day is not None, -(day or 0), name is None, name or "", row["id"])

    for members in groups.values():
        for number, row in enumerate(sorted(members, key=place), 1):
            numbers[row["id"]] = number
    return numbers


@pytest.mark.parametrize("large", [[], [("hot", 1000)], [("hot", 1000), ("g1", 40), (None, 9)]])
def test_numbering(spark, rows, large):
    groups = LargeGroups(spark, "grp", large)
    numbered = number_rows(rows, "grp", KEYS, "n", groups)
    assert {r["id"]: r["n"] for r in numbered.collect()} == expected_numbers(rows)


@pytest.mark.parametrize("per_piece", [1_000_000, 7])
def test_copies_are_numbered_too(spark, rows, per_piece, monkeypatch):
    monkeypatch.setattr("labreports.plans.skew.COPIES_PER_PIECE", per_piece)
    copied = rows.unionByName(rows.filter("id = 300").crossJoin(spark.range(500).select()))
    keys = KEYS[:2] + [SortKey("id")]
    plain = number_rows(copied, "grp", keys, "n", LargeGroups(spark, "grp", []))
    split = number_rows(copied, "grp", keys, "n", LargeGroups(spark, "grp", [("hot", 1500)]))
    assert sorted(map(str, split.collect())) == sorted(map(str, plain.collect()))
    assert split.filter("id = 300").count() == 501


def test_large_group_is_cut_into_many_slices(spark, rows):
    from labreports.plans.skew import _sliced

    sliced = _sliced(rows, "grp", KEYS, LargeGroups(spark, "grp", [("hot", 1000)]))
    sizes = sliced.filter("grp = 'hot'").groupBy("_slice").count().agg(F.count("*"), F.max("count"))
    slices, largest = sizes.first()
    assert slices > 100 and largest < 100
    assert sliced.filter("grp <> 'hot' and _slice <> 0").count() == 0


def test_slices_of_a_group_are_numbered_in_tasks_of_their_own(spark, rows):
    """Without broadcasts too: rows meet the cuts in parts, and windows have a shuffle by slice."""
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        numbered = number_rows(rows, "grp", KEYS, "n", LargeGroups(spark, "grp", [("hot", 1000)]))
        plan = numbered._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"hashpartitioning\(grp#\d+, _slice#\d+", plan)
        assert re.search(r"hashpartitioning\(grp#\d+, _part#\d+", plan)
        assert {r["id"]: r["n"] for r in numbered.collect()} == expected_numbers(rows)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


@pytest.mark.parametrize("large", [[], [("hot", 1000)]])
def test_totals(spark, rows, large):
    groups = LargeGroups(spark, "grp", large)
    totals = group_total(rows, ["grp", "name"], F.count("day"), "n", groups)
    expected = {}
    for row in rows.collect():
        key = (row["grp"], row["name"])
        expected[key] = expected.get(key, 0) + (row["day"] is not None)
    got = {(r["grp"], r["name"]): r["n"] for r in totals.collect()}
    assert got == expected and totals.count() == 3000


@pytest.mark.parametrize("large", [[], [(None, 5)]])
def test_left_join_with_many_matches(spark, large):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (None, "d")], "k int, v string")
    right = spark.createDataFrame(
        [(1, "x")] * 50 + [(3, "y"), (9, "z"), (None, "w")], "k int, w string"
    )
    joined = left_join_many(left, right, ["k"], LargeGroups(spark, "k", large))
    counts = {(r["k"], r["w"]): r["count"] for r in joined.groupBy("k", "w").count().collect()}
    assert counts == {(1, "x"): 50, (2, None): 1, (3, "y"): 1, (None, None): 1}


def test_large_groups_are_found_in_a_sample(spark, rows):
    spark.conf.set("spark.labreports.sampleEvery", "20")
    try:
        groups = LargeGroups.of(sampled(rows), "grp")
        found = {r["grp"]: r["_rows"] for r in groups.frame().collect()}
    finally:
        spark.conf.unset("spark.labreports.sampleEvery")
    assert 400 < found["hot"] < 2000


def test_ordinary_groups_are_not_found(rows):
    assert not LargeGroups.of(sampled(rows), "grp").any


def test_cuts_are_passed_by_halving(spark):
    """The slice of a row is the number of cuts before it, as plain counting gives it."""
    from labreports.plans.skew import _before, _cuts, _ordered, _passed

    keys = [SortKey("a", descending=True), SortKey("b"), SortKey("c"), SortKey("d"), SortKey("e")]
    frame = spark.range(400).select(
        F.when(F.col("id") % 5 != 0, F.col("id") % 3).alias("a"),
        F.lit("x").alias("b"),
        F.when(F.col("id") % 7 != 0, F.col("id") % 2).alias("c"),
        F.lit(1).alias("d"),
        F.concat(F.lit("t"), F.col("id") * 37 % 400).alias("e"),
    )
    place = F.struct(*[F.col(k.column) for k in keys])
    places = frame.filter("length(e) = 3").agg(F.collect_set(place).alias("places"))
    cuts = places.select("places", _ordered(F.col("places"), keys).alias("ordered")).select(
        "places", "ordered", _cuts(F.col("ordered"), keys).alias("cuts")
    )
    joined = frame.withColumn("place", place).crossJoin(F.broadcast(cuts))
    counted = F.size(F.filter("places", lambda cut: _before(cut, F.col("place"), keys)))
    rows = joined.select(
        _passed(F.col("cuts"), F.col("place"), keys).alias("halved"), counted.alias("counted"), "cuts"
    ).collect()
    assert len(rows) == 400 and all(r.halved == r.counted for r in rows)
    assert len({r.halved for r in rows}) > 50
    assert all(cut["all"] is not None for cut in rows[0].cuts)  # leading keys tie everywhere here


def test_cuts_hold_later_keys_only_where_leading_ones_tie(spark):
    from labreports.plans.skew import _cuts, _ordered

    keys = [SortKey(name) for name in "abcde"]
    frame = spark.createDataFrame(
        [(1, 0, 0, 0, "long"), (2, 0, 0, 0, "first"), (2, 0, 0, 0, "second"), (None, 0, 0, 0, "last")],
        "a int, b int, c int, d int, e string",
    )
    places = frame.agg(F.collect_set(F.struct(*"abcde")).alias("places"))
    ordered = places.select(_ordered(F.col("places"), keys).alias("ordered"))
    cuts = ordered.select(_cuts(F.col("ordered"), keys).alias("cuts")).first().cuts
    assert [cut["lead"]["a"] for cut in cuts] == [1, 2, 2, None]
    assert [cut["all"] and cut["all"]["e"] for cut in cuts] == [None, "first", "second", None]
