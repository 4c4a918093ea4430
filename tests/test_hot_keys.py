"""One requisition, patient or detail holds a third of the rows: same reports, split plans."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

import labreports as lab
from labreports.plans.skew import SAMPLE_EVERY_CONF

DAYS = (dt.date(1995, 1, 1), dt.date(2001, 8, 1))


@pytest.fixture(scope="module")
def hot_tables(small_tables, tmp_path_factory, spark):
    """Fold a third of the requisitions into one, and a third of the results onto one detail."""
    t = dict(small_tables)
    hot = F.col("lab_order_fk") % 3 == 0
    t["dim_lab_order_details"] = t["dim_lab_order_details"].withColumns(
        {
            "requisition_id": F.when(hot, "R0").otherwise(F.col("requisition_id")),
            "accession_number": F.when(hot, "A0-0").otherwise(F.col("accession_number")),
        }
    )
    one = t["dim_lab_order_details"].filter("requisition_id = 'R0'").agg(
        F.min("lab_order_details_pk").alias("pk"), F.min_by("lab_order_fk", "lab_order_details_pk").alias("fk")
    ).first()
    t["results"] = t["results"].withColumns(
        {
            "lab_order_details_fk": F.when(hot, one["pk"]).otherwise(F.col("lab_order_details_fk")),
            "lab_order_fk": F.when(hot, one["fk"]).otherwise(F.col("lab_order_fk")),
        }
    )
    t["dim_lab_order"] = t["dim_lab_order"].withColumn(
        "spectra_mrn_assc_fk",
        F.when(F.col("lab_order_pk") % 3 == 0, 1).otherwise(F.col("spectra_mrn_assc_fk")),
    )
    root = tmp_path_factory.mktemp("hot")
    for name in ("dim_lab_order", "dim_lab_order_details", "results"):
        t[name].write.parquet(f"{root}/{name}")
        t[name] = spark.read.parquet(f"{root}/{name}")
    return t


REPORTS = {
    "tubes": lab.tube_summary,
    "routine": lab.routine_test_details,
    "status": lab.status_details,
    "orders": lambda t: lab.order_summary(t, *DAYS),
}


@pytest.mark.parametrize("name", REPORTS)
def test_split_plan_gives_the_same_rows(spark, hot_tables, name):
    plain = REPORTS[name](hot_tables)
    spark.conf.set(SAMPLE_EVERY_CONF, "40")
    try:
        split = REPORTS[name](hot_tables)
    finally:
        spark.conf.unset(SAMPLE_EVERY_CONF)
    assert "_slice" in split._jdf.queryExecution().analyzed().toString()
    assert "_slice" not in plain._jdf.queryExecution().analyzed().toString()
    assert sorted(map(str, split.collect())) == sorted(map(str, plain.collect()))


def test_tied_results_are_numbered_alike_in_any_input_order_and_plan(spark, small_tables):
    """Results of one culture that differ in organism, drug and isolate only."""
    tied = F.col("result_sequence").isNull()
    same = {
        name: F.when(tied, F.lit("x")).otherwise(F.col(name))
        for name in ("result_test_code", "result_test_name", "textual_result", "textual_result_full")
    }
    results = small_tables["results"].withColumns(same)
    seen = []
    for every, order in ((None, F.asc), (None, F.desc), ("1", F.asc)):
        t = {**small_tables, "results": results.orderBy(order("micro_isolate"), order("lab_order_fk"))}
        if every:
            spark.conf.set(SAMPLE_EVERY_CONF, every)
        try:
            seen.append(sorted(map(str, lab.micro_test_details(t).collect())))
        finally:
            spark.conf.unset(SAMPLE_EVERY_CONF)
    assert seen[0] and seen[0] == seen[1] == seen[2]


def test_only_rows_of_large_groups_are_sliced(spark):
    from labreports.functions.ordering import SortKey
    from labreports.plans.skew import LargeGroups, number_rows

    rows = spark.range(100).select(F.concat(F.lit("g"), F.col("id") % 4).alias("grp"), "id")
    numbered = number_rows(rows, "grp", [SortKey("id")], "n", LargeGroups(spark, "grp", [("g1", 25)]))
    text = numbered._jdf.queryExecution().optimizedPlan().toString()
    ordinary = text.split("Union")[1].split("_slice")[0]
    assert "NOT" in ordinary and "Aggregate" not in ordinary.split("Range")[0]
    assert numbered.count() == 100
