"""Rows that reports shuffle: how often, how wide, and that the rows they give stay the same."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import labreports as lab
from labreports.operators import details, history
from labreports.plans import scope
from labreports.plans.packing import pack, pack_more, unpack, unpack_first
from labreports.plans.scope import few_rows


def executed(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def shuffled(spark):
    """Every table is large: no join is a broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_numbers_and_the_first_column_leave_a_packed_text(spark):
    odd = [None, "", "\x1f", "\x1en", "a\x1fb"]
    rows = [(a, b, n, i) for a in odd for b in odd for i, n in enumerate([None, 0, -7])]
    frame = spark.createDataFrame(rows, "a string, b string, n int, i bigint")
    one = pack_more(pack(frame, "one", ["a", "b", "n"]), "one", ["i"])
    assert one.columns == ["one"]
    apart = unpack_first(one, "one", "a")
    back = unpack(apart, "one", ["b", "n", "i"], {"n": "int", "i": "bigint"})
    assert back.select("a", "b", "n", "i").dtypes == frame.dtypes
    assert sorted(map(repr, map(tuple, back.select("a", "b", "n", "i").collect()))) == sorted(map(repr, rows))


def rows_with_tests(make_tables):
    """Two details of one key, results without a test, with an unknown one, and tests listed twice."""
    detail = {
        "requisition_id": "R1",
        "lab_order_fk": 1,
        "accession_number": "A1",
        "order_test_code": "T1",
        "order_test_name": "Test",
        "test_category": "GEN",
        "order_test_fk": 1,
    }
    keys = ["d1", "d1", "d2", "d3", "d4", None]
    results = [("d1", 1), ("d1", 2), ("d2", None), ("d2", 9), ("d3", 9), ("d3", 3), (None, 1)]
    return make_tables(
        dim_lab_order_details=[detail | {"lab_order_details_pk": key} for key in keys],
        dim_order_test=[{"order_test_pk": 1, "micro_culture_format_flag": "N", "order_test_type": "T"}],
        dim_result_test=[
            {"result_test_pk": pk, "sequence_number": n, "report_grouping": f"G{n}"}
            for pk, n in ((1, 5), (2, 6), (3, 7), (3, 8), (None, 4))
        ],
        results=[
            {"lab_order_details_fk": key, "result_test_fk": test, "result_test_name": f"N{n}"}
            for n, (key, test) in enumerate(results)
        ],
    )


@pytest.mark.parametrize("report", [lab.report_group_details, lab.status_details])
def test_result_tests_give_the_same_rows_after_the_details(make_tables, monkeypatch, report):
    t = rows_with_tests(make_tables)
    late = sorted(map(str, report(t).collect()))
    monkeypatch.setattr(details, "_unlisted_tests", lambda *_: None)
    assert late == sorted(map(str, report(t).collect()))
    # d1 twice with two results, d2 without any, d3 with a test listed twice, two without results.
    assert len(late) == 4 + 1 + 2 + 2


@pytest.mark.parametrize("report", [lab.report_group_details, lab.status_details])
def test_results_are_shuffled_once_before_they_meet_details(small_tables, shuffled, report):
    """By detail; only the rows that are left are shuffled by test, those without a result spread out."""
    text = executed(report(small_tables))
    by_test = [line for line in text.splitlines() if "Exchange hashpartitioning(result_test_fk" in line]
    assert len(by_test) == 2 and all("_dealt" in line for line in by_test)


def test_many_unlisted_tests_keep_the_join_by_test(small_tables, shuffled, monkeypatch):
    monkeypatch.setattr(few_rows, "__defaults__", (0,))
    t = {**small_tables, "dim_result_test": small_tables["dim_result_test"].filter("result_test_pk % 2 = 0")}
    text = executed(lab.report_group_details(t))
    assert "_dealt" not in text and "Exchange hashpartitioning(result_test_fk" in text


def test_lines_of_a_message_need_no_shuffle_of_their_own(small_tables, shuffled, monkeypatch):
    """Events and lines are each shuffled once, unless a test has very many details."""
    plain = executed(lab.status_details(small_tables))
    rows = sorted(map(str, lab.status_details(small_tables).collect()))
    monkeypatch.setattr(details, "may_have_large_tests", lambda *_: True)
    split = executed(lab.status_details(small_tables))
    assert plain.count("Exchange") == split.count("Exchange") - 2
    assert rows == sorted(map(str, lab.status_details(small_tables).collect()))


def test_a_large_test_is_seen(spark, make_tables):
    pair = {"accession_number": "A1", "order_test_code": "T1"}
    t = make_tables(
        dim_lab_order_details=[pair | {"lab_order_details_pk": f"d{n}"} for n in range(3)]
        + [{"lab_order_details_pk": f"e{n}", "accession_number": "A2"} for n in range(9)]
    )
    asked = t["dim_lab_order_details"]
    assert not history.may_have_large_tests(t, asked)
    spark.conf.set("spark.labreports.sampleEvery", "1")
    try:
        assert history.may_have_large_tests(t, asked)
        assert not history.may_have_large_tests(t, asked.filter("accession_number = 'A2'"))
    finally:
        spark.conf.unset("spark.labreports.sampleEvery")


def test_very_many_requisitions_leave_the_narrowing_to_the_joins(small_tables, monkeypatch):
    monkeypatch.setattr(few_rows, "__defaults__", (3,))
    keys = small_tables["dim_lab_order"].select("requisition_id").filter(F.hash("requisition_id") % 4 == 0)
    narrowed = lab.routine_test_details(small_tables, keys)
    monkeypatch.setattr(scope, "MANY", 4)
    many = lab.routine_test_details(small_tables, keys)
    # What is left are the two reads of details by requisition.
    assert many._jdf.queryExecution().optimizedPlan().toString().count("LeftSemi") == 2
    assert narrowed._jdf.queryExecution().optimizedPlan().toString().count("LeftSemi") > 2
    found = sorted(map(str, many.collect()))
    assert found and found == sorted(map(str, narrowed.collect()))
