"""What the operators ask of Spark, over tables stored as parquet."""

from __future__ import annotations

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

import labreports as lab
from labreports.operators import details
from labreports.plans.scope import few_rows
from labreports.sources.fixtures import FIXTURE_SQL
from labreports.sources.warehouse import SCHEMAS, jdbc_tables, parquet_tables

DAYS = (dt.date(1995, 1, 1), dt.date(2001, 8, 1))


@pytest.fixture(scope="module")
def stored(spark, small_tables, tmp_path_factory):
    root = tmp_path_factory.mktemp("warehouse")
    for name in FIXTURE_SQL:
        small_tables[name].write.parquet(f"{root}/{name}")
    return parquet_tables(spark, str(root))


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def searches(spark):
    return spark.createDataFrame(
        [("s", "house", 0, None)], "search_id string, name string, facility_id int, dob string"
    )


REPORTS = {
    "tube_summary": lambda spark, t: lab.tube_summary(t),
    "order_summary": lambda spark, t: lab.order_summary(t, *DAYS),
    "messages": lambda spark, t: lab.status_history_messages(t),
    "routine": lambda spark, t: lab.routine_test_details(t),
    "micro": lambda spark, t: lab.micro_test_details(t),
    "groups": lambda spark, t: lab.report_group_details(t),
    "status": lambda spark, t: lab.status_details(t),
    "header": lambda spark, t: lab.requisition_header(t),
    "environment": lambda spark, t: lab.environment_requisition_header(t),
    "demographics": lambda spark, t: lab.requisition_demographics(t),
    "search": lambda spark, t: lab.patient_search(t, searches(spark)),
    "patient": lambda spark, t: lab.patient_details(t),
    "primary_groups": lambda spark, t: lab.primary_groups(t["dir_user"], t["dir_group"]),
    "access": lambda spark, t: lab.access_report(
        t["dir_user"],
        t["dir_attribute_value"],
        spark.createDataFrame([("user1", "APP1")], "user_id string, app string"),
    ),
}


@pytest.mark.parametrize("name", REPORTS)
def test_no_pairs_of_whole_tables_and_no_python(spark, stored, name):
    text = plan(REPORTS[name](spark, stored))
    for costly in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas"):
        assert costly not in text


def test_one_requisition_is_pushed_to_every_large_scan(spark, stored):
    one = spark.createDataFrame([("r10",)], "requisition_id string")
    text = plan(lab.routine_test_details(stored, one))
    for scan in re.findall(r"FileScan parquet \[[^\n]*", text):
        columns = scan.split("]")[0]
        if "textual_result" in columns or "status_date_time" in columns or "priority" in columns:
            pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", scan).group(1)
            assert re.search(r"(In|EqualTo)\((requisition_id|lab_order_details_fk|accession_number),", pushed)


def scanned_large_tables(text):
    """The scans of tables that hold a row per detail, result or event."""
    large = ("textual_result", "status_date_time", "priority", "order_detail_status")
    scans = re.findall(r"FileScan parquet \[[^\n]*", text)
    return [scan for scan in scans if any(word in scan.split("]")[0] for word in large)]


@pytest.mark.parametrize("asked", ["many requisitions", "one with many details"])
def test_many_keys_narrow_every_large_table_by_a_semi_join(spark, stored, asked, monkeypatch):
    monkeypatch.setattr(few_rows, "__defaults__", (3,))
    keys = stored["dim_lab_order"].select("requisition_id")
    if asked == "one with many details":
        counts = stored["dim_lab_order_details"].groupBy("requisition_id").count()
        keys = counts.orderBy(F.desc("count"), "requisition_id").limit(1).select("requisition_id")
    text = plan(lab.routine_test_details(stored, keys))
    assert text.count("LeftSemi") >= len(scanned_large_tables(text)) - 1
    everything = {str(r) for r in lab.routine_test_details(stored).collect()}
    wanted = {r[0] for r in keys.collect()}
    got = lab.routine_test_details(stored, keys).collect()
    assert {str(r) for r in got} <= everything
    assert {r["requisition_id"] for r in got} <= wanted


def test_the_window_narrows_details_and_results(stored):
    text = plan(lab.order_summary(stored, dt.date(1995, 1, 1), dt.date(1995, 1, 7)))
    assert text.count("LeftSemi") >= 3


def test_few_facilities_and_birth_dates_reach_the_scan(spark, stored):
    def search(facility, dob):
        asked = spark.createDataFrame(
            [("s", "", facility, dob)], "search_id string, name string, facility_id int, dob string"
        )
        return plan(lab.patient_search(stored, asked))

    pushed = lambda text, name: re.search(rf"PushedFilters: \[[^\]]*EqualTo\({name},", text)
    assert pushed(search(3, None), "facility_fk")
    assert pushed(search(0, "01021940"), "dob")


def test_a_contains_search_has_no_constant_key(spark, stored):
    asked = spark.createDataFrame(
        [("s", " ldin cust", 0, None)], "search_id string, name string, facility_id int, dob string"
    )
    text = plan(lab.patient_search(stored, asked))
    assert "Generate explode(CASE WHEN" in text and "'' AS value" not in text


def test_a_hot_history_key_is_split(spark, stored):
    """The join of orders and events has shuffles of its own, which adaptive execution can split."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "8",
    }
    t = dict(stored)
    first = t["dim_lab_order_details"].select("accession_number", "order_test_code").first()
    hot = F.col("status_date_time").isNotNull() & (F.hash("status_date_time") % 2 == 0)
    for name, value in zip(("accession_number", "order_test_code"), first):
        t["status_history"] = t["status_history"].withColumn(
            name, F.when(hot, value).otherwise(F.col(name))
        )
    before = {key: spark.conf.get(key, None) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        messages = lab.status_history_messages(t)
        messages.collect()
        assert "SortMergeJoin(skew=true)" in plan(messages)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_scans_read_only_the_columns_used(stored):
    text = plan(lab.tubes_not_received(stored["dim_lab_order_details"]))
    read = re.search(r"ReadSchema: struct<(.*?)>", text).group(1)
    assert "report_notes" not in read and "order_test_name" not in read
    phones = lab.account_attributes(
        stored["dir_user"],
        stored["dir_user"].select(stored["dir_user"]["sam_account_name"].alias("user_id")),
        ["telephone_number"],
    )
    assert "mail" not in plan(phones)


def test_stored_tables_keep_their_columns(spark, stored, small_tables):
    for name, ddl in SCHEMAS.items():
        expected = spark.createDataFrame([], ddl).dtypes
        assert stored[name].dtypes == expected
        assert small_tables[name].dtypes == expected


def test_stored_tables_give_the_same_report(stored, small_tables):
    left, right = lab.status_details(stored), lab.status_details(small_tables)
    assert sorted(map(str, left.collect())) == sorted(map(str, right.collect()))


def test_jdbc_reads_are_split():
    class Reader:
        def __init__(self):
            self.given = {}

        def format(self, name):
            self.given["format"] = name
            return self

        def options(self, **options):
            self.given.update(options)
            return self

        def load(self):
            return self.given

    class Session:
        @property
        def read(self):
            return Reader()

    split = {"partitionColumn": "lab_order_fk", "lowerBound": 0, "upperBound": 9, "numPartitions": 3}
    tables = jdbc_tables(Session(), "jdbc:x", "dw", {"fetchsize": "1000"}, {"results": split})
    assert tables["results"]["numPartitions"] == 3
    assert tables["results"]["dbtable"] == "dw.results"
    assert "numPartitions" not in tables["dim_lab"]
    assert set(tables) == set(SCHEMAS)


@pytest.mark.parametrize("report", [lab.routine_test_details, lab.micro_test_details, lab.status_details])
def test_wide_rows_are_not_shuffled_for_their_messages(small_tables, report):
    """Rows and messages meet in the shuffle by requisition, and lines are made distinct in one."""
    plan = report(small_tables)._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert not any("order_test_code" in line for line in joins)
    assert "line#" not in "".join(line for line in plan.splitlines() if "Exchange" in line)


def test_messages_are_the_same_beside_large_groups(spark, make_tables):
    """Accessions and tests may be null, orders without a lab, events and details repeated."""
    tests = [("A1", "T1"), ("A1", "T2"), (None, "T1"), ("A2", None), ("A1", "T1")]
    details = [
        {
            "lab_order_details_pk": f"{req}-{n}",
            "lab_order_fk": order,
            "requisition_id": req,
            "accession_number": accession,
            "order_test_code": code,
            "order_test_name": "Test",
            "test_category": "GEN",
            "order_test_fk": 1,
            "priority": "RTN",
        }
        for req, order in (("R1", 1), ("R2", 2), ("R3", None))
        for n, (accession, code) in enumerate(tests)
    ]
    event = {"order_test_code": "T1", "event_status_code": "D", "entered_by": "U1"}
    t = make_tables(
        dim_lab_order_details=details,
        dim_order_test=[{"order_test_pk": 1, "micro_culture_format_flag": "N", "order_test_type": "T"}],
        dim_lab_order=[{"lab_order_pk": 1, "requisition_id": "R1", "lab_fk": 1}, {"lab_order_pk": 2}],
        dim_lab=[{"lab_pk": 1, "lab_id": "SE"}],
        status_history=[event | {"accession_number": key} for key in ("A1", "A1", None)],
    )
    plain = sorted(map(str, lab.routine_test_details(t).collect()))
    spark.conf.set("spark.labreports.sampleEvery", "1")
    try:
        split = sorted(map(str, lab.routine_test_details(t).collect()))
    finally:
        spark.conf.unset("spark.labreports.sampleEvery")
    assert plain == split and len(plain) == 15
    assert sum("sh_msg='-'" not in row for row in plain) == 2


@pytest.mark.parametrize("found", [[], [(None, 10, 9)]])
def test_sampled_results_are_narrowed_only_for_large_orders(stored, found, monkeypatch):
    """To narrow them to many requisitions, all their details have to be shuffled."""
    monkeypatch.setattr(few_rows, "__defaults__", (3,))
    samples = []
    monkeypatch.setattr(details, "large_values", lambda sample, *_: samples.append(sample) or found)
    lab.routine_test_details(stored, stored["dim_lab_order"].select("requisition_id"))
    joins = [s._jdf.queryExecution().optimizedPlan().toString().count("LeftSemi") for s in samples]
    assert joins[0] == 1 and len(joins) == 1 + len(found) and all(n > 1 for n in joins[1:])
