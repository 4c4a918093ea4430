"""Reports over hand-made rows that the shared test tables do not reach."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

import labreports as lab
from tests.conftest import as_dicts

NOON = dt.datetime(2024, 1, 2, 12, 0)
DAY = dt.date(2024, 1, 2)


def detail(pk, **columns):
    base = {
        "lab_order_details_pk": pk,
        "lab_order_fk": 1,
        "requisition_id": "R1",
        "accession_number": "A1",
        "test_category": "GEN",
        "order_detail_status": "I",
        "clinical_status": "D",
        "order_test_fk": 1,
        "order_test_code": "T",
        "order_test_name": "CBC, full",
        "priority": "RTN",
        "lab_fk": 1,
    }
    return {**base, **columns}


def order(pk=1, **columns):
    base = {
        "lab_order_pk": pk,
        "requisition_id": f"R{pk}",
        "requisition_status": "F",
        "collection_date": DAY,
        "collection_date_time": NOON,
        "spectra_mrn_assc_fk": 1,
        "account_fk": 1,
        "lab_fk": 1,
        "modality_code": "M",
        "patient_type": "PT",
        "external_mrn": "007",
    }
    return {**base, **columns}


def event(**columns):
    base = {
        "accession_number": "A1",
        "order_test_code": "T",
        "event_status_code": "D",
        "status_date_time": NOON,
    }
    return {**base, **columns}


STAR = {
    "spectra_mrn_associations": [
        {"spectra_mrn_assc_pk": 1, "spectra_mrn_fk": 1, "facility_fk": 1}
    ],
    "spectra_mrn_master": [{"spectra_mrn_pk": 1, "spectra_mrn": "007", "mrn_status": "ACTIVE"}],
    "dim_facility": [{"facility_pk": 1, "facility_id": "F1", "client_fk": 1, "name": "Site"}],
    "dim_client": [{"client_pk": 1, "name": "Client"}],
    "dim_account": [{"account_pk": 1, "facility_fk": 1}],
    "dim_modality": [{"modality_code": "M"}],
    "dim_lab": [{"lab_pk": 1, "lab_id": "SE"}],
    "lov_patient_type": [{"patient_type": "PT", "patient_type_sub_group": "HEMO"}],
    "dim_order_test": [
        {"order_test_pk": 1, "micro_culture_format_flag": "N", "inquiry_grouping": "G"}
    ],
}


def test_tubes_of_an_accession_in_two_labs_multiply(make_tables):
    t = make_tables(
        dim_lab_order_details=[
            detail("a", lab_fk=1, specimen_container_desc="red"),
            detail("b", lab_fk=2, specimen_container_desc="blue"),
            detail("c", test_category="MISC", order_test_name="hemolyzed"),
            detail("d", test_category=None, accession_number="A2"),
            detail("e", test_category="CALC", accession_number="A3", clinical_status="S"),
        ]
    )
    rows = as_dicts(lab.tube_summary(t))
    a1 = [r for r in rows if r["accession_number"] == "A1"]
    assert sorted((r["lab_fk"], r["specimen_container_desc"]) for r in a1) == [
        (1, "blue"), (1, "red"), (2, "blue"), (2, "red"),
    ]
    assert {r["condition"] for r in a1} == {"hemolyzed"}
    calc = [r for r in rows if r["accession_number"] == "A3"]
    assert len(calc) == 1 and calc[0]["specimen_container_desc"] is None
    assert calc[0]["derived_status"] == "Scheduled"
    assert "A2" not in {r["accession_number"] for r in rows}
    assert sorted(r["sort_position"] for r in rows) == [1, 2, 3, 4, 5]


def test_tubes_not_received(make_tables):
    t = make_tables(
        dim_lab_order_details=[
            detail("a", specimen_container_desc="red"),
            detail("b", specimen_container_desc="blue"),
            detail("c", accession_number="A2", specimen_received_date_time=NOON),
            detail("d", accession_number="A2"),
            detail("e", accession_number="A3", test_category="CALC"),
            detail("f", requisition_id="R2", accession_number="A4", specimen_received_date_time=NOON),
        ]
    )
    rows = as_dicts(lab.tubes_not_received(t["dim_lab_order_details"]))
    assert {r["requisition_id"]: r["NumOfTubesNotReceived"] for r in rows} == {"R1": 3, "R2": 0}


def test_messages_of_a_shared_accession_stay_with_their_requisition(make_tables):
    t = make_tables(
        dim_lab=STAR["dim_lab"],
        dim_lab_order=[order(1), order(2)],
        dim_lab_order_details=[
            detail("a"),
            detail("b", lab_order_fk=2, requisition_id="R2", order_test_name="CMP"),
        ],
        status_history=[event(), event(), event(event_status_code="T"), event(event_status_code="S")],
    )
    rows = as_dicts(lab.status_history_messages(t))
    assert {r["requisition_id"]: r["sh_msg"] for r in rows} == {
        "R1": "*,CBC- full|01/02/2024 12:00 PM ET|Result Finalized",
        "R2": "*,CMP|01/02/2024 12:00 PM ET|Result Finalized",
    }


def details_tables(make_tables, **tables):
    return make_tables(**{**STAR, "dim_lab_order": [order(1), order(2)], **tables})


def test_routine_details(make_tables):
    t = details_tables(
        make_tables,
        dim_lab_order_details=[
            detail("a", order_detail_status="X"),
            detail("b", test_category="PENDING"),
            detail("c", test_category=None, order_test_name="ALT"),
            detail("d", order_test_name="COLL"),
            detail("e", order_test_fk=2),
        ],
        dim_order_test=[
            *STAR["dim_order_test"],
            {"order_test_pk": 2, "micro_culture_format_flag": "N", "order_test_type": "+"},
        ],
        results=[
            {"lab_order_details_fk": "d", "result_test_code": "COLLB"},
            {"lab_order_details_fk": "c", "result_test_name": "ALT 1", "textual_result_full": "5"},
            {"lab_order_details_fk": "c", "result_test_code": "RT"},
        ],
        lov_clinical_status=[{"clinical_status": "D", "clinical_status_def": "Done"}],
    )
    rows = sorted(as_dicts(lab.routine_test_details(t)), key=lambda r: r["sort_position"])
    shown = [
        (r["order_test_name"], r["result_test_name"], r["textual_result_full"], r["parent_test_count"])
        for r in rows
    ]
    assert shown == [
        ("ALT", "ALT", "PENDING", 2),
        ("ALT", "ALT 1", "5", 2),
        ("CBC, full", "CBC, full", "CANCELLED", 1),
    ]
    assert {r["clinical_status"] for r in rows} == {"Done"}
    assert {r["patient_type_sub_group"] for r in rows} == {"HEMO"}
    assert {r["sh_msg"] for r in rows} == {"-"}


def grouped_tables(make_tables):
    def result(pk, test, **columns):
        return {"lab_order_details_fk": pk, "result_test_fk": test, "source_lab_system": "SE", **columns}

    return details_tables(
        make_tables,
        dim_lab_order_details=[
            detail(pk, order_test_name=f"T{pk}", clinical_status=status)
            for pk, status in [("a", "D"), ("b", "X"), ("c", "D"), ("d", "D"), ("e", "S"), ("f", None)]
        ],
        dim_order_test=[
            {
                "order_test_pk": 1,
                "micro_culture_format_flag": "N",
                "inquiry_grouping": "G9",
                "source_lab_system": "SW",
            }
        ],
        dim_result_test=[
            {"result_test_pk": 1, "sequence_number": 2, "report_grouping": "G1"},
            {"result_test_pk": 2, "sequence_number": 10, "report_grouping": "G1"},
            {"result_test_pk": 3, "sequence_number": 1, "report_grouping": "Problem Log"},
            {"result_test_pk": 4, "report_grouping": "G2"},
            {"result_test_pk": 5, "report_grouping": None},
        ],
        results=[
            result("a", 1),
            result("b", 2),
            result("c", 3),
            result("d", 4),
            result("e", 5),
            result("f", 99),
        ],
        lov_clinical_status=[
            {"clinical_status": "D", "clinical_status_def": "Done"},
            {"clinical_status": "X", "clinical_status_def": "Cancelled"},
            {"clinical_status": "S", "clinical_status_def": "Scheduled"},
        ],
        lov_report_grouping=[
            {"report_grouping": "G1", "source_lab_system": "SE", "sort_order": 30.0},
            {"report_grouping": "G2", "source_lab_system": "SW", "sort_order": 20.0},
            {"report_grouping": "G9", "source_lab_system": "SW", "sort_order": 40.0},
        ],
    )


def in_order(frame):
    rows = sorted(as_dicts(frame), key=lambda r: r["sort_position"])
    return [(r["order_test_name"], r["report_grouping"]) for r in rows]


def test_report_groups_in_order(make_tables):
    # Sequence 10 sorts before 2 because both are text; G2 has no order under the
    # result's system and is found under the test's.
    assert in_order(lab.report_group_details(grouped_tables(make_tables))) == [
        ("Tc", "Problem Log"),
        ("Td", "G2"),
        ("Tb", "G1"),
        ("Ta", "G1"),
        ("Te", "G9"),
        ("Tf", "G9"),
    ]


def test_status_order_comes_first(make_tables):
    assert in_order(lab.status_details(grouped_tables(make_tables))) == [
        ("Tb", "G1"),
        ("Te", "G9"),
        ("Tc", "Problem Log"),
        ("Td", "G2"),
        ("Ta", "G1"),
        ("Tf", "G9"),
    ]


def test_report_group_listed_twice_is_an_error(make_tables, spark):
    t = grouped_tables(make_tables)
    again = t["lov_report_grouping"]
    t["lov_report_grouping"] = again.unionByName(again)
    with pytest.raises(Exception, match="twice"):
        lab.report_group_details(t).collect()


def test_micro_details(make_tables):
    t = details_tables(
        make_tables,
        dim_lab_order_details=[detail("a"), detail("b", test_category="MISC")],
        dim_order_test=[{"order_test_pk": 1, "micro_culture_format_flag": "Y"}],
        dim_result_test=[{"result_test_pk": 1, "sequence_number": 5}],
        results=[
            {"lab_order_details_fk": "a", "result_test_fk": 1, "result_test_name": "Organism"},
            {"lab_order_details_fk": "a", "result_test_fk": 1, "result_test_name": "Collection time"},
            {"lab_order_details_fk": "a", "result_test_fk": 7, "result_test_code": "COLLB"},
        ],
    )
    rows = sorted(as_dicts(lab.micro_test_details(t)), key=lambda r: r["sort_position"])
    assert [(r["result_test_name"], r["seq_num"]) for r in rows] == [
        ("Collection time", 1),
        ("Organism", 5),
        ("CBC, full", None),
    ]
    assert {r["textual_result_full"] for r in rows} == {None}


def header_tables(make_tables, **tables):
    return make_tables(
        **{
            **STAR,
            "dim_lab_order": [order(1)],
            "dim_lab_order_details": [
                detail("a", order_detail_status="X", order_control_reason="R"),
                detail("b"),
                detail("c", test_category=None),
            ],
            "results": [
                {"lab_order_fk": 1, "lab_order_details_fk": "a", "abnormal_flag": "AH"},
                {"lab_order_fk": 1, "lab_order_details_fk": "a", "abnormal_flag": "AH"},
                {"lab_order_fk": 2, "lab_order_details_fk": "b", "derived_abnormal_flag": "AH"},
                {
                    "lab_order_fk": 1,
                    "lab_order_details_fk": "b",
                    "result_test_code": "COLLB",
                    "textual_result": "Nurse",
                },
            ],
            "dim_equipment": [
                {"spectra_mrn_fk": 1, "machine_name": "M1"},
                {"spectra_mrn_fk": 1, "machine_name": "M2"},
            ],
            **tables,
        }
    )


def reason(code, flag):
    return {
        "order_control_reason": "R",
        "order_control_reason_code": code,
        "reportable_flag": flag,
    }


REASONS = [("C", "1", True), (None, "1", False), ("C", "0", False)]


@pytest.mark.parametrize("code, flag, reported", REASONS)
def test_reportable_cancellation(make_tables, code, flag, reported):
    t = header_tables(make_tables, lov_order_control_reason=[reason(code, flag)])
    (row,) = as_dicts(lab.requisition_header(t))
    assert row["cancelled_test_ind"] is reported
    assert row["alert_exception_ind"] is False  # the abnormal result is another order's
    assert row["test_count"] == 2
    assert (row["lab_name"], row["requisition_status"]) == ("Rockleigh", "Final")


def test_header_needs_listed_modality_and_patient_type(make_tables):
    assert lab.requisition_header(header_tables(make_tables, dim_modality=[])).count() == 0
    assert lab.requisition_header(header_tables(make_tables, lov_patient_type=[])).count() == 0
    assert lab.requisition_demographics(header_tables(make_tables, lov_patient_type=[])).count() == 1


def test_environment_header_has_one_row_per_machine(make_tables):
    rows = as_dicts(lab.environment_requisition_header(header_tables(make_tables)))
    assert {(r["machine_name"], r["collb"], r["test_count"]) for r in rows} == {
        ("M1", "Nurse", 2),
        ("M2", "Nurse", 2),
    }


def test_demographics_sum_over_results(make_tables):
    (row,) = as_dicts(lab.requisition_demographics(header_tables(make_tables)))
    assert (row["cancelled_test_ind"], row["alert_exception_ind"], row["test_count"]) == (2, 2, 2)
    assert row["external_mrn"] is None  # it repeats the patient's own number
    assert (row["spectra_mrn"], row["facility_name"]) == (7, "Site")


def summary_tables(make_tables):
    def on(pk, day, **columns):
        return order(pk, collection_date=dt.date(2024, 1, day), **columns)

    return make_tables(
        **{
            **STAR,
            "dim_lab_order": [on(1, 1), on(2, 5), on(3, 3), on(4, 9), on(5, 4), on(6, 2)],
            "dim_lab_order_details": [
                detail(f"d{pk}", lab_order_fk=pk, requisition_id=f"R{pk}") for pk in (1, 2, 3, 4, 6)
            ],
        }
    )


def test_order_summary_dates_numbers_and_pages(make_tables):
    t = summary_tables(make_tables)
    days = (dt.date(2024, 1, 2), dt.date(2024, 1, 5))
    rows = as_dicts(lab.order_summary(t, *days))
    assert {(r["sl_no"], r["requisition_id"]) for r in rows} == {(1, "R2"), (2, "R3"), (3, "R6")}
    assert {r["total_count"] for r in rows} == {3}
    assert {r["NumOfTubesNotReceived"] for r in rows} == {1}
    page = as_dicts(lab.order_summary(t, *days, start=2, end=2))
    assert [(r["requisition_id"], r["total_count"]) for r in page] == [("R3", 3)]
    assert len(as_dicts(lab.order_summary(t, *days, start=0, end=2))) == 3


def test_order_summary_of_chosen_patients(make_tables, spark):
    t = summary_tables(make_tables)
    days = (dt.date(2024, 1, 1), dt.date(2024, 1, 31))
    for number, count in [("007", 5), ("008", 0)]:
        chosen = spark.createDataFrame([(number,)], "spectra_mrn string")
        assert lab.order_summary(t, *days, mrns=chosen).count() == count


SCOPED = [
    lab.tube_summary,
    lab.status_history_messages,
    lab.routine_test_details,
    lab.micro_test_details,
    lab.report_group_details,
    lab.status_details,
    lab.requisition_header,
    lab.environment_requisition_header,
    lab.requisition_demographics,
]


JOINED = [lab.tube_summary, lab.routine_test_details, lab.requisition_header]
# With keys written into the plan and, past a limit of none, with keys joined.
CASES = [(report, 1000) for report in SCOPED] + [(report, 0) for report in JOINED]


@pytest.mark.parametrize("report, few", CASES, ids=lambda value: getattr(value, "__name__", value))
def test_scope_equals_filtering_the_whole_report(spark, small_tables, report, few, monkeypatch):
    monkeypatch.setattr("labreports.plans.scope.few_rows.__defaults__", (few,))
    chosen = ["R%d" % n for n in range(0, 40)]
    keys = spark.createDataFrame([(c.lower(),) for c in chosen], "requisition_id string")
    scoped = sorted(map(str, report(small_tables, keys).collect()))
    whole = report(small_tables).filter(F.col("requisition_id").isin(chosen))
    assert scoped and scoped == sorted(map(str, whole.collect()))
