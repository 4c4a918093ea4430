from __future__ import annotations

import datetime as dt

import pytest

import labreports as lab
from tests.conftest import as_dicts


def patient(pk, full_name, **columns):
    last, _, first = full_name.partition(", ")
    base = {
        "patient_pk": pk,
        "full_name": full_name,
        "last_name": last,
        "first_name": first,
        "dob": dt.date(1950, 1, pk),
        "gender": "F" if pk % 2 else "M",
        "modality_code": f"M{pk}",
        "spectra_mrn": str(10 * (10 - pk)),
        "facility_fk": 1,
        "spectra_mrn_fk": pk,
    }
    return {**base, **columns}


@pytest.fixture
def tables(make_tables):
    people = [
        patient(1, "Smith, John"),
        patient(2, "Smithers, Ann"),
        patient(3, "O'Smith, Jo"),
        patient(4, "Smith, Adam", facility_fk=2),
        patient(5, "S_1 Smith, Eve"),
        patient(6, "Smith\\x, Zoe", facility_fk=3),
        patient(7, "Smith, Old"),
    ]
    return make_tables(
        dim_patient=people,
        agg_patient_max_general_lab_mv=[
            {"patient_fk": p["patient_pk"], "collection_date_fk": p["patient_pk"] % 3} for p in people
        ],
        dim_date=[{"date_pk": n, "day": dt.date(2024, 1, 1 + n)} for n in range(3)],
        dim_facility=[
            {"facility_pk": 1, "display_name": "North", "client_fk": 1, "east_west_flag": "SE"},
            {"facility_pk": 2, "display_name": "South", "client_fk": 1, "east_west_flag": "QQ"},
            {"facility_pk": 3, "display_name": "West", "client_fk": 1},
            {"facility_pk": 4, "display_name": "None", "client_fk": 1},
        ],
        dim_client=[{"client_pk": 1, "name": "Client"}],
        dim_account=[
            {"account_pk": 1, "facility_fk": 1, "account_type": "STUDY", "account_status": "Active"},
            {"account_pk": 2, "facility_fk": 2, "account_type": "STUDY", "account_status": "active"},
            {"account_pk": 3, "facility_fk": 3, "account_type": "STUDY", "account_status": "ACTIVE"},
            {"account_pk": 4, "facility_fk": 1, "account_type": "STUDY", "account_status": "ACTIVE"},
            {"account_pk": 5, "facility_fk": 4, "account_type": "OTHER", "account_status": "ACTIVE"},
        ],
        spectra_mrn_master=[
            {
                "spectra_mrn_pk": p["patient_pk"],
                "spectra_mrn": p["spectra_mrn"],
                "mrn_status": "MERGED" if p["patient_pk"] == 7 else "ACTIVE",
            }
            for p in people
        ],
    )


def find(spark, tables, name="", facility_id=0, dob=None, **options):
    searches = spark.createDataFrame(
        [("s", name, facility_id, dob)],
        "search_id string, name string, facility_id int, dob string",
    )
    rows = as_dicts(lab.patient_search(tables, searches, **options))
    assert {r["total_entity_cnt"] for r in rows} <= {len(rows)}
    rows.sort(key=lambda r: r["sl_no"])
    assert [r["sl_no"] for r in rows] == list(range(1, len(rows) + 1))
    return [10 - r["spectra_mrn"] // 10 for r in rows]


FOUND = [
    ({"name": "smith"}, {1, 2, 4, 6}),
    ({"name": "sm"}, {1, 2, 4, 6}),
    ({"name": "smith,  j"}, {1}),
    ({"name": " smith"}, {1, 2, 3, 4, 5, 6}),
    ({"name": "%smith, j"}, {1, 3}),
    ({"name": "s_ith, jo"}, {1}),
    ({"name": "s_1 smith"}, {5}),
    ({"name": "smith\\"}, {6}),
    ({"name": "smi%\\x"}, {6}),
    ({"name": "smith", "facility_id": 2}, {4}),
    ({"facility_id": 1}, {1, 2, 3, 5}),
    ({"facility_id": 4}, set()),
    ({"dob": "01021950"}, {2}),
    ({"dob": "1021950"}, set()),
    ({"dob": "not a date"}, set()),
    ({"dob": "01021950", "name": "smith,"}, set()),
    ({"dob": ""}, {1, 2, 3, 4, 5, 6, 7}),
    ({"name": None}, {1, 2, 3, 4, 5, 6, 7}),
    ({"name": "%"}, {1, 2, 3, 4, 5, 6}),
]


@pytest.mark.parametrize("search, expected", FOUND, ids=lambda value: str(value))
def test_search(spark, tables, search, expected):
    assert set(find(spark, tables, **search)) == expected


# A backslash sorts after the letters, an underscore after that.
ORDERS = [
    (None, False, [3, 4, 1, 2, 6, 5]),
    (None, True, [3, 1, 4, 2, 6, 5]),
    ("fullName", False, [3, 4, 1, 2, 6, 5]),
    ("FULLNAME", True, [5, 6, 2, 1, 4, 3]),
    ("dateOfBirth", True, [6, 5, 4, 3, 2, 1]),
    ("lastDrawDate", False, [3, 6, 4, 1, 2, 5]),
    ("gender", True, [4, 2, 6, 3, 1, 5]),
    ("modality", False, [1, 2, 3, 4, 5, 6]),
    ("facilityName", True, [6, 4, 3, 1, 2, 5]),
    ("spectraMRN", False, [6, 5, 4, 3, 2, 1]),
    ("unknown", True, [1, 2, 3, 4, 5, 6]),
]


@pytest.mark.parametrize("field, descending, expected", ORDERS)
def test_sort_fields(spark, tables, field, descending, expected):
    options = {"sort_field": field, "descending": descending}
    assert find(spark, tables, name="%smith", **options) == expected


def test_several_searches_are_numbered_apart(spark, tables):
    searches = spark.createDataFrame(
        [("a", "smith,", 0, None), ("b", "", 1, None), ("c", "", 0, None)],
        "search_id string, name string, facility_id int, dob string",
    )
    rows = as_dicts(lab.patient_search(tables, searches))
    counts = {r["search_id"]: r["total_entity_cnt"] for r in rows}
    assert counts == {"a": 2, "b": 4, "c": 7}


def test_patient_details(spark, tables):
    assert lab.patient_details(tables).count() == 7
    assert lab.patient_details(tables, facility_id=2).count() == 1
    assert lab.patient_details(tables, facility_id=0).count() == 7
    chosen = spark.createDataFrame([("90",)], "spectra_mrn string")
    (row,) = as_dicts(lab.patient_details(tables, mrns=chosen))
    assert (row["full_name"], row["lab"], row["modality"]) == ("Smith, John", "Rockleigh", "M1")
    assert lab.patient_details(tables, mrns=chosen, facility_id=2).count() == 0
