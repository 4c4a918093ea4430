"""How searches look patients up: rarest letters, pairs of common ones, splits; the same rows always."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

import labreports as lab
from labreports.operators import patients as search
from labreports.plans import skew
from labreports.plans.scope import few_rows
from labreports.plans.skew import SAMPLE_EVERY_CONF

SEARCHES = [
    ("hot", "%annaxyzq", 0, None),
    ("pair", "%anna%bella", 0, None),
    ("start", "annax", 0, None),
    ("place", "", 2, None),
    ("born", "", 0, "01021950"),
    ("short", "%q%", 0, None),
    ("any", "", 0, None),
    ("none", "%zzzzzz", 0, None),
]


@pytest.fixture
def tables(make_tables):
    """ANN and NNA are in nearly every name; XYZ is in three, of which one continues as asked."""
    names = [f"Anna{k % 7}, Bella{k % 3}" for k in range(60)]
    names += ["Annaxyzq, Una", "Mannaxyz, Una", "Xyz, Q", "Annax, Bell", "Jo"]
    people = [
        {
            "patient_pk": k,
            "full_name": name,
            "last_name": name.partition(",")[0],
            "first_name": "same",
            "dob": dt.date(1950, 1, 1 + k % 5),
            "gender": "F",
            "spectra_mrn": str(k),
            "facility_fk": 1 + k % 2,
            "spectra_mrn_fk": k,
        }
        for k, name in enumerate(names)
    ]
    return make_tables(
        dim_patient=people,
        agg_patient_max_general_lab_mv=[
            {"patient_fk": k, "collection_date_fk": day} for k in range(len(people)) for day in (0, 1)
        ],
        dim_date=[{"date_pk": n, "day": dt.date(2024, 1, 1 + n)} for n in range(2)],
        dim_facility=[
            {"facility_pk": k, "display_name": "North", "client_fk": 1} for k in (1, 2)
        ],
        dim_client=[{"client_pk": 1, "name": "Client"}],
        dim_account=[
            {"account_pk": k, "facility_fk": k, "account_type": "STUDY", "account_status": "ACTIVE"}
            for k in (1, 2)
        ],
        # Two masters for every third patient: rows that tie in all that a search sorts by.
        spectra_mrn_master=[
            {"spectra_mrn_pk": k, "spectra_mrn": str(k), "mrn_status": "ACTIVE"}
            for k in range(len(people))
            for _ in range(1 + (k % 3 == 0))
        ],
    )


def asked(spark, searches=SEARCHES):
    return spark.createDataFrame(searches, "search_id string, name string, facility_id int, dob string")


def found(frame):
    return sorted(map(str, frame.collect()))


_EXPECTED: list[str] = []


@pytest.fixture
def expected(spark, tables):
    """Each search by itself."""
    if not _EXPECTED:
        for one in SEARCHES:
            _EXPECTED.extend(found(lab.patient_search(tables, asked(spark, [one]))))
    assert len(_EXPECTED) > 100
    return sorted(_EXPECTED)


@pytest.mark.parametrize("common, stored, few", [(2, False, 1000), (2, True, 1000), (1 << 20, True, 0), (1 << 20, False, 0)])
def test_every_way_gives_the_same_rows(spark, tables, expected, common, stored, few, monkeypatch):
    monkeypatch.setattr(search, "COMMON", common)
    monkeypatch.setattr(few_rows, "__defaults__", (few,))
    keys = lab.patient_keys(tables["dim_patient"]) if stored else None
    assert found(lab.patient_search(tables, asked(spark), keys=keys)) == expected


def chosen(spark, tables, searches, keys=None):
    made = search._Searches(asked(spark, searches), tables["dim_patient"], keys)
    return made, {r.search_id: (r.by, r.value) for r in made.terms.collect()}


@pytest.mark.parametrize("few", [1000, 0])
def test_the_rarest_letters_are_looked_up(spark, tables, few, monkeypatch):
    monkeypatch.setattr(few_rows, "__defaults__", (few,))
    made, keys = chosen(spark, tables, SEARCHES[:1])
    assert keys["hot"][0] == "piece" and keys["hot"][1] in ("YZQ", "XYZ", "AXY")
    value = keys["hot"][1]
    named = tables["dim_patient"].withColumn("upper_name", F.upper("full_name"))
    met = named.withColumn("value", made._value("piece")).join(made._of_kind("piece"), "value")
    assert met.count() == named.filter(F.col("upper_name").contains(value)).count() <= 3


def test_common_letters_are_looked_up_in_twos(spark, tables, monkeypatch):
    monkeypatch.setattr(search, "COMMON", 2)
    made, keys = chosen(spark, tables, SEARCHES[1:2])
    by, value = keys["pair"]
    assert by == "pair" and len(value) == 6 and value[:3] < value[3:]
    named = tables["dim_patient"].withColumn("upper_name", F.upper("full_name"))
    met = named.withColumn("value", made._value("pair")).filter(F.col("value") == value)
    both = F.col("upper_name").contains(value[:3]) & F.col("upper_name").contains(value[3:])
    assert met.count() == named.filter(both).count()


@pytest.mark.parametrize("sought", [32, 0])
def test_only_letters_asked_for_leave_the_scan(spark, tables, sought, monkeypatch):
    """Neither the other letters of the names nor the patients themselves are shuffled for few searches."""
    monkeypatch.setattr(search, "_SOUGHT", sought)
    made, keys = chosen(spark, tables, [SEARCHES[0], ("una", "%una%", 0, None), SEARCHES[7]])
    named = tables["dim_patient"].withColumn("upper_name", F.upper("full_name"))
    met = named.select("patient_pk", made._value("piece").alias("value"))
    assert {r.value for r in met.collect()} == {keys["hot"][1], "UNA"}
    assert made.kinds == ("piece",)
    plan = made.matches(tables["dim_patient"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning(value" not in plan


def test_searches_are_joined_by_the_keys_they_have(spark, tables, monkeypatch):
    """Of very many searches too: by birth date alone, no name is cut into letters."""
    monkeypatch.setattr(few_rows, "__defaults__", (0,))
    made, _ = chosen(spark, tables, [("born", "", 0, "01021950"), ("too", "", 0, "01031950")])
    assert made.kinds == ("born",)
    made, _ = chosen(spark, tables, SEARCHES)
    assert made.kinds == ("facility", "born", "start", "piece", "all")


def test_a_common_start_gives_way_to_rarer_letters_where_keys_are_stored(spark, tables, monkeypatch):
    monkeypatch.setattr(search, "COMMON", 2)
    stored = lab.patient_keys(tables["dim_patient"])
    _, keys = chosen(spark, tables, SEARCHES[2:3], stored)
    assert keys["start"] == ("piece", "NAX") or keys["start"][0] == "pair"
    _, keys = chosen(spark, tables, SEARCHES[2:3])
    assert keys["start"] == ("start", "ANN")


def test_patient_keys_count_patients(tables):
    counts = {(r.by, r.value): r.n for r in lab.patient_keys(tables["dim_patient"]).collect()}
    assert counts["all", ""] == 65 and counts["piece", "XYZ"] == 3 and counts["start", "ANN"] == 62
    assert counts["facility", "1"] + counts["facility", "2"] == 65 and counts["start", "JO"] == 1
    assert sum(n for (by, _), n in counts.items() if by == "born") == 65


def test_no_key_holds_all_patients(spark, tables):
    """A search without a key meets every split of the patients; a split is a part of them."""
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    try:
        made, _ = chosen(spark, tables, [("any", "", 0, None), ("more", "%q%", 0, None)])
        patients = tables["dim_patient"].withColumn("upper_name", F.upper("full_name"))
        sizes = patients.groupBy(made._value("all").alias("value")).count().collect()
        assert len(sizes) == 5 and max(r["count"] for r in sizes) < 65 / 2
        dealt = made._of_kind("all").groupBy("search_id").count().collect()
        assert [r["count"] for r in dealt] == [5, 5]
        rows = lab.patient_search(tables, asked(spark, [("any", "", 0, None)]))
        assert "'' AS value" not in rows._jdf.queryExecution().optimizedPlan().toString()
        assert rows.count() == 2 * (65 + 22)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")


def test_stored_keys_make_the_sample_unnecessary(spark, tables, monkeypatch):
    def refuse(*_):
        raise AssertionError("a sample was drawn")

    keys = lab.patient_keys(tables["dim_patient"])
    monkeypatch.setattr(skew, "large_values", refuse)
    keyed = [one for one in SEARCHES if one[0] not in ("short", "any")]
    assert lab.patient_search(tables, asked(spark, keyed), keys=keys).count()
    # Without them the sample of so few patients is too short to be looked at.
    assert lab.patient_search(tables, asked(spark, keyed)).count()
    spark.conf.set(SAMPLE_EVERY_CONF, "1")
    try:
        with pytest.raises(AssertionError):
            lab.patient_search(tables, asked(spark, keyed))
    finally:
        spark.conf.unset(SAMPLE_EVERY_CONF)


@pytest.mark.parametrize("field", [None, "unknown"])
def test_ties_are_numbered_alike_in_any_order_and_plan(spark, tables, field):
    """Rows of one patient that differ in the last lab date only, and rows that differ in nothing."""
    seen = []
    for every, order in ((None, F.asc), (None, F.desc), ("1", F.asc), ("1", F.desc)):
        t = type(tables)(tables)
        for name in ("dim_patient", "agg_patient_max_general_lab_mv", "spectra_mrn_master"):
            t[name] = tables[name].orderBy(*[order(c) for c in tables[name].columns[:2]])
        if every:
            spark.conf.set(SAMPLE_EVERY_CONF, every)
        try:
            rows = lab.patient_search(t, asked(spark), sort_field=field)
            assert ("_slice" in rows._jdf.queryExecution().analyzed().toString()) == bool(every)
            seen.append(found(rows))
        finally:
            spark.conf.unset(SAMPLE_EVERY_CONF)
    assert seen[0] and all(rows == seen[0] for rows in seen)
