from __future__ import annotations

import pytest

import labreports as lab
from tests.conftest import as_dicts



def sid(relative_id):
    start = "010500000000000515000000" + "01000000" + "02000000" + "03000000"
    return bytearray.fromhex(start + relative_id.to_bytes(4, "little").hex())


@pytest.fixture
def directory(make_tables):
    def user(account, cn, rid, **columns):
        return {
            "object_class": "user",
            "sam_account_name": account,
            "cn": cn,
            "distinguished_name": f"CN={cn},OU=Users",
            "object_sid": sid(rid),
            "primary_group_id": "513",
            **columns,
        }

    def group(account, rid):
        return {"object_class": "group", "sam_account_name": account, "object_sid": sid(rid)}

    def value(app, attribute, text):
        return {"group_cn": app, "attribute_id": attribute, "value": text}

    return make_tables(
        dir_user=[
            user("ann", "Ann A", 1001, telephone_number="555-1"),
            user("Bob", "Bob B", 1002, primary_group_id="600"),
            user("bob", "Bob A", 1003),
            user("cat", "Cat C", 1004, object_sid=None),
            user("dan", "Dan D", 1005, primary_group_id="600"),
            user("ann", "Printer", 1006, object_class="computer"),
        ],
        dir_group=[group("staff", 513), group("left", 600), group("right", 600)],
        dir_attribute_value=[
            value("LEDGER", "member", "CN=Ann A,OU=Users"),
            value("LEDGER", "member", "CN=Ann A,OU=Users"),
            value("LEDGER", "member", "CN=Bob Ace,OU=Users"),
            value("LEDGER", "description", "CN=Cat C,OU=Users"),
            value("LEDGER", "name", "CN=Dan D"),
        ],
    )


def names(spark, *user_ids):
    return spark.createDataFrame([(u,) for u in user_ids], "user_id string")


def by_user(frame, column):
    return {r["user_id"]: r[column] for r in as_dicts(frame)}


def test_account_lookup(spark, directory):
    wanted = names(spark, "ANN", "bob", "nobody", "ANN")
    unique = lab.account_lookup(directory["dir_user"], wanted, "unique")
    assert by_user(unique, "cn") == {"ANN": "Ann A", "bob": None, "nobody": None}
    first = lab.account_lookup(directory["dir_user"], wanted, "first")
    assert by_user(first, "cn") == {"ANN": "Ann A", "bob": "Bob A", "nobody": None}
    with pytest.raises(ValueError):
        lab.account_lookup(directory["dir_user"], wanted, "any")


def test_account_attributes_read_only_their_columns(spark, directory):
    phones = lab.account_attributes(
        directory["dir_user"], names(spark, "ann", "cat"), ["telephone_number"]
    )
    assert by_user(phones, "telephone_number") == {"ann": "555-1", "cat": None}


def test_primary_groups(spark, directory):
    users, groups = directory["dir_user"], directory["dir_group"]
    found = lab.primary_groups(users, groups)
    assert by_user(found, "group_name") == {
        "ann": "staff",
        "Bob": None,
        "bob": None,
        "cat": None,
        "dan": None,
    }
    assert by_user(found, "primary_group_sid")["dan"] == "S-1-5-21-1-2-3-600"
    assert by_user(lab.primary_groups(users, groups, names(spark, "Ann")), "group_name") == {
        "Ann": "staff"
    }


def test_group_by_sid_needs_exactly_one(spark, directory):
    sids = spark.createDataFrame([(f"S-1-5-21-1-2-3-{n}",) for n in (513, 600, 7)], "sid string")
    rows = as_dicts(lab.group_by_sid(directory["dir_group"], sids))
    assert {r["sid"][-3:]: r["group_name"] for r in rows} == {"513": "staff", "600": None, "3-7": None}


def test_app_membership(spark, directory):
    people = ["Ann A", "Bob A", "Cat C", "Dan D"]
    asked = spark.createDataFrame(
        [(cn, app) for cn in people for app in ("LEDGER", "ROSTER")], "cn string, app string"
    )
    rows = as_dicts(lab.app_membership(asked, directory["dir_attribute_value"]))
    assert {(r["cn"], r["app"]) for r in rows if r["is_member"] == 1} == {
        ("Ann A", "LEDGER"),
        ("Dan D", "LEDGER"),
    }
    assert len(rows) == 8


def test_access_report(spark, directory):
    asked = spark.createDataFrame(
        [("ann", "ledger"), ("bob", "LEDGER"), ("joe", "LEDGER"), (None, "LEDGER")],
        "user_id string, app string",
    )
    report = lab.access_report(directory["dir_user"], directory["dir_attribute_value"], asked)
    assert by_user(report, "message") == {
        "ann": "MATCHING ENTRY FOUND FOR: ANN A IN THE SSO: LEDGER",
        "bob": "SORRY NO MATCHING ENTRY FOR: BOB A IN THE SSO-LEDGER",
        "joe": "Sorry your User-id (network-id) is invalid...",
        None: "Sorry your User-id (network-id) is invalid...",
    }
