"""What happened to each ordered test, as one line of text per event."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labreports.functions import rules
from labreports.plans.packing import pack, unpack
from labreports.plans.scope import Related, requisition_scope
from labreports.plans.skew import LARGE_KEYS, large_values, sampled
from labreports.sources.warehouse import Tables

_TEST = ["accession_number", "order_test_code"]
_MESSAGE_OF = ["requisition_id", *_TEST]


def history_messages(
    t: Tables, details: DataFrame, related: Related, hot: bool = True, split: bool = True
) -> DataFrame:
    """One message per requisition, accession and test of ``details``.

    Orders and events each shrink to what a line shows before they meet, so
    repeated events are never paired with repeated orders. What an order or an event
    shows is packed for the shuffles, and so is the accession and test that they meet by.

    ``hot`` says that one order may have very many details. Where none has, details meet their order
    first and are made distinct where they are, which spares them a shuffle.

    ``split`` says that one accession and test may have very many details. The join then has a shuffle
    of its own on both sides, so that adaptive execution can split a hot pair, and its lines are made
    distinct ahead of the next shuffle. Where no pair has, events are made distinct where they meet the
    orders, and lines where they are made, which spares both a shuffle.
    """
    zones = t["dim_lab"].select(
        F.col("lab_pk").alias("lab_fk"), rules.label(F.col("lab_id"), rules.LAB_ZONE).alias("zone")
    )
    order_zones = (
        related.narrow(t["dim_lab_order"], "lab_order_pk", "lab_order_fk", at_once=True)
        .select(F.col("lab_order_pk").alias("lab_order_fk"), "lab_fk")
        .join(zones, "lab_fk")
        .drop("lab_fk")
    )
    ordered = ["requisition_id", "test_name", "priority"]
    orders = details.select(
        *_TEST,
        "requisition_id",
        "lab_order_fk",
        F.replace("order_test_name", F.lit(","), F.lit("-")).alias("test_name"),
        F.when(F.col("priority").isin("RTN", "Q"), F.col("priority")).alias("priority"),
    )
    orders = _by_test(orders, "_order", ordered)
    if hot:
        orders = orders.distinct().join(order_zones, "lab_order_fk")
    else:
        orders = orders.join(order_zones, "lab_order_fk").distinct()
    orders = orders.drop("lab_order_fk")
    shown = ["event", "entered_by", "time_text"]
    events = (
        related.narrow(t["status_history"], "accession_number", "accession_number", at_once=True)
        .filter(F.col("event_status_code").isin(rules.HISTORY_EVENTS))
        .select(
            *_TEST,
            F.col("event_status_code").alias("event"),
            "entered_by",
            F.date_format("status_date_time", rules.HISTORY_TIME_FORMAT).alias("time_text"),
        )
    )
    events = _by_test(events, "_event", shown)
    events = events.distinct() if split else events.repartition("_test").distinct()
    message = F.array_join(F.array_sort(F.collect_set("line")), ",")
    met = unpack(unpack(orders.join(events, "_test"), "_order", ordered), "_event", shown)
    lines = met.select("requisition_id", "_test", rules.history_line().alias("line"))
    if split:
        return unpack(lines, "_test", _TEST).groupBy(*_MESSAGE_OF).agg(message.alias("sh_msg"))
    messages = lines.groupBy("requisition_id", "_test").agg(message.alias("sh_msg"))
    return unpack(messages, "_test", _TEST).select(*_MESSAGE_OF, "sh_msg")


def may_have_large_tests(t: Tables, details: DataFrame) -> bool:
    """Whether a sample shows an accession and test with very many details, or none may be drawn."""
    if t.get(LARGE_KEYS) is not None:
        return True
    named = sampled(details, "lab_order_details_pk").select(*_TEST).dropna()
    return bool(large_values(named, *_TEST))


def _by_test(rows: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """Rows of an accession and a test, packed as ``_test`` and the columns as ``name``; without either
    of the two a row meets none."""
    present = F.col("accession_number").isNotNull() & F.col("order_test_code").isNotNull()
    return pack(pack(rows.filter(present), "_test", _TEST), name, columns)


def status_history_messages(t: Tables, requisitions: DataFrame | None = None) -> DataFrame:
    """History message of every requisition, accession and test that has one."""
    scope = requisition_scope(requisitions)
    details = scope.keep(t["dim_lab_order_details"], "requisition_id")
    related = scope.related(details, ["lab_order_fk", "accession_number"])
    return history_messages(t, details, related)
