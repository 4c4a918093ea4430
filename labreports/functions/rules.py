"""The reports' shared rules, each as a Column."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Codes and texts that have to equal the warehouse's.
REQUISITION_STATUS = {"F": "Final", "P": "Partial"}
LAB_CITY = {"SW": "Milpitas", "SE": "Rockleigh", "HW": "Milpitas", "HE": "Rockleigh"}
LAB_ZONE = {"SW": "PT", "SE": "ET", "HW": "PT", "HE": "ET"}
FACILITY_CITY = {"SE": "Rockleigh", "SW": "Milpitas"}
STATUS_RANK = {"Cancelled": 1, "Scheduled": 2, "Received": 3, "Valued": 4, "Done": 5}
ABNORMAL_FLAGS = ["AH", "AL", "EH", "EL", "CA", "CE"]
EXCLUDED_ORDER_TEST_TYPES = ["+", "-", "C"]
COLLECTED_BY_CODE = "COLLB"
PROBLEM_LOG = "Problem Log"
PROBLEM_LOG_ORDER = 0.1
OTHER_TESTS = "Other Tests"
HISTORY_EVENTS = ["A", "D", "X", "S"]
INTERFACE_USER = "IF"
HISTORY_TIME_FORMAT = "MM/dd/yyyy HH:mm a"


def label(code: Column, labels: Mapping[str, str]) -> Column:
    """The code's label; a code that has none is shown itself."""
    return F.coalesce(*[F.when(code == key, F.lit(text)) for key, text in labels.items()], code)


def joined_text(*parts: Column | str) -> Column:
    """Concatenation in which a null part adds nothing."""
    return F.concat(*[F.coalesce(p, F.lit("")) if isinstance(p, Column) else F.lit(p) for p in parts])


def not_in_keeping_null(column: Column, values: list[str]) -> Column:
    """Not one of the values; a null passes (plain ``~isin`` would drop it)."""
    return column.isNull() | ~column.isin(values)


def tube_status() -> Column:
    """Status of an accession from its counts; the first rule that holds wins."""
    tests = F.col("test_count")
    in_process = F.col("in_process_count") > 0
    return (
        F.when(in_process & F.col("specimen_received_date_time").isNull(), "Intransit")
        .when(F.col("scheduled_count") == tests, "Scheduled")
        .when(in_process, "In Process")
        .when(F.col("cancel_count") == tests, "Cancelled")
        .when(F.col("complete_count") == tests, "Done")
        .when(F.col("done_count") > 0, "Partial Complete")
    )


def result_or_placeholder(result: Column, order_status: Column) -> Column:
    """The result's text, or the word that stands for a result still missing."""
    return F.coalesce(
        result,
        F.when(order_status.isin("I", "O", "P"), "PENDING").when(order_status == "X", "CANCELLED"),
    )


def status_rank(status_text: Column) -> Column:
    ranks = [F.when(status_text == text, rank) for text, rank in STATUS_RANK.items()]
    return F.coalesce(*ranks, F.lit(len(STATUS_RANK) + 1))


def history_line() -> Column:
    """One line of a test's history message.

    Columns used: ``test_name``, ``priority`` and ``zone`` of the order;
    ``event``, ``entered_by`` and ``time_text`` of the event.
    """
    event, priority, user = F.col("event"), F.col("priority"), F.col("entered_by")
    by_interface = user == INTERFACE_USER
    by_person = user != INTERFACE_USER
    texts = []
    for code, done in (("S", "Order Received"), ("A", "Tube Scanned")):
        for urgency, kind in (("RTN", ""), ("Q", "Add-On ")):
            here = (priority == urgency) & (event == code)
            texts.append(F.when(here & by_interface, f"Interface {kind}{done}"))
            texts.append(F.when(here & by_person, F.concat(F.lit(f"Manual {kind}{done} - "), user)))
    texts.append(F.when(event == "D", "Result Finalized"))
    texts.append(F.when((event == "X") & by_person, F.concat(F.lit("Cancelled - "), user)))
    texts.append(F.when((event == "X") & by_interface, "Cancelled"))
    start = joined_text(F.col("test_name"), "|", F.col("time_text"), " ", F.col("zone"), "|")
    return F.coalesce(F.concat(start, F.coalesce(*texts)), F.lit("*"))
