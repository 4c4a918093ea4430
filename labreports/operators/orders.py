"""A patient's orders, newest first."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labreports.functions import rules
from labreports.functions.ordering import SortKey, ascending
from labreports.operators.headers import order_indicators
from labreports.operators.tubes import tubes_not_received
from labreports.plans.scope import Scope
from labreports.plans.skew import LargeGroups, number_rows, sampled, stored_values
from labreports.sources.warehouse import Tables

_ROW = [
    "spectra_mrn",
    "requisition_id",
    "collection_date",
    "requisition_status",
    "draw_frequency",
    "patient_type",
    "corporate_acronym",
    "display_name",
    "NumOfTubesNotReceived",
]
_ORDER = [
    SortKey("collection_date", descending=True),
    *ascending(
        "requisition_id",
        "requisition_status",
        "draw_frequency",
        "patient_type",
        "display_name",
        "corporate_acronym",
        "NumOfTubesNotReceived",
    ),
]


def order_sample(orders: DataFrame, patients: DataFrame) -> DataFrame:
    """Sampled orders by patient number."""
    own = sampled(orders, "lab_order_pk").select("spectra_mrn_assc_fk")
    return own.join(patients, "spectra_mrn_assc_fk").select("spectra_mrn")


def order_summary(
    t: Tables,
    from_date: dt.date,
    as_of: dt.date,
    mrns: DataFrame | None = None,
    start: int = 0,
    end: int = 0,
) -> DataFrame:
    """Orders drawn from ``from_date`` to ``as_of``, numbered per patient.

    ``mrns`` limits the patients. Rows ``start`` to ``end`` of each patient are
    returned if both are given.
    """
    scope = Scope(None if mrns is None else mrns.select("spectra_mrn"))
    masters = t["spectra_mrn_master"].select(
        F.col("spectra_mrn_pk").alias("spectra_mrn_fk"), "spectra_mrn"
    )
    masters = scope.keep(masters, "spectra_mrn")
    numbers = scope.related(masters, ["spectra_mrn_fk"])
    patients = (
        numbers.narrow(t["spectra_mrn_associations"], "spectra_mrn_fk", "spectra_mrn_fk")
        .join(masters, "spectra_mrn_fk")
        .select(
            F.col("spectra_mrn_assc_pk").alias("spectra_mrn_assc_fk"), "spectra_mrn", "facility_fk"
        )
    )
    of_patients = scope.related(patients, ["spectra_mrn_assc_fk"])
    drawn_on = F.to_date("collection_date")
    drawn = of_patients.narrow(
        t["dim_lab_order"], "spectra_mrn_assc_fk", "spectra_mrn_assc_fk"
    ).filter(drawn_on.between(F.lit(from_date), F.lit(as_of)))
    # The window alone limits details, tubes and results to the orders drawn in it.
    related = scope.related(drawn, ["lab_order_pk", "requisition_id"], limited=True)

    facilities = t["dim_facility"].select(
        F.col("facility_pk").alias("facility_fk"), "corporate_acronym", "display_name"
    )
    tubes = tubes_not_received(
        related.narrow(t["dim_lab_order_details"], "requisition_id", "requisition_id").filter(
            F.col("requisition_id").isNotNull()
        )
    )
    rows = (
        drawn.join(patients, "spectra_mrn_assc_fk")
        .join(facilities, "facility_fk")
        .join(order_indicators(t, related), "lab_order_pk")
        .join(tubes, "requisition_id", "left")
        .withColumns(
            {
                "requisition_status": rules.label(
                    F.col("requisition_status"), rules.REQUISITION_STATUS
                ),
                "NumOfTubesNotReceived": F.coalesce("NumOfTubesNotReceived", F.lit(0)),
            }
        )
        .groupBy(*_ROW)
        .agg(
            F.sum("test_count").alias("test_count"),
            F.max("cancelled_test_ind").alias("cancelled_test_ind"),
            F.max("alert_exception_ind").alias("alert_exception_ind"),
        )
    )
    large = LargeGroups.of(
        order_sample(drawn, patients), "spectra_mrn", stored_values(t, "orders_of_patient")
    )
    rows = number_rows(rows, "spectra_mrn", _ORDER, "sl_no", large)
    rows = _with_requisition_count(rows, large)
    if start and end:
        rows = rows.filter(F.col("sl_no").between(start, end))
    return rows.select(
        *_ROW, "test_count", "cancelled_test_ind", "alert_exception_ind", "sl_no", "total_count"
    )


def _with_requisition_count(rows: DataFrame, large: LargeGroups) -> DataFrame:
    """Add the patient's number of different requisitions."""
    if not large.any:
        # The highest dense rank is the distinct count; both windows and the
        # row numbers use the same shuffle.
        of_patient = Window.partitionBy("spectra_mrn")
        ranked = rows.withColumn(
            "_rank", F.dense_rank().over(of_patient.orderBy("requisition_id"))
        )
        total = F.max("_rank").over(of_patient).cast("bigint")
        return ranked.withColumn("total_count", total).drop("_rank")
    totals = rows.groupBy("spectra_mrn").agg(
        F.count_distinct("requisition_id").alias("total_count")
    )
    return rows.join(totals, "spectra_mrn")
