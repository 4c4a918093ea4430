"""Requisition headers: who, where, how many tests and what needs attention."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labreports.functions import rules
from labreports.plans.scope import Related, requisition_scope
from labreports.sources.warehouse import Tables

# Categories not counted as tests. A null category is not counted either.
_NOT_COUNTED = ["MISC", "PENDING"]

_RESULT_OF = ["lab_order_fk", "lab_order_details_pk"]


def counted_details(t: Tables, related: Related) -> DataFrame:
    details = related.narrow(t["dim_lab_order_details"], "lab_order_fk", "lab_order_pk")
    return details.filter(~F.col("test_category").isin(_NOT_COUNTED))


def with_results(
    details: DataFrame, results: DataFrame, of_detail: dict[str, Column], of_result: dict[str, Column]
) -> DataFrame:
    """One row per order and detail, aggregated over its copies and its results.

    Details and results meet in one aggregate that combines ahead of its shuffle, so neither is
    shuffled and sorted for a join. Results without a detail are dropped. Columns whose names end
    in ``copies`` or ``count`` are summed, others take their maximum.
    """
    results = results.withColumnRenamed("lab_order_details_fk", "lab_order_details_pk").filter(
        F.col("lab_order_fk").isNotNull() & F.col("lab_order_details_pk").isNotNull()
    )
    rows = details.select(
        *_RESULT_OF, F.lit(True).alias("_is_detail"), *[c.alias(n) for n, c in of_detail.items()]
    ).unionByName(
        results.select(*_RESULT_OF, *[c.alias(n) for n, c in of_result.items()]),
        allowMissingColumns=True,
    )
    names = [*of_detail, *of_result]
    totals = [(F.sum if n.endswith(("copies", "count")) else F.max)(n).alias(n) for n in names]
    grouped = rows.groupBy(*_RESULT_OF).agg(F.max("_is_detail").alias("_is_detail"), *totals)
    return grouped.filter("_is_detail").drop("_is_detail")


def is_abnormal(flag: str) -> Column:
    return F.col(flag).isin(rules.ABNORMAL_FLAGS)


def with_reportable_cancellation(t: Tables, details: DataFrame) -> DataFrame:
    """Mark details cancelled for a reason that has to be reported."""
    reasons = (
        t["lov_order_control_reason"]
        .filter((F.col("reportable_flag") == "1") & F.col("order_control_reason_code").isNotNull())
        .select("order_control_reason", F.lit(True).alias("reportable"))
        .distinct()
    )
    stopped = F.coalesce(
        (F.col("order_detail_status") == "X") | (F.col("clinical_status") == "CM"), F.lit(False)
    )
    return details.join(reasons, "order_control_reason", "left").withColumn(
        "cancelled", stopped & F.coalesce("reportable", F.lit(False))
    )


def order_indicators(t: Tables, related: Related, collected_by: bool = False) -> DataFrame:
    """Per order: tests, reportable cancellation, abnormal result, who collected.

    The cancellation depends on details alone, and the other two on the few
    results that are abnormal or name the collector, so only those are read.
    """
    kept = is_abnormal("derived_abnormal_flag")
    of_result = {"abnormal": F.coalesce(kept, F.lit(False))}
    if collected_by:
        names_collector = F.col("result_test_code") == rules.COLLECTED_BY_CODE
        kept = kept | names_collector
        of_result["collb"] = F.when(names_collector, F.col("textual_result"))
    results = related.narrow(t["results"], "lab_order_fk", "lab_order_pk").filter(kept)
    details = with_reportable_cancellation(t, counted_details(t, related))
    # One row per detail: copies of a detail count once.
    per_detail = with_results(details, results, {"cancelled": F.col("cancelled")}, of_result)
    totals = [
        F.count("lab_order_details_pk").alias("test_count"),
        F.max("cancelled").alias("cancelled_test_ind"),
        F.coalesce(F.max("abnormal"), F.lit(False)).alias("alert_exception_ind"),
    ]
    if collected_by:
        totals.append(F.max("collb").alias("collb"))
    return per_detail.groupBy(F.col("lab_order_fk").alias("lab_order_pk")).agg(*totals)


def _header_rows(t: Tables, orders: DataFrame) -> DataFrame:
    """Orders with patient number, account, facility, client and modality.

    The facility is the account's. An order whose modality is not listed has no header.
    """
    mrns = t["spectra_mrn_associations"].select(
        F.col("spectra_mrn_assc_pk").alias("spectra_mrn_assc_fk"),
        "spectra_mrn_fk",
    )
    masters = t["spectra_mrn_master"].select(
        F.col("spectra_mrn_pk").alias("spectra_mrn_fk"), "spectra_mrn"
    )
    clients = t["dim_client"].select(
        F.col("client_pk").alias("client_fk"), F.col("name").alias("corporation_name")
    )
    facilities = t["dim_facility"].select(
        F.col("facility_pk"),
        F.col("facility_id").alias("primary_facility_number"),
        F.col("display_name"),
        F.col("name").alias("full_facility_name"),
        "client_fk",
    )
    accounts = t["dim_account"].select(
        F.col("account_pk").alias("account_fk"),
        "account_number",
        "hlab_number",
        F.col("name").alias("account_name"),
        F.col("facility_fk").alias("facility_pk"),
    )
    sites = accounts.join(facilities, "facility_pk").join(clients, "client_fk")
    return (
        orders.join(sites, "account_fk")
        .join(t["dim_modality"], "modality_code")
        .join(mrns, "spectra_mrn_assc_fk")
        .join(masters, "spectra_mrn_fk")
        .withColumns(
            {
                "requisition_status": rules.label(
                    F.col("requisition_status"), rules.REQUISITION_STATUS
                ),
                "modality": F.coalesce("modality_description", "modality_code"),
            }
        )
    )


def _merge(
    rows: DataFrame, keys: list[str], totals: dict[str, Callable], blank_own_number: bool = False
) -> DataFrame:
    """Orders that agree in every header column are one header.

    ``blank_own_number`` hides an external number that repeats the patient's own.
    """
    merged = rows.groupBy(*keys, "alternate_patient_id").agg(
        *[total(name).alias(name) for name, total in totals.items()]
    )
    number = F.col("spectra_mrn")
    other = F.col("external_mrn")
    if blank_own_number:
        other = F.when(other == number, None).otherwise(other)
    return merged.withColumns(
        {"external_mrn": other, "spectra_mrn": number.cast("bigint")}
    ).drop("alternate_patient_id")


_PATIENT = [
    "requisition_status",
    "patient_name",
    "patient_dob",
    "gender",
    "modality",
    "initiate_id",
    "spectra_mrn",
    "chart_num",
    "external_mrn",
    "ordering_physician_name",
    "account_number",
    "hlab_number",
    "account_name",
    "primary_facility_number",
    "facility_name",
    "facility_pk",
    "corporation_name",
    "draw_frequency",
]
_INDICATORS = {"test_count": F.sum, "cancelled_test_ind": F.max, "alert_exception_ind": F.max}


def _scoped_orders(t: Tables, requisitions: DataFrame | None) -> tuple[DataFrame, Related]:
    scope = requisition_scope(requisitions)
    orders = scope.keep(t["dim_lab_order"], "requisition_id")
    return orders, scope.related(orders, ["lab_order_pk"])


def _with_lab_and_type(t: Tables, rows: DataFrame) -> DataFrame:
    labs = t["dim_lab"].select(
        F.col("lab_pk").alias("lab_fk"),
        rules.label(F.col("lab_id"), rules.LAB_CITY).alias("lab_name"),
    )
    return (
        rows.withColumn("facility_name", F.col("display_name"))
        .join(labs, "lab_fk")
        .join(t["lov_patient_type"], "patient_type")
    )


def requisition_header(t: Tables, requisitions: DataFrame | None = None) -> DataFrame:
    """Header of each requisition of a patient."""
    orders, related = _scoped_orders(t, requisitions)
    rows = _with_lab_and_type(t, _header_rows(t, orders)).join(
        order_indicators(t, related), "lab_order_pk"
    )
    keys = ["requisition_id", "collection_date", *_PATIENT]
    return _merge(rows, [*keys, "patient_type", "patient_type_sub_group", "lab_name"], _INDICATORS)


def environment_requisition_header(t: Tables, requisitions: DataFrame | None = None) -> DataFrame:
    """Header of each requisition for a machine: one row per machine of its number."""
    orders, related = _scoped_orders(t, requisitions)
    rows = (
        _with_lab_and_type(t, _header_rows(t, orders))
        .join(t["dim_equipment"], "spectra_mrn_fk")
        .join(order_indicators(t, related, collected_by=True), "lab_order_pk")
    )
    keys = ["requisition_id", "collection_date_time", *_PATIENT]
    keys += ["patient_type", "patient_type_sub_group", "lab_name", "machine_name", "serial_number"]
    return _merge(rows, keys, {**_INDICATORS, "collb": F.max})


def requisition_demographics(t: Tables, requisitions: DataFrame | None = None) -> DataFrame:
    """Header as the patient pages show it.

    Any cancelled detail counts, abnormal is the result's own flag, and both
    are sums over details paired with their results.
    """
    orders, related = _scoped_orders(t, requisitions)
    per_detail = with_results(
        counted_details(t, related),
        related.narrow(t["results"], "lab_order_fk", "lab_order_pk"),
        {
            "copies": F.lit(1),
            "cancelled_copies": F.when(F.col("order_detail_status") == "X", 1).otherwise(0),
        },
        {
            "result_count": F.lit(1),
            "abnormal_count": F.when(is_abnormal("abnormal_flag"), 1).otherwise(0),
        },
    )
    pairs = F.coalesce("result_count", F.lit(1))
    totals = (
        per_detail.groupBy(F.col("lab_order_fk").alias("lab_order_pk")).agg(
            F.count("lab_order_details_pk").alias("test_count"),
            F.sum(F.col("cancelled_copies") * pairs).alias("cancelled_test_ind"),
            F.sum(F.col("copies") * F.coalesce("abnormal_count", F.lit(0))).alias(
                "alert_exception_ind"
            ),
        )
    )
    rows = _header_rows(t, orders).withColumn("facility_name", F.col("full_facility_name"))
    keys = ["requisition_id", "collection_date", *_PATIENT]
    return _merge(
        rows.join(totals, "lab_order_pk"),
        keys,
        dict.fromkeys(_INDICATORS, F.sum),
        blank_own_number=True,
    )
