"""Specimen tubes: what was received, what is missing and how far testing is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labreports.functions import rules
from labreports.functions.ordering import ascending
from labreports.plans.scope import requisition_scope
from labreports.plans.skew import (
    LargeGroups,
    number_rows,
    sampled,
    stored_values,
)
from labreports.sources.warehouse import Tables

# Categories left out. A null category is left out as well.
_NOT_ACCESSIONED = ["MISC", "PENDING", "PAT"]
_NOT_IN_CONTAINER = ["MISC", "PENDING", "CALC", "PAT"]
_CONDITION_CATEGORY = "MISC"

_ACCESSION = ["requisition_id", "accession_number"]
_CONTAINER = ["specimen_container_desc", "specimen_method_desc"]


def detail_sample(details: DataFrame) -> DataFrame:
    return sampled(details, "lab_order_details_pk").select("requisition_id")


def tube_summary(t: Tables, requisitions: DataFrame | None = None) -> DataFrame:
    """One row per accession and container of a requisition, in accession order.

    Details are read once and counted by all that the rows tell apart. What is left of an accession
    is as many rows as it has labs, containers and methods, so its labs and containers are lists.
    """
    scope = requisition_scope(requisitions)
    details = scope.keep(t["dim_lab_order_details"], "requisition_id")
    category = F.col("test_category")
    accessioned = ~category.isin(_NOT_ACCESSIONED)
    listed = ~category.isin(_NOT_IN_CONTAINER)

    def count_of(*statuses: str) -> Column:
        return F.count_if(accessioned & F.col("clinical_status").isin(*statuses))

    counts = {
        "test_count": F.count_if(accessioned),
        "scheduled_count": count_of("S"),
        "in_process_count": count_of("A", "T", "V"),
        "done_count": count_of("D"),
        "complete_count": count_of("CM", "D", "X"),
        "cancel_count": count_of("CM", "X"),
    }
    received = "specimen_received_date_time"
    found = details.groupBy(*_ACCESSION, "lab_fk", *_CONTAINER).agg(
        F.min(F.when(accessioned, F.col(received))).alias(received),
        F.max(listed).alias("listed"),
        F.max(F.when(category == _CONDITION_CATEGORY, F.col("order_test_name"))).alias("condition"),
        *[count.alias(name) for name, count in counts.items()],
    )
    # A container is listed once per lab, and goes with every lab of its accession.
    container = F.struct(*_CONTAINER, F.col("lab_fk").alias("container_lab_fk"))
    of_lab = found.groupBy(*_ACCESSION, "lab_fk").agg(
        F.min(received).alias(received),
        F.max("condition").alias("condition"),
        F.collect_list(F.when(F.col("listed"), container)).alias("containers"),
        *[F.sum(name).alias(name) for name in counts],
    )
    lab = F.struct("lab_fk", received, rules.tube_status().alias("derived_status"))
    of_accession = of_lab.groupBy(*_ACCESSION).agg(
        F.max("condition").alias("condition"),
        F.flatten(F.collect_list("containers")).alias("containers"),
        F.collect_list(F.when(F.col("test_count") > 0, lab)).alias("labs"),
    )
    # Without an accession number nothing is joined.
    named = F.col("accession_number").isNotNull()
    rows = of_accession.select(
        *_ACCESSION,
        F.when(named, F.col("condition")).alias("condition"),
        F.when(named, F.col("containers")).alias("containers"),
        F.explode("labs").alias("lab"),
    )
    rows = rows.select(*_ACCESSION, "condition", "lab.*", F.explode_outer("containers").alias("container"))
    rows = rows.select(*_ACCESSION, "condition", "lab_fk", received, "derived_status", "container.*")
    order = ascending("accession_number", *_CONTAINER, "lab_fk", "container_lab_fk")
    large = LargeGroups.of(
        detail_sample(details), "requisition_id", stored_values(t, "details_of_requisition")
    )
    return number_rows(rows, "requisition_id", order, "sort_position", large).select(
        "requisition_id",
        "sort_position",
        "accession_number",
        *_CONTAINER,
        "specimen_received_date_time",
        "condition",
        "derived_status",
        F.coalesce("lab_fk", F.lit(0)).alias("lab_fk"),
    )


def tubes_not_received(details: DataFrame) -> DataFrame:
    """Per requisition, the tubes of accessions of which nothing was received yet.

    Counting the containers before the accessions lets each step combine ahead
    of its shuffle; an accession without a container counts as one tube.
    """
    in_container = ~F.col("test_category").isin(_NOT_IN_CONTAINER)
    containers = (
        details.filter(~F.col("test_category").isin(_NOT_ACCESSIONED))
        .groupBy(*_ACCESSION, *_CONTAINER)
        .agg(
            F.max("specimen_received_date_time").alias("received"),
            F.max(F.when(in_container, 1).otherwise(0)).alias("listed"),
        )
    )
    named = F.col("accession_number").isNotNull()
    accessions = containers.groupBy(*_ACCESSION).agg(
        F.max("received").alias("received"),
        F.greatest(F.sum(F.when(named, F.col("listed"))), F.lit(1)).alias("tubes"),
    )
    missing = F.when(F.col("received").isNull(), F.col("tubes")).otherwise(0)
    return accessions.groupBy("requisition_id").agg(F.sum(missing).alias("NumOfTubesNotReceived"))
