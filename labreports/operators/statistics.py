"""What reports look up about keys before they plan: taken once, stored, and passed in.

``large_keys`` goes into the tables under its own name. ``patient_keys`` is given to the patient
search. Both are small whatever the tables hold, and a stale one costs time, not rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labreports.operators.details import requisition_sample
from labreports.operators.orders import order_sample
from labreports.operators.patients import name_pieces, name_start
from labreports.operators.tubes import detail_sample
from labreports.plans.skew import as_stored
from labreports.sources.warehouse import Tables


def large_keys(t: Tables) -> DataFrame:
    """Requisitions and patients with very many rows, from a sample of the whole tables.

    With this table among the tables, as ``large_keys``, no report draws a sample.
    """
    details, results = t["dim_lab_order_details"], t["results"]
    patients = (
        t["spectra_mrn_associations"]
        .join(
            t["spectra_mrn_master"].withColumnRenamed("spectra_mrn_pk", "spectra_mrn_fk"), "spectra_mrn_fk"
        )
        .select(F.col("spectra_mrn_assc_pk").alias("spectra_mrn_assc_fk"), "spectra_mrn")
    )
    found = [
        as_stored(
            requisition_sample(details, results), "rows_of_requisition", "requisition_id", "order"
        ),
        as_stored(detail_sample(details), "details_of_requisition", "requisition_id"),
        as_stored(order_sample(t["dim_lab_order"], patients), "orders_of_patient", "spectra_mrn"),
    ]
    return reduce(DataFrame.unionByName, found)


def patient_keys(patients: DataFrame) -> DataFrame:
    """``by, value, n``: how many patients each key that searches look patients up by has.

    There are as many rows as facilities, birth dates and groups of three letters.
    """
    named = patients.withColumn("upper_name", F.upper("full_name"))
    kinds = F.array(
        F.struct(F.lit("facility").alias("by"), F.col("facility_fk").cast("string").alias("value")),
        F.struct(F.lit("born").alias("by"), F.col("dob").cast("string").alias("value")),
        F.struct(F.lit("start").alias("by"), name_start().alias("value")),
        F.struct(F.lit("all").alias("by"), F.lit("").alias("value")),
    )
    pieces = F.transform(
        F.coalesce(name_pieces(), F.array().cast("array<string>")),
        lambda piece: F.struct(F.lit("piece").alias("by"), piece.alias("value")),
    )
    keys = named.select(F.explode(F.concat(kinds, pieces)).alias("key")).select("key.*")
    return keys.filter(F.col("value").isNotNull()).groupBy("by", "value").agg(F.count("*").alias("n"))
