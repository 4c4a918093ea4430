"""Input tables: their schemas and the ways to read them.

Every operator takes ``t``, a mapping from table name to DataFrame. Where the
frames come from is up to the caller; the two readers below cover a directory
of parquet tables and a relational warehouse.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

Tables = Mapping[str, DataFrame]

#: Columns of each table, as Spark reads them.
SCHEMAS = {
    "dim_lab_order": """
        lab_order_pk bigint, requisition_id string, requisition_status string,
        collection_date date, collection_date_time timestamp_ntz, draw_frequency string,
        patient_type string, patient_name string, patient_dob date, gender string,
        modality_code string, initiate_id string, chart_num string, external_mrn string,
        alternate_patient_id string, ordering_physician_name string,
        spectra_mrn_assc_fk bigint, account_fk bigint, lab_fk bigint""",
    "dim_lab_order_details": """
        lab_order_details_pk string, lab_order_fk bigint, requisition_id string,
        accession_number string, test_category string, order_detail_status string,
        clinical_status string, order_control_reason string, order_test_fk bigint,
        order_test_code string, order_test_name string, priority string,
        specimen_received_date_time timestamp_ntz, specimen_container_desc string,
        specimen_method_desc string, specimen_source_desc string, report_notes string,
        lab_fk int""",
    "results": """
        lab_order_fk bigint, lab_order_details_fk string, result_test_fk bigint,
        result_test_code string, result_test_name string, order_test_name string,
        textual_result string, textual_result_full string, unit_of_measure string,
        reference_range string, result_comment string, abnormal_flag string,
        derived_abnormal_flag string, micro_isolate string, micro_organism_name string,
        micro_sensitivity_name string, micro_sensitivity_flag string,
        source_lab_system string, result_sequence int""",
    "dim_order_test": """
        order_test_pk bigint, micro_culture_format_flag string, order_test_type string,
        inquiry_grouping string, source_lab_system string""",
    "dim_result_test": "result_test_pk bigint, sequence_number int, report_grouping string",
    "status_history": """
        accession_number string, order_test_code string, event_status_code string,
        entered_by string, status_date_time timestamp_ntz""",
    "lov_clinical_status": "clinical_status string, clinical_status_def string",
    "lov_patient_type": "patient_type string, patient_type_sub_group string",
    "lov_report_grouping": "report_grouping string, source_lab_system string, sort_order double",
    "lov_order_control_reason": """
        order_control_reason string, order_control_reason_code string, reportable_flag string""",
    "dim_lab": "lab_pk bigint, lab_id string",
    "dim_facility": """
        facility_pk bigint, facility_id string, fmc_number string, display_name string,
        name string, phone_number string, corporate_acronym string, east_west_flag string,
        client_fk bigint""",
    "dim_client": "client_pk bigint, name string, corporate_acronym string",
    "dim_account": """
        account_pk bigint, account_number string, hlab_number string, name string,
        account_type string, account_status string, facility_fk bigint""",
    "dim_modality": "modality_code string, modality_description string",
    "dim_physician": "physician_pk bigint, physician_name string",
    "dim_patient": """
        patient_pk bigint, full_name string, last_name string, first_name string, dob date,
        gender string, modality_code string, spectra_mrn string, external_mrn string,
        patient_type string, home_phone_number string, primary_email string,
        facility_fk bigint, physician_fk bigint, spectra_mrn_fk bigint""",
    "dim_date": "date_pk int, day date",
    "agg_patient_max_general_lab_mv": "patient_fk bigint, collection_date_fk int",
    "spectra_mrn_associations": """
        spectra_mrn_assc_pk bigint, spectra_mrn_fk bigint, facility_fk bigint""",
    "spectra_mrn_master": "spectra_mrn_pk bigint, spectra_mrn string, mrn_status string",
    "dim_equipment": "spectra_mrn_fk bigint, machine_name string, serial_number string",
    "dir_user": """
        object_class string, sam_account_name string, cn string, name string, mail string,
        distinguished_name string, telephone_number string, object_sid binary,
        primary_group_id string""",
    "dir_group": "object_class string, sam_account_name string, cn string, object_sid binary",
    "dir_attribute_value": "group_cn string, attribute_id string, value string",
}


#: Columns that a directory stored with its keys has besides.
DIRECTORY_KEYS = {
    "dir_user": "account_key string",
    "dir_group": "sid string",
    "dir_attribute_value": "app_key string",
}


def parquet_tables(
    spark: SparkSession, root: str, directory_keys: bool = False
) -> dict[str, DataFrame]:
    """One parquet table per name under ``root``, read with its fixed schema.

    ``directory_keys`` says that the directory was stored by ``directory_with_keys``.
    """
    schemas = dict(SCHEMAS)
    if directory_keys:
        schemas |= {name: f"{SCHEMAS[name]}, {key}" for name, key in DIRECTORY_KEYS.items()}
    return {
        name: spark.read.schema(schema).parquet(f"{root}/{name}")
        for name, schema in schemas.items()
    }


def jdbc_tables(
    spark: SparkSession,
    url: str,
    schema: str,
    properties: dict[str, str],
    splits: Mapping[str, Mapping[str, object]],
) -> dict[str, DataFrame]:
    """The same tables from a relational warehouse.

    ``splits`` gives, for each large table, the ``partitionColumn``,
    ``lowerBound``, ``upperBound`` and ``numPartitions`` of the read, so that
    it runs as many range queries. A table without an entry is read over one
    connection, which only suits code lists and other short tables.
    """
    tables = {}
    for name in SCHEMAS:
        reader = spark.read.format("jdbc").options(
            url=url,
            dbtable=f"{schema}.{name}",
            customSchema=" ".join(SCHEMAS[name].split()),
            **properties,
        )
        tables[name] = reader.options(**splits.get(name, {})).load()
    return tables
