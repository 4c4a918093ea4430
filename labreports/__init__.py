"""Clinical-lab reports and directory checks as PySpark DataFrame operators."""

from labreports.operators.details import (
    micro_test_details,
    report_group_details,
    routine_test_details,
    status_details,
)
from labreports.operators.directory import (
    access_report,
    account_attributes,
    account_lookup,
    app_membership,
    directory_with_keys,
    group_by_sid,
    primary_groups,
    with_primary_group_sid,
)
from labreports.operators.headers import (
    environment_requisition_header,
    requisition_demographics,
    requisition_header,
)
from labreports.operators.history import status_history_messages
from labreports.operators.orders import order_summary
from labreports.operators.patients import patient_details, patient_search
from labreports.operators.statistics import large_keys, patient_keys
from labreports.operators.tubes import tube_summary, tubes_not_received
from labreports.sources.warehouse import jdbc_tables, parquet_tables

__all__ = [
    "access_report",
    "account_attributes",
    "account_lookup",
    "app_membership",
    "directory_with_keys",
    "environment_requisition_header",
    "group_by_sid",
    "jdbc_tables",
    "large_keys",
    "micro_test_details",
    "order_summary",
    "parquet_tables",
    "patient_details",
    "patient_keys",
    "patient_search",
    "primary_groups",
    "report_group_details",
    "requisition_demographics",
    "requisition_header",
    "routine_test_details",
    "status_details",
    "status_history_messages",
    "tube_summary",
    "tubes_not_received",
    "with_primary_group_sid",
]
