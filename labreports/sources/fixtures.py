"""Warehouse and directory tables derived from the generic test tables.

Each entry is a query that Spark and DuckDB both accept, with the source tables
in braces, so both engines start from the same rows. The rules are fixed values:
they decide which branch of a report each row reaches.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping
from string import Formatter

from pyspark.sql import DataFrame, SparkSession

SOURCES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]

_DETAIL_KEY = (
    "concat(cast(l_orderkey as string), '-', cast(l_linenumber as string), '-',"
    " cast(l_partkey as string), '-', cast(l_suppkey as string))"
)
_SID_START = "'010500000000000515000000', 'A065CF7E', '784B9B5F', 'E77C8770'"


def _sid(relative_id: str) -> str:
    digits = f"lpad(hex({relative_id}), 4, '0')"
    return (
        f"unhex(concat({_SID_START}, substr({digits}, 3, 2), substr({digits}, 1, 2), '0000'))"
    )


FIXTURE_SQL = {
    "dim_lab_order": """
        select o_orderkey as lab_order_pk,
            concat('R', cast(o_orderkey as string)) as requisition_id,
            o_orderstatus as requisition_status,
            cast(o_orderdate as date) as collection_date,
            o_orderdate as collection_date_time,
            o_orderpriority as draw_frequency,
            case when o_custkey % 6 = 0 then null
                 else concat('PT', cast(o_custkey % 6 as string)) end as patient_type,
            concat('Patient ', cast(o_custkey as string)) as patient_name,
            cast('1940-01-01' as date) + cast(o_custkey % 20000 as int) as patient_dob,
            case when o_custkey % 2 = 0 then 'F' else 'M' end as gender,
            concat('M', cast(o_custkey % 4 as string)) as modality_code,
            concat('I', cast(o_custkey as string)) as initiate_id,
            concat('C', cast(o_custkey as string)) as chart_num,
            case when o_custkey % 3 = 0 then cast(o_custkey + 500000 as string)
                 when o_custkey % 3 = 1 then concat('X', cast(o_custkey as string))
                 end as external_mrn,
            concat('ALT', cast(o_custkey as string)) as alternate_patient_id,
            concat('Dr ', cast(o_custkey % 17 as string)) as ordering_physician_name,
            o_custkey as spectra_mrn_assc_fk,
            o_custkey % 10 as account_fk,
            o_orderkey % 5 as lab_fk
        from {orders}""",
    "dim_lab_order_details": f"""
        select {_DETAIL_KEY} as lab_order_details_pk,
            l_orderkey as lab_order_fk,
            concat('R', cast(l_orderkey as string)) as requisition_id,
            concat('A', cast(l_orderkey as string), '-', cast(l_linenumber % 3 as string))
                as accession_number,
            case l_partkey % 8 when 0 then 'MISC' when 1 then 'PENDING' when 2 then 'CALC'
                 when 3 then 'PAT' when 4 then null else 'GEN' end as test_category,
            case l_returnflag when 'R' then 'X' when 'A' then 'F' else 'I' end
                as order_detail_status,
            case l_partkey % 7 when 0 then 'S' when 1 then 'A' when 2 then 'T' when 3 then 'V'
                 when 4 then 'D' when 5 then 'CM' else 'X' end as clinical_status,
            case when l_linenumber % 2 = 0
                 then concat('REASON', cast(l_suppkey % 6 as string)) end as order_control_reason,
            l_partkey as order_test_fk,
            concat('T', cast(l_partkey % 5 as string)) as order_test_code,
            concat('TEST,', cast(l_partkey % 5 as string)) as order_test_name,
            case when l_linenumber % 4 = 0 then 'Q' when l_linenumber = 7 then 'STAT'
                 else 'RTN' end as priority,
            case when l_linestatus = 'F' then l_shipdate end as specimen_received_date_time,
            concat('Tube ', cast(l_suppkey % 3 as string)) as specimen_container_desc,
            concat('Method ', cast(l_suppkey % 2 as string)) as specimen_method_desc,
            concat('Source ', cast(l_suppkey % 4 as string)) as specimen_source_desc,
            case when l_suppkey % 5 = 0 then 'note' end as report_notes,
            cast(l_orderkey % 5 as int) as lab_fk
        from {{lineitem}}""",
    "results": f"""
        select l_orderkey as lab_order_fk,
            {_DETAIL_KEY} as lab_order_details_fk,
            l_partkey as result_test_fk,
            case when l_partkey % 3 = 0 then 'RT-tied' when (l_partkey + rep) % 13 = 0 then 'COLLB'
                 else concat('RT', cast((l_partkey + rep) % 13 as string)) end as result_test_code,
            case when l_partkey % 9 = 0 then 'Collection Time' when l_partkey % 9 = 1 then null
                 else concat('Result ', cast(l_partkey % 9 as string), '.', cast(rep as string))
                 end as result_test_name,
            case when rep = 1 then concat('TEST,', cast(l_partkey % 5 as string), ' R') end
                as order_test_name,
            cast(cast(l_quantity as int) as string) as textual_result,
            case when l_linenumber = 7 then null
                 else concat('full ', cast(cast(l_quantity as int) as string)) end
                as textual_result_full,
            'mg/dL' as unit_of_measure,
            concat('0-', cast(l_partkey % 50 as string)) as reference_range,
            case when rep = 1 then 'repeat' end as result_comment,
            case l_suppkey % 4 when 0 then 'AH' when 1 then 'CE' when 2 then null else 'N' end
                as abnormal_flag,
            case l_suppkey % 9 when 0 then 'AH' when 1 then 'AL' when 2 then 'EH' when 3 then 'EL'
                 when 4 then 'CA' when 5 then 'CE' when 6 then null else 'N' end
                as derived_abnormal_flag,
            case when rep = 0 then '1' else '2' end as micro_isolate,
            concat('Org ', cast(l_partkey % 3 as string)) as micro_organism_name,
            concat('Drug ', cast(l_suppkey % 3 as string)) as micro_sensitivity_name,
            case l_suppkey % 3 when 0 then 'S' when 1 then 'R' end as micro_sensitivity_flag,
            case when l_partkey % 2 = 0 then 'SE' else 'SW' end as source_lab_system,
            case when l_partkey % 3 = 0 then cast(null as int) else rep + 1 end as result_sequence
        from {{lineitem}} join (select 0 as rep union all select 1 as rep) reps
            on l_quantity > 10 + 20 * rep""",
    "dim_order_test": """
        select p_partkey as order_test_pk,
            case when p_type = 'PROMO' then 'Y' else 'N' end as micro_culture_format_flag,
            case p_size % 6 when 0 then '+' when 1 then '-' when 2 then 'C' when 3 then null
                 else 'T' end as order_test_type,
            case p_size % 4 when 0 then 'Problem Log' when 1 then 'Other Tests'
                 else concat('GRP', cast(p_size % 4 as string)) end as inquiry_grouping,
            case when p_partkey % 3 = 0 then 'SE' else 'SW' end as source_lab_system
        from {part}""",
    "dim_result_test": """
        select p_partkey as result_test_pk,
            case when p_size = 50 then null else p_size end as sequence_number,
            case p_size % 5 when 0 then null when 1 then 'Problem Log' when 2 then 'Other Tests'
                 else concat('GRP', cast(p_size % 5 as string)) end as report_grouping
        from {part}""",
    "status_history": """
        select concat('A', cast(l_orderkey as string), '-', cast(a3 as string))
                as accession_number,
            concat('T', cast(t5 as string)) as order_test_code,
            case event_type when 'signup' then 'S' when 'view' then 'A' when 'purchase' then 'D'
                 when 'error' then 'X' else 'T' end as event_status_code,
            case when event_id % 3 = 0 then 'IF' when event_id % 11 = 0 then null
                 else concat('U', cast(user_id as string)) end as entered_by,
            ts as status_date_time
        from (select distinct l_orderkey, l_linenumber % 3 as a3, l_partkey % 5 as t5
              from {lineitem}) d
        join {events} on cast(floor(event_id / 4) as bigint) = d.l_orderkey""",
    "lov_clinical_status": """
        select c1 as clinical_status, c2 as clinical_status_def
        from (values ('S', 'Scheduled'), ('A', 'Received'), ('V', 'Valued'), ('D', 'Done'),
              ('X', 'Cancelled')) t(c1, c2)""",
    "lov_patient_type": """
        select c1 as patient_type, c2 as patient_type_sub_group
        from (values ('PT1', 'HEMO'), ('PT2', 'PD'), ('PT3', 'ENVIRONMENT'), ('PT4', 'STAFF'))
              t(c1, c2)""",
    "lov_report_grouping": """
        select c1 as report_grouping, c2 as source_lab_system, cast(c3 as double) as sort_order
        from (values ('GRP2', 'SE', 10.0), ('GRP2', 'SW', 20.0), ('GRP3', 'SE', 30.0),
              ('GRP4', 'SW', 40.0), ('Other Tests', 'SE', 90.0), ('Problem Log', 'SW', 50.0))
              t(c1, c2, c3)""",
    "lov_order_control_reason": """
        select c1 as order_control_reason, c2 as order_control_reason_code, c3 as reportable_flag
        from (values ('REASON0', 'C0', '1'), ('REASON1', 'C1', '0'), ('REASON2', 'C2', '1'),
              ('REASON3', cast(null as string), '1')) t(c1, c2, c3)""",
    "dim_lab": """
        select cast(c1 as bigint) as lab_pk, c2 as lab_id
        from (values (0, 'SW'), (1, 'SE'), (2, 'HW'), (3, 'HE'), (4, 'ZZ')) t(c1, c2)""",
    "dim_facility": """
        select cast(n_nationkey as bigint) as facility_pk,
            concat('F', cast(n_nationkey as string)) as facility_id,
            concat('FMC', cast(n_nationkey as string)) as fmc_number,
            n_name as display_name,
            concat('Facility ', n_name) as name,
            concat('555-', cast(n_nationkey as string)) as phone_number,
            concat('ACR', cast(n_regionkey as string)) as corporate_acronym,
            case n_nationkey % 3 when 0 then 'SE' when 1 then 'SW' else 'ZZ' end as east_west_flag,
            cast(n_regionkey as bigint) as client_fk
        from {nation}""",
    "dim_client": """
        select cast(r_regionkey as bigint) as client_pk, r_name as name,
            substr(r_name, 1, 3) as corporate_acronym
        from {region}""",
    "dim_account": """
        select s_suppkey as account_pk,
            concat('AC', cast(s_suppkey as string)) as account_number,
            concat('H', cast(s_suppkey as string)) as hlab_number,
            s_name as name,
            case s_suppkey % 8 when 0 then 'STUDY' when 1 then 'DRAW STATION'
                 when 2 then 'IN-HOUSE EAST' when 3 then 'IN-HOUSE WEST' when 4 then 'SPECTRA WEST'
                 when 5 then 'SPECTRA EAST' else 'OTHER' end as account_type,
            case s_suppkey % 5 when 0 then 'Active' when 1 then 'In Progress'
                 when 2 then 'transferred' when 3 then 'Closed' end as account_status,
            cast(s_nationkey as bigint) as facility_fk
        from {supplier}""",
    "dim_modality": """
        select c1 as modality_code, c2 as modality_description
        from (values ('M0', 'Hemo'), ('M1', 'Peritoneal'), ('M2', cast(null as string)))
              t(c1, c2)""",
    "dim_physician": """
        select s_suppkey as physician_pk, s_name as physician_name from {supplier}""",
    "dim_patient": """
        select c_custkey as patient_pk,
            concat(c_mktsegment, ', ', c_name) as full_name,
            c_mktsegment as last_name,
            c_name as first_name,
            cast('1940-01-01' as date) + cast(c_custkey % 20000 as int) as dob,
            case when c_custkey % 2 = 0 then 'F' else 'M' end as gender,
            concat('M', cast(c_custkey % 4 as string)) as modality_code,
            cast(c_custkey + 500000 as string) as spectra_mrn,
            concat('X', cast(c_custkey as string)) as external_mrn,
            concat('PT', cast(c_custkey % 6 as string)) as patient_type,
            concat('555-', cast(c_custkey as string)) as home_phone_number,
            concat('p', cast(c_custkey as string), '@example.org') as primary_email,
            cast(c_nationkey as bigint) as facility_fk,
            case when c_custkey % 7 = 0 then null else c_custkey % 10 end as physician_fk,
            c_custkey as spectra_mrn_fk
        from {customer}""",
    "dim_date": """
        select cast(year(dy) * 10000 + month(dy) * 100 + day(dy) as int) as date_pk, dy as day
        from (select distinct cast(o_orderdate as date) as dy from {orders}) d""",
    "agg_patient_max_general_lab_mv": """
        select o_custkey as patient_fk,
            cast(year(dy) * 10000 + month(dy) * 100 + day(dy) as int) as collection_date_fk
        from (select o_custkey, max(cast(o_orderdate as date)) as dy
              from {orders} group by o_custkey) m""",
    "spectra_mrn_associations": """
        select c_custkey as spectra_mrn_assc_pk, c_custkey as spectra_mrn_fk,
            cast(c_nationkey as bigint) as facility_fk
        from {customer}""",
    "spectra_mrn_master": """
        select c_custkey as spectra_mrn_pk, cast(c_custkey + 500000 as string) as spectra_mrn,
            case when c_custkey % 5 = 0 then 'MERGED' else 'ACTIVE' end as mrn_status
        from {customer}""",
    "dim_equipment": """
        select c_custkey as spectra_mrn_fk,
            concat('Machine ', cast(rep as string)) as machine_name,
            concat('SN', cast(c_custkey as string)) as serial_number
        from {customer} join (select 0 as rep union all select 1 as rep) reps
            on c_custkey % 4 = rep""",
    "dir_user": f"""
        select 'user' as object_class,
            concat('user', cast(c_custkey % 1000 as string)) as sam_account_name,
            c_name as cn,
            c_name as name,
            case when c_custkey % 3 = 0 then null
                 else concat('u', cast(c_custkey as string), '@example.org') end as mail,
            concat('CN=', c_name, ',OU=Users,DC=example,DC=org') as distinguished_name,
            case when c_custkey % 4 = 0 then null
                 else concat('555-', cast(c_custkey as string)) end as telephone_number,
            {_sid("c_custkey + 5000")} as object_sid,
            cast(1000 + c_nationkey as string) as primary_group_id
        from {{customer}}""",
    "dir_group": f"""
        select 'group' as object_class,
            concat('grp_', n_name, '_', cast(rep as string)) as sam_account_name,
            n_name as cn,
            {_sid("1000 + n_nationkey")} as object_sid
        from {{nation}} join (select 0 as rep union all select 1 as rep) reps
            on n_nationkey % 6 <> 5 and (rep = 0 or n_nationkey % 6 = 4)""",
    "dir_attribute_value": """
        select concat(case when app = 1 then 'App' else 'APP' end, cast(app as string)) as group_cn,
            case when c_custkey % 11 = 0 then 'description' else 'member' end as attribute_id,
            concat('CN=', c_name, ',OU=Users,DC=example,DC=org') as value
        from {customer} join (select 0 as app union all select 1 as app union all select 2 as app)
            apps on c_custkey % 5 = app or c_custkey % 7 = app""",
}


class FixtureTables(Mapping):
    """The derived tables of one directory; each is planned when it is first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark = spark
        self._sf_dir = sf_dir
        self._sources: dict[str, DataFrame] = {}
        self._tables: dict[str, DataFrame] = {}

    def query(self, sql: str) -> DataFrame:
        """Run a query with source tables in braces."""
        used = [name for _, name, _, _ in Formatter().parse(sql) if name]
        for name in used:
            if name not in self._sources:
                self._sources[name] = self._spark.read.parquet(f"{self._sf_dir}/{name}.parquet")
        return self._spark.sql(sql, **{name: self._sources[name] for name in used})

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self.query(FIXTURE_SQL[name])
        return self._tables[name]

    def __iter__(self) -> Iterator[str]:
        return iter(FIXTURE_SQL)

    def __len__(self) -> int:
        return len(FIXTURE_SQL)


def fixture_ctes(names: Iterable[str]) -> str:
    """The chosen tables as common table expressions over the source tables' own names."""
    plain = {name: name for name in SOURCES}
    return ",\n".join(f"{name} as ({FIXTURE_SQL[name].format(**plain)})" for name in names)
