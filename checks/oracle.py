"""Each registered query in SQL for DuckDB, written from the reports' meaning."""

from __future__ import annotations

from checks.requests import request_cte
from labreports.sources.fixtures import fixture_ctes

FROM_DATE = "1995-01-01"
AS_OF = "2001-08-01"

_CITY = """case {0} when 'SW' then 'Milpitas' when 'HW' then 'Milpitas'
    when 'SE' then 'Rockleigh' when 'HE' then 'Rockleigh' else {0} end"""
_STATUS = """case requisition_status when 'F' then 'Final' when 'P' then 'Partial'
    else requisition_status end"""
_FLAGS = "('AH', 'AL', 'EH', 'EL', 'CA', 'CE')"


def _query(tables: list[str], ctes: str, final: str, requests: list[str] = ()) -> str:
    parts = [fixture_ctes(tables), *[request_cte(name) for name in requests]]
    if ctes:
        parts.append(ctes)
    return "with " + ",\n".join(parts) + "\n" + final


_TUBE_SUMMARY = _query(
    ["dim_lab_order_details"],
    """
    accessions as (
        select requisition_id, accession_number, lab_fk,
            min(specimen_received_date_time) as specimen_received_date_time,
            count(*) as tests,
            count(*) filter (where clinical_status = 'S') as scheduled,
            count(*) filter (where clinical_status in ('A', 'T', 'V')) as in_process,
            count(*) filter (where clinical_status = 'D') as done,
            count(*) filter (where clinical_status in ('CM', 'D', 'X')) as complete,
            count(*) filter (where clinical_status in ('CM', 'X')) as cancelled
        from dim_lab_order_details
        where test_category not in ('MISC', 'PENDING', 'PAT')
        group by all),
    containers as (
        select distinct requisition_id, accession_number, lab_fk as container_lab,
            specimen_container_desc, specimen_method_desc
        from dim_lab_order_details
        where test_category not in ('MISC', 'PENDING', 'CALC', 'PAT'))""",
    """
    select requisition_id,
        row_number() over (partition by requisition_id
            order by accession_number nulls last, specimen_container_desc nulls last,
                specimen_method_desc nulls last, lab_fk nulls last, container_lab nulls last)
            as sort_position,
        accession_number, specimen_container_desc, specimen_method_desc,
        specimen_received_date_time,
        (select max(order_test_name) from dim_lab_order_details m
         where m.requisition_id = a.requisition_id and m.accession_number = a.accession_number
           and m.test_category = 'MISC') as condition,
        case when in_process > 0 and specimen_received_date_time is null then 'Intransit'
             when scheduled = tests then 'Scheduled'
             when in_process > 0 then 'In Process'
             when cancelled = tests then 'Cancelled'
             when complete = tests then 'Done'
             when done > 0 then 'Partial Complete' end as derived_status,
        lab_fk
    from accessions a left join containers c using (requisition_id, accession_number)""",
)

_TUBES = """
    accessions as (
        select requisition_id, accession_number, min(specimen_received_date_time) as received
        from dim_lab_order_details
        where test_category not in ('MISC', 'PENDING', 'PAT')
        group by all),
    containers as (
        select distinct requisition_id, accession_number, specimen_container_desc,
            specimen_method_desc
        from dim_lab_order_details
        where test_category not in ('MISC', 'PENDING', 'CALC', 'PAT')),
    tubes as (
        select requisition_id,
            cast(count(*) - count(received) as bigint) as "NumOfTubesNotReceived"
        from accessions left join containers using (requisition_id, accession_number)
        group by requisition_id)"""

_TUBES_NOT_RECEIVED = _query(["dim_lab_order_details"], _TUBES, "select * from tubes")

_CANCELLED = """coalesce((d.order_detail_status = 'X' or d.clinical_status = 'CM')
    and d.order_control_reason is not null
    and (select count(order_control_reason_code) from lov_order_control_reason v
         where v.order_control_reason = d.order_control_reason and v.reportable_flag = '1') > 0,
    false)"""

_ORDER_ROWS = (
    _TUBES
    + f""",
    summary as (
        select spectra_mrn, o.requisition_id, collection_date, {_STATUS} as requisition_status,
            draw_frequency, patient_type, corporate_acronym, display_name,
            coalesce("NumOfTubesNotReceived", 0) as "NumOfTubesNotReceived",
            count(distinct lab_order_details_pk) as test_count,
            sum(case when {_CANCELLED} then 1 else 0 end) <> 0 as cancelled_test_ind,
            sum(case when derived_abnormal_flag in {_FLAGS} then 1 else 0 end) <> 0
                as alert_exception_ind
        from dim_lab_order o
        join spectra_mrn_associations a on a.spectra_mrn_assc_pk = o.spectra_mrn_assc_fk
        join dim_facility f on f.facility_pk = a.facility_fk
        join spectra_mrn_master m on m.spectra_mrn_pk = a.spectra_mrn_fk
        join dim_lab_order_details d on d.lab_order_fk = o.lab_order_pk
        left join results r on r.lab_order_fk = o.lab_order_pk
            and r.lab_order_details_fk = d.lab_order_details_pk
        left join tubes on tubes.requisition_id = o.requisition_id
        where collection_date between date '{FROM_DATE}' and date '{AS_OF}'
            and test_category not in ('MISC', 'PENDING')
        group by all),
    numbered as (
        select *,
            row_number() over (partition by spectra_mrn
                order by collection_date desc nulls first, requisition_id nulls last,
                    requisition_status nulls last, draw_frequency nulls last,
                    patient_type nulls last, display_name nulls last) as sl_no,
            count(distinct requisition_id) over (partition by spectra_mrn) as total_count
        from summary)"""
)
_ORDER_TABLES = [
    "dim_lab_order",
    "spectra_mrn_associations",
    "dim_facility",
    "spectra_mrn_master",
    "dim_lab_order_details",
    "results",
    "lov_order_control_reason",
]

_HISTORY_TABLES = ["dim_lab_order_details", "dim_lab_order", "dim_lab", "status_history"]
_MESSAGES = """
    history as (
        select d.requisition_id, d.accession_number, d.order_test_code, d.priority,
            s.event_status_code as event, s.entered_by as person,
            coalesce(replace(d.order_test_name, ',', '-'), '') || '|'
                || coalesce(strftime(s.status_date_time, '%m/%d/%Y %H:%M %p'), '') || ' '
                || coalesce(case when lab_id in ('SW', 'HW') then 'PT'
                                 when lab_id in ('SE', 'HE') then 'ET' else lab_id end, '')
                || '|' as start
        from dim_lab_order_details d
        join dim_lab_order o on o.lab_order_pk = d.lab_order_fk
        join dim_lab l on l.lab_pk = o.lab_fk
        join status_history s on s.accession_number = d.accession_number
            and s.order_test_code = d.order_test_code
        where s.event_status_code in ('A', 'D', 'X', 'S')),
    lines as (
        select distinct requisition_id, accession_number, order_test_code,
            case when event = 'D' then start || 'Result Finalized'
                 when person is null then '*'
                 when event = 'X' and person = 'IF' then start || 'Cancelled'
                 when event = 'X' then start || 'Cancelled - ' || person
                 when priority is null or priority not in ('RTN', 'Q') then '*'
                 else start || case when person = 'IF' then 'Interface ' else 'Manual ' end
                     || case when priority = 'Q' then 'Add-On ' else '' end
                     || case when event = 'S' then 'Order Received' else 'Tube Scanned' end
                     || case when person = 'IF' then '' else ' - ' || person end
                 end as line
        from history),
    messages as (
        select requisition_id, accession_number, order_test_code,
            string_agg(line, ',' order by line) as sh_msg
        from lines group by all)"""

_STATUS_HISTORY_MESSAGES = _query(_HISTORY_TABLES, _MESSAGES, "select * from messages")

_DETAIL_TABLES = [
    *_HISTORY_TABLES,
    "results",
    "dim_order_test",
    "dim_result_test",
    "lov_clinical_status",
    "lov_patient_type",
    "lov_report_grouping",
]
_TIES = """lab_order_details_pk nulls last, result_sequence nulls last,
    result_test_code nulls last, textual_result nulls last, textual_result_full nulls last,
    accession_number nulls last, order_test_name nulls last, result_test_name nulls last,
    unit_of_measure nulls last, reference_range nulls last, abnormal_flag nulls last,
    result_comment nulls last, clinical_status nulls last, order_control_reason nulls last"""
_MICRO_TIES = ", ".join(
    f"{column} nulls last"
    for column in [
        "patient_type_sub_group",
        "report_notes",
        "specimen_method_desc",
        "specimen_source_desc",
        "seq_num",
        "micro_isolate",
        "micro_organism_name",
        "micro_sensitivity_name",
    ]
)


def _details(micro: str, categories: str, columns: str, joins: str) -> str:
    return f"""
    rows as (
        select d.requisition_id, d.accession_number,
            coalesce(r.order_test_name, d.order_test_name) as order_test_name,
            coalesce(r.result_test_name, d.order_test_name) as result_test_name,
            r.unit_of_measure, r.reference_range, r.derived_abnormal_flag as abnormal_flag,
            r.result_comment,
            coalesce(c.clinical_status_def, d.clinical_status) as clinical_status,
            d.order_control_reason, coalesce(sh_msg, '-') as sh_msg,
            d.order_test_name as ordered_name, d.lab_order_details_pk, r.result_sequence,
            r.result_test_code, r.textual_result, {columns}
        from dim_lab_order_details d
        join dim_order_test t on t.order_test_pk = d.order_test_fk
        {joins}
        left join lov_clinical_status c on c.clinical_status = d.clinical_status
        left join messages m on m.requisition_id = d.requisition_id
            and m.accession_number = d.accession_number
            and m.order_test_code = d.order_test_code
        where t.micro_culture_format_flag = '{micro}'
            and coalesce(d.test_category, 'X') not in {categories}
            and coalesce(t.order_test_type, 'X') not in ('+', '-', 'C'))"""


_SHOWN_RESULT = """case
    when r.textual_result_full is null and d.order_detail_status in ('I', 'O', 'P') then 'PENDING'
    when r.textual_result_full is null and d.order_detail_status = 'X' then 'CANCELLED'
    else r.textual_result_full end as textual_result_full"""
_PATIENT_GROUP = """
    left join dim_lab_order o on o.lab_order_pk = d.lab_order_fk
    left join lov_patient_type p on p.patient_type = o.patient_type"""
_NOT_COLLECTED_BY = "coalesce(result_test_code, 'X') <> 'COLLB'"


def _positions(order: str, where: str = "true", last: str = "null") -> str:
    return f"""
    select * exclude (ordered_name, lab_order_details_pk, result_sequence, result_test_code,
                      textual_result, sort_keys),
        row_number() over (partition by requisition_id order by {order}, {_TIES}, {last})
            as sort_position,
        count(*) over (partition by requisition_id, order_test_name) as parent_test_count
    from (select *, null as sort_keys from rows where {where}) kept"""


_ROUTINE = _query(
    _DETAIL_TABLES,
    _MESSAGES
    + ","
    + _details(
        "N",
        "('PENDING')",
        f"{_SHOWN_RESULT}, p.patient_type_sub_group",
        "left join results r on r.lab_order_details_fk = d.lab_order_details_pk" + _PATIENT_GROUP,
    ),
    _positions(
        "accession_number nulls last, ordered_name nulls last, result_test_name nulls last",
        _NOT_COLLECTED_BY,
    ),
)

_MICRO = _query(
    _DETAIL_TABLES,
    _MESSAGES
    + ","
    + _details(
        "Y",
        "('MISC', 'PENDING')",
        """r.textual_result_full, p.patient_type_sub_group, d.report_notes,
            d.specimen_method_desc, d.specimen_source_desc,
            case when upper(r.result_test_name) = 'COLLECTION TIME' then 1
                 else rt.sequence_number end as seq_num,
            r.micro_isolate, r.micro_organism_name, r.micro_sensitivity_name,
            r.micro_sensitivity_flag""",
        """left join results r on r.lab_order_details_fk = d.lab_order_details_pk
        left join dim_result_test rt on rt.result_test_pk = r.result_test_fk"""
        + _PATIENT_GROUP,
    ),
    _positions(
        """accession_number nulls last, ordered_name nulls last, seq_num nulls last,
        micro_sensitivity_flag nulls last""",
        last=_MICRO_TIES,
    ),
)

_GROUPED_ROWS = (
    _MESSAGES
    + ","
    + _details(
        "N",
        "('PENDING')",
        f"""{_SHOWN_RESULT}, coalesce(r.report_grouping, t.inquiry_grouping) as report_grouping,
            case when coalesce(r.report_grouping, t.inquiry_grouping) = 'Problem Log' then 0.1
                 when g.sort_order is not null then g.sort_order
                 else (select g2.sort_order from lov_report_grouping g2
                       where g2.report_grouping = coalesce(r.report_grouping, t.inquiry_grouping)
                         and g2.source_lab_system = t.source_lab_system) end as group_order,
            case when coalesce(r.report_grouping, t.inquiry_grouping) = 'Other Tests'
                 then coalesce(r.order_test_name, d.order_test_name)
                 else coalesce(cast(r.sequence_number as string), '') || 'A' end as test_text""",
        """left join (select x.*, rt.report_grouping, rt.sequence_number from results x
                      join dim_result_test rt on rt.result_test_pk = x.result_test_fk) r
            on r.lab_order_details_fk = d.lab_order_details_pk
        left join lov_report_grouping g on g.report_grouping = r.report_grouping
            and g.source_lab_system = r.source_lab_system""",
    )
)
_GROUP_ORDER = """group_order nulls last, report_grouping nulls last, test_text nulls last,
    result_test_name nulls last"""
_STATUS_RANK = """case clinical_status when 'Cancelled' then 1 when 'Scheduled' then 2
    when 'Received' then 3 when 'Valued' then 4 when 'Done' then 5 else 6 end"""


def _grouped(order: str) -> str:
    final = _positions(order, _NOT_COLLECTED_BY)
    final = final.replace("sort_keys)", "sort_keys, group_order, test_text)", 1)
    return _query(_DETAIL_TABLES, _GROUPED_ROWS, final)


_HEADER_TABLES = [
    "dim_lab_order",
    "dim_lab",
    "spectra_mrn_associations",
    "spectra_mrn_master",
    "dim_account",
    "dim_facility",
    "dim_client",
    "dim_modality",
    "dim_lab_order_details",
    "lov_patient_type",
    "results",
    "lov_order_control_reason",
    "dim_equipment",
]
_HEADER_COLUMNS = f"""o.requisition_id, {_STATUS} as requisition_status, o.patient_name,
    o.patient_dob, o.gender, coalesce(dm.modality_description, o.modality_code) as modality,
    o.initiate_id, cast(m.spectra_mrn as bigint) as spectra_mrn, o.chart_num,
    o.ordering_physician_name, a.account_number, a.hlab_number, a.name as account_name,
    f.facility_id as primary_facility_number, c.name as corporation_name, o.draw_frequency,
    f.facility_pk, o.alternate_patient_id, count(distinct d.lab_order_details_pk) as test_count"""
_HEADER_JOINS = """dim_lab_order o
    join spectra_mrn_associations s on s.spectra_mrn_assc_pk = o.spectra_mrn_assc_fk
    join spectra_mrn_master m on m.spectra_mrn_pk = s.spectra_mrn_fk
    join dim_account a on a.account_pk = o.account_fk
    join dim_facility f on f.facility_pk = a.facility_fk
    join dim_client c on c.client_pk = f.client_fk
    join dim_modality dm on dm.modality_code = o.modality_code
    join dim_lab_order_details d on d.lab_order_fk = o.lab_order_pk
    left join results r on r.lab_order_fk = o.lab_order_pk
        and r.lab_order_details_fk = d.lab_order_details_pk"""
_LAB_AND_TYPE_JOINS = """
    join dim_lab l on l.lab_pk = o.lab_fk
    join lov_patient_type p on p.patient_type = o.patient_type"""
_INDICATORS = f"""
    sum(case when {_CANCELLED} then 1 else 0 end) <> 0 as cancelled_test_ind,
    sum(case when r.derived_abnormal_flag in {_FLAGS} then 1 else 0 end) <> 0
        as alert_exception_ind"""


def _header(columns: str, joins: str) -> str:
    return _query(
        _HEADER_TABLES,
        "",
        f"""select * exclude (alternate_patient_id) from (
            select {_HEADER_COLUMNS}, {columns}
            from {_HEADER_JOINS} {joins}
            where d.test_category not in ('MISC', 'PENDING')
            group by all) h""",
    )


_REQUISITION_HEADER = _header(
    f"""o.collection_date, o.external_mrn, f.display_name as facility_name, o.patient_type,
    p.patient_type_sub_group, {_CITY.format("l.lab_id")} as lab_name, {_INDICATORS}""",
    _LAB_AND_TYPE_JOINS,
)
_ENVIRONMENT_HEADER = _header(
    f"""o.collection_date_time, o.external_mrn, f.display_name as facility_name, o.patient_type,
    p.patient_type_sub_group, {_CITY.format("l.lab_id")} as lab_name, e.machine_name,
    e.serial_number, {_INDICATORS},
    max(case when r.result_test_code = 'COLLB' then r.textual_result end) as collb""",
    _LAB_AND_TYPE_JOINS + " join dim_equipment e on e.spectra_mrn_fk = s.spectra_mrn_fk",
)
_DEMOGRAPHICS = _header(
    f"""o.collection_date,
    case when o.external_mrn = m.spectra_mrn then null else o.external_mrn end as external_mrn,
    f.name as facility_name,
    cast(sum(case when d.order_detail_status = 'X' then 1 else 0 end) as bigint)
        as cancelled_test_ind,
    cast(sum(case when r.abnormal_flag in {_FLAGS} then 1 else 0 end) as bigint)
        as alert_exception_ind""",
    "",
)

_PATIENT_TABLES = [
    "dim_patient",
    "dim_facility",
    "dim_client",
    "dim_modality",
    "dim_physician",
    "dim_date",
    "agg_patient_max_general_lab_mv",
    "spectra_mrn_master",
    "dim_account",
]


def _search(searches: str, condition: str, filtered: str, order: str) -> str:
    return _query(
        _PATIENT_TABLES,
        "",
        f"""
        select search_id, corp_name, facility_name, facility_id, fmc_number, full_name, dob,
            gender, last_general_lab_date, modality, cast(mrn as bigint) as spectra_mrn,
            external_mrn, physician_name, lab, patient_type, facility_fk,
            row_number() over (partition by search_id order by {order}, patient_pk) as sl_no,
            count(mrn) over (partition by search_id) as total_entity_cnt
        from (
            select q.search_id, c.name as corp_name,
                coalesce(c.corporate_acronym, '') || ' - ' || coalesce(f.display_name, '')
                    as facility_name,
                f.facility_id, f.fmc_number, p.full_name, p.last_name, p.first_name, p.dob,
                p.gender, dd.day as last_general_lab_date, p.patient_type, p.patient_pk,
                coalesce(dm.modality_description, p.modality_code) as modality,
                p.spectra_mrn as mrn, p.external_mrn, ph.physician_name,
                case f.east_west_flag when 'SE' then 'Rockleigh' when 'SW' then 'Milpitas'
                    else f.east_west_flag end as lab,
                p.facility_fk
            from dim_patient p
            join {searches} q on {condition}
            join agg_patient_max_general_lab_mv x on x.patient_fk = p.patient_pk
            join dim_date dd on dd.date_pk = x.collection_date_fk
            join dim_facility f on f.facility_pk = p.facility_fk
            join dim_client c on c.client_pk = f.client_fk
            left join dim_modality dm on dm.modality_code = p.modality_code
            left join dim_physician ph on ph.physician_pk = p.physician_fk
            join spectra_mrn_master m on m.spectra_mrn_pk = p.spectra_mrn_fk
            where (not ({filtered}) or m.mrn_status = 'ACTIVE') and exists (
                select 1 from dim_account a where a.facility_fk = f.facility_pk
                and a.account_type in ('STUDY', 'DRAW STATION', 'IN-HOUSE EAST',
                    'IN-HOUSE WEST', 'SPECTRA WEST', 'SPECTRA EAST')
                and upper(a.account_status) in ('ACTIVE', 'IN PROGRESS', 'TRANSFERRED'))) hits""",
        [searches],
    )


_BY_NAME = """upper(last_name) nulls last, upper(first_name) nulls last,
    last_general_lab_date desc nulls first"""
_LIKE_START = "upper(p.full_name) like upper(q.name) || '%'"
_LIKE_WORDS = """upper(p.full_name)
    like upper(regexp_replace(q.name, '\\s+', '%', 'g')) || '%'"""

_PATIENT_DETAILS = _query(
    _PATIENT_TABLES,
    "",
    """
    select p.full_name, p.dob, p.gender,
        coalesce(dm.modality_description, p.modality_code) as modality,
        cast(p.spectra_mrn as bigint) as spectra_mrn, p.external_mrn, c.name as client_name,
        f.facility_id, f.name as facility_name, f.phone_number, p.home_phone_number,
        p.primary_email, ph.physician_name,
        case f.east_west_flag when 'SE' then 'Rockleigh' when 'SW' then 'Milpitas'
            else f.east_west_flag end as lab,
        p.facility_fk, p.patient_type
    from dim_patient p
    join dim_facility f on f.facility_pk = p.facility_fk
    join dim_client c on c.client_pk = f.client_fk
    left join dim_modality dm on dm.modality_code = p.modality_code
    left join dim_physician ph on ph.physician_pk = p.physician_fk""",
)

# The SID text is built from the keys here, not decoded from the binary.
_SID = "'S-1-5-21-2127521184-1604012920-1887927527-'"
_ACCOUNT = "cn, name, mail, sam_account_name, distinguished_name, telephone_number"
_FIRST = """
    firsts as (
        select lower(sam_account_name) as account_key,
            arg_min(u, distinguished_name) as entry, count(*) as matches
        from dir_user u where object_class = 'user' group by 1)"""
_MEMBERS = """
    members as (
        select distinct lower(group_cn) as app, split_part(value, ',', 1) as member
        from dir_attribute_value where attribute_id in ('name', 'member'))"""

_ENTRY = ", ".join(f"entry.{c.strip()} as {c.strip()}" for c in _ACCOUNT.split(","))

_UNIQUE = _query(
    ["dir_user"],
    _FIRST,
    f"""select user_id, {_ENTRY} from account_names
    left join (select * from firsts where matches = 1) on account_key = lower(user_id)""",
    ["account_names"],
)
_FIRST_ACCOUNT = _query(
    ["dir_user"],
    _FIRST,
    f"""select user_id, {_ENTRY} from account_names
    left join firsts on account_key = lower(user_id)""",
    ["account_names"],
)
_ATTRIBUTES = _query(
    ["dir_user"],
    _FIRST,
    """select user_id, entry.telephone_number as telephone_number from account_names
    left join firsts on account_key = lower(user_id)""",
    ["account_names"],
)
_PRIMARY_GROUP_SID = f"""
    select concat('CN=', c_name, ',OU=Users,DC=example,DC=org') as distinguished_name,
        {_SID} || cast(1000 + c_nationkey as string) as primary_group_sid
    from customer"""
_GROUP_NAMES = f"""
    named as (
        select {_SID} || cast(1000 + n_nationkey as string) as sid,
            concat('grp_', n_name, '_', cast(rep as string)) as group_name,
            count(*) over (partition by n_nationkey) as matches
        from nation join (select 0 as rep union all select 1 as rep) reps
            on n_nationkey % 6 <> 5 and (rep = 0 or n_nationkey % 6 = 4))"""
_GROUP_BY_SID = _query(
    [],
    _GROUP_NAMES,
    """select g.sid, group_name from group_sids g
    left join (select * from named where matches = 1) n on n.sid = g.sid""",
    ["group_sids"],
).replace("with ,\n", "with ", 1)
_PRIMARY_GROUPS = f"""with {_GROUP_NAMES.strip()},
    accounts as (
        select concat('user', cast(c_custkey % 1000 as string)) as user_id, count(*) as matches,
            min(c_name) as cn, {_SID} || cast(1000 + min(c_nationkey) as string) as sid
        from customer group by 1)
    select user_id, case when a.matches = 1 then cn end as cn,
        case when a.matches = 1 then a.sid end as primary_group_sid, group_name
    from accounts a left join named n
        on n.sid = a.sid and n.matches = 1 and a.matches = 1"""
_APP_MEMBERSHIP = _query(
    ["dir_attribute_value"],
    _MEMBERS,
    """select distinct q.cn, q.app, case when member is null then 0 else 1 end as is_member
    from member_requests q left join members m on m.app = lower(q.app) and member = 'CN=' || q.cn""",
    ["member_requests"],
)
_ACCESS_REPORT = _query(
    ["dir_user", "dir_attribute_value"],
    _FIRST + "," + _MEMBERS,
    """
    select distinct user_id, q.app, entry.cn as cn,
        case when entry is null then 'Sorry your User-id (network-id) is invalid...'
             when member is not null
                 then 'MATCHING ENTRY FOUND FOR: ' || upper(entry.cn) || ' IN THE SSO: '
                      || upper(q.app)
             else 'SORRY NO MATCHING ENTRY FOR: ' || upper(entry.cn) || ' IN THE SSO-'
                  || upper(q.app) end as message
    from access_requests q
    left join firsts on account_key = lower(user_id)
    left join members m on m.app = lower(q.app) and member = 'CN=' || entry.cn""",
    ["access_requests"],
)

_ASKED = "where upper(requisition_id) in (select upper(requisition_id) from urgent_requisitions)"


def _scoped(query: str) -> str:
    """A report limited to the requisitions asked for, whose keys are in lower case."""
    asked = request_cte("urgent_requisitions")
    return f"with {asked}\nselect * from ({query}) report {_ASKED}"


ORACLE_SQL = {
    "tube_summary": _TUBE_SUMMARY,
    "tubes_not_received": _TUBES_NOT_RECEIVED,
    "order_summary": _query(_ORDER_TABLES, _ORDER_ROWS, "select * from numbered"),
    "order_summary_page": _query(
        _ORDER_TABLES, _ORDER_ROWS, "select * from numbered where sl_no between 2 and 4"
    ),
    "status_history_messages": _STATUS_HISTORY_MESSAGES,
    "status_history_requested": _scoped(_STATUS_HISTORY_MESSAGES),
    "routine_test_details_requested": _scoped(_ROUTINE),
    "requisition_header_requested": _scoped(_REQUISITION_HEADER),
    "routine_test_details": _ROUTINE,
    "micro_test_details": _MICRO,
    "report_group_details": _grouped(_GROUP_ORDER),
    "status_details": _grouped(_STATUS_RANK + ", " + _GROUP_ORDER),
    "requisition_header": _REQUISITION_HEADER,
    "environment_requisition_header": _ENVIRONMENT_HEADER,
    "requisition_demographics": _DEMOGRAPHICS,
    "patient_search_name": _search("name_searches", _LIKE_START, "true", _BY_NAME),
    "patient_search_dob": _search(
        "dob_searches", "strftime(p.dob, '%m%d%Y') = q.dob", "true", _BY_NAME
    ),
    "patient_search_facility": _search(
        "facility_searches",
        "q.facility_id = 0 or q.facility_id = p.facility_fk",
        "q.facility_id > 0",
        _BY_NAME,
    ),
    "patient_search_sorted": _search(
        "contains_searches",
        _LIKE_WORDS,
        "true",
        "upper(facility_name) desc nulls first, upper(full_name) nulls last",
    ),
    "patient_details": _PATIENT_DETAILS,
    "account_lookup_unique": _UNIQUE,
    "account_lookup_first": _FIRST_ACCOUNT,
    "account_attributes": _ATTRIBUTES,
    "primary_group_sid": _PRIMARY_GROUP_SID,
    "group_by_sid": _GROUP_BY_SID,
    "primary_groups": _PRIMARY_GROUPS,
    "app_membership": _APP_MEMBERSHIP,
    "access_report": _ACCESS_REPORT,
}
