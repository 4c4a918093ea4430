"""Searches, account names and access requests derived from the test tables.

Like the fixture tables these queries run unchanged on Spark and DuckDB.
"""

from __future__ import annotations

from labreports.sources.fixtures import SOURCES

_DOB = "cast('1940-01-01' as date) + cast(c_custkey % 20000 as int)"

REQUEST_SQL = {
    "urgent_requisitions": """
        select lower(concat('R', cast(o_orderkey as string))) as requisition_id
        from {orders} where o_orderpriority = '1-URGENT'""",
    "name_searches": """
        select distinct c_mktsegment as search_id, lower(substr(c_mktsegment, 1, 5)) as name,
            cast(0 as bigint) as facility_id, '' as dob
        from {customer}""",
    "contains_searches": """
        select distinct c_mktsegment as search_id,
            concat(' ', lower(substr(c_mktsegment, 3, 4)), '   Customer') as name,
            cast(0 as bigint) as facility_id, cast(null as string) as dob
        from {customer}""",
    "facility_searches": """
        select n_name as search_id, '' as name, cast(n_nationkey as bigint) as facility_id,
            '' as dob
        from {nation}""",
    "dob_searches": f"""
        select distinct concat('born ', cast(born as string)) as search_id, '' as name,
            cast(0 as bigint) as facility_id,
            concat(lpad(cast(month(born) as string), 2, '0'),
                   lpad(cast(day(born) as string), 2, '0'), cast(year(born) as string)) as dob
        from (select {_DOB} as born from {{customer}}) b""",
    "account_names": """
        select distinct case when c_custkey % 50 = 0 then concat('Nobody', cast(c_custkey as string))
                             else concat('USER', cast(c_custkey % 1000 as string)) end as user_id
        from {customer}""",
    "group_sids": """
        select concat('S-1-5-21-2127521184-1604012920-1887927527-',
                      cast(1000 + n_nationkey as string)) as sid
        from {nation}""",
    "member_requests": """
        select c_name as cn,
            concat(case when rep = 0 then 'APP' else 'app' end,
                   cast((c_custkey + rep) % 4 as string)) as app
        from {customer} join (select 0 as rep union all select 1 as rep) reps on rep < 2""",
    "access_requests": """
        select case when c_custkey % 75 = 0 then null
                    when c_custkey % 50 = 0 then concat('Nobody', cast(c_custkey as string))
                    else concat('USER', cast(c_custkey % 1000 as string)) end as user_id,
            concat('APP', cast(c_custkey % 4 as string)) as app
        from {customer}""",
}


def request_cte(name: str) -> str:
    return f"{name} as ({REQUEST_SQL[name].format(**{s: s for s in SOURCES})})"
