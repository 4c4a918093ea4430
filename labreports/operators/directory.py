"""Directory accounts, their groups, and who may use an application.

The directory is a snapshot: ``dir_user`` and ``dir_group`` have one row per
entry, ``dir_attribute_value`` one per value of a group's attributes. Names are
matched without regard to case, as a directory does: in lower case, which is
computed per row unless the snapshot was stored with its keys
(``directory_with_keys``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labreports.functions.sid import in_same_domain, sid_text
from labreports.plans.scope import narrow
from labreports.sources.warehouse import Tables

_ACCOUNT_COLUMNS = [
    "cn",
    "name",
    "mail",
    "sam_account_name",
    "distinguished_name",
    "telephone_number",
]
# Attributes that list members, and the wording of the answers.
_MEMBER_ATTRIBUTES = ["name", "member"]
_INVALID = "Sorry your User-id (network-id) is invalid..."


def _only_or_first(mode: str, entry: str) -> Column:
    if mode not in ("unique", "first"):
        raise ValueError(f"mode is 'unique' or 'first', not {mode!r}")
    return F.col(entry) if mode == "first" else F.when(F.col("matches") == 1, F.col(entry))


#: Key columns of a stored snapshot, by table: what lookups compare by.
_KEYS = {
    "dir_user": ("account_key", F.lower, "sam_account_name"),
    "dir_group": ("sid", sid_text, "object_sid"),
    "dir_attribute_value": ("app_key", F.lower, "group_cn"),
}


def _key(entries: DataFrame, table: str) -> Column:
    name, rule, source = _KEYS[table]
    return F.col(name) if name in entries.columns else rule(F.col(source))


def directory_with_keys(t: Tables) -> dict[str, DataFrame]:
    """The directory tables with their keys as columns, in the order of the keys, for storing.

    A lookup in stored tables of this form (``parquet_tables(..., directory_keys=True)``) compares
    plain columns, so the filter reaches the scan and skips row groups.
    """
    return {
        table: t[table]
        .withColumn(name, rule(F.col(source)))
        .repartitionByRange(name)
        .sortWithinPartitions(name)
        for table, (name, rule, source) in _KEYS.items()
    }


def _entries(users: DataFrame, columns: list[str], mode: str, *more: Column) -> DataFrame:
    """Account name in lower case with its entry; in ``first`` mode the lowest distinguished name.

    Aggregating, not ranking, keeps a name that very many entries share out of
    any single task.
    """
    entry = F.struct("distinguished_name", *[c for c in columns if c != "distinguished_name"])
    return (
        users.filter(F.col("object_class") == "user")
        .groupBy(_key(users, "dir_user").alias("account_key"))
        .agg(F.count("*").alias("matches"), F.min(entry).alias("entry"), *more)
        .withColumn("entry", _only_or_first(mode, "entry"))
    )


def _lookup(users: DataFrame, names: DataFrame, columns: list[str], mode: str) -> DataFrame:
    names = names.select("user_id", F.lower("user_id").alias("account_key")).distinct()
    users = narrow(users, _key(users, "dir_user"), names.select("account_key"))
    entries = _entries(users, columns, mode)
    return names.join(entries, "account_key", "left").select(
        "user_id", *[F.col(f"entry.{c}").alias(c) for c in columns]
    )


def account_lookup(users: DataFrame, names: DataFrame, mode: str = "unique") -> DataFrame:
    """Account of each ``user_id`` in ``names``; null if none, or if several in ``unique`` mode."""
    return _lookup(users, names, _ACCOUNT_COLUMNS, mode)


def account_attributes(
    users: DataFrame, names: DataFrame, columns: list[str], mode: str = "first"
) -> DataFrame:
    """The chosen attributes of each ``user_id``; only those are read."""
    return _lookup(users, names, columns, mode)


def with_primary_group_sid(users: DataFrame) -> DataFrame:
    """Add the SID of the primary group: the user's own, ending in the group's number."""
    own = sid_text(F.col("object_sid"))
    return users.withColumn("primary_group_sid", in_same_domain(own, F.col("primary_group_id")))


def _named_groups(groups: DataFrame) -> DataFrame:
    """Account name of the group with each ``sid``, where exactly one has it."""
    return (
        groups.filter(F.col("object_class") == "group")
        .groupBy(_key(groups, "dir_group").alias("sid"))
        .agg(F.count("*").alias("matches"), F.min("sam_account_name").alias("group_name"))
        .filter(F.col("matches") == 1)
        .drop("matches")
    )


def group_by_sid(groups: DataFrame, sids: DataFrame) -> DataFrame:
    """Account name of the group with each ``sid``; null unless exactly one has it.

    Only groups that are asked for are aggregated.
    """
    asked = sids.select("sid").distinct()
    named = _named_groups(narrow(groups, _key(groups, "dir_group"), asked))
    return asked.join(named, "sid", "left")


def _all_accounts(users: DataFrame, columns: list[str]) -> DataFrame:
    """Every account name as it is written, with its entry; null if several entries have it."""
    spellings = F.collect_set("sam_account_name").alias("spellings")
    entries = _entries(users, columns, "unique", spellings)
    entry = F.when(F.col("account_key").isNotNull(), F.col("entry"))
    return entries.select(F.explode_outer("spellings").alias("user_id"), entry.alias("entry")).select(
        "user_id", *[F.col(f"entry.{c}").alias(c) for c in columns]
    )


def primary_groups(
    users: DataFrame, groups: DataFrame, names: DataFrame | None = None
) -> DataFrame:
    """Primary group of each account name that belongs to exactly one user.

    For all accounts, users and groups are read once each; some names narrow both.
    """
    columns = ["cn", "object_sid", "primary_group_id"]
    if names is None:
        accounts = with_primary_group_sid(_all_accounts(users, columns))
        named = _named_groups(groups)
    else:
        accounts = with_primary_group_sid(_lookup(users, names, columns, "unique"))
        named = group_by_sid(groups, accounts.select(F.col("primary_group_sid").alias("sid")))
    return (
        accounts.withColumnRenamed("primary_group_sid", "sid")
        .join(named, "sid", "left")
        .select("user_id", "cn", F.col("sid").alias("primary_group_sid"), "group_name")
    )


def _with_membership(
    asked: DataFrame, attribute_values: DataFrame, apps: DataFrame, names: DataFrame | None = None
) -> DataFrame:
    """Add ``is_member`` to rows of ``cn`` and ``app``.

    Values of the applications in ``apps`` only, and of the members in ``names`` if they are known
    beforehand, are read, before anything is shuffled.
    """
    member = F.split_part("value", F.lit(","), F.lit(1))
    named = F.concat(F.lit("CN="), "cn")
    values = attribute_values.filter(F.col("attribute_id").isin(_MEMBER_ATTRIBUTES))
    key = _key(values, "dir_attribute_value")
    values = narrow(values, key, apps.select(F.lower("app").alias("app_key")).distinct())
    if names is not None:
        values = narrow(values, member, names.select(named.alias("member")).distinct())
    members = values.select(
        key.alias("app_key"), member.alias("member"), F.lit(1).alias("found")
    ).distinct()
    return (
        asked.withColumns({"member": named, "app_key": F.lower("app")})
        .join(members, ["app_key", "member"], "left")
        .withColumn("is_member", F.coalesce("found", F.lit(0)))
        .drop("app_key", "member", "found")
    )


def app_membership(requests: DataFrame, attribute_values: DataFrame) -> DataFrame:
    """Whether each requested ``cn`` is a member of the application ``app``: 1 or 0.

    The application is looked up without regard to case, as a distinguished name is; the member's
    name must match exactly.
    """
    wanted = requests.select("cn", "app").distinct()
    return _with_membership(wanted, attribute_values, wanted, wanted)


def access_report(
    users: DataFrame, attribute_values: DataFrame, requests: DataFrame
) -> DataFrame:
    """Answer to each request of a ``user_id`` for an ``app``; a missing id is an invalid one."""
    accounts = _lookup(users, requests, ["cn"], "first")
    wanted = requests.select("user_id", "app").distinct()
    asked = wanted.join(accounts, "user_id", "left")
    found = F.concat(F.lit("Matching entry found for: "), "cn", F.lit(" in the SSO: "), "app")
    missing = F.concat(F.lit("Sorry no matching entry for: "), "cn", F.lit(" in the SSO-"), "app")
    return _with_membership(asked, attribute_values, wanted).select(
        "user_id",
        "app",
        "cn",
        F.when(F.col("cn").isNull(), _INVALID)
        .when(F.col("is_member") == 1, F.upper(found))
        .otherwise(F.upper(missing))
        .alias("message"),
    )
