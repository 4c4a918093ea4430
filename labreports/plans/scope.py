"""Restricting a report to some requisitions, patients or users.

A report for one requisition must not shuffle the warehouse. When the caller
names few keys they become an IN list, which reaches the parquet scan and skips
row groups there. More keys than that stay a DataFrame, and every large table is
narrowed by a semi join with them.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Up to this many keys are written into the plan; beyond it they are joined.
FEW = 1000
#: With more requisitions than this their details don't fit a broadcast of common size.
MANY = 1 << 18


def few_rows(rows: DataFrame, limit: int = FEW) -> list | None:
    """The rows if there are at most ``limit`` of them, else None."""
    found = rows.limit(limit + 1).collect()
    return found if len(found) <= limit else None


def _more_than(rows: DataFrame, limit: int) -> bool:
    return rows.limit(limit + 1).count() > limit


def is_one_of(column: Column, values) -> Column:
    return column.isin(sorted({value for value in values if value is not None}))


def narrow(rows: DataFrame, column: Column, keys: DataFrame) -> DataFrame:
    """Drop rows that cannot join any of ``keys``: by an IN list if the keys are few, else by a join."""
    few = few_rows(keys)
    if few is not None:
        return rows.filter(is_one_of(column, [row[0] for row in few]))
    wanted = keys.select(F.col(keys.columns[0]).alias("_wanted")).distinct()
    return rows.join(wanted, column == F.col("_wanted"), "left_semi")


class Scope:
    """The keys a report is limited to: the first column of ``keys``, or no limit if None."""

    def __init__(self, keys: DataFrame | None, upper: bool = False):
        if keys is not None:
            key = F.col(keys.columns[0])
            keys = keys.select((F.upper(key) if upper else key).alias("_key")).distinct()
        self._keys = keys
        few = None if keys is None else few_rows(keys)
        self._few = None if few is None else [row[0] for row in few]

    @cached_property
    def many(self) -> bool:
        """Whether there are more keys than ``MANY``; counted when first asked for."""
        return self._keys is not None and self._few is None and _more_than(self._keys, MANY)

    def keep(self, rows: DataFrame, column: str) -> DataFrame:
        """Rows with one of the keys; without a scope, all rows that have a key."""
        if self._keys is None:
            return rows.filter(F.col(column).isNotNull())
        if self._few is not None:
            return rows.filter(is_one_of(F.col(column), self._few))
        return rows.join(self._keys.withColumnRenamed("_key", column), column, "left_semi")

    def related(self, kept: DataFrame, columns: list[str], limited: bool = False) -> Related:
        """Key values of the rows kept. ``limited`` says that ``kept`` is a part of its table even
        where the scope names no keys."""
        if self._keys is None and not limited:
            return Related(None, None)
        keys = kept.select(*columns)
        return Related(keys, few_rows(keys) if self._few is not None else None, self)


class Related:
    """Narrows the tables that are joined to a report's scope, at any number of keys.

    Only rows that the join itself would drop are removed: by an IN list that reaches the scan while
    the keys are few, and by a semi join otherwise. Without a scope nothing is done.
    """

    def __init__(self, keys: DataFrame | None, few: list | None, scope: Scope | None = None):
        self._keys = keys
        self._few = few
        self._scope = scope

    def narrow(self, rows: DataFrame, column: str, key: str, at_once: bool = False) -> DataFrame:
        """``at_once`` says that the join shuffles these very rows by ``column``. Very many keys are then
        left to that join, because a semi join ahead of it would shuffle as many rows, and the keys too."""
        if self._keys is None:
            return rows
        if self._few is not None:
            return rows.filter(is_one_of(F.col(column), [row[key] for row in self._few]))
        if at_once and self._scope is not None and self._scope.many:
            return rows
        wanted = self._keys.select(F.col(key).alias(column)).distinct()
        return rows.join(wanted, column, "left_semi")


def requisition_scope(requisitions: DataFrame | None) -> Scope:
    """Requisition keys are matched in upper case."""
    return Scope(None if requisitions is None else requisitions.select("requisition_id"), upper=True)
