"""Sort keys that put nulls where the warehouse puts them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SortKey:
    """One sort column: ascending has nulls last, descending has nulls first."""

    column: str
    descending: bool = False

    def ordering(self) -> Column:
        column = F.col(self.column)
        return column.desc_nulls_first() if self.descending else column.asc_nulls_last()


def ascending(*columns: str) -> list[SortKey]:
    return [SortKey(column) for column in columns]


def orderings(keys: list[SortKey]) -> list[Column]:
    return [key.ordering() for key in keys]
