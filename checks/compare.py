"""Run each query on Spark and its SQL on DuckDB and compare the rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pyarrow as pa


def duckdb_rows(sql: str, sf_dir: str) -> pa.Table:
    with duckdb.connect() as con:
        for path in sorted(Path(sf_dir).glob("*.parquet")):
            con.execute(f"create view {path.stem} as select * from read_parquet('{path}')")
        return con.sql(sql).to_arrow_table()


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


def sorted_rows(table: pa.Table) -> list[tuple]:
    names = sorted(table.column_names)
    rows = [tuple(_plain(row[name]) for name in names) for row in table.to_pylist()]
    return sorted(rows, key=lambda row: tuple((v is None, str(v)) for v in row))


def difference(spark_table: pa.Table, sql_table: pa.Table) -> str | None:
    """What differs between the two results, or None."""
    left, right = sorted(spark_table.column_names), sorted(sql_table.column_names)
    if left != right:
        return f"columns {left} and {right}"
    if spark_table.num_rows != sql_table.num_rows:
        return f"{spark_table.num_rows} and {sql_table.num_rows} rows"
    for a, b in zip(sorted_rows(spark_table), sorted_rows(sql_table)):
        if a != b:
            return f"first differing row {a} and {b} in {left}"
    return None
