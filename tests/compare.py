"""Runs registered queries beside their SQL in DuckDB and tells where they differ."""

from __future__ import annotations

import math
from datetime import date, datetime

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.plans.workspace import TABLES

# Arrow types that count as the same in both engines.
_SAME_TYPE = {"large_string": "string", "timestamp[us, tz=UTC]": "timestamp[us]"}


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def difference(found: DataFrame, connection: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """What differs between a Spark result and a SQL result; None if nothing does."""
    spark_side = found.toArrow()
    duck_side = connection.sql(sql).to_arrow_table()
    types, wanted = _types(spark_side), _types(duck_side)
    if types != wanted:
        return f"schema: {types} against {wanted}"
    if spark_side.num_rows != duck_side.num_rows:
        return f"rows: {spark_side.num_rows} against {duck_side.num_rows}"
    ours, theirs = _rows(spark_side), _rows(duck_side)
    for left, right in zip(ours, theirs):
        if left != right:
            return f"values: {left} against {right}"
    return None


def _types(table: pa.Table) -> dict[str, str]:
    return {
        field.name: _SAME_TYPE.get(str(field.type), str(field.type))
        for field in sorted(table.schema, key=lambda field: field.name)
    }


def _rows(table: pa.Table) -> list[tuple]:
    names = sorted(table.schema.names)
    columns = [[_plain(value) for value in table.column(name).to_pylist()] for name in names]
    return sorted(zip(*columns), key=repr)


def _plain(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else value
    if isinstance(value, (date, datetime)):
        return value.isoformat()
    return value
