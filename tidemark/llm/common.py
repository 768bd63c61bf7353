"""What the operators share: working tables, task counts and Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import run_folder

# Bytes that one task takes on where an operator fixes the number of tasks itself.
TASK_BYTES = 32 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fresh(rows: DataFrame, name: str) -> str:
    """A column name that ``rows`` does not have yet, whatever the case of its letters."""
    taken = {column.lower() for column in rows.columns}
    while name.lower() in taken:
        name += "_"
    return name


def materialise(rows: DataFrame, label: str) -> DataFrame:
    """``rows`` written as a table in the shared folder and read back: lineage ends here."""
    folder = run_folder(rows.sparkSession, label)
    rows.write.option("compression", "zstd").parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


def tasks_for(size: int | None, task_size: int = TASK_BYTES) -> int:
    """How many tasks share work of a measured size; grows with it without a ceiling."""
    return max(1, -(-int(size or 0) // task_size))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def text_of(column: str | Column = "text") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def rows_of(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """The rows of Arrow batches as tuples, one batch in memory at a time."""
    for batch in batches:
        yield from zip(*(batch.column(name).to_pylist() for name in names))


def batches_of(
    rows: Iterator[tuple], schema: pa.Schema, size: int = 4096, weight: Callable | None = None
) -> Iterator[pa.RecordBatch]:
    """Tuples as Arrow batches of at most ``size`` rows, or of about 16 MB by ``weight``."""
    held, bytes_held = [], 0
    for row in rows:
        held.append(row)
        bytes_held += weight(row) if weight else 0
        if len(held) >= size or bytes_held >= 16 << 20:
            yield _batch(held, schema)
            held, bytes_held = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows)
    arrays = [pa.array(column, field.type) for column, field in zip(columns, schema)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)
