"""Column statistics of a table: rows, nulls, min, max, distinct values, mean vector length.

``record_statistics`` keeps them for each snapshot by itself, with sketches of the distinct values
and quantiles, so that ``merged_statistics`` of a state reads no rows and an append only its own.
``frequent_values`` gives the values that occur most, counted exactly.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.distances import norm
from tidemark.session import run_folder
from tidemark.sources.lakehouse import SNAPSHOT, Lakehouse, TableState

FACTS = ("row_count", "null_count", "min_value", "max_value", "distinct_count", "mean_norm")


def column_statistics(rows: DataFrame, exact_distinct: bool = False) -> DataFrame:
    """One row per column: ``column_name`` and the facts above.

    Distinct counts are approximate unless asked for exactly. Approximate ones take one
    pass in which sketches of fixed size are merged. Exact ones group each column by itself,
    with repeats already merged before the shuffle; a Parquet scan then still reads every
    column just once, but a costly query behind ``rows`` would be run once per column.

    Min and max are given as text; they and the distinct count are null for nested columns.
    """
    if exact_distinct:
        return reduce(DataFrame.union, [_exact(rows, field) for field in rows.schema.fields])
    facts = [F.count(F.lit(1)).alias("row_count")]
    for number, field in enumerate(rows.schema.fields):
        facts += [fact.alias(f"{name}_{number}") for name, fact in _approximate(field).items()]
    lines = []
    for number, field in enumerate(rows.schema.fields):
        nulls = (F.col("row_count") - F.col(f"present_{number}")).alias("null_count")
        others = [F.col(f"{name}_{number}").alias(name) for name in FACTS[2:]]
        name = F.lit(field.name).alias("column_name")
        lines.append(F.struct(name, F.col("row_count"), nulls, *others))
    return rows.agg(*facts).select(F.inline(F.array(*lines)))


def _approximate(field: T.StructField) -> dict[str, Column]:
    column = F.col(f"`{field.name}`")
    none = F.lit(None)
    ordered = isinstance(field.dataType, T.AtomicType)
    return {
        "present": F.count(column),
        "min_value": (F.min(column) if ordered else none).cast("string"),
        "max_value": (F.max(column) if ordered else none).cast("string"),
        "distinct_count": (F.approx_count_distinct(column) if ordered else none).cast("long"),
        "mean_norm": _mean_norm(field),
    }


def _exact(rows: DataFrame, field: T.StructField) -> DataFrame:
    column = F.col(f"`{field.name}`")
    name = F.lit(field.name).alias("column_name")
    if not isinstance(field.dataType, T.AtomicType):
        facts = {name: fact.alias(name) for name, fact in _approximate(field).items()}
        whole = rows.agg(F.count(F.lit(1)).alias("row_count"), *facts.values())
        nulls = (F.col("row_count") - F.col("present")).alias("null_count")
        return whole.select(name, "row_count", nulls, *FACTS[2:])
    values = rows.groupBy(column.alias("value")).agg(F.count(F.lit(1)).alias("repeats"))
    absent = F.sum(F.when(F.col("value").isNull(), F.col("repeats")))
    return values.agg(
        F.coalesce(F.sum("repeats"), F.lit(0)).alias("row_count"),
        F.coalesce(absent, F.lit(0)).alias("null_count"),
        F.min("value").cast("string").alias("min_value"),
        F.max("value").cast("string").alias("max_value"),
        F.count("value").alias("distinct_count"),
    ).select(name, *FACTS[:5], F.lit(None).cast("double").alias("mean_norm"))


def _mean_norm(field: T.StructField) -> Column:
    if isinstance(field.dataType, T.ArrayType) and isinstance(
        field.dataType.elementType, T.NumericType
    ):
        return F.avg(norm(F.col(f"`{field.name}`")))
    return F.lit(None).cast("double")


# -- statistics that merge over snapshots ----------------------------------------------

# Shares of a numeric column's values whose quantiles are told.
QUANTILES = (0.25, 0.5, 0.75)
RECORDED = (
    "column_name string, row_count long, null_count long, min_value string, max_value string, "
    "distinct_sketch binary, quantile_sketch binary"
)


def record_statistics(
    lake: Lakehouse, namespace: str, table_name: str, metadata_location: str | None = None
) -> int:
    """Writes the statistics of every snapshot of a state that has none yet; tells of how many.

    Each is one pass over the rows of that snapshot alone, and one small file.
    """
    state = lake.state(namespace, table_name, metadata_location)
    missing = [n for n in range(state.snapshot_seq + 1) if not _is_recorded(lake, state, n)]
    for number in missing:
        rows = lake.scan_files(state, after=number - 1).where(F.col(SNAPSHOT) == number)
        _sketched(rows, state.schema).coalesce(1).write.mode("overwrite").parquet(
            _statistics_path(state, number)
        )
    return len(missing)


def merged_statistics(
    lake: Lakehouse, namespace: str, table_name: str, metadata_location: str | None = None
) -> DataFrame:
    """One row per column of a state, from what was recorded for its snapshots: row_count,
    null_count, min_value, max_value, distinct_count (approximate), quantiles (of numbers)."""
    state = lake.state(namespace, table_name, metadata_location)
    missing = [n for n in range(state.snapshot_seq + 1) if not _is_recorded(lake, state, n)]
    if missing:
        raise LookupError(f"no statistics recorded for snapshots {missing} of {namespace}.{table_name}")
    paths = [_statistics_path(state, n) for n in range(state.snapshot_seq + 1)]
    stored = lake.spark.read.schema(RECORDED).parquet(*paths)
    merged = [_merged(stored, field) for field in state.schema.fields]
    return reduce(DataFrame.union, merged)


def _statistics_path(state: TableState, number: int) -> str:
    return f"{state.table_path}-statistics/{number}"


def _is_recorded(lake: Lakehouse, state: TableState, number: int) -> bool:
    path = lake.spark._jvm.org.apache.hadoop.fs.Path(f"{_statistics_path(state, number)}/_SUCCESS")
    return path.getFileSystem(lake.spark._jsc.hadoopConfiguration()).exists(path)


def _sketched(rows: DataFrame, schema: T.StructType) -> DataFrame:
    facts = [F.count(F.lit(1)).alias("row_count")]
    for number, field in enumerate(schema.fields):
        column = F.col(f"`{field.name}`")
        is_atomic = isinstance(field.dataType, T.AtomicType)
        text, none = column.cast("string"), F.lit(None)
        is_number = isinstance(field.dataType, T.NumericType)
        parts = {
            "null_count": F.count_if(column.isNull()),
            "min_value": (F.min(column) if is_atomic else none).cast("string"),
            "max_value": (F.max(column) if is_atomic else none).cast("string"),
            "distinct_sketch": F.hll_sketch_agg(text) if is_atomic else none.cast("binary"),
            "quantile_sketch": F.kll_sketch_agg_double(column.cast("double")) if is_number else none.cast("binary"),
        }
        facts += [part.alias(f"{name}_{number}") for name, part in parts.items()]
    names = ("null_count", "min_value", "max_value", "distinct_sketch", "quantile_sketch")
    lines = [
        F.struct(
            F.lit(field.name).alias("column_name"),
            F.col("row_count"),
            *[F.col(f"{name}_{number}").alias(name) for name in names],
        )
        for number, field in enumerate(schema.fields)
    ]
    return rows.agg(*facts).select(F.inline(F.array(*lines)))


def _merged(stored: DataFrame, field: T.StructField) -> DataFrame:
    """The stored rows of one column as one; least and greatest go by the column's own type."""
    own = stored.where(F.col("column_name") == field.name)
    kind = field.dataType if isinstance(field.dataType, T.AtomicType) else T.StringType()
    sketch = F.hll_union_agg("distinct_sketch")
    if isinstance(field.dataType, T.NumericType):
        full = F.col("row_count") > F.col("null_count")
        merged = F.kll_merge_agg_double(F.when(full, F.col("quantile_sketch")))
        shares = F.array(*map(F.lit, QUANTILES))
        quantiles = F.kll_sketch_get_quantile_double(merged, shares)
        some = F.sum(full.cast("int")) > 0
        quantiles = F.when(some, quantiles)
    else:
        quantiles = F.lit(None).cast("array<double>")
    return own.agg(
        F.sum("row_count").alias("row_count"),
        F.sum("null_count").alias("null_count"),
        F.min(F.col("min_value").cast(kind)).cast("string").alias("min_value"),
        F.max(F.col("max_value").cast(kind)).cast("string").alias("max_value"),
        F.hll_sketch_estimate(sketch).alias("distinct_count"),
        quantiles.alias("quantiles"),
    ).select(F.lit(field.name).alias("column_name"), "*")


# -- frequent values -------------------------------------------------------------------

# Values of a column that a task keeps counters of.
COUNTERS = 10_000


def frequent_values(
    rows: DataFrame, columns: Sequence[str], k: int, counters: int = COUNTERS
) -> DataFrame:
    """The k values that occur most in each column: (column_name, value, repeats, rank).

    Values are told as text, nulls left out; of those that occur as often the lower text comes
    first. In a first pass each task keeps at most twice ``counters`` counters a column; what it
    lets go of bounds how far a sum of counters is too low. Only values that this leaves in
    question are counted exactly in a second pass. A column where nearly all of them are (none
    occurs often) is counted whole instead.
    """
    if k <= 0 or counters < k:
        raise ValueError("k must be positive, and counters at least as many")
    texts = rows.select(*[F.col(f"`{name}`").cast("string").alias(f"c{n}") for n, name in enumerate(columns)])
    schema = "number int, value string, repeats long, lost long"
    folder = run_folder(rows.sparkSession, "counters")
    texts.mapInArrow(_counted(len(columns), counters), schema).write.parquet(folder)
    kept = rows.sparkSession.read.schema(schema).parquet(folder)
    sums = kept.groupBy("number", "value").agg(F.sum("repeats").alias("repeats"), F.sum("lost").alias("lost"))
    lost = {row["number"]: row["lost"] for row in sums.where("value IS NULL").collect()}
    found = []
    for number, name in enumerate(columns):
        own = sums.where((F.col("number") == number) & F.col("value").isNotNull())
        top = own.orderBy(F.desc("repeats")).limit(k).agg(F.min("repeats").alias("kth"), F.count("*").alias("n")).first()
        value = F.col(f"c{number}")
        there = texts.where(value.isNotNull()).select(value.alias("value"))
        unsure = lost.get(number, 0)
        if unsure and (top["n"] < k or top["kth"] <= 2 * unsure):
            counted = there
        elif unsure:
            # Each occurs more often than half as often as the kth, so they are few.
            wanted = own.where(F.col("repeats") >= top["kth"] - unsure).select("value")
            counted = there.join(F.broadcast(wanted), "value", "left_semi")
        else:
            counted = None
        exact = own.select("value", "repeats") if counted is None else counted.groupBy("value").agg(
            F.count("*").alias("repeats")
        )
        best = exact.orderBy(F.desc("repeats"), "value").limit(k)
        found.append(best.select(F.lit(name).alias("column_name"), "value", "repeats"))
    whole = reduce(DataFrame.union, found)
    place = F.struct((-F.col("repeats")).alias("r"), "value")
    ranked = whole.groupBy("column_name").agg(F.array_sort(F.collect_list(place)).alias("best"))
    listed = ranked.select("column_name", F.posexplode("best").alias("at", "one"))
    return listed.select(
        "column_name",
        F.col("one.value").alias("value"),
        (-F.col("one.r")).alias("repeats"),
        (F.col("at") + 1).cast("long").alias("rank"),
    )


def _counted(columns: int, counters: int):
    """A task's counters of each column, and, under a null value, what it let go of."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, int]] = [{} for _ in range(columns)]
        lost = [0] * columns
        for batch in batches:
            for number in range(columns):
                own = held[number]
                for one in pc.value_counts(batch.column(number).drop_null()).to_pylist():
                    own[one["values"]] = own.get(one["values"], 0) + one["counts"]
                if len(own) > 2 * counters:
                    least = sorted(own.values(), reverse=True)[counters]
                    held[number] = {value: n - least for value, n in own.items() if n > least}
                    lost[number] += least
        for number, own in enumerate(held):
            values, counts = [*own, None], [*own.values(), 0]
            columns_ = [
                pa.array([number] * len(values), pa.int32()),
                pa.array(values, pa.string()),
                pa.array(counts, pa.int64()),
                pa.array([0] * len(own) + [lost[number]], pa.int64()),
            ]
            yield pa.record_batch(columns_, names=["number", "value", "repeats", "lost"])

    return count
