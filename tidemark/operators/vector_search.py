"""The k nearest vectors to one query vector, or to each of many.

One query is a distance column under ``ORDER BY ... LIMIT k``: Spark keeps k rows per
task and merges those, so vectors are never shuffled. Many queries are joined with the
vectors on cells around some of these.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.distances import (
    VectorError,
    check_metric,
    distance,
    nearest_first,
    norm,
    to_matrix,
)
from tidemark.functions.spaces import Space
from tidemark.operators.cells import VECTORS_AT_A_TIME, Cells, join_on_cells, nearest_centres

# Centres of a batch search: what goes to all tasks is so many vectors, however many there are.
CELLS = 256


def vector_topk(
    vectors: DataFrame,
    query: Sequence[float],
    k: int,
    metric: str = "l2",
    id_column: str = "id",
    vector_column: str = "vector",
    form: str = "arrow",
) -> DataFrame:
    """Exact top k: ``(id, distance, rank)``, nearest first, equal distances by ascending id.

    Null vectors are left out. An undefined distance is null and comes last. ``form`` says
    where distances are computed; both forms give the same bits.
    """
    _check_k(k)
    _check_names(id_column)
    key = _name(id_column)
    measured = distance(_name(vector_column), query, check_metric(metric), form)
    nearest = (
        vectors.where(_name(vector_column).isNotNull())
        .select(key, measured.alias("distance"))
        .orderBy(nearest_first(metric, F.col("distance")), key.asc())
        .limit(k)
    )
    # A window without a partition, but over the k rows that are left.
    in_order = Window.orderBy(nearest_first(metric, F.col("distance")), key.asc())
    return nearest.withColumn("rank", F.row_number().over(in_order).cast("long"))


def vector_topk_batch(
    vectors: DataFrame,
    queries: DataFrame,
    k: int,
    metric: str = "l2",
    id_column: str = "id",
    vector_column: str = "vector",
    query_id_column: str = "query_id",
    query_vector_column: str = "query_vector",
    cells: int = CELLS,
    group_bytes: int | None = None,
) -> DataFrame:
    """Exact top k for every row of ``queries``: ``(query id, id, distance, rank)``.

    Vectors are put to at most ``cells`` of their own as centres, and joined with the queries on
    the cells that these have to visit, see ``tidemark.operators.cells``. Both sides are measured
    and the cells counted first; the result is one lazy plan.
    """
    _check_k(k)
    _check_names(query_id_column, id_column)
    check_metric(metric)
    wanted = queries.select(
        _name(query_id_column).alias("query_id"),
        _numbers(queries, query_vector_column).alias("query_vector"),
    ).where("query_vector IS NOT NULL")
    scan = vectors.where(_name(vector_column).isNotNull()).select(
        _name(id_column).alias("id"), _name(vector_column).alias("vector")
    )
    names = (query_id_column, id_column)
    # Three small jobs that do not wait for each other.
    with ThreadPoolExecutor(3) as pool:
        checked = pool.submit(_check_queries, wanted)
        measured, chosen = pool.submit(_facts, scan, metric), pool.submit(_chosen, scan, cells)
        length, facts, chosen = checked.result(), measured.result(), chosen.result()
    if not length or not facts["rows"]:
        return _ranked(_no_matches(scan, wanted), k, metric, names)
    space = Space(metric, facts["longest"] or 0.0)
    # A cell of fewer vectors than are asked for bounds nothing.
    centres = _centres(chosen[: max(1, facts["rows"] // (8 * k))], space, length)
    sent = scan.sparkSession.sparkContext.broadcast(centres)
    placed = _placed(scan, sent, space, length)
    counts, radii = np.zeros(len(centres), np.int64), np.zeros(len(centres))
    farthest = F.max(F.coalesce("to_centre", F.lit(float("inf") if metric == "ip" else 0.0)))
    for row in placed.groupBy("cell").agg(F.count("*").alias("n"), farthest.alias("radius")).collect():
        counts[row["cell"]], radii[row["cell"]] = row["n"], row["radius"]
    known = Cells(space, centres, counts, radii, length)
    found = join_on_cells(placed.drop("to_centre"), wanted, k, metric, known, group_bytes)
    return _ranked(found, k, metric, names)


def nearest_in_cells(
    vectors: DataFrame,
    queries: DataFrame,
    k: int,
    metric: str,
    id_column: str,
    vector_column: str,
    cell_column: str,
    space: Space,
    centres: np.ndarray,
    counts: np.ndarray,
    radii: np.ndarray,
    group_bytes: int | None = None,
) -> DataFrame:
    """As ``vector_topk_batch``, for vectors that lie in cells already."""
    _check_k(k)
    _check_names("query_id", id_column)
    wanted = queries.select(
        "query_id", _numbers(queries, "query_vector").alias("query_vector")
    ).where("query_vector IS NOT NULL")
    length = _check_queries(wanted)
    scan = vectors.select(
        _name(id_column).alias("id"), _name(vector_column).alias("vector"), _name(cell_column).alias("cell")
    )
    names = ("query_id", id_column)
    if not length or not counts.sum():
        return _ranked(_no_matches(scan, wanted), k, metric, names)
    known = Cells(space, centres, counts, radii, length)
    return _ranked(join_on_cells(scan, wanted, k, metric, known, group_bytes), k, metric, names)


def best_of(found: DataFrame, k: int, metric: str, id_column: str) -> DataFrame:
    """The k nearest per query of several results of batch searches."""
    rows = found.select("query_id", _name(id_column).alias("id"), "distance")
    return _ranked(rows, k, metric, ("query_id", id_column))


def _check_queries(wanted: DataFrame) -> int | None:
    """The length of the query vectors; None without queries."""
    wild = F.exists("query_vector", lambda x: F.isnan(x) | (F.abs(x) == float("inf")) | x.isNull())
    facts = wanted.agg(
        F.count(F.lit(1)).alias("count"),
        F.count_distinct("query_id").alias("ids"),
        F.min(F.size("query_vector")).alias("shortest"),
        F.max(F.size("query_vector")).alias("longest"),
        F.bool_or(wild).alias("wild"),
    ).first()
    if facts["count"] != facts["ids"]:
        raise VectorError("query ids must be present and unique")
    if facts["shortest"] != facts["longest"]:
        raise VectorError("query vectors differ in length")
    if facts["longest"] == 0 or facts["wild"]:
        raise VectorError("a query vector needs at least one number, all of them finite")
    return facts["longest"]


def _facts(scan: DataFrame, metric: str):
    """How many vectors there are and, for products, how long the longest finite one is."""
    size = norm(F.col("vector")) if metric == "ip" else F.lit(0.0)
    return scan.agg(
        F.count(F.lit(1)).alias("rows"), F.max(F.when(size < float("inf"), size)).alias("longest")
    ).first()


def _chosen(scan: DataFrame, cells: int) -> list:
    """So many of the vectors, by hash."""
    rows = scan.select("vector", F.xxhash64("vector").alias("hash")).orderBy("hash").limit(cells)
    return [row["vector"] for row in rows.collect()]


def _centres(chosen: list, space: Space, length: int) -> np.ndarray:
    """Vectors that have a place in the space as its points, each once; never none."""
    rows = [vector for vector in chosen if len(vector) == length and None not in vector]
    points = space.points(np.array(rows, float).reshape(len(rows), length))
    points = np.unique(points[np.isfinite(points).all(axis=1)], axis=0)
    return points if len(points) else np.zeros((1, points.shape[1]))


def _placed(scan: DataFrame, sent, space: Space, length: int) -> DataFrame:
    """Vectors with their cell and, null where they have no place, the distance to its centre."""
    added = [T.StructField("cell", T.IntegerType()), T.StructField("to_centre", T.DoubleType())]
    schema = T.StructType([*scan.schema.fields, *added])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, VECTORS_AT_A_TIME):
                part = batch.slice(first, VECTORS_AT_A_TIME)
                points = space.points(to_matrix(part.column(1), length))
                cell, distance = nearest_centres(points, sent.value)
                columns = [pa.array(cell.astype(np.int32)), pa.array(distance, from_pandas=True)]
                yield pa.record_batch([*part.columns, *columns], names=schema.names)

    return scan.mapInArrow(place, schema)


def _check_k(k: int) -> None:
    if isinstance(k, bool) or not isinstance(k, int) or k <= 0:
        raise VectorError(f"k must be a positive whole number, not {k!r}")


def _check_names(*columns: str) -> None:
    names = [name.lower() for name in (*columns, "distance", "rank")]
    if len(set(names)) != len(names):
        raise VectorError(f"columns of the result would share a name: {names}")


def _name(column: str):
    return F.col(f"`{column}`")


def _numbers(rows: DataFrame, column: str):
    """Vectors of floats as they are, half as large to shuffle, others as doubles."""
    kind = rows.select(_name(column)).schema[0].dataType
    floats = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    return _name(column) if floats else _name(column).cast("array<double>")


def _match_schema(scan: DataFrame, wanted: DataFrame) -> T.StructType:
    return T.StructType(
        [
            T.StructField("query_id", wanted.schema["query_id"].dataType),
            T.StructField("id", scan.schema["id"].dataType),
            T.StructField("distance", T.DoubleType()),
        ]
    )


def _no_matches(scan: DataFrame, wanted: DataFrame) -> DataFrame:
    return scan.sparkSession.createDataFrame([], _match_schema(scan, wanted))


def _ranked(found: DataFrame, k: int, metric: str, names: tuple[str, str]) -> DataFrame:
    in_order = Window.partitionBy("query_id").orderBy(
        nearest_first(metric, F.col("distance")), F.col("id").asc()
    )
    ranked = found.withColumn("rank", F.row_number().over(in_order)).where(F.col("rank") <= k)
    return ranked.select(
        F.col("query_id").alias(names[0]),
        F.col("id").alias(names[1]),
        "distance",
        F.col("rank").cast("long").alias("rank"),
    )
