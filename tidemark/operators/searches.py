"""Search requests against a table as of one snapshot, through an index where one matches.

Both requests name the table, its ``metadata_location`` and an index. If a live index of
that name was built from that state or an earlier one it is used, and rows appended since
are scanned beside it; otherwise the table itself is scanned. The rows are the same either way, unless a vector search asks for fewer lists.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.distances import VectorError, check_query, distance, norm
from tidemark.functions.spaces import Space, sizes
from tidemark.functions.predicates import (
    LOOKED_UP,
    Predicate,
    PredicateError,
    parse_predicate,
)
from tidemark.operators.indexes import (
    IVF,
    LIST,
    SCALAR,
    ZONE,
    appended_since,
    index_rows,
    ivf_schema,
    matched,
)
from tidemark.operators.zones import looked_up
from tidemark.operators.vector_search import (
    best_of,
    nearest_in_cells,
    vector_topk,
    vector_topk_batch,
)
from tidemark.sources.lakehouse import Lakehouse, TableState

class IndexNotUsable(ValueError):
    """A search named an index that does not serve this table state or this request."""


def filter_rows(
    rows: DataFrame, expression_json: str, projection_columns: Sequence[str] | None = None
) -> DataFrame:
    """The rows of any DataFrame for which a JSON predicate is true."""
    predicate = parse_predicate(expression_json, rows.schema)
    return _project(rows.where(predicate.on_rows()), projection_columns)


def search_scalar(
    lake: Lakehouse,
    namespace: str,
    table_name: str,
    metadata_location: str | None,
    index_name: str | None,
    expression_json: str,
    projection_columns: Sequence[str] | None = None,
    file_io_config_json: str = "{}",
    allow_scan: bool = False,
) -> DataFrame:
    """Rows of a table state for which the predicate is true, cut down to some columns.

    Without ``index_name`` the table is scanned. A named index that does not serve the state
    is an error, unless ``allow_scan`` asks for a scan in its place.
    """
    state = lake.state(namespace, table_name, metadata_location)
    predicate = parse_predicate(expression_json, state.schema)
    index = matched(lake, state, index_name, SCALAR)
    if index is None and index_name is not None and not allow_scan:
        raise IndexNotUsable(f"no scalar index {index_name!r} of {state.metadata_location}")
    if index is None:
        rows = lake.scan_state(state, file_io_config_json)
    else:
        rows = _rows_in_zones(lake, state, index, predicate, file_io_config_json)
    return _project(rows.where(predicate.on_rows()), projection_columns)


def search_vector(
    lake: Lakehouse,
    namespace: str,
    table_name: str,
    metadata_location: str | None,
    index_name: str | None,
    query_vector: Sequence[float],
    k: int,
    distance_type: str = "l2",
    params_json: str = "{}",
    file_io_config_json: str = "{}",
) -> DataFrame:
    """The k nearest rows of a table state: ``(id, distance, rank)``.

    Through an index the result is the exact one: of the lists nearest to the query enough are
    searched first to bound how far the kth row can be, and then all lists that reach within that.
    ``params_json`` may hold ``nprobe`` (read just so many lists, the nearest ones, and further
    ones while these hold fewer than k rows: an approximate search), ``id_column`` and
    ``vector_column`` (needed without an index if the table has several), ``form``
    (``arrow`` unless said, or ``native``) and ``allow_scan`` (scan the table where the named
    index does not serve this state or distance, which is an error otherwise).
    """
    state = lake.state(namespace, table_name, metadata_location)
    params = json.loads(params_json)
    index = matched(lake, state, index_name, IVF)
    if index is not None and json.loads(index["params_json"])["metric"] == distance_type:
        id_column, vector_column = index["columns"]
        lists = _Lists(lake, state, index, file_io_config_json)
        if "nprobe" in params:
            numbers = lists.nearest(query_vector, params["nprobe"], k)
        else:
            numbers = lists.needed(query_vector, k)
        rows = lists.with_tail(lists.rows(numbers))
    elif index_name is not None and not params.get("allow_scan"):
        raise IndexNotUsable(
            f"no {distance_type} index {index_name!r} of {state.metadata_location}"
        )
    else:
        id_column, vector_column = _vector_columns(state, params)
        rows = lake.scan_state(state, file_io_config_json)
    form = params.get("form", "arrow")
    return vector_topk(rows, query_vector, k, distance_type, id_column, vector_column, form)


def _project(rows: DataFrame, columns: Sequence[str] | None) -> DataFrame:
    if columns is None:
        return rows
    unknown = [name for name in columns if name not in rows.columns]
    if unknown or not columns:
        raise PredicateError(f"projection names unknown columns {unknown}, or none at all")
    return rows.select(*[f"`{name}`" for name in columns])


def _rows_in_zones(
    lake: Lakehouse, state: TableState, index: dict, predicate: Predicate, file_io_config_json: str
) -> DataFrame:
    """Rows of the zones that may match. Zones are few by construction; their ids are a
    partition filter, so files of other zones are never opened."""
    zones = lake.spark.read.parquet(f"{index['index_path']}/zones")
    params = json.loads(index["params_json"])
    tests = predicate.lookups(params.get("lookup_columns", []))
    if tests:
        found = looked_up(
            lake.spark, index["index_path"], ZONE, tests, params["lookup_columns"], params["bits"]
        )
        zones = zones.join(found, ZONE, "left").withColumn(
            LOOKED_UP, F.coalesce(LOOKED_UP, F.array().cast("array<int>"))
        )
    possible = zones.where(predicate.on_zones(set(index["columns"]), tests)).select(ZONE).collect()
    numbers = [row[ZONE] for row in possible] if len(possible) < index["partition_count"] else None
    rows = index_rows(
        lake, index["index_path"], state.schema, ZONE, numbers, file_io_config_json
    ).drop(ZONE)
    tail = appended_since(lake, state, index, file_io_config_json)
    return rows if tail is None else rows.unionByName(tail)


class _Lists:
    """The lists of a vector index, as a search goes through them."""

    def __init__(self, lake: Lakehouse, state: TableState, index: dict, file_io_config_json: str):
        self.lake, self.index, self.file_io_config_json = lake, index, file_io_config_json
        self.schema = ivf_schema(state, *index["columns"])
        params = json.loads(index["params_json"])
        self.space = Space(params["metric"], params["longest"])
        self.table = lake.spark.read.parquet(f"{index['index_path']}/lists").where("row_count > 0")

        self.tail = appended_since(lake, state, index, file_io_config_json)

    def with_tail(self, rows: DataFrame) -> DataFrame:
        """Rows of lists and those that were appended after the index was built."""
        return rows if self.tail is None else rows.unionByName(self.tail.select(*rows.columns))

    def rows(self, numbers: Sequence[int] | None) -> DataFrame:
        if numbers is not None and len(numbers) == self.index["partition_count"]:
            numbers = None
        path = self.index["index_path"]
        return index_rows(
            self.lake, path, self.schema, LIST, numbers, self.file_io_config_json
        ).drop(LIST)

    def measured(self, query: Sequence[float]) -> list:
        """The lists by distance of their centroids: (list, rows, radius, distance, size)."""
        point = self.space.queries(np.array([check_query(query)]))[0]
        if not np.isfinite(point).all():
            away = F.lit(None).cast("double")
        else:
            away = distance(F.col("centroid"), point.tolist(), "l2", "native")
        facts = self.table.select(
            LIST, "row_count", "radius", away.alias("away"), norm(F.col("centroid")).alias("size")
        )
        return facts.orderBy(F.col("away").asc_nulls_last(), LIST).collect()

    def nearest(self, query: Sequence[float], nprobe: int, k: int) -> list[int]:
        """The ``nprobe`` nearest lists, and more in order of distance until they hold k rows."""
        if isinstance(nprobe, bool) or not isinstance(nprobe, int) or nprobe <= 0:
            raise VectorError(f"nprobe must be a positive whole number, not {nprobe!r}")
        return _first_lists(self.measured(query), nprobe, k)

    def needed(self, query: Sequence[float], k: int) -> list[int]:
        """All lists that may hold one of the k nearest rows."""
        bounds = self.bounds(query, k)
        return [row[LIST] for row, least, reach in bounds if least <= reach]

    def bounds(self, query: Sequence[float], k: int) -> list[tuple]:
        """(list, the least distance its rows can have, how far the kth row is at most)."""
        ranked = self.measured(query)
        id_column, vector_column = self.index["columns"]
        tried = self.rows(_first_lists(ranked, 1, k))
        found = vector_topk(tried, query, k, self.space.metric, id_column, vector_column)
        kth = found.where(F.col("rank") == k).select("distance").collect()
        kth = np.nan if not kth or kth[0][0] is None else kth[0][0]
        asked = np.array([check_query(query)])
        reach = self.space.reach(np.array([kth]), asked)[0]
        away = np.array([np.nan if row["away"] is None else row["away"] for row in ranked])
        radius = np.array([row["radius"] for row in ranked], float)
        own = sizes(self.space.queries(asked))[0]
        scale = own + np.array([row["size"] for row in ranked], float) + self.space.longest
        return list(zip(ranked, self.space.least(away, radius, scale).tolist(), [float(reach)] * len(ranked)))


def _first_lists(ranked: list, nprobe: int, k: int) -> list[int]:
    numbers, held = [], 0
    for row in ranked:
        if len(numbers) >= nprobe and held >= k:
            break
        numbers.append(row[LIST])
        held += row["row_count"]
    return numbers


def probed_lists(
    lake: Lakehouse,
    namespace: str,
    table_name: str,
    metadata_location: str | None,
    index_name: str,
    query_vector: Sequence[float],
    k: int,
) -> DataFrame:
    """Which lists an exact search through an index reads: ``(list_id, row_count, least_distance,
    is_read)``, distances in the space of the index."""
    state = lake.state(namespace, table_name, metadata_location)
    index = matched(lake, state, index_name, IVF)
    if index is None:
        raise IndexNotUsable(f"no vector index {index_name!r} of {state.metadata_location}")
    bounds = _Lists(lake, state, index, "{}").bounds(query_vector, k)
    rows = [(row[LIST], row["row_count"], least, least <= reach) for row, least, reach in bounds]
    return lake.spark.createDataFrame(
        rows, f"{LIST} int, row_count long, least_distance double, is_read boolean"
    )


def search_vector_batch(
    lake: Lakehouse,
    namespace: str,
    table_name: str,
    metadata_location: str | None,
    index_name: str,
    queries: DataFrame,
    k: int,
    distance_type: str = "l2",
    file_io_config_json: str = "{}",
) -> DataFrame:
    """Exact top k for each of many queries (query_id, query_vector) through an index:
    ``(query_id, id, distance, rank)``. The lists are the cells that queries visit."""
    state = lake.state(namespace, table_name, metadata_location)
    index = matched(lake, state, index_name, IVF)
    if index is None or json.loads(index["params_json"])["metric"] != distance_type:
        raise IndexNotUsable(f"no {distance_type} index {index_name!r} of {state.metadata_location}")
    lists = _Lists(lake, state, index, file_io_config_json)
    rows = index_rows(lake, index["index_path"], lists.schema, LIST, None, file_io_config_json)
    facts = lake.spark.read.parquet(f"{index['index_path']}/lists").orderBy(LIST).collect()
    columns = {name: np.array([row[name] for row in facts]) for name in ("centroid", "row_count", "radius")}
    found = nearest_in_cells(
        rows, queries, k, distance_type, *index["columns"], LIST, lists.space,
        columns["centroid"], columns["row_count"], columns["radius"],
    )
    if lists.tail is None:
        return found
    later = vector_topk_batch(lists.tail, queries, k, distance_type, *index["columns"])
    return best_of(found.unionByName(later), k, distance_type, index["columns"][0])


def _vector_columns(state: TableState, params: dict) -> tuple[str, str]:
    vectors = [
        field.name
        for field in state.schema.fields
        if isinstance(field.dataType, T.ArrayType)
        and isinstance(field.dataType.elementType, (T.FloatType, T.DoubleType))
    ]
    ids = [f.name for f in state.schema.fields if isinstance(f.dataType, T.IntegralType)]
    vector = params.get("vector_column") or (vectors[0] if len(vectors) == 1 else None)
    key = params.get("id_column") or (ids[0] if ids else None)
    if vector not in state.schema.names or key not in state.schema.names:
        raise VectorError("params_json must name the id_column and vector_column of the table")
    return key, vector
