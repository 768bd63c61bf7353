"""Exact nearest neighbours of many queries by a join on groups of cells.

Vectors lie in cells around centres, and each cell knows its radius. Cells near each other share a
group. A query first searches the group of its own cell, which bounds how far its k nearest can be;
it then visits the groups with cells that reach within that bound, by an equality join, and the
triangle inequality shows that no other can hold any of them. In a group too it goes by cells
that reach within the bound only.

Groups are of at most ``GROUP_BYTES`` and, of smaller tables, about ``GROUPS`` in number; cells above
that are cut by salts. So a query is sent out as often as there are groups, not cells, where bounds
rule nothing out. A task holds one group of vectors at a time while the queries that visit it stream
by, so neither a cell with a third of all vectors nor one with a third of all queries is gathered
anywhere. Vectors are shuffled once, and one part of each group besides; queries as often as they
visit. What goes to all tasks are the centres, whose size the caller bounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql import types as T

from tidemark.functions.distances import by_dimension, to_matrix
from tidemark.functions.spaces import Space, sizes
from tidemark.operators.nearest import NearestSoFar, scorable

GROUP_BYTES = 32 * 1024 * 1024
# Groups that smaller tables are cut into, so that many tasks share the work.
GROUPS = 32
# Cells of a group are put together into so many vectors, unless one alone has more.
VECTORS_IN_A_PIECE = 2_048
# Queries and vectors whose products a task holds in memory at a time.
QUERIES_AT_A_TIME = 256
VECTORS_AT_A_TIME = 10_000
# Points times centres whose scores a task holds at a time, three arrays of this size at once.
SCORES_AT_A_TIME = 1_000_000


@dataclass(frozen=True)
class Cells:
    """Centres as points of a space, and of each cell its number of vectors and its radius."""

    space: Space
    centres: np.ndarray
    counts: np.ndarray
    radii: np.ndarray
    length: int

    def plain(self) -> tuple:
        """What a broadcast can carry to workers that have no copy of this package."""
        return self.space.metric, self.space.longest, self.centres, self.counts, self.radii, self.length

    @classmethod
    def of(cls, plain: tuple) -> "Cells":
        return cls(Space(*plain[:2]), *plain[2:])

    def salts(self, group_bytes: int) -> np.ndarray:
        """Into how many groups each cell is cut."""
        rows = max(1, group_bytes // (8 * max(1, self.length)))
        return np.maximum(1, -(-self.counts // rows)).astype(np.int64)

    def groups(self, group_bytes: int) -> np.ndarray:
        """The group of each cell. Cells nearest to the same of some centres lie side by side, and
        are packed in this order; a cell that is cut has a group of its own."""
        rows = max(1, group_bytes // (8 * max(1, self.length)))
        rows = min(rows, max(1, -(-int(self.counts.sum()) // GROUPS)))
        anchors = self.centres[:: max(1, len(self.centres) // GROUPS)]
        near, _ = nearest_centres(self.centres, anchors)
        found, group, held = np.zeros(len(near), np.int64), 0, 0
        for cell in np.argsort(near, kind="stable"):
            if held and held + self.counts[cell] > rows:
                group, held = group + 1, 0
            found[cell] = group
            held += self.counts[cell]
        return found

    def to_centres(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances of queries to all centres, and the sizes that their rounding goes by."""
        points = self.space.queries(queries)
        own, other = sizes(points), sizes(self.centres)
        with np.errstate(all="ignore"):
            squares = own[:, None] ** 2 + other[None, :] ** 2 - 2 * points @ self.centres.T
            scale = own[:, None] + other[None, :] + self.space.longest
            return np.sqrt(np.maximum(squares, 0.0)), scale


def nearest_centres(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each point, the first of several, and how far it is; cell 0 and NaN
    for points that have no place. The same on every machine."""
    cells, distances = np.zeros(len(points), np.int64), np.full(len(points), np.nan)
    there = np.flatnonzero(np.isfinite(points).all(axis=1))
    numbers, scored = pa.array(np.arange(len(centres))), scorable(centres, "l2")
    # Some rows at least, so that many centres are not read anew for each.
    step = max(1, min(max(32, SCORES_AT_A_TIME // len(centres)), 4 * SCORES_AT_A_TIME // len(centres)))
    for start in range(0, len(there), step):
        rows = there[start : start + step]
        search = NearestSoFar(points[rows], 1, "l2")
        search.add(numbers, centres, scored)
        cells[rows] = search.ids.to_numpy()
        distances[rows] = by_dimension(
            np.ascontiguousarray(points[rows].T), np.ascontiguousarray(centres[cells[rows]].T), "l2"
        )
    return cells, distances


def join_on_cells(
    placed: DataFrame,
    queries: DataFrame,
    k: int,
    metric: str,
    cells: Cells,
    group_bytes: int | None = None,
) -> DataFrame:
    """(query_id, id, distance): of every query at least its k nearest, from (id, vector, cell) and
    (query_id, query_vector). At most k come from each group that a query visits."""
    sent = placed.sparkSession.sparkContext.broadcast(cells.plain())
    salts, groups = cells.salts(group_bytes or GROUP_BYTES), cells.groups(group_bytes or GROUP_BYTES)
    row = F.xxhash64("id", F.monotonically_increasing_id())
    n_salts = _of_cell(salts)
    if (salts == 1).all():
        n_salts = F.lit(1)
    vectors = placed.withColumn("salt", F.pmod(row, n_salts).cast("int")).withColumn("group", _of_cell(groups))
    asked = T.StructType([queries.schema["query_id"], queries.schema["query_vector"]])
    at_home = queries.mapInArrow(_homes(sent, groups), _grouped(asked))
    bounds = T.StructType([*asked.fields, *_BOUNDS, T.StructField("cell", T.IntegerType())])
    bounded = _meet(vectors.where("salt = 0"), at_home).mapInArrow(_search(sent, k, metric, bounds, True), bounds)
    visits = bounded.mapInArrow(_visits(sent, salts, groups), _grouped(T.StructType([*asked.fields, *_BOUNDS])))
    found = T.StructType(
        [queries.schema["query_id"], placed.schema["id"], T.StructField("distance", T.DoubleType())]
    )
    return _meet(vectors, visits).mapInArrow(_search(sent, k, metric, found, False), found)


# How far a query's kth vector is at most, in the space and as a distance of the metric.
_BOUNDS = [T.StructField("reach", T.DoubleType()), T.StructField("kth", T.DoubleType())]


def _of_cell(numbers: np.ndarray):
    return F.get(F.array(*[F.lit(int(n)) for n in numbers]), F.col("cell"))


def _grouped(asked: T.StructType) -> T.StructType:
    numbers = [T.StructField(name, T.IntegerType()) for name in ("cell", "group", "salt")]
    return T.StructType([*asked.fields, *numbers])


def _meet(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """Vectors and queries of each group beside each other, vectors first, both by cell."""
    both = vectors.withColumn("kind", F.lit(0)).unionByName(
        queries.withColumn("kind", F.lit(1)), allowMissingColumns=True
    )
    return both.repartition("group", "salt").sortWithinPartitions("group", "salt", "kind", "cell")


def _homes(sent, groups: np.ndarray):
    """Each query with its nearest cell that is not empty."""

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = Cells.of(sent.value)
        full = np.flatnonzero(cells.counts > 0)
        for batch in batches:
            for start in range(0, batch.num_rows, QUERIES_AT_A_TIME):
                part = batch.slice(start, QUERIES_AT_A_TIME)
                to, _ = cells.to_centres(to_matrix(part.column(1), cells.length))
                to = np.where(np.isnan(to), np.inf, to)
                cell = full[np.argmin(to[:, full], axis=1)]
                yield _with_groups(part, cell, groups[cell], np.zeros(part.num_rows))

    return homes


def _visits(sent, salts: np.ndarray, groups: np.ndarray):
    """Each query with all groups of all cells that may hold one of its k nearest."""
    times_of = np.zeros(groups.max() + 1, np.int64)
    np.maximum.at(times_of, groups, salts)

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = Cells.of(sent.value)
        for batch in batches:
            for start in range(0, batch.num_rows, QUERIES_AT_A_TIME):
                part = batch.slice(start, QUERIES_AT_A_TIME)
                reach = part.column("reach").to_numpy(zero_copy_only=False)
                query, cell = np.nonzero(_needed(cells, to_matrix(part.column(1), cells.length), reach))
                visit = np.unique(query * len(times_of) + groups[cell])
                query, group = np.divmod(visit, len(times_of))
                times = times_of[group]
                at = np.repeat(np.arange(len(visit)), times)
                salt = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
                home = part.column("cell").to_numpy()
                rows = part.drop_columns(["cell"])
                for first in range(0, len(at), VECTORS_AT_A_TIME):
                    some = slice(first, first + VECTORS_AT_A_TIME)
                    which = query[at[some]]
                    yield _with_groups(rows.take(pa.array(which)), home[which], group[at[some]], salt[some])

    return visits


def _needed(cells: Cells, queries: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """Which cells (columns) may hold a vector within reach of which query (rows)."""
    to, scale = cells.to_centres(queries)
    least = cells.space.least(to, cells.radii[None, :], scale)
    return (least <= reach[:, None]) & (cells.counts > 0)[None, :]


def _with_groups(rows: pa.RecordBatch, cell: np.ndarray, group: np.ndarray, salt: np.ndarray) -> pa.RecordBatch:
    numbers = [pa.array(values.astype(np.int32)) for values in (cell, group, salt)]
    return pa.RecordBatch.from_arrays(
        [*rows.columns, *numbers], names=[*rows.schema.names, "cell", "group", "salt"]
    )


def _search(sent, k: int, metric: str, schema: T.StructType, bound: bool):
    """Within each group the k nearest to every query; or, to bound its search, how far they are."""
    query_type = to_arrow_type(schema["query_id"].dataType)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = Cells.of(sent.value)
        group, held = None, []
        for run in _runs(batches):
            key = run.column("group")[0].as_py(), run.column("salt")[0].as_py()
            if key != group:
                group, held = key, []
            if run.column("kind")[0].as_py() == 0:
                matrix = to_matrix(run.column("vector"), cells.length)
                scored = scorable(matrix, metric)
                if metric != "cosine":
                    matrix = scored[:, :-1]
                # Ids are copied, since they would hold the whole batch with its vectors.
                ids = run.column("id").take(pa.array(np.arange(run.num_rows)))
                held.append((np.unique(run.column("cell").to_numpy()), ids, matrix, scored))
                continue
            for start in range(0, run.num_rows, QUERIES_AT_A_TIME):
                part = run.slice(start, QUERIES_AT_A_TIME)
                asked, vectors = part.column("query_id").cast(query_type), part.column("query_vector")
                queries, home = to_matrix(vectors, cells.length), part.column("cell")
                if bound:
                    kept = NearestSoFar(queries, k, metric)
                    own = [np.isin(home.to_numpy(), piece[0]) for piece in held]
                    _add(kept, held, own)
                    needed = _needed(cells, queries, cells.space.reach(kept.kth(), queries))
                    _add(kept, held, [needed[:, piece[0]].any(axis=1) & ~done for piece, done in zip(held, own)])
                    kth = kept.kth()
                    columns = [pa.array(cells.space.reach(kth, queries)), pa.array(kth), home]
                    yield pa.record_batch([asked, vectors, *columns], names=schema.names)
                    continue
                reach, kth = (part.column(name).to_numpy(zero_copy_only=False) for name in ("reach", "kth"))
                kept = NearestSoFar(queries, k, metric, kth)
                needed = _needed(cells, queries, reach)
                _add(kept, held, [needed[:, piece[0]].any(axis=1) for piece in held])
                if kept.ids is not None:
                    rows = [asked.take(pa.array(kept.which)), kept.ids, kept.distances()]
                    yield pa.record_batch(rows, names=schema.names)

    return search


def _add(kept: NearestSoFar, held: list, wanted: list[np.ndarray]) -> None:
    for (_, ids, matrix, scored), asked in zip(held, wanted):
        if asked.any():
            kept.add(ids, matrix, scored, None if asked.all() else np.flatnonzero(asked))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut where the group or the kind of row changes, and into bounded parts, those of
    vectors where a cell ends if it can be."""
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(name).to_numpy() for name in ("group", "salt", "kind")]
        changes = np.any([column[1:] != column[:-1] for column in columns], axis=0)
        cuts = [0, *(np.flatnonzero(changes) + 1).tolist(), batch.num_rows]
        cell = batch.column("cell").to_numpy()
        for first, last in zip(cuts, cuts[1:]):
            step = VECTORS_AT_A_TIME if columns[2][first] else VECTORS_IN_A_PIECE
            while first < last:
                end = min(first + step, last)
                ends = np.flatnonzero(cell[first + 1 : end + 1] != cell[first:end][: len(cell[first + 1 : end + 1])])
                if end < last and len(ends):
                    end = first + 1 + int(ends[-1])
                yield batch.slice(first, end - first)
                first = end
