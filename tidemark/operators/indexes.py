"""Index datasets: clustered copies of a table as of one snapshot, and their registry.

``scalar`` copies the rows in order of some columns into zones, with a zone map of each
zone's min, max and null count. ``ivf`` copies ids and vectors into the lists of their
nearest centroids. Both are written to a path of their own first; ``publish`` then appends
one registry row, and only then can a search see them. Files are never rewritten.

A search uses an index built from the table state it reads, or from an earlier state of that
table: then the rows that were appended since are scanned beside it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.distances import METRICS, norm, to_matrix
from tidemark.functions.predicates import zone_columns
from tidemark.functions.spaces import Space
from tidemark.operators.cells import nearest_centres
from tidemark.operators.zones import RANK_BITS, bits_for, bitsets, z_key
from tidemark.sources.lakehouse import Lakehouse, TableState, snapshot_number

SCALAR = "scalar"
IVF = "ivf"

# Centroids go to every task, so this is checked before they do.
MAX_CENTROID_BYTES = 256 * 1024 * 1024
# What a task of the training may hold of distances between a block of vectors and all centroids.
BLOCK_PRODUCTS_MB = 64
# Small tables still get this many files, so that an index can leave some of them out.
MIN_FILES = 8
SCALAR_ROWS_PER_FILE = 1_000_000
VECTOR_BYTES_PER_FILE = 256 * 1024 * 1024

# Into how many ranges rows of one value can be cut, or of one place in the space-filling order.
BITS_OF_RANGES = 16

ZONE = "zone_id"
LIST = "list_id"
TO_CENTROID = "centroid_distance"


class IndexBuildError(ValueError):
    pass


@dataclass(frozen=True)
class StagedIndex:
    """An index that is written in full but not registered yet."""

    lake: Lakehouse
    state: TableState
    event: dict

    def publish(self) -> dict:
        self.lake.record_index_event(self.state.namespace, self.state.table_name, self.event)
        return self.event


def build_scalar_index(
    lake: Lakehouse,
    namespace: str,
    table_name: str,
    index_name: str,
    columns: Sequence[str],
    metadata_location: str | None = None,
    rows_per_file: int = SCALAR_ROWS_PER_FILE,
    order: str = "columns",
    lookup_columns: Sequence[str] = (),
) -> StagedIndex:
    """Copy a table state into zones ordered by ``columns``, and map the zones.

    ``order="z"`` interleaves the columns, so that a test of any one of them rules zones out;
    ``lookup_columns`` get a bitset in each zone, so that tests for given values do, whatever the
    order (``tidemark.operators.zones``). Rows are range-partitioned by the order and then by a hash of where each row lies in
    its source file. A value that fills a third of the table is thereby cut into as many
    ranges as its share of the rows asks for, and a lost task finds the same rows again.
    """
    state = lake.state(namespace, table_name, metadata_location)
    types = {field.name: field.dataType for field in state.schema.fields}
    for name in columns:
        if not isinstance(types.get(name), T.AtomicType):
            raise IndexBuildError(f"cannot order rows by {name!r}")
    if not columns:
        raise IndexBuildError("a scalar index needs at least one column")
    if order not in ("columns", "z"):
        raise IndexBuildError(f"order must be 'columns' or 'z', not {order!r}")
    for name in lookup_columns:
        if not isinstance(types.get(name), T.AtomicType):
            raise IndexBuildError(f"cannot look {name!r} up")
    path = _new_path(lake, state, index_name)
    tasks = max(MIN_FILES, -(-state.total_rows // rows_per_file))
    keys = [F.col(f"`{name}`") for name in columns]
    zone = F.spark_partition_id()
    # A few bits tell equal values apart well enough, and are all of a hash that does not compress.
    rows = lake.scan_files(state).select(
        *[f"`{name}`" for name in types], F.pmod(_row_hash(), F.lit(1 << BITS_OF_RANGES)).alias("_row")
    )
    by = keys
    if order == "z":
        place = z_key(lake.scan_state(state), columns)
        if RANK_BITS * len(columns) <= 63 - BITS_OF_RANGES:
            # Both in one number, which is shuffled in fewer bytes.
            rows = rows.withColumn("_row", F.shiftleft(place, BITS_OF_RANGES) + F.col("_row"))
            by = [F.shiftright("_row", BITS_OF_RANGES)]
        else:
            rows, by = rows.withColumn("_z", place), [F.col("_z")]
    (
        rows.repartitionByRange(tasks, *by, F.col("_row"))
        .withColumn(ZONE, zone)
        .sortWithinPartitions(ZONE, *by)
        .drop("_row", "_z")
        .write.partitionBy(ZONE)
        .option("maxRecordsPerFile", rows_per_file)
        .option("compression", "zstd")
        .parquet(f"{path}/rows")
    )
    facts = [F.count(F.lit(1)).alias("row_count")]
    for name, column in zip(columns, keys):
        lowest, highest, nulls = zone_columns(name)
        facts += [
            F.min(column).alias(lowest),
            F.max(column).alias(highest),
            F.count_if(column.isNull()).alias(nulls),
        ]
    copy = index_rows(lake, path, state.schema, ZONE)
    copy.groupBy(ZONE).agg(*facts).coalesce(1).write.parquet(f"{path}/zones")
    sizes = lake.spark.read.parquet(f"{path}/zones").select("row_count")
    params = {"order": order, "lookup_columns": list(lookup_columns)}
    event = _event(state, index_name, SCALAR, path, columns, params, sizes)
    if lookup_columns:
        params["bits"] = bits_for(event["largest_partition_rows"])
        event["params_json"] = json.dumps(params)
    for at, name in enumerate(lookup_columns):
        # As they are grouped; in order of the words, so that few row groups hold those looked up.
        words = bitsets(copy, ZONE, name, params["bits"]).sortWithinPartitions("word")
        words.write.parquet(f"{path}/bitsets/{at}")
    if event["row_count"] != state.total_rows:
        raise IndexBuildError(f"{event['row_count']} of {state.total_rows} rows were copied")
    return StagedIndex(lake, state, event)


def build_ivf_index(
    lake: Lakehouse,
    namespace: str,
    table_name: str,
    index_name: str,
    id_column: str,
    vector_column: str,
    nlist: int,
    metadata_location: str | None = None,
    metric: str = "l2",
    seed: int = 42,
    max_iterations: int = 10,
    training_vectors: int | None = None,
    init_mode: str = "k-means||",
) -> StagedIndex:
    """Copy ids and vectors into lists around ``nlist`` KMeans centroids.

    Lists lie in the space of the metric (``tidemark.functions.spaces``), and each knows its radius
    there, so that a search can tell which of them cannot matter. Centroids are fitted on all vectors, or on about ``training_vectors`` of them where that
    is given; ``init_mode`` is how KMeans starts (``random`` is quicker for many lists and
    worse). They are sent to the tasks, and every vector is put to
    its list in one pass. One shuffle then brings each list together, with lists cut or
    joined so that every task gets an equal share: a list holding a third of all vectors is
    spread over a third of the tasks.
    """
    if metric not in METRICS:
        raise IndexBuildError(f"no vector index exists for {metric!r}")
    if nlist <= 0:
        raise IndexBuildError("nlist must be at least 1")
    state = lake.state(namespace, table_name, metadata_location)
    path = _new_path(lake, state, index_name)
    vector = F.col(f"`{vector_column}`")
    rows = (
        lake.scan_files(state)
        .where(vector.isNotNull())
        .select(f"`{id_column}`", vector, _row_hash().alias("_row"), _draw(id_column).alias("_draw"))
    )
    size = norm(vector)
    space = Space(metric)
    if metric == "ip":
        finite = rows.where(size < float("inf"))
        space = Space(metric, finite.agg(F.max(size)).first()[0] or 0.0)
    sample = rows
    if training_vectors is not None and state.total_rows > training_vectors:
        sample = rows.where(F.col("_draw") < training_vectors / state.total_rows)
    # One vector that is no point in space would make its whole centroid none.
    sample = sample.where((size < float("inf")) & (size > 0 if metric == "cosine" else F.lit(True)))
    point = vector.cast("array<double>")
    if metric == "ip":
        rest = F.greatest(F.lit(space.longest**2) - size * size, F.lit(0.0))
        point = F.array_append(point, F.sqrt(rest))
    sample = sample.select(array_to_vector(point).alias("features")).persist()
    try:
        first = sample.first()
        if first is None:
            raise IndexBuildError("no vectors to train on")
        length = len(first["features"])
        if nlist * length * 8 > MAX_CENTROID_BYTES:
            raise IndexBuildError(f"{nlist} centroids of {length} numbers are too large to send out")
        kmeans = KMeans(
            k=nlist,
            seed=seed,
            maxIter=max_iterations,
            distanceMeasure="cosine" if metric == "cosine" else "euclidean",
            initMode=init_mode,
            # By blocks, since the other solver has a task for every centroid in each round, which
            # tells the driver how far all others are.
            solver="block",
            maxBlockSizeInMB=min(1.0, BLOCK_PRODUCTS_MB * length / nlist),
        )
        model = kmeans.fit(sample)
        centers = np.array(model.clusterCenters())
        if metric == "cosine":
            centers = space.points(centers)
        counts = model.transform(sample).groupBy("prediction").count().collect()
    finally:
        sample.unpersist()
    lists = len(centers)
    weights = np.ones(lists)
    for row in counts:
        weights[row["prediction"]] += row["count"]
    rows_per_file = max(1, VECTOR_BYTES_PER_FILE // (4 * length))
    tasks = max(MIN_FILES, -(-state.total_rows // rows_per_file))
    place = _nearest_list(lake, centers, space, weights / weights.sum(), tasks)
    (
        rows.withColumn("_place", place(vector, F.col("_row")))
        .select(f"`{id_column}`", vector, f"_place.{LIST}", f"_place.{TO_CENTROID}", "_place.task")
        .repartitionById(tasks, F.col("task"))
        .drop("task")
        .sortWithinPartitions(LIST, F.col(f"`{id_column}`"))
        .write.partitionBy(LIST)
        .option("maxRecordsPerFile", rows_per_file)
        .parquet(f"{path}/rows")
    )
    measured = T.StructType([T.StructField(TO_CENTROID, T.DoubleType())])
    # A product with a vector that has no place in the space may be the largest of all.
    unknown = F.lit(float("inf") if metric == "ip" else 0.0)
    sizes = index_rows(lake, path, measured, LIST).groupBy(LIST).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.max(F.coalesce(TO_CENTROID, unknown)).alias("radius"),
    )
    centroids = lake.spark.createDataFrame(
        [(number, center.tolist()) for number, center in enumerate(centers)],
        f"{LIST} int, centroid array<double>",
    )
    (
        centroids.join(sizes, LIST, "left")
        .na.fill(0, ["row_count"])
        .na.fill(0.0, ["radius"])
        .coalesce(1)
        .write.parquet(f"{path}/lists")
    )
    params = {"metric": metric, "nlist": lists, "seed": seed, "max_iterations": max_iterations}
    params["longest"] = space.longest
    sizes = lake.spark.read.parquet(f"{path}/lists").select("row_count")
    columns = [id_column, vector_column]
    return StagedIndex(lake, state, _event(state, index_name, IVF, path, columns, params, sizes))


def drop_index(lake: Lakehouse, namespace: str, table_name: str, index_name: str) -> None:
    """Take an index out of use by one registry row. Its files stay for retention to clear."""
    state = lake.state(namespace, table_name)
    found = live_indexes(lake, namespace, table_name).where(F.col("index_name") == index_name)
    rows = found.collect()
    if not rows:
        raise LookupError(f"{namespace}.{table_name} has no index {index_name!r}")
    event = {name: rows[0][name] for name in rows[0].__fields__}
    event.update(event="dropped", table_uuid=state.table_uuid)
    lake.record_index_event(namespace, table_name, event)


def list_indexes(lake: Lakehouse) -> DataFrame:
    """Every live index of every table, with the size of its largest zone or list."""
    return _fold(lake.index_events(), "namespace", "table_name")


def live_indexes(lake: Lakehouse, namespace: str, table_name: str) -> DataFrame:
    """The live indexes of one table."""
    return _fold(lake.index_events_of(namespace, table_name))


def match_index(
    lake: Lakehouse,
    namespace: str,
    table_name: str,
    metadata_location: str,
    index_name: str | None = None,
) -> DataFrame:
    """The live index that serves a table state, as one JSON row. No match: no row.

    An index serves the state it was built from (``metadata_location``) and, as tables only grow,
    later ones. The one built from the latest state is taken, of several the newest.
    """
    state = lake.state(namespace, table_name, metadata_location)
    live = live_indexes(lake, namespace, table_name).where(F.col("table_uuid") == state.table_uuid)
    number = F.substring_index("metadata_location", "#", -1).cast("long")
    live = live.where(number <= state.snapshot_seq)
    if index_name is not None:
        live = live.where(F.col("index_name") == index_name)
    newest = live.agg(F.max_by(F.struct("*"), F.struct(number, "event_seq")).alias("index"))
    return newest.where("index IS NOT NULL").select(F.to_json("index").alias("index_json"))


def matched(
    lake: Lakehouse, state: TableState, index_name: str | None, index_type: str
) -> dict | None:
    """The index a search may use, or None: then it scans the table itself.

    Gives what ``match_index`` gives for a name, from that name's last event alone.
    ``snapshot_seq`` of the result tells up to which snapshot its rows go.
    """
    if not index_name:
        return None
    events = lake.index_events_of(state.namespace, state.table_name).where(
        (F.col("table_uuid") == state.table_uuid) & (F.col("index_name") == index_name)
    )
    last = events.orderBy(F.desc("event_seq")).limit(1).collect()
    if not last or last[0]["event"] != "published":
        return None
    index = last[0].asDict()
    index["snapshot_seq"] = snapshot_number(index["metadata_location"])
    fits = 0 <= index["snapshot_seq"] <= state.snapshot_seq
    return index if fits and index["index_type"] == index_type else None


def appended_since(
    lake: Lakehouse, state: TableState, index: dict, file_io_config_json: str = "{}"
) -> DataFrame | None:
    """The rows of a state that came after an index was built; None if there is no such snapshot."""
    if index["snapshot_seq"] == state.snapshot_seq:
        return None
    rows = lake.scan_files(state, file_io_config_json, after=index["snapshot_seq"])
    return rows.select(*[f"`{name}`" for name in state.schema.names])


def ivf_schema(state: TableState, id_column: str, vector_column: str) -> T.StructType:
    fields = {field.name: field for field in state.schema.fields}
    return T.StructType([fields[id_column], fields[vector_column]])


def index_rows(
    lake: Lakehouse,
    index_path: str,
    schema: T.StructType,
    folder: str,
    numbers: Sequence[int] | None = None,
    file_io_config_json: str = "{}",
) -> DataFrame:
    """The rows of an index, or of some of its zones or lists, with their ``folder`` column."""
    whole = T.StructType([*schema.fields, T.StructField(folder, T.IntegerType())])
    reader = lake.spark.read.schema(whole).options(**json.loads(file_io_config_json))
    root = f"{index_path}/rows"
    if numbers is None:
        return reader.parquet(root)
    if not len(numbers):
        return reader.parquet(root).where(F.lit(False))
    named = [f"{root}/{folder}={number}" for number in numbers]
    return reader.option("basePath", root).parquet(*named).where(F.col(folder).isin(list(numbers)))


def _fold(events: DataFrame, *address: str) -> DataFrame:
    last = F.max_by(F.struct("*"), F.col("event_seq")).alias("last")
    folded = events.groupBy(*address, "table_uuid", "index_name").agg(last)
    return folded.select("last.*").where(F.col("event") == "published")


def _row_hash() -> Column:
    """A number for each row that depends only on where it is stored."""
    return F.xxhash64("_metadata.file_name", "_metadata.row_index")


def _draw(id_column: str) -> Column:
    """A number in [0, 1) for each row, the same wherever files of the same rows lie.

    With the place in the file, since an id that is not unique must not come in all at once.
    """
    return _unit(F.xxhash64(F.col(f"`{id_column}`"), F.col("_metadata.row_index")))


def _unit(number: Column) -> Column:
    return F.pmod(number, F.lit(1 << 30)) / F.lit(float(1 << 30))


def _new_path(lake: Lakehouse, state: TableState, index_name: str) -> str:
    if not index_name:
        raise IndexBuildError("an index needs a name")
    return f"{lake.root}/indexes/{state.namespace}/{state.table_name}/{uuid.uuid4()}"


def _event(
    state: TableState,
    index_name: str,
    index_type: str,
    path: str,
    columns: Sequence[str],
    params: dict,
    sizes: DataFrame,
) -> dict:
    total = sizes.agg(
        F.sum("row_count").alias("rows"),
        F.count_if(F.col("row_count") > 0).alias("parts"),
        F.max("row_count").alias("largest"),
    ).first()
    return {
        "table_uuid": state.table_uuid,
        "event": "published",
        "index_name": index_name,
        "index_type": index_type,
        "metadata_location": state.metadata_location,
        "index_path": path,
        "columns": list(columns),
        "params_json": json.dumps(params),
        "row_count": total["rows"] or 0,
        "partition_count": total["parts"],
        "largest_partition_rows": total["largest"] or 0,
    }


def _nearest_list(lake: Lakehouse, centers: np.ndarray, space: Space, shares: np.ndarray, tasks: int):
    """The list of the nearest centroid, how far that is, and the task that writes the row.

    The search is exact, so a task run again elsewhere places every vector as before. Lists lie
    end to end on [0, 1), each as long as its share of the sample, and a row's hash gives its
    place within its list. Tasks are equal cuts of that line, so large lists span several tasks
    and small ones share one. The shares steer balance only.
    """
    ends = np.cumsum(shares)
    sent = lake.spark.sparkContext.broadcast((centers, ends - shares, shares))
    length = centers.shape[1] - (space.metric == "ip")

    @F.arrow_udf(f"{LIST} int, {TO_CENTROID} double, task int")
    def nearest(vectors: pa.Array, rows: pa.Array) -> pa.Array:
        table, starts, parts = sent.value
        found, distance = nearest_centres(space.points(to_matrix(vectors, length)), table)
        within = np.mod(rows.to_numpy(zero_copy_only=False), 1 << 30) / float(1 << 30)
        task = np.minimum(np.floor((starts[found] + within * parts[found]) * tasks), tasks - 1)
        columns = [pa.array(found.astype(np.int32)), pa.array(distance, from_pandas=True)]
        columns.append(pa.array(task.astype(np.int32)))
        return pa.StructArray.from_arrays(columns, names=[LIST, TO_CENTROID, "task"])

    return nearest
