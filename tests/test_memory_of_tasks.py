"""What a task of a batch search holds, without Spark."""

import io
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

from tidemark.functions.spaces import Space
from tidemark.operators import cells as cells_module
from tidemark.operators.cells import Cells, nearest_centres


def test_a_group_is_not_held_a_second_time_as_arrow_batches():
    length, count = 64, 2_000
    matrix = np.random.default_rng(5).normal(size=(10 * count, length)).astype(np.float32)
    known = Cells(Space("l2"), np.zeros((1, length)), np.array([len(matrix)]), np.array([1e3]), length)

    def batch(rows, first, kind):
        vectors = pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), length).cast(pa.list_(pa.float32()))
        numbers = pa.array(np.arange(first, first + len(rows)))
        same = {name: pa.array(np.zeros(len(rows), np.int32)) for name in ("cell", "group", "salt")}
        none, far = pa.nulls(len(rows), vectors.type), pa.array(np.full(len(rows), 1e3))
        columns = {
            "id": numbers, "vector": none if kind else vectors, **same,
            "kind": pa.array(np.full(len(rows), kind, np.int32)),
            "query_id": numbers, "query_vector": vectors if kind else none, "reach": far, "kth": far,
        }
        return pa.record_batch(columns)

    sent = io.BytesIO()
    parts = [batch(matrix[at : at + count], at, 0) for at in range(0, len(matrix), count)]
    parts.append(batch(matrix[:5], 0, 1))
    with pa.ipc.new_stream(sent, parts[0].schema) as writer:
        for part in parts:
            writer.write_batch(part)
    sent.seek(0)
    del parts
    schema = T.StructType(
        [T.StructField("query_id", T.LongType()), T.StructField("id", T.LongType()), T.StructField("distance", T.DoubleType())]
    )
    search = cells_module._search(SimpleNamespace(value=known.plain()), 1, "l2", schema, False)
    tracemalloc.start()
    try:
        found = search(iter(pa.ipc.open_stream(sent)))
        rows = next(found)
        held = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert rows.column("id").to_pylist() == [0, 1, 2, 3, 4]
    # As doubles with one more column, and the batch of queries.
    assert held < 1.25 * 2 * matrix.nbytes


def test_vectors_are_placed_by_blocks_of_bounded_size():
    rng = np.random.default_rng(6)
    points, centres = rng.normal(size=(10_000, 8)), rng.normal(size=(400, 8))
    wanted, away = nearest_centres(points, centres)
    tracemalloc.start()
    try:
        again, _ = nearest_centres(points, centres)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 48_000_000
    assert (again == wanted).all()
    squares = ((points[:50, None, :] - centres[None, :, :]) ** 2).sum(axis=2)
    assert (squares.argmin(axis=1) == wanted[:50]).all()
