import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.functions.distances import VectorError
from tidemark.operators import vector_topk, vector_topk_batch
from tidemark.functions.spaces import Space
from tidemark.operators import nearest
from tidemark.operators.cells import Cells, nearest_centres

SCHEMA = "id long, vector array<float>"
METRICS = ["l2", "ip", "cosine"]


def made_vectors(count, length=8, seed=3):
    """Vectors of few distinct numbers, so distances tie; a third are copies of one vector."""
    rng = random.Random(seed)
    rows = []
    for number in range(count):
        if rng.random() < 1 / 3:
            vector = [1.0] * length
        elif rng.random() < 0.05:
            vector = None
        elif rng.random() < 0.05:
            vector = [0.0] * length
        else:
            vector = [float(rng.choice([-1, 0, 0.5, 1, 2])) for _ in range(length)]
        rows.append((number, vector))
    return rows


def measured(a, b, metric):
    if metric == "l2":
        return math.sqrt(sum((x - y) ** 2 for x, y in zip(a, b)))
    product = sum(x * y for x, y in zip(a, b))
    if metric == "ip":
        return product
    size = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(y * y for y in b))
    return None if size == 0 else 1 - max(-1.0, min(1.0, product / size))


def brute_force(rows, query, k, metric):
    found = [(i, measured(v, query, metric)) for i, v in rows if v is not None]
    sign = -1 if metric == "ip" else 1
    found.sort(key=lambda item: (item[1] is None, sign * (item[1] or 0.0), item[0]))
    return [(i, d, rank) for rank, (i, d) in enumerate(found[:k], start=1)]


def close(found, wanted):
    assert [(row[0], row[2]) for row in found] == [(row[0], row[2]) for row in wanted]
    for (_, ours, _), (_, theirs, _) in zip(found, wanted):
        assert (ours is None) == (theirs is None)
        assert ours is None or ours == pytest.approx(theirs, abs=1e-12)


@pytest.mark.parametrize("metric", METRICS)
@pytest.mark.parametrize("form", ["native", "arrow"])
def test_one_query_gives_what_brute_force_gives(spark, metric, form):
    rows = made_vectors(300)
    query = [0.5, 1, 0, -1, 2, 1, 1, 0]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for k in (1, 7, 500):
        found = vector_topk(frame, query, k, metric, form=form).orderBy("rank").collect()
        close([tuple(row) for row in found], brute_force(rows, query, k, metric))


@pytest.mark.parametrize("metric", METRICS)
@pytest.mark.parametrize("parts", [1, 6])
def test_many_queries_give_what_brute_force_gives(spark, metric, parts):
    rows, asked = made_vectors(400), made_vectors(40, seed=9)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    queries = spark.createDataFrame(asked, "query_id long, query_vector array<float>")
    for k in (3, 450):
        found = vector_topk_batch(frame, queries, k, metric).collect()
        for number, query in asked:
            mine = sorted((r for r in found if r["query_id"] == number), key=lambda r: r["rank"])
            mine = [(r["id"], r["distance"], r["rank"]) for r in mine]
            wanted = [] if query is None else brute_force(rows, query, k, metric)
            close(mine, wanted)


@pytest.mark.parametrize("metric", METRICS)
def test_batch_and_single_searches_agree_to_the_bit(spark, sf_dir, metric):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    queries = vectors.select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector")
    )
    batch = vector_topk_batch(vectors, queries, 5, metric, "vec_id", "embedding").collect()
    for number in (0, 77, 499):
        query = list(vectors.where(F.col("vec_id") == number).first()["embedding"])
        mine = sorted(tuple(r)[1:] for r in batch if r["query_id"] == number)
        for form in ("native", "arrow"):
            single = vector_topk(vectors, query, 5, metric, "vec_id", "embedding", form)
            assert sorted(tuple(r) for r in single.collect()) == mine


@pytest.mark.parametrize("metric", METRICS)
@pytest.mark.parametrize("cells", [1, 7, 40])
def test_cells_and_salted_groups_lose_nothing(spark, metric, cells):
    rows, asked = made_vectors(600), made_vectors(60, seed=4)
    frame = spark.createDataFrame(rows + [(1000, [float("nan")] * 8)], SCHEMA).repartition(3)
    queries = spark.createDataFrame(asked, "query_id long, query_vector array<float>")
    found = vector_topk_batch(frame, queries, 2, metric, cells=cells, group_bytes=8 * 8 * 20).collect()
    for number, query in asked:
        mine = sorted((r for r in found if r["query_id"] == number), key=lambda r: r["rank"])
        wanted = brute_force(rows, query, 2, metric) if query is not None else []
        close([(r["id"], r["distance"], r["rank"]) for r in mine], wanted)


def test_far_cells_are_not_visited(spark):
    """Of well-parted clusters a query visits its own only."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 6)) * 100
    rows = [(i, [float(x) for x in centres[i % 20] + rng.normal(size=6)]) for i in range(4000)]
    frame = spark.createDataFrame(rows, "id long, vector array<double>")
    queries = frame.where("id < 100").toDF("query_id", "query_vector")
    found = vector_topk_batch(frame, queries, 3).collect()
    assert len(found) == 300 and all(r["query_id"] % 20 == r["id"] % 20 for r in found)
    matrix = np.array([vector for _, vector in rows])
    space = Space("l2")
    where, far = nearest_centres(matrix, matrix[:20])
    radii = np.array([far[where == cell].max() for cell in range(20)])
    cells = Cells(space, matrix[:20], np.bincount(where), radii, 6)
    to, scale = cells.to_centres(matrix[:100])
    assert ((space.least(to, radii[None, :], scale) <= 20).sum(axis=1) == 1).all()


def test_text_ids_and_their_own_column_names(spark):
    frame = spark.createDataFrame(
        [("b", [1.0]), ("a", [1.0]), ("c", [0.0]), ("ä", [1.0])], "key string, emb array<double>"
    )
    one = vector_topk(frame, [1.0], 3, "l2", "key", "emb")
    assert [tuple(r) for r in one.orderBy("rank").collect()] == [
        ("a", 0.0, 1),
        ("b", 0.0, 2),
        ("ä", 0.0, 3),
    ]
    queries = spark.createDataFrame([("q", [1.0])], "ask string, qv array<double>")
    many = vector_topk_batch(frame, queries, 3, "l2", "key", "emb", "ask", "qv")
    assert many.columns == ["ask", "key", "distance", "rank"]
    assert [r["key"] for r in many.orderBy("rank").collect()] == ["a", "b", "ä"]


def test_no_vectors_or_no_queries(spark):
    empty = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame([(1, [1.0])], SCHEMA)
    asked = "query_id long, query_vector array<float>"
    assert vector_topk(empty, [1.0], 3).count() == 0
    assert vector_topk_batch(empty, spark.createDataFrame([(1, [1.0])], asked), 3).count() == 0
    assert vector_topk_batch(some, spark.createDataFrame([], asked), 3).count() == 0


@pytest.mark.parametrize("k", [0, -1, 1.5, True])
def test_k_must_be_positive(spark, k):
    frame = spark.createDataFrame([(1, [1.0])], SCHEMA)
    with pytest.raises(VectorError):
        vector_topk(frame, [1.0], k)


@pytest.mark.parametrize("query", [[], [float("nan")], [float("inf")]])
def test_query_vectors_must_be_finite(spark, query):
    frame = spark.createDataFrame([(1, [1.0])], SCHEMA)
    with pytest.raises(VectorError):
        vector_topk(frame, query, 1)


def test_unknown_distance_or_repeated_query_ids_or_ragged_queries(spark):
    frame = spark.createDataFrame([(1, [1.0])], SCHEMA)
    asked = "query_id long, query_vector array<float>"
    with pytest.raises(VectorError):
        vector_topk(frame, [1.0], 1, "hamming")
    with pytest.raises(VectorError):
        vector_topk(frame.toDF("rank", "vector"), [1.0], 1, id_column="rank")
    with pytest.raises(VectorError):
        vector_topk_batch(frame, frame, 1, query_id_column="id", query_vector_column="vector")
    for rows in ([(1, [1.0]), (1, [2.0])], [(1, [1.0]), (2, [1.0, 2.0])]):
        with pytest.raises(VectorError):
            vector_topk_batch(frame, spark.createDataFrame(rows, asked), 1)


@pytest.mark.parametrize("form", ["native", "arrow"])
def test_a_vector_of_another_length_fails_the_job(spark, form):
    frame = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], SCHEMA)
    with pytest.raises(PySparkException, match="length differs"):
        vector_topk(frame, [1.0, 2.0], 1, form=form).collect()


def test_nan_in_a_vector_gives_no_distance_and_sorts_last(spark):
    frame = spark.createDataFrame([(1, [float("nan"), 1.0]), (2, [9.0, 9.0])], SCHEMA)
    asked = spark.createDataFrame([(1, [0.0, 1.0])], "query_id long, query_vector array<float>")
    for metric in METRICS:
        for form in ("native", "arrow"):
            found = vector_topk(frame, [0.0, 1.0], 2, metric, form=form).orderBy("rank").collect()
            assert [(r["id"], r["distance"] is None) for r in found] == [(2, False), (1, True)]
        found = vector_topk_batch(frame, asked, 2, metric).orderBy("rank").collect()
        assert [(r["id"], r["distance"] is None) for r in found] == [(2, False), (1, True)]


def test_far_apart_sizes_do_not_upset_the_matrix_product(spark):
    """Vectors near a distant point, where |a|^2 + |b|^2 - 2ab loses all its digits."""
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in 1e7 + rng.integers(0, 5, 4)]) for i in range(200)]
    frame = spark.createDataFrame(rows, "id long, vector array<double>")
    queries = spark.createDataFrame(rows[:20], "query_id long, query_vector array<double>")
    found = vector_topk_batch(frame, queries, 5).collect()
    for number, query in rows[:20]:
        mine = sorted((r["rank"], r["id"]) for r in found if r["query_id"] == number)
        assert [i for _, i in mine] == [i for i, _, _ in brute_force(rows, query, 5, "l2")]


def test_copies_of_one_vector_do_not_pile_up_pairs():
    """All rows tie for every query, yet only k of them per query are measured exactly."""
    queries = np.ones((50, 4))
    matrix = np.ones((5000, 4))
    kept = nearest.NearestSoFar(queries, 3, "l2")
    sizes = []
    keep = kept._keep
    kept._keep = lambda which, keys, ids: (sizes.append(len(which)), keep(which, keys, ids))
    ids = pa.array(np.arange(5000)[::-1].copy())
    kept.add(ids, matrix, nearest.scorable(matrix, "l2"))
    assert sum(sizes) <= 2 * 50 * 3
    assert kept.ids.to_pylist() == [0, 1, 2] * 50


def test_the_plan_merges_k_rows_per_task_and_shuffles_no_vectors(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    one = vector_topk(vectors, [0.5] * 64, 10, "l2", "vec_id", "embedding")
    text = one._jdf.queryExecution().explainString(mode)
    assert "TakeOrderedAndProject" in text and "Exchange" not in text
    assert "ReadSchema: struct<vec_id:bigint,embedding:array<float>>" in text
    queries = vectors.select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector")
    )
    many = vector_topk_batch(vectors, queries, 10, "l2", "vec_id", "embedding")
    text = many._jdf.queryExecution().explainString(mode)
    assert text.count("WindowGroupLimit (") >= 2 and "Join" not in text
    assert text.count("MapInArrow (") >= 4 and "BroadcastExchange" not in text


def test_queries_go_out_by_groups_of_cells_not_by_cells(spark):
    import pyarrow as pa

    from tidemark.functions.spaces import Space
    from tidemark.operators import cells as cells_module

    draw = np.random.default_rng(3)
    centres = draw.normal(size=(256, 8))
    counts = np.full(256, 40)
    counts[[5, 6, 7]] = 0, 1, 500_000
    known = cells_module.Cells(Space("l2"), centres, counts, np.full(256, 1e9), 8)
    salts, groups = known.salts(1 << 20), known.groups(1 << 20)
    assert salts[7] > 1 and [cell for cell in np.flatnonzero(groups == groups[7]) if counts[cell]] == [7]
    counts[7] = 40
    salts, groups = known.salts(1 << 20), known.groups(1 << 20)
    held = np.bincount(groups, counts)
    assert (salts == 1).all() and held.max() <= max(40, -(-counts.sum() // cells_module.GROUPS))
    assert len(held) <= 2 * cells_module.GROUPS
    asked = pa.record_batch(
        [
            pa.array([1, 2]),
            pa.array(draw.normal(size=(2, 8)).tolist()),
            pa.array([1e12, float("inf")]),
            pa.array([1e12, float("nan")]),
            pa.array([3, 4], pa.int32()),
        ],
        names=["query_id", "query_vector", "reach", "kth", "cell"],
    )
    sent = spark.sparkContext.broadcast(known.plain())
    rows = pa.Table.from_batches(cells_module._visits(sent, salts, groups)(iter([asked]))).to_pydict()
    # Every group that holds a vector, once for each query, and not every cell.
    full = set(groups[counts > 0].tolist())
    visits = list(zip(rows["query_id"], rows["group"], rows["salt"]))
    assert sorted(visits) == sorted((query, group, 0) for query in (1, 2) for group in full)
