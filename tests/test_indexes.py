import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.plans.queries import QUERIES
from tidemark.functions.distances import VectorError
from tidemark.operators import (
    build_ivf_index,
    build_scalar_index,
    drop_index,
    list_indexes,
    match_index,
    probed_lists,
    search_scalar,
    search_vector,
    search_vector_batch,
    vector_topk,
    vector_topk_batch,
)
from tidemark.operators.indexes import IndexBuildError
from tidemark.operators.searches import IndexNotUsable
from tidemark.sources import to_document


def plan_text(frame):
    spark = frame.sparkSession
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return frame._jdf.queryExecution().explainString(mode)


def loaded(lake, namespace, name, frame):
    lake.create_table(namespace, name, to_document(frame.schema))
    return lake.append(namespace, name, frame).state


def skewed(spark, count=4000):
    """A third of all rows hold the value 500; they are copies of each other but for the id."""
    hot = F.col("id") % 3 == 0
    return spark.range(count).select(
        "id", F.when(hot, F.lit(500)).otherwise(F.col("id") % 1000).cast("int").alias("n")
    )


def test_a_hot_value_is_cut_into_several_zones_of_like_size(spark, lake, namespace):
    frame = skewed(spark)
    state = loaded(lake, namespace, "t", frame)
    staged = build_scalar_index(lake, namespace, "t", "by_n", ["n"], rows_per_file=200)
    assert (staged.event["row_count"], staged.event["partition_count"]) == (4000, 20)
    assert staged.event["largest_partition_rows"] < 2 * 200
    zones = spark.read.parquet(f"{staged.event['index_path']}/zones")
    assert zones.where("min_n = 500 AND max_n = 500").count() >= 4
    staged.publish()
    node = json.dumps({"type": "eq", "term": "n", "value": 500})
    found = search_scalar(lake, namespace, "t", state.metadata_location, "by_n", node)
    assert sorted(map(tuple, found.collect())) == sorted(
        map(tuple, frame.where("n = 500").collect())
    )


def test_rows_that_are_all_alike_are_spread_as_well(spark, lake, namespace):
    loaded(lake, namespace, "t", spark.range(2000).select(F.lit(1).alias("n")))
    staged = build_scalar_index(lake, namespace, "t", "by_n", ["n"], rows_per_file=100)
    assert staged.event["row_count"] == 2000
    assert staged.event["largest_partition_rows"] < 300


def test_a_selective_search_opens_only_the_zones_that_may_match(spark, lake, namespace):
    state = loaded(lake, namespace, "t", spark.range(1000).select("id", (-F.col("id")).alias("m")))
    build_scalar_index(lake, namespace, "t", "by_id", ["id"], rows_per_file=50).publish()
    node = json.dumps({"type": "lt", "term": "id", "value": 20})
    found = search_scalar(lake, namespace, "t", state.metadata_location, "by_id", node, ["m"])
    text = plan_text(found)
    assert "PartitionFilters: [isnotnull(zone_id" in text and "zone_id" in text
    assert "PushedFilters: [IsNotNull(id), LessThan(id,20)]" in text
    assert "ReadSchema: struct<id:bigint,m:bigint>" in text
    assert len(found.inputFiles()) <= 20
    assert sorted(row["m"] for row in found.collect()) == list(range(-19, 1))
    touched = found.select(F.col("m")).rdd.getNumPartitions()
    assert touched <= 2


def test_zones_follow_the_number_of_rows(spark, lake, namespace):
    frame = skewed(spark, 900)
    state = loaded(lake, namespace, "t", frame)
    staged = build_scalar_index(lake, namespace, "t", "by_n", ["n"], rows_per_file=50)
    assert 8 < staged.event["partition_count"] <= 18 and staged.event["row_count"] == 900
    staged.publish()
    node = json.dumps({"type": "gt", "term": "n", "value": 300})
    found = search_scalar(lake, namespace, "t", state.metadata_location, "by_n", node)
    assert sorted(map(tuple, found.collect())) == sorted(
        map(tuple, frame.where("n > 300").collect())
    )


def test_an_empty_table_can_be_indexed(spark, lake, namespace):
    frame = spark.createDataFrame([], "id long, v array<float>")
    state = loaded(lake, namespace, "t", frame)
    build_scalar_index(lake, namespace, "t", "by_id", ["id"]).publish()
    found = search_scalar(lake, namespace, "t", state.metadata_location, "by_id", "true")
    assert found.count() == 0
    with pytest.raises(IndexBuildError, match="train"):
        build_ivf_index(lake, namespace, "t", "lists", "id", "v", 4)


def test_registry_staging_matching_listing_and_dropping(spark, lake, namespace):
    first = loaded(lake, namespace, "t", spark.range(100).toDF("id"))
    staged = build_scalar_index(lake, namespace, "t", "by_id", ["id"])
    names = lambda: [
        row["index_name"]
        for row in list_indexes(lake).where(F.col("namespace") == namespace).collect()
    ]
    match = lambda state, name=None: [
        json.loads(row["index_json"])
        for row in match_index(lake, namespace, "t", state.metadata_location, name).collect()
    ]
    assert names() == [] and match(first) == []
    staged.publish()
    assert names() == ["by_id"]
    assert [found["index_name"] for found in match(first)] == ["by_id"]
    assert match(first, "other") == []

    second = lake.append(namespace, "t", spark.range(100, 130).toDF("id")).state
    # An index of an earlier state serves a later one, together with the rows appended since.
    assert [found["metadata_location"] for found in match(second)] == [first.metadata_location]
    node = json.dumps({"type": "gt-eq", "term": "id", "value": 95})
    later = search_scalar(lake, namespace, "t", second.metadata_location, "by_id", node)
    assert sorted(row["id"] for row in later.collect()) == list(range(95, 130))
    text = plan_text(later)
    assert "zone_id" in text and "snapshot_seq=2" in text and "snapshot_seq=1" not in text
    only_second = build_scalar_index(lake, namespace, "t", "later", ["id"])
    only_second.publish()
    with pytest.raises(IndexNotUsable):
        search_scalar(lake, namespace, "t", first.metadata_location, "later", node)
    scanned = search_scalar(
        lake, namespace, "t", first.metadata_location, "later", node, allow_scan=True
    )
    assert scanned.count() == 5 and "zone_id" not in plan_text(scanned)
    drop_index(lake, namespace, "t", "later")

    build_scalar_index(lake, namespace, "t", "newer", ["id"]).publish()
    assert [found["index_name"] for found in match(second)] == ["newer"]
    drop_index(lake, namespace, "t", "by_id")
    assert names() == ["newer"] and match(first) == []
    with pytest.raises(LookupError):
        drop_index(lake, namespace, "t", "by_id")
    build_scalar_index(lake, namespace, "t", "by_id", ["id"]).publish()
    assert sorted(names()) == ["by_id", "newer"]
    assert [found["index_name"] for found in match(second)] == ["by_id"]


def test_faulty_builds_are_refused(spark, lake, namespace):
    frame = spark.createDataFrame([(1, [1.0])], "id long, v array<float>")
    loaded(lake, namespace, "t", frame)
    for columns in (["v"], ["absent"], []):
        with pytest.raises(IndexBuildError):
            build_scalar_index(lake, namespace, "t", "i", columns)
    with pytest.raises(IndexBuildError, match="hamming"):
        build_ivf_index(lake, namespace, "t", "i", "id", "v", 1, metric="hamming")
    with pytest.raises(IndexBuildError):
        build_ivf_index(lake, namespace, "t", "i", "id", "v", 0)


@pytest.fixture(scope="module")
def embeddings(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_probing_every_list_gives_the_exact_result_and_recall_grows(
    spark, lake, namespace, embeddings, metric
):
    state = loaded(lake, namespace, "e", embeddings)
    build_ivf_index(
        lake, namespace, "e", "lists", "vec_id", "embedding", 16, metric=metric
    ).publish()
    recall = {}
    for number in (0, 123):
        query = list(embeddings.where(F.col("vec_id") == number).first()["embedding"])
        exact = vector_topk(embeddings, query, 10, metric, "vec_id", "embedding").collect()
        for nprobe in (1, 8, 16, 99):
            found = search_vector(
                lake,
                namespace,
                "e",
                state.metadata_location,
                "lists",
                query,
                10,
                metric,
                json.dumps({"nprobe": nprobe}),
            )
            if nprobe < 16:
                assert "PartitionFilters: [" in plan_text(found) and "list_id" in plan_text(found)
            rows = found.collect()
            if nprobe >= 16:
                assert rows == exact
            hits = {r["vec_id"] for r in rows} & {r["vec_id"] for r in exact}
            recall[nprobe] = recall.get(nprobe, 0) + len(hits)
    assert recall[1] <= recall[8] <= recall[16] == recall[99] == 20
    print(f"recall@10 by nprobe, {metric}:", {n: hits / 20 for n, hits in recall.items()})


def clustered(spark, count=6000, length=8):
    """Vectors around thirty far centres; a third of them are copies of one."""
    rng = random.Random(6)
    centres = [[rng.gauss(0, 50) for _ in range(length)] for _ in range(30)]
    rows = []
    for i in range(count):
        centre = centres[0] if i % 3 == 0 else [x + rng.gauss(0, 1) for x in centres[i % 30]]
        rows.append((i, [float(x) for x in centre]))
    return rows


@pytest.mark.parametrize("metric", ["l2", "cosine", "ip"])
def test_the_search_by_radii_is_exact_and_leaves_lists_out(spark, lake, namespace, metric):
    rows = clustered(spark)
    rows += [(10_000, None), (10_001, [0.0] * 8), (10_002, [float("nan")] * 8), (10_003, [1e200] * 8)]
    frame = spark.createDataFrame(rows, "id long, v array<double>")
    state = loaded(lake, namespace, "t", frame)
    build_ivf_index(lake, namespace, "t", "lists", "id", "v", 30, metric=metric).publish()
    located = (lake, namespace, "t", state.metadata_location, "lists")
    shares = []
    for number in (1, 3, 8):
        query = [x + 0.25 for x in rows[number][1]]
        exact = vector_topk(frame, query, 5, metric, "id", "v").collect()
        assert search_vector(*located, query, 5, metric).collect() == exact
        lists = probed_lists(*located, query, 5).collect()
        read = sum(row["row_count"] for row in lists if row["is_read"])
        assert {row["row_count"] for row in lists} and sum(row["row_count"] for row in lists) == 6003
        shares.append(read / 6003)
    if metric != "ip":
        assert sum(shares) / 3 < 0.6, shares
    # With more rows asked for than have a distance, every list is read.
    exact = vector_topk(frame, [1.0] * 8, 6003, metric, "id", "v").collect()
    assert search_vector(*located, [1.0] * 8, 6003, metric).collect() == exact
    if metric == "cosine":
        exact = vector_topk(frame, [0.0] * 8, 4, metric, "id", "v").collect()
        assert search_vector(*located, [0.0] * 8, 4, metric).collect() == exact


@pytest.mark.parametrize("metric", ["l2", "cosine", "ip"])
def test_many_queries_through_an_index_give_what_a_scan_gives(spark, lake, namespace, metric):
    rows = clustered(spark, 1500) + [(10_001, [0.0] * 8), (10_002, [float("nan")] * 8), (10_003, None)]
    frame = spark.createDataFrame(rows, "id long, v array<double>")
    state = loaded(lake, namespace, "t", frame)
    build_ivf_index(lake, namespace, "t", "lists", "id", "v", 20, metric=metric).publish()
    queries = frame.where("id % 50 = 0 OR id = 10001 OR id = 10003").toDF("query_id", "query_vector")
    found = search_vector_batch(
        lake, namespace, "t", state.metadata_location, "lists", queries, 4, metric
    )
    wanted = vector_topk_batch(frame, queries, 4, metric, "id", "v")
    assert found.columns == wanted.columns
    assert sorted(found.collect()) == sorted(wanted.collect())
    with pytest.raises(IndexNotUsable):
        search_vector_batch(lake, namespace, "t", None, "absent", queries, 4, metric)


@pytest.mark.parametrize("metric", ["l2", "cosine", "ip"])
def test_vectors_appended_after_an_index_are_found(spark, lake, namespace, metric):
    rows = clustered(spark, 900)
    frame = spark.createDataFrame(rows, "id long, v array<double>")
    loaded(lake, namespace, "t", frame.where("id < 600"))
    build_ivf_index(lake, namespace, "t", "lists", "id", "v", 12, metric=metric).publish()
    lake.append(namespace, "t", frame.where("id >= 600 AND id < 800"))
    state = lake.append(namespace, "t", frame.where("id >= 800")).state
    located = (lake, namespace, "t", state.metadata_location, "lists")
    for number in (1, 700, 850):
        query = rows[number][1]
        exact = vector_topk(frame, query, 6, metric, "id", "v").collect()
        assert search_vector(*located, query, 6, metric).collect() == exact
    queries = frame.where("id % 40 = 0").toDF("query_id", "query_vector")
    found = search_vector_batch(*located, queries, 3, metric)
    assert sorted(found.collect()) == sorted(vector_topk_batch(frame, queries, 3, metric, "id", "v").collect())


def test_fewer_lists_find_less(spark, sf_dir, lake, namespace, embeddings):
    recall = QUERIES["vector_topk_ivf_recall"]
    assert recall(spark, sf_dir).first()["recall_reached"]
    state = loaded(lake, namespace, "e", embeddings)
    build_ivf_index(lake, namespace, "e", "lists", "vec_id", "embedding", 22).publish()
    hits = {1: 0, 11: 0}
    for row in embeddings.where("vec_id % 100 = 0").collect():
        exact = vector_topk(embeddings, row["embedding"], 10, "l2", "vec_id", "embedding")
        wanted = {r["vec_id"] for r in exact.collect()}
        for nprobe in hits:
            found = search_vector(
                lake, namespace, "e", state.metadata_location, "lists", row["embedding"], 10, "l2",
                json.dumps({"nprobe": nprobe}),
            )
            hits[nprobe] += len(wanted & {r["vec_id"] for r in found.collect()})
    assert hits[1] < hits[11] and hits[11] >= 40


def test_every_vector_lies_in_the_list_of_its_nearest_centroid(spark, lake, namespace, embeddings):
    loaded(lake, namespace, "e", embeddings)
    staged = build_ivf_index(lake, namespace, "e", "lists", "vec_id", "embedding", 12)
    path = staged.event["index_path"]
    centroids = spark.read.parquet(f"{path}/lists").collect()
    rows = spark.read.parquet(f"{path}/rows").collect()
    assert len(rows) == embeddings.count() == staged.event["row_count"]
    for row in random.Random(2).sample(rows, 60):
        distances = {
            c["list_id"]: sum((a - b) ** 2 for a, b in zip(row["embedding"], c["centroid"]))
            for c in centroids
        }
        assert min(distances, key=lambda n: (distances[n], n)) == row["list_id"]
    sizes = {c["list_id"]: c["row_count"] for c in centroids}
    counted = {}
    for row in rows:
        counted[row["list_id"]] = counted.get(row["list_id"], 0) + 1
    assert {n: size for n, size in sizes.items() if size} == counted


def test_a_list_of_copies_is_spread_over_tasks(spark, lake, namespace, embeddings):
    """A third of all vectors are one vector; its list is written by a third of the tasks."""
    hot = spark.range(10_000, 10_250).select(
        F.col("id").alias("vec_id"),
        F.array(*[F.lit(3.0).cast("float")] * 64).alias("embedding"),
        F.lit(0).alias("label"),
    )
    frame = embeddings.union(hot)
    state = loaded(lake, namespace, "e", frame)
    staged = build_ivf_index(lake, namespace, "e", "lists", "vec_id", "embedding", 8)
    assert staged.event["row_count"] == 750
    rows = spark.read.parquet(f"{staged.event['index_path']}/rows")
    per_file = rows.groupBy("list_id", F.col("_metadata.file_path").alias("file")).count()
    biggest = per_file.groupBy("list_id").agg(F.sum("count").alias("n"), F.count("*").alias("f"))
    top = biggest.orderBy(F.desc("n")).first()
    assert top["n"] >= 250 and top["f"] >= 3
    staged.publish()
    found = search_vector(
        lake,
        namespace,
        "e",
        state.metadata_location,
        "lists",
        [3.0] * 64,
        4,
        "l2",
        '{"nprobe": 1}',
    )
    assert [(r["vec_id"], r["distance"]) for r in found.orderBy("rank").collect()] == [
        (10_000 + n, 0.0) for n in range(4)
    ]


def test_zero_and_null_vectors_in_a_cosine_index(spark, lake, namespace):
    rows = [(i, [float(i % 5 + 1), float(i % 3)]) for i in range(40)]
    rows += [(99, [float("nan"), 1.0]), (100, [0.0, 0.0]), (101, None)]
    frame = spark.createDataFrame(rows, "id long, v array<float>")
    state = loaded(lake, namespace, "t", frame)
    staged = build_ivf_index(lake, namespace, "t", "lists", "id", "v", 3, metric="cosine")
    assert staged.event["row_count"] == 42
    staged.publish()
    found = search_vector(
        lake, namespace, "t", state.metadata_location, "lists", [1.0, 1.0], 50, "cosine",
        '{"nprobe": 3}',
    ).orderBy("rank").collect()
    assert len(found) == 42
    assert [(row["id"], row["distance"]) for row in found[-2:]] == [(99, None), (100, None)]
    centroids = spark.read.parquet(f"{staged.event['index_path']}/lists")
    assert centroids.where("exists(centroid, x -> isnan(x))").count() == 0
    assert found == vector_topk(frame, [1.0, 1.0], 50, "cosine", "id", "v").orderBy("rank").collect()


def test_requests_an_index_cannot_answer_scan_the_table(spark, lake, namespace, embeddings):
    state = loaded(lake, namespace, "e", embeddings)
    build_ivf_index(lake, namespace, "e", "lists", "vec_id", "embedding", 4).publish()
    query = [0.5] * 64
    for metric, name in (("ip", "lists"), ("cosine", "lists"), ("l2", "absent"), ("l2", None)):
        found = search_vector(
            lake, namespace, "e", state.metadata_location, name, query, 5, metric,
            '{"allow_scan": true}',
        )
        assert "list_id" not in plan_text(found)
        exact = vector_topk(embeddings, query, 5, metric, "vec_id", "embedding")
        assert found.collect() == exact.collect()
    for name in ("absent", "lists"):
        with pytest.raises(IndexNotUsable):
            search_vector(lake, namespace, "e", None, name, query, 5, "ip")
    for nprobe in (0, -1, 1.5, True):
        with pytest.raises(VectorError):
            search_vector(
                lake, namespace, "e", None, "lists", query, 5, "l2", json.dumps({"nprobe": nprobe})
            )


def test_training_takes_a_sample_only_where_asked(spark, lake, namespace, embeddings):
    state = loaded(lake, namespace, "e", embeddings)
    staged = build_ivf_index(
        lake, namespace, "e", "lists", "vec_id", "embedding", 5, training_vectors=100
    )
    assert staged.event["row_count"] == state.total_rows


def test_a_search_that_probes_a_small_list_still_finds_k_rows(spark, lake, namespace):
    far = [(0, [100.0, 100.0])]
    near = [(i, [float(i % 7), float(i % 5)]) for i in range(1, 400)]
    state = loaded(lake, namespace, "t", spark.createDataFrame(far + near, "id long, v array<float>"))
    build_ivf_index(lake, namespace, "t", "lists", "id", "v", 6).publish()
    found = search_vector(
        lake, namespace, "t", state.metadata_location, "lists", [100.0, 100.0], 10, "l2", '{"nprobe": 1}'
    ).collect()
    assert [row["rank"] for row in found] == list(range(1, 11)) and found[0]["id"] == 0


def test_training_leaves_the_distances_between_centroids_off_the_driver(spark, lake, namespace):
    frame = spark.range(600).selectExpr(
        "id", "transform(sequence(1, 64), i -> CAST(pmod(xxhash64(id, i), 1000) AS FLOAT)) AS v"
    )
    loaded(lake, namespace, "t", frame)
    context, group = spark.sparkContext, f"build {namespace}"
    context.setJobGroup(group, "lists")
    build_ivf_index(lake, namespace, "t", "lists", "id", "v", 200, max_iterations=3).publish()
    tracker = context.statusTracker()
    stages = [at for job in tracker.getJobIdsForGroup(group) for at in tracker.getJobInfo(job).stageIds]
    names = [found.name for found in map(tracker.getStageInfo, stages) if found]
    assert any("KMeans" in name for name in names)
    assert not any("DistanceMeasure" in name for name in names)


def test_building_zones_shuffles_and_writes_little_beside_the_rows(spark, lake, namespace):
    frame = spark.range(0, 200_000, 1, 4).selectExpr("id % 50 AS a", "CAST(id % 1000 AS INT) AS b")
    state = loaded(lake, namespace, "t", frame)
    context, group = spark.sparkContext, f"zones {namespace}"
    context.setJobGroup(group, "zones")
    index = build_scalar_index(lake, namespace, "t", "by_a", ["a"], rows_per_file=20_000).publish()
    tracker = context.statusTracker()
    store = context._jsc.sc().statusStore()
    stages = [at for job in tracker.getJobIdsForGroup(group) for at in tracker.getJobInfo(job).stageIds]
    done = [store.lastStageAttempt(at) for at in stages]
    shuffled = sum(stage.shuffleWriteBytes() for stage in done if str(stage.status()) == "COMPLETE")
    # With eight bytes of a hash for each row it would be 17 a row.
    assert shuffled < 15 * 200_000, shuffled
    # One value of a few still spans several zones, none of them much too large.
    assert index["row_count"] == 200_000 and index["largest_partition_rows"] <= 2 * 20_000
    files = spark.read.parquet(f"{index['index_path']}/rows").inputFiles()
    assert files and all(".zstd." in name for name in files)
    node = json.dumps({"type": "eq", "term": "a", "value": 7})
    found = search_scalar(lake, namespace, "t", state.metadata_location, "by_a", node)
    assert found.count() == 4_000
