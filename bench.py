"""Times the registered queries and prints one JSON line.

``BENCH_SF_DIR`` names the data, ``BENCH_CPUS`` the number of local cores.
Tables are loaded and indexes built first, each timed under its own name; every query is
then run once untimed and timed on its second run, with all of its rows produced.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import vector_topk, vector_topk_batch
from tidemark.plans.queries import QUERIES, first_vector
from tidemark.plans.workspace import TABLES, workspace


def session(cpus: str) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def run(rows: DataFrame) -> None:
    rows.write.format("noop").mode("overwrite").save()


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return round(time.perf_counter() - start, 3)


def nearest_to(spark: SparkSession, sf_dir: str, count: int) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    if count == 1:
        return vector_topk(vectors, first_vector(spark, sf_dir), 10, "l2", "vec_id", "embedding")
    queries = vectors.where(F.col("vec_id") < count).select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector")
    )
    return vector_topk_batch(vectors, queries, 10, "l2", "vec_id", "embedding")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    space = workspace(spark, sf_dir)
    times = {
        "load_tables": timed(lambda: space.tables(TABLES)),
        "load_orders_in_two": timed(space.orders_in_two),
        "build_scalar_index": timed(space.lineitem_by_date),
        "build_z_order_index": timed(space.lineitem_by_both),
        "build_ivf_indexes": timed(space.embeddings_in_lists),
        "build_indexes_of_first_states": timed(
            lambda: (space.orders_since_index(), space.embeddings_since_index())
        ),
        "build_and_drop_indexes": timed(space.supplier_indexes),
    }
    jobs = {name: (lambda q=query: run(q(spark, sf_dir))) for name, query in QUERIES.items()}
    for count in (1, 100, 500):
        jobs[f"baseline_topk_{count}"] = lambda n=count: nearest_to(spark, sf_dir, n).collect()
    only = set(sys.argv[1:])
    for name, job in jobs.items():
        if not only or name in only:
            job()
            times[name] = timed(job)
    print(
        json.dumps(
            {
                "metric": "total query time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
