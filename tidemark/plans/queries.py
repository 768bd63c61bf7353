"""The registered queries. Each reads whole tables and returns a lazy DataFrame."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import (
    column_statistics,
    frequent_values,
    list_indexes,
    match_index,
    merged_statistics,
    probed_lists,
    record_statistics,
    search_scalar,
    search_vector,
    search_vector_batch,
    vector_topk,
    vector_topk_batch,
)
from tidemark.operators.indexes import LIST, index_rows, ivf_schema
from tidemark.plans.workspace import TABLES, workspace
from tidemark.sources import PROBLEMS, conform, to_document, to_struct

Query = Callable[[SparkSession, str], DataFrame]

K = 10
# What the approximate search must find of the exact result, over every so many vectors.
LEAST_RECALL, RECALL_EVERY = 0.9, 20
# Three standard errors of the sketch that counts distinct values, at its usual 5 %.
SKETCH_ERROR = 0.15
# As much of the one that merges over snapshots, rounded up.
MERGED_ERROR = 0.06

# Lines shipped in the first half of 1997 from early parts, or returned in bulk then.
SHIPPED_EARLY_1997 = {
    "type": "and",
    "left": {
        "type": "and",
        "left": {"type": "gt-eq", "term": "l_shipdate", "value": "1997-01-01"},
        "right": {"type": "lt", "term": "l_shipdate", "value": "1997-07-01"},
    },
    "right": {
        "type": "or",
        "left": {"type": "lt", "term": "l_partkey", "value": 500},
        "right": {
            "type": "and",
            "left": {"type": "in", "term": "l_returnflag", "values": ["R", "A"]},
            "right": {
                "type": "not",
                "child": {"type": "lt-eq", "term": "l_quantity", "value": 30},
            },
        },
    },
}
LINE_COLUMNS = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_shipdate"]

# Parts told apart by text: a name prefix, a set of brands, and types left out.
PARTS_BY_TEXT = {
    "type": "and",
    "left": {"type": "starts-with", "term": "p_name", "value": "s"},
    "right": {
        "type": "and",
        "left": {"type": "not-in", "term": "p_brand", "values": ["Brand#1", "Brand#2"]},
        "right": {
            "type": "and",
            "left": {"type": "not-eq", "term": "p_type", "value": "ECONOMY"},
            "right": {"type": "not-null", "term": "p_size"},
        },
    },
}


def rounded(distance: str = "distance") -> Column:
    return (F.round(distance, 6) + F.lit(0.0)).alias("distance")


def first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The query vector of a single search: the embedding with id 0."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return list(rows.where("vec_id = 0").select("embedding").first()[0])


# -- S1-S5: tables and registries -------------------------------------------------


def table_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = workspace(spark, sf_dir)
    space.table("lineitem")
    return spark.sql(f"SELECT * FROM {space.namespace}.lineitem")


def field_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every declared column of every given table, beside the rows its table holds."""
    space = workspace(spark, sf_dir)
    space.tables(TABLES)
    fields, tables = space.lake.table_schemas(), space.lake.tables_internal()
    return (
        fields.join(tables, "table_uuid")
        .where(F.col("table_name").isin(TABLES))
        .select("table_name", "field_name", "field_type", "field_position", "total_rows")
    )


def table_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = workspace(spark, sf_dir)
    space.orders_in_two()
    return spark.sql(
        f"""
        SELECT table_name, snapshot_seq, total_rows,
               metadata_location IS NOT NULL AS metadata_location_set
        FROM {space.lake.catalog_namespace}.tables_internal
        WHERE namespace = '{space.namespace}' AND table_name = 'orders_in_two'
        """
    )


def table_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = workspace(spark, sf_dir)
    space.orders_in_two()
    events = space.lake.table_events().where(F.col("table_name") == "orders_in_two")
    return events.select("snapshot_seq", "added_rows", "total_rows")


def snapshot_pinned_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = workspace(spark, sf_dir)
    first, _ = space.orders_in_two()
    return space.lake.scan(space.namespace, "orders_in_two", first.metadata_location)


def conform_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers declared with other types than they come in, written and read back."""
    space = workspace(spark, sf_dir)

    def write():
        rows = space.given("customer")
        space.declare(
            "customer_retyped",
            rows,
            c_custkey="string",
            c_nationkey="long",
            c_acctbal="decimal(12,2)",
        )
        return space.lake.append(space.namespace, "customer_retyped", rows).state

    state = space.once("customer_retyped", write)
    return space.lake.scan_state(state).withColumn("c_acctbal", F.col("c_acctbal").cast("double"))


def conform_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose balance does not fit the declared decimal(5,2)."""
    rows = workspace(spark, sf_dir).given("customer")
    document = json.loads(to_document(rows.schema))
    for field in document["fields"]:
        field["required"] = True
        if field["name"] == "c_acctbal":
            field["type"] = "decimal(5,2)"
    return _with_problems_as_text(conform(rows, to_struct(document)).rejects)


def conform_rejects_lossy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items whose price or date a whole number or a day cannot hold without loss."""
    rows = workspace(spark, sf_dir).given("lineitem").select(
        "l_orderkey", "l_linenumber", "l_extendedprice", "l_shipdate"
    )
    document = json.loads(to_document(rows.schema))
    types = {"l_extendedprice": "long", "l_shipdate": "date"}
    for field in document["fields"]:
        field["type"] = types.get(field["name"], field["type"])
    return _with_problems_as_text(conform(rows, to_struct(document)).rejects)


def conform_rejects_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that lack the label a table would require."""
    space = workspace(spark, sf_dir)
    labels = space.given("labels").select("doc_id", "quality")
    documents = space.given("documents").select("doc_id", "lang", "source")
    rows = documents.join(labels, "doc_id", "left")
    document = json.loads(to_document(rows.schema))
    for field in document["fields"]:
        field["required"] = True
    return _with_problems_as_text(conform(rows, to_struct(document)).rejects)


def _with_problems_as_text(rejects: DataFrame) -> DataFrame:
    reasons = F.concat_ws("; ", PROBLEMS).alias("problems")
    return rejects.select(*[name for name in rejects.columns if name != PROBLEMS], reasons)


# -- P1-P5, T1: projections, predicates, order ------------------------------------


def projection_not_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = workspace(spark, sf_dir)
    space.table("customer")
    return spark.sql(
        f"""
        SELECT c_custkey, c_mktsegment, c_name IS NOT NULL AS name_set
        FROM {space.namespace}.customer
        """
    )


def filter_eq_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = workspace(spark, sf_dir)
    rows = space.lake.scan_state(space.table("lineitem"))
    return rows.where((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F"))


def scalar_subquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = workspace(spark, sf_dir)
    space.table("customer"), space.table("nation")
    return spark.sql(
        f"""
        SELECT c_custkey, c_name FROM {space.namespace}.customer
        WHERE c_nationkey = (
            SELECT n_nationkey FROM {space.namespace}.nation WHERE n_name = 'NATION_7'
        )
        ORDER BY c_custkey
        """
    )


def ordered_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = workspace(spark, sf_dir)
    rows = space.lake.scan_state(space.table("orders"))
    return rows.select("o_orderkey", "o_totalprice", "o_orderdate").orderBy(
        F.desc("o_totalprice"), "o_orderkey"
    )


def scalar_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = workspace(spark, sf_dir)
    return _search_lines(space, space.table("lineitem").metadata_location, None)


def scalar_search_zone_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = workspace(spark, sf_dir)
    return _search_lines(space, space.lineitem_by_date().metadata_location, "by_date")


def scalar_search_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = workspace(spark, sf_dir)
    location = space.table("part").metadata_location
    columns = ["p_partkey", "p_name", "p_brand", "p_type"]
    return search_scalar(
        space.lake, space.namespace, "part", location, None, json.dumps(PARTS_BY_TEXT), columns
    )


# Orders of a range of customers, whatever their day.
ORDERS_OF_SOME = {
    "type": "and",
    "left": {"type": "gt", "term": "o_custkey", "value": 100},
    "right": {"type": "lt-eq", "term": "o_custkey", "value": 160},
}


# Lines by the second column of an order, and by keys that no order helps to find.
LINES_OF_PARTS = {
    "type": "and",
    "left": {"type": "gt-eq", "term": "l_partkey", "value": 40},
    "right": {"type": "lt", "term": "l_partkey", "value": 55},
}
LINES_OF_ORDERS = {
    "type": "or",
    "left": {"type": "eq", "term": "l_orderkey", "value": 7},
    "right": {
        "type": "and",
        "left": {"type": "in", "term": "l_orderkey", "values": [64, 65, 100, 133, 999_999_999]},
        "right": {"type": "not", "child": {"type": "is-null", "term": "l_partkey"}},
    },
}


def searched_lines(predicate: dict) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        space = workspace(spark, sf_dir)
        state = space.lineitem_by_both()
        return search_scalar(
            space.lake,
            space.namespace,
            "lineitem",
            state.metadata_location,
            "by_both",
            json.dumps(predicate),
            LINE_COLUMNS,
        )

    return query


def scalar_search_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Through an index that is older than half of the rows."""
    space = workspace(spark, sf_dir)
    state = space.orders_since_index()
    return search_scalar(
        space.lake,
        space.namespace,
        "orders_in_two",
        state.metadata_location,
        "by_customer",
        json.dumps(ORDERS_OF_SOME),
        ["o_orderkey", "o_custkey", "o_orderdate"],
    )


def _search_lines(space, location: str, index_name: str | None) -> DataFrame:
    return search_scalar(
        space.lake,
        space.namespace,
        "lineitem",
        location,
        index_name,
        json.dumps(SHIPPED_EARLY_1997),
        LINE_COLUMNS,
    )


# -- T2, T3: vector search ---------------------------------------------------------


def exact_topk(metric: str, form: str = "arrow") -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
        wanted = first_vector(spark, sf_dir)
        found = vector_topk(vectors, wanted, K, metric, "vec_id", "embedding", form)
        return found.select("vec_id", rounded(), "rank")

    return query


def batch_topk(metric: str) -> Query:
    """The nearest of all embeddings to each of all embeddings."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
        queries = vectors.select(
            F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector")
        )
        found = vector_topk_batch(vectors, queries, K, metric, "vec_id", "embedding")
        return found.select("query_id", "vec_id", rounded(), "rank")

    return query


def indexed_topk(metric: str, all_lists: bool) -> Query:
    """The search through lists: all of them, or those that may hold one of the nearest."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        space = workspace(spark, sf_dir)
        state = space.embeddings_in_lists()
        found = search_vector(
            space.lake,
            space.namespace,
            "embeddings",
            state.metadata_location,
            f"lists_{metric}",
            first_vector(spark, sf_dir),
            K,
            metric,
            json.dumps({"nprobe": state.total_rows} if all_lists else {}),
        )
        return found.select("vec_id", rounded(), "rank")

    return query


def scanned_topk(metric: str) -> Query:
    """A search that names an index of another distance kind and allows a scan in its place."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        space = workspace(spark, sf_dir)
        state = space.embeddings_in_lists()
        other = "cosine" if metric == "l2" else "l2"
        found = search_vector(
            space.lake,
            space.namespace,
            "embeddings",
            state.metadata_location,
            f"lists_{other}",
            first_vector(spark, sf_dir),
            K,
            metric,
            '{"allow_scan": true}',
        )
        return found.select("vec_id", rounded(), "rank")

    return query


def vector_topk_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Through an index that is older than half of the vectors."""
    space = workspace(spark, sf_dir)
    state = space.embeddings_since_index()
    wanted = first_vector(spark, sf_dir)
    found = search_vector(
        space.lake, space.namespace, state.table_name, state.metadata_location, "lists", wanted, K
    )
    return found.select("vec_id", rounded(), "rank")


def vector_batch_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = workspace(spark, sf_dir)
    state = space.embeddings_since_index()
    queries = _every_twentieth(spark, sf_dir)
    found = search_vector_batch(
        space.lake, space.namespace, state.table_name, state.metadata_location, "lists", queries, K
    )
    return found.select("query_id", "vec_id", rounded(), "rank")


def lists_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows lie in lists, and whether those that a search reads hold enough of them."""
    space = workspace(spark, sf_dir)
    state = space.embeddings_in_lists()
    lists = probed_lists(
        space.lake,
        space.namespace,
        "embeddings",
        state.metadata_location,
        "lists_l2",
        first_vector(spark, sf_dir),
        K,
    )
    read = F.sum(F.when(F.col("is_read"), F.col("row_count")))
    return lists.agg(F.sum("row_count").alias("row_count"), (read >= K).alias("enough_is_read"))


def _every_twentieth(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return vectors.where(F.col("vec_id") % RECALL_EVERY == 0).select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector")
    )


def indexed_batch(metric: str) -> Query:
    """The nearest to every vector whose id is divisible by ``RECALL_EVERY``, through an index."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        space = workspace(spark, sf_dir)
        state = space.embeddings_in_lists()
        found = search_vector_batch(
            space.lake,
            space.namespace,
            "embeddings",
            state.metadata_location,
            f"lists_{metric}",
            _every_twentieth(spark, sf_dir),
            K,
            metric,
        )
        return found.select("query_id", "vec_id", rounded(), "rank")

    return query


def ivf_recall(metric: str) -> Query:
    """Whether the search through an index finds ``LEAST_RECALL`` of what one without it does."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
        queries = _every_twentieth(spark, sf_dir)
        exact = vector_topk_batch(vectors, queries, K, metric, "vec_id", "embedding")
        found = indexed_batch(metric)(spark, sf_dir).select("query_id", "vec_id", F.lit(1).alias("hit"))
        hits = exact.join(found, ["query_id", "vec_id"], "left")
        return hits.agg(
            F.count_distinct("query_id").alias("queries"),
            (F.count("hit") >= LEAST_RECALL * F.count("*")).alias("recall_reached"),
        )

    return query


# -- I1-I4: index builds, their registry, and statistics -----------------------------


def index_build_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The zone map of ``lineitem`` summed up: its zones hold every row once."""
    space = workspace(spark, sf_dir)
    index = _index(space, space.lineitem_by_date(), "by_date")
    return spark.read.parquet(f"{index['index_path']}/zones").agg(
        F.sum("row_count").alias("row_count"),
        F.min("min_l_shipdate").alias("first_shipdate"),
        F.max("max_l_shipdate").alias("last_shipdate"),
        F.min("min_l_partkey").alias("lowest_partkey"),
        F.max("max_l_partkey").alias("highest_partkey"),
        F.sum("nulls_l_partkey").alias("null_partkeys"),
    )


def index_build_ivf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector of ``embeddings`` as its list holds it."""
    space = workspace(spark, sf_dir)
    state = space.embeddings_in_lists()
    index = _index(space, state, "lists_l2")
    rows = index_rows(space.lake, index["index_path"], ivf_schema(state, *index["columns"]), LIST)
    first = F.round(F.get("embedding", F.lit(0)).cast("double"), 6) + F.lit(0.0)
    return rows.select("vec_id", F.size("embedding").alias("length"), first.alias("first_number"))


def _index(space, state, name: str) -> dict:
    found = match_index(
        space.lake, state.namespace, state.table_name, state.metadata_location, name
    )
    return json.loads(found.first()["index_json"])


def index_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index by date that serves ``lineitem``, by name: other queries add indexes of their own."""
    space = workspace(spark, sf_dir)
    state = space.lineitem_by_date()
    found = match_index(space.lake, space.namespace, "lineitem", state.metadata_location, "by_date")
    part = lambda path: F.get_json_object("index_json", f"$.{path}")
    return found.select(
        part("index_name").alias("index_name"),
        part("index_type").alias("index_type"),
        part("row_count").cast("long").alias("row_count"),
        (part("metadata_location") == state.metadata_location).alias("same_state"),
    )


def index_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two indexes left on ``supplier`` after a third was dropped."""
    space = workspace(spark, sf_dir)
    space.supplier_indexes()
    live = list_indexes(space.lake).where(F.col("table_name") == "supplier")
    return live.select("table_name", "index_name", "index_type", "row_count")


def line_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = workspace(spark, sf_dir)
    rows = space.lake.scan_state(space.table("lineitem"))
    return column_statistics(rows, exact_distinct=True).drop("mean_norm")


def line_statistics_approximate(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = workspace(spark, sf_dir)
    rows = space.lake.scan_state(space.table("lineitem"))
    exact = column_statistics(rows, exact_distinct=True).select(
        F.col("column_name").alias("name"), F.col("distinct_count").alias("exact")
    )
    both = column_statistics(rows).join(exact, F.col("column_name") == F.col("name"))
    off = F.abs(F.col("distinct_count") - F.col("exact"))
    return both.select(
        "column_name",
        "row_count",
        "null_count",
        "min_value",
        "max_value",
        (off <= SKETCH_ERROR * F.col("exact")).alias("distinct_within_error"),
    )


def merged_order_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of the second state of ``orders_in_two`` from those of its snapshots."""
    space = workspace(spark, sf_dir)
    _, second = space.orders_in_two()
    address = (space.lake, space.namespace, "orders_in_two", second.metadata_location)
    space.once("orders_statistics", lambda: record_statistics(*address))
    exact = column_statistics(space.lake.scan_state(second), exact_distinct=True).select(
        F.col("column_name").alias("name"), F.col("distinct_count").alias("exact")
    )
    both = merged_statistics(*address).join(exact, F.col("column_name") == F.col("name"))
    off = F.abs(F.col("distinct_count") - F.col("exact"))
    return both.select(
        "column_name",
        "row_count",
        "null_count",
        "min_value",
        "max_value",
        (off <= MERGED_ERROR * F.col("exact")).alias("distinct_within_error"),
    )


def frequent_line_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = workspace(spark, sf_dir)
    rows = space.lake.scan_state(space.table("lineitem"))
    return frequent_values(rows, ["l_returnflag", "l_suppkey", "l_shipdate", "l_quantity", "l_orderkey"], 5)


def vector_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = workspace(spark, sf_dir)
    rows = space.lake.scan_state(space.table("embeddings"))
    facts = column_statistics(rows).where(F.col("mean_norm").isNotNull())
    norm = (F.round("mean_norm", 6) + F.lit(0.0)).alias("mean_norm")
    return facts.select("column_name", "row_count", "null_count", norm)


QUERIES: dict[str, Query] = {
    "table_scan": table_scan,
    "field_catalog": field_catalog,
    "table_registry": table_registry,
    "table_history": table_history,
    "snapshot_pinned_scan": snapshot_pinned_scan,
    "conform_write": conform_write,
    "conform_rejects": conform_rejects,
    "conform_rejects_lossy": conform_rejects_lossy,
    "conform_rejects_required": conform_rejects_required,
    "projection_not_null": projection_not_null,
    "filter_eq_and": filter_eq_and,
    "scalar_subquery": scalar_subquery,
    "ordered_scan": ordered_scan,
    "scalar_search": scalar_search,
    "scalar_search_zone_map": scalar_search_zone_map,
    "scalar_search_text": scalar_search_text,
    "scalar_search_z_order": searched_lines(LINES_OF_PARTS),
    "scalar_search_lookup": searched_lines(LINES_OF_ORDERS),
    "scalar_search_none": searched_lines({"type": "false"}),
    "scalar_search_appended": scalar_search_appended,
    "vector_topk_l2": exact_topk("l2"),
    "vector_topk_ip": exact_topk("ip"),
    "vector_topk_cosine": exact_topk("cosine"),
    "vector_topk_l2_native": exact_topk("l2", "native"),
    "vector_topk_batch": batch_topk("l2"),
    "vector_topk_batch_ip": batch_topk("ip"),
    "vector_topk_batch_cosine": batch_topk("cosine"),
    "vector_topk_ivf_full": indexed_topk("l2", all_lists=True),
    "vector_topk_ivf_full_cosine": indexed_topk("cosine", all_lists=True),
    "vector_topk_ivf": indexed_topk("l2", all_lists=False),
    "vector_topk_ivf_cosine": indexed_topk("cosine", all_lists=False),
    "vector_topk_ivf_ip": indexed_topk("ip", all_lists=False),
    "vector_topk_ivf_lists": lists_read,
    "vector_topk_ivf_batch": indexed_batch("l2"),
    "vector_topk_ivf_batch_cosine": indexed_batch("cosine"),
    "vector_topk_ivf_batch_ip": indexed_batch("ip"),
    "vector_topk_appended": vector_topk_appended,
    "vector_topk_batch_appended": vector_batch_appended,
    "vector_topk_scan_l2": scanned_topk("l2"),
    "vector_topk_scan_ip": scanned_topk("ip"),
    "vector_topk_ivf_recall": ivf_recall("l2"),
    "vector_topk_ivf_recall_cosine": ivf_recall("cosine"),
    "index_build_scalar": index_build_scalar,
    "index_build_ivf": index_build_ivf,
    "index_match": index_match,
    "index_list": index_list,
    "column_statistics": line_statistics,
    "column_statistics_approximate": line_statistics_approximate,
    "column_statistics_merged": merged_order_statistics,
    "frequent_values": frequent_line_values,
    "column_statistics_vectors": vector_statistics,
}
