"""SQL for DuckDB that gives what each registered query gives, over the same tables."""

from __future__ import annotations

from tidemark.plans.workspace import SPLIT_DAY

# Columns and document types of the given tables, in column order.
FIELDS: dict[str, dict[str, str]] = {
    "region": {
        "r_regionkey": "int",
        "r_name": "string",
    },
    "nation": {
        "n_nationkey": "int",
        "n_name": "string",
        "n_regionkey": "int",
    },
    "customer": {
        "c_custkey": "long",
        "c_name": "string",
        "c_nationkey": "int",
        "c_acctbal": "double",
        "c_mktsegment": "string",
    },
    "supplier": {
        "s_suppkey": "long",
        "s_name": "string",
        "s_nationkey": "int",
        "s_acctbal": "double",
    },
    "part": {
        "p_partkey": "long",
        "p_name": "string",
        "p_brand": "string",
        "p_type": "string",
        "p_size": "int",
        "p_retailprice": "double",
    },
    "orders": {
        "o_orderkey": "long",
        "o_custkey": "long",
        "o_orderstatus": "string",
        "o_totalprice": "double",
        "o_orderdate": "timestamp",
        "o_orderpriority": "string",
    },
    "lineitem": {
        "l_orderkey": "long",
        "l_partkey": "long",
        "l_suppkey": "long",
        "l_linenumber": "int",
        "l_quantity": "double",
        "l_extendedprice": "double",
        "l_discount": "double",
        "l_tax": "double",
        "l_returnflag": "string",
        "l_linestatus": "string",
        "l_shipdate": "timestamp",
    },
    "events": {
        "event_id": "long",
        "ts": "timestamp",
        "user_id": "long",
        "event_type": "string",
        "value": "double",
        "props": "string",
    },
    "documents": {
        "doc_id": "long",
        "text": "string",
        "lang": "string",
        "source": "string",
        "n_chars": "long",
    },
    "embeddings": {
        "vec_id": "long",
        "embedding": '{"type":"list","element-id":4,"element":"float","element-required":false}',
        "label": "int",
    },
    "pages": {
        "page_id": "long",
        "url": "string",
        "html": "string",
    },
    "benchmark": {
        "item_id": "long",
        "text": "string",
    },
    "labels": {
        "doc_id": "long",
        "quality": "int",
        "toxic": "int",
    },
    "conversations": {
        "conv_id": "long",
        "turn": "long",
        "role": "string",
        "text": "string",
    },
}

_QUERY_VECTOR = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"


def _fields_sql() -> str:
    rows = []
    for table, fields in FIELDS.items():
        for position, (name, kind) in enumerate(fields.items(), start=1):
            rows.append(
                f"SELECT '{table}' AS table_name, '{name}' AS field_name, "
                f"'{kind}' AS field_type, CAST({position} AS BIGINT) AS field_position, "
                f"(SELECT count(*) FROM {table}) AS total_rows"
            )
    return " UNION ALL ".join(rows)


def _topk_sql(measure: str, order: str) -> str:
    return f"""
        WITH measured AS (
            SELECT vec_id, {measure}(embedding::DOUBLE[], {_QUERY_VECTOR}) AS exact
            FROM embeddings
        )
        SELECT vec_id, round(exact, 6) + 0.0 AS distance,
               row_number() OVER (ORDER BY exact {order}, vec_id) AS rank
        FROM measured
        ORDER BY exact {order}, vec_id LIMIT 10
    """


def _batch_sql(measure: str, order: str, asked: str = "TRUE") -> str:
    return f"""
        WITH measured AS (
            SELECT q.vec_id AS query_id, v.vec_id,
                   {measure}(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS exact
            FROM embeddings q CROSS JOIN embeddings v WHERE {asked}
        ), ranked AS (
            SELECT *, row_number() OVER (
                PARTITION BY query_id ORDER BY exact {order}, vec_id) AS rank
            FROM measured
        )
        SELECT query_id, vec_id, round(exact, 6) + 0.0 AS distance, rank
        FROM ranked WHERE rank <= 10
    """


def _frequent_sql(table: str, columns: list[str], k: int) -> str:
    parts = [
        f"""
        SELECT '{name}' AS column_name, CAST({name} AS VARCHAR) AS value, count(*) AS repeats,
               row_number() OVER (ORDER BY count(*) DESC, CAST({name} AS VARCHAR)) AS rank
        FROM {table} WHERE {name} IS NOT NULL GROUP BY {name}
        """
        for name in columns
    ]
    return f"SELECT * FROM ({' UNION ALL '.join(parts)}) AS ranked WHERE rank <= {k}"


def _statistics_sql(table: str = "lineitem") -> str:
    rows = []
    for name in FIELDS[table]:
        rows.append(
            f"SELECT '{name}' AS column_name, count(*) AS row_count, "
            f"count(*) - count({name}) AS null_count, "
            f"CAST(min({name}) AS VARCHAR) AS min_value, "
            f"CAST(max({name}) AS VARCHAR) AS max_value, "
            f"count(DISTINCT {name}) AS distinct_count FROM {table}"
        )
    return " UNION ALL ".join(rows)


_LINES = """
    SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_shipdate
    FROM lineitem
    WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1997-07-01'
      AND (l_partkey < 500 OR (l_returnflag IN ('R', 'A') AND NOT l_quantity <= 30))
"""

# The recall itself cannot be worked out in SQL: that it is reached is what must come out.
_RECALL_SQL = "SELECT count(*) AS queries, TRUE AS recall_reached FROM embeddings WHERE vec_id % 20 = 0"

ORACLES: dict[str, str] = {
    "table_scan": "SELECT * FROM lineitem",
    "field_catalog": _fields_sql(),
    "table_registry": """
        SELECT 'orders_in_two' AS table_name, CAST(2 AS BIGINT) AS snapshot_seq,
               count(*) AS total_rows, true AS metadata_location_set
        FROM orders
    """,
    "table_history": f"""
        WITH halves AS (
            SELECT count(*) FILTER (WHERE o_orderdate < TIMESTAMP '{SPLIT_DAY}') AS early,
                   count(*) AS whole
            FROM orders
        )
        SELECT CAST(0 AS BIGINT) AS snapshot_seq, CAST(0 AS BIGINT) AS added_rows,
               CAST(0 AS BIGINT) AS total_rows
        UNION ALL SELECT 1, early, early FROM halves
        UNION ALL SELECT 2, whole - early, whole FROM halves
    """,
    "snapshot_pinned_scan": f"SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '{SPLIT_DAY}'",
    "conform_write": """
        SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name,
               CAST(c_nationkey AS BIGINT) AS c_nationkey,
               CAST(CAST(c_acctbal AS DECIMAL(12, 2)) AS DOUBLE) AS c_acctbal, c_mktsegment
        FROM customer
    """,
    "conform_rejects": """
        SELECT *, 'c_acctbal: lost in cast' AS problems FROM customer
        WHERE TRY_CAST(c_acctbal AS DECIMAL(5, 2)) IS NULL
    """,
    "conform_rejects_lossy": """
        SELECT l_orderkey, l_linenumber, l_extendedprice, l_shipdate,
               concat_ws('; ',
                   CASE WHEN l_extendedprice <> trunc(l_extendedprice)
                        THEN 'l_extendedprice: lost in cast' END,
                   CASE WHEN l_shipdate <> CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP)
                        THEN 'l_shipdate: lost in cast' END) AS problems
        FROM lineitem
        WHERE l_extendedprice <> trunc(l_extendedprice)
           OR l_shipdate <> CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP)
    """,
    "conform_rejects_required": """
        SELECT d.doc_id, d.lang, d.source, l.quality, 'quality: required is null' AS problems
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
        WHERE l.quality IS NULL
    """,
    "projection_not_null": """
        SELECT c_custkey, c_mktsegment, c_name IS NOT NULL AS name_set FROM customer
    """,
    "filter_eq_and": """
        SELECT * FROM lineitem WHERE l_returnflag = 'A' AND l_linestatus = 'F'
    """,
    "scalar_subquery": """
        SELECT c_custkey, c_name FROM customer
        WHERE c_nationkey = (SELECT n_nationkey FROM nation WHERE n_name = 'NATION_7')
        ORDER BY c_custkey
    """,
    "ordered_scan": """
        SELECT o_orderkey, o_totalprice, o_orderdate FROM orders
        ORDER BY o_totalprice DESC, o_orderkey
    """,
    "scalar_search": _LINES,
    "scalar_search_zone_map": _LINES,
    "scalar_search_text": """
        SELECT p_partkey, p_name, p_brand, p_type FROM part
        WHERE starts_with(p_name, 's') AND p_brand NOT IN ('Brand#1', 'Brand#2')
          AND p_type <> 'ECONOMY' AND p_size IS NOT NULL
    """,
    "scalar_search_z_order": """
        SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_shipdate FROM lineitem
        WHERE l_partkey >= 40 AND l_partkey < 55
    """,
    "scalar_search_lookup": """
        SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_shipdate FROM lineitem
        WHERE l_orderkey = 7 OR (l_orderkey IN (64, 65, 100, 133, 999999999) AND l_partkey IS NOT NULL)
    """,
    "scalar_search_none": """
        SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_shipdate FROM lineitem WHERE FALSE
    """,
    "scalar_search_appended": """
        SELECT o_orderkey, o_custkey, o_orderdate FROM orders
        WHERE o_custkey > 100 AND o_custkey <= 160
    """,
    "vector_topk_appended": _topk_sql("list_distance", "ASC"),
    "vector_topk_batch_appended": _batch_sql("list_distance", "ASC", "q.vec_id % 20 = 0"),
    "vector_topk_l2": _topk_sql("list_distance", "ASC"),
    "vector_topk_ip": _topk_sql("list_inner_product", "DESC"),
    "vector_topk_cosine": _topk_sql("list_cosine_distance", "ASC"),
    "vector_topk_l2_native": _topk_sql("list_distance", "ASC"),
    "vector_topk_batch": _batch_sql("list_distance", "ASC"),
    "vector_topk_batch_ip": _batch_sql("list_inner_product", "DESC"),
    "vector_topk_batch_cosine": _batch_sql("list_cosine_distance", "ASC"),
    "vector_topk_ivf_full": _topk_sql("list_distance", "ASC"),
    "vector_topk_ivf_full_cosine": _topk_sql("list_cosine_distance", "ASC"),
    "index_build_scalar": """
        SELECT count(*) AS row_count,
               min(l_shipdate) AS first_shipdate, max(l_shipdate) AS last_shipdate,
               min(l_partkey) AS lowest_partkey, max(l_partkey) AS highest_partkey,
               count(*) - count(l_partkey) AS null_partkeys
        FROM lineitem
    """,
    "index_build_ivf": """
        SELECT vec_id, CAST(len(embedding) AS INTEGER) AS length,
               round(CAST(embedding[1] AS DOUBLE), 6) + 0.0 AS first_number
        FROM embeddings WHERE embedding IS NOT NULL
    """,
    "index_match": """
        SELECT 'by_date' AS index_name, 'scalar' AS index_type, count(*) AS row_count,
               true AS same_state
        FROM lineitem
    """,
    "index_list": """
        SELECT 'supplier' AS table_name, index_name, 'scalar' AS index_type,
               (SELECT count(*) FROM supplier) AS row_count
        FROM (VALUES ('by_balance'), ('by_name')) AS names(index_name)
    """,
    "column_statistics": _statistics_sql(),
    "column_statistics_approximate": f"""
        SELECT column_name, row_count, null_count, min_value, max_value,
               TRUE AS distinct_within_error
        FROM ({_statistics_sql()}) AS facts
    """,
    "column_statistics_merged": f"""
        SELECT column_name, row_count, null_count, min_value, max_value,
               TRUE AS distinct_within_error
        FROM ({_statistics_sql("orders")}) AS facts
    """,
    "frequent_values": _frequent_sql(
        "lineitem", ["l_returnflag", "l_suppkey", "l_shipdate", "l_quantity", "l_orderkey"], 5
    ),
    "vector_topk_ivf": _topk_sql("list_distance", "ASC"),
    "vector_topk_ivf_cosine": _topk_sql("list_cosine_distance", "ASC"),
    "vector_topk_ivf_ip": _topk_sql("list_inner_product", "DESC"),
    "vector_topk_scan_l2": _topk_sql("list_distance", "ASC"),
    "vector_topk_scan_ip": _topk_sql("list_inner_product", "DESC"),
    "vector_topk_ivf_batch": _batch_sql("list_distance", "ASC", "q.vec_id % 20 = 0"),
    "vector_topk_ivf_batch_cosine": _batch_sql("list_cosine_distance", "ASC", "q.vec_id % 20 = 0"),
    "vector_topk_ivf_batch_ip": _batch_sql("list_inner_product", "DESC", "q.vec_id % 20 = 0"),
    "vector_topk_ivf_lists": """
        SELECT CAST(count(*) AS BIGINT) AS row_count, TRUE AS enough_is_read FROM embeddings
    """,
    "vector_topk_ivf_recall": _RECALL_SQL,
    "vector_topk_ivf_recall_cosine": _RECALL_SQL,
    "column_statistics_vectors": """
        SELECT 'embedding' AS column_name, count(*) AS row_count,
               count(*) - count(embedding) AS null_count,
               round(avg(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 6)
                   + 0.0 AS mean_norm
        FROM embeddings
    """,
}
