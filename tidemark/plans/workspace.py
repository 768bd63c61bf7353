"""The given tables, declared and appended to a lakehouse once per Spark application.

Every table goes in whole. What a query needs is prepared the first time it is asked for
and then shared by the queries that follow.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.indexes import (
    SCALAR_ROWS_PER_FILE,
    build_ivf_index,
    build_scalar_index,
    drop_index,
)
from tidemark.session import run_folder
from tidemark.sources.documents import to_document
from tidemark.sources.lakehouse import Lakehouse, TableState

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

# Rows before this day form the first append of ``orders_in_two``, the others the second.
SPLIT_DAY = "1998-01-01"

_open: dict[tuple[str, str], "Workspace"] = {}


def workspace(spark: SparkSession, sf_dir: str) -> "Workspace":
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _open:
        _open[key] = Workspace(spark, sf_dir)
    return _open[key]


class Workspace:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")
        self.namespace = "lake_" + hashlib.sha256(self.sf_dir.encode()).hexdigest()[:8]
        root = run_folder(spark, "lake")
        self.lake = Lakehouse(spark, root, f"{self.namespace}_catalog")
        self._done: dict[str, object] = {}

    def given(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def table(self, name: str) -> TableState:
        """One given table, declared with its first column required, and appended whole."""
        return self.once(name, lambda: self._load(name))

    def tables(self, names: Sequence[str]) -> list[TableState]:
        """Several tables, a few of them written at a time."""
        with ThreadPoolExecutor(4) as pool:
            return list(pool.map(self.table, names))

    def orders_in_two(self) -> tuple[TableState, TableState]:
        """``orders`` in two appends by day: the states after the first and the second."""
        return self.once("orders_in_two", self._load_orders_in_two)

    def orders_since_index(self) -> TableState:
        """``orders_in_two`` after its second append, with an index of the first state only."""
        return self.once("orders_since_index", self._index_first_orders)

    def embeddings_since_index(self) -> TableState:
        """``embeddings`` in two appends by label, with a vector index of the first state only."""
        return self.once("embeddings_since_index", self._index_first_embeddings)

    def lineitem_by_date(self) -> TableState:
        """``lineitem`` with a scalar index on ship date and part key."""
        return self.once("lineitem_by_date", self._index_lineitem)

    def lineitem_by_both(self) -> TableState:
        """``lineitem`` in an order of ship date and part key alike, with bitsets of order keys."""
        return self.once("lineitem_by_both", self._index_lineitem_both_ways)

    def embeddings_in_lists(self) -> TableState:
        """``embeddings`` with IVF indexes for all distance kinds."""
        return self.once("embeddings_in_lists", self._index_embeddings)

    def supplier_indexes(self) -> TableState:
        """``supplier`` with three indexes published and one of them dropped again."""
        return self.once("supplier_indexes", self._index_supplier)

    def declare(self, table_name: str, rows: DataFrame, **types: str) -> TableState:
        """Create a table for ``rows``; ``types`` replaces document types by column name."""
        document = json.loads(to_document(rows.schema))
        for position, field in enumerate(document["fields"]):
            field["type"] = types.get(field["name"], field["type"])
            field["required"] = position == 0
        return self.lake.create_table(self.namespace, table_name, json.dumps(document))

    def once(self, name: str, prepare):
        if name not in self._done:
            self._done[name] = prepare()
        return self._done[name]

    def _load(self, name: str) -> TableState:
        rows = self.given(name)
        self.declare(name, rows)
        return self.lake.append(self.namespace, name, rows).state

    def _load_orders_in_two(self) -> tuple[TableState, TableState]:
        rows = self.given("orders")
        self.declare("orders_in_two", rows)
        early = F.col("o_orderdate") < F.lit(SPLIT_DAY).cast("timestamp_ntz")
        first = self.lake.append(self.namespace, "orders_in_two", rows.where(early))
        second = self.lake.append(self.namespace, "orders_in_two", rows.where(~early))
        return first.state, second.state

    def _index_first_orders(self) -> TableState:
        first, second = self.orders_in_two()
        build_scalar_index(
            self.lake, self.namespace, "orders_in_two", "by_customer", ["o_custkey"], first.metadata_location
        ).publish()
        return second

    def _index_first_embeddings(self) -> TableState:
        rows = self.given("embeddings")
        self.declare("embeddings_in_two", rows)
        even = F.coalesce(F.col("label") % 2 == 0, F.lit(True))
        address = (self.lake, self.namespace, "embeddings_in_two")
        first = self.lake.append(*address[1:], rows.where(even)).state
        lists = max(4, math.isqrt(first.total_rows))
        build_ivf_index(*address, "lists", "vec_id", "embedding", lists).publish()
        return self.lake.append(*address[1:], rows.where(~even)).state

    def _index_lineitem(self) -> TableState:
        state = self.table("lineitem")
        columns = ["l_shipdate", "l_partkey"]
        build_scalar_index(self.lake, self.namespace, "lineitem", "by_date", columns).publish()
        return state

    def _index_lineitem_both_ways(self) -> TableState:
        state = self.table("lineitem")
        rows_per_file = max(500, state.total_rows // 64)
        build_scalar_index(
            self.lake,
            self.namespace,
            "lineitem",
            "by_both",
            ["l_shipdate", "l_partkey"],
            rows_per_file=min(rows_per_file, SCALAR_ROWS_PER_FILE),
            order="z",
            lookup_columns=["l_orderkey"],
        ).publish()
        return state

    def _index_embeddings(self) -> TableState:
        state = self.table("embeddings")
        lists = max(4, math.isqrt(state.total_rows))
        for metric in ("l2", "cosine", "ip"):
            build_ivf_index(
                self.lake,
                self.namespace,
                "embeddings",
                f"lists_{metric}",
                "vec_id",
                "embedding",
                lists,
                metric=metric,
            ).publish()
        return state

    def _index_supplier(self) -> TableState:
        state = self.table("supplier")
        for name, column in (
            ("by_balance", "s_acctbal"),
            ("by_nation", "s_nationkey"),
            ("by_name", "s_name"),
        ):
            build_scalar_index(self.lake, self.namespace, "supplier", name, [column]).publish()
        drop_index(self.lake, self.namespace, "supplier", "by_nation")
        return state
