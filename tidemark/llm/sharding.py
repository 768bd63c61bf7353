"""Puts documents into shards of near-equal bytes by Karmarkar-Karp differencing.

Documents of equal text stay together. Their groups are the numbers to be parted: the two
partial partitions of largest spread are combined again and again, the largest shard of one
with the smallest of the other, until one is left.

That is done in steps of the same kind. Groups that hold over ``GIANT_SHARE`` of all
bytes are few by that bound. The others are dealt by hash to tasks; each differences its own
groups into one partial partition and hands up its shards' sums. These are differenced again as a
tree, ``FAN`` partitions at a time, at its root together with the giants.
Documents then look their shard up by hash. Slots are numbered within buckets of a shard and
set off by the counts of the buckets before, so no shard is sorted by one task.

A text that fills a third of the table is one group by the rule, counted by map-side sums; its
rows are split when they are joined. No row is sampled or capped.

Null texts have no bytes, and are one group with the empty ones. Repeated rows are of one
group and each gets its own slot; rows without id are placed like others. Extra columns are
not read. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialise, tasks_for, text_of

# Groups above this share of all bytes are parted one by one: there are fewer than 1/share.
GIANT_SHARE = 1 / 65536
# Groups that one task differences.
TASK_GROUPS = 200_000
# Partial partitions that one task of the tree differences.
FAN = 64
# Buckets within a shard in which slots are counted, for each so many documents.
BUCKET_ROWS = 500_000

LAW = "bytes"


def difference(sizes: list[int], shards: int) -> tuple[np.ndarray, list[int]]:
    """The shard of each number by largest differencing, and the shards' sums.

    A node of the tree of combinations keeps, for each of its shards, which shard of its two
    parts went there; the way from the root down then tells where every number went.
    """
    if not sizes:
        return np.zeros(0, np.int32), [0] * shards
    heap, children = [], {}
    for at, size in enumerate(sizes):
        heap.append((-size, at, (size,) + (0,) * (shards - 1)))
    heapq.heapify(heap)
    n = len(sizes)
    names = n
    while len(heap) > 1:
        _, left, a = heapq.heappop(heap)
        _, right, b = heapq.heappop(heap)
        sums = [x + y for x, y in zip(a, reversed(b))]
        order = sorted(range(shards), key=sums.__getitem__, reverse=True)
        least = sums[order[-1]]
        both = tuple([sums[i] - least for i in order])
        children[names] = (left, right, order)
        heapq.heappush(heap, (-both[0], names, both))
        names += 1
    shard_of = np.zeros(n, np.int32)
    # For each node: which final shard each of its own shards (ordered by sum) has become.
    places = {heap[0][1]: list(range(shards))}
    for node in range(names - 1, n - 1, -1):
        left, right, order = children.pop(node)
        to = places.pop(node)
        left_to, right_to = [0] * shards, [0] * shards
        for rank, i in enumerate(order):
            left_to[i] = to[rank]
            right_to[shards - 1 - i] = to[rank]
        places[left], places[right] = left_to, right_to
    for at in range(n):
        shard_of[at] = places[at][0]
    totals = [0] * shards
    for size, shard in zip(sizes, shard_of):
        totals[shard] += size
    return shard_of, totals



def place_groups(groups: DataFrame, shards: int, n_groups: int, n_bytes: int) -> DataFrame:
    """(group, size) with the shard of each group."""
    giant = F.col("group_size") > max(1, int(n_bytes * GIANT_SHARE))
    tasks = tasks_for(n_groups, TASK_GROUPS)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [batch for batch in batches if batch.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        shard_of, _ = difference(table.column("group_size").to_pylist(), shards)
        part = pa.array(np.full(len(table), TaskContext.get().partitionId(), np.int32))
        out = table.append_column("part", part).append_column("bin", pa.array(shard_of))
        yield from out.combine_chunks().to_batches(max_chunksize=10_000)

    schema = "group_hash long, group_crc long, group_size long, part int, bin int"
    small = groups.where(~giant).repartition(tasks, "group_hash").mapInArrow(partial, schema)
    large = groups.where(giant).select(
        "*", F.lit(-1).alias("part"), F.lit(None).cast("int").alias("bin")
    )
    parted = materialise(small.unionByName(large), "partial-partitions")

    small = parted.where("part >= 0")
    giants = parted.where("part < 0")
    sums = small.groupBy("part", "bin").agg(F.sum("group_size").alias("group_size"))
    # Where the shards of each task's own partition have gone so far.
    way = small.select("part", "bin", F.col("part").alias("at_part"), F.col("bin").alias("at_bin")).distinct()
    parts = (parted.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        is_last = parts <= FAN
        none = F.lit(None).cast("long")
        nodes = sums.select(none.alias("group_hash"), none.alias("group_crc"), "group_size", "part", "bin")
        nodes = nodes.unionByName(giants) if is_last else nodes
        above = F.floor(F.greatest("part", F.lit(0)) / FAN).cast("int").alias("parent")
        merged = nodes.select("*", above).groupBy("parent").applyInArrow(
            _merge(shards), schema + ", parent int, shard int"
        )
        merged = materialise(merged, "merged-partitions")
        step = merged.where("part >= 0").select(
            F.col("part").alias("at_part"), F.col("bin").alias("at_bin"), "parent", "shard"
        )
        way = way.join(step, ["at_part", "at_bin"]).select(
            "part", "bin", F.col("parent").alias("at_part"), F.col("shard").alias("at_bin")
        )
        if is_last:
            break
        sums = merged.groupBy(F.col("parent").alias("part"), F.col("shard").alias("bin")).agg(
            F.sum("group_size").alias("group_size")
        )
        parts = -(-parts // FAN)
    key = ["group_hash", "group_crc", "group_size"]
    return (
        small.join(way, ["part", "bin"])
        .select(*key, F.col("at_bin").alias("shard"))
        .unionByName(merged.where("part < 0").select(*key, "shard"))
    )


def _merge(shards: int):
    """Partial partitions of a node of the tree, and giants at its root, as one partition."""

    def merge(table: pa.Table) -> pa.Table:
        order = ("part", "bin", "group_hash", "group_crc", "group_size")
        table = table.sort_by([(name, "ascending") for name in order])
        shard_of, _ = difference(table.column("group_size").to_pylist(), shards)
        return table.append_column("shard", pa.array(shard_of))

    return merge


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Every document's size, the CRC-32 of its text, its shard and its slot there."""
    text = text_of()
    slim = materialise(
        docs.select(
            F.col("doc_id").cast("long"),
            (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("group_hash"),
        ),
        "sizes",
    )
    groups = slim.groupBy("group_hash", F.col("text_crc32").alias("group_crc"), F.col("size").alias("one")).agg(
        F.sum("size").alias("group_size")
    )
    groups = materialise(groups.drop("one"), "groups")
    totals = groups.agg(F.count("*"), F.sum("group_size")).first()
    n_groups, n_bytes = totals[0], totals[1] or 0
    placed = place_groups(groups, shards, n_groups, n_bytes)
    joined = slim.join(
        placed.drop("group_size").withColumnRenamed("group_crc", "text_crc32"),
        ["group_hash", "text_crc32"],
    )
    n_rows = slim.count()
    buckets = tasks_for(n_rows, BUCKET_ROWS * shards)
    bucketed = materialise(
        joined.select(
            "doc_id",
            "size",
            "text_crc32",
            "shard",
            F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(buckets)).cast("int").alias("bucket"),
        ),
        "placed",
    )
    counts = bucketed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")
    )
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    numbered = bucketed.withColumn("within", F.row_number().over(inside) - 1)
    return numbered.join(offsets, ["shard", "bucket"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit(LAW).alias("law"),
        "shard",
        (F.col("first") + F.col("within")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
