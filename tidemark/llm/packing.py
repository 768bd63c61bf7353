"""Packs documents into sequences of a fixed length by cutting-stock column generation.

A document longer than a sequence is cut into full pieces and one rest. The rests are counted
by length class (``CLASS_TOKENS`` tokens wide). Over that histogram, of fixed size whatever
the corpus, a linear program chooses patterns of classes that fill a sequence: its master is
solved by the revised simplex method, and a knapsack dynamic program prices new patterns
until none helps by more than ``TOLERANCE``. Patterns are used a rounded-down number of times;
the few rests beyond are packed best fit, again by class. Each rest has a rank within its
class, and the ranks of a class are dealt to the patterns that hold it, so every task places
its own rows and only one narrow row per piece is shuffled, to find offsets.

Ids are worked out once and written with the pieces to the shared folder. Ranks are counted
per task of that write and set off by the counts of the tasks before it, so no class, however
common, is numbered by one task. The driver holds the histogram and the patterns, bounded by
the number of classes.

Null texts are empty: one piece that holds just the end id. Repeated rows are documents of
their own, and so are rows of one id or of none. Extra columns are not read. An empty table
gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import batches_of, rows_of
from tidemark.llm.tokens import encoded
from tidemark.session import run_folder

# Width of a length class. A piece is placed as if it were rounded up to it.
CLASS_TOKENS = 16
# The master is left once no pattern can lower the number of sequences by a larger share.
TOLERANCE = 1e-4

PIECE_COLUMNS = (
    "task int, doc_id long, start long, length int, doc_tokens long, class int, task_rank long, "
    "ids_crc32 long, ids binary"
)
PIECE_SCHEMA = pa.schema(
    [
        ("task", pa.int32()),
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int32()),
        ("doc_tokens", pa.int64()),
        ("class", pa.int32()),
        ("task_rank", pa.int64()),
        ("ids_crc32", pa.int64()),
        ("ids", pa.binary()),
    ]
)


# -- the plan: from a histogram to patterns ----------------------------------------


def knapsack(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes within a capacity, by dynamic programming."""
    best, taken = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        fits = np.searchsorted(sizes, room, side="right")
        if fits:
            offers = best[room - sizes[:fits]] + values[:fits]
            pick = int(np.argmax(offers))
            if offers[pick] > best[room] + 1e-12:
                best[room], taken[room] = offers[pick], pick
    pattern, room = np.zeros(len(sizes)), capacity
    while room > 0:
        if taken[room] < 0:
            room -= 1
        else:
            pattern[taken[room]] += 1
            room -= sizes[taken[room]]
    return float(best[capacity]), pattern


def column_generation(
    sizes: np.ndarray, demand: np.ndarray, capacity: int, max_rounds: int = 20_000
) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (columns) and how often each is used, fractional, covering the demand exactly."""
    m = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    inverse, used = np.diag(1 / np.diag(basis)), demand / np.diag(basis)
    for _ in range(max_rounds):
        prices = np.maximum(inverse.sum(0), 0)
        value, pattern = knapsack(prices, sizes, capacity)
        if value <= 1 + 1e-9 or used.sum() - prices @ demand / value <= TOLERANCE * used.sum():
            break
        step = inverse @ pattern
        room = np.where(step > 1e-9, used / np.where(step > 1e-9, step, 1), np.inf)
        leaves = int(np.argmin(room))
        gain = room[leaves]
        used = np.maximum(used - gain * step, 0)
        used[leaves] = gain
        basis[:, leaves] = pattern
        inverse[leaves] /= step[leaves]
        others = np.arange(m) != leaves
        inverse[others] -= np.outer(step[others], inverse[leaves])
    return basis, used


def best_fit(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> list[dict[int, int]]:
    """Bins for what rounding left over: largest first, each where the least room stays."""
    open_bins: list[list[dict[int, int]]] = [[] for _ in range(capacity + 1)]
    for at in np.argsort(-sizes, kind="stable"):
        size = int(sizes[at])
        for _ in range(int(counts[at])):
            room = next((r for r in range(size, capacity) if open_bins[r]), capacity)
            content = open_bins[room].pop() if room < capacity else {}
            content[int(at)] = content.get(int(at), 0) + 1
            open_bins[room - size].append(content)
    return [content for bins in open_bins for content in bins]


def plan_patterns(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """``({class: pieces}, times)`` covering each piece of a class histogram exactly once."""
    if not histogram:
        return []
    sizes = np.array(sorted(histogram), dtype=np.int64)
    demand = np.array([histogram[size] for size in sizes], dtype=np.int64)
    basis, used = column_generation(sizes, demand.astype(float), capacity)
    times = np.floor(used + 1e-7).astype(np.int64)
    basis = np.rint(basis).astype(np.int64)
    left = demand - basis @ times
    for column in np.flatnonzero(times):
        # A pattern that rounding used too often goes back by one.
        while (left[basis[:, column] > 0] < 0).any() and times[column]:
            times[column] -= 1
            left += basis[:, column]
    plan = [
        ({int(sizes[i]): int(basis[i, column]) for i in np.flatnonzero(basis[:, column])}, int(n))
        for column, n in enumerate(times)
        if n
    ]
    rest: dict[tuple, int] = {}
    for content in best_fit(sizes, left, capacity):
        key = tuple(sorted((int(sizes[i]), n) for i, n in content.items()))
        rest[key] = rest.get(key, 0) + 1
    return plan + [(dict(key), n) for key, n in sorted(rest.items())]


def placements(plan: list[tuple[dict[int, int], int]], first_sequence: int) -> list[tuple]:
    """Which ranks of a class go where: (class, from, to, first sequence, per, first slot)."""
    dealt: dict[int, int] = {}
    rows, sequence = [], first_sequence
    for pattern, times in plan:
        slot = 0
        for size in sorted(pattern, reverse=True):
            per, start = pattern[size], dealt.get(size, 0)
            rows.append((size, start, start + per * times, sequence, per, slot))
            dealt[size] = start + per * times
            slot += per
        sequence += times
    return rows


# -- the jobs ----------------------------------------------------------------------


def write_pieces(
    docs: DataFrame, tokenizer_path: str, sequence_tokens: int = 4096, end_id: int = 2
) -> DataFrame:
    """Encodes ``docs`` (doc_id, text), cuts them and writes the pieces with their ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        ranks: dict[int, int] = {}

        def pieces():
            texts = rows_of(batches, "doc_id", "text")
            for (doc_id, _), ids in encoded(texts, tokenizer_path, end_id):
                n = len(ids) // 4
                for start in range(0, n, sequence_tokens):
                    piece = ids[4 * start : 4 * (start + sequence_tokens)]
                    length = len(piece) // 4
                    group = -(-length // CLASS_TOKENS) if length < sequence_tokens else 0
                    rank = ranks.get(group, 0)
                    ranks[group] = rank + 1
                    yield task, doc_id, start, length, n, group, rank, zlib.crc32(piece), piece

        yield from batches_of(pieces(), PIECE_SCHEMA, weight=lambda row: len(row[8]))

    spark = docs.sparkSession
    folder = run_folder(spark, "pieces")
    narrow = docs.select(F.col("doc_id").cast("long"), "text")
    narrow.mapInArrow(cut, PIECE_COLUMNS).write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(PIECE_COLUMNS).parquet(folder)


def assign(pieces: DataFrame, sequence_tokens: int = 4096) -> DataFrame:
    """``pieces`` without their ids, with ``sequence_id`` and ``offset``."""
    spark = pieces.sparkSession
    counts = pieces.groupBy("class", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("class").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "class", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("task_start")
    )
    histogram = {row["class"]: row["n"] for row in counts.groupBy("class").agg(F.sum("n").alias("n")).collect()}
    full = histogram.pop(0, 0)
    plan = plan_patterns(histogram, sequence_tokens // CLASS_TOKENS)
    rows = [(0, 0, full, 0, 1, 0)] + placements(plan, full)
    dealt = spark.createDataFrame(
        rows, "class int, from_rank long, to_rank long, first_sequence long, per int, first_slot int"
    )
    ranked = (
        pieces.drop("ids")
        .join(offsets, ["class", "task"])
        .withColumn("rank", F.col("task_start") + F.col("task_rank"))
    )
    # At most a few rows for each class and pattern, both bounded: small enough to broadcast.
    placed = ranked.join(F.broadcast(dealt), "class").where("rank >= from_rank AND rank < to_rank")
    placed = placed.select(
        "doc_id",
        "start",
        F.col("length").cast("long"),
        "ids_crc32",
        "doc_tokens",
        F.expr("first_sequence + (rank - from_rank) div per").alias("sequence_id"),
        F.expr("first_slot + (rank - from_rank) % per").alias("slot"),
    )
    ahead = Window.partitionBy("sequence_id").orderBy("slot")
    offset = F.sum("length").over(ahead.rowsBetween(Window.unboundedPreceding, -1))
    return placed.withColumn("offset", F.coalesce(offset, F.lit(0))).drop("slot")


def pack(
    docs: DataFrame, tokenizer_path: str, sequence_tokens: int = 4096, end_id: int = 2
) -> DataFrame:
    """One row per piece of every document, and where it lies in which sequence."""
    pieces = write_pieces(docs, tokenizer_path, sequence_tokens, end_id)
    return assign(pieces, sequence_tokens)


def sequences(pieces: DataFrame, assigned: DataFrame) -> DataFrame:
    """The token ids of each sequence, as bytes of little-endian unsigned 32-bit integers.

    Needs ids of documents that occur once; a sequence is bounded, so its pieces may meet.
    """
    whole = assigned.join(pieces.select("doc_id", "start", "ids"), ["doc_id", "start"])
    in_order = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    grouped = whole.groupBy("sequence_id").agg(in_order.alias("parts"), F.sum("length").alias("length"))
    joined = F.aggregate("parts", F.lit(b""), lambda done, part: F.concat(done, part["ids"]))
    return grouped.select("sequence_id", "length", joined.alias("ids"))
