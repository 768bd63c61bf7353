"""Removes long byte strings that occur more than once, by induced suffix sorting of shards.

Every byte covered by a string of ``min_bytes`` bytes that also starts elsewhere goes, in the
same document or another. Strings never reach over the end of a document.

Spark decides which suffixes can be equal, and shards are made of those alone:

1. Each start of a ``min_bytes`` string is given an anchor: the place, among the next
   ``SPAN`` ones, whose 16 bytes hash lowest. Equal strings have their anchor at the same
   distance, so their starts meet. Starts that follow each other and have one anchor are a
   block, with a name (the hash of all bytes its strings cover) and a core (the hash of the
   bytes all of them share).
2. Cores that occur once are done with. Of the others, blocks of one name are one block with
   a count: the naming step of induced sorting, done by partial aggregation, so a text copied
   thousands of times is sorted once.
3. Where a core has several names, its blocks are cut from the texts and dealt by core to
   shards. A shard sorts their suffixes: types, the substrings from one left-most S-type
   suffix to the next, their names, the order of the reduced string, and the induction of all
   suffixes from it. Queues of induced suffixes, one per first symbol, spill to a temporary
   file above ``QUEUE_BYTES``. In the order found, neighbours that share ``min_bytes`` mark
   both their starts.
4. A core whose blocks hold more than ``SHARD_BYTES`` (a footer under ever different texts)
   would be too much for one task. Its starts are dealt by core and the hash of their
   ``min_bytes`` bytes, in which equal strings agree, and Spark counts these: no task holds such a
   core.
5. What is marked goes back to every block of that name, and each document's runs are cut.

The core of a block is at least ``min_bytes - SPAN + 1`` bytes, so two texts meet in a shard
only where they share that much. Names, cores and the comparison of neighbours use 64-bit
hashes. The reduced string is ordered by doubling ranks up to ``min_bytes`` symbols.

A null or empty text has no bytes and nothing removed. Repeated rows are copies, each of them
loses what it shares; ids may repeat or be null. Extra columns are kept; result columns
replace columns of the same name. Empty tables are fine.
"""

from __future__ import annotations

import tempfile
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import batches_of, fresh, materialise, rows_of, tasks_for

GRAM, SPAN = 16, 192
# Starts worked on at a time; bytes of blocks in one shard and of queues held in memory.
PIECE, PLACE_BITS = 1 << 20, 21
SHARD_BYTES = 4 << 20
QUEUE_BYTES = 64 << 20

BLOCKS = "row long, first int, n_starts int, core long, name long"
BLOCK_SCHEMA = pa.schema(
    [
        ("row", pa.int64()),
        ("first", pa.int32()),
        ("n_starts", pa.int32()),
        ("core", pa.int64()),
        ("name", pa.int64()),
    ]
)
CUT = "core long, name long, n_starts int, block binary"
CUT_SCHEMA = pa.schema(
    [("core", pa.int64()), ("name", pa.int64()), ("n_starts", pa.int32()), ("block", pa.binary())]
)
STARTS = "core long, name long, start int, hash long"
START_SCHEMA = pa.schema(
    [("core", pa.int64()), ("name", pa.int64()), ("start", pa.int32()), ("hash", pa.int64())]
)
MARKS = "core long, name long, marks array<int>"
MARK_SCHEMA = pa.schema([("core", pa.int64()), ("name", pa.int64()), ("marks", pa.list_(pa.int32()))])

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(value: np.ndarray) -> np.ndarray:
    value = (value ^ value >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    return value ^ value >> np.uint64(29)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_ODD), n, 1 << 64))


def _doubled(hashes: np.ndarray, step: int, times: int) -> np.ndarray:
    """The hash of ``times`` values, each ``step`` places after the one before."""
    found, done, power, n = None, 0, hashes, 1
    while True:
        if times & n:
            if found is None:
                found = power
            else:
                tail = power[done * step :]
                found = found[: len(tail)] * _power(n) + tail[: len(found)]
            done += n
        n *= 2
        if n > times:
            return found
        half = n // 2
        power = power[: -half * step] * _power(half) + power[half * step :]


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the ``GRAM`` bytes from each place."""
    return _mix(_doubled(_mix(data.astype(np.uint64) + _ODD), 1, GRAM))


def window_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the ``size`` bytes from each place."""
    grams = gram_hashes(data)
    whole, rest = divmod(size, GRAM)
    found = _mix(_doubled(grams, GRAM, whole))
    if rest:
        last = grams[size - GRAM :]
        found = _mix(found[: len(last)] * _ODD ^ last)
    return found


def anchors(data: np.ndarray, n_starts: int) -> np.ndarray:
    """The anchor of each of the first ``n_starts`` places: the first of the lowest hashes."""
    keys = gram_hashes(data[: n_starts + SPAN + GRAM - 2])
    # The same for texts of any length, so that equal strings have equal anchors in all of them.
    bits = np.uint64(PLACE_BITS)
    least = keys >> bits << bits | np.arange(len(keys), dtype=np.uint64)
    step = 1
    while 2 * step <= SPAN:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    least = np.minimum(least[: n_starts], least[SPAN - step : SPAN - step + n_starts])
    return (least & (np.uint64(1) << bits) - np.uint64(1)).astype(np.int64)


def blocks_of(data: bytes, min_bytes: int) -> Iterator[tuple[int, int, int, int]]:
    """(first start, starts, core, name) of each block of a text."""
    digest, core_bytes = xxhash.xxh3_64_intdigest, min_bytes - SPAN + 1
    n_all = len(data) - min_bytes + 1
    whole = np.frombuffer(data, np.uint8)
    for at in range(0, max(0, n_all), PIECE):
        n = min(PIECE, n_all - at)
        found = anchors(whole[at:], n)
        firsts = np.concatenate([[0], np.flatnonzero(np.diff(found)) + 1])
        counts = np.diff(np.append(firsts, n))
        for first, count, place in zip(firsts.tolist(), counts.tolist(), found[firsts].tolist()):
            first, place = first + at, place + at
            core = digest(data[place : place + core_bytes])
            name = digest(data[first : first + count - 1 + min_bytes], place - first)
            yield first, count, _signed(core), _signed(name)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


# -- induced sorting of one shard ---------------------------------------------------


class Queues:
    """Queues of places by symbol, first in first out; spilled to a file above a bound."""

    def __init__(self, bound: int = QUEUE_BYTES):
        self.bound, self.held, self.file = bound, 0, None
        self.parts: dict[int, list] = defaultdict(list)

    def push(self, symbols: np.ndarray, places: np.ndarray) -> None:
        if not len(symbols):
            return
        order = np.argsort(symbols, kind="stable")
        symbols, places = symbols[order], places[order]
        cuts = np.flatnonzero(np.diff(symbols)) + 1
        starts = np.concatenate([[0], cuts])
        for start, part in zip(starts.tolist(), np.split(places, cuts)):
            self.parts[int(symbols[start])].append(part)
        self.held += places.nbytes
        if self.held > self.bound:
            self._spill()

    def _spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for held in self.parts.values():
            for at, part in enumerate(held):
                if isinstance(part, np.ndarray):
                    held[at] = (self.file.tell(), len(part))
                    self.file.write(part.tobytes())
        self.held = 0

    def pop(self, symbol: int) -> np.ndarray:
        """All places pushed for a symbol, oldest first."""
        found = []
        for part in self.parts.pop(symbol, []):
            if isinstance(part, tuple):
                self.file.seek(part[0])
                part = np.frombuffer(self.file.read(8 * part[1]), np.int64)
            else:
                self.held -= part.nbytes
            found.append(part)
        return np.concatenate(found) if found else np.zeros(0, np.int64)


def _types(text: np.ndarray) -> np.ndarray:
    """Which suffixes are of type S; the end counts as lower than any symbol."""
    rises = np.zeros(len(text), bool)
    rises[:-1] = text[:-1] < text[1:]
    decided = np.ones(len(text), bool)
    decided[:-1] = text[:-1] != text[1:]
    after = np.where(decided, np.arange(len(text)), len(text))
    after = np.minimum.accumulate(after[::-1])[::-1]
    return rises[after]


def induce(text: np.ndarray, is_s: np.ndarray, seeds: np.ndarray, symbols: int) -> np.ndarray:
    """All suffixes in order, from left-most S-type ones in order (those of equal symbol)."""
    by_symbol = seeds[np.argsort(text[seeds], kind="stable")]
    cuts = np.searchsorted(text[by_symbol], np.arange(symbols + 1))
    queues, larger = Queues(), [None] * symbols
    # The suffix before the end is the first to be induced.
    last = np.array([len(text) - 1], np.int64)
    queues.push(text[last].astype(np.int64), last)
    for symbol in range(symbols):
        done, front = [], queues.pop(symbol)
        while len(front):
            done.append(front)
            front = _before(text, ~is_s, front, symbol, queues)
        larger[symbol] = np.concatenate(done) if done else np.zeros(0, np.int64)
        _before(text, ~is_s, by_symbol[cuts[symbol] : cuts[symbol + 1]], symbol, queues)
    queues, pieces = Queues(), []
    for symbol in range(symbols - 1, -1, -1):
        done, front = [], queues.pop(symbol)
        while len(front):
            done.append(front)
            front = _before(text, is_s, front, symbol, queues)
        pieces += done
        pieces.append(larger[symbol][::-1])
        _before(text, is_s, larger[symbol][::-1], symbol, queues)
    return np.concatenate(pieces)[::-1]


def _before(text, wanted, places, symbol, queues) -> np.ndarray:
    """Pushes the suffixes one place before; returns those that start with ``symbol``."""
    before = places[places > 0] - 1
    before = before[wanted[before]]
    first = text[before].astype(np.int64)
    own = first == symbol
    queues.push(first[~own], before[~own])
    return before[own]


def suffix_order(text: np.ndarray, symbols: int, depth: int) -> np.ndarray:
    """Suffixes in the order of at least their first ``depth`` symbols."""
    is_s = _types(text)
    seeds = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    if not len(seeds):
        return induce(text, is_s, seeds, symbols)
    # Naming: sort the substrings between seeds by one induction, equal ones get one name.
    rough = induce(text, is_s, seeds, symbols)
    is_seed = np.zeros(len(text), bool)
    is_seed[seeds] = True
    by_substring = rough[is_seed[rough]]
    ends = np.append(seeds[1:], len(text) - 1)
    powers = np.full(len(text) + 1, _ODD)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    summed = np.concatenate([[np.uint64(0)], np.cumsum(_mix(text.astype(np.uint64) + _ODD) * powers[:-1])])
    at = np.searchsorted(seeds, by_substring)
    stop = ends[at] + 1
    # Hashes of equal substrings agree once both are moved to the same power.
    hashes = (summed[stop] - summed[by_substring]) * powers[len(text) - by_substring]
    lengths = stop - by_substring
    new = np.ones(len(at), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (lengths[1:] != lengths[:-1])
    names = np.empty(len(seeds), np.int64)
    names[at] = np.cumsum(new) - 1
    order = by_substring if new.all() else seeds[_ranked(names, depth)]
    return induce(text, is_s, order, symbols)


def _ranked(names: np.ndarray, depth: int) -> np.ndarray:
    """The order of the suffixes of the reduced string, by doubling."""
    rank, step = names.copy(), 1
    while True:
        after = np.zeros(len(rank), np.int64)
        after[:-step] = rank[step:] + 1
        key = rank * (len(rank) + 1) + after
        order = np.argsort(key, kind="stable")
        new = np.ones(len(rank), np.int64)
        new[1:] = key[order][1:] != key[order][:-1]
        rank[order] = np.cumsum(new) - 1
        step *= 2
        if new.all() or step >= min(depth, len(rank)):
            return order


def repeated_starts(blocks: list[tuple[bytes, int]], min_bytes: int) -> list[np.ndarray]:
    """For each (bytes, starts) the starts whose ``min_bytes`` bytes start elsewhere too."""
    lengths = np.array([len(data) + 1 for data, _ in blocks])
    text = np.zeros(int(lengths.sum()), np.int16)
    begins = np.concatenate([[0], np.cumsum(lengths)])
    valid = np.zeros(len(text), bool)
    for (data, n), begin in zip(blocks, begins.tolist()):
        text[begin : begin + len(data)] = np.frombuffer(data, np.uint8).astype(np.int16) + 1
        valid[begin : begin + n] = True
    order = suffix_order(text, 257, min_bytes)
    order = order[valid[order]]
    hashes = window_hashes(text.astype(np.uint64), min_bytes)
    same = hashes[order[1:]] == hashes[order[:-1]]
    marked = np.zeros(len(text), bool)
    marked[order[1:][same]] = True
    marked[order[:-1][same]] = True
    return [np.flatnonzero(marked[begin : begin + n]) for (_, n), begin in zip(blocks, begins.tolist())]


def hashed_starts(parts: Iterator[tuple], min_bytes: int) -> Iterator[pa.RecordBatch]:
    """For (core, name, starts, bytes) a row for each start: the hash of its ``min_bytes``."""
    held, size = [], 0
    for part in chain(parts, [None]):
        if held and (part is None or size + len(part[3]) > PIECE):
            hashes = window_hashes(np.frombuffer(b"".join(data for *_, data in held), np.uint8), min_bytes)
            begins = np.cumsum([0, *[len(data) for *_, data in held]]).tolist()
            counts = [n for _, _, n, _ in held]
            columns = [
                np.repeat(np.array([core for core, *_ in held], np.int64), counts),
                np.repeat(np.array([name for _, name, *_ in held], np.int64), counts),
                np.concatenate([np.arange(n, dtype=np.int32) for n in counts]),
                np.concatenate([hashes[at : at + n] for at, n in zip(begins, counts)]).view(np.int64),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(one) for one in columns], schema=START_SCHEMA)
            held, size = [], 0
        if part is not None:
            held.append(part)
            size += len(part[3])


def _runs(starts: np.ndarray) -> list[int]:
    """Ascending places as first, last, first, last of their runs."""
    if not len(starts):
        return []
    cuts = np.flatnonzero(np.diff(starts) > 1)
    firsts, lasts = starts[np.append(0, cuts + 1)], starts[np.append(cuts, len(starts) - 1)]
    return np.stack([firsts, lasts], 1).ravel().tolist()


# -- the jobs ----------------------------------------------------------------------


def remove_repeats(docs: DataFrame, min_bytes: int = 400) -> DataFrame:
    """``docs`` with ``kept`` (binary), ``spans`` (first and end of each run), n_bytes, n_removed."""
    if min_bytes < SPAN + GRAM:
        raise ValueError(f"min_bytes must be at least {SPAN + GRAM}")
    made = ["kept", "spans", "n_bytes", "n_removed"]
    rows_ = docs.drop(*made)
    row, found_, cut_ = (fresh(rows_, name) for name in ("_row", "_found", "_cut"))
    texts = materialise(rows_.withColumn(row, F.monotonically_increasing_id()), "texts")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for number, text in rows_of(batches, row, "text"):
                for block in blocks_of((text or "").encode(), min_bytes):
                    yield number, *block

        yield from batches_of(rows(), BLOCK_SCHEMA, size=50_000)

    blocks = materialise(texts.select(row, "text").mapInArrow(split, BLOCKS), "blocks")
    # Written first, so that the join has two plain sides and Spark can split a core's rows.
    cores = blocks.groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core")
    shared = materialise(cores, "shared-cores")
    shared = materialise(blocks.join(shared, "core"), "shared-blocks")
    named = shared.groupBy("core", "name").agg(
        F.count("*").alias("n"),
        F.min(F.struct("row", "first")).alias("at"),
        F.first("n_starts").alias("n_starts"),
    )
    named = materialise(named, "named-blocks")
    n_bytes = F.sum(F.col("n_starts") + min_bytes)
    several = named.groupBy("core").agg(F.count("*").alias("names"), n_bytes.alias("size"))
    several = several.where("names > 1").select("core", (F.col("size") > SHARD_BYTES).alias("is_large"))
    # Written first too, so that Spark can split the names of a core.
    several = materialise(several, "several-names")
    to_deal = materialise(
        named.join(several, "core").select("core", "name", "n_starts", "at.row", "at.first", "is_large"),
        "to-deal",
    )
    to_sort, to_count = to_deal.where("NOT is_large"), to_deal.where("is_large")
    size = to_sort.agg(n_bytes).first()[0]

    def texts_with(wanted: DataFrame) -> DataFrame:
        parts = F.collect_list(F.struct("core", "name", "n_starts", "first")).alias("wanted")
        wanted = wanted.groupBy("row").agg(parts)
        pieces = texts.select(F.col(row).alias("row"), "text").join(wanted, "row")
        return pieces.select("text", "wanted")

    def cut_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for text, parts in rows_of(batches, "text", "wanted"):
            data = (text or "").encode()
            for part in parts:
                first, n = part["first"], part["n_starts"]
                yield part["core"], part["name"], n, data[first : first + n - 1 + min_bytes]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches_of(cut_parts(batches), CUT_SCHEMA)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from hashed_starts(cut_parts(batches), min_bytes)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for core, name, starts in rows_of(batches, "core", "name", "starts"):
                yield core, name, _runs(np.array(starts))

        yield from batches_of(rows(), MARK_SCHEMA)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            keys, held, size, core = [], [], 0, None
            for one, name, n, data in rows_of(batches, "core", "name", "n_starts", "block"):
                if one != core and size >= SHARD_BYTES:
                    yield from marked(keys, held)
                    keys, held, size = [], [], 0
                core, size = one, size + len(data)
                keys.append((one, name))
                held.append((data, n))
            if held:
                yield from marked(keys, held)

        def marked(keys, held):
            for key, starts in zip(keys, repeated_starts(held, min_bytes)):
                if len(starts):
                    yield *key, _runs(starts)

        yield from batches_of(rows(), MARK_SCHEMA)

    cut_out = texts_with(to_sort).mapInArrow(cut, CUT)
    sharded = cut_out.repartition(tasks_for(size, 2 * SHARD_BYTES), "core").sortWithinPartitions("core", "name")
    sorted_marks = materialise(sharded.mapInArrow(mark, MARKS), "marks")
    starts = materialise(texts_with(to_count).mapInArrow(hashed, STARTS), "starts")
    again = starts.groupBy("core", "hash").agg(F.count("*").alias("n")).where("n > 1")
    again = starts.join(materialise(again.select("core", "hash"), "repeated-starts"), ["core", "hash"])
    counted = again.groupBy("core", "name").agg(F.array_sort(F.collect_list("start")).alias("starts"))
    sorted_marks = sorted_marks.unionByName(counted.mapInArrow(runs, MARKS))
    # A name that occurs twice is repeated whole, whatever its shard found.
    whole = named.where("n > 1").select(
        "core", "name", F.array(F.lit(0), F.col("n_starts") - 1).alias("marks")
    )
    single = sorted_marks.join(named.where("n = 1").select("core", "name"), ["core", "name"])
    marks = whole.unionByName(single.select("core", "name", "marks"))
    found = shared.join(marks, ["core", "name"]).groupBy("row").agg(
        F.collect_list(F.struct("first", "marks")).alias(found_)
    )
    joined = texts.join(found.withColumnRenamed("row", row), row, "left")
    cut_text = _remove(min_bytes)("text", found_)
    return joined.withColumn(cut_, cut_text).select(
        *rows_.columns, *[f"{cut_}.{name}" for name in made]
    )


def _remove(min_bytes: int):
    @F.pandas_udf("kept binary, spans array<struct<first:long,end:long>>, n_bytes long, n_removed long")
    def remove(texts, found):
        import pandas as pd

        rows = []
        for text, blocks in zip(texts, found):
            data = (text or "").encode()
            spans: list[list[int]] = []
            runs = [
                (block["first"] + start, block["first"] + last + min_bytes)
                for block in ([] if blocks is None else blocks)
                for start, last in zip(block["marks"][::2], block["marks"][1::2])
            ]
            for start, end in sorted(runs):
                if spans and start <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], end)
                else:
                    spans.append([start, end])
            parts, at = [], 0
            for start, end in spans:
                parts.append(data[at:start])
                at = end
            parts.append(data[at:])
            left = b"".join(parts)
            rows.append((left, [{"first": a, "end": b} for a, b in spans], len(data), len(data) - len(left)))
        return pd.DataFrame(rows, columns=["kept", "spans", "n_bytes", "n_removed"])

    return remove
