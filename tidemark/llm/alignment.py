"""Cross-tokenizer alignment: which tokens of two tokenizers end together, and how often.

A text is encoded by tokenizer A (byte-level, with a blank before it) and B (SentencePiece, which
adds that blank). Byte offsets where both have a token end cut them into groups; the two tokens
that end there are linked. The count of an id pair is its links in the whole corpus.

Method: the distinct linked pairs get a minimal perfect hash: level after level, keys alone in
their place of a bit array of twice their number stay there, the others go on; a key's number is
the rank of its bit. Tasks count links in dense vectors indexed by it, vectors are summed as a
tree, 16 at a time. A second pass aligns the documents again, looks their pairs up, and believes a
number only if the key kept for it is the pair itself.

Scale: texts are encoded once, and their ids written to the shared folder at 2 bytes a token;
both passes read those. Distinct pairs are at most the product of the two vocabularies. They are dealt by B id to shards of about ``SHARD_PAIRS``; each shard is hashed by
one task, and is counted and looked up by passes of its own, so no task or broadcast holds more
than one (at most some 100 MB). Nothing is shuffled by word or pair but the distinct pairs and the
vectors, which are kept to an eighth of what is read by giving each task enough of it.

Every row of the input gives a row, in no order: null or repeated ids stay as they are. A text
that is null or empty, or whose tokens do not spell it (one with U+2581, say), has no tokens: all
counts are zero. Columns other than ``doc_id`` and ``text`` are ignored, so names cannot clash. An
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import batches_of, materialise, rows_of
from tidemark.llm.tokens import byte_letters, encoder

# About how many distinct pairs one hash function, count vector and broadcast hold.
SHARD_PAIRS = 1 << 22
# Tokens that are aligned at a time, numbers of a vector that travel in one row, vectors summed
# at a time, and bytes read for each byte of a vector.
TOKENS_AT_ONCE, CHUNK, FAN, READ_PER_VECTOR = 1 << 18, 1 << 16, 16, 8

_aligners: dict[tuple[str, str], "Aligner"] = {}


def aligner(path_a: str, path_b: str) -> "Aligner":
    key = (path_a, path_b)
    if key not in _aligners:
        _aligners[key] = Aligner(*key)
    return _aligners[key]


class Aligner:
    """Encodes texts by both tokenizers and cuts their tokens into groups."""

    def __init__(self, path_a: str, path_b: str):
        # Special tokens written out in a text are plain text.
        self.a = encoder(path_a, special_as_text=True)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_a, self.bytes_b = _bytes_of_a(path_a, self.a.vocabulary), _bytes_of_b(self.b)
        self.sizes_a = np.array([len(one) for one in self.bytes_a])
        self.sizes_b = np.array([len(one) for one in self.bytes_b])
        self.type_a, self.type_b = _number_type(len(self.bytes_a)), _number_type(len(self.bytes_b))
        # Ids as text, with what follows them inside a group and at the end of their part of it.
        self.written_a = _written(len(self.bytes_a), b"|")
        self.written_b = _written(len(self.bytes_b), b";")

    def align(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, bytes]]:
        """For each text its ids by both tokenizers and its groups as text; empty without tokens."""
        nothing = np.zeros(0, self.type_a), np.zeros(0, self.type_b), b""
        there = [text for text in texts if text]
        ids_a = iter(self.a.encode([" " + text for text in there]))
        for text in texts:
            yield self._aligned(text, next(ids_a)) or nothing if text else nothing

    def _aligned(self, text: str, ids_a: bytes) -> tuple[np.ndarray, np.ndarray, bytes] | None:
        a, listed = np.frombuffer(ids_a, "<u4"), self.b.encode(text, num_threads=1)
        wanted = (" " + text).encode()
        spelt_b = b"".join(map(self.bytes_b.__getitem__, listed))
        if spelt_b != wanted or b"".join(map(self.bytes_a.__getitem__, a.tolist())) != wanted:
            return None
        b = np.array(listed)
        at_a, at_b = common_ends(np.cumsum(self.sizes_a[a]), np.cumsum(self.sizes_b[b]))
        last_a, last_b = np.zeros(len(a), int), np.zeros(len(b), int)
        last_a[at_a] = last_b[at_b] = 1
        # A token comes after the tokens of the other kind in the groups before its own.
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        before_a, before_b = np.concatenate([[0], at_b + 1]), at_a + 1
        parts = np.empty(len(a) + len(b), object)
        parts[np.arange(len(a)) + before_a[group_a]] = self.written_a[last_a, a]
        parts[np.arange(len(b)) + before_b[group_b]] = self.written_b[last_b, b]
        return a.astype(self.type_a), b.astype(self.type_b), b"".join(parts.tolist())[:-1]


def _written(size: int, last: bytes) -> np.ndarray:
    return np.array([[b"%d," % one for one in range(size)], [b"%d%s" % (one, last) for one in range(size)]], object)


def _number_type(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


def _bytes_of_a(path: str, size: int) -> list[bytes]:
    """What each token of a byte-level tokenizer stands for, by id."""
    letters, table = byte_letters(), [b""] * size
    with open(path, encoding="utf-8") as file:
        for token, at in json.load(file)["model"]["vocab"].items():
            table[at] = bytes(map(letters.__getitem__, token))
    return table


def _bytes_of_b(model: sentencepiece.SentencePieceProcessor) -> list[bytes]:
    return [
        bytes([int(model.id_to_piece(at)[3:5], 16)])
        if model.is_byte(at)
        else model.id_to_piece(at).replace("▁", " ").encode()
        for at in range(model.get_piece_size())
    ]


def common_ends(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places in both sorted arrays of what they have in common."""
    _, at_a, at_b = np.intersect1d(ends_a, ends_b, assume_unique=True, return_indices=True)
    return at_a, at_b


class Sizes(NamedTuple):
    """The number type of each tokenizer's ids, and the bytes that each id stands for."""

    type_a: str
    type_b: str
    bytes_a: np.ndarray
    bytes_b: np.ndarray


class PerfectHash:
    """A minimal perfect hash function of distinct 64-bit keys, with the keys by their number."""

    def __init__(self, sizes: list[int], bits: bytes, keys: bytes):
        self.sizes, self.bits = sizes, np.frombuffer(bits, np.uint8)
        self.keys = np.frombuffer(keys, np.uint64)
        self.ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(self.bits), dtype=np.int64)])

    @staticmethod
    def build(keys: np.ndarray) -> tuple[list[int], bytes, bytes]:
        """(bits of each level, their bytes one after the other, keys by number)."""
        sizes, levels, placed, left = [], [], [], np.sort(keys.astype(np.uint64))
        while len(left):
            size = -(-2 * len(left) // 8) * 8
            places = _place(left, len(sizes), size)
            alone = np.bincount(places, minlength=size) == 1
            stays = alone[places]
            order = np.argsort(places[stays])
            sizes.append(size)
            levels.append(np.packbits(alone, bitorder="little"))
            placed.append(left[stays][order])
            left = left[~stays]
        joined = np.concatenate(levels) if levels else np.zeros(0, np.uint8)
        in_order = np.concatenate(placed) if placed else np.zeros(0, np.uint64)
        return sizes, joined.tobytes(), in_order.tobytes()

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 for keys that are not among those hashed."""
        found = np.full(len(keys), -1, np.int64)
        open_, base = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            places = _place(keys[open_], level, size)
            at, bit = base + (places >> 3), (places & 7).astype(np.uint8)
            own = self.bits[at]
            hit = (own >> bit) & 1 == 1
            below = own[hit] & ((np.uint8(1) << bit[hit]) - np.uint8(1))
            found[open_[hit]] = self.ranks[at[hit]] + np.bitwise_count(below)
            open_, base = open_[~hit], base + size // 8
        met = found >= 0
        met[met] = self.keys[found[met]] == keys[met]
        found[~met] = -1
        return found


def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    mixed = keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((mixed ^ (mixed >> np.uint64(31))) % np.uint64(size)).astype(np.int64)


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row per document: its ids by both tokenizers as little-endian numbers, how many of them,
    of groups and links there are, how its links rank in the corpus, and the hash of its groups."""
    spark, coder = docs.sparkSession, aligner(path_a, path_b)
    lengths = Sizes(coder.type_a, coder.type_b, coder.sizes_a, coder.sizes_b)
    encoded = _encode(docs, path_a, path_b)
    pairs = materialise(_distinct_pairs(encoded, lengths), "pairs")
    shards = max(1, -(-pairs.count() // SHARD_PAIRS))
    hashed = materialise(_hash_functions(pairs, shards), "hashes")
    size = encoded.agg(F.sum(F.length("a_ids") + F.length("b_ids"))).first()[0] or 0
    looked_up = None
    for shard in range(shards):
        function = hashed.where(F.col("shard") == shard).select("sizes", "bits", "keys").first()
        if function is None:
            continue
        perfect = spark.sparkContext.broadcast(tuple(function))
        vector = _count(encoded, lengths, perfect, size)
        counts = spark.sparkContext.broadcast(vector)
        found = materialise(_look_up(encoded, lengths, perfect, counts), "links")
        looked_up = found if looked_up is None else looked_up.unionByName(found)
        perfect.destroy(), counts.destroy()
    nothing = [F.lit(0).cast("long").alias(name) for name in ("n_links", "n_best", "count_sum")]
    whole = encoded.select("row", *nothing)
    whole = whole if looked_up is None else whole.unionByName(looked_up)
    sums = whole.groupBy("row").agg(*[F.sum(name).alias(name) for name in ("n_links", "n_best", "count_sum")])
    return encoded.join(sums, "row").drop("row")


def _encode(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    schema = pa.schema(
        [("doc_id", pa.int64())]
        + [(name, pa.int64()) for name in ("n_a", "n_b", "n_groups")]
        + [("groups_sha256", pa.string()), ("a_ids", pa.binary()), ("b_ids", pa.binary())]
    )

    def encode(batches):
        coder = aligner(path_a, path_b)

        def rows():
            for held in _some_at_a_time(rows_of(batches, "doc_id", "text")):
                for (doc, _), (a, b, groups) in zip(held, coder.align([text for _, text in held])):
                    digest = hashlib.sha256(groups).hexdigest() if groups else ""
                    n_groups = groups.count(b"|")
                    yield doc, len(a), len(b), n_groups, digest, a.tobytes(), b.tobytes()

        yield from batches_of(rows(), schema, 2048, lambda row: len(row[-1]) + len(row[-2]))

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = narrow.mapInArrow(
        encode,
        "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, a_ids binary, b_ids binary",
    )
    # The ids of rows are written with them, so they stay the same from here on.
    return materialise(found.withColumn("row", F.monotonically_increasing_id()), "aligned")


def _some_at_a_time(rows: Iterator[tuple], size: int = 1 << 20) -> Iterator[list[tuple]]:
    """Rows in lists of at most 4096 and of about ``size`` characters."""
    held, chars = [], 0
    for row in rows:
        held.append(row)
        chars += len(row[1] or "")
        if chars >= size or len(held) >= 4096:
            yield held
            held, chars = [], 0
    if held:
        yield held


def _links(batches: Iterator[pa.RecordBatch], lengths: Sizes):
    """(rows, links by row, A ids, B ids) of the links of some documents at a time, aligned anew
    from the lengths of their tokens."""
    for held in _some_at_a_time(rows_of(batches, "row", "a_ids", "b_ids"), TOKENS_AT_ONCE):
        a = np.frombuffer(b"".join(row[1] for row in held), lengths.type_a)
        b = np.frombuffer(b"".join(row[2] for row in held), lengths.type_b)
        at_a, at_b = common_ends(np.cumsum(lengths.bytes_a[a]), np.cumsum(lengths.bytes_b[b]))
        width = np.dtype(lengths.type_a).itemsize
        lasts = np.cumsum([len(row[1]) // width for row in held])
        cuts = np.concatenate([[0], np.searchsorted(at_a, lasts, side="left")])
        yield [row[0] for row in held], cuts, a[at_a].astype(np.uint64), b[at_b].astype(np.uint64)


def _keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a << np.uint64(32)) | b


def _distinct_pairs(encoded: DataFrame, lengths: Sizes) -> DataFrame:
    def distinct(batches):
        for _, _, a, b in _links(batches, lengths):
            keys = np.unique(_keys(a, b))
            yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64))], names=["pair"])

    return encoded.select("row", "a_ids", "b_ids").mapInArrow(distinct, "pair long").distinct()


def _hash_functions(pairs: DataFrame, shards: int) -> DataFrame:
    """The hash function of each shard; all pairs of a B id are in one."""

    def build(table: pa.Table) -> pa.Table:
        sizes, bits, keys = PerfectHash.build(table.column("pair").to_numpy().astype(np.uint64))
        shard = table.column("shard")[0].as_py()
        return pa.table(
            {
                "shard": pa.array([shard], pa.int32()),
                "sizes": pa.array([sizes], pa.list_(pa.int64())),
                "bits": pa.array([bits], pa.binary()),
                "keys": pa.array([keys], pa.binary()),
            }
        )

    dealt = pairs.withColumn("shard", _shard(F.col("pair"), shards))
    return dealt.groupBy("shard").applyInArrow(build, "shard int, sizes array<long>, bits binary, keys binary")


def _shard(pair: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(pair.bitwiseAND(0xFFFFFFFF)), F.lit(shards)).cast("int")


def _count(encoded: DataFrame, lengths: Sizes, perfect, size: int) -> np.ndarray:
    """How often each pair of one shard is linked, by its number."""
    length = len(perfect.value[2]) // 8

    def count(batches):
        function, vector = PerfectHash(*perfect.value), np.zeros(length, np.int64)
        for _, _, a, b in _links(batches, lengths):
            keys, times = np.unique(_keys(a, b), return_counts=True)
            numbers = function.numbers(keys)
            vector[numbers[numbers >= 0]] += times[numbers >= 0]
        node = TaskContext.get().partitionId()
        for start in range(0, length, CHUNK):
            part = vector[start : start + CHUNK]
            if part.any():
                columns = [pa.array([start // CHUNK], pa.int64()), pa.array([node], pa.int64())]
                columns.append(pa.array([part.tobytes()], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=["chunk", "node", "vector"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(one.as_py(), np.int64) for one in table.column("vector"))
        firsts = [table.column(name).slice(0, 1).combine_chunks() for name in ("chunk", "node")]
        return pa.table([*firsts, pa.array([total.tobytes()], pa.binary())], names=["chunk", "node", "vector"])

    schema = "chunk long, node long, vector binary"
    tasks = max(1, size // (READ_PER_VECTOR * 8 * max(1, length)))
    read = encoded.select("row", "a_ids", "b_ids").coalesce(tasks)
    vectors = materialise(read.mapInArrow(count, schema), "vectors")
    last = vectors.agg(F.max("node")).first()[0] or 0
    while True:
        last //= FAN
        parents = vectors.withColumn("node", F.floor(F.col("node") / FAN).cast("long"))
        vectors = materialise(parents.groupBy("chunk", "node").applyInArrow(add, schema), "vectors")
        if not last:
            break
    whole = np.zeros(length, np.int64)
    for chunk, part in vectors.select("chunk", "vector").collect():
        part = np.frombuffer(part, np.int64)
        whole[chunk * CHUNK : chunk * CHUNK + len(part)] = part
    return whole


def _look_up(encoded: DataFrame, lengths: Sizes, perfect, counts) -> DataFrame:
    """Of each document the links whose pair is in the shard: how many there are, how many have
    the highest count of their B id, and the sum of their counts."""

    def look_up(batches):
        function, vector = PerfectHash(*perfect.value), counts.value
        owners = (function.keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        best = np.zeros(len(lengths.bytes_b), np.int64)
        np.maximum.at(best, owners, vector)
        for rows, cuts, a, b in _links(batches, lengths):
            numbers = function.numbers(_keys(a, b))
            met = numbers >= 0
            times = np.where(met, vector[numbers], 0)
            is_best = met & (times == best[b.astype(np.int64)])
            columns = [pa.array(rows, pa.int64())]
            for values in (met, is_best, times):
                sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
                columns.append(pa.array(sums[cuts[1:]] - sums[cuts[:-1]]))
            yield pa.RecordBatch.from_arrays(columns, names=["row", "n_links", "n_best", "count_sum"])

    return encoded.select("row", "a_ids", "b_ids").mapInArrow(
        look_up, "row long, n_links long, n_best long, count_sum long"
    )
