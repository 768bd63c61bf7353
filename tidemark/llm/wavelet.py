"""Token ids as wavelet matrices: one succinct, compressed file per shard.

A shard is a run of whole documents in ascending order of their ids. Its file row holds the
bit-planes of the ids from the highest bit to the lowest, each stably sorted by the planes
above it, with the number of zeros and the ones before each block of 512 bits. From that row
alone a token can be read, counted up to a place, and found (access, rank, select), and all
ids can be decoded. Files are Parquet with Zstandard pages, so any store Spark knows will do.

Documents are dealt out by range of their ids, and tokens are worked out once, after that one
shuffle. A task builds its shards one after the other and holds one at a time: at most
``SHARD_TOKENS`` ids and one document. What is gathered is one count per range.

Null texts are empty and hold just the end id. Null ids come first. Rows of one id stay
beside each other in order of their texts; each is a document of its own. Extra columns are
not read. An empty table gives no shards and no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import batches_of, rows_of, tasks_for
from tidemark.llm.tokens import encoded, encoder
from tidemark.session import run_folder

SHARD_TOKENS = 1 << 21
BLOCK = 512

FILE_SCHEMA = pa.schema(
    [
        ("part", pa.int32()),
        ("shard", pa.int32()),
        ("first_token", pa.int64()),
        ("n_tokens", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())),
        ("doc_tokens", pa.list_(pa.int64())),
        ("zeros", pa.list_(pa.int64())),
        ("bits", pa.list_(pa.binary())),
        ("ranks", pa.list_(pa.binary())),
    ]
)
FILE_COLUMNS = (
    "part int, shard int, first_token long, n_tokens long, doc_ids array<long>, "
    "doc_tokens array<long>, zeros array<long>, bits array<binary>, ranks array<binary>"
)
READ_SCHEMA = pa.schema(
    [
        ("part", pa.int32()),
        ("doc_id", pa.int64()),
        ("first_token", pa.int64()),
        ("n_tokens", pa.int64()),
        ("ids", pa.binary()),
    ]
)


class WaveletMatrix:
    """Rank and select over a sequence of ids, on bit-planes with counted blocks."""

    def __init__(self, n: int, zeros: list[int], bits: list[bytes], ranks: list[bytes]):
        self.n, self.zeros, self.bits, self.ranks = n, zeros, bits, ranks

    @classmethod
    def build(cls, ids: np.ndarray, width: int) -> "WaveletMatrix":
        zeros, bits, ranks = [], [], []
        ids = ids.astype(_narrow(width))
        for shift in range(width - 1, -1, -1):
            plane = (ids & ids.dtype.type(1 << shift)) != 0
            packed = np.packbits(plane, bitorder="little")
            padded = np.zeros(-(-max(1, len(packed)) // 64) * 64, np.uint8)
            padded[: len(packed)] = packed
            ones = np.bitwise_count(padded).reshape(-1, 64).sum(1)
            before = np.concatenate([[0], np.cumsum(ones)]).astype("<u4")
            zeros.append(int(len(ids) - before[-1]))
            bits.append(packed.tobytes())
            ranks.append(before.tobytes())
            ids = np.concatenate([np.compress(~plane, ids), np.compress(plane, ids)])
        return cls(len(ids), zeros, bits, ranks)

    def _bit(self, level: int, at: int) -> int:
        return self.bits[level][at >> 3] >> (at & 7) & 1

    def _ones(self, level: int, at: int) -> int:
        """Ones of a plane before a place: the block's count and the bits since."""
        block = at // BLOCK
        count = int.from_bytes(self.ranks[level][4 * block : 4 * block + 4], "little")
        since = int.from_bytes(self.bits[level][block * BLOCK // 8 : (at + 7) // 8], "little")
        return count + (since & (1 << at - block * BLOCK) - 1).bit_count()

    def access(self, at: int) -> int:
        """The id at a place."""
        value = 0
        for level, zeros in enumerate(self.zeros):
            bit, ones = self._bit(level, at), self._ones(level, at)
            value, at = value << 1 | bit, zeros + ones if bit else at - ones
        return value

    def _range(self, value: int, end: int) -> tuple[int, int]:
        low, high = 0, end
        for level, zeros in enumerate(self.zeros):
            bit = value >> len(self.zeros) - 1 - level & 1
            ones_low, ones_high = self._ones(level, low), self._ones(level, high)
            if bit:
                low, high = zeros + ones_low, zeros + ones_high
            else:
                low, high = low - ones_low, high - ones_high
        return low, high

    def rank(self, value: int, end: int | None = None) -> int:
        """How often an id occurs before a place, or at all."""
        if value >> len(self.zeros):
            return 0
        low, high = self._range(value, self.n if end is None else end)
        return high - low

    def select(self, value: int, k: int) -> int:
        """The place of the k-th occurrence of an id, counted from 0."""
        if not 0 <= k < self.rank(value):
            raise IndexError(f"id {value} occurs {self.rank(value)} times")
        at = self._range(value, self.n)[0] + k
        for level in range(len(self.zeros) - 1, -1, -1):
            bit = value >> len(self.zeros) - 1 - level & 1
            at = self._seek(level, bit, at - self.zeros[level] if bit else at)
        return at

    def _seek(self, level: int, bit: int, k: int) -> int:
        """The place of the k-th one, or zero, of a plane."""
        before = np.frombuffer(self.ranks[level], "<u4").astype(np.int64)
        if not bit:
            before = np.arange(len(before)) * BLOCK - before
        block = int(np.searchsorted(before, k, side="right")) - 1
        start = block * BLOCK // 8
        plane = np.unpackbits(
            np.frombuffer(self.bits[level][start : start + BLOCK // 8], np.uint8),
            bitorder="little",
        )
        return block * BLOCK + int(np.flatnonzero(plane == bit)[k - int(before[block])])

    def occurrences(self, value: int) -> list[int]:
        """All places of an id, ascending."""
        return [self.select(value, k) for k in range(self.rank(value))]

    def decode(self) -> np.ndarray:
        """All ids: the planes are undone from the lowest to the highest."""
        kind = _narrow(len(self.zeros))
        ids = np.zeros(self.n, kind)
        for level in range(len(self.zeros) - 1, -1, -1):
            packed = np.frombuffer(self.bits[level], np.uint8)
            plane = np.unpackbits(packed, count=self.n, bitorder="little").view(bool)
            above, zeros = np.empty(self.n, kind), self.zeros[level]
            above[np.flatnonzero(~plane)] = ids[:zeros]
            above[np.flatnonzero(plane)] = ids[zeros:] | kind(1 << len(self.zeros) - 1 - level)
            ids = above
        return ids.astype("<u4")


def _narrow(width: int) -> type:
    """The number type for ids of so many bits."""
    return np.uint16 if width <= 16 else np.uint32


def write_shards(
    docs: DataFrame, tokenizer_path: str, end_id: int = 2, shard_tokens: int = SHARD_TOKENS
) -> DataFrame:
    """Encodes ``docs`` (doc_id, text) and writes the shards; the file table is returned."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    ranged = (
        docs.select(F.col("doc_id").cast("long"), "text")
        .repartitionByRange(tasks_for(size), "doc_id")
        .sortWithinPartitions("doc_id", "text")
    )

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        width = max(encoder(tokenizer_path).vocabulary - 1, end_id).bit_length()
        shard = first = 0
        ids, lengths, held, size = [], [], [], 0

        def row():
            matrix = WaveletMatrix.build(np.frombuffer(b"".join(held), "<u4"), width)
            return (
                part, shard, first, matrix.n, ids, lengths,
                matrix.zeros, matrix.bits, matrix.ranks,
            )

        for (doc_id, _), tokens in encoded(
            rows_of(batches, "doc_id", "text"), tokenizer_path, end_id
        ):
            ids.append(doc_id)
            lengths.append(len(tokens) // 4)
            held.append(tokens)
            size += len(tokens) // 4
            if size >= shard_tokens:
                yield from batches_of(iter([row()]), FILE_SCHEMA)
                shard, first = shard + 1, first + size
                ids, lengths, held, size = [], [], [], 0
        if held:
            yield from batches_of(iter([row()]), FILE_SCHEMA)

    folder = run_folder(spark, "wavelet")
    ranged.mapInArrow(shards, FILE_COLUMNS).write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(FILE_COLUMNS).parquet(folder)


def read_documents(files: DataFrame) -> DataFrame:
    """Every document of a file table: doc_id, start, n_tokens and its ids as bytes."""
    return _placed(files, F.col("ids"))


def read_digests(files: DataFrame) -> DataFrame:
    """As ``read_documents``, with the CRC-32 of each document's ids in their place."""
    return _placed(files, F.crc32("ids").alias("ids_crc32"))


def _placed(files: DataFrame, result: Column) -> DataFrame:
    """``result`` of every document and where it starts; only that is shuffled."""
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        "part", F.coalesce(F.sum("part_tokens").over(before), F.lit(0)).alias("part_start")
    )
    decoded = files.mapInArrow(_decode, "part int, doc_id long, first_token long, n_tokens long, ids binary")
    rows = decoded.select("part", "doc_id", "first_token", "n_tokens", result)
    start = (F.col("part_start") + F.col("first_token")).alias("start")
    return rows.join(offsets, "part").select("doc_id", start, "n_tokens", rows.columns[-1])


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def documents():
        for batch in batches:
            for at in range(batch.num_rows):
                row = {name: batch.column(name)[at].as_py() for name in FILE_SCHEMA.names}
                matrix = WaveletMatrix(row["n_tokens"], row["zeros"], row["bits"], row["ranks"])
                ids, start = matrix.decode(), 0
                for doc_id, length in zip(row["doc_ids"], row["doc_tokens"]):
                    piece = ids[start : start + length].tobytes()
                    yield row["part"], doc_id, row["first_token"] + start, length, piece
                    start += length

    yield from batches_of(documents(), READ_SCHEMA, weight=lambda row: len(row[4]))
