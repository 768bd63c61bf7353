"""Stupid-backoff scores of documents, from n-gram counts over all documents.

The score of a word is the count of the longest n-gram that ends there over the count of its
context, if the n-gram occurs ``min_count`` times or more, and else ``backoff`` times the
score with a shorter context; a single word scores its share of all words.

Documents are taken in chunks, dealt out once: what explodes them and what scores them read the
same shuffle. A chunk holds its words as numbers and, exploded, each of its n-grams once with its
count there. These go to buckets by hash, where the counts of all chunks
are summed: a bucket is a shard of the count tables. Back go a bit for each n-gram, whether it
occurs again, and the counts of those that do. The sums are joined back to the chunks'
n-grams, chunk by chunk, and a chunk then sums its documents' scores. As a chunk sends each
n-gram once, a word pair that every document holds is one row per chunk and makes no bucket
hot. Buckets grow in number with the words; chunks are bounded by ``CHUNK_BYTES`` and one
document. Nothing but the number of words reaches the driver.

N-grams are told by 64-bit hashes; buckets are ranges of these, so a chunk's hashes are sent
in order as differences, like all numbers byte by byte of equal weight and compressed. Words
are ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased. Null and empty texts have no words, score 0.0 and no mean. Repeated rows count as often as they occur
and each is scored, also without id. Extra columns are not read. Empty tables are fine.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import batches_of, rows_of, tasks_for, text_of

CHUNK_BYTES = 8 << 20
BUCKET_WORDS = 1_000_000
# White space that parts words, as bytes of a text.
SPACE = r"[\x20\x09-\x0D]+"

CHUNKS = "chunk long, n_words long, doc_ids array<long>, doc_words array<int>, vocabulary binary, words binary"
CHUNK_SCHEMA = pa.schema(
    [
        ("chunk", pa.int64()),
        ("n_words", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())),
        ("doc_words", pa.list_(pa.int32())),
        ("vocabulary", pa.binary()),
        ("words", pa.binary()),
    ]
)
GRAMS = "bucket int, chunk long, grams binary, counts binary"
GRAM_SCHEMA = pa.schema(
    [("bucket", pa.int32()), ("chunk", pa.int64()), ("grams", pa.binary()), ("counts", pa.binary())]
)
TOTALS = "chunk long, bucket int, totals binary"
TOTAL_SCHEMA = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("totals", pa.binary())])
SCORES = "doc_id long, n_words long, log_score double"
SCORE_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("log_score", pa.float64())]
)


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers in little room: all lowest bytes, then all second ones and so on, compressed."""
    planes = numbers.view(np.uint8).reshape(len(numbers), numbers.itemsize).T.tobytes()
    return len(numbers).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _unpacked(data: bytes, kind: str) -> np.ndarray:
    n, width = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    planes = pa.decompress(data[8:], n * width, codec="zstd", asbytes=True)
    return np.frombuffer(planes, np.uint8).reshape(width, n).T.copy().view(kind).ravel()


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, number = TaskContext.get().partitionId(), 0
    ids, lengths, words, numbers, size = [], [], [], {}, 0

    def row():
        hashes = [xxhash.xxh3_64_intdigest(word) for word in numbers]
        return (
            task << 32 | number, len(words), ids, lengths,
            np.array(hashes, "<u8").tobytes(), _packed(np.array(words, "<u4")),
        )

    for doc_id, text in rows_of(batches, "doc_id", "text"):
        data = (text or "").encode()
        found = data.lower().split()
        words += [numbers.setdefault(word, len(numbers)) for word in found]
        ids.append(doc_id)
        lengths.append(len(found))
        size += len(data)
        if size >= CHUNK_BYTES:
            yield from batches_of(iter([row()]), CHUNK_SCHEMA)
            ids, lengths, words, numbers, size = [], [], [], {}, 0
            number += 1
    if ids:
        yield from batches_of(iter([row()]), CHUNK_SCHEMA)


def _grams(vocabulary: bytes, words: bytes, lengths: list[int], order: int) -> list[np.ndarray]:
    """For n = 1, 2, ... the hash of the n-gram that ends at each word; 0 where none does."""
    word = np.frombuffer(vocabulary, "<u8")[_unpacked(words, "<u4")]
    since = np.arange(len(word)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    found = [_mix(word)]
    for n in range(2, order + 1):
        longer = np.zeros(len(word), np.uint64)
        # The n-gram is the shorter one that ends a word earlier, and this word.
        longer[1:] = _mix(found[-1][:-1] * np.uint64(0xD6E8FEB86659FD93) + word[1:] + np.uint64(n))
        found.append(np.where(since >= n - 1, longer, 0).astype(np.uint64))
    return found


def _mix(value: np.ndarray) -> np.ndarray:
    value = (value ^ value >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    value = (value ^ value >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return np.maximum(value ^ value >> np.uint64(31), np.uint64(1))


def _distinct(grams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of a chunk once, ascending, and their counts."""
    every = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
    return np.unique(every[every != 0], return_counts=True)


def _bucket(grams: np.ndarray, buckets: int) -> np.ndarray:
    """The buckets of n-grams, ascending as their hashes are."""
    return (grams >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)


def count_chunks(docs: DataFrame, tasks: int) -> DataFrame:
    """The documents as chunks of numbered words, dealt out by chunk once for all that follows."""
    narrow = docs.select(F.col("doc_id").cast("long"), "text")
    return narrow.mapInArrow(_chunks, CHUNKS).repartition(tasks, "chunk")


def _known_again(sums: np.ndarray) -> bytes:
    """Counts in little room: a bit for each that is above 1, and those."""
    again = sums > 1
    bits = pa.compress(np.packbits(again).tobytes(), codec="zstd", asbytes=True)
    return len(sums).to_bytes(8, "little") + len(bits).to_bytes(8, "little") + bits + _packed(sums[again])


def _counts_of(data: bytes) -> np.ndarray:
    n, size = int.from_bytes(data[:8], "little"), int.from_bytes(data[8:16], "little")
    bits = pa.decompress(data[16 : 16 + size], -(-n // 8), codec="zstd", asbytes=True)
    again = np.unpackbits(np.frombuffer(bits, np.uint8), count=n).view(bool)
    counts = np.ones(n, np.int64)
    counts[again] = _unpacked(data[16 + size :], "<u8")
    return counts


def _parts(grams: np.ndarray, buckets: int, numbers: np.ndarray) -> tuple[list[int], list[int]]:
    """Where the n-grams of some buckets begin and end among ascending ones."""
    own = _bucket(grams, buckets)
    return tuple(np.searchsorted(own, numbers, side=side).tolist() for side in ("left", "right"))


def ngram_totals(chunks: DataFrame, order: int, buckets: int) -> DataFrame:
    """For each chunk and bucket the corpus counts of the chunk's n-grams, ascending by hash."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for chunk, lengths, vocabulary, words in rows_of(
                batches, "chunk", "doc_words", "vocabulary", "words"
            ):
                grams, counts = _distinct(_grams(vocabulary, words, lengths, order))
                numbers = np.unique(_bucket(grams, buckets))
                for number, start, end in zip(numbers.tolist(), *_parts(grams, buckets, numbers)):
                    steps = np.diff(grams[start:end], prepend=np.uint64(0))
                    yield number, chunk, _packed(steps), _packed(counts[start:end].astype("<u4"))

        yield from batches_of(rows(), GRAM_SCHEMA, weight=lambda row: len(row[2]))

    def total(table: pa.Table) -> pa.Table:
        held = [np.cumsum(_unpacked(g, "<u8"), dtype="<u8") for g in table.column("grams").to_pylist()]
        counts = [_unpacked(c, "<u4") for c in table.column("counts").to_pylist()]
        _, place = np.unique(np.concatenate(held), return_inverse=True)
        sums = np.bincount(place, weights=np.concatenate(counts)).astype("<u8")
        parts = np.split(sums[place], np.cumsum([len(one) for one in held])[:-1])
        return pa.table(
            [
                table.column("chunk"),
                table.column("bucket"),
                pa.array([_known_again(part) for part in parts], pa.binary()),
            ],
            schema=TOTAL_SCHEMA,
        )

    # All columns go in, so that the shuffle is the one that the join reads too.
    exploded = chunks.mapInArrow(explode, GRAMS)
    return exploded.groupBy("bucket").applyInArrow(total, TOTALS)


def score(
    docs: DataFrame, order: int = 3, backoff: float = 0.4, min_count: int = 2
) -> DataFrame:
    """doc_id, n_words, log_score (natural logarithm, summed) and mean_log_score per word."""
    if order < 1 or not 0 < backoff <= 1:
        raise ValueError("order must be at least 1 and backoff in (0, 1]")
    words = F.size(F.filter(F.split(text_of(), SPACE), lambda word: word != ""))
    facts = docs.agg(F.sum(words.cast("long")), F.sum(F.octet_length(text_of()))).first()
    n_all, buckets = facts[0] or 0, tasks_for(facts[0], BUCKET_WORDS)
    chunks = count_chunks(docs, tasks_for(facts[1], 4 * CHUNK_BYTES))
    totals = ngram_totals(chunks, order, buckets)

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        numbers, sums = right.column("bucket").to_numpy(), right.column("totals").to_pylist()
        for doc_ids, lengths, vocabulary, words in zip(
            *(left.column(n).to_pylist() for n in ("doc_ids", "doc_words", "vocabulary", "words"))
        ):
            grams = _grams(vocabulary, words, lengths, order)
            distinct, _ = _distinct(grams)
            counts = np.zeros(len(distinct), np.int64)
            for start, end, data in zip(*_parts(distinct, buckets, numbers), sums):
                counts[start:end] = _counts_of(data)
            found = [counts[np.searchsorted(distinct, g).clip(0, max(0, len(distinct) - 1))] if len(distinct) else g for g in grams]
            scores = _score(grams, found, n_all, backoff, min_count)
            owner = np.repeat(np.arange(len(lengths)), lengths)
            sums = np.bincount(owner, weights=scores, minlength=len(lengths))
            rows += zip(doc_ids, lengths, sums.tolist())
        if not rows:
            return SCORE_SCHEMA.empty_table()
        return pa.Table.from_batches(list(batches_of(iter(rows), SCORE_SCHEMA)))

    scored = chunks.groupBy("chunk").cogroup(totals.groupBy("chunk")).applyInArrow(join, SCORES)
    mean = F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words"))
    return scored.withColumn("mean_log_score", mean)


def _score(grams, counts, n_all: int, backoff: float, min_count: int) -> np.ndarray:
    """The logarithm of each word's score, from the shortest n-gram to the longest."""
    if not len(grams[0]):
        return np.zeros(0)
    scores = np.log(counts[0] / n_all)
    for n in range(1, len(grams)):
        there = grams[n] != 0
        known = there & (counts[n] >= min_count)
        context = np.concatenate([[1], counts[n - 1][:-1]])
        scores = np.where(there, scores + math.log(backoff), scores)
        scores[known] = np.log(counts[n][known] / context[known])
    return scores
