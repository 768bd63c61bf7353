"""Incremental line deduplication that can be undone: cuckoo filters over exact counts.

A line's key is its text without white space at the ends, A-Z lower-cased; a key is told by a
128-bit hash of its bytes. The state of a ``LineIndex`` is two tables in the shared folder:

- counts: for each key the exact number of documents that hold it, by shard of the key;
- filters: for each shard a cuckoo filter of the keys in ``min_documents`` documents or more.

``insert`` and ``delete`` add or take away whole documents: their keys are summed map-side,
merged into the counts, and keys that cross the threshold enter or leave their shard's
filter. Deleting what was inserted leaves the counts as they were, so both are reversible.
``repeated`` sends the keys of documents past the filter of their shard, a stream of rows
behind one filter row, and checks what passes against the exact counts, so a false alarm of
a filter never costs a line. ``apply`` drops the lines.

Shards grow with the number of keys. A line that a third of the documents hold is counted by
partial sums, its rows are spread over as many salted copies of its shard's filter as the
shard's counts call for, and the join with the exact counts can be split by Spark. Only
hashes are shuffled, but for the last join, which brings each document its repeated keys.

A null or empty text is one empty line. Keys shorter than ``min_chars`` code points are never
counted. A document counts once for a key, however often it repeats it; rows are documents
of their own, also where ids or whole rows repeat or ids are null. Extra columns are kept by
``apply``; its result columns replace columns of the same name. Empty tables are fine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import batches_of, fresh, materialise, rows_of, tasks_for
from tidemark.session import run_folder

# The white space that is stripped from a line.
SPACE = b" \t\n\x0b\x0c\r"

# Keys that one shard holds, rows of lines that pass one copy of a filter, bytes of text that
# one task splits.
SHARD_KEYS = 500_000
PROBE_ROWS = 1_000_000

KEY_COLUMNS = "doc_id long, hi long, lo long"
KEY_SCHEMA = pa.schema([("doc_id", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64())])
COUNT_COLUMNS = "shard int, hi long, lo long, n_docs long"
FILTER_COLUMNS = "shard int, filter binary"
FILTER_SCHEMA = pa.schema([("shard", pa.int32()), ("filter", pa.binary())])

SLOTS, KICKS = 4, 500


def line_key(line: bytes) -> bytes:
    return line.strip(SPACE).lower()


def key_hash(key: bytes) -> tuple[int, int]:
    digest = xxhash.xxh3_128_digest(key)
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)


def _counted(key: bytes, min_chars: int) -> bool:
    if len(key) >= 4 * min_chars:
        return True
    return len(key) >= min_chars and len(key.decode()) >= min_chars


class CuckooFilter:
    """16-bit fingerprints in buckets of four, each in one of two buckets; keys can be deleted.

    The second bucket is the first one xor a hash of the fingerprint, so a fingerprint can move
    without its key. Where an insertion finds no place the table is followed by another one.
    """

    def __init__(self, n_keys: int):
        buckets = 1 << max(4, int(np.ceil(np.log2(max(1, n_keys) / SLOTS / 0.85))))
        self.tables = [np.zeros((buckets, SLOTS), "<u2")]

    @staticmethod
    def _fingerprint(hi: int) -> int:
        return (hi & 0xFFFF) or 1

    @staticmethod
    def _other(table: np.ndarray, bucket: int, fingerprint: int) -> int:
        return (bucket ^ (fingerprint * 0x5BD1E995 >> 7)) & len(table) - 1

    def _places(self, table: np.ndarray, hi: int, lo: int) -> tuple[int, int, int]:
        fingerprint = self._fingerprint(hi)
        first = lo & len(table) - 1
        return fingerprint, first, self._other(table, first, fingerprint)

    def insert(self, hi: int, lo: int) -> None:
        table = self.tables[-1]
        fingerprint, first, second = self._places(table, hi, lo)
        for bucket in (first, second):
            free = np.flatnonzero(table[bucket] == 0)
            if len(free):
                table[bucket, free[0]] = fingerprint
                return
        bucket, moves = second, []
        for kick in range(KICKS):
            slot = (fingerprint + kick) % SLOTS
            moves.append((bucket, slot))
            fingerprint, table[bucket, slot] = int(table[bucket, slot]), fingerprint
            bucket = self._other(table, bucket, fingerprint)
            free = np.flatnonzero(table[bucket] == 0)
            if len(free):
                table[bucket, free[0]] = fingerprint
                return
        for bucket, slot in reversed(moves):
            fingerprint, table[bucket, slot] = int(table[bucket, slot]), fingerprint
        self.tables.append(np.zeros((2 * len(table), SLOTS), "<u2"))
        self.insert(hi, lo)

    def delete(self, hi: int, lo: int) -> bool:
        for table in self.tables:
            fingerprint, first, second = self._places(table, hi, lo)
            for bucket in (first, second):
                found = np.flatnonzero(table[bucket] == fingerprint)
                if len(found):
                    table[bucket, found[0]] = 0
                    return True
        return False

    def holds(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """For arrays of key halves: which may be in the filter. Never misses a key."""
        fingerprint = hi.astype(np.int64) & 0xFFFF
        fingerprint = np.where(fingerprint == 0, 1, fingerprint)
        found = np.zeros(len(hi), bool)
        for table in self.tables:
            mask = len(table) - 1
            first = lo & mask
            second = (first ^ (fingerprint * 0x5BD1E995 >> 7)) & mask
            wanted = fingerprint[:, None]
            found |= ((table[first] == wanted) | (table[second] == wanted)).any(1)
        return found

    def to_bytes(self) -> bytes:
        head = np.array([len(self.tables)] + [len(table) for table in self.tables], "<u4")
        return head.tobytes() + b"".join(table.tobytes() for table in self.tables)

    @classmethod
    def from_bytes(cls, data: bytes) -> "CuckooFilter":
        made = cls.__new__(cls)
        n = int.from_bytes(data[:4], "little")
        at, made.tables = 4 + 4 * n, []
        for size in np.frombuffer(data, "<u4", n, 4):
            table = np.frombuffer(data, "<u2", int(size) * SLOTS, at).reshape(-1, SLOTS).copy()
            made.tables.append(table)
            at += table.nbytes
        return made


def line_keys(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """One row per document and key of its lines."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def keys():
            for doc_id, text in rows_of(batches, "doc_id", "text"):
                lines = (text or "").encode().split(b"\n")
                for key in dict.fromkeys(map(line_key, lines)):
                    if _counted(key, min_chars):
                        yield doc_id, *key_hash(key)

        yield from batches_of(keys(), KEY_SCHEMA, size=20_000)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(explode, KEY_COLUMNS)


def _shard(shards: int) -> Column:
    return F.pmod(F.shiftrightunsigned("lo", 20), F.lit(shards)).cast("int")


class LineIndex:
    """Counts and filters of one corpus; each change writes new tables beside the old ones."""

    def __init__(self, spark: SparkSession, min_documents: int = 10, min_chars: int = 1):
        if min_documents < 1 or min_chars < 0:
            raise ValueError("min_documents must be at least 1, min_chars at least 0")
        self.spark, self.min_documents, self.min_chars = spark, min_documents, min_chars
        self.folder, self.version, self.shards = run_folder(spark, "lines"), 0, None
        self.counts = self.filters = None

    def insert(self, docs: DataFrame) -> None:
        self._change(docs, 1)

    def delete(self, docs: DataFrame) -> None:
        """Takes documents away that were inserted before; their rows must be given again."""
        self._change(docs, -1)

    def _change(self, docs: DataFrame, sign: int) -> None:
        added = (
            line_keys(docs, self.min_chars)
            .groupBy("hi", "lo")
            .agg((F.lit(sign) * F.count("*")).alias("n_docs"))
        )
        if self.counts is None:
            if sign < 0:
                raise ValueError("nothing has been inserted yet")
            added = materialise(added, "line-counts")
            self.shards = tasks_for(added.count(), SHARD_KEYS)
            merged = added.select(
                _shard(self.shards).alias("shard"), "hi", "lo", "n_docs", F.lit(0).cast("long").alias("old")
            )
        else:
            old = self.counts.select("hi", "lo", "n_docs", F.col("n_docs").alias("old"))
            both = old.unionByName(added.withColumn("old", F.lit(0).cast("long")))
            merged = both.groupBy("hi", "lo").agg(
                F.sum("n_docs").alias("n_docs"), F.sum("old").alias("old")
            )
            merged = merged.select(_shard(self.shards).alias("shard"), "hi", "lo", "n_docs", "old")
        changed = materialise(merged, "line-changes")
        if sign < 0 and changed.where("n_docs < 0").limit(1).count():
            raise ValueError("these documents have not all been inserted")
        self.version += 1
        path = f"{self.folder}/counts-{self.version}"
        changed.where("n_docs > 0").drop("old").write.parquet(path)
        self.counts = self.spark.read.schema(COUNT_COLUMNS).parquet(path)
        crossing = changed.where(
            (F.col("n_docs") >= self.min_documents) != (F.col("old") >= self.min_documents)
        ).select("shard", "hi", "lo", (F.col("n_docs") >= self.min_documents).alias("enters"))
        self._update_filters(crossing)

    def _update_filters(self, crossing: DataFrame) -> None:
        """Streams each shard's filter, if there is one, and then its changes through a task."""
        none = F.lit(None)
        changes = crossing.select("shard", "hi", "lo", "enters", none.cast("binary").alias("filter"))
        if self.filters is not None:
            before = self.filters.select(
                "shard", none.cast("long").alias("hi"), none.cast("long").alias("lo"),
                none.cast("boolean").alias("enters"), "filter",
            )
            changes = changes.unionByName(before)

        def update(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def filters():
                shard = current = None
                for number, hi, lo, enters, data in rows_of(
                    batches, "shard", "hi", "lo", "enters", "filter"
                ):
                    if number != shard:
                        if current is not None:
                            yield shard, current.to_bytes()
                        shard = number
                        current = CuckooFilter.from_bytes(data) if data else CuckooFilter(64)
                    if hi is not None:
                        current.insert(hi, lo) if enters else current.delete(hi, lo)
                if current is not None:
                    yield shard, current.to_bytes()

            yield from batches_of(filters(), FILTER_SCHEMA, weight=lambda row: len(row[1]))

        path = f"{self.folder}/filters-{self.version}"
        # A shard's filter row comes first; keys follow in a fixed order.
        ordered = changes.repartition(self.shards, "shard").sortWithinPartitions(
            "shard", F.col("hi").asc_nulls_first(), "lo"
        )
        ordered.mapInArrow(update, FILTER_COLUMNS).write.parquet(path)
        self.filters = self.spark.read.schema(FILTER_COLUMNS).parquet(path)

    def repeated(self, docs: DataFrame) -> DataFrame:
        """(doc_id, hi, lo) of the keys of ``docs`` in ``min_documents`` documents or more."""
        salts = self.counts.groupBy("shard").agg(
            F.ceil(F.sum("n_docs") / F.lit(PROBE_ROWS)).cast("int").alias("salts")
        )
        copies = (
            self.filters.join(salts, "shard")
            .select("shard", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "filter")
        )
        # As many salts as the fullest shard has copies; a shard with fewer folds them.
        keys = line_keys(docs, self.min_chars).withColumn("shard", _shard(self.shards))
        # A row a shard; joined by shuffle, few shards would bring all keys to few tasks.
        keys = keys.join(F.broadcast(salts) if self.shards <= 10_000 else salts, "shard").select(
            "shard",
            F.pmod(F.xxhash64("doc_id", "hi"), F.col("salts")).cast("int").alias("salt"),
            F.lit(None).cast("binary").alias("filter"), "doc_id", "hi", "lo",
        )
        none = F.lit(None).cast("long")
        streamed = copies.select(
            "shard", "salt", "filter", none.alias("doc_id"), none.alias("hi"), none.alias("lo")
        ).unionByName(keys)

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            place, current = None, None
            for batch in batches:
                columns = {n: batch.column(n) for n in ("shard", "salt", "doc_id", "hi", "lo")}
                number = columns["shard"].to_numpy().astype(np.int64) << 32
                number = number | columns["salt"].to_numpy()
                cuts = np.flatnonzero(np.diff(number)) + 1
                for start, end in zip([0, *cuts], [*cuts, batch.num_rows]):
                    if start == end:
                        continue
                    if number[start] != place:
                        place, current = number[start], None
                    if batch.column("filter")[start].is_valid:
                        current = CuckooFilter.from_bytes(batch.column("filter")[start].as_py())
                        start += 1
                    if current is None or start == end:
                        continue
                    rows = batch.select(["doc_id", "hi", "lo"]).slice(start, end - start)
                    passed = current.holds(rows.column("hi").to_numpy(), rows.column("lo").to_numpy())
                    if passed.any():
                        yield rows.filter(pa.array(passed))

        ordered = streamed.repartition("shard", "salt").sortWithinPartitions(
            "shard", "salt", F.col("filter").isNull()
        )
        passed = ordered.mapInArrow(probe, KEY_COLUMNS)
        exact = self.counts.where(F.col("n_docs") >= self.min_documents).select("hi", "lo")
        return passed.join(exact, ["hi", "lo"]).select("doc_id", "hi", "lo")

    def apply(self, docs: DataFrame) -> DataFrame:
        """``docs`` with ``kept_text``, ``n_lines`` and ``n_dropped``, repeated lines left out."""
        names = ["kept_text", "n_lines", "n_dropped"]
        rows = docs.drop(*names)
        keys, owner, cut = (fresh(rows, name) for name in ("_repeated", "_doc_id", "_cut"))
        found = self.repeated(docs).groupBy("doc_id").agg(F.collect_set(F.struct("hi", "lo")).alias(keys))
        found = found.withColumnRenamed("doc_id", owner)
        joined = rows.join(found, rows["doc_id"].cast("long").eqNullSafe(found[owner]), "left")
        return joined.withColumn(cut, _drop_lines("text", keys)).select(
            *rows.columns, *[f"{cut}.{name}" for name in names]
        )


def _drop_lines(text: str, repeated: str) -> Column:
    @F.pandas_udf("kept_text string, n_lines long, n_dropped long")
    def drop(texts, keys_of_texts):
        import pandas as pd

        rows = []
        for one, keys in zip(texts, keys_of_texts):
            lines = (one or "").encode().split(b"\n")
            kept = lines
            if keys is not None and len(keys):
                gone = {(key["hi"], key["lo"]) for key in keys}
                kept = [line for line in lines if key_hash(line_key(line)) not in gone]
            rows.append((b"\n".join(kept).decode(), len(lines), len(lines) - len(kept)))
        return pd.DataFrame(rows, columns=["kept_text", "n_lines", "n_dropped"])

    return drop(F.col(text), F.col(repeated))


def dedup_lines(docs: DataFrame, min_documents: int = 10, min_chars: int = 1) -> DataFrame:
    """``docs`` without the lines that ``min_documents`` of its own documents share."""
    index = LineIndex(docs.sparkSession, min_documents, min_chars)
    index.insert(docs)
    return index.apply(docs)
