"""SimHash near-duplicates through an inverted index of fingerprint bytes.

A text's fingerprint has 64 bits: bit i is set if it is set in over half the XXH64 values of
its word shingles. Two fingerprints that differ in at most ``radius`` bits share at least
``8 - radius`` of their eight bytes, place by place: that is the least tally of shared
positional bytes, and it filters the pairs. Posting single bytes and tallying pair by pair
would make a square number of pairs in each list, so the index posts a fingerprint under
every set of ``8 - radius`` places with the bytes found there: who meets in a list has
reached the tally. A list holds distinct fingerprints that differ in ``radius`` bytes only.

Lists stream through tasks sorted by their key. In a list each fingerprint looks up what is
within the radius on the bytes left (few values, however many rows) and is linked to the
first of its group, so a list of m fingerprints gives fewer than m links and no pairs are
spread out; the links found are checked on all 64 bits. Components come from star
contractions over the links of distinct fingerprints; copies of a fingerprint, even a third
of all rows, are grouped first by partial aggregation.

Null and empty texts have no words and the fingerprint zero, linked like any other. Repeated
rows are of one group; rows without id take part, but never give a component its id unless
no other row can. Extra columns are kept; result columns replace columns of the same name.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialise
from tidemark.llm.components import connected_components

SEED = 42
LINK_COLUMNS = "a long, b long"
LINK_SCHEMA = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def shingle_hashes(text: str | None, shingle_words: int) -> np.ndarray:
    """XXH64 of every word shingle of a text, repeats included, A-Z lower-cased."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, "<u8")
    if len(words) < shingle_words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], "<u8")
    joined = b" ".join(words)
    ends = np.cumsum([len(word) + 1 for word in words]) - 1
    starts = [0, *(ends[: len(words) - shingle_words] + 1).tolist()]
    stops = ends[shingle_words - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[i:j], SEED) for i, j in zip(starts, stops)]
    return np.array(hashes, "<u8")


def simhash(hashes: np.ndarray, chunk: int = 1 << 16) -> int:
    """The fingerprint of shingle hashes, as a signed 64-bit integer."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), chunk):
        bits = hashes[at : at + chunk].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(bits, axis=1, bitorder="little").sum(0, dtype=np.int64)
    packed = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(packed.view("<i8")[0])


def fingerprints(docs: DataFrame, shingle_words: int = 3) -> DataFrame:
    """``docs`` with ``fingerprint_bits``, a long."""

    @F.pandas_udf("long")
    def of(texts):
        return texts.map(lambda text: simhash(shingle_hashes(text, shingle_words)), na_action=None)

    return docs.withColumn("fingerprint_bits", of("text"))


def near_links(distinct: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) that join all distinct ``fingerprint_bits`` within a radius.

    Fingerprints within the radius are linked directly or through others that are.
    """
    if not 0 <= radius <= 3:
        raise ValueError("radius must be from 0 to 3")
    masks = [
        sum(0xFF << 8 * place for place in range(8) if place not in out)
        for out in combinations(range(8), radius)
    ]
    signed = [mask - (1 << 64) if mask >> 63 else mask for mask in masks]
    posted = distinct.select(
        F.col("fingerprint_bits").alias("value"),
        F.posexplode(F.array(*[F.lit(mask) for mask in signed])).alias("places", "mask"),
    )
    lists = posted.select("places", F.col("value").bitwiseAND(F.col("mask")).alias("shared"), "value")
    ordered = lists.repartition("places", "shared").sortWithinPartitions("places", "shared", "value")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = None
        for batch in batches:
            rows = np.stack([batch.column(n).to_numpy() for n in ("places", "shared", "value")])
            rows = rows if carried is None else np.hstack([carried, rows])
            cuts = np.flatnonzero((np.diff(rows[:2]) != 0).any(0)) + 1
            last = int(cuts[-1]) if len(cuts) else 0
            carried = rows[:, last:]
            yield _links(rows[2, :last], cuts[:-1], radius)
        if carried is not None:
            yield _links(carried[2], np.zeros(0, np.int64), radius)

    found = ordered.mapInArrow(link, LINK_COLUMNS)
    apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    return found.where(apart <= radius).distinct()


def _links(values: np.ndarray, cuts: np.ndarray, radius: int) -> pa.RecordBatch:
    starts = np.concatenate([[0], cuts]).astype(np.int64)
    stops = np.concatenate([cuts, [len(values)]]).astype(np.int64)
    pairs: list[tuple[int, int]] = []
    for at in np.flatnonzero(stops - starts > 1):
        pairs += _spanning(values[starts[at] : stops[at]], radius)
    return pa.RecordBatch.from_arrays(
        [pa.array([pair[side] for pair in pairs], pa.int64()) for side in (0, 1)], schema=LINK_SCHEMA
    )


def _spanning(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect the values of one list as all its pairs within the radius would.

    Values are visited from one to the next; each looks at those not yet reached, so a value
    is linked once, and a list in which all are near takes one look.
    """
    if len(values) == 2:
        near = int(values[0] ^ values[1]) & (1 << 64) - 1
        return [(int(values[0]), int(values[1]))] if near.bit_count() <= radius else []
    pairs, left = [], np.unique(values)
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            one = front.pop()
            near = np.bitwise_count((left ^ one).view(np.uint64)) <= radius
            for other in left[near]:
                pairs.append((int(one), int(other)))
                front.append(other)
            left = left[~near]
    return pairs


def _classes(groups: DataFrame, radius: int) -> DataFrame:
    """(fingerprint_bits, ..., root) for grouped fingerprints; root tells the component."""
    links = near_links(groups.select("fingerprint_bits"), radius)
    roots = connected_components(links).withColumnRenamed("node", "fingerprint_bits")
    return groups.join(roots, "fingerprint_bits", "left").withColumn(
        "root", F.coalesce("root", "fingerprint_bits")
    )


def near_components(docs: DataFrame, radius: int = 2, shingle_words: int = 3) -> DataFrame:
    """For each row doc_id, ``fingerprint`` (16 hex digits) and ``component_id``."""
    narrow = docs.select(F.col("doc_id").cast("long"), "text")
    slim = materialise(
        fingerprints(narrow, shingle_words).select("doc_id", "fingerprint_bits"), "fingerprints"
    )
    groups = slim.groupBy("fingerprint_bits").agg(F.min("doc_id").alias("least_id"))
    classes = materialise(_classes(materialise(groups, "fingerprint-groups"), radius), "classes")
    least = classes.groupBy("root").agg(F.min("least_id").alias("component_id"))
    placed = slim.join(classes.join(least, "root"), "fingerprint_bits")
    digits = F.lower(F.lpad(F.hex("fingerprint_bits"), 16, "0"))
    return placed.select("doc_id", digits.alias("fingerprint"), "component_id")


def keep_one_each(docs: DataFrame, radius: int = 2, shingle_words: int = 3) -> DataFrame:
    """``docs`` with one row of each component: that with the least id, the first of equal ones."""
    marked = fingerprints(docs.drop("fingerprint_bits", "_row"), shingle_words)
    rows = materialise(marked.withColumn("_row", F.monotonically_increasing_id()), "fingerprinted")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")
    groups = rows.groupBy("fingerprint_bits").agg(F.min(order).alias("first"))
    classes = _classes(materialise(groups, "fingerprint-groups"), radius)
    kept = classes.groupBy("root").agg(F.min("first").alias("first")).select("first._row")
    return rows.join(kept, "_row", "left_semi").drop("_row", "fingerprint_bits")
