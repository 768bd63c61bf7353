"""Finds benchmark items in documents by SimHash over item-sized windows.

Texts are lower-cased and cut into words (runs of ASCII letters, digits and ``_``, and of all
that is not ASCII); shingles are five words. Every window of as many words as an item has gets a 64-bit SimHash of its shingles.
The items' fingerprints lie in a multi-index of eight bytes: if two fingerprints differ in at
most ``radius`` bits, some byte differs in at most ``radius // 8``, so the index of the items
of one length holds each under all bytes that near and a window that looks up its eight bytes
misses no item within the radius. Candidates are then verified exactly: the weighted Jaccard similarity of
the shingles, weights being how often each occurs, must reach ``similarity``.

A window that reaches the similarity shares that part of its shingles with items, so windows
that share less with all items together are passed over before fingerprints are made; this
loses nothing. Work on a document grows with its length. Items are sent to the tasks in
blocks of about ``BLOCK_BYTES`` of text. One block needs no shuffle and no join; of several,
each is a pass of its own over the documents, whose leaks are written to the shared folder
before the next block is read, and these are joined to the documents in the end.

Null and empty texts hold no item. Items of fewer than ``shingle_words`` words (null ones
too) cannot be told from common phrases and are not searched for. Items without id are
searched for and reported with a null id, once for each text, unless an item with an id has
that text and is reported for it. Repeated documents are
each judged, items of equal text each reported. Extra columns are kept; a column named like
the result is replaced. Empty tables are fine.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fresh, materialise, tasks_for, text_of
from tidemark.session import run_folder

BLOCK_BYTES = 4 << 20
# Windows whose starts lie in one stretch of so many shingles share a running sum.
SEGMENT = 1 << 16
LEAKS = "array<struct<item_id:long,start:int,n_words:int,distance:int,similarity:double>>"

# ASCII letters, digits and ``_`` stay in words, like all that is not ASCII.
_PARTS = bytes(
    code if code >= 128 or chr(code).isalnum() or code == 95 else 32 for code in range(256)
)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8").translate(_PARTS).split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(word) for word in words], np.uint64)


def mixed(one: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash for each window of ``size`` word hashes."""
    if len(one) < size:
        return np.zeros(0, np.uint64)
    found = np.zeros(len(one) - size + 1, np.uint64)
    for k in range(size):
        found = (found ^ one[k : k + len(found)]) * _MIX
        found ^= found >> np.uint64(29)
    return found


def shingles(text: str | None, size: int) -> np.ndarray:
    return mixed(word_hashes(words_of(text)), size)


def window_fingerprints(hashes: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """SimHash of the ``size`` shingle hashes from each start."""
    low = int(starts.min())
    return _majorities(_ones(hashes[low : int(starts.max()) + size]), starts - low, size)


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes before each place have a bit set, for each of the 64 bits."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.vstack([np.zeros((1, 64), np.int32), np.cumsum(bits, 0, dtype=np.int32)])


def _majorities(ones: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    major = 2 * (ones[at + size] - ones[at]) > size
    return np.packbits(major, axis=1, bitorder="little").view(np.uint64).ravel()


class MultiIndex:
    """Fingerprints by their eight bytes and all bytes near these."""

    def __init__(self, items: np.ndarray, prints: np.ndarray, radius: int):
        self.items, self.prints, self.radius = items, prints, radius
        flips = [
            sum(1 << bit for bit in bits)
            for n in range(radius // 8 + 1)
            for bits in combinations(range(8), n)
        ]
        self.firsts, self.held = [], []
        for block in range(8):
            own = (prints >> np.uint64(8 * block) & np.uint64(255)).astype(np.int64)
            bytes_ = (own[:, None] ^ np.array(flips)).ravel()
            order = np.argsort(bytes_, kind="stable")
            self.firsts.append(np.searchsorted(bytes_[order], np.arange(257)))
            self.held.append(order // len(flips))

    def near(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of value, item, distance) of all pairs within the radius."""
        met = []
        for block in range(8):
            byte = (values >> np.uint64(8 * block) & np.uint64(255)).astype(np.int64)
            first = self.firsts[block][byte]
            n = self.firsts[block][byte + 1] - first
            at = np.arange(n.sum()) + np.repeat(first - np.cumsum(n) + n, n)
            met.append(np.repeat(np.arange(len(values)), n) * len(self.items) + self.held[block][at])
        place, item = np.divmod(np.unique(np.concatenate(met)), max(1, len(self.items)))
        distance = np.bitwise_count(values[place] ^ self.prints[item])
        close = distance <= self.radius
        return place[close], self.items[item[close]], distance[close]


class ItemIndex:
    """A block of items: their shingles, fingerprints and, by length, a multi-index over these."""

    def __init__(self, items: list[tuple[int, str]], size: int, radius: int):
        self.size, self.radius = size, radius
        made = [(item_id, shingles(text, size)) for item_id, text in items]
        made = [(item_id, hashes) for item_id, hashes in made if len(hashes)]
        self.ids = [item_id for item_id, _ in made]
        self.weights = [np.unique(hashes, return_counts=True) for _, hashes in made]
        self.lengths = np.array([len(hashes) for _, hashes in made], np.int64)
        self.all_shingles = np.unique(np.concatenate([np.zeros(0, np.uint64), *[h for _, h in made]]))
        # Numbers from 1 for the words of items, and their hashes by number.
        vocabulary = sorted({word for _, text in items for word in words_of(text)})
        self.number = {word: at for at, word in enumerate(vocabulary, 1)}
        self.hashes = np.concatenate([np.zeros(1, np.uint64), word_hashes(vocabulary)])
        zero = np.zeros(1, np.int64)
        prints = [window_fingerprints(hashes, zero, len(hashes))[0] for _, hashes in made]
        self.prints = np.array(prints, np.uint64)
        self.by_length = {}
        for length in np.unique(self.lengths).tolist():
            own = np.flatnonzero(self.lengths == length)
            self.by_length[length] = MultiIndex(own, self.prints[own], radius)

    def candidates(self, value: int) -> np.ndarray:
        """Items within the radius of a fingerprint."""
        values = np.array([value], np.uint64)
        near = [index.near(values)[1] for index in self.by_length.values()]
        return np.sort(np.concatenate([np.zeros(0, np.int64), *near]))

    def leaks(self, text: str | None, similarity: float) -> list[dict]:
        """The best window for each item that the text holds."""
        if not len(self.lengths):
            return []
        words = words_of(text)
        shared = self._shared(words)
        if shared[-1] < similarity * self.lengths.min():
            return []
        hashes = mixed(word_hashes(words), self.size)
        found = defaultdict(list)
        for start, n, item, distance in self._near_windows(hashes, shared, similarity):
            found[item].append((start, n, distance))
        best = [self._best(hashes, item, found[item], similarity) for item in sorted(found)]
        return [one for one in best if one]

    def _near_windows(self, hashes, shared, similarity) -> Iterator[tuple[int, int, int, int]]:
        """(start, length, item, distance) of windows within the radius of an item of their length
        that share enough shingles with all items; a text shorter than the item is one window."""
        n_all, windows = len(hashes), {}
        for length in self.by_length:
            if length <= n_all:
                starts = np.flatnonzero(shared[length:] - shared[:-length] >= similarity * length)
            else:
                starts = np.zeros(int(shared[-1] >= similarity * length), np.int64)
            if len(starts):
                windows[length] = starts
        lows = {int(part) for starts in windows.values() for part in np.unique(starts // SEGMENT)}
        for low in sorted(lows):
            mine = {}
            for length, starts in windows.items():
                of_segment = starts[starts // SEGMENT == low]
                if len(of_segment):
                    mine[length] = of_segment
            first = min(int(starts[0]) for starts in mine.values())
            last = max(int(starts[-1]) + length for length, starts in mine.items())
            # One running sum serves the windows of all lengths.
            ones = _ones(hashes[first:last])
            for length, starts in mine.items():
                n = min(length, n_all)
                values = _majorities(ones, starts - first, n)
                for place, item, distance in zip(*(x.tolist() for x in self.by_length[length].near(values))):
                    yield int(starts[place]), n, item, distance

    def _best(self, hashes, item: int, windows: list[tuple], similarity: float) -> dict | None:
        """The first of the windows most similar to an item, if they are similar enough.

        Places that hold any shingle of the item bound the similarity, so that few windows have
        their shingles counted.
        """
        keys, weights = self.weights[item]
        length = int(self.lengths[item])
        first = min(start for start, _, _ in windows)
        part = hashes[first : max(start + n for start, n, _ in windows)]
        place = np.searchsorted(keys, part).clip(0, len(keys) - 1)
        own = keys[place] == part
        before = np.concatenate([[0], np.cumsum(own)])
        bounded = [
            (-(int(before[start - first + n] - before[start - first])), start, n, distance)
            for start, n, distance in windows
        ]
        best = None
        for bound, start, n, distance in sorted(bounded):
            most = -bound / (n + length + bound)
            if most < similarity or (best and most <= best["similarity"]):
                break
            inside = place[start - first : start - first + n][own[start - first : start - first + n]]
            both = int(np.minimum(np.bincount(inside, minlength=len(keys)), weights).sum())
            score = both / (n + length - both)
            if score >= similarity and (not best or (-score, start) < (-best["similarity"], best["start"])):
                best = {
                    "item_id": self.ids[item],
                    "start": start,
                    "n_words": n + self.size - 1,
                    "distance": distance,
                    "similarity": score,
                }
        return best

    def _shared(self, words: list[bytes]) -> np.ndarray:
        """How many shingles before each place are those of an item.

        Only runs of words that items hold are hashed, so most of a text costs a lookup a word.
        """
        numbers = np.fromiter(map(self.number.get, words, repeat(0)), np.int64, len(words))
        n = len(numbers) - self.size + 1
        if n <= 0:
            return np.zeros(1, np.int64)
        strange = np.concatenate([[0], np.cumsum(numbers == 0)])
        at = np.flatnonzero(strange[self.size :] == strange[: -self.size])
        found = np.zeros(n + 1, np.int64)
        if len(at):
            runs = self.hashes[numbers[at[:, None] + np.arange(self.size)]]
            value = np.zeros(len(at), np.uint64)
            for k in range(self.size):
                value = (value ^ runs[:, k]) * _MIX
                value ^= value >> np.uint64(29)
            place = np.searchsorted(self.all_shingles, value)
            place[place == len(self.all_shingles)] = 0
            found[at + 1] = self.all_shingles[place] == value
        return np.cumsum(found)


def _leaks_in(index: ItemIndex, similarity: float, text: Column) -> Column:
    @F.pandas_udf(LEAKS)
    def leaks(texts):
        return texts.map(lambda one: index.leaks(one, similarity), na_action=None)

    # Else a filter on the result would make the optimizer work it out twice.
    return leaks.asNondeterministic()(text)


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    similarity: float = 0.8,
    radius: int = 15,
    shingle_words: int = 5,
) -> DataFrame:
    """``docs`` with ``leaks``: for each item found its best window, distance and similarity."""
    blocks = tasks_for(items.agg(F.sum(F.octet_length(text_of()))).first()[0], BLOCK_BYTES)
    narrow = items.select(F.col("item_id").cast("long"), text_of().alias("text"))
    named, nameless = narrow.where("item_id IS NOT NULL"), narrow.where("item_id IS NULL").distinct()
    narrow = named.unionByName(nameless.join(named.select("text"), "text", "left_anti"))

    def leaks_of(block: int) -> Column:
        mine = narrow.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        rows = sorted((tuple(row) for row in mine.collect()), key=lambda row: (row[0] is None, row[0] or 0, row[1]))
        return _leaks_in(ItemIndex(rows, shingle_words, radius), similarity, F.col("text"))

    if blocks == 1:
        return docs.withColumn("leaks", leaks_of(0))
    # A pass ends, and its index goes, before the next one is built.
    rows = docs.drop("leaks")
    row, own = fresh(rows, "_row"), fresh(rows, "_leaks")
    texts = materialise(rows.withColumn(row, F.monotonically_increasing_id()), "leak-texts")
    folder = run_folder(docs.sparkSession, "leaks")
    for block in range(blocks):
        passed = texts.select(F.col(row).alias("row"), leaks_of(block).alias("found"))
        passed.where(F.size("found") > 0).write.parquet(f"{folder}/block={block}")
    by_block = F.array_sort(F.collect_list(F.struct("block", "found")))
    found = (
        docs.sparkSession.read.schema(f"row long, found {LEAKS}, block int")
        .parquet(folder)
        .groupBy(F.col("row").alias(row))
        .agg(F.flatten(F.transform(by_block, lambda one: one["found"])).alias(own))
    )
    joined = texts.join(found, row, "left")
    leaks = F.coalesce(own, F.array().cast(LEAKS)).alias("leaks")
    return joined.select(*rows.columns, leaks)
