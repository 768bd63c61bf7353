"""Decontamination against a brute-force version that looks at every window for every item."""

import random
import re
from collections import Counter

import numpy as np
import xxhash

from tidemark.llm import decontaminate

COLUMNS = ("item_id", "start", "n_words", "distance", "similarity")


def shingle_hashes(text):
    words = [one.encode() for one in re.findall(r"[a-z0-9_\u0080-\U0010ffff]+", (text or "").lower())]
    found = []
    for at in range(len(words) - 4):
        value = np.zeros(1, np.uint64)
        for word in words[at : at + 5]:
            value = (value ^ np.uint64(xxhash.xxh3_64_intdigest(word))) * np.uint64(0x9E3779B97F4A7C15)
            value ^= value >> np.uint64(29)
        found.append(int(value[0]))
    return found


def simhash(hashes):
    return sum(1 << bit for bit in range(64) if 2 * sum(one >> bit & 1 for one in hashes) > len(hashes))


def brute_force(text, items, radius):
    hashes, found = shingle_hashes(text), []
    for item_id, item in items:
        wanted = shingle_hashes(item)
        best = None
        n = min(len(wanted), len(hashes))
        for start in range(len(hashes) - n + 1 if n else 0):
            window = hashes[start : start + n]
            both = sum((Counter(window) & Counter(wanted)).values())
            score = both / (n + len(wanted) - both)
            distance = (simhash(window) ^ simhash(wanted)).bit_count()
            if score >= 0.8 and distance <= radius and (best is None or score > best[4]):
                best = (item_id, start, n + 4, distance, score)
        found += [best] if best else []
    return sorted(found)


def edited(draw, words, share):
    return " ".join(draw.choice(["other", "", f"{word} more"]) if draw.random() < share else word for word in words)


def test_leaks_equal_brute_force(spark):
    draw = random.Random(4)
    items = [(at, " ".join(f"w{draw.randrange(60)}" for _ in range(draw.choice([9, 15, 15, 24])))) for at in range(30)]
    items += [(30, "again and again " * 6), (31, items[3][1]), (32, " ".join(items[5][1].split()[2:])), (33, None), (34, "four words are few")]
    rows = []
    for doc in range(60):
        parts = [f"w{draw.randrange(60)}" for _ in range(draw.randrange(30))]
        for _ in range(draw.randrange(3)):
            item = draw.choice(items)[1] or ""
            parts.append(edited(draw, item.split(), draw.choice([0, 0, 0.02, 0.05])))
            parts += [f"w{draw.randrange(60)}" for _ in range(draw.randrange(20))]
        rows.append((doc, ", ".join(parts).upper() if doc % 2 else "\n".join(parts)))
    rows += [(100, None), (101, ""), (102, "again and again " * 40), (103, items[0][1]), (None, items[0][1]), rows[0]]
    docs = spark.createDataFrame([(*row, 5, "x") for row in rows], "doc_id long, text string, _row int, leaks string")
    given = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_leaks(docs, given)
    assert found.columns == ["doc_id", "text", "_row", "leaks"]
    found = found.collect()
    key = lambda row: (str(row[0]), str(row[1]))
    got = sorted((row["doc_id"], row["text"], sorted(tuple(one[name] for name in COLUMNS) for one in row["leaks"])) for row in found if row["doc_id"] is not None)
    want = sorted((doc, text, brute_force(text, items, 15)) for doc, text in rows if doc is not None)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert sum(len(row[2]) for row in want) > 40


def test_radius_keeps_what_is_similar_enough():
    """Of windows whose similarity is just above the least one, 98 of 100 lie within the radius."""
    draw, near, all_ = np.random.default_rng(1), 0, 0
    for length in (15, 30, 60, 120):
        for _ in range(1000):
            item = draw.integers(0, 2**63, length).astype(np.uint64)
            window = item.copy()
            changed = int(length * 0.2 / 1.8)
            window[draw.choice(length, changed, replace=False)] = draw.integers(0, 2**63, changed)
            prints = [decontaminate.window_fingerprints(one, np.zeros(1, int), length)[0] for one in (item, window)]
            near += int(np.bitwise_count(prints[0] ^ prints[1]) <= 15)
            all_ += 1
    assert near / all_ >= 0.98, near / all_


def test_a_text_of_megabytes_and_one_evaluation(spark):
    draw = random.Random(5)
    item = " ".join(f"item{at}" for at in range(40))
    long = " ".join(draw.choice(["item3", "word", "x"]) for _ in range(700_000))
    rows = [(1, long + " " + item), (2, long), (3, item)]
    found = decontaminate.find_leaks(
        spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string")
    )
    leaks = found.select("doc_id", "leaks").where("size(leaks) > 0")
    assert leaks._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    got = {row["doc_id"]: [(one["start"], one["similarity"]) for one in row["leaks"]] for row in leaks.collect()}
    assert got == {1: [(700_000, 1.0)], 3: [(0, 1.0)]}
