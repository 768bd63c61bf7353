"""Columns whose names clash, very long texts, and the stages of the pipeline one by one."""


import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tidemark.llm import decontaminate, line_dedup, packing, quality, sharding, suffix, wavelet

SPACE = " \t\n\x0b\x0c\r"
CLASHES = "_words _lines _cut _repeated _doc_id _found _row _leaks row found block salt shard core name filter".split()


def clashing(spark, texts):
    rows = [(at, text, *[f"{name}{at}" for name in CLASHES]) for at, text in enumerate(texts)]
    columns = ", ".join(f"`{name}` string" for name in CLASHES)
    return spark.createDataFrame(rows, f"doc_id long, text string, {columns}")


@pytest.mark.parametrize("block_bytes", [4 << 20, 100])
def test_extra_columns_come_back_as_they_were(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block_bytes)
    passage = " ".join(f"w{at}" for at in range(120))
    docs = clashing(spark, [passage, f"a b c\n{passage}\nd e", None, "", "same line\nx", "same line\ny"])
    items = spark.createDataFrame([(1, passage), (2, "item of ten words that none of the texts holds anywhere")], "item_id long, text string")
    given = {row["doc_id"]: row for row in docs.collect()}
    for found in (
        quality.judge(docs),
        line_dedup.dedup_lines(docs, min_documents=2),
        suffix.remove_repeats(docs),
        decontaminate.find_leaks(docs, items),
    ):
        assert found.columns[: len(docs.columns)] == docs.columns
        rows = found.collect()
        assert len(rows) == len(given)
        for row in rows:
            assert row[: len(docs.columns)] == given[row["doc_id"]][:]


def test_shards_of_many_tasks_are_merged_as_a_tree(spark, monkeypatch):
    monkeypatch.setattr(sharding, "FAN", 3)
    monkeypatch.setattr(sharding, "TASK_GROUPS", 40)
    draw = random.Random(2)
    texts = ["x" * draw.randrange(1, 400) + str(at) for at in range(900)] + ["giant" * 4000, None, "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sharding.shard_documents(docs).collect()
    assert len(rows) == len(texts)
    sums = Counter()
    for row in rows:
        assert row["size"] == len(texts[row["doc_id"]] or "") + 1
        sums[row["shard"]] += row["size"]
    assert max(sums.values()) - sorted(sums.values())[0] <= 20_000
    plain = sorted(sums.values())[:-1]
    assert len(sums) == 16 and max(plain) - min(plain) <= 400
    of_text = {}
    for row in rows:
        assert of_text.setdefault(texts[row["doc_id"]] or "", row["shard"]) == row["shard"]
    for shard in range(16):
        assert sorted(row["slot"] for row in rows if row["shard"] == shard) == list(range(sum(row["shard"] == shard for row in rows)))


def long_text(seed, size=3_200_000):
    draw = random.Random(seed)
    words = ["".join(draw.choices("abcdefghijklmnoprstu", k=draw.randrange(2, 9))) for _ in range(40_000)]
    lines = [" ".join(draw.choices(words, k=12)) + "." for _ in range(size // 70)]
    return "\n".join(lines)


def test_texts_of_megabytes_lose_their_repeats(spark):
    passage = " ".join(f"passage{at}" for at in range(60))
    long = long_text(1)
    middle = len(long) // 2
    texts = [long[:middle] + passage + long[middle:] + passage, passage[:-3], long_text(2), long[-500_000:]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {row["doc_id"]: row for row in suffix.remove_repeats(docs).collect()}
    last = long[-500_000:]
    wanted = {
        0: long[:middle] + long[middle:-500_000],
        1: "",
        2: texts[2],
        3: "",
    }
    # The last character before the passage may begin a string that the other text has as well.
    for doc, text in wanted.items():
        kept = bytes(found[doc]["kept"]).decode()
        assert kept == text, (doc, len(kept), len(text))
    assert last


def test_texts_of_megabytes_are_encoded_and_packed_whole(spark):
    texts = [long_text(3), None, "x", long_text(4, 1_100_000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    start, wanted = 0, []
    for doc, text in enumerate(texts):
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        wanted.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    found = wavelet.read_digests(wavelet.write_shards(docs, path))
    assert sorted(map(tuple, found.collect())) == wanted
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    pieces = packing.pack(docs, path).collect()
    for doc, text in enumerate(texts):
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        mine = sorted((row["start"], row["length"], row["ids_crc32"]) for row in pieces if row["doc_id"] == doc)
        at = 0
        for first, length, crc in mine:
            assert first == at and crc == zlib.crc32(ids[first : first + length].tobytes())
            at += length
        assert at == len(ids)


# -- the stages of the pipeline --------------------------------------------------------


@pytest.fixture(scope="module")
def stage_docs(spark, tmp_path_factory):
    draw = random.Random(9)
    words = [f"word{draw.randrange(3000)}" for _ in range(6000)]
    item = " ".join(f"item{at}" for at in range(30))
    texts = [None, "", "short.", " \n\t"]
    for at in range(60):
        lines = [" ".join(draw.choices(words, k=12)).capitalize() + "." for _ in range(5)]
        if at % 4 == 0:
            lines.insert(2, "This line is one that many documents share with each other.")
        if at % 10 == 0:
            lines.append(item.capitalize() + ".")
        texts.append("\n".join(lines))
    texts += [texts[10], texts[10].upper(), texts[11] + " "]
    rows = [(at, text, "en", len(text or ""), "kept as it is") for at, text in enumerate(texts)]
    rows += [rows[12], (None, texts[13], "de", 1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long, leaks string")
    folder = tmp_path_factory.mktemp("stages")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def read(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def rows_of(frame):
    return sorted((tuple(row) for row in frame.collect()), key=str)


def test_quality_stage_keeps_what_the_operator_keeps(spark, stage_docs):
    docs = read(spark, stage_docs)
    found = stage("quality_rules")(spark, docs, stage_docs)
    judged = quality.judge(docs).where("kept").collect()
    assert found.columns == docs.columns and 50 <= len(judged) == found.count() < docs.count()
    wanted = [
        (row["doc_id"], row["clean_text"] if row["n_failed_lines"] else row["text"]) for row in judged
    ]
    assert sorted(((row["doc_id"], row["text"]) for row in found.collect()), key=str) == sorted(wanted, key=str)


def test_line_stage_equals_brute_force(spark, stage_docs):
    docs = read(spark, stage_docs)
    given = docs.collect()
    key = lambda line: "".join(c.lower() if c.isascii() else c for c in line.strip(SPACE))
    holders = Counter(k for row in given for k in {key(line) for line in (row["text"] or "").split("\n")} if k)
    wanted = []
    for row in given:
        lines = [line for line in (row["text"] or "").split("\n") if holders[key(line)] < 10]
        text = "\n".join(lines)
        wanted.append((row["doc_id"], text, row["lang"], len(text), row["leaks"]))
    assert rows_of(stage("line_dedup")(spark, docs, stage_docs)) == sorted(wanted, key=str)


def fingerprint(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    found = [" ".join(words[k : k + 3]).encode() for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(one, 42) for one in found]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_duplicate_stage_keeps_one_of_each_group(spark, stage_docs):
    docs = read(spark, stage_docs)
    prints = [fingerprint(row["text"]) for row in docs.collect()]
    group = list(range(len(prints)))
    for _ in prints:
        for i, a in enumerate(prints):
            for k, b in enumerate(prints):
                if (a ^ b).bit_count() <= 2:
                    group[i] = min(group[i], group[k])
    found = stage("near_duplicates")(spark, docs, stage_docs)
    assert found.columns == docs.columns
    kept = found.collect()
    assert len(kept) == len(set(group))
    assert len({fingerprint(row["text"]) for row in kept}) == len(kept)


def test_decontamination_stage_drops_what_holds_an_item(spark, stage_docs):
    docs = read(spark, stage_docs)
    found = stage("decontamination")(spark, docs, stage_docs)
    wanted = [tuple(row) for row in docs.collect() if "item29" not in (row["text"] or "").lower()]
    assert found.columns == docs.columns and rows_of(found) == sorted(wanted, key=str)


def test_the_pipeline_is_its_stages_one_after_the_other(spark, stage_docs):
    docs = read(spark, stage_docs)
    for _, function in corpus_pipeline.STAGES[:-1]:
        docs = function(spark, docs, stage_docs)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    wanted = Counter()
    for row in docs.collect():
        ids = np.array(tokenizer.encode(row["text"] or "", add_special_tokens=False).ids + [2], "<u4")
        wanted[len(ids), zlib.crc32(ids.tobytes())] += 1
    found = corpus_pipeline.run(spark, stage_docs).collect()
    assert Counter((row["length"], row["ids_crc32"]) for row in found) == wanted
    by_sequence = {}
    for row in found:
        by_sequence.setdefault(row["sequence_id"], []).append((row["offset"], row["length"]))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096


def test_stages_take_empty_tables(spark, stage_docs):
    docs = read(spark, stage_docs).where("false")
    for _, function in corpus_pipeline.STAGES:
        assert function(spark, docs, stage_docs).count() == 0


