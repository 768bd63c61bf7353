"""Alignment of two tokenizers against a brute-force version that calls both on whole texts."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tidemark.llm import alignment, queries

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split()
ODD = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "x\n\n  y", "x \n y", "\n", "\t\tq \t", "tab\there", "nb\xa0sp \xa0x",
    "a▁b", "<s> x </s>", "<|endoftext|> <0x0A>", "日本語 テキスト。 中文", "é é ﬁ", "🙂🙂 👩‍👩‍👧", "\x00 \x1c x",
    "it's we'll 1234567 3.14 --- ###", "　wide　 space", "ﷺ " * 30, "don't  \n\n\n stop", "word" * 3000,
]


def brute_force(rows):
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    spelling = {at: token for token, at in a.get_vocab().items()}
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(one): one for one in shown}
    for at, one in enumerate(one for one in range(256) if one not in shown):
        letters[chr(256 + at)] = one

    def bytes_b(at):
        piece = b.id_to_piece(at)
        return bytes([int(piece[3:5], 16)]) if b.is_byte(at) else piece.replace("▁", " ").encode()

    out, counts = [], Counter()
    for doc, text in rows:
        ids_a = a.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        spelt_a = [bytes(letters[one] for one in spelling[at]) for at in ids_a]
        spelt_b = [bytes_b(at) for at in ids_b]
        wanted = (" " + (text or "")).encode()
        if not text or b"".join(spelt_a) != wanted or b"".join(spelt_b) != wanted:
            out.append((doc, 0, 0, [], ""))
            continue
        ends_a = np.cumsum([len(one) for one in spelt_a]).tolist()
        ends_b = np.cumsum([len(one) for one in spelt_b]).tolist()
        both, groups, links = sorted(set(ends_a) & set(ends_b)), [], []
        left_a, left_b = list(zip(ends_a, ids_a))[::-1], list(zip(ends_b, ids_b))[::-1]
        for end in both:
            part_a, part_b = [], []
            while left_a and left_a[-1][0] <= end:
                part_a.append(left_a.pop()[1])
            while left_b and left_b[-1][0] <= end:
                part_b.append(left_b.pop()[1])
            groups.append(",".join(map(str, part_a)) + "|" + ",".join(map(str, part_b)))
            links.append((part_a[-1], part_b[-1]))
        counts.update(links)
        out.append((doc, len(ids_a), len(ids_b), links, ";".join(groups)))
    best = defaultdict(int)
    for (_, of_b), times in counts.items():
        best[of_b] = max(best[of_b], times)
    return sorted(
        (
            (
                doc,
                n_a,
                n_b,
                len(links),
                len(links),
                sum(counts[link] == best[link[1]] for link in links),
                sum(counts[link] for link in links),
                hashlib.sha256(groups.encode()).hexdigest() if groups else "",
            )
            for doc, n_a, n_b, links, groups in out
        ),
        key=repr,
    )


def run(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op12_token_alignment(spark, str(tmp_path))
    return sorted((tuple(row) for row in found.select(*COLUMNS).collect()), key=repr)


@pytest.mark.parametrize("shard_pairs", [1 << 22, 40])
def test_alignment_equals_brute_force(spark, docs, tmp_path, monkeypatch, shard_pairs):
    monkeypatch.setattr(alignment, "SHARD_PAIRS", shard_pairs)
    monkeypatch.setattr(alignment, "TOKENS_AT_ONCE", 700)
    monkeypatch.setattr(alignment, "CHUNK", 64)
    rows = [(at, text) for at, text in enumerate(ODD)] + [(3, ODD[3]), (None, "a b"), (None, None)]
    rows += [(100 + row.doc_id, row.text) for row in docs.where("doc_id is not null").collect()]
    given = spark.createDataFrame(
        [(*row, 1, "lost") for row in rows], "doc_id long, text string, row long, a_ids string"
    ).repartition(5)
    assert run(spark, given, tmp_path) == brute_force(rows)


def test_given_documents_equal_brute_force(spark, sf_dir):
    rows = [tuple(row) for row in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    found = queries.op12_token_alignment(spark, sf_dir).select(*COLUMNS)
    assert sorted((tuple(row) for row in found.collect()), key=repr) == brute_force(rows)


def test_no_documents_and_documents_without_tokens(spark, tmp_path):
    schema = "doc_id long, text string"
    assert run(spark, spark.createDataFrame([], schema), tmp_path / "none") == []
    empty = spark.createDataFrame([(1, None), (2, "")], schema)
    assert run(spark, empty, tmp_path / "empty") == [(1, *[0] * 6, ""), (2, *[0] * 6, "")]


def test_a_text_of_megabytes(spark, tmp_path):
    draw = random.Random(2)
    text = " ".join("".join(draw.choices("aeinrstß日,.", k=draw.randrange(1, 9))) for _ in range(600_000))
    assert len(text) > 3_000_000
    given = spark.createDataFrame([(1, text), (2, text[:1000])], "doc_id long, text string")
    assert run(spark, given, tmp_path) == brute_force([(1, text), (2, text[:1000])])


def test_the_hash_numbers_every_key_once_and_knows_no_other():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 62, 20_000, dtype=np.uint64))
    function = alignment.PerfectHash(*alignment.PerfectHash.build(keys))
    assert sorted(function.numbers(keys)) == list(range(len(keys)))
    assert (function.numbers(keys + np.uint64(1)) == -1).sum() >= len(keys) - 1
    empty = alignment.PerfectHash(*alignment.PerfectHash.build(keys[:0]))
    assert empty.numbers(keys[:3]).tolist() == [-1, -1, -1]
