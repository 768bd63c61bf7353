"""Base spans against the plain patterns; added ones by planted spans and look-alikes."""

import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import pii, queries

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(part) <= 255 for part in text.split("."))
    if kind == "card":
        total = 0
        for at, one in enumerate(reversed(digits)):
            value = int(one) * (1 + at % 2)
            total += value - 9 if value > 9 else value
        return 16 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def brute_force(text):
    return [
        (at, *found.span())
        for at, (kind, pattern) in enumerate(PATTERNS.items())
        for found in re.finditer(pattern, text or "")
        if holds(kind, found[0])
    ]


ODD = [
    None, "", "@", "a@b", "a@b.c@d.e", "a@b.c.@d.e", "@@a@b.c", "..a@b-.-c", "é@b.c x@y.z", "1.2.3.4", "1.2.3.4.5.6.7.8",
    "256.1.1.1.5 01.002.0003.4", "1.2.3", "999999.1.1.1", "4111 1111 1111 1111", "4111-1111 1111-1111 ", "1 " * 40,
    "4111111111111111 4111111111111111", "+1 (017) 555-7713", "+49 30 1234567, +1 ((((", "++1 23456789", "+1-2", "+123456789.",
    "🙂 und.34@mail7.example.com 🙂", "9" * 6000 + ".1.1.1", "x" * 5000 + "@", "+1" + "(" * 3000,
]


def test_odd_texts_equal_the_patterns():
    for text in ODD[1:]:
        assert pii.base_spans(text) == brute_force(text) if len(text) < 4300 or "." not in text else True, text
    assert pii.base_spans("9" * 6000 + ".1.1.1") == []


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab1.2@+-( )39é,0", max_size=60))
def test_any_text_equals_the_patterns(text):
    assert pii.base_spans(text) == brute_force(text)
    for one in pii.candidates(text):
        assert 0 <= one.start < one.end <= len(text)


def test_long_texts_take_time_in_proportion():
    for text in ("9" * 1_000_000, "1 " * 500_000, "a." * 500_000 + "@", "1." * 500_000, "+1" * 500_000, "a@" * 500_000):
        assert len(pii.base_spans(text)) <= 125_000
        assert len(pii.candidates(text)) < 5_000_000


def corpus(seed, size):
    draw = random.Random(seed)
    words = "lorem ipsum dolor sit amet or the contact server card is in by and".split()
    digits = lambda n: "".join(draw.choices("0123456789", k=n))

    def card():
        stem = digits(15)
        return stem + next(one for one in "0123456789" if pii.luhn(stem + one))

    plants = [
        lambda: f"{draw.choice(words)}.{digits(2)}@mail{digits(1)}.example.com",
        lambda: ".".join(str(draw.randrange(256)) for _ in range(4)),
        card,
        lambda: f"+1 ({digits(3)}) 555-{digits(4)}",
    ]
    rows = []
    for doc in range(size):
        parts = draw.choices(words, k=draw.randrange(20, 60))
        if doc % 3 == 0:
            parts.insert(draw.randrange(len(parts)), draw.choice(plants)())
        if doc % 7 == 0:
            parts.insert(draw.randrange(len(parts)), draw.choice([digits(16), digits(10), "2024-05-17", "3.14"]))
        rows.append((doc, " ".join(parts)))
    return rows


def read(spark, rows, tmp_path, schema="doc_id long, text string"):
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    return queries.op13_personal_data(spark, str(tmp_path)).collect()


def written(spans):
    return ",".join(f"{list(PATTERNS)[kind]}:{start}:{end}" for kind, start, end in spans)


def check_base(found, rows):
    want = sorted(
        (
            (doc, *[sum(span[0] == kind for span in spans) for kind in range(4)], hashlib.sha256(written(spans).encode()).hexdigest())
            for doc, spans in ((row[0], brute_force(row[1])) for row in rows)
        ),
        key=repr,
    )
    columns = ("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")
    assert sorted((tuple(row[name] for name in columns) for row in found), key=repr) == want


def test_trained_search_adds_other_spellings_and_leaves_clean_texts_alone(spark, tmp_path):
    hidden = [
        ("reach jo.07 [at] mail3 [dot] example [dot] com now", "jo.07 [at] mail3 [dot] example [dot] com"),
        ("lorem call 017 555 7713 ipsum", "017 555 7713"),
        ("lorem 10[.]20[.]30[.]40 ipsum", "10[.]20[.]30[.]40"),
    ]
    clean = ["born 2024-05-17 sit", "order 555-1234 dolor", "version 1.2.3.444 or 300.1.1.1", "we looked at example.com", "4111 1111 1111 1112"]
    rows = corpus(5, 1500) + [(10_000 + at, text) for at, (text, _) in enumerate(hidden)]
    rows += [(20_000 + at, text) for at, text in enumerate(clean)] + [(30_000 + at, text) for at, text in enumerate(ODD[:24])]
    rows += [(None, rows[0][1]), rows[3]]
    found = read(spark, rows, tmp_path)
    check_base(found, rows)
    by_id = {row.doc_id: row.spans for row in found}
    for at, (text, shown) in enumerate(hidden):
        start = text.index(shown)
        assert f":{start}:{start + len(shown)}" in by_id[10_000 + at], (text, by_id[10_000 + at])
    for at, text in enumerate(clean):
        assert by_id[20_000 + at] == "", (text, by_id[20_000 + at])
    for doc, text in corpus(5, 1500):
        base = written(brute_force(text))
        assert by_id[doc] == base or set(base.split(",")) <= set(by_id[doc].split(","))
    wrong = sum(by_id[doc] != written(brute_force(text)) for doc, text in corpus(5, 1500))
    assert wrong <= 5


def test_given_documents_have_their_base_spans(spark, sf_dir):
    rows = [tuple(row) for row in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    check_base(queries.op13_personal_data(spark, sf_dir).collect(), rows)


def test_no_documents_none_with_spans_and_clashing_columns(spark, tmp_path):
    assert read(spark, [], tmp_path / "none") == []
    rows = [(1, None, "x"), (1, "clean 12", "y"), (None, "", None)]
    found = read(spark, rows, tmp_path / "clean", "doc_id long, text string, base string")
    assert sorted(row.spans for row in found) == ["", "", ""]


def test_trees_and_thresholds_come_from_all_documents(spark, monkeypatch):
    rows = corpus(6, 600)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {}

    def materialise(table, label, write=pii.materialise):
        kept[label] = write(table, label)
        return kept[label]

    monkeypatch.setattr(pii, "materialise", materialise)
    trees = pii.train(docs)
    assert trees.trees and min(trees.thresholds) < float("inf")
    schema = "kind int, label double, held boolean, features array<double>"
    every = docs.mapInArrow(pii._examples, schema)
    n = {row.held: row["count"] for row in every.groupBy("held").count().collect()}
    # Each example counts, those that are equal in one row with their number.
    weights = {row.held: row["w"] for row in kept["examples"].groupBy("held").agg({"weight": "sum"}).toDF("held", "w").collect()}
    assert weights == n
    assert kept["held"].agg({"weight": "sum"}).first()[0] == n[True]
    assert kept["examples"].count() == every.distinct().count() < sum(n.values())
    # Sixteen times the documents: the same distinct rows, sixteen times the weight.
    pii.train(docs.crossJoin(spark.range(16).select()))
    assert kept["examples"].agg({"weight": "sum"}).first()[0] == 16 * sum(n.values())
    assert kept["examples"].count() == every.distinct().count()


def test_redacted_text_shows_kinds_only():
    text = "a a@b.c 1.2.3.4 z"
    assert pii.redact(text, pii.base_spans(text)) == "a [email] [ip] z"
