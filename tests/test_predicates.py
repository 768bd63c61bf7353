import json
import random
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import types as T

from tidemark.functions.predicates import PredicateError, parse_predicate
from tidemark.operators import build_scalar_index, filter_rows, search_scalar
from tidemark.sources import to_document

SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("n", T.IntegerType()),
        T.StructField("x", T.DoubleType()),
        T.StructField("s", T.StringType()),
        T.StructField("d", T.DateType()),
        T.StructField("t", T.TimestampNTZType()),
        T.StructField("p", T.DecimalType(9, 2)),
        T.StructField("b", T.BooleanType()),
        T.StructField("v", T.ArrayType(T.LongType())),
    ]
)


def made_rows(count, seed=5):
    """Rows with nulls and repeats; a third of them share one value of n and s."""
    rng = random.Random(seed)
    words = ["", "a", "ab", "abc", "b", "ba", "éa", "z"]
    maybe = lambda value: None if rng.random() < 0.15 else value
    rows = []
    for number in range(count):
        hot = rng.random() < 1 / 3
        rows.append(
            (
                number,
                7 if hot else maybe(rng.randint(-5, 20)),
                maybe(rng.choice([-1.5, 0.0, 2.5, float("nan"), float("inf"), 9.0])),
                "ab" if hot else maybe(rng.choice(words)),
                maybe(date(2020, 1, rng.randint(1, 28))),
                maybe(datetime(2020, 1, rng.randint(1, 28), rng.randint(0, 23))),
                maybe(Decimal(rng.randint(-300, 300)) / 100),
                maybe(rng.random() < 0.5),
                [1],
            )
        )
    return rows


def made_literal(rng, name):
    return {
        "id": lambda: rng.randint(0, 400),
        "n": lambda: rng.randint(-6, 21),
        "x": lambda: rng.choice([-1.5, 0, 2.5, 9, 1e9]),
        "s": lambda: rng.choice(["", "a", "ab", "abz", "b", "é", "zz"]),
        "d": lambda: f"2020-01-{rng.randint(1, 28):02d}",
        "t": lambda: f"2020-01-{rng.randint(1, 28):02d}T{rng.randint(0, 23):02d}:00:00",
        "p": lambda: rng.randint(-300, 300) / 100,
        "b": lambda: rng.random() < 0.5,
    }[name]()


def made_predicate(rng, depth):
    if depth and rng.random() < 0.7:
        kind = rng.choice(["and", "or", "not"])
        if kind == "not":
            return {"type": "not", "child": made_predicate(rng, depth - 1)}
        return {
            "type": kind,
            "left": made_predicate(rng, depth - 1),
            "right": made_predicate(rng, depth - 1),
        }
    name = rng.choice(["id", "n", "n", "x", "s", "s", "d", "t", "p", "b"])
    kinds = "eq not-eq lt lt-eq gt gt-eq in not-in is-null not-null".split()
    kind = rng.choice(kinds + ["starts-with", "starts-with"] if name == "s" else kinds)
    if kind.endswith("-null"):
        return {"type": kind, "term": name}
    if kind in ("in", "not-in"):
        values = [made_literal(rng, name) for _ in range(rng.randint(0, 3))]
        return {"type": kind, "term": name, "values": values}
    return {"type": kind, "term": name, "value": made_literal(rng, name)}


def comes_before(a, b):
    """Order of values, with NaN after every number."""
    a_nan, b_nan = a != a, b != b
    return not a_nan if b_nan and not a_nan else (False if a_nan else a < b)


def same(a, b):
    return a == b or (a != a and b != b)


def truth(node, row):
    """True, False or None: the predicate by SQL's three-valued logic, in plain Python."""
    kind = node["type"]
    if kind == "not":
        inner = truth(node["child"], row)
        return None if inner is None else not inner
    if kind in ("and", "or"):
        sides = (truth(node["left"], row), truth(node["right"], row))
        decisive = kind == "or"
        if decisive in sides:
            return decisive
        return None if None in sides else not decisive
    value = row[node["term"]]
    if kind == "is-null":
        return value is None
    if kind == "not-null":
        return value is not None
    if kind in ("in", "not-in"):
        literals = [as_value(item, node["term"]) for item in node["values"]]
        if not literals:
            return kind == "not-in"
        if value is None:
            return None
        return any(same(value, item) for item in literals) == (kind == "in")
    if value is None:
        return None
    wanted = as_value(node["value"], node["term"])
    return {
        "eq": lambda: same(value, wanted),
        "not-eq": lambda: not same(value, wanted),
        "lt": lambda: comes_before(value, wanted),
        "lt-eq": lambda: comes_before(value, wanted) or same(value, wanted),
        "gt": lambda: comes_before(wanted, value),
        "gt-eq": lambda: comes_before(wanted, value) or same(value, wanted),
        "starts-with": lambda: value.startswith(wanted),
    }[kind]()


def as_value(literal, name):
    if name == "d":
        return date.fromisoformat(literal)
    if name == "t":
        return datetime.fromisoformat(literal)
    if name == "p":
        return Decimal(str(literal))
    return literal


def test_predicates_give_what_plain_python_gives_with_and_without_an_index(spark, lake, namespace):
    rows = made_rows(400)
    frame = spark.createDataFrame(rows, SCHEMA)
    lake.create_table(namespace, "t", to_document(SCHEMA))
    state = lake.append(namespace, "t", frame.repartition(3, "id")).state
    columns = ["n", "s", "x", "d", "t", "p", "b"]
    build_scalar_index(
        lake, namespace, "t", "by_n", columns, rows_per_file=30
    ).publish()
    records = [dict(zip(SCHEMA.names, row)) for row in rows]
    rng = random.Random(11)
    for _ in range(40):
        node = made_predicate(rng, 3)
        wanted = [record["id"] for record in records if truth(node, record) is True]
        for index in (None, "by_n"):
            found = search_scalar(
                lake, namespace, "t", state.metadata_location, index, json.dumps(node), ["id"]
            )
            assert sorted(row["id"] for row in found.collect()) == wanted, (index, node)


@pytest.mark.parametrize(
    "node, ids",
    [
        (True, [0, 1, 2]),
        ("true", [0, 1, 2]),
        ("false", []),
        ({"type": "true"}, [0, 1, 2]),
        ({"type": "not", "child": {"type": "true"}}, []),
        ({"type": "eq", "term": "data", "value": "x"}, [0]),
        ({"type": "not-eq", "term": "data", "value": "x"}, [1]),
        ({"type": "not", "child": {"type": "eq", "term": "data", "value": "x"}}, [1]),
        ({"type": "in", "term": "id", "values": ["1", 2]}, [1, 2]),
        ({"type": "eq", "term": "id", "value": 2.0}, [2]),
    ],
)
def test_small_cases(spark, node, ids):
    frame = spark.createDataFrame([(0, "x"), (1, "y"), (2, None)], "id long, data string")
    found = filter_rows(frame, node if isinstance(node, (str, bool)) else json.dumps(node), ["id"])
    assert sorted(row["id"] for row in found.collect()) == ids


@pytest.mark.parametrize(
    "node",
    [
        "{",
        "[]",
        {},
        {"type": "like", "term": "s", "value": "a"},
        {"type": "not-starts-with", "term": "s", "value": "a"},
        {"type": "eq", "term": "absent", "value": 1},
        {"type": "eq", "term": "n"},
        {"type": "eq", "term": "n", "value": None},
        {"type": "eq", "term": "n", "value": "one"},
        {"type": "eq", "term": "n", "value": 1.5},
        {"type": "eq", "term": "n", "value": 2**31},
        {"type": "eq", "term": "n", "value": True},
        {"type": "eq", "term": "d", "value": "2020-13-01"},
        {"type": "eq", "term": "t", "value": "2020-01-01T00:00:00+02:00"},
        {"type": "eq", "term": "p", "value": "1.234"},
        {"type": "eq", "term": "p", "value": "12345678.00"},
        {"type": "eq", "term": "b", "value": 1},
        {"type": "eq", "term": "v", "value": 1},
        {"type": "in", "term": "n", "values": 1},
        {"type": "in", "term": "n"},
        {"type": "starts-with", "term": "n", "value": "1"},
        {"type": "and", "left": {"type": "true"}},
        {"type": "not"},
    ],
)
def test_faulty_predicates_are_refused_before_any_job(node):
    with pytest.raises(PredicateError):
        parse_predicate(node if isinstance(node, str) else json.dumps(node), SCHEMA)


def test_projection_must_name_known_columns(spark):
    frame = spark.createDataFrame([(0, "x")], "id long, data string")
    for columns in (["absent"], []):
        with pytest.raises(PredicateError):
            filter_rows(frame, "true", columns)


def test_a_literal_is_not_moved_by_the_session_time_zone(spark):
    frame = spark.sql("SELECT TIMESTAMP_NTZ '2020-01-01 00:30:00' AS t")
    node = json.dumps({"type": "eq", "term": "t", "value": "2020-01-01T00:30:00"})
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "Pacific/Auckland", "America/Lima"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert filter_rows(frame, node).count() == 1
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
