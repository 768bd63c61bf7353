import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.operators import (
    column_statistics,
    frequent_values,
    merged_statistics,
    record_statistics,
)
from tidemark.sources import to_document

ROWS = [
    (1, 2.5, "a", [3.0, 4.0]),
    (2, None, "b", None),
    (2, -1.0, None, [0.0, 0.0]),
    (None, 2.5, "b", [6.0, 8.0]),
]
SCHEMA = "n int, x double, s string, v array<float>"


@pytest.mark.parametrize("exact", [True, False])
def test_facts_of_each_column(spark, exact):
    frame = spark.createDataFrame(ROWS, SCHEMA)
    found = {row["column_name"]: tuple(row)[1:] for row in column_statistics(frame, exact).collect()}
    assert found == {
        "n": (4, 1, "1", "2", 2, None),
        "x": (4, 1, "-1.0", "2.5", 2, None),
        "s": (4, 1, "a", "b", 2, None),
        "v": (4, 1, None, None, None, 5.0),
    }


@pytest.mark.parametrize("exact", [True, False])
def test_an_empty_table_has_facts_too(spark, exact):
    frame = spark.createDataFrame([], SCHEMA)
    found = {row["column_name"]: tuple(row)[1:] for row in column_statistics(frame, exact).collect()}
    assert found == {
        "n": (0, 0, None, None, 0, None),
        "x": (0, 0, None, None, 0, None),
        "s": (0, 0, None, None, 0, None),
        "v": (0, 0, None, None, None, None),
    }


def test_both_forms_have_one_schema(spark):
    frame = spark.createDataFrame(ROWS, SCHEMA)
    exact, about = column_statistics(frame, True), column_statistics(frame)
    assert [(f.name, f.dataType) for f in exact.schema] == [
        (f.name, f.dataType) for f in about.schema
    ]


def test_approximate_counts_take_one_pass(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    plan = column_statistics(lines)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    exact = {r["column_name"]: r for r in column_statistics(lines, True).collect()}
    for row in column_statistics(lines).collect():
        wanted = exact[row["column_name"]]
        assert row["distinct_count"] == pytest.approx(wanted["distinct_count"], rel=0.2)
        assert row["min_value"] == wanted["min_value"] and row["max_value"] == wanted["max_value"]


def test_statistics_of_a_state_come_from_those_of_its_snapshots(spark, lake, namespace):
    frame = spark.range(900).select(
        "id",
        F.when(F.col("id") % 3 != 0, (F.col("id") % 50).cast("double")).alias("x"),
        F.concat(F.lit("n"), F.col("id") % 7).alias("s"),
        F.array("id").alias("a"),
    )
    lake.create_table(namespace, "t", to_document(frame.schema))
    first = lake.append(namespace, "t", frame.where("id < 300")).state
    assert record_statistics(lake, namespace, "t") == 2 and record_statistics(lake, namespace, "t") == 0
    second = lake.append(namespace, "t", frame.where("id >= 300")).state
    with pytest.raises(LookupError):
        merged_statistics(lake, namespace, "t")
    assert record_statistics(lake, namespace, "t") == 1
    for state, rows in ((first, frame.where("id < 300")), (second, frame)):
        found = {row["column_name"]: row for row in merged_statistics(lake, namespace, "t", state.metadata_location).collect()}
        for row in column_statistics(rows, exact_distinct=True).collect():
            mine = found[row["column_name"]]
            for fact in ("row_count", "null_count", "min_value", "max_value"):
                assert mine[fact] == row[fact], (row["column_name"], fact)
            if row["distinct_count"]:
                assert abs(mine["distinct_count"] - row["distinct_count"]) <= 0.06 * row["distinct_count"] + 1
        middle = rows.agg(F.median("x")).first()[0]
        assert abs(found["x"]["quantiles"][1] - middle) <= 2
        assert found["s"]["quantiles"] is None and found["a"]["min_value"] is None


@pytest.mark.parametrize("counters", [5, 40, 10_000])
def test_frequent_values_are_counted_exactly(spark, counters):
    draw = random.Random(3)
    words = [f"w{min(draw.randrange(1, 3000), draw.randrange(1, 3000), draw.randrange(1, 60))}" for _ in range(6000)]
    rows = [(word, at, None if at % 4 else "same") for at, word in enumerate(words)] + [(None, None, None)] * 30
    frame = spark.createDataFrame(rows, "word string, number int, `odd.name` string").repartition(5)
    found = frequent_values(frame, ["word", "number", "odd.name"], 5, counters)
    got = {}
    for row in found.collect():
        got.setdefault(row["column_name"], []).append((row["rank"], row["value"], row["repeats"]))
    for column, values in (("word", words), ("number", [str(at) for at in range(6000)]), ("odd.name", ["same"] * 1500)):
        best = sorted(Counter(values).items(), key=lambda item: (-item[1], item[0]))[:5]
        assert sorted(got[column]) == [(n, value, times) for n, (value, times) in enumerate(best, 1)]
    assert frequent_values(frame.where("false"), ["word"], 3).count() == 0
