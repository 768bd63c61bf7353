"""Levels of tool calls against a brute-force version; arguments no JSON writer can write again."""

import json
import random

from tidemark.llm import tool_calls

CALLS = "conv_id long, call_id string, turn long, name string, arguments string, depends_on array<string>"
RESULTS = "conv_id long, call_id string, turn long, content string"
SCHEMAS = {"f": {"type": "object", "properties": {"x": {"type": "number"}}}}


def brute_force(calls):
    """The level of each call: None if it waits for itself."""
    needs = {}
    for conv, call, *_, depends in sorted(calls, key=lambda row: (str(row[0]), str(row[1]), row[2])):
        needs.setdefault((conv, call), {(conv, one) for one in depends or []})
    needs = {key: {one for one in wanted if one in needs} for key, wanted in needs.items()}
    levels, grown = {}, True
    while grown:
        grown = False
        for key, wanted in needs.items():
            if key not in levels and all(one in levels for one in wanted):
                levels[key] = 1 + max((levels[one] for one in wanted), default=-1)
                grown = True
    return {key: levels.get(key) for key in needs}


def test_levels_equal_brute_force(spark):
    draw, rows = random.Random(1), []
    for conv in [*range(25), None]:
        n = draw.randrange(1, 14)
        for call in range(n):
            wanted = draw.sample(range(n), min(n, draw.choice([0, 0, 1, 1, 1, 2, 3])))
            wanted = [f"c{one}" for one in wanted if one < call or draw.random() < 0.1]
            rows.append((conv, f"c{call}", call, "f", "{}", wanted + draw.choice([[], [], ["absent"]])))
    rows += [(99, f"c{k}", k, "f", "{}", [f"c{(k + 1) % 5}"]) for k in range(5)]
    rows += [(99, "in", 9, "f", "{}", ["c0"]), (99, "self", 9, "f", "{}", ["self"]), (98, None, 0, "f", None, None)]
    rows += [(98, "n", 1, "f", None, [None]), rows[0]]
    calls = spark.createDataFrame(rows, CALLS)
    found = tool_calls.link_calls(calls, spark.createDataFrame([], RESULTS), SCHEMAS).collect()
    assert {(r["conv_id"], r["call_id"]): r["level"] for r in found} == brute_force(rows)
    assert all(("depends on itself" in (r["error"] or "")) == (r["level"] is None) for r in found)


def test_a_long_chain_takes_few_jobs(spark):
    rows = [(1, f"c{k:05}", k, "f", "{}", [f"c{k - 1:05}"] if k else []) for k in range(20_000)]
    calls = spark.createDataFrame(rows, CALLS).repartition(4)
    group = "a long chain"
    spark.sparkContext.setJobGroup(group, group)
    try:
        levels, _ = tool_calls._levels(calls.groupBy("conv_id", "call_id").agg(_first_call()))
        assert levels.selectExpr("count(*)", "sum(level)", "max(level)").first()[:] == (20_000, 199_990_000, 19_999)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 150, jobs


def _first_call():
    from pyspark.sql import functions as F

    return F.min(F.struct("turn", "name", "arguments", "depends_on")).alias("call")


def test_arguments_that_cannot_be_written_stay_as_text(spark):
    odd = {
        '{"x":1e999}': "a number out of range",
        '{"x":"\\ud800"}': "half a surrogate pair",
        '{"x":' + "[" * 200 + "]" * 200 + "}": "nested too deeply",
        '{"x":' + "[" * 200_000 + "]" * 200_000 + "}": "nested too deeply",
        "[" * 5000: "",
        '{"x":NaN}': "no JSON",
        '{"x":' + "9" * 5000 + "}": "no JSON",
        "{": "no JSON",
    }
    rows = [(1, f"c{at}", at, "f", text, []) for at, text in enumerate(odd)] + [(1, "good", 99, "f", '{"x": 1.5}', [])]
    results = spark.createDataFrame([(1, "c0", 1, "done"), (1, "lost", 1, "x")], RESULTS)
    found = tool_calls.link_calls(spark.createDataFrame(rows, CALLS), results, SCHEMAS).collect()
    assert len(found) == len(odd) + 2
    by_id = {row["call_id"]: row for row in found}
    for at, (text, problem) in enumerate(odd.items()):
        assert problem in by_id[f"c{at}"]["error"]
        assert json.loads(by_id[f"c{at}"]["json"])["arguments"] == text
    assert by_id["good"]["error"] is None and by_id["lost"]["status"] == "orphan"
