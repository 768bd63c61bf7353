"""Links tool calls to their results, orders them, checks their arguments, writes JSON.

Calls and results are tables keyed by conversation and identifier. Repeated identifiers are
settled by partial aggregation (the earliest row stands, the others are counted), then calls
and results meet in one equality join. A call may depend on others of its conversation; its
level is 0 without dependencies and else one more than the highest level of these. Levels are
found by rounds over all conversations at once, so a conversation with a third of all calls is
spread over tasks like any other. Calls that wait for one other are settled by pointer doubling,
in rounds that grow with the logarithm of their chain; only calls that wait for several take as
many rounds as these wait for each other. What no round reaches depends on itself. Arguments are checked against the schema of the called tool (types,
required and unknown properties, bounds, lengths, choices), and call and result become one
line of canonical JSON: keys sorted, no white space, text as UTF-8.

Rows: one for each call, and one for each result without a call (status ``orphan``). Null
identifiers and null conversations link like values of their own. Null arguments are an empty
object; text that is no JSON object, holds numbers or text that cannot be written again or is
nested more than ``DEEPEST`` times, or a tool without schema, is an error in ``error`` and the row
stays, such arguments as text. Dependencies on calls that do not exist are reported there, and ignored for the
level. Extra columns are not read. Empty tables give no rows.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialise

KEY = ["conv_id", "call_id"]
# How deep arguments may be nested.
DEEPEST = 100

# JSON Schema's names of types.
TYPES = {
    "string": str,
    "integer": int,
    "number": (int, float),
    "boolean": bool,
    "array": list,
    "object": dict,
    "null": type(None),
}


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def check(value, schema: dict, path: str = "$") -> list[str]:
    """What is wrong with a value under a schema, in the order of its properties."""
    wanted, wrong = schema.get("type"), []
    if wanted:
        is_flag = isinstance(value, bool)
        fits = isinstance(value, TYPES[wanted]) and (not is_flag or wanted == "boolean")
        if not fits:
            return [f"{path}: not of type {wanted}"]
    if "enum" in schema and value not in schema["enum"]:
        wrong.append(f"{path}: not one of the choices")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", -math.inf):
            wrong.append(f"{path}: below the minimum")
        if value > schema.get("maximum", math.inf):
            wrong.append(f"{path}: above the maximum")
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0):
            wrong.append(f"{path}: too short")
        if len(value) > schema.get("maxLength", math.inf):
            wrong.append(f"{path}: too long")
    if isinstance(value, list) and "items" in schema:
        for at, item in enumerate(value):
            wrong += check(item, schema["items"], f"{path}[{at}]")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        wrong += [f"{path}.{name}: missing" for name in schema.get("required", []) if name not in value]
        for name in sorted(value):
            if name in known:
                wrong += check(value[name], known[name], f"{path}.{name}")
            elif schema.get("additionalProperties") is False:
                wrong.append(f"{path}.{name}: unknown")
    return wrong


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """Calls (conv_id, call_id, turn, name, arguments, depends_on array) and results
    (conv_id, call_id, turn, content) as linked rows: conv_id, call_id, level, turn, status,
    repeats, error, json. Within a conversation ``level, turn, call_id`` is a topological order.
    """
    # Null keys stand as values of their own from here on.
    first_call = calls.groupBy(*KEY).agg(
        F.min(F.struct("turn", "name", "arguments", "depends_on")).alias("call"),
        F.count("*").alias("n_calls"),
    )
    first_call = materialise(first_call, "calls")
    first_result = results.groupBy(*KEY).agg(
        F.min(F.struct("turn", "content")).alias("result"), F.count("*").alias("n_results")
    )
    levels, missing = _levels(first_call)
    ordered = _join(_join(first_call, levels, "left"), missing, "left")
    linked = _join(ordered, first_result, "full")
    status = (
        F.when(F.col("call").isNull(), "orphan")
        .when(F.col("result").isNull(), "unanswered")
        .otherwise("answered")
    )
    repeats = F.greatest(F.coalesce("n_calls", F.lit(0)) + F.coalesce("n_results", F.lit(0)) - 2, F.lit(0))
    cycle = F.col("call").isNotNull() & F.col("level").isNull()
    written = linked.withColumn(
        "_written",
        _write(schemas)(
            F.col("call_id").cast("string"),
            F.col("call.name"),
            F.col("call.arguments"),
            F.col("call.depends_on"),
            F.col("result.content"),
            status,
            F.col("missing"),
            cycle,
        ),
    )
    return written.select(
        *KEY,
        "level",
        F.coalesce("call.turn", "result.turn").alias("turn"),
        status.alias("status"),
        repeats.alias("repeats"),
        F.col("_written.error").alias("error"),
        F.col("_written.json").alias("json"),
    )


def _join(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """A join on the key in which nulls are equal to nulls."""
    renamed = right.withColumnsRenamed({name: f"_{name}" for name in KEY})
    same = [left[name].eqNullSafe(renamed[f"_{name}"]) for name in KEY]
    joined = left.join(renamed, same[0] & same[1], how)
    keys = {name: F.coalesce(name, f"_{name}") for name in KEY}
    return joined.withColumns(keys).drop(*[f"_{name}" for name in KEY])


def _levels(calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, level) of each call that can be ordered, and (key, missing) dependencies.

    A call that waits for one other only points to it. Pointers are doubled until each points to a
    call that waits for none or for several, so a chain takes rounds by the logarithm of its
    length; what still points into a chain after as many rounds as the number of calls has binary
    digits waits for itself. Only calls that wait for several are then settled round by round.
    """
    needs = calls.select(*KEY, F.explode("call.depends_on").alias("needed")).distinct()
    there = calls.select("conv_id", F.col("call_id").alias("needed"), F.lit(True).alias("there"))
    same = needs["conv_id"].eqNullSafe(there["conv_id"]) & needs["needed"].eqNullSafe(there["needed"])
    known = needs.join(there, same, "left").select(*[needs[c] for c in (*KEY, "needed")], "there")
    edges = materialise(known, "dependencies")
    missing = edges.where("there IS NULL").groupBy(*KEY).agg(
        F.array_sort(F.collect_set(F.coalesce(F.col("needed").cast("string"), F.lit("null")))).alias("missing")
    )
    edges = edges.where("there").drop("there")
    waits = edges.groupBy(*KEY).agg(F.count("*").alias("n"), F.min("needed").alias("needed"))
    waits = materialise(waits, "waits")
    chains = _chains(waits.where("n = 1").drop("n"))
    free = _join(calls.select(*KEY), waits.select(*KEY, "n"), "left").where("n IS NULL")
    free = free.select(*KEY, F.lit(0).alias("level"))
    several = _join(edges, waits.where("n > 1").select(*KEY, "n"), "inner").select(*KEY, "needed")
    ends = _at(several, chains, "needed").select(
        *KEY,
        F.when(F.col("met"), F.col("_needed")).otherwise(F.col("needed")).alias("needed"),
        F.coalesce("_steps", F.lit(0)).alias("steps"),
        F.coalesce("_open", F.lit(False)).alias("open"),
    )
    ends = materialise(ends, "dependencies")
    levels, settled = materialise(free, "levels"), 0
    while True:
        found = _at(ends, levels, "needed")
        ready = (
            found.groupBy(*KEY)
            .agg(
                (F.max(F.col("_level") + F.col("steps")) + 1).alias("level"),
                F.bool_and(F.col("_level").isNotNull() & ~F.col("open")).alias("all"),
            )
            .where("all")
            .select(*KEY, "level")
        )
        ready = materialise(ready, "levels")
        now = ready.count()
        levels = free.unionByName(ready)
        if now == settled:
            break
        settled = now
    chained = _at(chains.where("NOT open"), levels, "needed").where("_level IS NOT NULL")
    chained = chained.select(*KEY, (F.col("_level") + F.col("steps")).alias("level"))
    return levels.unionByName(chained), missing


def _at(rows: DataFrame, calls: DataFrame, column: str) -> DataFrame:
    """``rows`` with the columns of the call that ``column`` names, prefixed; ``met`` if there is one."""
    prefixed = calls.select(*[F.col(name).alias(f"_{name}") for name in calls.columns], F.lit(True).alias("_met"))
    same = rows["conv_id"].eqNullSafe(prefixed["_conv_id"]) & rows[column].eqNullSafe(prefixed["_call_id"])
    joined = rows.join(prefixed, same, "left").withColumn("met", F.coalesce("_met", F.lit(False)))
    return joined.drop("_conv_id", "_call_id", "_met")


def _chains(single: DataFrame) -> DataFrame:
    """(key, needed, steps, open): where the chain of each call that waits for one other ends, how
    many steps away, and whether it never does."""
    chains = materialise(single.withColumns({"steps": F.lit(1), "open": F.lit(True)}), "chains")
    for _ in range(chains.count().bit_length() + 1):
        jumped = _at(chains, chains, "needed").select(
            *KEY,
            F.when(F.col("met"), F.col("_needed")).otherwise(F.col("needed")).alias("needed"),
            (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"),
            F.col("met").alias("open"),
        )
        chains = materialise(jumped, "chains")
        if not chains.where("open").limit(1).count():
            break
    return chains


def _write(schemas: dict[str, dict]):
    @F.pandas_udf("error string, json string")
    def write(call_id, name, arguments, depends_on, content, status, missing, cycle):
        import pandas as pd

        rows = []
        for one in zip(call_id, name, arguments, depends_on, content, status, missing, cycle):
            rows.append(_one(schemas, *one))
        return pd.DataFrame(rows, columns=["error", "json"])

    return write


def _one(schemas, call_id, name, arguments, depends_on, content, status, missing, cycle):
    wrong, row = [], {"id": call_id}
    if status != "orphan":
        given, problem = _parsed(arguments)
        wrong += [problem] if problem else []
        if name not in schemas:
            wrong.append("no schema for this tool")
        elif not wrong:
            wrong += check(given, {"type": "object"} | schemas[name])
        wrong += [f"depends on a missing call: {needed}" for needed in ([] if missing is None else missing)]
        if cycle:
            wrong.append("depends on itself")
        row |= {"arguments": given, "name": name}
        row["depends_on"] = sorted(set() if depends_on is None else {one or "" for one in depends_on})
    if status != "unanswered":
        row["result"] = content
    return "; ".join(wrong) or None, canonical(row)


def _parsed(arguments: str | None) -> tuple:
    """Arguments as a value that can be written again, or as they are with what is wrong."""
    if not arguments:
        return {}, None
    try:
        given = json.loads(arguments, parse_constant=_no_constant)
    except ValueError:
        return arguments, "$: no JSON"
    except RecursionError:
        return arguments, "$: nested too deeply"
    if _depth_exceeds(given, DEEPEST):
        return arguments, "$: nested too deeply"
    try:
        canonical(given).encode()
    except UnicodeEncodeError:
        return arguments, "$: half a surrogate pair"
    except ValueError:
        return arguments, "$: a number out of range"
    return given, None


def _depth_exceeds(value, most: int) -> bool:
    """Whether lists and objects lie in each other more than ``most`` times; without recursion."""
    level = [value]
    for _ in range(most):
        level = [
            inner
            for one in level
            if isinstance(one, (list, dict))
            for inner in (one.values() if isinstance(one, dict) else one)
        ]
        if not level:
            return False
    return any(isinstance(one, (list, dict)) for one in level)


def _no_constant(text: str):
    raise ValueError(text)
