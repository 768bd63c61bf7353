"""Predicates given as JSON, turned into Spark columns.

A predicate is a tree of objects with a ``type``:

``and`` / ``or`` (``left``, ``right``), ``not`` (``child``), ``true``, ``false``,
``eq`` / ``not-eq`` / ``lt`` / ``lt-eq`` / ``gt`` / ``gt-eq`` / ``starts-with``
(``term``, ``value``), ``in`` / ``not-in`` (``term``, ``values``),
``is-null`` / ``not-null`` (``term``).

``term`` is a column name; a literal takes the type of its column. SQL three-valued
logic holds: ``df.where(...)`` keeps a row only where the predicate is true. Every fault
in a predicate is raised here, before Spark runs anything.
"""

from __future__ import annotations

import json
import math
import struct
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, datetime
from decimal import Decimal, InvalidOperation
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Node names, and the node each one becomes under ``not``.
NEGATED = {
    "eq": "not-eq",
    "not-eq": "eq",
    "lt": "gt-eq",
    "gt-eq": "lt",
    "gt": "lt-eq",
    "lt-eq": "gt",
    "in": "not-in",
    "not-in": "in",
    "is-null": "not-null",
    "not-null": "is-null",
    "starts-with": "not-starts-with",
    "not-starts-with": "starts-with",
    "true": "false",
    "false": "true",
    "and": "or",
    "or": "and",
}
_COMPARISONS = ("eq", "not-eq", "lt", "lt-eq", "gt", "gt-eq", "starts-with")
_SETS = ("in", "not-in")
_NULL_TESTS = ("is-null", "not-null")
_INTEGER_BITS = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}


# The column in which a zone map lists the lookups that a zone may fulfil.
LOOKED_UP = "looked_up"


class PredicateError(ValueError):
    """The predicate is malformed, or does not fit the columns it is put to."""


@dataclass(frozen=True)
class ColumnTest:
    """One test of one column; ``values`` are Python values of the column's type."""

    op: str
    field: T.StructField
    values: tuple

    @property
    def literals(self) -> list[Column]:
        # Dates and times go in as text, which no driver or session time zone can shift.
        plain = [v.isoformat() if isinstance(v, date) else v for v in self.values]
        return [F.lit(value).cast(self.field.dataType) for value in plain]


@dataclass(frozen=True)
class Junction:
    op: str
    parts: tuple


@dataclass(frozen=True)
class Predicate:
    """A checked predicate. ``not`` is already pushed down into the tests."""

    root: ColumnTest | Junction | bool

    def on_rows(self) -> Column:
        return _build(self.root, _row_test)

    def on_zones(self, zoned: set[str], looked_up: Sequence[ColumnTest] = ()) -> Column:
        """True for every zone that may hold a matching row, by its min, max and null count.

        Columns outside ``zoned`` have no such statistics and rule nothing out. Of tests that were
        ``looked_up`` in bitsets a zone has the numbers of those it may fulfil in ``LOOKED_UP``.
        """

        def leaf(test: ColumnTest) -> Column:
            possible = _zone_test(test, zoned)
            if test in looked_up:
                possible = possible & F.array_contains(LOOKED_UP, list(looked_up).index(test))
            return possible

        return _build(self.root, leaf)

    def lookups(self, columns: Sequence[str]) -> list[ColumnTest]:
        """The tests for given values of some columns."""
        found, open_ = [], [self.root]
        while open_:
            node = open_.pop()
            if isinstance(node, Junction):
                open_ += node.parts
            elif isinstance(node, ColumnTest) and node.op in ("eq", "in"):
                if node.field.name in columns and node not in found:
                    found.append(node)
        return found


def parse_predicate(expression_json: str | dict | bool, schema: T.StructType) -> Predicate:
    node = expression_json
    if isinstance(node, str):
        try:
            node = json.loads(node, parse_float=Decimal)
        except json.JSONDecodeError as problem:
            raise PredicateError(f"not JSON: {problem}") from None
    return Predicate(_node(node, {field.name: field for field in schema.fields}, False))


def zone_columns(name: str) -> tuple[str, str, str]:
    """Names of the min, max and null-count columns a zone map keeps for a column."""
    return f"min_{name}", f"max_{name}", f"nulls_{name}"


def _node(node, fields: dict[str, T.StructField], negate: bool) -> ColumnTest | Junction | bool:
    if isinstance(node, bool):
        return node != negate
    if not isinstance(node, dict) or not isinstance(node.get("type"), str):
        raise PredicateError(f"a predicate node is an object with a type, not {node!r}")
    kind = node["type"]
    if kind == "not":
        return _node(_part(node, "child"), fields, not negate)
    if kind not in NEGATED or kind == "not-starts-with":
        raise PredicateError(f"unknown predicate node {kind!r}")
    op = NEGATED[kind] if negate else kind
    if kind in ("true", "false"):
        return op == "true"
    if kind in ("and", "or"):
        parts = [_node(_part(node, side), fields, negate) for side in ("left", "right")]
        return Junction(op, tuple(parts))
    field = fields.get(_part(node, "term"))
    if field is None:
        raise PredicateError(f"unknown column {node['term']!r}")
    if kind in _NULL_TESTS:
        return ColumnTest(op, field, ())
    if not isinstance(field.dataType, T.AtomicType):
        raise PredicateError(f"{field.name!r} is {field.dataType.simpleString()}: cannot compare")
    if kind == "starts-with" and not isinstance(field.dataType, T.StringType):
        raise PredicateError(f"starts-with needs a string column, not {field.name!r}")
    given = _part(node, "values") if kind in _SETS else [_part(node, "value")]
    if not isinstance(given, list):
        raise PredicateError("values must be a list")
    return ColumnTest(op, field, tuple(_literal(value, field) for value in given))


def _part(node: dict, name: str):
    if name not in node:
        raise PredicateError(f"{node['type']!r} lacks {name!r}")
    return node[name]


def _literal(value, field: T.StructField):
    """``value`` as a Python value of the column's type, or an error; never a silent change."""
    dtype = field.dataType
    try:
        if value is None:
            raise ValueError("null is never equal to anything; use is-null")
        if isinstance(dtype, T.BooleanType):
            return _as_boolean(value)
        if isinstance(value, bool):
            raise ValueError("a boolean")
        if isinstance(dtype, T.StringType):
            return value if isinstance(value, str) else str(value)
        if isinstance(dtype, T.DateType):
            return date.fromisoformat(value)
        if isinstance(dtype, T.TimestampNTZType):
            moment = datetime.fromisoformat(value)
            if moment.tzinfo is not None:
                raise ValueError("the column has no time zone")
            return moment
        if isinstance(dtype, T.TimestampType):
            return datetime.fromisoformat(value)
        if isinstance(dtype, (T.DoubleType, T.FloatType)):
            return _as_float(value, dtype)
        if isinstance(dtype, (T.IntegralType, T.DecimalType)):
            return _as_number(value, dtype)
    except (ValueError, TypeError, OverflowError, InvalidOperation) as problem:
        reason = f"{value!r} is no {dtype.simpleString()} for {field.name!r}: {problem}"
        raise PredicateError(reason) from None
    raise PredicateError(f"{field.name!r} is {dtype.simpleString()}: cannot compare")


def _as_boolean(value) -> bool:
    if isinstance(value, bool):
        return value
    if isinstance(value, str) and value.lower() in ("true", "false"):
        return value.lower() == "true"
    raise ValueError("neither true nor false")


def _as_float(value, dtype: T.DataType) -> float:
    """A fraction is rounded to the column's type as any is; a whole number must survive that."""
    held = float(value)
    if isinstance(dtype, T.FloatType) and math.isfinite(held):
        (held,) = struct.unpack("f", struct.pack("f", held))
    given = Decimal(str(value))
    if given.is_finite() and given == given.to_integral_value() and Decimal(held) != given:
        raise ValueError(f"would be {held!r}")
    return float(value)


def _as_number(value, dtype: T.DataType) -> int | Decimal:
    number = Decimal(str(value))
    if isinstance(dtype, T.DecimalType):
        if not number.is_finite() or number != round(number, dtype.scale):
            raise ValueError(f"more than {dtype.scale} decimals")
        if abs(number) >= Decimal(10) ** (dtype.precision - dtype.scale):
            raise ValueError("out of range")
        return number
    if not number.is_finite() or number != number.to_integral_value():
        raise ValueError("not a whole number")
    limit = 2 ** (_INTEGER_BITS[type(dtype)] - 1)
    if not -limit <= number < limit:
        raise ValueError("out of range")
    return int(number)


def _build(node: ColumnTest | Junction | bool, leaf) -> Column:
    if isinstance(node, bool):
        return F.lit(node)
    if isinstance(node, ColumnTest):
        return leaf(node)
    parts = [_build(part, leaf) for part in node.parts]
    return reduce(lambda a, b: a & b if node.op == "and" else a | b, parts)


def _row_test(test: ColumnTest) -> Column:
    column = F.col(f"`{test.field.name}`")
    if test.op == "is-null":
        return column.isNull()
    if test.op == "not-null":
        return column.isNotNull()
    if test.op == "in":
        return column.isin(*test.literals) if test.values else F.lit(False)
    if test.op == "not-in":
        return ~column.isin(*test.literals) if test.values else F.lit(True)
    if test.op == "starts-with":
        return column.startswith(test.values[0])
    if test.op == "not-starts-with":
        return ~column.startswith(test.values[0])
    return _compare(test.op, column, test.literals[0])


def _compare(op: str, left: Column, right: Column) -> Column:
    compared = {
        "eq": left == right,
        "not-eq": left != right,
        "lt": left < right,
        "lt-eq": left <= right,
        "gt": left > right,
        "gt-eq": left >= right,
    }
    return compared[op]


def _zone_test(test: ColumnTest, zoned: set[str]) -> Column:
    if test.field.name not in zoned:
        return F.lit(True)
    lowest, highest, nulls = (F.col(f"`{name}`") for name in zone_columns(test.field.name))
    if test.op == "is-null":
        return nulls > 0
    if test.op == "not-null":
        return nulls < F.col("row_count")
    if test.op == "in":
        possible = _any_literal(test, lambda value: (lowest <= value) & (value <= highest))
    elif test.op == "not-in":
        only_excluded = _any_literal(test, lambda value: lowest == value)
        possible = (lowest != highest) | ~only_excluded
    elif test.op == "starts-with":
        prefix = test.values[0]
        size = len(prefix)
        possible = (F.substring(lowest, 1, size) <= prefix) & (
            F.substring(highest, 1, size) >= prefix
        )
    elif test.op == "not-starts-with":
        possible = nulls < F.col("row_count")
    elif test.op == "eq":
        possible = (lowest <= test.literals[0]) & (test.literals[0] <= highest)
    elif test.op == "not-eq":
        possible = (lowest != test.literals[0]) | (highest != test.literals[0])
    elif test.op in ("lt", "lt-eq"):
        possible = _compare(test.op, lowest, test.literals[0])
    else:
        possible = _compare(test.op, highest, test.literals[0])
    # A zone of nulls only has no min or max, and no row a comparison could be true for.
    return F.coalesce(possible, F.lit(False))


def _any_literal(test: ColumnTest, check) -> Column:
    if not test.values:
        return F.lit(False)
    return F.exists(F.array(*test.literals), check)
