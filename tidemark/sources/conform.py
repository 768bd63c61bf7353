"""Rows conformed to a declared schema: cast, checked, and split from the rejects.

Everything is a per-row column expression, so conforming adds no shuffle and runs in
the same stage as the scan before it and the write after it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.documents import FIELD_FORMAT, fixed_length

# Fixed value: the text form of a uuid.
UUID_PATTERN = "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"

# Column of the reasons beside a refused row.
PROBLEMS = "_problems"


@dataclass(frozen=True)
class Conformed:
    """``typed`` holds the cast columns, ``checks`` the tests a row may fail, by label."""

    source: DataFrame
    typed: list[Column]
    checks: dict[str, Column]

    @property
    def failed(self) -> Column:
        failed = F.lit(False)
        for check in self.checks.values():
            failed = failed | check
        return failed

    @property
    def accepted(self) -> DataFrame:
        good = self.source.where(~self.failed) if self.checks else self.source
        return good.select(*self.typed)

    @property
    def rejects(self) -> DataFrame:
        """The refused rows as they came, with the reasons in ``_problems``."""
        reasons = [F.when(check, F.lit(label)) for label, check in self.checks.items()]
        reasons = F.array_compact(F.array(*reasons)) if reasons else F.array().cast("array<string>")
        return self.source.where(self.failed).withColumn(PROBLEMS, reasons)


# Types between which a cast may round a value and still give one.
MEASURES = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)


def conform(rows: DataFrame, schema: T.StructType, lossy: str = "refuse") -> Conformed:
    """Match ``rows`` to ``schema`` by column name.

    A row is refused if a required value is null or a value is lost in the cast: if it turns
    into null or, unless ``lossy="allow"``, into a number or time that does not cast back.
    Columns the schema does not declare, and absent required ones, are errors.
    """
    if lossy not in ("refuse", "allow"):
        raise ValueError(f"lossy must be 'refuse' or 'allow', not {lossy!r}")
    exact = lossy == "refuse"
    given = {field.name: field.dataType for field in rows.schema.fields}
    # Casts go to the nullable form of a type; nulls inside are found by the checks.
    relaxed = schema.toNullable()
    unknown = sorted(set(given) - set(schema.names))
    if unknown:
        raise ValueError(f"columns not declared by the table: {unknown}")
    typed: list[Column] = []
    checks: dict[str, Column] = {}
    for field in schema.fields:
        if field.name not in given:
            if not field.nullable:
                raise ValueError(f"required column {field.name!r} is absent")
            typed.append(F.lit(None).cast(field.dataType).alias(field.name))
            continue
        raw = F.col(f"`{field.name}`")
        came = given[field.name]
        value = raw if _same(came, field.dataType) else raw.try_cast(relaxed[field.name].dataType)
        tests = {
            "lost in cast": _lost(raw, value, came, field.dataType, exact),
            "required is null": _missing(raw, field.dataType, not field.nullable),
            "bad format": _bad_format(value, field.metadata.get(FIELD_FORMAT)),
        }
        for label, test in tests.items():
            if test is not None:
                checks[f"{field.name}: {label}"] = F.coalesce(test, F.lit(False))
        typed.append(value.alias(field.name))
    return Conformed(rows, typed, checks)


def _same(left: T.DataType, right: T.DataType) -> bool:
    return left.simpleString() == right.simpleString()


def _any(tests: list[Column]) -> Column | None:
    if not tests:
        return None
    found = tests[0]
    for test in tests[1:]:
        found = found | test
    return found


def _missing(value: Column, dtype: T.DataType, required: bool) -> Column | None:
    """True where a required value, at any depth, is null. None if nothing is required."""
    tests = [value.isNull()] if required else []
    if isinstance(dtype, T.StructType):
        inner = [
            _missing(value.getField(f.name), f.dataType, not f.nullable) for f in dtype.fields
        ]
        inner = _any([test for test in inner if test is not None])
        if inner is not None:
            tests.append(value.isNotNull() & inner)
    elif isinstance(dtype, (T.ArrayType, T.MapType)):
        is_map = isinstance(dtype, T.MapType)
        item_type = dtype.valueType if is_map else dtype.elementType
        nullable = dtype.valueContainsNull if is_map else dtype.containsNull
        items = F.map_values(value) if is_map else value
        if _missing(F.lit(None), item_type, not nullable) is not None:
            found = F.exists(items, lambda item: _missing(item, item_type, not nullable))
            tests.append(F.coalesce(found, F.lit(False)))
    return _any(tests)


def _lost(
    raw: Column, value: Column, came: T.DataType, wanted: T.DataType, exact: bool
) -> Column | None:
    """True where the cast lost a value, at any depth. None if there is no cast."""
    if _same(came, wanted):
        return None
    tests = [raw.isNotNull() & value.isNull()]
    if exact and isinstance(came, MEASURES) and isinstance(wanted, MEASURES):
        tests.append(value.isNotNull() & ~value.try_cast(came).eqNullSafe(raw))
    if isinstance(came, T.StructType) and isinstance(wanted, T.StructType):
        if came.names != wanted.names:
            raise ValueError(f"nested fields {came.names} do not match {wanted.names}")
        for old, new in zip(came.fields, wanted.fields):
            inner = _lost(
                raw.getField(old.name), value.getField(new.name), old.dataType, new.dataType, exact
            )
            if inner is not None:
                tests.append(F.coalesce(inner, F.lit(False)))
    elif isinstance(came, T.ArrayType) and isinstance(wanted, T.ArrayType):
        tests.append(_lost_items(raw, value, came.elementType, wanted.elementType, exact))
    elif isinstance(came, T.MapType) and isinstance(wanted, T.MapType):
        for part, old, new in (
            (F.map_keys, came.keyType, wanted.keyType),
            (F.map_values, came.valueType, wanted.valueType),
        ):
            if not _same(old, new):
                tests.append(_lost_items(part(raw), part(value), old, new, exact))
    return _any(tests)


def _lost_items(
    raw: Column, value: Column, came: T.DataType, wanted: T.DataType, exact: bool
) -> Column:
    lost = F.zip_with(raw, value, lambda old, new: _lost(old, new, came, wanted, exact))
    return F.coalesce(F.exists(lost, lambda flag: flag), F.lit(False))


def _bad_format(value: Column, declared: str | None) -> Column | None:
    if declared is None:
        return None
    if declared == "uuid":
        return ~value.rlike(UUID_PATTERN)
    return F.octet_length(value) != fixed_length(declared)
