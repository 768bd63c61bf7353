"""Schema documents: the JSON that declares a table, and its Spark ``StructType``.

A document is ``{"type": "struct", "fields": [...]}``; each field has an integer
``id`` that stays with the column, a ``name``, a ``type`` and a ``required`` flag.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import types as T

FIELD_ID = "field.id"
FIELD_FORMAT = "field.format"

# Primitive type names of a document and the Spark type of each.
PRIMITIVES: dict[str, T.DataType] = {
    "boolean": T.BooleanType(),
    "int": T.IntegerType(),
    "long": T.LongType(),
    "float": T.FloatType(),
    "double": T.DoubleType(),
    "date": T.DateType(),
    "timestamp": T.TimestampNTZType(),
    "timestamptz": T.TimestampType(),
    "string": T.StringType(),
    "uuid": T.StringType(),
    "binary": T.BinaryType(),
}

# Column names that Spark or the layout of tables and indexes uses itself.
RESERVED = ("_draw", "_metadata", "_problems", "_row", "_task", "list_id", "snapshot_seq", "zone_id")

_DECIMAL = re.compile(r"decimal\(\s*(\d+)\s*,\s*(\d+)\s*\)")
_FIXED = re.compile(r"fixed[\[(](\d+)[\])]")


class SchemaDocumentError(ValueError):
    """The document does not describe a table this library can store."""


def to_struct(document: str | dict) -> T.StructType:
    """The Spark schema a document declares, with field ids kept as metadata."""
    body = json.loads(document) if isinstance(document, str) else document
    if not isinstance(body, dict) or body.get("type") != "struct":
        raise SchemaDocumentError("a schema document must be an object of type 'struct'")
    struct = _struct(body)
    if not struct.fields:
        raise SchemaDocumentError("a schema document needs at least one field")
    reserved = [name for name in struct.names if name.lower() in RESERVED]
    if reserved:
        raise SchemaDocumentError(f"reserved column names: {reserved}")
    ids = [field.metadata[FIELD_ID] for field in struct.fields]
    if len(set(ids)) != len(ids):
        raise SchemaDocumentError(f"field ids repeat: {ids}")
    return struct


def to_document(schema: T.StructType) -> str:
    """A document for an existing Spark schema; ids are given in column order."""
    ids = iter(range(1, 1_000_000))
    return json.dumps(_document_type(schema, ids))


def _struct(body: dict) -> T.StructType:
    fields = []
    for item in body.get("fields", []):
        missing = {"id", "name", "type"} - set(item)
        if missing:
            raise SchemaDocumentError(f"field {item} lacks {sorted(missing)}")
        if not isinstance(item["id"], int) or isinstance(item["id"], bool):
            raise SchemaDocumentError(f"field id must be an integer: {item['id']!r}")
        if not isinstance(item["name"], str) or not item["name"] or "`" in item["name"]:
            raise SchemaDocumentError(f"not a column name: {item['name']!r}")
        metadata = {FIELD_ID: item["id"]}
        if isinstance(item["type"], str) and (
            item["type"] == "uuid" or _FIXED.fullmatch(item["type"])
        ):
            metadata[FIELD_FORMAT] = item["type"]
        fields.append(
            T.StructField(
                item["name"], _type(item["type"]), not item.get("required", False), metadata
            )
        )
    names = [field.name.lower() for field in fields]
    if len(set(names)) != len(names):
        raise SchemaDocumentError(f"field names repeat: {names}")
    return T.StructType(fields)


def _type(declared: str | dict) -> T.DataType:
    if isinstance(declared, dict):
        kind = declared.get("type")
        if kind == "struct":
            return _struct(declared)
        if kind == "list":
            return T.ArrayType(
                _type(declared["element"]), not declared.get("element-required", False)
            )
        if kind == "map":
            return T.MapType(
                _type(declared["key"]),
                _type(declared["value"]),
                not declared.get("value-required", False),
            )
        raise SchemaDocumentError(f"unknown nested type {kind!r}")
    if declared in PRIMITIVES:
        return PRIMITIVES[declared]
    decimal = _DECIMAL.fullmatch(declared)
    if decimal:
        return T.DecimalType(int(decimal[1]), int(decimal[2]))
    if _FIXED.fullmatch(declared):
        return T.BinaryType()
    if declared == "time":
        raise SchemaDocumentError("type 'time' cannot be stored: Spark's TIME type is off by default")
    raise SchemaDocumentError(f"unknown type {declared!r}")


def fixed_length(declared: str) -> int | None:
    """The byte length in ``fixed[n]``, or None for any other type name."""
    match = _FIXED.fullmatch(declared)
    return int(match[1]) if match else None


def _document_type(dtype: T.DataType, ids) -> str | dict:
    if isinstance(dtype, T.StructType):
        numbered = [(next(ids), field) for field in dtype.fields]
        return {
            "type": "struct",
            "fields": [
                {
                    "id": number,
                    "name": field.name,
                    "type": _document_type(field.dataType, ids),
                    "required": not field.nullable,
                }
                for number, field in numbered
            ],
        }
    if isinstance(dtype, T.ArrayType):
        return {
            "type": "list",
            "element-id": next(ids),
            "element": _document_type(dtype.elementType, ids),
            "element-required": not dtype.containsNull,
        }
    if isinstance(dtype, T.MapType):
        return {
            "type": "map",
            "key-id": next(ids),
            "key": _document_type(dtype.keyType, ids),
            "value-id": next(ids),
            "value": _document_type(dtype.valueType, ids),
            "value-required": not dtype.valueContainsNull,
        }
    if isinstance(dtype, T.DecimalType):
        return f"decimal({dtype.precision},{dtype.scale})"
    for name, known in PRIMITIVES.items():
        if known == dtype:
            return name
    if isinstance(dtype, (T.ByteType, T.ShortType)):
        return "int"
    raise SchemaDocumentError(f"no document type for {dtype.simpleString()}")
