"""Entity tables stored as (id, JSON payload) rows."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsframe.functions.keys import escape_non_ascii, json_number, json_quoted
from opsframe.schemas import ENTITIES, ENTITY_DEFAULTS


def latest_rows(rows: DataFrame, version: str) -> DataFrame:
    """Last write per id: one mergeable aggregate, whatever the number of writes."""
    return rows.groupBy("id").agg(F.max_by("payload", version).alias("payload"))


def decode_entity_rows(rows: DataFrame, entity: str, version: str | None = None) -> DataFrame:
    """Typed rows of (id, payload); absent keys get the entity's defaults."""
    stored = rows if version is None else latest_rows(rows, version)
    schema = T.StructType.fromDDL(ENTITIES[entity])
    parsed = stored.select(F.from_json("payload", schema).alias("p"))
    defaults = ENTITY_DEFAULTS.get(entity, {})
    return parsed.select(
        *[
            F.coalesce(F.col(f"p.`{f.name}`"), F.expr(defaults[f.name])).alias(f.name)
            if f.name in defaults
            else F.col(f"p.`{f.name}`").alias(f.name)
            for f in schema.fields
        ]
    )


def _json(value: Column, kind: T.DataType) -> Column:
    """Compact JSON text with struct fields and map keys in sorted order."""
    comma = lambda parts: F.array_join(parts, ",")
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        parts = [
            F.concat(F.lit(json.dumps(f.name) + ":"), _json(value.getField(f.name), f.dataType))
            for f in fields
        ]
        text = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        items = F.transform(value, lambda x: _json(x, kind.elementType))
        text = F.concat(F.lit("["), comma(items), F.lit("]"))
    elif isinstance(kind, T.MapType):
        entries = F.array_sort(
            F.map_entries(value), lambda a, b: F.when(a["key"] < b["key"], -1).otherwise(1)
        )
        items = F.transform(
            entries,
            lambda e: F.concat(
                json_quoted(e["key"].cast("string")), F.lit(":"), _json(e["value"], kind.valueType)
            ),
        )
        text = F.concat(F.lit("{"), comma(items), F.lit("}"))
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        text = json_number(value.cast("double"))
    elif isinstance(kind, (T.IntegralType, T.BooleanType, T.DecimalType)):
        text = value.cast("string")
    elif isinstance(kind, T.StringType):
        text = json_quoted(value)
    else:  # dates and times as Spark writes them
        text = F.regexp_extract(F.to_json(F.struct(value.alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1)
    return F.when(value.isNull(), "null").otherwise(text)


def encode_entity_rows(df: DataFrame, id_column: str = "id") -> DataFrame:
    """(id, payload): every column as compact JSON with sorted keys."""
    fields = sorted(df.schema.fields, key=lambda f: f.name)
    body = F.struct(*[F.col(f"`{f.name}`").alias(f.name) for f in fields])
    payload = escape_non_ascii(_json(body, T.StructType(fields)))
    return df.select(F.col(id_column).cast("string").alias("id"), payload.alias("payload"))
