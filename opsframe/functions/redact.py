"""Hide secret values inside nested columns without leaving the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsframe.schemas import SECRET_KEYS

# What replaces a secret, and what lies below the depth limit.
HIDDEN = "[REDACTED]"
TOO_DEEP = "<truncated>"
MAX_DEPTH = 6


def redacted(value: Column, kind: T.DataType, depth: int = 1) -> Column:
    """Expression for ``value`` with secrets hidden.

    The schema is walked once while the plan is built.  A secret key hides any
    non-null value, whatever its type; below the depth limit everything becomes a
    marker.  Values that are hidden or cut turn into text.
    """
    if depth > MAX_DEPTH:
        return F.lit(TOO_DEEP)
    if isinstance(kind, T.StructType):
        fields = []
        for field in kind.fields:
            inner = value.getField(field.name)
            if field.name.lower() in SECRET_KEYS:
                shown = F.when(inner.isNotNull(), F.lit(HIDDEN))
            else:
                shown = redacted(inner, field.dataType, depth + 1)
            fields.append(shown.alias(field.name))
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: redacted(x, kind.elementType, depth + 1))
    if isinstance(kind, T.MapType):
        # A map holds one type, so hidden values need text values around them.
        plain = isinstance(kind.valueType, T.StringType)

        def shown(key, x):
            rest = redacted(x, kind.valueType, depth + 1)
            secret = F.lower(key).isin(SECRET_KEYS) & x.isNotNull()
            text = rest if plain else _as_text(rest, kind.valueType)
            return F.when(secret, F.lit(HIDDEN)).otherwise(text)

        return F.transform_values(value, shown)
    return value


def _as_text(value: Column, kind: T.DataType) -> Column:
    nested = isinstance(kind, (T.StructType, T.ArrayType, T.MapType))
    return F.to_json(value) if nested else value.cast("string")


def redact_secrets(df: DataFrame) -> DataFrame:
    """Hide the secrets of every column, the column's own name included."""
    out = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if field.name.lower() in SECRET_KEYS:
            column = F.when(column.isNotNull(), F.lit(HIDDEN))
        else:
            column = redacted(column, field.dataType)
        out.append(column.alias(field.name))
    return df.select(*out)
