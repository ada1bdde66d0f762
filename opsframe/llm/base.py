"""Small helpers that the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the documents table, which every pipeline stage but the last returns.
DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or the first variant of it that no column of ``df`` has in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def quoted(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` with nulls matching; each key appears once, from the left."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    match = F.lit(True)
    for k in keys:
        match = match & left[k].eqNullSafe(renamed[f"_r_{k}"])
    return left.join(renamed, match, how).drop(*[f"_r_{k}" for k in keys])
