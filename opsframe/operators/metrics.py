"""Counters, gauges and histograms from a log of metric updates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsframe.schemas import HISTOGRAM_BOUNDS


def counter_totals(increments: DataFrame) -> DataFrame:
    """Sum of increments per counter; ``increments`` has (name, n)."""
    return increments.groupBy("name").agg(F.sum("n").alias("value"))


def gauge_latest(updates: DataFrame, order: Sequence[str] = ("ts", "ord")) -> DataFrame:
    """Value per gauge after a log of sets and adds (name, op, value, order...).

    The last set counts, plus every add after it; without a set, the adds from zero.
    """
    moment = F.struct(*order)
    is_set = F.col("op") == "set"
    last = updates.groupBy("name").agg(
        F.max(F.when(is_set, moment)).alias("_at"),
        F.max_by("value", F.when(is_set, moment)).alias("_set"),
    )
    later = (
        updates.filter(~is_set)
        .join(last, "name")
        .filter(F.col("_at").isNull() | (moment > F.col("_at")))
        .groupBy("name")
        .agg(F.sum("value").alias("_added"))
    )
    return last.join(later, "name", "left").select(
        "name",
        (F.coalesce("_set", F.lit(0.0)) + F.coalesce("_added", F.lit(0.0))).alias("value"),
    )


def latest_samples(samples: DataFrame, order: Sequence[str] = ("ts", "ord")) -> DataFrame:
    """Latest sample per (workload, metric)."""
    return samples.groupBy("workload_id", "metric").agg(
        F.max_by("value", F.struct(*order)).alias("value")
    )


def histogram_buckets(
    samples: DataFrame, bounds: Sequence[float] = tuple(HISTOGRAM_BOUNDS)
) -> DataFrame:
    """Cumulative count per bound, with total count and sum, per histogram.

    One pass and one shuffle: each bound is its own conditional sum.
    """
    counts = [
        F.count_if(F.col("value") <= F.lit(float(b))).alias(f"_b{i}") for i, b in enumerate(bounds)
    ]
    totals = samples.groupBy("name").agg(
        *counts, F.count("*").alias("count"), F.sum("value").alias("sum")
    )
    buckets = F.array(
        *[
            F.struct(F.lit(float(b)).alias("le"), F.col(f"_b{i}").alias("n"))
            for i, b in enumerate(bounds)
        ]
    )
    return totals.select("name", "count", "sum", F.explode(buckets).alias("b")).select(
        "name", F.col("b.le").alias("le"), F.col("b.n").alias("bucket_count"), "count", "sum"
    )


def metrics_snapshot(counters: DataFrame, gauges: DataFrame, buckets: DataFrame) -> DataFrame:
    """One JSON text per instrument, with its section and name.

    Instruments stay rows, so the export is as wide as the cluster; sort by
    (section, name) when writing for readers.
    """
    simple = [
        part.select(
            F.lit(section).alias("section"), "name", F.col("value").cast("string").alias("body")
        )
        for section, part in (("counters", counters), ("gauges", gauges))
    ]
    histograms = buckets.groupBy("name").agg(
        F.array_sort(
            F.collect_list(F.struct("le", F.col("bucket_count").alias("count")))
        ).alias("buckets"),
        F.first("count").alias("count"),
        F.first("sum").alias("sum"),
    )
    histograms = histograms.select(
        F.lit("histograms").alias("section"),
        "name",
        F.to_json(F.struct("buckets", "count", "sum")).alias("body"),
    )
    return simple[0].unionByName(simple[1]).unionByName(histograms)
