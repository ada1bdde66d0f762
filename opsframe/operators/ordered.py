"""Per-key ordered numbering, look-back and running sums that survive hot keys.

A plain window sends every row of a key to one task.  Each helper first counts
the rows of the largest key (a map-side combined aggregate over the key columns
only).  While that fits one task the plain window is used.  Beyond it the rows
are range-partitioned on (key, order), so a hot key spreads over many slices;
each slice is worked on alone and the totals of the slices before it are added.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsframe.session import cut_lineage, rows_per_task

SLICE = "_slice"


def group_sizes(df: DataFrame, keys: Sequence[str]) -> tuple[int, int]:
    """(rows of the largest group, rows in total)."""
    row = (
        df.groupBy(*keys)
        .agg(F.count("*").alias("n"))
        .agg(F.max("n").alias("largest"), F.sum("n").alias("total"))
        .first()
    )
    return int(row["largest"] or 0), int(row["total"] or 0)


def slice_groups(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], total: int
) -> DataFrame:
    """Spread (key, order) ranges over tasks and freeze the slice number of each row.

    The slices are written out because the boundaries come from a sample: a
    second evaluation must not draw other boundaries.
    """
    spark = df.sparkSession
    tasks = max(
        int(spark.conf.get("spark.sql.shuffle.partitions")),
        -(-2 * total // rows_per_task(spark)),
    )
    ranged = df.repartitionByRange(tasks, *keys, *order)
    ranged = ranged.sortWithinPartitions(*keys, *order)
    return cut_lineage(ranged.withColumn(SLICE, F.spark_partition_id()))


def join_keys(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Join on ``keys`` with nulls matching; each key appears once in the result.

    The right keys are renamed first: both sides often come from one frame.
    """
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    matches = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    joined = left.join(renamed, matches, how)
    return joined.drop(*[f"_r_{k}" for k in keys])


def ordered_columns(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    number: str | None = None,
    previous: Mapping[str, tuple[str, object]] | None = None,
    running: Mapping[str, Column] | None = None,
    sized_by: DataFrame | None = None,
    sizes: tuple[int, int] | None = None,
) -> DataFrame:
    """Add columns that depend on the order of rows within a key.

    ``number``: name of a 1-based row number.  ``previous``: new name ->
    (column, default for the first row).  ``running``: new name -> expression
    summed over all rows up to and including this one.  ``order`` must be
    unique within the key.  ``sized_by``: a cheaper frame with at least as many rows
    per key, counted in place of ``df``; ``sizes``: what ``group_sizes`` has found already.
    """
    previous = previous or {}
    running = running or {}
    largest, total = sizes or group_sizes(df if sized_by is None else sized_by, keys)
    if largest <= rows_per_task(df.sparkSession):
        window = Window.partitionBy(*keys).orderBy(*order)
        upto = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        added = {
            name: F.lag(column, 1, default).over(window)
            for name, (column, default) in previous.items()
        }
        added |= {name: F.sum(e).over(upto) for name, e in running.items()}
        if number:
            added[number] = F.row_number().over(window).cast("long")
        return df.withColumns(added)
    return _sliced_columns(df, keys, order, total, number, previous, running)


def _sliced_columns(df, keys, order, total, number, previous, running):
    sliced = slice_groups(df, keys, order, total)
    cut = [*keys, SLICE]

    # One row per (key, slice): at most slices + keys rows in all.
    sums = [F.sum(e).alias(f"_s_{n}") for n, e in running.items()]
    lasts = [
        F.max_by(F.struct(F.col(c)), F.struct(*order)).alias(f"_l_{n}")
        for n, (c, _) in previous.items()
    ]
    totals = sliced.groupBy(*cut).agg(F.count("*").alias("_rows"), *sums, *lasts)
    by_slice = Window.partitionBy(*keys).orderBy(SLICE)
    before = by_slice.rowsBetween(Window.unboundedPreceding, -1)
    carried = {"_base": F.coalesce(F.sum("_rows").over(before), F.lit(0))}
    for n in running:
        carried[f"_s_{n}"] = F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0))
    for n in previous:
        carried[f"_l_{n}"] = F.lag(f"_l_{n}").over(by_slice)
    carry = totals.withColumns(carried)

    joined = join_keys(sliced, carry.select(*cut, *carried), cut, "left")
    within = Window.partitionBy(*cut).orderBy(*order)
    upto = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    added = {"_n": F.row_number().over(within)}
    for n, e in running.items():
        added[n] = F.col(f"_s_{n}") + F.sum(e).over(upto)
    for n, (c, _) in previous.items():
        added[n] = F.lag(c).over(within)
    out = joined.withColumns(added)
    # The first row of a slice looks back into the slice before it.
    fixed = {
        n: F.when(F.col("_n") > 1, F.col(n))
        .when(F.col("_base") > 0, F.col(f"_l_{n}")[c])
        .otherwise(F.lit(default))
        for n, (c, default) in previous.items()
    }
    if number:
        fixed[number] = (F.col("_base") + F.col("_n")).cast("long")
    return out.withColumns(fixed).drop(SLICE, "_n", *carried)


def first_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int
) -> DataFrame:
    """First ``n`` rows of each key in order.

    For small ``n`` Spark keeps only that many rows per key and map task before the
    shuffle, so a hot key never travels whole.  It does so up to a limit of its own;
    a larger ``n`` takes row numbers that survive hot keys.
    """
    limit = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if n > limit:
        numbered = ordered_columns(df, keys, order, number="_rn")
        return numbered.filter(F.col("_rn") <= n).drop("_rn")
    window = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_rn", F.row_number().over(window))
        .filter(F.col("_rn") <= n)
        .drop("_rn")
    )
