"""Chains of rows that name each other: who follows a row, and which rows a chain passes.

Both work by equality joins on rows, so a key may hold any number of them: no task sees a key whole,
and no state is handed along.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsframe.operators.ordered import group_sizes, join_keys, ordered_columns
from opsframe.session import cut_lineage, rows_per_task


def latest(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], marked: Column, value: Column, name: str, fits: bool | None = None
) -> DataFrame:
    """``df`` with ``value`` of the last marked row of the key up to and including each row; null before the first.

    ``fits``: whether a task may hold a key's rows, counted here if not given.  Where it may not, a running count of
    marked rows joins the rows behind a marked row to it.
    """
    if fits is None:
        fits = group_sizes(df, keys)[0] <= rows_per_task(df.sparkSession)
    held = F.when(marked, F.struct(value.alias("v")))
    if fits:
        upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.withColumn(name, F.last(held, ignorenulls=True).over(upto)["v"])
    counted = ordered_columns(df, keys, order, running={"_seen": marked.cast("bigint")})
    found = counted.filter(marked).select(*keys, "_seen", value.alias(name))
    return join_keys(counted, found, [*keys, "_seen"], "left").drop("_seen")


def successors(
    asks: DataFrame, offers: DataFrame, keys: Sequence[str], strict: bool = False, fits: bool | None = None
) -> DataFrame:
    """(keys, node, next): for each ask (keys, node, at) the first offer (keys, node, at) of its key at that place or later.

    ``strict`` looks behind the place only.  Asks that nothing follows are left out.
    """
    first, second = (1, 0) if strict else (0, 1)

    def side(df: DataFrame, kind: int, offer: bool) -> DataFrame:
        return df.select(
            *keys, (-F.col("at")).alias("_back"), F.lit(kind).alias("_kind"), "node", F.lit(offer).alias("_offer")
        )

    both = side(offers, first, True).unionByName(side(asks, second, False))
    back = ["_back", "_kind", "node"]
    found = latest(both, keys, back, F.col("_offer"), F.col("node"), "next", fits)
    return found.filter("not _offer and next is not null").select(*keys, "node", "next")


def reached(links: DataFrame, heads: DataFrame, keys: Sequence[str], crowded: bool = True) -> DataFrame:
    """(keys, node): the heads and all nodes that links (keys, node, next) lead to from them.

    Pointers double: after n rounds the nodes up to 2^n links away are known, and every pointer spans 2^n
    links, so rounds grow with the logarithm of the longest chain.  A pointer that runs out of its chain drops
    out.  ``crowded``: many nodes lead to one; those that none leads to are dropped first.
    """
    named = [*keys, "node"]
    pointers = links.select(*named, "next")
    if crowded:
        pointers = cut_lineage(pointers)
        ends = pointers.select(*keys, F.col("next").alias("node")).unionByName(heads.select(*named)).distinct()
        pointers = join_keys(pointers, ends, named).select(*named, "next")
    pointers = cut_lineage(pointers)
    known = [cut_lineage(heads.select(*named))]
    while True:
        so_far = reduce(DataFrame.unionByName, known)
        new = cut_lineage(join_keys(pointers, so_far, named).select(*keys, F.col("next").alias("node")))
        if new.isEmpty():
            return so_far
        known.append(new)
        onward = pointers.select(*keys, F.col("node").alias("next"), F.col("next").alias("_onward"))
        pointers = cut_lineage(
            join_keys(pointers, onward, [*keys, "next"]).select(*named, F.col("_onward").alias("next"))
        )
