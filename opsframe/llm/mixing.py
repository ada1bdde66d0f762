"""Sainte-Laguë mixing: sources get equal-token blocks by highest quotients, then seeded blocks are taken.

A source is a stream of tokens, its documents in seeded order.  A seat is a block of
``block_tokens`` tokens; a source's seats are consecutive blocks of the stream from a seeded start,
going round again when the stream ends, so every token is repeated as often as any other, give or
take one.  Seats are given out shard by shard: Sainte-Laguë is house monotone, so a shard's quotas
are the difference of two apportionments and sum exactly to the whole mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsframe.llm.base import fresh, null_safe, quoted

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
BLOCK_TOKENS = 64
SHARDS = 24
SEED = "mix-1"
#: Equal rows beyond this many start another run, so one hot row spreads over tasks.
COPIES_PER_RUN = 256


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(
    sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_REPEATS
) -> DataFrame:
    """Each source's target: its share by weight of all sizes, at most ``most`` times its own size.

    ``sizes`` has source and source_size, a row per source.  Sources in code-point order, null last,
    take the weights in turn.  What a full source leaves goes to the others by weight: in
    order of size per weight, a source is full if it lies below the level of those after it.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    ranked = sizes.withColumn("rank", F.row_number().over(by_name) - 1)
    weighted = ranked.withColumn(
        "weight",
        F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")),
    ).withColumn("full", F.col("source_size") * F.lit(most))
    rising = Window.orderBy(F.col("full") / F.col("weight"), "rank")
    everyone = rising.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = F.coalesce(F.sum("full").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_weight = F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing))
    level = (F.sum("source_size").over(everyone) - filled) / open_weight
    return (
        weighted.withColumn("level", level)
        .withColumn("is_full", F.col("full") <= F.col("level") * F.col("weight"))
        .withColumn("open_level", F.min(F.when(~F.col("is_full"), F.struct(F.col("full") / F.col("weight"), "rank", "level"))).over(everyone)["level"])
        .select(
            "source", "rank", "weight", "source_size",
            F.when(F.col("is_full"), F.col("full").cast("double"))
            .otherwise(F.col("open_level") * F.col("weight")).alias("target"),
        )
    )


def apportion(target: DataFrame, block_tokens: int = BLOCK_TOKENS, shards: int = SHARDS) -> DataFrame:
    """Seats of each source after each shard: source, shard, seats (this shard's), until (all so far).

    The highest quotients target/(2k+1) win.  Only those near the deciding level are listed: with n
    seats, k sources and total w, every source is sure of target*(n-k/2)/w rounded down at a half,
    which leaves at most k seats to decide.
    """
    everyone = Window.partitionBy("shard")
    per_source = target.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    whole, k = F.sum("target").over(everyone), F.count("*").over(everyone)
    blocks = F.floor(F.round(F.sum("source_size").over(everyone) / block_tokens) * (F.col("shard") + 1) / shards)
    known = per_source.withColumns({"whole": whole, "k": k, "blocks": blocks.cast("long")}).filter("whole > 0")
    sure = known.withColumn(
        "sure",
        F.greatest(F.lit(0), F.ceil(F.col("target") * (F.col("blocks") - F.col("k") / 2) / F.col("whole") - 0.5 - 1e-9)).cast("long"),
    ).withColumn("left", F.col("blocks") - F.sum("sure").over(everyone))
    more = sure.filter("target > 0").withColumn(
        "seat",
        F.explode(F.sequence("sure", F.col("sure") + F.floor(F.col("target") * F.col("k") / F.col("whole")).cast("long") + 2)),
    )
    best = Window.partitionBy("shard").orderBy(F.desc(F.col("target") / (2 * F.col("seat") + 1)), "rank", "seat")
    won = (
        more.withColumn("place", F.row_number().over(best))
        .filter(F.col("place") <= F.col("left"))
        .groupBy("shard", "rank").agg(F.count("*").alias("won"))
    )
    until = sure.join(won, ["shard", "rank"], "left").withColumn(
        "until", F.col("sure") + F.coalesce("won", F.lit(0))
    )
    before = F.lag("until", 1, 0).over(Window.partitionBy("rank").orderBy("shard"))
    return until.withColumn("seats", F.col("until") - before).select(
        "source", "rank", "weight", "source_size", "target", "shard", "seats", "until"
    )


def token_streams(docs: DataFrame, key: str, source: str, text: str, seed: str = SEED) -> DataFrame:
    """Each run of equal rows with the token at which it starts in its source's stream.

    Returns doc_id, source, size, copies, start.  Rows are put in 4,096 seeded ranges, whose
    totals are summed up in two levels of 64, so no task sees a whole source.
    """
    rows = docs.select(
        quoted(key).alias("doc_id"), quoted(source).alias("source"),
        token_count(quoted(text)).alias("size"),
        F.md5(F.coalesce(quoted(text), F.lit(""))).alias("digest"),
    )
    counted = rows.groupBy("doc_id", "source", "size", "digest").agg(F.count("*").alias("n"))
    runs = counted.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES_PER_RUN))))
    order = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "digest", "run"))
    runs = runs.select(
        "doc_id", "source", "size", "digest",
        F.least(F.lit(COPIES_PER_RUN), F.col("n") - F.col("run") * COPIES_PER_RUN).alias("copies"),
        order.alias("place"),
    ).withColumn("range", F.conv(F.substring("place", 1, 3), 16, 10).cast("int"))
    tokens = F.col("size") * F.col("copies")
    per_range = runs.groupBy("source", "range").agg(F.sum(tokens).alias("tokens")).withColumn("high", F.floor(F.col("range") / 64))
    below = lambda w: F.coalesce(F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    low = per_range.withColumn("low_start", below(Window.partitionBy("source", "high").orderBy("range")))
    high = (
        per_range.groupBy("source", "high").agg(F.sum("tokens").alias("tokens"))
        .withColumn("high_start", below(Window.partitionBy("source").orderBy("high"))).drop("tokens")
    )
    starts = null_safe(low, high, ["source", "high"]).select(
        "source", "range", (F.col("low_start") + F.col("high_start")).alias("range_start")
    )
    inside = Window.partitionBy("source", "range").orderBy("place", "doc_id", "size")
    placed = runs.withColumn("inside", F.coalesce(F.sum(tokens).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return null_safe(placed, starts, ["source", "range"]).select(
        "doc_id", "source", "size", "digest", "copies", (F.col("range_start") + F.col("inside")).alias("start")
    )


def plan_mix(
    docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text",
    weights: tuple[float, ...] = WEIGHTS, most: int = MOST_REPEATS,
    block_tokens: int = BLOCK_TOKENS, shards: int = SHARDS, seed: str = SEED,
) -> tuple[DataFrame, DataFrame]:
    """(documents with what the mix takes of them, quotas per source and shard).

    Documents: doc_id, source, size, source_size, target, taken (words, repeats counted), first_token
    (its place in the stream), start_token and run_tokens (what the source gives: so many tokens from there,
    going round).  A null text has no words and none is taken; a null source is a
    source of its own; equal rows each keep a row; an empty table gives no rows; other columns are
    not looked at.  The mix never takes a document more than ``most`` times.
    """
    sizes = docs.select(quoted(source).alias("source"), token_count(quoted(text)).alias("n")).groupBy("source").agg(F.sum("n").alias("source_size"))
    quotas = apportion(targets(sizes, weights, most), block_tokens, shards)
    ends = quotas.groupBy("source", "source_size", "target").agg(
        F.least(F.max("until") * block_tokens, F.col("source_size") * most).alias("run_tokens")
    )
    turn = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.coalesce("source", F.lit("-")))), 1, 12), 16, 10).cast("long")
    ends = ends.withColumn("start_token", F.when(F.col("source_size") > 0, turn % F.col("source_size")).otherwise(0))
    streams = null_safe(token_streams(docs, key, source, text, seed), ends, ["source"], "left")
    rows = streams.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).withColumn(
        "first_token", F.col("start") + F.col("copy") * F.col("size")
    )
    whole = F.floor(F.col("run_tokens") / F.col("source_size"))
    rest = F.col("run_tokens") % F.col("source_size")
    last = F.col("first_token") + F.col("size")
    shared = lambda a, b: F.greatest(F.lit(0), F.least(last, b) - F.greatest(F.col("first_token"), a))
    end = F.col("start_token") + rest
    extra = shared(F.col("start_token"), F.least(end, F.col("source_size"))) + shared(F.lit(0), end - F.col("source_size"))
    taken = F.when(F.col("source_size") > 0, whole * F.col("size") + extra).otherwise(0)
    mixed = rows.select(
        "doc_id", "source", "size", F.coalesce("source_size", F.lit(0)).cast("long").alias("source_size"),
        F.coalesce("target", F.lit(0.0)).alias("target"), F.coalesce(taken, F.lit(0)).cast("long").alias("taken"),
        "first_token", "start_token", "run_tokens", "digest",
    )
    return mixed, quotas.filter("seats > 0")


def repeats(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", **how) -> DataFrame:
    """``docs`` with each row given as often as the mix takes it: whole rows, all columns kept.

    A row comes once for every pass of its source's run over its first token, so a source's words
    stay near its target.  Among equal rows that share an uneven number of takings, a seeded draw
    on the row's place in the input decides who gets one more.
    """
    mixed, _ = plan_mix(docs, key, source, text, **how)
    length = F.nullif(F.col("source_size"), F.lit(0))  # a source without words has no places, and gives no rows
    at = F.col("first_token") % length
    end = F.col("start_token") + F.col("run_tokens") % length
    again = ((at >= F.col("start_token")) & (at < end)) | (at < end - length)
    times = F.floor(F.col("run_tokens") / length) + again.cast("int")
    name = {n: fresh(docs, f"_mix_{n}") for n in ("key", "source", "digest", "share", "row", "count", "copy")}
    col = {n: quoted(c) for n, c in name.items()}
    share = (
        mixed.withColumn("times", F.coalesce(times, F.lit(0)))
        .groupBy("doc_id", "source", "digest").agg(F.avg("times").alias("share")).filter("share > 0")
        .select(*[F.col(c).alias(name[n]) for n, c in (("key", "doc_id"), ("source", "source"), ("digest", "digest"), ("share", "share"))])
    )
    digest = F.md5(F.coalesce(quoted(text), F.lit("")))
    chosen = docs.withColumn(name["row"], F.monotonically_increasing_id()).join(
        share, quoted(key).eqNullSafe(col["key"]) & quoted(source).eqNullSafe(col["source"]) & (digest == col["digest"])
    )
    draw = F.pmod(F.xxhash64(col["digest"], col["row"]), F.lit(1 << 20)) / (1 << 20)
    whole = F.floor(col["share"])
    count = whole + (draw < col["share"] - whole).cast("int")
    return (
        chosen.withColumn(name["count"], count).filter(col["count"] > 0)
        .withColumn(name["copy"], F.explode(F.sequence(F.lit(1).cast("long"), col["count"])))
        .select(*[quoted(c) for c in docs.columns])
    )
