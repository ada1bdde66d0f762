"""Fixed virtual slots: rows hash into thousands of slots, and a small versioned map sends slots to shards.

A row's slot never changes.  Growing or rebalancing edits the map only, and a new
version names the slots that moved.  The shards' sizes are made near equal in bytes.
"""

from __future__ import annotations

import bisect
import heapq
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opsframe.llm.base import quoted

SLOTS = 8192
SHARDS = 24
#: Equal rows beyond this many go on in another slot, so no slot is bound to hold them all.
COPIES_PER_SLOT = 256


@dataclass(frozen=True)
class SlotMap:
    """``shard[slot]`` for every virtual slot; edits give a new version."""

    version: int
    shards: int
    shard: tuple[int, ...]

    @staticmethod
    def even(slots: int = SLOTS, shards: int = SHARDS) -> SlotMap:
        """The first version, made before anything is known about sizes."""
        return SlotMap(1, shards, tuple(s % shards for s in range(slots)))

    def rebalanced(self, size: dict[int, int], shards: int | None = None) -> SlotMap:
        """Edit the map so that shard sizes come near each other.

        A shard above the mean gives up the largest slots that fit into what it has too much, so few slots move;
        shards that are gone give up all of theirs.  What moves goes, largest first, to the shard that is
        smallest at that moment.
        """
        shards = shards or self.shards
        mean = sum(size.values()) / shards
        new, moving = list(self.shard), []
        own: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
        for slot, at in enumerate(new):
            if at < shards:
                own[at].append((size.get(slot, 0), slot))
            else:
                moving.append(slot)
        load = [sum(much for much, _ in slots) for slots in own]
        for at, slots in enumerate(own):
            slots.sort()
            while slots and load[at] > mean:
                over = load[at] - mean
                place = bisect.bisect_right(slots, (over, len(new))) - 1
                if place < 0 and slots[0][0] >= 2 * over:  # the smallest slot would leave it further below than it is above
                    break
                much, slot = slots.pop(max(place, 0))
                if not much:
                    break
                load[at] -= much
                moving.append(slot)
        heap = [(much, at) for at, much in enumerate(load)]
        heapq.heapify(heap)
        for slot in sorted(moving, key=lambda s: (-size.get(s, 0), s)):
            much, at = heapq.heappop(heap)
            new[slot] = at
            heapq.heappush(heap, (much + size.get(slot, 0), at))
        return SlotMap(self.version + 1, shards, tuple(new))

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(self.version, self.shards, s, at) for s, at in enumerate(self.shard)]
        return spark.createDataFrame(rows, "version int, shards int, virtual_slot int, shard int")

    def save(self, spark: SparkSession, path: str) -> None:
        """Add this version to the stored map; earlier versions stay readable."""
        self.frame(spark).coalesce(1).write.partitionBy("version").mode("append").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        stored = spark.read.parquet(path)
        version = version or stored.agg(F.max("version")).first()[0]
        rows = stored.filter(F.col("version") == version).orderBy("virtual_slot").collect()
        return SlotMap(version, rows[0]["shards"], tuple(r["shard"] for r in rows))


def slotted(docs: DataFrame, key: str, text: str, slots: int = SLOTS) -> DataFrame:
    """One row per distinct (key, text) and slot: key, size, text_crc32, copies, virtual_slot.

    Equal rows are counted before the shuffle, then cut into runs that hash to slots of their own.
    """
    body = F.coalesce(quoted(text).cast("string"), F.lit(""))
    rows = docs.select(
        quoted(key).alias("doc_id"),
        (F.octet_length(body) + 8).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
    )
    counted = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
    runs = counted.withColumn(
        "run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES_PER_SLOT)))
    )
    return runs.select(
        "doc_id",
        "size",
        "text_crc32",
        F.least(F.lit(COPIES_PER_SLOT), F.col("n") - F.col("run") * COPIES_PER_SLOT).alias("copies"),
        F.pmod(F.xxhash64("doc_id", "size", "text_crc32", "run"), F.lit(slots))
        .cast("int")
        .alias("virtual_slot"),
    )


def slot_totals(rows: DataFrame) -> list:
    """Bytes and rows per slot: at most as many rows as there are slots, whatever the input."""
    return (
        rows.groupBy("virtual_slot")
        .agg(F.sum(F.col("size") * F.col("copies")).alias("bytes"), F.sum("copies").alias("rows"))
        .collect()
    )


def shard_rows(
    docs: DataFrame,
    shards: int = SHARDS,
    slots: int = SLOTS,
    key: str = "doc_id",
    text: str = "text",
    before: SlotMap | None = None,
) -> tuple[DataFrame, SlotMap]:
    """Every row's shard under a map rebalanced for these rows, and that map.

    Returns doc_id, size (UTF-8 bytes of the text plus 8; 8 for null), text_crc32 (0 for null or
    empty), shard, slot (place in the shard, gapless from 0), virtual_slot and map_version.
    ``before`` is the stored map to edit (the even first version if none).  Null keys hash like any
    value; equal rows each get a place of their own; an empty table gives no rows; other
    columns are not looked at.
    """
    rows = slotted(docs, key, text, slots)
    totals = slot_totals(rows)
    plan = (before or SlotMap.even(slots, shards)).rebalanced(
        {r["virtual_slot"]: r["bytes"] for r in totals}, shards
    )
    count = {r["virtual_slot"]: r["rows"] for r in totals}
    first, filled = [], [0] * shards
    for slot, at in enumerate(plan.shard):
        first.append(filled[at])
        filled[at] += count.get(slot, 0)
    spark = docs.sparkSession
    places = spark.createDataFrame(
        [(s, at, first[s]) for s, at in enumerate(plan.shard)], "virtual_slot int, shard int, first long"
    )
    within = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size", "copies")
    placed = rows.withColumn(
        "before", F.sum("copies").over(within.rowsBetween(Window.unboundedPreceding, -1))
    ).join(F.broadcast(places), "virtual_slot")  # one row per slot, so bounded by ``slots``
    start = F.col("first") + F.coalesce("before", F.lit(0))
    out = placed.withColumn("slot", F.explode(F.sequence(start, start + F.col("copies") - 1)))
    return (
        out.select(
            "doc_id", "size", "text_crc32", "shard", "slot", "virtual_slot",
            F.lit(plan.version).alias("map_version"),
        ),
        plan,
    )
