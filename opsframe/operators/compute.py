"""Leases, node capacity and placement.

``nodes`` (id, tags, capacity_cpu, capacity_mem, state), ``workloads`` (id, cpu,
memory, policy, node_tags, pin, spread, priority, status, desired_replicas,
created_at), ``leases`` (id, workload_id, node_id, state, created_at, expires_at).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsframe.operators.chains import latest, reached, successors
from opsframe.operators.folds import Machine, fold
from opsframe.operators.ordered import group_sizes, join_keys, ordered_columns
from opsframe.session import cut_lineage, rows_per_task


def live_leases(leases: DataFrame, now: Column) -> DataFrame:
    return leases.filter((F.col("state") == "active") & (F.col("expires_at") > now))


def node_load(
    nodes: DataFrame, workloads: DataFrame, leases: DataFrame, now: Column
) -> DataFrame:
    """Nodes with the live leases of active workloads they carry, zero-filled.

    Leases are counted per (workload, node) before the join, so a workload or
    node that holds a large share of the leases is combined map-side.
    """
    held = live_leases(leases, now).groupBy("workload_id", "node_id").agg(F.count("*").alias("n"))
    needs = workloads.filter(F.col("status") == "active").select(
        F.col("id").alias("workload_id"), "cpu", "memory"
    )
    used = (
        held.join(needs, "workload_id")
        .groupBy("node_id")
        .agg(
            F.sum("n").alias("leases"),
            F.sum(F.col("n") * F.col("cpu")).alias("used_cpu"),
            F.sum(F.col("n") * F.col("memory")).alias("used_mem"),
        )
        .withColumnRenamed("node_id", "id")
    )
    filled = {c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("leases", "used_cpu", "used_mem")}
    return nodes.join(used, "id", "left").withColumns(filled)


def node_headroom(loaded: DataFrame, cpu: int, memory: int) -> DataFrame:
    """Free capacity per node, and whether it can host one (cpu, memory) replica."""
    return loaded.withColumns(
        {
            "free_cpu": F.col("capacity_cpu") - F.col("used_cpu"),
            "free_mem": F.col("capacity_mem") - F.col("used_mem"),
        }
    ).withColumn(
        "can_host",
        (F.col("state") == "active") & (F.col("free_cpu") >= cpu) & (F.col("free_mem") >= memory),
    )


def replica_backlog(workloads: DataFrame, leases: DataFrame, now: Column) -> DataFrame:
    """Live leases, deficit and surplus per active workload."""
    live = live_leases(leases, now).groupBy(F.col("workload_id").alias("id")).agg(
        F.count("*").alias("live")
    )
    active = workloads.filter(F.col("status") == "active").join(live, "id", "left")
    have = F.coalesce("live", F.lit(0))
    want = F.col("desired_replicas")
    return active.select(
        "id",
        "priority",
        "created_at",
        have.alias("live"),
        want.alias("desired"),
        F.greatest(want - have, F.lit(0)).cast("bigint").alias("deficit"),
        F.greatest(have - want, F.lit(0)).cast("bigint").alias("surplus"),
    )


def by_turn(backlog: DataFrame) -> DataFrame:
    """Order in which workloads are served."""
    return backlog.orderBy(F.desc("priority"), "created_at", "id")


def release_candidates(
    workloads: DataFrame, leases: DataFrame, nodes: DataFrame, now: Column
) -> DataFrame:
    """Leases to give back: draining nodes first, then oldest, per surplus workload."""
    surplus = (
        replica_backlog(workloads, leases, now)
        .filter("surplus > 0")
        .select(F.col("id").alias("workload_id"), "surplus")
    )
    held = live_leases(leases, now).join(surplus, "workload_id")
    draining = nodes.filter(F.col("state") == "draining").select(
        F.col("id").alias("node_id"), F.lit(0).alias("_late")
    )
    held = held.join(draining, "node_id", "left").withColumn(
        "_late", F.coalesce("_late", F.lit(1))
    )
    numbered = ordered_columns(
        held, ["workload_id"], ["_late", "created_at", "id"], number="turn", sized_by=leases
    )
    return numbered.filter(F.col("turn") <= F.col("surplus")).drop("_late", "surplus")


# ------------------------------------------------------------------- placement
#
# A workload's demand is (cpu, memory, tags, spread, policy); all workloads with
# the same demand get the same answer, so the search runs once per distinct demand
# and never pairs workloads with nodes.  "free cpu >= c and free memory >= m" is
# answered with equality joins: every node adds itself to the binary blocks
# (level, free >> level) that contain it, blocks are reduced to a count and the best
# node per policy, and a demand looks up the few blocks that make up [c, max].

def _tag_key(tags: Column) -> Column:
    return F.to_json(F.array_sort(F.array_distinct(tags)))


def _in_blocks(df: DataFrame, value: str, name: str, bits: int) -> DataFrame:
    """Repeat rows once per block that contains ``value``."""
    level = f"_{name}"
    return (
        df.withColumn(level, F.explode(F.sequence(F.lit(0), F.lit(bits))))
        .withColumn(name, F.expr(f"struct({level} as level, shiftright({value}, {level}) as block)"))
        .drop(level)
    )


def _ask_blocks(df: DataFrame, value: str, name: str, bits: int) -> DataFrame:
    """Repeat rows once per block of a disjoint cover of [value, 2^bits)."""
    level = f"_{name}"
    above = f"shiftright({value}, {level})"
    return (
        df.withColumn(level, F.explode(F.sequence(F.lit(-1), F.lit(bits - 1))))
        .filter(f"{level} < 0 or {above} % 2 = 0")
        .withColumn(
            name,
            F.expr(
                f"if({level} < 0, struct(0 as level, {value} as block),"
                f" struct({level} as level, {above} + 1 as block))"
            ),
        )
        .drop(level)
    )


def _tagged_nodes(nodes: DataFrame, demands: DataFrame) -> DataFrame:
    """Nodes repeated once per requested tag set they satisfy (``tag_key``)."""
    sets = demands.select("tag_key", "tags").distinct()
    wanted = sets.select("tag_key", F.size("tags").alias("_need"), F.explode("tags").alias("tag"))
    have = nodes.select("id", F.explode(F.array_distinct("tags")).alias("tag"))
    covered = (
        have.join(wanted, "tag")
        .groupBy("id", "tag_key", "_need")
        .agg(F.count("*").alias("_has"))
        .filter(F.col("_has") == F.col("_need"))
        .select("id", "tag_key")
    )
    any_node = nodes.select("id", F.lit("[]").alias("tag_key"))
    return nodes.join(covered.unionByName(any_node), "id")


def placements(workloads: DataFrame, loaded: DataFrame) -> DataFrame:
    """Number of eligible nodes and the preferred one, per active workload.

    Eligible: active, pinned node if any, all tags, enough free cpu and memory,
    and no live lease at all when the workload spreads.  Preferred: bin_pack takes
    the most free cpu, round_robin the fewest leases, fifo and priority the
    least used cpu; ties go to the smaller id.
    """
    active = workloads.filter(F.col("status") == "active").withColumns(
        {
            "tags": F.array_sort(F.array_distinct("node_tags")),
            "tag_key": _tag_key(F.col("node_tags")),
            "pin": F.nullif("pin", F.lit("")),
        }
    )
    free = loaded.filter(F.col("state") == "active").withColumns(
        {
            "free_cpu": F.col("capacity_cpu") - F.col("used_cpu"),
            "free_mem": F.col("capacity_mem") - F.col("used_mem"),
        }
    )
    # The node side is used several times; the scan of the leases behind it is not.
    free = cut_lineage(free)
    pinned = _pinned(active.filter("pin is not null"), free)
    shared = _shared(active.filter("pin is null"), free.filter("free_cpu >= 0 and free_mem >= 0"))
    found = pinned.unionByName(shared)
    return active.select("id", "policy").join(found, "id", "left").select(
        "id",
        "policy",
        F.coalesce("eligible", F.lit(0)).alias("eligible"),
        "node_id",
    )


def _pinned(workloads: DataFrame, free: DataFrame) -> DataFrame:
    target = free.select(
        F.col("id").alias("pin"),
        F.col("tags").alias("node_has"),
        "free_cpu",
        "free_mem",
        "leases",
    )
    fits = (
        (F.size(F.array_except("tags", "node_has")) == 0)
        & (F.col("free_cpu") >= F.col("cpu"))
        & (F.col("free_mem") >= F.col("memory"))
        & (~F.col("spread") | (F.col("leases") == 0))
    )
    return (
        workloads.join(target, "pin")
        .filter(fits)
        .select("id", F.lit(1).cast("bigint").alias("eligible"), F.col("pin").alias("node_id"))
    )


def _shared(workloads: DataFrame, free: DataFrame) -> DataFrame:
    top = free.agg(F.max("free_cpu").alias("c"), F.max("free_mem").alias("m")).first()
    cpu_bits = int(top["c"] or 0).bit_length()
    mem_bits = int(top["m"] or 0).bit_length()
    demand = ["cpu", "memory", "tag_key", "spread", "policy"]
    demands = (
        workloads.filter((F.col("cpu") <= F.lit(top["c"])) & (F.col("memory") <= F.lit(top["m"])))
        .select(*demand, "tags")
        .distinct()
    )
    places = _places(free, demands, cpu_bits, mem_bits)
    cell = ["tag_key", "spread", "c", "m"]
    asked = _ask_blocks(demands.select(*demand), "cpu", "c", cpu_bits)
    asked = _ask_blocks(asked, "memory", "m", mem_bits)
    answers = (
        asked.join(places, cell)
        .groupBy(*demand)
        .agg(
            F.sum("n").alias("eligible"),
            F.min("packed").alias("packed"),
            F.min("fewest").alias("fewest"),
            F.min("idlest").alias("idlest"),
        )
        .select(
            *demand,
            "eligible",
            F.when(F.col("policy") == "bin_pack", F.col("packed.id"))
            .when(F.col("policy") == "round_robin", F.col("fewest.id"))
            .otherwise(F.col("idlest.id"))
            .alias("node_id"),
        )
    )
    return workloads.join(answers, demand).select("id", "eligible", "node_id")


def _places(free: DataFrame, demands: DataFrame, cpu_bits: int, mem_bits: int) -> DataFrame:
    """Block contents: node count and the preferred node under each policy."""
    idle_too = F.when(F.col("leases") == 0, F.array(F.lit(False), F.lit(True)))
    spread_over = _tagged_nodes(free, demands).withColumn(
        "spread", F.explode(F.coalesce(idle_too, F.array(F.lit(False))))
    )
    in_cpu = _in_blocks(spread_over, "free_cpu", "c", cpu_bits)
    in_both = _in_blocks(in_cpu, "free_mem", "m", mem_bits)
    return in_both.groupBy("tag_key", "spread", "c", "m").agg(
        F.count("*").alias("n"),
        F.min(F.struct((-F.col("free_cpu")).alias("k"), "id")).alias("packed"),
        F.min(F.struct(F.col("leases").alias("k"), "id")).alias("fewest"),
        F.min(F.struct(F.col("used_cpu").alias("k"), "id")).alias("idlest"),
    )


# ----------------------------------------------------------------- lease history

_LEASE_ORDER = ["at_us", "op", "nonce", "old_us", "new_us"]


def lease_history(log: DataFrame) -> DataFrame:
    """Verdict per lease action in time order.

    ``log`` has (lease_id, at_us, op renew|release, nonce, old_us, new_us, granted_nonce,
    granted_us); the last two repeat the grant.  A renewal counts when the lease is
    active, the nonce is the holder's and the expiry it saw is the current one.
    Leases that fit a task are stepped through in one sorted pass, so the log is shuffled once.  Where one does not,
    the renewals that count are found as a chain of rows, so a lease may hold all rows of the log.
    """
    log = log.select("lease_id", *_LEASE_ORDER, "granted_nonce", "granted_us")
    sizes = group_sizes(log, ["lease_id"])
    if sizes[0] > rows_per_task(log.sparkSession):
        return _lease_chains(log, sizes)

    def step(state, row):
        _, _, op, nonce, old, new, holder, granted = row
        expires, over = state or (granted, False)
        if over:
            found = "rejected", "illegal: released"
        elif op == "release":
            over, found = True, ("released", "")
        elif nonce != holder:
            found = "rejected", "nonce mismatch"
        elif old != expires:
            found = "rejected", "stale expires_at"
        else:
            expires, found = new, ("renewed", "")
        return (expires, over), (*found, expires)

    outputs = [("verdict", "string"), ("reason", "string"), ("expires_us", "long")]
    return fold(log, ["lease_id"], _LEASE_ORDER, Machine(lambda row: None, step, outputs), sizes=sizes)


def _lease_chains(log: DataFrame, sizes: tuple[int, int]) -> DataFrame:
    """``lease_history`` by pointers between rows, where a lease is too long for a task.

    Renewals form a linked list: one that counts is followed by the first later one of the holder that saw the
    expiry it set.  The list that begins at the grant holds those that count; the others are judged by how
    many of these stand before them.
    """
    lease, order = ["lease_id"], _LEASE_ORDER
    release = F.col("op").eqNullSafe("release")
    numbered = cut_lineage(
        ordered_columns(log, lease, order, number="node", running={"_ends": release.cast("bigint")}, sizes=sizes)
    )
    holders = F.col("nonce").eqNullSafe(F.col("granted_nonce"))
    offers = numbered.filter(~release & holders & (F.col("_ends") == 0))
    grants = numbered.filter("node = 1").select("lease_id", F.lit(0).cast("long").alias("node"), F.col("granted_us").alias("saw"))
    asks = offers.select("lease_id", "node", F.col("new_us").alias("saw")).unionByName(grants)
    at = F.col("node").alias("at")
    links = successors(
        asks.select("*", at), offers.select("lease_id", "node", F.col("old_us").alias("saw"), at), ["lease_id", "saw"], True
    )
    counted = reached(links.drop("saw"), grants.select("lease_id", "node"), lease, crowded=False).withColumn("_counts", F.lit(True))
    judged = join_keys(numbered, counted, ["lease_id", "node"], "left").withColumn("_counts", F.coalesce("_counts", F.lit(False)))
    judged = latest(judged, lease, ["node"], F.col("_counts"), F.struct(F.col("new_us").alias("to")), "_set", False)
    expires = F.when(F.col("_set").isNull(), F.col("granted_us")).otherwise(F.col("_set")["to"])
    over = F.col("_ends") > release.cast("bigint")
    verdict = F.when(F.col("_counts"), "renewed").when(release & ~over, "released").otherwise("rejected")
    reason = (
        F.when(F.col("_counts") | (release & ~over), "")
        .when(over, "illegal: released")
        .when(~holders, "nonce mismatch")
        .otherwise("stale expires_at")
    )
    return judged.select(
        "lease_id", *order, "granted_nonce", "granted_us",
        verdict.alias("verdict"), reason.alias("reason"), expires.alias("expires_us"),
    )


def lease_states(history: DataFrame, now_us: int) -> DataFrame:
    """Standing of each lease at ``now``: live, expired or released."""
    last = history.groupBy("lease_id").agg(
        F.max_by("expires_us", F.struct(*_LEASE_ORDER)).alias("expires_us"),
        F.bool_or(F.col("verdict") == "released").alias("_released"),
        F.count_if(F.col("verdict") == "renewed").alias("renewals"),
        F.count_if(F.col("verdict") == "rejected").alias("rejected"),
    )
    standing = (
        F.when(F.col("_released"), "released")
        .when(F.lit(now_us) >= F.col("expires_us"), "expired")
        .otherwise("live")
    )
    return last.select("lease_id", "expires_us", "renewals", "rejected", standing.alias("standing"))
