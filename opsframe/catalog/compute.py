"""Compute-plane queries; the clock stands at 2002-01-15."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsframe import fixtures as fx
from opsframe.operators import compute as cp
from opsframe.operators import scaling as sc
from opsframe.operators import validate as va
from opsframe.operators.metrics import latest_samples

DUCK_NOW = "TIMESTAMP '2002-01-15'"
# Targets per metric: (target, low, high).
TARGETS = {
    "cpu": (20.0, 0.0, sc.NO_LIMIT),
    "memory": (20.0, 0.0, 40.0),
    "queue": (10.0, 2.0, sc.NO_LIMIT),
    "throughput": (25.0, 0.0, sc.NO_LIMIT),
}


def now():
    return F.lit("2002-01-15").cast("timestamp")


def _loaded(spark, d):
    return cp.node_load(
        fx.compute_nodes(spark, d), fx.workloads(spark, d), fx.leases(spark, d), now()
    )


def node_load(spark, d):
    return _loaded(spark, d).select("id", "leases", "used_cpu", "used_mem")


def node_headroom(spark, d):
    return cp.node_headroom(_loaded(spark, d), 500, 1024).select(
        "id", "free_cpu", "free_mem", "can_host"
    )


def replica_backlog(spark, d):
    backlog = cp.replica_backlog(fx.workloads(spark, d), fx.leases(spark, d), now())
    return cp.by_turn(backlog).drop("created_at")


def eligible_nodes(spark, d):
    placed = cp.placements(fx.workloads(spark, d), _loaded(spark, d))
    return placed.select("id", "eligible")


def rank_placements(spark, d):
    placed = cp.placements(fx.workloads(spark, d), _loaded(spark, d))
    return placed.select("id", "policy", F.coalesce("node_id", F.lit("")).alias("node_id"))


def release_candidates(spark, d):
    leases = cp.release_candidates(
        fx.workloads(spark, d), fx.leases(spark, d), fx.compute_nodes(spark, d), now()
    )
    return leases.select("workload_id", "id", "turn")


def _lease_log(spark, d):
    """Renewals of every lease: most in turn, some stale, some by a stranger."""
    held = fx.leases(spark, d).selectExpr(
        "id as lease_id",
        "unix_micros(created_at) as t0",
        "unix_micros(expires_at) as e0",
        "cast(length(id) as bigint) as k",
        "state",
    )
    day = 86_400_000_000
    return held.select(
        "*", F.explode(F.expr("sequence(1, cast(2 + k % 4 as int))")).alias("n")
    ).selectExpr(
        "lease_id",
        f"t0 + n * {day} as at_us",
        "case when n = 4 and state = 'released' then 'release' else 'renew' end as op",
        "case when n % 3 = 0 then 'other' else concat('n', k) end as nonce",
        f"e0 + case when n = 1 then 0 when n = 2 then {day} when n = 5 then {day} * 3 else {day} * 2 end as old_us",
        f"e0 + n * {day} as new_us",
        "concat('n', k) as granted_nonce",
        "e0 as granted_us",
    )


def lease_lifecycle(spark, d):
    return cp.lease_history(_lease_log(spark, d)).select(
        "lease_id", "at_us", "verdict", "reason", "expires_us"
    )


def lease_states(spark, d):
    return cp.lease_states(cp.lease_history(_lease_log(spark, d)), 1_011_052_800_000_000)


def validate_namespace(spark, d):
    raw = fx.table(spark, d, "customer").selectExpr(
        "c_custkey as id",
        "case c_custkey % 6 when 0 then c_name when 1 then '' when 2 then repeat('n', 65)"
        " when 3 then concat('9', c_mktsegment) when 4 then concat(c_mktsegment, c_custkey)"
        " else 'étage' end as name",
    )
    return va.validate_namespace(raw).select("id", F.array_join("errors", "; ").alias("errors"))


def validate_workload(spark, d):
    raw = fx.table(spark, d, "part").selectExpr(
        "p_partkey as id",
        "case when p_partkey % 31 = 0 then '' else p_name end as name",
        "case when p_partkey % 37 = 0 then null else p_type end as image",
        "case when p_partkey % 3 > 0 then p_partkey % 7 - 1 end as replicas",
        "case when p_partkey % 5 > 0 then p_partkey % 50 end as cpu",
        "cast(null as bigint) as memory",
        "case when p_partkey % 4 = 0 then p_partkey % 3 end as min_replicas",
        "case when p_partkey % 6 = 0 then p_partkey end as max_replicas",
        "element_at(array('FIFO', 'priority', 'best_fit', null), cast(1 + p_partkey % 4 as int)) as policy",
    )
    return va.validate_workload(raw).select(
        "id", "replicas", "cpu", "memory", "min_replicas", "max_replicas", "policy",
        F.array_join("errors", "; ").alias("errors"),
    )


def validate_node(spark, d):
    raw = fx.table(spark, d, "supplier").selectExpr(
        "s_suppkey as id",
        "case when s_suppkey % 9 > 0 then s_name end as name",
        "case when s_suppkey % 2 = 0 then s_suppkey % 8 end as cpu",
        "case when s_suppkey % 7 = 0 then -1L end as memory",
    )
    return va.validate_node(raw).select(
        "id", "cpu", "memory", "state", F.array_join("errors", "; ").alias("errors")
    )


def _scaled_workloads(spark, d):
    """Workloads that report metrics: one per user of the events table."""
    users = fx.table(spark, d, "events").select("user_id").distinct()
    return users.selectExpr(
        "cast(user_id as string) as id", "'active' as status", "1 + user_id % 5 as desired_replicas",
        "user_id % 2 as min_replicas", "10 + user_id % 30 as max_replicas",
    )


def _targets(workloads):
    rows = F.array(
        *[
            F.struct(
                F.lit(m).alias("metric"), F.lit(t).alias("target"),
                F.lit(low).alias("low"), F.lit(high).alias("high"),
            )
            for m, (t, low, high) in TARGETS.items()
        ]
    )
    return workloads.select(F.col("id").alias("workload_id"), F.explode(rows).alias("t")).select(
        "workload_id", "t.*"
    )


def dominant_demand(spark, d):
    workloads = _scaled_workloads(spark, d)
    latest = latest_samples(fx.metric_samples(spark, d))
    return sc.dominant_demand(workloads, _targets(workloads), latest)


def autoscale_decisions(spark, d):
    moves = sc.autoscale_decisions(
        _scaled_workloads(spark, d), fx.metric_samples(spark, d), TARGETS, tick_seconds=60,
        policy=sc.target_policy(cooldown=6 * 3600.0, protect_after=24 * 3600.0),
    )
    return moves.filter("decided").select("workload_id", "tick", "from_replicas", "to_replicas")


def autoscale_custom_policy(spark, d):
    """A caller's own policy: one replica more when the queue is long, else one less."""

    def decide(current, low, high, measured, targets, now, last_action, last_up):
        wanted = current + (1 if measured.get("queue", 0.0) > targets["queue"][0] else -1)
        wanted = min(max(wanted, low), high)
        return None if wanted == current else wanted

    moves = sc.autoscale_decisions(
        _scaled_workloads(spark, d), fx.metric_samples(spark, d), TARGETS, tick_seconds=3600,
        policy=decide,
    )
    return moves.filter("decided").select("workload_id", "tick", "from_replicas", "to_replicas")


_LOAD = f"""load AS (SELECT l.node_id AS id, CAST(count(*) AS BIGINT) AS leases, CAST(sum(w.cpu) AS BIGINT) AS cpu, CAST(sum(w.memory) AS BIGINT) AS mem
 FROM leases l JOIN workloads w ON w.id = l.workload_id
 WHERE l.state = 'active' AND l.expires_at > {DUCK_NOW} AND w.status = 'active' GROUP BY l.node_id),
loaded AS (SELECT n.*, coalesce(o.leases, 0) AS leases, coalesce(o.cpu, 0) AS used_cpu, coalesce(o.mem, 0) AS used_mem
 FROM compute_nodes n LEFT JOIN load o ON o.id = n.id)"""
_BACKLOG = f"""backlog AS (SELECT w.id, w.priority, coalesce(l.n, 0) AS live, w.desired_replicas AS desired FROM workloads w
 LEFT JOIN (SELECT workload_id, count(*) AS n FROM leases WHERE state = 'active' AND expires_at > {DUCK_NOW} GROUP BY 1) l
 ON l.workload_id = w.id WHERE w.status = 'active')"""
_PAIRS = f"""{_LOAD}, pairs AS (SELECT w.id, w.policy, n.id AS node_id, row_number() OVER (PARTITION BY w.id ORDER BY
 CASE w.policy WHEN 'bin_pack' THEN -(n.capacity_cpu - n.used_cpu) WHEN 'round_robin' THEN n.leases ELSE n.used_cpu END, n.id) AS place
 FROM workloads w JOIN loaded n ON n.state = 'active' AND w.status = 'active' AND (w.pin IS NULL OR w.pin = n.id)
 AND (w.node_tag IS NULL OR w.node_tag = n.tag) AND n.capacity_cpu - n.used_cpu >= w.cpu
 AND n.capacity_mem - n.used_mem >= w.memory AND NOT (w.spread AND n.leases > 0))"""
_TICKS = """wl AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS id, 1 + user_id % 5 AS cur, user_id % 2 AS lo, 10 + user_id % 30 AS hi FROM events),
tk AS (SELECT workload_id, CAST(floor(epoch_us(ts) / {width}) AS BIGINT) + 1 AS tick, metric, arg_max(value, (ts, ord)) AS value
 FROM metric_samples GROUP BY ALL),
wide AS (SELECT workload_id, tick, max(CASE metric WHEN 'cpu' THEN value END) AS c, max(CASE metric WHEN 'memory' THEN value END) AS m,
 max(CASE metric WHEN 'queue' THEN value END) AS q, max(CASE metric WHEN 'throughput' THEN value END) AS t FROM tk GROUP BY ALL),
filled AS MATERIALIZED (SELECT workload_id, tick, row_number() OVER w AS n, last_value(c IGNORE NULLS) OVER w AS c,
 last_value(m IGNORE NULLS) OVER w AS m, last_value(q IGNORE NULLS) OVER w AS q, last_value(t IGNORE NULLS) OVER w AS t
 FROM wide WINDOW w AS (PARTITION BY workload_id ORDER BY tick ROWS UNBOUNDED PRECEDING))"""

QUERIES = {
    "node_load": node_load,
    "node_headroom": node_headroom,
    "replica_backlog": replica_backlog,
    "eligible_nodes": eligible_nodes,
    "rank_placements": rank_placements,
    "release_candidates": release_candidates,
    "lease_lifecycle": lease_lifecycle,
    "lease_states": lease_states,
    "validate_namespace": validate_namespace,
    "validate_workload": validate_workload,
    "validate_node": validate_node,
    "dominant_demand": dominant_demand,
    "autoscale_decisions": autoscale_decisions,
    "scaler_policy": autoscale_custom_policy,
}

_LEASE_WALK = """WITH RECURSIVE h AS (SELECT id AS lease_id, epoch_us(created_at) AS t0, epoch_us(expires_at) AS e0,
 CAST(length(id) AS BIGINT) AS k, state FROM leases),
log AS MATERIALIZED (SELECT lease_id, n, t0 + n * 86400000000 AS at_us, CASE WHEN n = 4 AND state = 'released' THEN 'release' ELSE 'renew' END AS op,
 n % 3 <> 0 AS mine, e0 + CASE n WHEN 1 THEN 0 WHEN 2 THEN 86400000000 WHEN 5 THEN 86400000000 * 3 ELSE 86400000000 * 2 END AS old_us,
 e0 + n * 86400000000 AS new_us, e0 FROM h JOIN range(1, 6) r(n) ON n <= 2 + k % 4),
walk AS (SELECT lease_id, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS at_us, '' AS verdict, '' AS reason, e0 AS expires_us, false AS gone FROM h
 UNION ALL SELECT w.lease_id, l.n, l.at_us,
  CASE WHEN w.gone THEN 'rejected' WHEN l.op = 'release' THEN 'released' WHEN l.mine AND l.old_us = w.expires_us THEN 'renewed' ELSE 'rejected' END,
  CASE WHEN w.gone THEN 'illegal: released' WHEN l.op = 'release' THEN '' WHEN NOT l.mine THEN 'nonce mismatch'
   WHEN l.old_us <> w.expires_us THEN 'stale expires_at' ELSE '' END,
  CASE WHEN NOT w.gone AND l.op = 'renew' AND l.mine AND l.old_us = w.expires_us THEN l.new_us ELSE w.expires_us END,
  w.gone OR l.op = 'release' FROM walk w JOIN log l ON l.lease_id = w.lease_id AND l.n = w.n + 1)"""

ORACLES = {
    "node_load": f"WITH {_LOAD} SELECT id, leases, used_cpu, used_mem FROM loaded",
    "node_headroom": f"""WITH {_LOAD} SELECT id, capacity_cpu - used_cpu AS free_cpu, capacity_mem - used_mem AS free_mem,
 state = 'active' AND capacity_cpu - used_cpu >= 500 AND capacity_mem - used_mem >= 1024 AS can_host FROM loaded""",
    "replica_backlog": f"""WITH {_BACKLOG} SELECT id, CAST(priority AS BIGINT) AS priority, live, desired, CAST(greatest(desired - live, 0) AS BIGINT) AS deficit,
 CAST(greatest(live - desired, 0) AS BIGINT) AS surplus FROM backlog""",
    "eligible_nodes": f"""WITH {_PAIRS} SELECT w.id, count(p.node_id) AS eligible FROM workloads w LEFT JOIN pairs p ON p.id = w.id
 WHERE w.status = 'active' GROUP BY w.id""",
    "rank_placements": f"""WITH {_PAIRS} SELECT w.id, w.policy, coalesce(p.node_id, '') AS node_id FROM workloads w
 LEFT JOIN pairs p ON p.id = w.id AND p.place = 1 WHERE w.status = 'active'""",
    "release_candidates": f"""WITH {_BACKLOG}, turns AS (SELECT l.workload_id, l.id, row_number() OVER (PARTITION BY l.workload_id
 ORDER BY CASE n.state WHEN 'draining' THEN 0 ELSE 1 END, l.created_at, l.id) AS turn FROM leases l
 LEFT JOIN compute_nodes n ON n.id = l.node_id WHERE l.state = 'active' AND l.expires_at > {DUCK_NOW})
SELECT t.* FROM turns t JOIN backlog b ON b.id = t.workload_id WHERE t.turn <= b.live - b.desired""",
    "lease_lifecycle": f"{_LEASE_WALK} SELECT lease_id, at_us, verdict, reason, expires_us FROM walk WHERE n > 0",
    "lease_states": f"""{_LEASE_WALK} SELECT lease_id, arg_max(expires_us, n) AS expires_us, count(*) FILTER (verdict = 'renewed') AS renewals,
 count(*) FILTER (verdict = 'rejected') AS rejected, CASE WHEN bool_or(gone) THEN 'released'
 WHEN 1011052800000000 >= arg_max(expires_us, n) THEN 'expired' ELSE 'live' END AS standing FROM walk WHERE n > 0 GROUP BY lease_id""",
    "validate_namespace": """SELECT c_custkey AS id, CASE c_custkey % 6 WHEN 0 THEN 'namespace must be alnum, starting with a letter'
 WHEN 1 THEN 'namespace name must be 1-64 chars; namespace must be alnum, starting with a letter' WHEN 2 THEN 'namespace name must be 1-64 chars'
 WHEN 3 THEN 'namespace must be alnum, starting with a letter' ELSE '' END AS errors FROM customer""",
    "validate_workload": """WITH raw AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 > 0 THEN p_partkey % 7 - 1 ELSE 1 END AS replicas,
 CASE WHEN p_partkey % 5 > 0 THEN p_partkey % 50 ELSE 100 END AS cpu, CAST(128 AS BIGINT) AS memory,
 CASE WHEN p_partkey % 4 = 0 THEN p_partkey % 3 ELSE 0 END AS min_replicas,
 ['fifo','priority','best_fit','bin_pack'][1 + p_partkey % 4] AS policy FROM part),
full_rows AS (SELECT *, CASE WHEN id % 6 = 0 THEN id ELSE greatest(1, replicas * 4) END AS max_replicas FROM raw)
SELECT id, replicas, cpu, memory, min_replicas, max_replicas, policy, array_to_string(list_filter([
 CASE WHEN id % 31 = 0 THEN 'workload name is required (1-128 chars)' END, CASE WHEN id % 37 = 0 THEN 'image is required' END,
 CASE WHEN replicas < 0 THEN 'replicas must be >= 0' END, CASE WHEN cpu <= 0 THEN 'cpu/memory must be > 0' END,
 CASE WHEN NOT (0 <= min_replicas AND min_replicas <= replicas AND replicas <= max_replicas AND max_replicas < 10000) THEN 'min <= replicas <= max' END,
 CASE WHEN policy = 'best_fit' THEN 'policy must be one of: fifo, priority, round_robin, bin_pack' END], lambda x: x IS NOT NULL), '; ') AS errors
 FROM full_rows""",
    "validate_node": """WITH raw AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey % 8 ELSE 1000 END AS cpu,
 CAST(CASE WHEN s_suppkey % 7 = 0 THEN -1 ELSE 2048 END AS BIGINT) AS memory FROM supplier)
SELECT id, cpu, memory, 'active' AS state, array_to_string(list_filter([CASE WHEN id % 9 = 0 THEN 'node name is required' END,
 CASE WHEN cpu <= 0 OR memory <= 0 THEN 'node cpu/memory must be > 0' END], lambda x: x IS NOT NULL), '; ') AS errors FROM raw""",
    "dominant_demand": """WITH wl AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS id, 1 + user_id % 5 AS cur, user_id % 2 AS lo, 10 + user_id % 30 AS hi FROM events),
l AS (SELECT workload_id, metric, arg_max(value, (ts, ord)) AS value FROM metric_samples GROUP BY ALL),
c AS (SELECT wl.id, wl.cur, lo, hi, max(CASE metric WHEN 'cpu' THEN ceil(cur * value / 20.0) WHEN 'memory' THEN least(ceil(cur * value / 20.0), 40)
 WHEN 'queue' THEN greatest(ceil(cur * value / 10.0), 2) ELSE ceil(cur * value / 25.0) END) AS most FROM wl JOIN l ON l.workload_id = wl.id GROUP BY ALL)
SELECT id, cur AS desired_replicas, CAST(least(greatest(most, lo), hi) AS BIGINT) AS demand FROM c""",
    "autoscale_decisions": f"""WITH RECURSIVE {_TICKS.format(width=60000000)},
walk AS (SELECT id, cur, lo, hi, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS tick, false AS moved, cur AS prev, CAST(0 AS BIGINT) AS act, CAST(0 AS BIGINT) AS up FROM wl
 UNION ALL SELECT id, CASE WHEN moved2 THEN want ELSE cur END, lo, hi, n2, tick2, moved2, cur,
  CASE WHEN moved2 THEN tick2 * 60 ELSE act END, CASE WHEN moved2 AND want > cur THEN tick2 * 60 ELSE up END
 FROM (SELECT *, want <> cur AND abs(want - cur) > 0.10 * greatest(1.0, cur) AND tick2 * 60 - act >= 21600
   AND NOT (want <= cur AND up <> 0 AND tick2 * 60 - up < 86400) AS moved2
  FROM (SELECT w.*, f.n AS n2, f.tick AS tick2, CAST(least(greatest(greatest(coalesce(ceil(w.cur * f.c / 20.0), -1),
   coalesce(CASE WHEN f.m IS NOT NULL THEN least(ceil(w.cur * f.m / 20.0), 40) END, -1), coalesce(CASE WHEN f.q IS NOT NULL THEN greatest(ceil(w.cur * f.q / 10.0), 2) END, -1), coalesce(ceil(w.cur * f.t / 25.0), -1)), w.lo), w.hi) AS BIGINT) AS want
   FROM walk w JOIN filled f ON f.workload_id = w.id AND f.n = w.n + 1) a) b)
SELECT id AS workload_id, tick, prev AS from_replicas, cur AS to_replicas FROM walk WHERE moved""",
    "scaler_policy": f"""WITH RECURSIVE {_TICKS.format(width=3600000000)},
walk AS (SELECT id, cur, lo, hi, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS tick, cur AS prev FROM wl
 UNION ALL SELECT w.id, least(greatest(w.cur + CASE WHEN coalesce(f.q, 0) > 10 THEN 1 ELSE -1 END, w.lo), w.hi), w.lo, w.hi, f.n, f.tick, w.cur
 FROM walk w JOIN filled f ON f.workload_id = w.id AND f.n = w.n + 1)
SELECT id AS workload_id, tick, prev AS from_replicas, cur AS to_replicas FROM walk WHERE prev <> cur""",
}
