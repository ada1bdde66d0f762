"""The derived entities as SQL, inlined into the oracles that need them."""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {
    "bus_events": """SELECT event_id AS id, event_type AS topic, CAST(user_id AS VARCHAR) AS key,
 CAST(user_id % 4 AS INT) AS "partition",
 row_number() OVER (PARTITION BY event_type, user_id % 4 ORDER BY ts, event_id) AS seq,
 props AS payload, 1 AS schema_version, ts AS created_at,
 CASE WHEN event_id % 5 = 0 THEN 'delivered' WHEN event_id % 23 = 0 THEN 'dead' ELSE 'pending' END AS status,
 CAST(event_id % 7 AS INT) AS attempts_g1 FROM events""",
    "bus_offsets": """SELECT 'g1' AS grp, topic, "partition", CAST(floor(max(seq) / 2) AS BIGINT) AS seq
 FROM bus_events WHERE "partition" < 3 GROUP BY topic, "partition" """,
    "acks": """SELECT e.id AS event_id, e.topic, e."partition", e.seq, 'g' || CAST(e.id % 2 AS VARCHAR) AS grp,
 n.n AS ack_no, e.created_at + n.n * INTERVAL 30 SECOND AS ack_ts,
 (n.n = 1 + e.id % 6 AND e.id % 4 <> 0) AS ok, 'err-' || CAST(e.id % 3 AS VARCHAR) AS error
 FROM bus_events e JOIN range(1, 7) n(n) ON n.n <= 1 + e.id % 6""",
    "compute_nodes": """SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS name, r_name AS tag,
 1000 + 1000 * (s_suppkey % 4) AS capacity_cpu, 2048 * (1 + s_suppkey % 3) AS capacity_mem,
 CASE s_suppkey % 10 WHEN 0 THEN 'cordoned' WHEN 1 THEN 'draining' WHEN 2 THEN 'offline' ELSE 'active' END AS state
 FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "workloads": """SELECT CAST(p_partkey AS VARCHAR) AS id, p_brand AS namespace, p_name AS name,
 50 + 10 * (p_size % 10) AS cpu, 64 + 32 * (p_size % 6) AS memory,
 ['fifo','priority','round_robin','bin_pack'][1 + p_partkey % 4] AS policy,
 CASE WHEN p_partkey % 3 = 0 THEN ['ASIA','EUROPE','AMERICA','AFRICA','MIDDLE EAST'][1 + p_partkey % 5] END AS node_tag,
 CASE WHEN p_partkey % 50 = 0 THEN CAST(1 + p_partkey // 50 AS VARCHAR) END AS pin,
 p_partkey % 40 = 0 AS spread, p_size % 3 AS priority,
 CASE WHEN p_partkey % 17 = 0 THEN 'paused' ELSE 'active' END AS status,
 p_partkey % 4 AS desired_replicas, 0 AS min_replicas, 60 AS max_replicas,
 TIMESTAMP '1995-01-01' + p_partkey * INTERVAL 1 MINUTE AS created_at FROM part""",
    "leases": """SELECT l_partkey || '-' || l_suppkey AS id, CAST(l_partkey AS VARCHAR) AS workload_id,
 CAST(l_suppkey AS VARCHAR) AS node_id, min(l_shipdate) AS created_at,
 max(l_shipdate) + INTERVAL 200 DAY AS expires_at,
 CASE WHEN min(l_returnflag) = 'R' OR l_suppkey % 13 = 5 THEN 'released' ELSE 'active' END AS state
 FROM lineitem GROUP BY l_partkey, l_suppkey""",
    "workflows": """SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS namespace,
 'run-' || o_orderpriority AS name,
 CASE o_orderstatus WHEN 'F' THEN 'running' WHEN 'O' THEN 'pending' ELSE 'running' END AS status,
 o_orderdate AS created_at, CASE WHEN o_orderkey % 3 = 0 THEN 86400.0 * 900 END AS timeout,
 o_orderkey % 11 = 0 AS cancel_requested, o_orderkey % 2 = 0 AS dead_letter FROM orders""",
    "wf_nodes": """SELECT CAST(l_orderkey AS VARCHAR) AS workflow_id, l_linenumber AS node_id,
 CASE WHEN l_linenumber > 1 THEN l_linenumber // 2 END AS dep, CAST(min(l_partkey) AS VARCHAR) AS workload_id,
 CAST(l_linenumber % 4 AS INT) AS retry_max,
 ['succeeded','succeeded','succeeded','pending','pending','dispatched','failed','timed_out','cancelled','succeeded'][1 + CAST(floor(min(l_quantity)) AS INT) % 10] AS status,
 1 + l_linenumber % 3 AS max_concurrency FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "attempts": """SELECT CAST(l_orderkey AS VARCHAR) AS workflow_id, l_linenumber AS node_id,
 row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice) AS attempt_no,
 l_shipdate AS started_at, l_shipdate + CAST(floor(l_quantity) AS INT) * INTERVAL 1 SECOND AS finished_at,
 CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'failed' WHEN 'RO' THEN 'timed_out' WHEN 'NO' THEN 'running' ELSE 'succeeded' END AS status
 FROM lineitem""",
    "requests": """SELECT event_id AS id, ts,
 CASE WHEN event_id % 9 <> 0 THEN user_id || ':' || CAST(floor(value / 20) AS INT) END AS idem_key,
 sha256(event_type) AS digest FROM events""",
    "calls": """SELECT event_id AS id, ts, CAST(user_id % 5 AS VARCHAR) AS name, event_type <> 'error' AS ok FROM events""",
    "status_log": """SELECT CAST(l_orderkey AS VARCHAR) AS record_id,
 row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS step,
 ['pending','dispatched','succeeded','failed','timed_out','cancelled','skipped'][1 + CAST(l_suppkey % 7 AS INT)] AS status
 FROM lineitem""",
    "run_requests": """SELECT CAST(o_orderkey AS VARCHAR) AS workflow_id,
 CASE o_orderkey % 2 WHEN 0 THEN 'cancel' ELSE 'retry' END AS action FROM orders
 UNION ALL SELECT 'missing', 'cancel'""",
    "metric_samples": """SELECT CAST(user_id AS VARCHAR) AS workload_id,
 CASE event_type WHEN 'click' THEN 'cpu' WHEN 'view' THEN 'memory' WHEN 'error' THEN 'queue' ELSE 'throughput' END AS metric,
 ts, event_id AS ord, value FROM events""",
    "heartbeats": """SELECT event_type AS loop, ts FROM events""",
    "audit": """SELECT event_id AS id, ts, CAST(user_id AS VARCHAR) AS actor, event_type AS action, props AS resource FROM events""",
    "ledger_body": """SELECT conv_id AS chain_id, turn AS seq,
 role || ': ' || text AS body FROM conversations""",
    "tasks": """SELECT o_orderkey AS task_id, ['Inspect the repos','Refactoring pass','run TESTS now',
 'latest contest digit','Git commit of work','research the web','open Browser tab','verifying proof','plain chore',
 'send report','undelete row','redeploy unit','delete row','deploy unit','drop it','wipe disk then verify'][1 + o_orderkey % 16]
 || ' for ' || o_orderpriority AS intent, 'A' || (o_orderkey % 6) AS autonomy FROM orders""",
    "resources": """SELECT 'agent://' || s_suppkey AS resource_id, s_suppkey AS ord,
 ['agent','model','model-provider'][1 + s_suppkey % 3] AS kind,
 ['cap://' || ['software/repository/inspect','software/code/refactor','software/testing/execute','software/git/operate','research/web'][1 + s_suppkey % 5],
  'cap://' || ['interaction/browser','verification/save-proof','general/agent/execute'][1 + s_suppkey % 3]] AS capability_ids,
 (s_suppkey % 11) / 10.0 AS trust, (s_suppkey % 7) * 0.5 AS cost_estimate FROM supplier""",
    "schedules": """SELECT c_custkey AS schedule_id, CASE c_custkey % 8
 WHEN 0 THEN (c_custkey % 60) || ' ' || (c_custkey % 24) || ' * * *'
 WHEN 1 THEN '*/15 8 1,15 * *' WHEN 2 THEN '0 0 * * 0' WHEN 3 THEN '0 0 13 * 5'
 WHEN 4 THEN '5-20/5 8 1,15 * *' WHEN 5 THEN '0 0 31 2 *'
 WHEN 6 THEN (c_custkey % 70) || ' 1 * * *'
 ELSE '1 2 3 4' || repeat(' 5', CAST(c_custkey % 3 AS INT)) END AS expr FROM customer""",
}


def with_views(sql: str) -> str:
    """Prefix ``sql`` with the views it names, in dependency order."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if re.search(rf"\b{name}\b", text) and name not in needed:
                visit(VIEWS[name])
                needed.append(name)

    visit(sql)
    if not needed:
        return sql
    heads = ", ".join(f"{n} AS ({VIEWS[n]})" for n in needed)
    body = sql.strip()
    match = re.match(r"(?i)with\s+(recursive\s+)?", body)
    if match:
        recursive = "RECURSIVE " if match.group(1) else ""
        return f"WITH {recursive}{heads}, {body[match.end():]}"
    return f"WITH {heads} {body}"
