"""Workflow-plane queries; the clock stands at 2000-01-01."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsframe import fixtures as fx
from opsframe.functions.timing import backoff_seconds
from opsframe.operators import events as ev
from opsframe.operators import validate as va
from opsframe.operators import workflow as wf
from opsframe.operators.metrics import histogram_buckets

DUCK_NOW = "TIMESTAMP '2000-01-01'"


def now():
    return F.lit("2000-01-01").cast("timestamp")


def dangling_dependencies(spark, d):
    return wf.dangling_dependencies(fx.wf_nodes(spark, d))


def _raw_nodes(spark, d):
    """Node rows before the duplicate check: one per line item."""
    return fx.table(spark, d, "lineitem").selectExpr(
        "cast(l_orderkey as string) as workflow_id", "l_linenumber as node_id"
    )


def duplicate_ids(spark, d):
    return wf.duplicate_ids(_raw_nodes(spark, d))


def _graph(spark, d):
    """Every 50th workflow's first node also waits for its third: a cycle."""
    nodes = fx.wf_nodes(spark, d).select("workflow_id", "node_id", "depends_on")
    loop = (F.col("node_id") == 1) & (F.col("workflow_id").cast("bigint") % 50 == 0)
    return nodes.withColumn(
        "depends_on", F.when(loop, F.array(F.lit(3))).otherwise(F.col("depends_on"))
    )


def dag_levels(spark, d):
    return wf.dag_levels(_graph(spark, d))


def cyclic_workflows(spark, d):
    return wf.cyclic_workflows(_graph(spark, d))


def illegal_transitions(spark, d):
    moves = wf.illegal_transitions(fx.status_log(spark, d), fx.STATUS_LOG_ORDER)
    return moves.groupBy("record_id", "from_status", "to_status").agg(F.count("*").alias("moves"))


def ready_nodes(spark, d):
    return wf.ready_nodes(fx.wf_nodes(spark, d)).select(
        "workflow_id", "node_id", "decision", "reason"
    )


def ready_nodes_of_open_runs(spark, d):
    return wf.ready_nodes(
        fx.wf_nodes(spark, d), fx.workflows(spark, d), propagate_skips=True
    ).select("workflow_id", "node_id", "decision", "reason")


def dispatch_guard(spark, d):
    waiting = fx.wf_nodes(spark, d).filter("status = 'pending'")
    return wf.dispatch_guard(waiting, fx.attempts(spark, d)).select("workflow_id", "node_id")


def _ready(spark, d, nodes):
    return wf.ready_nodes(nodes).filter("decision = 'ready'")


def concurrency_admission(spark, d):
    nodes = fx.wf_nodes(spark, d)
    admitted = wf.concurrency_admission(_ready(spark, d, nodes), nodes)
    return admitted.select("workflow_id", "node_id", "active", "admitted")


def pick_slot(spark, d):
    nodes = fx.wf_nodes(spark, d)
    slots = wf.pick_slot(_ready(spark, d, nodes), fx.leases(spark, d), now())
    return slots.select(
        "workflow_id", "node_id", F.coalesce("lease_id", F.lit("")).alias("lease_id"), "dispatched"
    )


def backoff_schedule(spark, d):
    lost = fx.attempts(spark, d).filter("status in ('failed', 'timed_out')")
    return lost.select(
        "workflow_id",
        "node_id",
        "attempt_no",
        backoff_seconds(F.col("attempt_no"), 2.0, 60.0, 0.0).alias("delay"),
    )


def _attempts_with_errors(spark, d):
    """Attempts of which every other one already says what went wrong."""
    told = F.expr("case when attempt_no % 2 = 1 and status in ('failed', 'timed_out') then concat('was ', node_id) end")
    return fx.attempts(spark, d).withColumn("error", told)


def fold_attempts(spark, d):
    states = wf.fold_attempts(fx.wf_nodes(spark, d), _attempts_with_errors(spark, d))
    return states.select(
        "workflow_id", "node_id", "attempts", "status", "error",
        F.coalesce(F.unix_micros("next_retry_at"), F.lit(-1)).alias("next_retry_us"),
        F.coalesce(F.unix_micros("finished_at"), F.lit(-1)).alias("finished_us"),
    )


def _reports(spark, d):
    """Two conflicting reports for every attempt; the first one is to count."""
    first = fx.attempts(spark, d).selectExpr(
        "workflow_id", "node_id", "attempt_no", "attempt_no % 2 = 0 as ok",
        "attempt_no % 3 = 0 as timed_out", "concat('e', attempt_no) as error", "finished_at as at",
    )
    second = first.withColumn("ok", ~F.col("ok")).withColumn(
        "at", F.timestamp_micros(F.unix_micros("at") + 1)
    )
    return first.unionByName(second)


def complete_attempts(spark, d):
    done = wf.complete_attempts(_attempts_with_errors(spark, d), _reports(spark, d), fx.workflows(spark, d))
    return done.select(
        "workflow_id", "node_id", "attempt_no", "status", F.coalesce("error", F.lit("")).alias("error")
    )


def workflow_outcome(spark, d):
    return wf.workflow_outcome(fx.workflows(spark, d), fx.wf_nodes(spark, d))


def outcome_events(spark, d):
    return wf.outcome_events(workflow_outcome(spark, d)).drop("schema_version")


def outcome_log(spark, d):
    """Finished-run messages appended to the log with their sequence numbers."""
    messages = wf.outcome_events(workflow_outcome(spark, d)).withColumn(
        "partition", F.expr("cast(cast(key as bigint) % 4 as int)")
    )
    return ev.assign_sequence(messages, order=["key"]).select("topic", "partition", "key", "seq")


def node_latency_histogram(spark, d):
    done = fx.attempts(spark, d).filter("status = 'succeeded'")
    seconds = (F.unix_micros("finished_at") - F.unix_micros("started_at")) / 1_000_000
    samples = done.select(
        F.lit("workflow.node_latency").alias("name"), F.greatest(seconds, F.lit(0.0)).alias("value")
    )
    return histogram_buckets(samples, bounds=[1.0, 5.0, 10.0, 25.0, 50.0])


def timed_out_runs(spark, d):
    return wf.timed_out_runs(fx.workflows(spark, d), now()).select("id")


def _limited_nodes(spark, d):
    return fx.wf_nodes(spark, d).withColumn(
        "timeout", F.when(F.col("node_id") % 2 == 0, F.lit(3600.0) * F.col("node_id"))
    )


def sweep_timeouts(spark, d):
    nodes, attempts = _limited_nodes(spark, d), fx.attempts(spark, d)
    late = wf.timed_out_attempts(attempts, nodes, now(), fx.workflows(spark, d)).selectExpr(
        "workflow_id", "node_id", "attempt_no", "'attempt' as what", "'node_timeout' as reason"
    )
    skipped, stopped = wf.time_out_runs(fx.workflows(spark, d), nodes, attempts, now())
    skipped = skipped.selectExpr(
        "workflow_id", "node_id", "0L as attempt_no", "'node' as what", "error as reason"
    )
    stopped = stopped.selectExpr(
        "workflow_id", "node_id", "attempt_no", "'attempt' as what", "error as reason"
    )
    return late.unionByName(skipped).unionByName(stopped)


def _cancels(spark, d):
    return fx.run_requests(spark, d).filter("action = 'cancel'").select("workflow_id")


def _finished_some(spark, d):
    """Workflows of which every 26th already failed."""
    return fx.workflows(spark, d).withColumn(
        "status", F.when(F.col("id").cast("bigint") % 52 == 0, "failed").otherwise(F.col("status"))
    )


def classify_cancels(spark, d):
    return wf.classify_cancels(_cancels(spark, d), _finished_some(spark, d))


def cancel_runs(spark, d):
    nodes, attempts = wf.cancel_runs(
        _cancels(spark, d), _finished_some(spark, d), fx.wf_nodes(spark, d), fx.attempts(spark, d)
    )
    nodes = nodes.selectExpr("workflow_id", "node_id", "0L as attempt_no", "status")
    return nodes.unionByName(attempts.select("workflow_id", "node_id", "attempt_no", "status"))


def retry_nodes(spark, d):
    asked = fx.run_requests(spark, d).selectExpr(
        "workflow_id", "cast(1 + length(workflow_id) % 5 as int) as node_id"
    )
    verdicts = wf.retry_nodes(asked, fx.workflows(spark, d), fx.wf_nodes(spark, d))
    return verdicts.select(
        "workflow_id", "node_id", "verdict",
        F.coalesce("node_status", F.lit("")).alias("node_status"),
        F.coalesce("run_status", F.lit("")).alias("run_status"),
    )


def recover_orphans(spark, d):
    recovered = wf.recover_orphans(_attempts_with_errors(spark, d), now(), fx.workflows(spark, d))
    states = wf.fold_attempts(fx.wf_nodes(spark, d), recovered)
    return states.select("workflow_id", "node_id", "attempts", "status", "error")


def clone_runs(spark, d):
    templates = fx.workflows(spark, d)
    fires = fx.table(spark, d, "orders").selectExpr(
        "cast(o_orderkey as string) as template_id", "o_orderdate as fire_at"
    )
    runs, nodes = wf.clone_runs(templates, fx.wf_nodes(spark, d), fires)
    counts = nodes.groupBy(F.col("workflow_id").alias("id")).agg(
        F.count("*").alias("nodes"), F.count_if(F.col("status") == "pending").alias("pending")
    )
    return runs.join(counts, "id", "left").select(
        "id", "template_id", "status", "epoch",
        F.coalesce("nodes", F.lit(0)).alias("nodes"), F.coalesce("pending", F.lit(0)).alias("pending"),
    )


def validate_workflow_node(spark, d):
    raw = fx.table(spark, d, "lineitem").selectExpr(
        "cast(l_orderkey as string) as workflow_id",
        "cast(l_linenumber as string) as id",
        "case when l_suppkey % 19 = 0 then '' end as name",
        "case when l_suppkey % 7 = 0 then array(cast(l_linenumber as string))"
        " when l_linenumber > 1 then array(cast(l_linenumber - 1 as string)) end as depends_on",
        "case when l_partkey % 3 = 0 then cast(l_partkey as string) end as workload_id",
        "case when l_partkey % 11 = 0 then 'topic' else '' end as event_topic",
        "named_struct('workload_id', case when l_partkey % 3 = 1 then 'w' end,"
        " 'topic', case when l_partkey % 3 = 2 then 't' end) as exec",
        "named_struct('max', case when l_quantity > 10 then cast(l_quantity * 3 as int) end,"
        " 'base_seconds', cast(null as double), 'max_seconds', cast(null as double),"
        " 'jitter', cast(null as double)) as retry",
        "case when l_linenumber % 2 = 0 then 0.0D else 5.0D end as timeout",
        "cast(null as int) as max_concurrency",
    )
    checked = va.validate_workflow_node(raw)
    return checked.groupBy(
        "workflow_id", "id", F.array_join("errors", "; ").alias("errors"), "retry_max", "max_concurrency"
    ).agg(F.count("*").alias("rows"))


def validate_workflow(spark, d):
    defs = fx.table(spark, d, "orders").selectExpr(
        "cast(o_orderkey as string) as id",
        "case when o_orderkey % 23 = 0 then '' else o_orderpriority end as name",
        "case when o_orderkey % 29 = 0 then -1.0D when o_orderkey % 2 = 0 then 0.0D end as timeout",
        "case when o_orderkey % 5 = 0 then false end as dead_letter",
    )
    graph = _graph(spark, d)
    extra = graph.filter("node_id = 2 and cast(workflow_id as bigint) % 17 = 0")
    return va.validate_workflow(defs, graph.unionByName(extra)).select(
        "workflow_id", F.array_join("errors", "; ").alias("errors"), "dead_letter"
    )


_GRAPH = """graph AS (SELECT workflow_id, node_id,
 CASE WHEN node_id = 1 AND CAST(workflow_id AS BIGINT) % 50 = 0 THEN 3 ELSE dep END AS dep FROM wf_nodes),
lv AS (SELECT workflow_id, node_id, CAST(0 AS BIGINT) AS level FROM graph WHERE dep IS NULL
 UNION ALL SELECT g.workflow_id, g.node_id, lv.level + 1 FROM lv JOIN graph g ON g.workflow_id = lv.workflow_id AND g.dep = lv.node_id),
levels AS (SELECT g.workflow_id, g.node_id, coalesce(lv.level, -1) AS level FROM graph g
 LEFT JOIN lv ON lv.workflow_id = g.workflow_id AND lv.node_id = g.node_id)"""

_READY = """SELECT n.workflow_id, n.node_id, n.max_concurrency, n.workload_id,
 CASE WHEN p.status IN ({bad}) OR p.status = 'cancelled' THEN 'skip'
  WHEN n.dep IS NULL OR p.status = 'succeeded' THEN 'ready' ELSE 'wait' END AS decision,
 CASE WHEN p.status IN ({bad}) THEN 'dependency failed' WHEN p.status = 'cancelled' THEN 'dependency cancelled' ELSE '' END AS reason
 FROM wf_nodes n LEFT JOIN wf_nodes p ON p.workflow_id = n.workflow_id AND p.node_id = n.dep WHERE n.status = 'pending'"""
_READY1 = _READY.format(bad="'failed','timed_out'")
_READY2 = _READY.format(bad="'failed','timed_out','skipped'")

_FOLD = """SELECT n.workflow_id, n.node_id, a.attempt_no AS attempts,
 CASE WHEN a.status IN ('failed','timed_out') AND a.attempt_no <= n.retry_max THEN 'pending'
  WHEN a.status = 'running' THEN 'dispatched' ELSE a.status END AS status,
 CASE WHEN a.status IN ('failed','timed_out') AND a.error <> '' THEN a.error
  WHEN a.status = 'timed_out' THEN 'node timed out' WHEN a.status = 'failed' THEN 'attempt failed'
  WHEN a.status = 'cancelled' THEN 'cancelled' ELSE '' END AS error,
 CASE WHEN a.status IN ('failed','timed_out') AND a.attempt_no <= n.retry_max
  THEN epoch_us(a.finished_at) + CAST(least(60, 2 ** (a.attempt_no - 1)) * 1000000 AS BIGINT) ELSE -1 END AS next_retry_us,
 CASE WHEN a.status = 'succeeded' OR (a.status IN ('failed','timed_out') AND a.attempt_no > n.retry_max)
  OR a.status = 'cancelled' THEN epoch_us(a.finished_at) ELSE -1 END AS finished_us
 FROM wf_nodes n JOIN {attempts} a ON a.workflow_id = n.workflow_id AND a.node_id = n.node_id
 QUALIFY row_number() OVER (PARTITION BY n.workflow_id, n.node_id ORDER BY a.attempt_no DESC) = 1"""

_TOLD = """(SELECT *, CASE WHEN attempt_no % 2 = 1 AND status IN ('failed','timed_out') THEN 'was ' || node_id END AS error FROM attempts)"""

_OUTCOME = """SELECT w.id, w.name, w.namespace, CASE WHEN NOT bool_and(n.status IN ('succeeded','failed','timed_out','cancelled','skipped')) THEN 'open'
 WHEN w.cancel_requested OR bool_or(n.status = 'cancelled') THEN 'cancelled' WHEN bool_or(n.status = 'timed_out') THEN 'timed_out'
 WHEN bool_or(n.status = 'failed') THEN 'failed' WHEN bool_and(n.status = 'succeeded') THEN 'succeeded' ELSE 'open' END AS outcome,
 w.dead_letter, count(*) AS nodes FROM workflows w JOIN wf_nodes n ON n.workflow_id = w.id
 GROUP BY w.id, w.name, w.namespace, w.cancel_requested, w.dead_letter"""

_FINISHED = "SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderkey % 52 = 0 AS over FROM orders"

QUERIES = {
    "dangling_dependencies": dangling_dependencies,
    "duplicate_ids": duplicate_ids,
    "dag_levels": dag_levels,
    "dag_cycles": cyclic_workflows,
    "illegal_transitions": illegal_transitions,
    "ready_nodes": ready_nodes,
    "ready_nodes_open_runs": ready_nodes_of_open_runs,
    "dispatch_guard": dispatch_guard,
    "concurrency_admission": concurrency_admission,
    "pick_slot": pick_slot,
    "backoff_schedule": backoff_schedule,
    "fold_attempts": fold_attempts,
    "complete_attempts": complete_attempts,
    "workflow_outcome": workflow_outcome,
    "outcome_events": outcome_events,
    "outcome_log": outcome_log,
    "node_latency_histogram": node_latency_histogram,
    "timed_out_runs": timed_out_runs,
    "sweep_timeouts": sweep_timeouts,
    "classify_cancels": classify_cancels,
    "cancel_runs": cancel_runs,
    "retry_nodes": retry_nodes,
    "recover_orphans": recover_orphans,
    "clone_runs": clone_runs,
    "validate_workflow_node": validate_workflow_node,
    "validate_workflow": validate_workflow,
}

ORACLES = {
    "dangling_dependencies": """SELECT n.workflow_id, n.node_id, CAST(n.dep AS INT) AS dep FROM wf_nodes n WHERE n.dep IS NOT NULL
 AND NOT EXISTS (SELECT 1 FROM wf_nodes p WHERE p.workflow_id = n.workflow_id AND p.node_id = n.dep)""",
    "duplicate_ids": """SELECT CAST(l_orderkey AS VARCHAR) AS workflow_id, l_linenumber AS node_id, count(*) AS copies
 FROM lineitem GROUP BY ALL HAVING count(*) > 1""",
    "dag_levels": f"WITH RECURSIVE {_GRAPH} SELECT * FROM levels",
    "dag_cycles": f"WITH RECURSIVE {_GRAPH} SELECT workflow_id, count(*) AS stuck FROM levels WHERE level < 0 GROUP BY ALL",
    "illegal_transitions": """WITH moves AS (SELECT record_id, lag(status) OVER (PARTITION BY record_id ORDER BY step) AS from_status,
 status AS to_status FROM status_log)
SELECT record_id, from_status, to_status, count(*) AS moves FROM moves WHERE from_status IS NOT NULL
 AND NOT coalesce(CASE from_status WHEN 'pending' THEN to_status IN ('dispatched','skipped','cancelled')
 WHEN 'dispatched' THEN to_status IN ('running','succeeded','failed','timed_out','cancelled','skipped','pending')
 WHEN 'running' THEN to_status IN ('succeeded','failed','timed_out','cancelled','skipped')
 WHEN 'failed' THEN to_status = 'pending' WHEN 'timed_out' THEN to_status = 'pending' END, false) GROUP BY ALL""",
    "ready_nodes": f"SELECT workflow_id, node_id, decision, reason FROM ({_READY1})",
    "ready_nodes_open_runs": f"""SELECT r.workflow_id, r.node_id, decision, reason FROM ({_READY2}) r
 JOIN workflows w ON w.id = r.workflow_id WHERE w.status IN ('pending','running') AND NOT w.cancel_requested""",
    "dispatch_guard": """SELECT workflow_id, node_id FROM wf_nodes n WHERE status = 'pending' AND NOT EXISTS
 (SELECT 1 FROM attempts a WHERE a.workflow_id = n.workflow_id AND a.node_id = n.node_id AND a.status = 'running')""",
    "concurrency_admission": f"""WITH RECURSIVE busy AS (SELECT workflow_id, count(*) AS active FROM wf_nodes
 WHERE status IN ('dispatched','running') GROUP BY workflow_id),
r AS MATERIALIZED (SELECT x.workflow_id, x.node_id, x.max_concurrency, coalesce(b.active, 0) AS active,
 row_number() OVER (PARTITION BY x.workflow_id ORDER BY x.node_id) AS n
 FROM ({_READY1}) x LEFT JOIN busy b ON b.workflow_id = x.workflow_id WHERE x.decision = 'ready'),
walk AS (SELECT workflow_id, node_id, active, n, active < max_concurrency AS admitted,
 active + CASE WHEN active < max_concurrency THEN 1 ELSE 0 END AS used FROM r WHERE n = 1
 UNION ALL SELECT r.workflow_id, r.node_id, r.active, r.n, w.used < r.max_concurrency,
 w.used + CASE WHEN w.used < r.max_concurrency THEN 1 ELSE 0 END FROM walk w JOIN r ON r.workflow_id = w.workflow_id AND r.n = w.n + 1)
SELECT workflow_id, node_id, active, admitted FROM walk""",
    "pick_slot": f"""WITH slot AS (SELECT workload_id, id FROM leases WHERE state = 'active' AND expires_at > {DUCK_NOW}
 QUALIFY row_number() OVER (PARTITION BY workload_id ORDER BY created_at, id) = 1)
SELECT r.workflow_id, r.node_id, coalesce(s.id, '') AS lease_id, s.id IS NOT NULL AS dispatched
 FROM ({_READY1}) r LEFT JOIN slot s ON s.workload_id = r.workload_id WHERE r.decision = 'ready'""",
    "backoff_schedule": """SELECT workflow_id, node_id, attempt_no, CAST(least(60.0, 2.0 * 2 ** (attempt_no - 1)) AS DOUBLE) AS delay
 FROM attempts WHERE status IN ('failed','timed_out')""",
    "fold_attempts": _FOLD.format(attempts=_TOLD),
    "complete_attempts": """SELECT a.workflow_id, a.node_id, a.attempt_no,
 CASE WHEN a.status <> 'running' THEN a.status WHEN coalesce(w.cancel_requested, false) THEN 'cancelled'
  WHEN a.attempt_no % 3 = 0 THEN 'timed_out' WHEN a.attempt_no % 2 = 0 THEN 'succeeded' ELSE 'failed' END AS status,
 CASE WHEN a.status = 'running' THEN 'e' || a.attempt_no ELSE coalesce(a.error, '') END AS error
 FROM """ + _TOLD + """ a LEFT JOIN workflows w ON w.id = a.workflow_id""",
    "workflow_outcome": f"""SELECT id, name, namespace, outcome, outcome = 'failed' AND dead_letter AS dead_lettered, nodes FROM ({_OUTCOME})""",
    "outcome_events": f"""SELECT 'workflow.finished' AS topic, id AS key, '{{"workflow_id":"' || id || '","name":"' || name || '","namespace":"' || namespace
 || '","outcome":"' || outcome || '","nodes":' || nodes || '}}' AS payload FROM ({_OUTCOME}) WHERE outcome <> 'open'""",
    "outcome_log": f"""SELECT 'workflow.finished' AS topic, CAST(CAST(id AS BIGINT) % 4 AS INT) AS "partition", id AS key,
 row_number() OVER (PARTITION BY CAST(id AS BIGINT) % 4 ORDER BY id) AS seq FROM ({_OUTCOME}) WHERE outcome <> 'open'""",
    "node_latency_histogram": """WITH s AS (SELECT epoch_us(finished_at - started_at) / 1000000 AS value FROM attempts WHERE status = 'succeeded')
SELECT 'workflow.node_latency' AS name, CAST(le AS DOUBLE) AS le, count(*) FILTER (value <= le) AS bucket_count, count(*) AS "count",
 CAST(sum(value) AS DOUBLE) AS "sum" FROM s, (SELECT unnest([1, 5, 10, 25, 50]) AS le) GROUP BY le""",
    "timed_out_runs": f"""SELECT id FROM workflows WHERE status IN ('pending','running')
 AND {DUCK_NOW} > created_at + CAST(timeout AS INT) * INTERVAL 1 SECOND""",
    "sweep_timeouts": f"""WITH over AS (SELECT id FROM workflows WHERE status IN ('pending','running')
 AND {DUCK_NOW} > created_at + CAST(timeout AS INT) * INTERVAL 1 SECOND)
SELECT a.workflow_id, a.node_id, a.attempt_no, 'attempt' AS what, 'node_timeout' AS reason FROM attempts a
 JOIN wf_nodes n ON n.workflow_id = a.workflow_id AND n.node_id = a.node_id
 WHERE a.status = 'running' AND a.workflow_id NOT IN (SELECT id FROM over) AND n.node_id % 2 = 0 AND {DUCK_NOW} > a.started_at + n.node_id * INTERVAL 1 HOUR
UNION ALL SELECT n.workflow_id, n.node_id, 0, 'node', 'workflow timeout' FROM wf_nodes n JOIN over ON over.id = n.workflow_id
 WHERE n.status IN ('pending','dispatched')
UNION ALL SELECT a.workflow_id, a.node_id, a.attempt_no, 'attempt', 'workflow timeout' FROM attempts a JOIN over ON over.id = a.workflow_id
 WHERE a.status = 'running'""",
    "classify_cancels": f"""SELECT r.workflow_id, CASE WHEN w.id IS NULL THEN 'not_found' WHEN w.over THEN 'conflict' ELSE 'ok' END AS verdict
 FROM run_requests r LEFT JOIN ({_FINISHED}) w ON w.id = r.workflow_id WHERE r.action = 'cancel'""",
    "cancel_runs": f"""WITH hit AS (SELECT r.workflow_id FROM run_requests r JOIN ({_FINISHED}) w ON w.id = r.workflow_id
 WHERE r.action = 'cancel' AND NOT w.over)
SELECT n.workflow_id, n.node_id, CAST(0 AS BIGINT) AS attempt_no, 'cancelled' AS status FROM wf_nodes n JOIN hit USING (workflow_id)
 WHERE n.status IN ('pending','dispatched')
UNION ALL SELECT a.workflow_id, a.node_id, a.attempt_no, 'cancelled' FROM attempts a JOIN hit USING (workflow_id) WHERE a.status = 'running'""",
    "retry_nodes": """SELECT r.workflow_id, CAST(1 + length(r.workflow_id) % 5 AS INT) AS node_id,
 CASE WHEN w.id IS NULL OR n.status IS NULL THEN 'not_found' WHEN n.status IN ('failed','timed_out') THEN 'ok' ELSE 'conflict' END AS verdict,
 CASE WHEN n.status IN ('failed','timed_out') THEN 'pending' ELSE coalesce(n.status, '') END AS node_status,
 CASE WHEN n.status IN ('failed','timed_out') THEN 'running' ELSE '' END AS run_status
 FROM run_requests r LEFT JOIN workflows w ON w.id = r.workflow_id
 LEFT JOIN wf_nodes n ON n.workflow_id = r.workflow_id AND n.node_id = 1 + length(r.workflow_id) % 5""",
    "recover_orphans": "SELECT workflow_id, node_id, attempts, status, error FROM ("
    + _FOLD.format(
        attempts=f"""(SELECT t.* REPLACE (CASE WHEN t.status = 'running' THEN CASE WHEN coalesce(w.cancel_requested, false) THEN 'cancelled'
 ELSE 'failed' END ELSE t.status END AS status, CASE WHEN t.status = 'running' THEN 'recovered_after_restart' ELSE t.error END AS error)
 FROM {_TOLD} t LEFT JOIN workflows w ON w.id = t.workflow_id)"""
    )
    + ")",
    "clone_runs": """SELECT o_orderkey || '.' || epoch_ms(o_orderdate) AS id, CAST(o_orderkey AS VARCHAR) AS template_id, 'pending' AS status,
 CAST(2 AS BIGINT) AS epoch, count(n.node_id) AS nodes, count(n.node_id) AS pending
 FROM orders LEFT JOIN wf_nodes n ON n.workflow_id = CAST(o_orderkey AS VARCHAR) GROUP BY o_orderkey, o_orderdate""",
    "validate_workflow_node": """WITH raw AS (SELECT CAST(l_orderkey AS VARCHAR) AS workflow_id, CAST(l_linenumber AS VARCHAR) AS id,
 l_suppkey % 19 <> 0 AS named, l_suppkey % 7 = 0 AS selfdep,
 l_partkey % 3 IN (0, 1) AS has_load, l_partkey % 3 = 2 OR l_partkey % 11 = 0 AS has_topic,
 CASE WHEN l_quantity > 10 THEN CAST(l_quantity * 3 AS BIGINT) ELSE 3 END AS retry_max FROM lineitem)
SELECT workflow_id, id, array_to_string(list_filter([CASE WHEN NOT named THEN 'node name is required' END,
 CASE WHEN selfdep THEN 'a node cannot depend on itself' END,
 CASE WHEN has_load = has_topic THEN 'node must exec exactly one of workload_id | event_topic' END,
 CASE WHEN retry_max > 100 THEN 'retry max must be 0..100' END], lambda x: x IS NOT NULL), '; ') AS errors,
 retry_max, CAST(16 AS BIGINT) AS max_concurrency, count(*) AS rows FROM raw GROUP BY ALL""",
    "validate_workflow": f"""WITH RECURSIVE {_GRAPH},
w AS (SELECT CAST(o_orderkey AS VARCHAR) AS workflow_id, o_orderkey AS k FROM orders),
c AS (SELECT workflow_id, bool_or(level < 0) AS stuck, bool_or(node_id = 2) AS two FROM levels GROUP BY ALL),
dang AS (SELECT DISTINCT g.workflow_id FROM graph g WHERE g.dep IS NOT NULL AND NOT EXISTS
 (SELECT 1 FROM graph p WHERE p.workflow_id = g.workflow_id AND p.node_id = g.dep))
SELECT w.workflow_id, array_to_string(list_filter([CASE WHEN k % 23 = 0 THEN 'workflow name is required' END,
 CASE WHEN c.workflow_id IS NULL THEN 'workflow needs at least one node' END,
 CASE WHEN k % 17 = 0 AND c.two THEN 'duplicate node id' END,
 CASE WHEN dang.workflow_id IS NOT NULL THEN 'node depends on unknown node' END,
 CASE WHEN c.stuck AND dang.workflow_id IS NULL AND NOT (k % 17 = 0 AND c.two) THEN 'workflow DAG contains a cycle' END,
 CASE WHEN k % 29 = 0 THEN 'workflow timeout must be > 0' END], lambda x: x IS NOT NULL), '; ') AS errors, k % 5 <> 0 AS dead_letter
 FROM w LEFT JOIN c ON c.workflow_id = w.workflow_id LEFT JOIN dang ON dang.workflow_id = w.workflow_id""",
}
