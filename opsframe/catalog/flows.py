"""Queries that chain several operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsframe import fixtures as fx
from opsframe.catalog import text as text_catalog
from opsframe.catalog import workflow as workflow_catalog
from opsframe.plans import flows


def publish_flow(spark, d):
    """Outcome of publishing all events into topics that hold 500 messages each."""
    messages = fx.published(spark, d).selectExpr("id", "topic", "key", "payload", "created_at")
    done = flows.publish(messages, max_lag=500)
    accepted = done.accepted.groupBy("topic").agg(
        F.lit("accepted").alias("outcome"), F.count("*").alias("messages")
    )
    rejected = done.rejected.groupBy("topic").agg(
        F.lit("rejected").alias("outcome"), F.count("*").alias("messages")
    )
    return accepted.unionByName(rejected)


def tick_flow(spark, d):
    result = flows.tick(
        fx.workflows(spark, d), fx.wf_nodes(spark, d), fx.attempts(spark, d), fx.leases(spark, d),
        workflow_catalog.now(),
    )
    skipped = result.skipped.selectExpr("workflow_id", "node_id", "'skip' as outcome", "reason as detail")
    started = result.dispatched.selectExpr("workflow_id", "node_id", "'start' as outcome", "lease_id as detail")
    waiting = result.waiting.selectExpr("workflow_id", "node_id", "'wait' as outcome", "reason as detail")
    return skipped.unionByName(started).unionByName(waiting)


def plan_flow(spark, d):
    plans = flows.plan_tasks(fx.tasks(spark, d), fx.resources(spark, d), "task-", "plan/", "plan.task.")
    return plans.runs.select("run_key", "name", "timeout")


_READY = workflow_catalog._READY1
QUERIES = {"publish_flow": publish_flow, "tick_flow": tick_flow, "plan_flow": plan_flow}
ORACLES = {
    "publish_flow": """WITH n AS (SELECT event_type AS topic, count(*) AS c FROM events GROUP BY 1)
SELECT topic, 'accepted' AS outcome, least(c, 500) AS messages FROM n UNION ALL SELECT topic, 'rejected', c - 500 FROM n WHERE c > 500""",
    "tick_flow": f"""WITH RECURSIVE over AS (SELECT id FROM workflows WHERE status IN ('pending','running')
 AND {workflow_catalog.DUCK_NOW} > created_at + CAST(timeout AS INT) * INTERVAL 1 SECOND),
live AS (SELECT id FROM workflows WHERE status IN ('pending','running') AND NOT cancel_requested AND id NOT IN (SELECT id FROM over)),
dec AS (SELECT x.* FROM ({_READY}) x JOIN live ON live.id = x.workflow_id),
busy AS (SELECT workflow_id, count(*) AS active FROM wf_nodes WHERE status IN ('dispatched','running') GROUP BY workflow_id),
r AS MATERIALIZED (SELECT x.workflow_id, x.node_id, x.workload_id, x.max_concurrency, coalesce(b.active, 0) AS active,
 row_number() OVER (PARTITION BY x.workflow_id ORDER BY x.node_id) AS n FROM dec x LEFT JOIN busy b ON b.workflow_id = x.workflow_id
 WHERE x.decision = 'ready' AND NOT EXISTS (SELECT 1 FROM attempts a WHERE a.workflow_id = x.workflow_id AND a.node_id = x.node_id AND a.status = 'running')),
walk AS (SELECT workflow_id, node_id, workload_id, n, active < max_concurrency AS ok, active + CASE WHEN active < max_concurrency THEN 1 ELSE 0 END AS used FROM r WHERE n = 1
 UNION ALL SELECT r.workflow_id, r.node_id, r.workload_id, r.n, w.used < r.max_concurrency, w.used + CASE WHEN w.used < r.max_concurrency THEN 1 ELSE 0 END
 FROM walk w JOIN r ON r.workflow_id = w.workflow_id AND r.n = w.n + 1),
slot AS (SELECT workload_id, id FROM leases WHERE state = 'active' AND expires_at > {workflow_catalog.DUCK_NOW}
 QUALIFY row_number() OVER (PARTITION BY workload_id ORDER BY created_at, id) = 1)
SELECT workflow_id, node_id, 'skip' AS outcome, reason AS detail FROM dec WHERE decision = 'skip'
UNION ALL SELECT n.workflow_id, n.node_id, 'skip', 'workflow timeout' FROM wf_nodes n JOIN over ON over.id = n.workflow_id WHERE n.status IN ('pending','dispatched')
UNION ALL SELECT w.workflow_id, w.node_id, CASE WHEN w.ok AND s.id IS NOT NULL THEN 'start' ELSE 'wait' END,
 CASE WHEN NOT w.ok THEN 'concurrency limit' WHEN s.id IS NULL THEN 'no lease' ELSE s.id END FROM walk w LEFT JOIN slot s ON s.workload_id = w.workload_id""",
    "plan_flow": f"""WITH {text_catalog._TAGGED}, ok AS (SELECT DISTINCT t.intent, t.capabilities FROM tagged t JOIN tasks k ON k.task_id = t.task_id
 WHERE NOT (regexp_matches(lower(k.intent), '\\b(delete|destroy|drop|wipe|transfer|purchase|deploy)\\b') AND k.autonomy IN ('A3','A4','A5')))
SELECT 'task-' || substring(sha256('{{"capabilities": ["' || array_to_string(list_sort(capabilities), '", "') || '"], "intent": "' || intent || '"}}'), 1, 40) AS run_key,
 'plan/' || substring({text_catalog._SLUG.format(c='intent')}, 1, 48) AS name, CAST(300.0 * len(capabilities) AS DOUBLE) AS timeout FROM ok""",
}
