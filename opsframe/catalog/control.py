"""Control-plane and metric queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsframe import fixtures as fx
from opsframe.functions.keys import request_digest
from opsframe.functions.redact import redact_secrets
from opsframe.operators import control as ct
from opsframe.operators import metrics as mt


def namespace_scope(spark, d):
    return ct.namespace_scope(fx.workloads(spark, d), "Brand#2").select("id", "name")


def access_check(spark, d):
    asked = fx.table(spark, d, "lineitem").selectExpr(
        "l_orderkey as request", "l_linenumber",
        "cast(case when l_quantity > 48 then -l_partkey - 1 else l_partkey end as string) as id",
        "concat('Brand#', l_suppkey % 25) as caller",
    )
    verdicts = ct.access_check(asked, fx.workloads(spark, d))
    return verdicts.groupBy("caller", "verdict").agg(F.count("*").alias("requests"))


def _tokens(spark, d):
    return fx.table(spark, d, "customer").selectExpr(
        "cast(c_custkey as string) as id",
        "c_mktsegment as namespace",
        "element_at(array(array('read'), array('read','write'), array('read','write','admin')),"
        " cast(1 + c_custkey % 3 as int)) as scopes",
        "case when c_custkey % 4 > 0 then timestampadd(hour, cast(c_custkey % 1000 as int),"
        " timestamp'1998-01-01') end as expires_at",
    )


def token_access_check(spark, d):
    asked = fx.table(spark, d, "orders").selectExpr(
        "o_orderkey as request",
        "cast(o_custkey + case when o_orderkey % 40 = 0 then 1000000 else 0 end as string) as token_id",
        "case when o_orderkey % 3 > 0 then element_at(array('AUTOMOBILE','BUILDING','FURNITURE',"
        "'MACHINERY','HOUSEHOLD'), cast(1 + o_orderkey % 5 as int)) end as namespace",
        "element_at(array('read','write','admin'), cast(1 + o_orderkey % 3 as int)) as scope",
    )
    now = F.lit("1998-01-20").cast("timestamp")
    return ct.token_access_check(asked, _tokens(spark, d), now).select("request", "verdict")


def log_level_filter(spark, d):
    kept = ct.log_level_filter(fx.log_records(spark, d), "warn")
    return kept.select("id", "level", "event")


def redact(spark, d):
    safe = redact_secrets(fx.log_records(spark, d))
    return safe.select(
        "id",
        F.col("fields.user").alias("user"),
        F.col("fields.Token").alias("token_text"),
        F.coalesce("fields.inner.password", F.lit("")).alias("password_text"),
        F.col("fields.inner.value").alias("value"),
        F.col("fields.items")[0]["api_key"].alias("key_text"),
        F.element_at("fields.labels", "Secret").alias("secret_text"),
        F.element_at("fields.labels", "plain").alias("plain"),
    )


def idempotency_classify(spark, d):
    return ct.idempotency_classify(fx.requests(spark, d)).select("id", "kind", "answer_id")


def request_keys(spark, d):
    raw = fx.table(spark, d, "events").select(
        "event_id",
        request_digest(F.col("props"), F.lit("POST"), F.concat(F.lit("/v1/events/"), "event_type")).alias("digest"),
    )
    return raw


def _timed_calls(spark, d):
    return fx.table(spark, d, "events").selectExpr(
        "cast(user_id as string) as user", "unix_micros(ts) as at_us", "event_id as id"
    )


def rate_limit(spark, d):
    return ct.rate_limit(_timed_calls(spark, d), "user", limit=2, window_seconds=86_400).select(
        "id", "allowed", "retry_after_us"
    )


def _calls(spark, d):
    return fx.calls(spark, d).selectExpr("name", "unix_micros(ts) as at_us", "id", "ok")


def breaker_trips(spark, d):
    return ct.breaker_trips(_calls(spark, d), threshold=3, window_seconds=12 * 3600)


def breaker_states(spark, d):
    states = ct.breaker_states(
        _calls(spark, d), threshold=3, window_seconds=12 * 3600, open_seconds=3600
    )
    return states.select("id", "allowed", "state")


def list_entities(spark, d):
    return ct.list_entities(fx.workloads(spark, d), "Brand#7").select(
        "id", "name", F.unix_micros("created_at").alias("created_us")
    )


def list_nodes(spark, d):
    return ct.list_entities(fx.compute_nodes(spark, d), None, order="name").select("id", "name")


def audit_tail(spark, d):
    return ct.audit_tail(fx.audit(spark, d), limit=2_500).select("id", "actor", "action")


def audit_retention(spark, d):
    return ct.audit_retention(fx.audit(spark, d), keep=5_000).select("id")


def entity_counts(spark, d):
    return ct.entity_counts(
        {
            "workflows": fx.workflows(spark, d),
            "workloads": fx.workloads(spark, d),
            "nodes": fx.compute_nodes(spark, d),
            "leases": fx.leases(spark, d),
        }
    )


def stall_detect(spark, d):
    now = F.lit("2024-01-31").cast("timestamp")
    stalled = ct.stall_detect(
        fx.heartbeats(spark, d), {"click": 600.0, "view": 10.0}, now, stall_seconds=600.0
    )
    return stalled.select(
        "loop", F.round("idle_seconds", 3).alias("idle_seconds"), "limit_seconds", "stalled"
    )


def _increments(spark, d):
    return fx.table(spark, d, "events").selectExpr(
        "concat('events.', event_type) as name", "cast(event_id % 3 as double) as n"
    )


def counter_totals(spark, d):
    return mt.counter_totals(_increments(spark, d))


def _gauge_updates(spark, d):
    return fx.table(spark, d, "events").selectExpr(
        "concat('gauge.', user_id) as name",
        "case when event_id % 4 = 0 and user_id % 10 > 0 then 'set' else 'add' end as op",
        "cast(floor(value) as double) as value",
        "ts",
        "event_id as ord",
    )


def gauge_latest(spark, d):
    return mt.gauge_latest(_gauge_updates(spark, d))


def latest_samples(spark, d):
    return mt.latest_samples(fx.metric_samples(spark, d))


def _observations(spark, d):
    return fx.table(spark, d, "events").selectExpr(
        "event_type as name", "cast(cast(value * 100 as bigint) % 1200 as double) / 100 as value"
    )


def histogram_buckets(spark, d):
    buckets = mt.histogram_buckets(_observations(spark, d))
    return buckets.withColumn("sum", F.round("sum", 2))


def metrics_snapshot(spark, d):
    buckets = mt.histogram_buckets(
        _observations(spark, d).withColumn("value", F.floor("value").cast("double")), [1.0, 5.0]
    )
    return mt.metrics_snapshot(counter_totals(spark, d), gauge_latest(spark, d), buckets)


_GAUGE = """g AS (SELECT 'gauge.' || user_id AS name, event_id % 4 = 0 AND user_id % 10 > 0 AS is_set, floor(value) AS value, ts, event_id AS ord FROM events),
s AS (SELECT name, max((ts, ord)) AS at_last, arg_max(value, (ts, ord)) AS base FROM g WHERE is_set GROUP BY name),
gauges AS (SELECT g.name, CAST(coalesce(max(s.base), 0) + coalesce(sum(CASE WHEN NOT g.is_set AND (s.at_last IS NULL OR (g.ts, g.ord) > s.at_last) THEN g.value END), 0) AS DOUBLE) AS value
 FROM g LEFT JOIN s ON s.name = g.name GROUP BY g.name)"""
_COUNT = "counts AS (SELECT 'events.' || event_type AS name, CAST(sum(event_id % 3) AS DOUBLE) AS value FROM events GROUP BY event_type)"

QUERIES = {
    "namespace_scope": namespace_scope,
    "namespace_access_check": access_check,
    "token_access_check": token_access_check,
    "log_level_filter": log_level_filter,
    "redact_secrets": redact,
    "idempotency_classify": idempotency_classify,
    "request_keys": request_keys,
    "rate_limit": rate_limit,
    "breaker_trips": breaker_trips,
    "breaker_states": breaker_states,
    "list_entities": list_entities,
    "list_nodes": list_nodes,
    "audit_tail": audit_tail,
    "audit_retention": audit_retention,
    "entity_counts": entity_counts,
    "stall_detect": stall_detect,
    "counter_totals": counter_totals,
    "gauge_latest": gauge_latest,
    "latest_samples": latest_samples,
    "histogram_buckets": histogram_buckets,
    "metrics_snapshot_export": metrics_snapshot,
}

ORACLES = {
    "namespace_scope": "SELECT id, name FROM workloads WHERE namespace = 'Brand#2'",
    "namespace_access_check": """SELECT 'Brand#' || (l_suppkey % 25) AS caller, CASE WHEN w.id IS NULL THEN 'not_found'
 WHEN w.namespace <> 'Brand#' || (l_suppkey % 25) THEN 'forbidden' ELSE 'ok' END AS verdict, count(*) AS requests
 FROM lineitem LEFT JOIN workloads w ON w.id = CAST(CASE WHEN l_quantity > 48 THEN -l_partkey - 1 ELSE l_partkey END AS VARCHAR) GROUP BY ALL""",
    "token_access_check": """SELECT o_orderkey AS request, CASE WHEN c.c_custkey IS NULL OR (c_custkey % 4 > 0
 AND epoch(TIMESTAMP '1998-01-20') > epoch(TIMESTAMP '1998-01-01' + (c_custkey % 1000) * INTERVAL 1 HOUR)) THEN 'unauthorized'
 WHEN o_orderkey % 3 > 0 AND c_mktsegment <> ['AUTOMOBILE','BUILDING','FURNITURE','MACHINERY','HOUSEHOLD'][1 + o_orderkey % 5] THEN 'forbidden'
 WHEN o_orderkey % 3 > c_custkey % 3 THEN 'forbidden' ELSE 'ok' END AS verdict
 FROM orders LEFT JOIN customer c ON c.c_custkey = o_custkey + CASE WHEN o_orderkey % 40 = 0 THEN 1000000 ELSE 0 END""",
    "log_level_filter": """SELECT event_id AS id, ['debug','info','warn','error','fatal'][1 + event_id % 6] AS level, event_type AS event
 FROM events WHERE event_id % 6 IN (2, 3, 4)""",
    "redact_secrets": """SELECT event_id AS id, user_id AS user, '[REDACTED]' AS token_text,
 CASE WHEN event_id % 2 = 0 AND props IS NOT NULL THEN '[REDACTED]' ELSE '' END AS password_text, props AS value,
 CASE WHEN props IS NOT NULL THEN '[REDACTED]' END AS key_text, '[REDACTED]' AS secret_text, event_type AS plain FROM events""",
    "idempotency_classify": """WITH f AS (SELECT *, first_value(digest) OVER w AS d1, first_value(id) OVER w AS id1 FROM requests
 WINDOW w AS (PARTITION BY idem_key ORDER BY ts, id))
SELECT id, CASE WHEN idem_key IS NULL OR id = id1 THEN 'fresh' WHEN digest = d1 THEN 'replay' ELSE 'conflict' END AS kind,
 CASE WHEN idem_key IS NULL OR digest <> d1 THEN id ELSE id1 END AS answer_id FROM f""",
    "request_keys": """SELECT event_id, sha256('{"body": ' || props || ', "method": "POST", "path": "/v1/events/' || event_type || '"}') AS digest FROM events""",
    "rate_limit": """WITH RECURSIVE c AS MATERIALIZED (SELECT user_id AS u, epoch_us(ts) AS t, event_id AS id,
 row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
walk AS (SELECT u, t AS start, 1 AS used, id, n, true AS allowed, CAST(0 AS BIGINT) AS retry FROM c WHERE n = 1
 UNION ALL SELECT w.u, CASE WHEN c.t - w.start >= 86400000000 THEN c.t ELSE w.start END,
  CASE WHEN c.t - w.start >= 86400000000 THEN 1 WHEN w.used < 2 THEN w.used + 1 ELSE w.used END, c.id, c.n,
  c.t - w.start >= 86400000000 OR w.used < 2,
  CASE WHEN c.t - w.start >= 86400000000 OR w.used < 2 THEN 0 ELSE 86400000000 - (c.t - w.start) END
 FROM walk w JOIN c ON c.u = w.u AND c.n = w.n + 1)
SELECT id, allowed, retry AS retry_after_us FROM walk""",
    "breaker_trips": """WITH r AS (SELECT name, id, epoch_us(ts) AS at_us, ok, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY name ORDER BY ts, id) AS run FROM calls),
f AS (SELECT name, id, at_us, count(*) OVER (PARTITION BY name, run ORDER BY at_us RANGE BETWEEN 43200000000 PRECEDING AND CURRENT ROW) AS recent FROM r WHERE NOT ok)
SELECT name, id, at_us FROM f WHERE recent >= 3""",
    "breaker_states": """WITH RECURSIVE c AS MATERIALIZED (SELECT name, epoch_us(ts) AS t, id, ok, row_number() OVER (PARTITION BY name ORDER BY ts, id) AS n FROM calls),
walk AS (SELECT DISTINCT name, CAST(0 AS BIGINT) AS n, CAST(-1 AS BIGINT) AS id, true AS allowed, false AS open, CAST(0 AS BIGINT) AS opened, CAST([] AS BIGINT[]) AS fails FROM c
 UNION ALL SELECT w.name, c.n, c.id, NOT w.open OR c.t - w.opened >= 3600000000,
  CASE WHEN w.open THEN c.t - w.opened < 3600000000 OR NOT c.ok ELSE NOT c.ok AND len(list_filter(w.fails, lambda f: c.t - f <= 43200000000)) + 1 >= 3 END,
  CASE WHEN w.open AND c.t - w.opened < 3600000000 THEN w.opened WHEN NOT c.ok THEN c.t ELSE 0 END,
  CASE WHEN w.open OR c.ok THEN CAST([] AS BIGINT[]) ELSE list_append(list_filter(w.fails, lambda f: c.t - f <= 43200000000), c.t) END
 FROM walk w JOIN c ON c.name = w.name AND c.n = w.n + 1)
SELECT id, allowed, CASE WHEN open THEN 'open' ELSE 'closed' END AS state FROM walk WHERE n > 0""",
    "list_entities": "SELECT id, name, epoch_us(created_at) AS created_us FROM workloads WHERE namespace = 'Brand#7'",
    "list_nodes": "SELECT id, name FROM compute_nodes",
    "audit_tail": "SELECT id, actor, action FROM audit ORDER BY ts DESC, id DESC LIMIT 2500",
    "audit_retention": "SELECT id FROM audit ORDER BY ts DESC, id DESC LIMIT 5000",
    "entity_counts": """SELECT 'workflows' AS entity, count(*) AS rows FROM workflows UNION ALL SELECT 'workloads', count(*) FROM workloads
UNION ALL SELECT 'nodes', count(*) FROM compute_nodes UNION ALL SELECT 'leases', count(*) FROM leases""",
    "stall_detect": """WITH l AS (SELECT loop, epoch_us(TIMESTAMP '2024-01-31' - max(ts)) / 1000000 AS idle,
 CASE loop WHEN 'click' THEN 1800.0 ELSE 600.0 END AS lim FROM heartbeats GROUP BY loop)
SELECT loop, round(idle, 3) AS idle_seconds, CAST(lim AS DOUBLE) AS limit_seconds, idle > lim AS stalled FROM l""",
    "counter_totals": f"WITH {_COUNT} SELECT * FROM counts",
    "gauge_latest": f"WITH {_GAUGE} SELECT * FROM gauges",
    "latest_samples": "SELECT workload_id, metric, arg_max(value, (ts, ord)) AS value FROM metric_samples GROUP BY ALL",
    "histogram_buckets": """WITH s AS (SELECT event_type AS name, CAST(CAST(trunc(value * 100) AS BIGINT) % 1200 AS DOUBLE) / 100 AS value FROM events)
SELECT name, CAST(le AS DOUBLE) AS le, count(*) FILTER (value <= le) AS bucket_count, count(*) AS "count", round(sum(value), 2) AS "sum"
 FROM s, (SELECT unnest([0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]::DOUBLE[]) AS le) GROUP BY name, le""",
    "metrics_snapshot_export": f"""WITH {_GAUGE}, {_COUNT},
h AS (SELECT event_type AS name, floor(CAST(CAST(trunc(value * 100) AS BIGINT) % 1200 AS DOUBLE) / 100) AS value FROM events)
SELECT 'counters' AS section, name, CAST(value AS VARCHAR) AS body FROM counts UNION ALL SELECT 'gauges', name, CAST(value AS VARCHAR) FROM gauges
UNION ALL SELECT 'histograms', name, '{{"buckets":[{{"le":1.0,"count":' || count(*) FILTER (value <= 1) || '}},{{"le":5.0,"count":' || count(*) FILTER (value <= 5)
 || '}}],"count":' || count(*) || ',"sum":' || CAST(sum(value) AS VARCHAR) || '}}' FROM h GROUP BY name""",
}
