"""Intent, ledger, cron and source queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsframe import fixtures as fx
from opsframe.functions import cron
from opsframe.functions.keys import slugify, task_key
from opsframe.operators import control as ct
from opsframe.operators import intent as it
from opsframe.operators import ledger as lg
from opsframe.session import scratch_folder
from opsframe.sources import entities as en
from opsframe.sources import event_log as el
from opsframe.sources import files as fs
from opsframe.sources import jsonl as js

# ------------------------------------------------------------------------ intent


def _tagged(spark, d):
    return fx.tasks(spark, d).withColumn("capabilities", it.tag_capabilities(F.col("intent")))


def tag_capabilities(spark, d):
    return _tagged(spark, d).select("task_id", F.array_join("capabilities", ",").alias("capabilities"))


def tag_documents(spark, d):
    """Tags over whole document texts."""
    docs = fx.table(spark, d, "documents")
    tags = F.array_join(it.tag_capabilities(F.col("text")), ",")
    return docs.select("doc_id", tags.alias("capabilities"))


def policy_gate(spark, d):
    return it.policy_gate(fx.tasks(spark, d)).select("task_id", "allowed", "reason")


def slug(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", slugify(F.col("text")).alias("slug"))


def task_keys(spark, d):
    return _tagged(spark, d).select(
        "task_id", task_key(F.col("intent"), F.col("capabilities"), "task-").alias("task_key")
    )


def capability_scores(spark, d):
    scores = it.capability_scores(_tagged(spark, d), fx.resources(spark, d), network=False)
    return scores.select(
        "set_key", "tasks", "resource_id", F.round("fit", 9).alias("fit"), F.round("score", 9).alias("score")
    )


def top_candidates(spark, d):
    best = it.top_candidates(_tagged(spark, d), fx.resources(spark, d))
    return best.select("task_id", "place", "resource_id", F.round("score", 9).alias("score"), "confidence")


def expand_plan(spark, d):
    runs, nodes = it.expand_plan(_tagged(spark, d), "plan/", "plan.task.")
    return nodes.join(runs.select("task_id", F.col("name").alias("run"), F.col("timeout").alias("run_timeout")), "task_id").select(
        "task_id", "run", "run_timeout", "node_id", "event_topic", "retry_max"
    )


def net_cost(spark, d):
    return fx.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber",
        it.net_cost(F.col("l_extendedprice"), F.col("l_quantity") * 100).alias("net"),
    )


def _versions(spark, d):
    """Documents as files before and after a change, with their hashes."""
    docs = fx.table(spark, d, "documents").selectExpr("concat('doc/', doc_id) as path", "doc_id", "text")
    before = docs.selectExpr("path", "sha2(text, 256) as hash")
    after = docs.filter("doc_id % 17 > 0").selectExpr(
        "path", "sha2(case when doc_id % 10 = 0 then text || '!' else text end, 256) as hash"
    )
    targets = docs.selectExpr(
        "path", "case when doc_id % 3 = 0 then sha2(text, 256) when doc_id % 7 = 0 then 'x' end as expected"
    )
    return before, after, targets


def save_proof(spark, d):
    return it.save_proof(*_versions(spark, d))


def file_snapshot(spark, d):
    _, after, targets = _versions(spark, d)
    found = fs.file_snapshot(targets.select("path"), after)
    return found.select("path", "exists", F.coalesce("hash", F.lit("")).alias("hash"))


def table_files(spark, d):
    """Hashes of the stored table files themselves."""
    hashes = fs.file_hashes(spark, d, "*.parquet")
    return hashes.select(F.regexp_extract("path", "[^/]+$", 0).alias("file"), "hash")


# ------------------------------------------------------------------------ ledger


def build_hash_chain(spark, d):
    return lg.build_hash_chain(fx.ledger_body(spark, d)).select(
        "chain_id", "seq", "previous_hash", "hash"
    )


def _tampered(spark, d):
    """Every seventh chain has its second record rewritten."""
    chain = lg.build_hash_chain(fx.ledger_body(spark, d))
    hit = (F.col("chain_id") % 7 == 0) & (F.col("seq") == 1)
    return chain.withColumn(
        "body", F.when(hit, F.concat("body", F.lit(" "))).otherwise(F.col("body"))
    ).filter("not (chain_id % 5 = 0 and seq = 2)")


def verify_hash_chain(spark, d):
    return lg.verify_hash_chain(_tampered(spark, d))


def chain_issues(spark, d):
    return lg.chain_issues(_tampered(spark, d))


def _memory_lines(spark, d):
    records = fx.table(spark, d, "conversations").selectExpr(
        "conv_id", "turn", "role as kind", "text as content",
        "map('conv', cast(conv_id as string)) as provenance",
    )
    now = F.lit("2024-05-06 07:08:09.000012").cast("timestamp")
    return records, now


def memory_search(spark, d):
    records, now = _memory_lines(spark, d)
    lines = js.record_lines(records, now).withColumnRenamed("value", "json_text")
    return lg.memory_search(lines, "ATION")


# -------------------------------------------------------------------------- cron

START, END = "2024-09-01", "2024-10-01"


def cron_expand(spark, d):
    lower, upper = (F.lit(x).cast("timestamp") for x in (START, END))
    fires = cron.cron_expand(fx.schedules(spark, d), lower, upper)
    return fires.select("schedule_id", F.unix_seconds("fire_at").alias("fire_s"))


def cron_malformed(spark, d):
    return cron.malformed_schedules(fx.schedules(spark, d)).select("schedule_id", "error")


def cron_next(spark, d):
    now = F.lit("2024-09-13 08:05:30").cast("timestamp")
    found = cron.cron_next(fx.schedules(spark, d), now)
    return found.select(
        "schedule_id", F.coalesce(F.unix_seconds("next_at"), F.lit(-1)).alias("next_s"), "error"
    )


def cron_fires_guarded(spark, d):
    fires = fx.table(spark, d, "events").selectExpr(
        "event_type as template_id", "unix_micros(ts) as at_us", "event_id as id"
    )
    guarded = ct.rate_limit(fires, "template_id", limit=1, window_seconds=1800)
    return guarded.filter("allowed").select("template_id", "id")


# ----------------------------------------------------------------------- sources


def _written_log(spark, d):
    """Events as JSON lines, every 50th torn, some blank lines, read back."""
    lines = fx.table(spark, d, "events").selectExpr(
        "case when event_id % 50 = 0 then substring(props, 1, length(props) - 1)"
        " when event_id % 77 = 0 then '   ' else concat('  ', props) end as value"
    )
    folder = scratch_folder(spark, "log")
    lines.write.text(folder)
    return js.read_jsonl_tolerant(spark, folder)


def read_jsonl_tolerant(spark, d):
    log = _written_log(spark, d)
    return log.groupBy("torn", "text").agg(F.count("*").alias("lines"))


def quarantine_torn(spark, d):
    log = _written_log(spark, d)
    folder = scratch_folder(spark, "kept")
    stamp = F.lit("2024-01-31").cast("timestamp")
    js.quarantine_torn(log, f"{folder}/log", f"{folder}/corrupt", stamp)
    kept = spark.read.text(f"{folder}/log").select(F.lit("log").alias("part"), "value")
    moved = spark.read.text(f"{folder}/corrupt").select(F.lit("corrupt").alias("part"), "value")
    both = kept.unionByName(moved.filter("not startswith(value, '#')"))
    return both.groupBy("part", "value").agg(F.count("*").alias("lines"))


def append_records(spark, d):
    records, now = _memory_lines(spark, d)
    folder = scratch_folder(spark, "memory")
    js.append_records(records.filter("turn = 0"), folder, now)
    js.append_records(records.filter("turn > 0"), folder, now)
    return spark.read.text(folder).select(F.col("value").alias("line"))


def read_partition(spark, d):
    """One partition of the stored log, in order: only its folder is read."""
    folder = scratch_folder(spark, "events")
    el.write_event_log(fx.bus_events(spark, d).select("topic", "partition", "seq", "id"), folder)
    log = el.read_event_log(spark, folder, "seq bigint, id bigint, topic string, partition int")
    return el.partition_events(log, "click", 2).select("seq", "id")


def _entity_rows(spark, d):
    """Workload payloads in two versions; the later one paused some workloads."""
    stored = fx.workloads(spark, d).selectExpr(
        "id", "namespace", "name", "cpu", "memory", "policy", "node_tags", "spread", "priority",
        "status", "desired_replicas", "unix_seconds(created_at) as created_at",
    )
    first = en.encode_entity_rows(stored.withColumn("status", F.lit("active"))).withColumn("v", F.lit(1))
    second = en.encode_entity_rows(stored).withColumn("v", F.lit(2))
    return first.unionByName(second)


def encode_entity_rows(spark, d):
    return _entity_rows(spark, d).filter("v = 2").select("id", "payload")


def decode_entity_rows(spark, d):
    rows = en.decode_entity_rows(_entity_rows(spark, d), "workloads", version="v")
    return rows.select(
        "id", "name", "cpu", "status", "created_at", F.array_join("node_tags", ",").alias("tags"),
        F.size("scaler.metrics").alias("metrics"),
    )


def write_event_log(spark, d):
    folder = scratch_folder(spark, "events")
    events = fx.bus_events(spark, d).select("topic", "partition", "seq", "id", "payload")
    el.write_event_log(events, folder)
    log = el.read_event_log(
        spark, folder, "seq bigint, id bigint, payload string, topic string, partition int"
    )
    return log.select("topic", "partition", "seq", "id", "payload")


# RE2 only knows ASCII word boundaries, so they are spelled out.
_L, _R = "(^|[^\\p{L}\\p{M}\\p{N}_])", "($|[^\\p{L}\\p{M}\\p{N}_])"
_TAG = """[CASE WHEN regexp_matches({c}, '{l}repos?') THEN 'cap://software/repository/inspect' END,
 CASE WHEN regexp_matches({c}, '{l}refactor(?:ing)?{r}') THEN 'cap://software/code/refactor' END,
 CASE WHEN regexp_matches({c}, '{l}tests?{r}') THEN 'cap://software/testing/execute' END,
 CASE WHEN regexp_matches({c}, '{l}(git|commit){r}') THEN 'cap://software/git/operate' END,
 CASE WHEN regexp_matches({c}, '{l}research{r}') THEN 'cap://research/web' END,
 CASE WHEN regexp_matches({c}, '{l}browser{r}') THEN 'cap://interaction/browser' END,
 CASE WHEN regexp_matches({c}, '{l}verify(?:ing|ied|y)?{r}') THEN 'cap://verification/save-proof' END]"""


def _tags(column):
    found = f"list_filter({_TAG.format(c=f'lower({column})', l=_L, r=_R)}, lambda x: x IS NOT NULL)"
    return f"CASE WHEN len({found}) > 0 THEN {found} ELSE ['cap://general/agent/execute'] END"


_TAGGED = f"tagged AS (SELECT task_id, intent, {_tags('intent')} AS capabilities FROM tasks)"
_SLUG = "trim(regexp_replace(lower({c}), '[^a-z0-9]+', '-', 'g'), '-')"
_CHAIN = """chain AS (SELECT chain_id, seq, body, '' AS previous_hash, sha256(body) AS hash FROM num WHERE n = 1
 UNION ALL SELECT m.chain_id, m.seq, m.body, c.hash, sha256(c.hash || m.body) FROM chain c JOIN num p ON p.chain_id = c.chain_id AND p.seq = c.seq
 JOIN num m ON m.chain_id = c.chain_id AND m.n = p.n + 1)"""
_CHAINED = f"num AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY chain_id ORDER BY seq) AS n FROM ledger_body), {_CHAIN}"
_ISSUES = f"""{_CHAINED},
bad AS (SELECT chain_id, seq, CASE WHEN chain_id % 7 = 0 AND seq = 1 THEN body || ' ' ELSE body END AS body, previous_hash, hash
 FROM chain WHERE NOT (chain_id % 5 = 0 AND seq = 2)),
seen AS (SELECT *, coalesce(lag(hash) OVER w, '') AS prior, row_number() OVER w - 1 AS position FROM bad WINDOW w AS (PARTITION BY chain_id ORDER BY seq)),
issues AS (SELECT chain_id, seq, position, 'previous_hash mismatch' AS issue FROM seen WHERE previous_hash <> prior
 UNION ALL SELECT chain_id, seq, position, 'hash mismatch (tampered or rewritten)' FROM seen WHERE hash <> sha256(previous_hash || body))"""
_LINE = """'{"content": ' || to_json(text) || ', "kind": "' || role || '", "provenance": {"conv": "' || conv_id || '"}, "timestamp": "2024-05-06T07:08:09.000012+00:00"}'"""
# What each kind of schedule means, written out by hand.
_FITS = """CASE c_custkey % 8 WHEN 0 THEN m = c_custkey % 60 AND h = c_custkey % 24
 WHEN 1 THEN m % 15 = 0 AND h = 8 AND day IN (1, 15) WHEN 2 THEN m = 0 AND h = 0 AND dow = 0
 WHEN 3 THEN m = 0 AND h = 0 AND day = 13 AND dow = 5 WHEN 4 THEN m IN (5, 10, 15, 20) AND h = 8 AND day IN (1, 15)
 WHEN 5 THEN false WHEN 6 THEN c_custkey % 70 < 60 AND m = c_custkey % 70 AND h = 1
 ELSE c_custkey % 3 = 1 AND m = 1 AND h = 2 AND day = 3 AND month = 4 AND dow = 5 END"""
_ERROR = """CASE WHEN c_custkey % 8 = 6 AND c_custkey % 70 >= 60 THEN 'malformed minute field'
 WHEN c_custkey % 8 = 7 AND c_custkey % 3 <> 1 THEN 'cron must have exactly 5 fields: minute hour dom month dow' ELSE '' END"""
_JSON_WORKLOAD = """'{"cpu":' || cpu || ',"created_at":' || CAST(epoch(created_at) AS BIGINT) || ',"desired_replicas":' || desired_replicas || ',"id":"' || id
 || '","memory":' || memory || ',"name":"' || name || '","namespace":"' || namespace || '","node_tags":[' || coalesce('"' || node_tag || '"', '')
 || '],"policy":"' || policy || '","priority":' || priority || ',"spread":' || spread || ',"status":"' || status || '"}'"""
_TEXT_LOG = """lines AS (SELECT trim(CASE WHEN event_id % 50 = 0 THEN substring(props, 1, length(props) - 1)
 WHEN event_id % 77 = 0 THEN '   ' ELSE props END) AS text, event_id % 50 = 0 AS torn FROM events)"""

QUERIES = {
    "tag_capabilities": tag_capabilities,
    "tag_documents": tag_documents,
    "policy_gate": policy_gate,
    "slugify": slug,
    "task_keys": task_keys,
    "capability_scores": capability_scores,
    "top_candidates": top_candidates,
    "expand_plan": expand_plan,
    "net_cost": net_cost,
    "save_proof": save_proof,
    "file_snapshot": file_snapshot,
    "file_hashes": table_files,
    "build_hash_chain": build_hash_chain,
    "verify_hash_chain": verify_hash_chain,
    "hash_chain_issues": chain_issues,
    "memory_search": memory_search,
    "cron_expand": cron_expand,
    "cron_malformed": cron_malformed,
    "cron_next": cron_next,
    "cron_fires_guarded": cron_fires_guarded,
    "read_jsonl_tolerant": read_jsonl_tolerant,
    "quarantine_torn": quarantine_torn,
    "append_records": append_records,
    "encode_entity_rows": encode_entity_rows,
    "decode_entity_rows": decode_entity_rows,
    "write_event_log": write_event_log,
    "read_partition": read_partition,
}

ORACLES = {
    "tag_capabilities": f"WITH {_TAGGED} SELECT task_id, array_to_string(capabilities, ',') AS capabilities FROM tagged",
    "tag_documents": f"SELECT doc_id, array_to_string({_tags('text')}, ',') AS capabilities FROM documents",
    "policy_gate": """WITH v AS (SELECT task_id, regexp_matches(lower(intent), '\\b(delete|destroy|drop|wipe|transfer|purchase|deploy)\\b')
 AND autonomy IN ('A3','A4','A5') AS b FROM tasks)
SELECT task_id, NOT b AS allowed, CASE WHEN b THEN 'Explicit human approval required.' ELSE 'allowed' END AS reason FROM v""",
    "slugify": f"SELECT doc_id, {_SLUG.format(c='text')} AS slug FROM documents",
    "task_keys": f"""WITH {_TAGGED} SELECT task_id, 'task-' || substring(sha256('{{"capabilities": ["' || array_to_string(list_sort(capabilities), '", "')
 || '"], "intent": "' || intent || '"}}'), 1, 40) AS task_key FROM tagged""",
    "capability_scores": f"""WITH {_TAGGED}, sets AS (SELECT array_to_string(list_sort(capabilities), ' ') AS set_key, any_value(capabilities) AS caps, count(*) AS tasks
 FROM tagged GROUP BY 1),
s AS (SELECT set_key, tasks, r.resource_id, len(list_intersect(caps, r.capability_ids)) / len(caps) AS fit, r.trust, r.cost_estimate, r.kind FROM sets, resources r)
SELECT set_key, tasks, resource_id, round(fit, 9) AS fit,
 round(0.65 * fit + 0.25 * trust + 0.10 / (1 + cost_estimate) - CASE WHEN kind IN ('model','model-provider') THEN 0.15 ELSE 0 END, 9) AS score FROM s WHERE fit > 0""",
    "top_candidates": f"""WITH {_TAGGED}, s AS (SELECT t.task_id, r.resource_id, r.ord, CAST(r.trust AS DOUBLE) AS confidence,
 (CAST(0.65 AS DOUBLE) * (CAST(len(list_intersect(t.capabilities, r.capability_ids)) AS DOUBLE) / len(t.capabilities)) + CAST(0.25 AS DOUBLE) * CAST(r.trust AS DOUBLE))
 + CAST(0.10 AS DOUBLE) / (CAST(1 AS DOUBLE) + r.cost_estimate) AS score FROM tagged t, resources r)
SELECT task_id, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, confidence DESC, ord) AS place, resource_id, round(score, 9) AS score, confidence
 FROM s QUALIFY place <= 5""",
    "expand_plan": f"""WITH {_TAGGED}, u AS (SELECT task_id, intent, len(capabilities) AS n, unnest(capabilities) AS cap, generate_subscripts(capabilities, 1) - 1 AS i FROM tagged)
SELECT task_id, 'plan/' || substring({_SLUG.format(c='intent')}, 1, 48) AS run, CAST(300.0 * n AS DOUBLE) AS run_timeout, 'cap-' || i AS node_id,
 'plan.task.' || {_SLUG.format(c='cap')} AS event_topic, CAST(3 AS BIGINT) AS retry_max FROM u""",
    "net_cost": "SELECT l_orderkey, l_linenumber, l_extendedprice - l_quantity * 100 AS net FROM lineitem",
    "save_proof": """WITH v AS (SELECT 'doc/' || doc_id AS path, doc_id % 17 > 0 AS here, doc_id % 10 = 0 AS edited,
 CASE WHEN doc_id % 3 = 0 THEN 'same' WHEN doc_id % 7 = 0 THEN 'x' END AS expected FROM documents)
SELECT path, here AS exists, NOT here OR edited AS changed,
 CASE expected WHEN 'same' THEN here AND NOT edited WHEN 'x' THEN false ELSE true END AS expected_hash_ok,
 here AND CASE expected WHEN 'same' THEN NOT edited WHEN 'x' THEN false ELSE edited END AS verified FROM v""",
    "file_snapshot": """SELECT 'doc/' || doc_id AS path, doc_id % 17 > 0 AS exists, CASE WHEN doc_id % 17 > 0
 THEN sha256(CASE WHEN doc_id % 10 = 0 THEN text || '!' ELSE text END) ELSE '' END AS hash FROM documents""",
    "build_hash_chain": f"WITH RECURSIVE {_CHAINED} SELECT chain_id, seq, previous_hash, hash FROM chain",
    "verify_hash_chain": f"""WITH RECURSIVE {_ISSUES} SELECT s.chain_id, coalesce(i.n, 0) = 0 AS ok, count(*) AS records, CAST(0 AS BIGINT) AS torn,
 coalesce(i.n, 0) AS issues FROM seen s LEFT JOIN (SELECT chain_id, count(*) AS n FROM issues GROUP BY 1) i ON i.chain_id = s.chain_id GROUP BY s.chain_id, i.n""",
    "hash_chain_issues": f"WITH RECURSIVE {_ISSUES} SELECT * FROM issues",
    "memory_search": f"SELECT json_text FROM (SELECT {_LINE} AS json_text FROM conversations) WHERE contains(lower(json_text), 'ation')",
    "cron_expand": f"""WITH mins AS (SELECT t, minute(t) AS m, hour(t) AS h, day(t) AS day, month(t) AS month, dayofweek(t) AS dow
 FROM (SELECT unnest(generate_series(TIMESTAMP '{START}', TIMESTAMP '{END}' - INTERVAL 1 MINUTE, INTERVAL 1 MINUTE)) AS t))
SELECT c_custkey AS schedule_id, CAST(epoch(t) AS BIGINT) AS fire_s FROM mins JOIN customer ON {_FITS}""",
    "cron_malformed": f"SELECT c_custkey AS schedule_id, {_ERROR} AS error FROM customer WHERE {_ERROR} <> ''",
    "cron_next": f"""WITH days AS (SELECT unnest(generate_series(DATE '2024-09-13', DATE '2026-09-16', INTERVAL 1 DAY)) AS d),
slots AS (SELECT unnest(range(0, 60)) AS m), hours AS (SELECT unnest(range(0, 24)) AS h),
okday AS (SELECT k, min(d) FILTER (d > DATE '2024-09-13') AS nxt, bool_or(d = DATE '2024-09-13') AS today FROM days, (SELECT unnest(range(0, 8)) AS k)
 WHERE CASE k WHEN 1 THEN day(d) IN (1, 15) WHEN 2 THEN dayofweek(d) = 0 WHEN 3 THEN day(d) = 13 AND dayofweek(d) = 5 WHEN 4 THEN day(d) IN (1, 15)
  WHEN 5 THEN false WHEN 7 THEN day(d) = 3 AND month(d) = 4 AND dayofweek(d) = 5 ELSE true END GROUP BY k),
ok AS (SELECT c_custkey, c_custkey % 8 AS k, CASE c_custkey % 8 WHEN 0 THEN (c_custkey % 24) * 60 + c_custkey % 60 WHEN 1 THEN 480 WHEN 4 THEN 485
  WHEN 6 THEN 60 + c_custkey % 70 WHEN 7 THEN 121 ELSE 0 END AS first_min FROM customer WHERE {_ERROR} = ''),
fire AS (SELECT c.c_custkey, c.error, CASE WHEN o.c_custkey IS NULL OR dd.k IS NULL THEN -1
  WHEN dd.today AND o.first_min > 485 THEN CAST(epoch(DATE '2024-09-13') AS BIGINT) + o.first_min * 60
  WHEN dd.nxt IS NULL THEN -1 ELSE CAST(epoch(dd.nxt) AS BIGINT) + o.first_min * 60 END AS next_s
 FROM (SELECT c_custkey, {_ERROR} AS error FROM customer) c LEFT JOIN ok o ON o.c_custkey = c.c_custkey LEFT JOIN okday dd ON dd.k = o.k)
SELECT c_custkey AS schedule_id, next_s, CASE WHEN error = '' AND next_s < 0 THEN 'no match within 2 years' ELSE error END AS error FROM fire""",
    "cron_fires_guarded": """WITH RECURSIVE c AS MATERIALIZED (SELECT event_type AS k, epoch_us(ts) AS t, event_id AS id,
 row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events),
walk AS (SELECT k, t AS start, id, n, true AS fired FROM c WHERE n = 1
 UNION ALL SELECT w.k, CASE WHEN c.t - w.start >= 1800000000 THEN c.t ELSE w.start END, c.id, c.n, c.t - w.start >= 1800000000
 FROM walk w JOIN c ON c.k = w.k AND c.n = w.n + 1)
SELECT k AS template_id, id FROM walk WHERE fired""",
    "read_jsonl_tolerant": f"WITH {_TEXT_LOG} SELECT torn, text, count(*) AS lines FROM lines WHERE text <> '' GROUP BY ALL",
    "quarantine_torn": f"""WITH {_TEXT_LOG} SELECT CASE WHEN torn THEN 'corrupt' ELSE 'log' END AS part, text AS value, count(*) AS lines
 FROM lines WHERE text <> '' GROUP BY ALL""",
    "append_records": f"SELECT {_LINE} AS line FROM conversations",
    "encode_entity_rows": f"SELECT id, {_JSON_WORKLOAD} AS payload FROM workloads",
    "decode_entity_rows": """SELECT id, name, CAST(cpu AS BIGINT) AS cpu, status, CAST(epoch(created_at) AS DOUBLE) AS created_at, coalesce(node_tag, '') AS tags, 0 AS metrics FROM workloads""",
    "read_partition": """SELECT seq, id FROM bus_events WHERE topic = 'click' AND "partition" = 2""",
    "write_event_log": """SELECT topic, "partition", seq, id, payload FROM bus_events""",
}
