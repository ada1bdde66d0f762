"""Event-plane queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsframe import fixtures as fx
from opsframe.functions.keys import event_partition
from opsframe.operators import events as ev


def _subscriptions(events):
    return events.select("topic").distinct().withColumn("grp", F.lit("g1"))


def next_batch(spark, d):
    events = fx.bus_events(spark, d)
    due = ev.next_batch(events, fx.bus_offsets(events), _subscriptions(events))
    return due.select("grp", "topic", "partition", "seq", "id")


def event_partition_of_key(spark, d):
    return fx.published(spark, d).select(
        "id", "key", event_partition(F.col("key")).cast("bigint").alias("partition")
    )


def assign_sequence(spark, d):
    return ev.assign_sequence(fx.published(spark, d)).select("id", "topic", "partition", "seq")


def _raw_messages(spark, d):
    return fx.table(spark, d, "events").selectExpr(
        "event_id as id",
        "case when event_id % 31 = 0 then '' when event_id % 37 = 0"
        " then repeat('t', 129) else event_type end as topic",
        "case when event_id % 11 = 0 then '[1, 2]' when event_id % 13 = 0 then '{\"k\": '"
        " when event_id % 17 = 0 then repeat(' ', 2000) || props when event_id % 19 = 0"
        " then null else props end as payload",
    )


def validate_event(spark, d):
    checked = ev.validate_event(_raw_messages(spark, d), max_payload=1024)
    return checked.select("id", F.array_join("errors", "; ").alias("errors"))


def topic_lag(spark, d):
    return ev.topic_lag(fx.published(spark, d))


def ack_states(spark, d):
    states = ev.ack_states(fx.bus_events(spark, d), fx.acks(spark, d))
    fails = F.aggregate(F.map_values("delivery_attempts"), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return states.select("event_id", "topic", "status", "illegal_transition", fails.alias("fails"))


def ack_dead_letters(spark, d):
    dead = ev.ack_dead_letters(fx.bus_events(spark, d), fx.acks(spark, d))
    return dead.select(
        "id", "topic", "partition", "seq", "grp", "error", "attempts",
        F.unix_micros("created_at").alias("created_us"),
    )


def ack_offsets(spark, d):
    return ev.ack_offsets(fx.bus_events(spark, d), fx.acks(spark, d))


def list_dead_letters(spark, d):
    dead = ev.ack_dead_letters(fx.bus_events(spark, d), fx.acks(spark, d))
    return ev.list_dead_letters(dead, "click").select(
        "id", "grp", "attempts", F.unix_micros("created_at").alias("created_us")
    )


def admit_events(spark, d):
    return ev.admit_events(fx.published(spark, d), max_lag=500).select("id", "topic", "accepted")


def _actions(spark, d):
    log = fx.published(spark, d)
    publish = log.selectExpr("topic", "unix_micros(created_at) as at", "id * 2 as id", "false as settled")
    settle = log.filter("id % 3 <> 0").selectExpr(
        "topic", "unix_micros(created_at) + (60 + id % 7200) * 1000000 as at",
        "id * 2 + 1 as id", "true as settled",
    )
    return publish.unionByName(settle)


def admit_with_settles(spark, d):
    return ev.admit_with_settles(_actions(spark, d), max_lag=3).filter("not settled").select(
        "id", "topic", "accepted"
    )


_ACK_IDX = """idx AS (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY event_id, grp ORDER BY ack_no) AS tries
  FROM acks),
seen AS (SELECT event_id, min(CASE WHEN ok THEN ack_ts END) AS ok_at,
  min(CASE WHEN NOT ok AND tries >= 5 THEN ack_ts END) AS spent_at,
  CAST(sum(CASE WHEN ok THEN 0 ELSE 1 END) AS BIGINT) AS fails FROM idx GROUP BY event_id),
final AS (SELECT e.id AS event_id, e.topic, e."partition", e.seq, s.fails,
  coalesce(s.spent_at IS NOT NULL AND (s.ok_at IS NULL OR s.spent_at < s.ok_at), false) AS dead, s.ok_at, s.spent_at
  FROM bus_events e LEFT JOIN seen s ON s.event_id = e.id),
letters AS (SELECT f.event_id AS id, f.topic, f."partition", f.seq, a.grp, a.error, CAST(a.tries AS BIGINT) AS attempts,
  epoch_us(a.ack_ts) AS created_us
  FROM final f JOIN idx a ON a.event_id = f.event_id WHERE f.dead AND NOT a.ok AND a.tries >= 5
  QUALIFY row_number() OVER (PARTITION BY f.event_id ORDER BY a.ack_ts DESC) = 1)"""

QUERIES = {
    "next_batch": next_batch,
    "event_partition": event_partition_of_key,
    "assign_sequence": assign_sequence,
    "validate_event": validate_event,
    "topic_lag": topic_lag,
    "fold_acks_states": ack_states,
    "fold_acks_dead_letters": ack_dead_letters,
    "fold_acks_offsets": ack_offsets,
    "list_dead_letters": list_dead_letters,
    "admit_events": admit_events,
    "admit_events_settled": admit_with_settles,
}

ORACLES = {
    "next_batch": """SELECT 'g1' AS grp, e.topic, e."partition", e.seq, e.id
FROM bus_events e LEFT JOIN bus_offsets o ON o.topic = e.topic AND o."partition" = e."partition"
WHERE e.status = 'pending' AND e.seq > coalesce(o.seq, 0) AND e.attempts_g1 < 5
QUALIFY row_number() OVER (PARTITION BY e.topic, e."partition" ORDER BY e.seq) <= 10""",
    # crc32 bit by bit over the characters of each distinct key.
    "event_partition": """WITH RECURSIVE keys AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS key FROM events),
bits AS (SELECT key, 0 AS i, CAST(4294967295 AS BIGINT) AS crc FROM keys
 UNION ALL SELECT key, i + 1, CASE WHEN fed & 1 = 1 THEN xor(fed >> 1, CAST(3988292384 AS BIGINT)) ELSE fed >> 1 END
 FROM (SELECT key, i, CASE WHEN i % 8 = 0 THEN xor(crc, CAST(ascii(substring(key, i // 8 + 1, 1)) AS BIGINT)) ELSE crc END AS fed
  FROM bits WHERE i < 8 * length(key)) f)
SELECT e.event_id AS id, b.key, xor(b.crc, CAST(4294967295 AS BIGINT)) % 4 AS "partition" FROM events e
 JOIN bits b ON b.key = CAST(e.user_id AS VARCHAR) AND b.i = 8 * length(b.key)""",
    "assign_sequence": 'SELECT id, topic, "partition", seq FROM bus_events',
    "validate_event": """WITH raw AS (SELECT event_id AS id,
 CASE WHEN event_id % 31 = 0 THEN '' WHEN event_id % 37 = 0 THEN repeat('t', 129) ELSE event_type END AS topic,
 CASE WHEN event_id % 11 = 0 THEN '[1, 2]' WHEN event_id % 13 = 0 THEN '{"k": '
  WHEN event_id % 17 = 0 THEN repeat(' ', 2000) || props WHEN event_id % 19 = 0 THEN NULL ELSE props END AS payload
 FROM events)
SELECT id, array_to_string(list_filter([
 CASE WHEN payload IS NOT NULL AND (NOT json_valid(payload) OR json_type(CASE WHEN json_valid(payload) THEN payload END) <> 'OBJECT') THEN 'event payload must be an object' END,
 CASE WHEN length(payload) > 1024 THEN 'event payload exceeds 1024 bytes' END,
 CASE WHEN length(topic) NOT BETWEEN 1 AND 128 THEN 'topic is required' END], lambda x: x IS NOT NULL), '; ') AS errors FROM raw""",
    "topic_lag": """SELECT coalesce(topic, '*') AS topic, count(*) AS lag FROM bus_events
WHERE status = 'pending' GROUP BY ROLLUP (topic)""",
    "fold_acks_states": f"""WITH {_ACK_IDX}
SELECT event_id, topic, CASE WHEN dead THEN 'dead' WHEN ok_at IS NOT NULL THEN 'delivered' ELSE 'pending' END AS status,
 spent_at IS NOT NULL AND NOT dead AS illegal_transition, coalesce(fails, 0) AS fails FROM final""",
    "fold_acks_dead_letters": f"WITH {_ACK_IDX} SELECT * FROM letters",
    "fold_acks_offsets": f"""WITH {_ACK_IDX},
moves AS (SELECT a.grp, f.topic, f."partition", f.seq, a.ack_ts, a.event_id, a.ack_no FROM idx a JOIN final f ON f.event_id = a.event_id
 WHERE a.ok OR (f.dead AND a.tries >= 5)),
offs AS (SELECT grp, topic, "partition", seq AS "offset" FROM moves
 QUALIFY row_number() OVER (PARTITION BY grp, topic, "partition" ORDER BY ack_ts DESC, event_id DESC, ack_no DESC) = 1)
SELECT grp, topic, "partition", "offset", (SELECT count(*) FROM final f WHERE NOT f.dead AND f.ok_at IS NULL
 AND f.topic = offs.topic AND f."partition" = offs."partition" AND f.seq <= offs."offset") AS stranded FROM offs""",
    "list_dead_letters": f"""WITH {_ACK_IDX} SELECT id, grp, attempts, created_us FROM letters WHERE topic = 'click'""",
    "admit_events": """SELECT event_id AS id, event_type AS topic,
 row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) <= 500 AS accepted FROM events""",
    "admit_events_settled": """WITH RECURSIVE log AS (
 SELECT event_type AS topic, epoch_us(ts) AS at_us, event_id * 2 AS id, false AS settled FROM events
 UNION ALL SELECT event_type, epoch_us(ts) + (60 + event_id % 7200) * 1000000, event_id * 2 + 1, true FROM events WHERE event_id % 3 <> 0),
num AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY at_us, id) AS n FROM log),
walk AS (SELECT DISTINCT topic, CAST(0 AS BIGINT) AS n, 0 AS lag, false AS accepted, CAST(-1 AS BIGINT) AS id, true AS settled FROM num
 UNION ALL SELECT w.topic, m.n, CASE WHEN m.settled THEN greatest(w.lag - 1, 0) WHEN w.lag < 3 THEN w.lag + 1 ELSE w.lag END,
  NOT m.settled AND w.lag < 3, m.id, m.settled FROM walk w JOIN num m ON m.topic = w.topic AND m.n = w.n + 1)
SELECT id, topic, accepted FROM walk WHERE NOT settled""",
}
