"""Streaming queries: each runs over all available input and reads its result back."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from opsframe.catalog import compute as compute_catalog
from opsframe.catalog import control as control_catalog
from opsframe.catalog import events as event_catalog
from opsframe.operators import control as ct
from opsframe.operators import events as ev
from opsframe.operators.folds import Machine
from opsframe.operators.scaling import target_policy
from opsframe.schemas import TABLES
from opsframe.session import scratch_folder
from opsframe.streaming import consume as cs
from opsframe.streaming import stateful as st


def event_stream(spark, d):
    # The pattern matches one name, be it a single file or a folder of files; a folder comes in parts.
    files = spark.readStream.schema(TABLES["events"]).option("maxBytesPerTrigger", str(1 << 30))
    return files.parquet(f"{d}/events.parque[t]")


def refuse_tens(payload: str) -> None:
    """A handler that cannot digest every tenth payload."""
    if json.loads(payload)["k"] % 10 == 0:
        raise ValueError("poison")


def _messages(events):
    return events.selectExpr("event_id as id", "event_type as topic", "props as payload")


def consume_stream(spark, d):
    folder = scratch_folder(spark, "consume")
    query = (
        cs.consume_stream(_messages(event_stream(spark, d)), folder, refuse_tens, max_attempts=3)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return cs.settled(spark, folder).select("id", "topic", "ok", "tries", "error")


def apply_handler(spark, d):
    events = spark.read.schema(TABLES["events"]).parquet(f"{d}/events.parquet")
    messages = _messages(events).withColumn("tries", F.lit(0).cast("bigint"))
    return cs.apply_handler(messages, refuse_tens).select("id", "ok", "error")


def maintain_lag_gauge(spark, d):
    changes = event_stream(spark, d).select(
        F.col("event_type").alias("topic"),
        F.explode(
            F.expr("if(event_id % 5 = 0 or event_id % 23 = 0, array(1L, -1L), array(1L))")
        ).alias("change"),
    )
    return cs.run_to_table(cs.lag_gauge(changes), scratch_folder(spark, "gauge"))


def dedup_stream(spark, d):
    requests = event_stream(spark, d).selectExpr(
        "event_id as id",
        "unix_micros(ts) as ts_us",
        "case when event_id % 9 <> 0 then concat(user_id, ':', cast(floor(value / 20) as int)) end as idem_key",
        "sha2(event_type, 256) as digest",
    )
    told = cs.run_to_files(st.dedup_stream(requests, ttl_seconds=None), scratch_folder(spark, "dedup"))
    return told.select("id", "kind", "answer_id")


def rate_limit_stream(spark, d):
    calls = event_stream(spark, d).selectExpr(
        "cast(user_id as string) as user", "unix_micros(ts) as at_us", "event_id as id"
    )
    width = 86_400_000_000
    machine = Machine(
        start=lambda row: None,
        step=ct.window_step(2, width),
        outputs=[("allowed", "boolean"), ("retry_after_us", "long")],
    )
    told = cs.run_to_files(
        st.fold_stream(calls, ["user"], ["at_us", "id"], machine), scratch_folder(spark, "limit")
    )
    return told.select("id", "allowed", "retry_after_us")


def breaker_stream(spark, d):
    calls = event_stream(spark, d).selectExpr(
        "cast(user_id % 5 as string) as name", "unix_micros(ts) as at_us", "event_id as id",
        "event_type <> 'error' as ok",
    )
    machine = Machine(
        start=lambda row: ["closed", [], 0],
        step=ct.breaker_step(3, 43_200_000_000, 3_600_000_000),
        outputs=[("allowed", "boolean"), ("state", "string")],
    )
    told = cs.run_to_files(
        st.fold_stream(calls, ["name"], ["at_us", "id"], machine), scratch_folder(spark, "breaker")
    )
    return told.select("id", "allowed", "state")


def fold_acks_stream(spark, d):
    """Final status per event from the ack-by-ack stream."""
    acks = (
        event_stream(spark, d)
        .select("event_id", "ts", F.explode(F.expr("sequence(1, cast(1 + event_id % 6 as int))")).alias("n"))
        .selectExpr(
            "event_id",
            "unix_micros(ts) + n * 30000000 as at_us",
            "concat('g', event_id % 2) as grp",
            "n as ack_no",
            "(n = 1 + event_id % 6 and event_id % 4 <> 0) as ok",
            "concat('err-', event_id % 3) as error",
        )
    )
    told = cs.run_to_files(
        st.fold_stream(acks, ["event_id"], ["at_us", "grp", "ack_no"], ev.ack_machine(), groups=4096),
        scratch_folder(spark, "acks"),
    )
    return told.groupBy("event_id").agg(
        F.max_by("status", F.struct("at_us", "grp", "ack_no")).alias("status"),
        F.bool_or("dead_letter").alias("dead_letter"),
    )


def autoscale_stream(spark, d):
    samples = event_stream(spark, d).selectExpr(
        "cast(user_id as string) as workload_id",
        "case event_type when 'click' then 'cpu' when 'view' then 'memory'"
        " when 'error' then 'queue' else 'throughput' end as metric",
        "ts",
        "value",
    )
    moves = st.autoscale_stream(
        samples, compute_catalog._scaled_workloads(spark, d), compute_catalog.TARGETS,
        target_policy(cooldown=6 * 3600.0, protect_after=24 * 3600.0),
    )
    told = cs.run_to_files(moves, scratch_folder(spark, "scale"))
    return told.filter("decided").select("workload_id", "tick", "from_replicas", "to_replicas")


def stall_stream(spark, d):
    """Silences of users for more than a day, as they are noticed."""
    beats = event_stream(spark, d).selectExpr("cast(user_id as string) as loop", "ts")
    stalls = st.stall_stream(beats, {}, "0 seconds", stall_seconds=86_400.0)
    return cs.run_to_files(stalls, scratch_folder(spark, "stall"))


def timeout_stream(spark, d):
    """Attempts of which no completion arrives in time: every third is never closed, some end late."""
    changes = event_stream(spark, d).select(
        F.col("event_id").cast("string").alias("attempt_id"),
        F.col("ts").alias("started"),
        F.explode(
            F.when(F.col("event_id") % 3 == 0, F.array(F.lit(True))).otherwise(
                F.array(F.lit(True), F.lit(False))
            )
        ).alias("running"),
        F.lit(3_600_000).cast("bigint").alias("timeout_ms"),
    )
    # an end comes half an hour after its start, of every fifth attempt two hours after it
    late = F.when(F.col("attempt_id").cast("bigint") % 5 == 0, 7200).otherwise(1800).cast("bigint")
    moment = F.timestamp_micros(F.unix_micros("started") + F.when(F.col("running"), 0).otherwise(late * 1_000_000))
    changes = changes.withColumn("ts", moment).drop("started")
    return cs.run_to_files(st.timeout_stream(changes, "0 seconds"), scratch_folder(spark, "timeout"))


QUERIES = {
    "consume_stream": consume_stream,
    "apply_handler": apply_handler,
    "maintain_lag_gauge": maintain_lag_gauge,
    "dedup_stream": dedup_stream,
    "rate_limit_stream": rate_limit_stream,
    "breaker_stream": breaker_stream,
    "fold_acks_stream": fold_acks_stream,
    "autoscale_stream": autoscale_stream,
    "stall_stream": stall_stream,
    "sweep_timeouts_stream": timeout_stream,
}

_K = "CAST(json_extract(props, '$.k') AS BIGINT) % 10 = 0"
ORACLES = {
    "consume_stream": f"""SELECT event_id AS id, event_type AS topic, NOT ({_K}) AS ok, CAST(CASE WHEN {_K} THEN 3 ELSE 1 END AS BIGINT) AS tries,
 CASE WHEN {_K} THEN 'poison' ELSE '' END AS error FROM events""",
    "apply_handler": f"SELECT event_id AS id, NOT ({_K}) AS ok, CASE WHEN {_K} THEN 'poison' ELSE '' END AS error FROM events",
    "maintain_lag_gauge": """SELECT event_type AS topic, CAST(count(*) FILTER (event_id % 5 <> 0 AND event_id % 23 <> 0) AS BIGINT) AS pending
 FROM events GROUP BY event_type""",
    "dedup_stream": control_catalog.ORACLES["idempotency_classify"],
    "rate_limit_stream": control_catalog.ORACLES["rate_limit"],
    "breaker_stream": control_catalog.ORACLES["breaker_states"],
    "fold_acks_stream": f"""WITH {event_catalog._ACK_IDX}
SELECT event_id, CASE WHEN dead THEN 'dead' WHEN ok_at IS NOT NULL THEN 'delivered' ELSE 'pending' END AS status, dead AS dead_letter FROM final""",
    # As in the batch form, with every sample a tick of its own.
    "autoscale_stream": compute_catalog.ORACLES["autoscale_decisions"]
    .replace("/ 60000000) AS BIGINT) + 1", "/ 1) AS BIGINT)")
    .replace("tick2 * 60", "tick2 / 1000000.0")
    .replace("CAST(0 AS BIGINT) AS act, CAST(0 AS BIGINT) AS up", "CAST(0 AS DOUBLE) AS act, CAST(0 AS DOUBLE) AS up"),
    "stall_stream": """WITH l AS (SELECT CAST(user_id AS VARCHAR) AS loop, (epoch_us(ts) // 1000) AS last_ms,
 lead(epoch_us(ts) // 1000) OVER (PARTITION BY user_id ORDER BY ts) AS next_ms FROM events)
SELECT loop, last_ms, CAST(86400000 AS BIGINT) AS limit_ms FROM l WHERE next_ms - last_ms > 86400000
 OR next_ms IS NULL AND last_ms + 86400001 < (SELECT max((epoch_us(ts) // 1000)) FROM events)""",
    "sweep_timeouts_stream": """SELECT CAST(event_id AS VARCHAR) AS attempt_id, (epoch_us(ts) // 1000) + 3600000 AS due_ms FROM events
 WHERE CASE WHEN event_id % 3 = 0 THEN (epoch_us(ts) // 1000) + 3600001 < (SELECT max((epoch_us(ts) // 1000)
  + CASE WHEN event_id % 3 = 0 THEN 0 WHEN event_id % 5 = 0 THEN 7200000 ELSE 1800000 END) FROM events) ELSE event_id % 5 = 0 END""",
}
