"""Several operators as one job: publishing, a workflow tick, from intent to plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsframe.functions.keys import event_partition, task_key
from opsframe.operators import events as ev
from opsframe.operators import intent as it
from opsframe.operators import workflow as wf


@dataclass(frozen=True)
class Published:
    accepted: DataFrame
    rejected: DataFrame


def publish(
    messages: DataFrame,
    partitions: int = 4,
    max_lag: int = 1000,
    opening_lag: DataFrame | None = None,
    existing: DataFrame | None = None,
    max_payload: int = 1024 * 1024,
) -> Published:
    """Check, partition, admit and number messages (id, topic, key, payload, created_at)."""
    checked = ev.validate_event(messages, max_payload)
    valid = checked.filter(F.size("errors") == 0).drop("errors")
    placed = valid.withColumn("partition", event_partition(F.col("key"), partitions))
    admitted = ev.admit_events(placed, max_lag, opening_lag=opening_lag)
    numbered = ev.assign_sequence(
        admitted.filter("accepted").drop("accepted"), existing=existing
    ).withColumn("status", F.lit("pending"))
    refused = checked.filter(F.size("errors") > 0).select(
        "id", "topic", F.get("errors", F.lit(0)).alias("reason")
    )
    delayed = admitted.filter("not accepted").select(
        "id", "topic", F.format_string("topic '%s' lag exceeds " + str(max_lag), "topic").alias("reason")
    )
    return Published(numbered, refused.unionByName(delayed))


@dataclass(frozen=True)
class Tick:
    skipped: DataFrame  # nodes that will not run, with the reason
    dispatched: DataFrame  # workload nodes that start, with their lease
    fired: DataFrame  # event nodes, done once their message is published
    waiting: DataFrame  # ready nodes held back by limits or missing leases


def tick(
    workflows: DataFrame, nodes: DataFrame, attempts: DataFrame, leases: DataFrame, now: Column
) -> Tick:
    """One pass over all open runs at ``now``.

    Runs past their timeout stop; due nodes are decided from one snapshot of their
    dependencies, kept to the concurrency limits, and given the oldest live
    lease.  Run it again for nodes that a fired event node has just released.
    """
    over = wf.timed_out_runs(workflows, now).select("id")
    live = workflows.join(over, "id", "left_anti")
    decided = wf.ready_nodes(nodes, live, now)
    stopped, _ = wf.time_out_runs(workflows, nodes, attempts, now)
    skipped = (
        decided.filter("decision = 'skip'")
        .select(*wf.NODE, "reason")
        .unionByName(stopped.select(*wf.NODE, F.col("error").alias("reason")))
    )
    ready = wf.dispatch_guard(decided.filter("decision = 'ready'"), attempts)
    admitted = wf.concurrency_admission(ready, nodes).select(*wf.NODE, "admitted")
    known = ready.join(admitted, wf.NODE)
    is_event = (
        F.coalesce("event_topic", F.lit("")) != "" if "event_topic" in nodes.columns else F.lit(False)
    )
    slots = wf.pick_slot(known.filter("admitted").filter(~is_event), leases, now)
    held = known.filter("not admitted").select(*wf.NODE, F.lit("concurrency limit").alias("reason"))
    starved = slots.filter("not dispatched").select(*wf.NODE, F.lit("no lease").alias("reason"))
    return Tick(
        skipped=skipped,
        dispatched=slots.filter("dispatched").select(*wf.NODE, "workload_id", "lease_id"),
        fired=known.filter("admitted").filter(is_event).select(*wf.NODE),
        waiting=held.unionByName(starved),
    )


@dataclass(frozen=True)
class Plans:
    candidates: DataFrame
    runs: DataFrame
    nodes: DataFrame


def plan_tasks(
    tasks: DataFrame,
    resources: DataFrame,
    key_prefix: str,
    name_prefix: str,
    topic_prefix: str,
    network: bool = True,
) -> Plans:
    """Tag tasks, drop the blocked ones, rank resources and lay out their workflows.

    Tasks with the same intent and capabilities share one run under one key.
    """
    tagged = tasks.withColumn("capabilities", it.tag_capabilities(F.col("intent")))
    allowed = it.policy_gate(tagged).filter("allowed")
    keyed = allowed.withColumn("run_key", task_key(F.col("intent"), F.col("capabilities"), key_prefix))
    distinct = keyed.groupBy("run_key").agg(
        F.min(F.struct("task_id", "intent", "capabilities")).alias("t")
    ).select("run_key", "t.*")
    runs, nodes = it.expand_plan(distinct, name_prefix, topic_prefix)
    return Plans(
        candidates=it.top_candidates(allowed, resources, network=network),
        runs=distinct.select("task_id", "run_key").join(runs, "task_id"),
        nodes=nodes,
    )
