"""Workflow runs: graph checks, readiness, attempts, timeouts, outcomes.

Run tables used here: ``workflows`` (id, status, created_at, timeout,
cancel_requested, dead_letter, ...), ``nodes`` (workflow_id, node_id,
depends_on, status, ...) and ``attempts`` (workflow_id, node_id, attempt_no,
status, started_at, finished_at).  Every rule that looks at the clock takes
``now`` as a timestamp column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsframe.functions.timing import backoff_seconds
from opsframe.operators.folds import Machine, fold
from opsframe.operators.ordered import ordered_columns
from opsframe.schemas import NODE_DONE, RUN_DONE, TRANSITIONS
from opsframe.session import cut_lineage

NODE = ["workflow_id", "node_id"]

# What nodes and attempts say went wrong.
NODE_TIMED_OUT = "node timed out"
ATTEMPT_FAILED = "attempt failed"
CANCELLED = "cancelled"
RECOVERED = "recovered_after_restart"
RUN_TIMED_OUT = "workflow timeout"



def _edges(nodes: DataFrame) -> DataFrame:
    return nodes.select(*NODE, F.explode("depends_on").alias("dep"))


# ------------------------------------------------------------------ graph checks


def dangling_dependencies(nodes: DataFrame) -> DataFrame:
    """Edges whose target is not a node of the same workflow."""
    targets = nodes.select("workflow_id", F.col("node_id").alias("dep"))
    return _edges(nodes).join(targets, ["workflow_id", "dep"], "left_anti").select(*NODE, "dep")


def duplicate_ids(nodes: DataFrame) -> DataFrame:
    """Node ids used more than once in a workflow."""
    return nodes.groupBy(*NODE).agg(F.count("*").alias("copies")).filter("copies > 1")


def dag_levels(nodes: DataFrame) -> DataFrame:
    """Level of each node; nodes on or behind a cycle get level -1.

    Nodes whose dependencies are all placed are peeled off round by round.
    Each round joins only the newest level with the edges that leave it.  The
    in-degree counts repeated dependencies while a placed node lowers it once,
    so a node that lists a dependency twice is never placed.
    """
    all_edges = _edges(nodes)
    edges = cut_lineage(all_edges.distinct())
    degree = all_edges.groupBy(*NODE).agg(F.count("*").alias("open"))
    waiting = cut_lineage(
        nodes.select(*NODE)
        .join(degree, NODE, "left")
        .select(*NODE, F.coalesce("open", F.lit(0)).alias("open"))
    )
    levels, depth = None, 0
    while True:
        front = waiting.filter("open = 0").select(*NODE)
        placed = front.withColumn("level", F.lit(depth).cast("bigint"))
        levels = placed if levels is None else levels.unionByName(placed)
        if depth % 20 == 19:  # keep the plan of a deep graph short
            levels = cut_lineage(levels)
        waiting = waiting.filter("open > 0")
        lowered = (
            edges.join(
                front.withColumnRenamed("node_id", "dep"), ["workflow_id", "dep"], "left_semi"
            )
            .groupBy(*NODE)
            .agg(F.count("*").alias("_less"))
        )
        waiting = cut_lineage(
            waiting.join(lowered, NODE, "left").select(
                *NODE, (F.col("open") - F.coalesce("_less", F.lit(0))).alias("open")
            )
        )
        depth += 1
        if waiting.filter("open = 0").limit(1).count() == 0:
            break
    stuck = waiting.select(*NODE, F.lit(-1).cast("bigint").alias("level"))
    return levels.unionByName(stuck)


def cyclic_workflows(nodes: DataFrame) -> DataFrame:
    """Workflows that contain a cycle, with the number of nodes never placed."""
    return (
        dag_levels(nodes).filter("level < 0").groupBy("workflow_id").agg(F.count("*").alias("stuck"))
    )


def illegal_transitions(log: DataFrame, order: Sequence[str]) -> DataFrame:
    """Moves (from, to) in a change log that the record's machine does not allow.

    ``log`` has (kind, record_id, status) and the ``order`` columns.
    """
    allowed = [
        f"{kind}:{a}>{b}"
        for kind, table in TRANSITIONS.items()
        for a, targets in table.items()
        for b in targets
    ]
    moved = ordered_columns(
        log, ["kind", "record_id"], list(order), previous={"from_status": ("status", None)}
    ).filter(F.col("from_status").isNotNull())
    move = F.concat("kind", F.lit(":"), "from_status", F.lit(">"), "status")
    return moved.filter(~move.isin(allowed)).withColumnRenamed("status", "to_status")


# -------------------------------------------------------------------- readiness


def open_runs(workflows: DataFrame) -> DataFrame:
    return workflows.filter(F.col("status").isin("pending", "running"))


def ready_nodes(
    nodes: DataFrame,
    workflows: DataFrame | None = None,
    now: Column | None = None,
    propagate_skips: bool = False,
) -> DataFrame:
    """Decision per pending node that is due: ready, wait, or skip with a reason.

    Looks one hop back: a failed or timed-out dependency skips the node, then a
    cancelled one, and all must have succeeded to be ready; an unknown
    dependency keeps it waiting.  A skipped dependency also keeps it waiting
    unless ``propagate_skips`` is set, which then counts it as failed.
    """
    due = nodes.filter(F.col("status") == "pending")
    if now is not None and "next_retry_at" in nodes.columns:
        due = due.filter(F.col("next_retry_at").isNull() | (now >= F.col("next_retry_at")))
    if workflows is not None:
        live = open_runs(workflows).filter(~F.col("cancel_requested"))
        due = due.join(live.select(F.col("id").alias("workflow_id")), "workflow_id", "left_semi")
    states = nodes.select(
        "workflow_id", F.col("node_id").alias("dep"), F.col("status").alias("dep_status")
    )
    bad = ["failed", "timed_out"] + (["skipped"] if propagate_skips else [])
    state = F.col("dep_status")
    seen = (
        _edges(due)
        .join(states, ["workflow_id", "dep"], "left")
        .groupBy(*NODE)
        .agg(
            F.bool_or(F.coalesce(state.isin(bad), F.lit(False))).alias("_failed"),
            F.bool_or(F.coalesce(state == "cancelled", F.lit(False))).alias("_cancelled"),
            F.bool_and(F.coalesce(state == "succeeded", F.lit(False))).alias("_done"),
        )
    )
    decision = (
        F.when(F.col("_failed"), "skip")
        .when(F.col("_cancelled"), "skip")
        .when(F.coalesce("_done", F.lit(True)), "ready")
        .otherwise("wait")
    )
    reason = (
        F.when(F.col("_failed"), "dependency failed")
        .when(F.col("_cancelled"), "dependency cancelled")
        .otherwise("")
    )
    return (
        due.join(seen, NODE, "left")
        .withColumn("decision", decision)
        .withColumn("reason", reason)
        .drop("_failed", "_cancelled", "_done")
    )


def dispatch_guard(candidates: DataFrame, attempts: DataFrame) -> DataFrame:
    """Candidates that have no running attempt yet."""
    running = attempts.filter(F.col("status") == "running").select(*NODE)
    return candidates.join(running, NODE, "left_anti")


def concurrency_admission(
    ready: DataFrame, nodes: DataFrame, order: Sequence[str] = ("node_id",)
) -> DataFrame:
    """Admit ready nodes in order while the workflow is below each one's limit.

    Dispatched and running nodes and those admitted before take a slot; event
    nodes finish at once and take none.  ``order`` names the columns of ``ready`` that nodes are
    walked by: their place in the definition for a workflow that is new, their id (the default) for one
    read back from storage, which keeps nodes sorted by id.  Equal places are walked by id.
    """
    order = [*order, *[c for c in ("node_id",) if c not in order]]
    active = (
        nodes.filter(F.col("status").isin("dispatched", "running"))
        .groupBy("workflow_id")
        .agg(F.count("*").alias("active"))
    )
    columns = ready.columns
    takes = (
        (F.coalesce("event_topic", F.lit("")) == "")
        if "event_topic" in columns
        else F.lit(True)
    )
    slots = ready.join(active, "workflow_id", "left").select(
        *NODE,
        F.coalesce("active", F.lit(0)).alias("active"),
        F.col("max_concurrency").cast("bigint").alias("max_concurrency"),
        takes.alias("takes_slot"),
        *[c for c in order if c != "node_id"],
    )

    def step(used, row):
        limit, takes_slot = row[3], row[4]
        admitted = used < limit
        return used + (1 if admitted and takes_slot else 0), (admitted,)

    machine = Machine(start=lambda row: row[2], step=step, outputs=[("admitted", "boolean")])
    return fold(slots, ["workflow_id"], order, machine, sized_by=nodes)


def pick_slot(ready: DataFrame, leases: DataFrame, now: Column) -> DataFrame:
    """Oldest live lease of each node's workload; without one the node waits."""
    slot = (
        leases.filter((F.col("state") == "active") & (F.col("expires_at") > now))
        .groupBy("workload_id")
        .agg(F.min_by("id", F.struct("created_at", "id")).alias("lease_id"))
    )
    return ready.join(slot, "workload_id", "left").withColumn(
        "dispatched", F.col("lease_id").isNotNull()
    )


# --------------------------------------------------------------------- attempts


def complete_attempts(
    attempts: DataFrame, reports: DataFrame, workflows: DataFrame | None = None
) -> DataFrame:
    """Apply completion reports (ok, timed_out, error, at) to running attempts.

    The first report of a running attempt counts; later ones and reports on
    attempts that no longer run are ignored.
    """
    key = [*NODE, "attempt_no"]
    before = _errors_of(attempts)
    first = reports.groupBy(*key).agg(
        F.min_by(F.struct("ok", "timed_out", "error", "at"), F.struct("at", "ok")).alias("r")
    )
    joined = attempts.join(first, key, "left")
    joined, cancelled = _with_cancels(joined, workflows)
    hit = (F.col("status") == "running") & F.col("r").isNotNull()
    target = (
        F.when(cancelled, "cancelled")
        .when(F.col("r.timed_out"), "timed_out")
        .when(F.col("r.ok"), "succeeded")
        .otherwise("failed")
    )
    return joined.select(
        *[c for c in attempts.columns if c not in ("status", "finished_at", "error")],
        F.when(hit, target).otherwise(F.col("status")).alias("status"),
        F.when(hit, F.col("r.at")).otherwise(F.col("finished_at")).alias("finished_at"),
        F.when(hit, F.col("r.error")).otherwise(before).alias("error"),
    )


def _errors_of(attempts: DataFrame) -> Column:
    """What an attempt says went wrong; null if the table does not tell."""
    return F.col("error") if "error" in attempts.columns else F.lit(None).cast("string")


def _with_cancels(attempts: DataFrame, workflows: DataFrame | None) -> tuple[DataFrame, Column]:
    """``attempts`` and whether their run is asked to stop."""
    if workflows is None:
        return attempts, F.lit(False)
    stop = workflows.select(
        F.col("id").alias("workflow_id"), F.col("cancel_requested").alias("_stop")
    )
    return attempts.join(stop, "workflow_id", "left"), F.coalesce("_stop", F.lit(False))


def late_reports(attempts: DataFrame, reports: DataFrame) -> DataFrame:
    """Reports that change nothing because their attempt is not running."""
    running = attempts.filter(F.col("status") == "running")
    return reports.join(running, [*NODE, "attempt_no"], "left_anti")


def fold_attempts(
    nodes: DataFrame, attempts: DataFrame, jitter: float = 0.0, unit: Column | float = 0.0
) -> DataFrame:
    """State of each attempted node after its latest attempt.

    A failure or timeout returns to pending with a backoff while the attempt
    number is at most ``retry_max`` (so ``retry_max + 1`` tries in all).  The
    attempt's own error is kept; without one a fixed text tells what happened.
    """
    told = F.struct("attempt_no", "status", "finished_at", _errors_of(attempts).alias("error"))
    latest = attempts.groupBy(*NODE).agg(F.max_by(told, "attempt_no").alias("a"))
    base = F.col("backoff_base") if "backoff_base" in nodes.columns else 1.0
    cap = F.col("backoff_max") if "backoff_max" in nodes.columns else 60.0
    tries, state = F.col("a.attempt_no"), F.col("a.status")
    lost = state.isin("failed", "timed_out")
    again = lost & (tries <= F.col("retry_max"))
    delay = backoff_seconds(tries, base, cap, jitter, unit)
    resume = F.timestamp_micros(
        F.unix_micros("a.finished_at") + F.round(delay * 1_000_000).cast("bigint")
    )
    return nodes.join(latest, NODE).select(
        *NODE,
        tries.alias("attempts"),
        F.when(again, "pending")
        .when(state == "running", "dispatched")
        .otherwise(state)
        .alias("status"),
        F.when(again, resume).alias("next_retry_at"),
        F.when(again | (state == "running"), F.lit(None))
        .otherwise(F.col("a.finished_at"))
        .alias("finished_at"),
        F.when(lost & (F.col("a.error") != ""), F.col("a.error"))
        .when(state == "timed_out", NODE_TIMED_OUT)
        .when(state == "failed", ATTEMPT_FAILED)
        .when(state == "cancelled", CANCELLED)
        .otherwise("")
        .alias("error"),
    )


def recover_orphans(
    attempts: DataFrame, now: Column, workflows: DataFrame | None = None
) -> DataFrame:
    """After a restart every running attempt counts as failed, or as cancelled if its run is to stop.

    Other attempts keep their state and their error.
    """
    orphan = F.col("status") == "running"
    before = _errors_of(attempts)
    joined, cancelled = _with_cancels(attempts, workflows)
    return joined.select(
        *[c for c in attempts.columns if c not in ("status", "finished_at", "error")],
        F.when(orphan & cancelled, "cancelled")
        .when(orphan, "failed")
        .otherwise(F.col("status"))
        .alias("status"),
        F.when(orphan, now).otherwise(F.col("finished_at")).alias("finished_at"),
        F.when(orphan, RECOVERED).otherwise(before).alias("error"),
    )


# ---------------------------------------------------------------------- outcome


def workflow_outcome(workflows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Outcome of each run that is not finished yet, or ``open``.

    Once every node is done: cancelled beats timed out beats failed beats
    succeeded.  A run whose other nodes succeeded but has skipped ones stays open.
    """
    state = F.col("status")
    seen = nodes.groupBy(F.col("workflow_id").alias("id")).agg(
        F.bool_and(state.isin(NODE_DONE)).alias("_all"),
        F.bool_or(state == "cancelled").alias("_cancelled"),
        F.bool_or(state == "timed_out").alias("_timed_out"),
        F.bool_or(state == "failed").alias("_failed"),
        F.bool_and(state == "succeeded").alias("_succeeded"),
        F.count("*").alias("nodes"),
    )
    outcome = (
        F.when(~F.col("_all"), "open")
        .when(F.col("cancel_requested") | F.col("_cancelled"), "cancelled")
        .when(F.col("_timed_out"), "timed_out")
        .when(F.col("_failed"), "failed")
        .when(F.col("_succeeded"), "succeeded")
        .otherwise("open")
    )
    return (
        workflows.filter(~F.col("status").isin(RUN_DONE))
        .join(seen, "id")
        .withColumn("outcome", outcome)
        .withColumn("dead_lettered", (F.col("outcome") == "failed") & F.col("dead_letter"))
        .select(
            "id",
            *[c for c in ("name", "namespace") if c in workflows.columns],
            "outcome",
            "dead_lettered",
            "nodes",
        )
    )


# Fixed value: topic that announces finished runs.
FINISHED_TOPIC = "workflow.finished"


def outcome_events(outcomes: DataFrame) -> DataFrame:
    """One message per finished run, ready to be partitioned and numbered."""
    payload = F.to_json(
        F.struct(
            F.col("id").alias("workflow_id"), "name", "namespace", "outcome", "nodes"
        )
    )
    return outcomes.filter(F.col("outcome") != "open").select(
        F.lit(FINISHED_TOPIC).alias("topic"),
        F.col("id").alias("key"),
        payload.alias("payload"),
        F.lit(1).alias("schema_version"),
    )


# --------------------------------------------------------------------- commands


def seconds_after(moment: Column | str, seconds: Column) -> Column:
    moment = F.col(moment) if isinstance(moment, str) else moment
    return F.timestamp_micros(
        F.unix_micros(moment) + F.round(seconds * 1_000_000).cast("bigint")
    )


def timed_out_runs(workflows: DataFrame, now: Column) -> DataFrame:
    """Runs past their timeout; a missing or zero timeout never fires."""
    return open_runs(workflows).filter(
        (F.coalesce("timeout", F.lit(0.0)) > 0)
        & (now > seconds_after("created_at", F.col("timeout")))
    )


def timed_out_attempts(
    attempts: DataFrame, nodes: DataFrame, now: Column, workflows: DataFrame | None = None
) -> DataFrame:
    """Running attempts past the timeout of their node.

    With ``workflows``, attempts of runs that time out themselves are left out:
    those are stopped first, by ``time_out_runs``.
    """
    limits = nodes.filter(F.col("timeout").isNotNull()).select(*NODE, "timeout")
    running = attempts.filter(F.col("status") == "running")
    if workflows is not None:
        over = timed_out_runs(workflows, now).select(F.col("id").alias("workflow_id"))
        running = running.join(over, "workflow_id", "left_anti")
    return (
        running.join(limits, NODE)
        .filter(now > seconds_after("started_at", F.col("timeout")))
    )


def time_out_runs(
    workflows: DataFrame, nodes: DataFrame, attempts: DataFrame, now: Column
) -> tuple[DataFrame, DataFrame]:
    """Changed nodes and attempts of the runs that time out at ``now``."""
    over = timed_out_runs(workflows, now).select(F.col("id").alias("workflow_id"))
    skipped = (
        nodes.filter(F.col("status").isin("pending", "dispatched"))
        .join(over, "workflow_id", "left_semi")
        .select(*NODE, F.lit("skipped").alias("status"), F.lit(RUN_TIMED_OUT).alias("error"))
    )
    stopped = (
        attempts.filter(F.col("status") == "running")
        .join(over, "workflow_id", "left_semi")
        .select(
            *NODE,
            "attempt_no",
            F.lit("timed_out").alias("status"),
            F.lit(RUN_TIMED_OUT).alias("error"),
        )
    )
    return skipped, stopped


def classify_cancels(requests: DataFrame, workflows: DataFrame) -> DataFrame:
    """Verdict per cancel request: ok, conflict (already finished) or not_found."""
    states = workflows.select(F.col("id").alias("workflow_id"), F.col("status").alias("_s"))
    verdict = (
        F.when(F.col("_s").isNull(), "not_found")
        .when(F.col("_s").isin(RUN_DONE), "conflict")
        .otherwise("ok")
    )
    return (
        requests.join(states, "workflow_id", "left").withColumn("verdict", verdict).drop("_s")
    )


def cancel_runs(
    requests: DataFrame, workflows: DataFrame, nodes: DataFrame, attempts: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Changed nodes and attempts of the runs whose cancellation is accepted."""
    hit = classify_cancels(requests, workflows).filter("verdict = 'ok'").select("workflow_id")
    stopped_nodes = (
        nodes.filter(F.col("status").isin("pending", "dispatched", "running"))
        .join(hit, "workflow_id", "left_semi")
        .select(
            *NODE,
            F.when(F.col("status") == "running", "running").otherwise("cancelled").alias("status"),
            F.when(F.col("status") == "running", "cancel requested")
            .otherwise("cancelled")
            .alias("error"),
        )
    )
    stopped = (
        attempts.filter(F.col("status") == "running")
        .join(hit, "workflow_id", "left_semi")
        .select(
            *NODE,
            "attempt_no",
            F.lit("cancelled").alias("status"),
            F.lit("cancelled").alias("error"),
        )
    )
    return stopped_nodes, stopped


def retry_nodes(requests: DataFrame, workflows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Verdict and new status per retry request (workflow_id, node_id)."""
    known = workflows.select(F.col("id").alias("workflow_id"), F.lit(True).alias("_run"))
    states = nodes.select(*NODE, F.col("status").alias("_s"))
    verdict = (
        F.when(F.col("_run").isNull() | F.col("_s").isNull(), "not_found")
        .when(F.col("_s").isin("failed", "timed_out"), "ok")
        .otherwise("conflict")
    )
    return (
        requests.join(known, "workflow_id", "left")
        .join(states, NODE, "left")
        .withColumn("verdict", verdict)
        .withColumn("node_status", F.when(F.col("verdict") == "ok", "pending").otherwise(F.col("_s")))
        .withColumn("run_status", F.when(F.col("verdict") == "ok", "running"))
        .drop("_run", "_s")
    )


def clone_runs(
    templates: DataFrame, nodes: DataFrame, fires: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Fresh runs, one per (template, fire time), and their reset nodes.

    ``fires`` has (template_id, fire_at).
    """
    run_id = F.concat(
        "template_id", F.lit("."), F.floor(F.unix_micros("fire_at") / 1000).cast("string")
    )
    fired = fires.withColumn("run_id", run_id)
    epoch = F.coalesce("epoch", F.lit(1)) if "epoch" in templates.columns else F.lit(1)
    runs = fired.join(templates.withColumnRenamed("id", "template_id"), "template_id").select(
        F.col("run_id").alias("id"),
        "template_id",
        F.lit("pending").alias("status"),
        *[c for c in ("name", "namespace", "timeout", "dead_letter", "created_at") if c in templates.columns],
        F.lit(False).alias("cancel_requested"),
        F.lit(None).cast("string").alias("schedule"),
        (epoch + 1).cast("bigint").alias("epoch"),
    )
    fresh = (
        fired.select("template_id", "run_id")
        .join(nodes.withColumnRenamed("workflow_id", "template_id"), "template_id")
        .withColumn("workflow_id", F.col("run_id"))
        .withColumn("status", F.lit("pending"))
        .withColumn("attempts", F.lit(0).cast("bigint"))
        .drop("template_id", "run_id", "next_retry_at", "error", "finished_at", "started_at")
    )
    return runs, fresh


