"""Replica decisions from metric samples."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsframe.operators.folds import Machine, fold

# A missing upper bound of a metric.
NO_LIMIT = float("inf")


def dominant_demand(workloads: DataFrame, targets: DataFrame, latest: DataFrame) -> DataFrame:
    """Replicas asked for by the most demanding metric of each workload.

    ``targets`` has (workload_id, metric, target, low, high), ``latest`` the newest
    (workload_id, metric, value).  Metrics without sample or with target <= 0
    do not count; without any, ``demand`` is null.
    """
    asked = targets.filter(F.col("target") > 0).join(latest, ["workload_id", "metric"])
    sized = asked.join(
        workloads.select(F.col("id").alias("workload_id"), "desired_replicas"), "workload_id"
    )
    wanted = F.ceil(F.col("desired_replicas") * F.col("value") / F.col("target"))
    bounded = F.least(
        F.greatest(wanted.cast("double"), F.coalesce("low", F.lit(0.0))),
        F.coalesce("high", F.lit(NO_LIMIT)),
    )
    most = sized.groupBy(F.col("workload_id").alias("id")).agg(F.max(bounded).alias("_most"))
    demand = F.when(
        F.col("_most").isNotNull(),
        F.least(
            F.greatest(F.col("_most"), F.col("min_replicas").cast("double")),
            F.col("max_replicas").cast("double"),
        ),
    )
    return workloads.join(most, "id", "left").select(
        "id", "desired_replicas", demand.cast("bigint").alias("demand")
    )


@dataclass(frozen=True)
class TargetPolicy:
    """Default policy: come as near to the dominant metric's demand as the room at this moment allows.

    Times are seconds.  Called as ``policy(current, low, high, measured, targets, now,
    last_action, last_up)`` it gives the new replica count or None.
    """

    deadband: float = 0.10
    cooldown: float = 60.0
    protect_after: float = 180.0
    step: int | None = None

    def demand(self, current, low, high, measured, targets) -> int | None:
        """Replicas the most demanding usable metric asks for, within the workload's bounds."""
        usable = {m: t for m, t in targets.items() if t[0] > 0 and m in measured}
        asked = (
            _within(math.ceil(current * measured[m] / goal), least, most)
            for m, (goal, least, most) in usable.items()
        )
        top = max(asked, default=None)
        return None if top is None else int(_within(top, low, high))

    def room(self, current, low, high, idle, risen) -> tuple[float, float]:
        """Least and most replicas that may follow ``current``, ``idle`` and ``risen`` seconds after its last
        change and its last rise: one step either way within the bounds, nothing below after a rise, and
        nothing but ``current`` after a change."""
        if idle < self.cooldown:
            return current, current
        reach = NO_LIMIT if self.step is None else self.step
        least, most = _within(current - reach, low, high), _within(current + reach, low, high)
        return (current if risen < self.protect_after else least), most

    def __call__(self, current, low, high, measured, targets, now, last_action, last_up):
        goal = self.demand(current, low, high, measured, targets)
        if goal is None or abs(goal - current) <= self.deadband * max(1.0, current):
            return None
        least, most = self.room(current, low, high, now - last_action, now - last_up if last_up else NO_LIMIT)
        new = int(_within(goal, least, most)) if least <= most else current
        return None if new == current else new


def _within(value, low, high):
    return max(low, min(value, high)) if low <= high else high


def target_policy(**settings) -> TargetPolicy:
    return TargetPolicy(**settings)


def latest_per_tick(samples: DataFrame, tick_seconds: int) -> DataFrame:
    """Newest value per (workload, metric, tick); one mergeable aggregate.

    The scaler looks once per tick, so samples overtaken within a tick never
    matter.  This bounds the replay of one workload by time, not by its samples.
    """
    width = tick_seconds * 1_000_000
    tick = F.floor(F.unix_micros("ts") / width) + 1
    return samples.groupBy("workload_id", "metric", tick.cast("bigint").alias("tick")).agg(
        F.max_by("value", F.struct("ts", "ord")).alias("value")
    )


def scaler_machine(decide: Callable, targets: dict, tick_seconds: float) -> Machine:
    """Replays one workload: (workload_id, tick, metric, value, closes, start_replicas, low, high).

    The state is [replicas, last change, last change upwards, newest value per
    metric]; a row that closes its tick asks the policy.
    """

    def step(state, row):
        current, last_action, last_up, measured = state
        _, tick, metric, value, closes, _, low, high = row
        measured = {**measured, metric: value}
        if not closes:
            return [current, last_action, last_up, measured], (False, current, current)
        now = float(tick * tick_seconds)
        new = decide(current, low, high, measured, targets, now, last_action, last_up)
        if new is None:
            return [current, last_action, last_up, measured], (False, current, current)
        up = now if new > current else last_up
        return [new, now, up, measured], (True, current, new)

    return Machine(
        start=lambda row: [row[5], 0.0, 0.0, {}],
        step=step,
        outputs=[("decided", "boolean"), ("from_replicas", "long"), ("to_replicas", "long")],
    )


def replica_bounds(workloads: DataFrame) -> DataFrame:
    return workloads.filter(F.col("status") == "active").select(
        F.col("id").alias("workload_id"),
        F.col("desired_replicas").cast("bigint").alias("start_replicas"),
        F.col("min_replicas").cast("bigint").alias("low"),
        F.col("max_replicas").cast("bigint").alias("high"),
    )


def autoscale_decisions(
    workloads: DataFrame,
    samples: DataFrame,
    targets: dict[str, tuple[float, float, float]],
    tick_seconds: int = 1,
    policy: Callable | None = None,
) -> DataFrame:
    """Replay the scaler: one row per (workload, tick, metric) with the decision.

    At the end of each tick with new samples the policy sees the newest value
    of every metric so far.  ``decided`` marks ticks that change the replica count
    (``from_replicas`` to ``to_replicas``); it is set on the last metric of the tick.
    """
    decide = policy or target_policy()
    ticks = latest_per_tick(
        samples.filter(F.col("metric").isin(list(targets))), tick_seconds
    )
    # The alphabetically last metric of a tick closes it.
    closing = ticks.groupBy("workload_id", "tick").agg(F.max("metric").alias("_closing"))
    rows = (
        ticks.join(closing, ["workload_id", "tick"])
        .join(replica_bounds(workloads), "workload_id")
        .select(
            "workload_id",
            "tick",
            "metric",
            "value",
            (F.col("metric") == F.col("_closing")).alias("closes"),
            "start_replicas",
            "low",
            "high",
        )
    )

    machine = scaler_machine(decide, targets, tick_seconds)
    return fold(rows, ["workload_id"], ["tick", "metric"], machine)
