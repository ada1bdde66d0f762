"""Structured Streaming twins of the ordered folds.

A batch ``Machine`` runs unchanged: its state lives in the state store between
micro-batches and the rows of a micro-batch are sorted per key before they are
stepped through, so one pass over a file source gives the batch result.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupStateTimeout

from opsframe.operators.folds import Machine
from opsframe.operators.scaling import replica_bounds, scaler_machine, target_policy


#: Rows stepped through at a time, so that only plain columns of a key's micro-batch are held as a whole.
_SLICE = 20_000


def _machine_runner(machine: Machine, keys: list, order: list, columns: list, ttl_ms: int | None, grouped: bool):
    names = columns + [n for n, _ in machine.outputs]
    sent = columns if grouped else columns[len(keys) :]
    by = [*keys, *order] if grouped else order

    def run(key, batches, held):
        if held.hasTimedOut:  # idle for longer than the key is to be remembered
            held.remove()
            return
        pdf = pd.concat([part[sent] for part in batches], ignore_index=True)
        place = pdf[by].sort_values(by).index.to_numpy()
        body = json.loads(held.get[0]) if held.exists else None
        states = {} if body is None else {tuple(k): s for k, s in body} if grouped else {(): body}
        current = None
        for start in range(0, len(place), _SLICE):
            out = []
            for row in pdf.take(place[start : start + _SLICE]).astype(object).itertuples(index=False, name=None):
                if grouped:
                    own = tuple(None if v != v else v for v in row[: len(keys)])
                else:
                    own, row = (), key + row
                if own != current:
                    if current is not None:
                        states[current] = state
                    current = own
                    state = states[own] if own in states else machine.start(row)
                state, result = machine.step(state, row)
                out.append(row + tuple(result))
            yield pd.DataFrame(out, columns=names)
        states[current] = state
        held.update((json.dumps(list(states.items()) if grouped else state),))
        if ttl_ms is not None:
            held.setTimeoutDuration(ttl_ms)

    return run


def _group(keys: Sequence[str], groups: int):
    return F.pmod(F.xxhash64(*keys), F.lit(groups))


def fold_stream(
    stream: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    machine: Machine,
    ttl_seconds: int | None = None,
    groups: int | None = None,
) -> DataFrame:
    """Streaming form of ``fold``; with ``ttl_seconds`` idle keys are forgotten.

    Forgetting follows the wall clock, so a stream with ``ttl_seconds`` wants a
    processing-time trigger: under ``availableNow`` it would wait for the clock.

    With ``groups`` the states of all keys with one hash are kept as one value, so many keys with few rows each
    share the cost of a call.  A micro-batch then rewrites the values of the groups it touches, so it wants large triggers; the
    number of groups must stay the same as long as a checkpoint is used, and keys must survive JSON.
    """
    if groups and ttl_seconds is not None:
        raise ValueError("keys of a group are not forgotten one by one: give ttl_seconds or groups")
    columns = [*keys, *[c for c in stream.columns if c not in keys]]
    kinds = dict(stream.dtypes)
    fields = [f"`{c}` {kinds[c]}" for c in columns]
    fields += [f"`{n}` {t}" for n, t in machine.outputs]
    ttl_ms = None if ttl_seconds is None else ttl_seconds * 1000
    rows = stream.select(*columns)
    return (
        (rows.withColumn("_group", _group(keys, groups)).groupBy("_group") if groups else rows.groupBy(*keys))
        .applyInPandasWithState(
            _machine_runner(machine, list(keys), list(order), columns, ttl_ms, bool(groups)),
            ", ".join(fields),
            "body string",
            "append",
            GroupStateTimeout.NoTimeout
            if ttl_ms is None
            else GroupStateTimeout.ProcessingTimeTimeout,
        )
    )


_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _FirstUse(StatefulProcessor):
    """Remembers the digest and id of a key's first request; the store forgets them by itself."""

    def __init__(self, ttl_ms: int, columns: list[str]):
        self.ttl_ms, self.columns = ttl_ms, columns

    def init(self, handle) -> None:
        self.first = handle.getValueState("first", "digest string, id long", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.first.get() if self.first.exists() else None
        waiting = []
        if held is None:  # which request came first shows when the last part is in; a trigger bounds how many wait
            waiting = [part[self.columns] for part in rows]
            earliest = pd.concat([part.nsmallest(1, ["ts_us", "id"]) for part in waiting]).nsmallest(1, ["ts_us", "id"]).iloc[0]
            request = int(earliest["id"])
            held = (earliest["digest"], request)
        else:
            request = None
        digest, answer = held
        self.first.update((digest, int(answer)))
        for part in waiting or (part[self.columns] for part in rows):
            same = part["digest"].eq(digest) if digest is not None else part["digest"].isna()
            ids = part["id"].astype("int64")
            kind = np.where(same, "replay", "conflict")
            if request is not None:
                kind = np.where(ids == request, "fresh", kind)
            yield part.assign(kind=kind, answer_id=np.where(kind == "conflict", ids, answer))

    def close(self) -> None:
        pass


def _first_use() -> Machine:
    def step(first, row):
        _, request, _, digest = row
        if first is None:
            return [digest, request], ("fresh", request)
        return first, ("replay", first[1]) if digest == first[0] else ("conflict", request)

    return Machine(start=lambda row: None, step=step, outputs=[("kind", "string"), ("answer_id", "long")])


def dedup_stream(requests: DataFrame, ttl_seconds: int | None = 90 * 86_400, groups: int = 4096) -> DataFrame:
    """fresh, replay or conflict per request (id, ts_us, idem_key, digest) of a stream.

    A key is remembered for ``ttl_seconds`` after its last use (90 days unless told otherwise), by a state
    store that drops each value when its time is up; it keeps one digest and one id a key on disk.  Requests without key
    are all fresh and need no state.  Ids are unique.  A key that is known is answered part by part; the requests of a new key
    wait for the end of their micro-batch, so bound those by the source (``maxBytesPerTrigger`` or the like).  Forgetting follows
    the wall clock, so with ``ttl_seconds`` use a processing-time trigger.  Without it nothing is forgotten, and keys with one
    hash (of ``groups``) share a value and a call (see ``fold_stream``).  Sets the session's state store provider.
    """
    requests.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)
    keyed = F.coalesce("idem_key", F.lit("")) != ""
    columns = ["idem_key", "id", "ts_us", "digest"]
    kinds = dict(requests.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in columns) + ", kind string, answer_id long"
    asked = requests.filter(keyed).select(*columns)
    if ttl_seconds is None:
        told = fold_stream(asked, ["idem_key"], ["ts_us", "id"], _first_use(), groups=groups)
    else:
        told = asked.groupBy("idem_key").transformWithStateInPandas(
            _FirstUse(ttl_seconds * 1000, columns), schema, "append", "processingTime"
        )
    rest = requests.filter(~keyed).select(
        *columns, F.lit("fresh").alias("kind"), F.col("id").cast("bigint").alias("answer_id")
    )
    return told.unionByName(rest)


def autoscale_stream(
    samples: DataFrame, workloads: DataFrame, targets: dict, policy: Callable | None = None
) -> DataFrame:
    """Scaling decisions as samples (workload_id, metric, ts, value) arrive.

    Every sample asks the policy with the newest value of each metric; ``tick`` is
    the sample's time in microseconds.
    """
    machine = scaler_machine(policy or target_policy(), targets, 1e-6)
    rows = (
        samples.filter(F.col("metric").isin(list(targets)))
        .join(replica_bounds(workloads), "workload_id")
        .select(
            "workload_id",
            F.unix_micros("ts").alias("tick"),
            "metric",
            "value",
            F.lit(True).alias("closes"),
            "start_replicas",
            "low",
            "high",
        )
    )
    return fold_stream(rows, ["workload_id"], ["tick", "metric"], machine)


def stall_stream(
    heartbeats: DataFrame,
    intervals: dict[str, float],
    delay: str,
    stall_seconds: float = 30.0,
) -> DataFrame:
    """Every silence of a loop (loop, ts) that is longer than its limit in event time.

    Each loop keeps its last heartbeat and one event-time timeout after it.  Gaps between
    heartbeats that arrive together are reported too, so the result does not depend on
    how the input is cut into micro-batches.  Heartbeats later than ``delay`` are dropped.
    """
    limits = {k: int(max(stall_seconds, 3 * v) * 1000) for k, v in intervals.items()}
    default = int(stall_seconds * 1000)

    def watch(key, batches, held):
        limit = limits.get(key[0], default)
        if held.hasTimedOut:
            last = held.get[0]
            held.remove()
            yield pd.DataFrame({"loop": [key[0]], "last_ms": [last], "limit_ms": [limit]})
            return
        known = [[held.get[0]]] if held.exists else []
        beats = np.sort(np.concatenate(known + [pdf["ts_ms"].to_numpy() for pdf in batches]))
        ends = beats[:-1][np.diff(beats) > limit].tolist()
        newest = int(beats[-1])
        due = newest + limit + 1
        over = due <= held.getCurrentWatermarkMs()
        ends += [newest] if over else []
        if ends:
            yield pd.DataFrame({"loop": key[0], "last_ms": ends, "limit_ms": limit})
        if over:
            if held.exists:
                held.remove()
            return
        held.update((newest,))
        held.setTimeoutTimestamp(due)

    marked = heartbeats.withWatermark("ts", delay).select("loop", "ts", F.unix_millis("ts").alias("ts_ms"))
    return marked.groupBy("loop").applyInPandasWithState(
        watch,
        "loop string, last_ms bigint, limit_ms bigint",
        "last_ms bigint",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )


def timeout_stream(changes: DataFrame, delay: str, groups: int = 4096) -> DataFrame:
    """Timed-out attempts of a stream of (attempt_id, ts, running, timeout_ms).

    A row with ``running`` starts an attempt, one without ends it.  An end after the limit is a
    timeout, also if both come in one micro-batch; what is not ended at all is
    emitted when the watermark passes its limit.  Rows later than ``delay`` are dropped.

    Open attempts with one hash (of ``groups``) are kept as one value with one timer, that of the first limit, so an
    attempt costs no call of its own.  ``groups`` must stay the same as long as a checkpoint is used.
    """

    def watch(key, batches, held):
        waiting = dict(json.loads(held.get[0])) if held.exists else {}
        starts, ends, told = {}, {}, []
        for pdf in () if held.hasTimedOut else batches:
            for attempt, at, running, limit in zip(*(pdf[c].tolist() for c in ("attempt_id", "ts_ms", "running", "timeout_ms"))):
                if running:
                    starts[attempt] = max(starts.get(attempt, at + limit), at + limit)
                else:
                    ends[attempt] = min(ends.get(attempt, at), at)
        for attempt in starts | ends:
            due = waiting.get(attempt, starts.get(attempt))
            if due is None:
                continue  # the end of an attempt that is already reported
            waiting[attempt] = due
            if attempt in ends:
                del waiting[attempt]
                if ends[attempt] > due:
                    told.append((attempt, int(due)))
        now = held.getCurrentWatermarkMs()
        for attempt, due in list(waiting.items()):
            if due + 1 <= now:
                del waiting[attempt]
                told.append((attempt, int(due)))
        if waiting:
            held.update((json.dumps([(a, int(due)) for a, due in waiting.items()]),))
            held.setTimeoutTimestamp(int(min(waiting.values())) + 1)
        elif held.exists:
            held.remove()
        if told:
            yield pd.DataFrame(told, columns=["attempt_id", "due_ms"])

    marked = changes.withWatermark("ts", delay).select(
        "attempt_id", "ts", F.unix_millis("ts").alias("ts_ms"), "running", "timeout_ms"
    )
    return marked.withColumn("_group", _group(["attempt_id"], groups)).groupBy("_group").applyInPandasWithState(
        watch,
        "attempt_id string, due_ms bigint",
        "body string",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )
