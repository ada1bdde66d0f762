"""Partitioned event log: admission, sequence numbers, delivery, dead letters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsframe.operators.folds import Machine, fold
from opsframe.operators.ordered import first_per_key, ordered_columns

# Fixed value: error text of a dead letter that carries none.
EXHAUSTED = "max attempts exceeded"


def validate_event(events: DataFrame, max_payload: int = 1024 * 1024) -> DataFrame:
    """Add ``errors``: the rules a message breaks (empty when it is fine).

    An absent or empty payload counts as an empty object.
    """
    parsed = F.try_parse_json(F.col("payload"))
    kind = F.schema_of_variant(parsed)
    empty = F.col("payload").isNull() | F.trim("payload").isin(
        "", "null", "false", "0", '""', "[]"
    )
    is_object = F.coalesce(kind.startswith("OBJECT<"), F.lit(False))
    topic = F.coalesce(F.length("topic"), F.lit(0))
    errors = F.array_compact(
        F.array(
            F.when(~empty & ~is_object, F.lit("event payload must be an object")),
            F.when(
                F.coalesce(F.length("payload"), F.lit(0)) > max_payload,
                F.lit(f"event payload exceeds {max_payload} bytes"),
            ),
            F.when(~topic.between(1, 128), F.lit("topic is required")),
        )
    )
    return events.withColumn("errors", errors)


def assign_sequence(
    published: DataFrame,
    order: Sequence[str] = ("created_at", "id"),
    existing: DataFrame | None = None,
) -> DataFrame:
    """Number messages 1, 2, ... per (topic, partition), after ``existing`` ones."""
    keys = ["topic", "partition"]
    numbered = ordered_columns(published, keys, list(order), number="seq")
    if existing is None:
        return numbered
    last = existing.groupBy(*keys).agg(F.max("seq").alias("_last"))
    return (
        numbered.join(last, keys, "left")
        .withColumn("seq", F.col("seq") + F.coalesce("_last", F.lit(0)))
        .drop("_last")
    )


def topic_lag(events: DataFrame) -> DataFrame:
    """Pending messages per topic; the row with topic ``*`` is the grand total."""
    return (
        events.filter(F.col("status") == "pending")
        .rollup("topic")
        .agg(F.count("*").alias("lag"), F.grouping("topic").alias("_all"))
        .select(
            F.when(F.col("_all") == 1, F.lit("*")).otherwise(F.col("topic")).alias("topic"),
            "lag",
        )
    )


def next_batch(
    events: DataFrame,
    offsets: DataFrame,
    subscriptions: DataFrame,
    limit: int = 10,
    max_attempts: int = 5,
) -> DataFrame:
    """Next undelivered messages per (group, topic, partition), in sequence order.

    ``subscriptions`` has (grp, topic).  A message is due when its number is
    past the group's offset, it is still pending, and the group has tries left.
    """
    due = (
        events.filter(F.col("status") == "pending")
        .join(subscriptions, "topic")
        .filter(
            F.coalesce(F.try_element_at("delivery_attempts", F.col("grp")), F.lit(0))
            < max_attempts
        )
    )
    behind = offsets.select("grp", "topic", "partition", F.col("seq").alias("_done"))
    ahead = (
        due.join(behind, ["grp", "topic", "partition"], "left")
        .filter(F.col("seq") > F.coalesce("_done", F.lit(0)))
        .drop("_done")
    )
    return first_per_key(ahead, ["grp", "topic", "partition"], ["seq"], limit)


def _ack_groups(acks: DataFrame, max_attempts: int) -> DataFrame:
    """One row per (event, group): failures, last moves, and where tries ran out.

    Everything is a mergeable aggregate or a first-n, so an event that holds a
    large share of all acks is combined before it is shuffled.
    """
    keys = ["event_id", "topic", "grp"]
    moment = F.struct("ack_ts", "event_id", "grp", "ack_no")
    totals = acks.groupBy(*keys).agg(
        F.count_if(~F.col("ok")).alias("fails"),
        F.min(F.when(F.col("ok"), moment)).alias("first_ok"),
        F.max(F.when(F.col("ok"), moment)).alias("last_ok"),
        F.max(F.when(~F.col("ok"), moment)).alias("last_fail"),
        F.max_by("error", F.when(~F.col("ok"), moment)).alias("last_error"),
    )
    spent = (
        first_per_key(
            acks.filter(~F.col("ok")).select(*keys, "ack_ts", "ack_no"),
            keys,
            ["ack_ts", "ack_no"],
            max_attempts,
        )
        .groupBy(*keys)
        .agg(F.count("*").alias("_n"), F.max(moment).alias("spent_at"))
        .filter(F.col("_n") == max_attempts)
        .drop("_n")
    )
    return totals.join(spent, keys, "left")


def _ack_events(events: DataFrame, groups: DataFrame) -> DataFrame:
    """Final status per acked event; ``legal`` events died before any delivery."""
    per_event = groups.groupBy("event_id", "topic").agg(
        F.min("first_ok").alias("first_ok"), F.min("spent_at").alias("spent_at")
    )
    died = F.col("spent_at").isNotNull() & (
        F.col("first_ok").isNull() | (F.col("spent_at") < F.col("first_ok"))
    )
    known = events.select(F.col("id").alias("event_id"), "topic", "partition", "seq")
    return (
        known.join(per_event, ["event_id", "topic"], "left")
        .withColumn("dead", F.coalesce(died, F.lit(False)))
        .withColumn(
            "status",
            F.when(F.col("dead"), "dead")
            .when(F.col("first_ok").isNotNull(), "delivered")
            .otherwise("pending"),
        )
        .withColumn(
            "illegal_transition", F.col("spent_at").isNotNull() & ~F.col("dead")
        )
    )


def ack_states(events: DataFrame, acks: DataFrame, max_attempts: int = 5) -> DataFrame:
    """Status of every event after its acks, with failed tries per group."""
    groups = _ack_groups(acks, max_attempts)
    tries = groups.groupBy("event_id", "topic").agg(
        F.map_from_entries(F.collect_list(F.struct("grp", "fails"))).alias("delivery_attempts")
    )
    return (
        _ack_events(events, groups)
        .join(tries, ["event_id", "topic"], "left")
        .select(
            "event_id",
            "topic",
            "partition",
            "seq",
            "status",
            "illegal_transition",
            F.coalesce("delivery_attempts", F.expr("cast(map() as map<string,bigint>)")).alias(
                "delivery_attempts"
            ),
        )
    )


def ack_dead_letters(
    events: DataFrame, acks: DataFrame, max_attempts: int = 5
) -> DataFrame:
    """One dead letter per dead event; the last exhausted group writes it."""
    groups = _ack_groups(acks, max_attempts)
    dead = _ack_events(events, groups).filter("dead")
    last = (
        groups.filter(F.col("spent_at").isNotNull())
        .groupBy("event_id", "topic")
        .agg(
            F.max_by(
                F.struct("grp", "fails", "last_error", "last_fail"), "last_fail"
            ).alias("d")
        )
    )
    return dead.join(last, ["event_id", "topic"]).select(
        F.col("event_id").alias("id"),
        "topic",
        "partition",
        "seq",
        F.col("d.grp").alias("grp"),
        F.coalesce(F.nullif("d.last_error", F.lit("")), F.lit(EXHAUSTED)).alias("error"),
        F.col("d.fails").alias("attempts"),
        F.col("d.last_fail.ack_ts").alias("created_at"),
    )


def ack_offsets(events: DataFrame, acks: DataFrame, max_attempts: int = 5) -> DataFrame:
    """Committed offset per (group, topic, partition): the last ack that moves it.

    The offset may move back; ``stranded`` counts events still pending at or
    below it, which the group will not see again.
    """
    groups = _ack_groups(acks, max_attempts)
    states = _ack_events(events, groups)
    keys = ["grp", "topic", "partition"]
    moves = (
        groups.join(states.select("event_id", "topic", "partition", "seq", "dead"), ["event_id", "topic"])
        .withColumn(
            "moved",
            F.greatest(
                "last_ok",
                F.when(F.col("dead") & F.col("spent_at").isNotNull(), F.col("last_fail")),
            ),
        )
        .filter(F.col("moved").isNotNull())
    )
    offsets = moves.groupBy(*keys).agg(F.max_by("seq", "moved").alias("offset"))
    # How many events are still pending up to each sequence number; an offset is the
    # number of an event, so it finds its count by equality.
    counted = ordered_columns(
        states.select("topic", "partition", "seq", "status"),
        ["topic", "partition"],
        ["seq"],
        running={"stranded": (F.col("status") == "pending").cast("bigint")},
        sized_by=events,
    )
    upto = counted.select("topic", "partition", F.col("seq").alias("offset"), "stranded")
    return offsets.join(upto, ["topic", "partition", "offset"], "left").select(
        *keys, "offset", "stranded"
    )


def ack_machine(max_attempts: int = 5) -> Machine:
    """Ack by ack view of one event: (event_id, at_us, grp, ack_no, ok, error).

    Same rules as the aggregates above, for streams and for following a single event.
    """

    def step(state, row):
        status, fails = state
        grp, ok = row[2], row[4]
        if ok:
            now = "delivered" if status == "pending" else status
            return [now, fails], (now, fails.get(grp, 0), True, False, False)
        tries = fails.get(grp, 0) + 1
        fails = {**fails, grp: tries}
        if tries < max_attempts:
            return [status, fails], (status, tries, False, False, False)
        if status == "delivered":
            return [status, fails], (status, tries, False, False, True)
        return ["dead", fails], ("dead", tries, True, True, False)

    return Machine(
        start=lambda row: ["pending", {}],
        step=step,
        outputs=[
            ("status", "string"),
            ("attempts", "long"),
            ("moves_offset", "boolean"),
            ("dead_letter", "boolean"),
            ("illegal_transition", "boolean"),
        ],
    )


def unknown_acks(events: DataFrame, acks: DataFrame) -> DataFrame:
    """Acks that name no event of their topic."""
    known = events.select(F.col("id").alias("event_id"), "topic")
    return acks.join(known, ["event_id", "topic"], "left_anti")


def list_dead_letters(dead_letters: DataFrame, topic: str) -> DataFrame:
    return dead_letters.filter(F.col("topic") == topic).orderBy("created_at", "id")


def admit_events(
    published: DataFrame,
    max_lag: int = 1000,
    order: Sequence[str] = ("created_at", "id"),
    opening_lag: DataFrame | None = None,
) -> DataFrame:
    """Backpressure when nothing is settled meanwhile: the first free slots win.

    ``opening_lag`` has (topic, lag); topics absent from it start empty.
    """
    numbered = ordered_columns(published, ["topic"], list(order), number="_nth")
    if opening_lag is None:
        numbered = numbered.withColumn("lag", F.lit(0))
    else:
        numbered = numbered.join(opening_lag, "topic", "left")
    room = F.lit(max_lag) - F.coalesce("lag", F.lit(0))
    return numbered.withColumn("accepted", F.col("_nth") <= room).drop("_nth", "lag")


def _admit_step(max_lag):
    def step(lag, row):
        if row[-1]:  # a settled message frees a slot
            return max(lag - 1, 0), (False,)
        return (lag + 1, (True,)) if lag < max_lag else (lag, (False,))

    return step


def _admit_summary(max_lag):
    def summarise(rows):
        """A slice maps the lag x to min(high, max(low, x + shift))."""
        shift, low, high = 0, 0, max_lag
        for row in rows:
            d = -1 if row[-1] else 1
            shift += d
            low = min(max(low + d, 0), max_lag)
            high = min(max(high + d, 0), max_lag)
        return [shift, low, high]

    return summarise


def _admit_advance(lag, summary):
    shift, low, high = summary
    return min(high, max(low, lag + shift))


def admit_with_settles(
    actions: DataFrame, max_lag: int = 1000, order: Sequence[str] = ("at", "id")
) -> DataFrame:
    """Backpressure over a log of publishes and settles (``settled`` true).

    A publish is accepted while fewer than ``max_lag`` messages of its topic are
    pending; every settled message frees one slot.
    """
    machine = Machine(
        start=lambda row: 0,
        step=_admit_step(max_lag),
        outputs=[("accepted", "boolean")],
        summarise=_admit_summary(max_lag),
        advance=_admit_advance,
    )
    columns = ["topic", *[c for c in actions.columns if c not in ("topic", "settled")], "settled"]
    return fold(actions.select(*columns), ["topic"], list(order), machine)
