"""Tenant views, access checks, request classification, limits and breakers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsframe.operators.chains import reached, successors
from opsframe.operators.folds import Machine, fold
from opsframe.operators.ordered import first_per_key, group_sizes, join_keys, ordered_columns
from opsframe.schemas import LOG_LEVELS
from opsframe.session import cut_lineage, rows_per_task

# ----------------------------------------------------------------------- tenants


def namespace_scope(rows: DataFrame, namespace: str) -> DataFrame:
    return rows.filter(F.col("namespace") == namespace)


def access_check(requests: DataFrame, rows: DataFrame) -> DataFrame:
    """Verdict per by-id request (id, caller): ok, forbidden or not_found."""
    owners = rows.select("id", F.col("namespace").alias("_owner"))
    verdict = (
        F.when(F.col("_owner").isNull(), "not_found")
        .when(F.col("_owner") != F.col("caller"), "forbidden")
        .otherwise("ok")
    )
    return requests.join(owners, "id", "left").withColumn("verdict", verdict).drop("_owner")


def token_access_check(requests: DataFrame, tokens: DataFrame, now: Column) -> DataFrame:
    """Verdict per request (token_id, namespace, scope): ok, unauthorized, forbidden.

    A token expires once the whole second of its expiry has passed; ``read``
    needs no scope, and a request without namespace is not tied to one.
    """
    known = tokens.select(
        F.col("id").alias("token_id"),
        F.col("namespace").alias("_ns"),
        F.col("scopes").alias("_scopes"),
        F.col("expires_at").alias("_expires"),
        F.lit(True).alias("_known"),
    )
    expired = F.unix_seconds(now) > F.unix_seconds(F.col("_expires"))
    verdict = (
        F.when(F.col("_known").isNull() | F.coalesce(expired, F.lit(False)), "unauthorized")
        .when(F.col("namespace").isNotNull() & (F.col("namespace") != F.col("_ns")), "forbidden")
        .when(
            (F.col("scope") != "read") & ~F.array_contains("_scopes", F.col("scope")), "forbidden"
        )
        .otherwise("ok")
    )
    return (
        requests.join(known, "token_id", "left")
        .withColumn("verdict", verdict)
        .drop("_ns", "_scopes", "_expires", "_known")
    )


def list_entities(rows: DataFrame, namespace: str | None, order: str = "created_at") -> DataFrame:
    scoped = rows if namespace is None else namespace_scope(rows, namespace)
    return scoped.orderBy(order, "id") if "id" in rows.columns else scoped.orderBy(order)


def audit_tail(audit: DataFrame, limit: int) -> DataFrame:
    """The newest ``limit`` entries, newest first."""
    return audit.orderBy(F.desc("ts"), F.desc("id")).limit(limit)


def audit_retention(audit: DataFrame, keep: int) -> DataFrame:
    """The newest ``keep`` entries."""
    return audit.orderBy(F.desc("ts"), F.desc("id")).limit(keep)


def entity_counts(entities: Mapping[str, DataFrame]) -> DataFrame:
    parts = [
        df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("entity"), "rows")
        for name, df in entities.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def log_level_filter(records: DataFrame, threshold: str = "info") -> DataFrame:
    """Records at or above ``threshold``; an unknown level counts as info."""
    level = F.when(F.col("level").isin(LOG_LEVELS), F.col("level")).otherwise("info")
    rank = LOG_LEVELS.index(threshold) if threshold in LOG_LEVELS else 1
    return records.withColumn("level", level).filter(level.isin(LOG_LEVELS[rank:]))


# ------------------------------------------------------------------- idempotency


def idempotency_classify(requests: DataFrame) -> DataFrame:
    """fresh, replay or conflict per request (id, ts, idem_key, digest).

    The first request of a key decides; it is found with one mergeable aggregate
    per key and joined back, so no key has to be sorted in one task.
    ``answer_id`` is the request whose response is returned.
    """
    keyed = F.coalesce("idem_key", F.lit("")) != ""
    first = (
        requests.filter(keyed)
        .groupBy("idem_key")
        .agg(F.min(F.struct("ts", "id", "digest")).alias("_first"))
    )
    with_key = requests.filter(keyed).join(first, "idem_key")
    kind = (
        F.when(F.col("id") == F.col("_first.id"), "fresh")
        .when(F.col("digest") == F.col("_first.digest"), "replay")
        .otherwise("conflict")
    )
    with_key = with_key.select(
        *requests.columns,
        kind.alias("kind"),
        F.when(kind == "conflict", F.col("id")).otherwise(F.col("_first.id")).alias("answer_id"),
    )
    without = requests.filter(~keyed).select(
        *requests.columns, F.lit("fresh").alias("kind"), F.col("id").alias("answer_id")
    )
    return with_key.unionByName(without)


# -------------------------------------------------------------------- rate limit


def window_step(limit: int, width: int):
    """Fixed window anchored at its first call; state is [calls let through, start]."""

    def step(state, row):
        at = row[1]
        if state is None or at - state[1] >= width:
            state = [0, at]
        used, start = state
        if used >= limit:
            return state, (False, width - (at - start))
        return [used + 1, start], (True, 0)

    return step


def _window_starts(calls: DataFrame, key: str, width: int) -> DataFrame:
    """(key, _start): where the windows of each key begin, by pointers from each call time to the first one a window later."""
    times = cut_lineage(calls.select(key, F.col("at_us").alias("node")).distinct())
    offers = times.withColumn("at", F.col("node"))
    links = successors(times.withColumn("at", F.col("node") + width), offers, [key])
    heads = times.groupBy(key).agg(F.min("node").alias("node"))
    return reached(links, heads, [key]).withColumnRenamed("node", "_start")


def _rate_limit_rows(calls: DataFrame, key: str, limit: int, width: int) -> DataFrame:
    """As ``rate_limit``, by joins on rows only, for keys that no task can hold.

    Stretches of one width hold one window start at most, and a call's window starts in its own stretch or in the
    one before, so two equality joins find it.  The last call let through marks where a window closes.
    """
    starts = cut_lineage(_window_starts(calls, key, width))
    stretch = F.floor(F.col("_start") / width)
    own = starts.select(key, stretch.alias("_stretch"), F.col("_start").alias("_own"))
    before = starts.select(key, (stretch + 1).alias("_stretch"), F.col("_start").alias("_before"))
    placed = calls.withColumn("_stretch", F.floor(F.col("at_us") / width))
    placed = join_keys(join_keys(placed, own, [key, "_stretch"], "left"), before, [key, "_stretch"], "left")
    start = F.when(F.col("_own") <= F.col("at_us"), F.col("_own")).otherwise(F.col("_before"))
    placed = placed.withColumn("_start", start).drop("_stretch", "_own", "_before")
    within = first_per_key(placed.select(key, "_start", "at_us", "id"), [key, "_start"], ["at_us", "id"], limit)
    closes = within.groupBy(key, "_start").agg(F.max(F.struct("at_us", "id")).alias("_closes"))
    judged = join_keys(placed, closes, [key, "_start"], "left")
    allowed = F.coalesce(F.struct("at_us", "id") <= F.col("_closes"), F.lit(False))
    wait = F.when(allowed, F.lit(0)).otherwise(F.col("_start") + width - F.col("at_us")).cast("long")
    return judged.withColumns({"allowed": allowed, "retry_after_us": wait}).drop("_start", "_closes")


def rate_limit(
    calls: DataFrame, key: str, limit: int, window_seconds: float = 60.0
) -> DataFrame:
    """allowed and retry_after (microseconds) per call (key, at_us, id).

    A window starts at a key's first call and the next one at the first call
    at least ``window_seconds`` later; only ``limit`` calls pass per window.
    Keys that fit one task are folded in one pass; otherwise window starts are found by doubling pointers, and no
    task holds more of a key than of any other.
    """
    width = int(window_seconds * 1_000_000)
    rest = [c for c in calls.columns if c not in (key, "at_us", "id")]
    calls = calls.select(key, "at_us", "id", *rest)
    largest, _ = group_sizes(calls, [key])
    if largest > rows_per_task(calls.sparkSession):
        return _rate_limit_rows(calls, key, limit, width)
    machine = Machine(
        start=lambda row: None,
        step=window_step(limit, width),
        outputs=[("allowed", "boolean"), ("retry_after_us", "long")],
    )
    return fold(calls, [key], ["at_us", "id"], machine)


# --------------------------------------------------------------------- breakers


def breaker_trips(
    calls: DataFrame, threshold: int = 5, window_seconds: float = 30.0
) -> DataFrame:
    """Failures that complete ``threshold`` failures within the window since the
    last success (name, at_us, id, ok).

    That is so when the row ``threshold - 1`` places earlier is a failure of the same
    unbroken run and recent enough, which an equality join on row numbers tells.
    """
    numbered = ordered_columns(
        calls,
        ["name"],
        ["at_us", "id"],
        number="nth",
        running={"successes": F.col("ok").cast("bigint")},
    )
    failed = numbered.filter(~F.col("ok")).select("name", "nth", "successes", "at_us", "id")
    if threshold <= 1:
        return failed.select("name", "id", "at_us")
    earlier = failed.select(
        "name",
        (F.col("nth") + (threshold - 1)).alias("nth"),
        F.col("successes").alias("_s"),
        F.col("at_us").alias("_at"),
    )
    width = int(window_seconds * 1_000_000)
    return (
        failed.join(earlier, ["name", "nth"])
        .filter((F.col("_s") == F.col("successes")) & (F.col("at_us") - F.col("_at") <= width))
        .select("name", "id", "at_us")
    )


def breaker_step(threshold: int, window: int, open_for: int):
    """state: [closed|open, recent failure times, opened at]; row: (name, at, id, ok)."""

    def step(state, row):
        mode, failures, opened = state
        at, ok = row[1], row[3]
        if mode == "open":
            if at - opened < open_for:
                return state, (False, "open")
            if ok:
                return ["closed", [], 0], (True, "closed")
            return ["open", [], at], (True, "open")
        if ok:
            return ["closed", [], 0], (True, "closed")
        failures = [f for f in failures if at - f <= window] + [at]
        if len(failures) >= threshold:
            return ["open", [], at], (True, "open")
        return ["closed", failures, 0], (True, "closed")

    return step


def _breaker_summary(threshold: int, window: int, open_for: int):
    def summarise(rows):
        """[head, closed end, steps].

        ``head``: the first calls, each with the end state when a breaker is closed
        and clean, or opens, right after it.  ``closed end``: end state from a clean
        breaker.  ``steps``: end state by the time from which a probe may run.
        """
        calls = [(row[1], row[3]) for row in rows]
        n = len(calls)
        run = 0  # unbroken failures up to a row
        trips = [False] * n
        for j, (at, ok) in enumerate(calls):
            run = 0 if ok else run + 1
            trips[j] = run >= threshold and at - calls[j - threshold + 1][0] <= window
        tail: list = []
        after_opening: list = [None] * n  # opened at row i
        probing: list = [None] * n  # row i is the probe
        clean: list = [None] * (n + 1)  # closed and clean before row i

        for j in range(n - 1, -1, -1):
            if calls[j][1] or len(tail) >= threshold:
                break
            tail.insert(0, [j, calls[j][0]])

        def still_closed(i):
            last = calls[n - 1][0]
            return ["closed", [t for j, t in tail if j >= i and last - t <= window], 0]

        following = n  # first row a probe may run after row i opens
        next_trip = n
        for i in range(n, -1, -1):
            at_trip = i + threshold - 1
            if at_trip < n and trips[at_trip]:
                next_trip = at_trip
            if i < n:
                while following - 1 > i and calls[following - 1][0] >= calls[i][0] + open_for:
                    following -= 1
                after_opening[i] = (
                    probing[following] if following < n else ["open", [], calls[i][0]]
                )
                probing[i] = clean[i + 1] if calls[i][1] else after_opening[i]
            clean[i] = after_opening[next_trip] if next_trip < n else still_closed(i)
        steps: list = []
        for i in range(n):
            if i and calls[i][0] == calls[i - 1][0]:
                continue
            if steps and steps[-1][1] == probing[i]:
                steps[-1][0] = calls[i][0]
            else:
                steps.append([calls[i][0], probing[i]])
            if calls[i][0] >= calls[0][0] + open_for:
                break
        head = [
            [at, ok, clean[i + 1], after_opening[i]]
            for i, (at, ok) in enumerate(calls[:threshold])
        ]
        return [head, clean[0], steps, n]

    return summarise


def _breaker_advance(threshold: int, window: int, open_for: int):
    def advance(state, summary):
        head, from_clean, steps, n = summary
        mode, failures, opened = state
        if mode == "open":
            for last, end in steps:
                if last >= opened + open_for:
                    return end
            return state
        for at, ok, clean_after, opened_here in head:
            if ok:
                return clean_after
            failures = [f for f in failures if at - f <= window] + [at]
            if len(failures) >= threshold:
                return opened_here
        # A longer slice has by now forgotten the failures before it.
        return from_clean if n > len(head) else ["closed", failures, 0]

    return advance


def breaker_states(
    calls: DataFrame,
    threshold: int = 5,
    window_seconds: float = 30.0,
    open_seconds: float = 5.0,
) -> DataFrame:
    """allowed and the state after each call (name, at_us, id, ok).

    Closed calls pass; enough recent failures open the breaker; after
    ``open_seconds`` one probe passes and closes or reopens it.
    """
    window, open_for = int(window_seconds * 1_000_000), int(open_seconds * 1_000_000)
    machine = Machine(
        start=lambda row: ["closed", [], 0],
        step=breaker_step(threshold, window, open_for),
        outputs=[("allowed", "boolean"), ("state", "string")],
        summarise=_breaker_summary(threshold, window, open_for),
        advance=_breaker_advance(threshold, window, open_for),
    )
    return fold(calls.select("name", "at_us", "id", "ok"), ["name"], ["at_us", "id"], machine)


# ---------------------------------------------------------------------- watchdog

# Loops the watchdog leaves out.
UNWATCHED = ["writer", "watchdog"]


def stall_detect(
    heartbeats: DataFrame, intervals: Mapping[str, float], now: Column, stall_seconds: float = 30.0
) -> DataFrame:
    """Seconds since the last progress of each loop, and whether that is a stall.

    A loop stalls after max(stall_seconds, 3 x its own interval).
    """
    last = heartbeats.filter(~F.col("loop").isin(UNWATCHED)).groupBy("loop").agg(
        F.max("ts").alias("last_ts")
    )
    own = F.lit(0.0)
    for name, seconds in intervals.items():
        own = F.when(F.col("loop") == name, F.lit(float(seconds))).otherwise(own)
    idle = (F.unix_micros(now) - F.unix_micros("last_ts")) / 1_000_000
    limit = F.greatest(F.lit(float(stall_seconds)), own * 3.0)
    return last.select(
        "loop", idle.alias("idle_seconds"), limit.alias("limit_seconds"), (idle > limit).alias("stalled")
    )
