"""Five-field cron expressions expanded with array expressions.

All five fields must match (day of month and weekday are ANDed), 0 is Sunday,
and ``n/step`` means just ``n``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsframe.operators.ordered import join_keys
from opsframe.session import cut_lineage

# Range of each field.
FIELDS = {
    "minute": (0, 59),
    "hour": (0, 23),
    "day": (1, 31),
    "month": (1, 12),
    "weekday": (0, 6),
}
#: Distinct expressions up to which what was parsed is broadcast.
FEW = 10_000
# Fixed value: how far ahead the next fire time is searched, in minutes.
SEARCH_MINUTES = 60 * 24 * 366 * 2


def _whole(text: str) -> str:
    return (
        f"if({text} rlike '^[+-]?[0-9]+(_[0-9]+)*$',"
        f" try_cast(replace({text}, '_', '') as int), null)"
    )


def field_values(spec: str, low: int, high: int) -> Column:
    """Sorted values of a field, or null when any part of it is malformed.

    List elements are split into base and step, then into bounds, then spelled out.
    Flattening a list that holds a null gives null: one bad part spoils the field.
    """
    parts = f"filter(transform(split({spec}, ','), p -> trim(p)), p -> p <> '')"
    stepped = (
        f"transform({parts}, p -> struct(substring_index(p, '/', 1) as base,"
        f" if(contains(p, '/'), {_whole("substring(p, instr(p, '/') + 1)")}, 1) as step))"
    )
    first = _whole("substring_index(p.base, '-', 1)")
    second = _whole("substring(p.base, instr(p.base, '-') + 1)")
    bounds = (
        f"transform({stepped}, p -> struct("
        f"if(p.base = '*', {low}, if(contains(p.base, '-'), {first}, {_whole('p.base')})) as lo,"
        f" if(p.base = '*', {high}, if(contains(p.base, '-'), {second}, {_whole('p.base')})) as hi,"
        f" p.step as step))"
    )
    values = (
        f"transform({bounds}, p -> if(p.step > 0 and p.lo >= {low} and p.lo <= p.hi"
        f" and p.hi <= {high}, sequence(p.lo, p.hi, p.step), null))"
    )
    merged = F.array_sort(F.array_distinct(F.flatten(F.expr(values))))
    return F.when(F.size(merged) > 0, merged)


def parse_schedules(schedules: DataFrame, expr: str = "expr") -> DataFrame:
    """Add the five value arrays and ``error`` (empty for a valid expression)."""
    words = F.split(F.trim(F.regexp_replace(expr, r"\s+", " ")), " ")
    out = schedules.withColumn("_w", words)
    for i, (name, (low, high)) in enumerate(FIELDS.items()):
        out = out.withColumn(name, field_values(f"coalesce(get(_w, {i}), '')", low, high))
    error = F.when(
        F.size("_w") != 5, "cron must have exactly 5 fields: minute hour dom month dow"
    )
    for name in FIELDS:
        error = error.when(F.col(name).isNull(), f"malformed {name} field")
    return out.withColumn("error", error.otherwise("")).drop("_w")


def _per_expression(schedules: DataFrame, clock: dict[str, Column], found: Callable[[DataFrame], DataFrame], spread: bool = False) -> DataFrame:
    """``schedules`` with what ``found`` adds to (expr, clock columns).

    Many schedules share an expression: each is parsed once, beside the clock it is read at.  ``spread``: the
    schedules are dealt out first, as a small file of them may be read by one task and become many rows.
    """
    asked = ["expr", *clock]
    timed = schedules.drop("error", *FIELDS).withColumns(clock)
    # Written out, or conditions on what was parsed would be moved before the step that drops repeated expressions.
    once = cut_lineage(found(timed.select(*asked).distinct()))
    if once.count() <= FEW:  # else Spark might send the schedules to the task that holds the expressions
        once = F.broadcast(once)
    if spread:
        timed = timed.repartition(int(timed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return join_keys(timed, once, asked).drop(*clock)


def malformed_schedules(schedules: DataFrame) -> DataFrame:
    return _per_expression(schedules, {}, lambda asked: parse_schedules(asked).filter("error <> ''").drop(*FIELDS))


def _day_fits(day: Column) -> Column:
    return (
        F.array_contains("month", F.month(day))
        & F.array_contains("day", F.dayofmonth(day))
        & F.array_contains("weekday", F.dayofweek(day) - 1)
    )


def _utc_date(moment: Column) -> Column:
    return F.date_from_unix_date(F.floor(F.unix_seconds(moment) / 86_400).cast("int"))


def cron_expand(schedules: DataFrame, start: Column, end: Column) -> DataFrame:
    """Fire times of every valid schedule in [start, end).

    Days are matched first; only the hours and minutes of matching days are
    spelled out, so the work follows the number of fires;
    the schedules are shuffled once.
    """
    first, last = F.col("_start"), F.col("_end")
    days = F.filter(F.sequence(_utc_date(first), _utc_date(last)), _day_fits)

    def parsed(asked: DataFrame) -> DataFrame:
        good = parse_schedules(asked).filter("error = ''")
        return good.select("expr", "_start", "_end", days.alias("_days"), F.col("hour").alias("_hours"), F.col("minute").alias("_minutes"),
                           first.alias("_from"), last.alias("_until"))

    fires = (
        _per_expression(schedules, {"_start": start, "_end": end}, parsed, spread=True)
        .withColumn("_day", F.explode("_days"))
        .withColumn("_hour", F.explode("_hours"))
        .withColumn("_minute", F.explode("_minutes"))
        .withColumn(
            "fire_at",
            F.timestamp_seconds(
                F.unix_date("_day").cast("bigint") * 86_400
                + F.col("_hour") * 3_600
                + F.col("_minute") * 60
            ),
        )
    )
    kept = fires.filter((F.col("fire_at") >= F.col("_from")) & (F.col("fire_at") < F.col("_until")))
    return kept.drop("_day", "_hour", "_minute", "_days", "_hours", "_minutes", "_from", "_until")


def cron_next(schedules: DataFrame, now: Column) -> DataFrame:
    """First fire strictly after ``now`` (minute grain), null when there is none
    within the search range; malformed schedules keep their error."""
    return _per_expression(schedules, {"_now": now}, _next_fire)


def _next_fire(asked: DataFrame) -> DataFrame:
    now = F.col("_now")
    minute_now = F.floor(F.unix_seconds(now) / 60)
    today = F.floor(minute_now / 1440)
    times = F.flatten(
        F.transform("hour", lambda h: F.transform("minute", lambda m: h * 60 + m))
    )
    parsed = parse_schedules(asked).withColumn("_times", times)

    def first_day(days: int) -> Column:
        after = F.sequence(F.date_add(_utc_date(now), 1), F.date_add(_utc_date(now), days))
        return F.unix_date(F.array_min(F.filter(after, _day_fits)))

    later = F.array_min(F.filter("_times", lambda t: today * 1440 + t > minute_now))
    on_today = F.when(_day_fits(_utc_date(now)), today * 1440 + later)
    # Nearly every schedule fits a day of the next two months; look further only if not.
    next_day = F.coalesce(first_day(62), first_day(SEARCH_MINUTES // 1440 + 1))
    fire = F.coalesce(on_today, next_day * 1440 + F.array_min("_times"))
    good = (F.col("error") == "") & (fire <= minute_now + SEARCH_MINUTES)
    return (
        parsed.withColumn("next_at", F.timestamp_seconds(F.when(good, fire) * 60))
        .withColumn(
            "error",
            F.when((F.col("error") == "") & F.col("next_at").isNull(), "no match within 2 years")
            .otherwise(F.col("error")),
        )
        .drop("_times", *FIELDS)
    )
