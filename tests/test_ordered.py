"""Numbering, look-back and running sums agree with a plain loop, sliced or not."""

import random

from pyspark.sql import functions as F

from opsframe.operators.ordered import first_per_key, ordered_columns


def rows(n=120):
    rng = random.Random(3)
    # One key holds most of the rows.
    return [
        (rng.choice(["hot", "hot", "hot", "a", "b", None]), i * 7 % 113, i, rng.choice(["x", None, "y"]), rng.randint(-3, 9))
        for i in range(n)
    ]


def expected(data):
    out, groups = {}, {}
    for r in sorted(data, key=lambda r: (r[1], r[2])):
        groups.setdefault(r[0], []).append(r)
    for members in groups.values():
        total = 0
        for i, r in enumerate(members):
            total += r[4]
            out[r[2]] = (i + 1, members[i - 1][3] if i else "none", total)
    return out


def test_ordered_columns(spark, both_ways):
    data = rows()
    df = spark.createDataFrame(data, "k string, at int, id int, v string, n int")
    got = ordered_columns(
        df, ["k"], ["at", "id"], number="nth", previous={"before": ("v", "none")},
        running={"total": F.col("n").cast("long")},
    )
    assert set(got.columns) == {"k", "at", "id", "v", "n", "before", "total", "nth"}
    assert {r.id: (r.nth, r.before, r.total) for r in got.collect()} == expected(data)


def test_sliced_plan_spreads_a_hot_key(spark, tiny_tasks):
    from opsframe.operators.ordered import SLICE, slice_groups

    df = spark.createDataFrame(rows(), "k string, at int, id int, v string, n int")
    sizes = slice_groups(df, ["k"], ["at", "id"], 120).groupBy(SLICE).count().collect()
    assert len(sizes) > 10 and max(r["count"] for r in sizes) < 40


def test_first_per_key(spark):
    df = spark.createDataFrame(rows(), "k string, at int, id int, v string, n int")
    got = first_per_key(df.filter("k is not null"), ["k"], ["at", "id"], 3)
    assert sorted(r["count"] for r in got.groupBy("k").count().collect()) == [3, 3, 3]
