"""Hand-worked cases of each plane."""

import json
import zlib

import pytest
from pyspark.sql import functions as F

from opsframe.functions import cron
from opsframe.functions.keys import event_partition, slugify, task_key
from opsframe.functions.redact import redact_secrets
from opsframe.functions.timing import backoff_seconds, repeatable_unit
from opsframe.operators import compute as cp
from opsframe.operators import events as ev
from opsframe.operators import intent as it
from opsframe.operators import metrics as mt
from opsframe.operators import scaling as sc
from opsframe.operators import validate as va
from opsframe.operators import workflow as wf


def demand(spark, current, value, target, low=0, high=1000):
    loads = spark.createDataFrame(
        [("w", current, low, high)], "id string, desired_replicas long, min_replicas long, max_replicas long"
    )
    targets = spark.createDataFrame(
        [("w", "m", target, None, None)], "workload_id string, metric string, target double, low double, high double"
    )
    latest = spark.createDataFrame([("w", "m", value)], "workload_id string, metric string, value double")
    return sc.dominant_demand(loads, targets, latest).first().demand


def test_demand_cases(spark):
    assert demand(spark, 2, 0.9, 0.65) == 3
    assert demand(spark, 2, 600.0, 10.0) == 120
    assert demand(spark, 2, 600.0, 10.0, high=50) == 50
    assert demand(spark, 2, 600.0, 0.0) is None


def test_policy_cases():
    decide = sc.target_policy()
    targets = {"m": (10.0, 0.0, sc.NO_LIMIT)}
    assert decide(10, 0, 100, {"m": 11.0}, targets, 1e6, 0, 0) is None  # within the deadband
    assert decide(1, 0, 100, {"m": 50.0}, targets, 1e6, 0, 0) == 5
    assert sc.target_policy(step=4)(1, 0, 100, {"m": 900.0}, targets, 1e6, 0, 0) == 5
    assert decide(10, 0, 100, {"m": 1.0}, targets, 1e6, 1e6 - 59, 0) is None  # cooling down
    assert decide(10, 0, 100, {"m": 1.0}, targets, 1e6, 1e6 - 90, 1e6 - 90) is None  # just scaled up
    assert decide(10, 0, 100, {"m": 1.0}, targets, 1e6, 1e6 - 200, 1e6 - 200) == 1
    assert decide(10, 0, 100, {}, targets, 1e6, 0, 0) is None


def test_keys(spark):
    df = spark.createDataFrame([("poison",), ("happy",), ("ünï",)], "k string")
    got = {r.k: r.p for r in df.select("k", event_partition(F.col("k")).alias("p")).collect()}
    assert got == {k: zlib.crc32(k.encode()) % 4 for k in got} and got["poison"] == got["happy"] == 1
    one = spark.range(1)
    assert one.select(slugify(F.lit("cap://software/code/refactor"))).first()[0] == "cap-software-code-refactor"
    import hashlib

    for intent in ["plain", "\x1f\x0b\x7f \\u001F", 'quote " back \\ tab\t', "é 漢 😀 \x7f"]:
        text = json.dumps({"intent": intent, "capabilities": ["a", "b"]}, sort_keys=True)
        want = "task-" + hashlib.sha256(text.encode()).hexdigest()[:40]
        assert one.select(task_key(F.lit(intent), F.array(F.lit("b"), F.lit("a")), "task-")).first()[0] == want


def test_backoff(spark):
    row = spark.range(1).select(
        *[backoff_seconds(F.lit(n), 1.0, 60.0, 0.0).alias(f"a{n}") for n in (0, 1, 2, 5, 7, 5000)],
        backoff_seconds(F.lit(3), 1.0, 60.0, 0.5, -1.0).alias("low"),
        repeatable_unit(F.lit("w"), F.lit(1)).alias("u"),
    ).first()
    assert list(row)[:6] == [1, 1, 2, 16, 60, 60] and row.low == 2 and -1 <= row.u <= 1


@pytest.mark.parametrize(
    "expr,now,want",
    [
        ("*/15 * * * *", "2024-01-01 10:07:00", "2024-01-01 10:15:00"),
        ("*/15 * * * *", "2024-01-01 10:15:00", "2024-01-01 10:30:00"),
        ("0 0 * * 0", "2024-01-03 00:00:00", "2024-01-07 00:00:00"),
        ("0 0 13 * 5", "2024-01-01 00:00:00", "2024-09-13 00:00:00"),
        ("0 0 29 2 *", "2024-03-01 00:00:00", None),
        ("7/5 3 * * *", "2024-01-01 04:00:00", "2024-01-02 03:07:00"),
        ("0 0 31 2 *", "2024-01-01 00:00:00", None),
    ],
)
def test_cron_next(spark, expr, now, want):
    df = spark.createDataFrame([(1, expr)], "schedule_id int, expr string")
    row = cron.cron_next(df, F.lit(now).cast("timestamp")).first()
    assert (None if row.next_at is None else str(row.next_at)) == want
    assert row.error == ("" if want else "no match within 2 years")


def test_cron_parses_an_expression_once(spark):
    exprs = ["0 6 * * *", "61 1 * * *", "*/30 8 1,15 * *", None]
    df = spark.createDataFrame([(i, exprs[i % 4]) for i in range(40)], "id int, expr string")
    start, end = (F.lit(t).cast("timestamp") for t in ("2024-09-01", "2024-10-01"))
    found = {
        "next": (cron.cron_next(df, start), 40),
        "fires": (cron.cron_expand(df, start, end), 10 * (30 + 4)),
        "bad": (cron.malformed_schedules(df), 20),
    }
    for name, (rows, count) in found.items():
        assert "lambda" not in rows._jdf.queryExecution().executedPlan().toString(), name
        assert rows.count() == count, name
    # The clock may differ from row to row.
    own = df.withColumn("at", F.timestamp_seconds(F.lit(1725148800) + F.col("id") * 86400))
    got = {r.id: r.s for r in cron.cron_next(own, F.col("at")).filter("id % 4 = 0").select("id", F.unix_seconds("next_at").alias("s")).collect()}
    assert got == {i: 1725148800 + i * 86400 + 6 * 3600 for i in range(0, 40, 4)}


def test_cron_fields(spark):
    df = spark.createDataFrame(
        [(s,) for s in ["1,,3", "5-20/5", "*/20", "", ",", "7-3", "60", "a", "*/0", "1-", "-1", "9/2", "1-5/x"]],
        "s string",
    )
    got = {r.s: r.v for r in df.select("s", cron.field_values("s", 0, 59).alias("v")).collect()}
    assert got["1,,3"] == [1, 3] and got["5-20/5"] == [5, 10, 15, 20] and got["*/20"] == [0, 20, 40]
    assert got["9/2"] == [9]
    assert all(got[s] is None for s in ["", ",", "7-3", "60", "a", "*/0", "1-", "-1", "1-5/x"])


def test_dag_with_many_parents(spark):
    nodes = [
        ("w", "a", []), ("w", "b", ["a"]), ("w", "c", ["a", "b"]), ("w", "d", ["c", "a"]),
        ("x", "a", ["b"]), ("x", "b", ["a"]), ("x", "c", []), ("x", "d", ["b", "c"]),
        ("y", "a", []), ("y", "b", ["a", "a"]),  # a repeated dependency is never satisfied
    ]
    df = spark.createDataFrame(nodes, "workflow_id string, node_id string, depends_on array<string>")
    got = {(r.workflow_id, r.node_id): r.level for r in wf.dag_levels(df).collect()}
    assert got == {
        ("w", "a"): 0, ("w", "b"): 1, ("w", "c"): 2, ("w", "d"): 3,
        ("x", "a"): -1, ("x", "b"): -1, ("x", "c"): 0, ("x", "d"): -1, ("y", "a"): 0, ("y", "b"): -1,
    }
    assert {r.workflow_id for r in wf.cyclic_workflows(df).collect()} == {"x", "y"}


def test_readiness_with_many_parents(spark):
    nodes = [
        ("w", "ok", [], "succeeded"), ("w", "bad", [], "failed"), ("w", "off", [], "cancelled"),
        ("w", "gone", [], "skipped"), ("w", "n1", ["ok"], "pending"), ("w", "n2", ["ok", "off", "bad"], "pending"),
        ("w", "n3", ["off", "n1"], "pending"), ("w", "n4", ["gone"], "pending"), ("w", "n5", ["n1"], "pending"),
    ]
    df = spark.createDataFrame(nodes, "workflow_id string, node_id string, depends_on array<string>, status string")
    got = {r.node_id: (r.decision, r.reason) for r in wf.ready_nodes(df).collect()}
    assert got == {
        "n1": ("ready", ""), "n2": ("skip", "dependency failed"), "n3": ("skip", "dependency cancelled"),
        "n4": ("wait", ""), "n5": ("wait", ""),
    }
    assert {r.node_id: r.decision for r in wf.ready_nodes(df, propagate_skips=True).collect()}["n4"] == "skip"


def test_placements_with_tag_sets(spark):
    """Every policy, tag sets, pins and spreading against all pairs by brute force."""
    import random

    rng = random.Random(11)
    nodes = [
        (f"n{i}", rng.sample(["x", "y", "z"], rng.randint(0, 3)), rng.randint(0, 40) * 50, rng.randint(0, 40) * 50,
         rng.choice(["active", "active", "draining"]), rng.randint(0, 2), rng.randint(0, 500), rng.randint(0, 500))
        for i in range(25)
    ]
    loads = [
        (f"w{i}", rng.randint(1, 30) * 50, rng.randint(1, 30) * 50, rng.choice(["fifo", "priority", "round_robin", "bin_pack"]),
         rng.sample(["x", "y", "z"], rng.choice([0, 0, 1, 2, 3])), rng.choice([None, None, "", f"n{i % 30}"]),
         rng.random() < 0.3, rng.choice(["active", "active", "paused"]))
        for i in range(80)
    ]
    n = spark.createDataFrame(
        nodes, "id string, tags array<string>, capacity_cpu long, capacity_mem long, state string, leases long,"
        " used_cpu long, used_mem long")
    w = spark.createDataFrame(
        loads, "id string, cpu long, memory long, policy string, node_tags array<string>, pin string, spread boolean,"
        " status string")
    want = {}
    for i, cpu, mem, policy, tags, pin, spread, status in loads:
        if status != "active":
            continue
        fits = [
            m for m in nodes
            if m[4] == "active" and (not pin or pin == m[0]) and set(tags) <= set(m[1])
            and m[2] - m[6] >= cpu and m[3] - m[7] >= mem and not (spread and m[5] > 0)
        ]
        order = {"bin_pack": lambda m: (-(m[2] - m[6]), m[0]), "round_robin": lambda m: (m[5], m[0])}
        best = min(fits, key=order.get(policy, lambda m: (m[6], m[0])), default=(None,))
        want[i] = (len(fits), best[0])
    assert {r.id: (r.eligible, r.node_id) for r in cp.placements(w, n).collect()} == want


def test_top_candidates_brute_force(spark):
    import random

    rng = random.Random(5)
    caps = ["a", "b", "c", "d"]
    res = [
        (f"r{i}", i, rng.choice(["agent", "model"]), rng.sample(caps, rng.randint(0, 2)), rng.randint(0, 4) / 4, rng.randint(0, 3) * 1.0)
        for i in range(30)
    ]
    tasks = [(i, rng.sample(caps, rng.randint(0, 3))) for i in range(20)]
    r = spark.createDataFrame(res, "resource_id string, ord int, kind string, capability_ids array<string>, trust double, cost_estimate double")
    t = spark.createDataFrame(tasks, "task_id int, capabilities array<string>")
    got = {}
    for row in it.top_candidates(t, r, network=False).orderBy("task_id", "place").collect():
        got.setdefault(row.task_id, []).append(row.resource_id)
    for task, need in tasks:
        def score(x):
            fit = len(set(need) & set(x[3])) / len(need) if need else 0.5
            s = 0.65 * fit + 0.25 * x[4] + 0.10 / (1.0 + x[5])
            return s - 0.15 if x[2] == "model" else s
        ranked = sorted(res, key=lambda x: (score(x), x[4]), reverse=True)
        assert got[task] == [x[0] for x in ranked[:5]]


def test_text_rules(spark):
    cases = {
        "Latest contest digit": "cap://general/agent/execute",
        "run tests, then TEST": "cap://software/testing/execute",
        "report": "cap://general/agent/execute",
        "reports": "cap://general/agent/execute",
        "repository": "cap://software/repository/inspect",
        "étest": "cap://general/agent/execute",
        "git commit": "cap://software/git/operate",
        "verified": "cap://general/agent/execute",
    }
    # "report" starts with "repo": the first rule has no right boundary.
    cases["report"] = cases["reports"] = "cap://software/repository/inspect"
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    got = {r.t: ",".join(r.c) for r in df.select("t", it.tag_capabilities(F.col("t")).alias("c")).collect()}
    assert got == cases
    gate = spark.createDataFrame(
        [("Delete it", "A3"), ("delete it", "A2"), ("undelete", "A5"), ("redeploy", "A4"), ("drop-in", "A5")],
        "intent string, autonomy string",
    )
    assert [r.allowed for r in it.policy_gate(gate).collect()] == [False, True, True, True, False]


def test_redaction_depth(spark):
    deep = spark.sql(
        "select 'k' as api_key, named_struct('a', named_struct('b', named_struct('c', named_struct('d',"
        " named_struct('e', named_struct('f', 1, 'token', 't')))))) as n, array(map('Password', 'p', 'x', 'y')) as m"
    )
    row = redact_secrets(deep).first()
    assert row.api_key == "[REDACTED]" and row.m == [{"Password": "[REDACTED]", "x": "y"}]
    assert row.n.a.b.c.d.e.f == "<truncated>" and row.n.a.b.c.d.e.token == "[REDACTED]"


def test_event_rules(spark):
    df = spark.createDataFrame(
        [("t", '{"a": 1}'), ("t", "[]"), ("t", "[1]"), ("t", None), ("", "{}"), ("t", "{bad"), ("t", '"x"')],
        "topic string, payload string",
    )
    assert [len(r.errors) for r in ev.validate_event(df).collect()] == [0, 0, 1, 0, 1, 1, 1]
    log = spark.createDataFrame([("t", 0, 1, 5)], "topic string, partition int, id int, seq long")
    more = spark.createDataFrame([("t", 0, 9, 1), ("u", 0, 8, 1)], "topic string, partition int, id int, created_at int")
    assert {r.id: r.seq for r in ev.assign_sequence(more, existing=log).collect()} == {9: 6, 8: 1}


def test_gauge_and_histogram(spark):
    updates = spark.createDataFrame(
        [("g", "add", 5.0, 1, 1), ("g", "set", 2.0, 2, 2), ("g", "add", 3.0, 3, 3), ("h", "add", 1.0, 1, 4)],
        "name string, op string, value double, ts int, ord int",
    )
    assert {r.name: r.value for r in mt.gauge_latest(updates).collect()} == {"g": 5.0, "h": 1.0}
    samples = spark.createDataFrame([("l", v) for v in (0.001, 0.3, 99.0)], "name string, value double")
    counts = {r.le: r.bucket_count for r in mt.histogram_buckets(samples).collect()}
    assert counts[0.001] == 1 and counts[0.5] == 2 and counts[10.0] == 2 and len(counts) == 12


def test_namespaces(spark):
    df = spark.createDataFrame([("ok1",), ("",), ("1a",), ("a-b",), ("n" * 64,), ("n" * 65,), (None,)], "name string")
    assert [len(r.errors) == 0 for r in va.validate_namespace(df).collect()] == [True, False, False, False, True, False, False]


def test_clone_runs(spark):
    templates = spark.createDataFrame([("t", "nightly", 3)], "id string, name string, epoch long")
    nodes = spark.createDataFrame([("t", "a", "failed", 4)], "workflow_id string, node_id string, status string, attempts long")
    fires = spark.sql("select 't' as template_id, timestamp'2024-01-01 00:00:00.5' as fire_at")
    runs, fresh = wf.clone_runs(templates, nodes, fires)
    run, node = runs.first(), fresh.first()
    assert (run.id, run.status, run.epoch) == ("t.1704067200500", "pending", 4)
    assert (node.workflow_id, node.status, node.attempts) == (run.id, "pending", 0)


def test_json_numbers_and_strings_as_python_writes_them(spark):
    import random

    from opsframe.functions.keys import json_number, json_string

    rng = random.Random(1)
    values = [0.0, -0.0, 1e-5, 1e-4, 0.001, 1e7, 1.5e15, 1e16, 1e22, 1.7976931348623157e308, 1700000000.125, 123456789012345.6, -2.5e-7]
    values += [rng.uniform(-1, 1) * 10 ** rng.randint(-20, 25) for _ in range(300)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", json_number(F.col("v")).alias("t")).collect()
    assert all(float(r.t) == r.v for r in rows)
    assert sum(r.t != json.dumps(r.v) for r in rows) <= 0.05 * len(rows)  # Java 17 does not always find the shortest digits
    texts = ["".join(chr(rng.choice([*range(1, 40), 92, 117, 34, 0x7F, 0xE9, 0x1F600])) for _ in range(rng.randint(0, 30))) for _ in range(200)]
    rows = spark.createDataFrame([(t,) for t in texts], "v string").select("v", json_string(F.col("v")).alias("t")).collect()
    assert [r.t for r in rows] == [json.dumps(r.v) for r in rows]


def test_utc_whatever_the_session_zone(spark):
    from opsframe.functions.cron import cron_expand
    from opsframe.sources.jsonl import record_lines

    schedules = spark.createDataFrame([("a", "0 22 * * *")], "id string, expr string")
    try:
        for zone in ("Asia/Tokyo", "America/New_York", "UTC"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            at = lambda s: F.timestamp_seconds(F.lit(s))
            fires = cron_expand(schedules, at(1704067200 + 20 * 3600), at(1704067200 + 23 * 3600))
            assert [r.s for r in fires.select(F.unix_seconds("fire_at").alias("s")).collect()] == [1704067200 + 22 * 3600]
            records = spark.sql("select 'k' as kind, 'c' as content, map('a', 'b') as provenance")
            assert '"timestamp": "2024-01-01T00:00:00+00:00"' in record_lines(records, at(1704067200)).first()[0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_large_n_per_key(spark):
    from opsframe.operators.ordered import first_per_key

    df = spark.range(5000).selectExpr("id % 2 as k", "id")
    got = first_per_key(df, ["k"], ["id"], 1500)
    assert got.count() == 3000 and got.agg(F.max("id")).first()[0] == 2999
