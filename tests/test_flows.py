from pyspark.sql import functions as F

from opsframe.plans import flows


def test_publish(spark):
    rows = [(1, "t", "a", '{"x": 1}', 1), (2, "t", "b", "[1]", 2), (3, "t", "c", "{}", 3), (4, "t", "d", None, 4), (5, "u", "e", "{}", 5)]
    messages = spark.createDataFrame(rows, "id int, topic string, key string, payload string, created_at int")
    lag = spark.createDataFrame([("t", 8)], "topic string, lag long")
    done = flows.publish(messages, max_lag=10, opening_lag=lag)
    assert {r.id for r in done.accepted.collect()} == {1, 3, 5}
    assert {r.id: r.reason for r in done.rejected.collect()} == {
        2: "event payload must be an object", 4: "topic 't' lag exceeds 10",
    }
    numbered = done.accepted.groupBy("topic", "partition").agg(F.max("seq").alias("m"), F.count("*").alias("n"))
    assert all(r.m == r.n for r in numbered.collect())


def test_tick(spark):
    workflows = spark.sql(
        "select * from values ('w', 'running', timestamp'2024-01-01', cast(null as double), false),"
        " ('late', 'pending', timestamp'2023-01-01', 60.0D, false), ('stop', 'running', timestamp'2024-01-01', null, true)"
        " as t(id, status, created_at, timeout, cancel_requested)"
    )
    nodes = spark.createDataFrame(
        [
            ("w", 1, [], "succeeded", "a", None, 9), ("w", 2, [1], "pending", "a", None, 9), ("w", 3, [1], "pending", None, "topic", 9),
            ("w", 4, [1], "pending", "none", None, 9), ("w", 5, [9], "pending", "a", None, 9), ("w", 9, [], "failed", "a", None, 9),
            ("w", 6, [1], "pending", "a", None, 1), ("w", 7, [1], "pending", "a", None, 9),
            ("late", 1, [], "pending", "a", None, 9), ("stop", 1, [], "pending", "a", None, 9),
        ],
        "workflow_id string, node_id int, depends_on array<int>, status string, workload_id string, event_topic string, max_concurrency int",
    )
    attempts = spark.createDataFrame([("w", 7, 1, "running")], "workflow_id string, node_id int, attempt_no long, status string")
    leases = spark.sql(
        "select * from values ('l2', 'a', 'active', timestamp'2024-01-02', timestamp'2025-01-01'),"
        " ('l1', 'a', 'active', timestamp'2024-01-01', timestamp'2025-01-01'), ('l0', 'a', 'active', timestamp'2023-01-01', timestamp'2023-02-01')"
        " as t(id, workload_id, state, created_at, expires_at)"
    )
    result = flows.tick(workflows, nodes, attempts, leases, F.lit("2024-06-01").cast("timestamp"))
    assert {(r.workflow_id, r.node_id, r.reason) for r in result.skipped.collect()} == {
        ("w", 5, "dependency failed"), ("late", 1, "workflow timeout"),
    }
    assert [(r.node_id, r.lease_id) for r in result.dispatched.collect()] == [(2, "l1")]
    assert [r.node_id for r in result.fired.collect()] == [3]
    assert {(r.node_id, r.reason) for r in result.waiting.collect()} == {(4, "no lease"), (6, "concurrency limit")}


def test_plan_tasks(spark):
    tasks = spark.createDataFrame(
        [(1, "run tests", "A2"), (2, "run tests", "A4"), (3, "drop tests", "A4")], "task_id int, intent string, autonomy string"
    )
    resources = spark.createDataFrame(
        [("r1", 1, "agent", ["cap://software/testing/execute"], 0.5, 0.0)],
        "resource_id string, ord int, kind string, capability_ids array<string>, trust double, cost_estimate double",
    )
    plans = flows.plan_tasks(tasks, resources, "task-", "plan/", "plan.task.")
    assert [r.task_id for r in plans.runs.collect()] == [1]
    assert plans.nodes.first().event_topic == "plan.task.cap-software-testing-execute"
    assert sorted(r.task_id for r in plans.candidates.collect()) == [1, 2]
