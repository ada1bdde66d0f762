"""Definition checks: raw rows in, defaults filled and an ``errors`` list out.

The first error is the one a caller would see first; an empty list means valid.
The error texts are fixed values that callers match on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsframe.operators.workflow import cyclic_workflows, dangling_dependencies, duplicate_ids
from opsframe.schemas import POLICIES


def _errors(*checks: tuple[Column, str]) -> Column:
    """Messages of the checks that are not true; unknown counts as broken."""
    return F.array_compact(
        F.array(*[F.when(~F.coalesce(good, F.lit(False)), F.lit(text)) for good, text in checks])
    )


def _length_between(column: str, low: int, high: int) -> Column:
    return F.length(column).between(low, high)


def _default(df: DataFrame, column: str, value: Column, kind: str) -> Column:
    if column in df.columns:
        return F.coalesce(F.col(column).cast(kind), value.cast(kind)).alias(column)
    return value.cast(kind).alias(column)


def validate_namespace(rows: DataFrame) -> DataFrame:
    return rows.withColumn(
        "errors",
        _errors(
            (_length_between("name", 1, 64), "namespace name must be 1-64 chars"),
            (
                F.col("name").rlike(r"^\p{L}[\p{L}\p{Nd}\p{Nl}\p{No}]*$"),
                "namespace must be alnum, starting with a letter",
            ),
        ),
    )


def validate_workload(rows: DataFrame) -> DataFrame:
    """Fill defaults of a workload definition and list what is wrong with it."""
    filled = rows.select(
        *[
            c
            for c in rows.columns
            if c not in ("replicas", "cpu", "memory", "min_replicas", "policy", "priority")
        ],
        _default(rows, "replicas", F.lit(1), "bigint"),
        _default(rows, "cpu", F.lit(100), "bigint"),
        _default(rows, "memory", F.lit(128), "bigint"),
        _default(rows, "min_replicas", F.lit(0), "bigint"),
        F.lower(_default(rows, "policy", F.lit("bin_pack"), "string")).alias("policy"),
        _default(rows, "priority", F.lit(0), "bigint"),
    )
    most = F.greatest(F.lit(1), F.col("replicas") * 4)
    filled = filled.withColumn("max_replicas", _default(filled, "max_replicas", most, "bigint"))
    replicas, low, high = F.col("replicas"), F.col("min_replicas"), F.col("max_replicas")
    return filled.withColumn("desired_replicas", replicas).withColumn(
        "errors",
        _errors(
            (_length_between("name", 1, 128), "workload name is required (1-128 chars)"),
            (F.length("image") > 0, "image is required"),
            (replicas >= 0, "replicas must be >= 0"),
            ((F.col("cpu") > 0) & (F.col("memory") > 0), "cpu/memory must be > 0"),
            (
                (low >= 0) & (low <= replicas) & (replicas <= high) & (high < 10_000),
                "min <= replicas <= max",
            ),
            (F.col("policy").isin(POLICIES), "policy must be one of: " + ", ".join(POLICIES)),
        ),
    )


def validate_node(rows: DataFrame) -> DataFrame:
    filled = rows.select(
        *[c for c in rows.columns if c not in ("cpu", "memory")],
        _default(rows, "cpu", F.lit(1000), "bigint"),
        _default(rows, "memory", F.lit(2048), "bigint"),
        F.lit("active").alias("state"),
    )
    return filled.withColumn(
        "errors",
        _errors(
            (F.length("name") > 0, "node name is required"),
            ((F.col("cpu") > 0) & (F.col("memory") > 0), "node cpu/memory must be > 0"),
        ),
    )


def validate_workflow_node(rows: DataFrame) -> DataFrame:
    """Check node definitions (workflow_id, id, name, depends_on, workload_id,
    event_topic, exec{workload_id, topic}, retry{max, base_seconds, max_seconds,
    jitter}, timeout, max_concurrency) and fill their defaults."""

    def given(column: str) -> Column:
        return F.nullif(F.col(column), F.lit(""))

    deps = F.coalesce("depends_on", F.expr("cast(array() as array<string>)"))
    filled = rows.select(
        "workflow_id",
        "id",
        F.coalesce("name", "id").alias("name"),
        deps.alias("depends_on"),
        F.coalesce(given("workload_id"), given("exec.workload_id")).alias("workload_id"),
        F.coalesce(given("event_topic"), given("exec.topic")).alias("event_topic"),
        F.coalesce("retry.max", F.lit(3)).cast("bigint").alias("retry_max"),
        F.coalesce("retry.base_seconds", F.lit(1.0)).alias("backoff_base"),
        F.coalesce("retry.max_seconds", F.lit(60.0)).alias("backoff_max"),
        F.coalesce("retry.jitter", F.lit(0.2)).alias("jitter"),
        F.nullif(F.col("timeout"), F.lit(0.0)).alias("timeout"),
        F.coalesce("max_concurrency", F.lit(16)).cast("bigint").alias("max_concurrency"),
        F.lit("pending").alias("status"),
    )
    one_target = F.col("workload_id").isNotNull() != F.col("event_topic").isNotNull()
    return filled.withColumn(
        "errors",
        _errors(
            (F.length("name") > 0, "node name is required"),
            (~F.array_contains("depends_on", F.col("id")), "a node cannot depend on itself"),
            (one_target, "node must exec exactly one of workload_id | event_topic"),
            (F.col("retry_max").between(0, 100), "retry max must be 0..100"),
        ),
    )


def validate_workflow(workflows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Check workflow definitions (id, name, timeout, dead_letter) with their
    nodes (workflow_id, node_id, depends_on), the graph included."""
    counts = nodes.groupBy("workflow_id").agg(
        F.count("*").alias("nodes"),
        F.count_if(F.coalesce(F.col("node_id").cast("string"), F.lit("")) == "").alias("_unnamed"),
    )
    repeated = duplicate_ids(nodes).select("workflow_id", F.lit(True).alias("_twice")).distinct()
    dangling = dangling_dependencies(nodes).select(
        "workflow_id", F.lit(True).alias("_dangling")
    ).distinct()
    cyclic = cyclic_workflows(nodes).select("workflow_id", F.lit(True).alias("_cyclic"))
    joined = workflows.withColumnRenamed("id", "workflow_id")
    for part in (counts, repeated, dangling, cyclic):
        joined = joined.join(part, "workflow_id", "left")

    def absent(flag: str) -> Column:
        return F.col(flag).isNull()

    return (
        joined.withColumn(
            "errors",
            _errors(
                (_length_between("name", 1, 128), "workflow name is required"),
                (F.coalesce("nodes", F.lit(0)) >= 1, "workflow needs at least one node"),
                (F.coalesce("_unnamed", F.lit(0)) == 0, "each node needs an id"),
                (absent("_twice"), "duplicate node id"),
                (absent("_dangling"), "node depends on unknown node"),
                (
                    absent("_cyclic") | ~absent("_dangling") | ~absent("_twice"),
                    "workflow DAG contains a cycle",
                ),
                (F.col("timeout").isNull() | (F.col("timeout") >= 0), "workflow timeout must be > 0"),
            ),
        )
        .withColumn("dead_letter", F.coalesce("dead_letter", F.lit(True)))
        .drop("_unnamed", "_twice", "_dangling", "_cyclic")
    )
