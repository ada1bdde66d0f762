"""Operational entities derived from the given tables (see FIXTURES.md, part B).

Every view is a projection, aggregation or window over whole tables, so its size
grows with them.  ``catalog/views.py`` holds the same views as SQL for checking.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsframe.operators.ordered import ordered_columns
from opsframe.schemas import TABLES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def published(spark, sf_dir) -> DataFrame:
    """Events as published: no sequence number yet."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id as id",
        "event_type as topic",
        "cast(user_id as string) as key",
        "cast(user_id % 4 as int) as partition",
        "props as payload",
        "1 as schema_version",
        "ts as created_at",
        "case when event_id % 5 = 0 then 'delivered'"
        " when event_id % 23 = 0 then 'dead' else 'pending' end as status",
        "map('g1', cast(event_id % 7 as int)) as delivery_attempts",
    )


def bus_events(spark, sf_dir) -> DataFrame:
    return ordered_columns(
        published(spark, sf_dir),
        ["topic", "partition"],
        ["created_at", "id"],
        number="seq",
    )


def bus_offsets(events: DataFrame) -> DataFrame:
    """Half of each of the first three partitions is consumed by group g1."""
    return (
        events.filter("partition < 3")
        .groupBy("topic", "partition")
        .agg(F.expr("cast(floor(max(seq) / 2) as bigint)").alias("seq"))
        .withColumn("grp", F.lit("g1"))
    )


def acks(spark, sf_dir) -> DataFrame:
    return (
        table(spark, sf_dir, "events")
        .select(
            "event_id",
            "event_type",
            "ts",
            F.explode(F.expr("sequence(1, cast(1 + event_id % 6 as int))")).alias("n"),
        )
        .selectExpr(
            "event_id",
            "event_type as topic",
            "concat('g', event_id % 2) as grp",
            "n as ack_no",
            "timestampadd(second, n * 30, ts) as ack_ts",
            "(n = 1 + event_id % 6 and event_id % 4 <> 0) as ok",
            "concat('err-', event_id % 3) as error",
        )
    )


def compute_nodes(spark, sf_dir) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    return (
        table(spark, sf_dir, "supplier")
        .join(nation, F.expr("s_nationkey = n_nationkey"))
        .join(region, F.expr("n_regionkey = r_regionkey"))
        .selectExpr(
            "cast(s_suppkey as string) as id",
            "s_name as name",
            "array(r_name) as tags",
            "1000 + 1000 * (s_suppkey % 4) as capacity_cpu",
            "2048 * (1 + s_suppkey % 3) as capacity_mem",
            "case s_suppkey % 10 when 0 then 'cordoned' when 1 then 'draining'"
            " when 2 then 'offline' else 'active' end as state",
        )
    )


def workloads(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "cast(p_partkey as string) as id",
        "p_brand as namespace",
        "p_name as name",
        "cast(50 + 10 * (p_size % 10) as bigint) as cpu",
        "cast(64 + 32 * (p_size % 6) as bigint) as memory",
        "element_at(array('fifo','priority','round_robin','bin_pack'),"
        " cast(1 + p_partkey % 4 as int)) as policy",
        "case when p_partkey % 3 = 0 then array(element_at("
        "array('ASIA','EUROPE','AMERICA','AFRICA','MIDDLE EAST'),"
        " cast(1 + p_partkey % 5 as int))) else cast(array() as array<string>) end"
        " as node_tags",
        "case when p_partkey % 50 = 0 then cast(1 + p_partkey div 50 as string) end as pin",
        "p_partkey % 40 = 0 as spread",
        "cast(p_size % 3 as bigint) as priority",
        "case when p_partkey % 17 = 0 then 'paused' else 'active' end as status",
        "p_partkey % 4 as desired_replicas",
        "0L as min_replicas",
        "60L as max_replicas",
        "timestampadd(minute, p_partkey, timestamp'1995-01-01') as created_at",
    )


def leases(spark, sf_dir) -> DataFrame:
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_partkey", "l_suppkey")
        .agg(
            F.min("l_shipdate").alias("created_at"),
            F.max("l_shipdate").alias("last"),
            F.min("l_returnflag").alias("flag"),
        )
        .selectExpr(
            "concat(l_partkey, '-', l_suppkey) as id",
            "cast(l_partkey as string) as workload_id",
            "cast(l_suppkey as string) as node_id",
            "created_at",
            "timestampadd(day, 200, last) as expires_at",
            # Some nodes have given everything back, so that there is room somewhere.
            "case when flag = 'R' or l_suppkey % 13 = 5 then 'released' else 'active' end as state",
        )
    )


def workflows(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "cast(o_orderkey as string) as id",
        "cast(o_custkey as string) as namespace",
        "concat('run-', o_orderpriority) as name",
        "case o_orderstatus when 'F' then 'running' when 'O' then 'pending'"
        " else 'running' end as status",
        "o_orderdate as created_at",
        "case when o_orderkey % 3 = 0 then 86400.0D * 900 end as timeout",
        "o_orderkey % 11 = 0 as cancel_requested",
        "o_orderkey % 2 = 0 as dead_letter",
    )


def wf_nodes(spark, sf_dir) -> DataFrame:
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey", "l_linenumber")
        .agg(
            F.min("l_partkey").alias("part"),
            F.min("l_quantity").alias("quantity"),
        )
        .selectExpr(
            "cast(l_orderkey as string) as workflow_id",
            "l_linenumber as node_id",
            "case when l_linenumber > 1 then array(l_linenumber div 2)"
            " else cast(array() as array<bigint>) end as depends_on",
            "cast(part as string) as workload_id",
            "cast(l_linenumber % 4 as int) as retry_max",
            "element_at(array('succeeded','succeeded','succeeded','pending','pending',"
            "'dispatched','failed','timed_out','cancelled','succeeded'),"
            " 1 + cast(floor(quantity) as int) % 10) as status",
            "cast(1 + l_linenumber % 3 as bigint) as max_concurrency",
        )
        .withColumn("depends_on", F.col("depends_on").cast("array<int>"))
    )


def attempts(spark, sf_dir) -> DataFrame:
    numbered = ordered_columns(
        table(spark, sf_dir, "lineitem").select(
            "l_orderkey",
            "l_linenumber",
            "l_shipdate",
            "l_partkey",
            "l_suppkey",
            "l_extendedprice",
            "l_quantity",
            "l_returnflag",
            "l_linestatus",
        ),
        ["l_orderkey", "l_linenumber"],
        ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"],
        number="attempt_no",
    )
    return numbered.selectExpr(
        "cast(l_orderkey as string) as workflow_id",
        "l_linenumber as node_id",
        "attempt_no",
        "l_shipdate as started_at",
        "timestampadd(second, cast(floor(l_quantity) as int), l_shipdate) as finished_at",
        "case concat(l_returnflag, l_linestatus) when 'AF' then 'failed'"
        " when 'RO' then 'timed_out' when 'NO' then 'running'"
        " else 'succeeded' end as status",
    )


def requests(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id as id",
        "ts",
        "case when event_id % 9 <> 0 then"
        " concat(user_id, ':', cast(floor(value / 20) as int)) end as idem_key",
        "sha2(event_type, 256) as digest",
    )


def calls(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id as id",
        "ts",
        "cast(user_id % 5 as string) as name",
        "event_type <> 'error' as ok",
    )


def status_log(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "cast(l_orderkey as string) as record_id",
        "'node' as kind",
        "l_shipdate as changed_at",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        "l_extendedprice",
        "element_at(array('pending','dispatched','succeeded','failed','timed_out',"
        "'cancelled','skipped'), cast(1 + l_suppkey % 7 as int)) as status",
    )


STATUS_LOG_ORDER = [
    "changed_at",
    "l_linenumber",
    "l_partkey",
    "l_suppkey",
    "l_extendedprice",
]


def run_requests(spark, sf_dir) -> DataFrame:
    asked = (
        table(spark, sf_dir, "orders")
        .selectExpr(
            "cast(o_orderkey as string) as workflow_id",
            "case o_orderkey % 2 when 0 then 'cancel' else 'retry' end as action",
        )
    )
    missing = spark.range(1).selectExpr("'missing' as workflow_id", "'cancel' as action")
    return asked.unionByName(missing)


def metric_samples(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "cast(user_id as string) as workload_id",
        "case event_type when 'click' then 'cpu' when 'view' then 'memory'"
        " when 'error' then 'queue' else 'throughput' end as metric",
        "ts",
        "event_id as ord",
        "value",
    )


def heartbeats(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("event_type as loop", "ts")


def audit(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id as id",
        "ts",
        "cast(user_id as string) as actor",
        "event_type as action",
        "props as resource",
    )


def ledger_body(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "conversations").selectExpr(
        "conv_id as chain_id",
        "turn as seq",
        "concat(role, ': ', text) as body",
    )


def tasks(spark, sf_dir) -> DataFrame:
    """Intents: one ASCII phrase per order, with word-boundary traps."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as task_id",
        "concat(element_at(array('Inspect the repos','Refactoring pass','run TESTS now',"
        "'latest contest digit','Git commit of work','research the web',"
        "'open Browser tab','verifying proof','plain chore','send report',"
        "'undelete row','redeploy unit','delete row','deploy unit','drop it',"
        "'wipe disk then verify'), cast(1 + o_orderkey % 16 as int)),"
        " ' for ', o_orderpriority) as intent",
        "concat('A', o_orderkey % 6) as autonomy",
    )


def resources(spark, sf_dir) -> DataFrame:
    """Registered resources, one per supplier."""
    return table(spark, sf_dir, "supplier").selectExpr(
        "concat('agent://', s_suppkey) as resource_id",
        "s_suppkey as ord",
        "element_at(array('agent','model','model-provider'),"
        " cast(1 + s_suppkey % 3 as int)) as kind",
        "array(concat('cap://', element_at(array('software/repository/inspect',"
        "'software/code/refactor','software/testing/execute','software/git/operate',"
        "'research/web'), cast(1 + s_suppkey % 5 as int))),"
        " concat('cap://', element_at(array('interaction/browser',"
        "'verification/save-proof','general/agent/execute'),"
        " cast(1 + s_suppkey % 3 as int)))) as capability_ids",
        "(s_suppkey % 11) / 10.0D as trust",
        "(s_suppkey % 7) * 0.5D as cost_estimate",
    )


def schedules(spark, sf_dir) -> DataFrame:
    """One cron expression per customer, some of them malformed."""
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey as schedule_id",
        "case c_custkey % 8"
        " when 0 then concat(c_custkey % 60, ' ', c_custkey % 24, ' * * *')"
        " when 1 then '*/15 8 1,15 * *'"
        " when 2 then '0 0 * * 0'"
        " when 3 then '0 0 13 * 5'"
        " when 4 then '5-20/5 8 1,15 * *'"
        " when 5 then '0 0 31 2 *'"
        " when 6 then concat(c_custkey % 70, ' 1 * * *')"
        " else concat('1 2 3 4', repeat(' 5', cast(c_custkey % 3 as int))) end as expr",
    )


def log_records(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id as id",
        "element_at(array('debug','info','warn','error','fatal','trace'),"
        " cast(1 + event_id % 6 as int)) as level",
        "event_type as event",
        "named_struct('user', user_id, 'Token', concat('t', user_id),"
        " 'note', event_type, 'inner', named_struct('password',"
        " case when event_id % 2 = 0 then props end, 'value', props),"
        " 'items', array(named_struct('api_key', props, 'n', event_id)),"
        " 'labels', map('Secret', event_type, 'plain', event_type)) as fields",
    )
