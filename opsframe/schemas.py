"""Fixed schemas and value domains.  Nothing is inferred from data."""

from __future__ import annotations

# Wire names of the states and the moves each machine allows.
TRANSITIONS: dict[str, dict[str, list[str]]] = {
    "workflow": {
        "pending": ["running", "cancelled"],
        "running": ["succeeded", "failed", "cancelled", "timed_out"],
    },
    "node": {
        "pending": ["dispatched", "skipped", "cancelled"],
        "dispatched": [
            "running",
            "succeeded",
            "failed",
            "timed_out",
            "cancelled",
            "skipped",
            "pending",
        ],
        "running": ["succeeded", "failed", "timed_out", "cancelled", "skipped"],
        "failed": ["pending"],
        "timed_out": ["pending"],
    },
    "attempt": {"running": ["succeeded", "failed", "timed_out", "cancelled"]},
    "lease": {
        "active": ["renewing", "expired", "released"],
        "renewing": ["active", "expired", "released"],
    },
    "event": {"pending": ["delivered", "dead"]},
}

# Placement policies, token scopes, secret keys, log levels.
POLICIES = ["fifo", "priority", "round_robin", "bin_pack"]
SECRET_KEYS = [
    "secret",
    "secret_hash",
    "token",
    "password",
    "authorization",
    "api_key",
]
LOG_LEVELS = ["debug", "info", "warn", "error", "fatal"]

# Default histogram bounds in seconds.
HISTOGRAM_BOUNDS = [0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]

NODE_DONE = ["succeeded", "failed", "timed_out", "cancelled", "skipped"]
RUN_DONE = ["succeeded", "failed", "timed_out", "cancelled"]

# Stored JSON payload of each entity; times are epoch seconds.
ENTITIES: dict[str, str] = {
    "tokens": "id string, namespace string, scopes array<string>, secret_hash string,"
    " created_at double, expires_at double",
    "workloads": "id string, namespace string, name string, image string,"
    " replicas bigint, min_replicas bigint, max_replicas bigint, cpu bigint,"
    " memory bigint, policy string, node_tags array<string>, pin string,"
    " spread boolean, priority bigint, status string, desired_replicas bigint,"
    " created_at double, updated_at double,"
    " scaler struct<cooldown_seconds:double,"
    "metrics:map<string,struct<target:double,min:double,max:double>>>,"
    " health_path string",
    "nodes": "id string, name string, tags array<string>, capacity_cpu bigint,"
    " capacity_mem bigint, state string, used_cpu bigint, used_mem bigint,"
    " created_at double, last_heartbeat double",
    "leases": "id string, workload_id string, namespace string, node_id string,"
    " holder string, nonce string, expires_at double, state string,"
    " attempt bigint, trace_id string, created_at double, cancellable boolean",
    "workflows": "id string, namespace string, name string, nodes array<struct<"
    "id:string,name:string,depends_on:array<string>,workload_id:string,"
    "event_topic:string,retry_max:bigint,backoff_base:double,backoff_max:double,"
    "jitter:double,timeout:double,max_concurrency:bigint,status:string,"
    "attempts:bigint,next_retry_at:double,error:string,finished_at:double,"
    "started_at:double>>, status string, created_at double, updated_at double,"
    " timeout double, schedule string, dead_letter boolean, trace_id string,"
    " error string, cancel_requested boolean, epoch bigint",
    "attempts": "id string, workflow_id string, node_id string, attempt_no bigint,"
    " lease_id string, status string, started_at double, finished_at double,"
    " error string, trace_id string",
    "events": "id string, topic string, key string, partition bigint, seq bigint,"
    " payload string, schema_version bigint, trace_id string, created_at double,"
    " status string, delivery_attempts map<string,int>",
    "dlq": "id string, topic string, partition bigint, seq bigint, `group` string,"
    " error string, attempts bigint, created_at double",
}

# Values of keys an older writer may have left out of a payload.
ENTITY_DEFAULTS: dict[str, dict[str, str]] = {
    "workloads": {"scaler": "named_struct('cooldown_seconds', cast(null as double),"
                            " 'metrics', cast(map() as map<string,struct<target:double,min:double,max:double>>))"},
    "leases": {"trace_id": "''", "created_at": "0.0D", "cancellable": "false"},
    "workflows": {
        "dead_letter": "true",
        "trace_id": "''",
        "cancel_requested": "false",
        "epoch": "1L",
    },
    "attempts": {"trace_id": "''"},
    "events": {
        "trace_id": "''",
        "delivery_attempts": "cast(map() as map<string,int>)",
    },
}

# The given tables; ``timestamp`` columns are read as UTC instants.
TABLES: dict[str, str] = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int,"
    " c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string,"
    " p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string,"
    " o_totalprice double, o_orderdate timestamp, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint,"
    " l_linenumber int, l_quantity double, l_extendedprice double,"
    " l_discount double, l_tax double, l_returnflag string, l_linestatus string,"
    " l_shipdate timestamp",
    "events": "event_id bigint, ts timestamp, user_id bigint, event_type string,"
    " value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string,"
    " n_chars bigint",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "pages": "page_id bigint, url string, html string",
    "labels": "doc_id bigint, quality int, toxic int",
    "benchmark": "item_id bigint, text string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
}
