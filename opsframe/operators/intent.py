"""From a task's text to capability tags, a policy verdict, ranked resources, a plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsframe.functions.keys import slugify
from opsframe.operators.ordered import first_per_key

# Rules that tag a lower-cased text, in order, and the fallback tag.  Each
# starts with the letters every match contains.
CAPABILITY_RULES = [
    ("repo", r"\brepos?", "cap://software/repository/inspect"),
    ("refactor", r"\brefactor(?:ing)?\b", "cap://software/code/refactor"),
    ("test", r"\btests?\b", "cap://software/testing/execute"),
    ("git", r"\bgit\b", "cap://software/git/operate"),
    ("commit", r"\bcommit\b", "cap://software/git/operate"),
    ("research", r"\bresearch\b", "cap://research/web"),
    ("browser", r"\bbrowser\b", "cap://interaction/browser"),
    ("verify", r"\bverify(?:ing|ied|y)?\b", "cap://verification/save-proof"),
]
FALLBACK_CAPABILITY = "cap://general/agent/execute"

# Words that need approval, and the autonomy levels that act.
DESTRUCTIVE_WORDS = ["delete", "destroy", "drop", "wipe", "transfer", "purchase", "deploy"]
ACTING_AUTONOMY = ["A3", "A4", "A5"]

# Weights of a candidate's score and the offline penalty.
FIT_WEIGHT, TRUST_WEIGHT, COST_WEIGHT = 0.65, 0.25, 0.10
NEUTRAL_FIT = 0.5
OFFLINE_PENALTY = 0.15
REMOTE_KINDS = ["model", "model-provider"]

# Names used in a task's plan.
PLAN_NAME_LENGTH = 48


def tag_capabilities(text: Column) -> Column:
    """Distinct capability tags of a text in rule order; the fallback when none fits."""

    def tags(lowered: Column) -> Column:
        # The plain substring test spares most texts the regular expression.
        return F.array_compact(
            F.array(
                *[
                    F.when(
                        F.contains(lowered, F.lit(stem)) & lowered.rlike("(?U)" + rule), F.lit(tag)
                    )
                    for stem, rule, tag in CAPABILITY_RULES
                ]
            )
        )

    # Mapping over one-element arrays names a value, so it is worked out once.
    hits = F.transform(F.array(F.lower(text)), tags)
    chosen = F.transform(
        hits,
        lambda h: F.when(F.size(h) > 0, F.array_distinct(h)).otherwise(
            F.array(F.lit(FALLBACK_CAPABILITY))
        ),
    )
    return F.get(chosen, F.lit(0))


def policy_blocked(text: Column, autonomy: Column) -> Column:
    """True when a destructive word meets an autonomy level that acts."""
    words = "|".join(DESTRUCTIVE_WORDS)
    return F.lower(text).rlike(rf"(?U)\b({words})\b") & autonomy.isin(ACTING_AUTONOMY)


def policy_gate(tasks: DataFrame) -> DataFrame:
    blocked = policy_blocked(F.col("intent"), F.col("autonomy"))
    return tasks.withColumn("allowed", ~blocked).withColumn(
        "reason", F.when(blocked, "Explicit human approval required.").otherwise("allowed")
    )


def net_cost(current: Column, reusable: Column) -> Column:
    return current - reusable


def _score(fit: Column, network: bool) -> Column:
    """Terms are added in this order, so equal inputs round alike."""
    score = (FIT_WEIGHT * fit + TRUST_WEIGHT * F.col("trust")) + COST_WEIGHT / (
        1.0 + F.col("cost_estimate")
    )
    if network:
        return score
    return score - F.when(F.col("kind").isin(REMOTE_KINDS), OFFLINE_PENALTY).otherwise(0.0)


_RESOURCE = ["resource_id", "ord", "kind", "trust", "cost_estimate"]


def _set_key(capabilities: str) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(capabilities)), " ")


def _scored(sets: DataFrame, resources: DataFrame, network: bool) -> DataFrame:
    """Score of each (capability set, resource) that share a capability.

    Joined on the capability, so a pair costs work only if it has one in common.
    """
    offered = resources.select(
        *_RESOURCE, F.explode(F.array_distinct("capability_ids")).alias("cap")
    )
    wanted = sets.select(
        "set_key", F.size("caps").alias("_size"), F.explode("caps").alias("cap")
    )
    shared = (
        wanted.join(offered, "cap")
        .groupBy("set_key", "_size", *_RESOURCE)
        .agg(F.count("*").alias("_shared"))
        .withColumn("fit", F.col("_shared") / F.col("_size"))
    )
    return shared.select(
        "set_key",
        "resource_id",
        "ord",
        "fit",
        _score(F.col("fit"), network).alias("score"),
        F.col("trust").alias("confidence"),
    )


def _capability_sets(tasks: DataFrame) -> DataFrame:
    return (
        tasks.select("set_key", F.array_sort(F.array_distinct("capabilities")).alias("caps"))
        .distinct()
    )


def capability_scores(
    tasks: DataFrame, resources: DataFrame, network: bool = True
) -> DataFrame:
    """Score of every resource that covers part of a capability set.

    ``tasks`` has (task_id, capabilities), ``resources`` (resource_id, ord, kind,
    capability_ids, trust, cost_estimate).  A score depends on a task only through its
    capability set, so there is one row per distinct set (``set_key``, with the
    number of tasks that ask for it) and covering resource, not one per task.
    Resources that cover nothing score alike for all: see ``uncovered_scores``.
    """
    keyed = tasks.withColumn("set_key", _set_key("capabilities"))
    asked = keyed.groupBy("set_key").agg(F.count("*").alias("tasks"))
    return _scored(_capability_sets(keyed), resources, network).join(asked, "set_key").drop("ord")


def uncovered_scores(resources: DataFrame, network: bool = True) -> DataFrame:
    """Score of each resource for a task it covers nothing of."""
    return resources.select(
        "resource_id",
        _score(F.lit(0.0), network).alias("score"),
        F.col("trust").alias("confidence"),
    )


def top_candidates(
    tasks: DataFrame, resources: DataFrame, n: int = 5, network: bool = True
) -> DataFrame:
    """Best ``n`` resources per task by score, then confidence, then registration.

    For each capability set only two kinds of resource can be among the best: those
    that share a capability, and the ``n`` best by the part of the score that does
    not depend on the task.  If one of those ``n`` shares a capability its score
    only grows, so no resource ranked after them can come in.
    """
    keyed = tasks.withColumn("set_key", _set_key("capabilities"))
    sets = _capability_sets(keyed)
    scored = _scored(sets, resources, network)
    ranked = resources.select(*_RESOURCE, _score(F.lit(0.0), network).alias("_base"))
    leaders = ranked.orderBy(F.desc("_base"), F.desc("trust"), "ord").limit(n)
    # At most n rows: a fixed-size list, carried along as one array.
    listed = leaders.agg(F.collect_list(F.struct(*_RESOURCE)).alias("l")).scalar()
    fit = F.when(F.size("caps") == 0, NEUTRAL_FIT).otherwise(0.0)
    general = (
        sets.select("set_key", fit.alias("fit"), F.explode(listed).alias("l"))
        .select("set_key", "fit", "l.*")
        .select(
            "set_key",
            "resource_id",
            "ord",
            "fit",
            _score(F.col("fit"), network).alias("score"),
            F.col("trust").alias("confidence"),
        )
    )
    covered = scored.select("set_key", "resource_id")
    general = general.join(covered, ["set_key", "resource_id"], "left_anti")
    pool = scored.select(*general.columns).unionByName(general).withColumns(
        {"_s": -F.col("score"), "_c": -F.col("confidence")}
    )
    best = first_per_key(pool, ["set_key"], ["_s", "_c", "ord"], n)
    places = (
        best.groupBy("set_key")
        .agg(
            F.array_sort(
                F.collect_list(F.struct("_s", "_c", "ord", "resource_id", "score", "confidence"))
            ).alias("list")
        )
        .select("set_key", F.posexplode("list").alias("_pos", "b"))
        .select(
            "set_key",
            (F.col("_pos") + 1).cast("bigint").alias("place"),
            F.col("b.resource_id").alias("resource_id"),
            F.col("b.score").alias("score"),
            F.col("b.confidence").alias("confidence"),
        )
    )
    return keyed.select("task_id", "set_key").join(places, "set_key").drop("set_key")


def expand_plan(
    tasks: DataFrame,
    name_prefix: str,
    topic_prefix: str,
    node_timeout: float = 300.0,
    retry_max: int = 3,
) -> tuple[DataFrame, DataFrame]:
    """One workflow per task and one event node per capability.

    ``tasks`` has (task_id, intent, capabilities).
    """
    caps = F.when(F.size("capabilities") > 0, F.col("capabilities")).otherwise(
        F.array(F.lit(FALLBACK_CAPABILITY))
    )
    name = F.substring(slugify(F.col("intent")), 1, PLAN_NAME_LENGTH)
    runs = tasks.select(
        "task_id",
        F.concat(
            F.lit(name_prefix), F.when(name == "", "task").otherwise(name)
        ).alias("name"),
        (F.lit(float(node_timeout)) * F.size(caps)).alias("timeout"),
        F.lit(True).alias("dead_letter"),
    )
    nodes = tasks.select("task_id", F.posexplode(caps).alias("i", "cap")).select(
        "task_id",
        F.concat(F.lit("cap-"), F.col("i")).alias("node_id"),
        F.col("cap").alias("name"),
        F.concat(F.lit(topic_prefix), slugify(F.col("cap"))).alias("event_topic"),
        F.lit(float(node_timeout)).alias("timeout"),
        F.lit(retry_max).cast("bigint").alias("retry_max"),
        F.lit(1.0).alias("backoff_base"),
        F.lit(60.0).alias("backoff_max"),
        F.lit(0.2).alias("jitter"),
        F.lit(16).cast("bigint").alias("max_concurrency"),
    )
    return runs, nodes


def save_proof(before: DataFrame, after: DataFrame, targets: DataFrame) -> DataFrame:
    """Was each target really saved?

    ``before`` and ``after`` are snapshots (path, hash; absent path: no such file),
    ``targets`` has (path, expected), expected may be null.
    """
    old = before.select("path", F.col("hash").alias("_old"))
    new = after.select("path", F.col("hash").alias("_new"), F.lit(True).alias("_there"))
    exists = F.coalesce("_there", F.lit(False))
    changed = ~F.col("_old").eqNullSafe(F.col("_new"))
    given = F.col("expected").isNotNull()
    matches = ~given | F.col("_new").eqNullSafe(F.col("expected"))
    return (
        targets.join(old, "path", "left")
        .join(new, "path", "left")
        .select(
            "path",
            exists.alias("exists"),
            changed.alias("changed"),
            matches.alias("expected_hash_ok"),
            (exists & F.when(given, matches).otherwise(changed)).alias("verified"),
        )
    )
