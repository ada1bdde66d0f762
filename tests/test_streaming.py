"""Streams over several files give the batch result and go on after a restart."""

import random
import time

from opsframe.operators import control as ct
from opsframe.operators.folds import Machine
from opsframe.streaming import consume as cs
from opsframe.streaming import stateful as st

SCHEMA = "name string, at_us long, id long, ok boolean"


def feed(spark, folder, rows, name):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").option(
        "maxFilesPerTrigger", "1"
    ).parquet(folder)


def test_breaker_stream_resumes(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(f"b{i % 2}", i * 1_000_000, i, i % 5 == 0) for i in range(60)]
    machine = Machine(
        start=lambda row: ["closed", [], 0],
        step=ct.breaker_step(3, 10_000_000, 4_000_000),
        outputs=[("allowed", "boolean"), ("state", "string")],
    )
    for name, part in (("1", rows[:25]), ("2", rows[25:])):
        feed(spark, source, part, name)
        folded = st.fold_stream(stream(spark, source), ["name"], ["at_us", "id"], machine)
        got = cs.run_to_files(folded, out)  # the second run starts from the checkpoint
    batch = ct.breaker_states(spark.createDataFrame(rows, SCHEMA), 3, 10.0, 4.0)
    assert sorted(got.select("id", "allowed", "state").collect()) == sorted(
        batch.select("id", "allowed", "state").collect()
    )


REQUESTS = "id long, ts_us long, idem_key string, digest string"


def told(spark, source, out, ttl=None):
    stream = spark.readStream.schema(REQUESTS).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", "1").parquet(source)
    return {r.id: (r.kind, r.answer_id) for r in cs.run_to_files(st.dedup_stream(stream, ttl), out).collect()}


def parted(spark, folder, rows, parts):
    for i in range(parts):
        part = rows[len(rows) * i // parts : len(rows) * (i + 1) // parts]
        spark.createDataFrame(part[::-1], REQUESTS).coalesce(1).write.parquet(f"{folder}/{i}")


def test_dedup_does_not_depend_on_the_cut(spark, tmp_path):
    """One key holds a fifth of the rows; nulls and empty keys are never replays; a stream goes on after a restart."""
    rng = random.Random(3)
    keys = ["hot"] * 10 + [f"k{i}" for i in range(30)] + [None, ""] * 4
    rows = [(i, 1000 + i // 2, rng.choice(keys), rng.choice(["a", "a", "b", None])) for i in range(200)]
    want, first = {}, {}
    for i, _, key, digest in rows:
        if not key or key not in first:
            want[i] = ("fresh", i)
            first[key] = (digest, i)
        else:
            known, answer = first[key]
            want[i] = ("replay", answer) if digest == known else ("conflict", i)
    for parts in (1, 3):
        source = str(tmp_path / f"in{parts}")
        parted(spark, source, rows, parts)
        assert told(spark, source, str(tmp_path / f"out{parts}")) == want
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    parted(spark, f"{source}/x", rows[:120], 1)
    told(spark, source, out)
    parted(spark, f"{source}/y", rows[120:], 2)
    assert told(spark, source, out) == want


def test_dedup_forgets_after_its_time(spark, tmp_path):
    """A running query, as the clock only goes on in one."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    parted(spark, f"{source}/x", [(1, 1, "k", "a"), (2, 2, "k", "a")], 1)
    stream = spark.readStream.schema(REQUESTS).option("recursiveFileLookup", "true").parquet(source)
    query = (
        st.dedup_stream(stream, 8).writeStream.format("memory").queryName("forgetful")
        .option("checkpointLocation", out).trigger(processingTime="1 second").start()
    )

    def seen(n):
        until = time.time() + 60
        while time.time() < until and query.exception() is None and spark.table("forgetful").count() < n:
            time.sleep(0.5)
        return {r.id: (r.kind, r.answer_id) for r in spark.table("forgetful").collect()}

    try:
        assert seen(2) == {1: ("fresh", 1), 2: ("replay", 1)}
        time.sleep(10)
        parted(spark, f"{source}/y", [(3, 3, "k", "b"), (4, 4, "k", "b")], 1)
        assert seen(4) == {1: ("fresh", 1), 2: ("replay", 1), 3: ("fresh", 3), 4: ("replay", 3)}
    finally:
        query.stop()


def test_consumer_isolates_poison_and_resumes(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")

    def handler(payload):
        if payload == "bad":
            raise ValueError("poison")

    for name, ids in (("1", range(4)), ("2", range(4, 8))):
        feed(spark, source, [("bad" if i % 4 == 1 else "fine", 0, i, True) for i in ids], name)
        events = stream(spark, source).selectExpr("id", "'t' as topic", "name as payload")
        cs.consume_stream(events, out, handler, max_attempts=2).trigger(availableNow=True).start().awaitTermination()
    done = {r.id: (r.ok, r.tries) for r in cs.settled(spark, out).collect()}
    assert done == {i: (i % 4 != 1, 2 if i % 4 == 1 else 1) for i in range(8)}
    assert {(r.id, r.error, r.attempts) for r in cs.dead_letters(spark, out).collect()} == {(1, "poison", 2), (5, "poison", 2)}


def test_a_repeated_batch_leaves_one_record(spark, tmp_path):
    batch = spark.createDataFrame([(1, "t", "bad"), (2, "t", "ok")], "id long, topic string, payload string")

    def handler(payload):
        if payload == "bad":
            raise ValueError("")

    for _ in range(2):
        cs.deliver_batch(batch, 0, str(tmp_path), handler, 3)
    assert cs.settled(spark, str(tmp_path)).count() == 2
    assert cs.dead_letters(spark, str(tmp_path)).first().error == "max attempts exceeded"


def called(spark, tmp_path, name, make, schema, batches):
    """Rows of a stream over ``batches``, one a micro-batch; calls of its state function per row of input would be slow."""
    source = str(tmp_path / f"in-{name}")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{source}/{i}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(source)
        got = cs.run_to_files(make(stream), str(tmp_path / f"out-{name}"))
    return got


def test_keys_of_a_group_keep_states_of_their_own(spark, tmp_path):
    """Two keys a row of it null, cut anywhere: as each key by itself; a hot key is given out slice by slice."""
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", "c", None]), i, rng.randrange(3)) for i in range(300)]
    machine = Machine(start=lambda row: 0, step=lambda s, row: (s + row[2], (s + row[2],)), outputs=[("total", "long")])
    total, want = {}, []
    for name, i, n in rows:
        total[name] = total.get(name, 0) + n
        want.append((name, i, n, total[name]))
    for groups in (1, 3, None):
        make = lambda stream: st.fold_stream(stream, ["name"], ["i"], machine, groups=groups)  # noqa: E731, B023
        got = called(spark, tmp_path, str(groups), make, "name string, i long, n long", [rows[:110], rows[110:]])
        assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == want


def test_timeouts_of_one_group(spark, tmp_path):
    """All attempts in one group, ends in the same or a later micro-batch, late or never: one timer reports each once."""
    from datetime import datetime, timedelta

    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    first = [("open", at(0), True, 10_000), ("ok", at(0), True, 10_000), ("ok", at(5), False, 10_000), ("late", at(0), True, 10_000),
             ("late", at(11), False, 10_000), ("next", at(8), True, 10_000), ("slow", at(9), True, 10_000), ("far", at(9), True, 900_000)]
    second = [("next", at(15), False, 10_000), ("slow", at(25), False, 10_000), ("none", at(26), False, 10_000)]
    got = called(
        spark, tmp_path, "timeouts", lambda s: st.timeout_stream(s, "0 seconds", groups=1),
        "attempt_id string, ts timestamp, running boolean, timeout_ms long", [first, second],
    )
    begin = int((datetime(2024, 1, 1) - datetime(1970, 1, 1)).total_seconds()) * 1000
    assert sorted((r.attempt_id, r.due_ms - begin) for r in got.collect()) == [("late", 10_000), ("open", 10_000), ("slow", 19_000)]


def test_dedup_without_expiry_needs_no_call_per_key(spark, tmp_path):
    """Many keys share one group over two micro-batches; ids beyond 2^53 and null digests stay what they are."""
    big = 1 << 60
    rows = [(big + i, i, f"k{i % 40}", None if i % 3 == 0 else "a") for i in range(160)]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for i, part in enumerate((rows[:70], rows[70:])):
        spark.createDataFrame(part[::-1], REQUESTS).coalesce(1).write.parquet(f"{source}/{i}")
        stream = spark.readStream.schema(REQUESTS).option("recursiveFileLookup", "true").parquet(source)
        got = cs.run_to_files(st.dedup_stream(stream, None, groups=1), out)
    first = {k: (d, i) for i, _, k, d in reversed(rows)}
    want = {}
    for i, _, k, d in rows:
        want[i] = ("fresh", i) if first[k][1] == i else ("replay", first[k][1]) if first[k][0] == d else ("conflict", i)
    assert {r.id: (r.kind, r.answer_id) for r in got.collect()} == want
