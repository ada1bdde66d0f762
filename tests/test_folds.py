"""Ordered folds agree with a plain loop per key, on whole keys and on slices."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as some

from opsframe.operators import compute as cp
from opsframe.operators import control as ct
from opsframe.operators import events as ev
from opsframe.operators import ledger as lg
from opsframe.operators import workflow as wf

S = 1_000_000


def loop(rows, start, step):
    """Outputs per row of one key."""
    out, state = [], None
    for i, row in enumerate(rows):
        if i == 0:
            state = start(row)
        state, result = step(state, row)
        out.append(result)
    return out


def calls(n, seed, span=400):
    rng = random.Random(seed)
    return [
        (rng.choice(["hot", "hot", "hot", "b"]), rng.randint(0, span) * S // 2, i, rng.random() < 0.5)
        for i in range(n)
    ]


def by_key(data):
    groups = {}
    for row in sorted(data, key=lambda r: (r[0], r[1], r[2])):
        groups.setdefault(row[0], []).append(row)
    return groups


def test_rate_limit(spark, both_ways):
    data = calls(150, 1)
    df = spark.createDataFrame(data, "key string, at_us long, id long, ok boolean")
    got = {r.id: (r.allowed, r.retry_after_us) for r in ct.rate_limit(df, "key", 3, 10.0).collect()}
    want = {}
    for rows in by_key(data).values():
        for row, out in zip(rows, loop(rows, lambda r: None, ct.window_step(3, 10 * S))):
            want[row[2]] = out
    assert got == want


def test_breaker_states(spark, both_ways):
    data = calls(200, 2)
    df = spark.createDataFrame(data, "name string, at_us long, id long, ok boolean")
    got = {r.id: (r.allowed, r.state) for r in ct.breaker_states(df, 3, 10.0, 5.0).collect()}
    want = {}
    for rows in by_key(data).values():
        step = ct.breaker_step(3, 10 * S, 5 * S)
        for row, out in zip(rows, loop(rows, lambda r: ["closed", [], 0], step)):
            want[row[2]] = out
    assert got == want


def test_breaker_trips(spark, both_ways):
    data = calls(200, 4)
    df = spark.createDataFrame(data, "name string, at_us long, id long, ok boolean")
    got = {r.id for r in ct.breaker_trips(df, 3, 10.0).collect()}
    want = set()
    for rows in by_key(data).values():
        fails = []
        for _, at, i, ok in rows:
            fails = [] if ok else [f for f in fails if at - f <= 10 * S] + [at]
            if len(fails) >= 3:
                want.add(i)
    assert got == want


cuts = some.lists(some.tuples(some.integers(0, 40), some.booleans()), min_size=1, max_size=40)


@settings(max_examples=300, deadline=None)
@given(cuts, some.lists(some.integers(0, 40), max_size=6), some.integers(1, 4), some.integers(0, 9))
def test_slice_summaries_match_stepping(events, marks, threshold, width):
    """Chaining summaries of arbitrary slices ends in the state of the full walk."""
    rows = [("k", at, i, ok) for i, (at, ok) in enumerate(sorted(events, key=lambda e: e[0]))]
    bounds = sorted({0, len(rows), *[m for m in marks if m < len(rows)]})
    slices = [rows[a:b] for a, b in zip(bounds, bounds[1:])]
    window = width + 3
    machines = [
        (["closed", [], 0], ct.breaker_step(threshold, window, width),
         ct._breaker_summary(threshold, window, width), ct._breaker_advance(threshold, window, width)),
    ]
    for start, step, summarise, advance in machines:
        walked = jumped = start
        for part in slices:
            jumped = advance(jumped, summarise(iter(part)))
            for row in part:
                walked, _ = step(walked, row)
            # Failures too old to count may be kept or dropped: compare what matters.
            if walked and walked[0] == "closed":
                now = part[-1][1]
                walked = ["closed", [f for f in walked[1] if now - f <= window], 0]
                jumped = ["closed", [f for f in jumped[1] if now - f <= window], 0]
            assert list(jumped) == list(walked)


@settings(max_examples=200, deadline=None)
@given(some.lists(some.booleans(), min_size=1, max_size=40), some.integers(0, 39), some.integers(1, 5))
def test_admission_summary(settles, mark, max_lag):
    rows = [("t", i, i, s) for i, s in enumerate(settles)]
    walked = jumped = 0
    for part in (rows[:mark], rows[mark:]):
        if part:
            jumped = ev._admit_advance(jumped, ev._admit_summary(max_lag)(iter(part)))
        for row in part:
            walked, _ = ev._admit_step(max_lag)(walked, row)
        assert jumped == walked


def test_admission_with_settles(spark, both_ways):
    rng = random.Random(5)
    data = [(rng.choice("ttts"), i, i, rng.random() < 0.45) for i in range(150)]
    df = spark.createDataFrame(data, "topic string, at long, id long, settled boolean")
    got = {r.id: r.accepted for r in ev.admit_with_settles(df, 4).collect()}
    want = {}
    for rows in by_key(data).values():
        for row, out in zip(rows, loop(rows, lambda r: 0, ev._admit_step(4))):
            want[row[2]] = out[0]
    assert got == want


def test_hash_chain_and_damage(spark, both_ways):
    data = [("long" if i % 4 else "short", i, f'{{"n":{i}}}') for i in range(60)]
    df = spark.createDataFrame(data, "chain_id string, seq long, body string")
    chain = lg.build_hash_chain(df)
    last, want = {}, {}
    for chain_id, seq, body in data:
        previous = last.get(chain_id, "")
        last[chain_id] = hashlib.sha256((previous + body).encode()).hexdigest()
        want[seq] = (previous, last[chain_id])
    assert {r.seq: (r.previous_hash, r.hash) for r in chain.collect()} == want
    assert lg.chain_issues(chain).count() == 0
    from pyspark.sql import functions as F

    bad = chain.withColumn("body", F.when(F.col("seq") == 9, "{}").otherwise(F.col("body")))
    issues = lg.chain_issues(bad.filter("seq <> 21")).collect()
    assert {(r.seq, r.issue) for r in issues} == {(9, lg.BROKEN_HASH), (22, lg.BROKEN_LINK)}
    more = spark.createDataFrame([("long", 100, "x")], df.schema)
    tails = spark.createDataFrame([("long", last["long"])], "chain_id string, hash string")
    assert lg.build_hash_chain(more, tails).first().previous_hash == last["long"]


def test_json_ledger(spark):
    import json

    lines, previous = [], ""
    for i in range(5):
        record = {"event": f"é{i}", "n": i, "previous_hash": previous}
        text = json.dumps(record, sort_keys=True, separators=(",", ":"))
        previous = record["hash"] = hashlib.sha256(text.encode()).hexdigest()
        lines.append(("c", i, json.dumps(record, ensure_ascii=False)))
    lines[2] = ("c", 2, lines[2][2].replace("é2", "é9"))
    df = spark.createDataFrame(lines, "chain_id string, seq long, line string")
    assert [(r.position, r.issue) for r in lg.json_ledger_issues(df).collect()] == [(2, lg.BROKEN_HASH)]


def test_lease_history(spark, both_ways):
    log = [
        ("l", 10, "renew", "n", 100, 150),  # accepted
        ("l", 20, "renew", "x", 150, 160),  # another holder
        ("l", 30, "renew", "n", 100, 170),  # stale
        ("l", 40, "renew", "n", 150, 180),  # accepted
        ("l", 50, "release", "n", 0, 0),
        ("l", 60, "renew", "n", 180, 190),  # gone
        ("m", 10, "renew", "n", 100, 300),
    ] + [("h", i, "renew", "n", 100 + i, 101 + i) for i in range(30)]
    df = spark.createDataFrame(
        [(*r, "n", 100) for r in log],
        "lease_id string, at_us long, op string, nonce string, old_us long, new_us long,"
        " granted_nonce string, granted_us long",
    )
    history = cp.lease_history(df)
    verdicts = [r.verdict for r in history.filter("lease_id = 'l'").orderBy("at_us").collect()]
    assert verdicts == ["renewed", "rejected", "rejected", "renewed", "released", "rejected"]
    states = {r.lease_id: (r.standing, r.expires_us) for r in cp.lease_states(history, 200).collect()}
    assert states == {"l": ("released", 180), "m": ("live", 300), "h": ("expired", 130)}


def test_lease_history_moves_the_log_once(spark):
    rng = random.Random(5)
    pick = lambda *values: rng.choice([*values, None])
    log = [
        (f"l{i % 9}", rng.randint(1, 40), pick("renew", "renew", "renew", "renew", "release"), pick("n", "n", "x"), pick(1, 2, 3), pick(1, 2, 3), "n", 1)
        for i in range(400)
    ]
    schema = "lease_id string, at_us long, op string, nonce string, old_us long, new_us long, granted_nonce string, granted_us long"
    df = spark.createDataFrame(log, schema).distinct().localCheckpoint()
    stepped = cp.lease_history(df)
    plan = stepped._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    rows = lambda found: sorted(map(str, found.collect()))
    chained = cp._lease_chains(df, (10**9, 10**9))
    assert rows(stepped) == rows(chained.select(*stepped.columns))


def test_concurrency_admission(spark, both_ways):
    rng = random.Random(7)
    ready = [("w" if i % 5 else "v", i, rng.randint(1, 20), "t" if i % 7 == 0 else None) for i in range(40)]
    nodes = [("w", 900 + i, "dispatched") for i in range(2)]
    got = wf.concurrency_admission(
        spark.createDataFrame(ready, "workflow_id string, node_id int, max_concurrency int, event_topic string"),
        spark.createDataFrame(nodes, "workflow_id string, node_id int, status string"),
    )
    want, used = {}, {"w": 2, "v": 0}
    for w, n, limit, topic in sorted(ready):
        want[(w, n)] = used[w] < limit
        used[w] += used[w] < limit and topic is None
    assert {(r.workflow_id, r.node_id): r.admitted for r in got.collect()} == want


def test_admission_in_order_of_definition(spark, both_ways):
    """Ten nodes whose ids sort otherwise than they were defined ("n10" before "n2")."""
    ready = [(w, f"n{i}", i // 2, 3 + i % 4) for w in "ab" for i in range(1, 24)]
    got = wf.concurrency_admission(
        spark.createDataFrame(ready, "workflow_id string, node_id string, place int, max_concurrency int"),
        spark.createDataFrame([("a", "x", "running")], "workflow_id string, node_id string, status string"),
        ["place"],
    )
    for order, rows in (("place", got.collect()), ("id", wf.concurrency_admission(
        spark.createDataFrame(ready, "workflow_id string, node_id string, place int, max_concurrency int"),
        spark.createDataFrame([("a", "x", "running")], "workflow_id string, node_id string, status string"),
    ).collect())):
        want, used = {}, {"a": 1, "b": 0}
        for w, n, place, limit in sorted(ready, key=lambda r: (r[0], r[2] if order == "place" else 0, r[1])):
            want[(w, n)] = used[w] < limit
            used[w] += used[w] < limit
        assert {(r.workflow_id, r.node_id): r.admitted for r in rows} == want


@pytest.mark.parametrize("seed", [1, 2])
def test_acks_against_ack_by_ack(spark, seed):
    """Aggregated acks agree with a loop over single acks, several groups included."""
    rng = random.Random(seed)
    events = [(i, "t", i % 3, i + 1) for i in range(12)]
    acks = [
        (rng.randrange(12), "t", rng.choice(["g0", "g1"]), i, i * S, rng.random() < 0.25, rng.choice(["e", ""]))
        for i in range(160)
    ]
    e = spark.createDataFrame(events, "id long, topic string, partition int, seq long")
    a = spark.createDataFrame(
        acks, "event_id long, topic string, grp string, ack_no long, at_us long, ok boolean, error string"
    ).selectExpr("*", "timestamp_micros(at_us) as ack_ts")
    step = ev.ack_machine(3).step
    states, letters, offsets = {}, {}, {}
    for row in acks:
        event, _, grp, n, at, ok, error = row
        state = states.get(event, ["pending", {}])
        state, (status, tries, moves, dead, _) = step(state, (event, at, grp, n, ok, error))
        states[event] = state
        if moves:
            offsets[(grp, event % 3)] = event + 1
        if dead:
            letters[event] = (grp, error or ev.EXHAUSTED, tries)
    got = {r.event_id: [r.status, r.delivery_attempts] for r in ev.ack_states(e, a, 3).collect()}
    for event, (status, fails) in states.items():
        assert got[event][0] == status
        assert {k: v for k, v in got[event][1].items() if v} == fails
    assert {r.id: (r.grp, r.error, r.attempts) for r in ev.ack_dead_letters(e, a, 3).collect()} == letters
    out = {(r.grp, r.partition): (r.offset, r.stranded) for r in ev.ack_offsets(e, a, 3).collect()}
    assert {k: v[0] for k, v in out.items()} == offsets
    for (grp, part), (offset, stranded) in out.items():
        assert stranded == sum(
            1 for i, _, p, seq in events
            if p == part and seq <= offset and states.get(i, ["pending"])[0] == "pending"
        )
