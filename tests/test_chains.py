"""Successors, reached nodes, rate limits and leases against plain loops."""

import random

import pytest

from opsframe.operators import chains as ch
from opsframe.operators import compute as cp
from opsframe.operators import control as ct

LEASES = (
    "lease_id string, at_us long, op string, nonce string, old_us long, new_us long, granted_nonce string, granted_us long"
)


@pytest.mark.parametrize("strict", [False, True])
def test_successors(spark, both_ways, strict):
    rng = random.Random(1)
    asks = [(rng.choice(["a", "b", None]), i, rng.randrange(40)) for i in range(60)]
    offers = [(rng.choice(["a", "a", None]), 1000 + i, rng.randrange(30)) for i in range(25)]
    frame = lambda rows: spark.createDataFrame(rows, "k string, node long, at long")
    got = {tuple(r) for r in ch.successors(frame(asks), frame(offers), ["k"], strict).collect()}
    want = set()
    for k, node, at in asks:
        later = [(t, -n) for key, n, t in offers if key == k and (t > at if strict else t >= at)]
        if later:
            want.add((k, node, min(later)[0]))
    place = {n: t for _, n, t in offers}
    assert {(k, n, place[o]) for k, n, o in got} == want


def test_reached(spark):
    rng = random.Random(2)
    links = [("a", i, i + rng.randint(1, 4)) for i in range(300) if rng.random() < 0.97] + [("b", 1, 2), (None, 5, 6), ("c", 3, 4)]
    heads = [("a", 0), ("b", 1), (None, 5), ("d", 9)]
    got = sorted(map(tuple, ch.reached(
        spark.createDataFrame(links, "k string, node long, next long"), spark.createDataFrame(heads, "k string, node long"), ["k"]
    ).collect()), key=str)
    follow, want = {(k, n): m for k, n, m in links}, []
    for k, n in heads:
        while n is not None:
            want.append((k, n))
            n = follow.get((k, n))
    assert got == sorted(want, key=str)


@pytest.mark.parametrize("seed, limit, width, span", [(1, 3, 10, 400), (2, 1, 7, 60), (3, 50, 3, 30), (4, 2, 1, 2000), (5, 2, 100, 50)])
def test_rate_limit_of_rows_equals_the_loop(spark, seed, limit, width, span):
    """One key holds nearly all calls; ties in time, gaps longer than a window, and a null key."""
    rng = random.Random(seed)
    calls = [(rng.choice(["hot"] * 8 + ["b", None]), rng.randint(-span, span), i, "x") for i in range(260)]
    frame = spark.createDataFrame(calls, "key string, at_us long, id long, more string")
    got = {r["id"]: (r["allowed"], r["retry_after_us"]) for r in ct._rate_limit_rows(frame, "key", limit, width).collect()}
    want, states = {}, {}
    for row in sorted(calls, key=lambda r: (r[1], r[2])):
        states[row[0]], want[row[2]] = ct.window_step(limit, width)(states.get(row[0]), row)
    assert got == want
    assert ct._rate_limit_rows(frame.limit(0), "key", limit, width).count() == 0


def lease_loop(rows):
    """Verdict, reason and expiry of each row of one lease, as the rule says."""
    held, expires, out = "active", rows[0][7], []
    for _, _, op, nonce, old, new, granted, _ in rows:
        if held != "active":
            out.append(("rejected", f"illegal: {held}", expires))
        elif op == "release":
            held = "released"
            out.append(("released", "", expires))
        elif nonce != granted:
            out.append(("rejected", "nonce mismatch", expires))
        elif old != expires:
            out.append(("rejected", "stale expires_at", expires))
        else:
            expires = new
            out.append(("renewed", "", expires))
    return out


def test_leases_equal_the_loop(spark, both_ways):
    """Retries of one expiry, expiries that come back, renewals that change nothing, releases, nulls."""
    rng = random.Random(4)
    log = []
    for i in range(240):
        lease = rng.choice(["hot"] * 6 + ["b", "c", None])
        op = "release" if rng.random() < 0.01 or (lease == "b" and i > 150) else rng.choice(["renew", "renew", "renew", None])
        log.append((lease, i, op, rng.choice(["n"] * 9 + ["x", None]), rng.choice([1, 2, 3, 4, None]), rng.choice([1, 2, 3, 4, None]), None if lease == "c" else "n", 1))
    got = {r["at_us"]: (r["verdict"], r["reason"], r["expires_us"]) for r in cp.lease_history(spark.createDataFrame(log, LEASES)).collect()}
    want = {}
    for lease in {r[0] for r in log}:
        rows = [r for r in log if r[0] == lease]
        want |= dict(zip([r[1] for r in rows], lease_loop(rows)))
    assert got == want
    assert sum(v[0] == "renewed" for v in want.values()) > 10
    assert cp.lease_history(spark.createDataFrame([], LEASES)).count() == 0
