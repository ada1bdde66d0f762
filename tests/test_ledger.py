"""JSON ledgers and searches against the rules in plain Python."""

import hashlib
import json
import random

from pyspark.sql import functions as F

from opsframe.operators import ledger as lg
from test_canonical import foreign, value



def now():
    return F.lit("2024-05-06 07:08:09.000012").cast("timestamp")


STAMP = "2024-05-06T07:08:09.000012+00:00"


def digest(record):
    body = {k: v for k, v in record.items() if k != "hash"}
    return hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def appended(events, tails=None):
    """What a ledger holds after its events, one after the other."""
    last, out = dict(tails or {}), []
    for chain, seq, event in sorted(events, key=lambda e: (str(e[0]), e[1])):
        record = {"timestamp": STAMP, **event, "previous_hash": last.get(chain, "")}
        record["hash"] = digest(record)
        last[chain] = record["hash"]
        out.append((chain, seq, record))
    return out


def faults(lines):
    """Issues of the lines of one chain, and how many of them are torn."""
    records, torn, out, before = [], 0, [], ""
    for seq, line in lines:
        if line.strip():
            try:
                records.append((seq, json.loads(line)))
            except ValueError:
                torn += 1
    for place, (seq, record) in enumerate(records):
        if record.get("previous_hash") != before:
            out.append((seq, place, lg.BROKEN_LINK))
        if record.get("hash") != digest(record):
            out.append((seq, place, lg.BROKEN_HASH))
        before = record.get("hash", "")
    return out, torn, len(records)


def events_of(rng, n):
    out = []
    for i in range(n):
        event = {rng.choice(["kind", "zeta", "é", "n", "previous_hash", "hash", "timestamp"]): value(rng) for _ in range(rng.randrange(4))}
        out.append((rng.choice(["a", "b", None]), i, event))
    return out


def test_appended_lines_are_those_of_the_rule(spark, both_ways):
    rng = random.Random(3)
    events = events_of(rng, 60)
    rows = [(c, s, foreign(rng, e)) for c, s, e in events] + [("a", 70, "[1]"), ("a", 71, None), ("b", 72, "{torn")]
    tails = {"b": "f" * 64}
    frame = spark.createDataFrame(rows, "chain_id string, seq long, event string")
    seeds = spark.createDataFrame(list(tails.items()), "chain_id string, hash string")
    got = lg.append_json_ledger(frame, now(), seeds)
    want = appended(events, tails)
    assert sorted((str(r["chain_id"]), r["seq"], r["line"]) for r in got.collect()) == sorted(
        (str(c), s, json.dumps(r, sort_keys=True, ensure_ascii=False)) for c, s, r in want
    )
    assert {r["chain_id"]: r["hash"] for r in lg.ledger_tails(got.select("chain_id", "seq", "line")).collect()} == {c: r["hash"] for c, _, r in want}
    assert lg.append_json_ledger(frame.limit(0), now()).count() == 0


def test_damage_is_found_as_by_the_rule(spark, both_ways):
    rng = random.Random(5)
    lines = []
    for chain, seq, record in appended(events_of(rng, 90)):
        kind = rng.randrange(14)
        if kind == 0:
            record["n"] = "changed"
        elif kind == 1:
            record["previous_hash"] = rng.choice(["", None, "0" * 64])
        elif kind == 2:
            record["hash"] = rng.choice([None, 5, "0" * 64])
        elif kind == 3:
            del record[rng.choice(["hash", "previous_hash"])]
        line = foreign(rng, record)
        if kind == 4:
            line = line.rstrip()[:-1]
        elif kind == 5:
            lines.append((chain, seq * 2 + 1, "   "))
        if kind != 6:
            lines.append((chain, seq * 2, line))
    frame = spark.createDataFrame(lines, "chain_id string, seq long, line string").repartition(3)
    issues = {(r["chain_id"], r["seq"], r["position"], r["issue"]) for r in lg.json_ledger_issues(frame).collect()}
    summary = {r["chain_id"]: (r["ok"], r["records"], r["torn"], r["issues"]) for r in lg.verify_json_ledger(frame).collect()}
    for chain in ("a", "b", None):
        out, torn, records = faults([(s, t) for c, s, t in sorted(lines, key=lambda x: x[1]) if c == chain])
        assert {i[1:] for i in issues if i[0] == chain} == set(out)
        assert summary[chain] == (not out and not torn, records, torn, len(out))


def test_search_by_many_queries(spark):
    rng = random.Random(2)
    words = ["Alpha", "beta", "GAMMA", "délta", "日本", "x", "{\"k\": 1}", "aaa"]
    records = [(rng.randrange(50), rng.choice([" ", "", "-"]).join(rng.choice(words) for _ in range(rng.randrange(12)))) for _ in range(120)]
    records += [(None, "alpha of no key"), (7, None), (7, "alpha"), (7, "alpha")]
    queries = ["alpha", "ALPHA", "a", "aa", "aaaa", "", None, "日", "ta日", "nowhere", "élT", "\"K\"", "alpha", "z", "taG", "of no key"]
    frame = spark.createDataFrame([(*r, "clash") for r in records], "record_id int, json_text string, query string")
    asked = spark.createDataFrame([(q,) for q in queries], "query string")
    want = sorted(((q, i) for q in {*queries} for i, t in records if q and t and q.lower() in t.lower()), key=str)
    assert sorted(map(tuple, lg.memory_search_many(frame, asked).collect()), key=str) == want
    only_long = asked.filter("length(query) > 3")
    assert sorted(map(tuple, lg.memory_search_many(frame, only_long).collect()), key=str) == [w for w in want if len(w[0]) > 3]
    assert lg.memory_search_many(frame, asked.limit(0)).count() == 0
    assert lg.memory_search_many(frame.limit(0), asked).count() == 0
    plan = lg.memory_search_many(frame, asked)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_runs_of_a_text_are_counted_where_they_are_found(spark):
    """No row a run and record is sent before the runs are counted; short queries need no look at the texts."""
    frame = spark.createDataFrame([(i, "abcdefgh" * 9) for i in range(40)], "record_id int, json_text string")
    asked = spark.createDataFrame([("a",), ("bc",), ("gha",), ("cdefg",), ("hh",)], "query string")
    found = lg.memory_search_many(frame, asked)
    assert found.groupBy("query").count().collect() and found.count() == 160
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "array_distinct" not in plan.lower().split("mapinarrow", 1)[1]


def test_search_sends_no_pair_before_it_is_found(spark, monkeypatch):
    """Queries go to the records in blocks; what a record holds is neither shuffled nor joined."""
    monkeypatch.setattr(lg, "BLOCK_QUERIES", 7)
    rng = random.Random(5)
    texts = ["".join(rng.choice("aB é日") for _ in range(rng.randrange(120))) for _ in range(60)] + ["a" * 40, "x" + "ab" * 20]
    pieces = [t[i : i + n] for t in texts for i, n in [(rng.randrange(60), rng.choice([1, 3, 15, 16, 17, 18, 33, 70]))]]
    queries = pieces + ["a" * n for n in (16, 17, 39, 40, 41)] + ["ba" * 15, "AB" * 20, "", None]
    frame = spark.createDataFrame(list(enumerate(texts)), "record_id int, json_text string").repartition(3)
    found = lg.memory_search_many(frame, spark.createDataFrame([(q,) for q in queries], "query string"))
    want = sorted((q, i) for q in {*queries} for i, t in enumerate(texts) if q and q.lower() in t.lower())
    assert sorted(map(tuple, found.collect())) == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") > 2 and "Join" not in plan and "Aggregate" not in plan


def test_lines_are_parsed_once(spark):
    lines = spark.range(3).select(F.col("id").alias("chain_id"), F.lit(0).alias("seq"), F.lit('{"previous_hash": "", "hash": "x"}').alias("line"))
    for found, rows in ((lg.verify_json_ledger(lines), 3), (lg.json_ledger_issues(lines), 3)):
        assert "regexp_replace" not in found._jdf.queryExecution().executedPlan().toString()
        assert found.count() == rows
