import re
from collections import Counter, defaultdict
from heapq import heapify, heapreplace

from pyspark.sql import functions as F

from opsframe.llm.mixing import WEIGHTS, apportion, plan_mix, repeats, targets

DOCS = "doc_id long, text string, source string, size int, target string"


def want_targets(sizes, weights=WEIGHTS, most=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, left = {}, sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in full]
        level = left / sum(weight[s] for s in open_) if open_ else 0
        over = [s for s in open_ if most * sizes[s] < level * weight[s]]
        if not over:
            return {s: full.get(s, level * weight[s]) for s in names}
        for s in over:
            full[s] = most * sizes[s]
            left -= full[s]


def want_seats(target, blocks):
    names = list(target)
    heap = [(-target[s] / 1, i, 0) for i, s in enumerate(names) if target[s] > 0]
    heapify(heap)
    won = Counter()
    for _ in range(blocks):
        _, i, k = heap[0]
        won[names[i]] += 1
        heapreplace(heap, (-target[names[i]] / (2 * k + 3), i, k + 1))
    return won


def test_targets_and_seats(spark):
    for sizes in ({"a": 1000, "b": 10, "c": 5000, None: 700, "é": 3}, {"a": 5}, {"x": 0, "y": 100}, {"a": 7, "b": 7, "c": 7}):
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r["source"]: r["target"] for r in targets(df).collect()}
        want = want_targets(sizes)
        assert all(abs(got[s] - want[s]) < 1e-6 * (1 + want[s]) for s in want), (got, want)
        rows = apportion(targets(df), block_tokens=8, shards=5).collect()
        blocks = int(sum(sizes.values()) / 8 + 0.5)
        for shard in range(5):
            seats = {r["source"]: r["until"] for r in rows if r["shard"] == shard and r["until"]}
            assert seats == dict(want_seats(want, blocks * (shard + 1) // 5))
        assert all(r["seats"] >= 0 for r in rows)


def docs_of(n=400):
    rows = [(i, " ".join(["wörd"] * (1 + i * 7 % 90)) + "\x0b", ["a", "b", "c", None][i % 4] if i % 3 else "a", 0, "") for i in range(n)]
    return rows + [(1, None, "b", 0, ""), (2, "", None, 0, "")] + [(7, "same words here", "c", 0, "")] * 700


def test_documents_are_covered(spark):
    rows = docs_of()
    mixed, quotas = plan_mix(spark.createDataFrame(rows, DOCS).repartition(3), block_tokens=16, shards=4)
    got = mixed.collect()
    sizes = defaultdict(int)
    for _, text, source, _, _ in rows:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    want = want_targets(sizes)
    assert len(got) == len(rows)
    streams, taken = defaultdict(list), Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
        assert 0 <= r["taken"] <= 3 * r["size"]
        streams[r["source"]].append(r)
        taken[r["source"]] += r["taken"]
    for s, own in streams.items():
        assert abs(taken[s] - want[s]) <= 16
        own.sort(key=lambda r: (r["first_token"], r["size"]))
        at = 0
        for r in own:  # documents fill the stream without gap or overlap
            assert r["first_token"] == at
            at += r["size"]
        cover = Counter((own[0]["start_token"] + t) % sizes[s] for t in range(own[0]["run_tokens"])) if sizes[s] else Counter()
        for r in own:
            assert r["taken"] == sum(cover[t] for t in range(r["first_token"], r["first_token"] + r["size"]))
    assert {r["source"] for r in quotas.collect()} <= set(sizes)
    again, _ = plan_mix(spark.createDataFrame(rows, DOCS).repartition(2), block_tokens=16, shards=4)
    assert sorted(map(str, again.collect())) == sorted(map(str, got))


def test_repeats_keep_columns(spark):
    rows = docs_of()
    docs = spark.createDataFrame(rows, DOCS)
    out = repeats(docs, block_tokens=16)
    assert out.columns == docs.columns
    words = {r["source"]: r["n"] for r in out.groupBy("source").agg(F.sum(F.size(F.split("text", " "))).alias("n")).collect()}
    mixed, _ = plan_mix(docs, block_tokens=16)
    for r in mixed.groupBy("source").agg(F.first("target").alias("t")).collect():
        assert abs(words[r["source"]] - r["t"]) < 250
    assert max(Counter(r["doc_id"] for r in out.collect() if r["doc_id"] != 7).values()) <= 6
    assert repeats(spark.createDataFrame([], DOCS)).count() == 0
