import zlib
from collections import defaultdict

from opsframe.llm.sharding import SlotMap, shard_rows

DOCS = "doc_id long, text string, SIZE int, virtual_slot string"


def check(rows, docs, shards):
    assert len(rows) == len(docs)
    want = sorted(
        (str(d[0]), len((d[1] or "").encode()) + 8, zlib.crc32((d[1] or "").encode())) for d in docs
    )
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in rows) == want
    places = defaultdict(list)
    for r in rows:
        places[r["shard"]].append(r["slot"])
    for at, slots in places.items():
        assert 0 <= at < shards and sorted(slots) == list(range(len(slots)))
    return {at: sum(r["size"] for r in rows if r["shard"] == at) for at in range(shards)}


def test_every_row_once_and_bytes_even(spark):
    docs = [(i, "ab é" * (i % 37), 1, "x") for i in range(3000)] + [(None, None, 1, None), (5, "", 1, "x")] * 2
    out, plan = shard_rows(spark.createDataFrame(docs, DOCS).repartition(5), shards=7)
    load = check(out.collect(), docs, 7)
    assert max(load.values()) - min(load.values()) <= 0.01 * sum(load.values()) / 7
    assert plan.version == 2


def test_equal_rows_spread(spark):
    docs = [(1, "same", 0, "")] * 5000 + [(i, "t", 0, "") for i in range(2000)]
    out, _ = shard_rows(spark.createDataFrame(docs, DOCS), shards=4)
    load = check(out.collect(), docs, 4)
    assert max(load.values()) < 1.1 * min(load.values())


def test_empty(spark):
    out, plan = shard_rows(spark.createDataFrame([], DOCS))
    assert out.count() == 0 and len(plan.shard) == 8192


def test_map_versions(spark, tmp_path):
    first = SlotMap.even(64, 4)
    size = {s: 10 + s for s in range(64)}
    second = first.rebalanced(size)
    third = second.rebalanced(size, 5)
    moved = [s for s in range(64) if third.shard[s] != second.shard[s]]
    assert 4 in {third.shard[s] for s in moved} and len(moved) <= 20
    for plan in (first, second, third):
        plan.save(spark, str(tmp_path / "map"))
    assert SlotMap.load(spark, str(tmp_path / "map")) == third
    assert SlotMap.load(spark, str(tmp_path / "map"), 2) == second
