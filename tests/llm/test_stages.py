"""The pipeline's stages on null, empty, repeated and tied rows."""

import random

import corpus_pipeline
from opsframe.llm import decontaminate, mixing, neardup, sharding

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows():
    rng = random.Random(7)
    text = lambda: " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(900)}" for _ in range(60))
    some = [(i, text(), "en", rng.choice(["a", "b"]), 1) for i in range(40)]
    copy = some[3][1]
    odd = [(100, None, None, None, None), (101, None, "en", "a", 0), (102, "", "en", "a", 0), (None, text(), "en", "a", 1), (None, text(), "en", "b", 1)]
    return some + [(50, copy, "en", "b", 1), (None, copy, "en", "a", 1)] + some[:4] + odd


def test_near_duplicates_keep_one_of_each(spark):
    data = rows()
    kept = [tuple(r) for r in neardup.one_per_class(spark.createDataFrame(data, DOCS)).collect()]
    texts = [r[1] or "" for r in kept]
    assert sorted(texts) == sorted({r[1] or "" for r in data})
    assert set(kept) <= set(data)


def test_leaks_leave_odd_rows_alone(spark):
    data = rows()
    items = spark.createDataFrame([(1, data[5][1]), (2, None), (None, "")], "item_id long, text string")
    kept = decontaminate.without_leaks(spark.createDataFrame(data, DOCS), items).collect()
    assert sorted(map(str, map(tuple, kept))) == sorted(str(r) for r in data if r[1] != data[5][1])


def test_mix_and_shards_take_odd_rows(spark):
    data = rows()
    mixed = mixing.repeats(spark.createDataFrame(data, DOCS))
    taken = [tuple(r) for r in mixed.collect()]
    assert set(taken) <= set(data) and taken
    placed, _ = sharding.shard_rows(mixed)
    assert placed.count() == len(taken)


def test_empty_tables_stay_empty(spark):
    none = spark.createDataFrame([], DOCS)
    for name, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, none, "/root/testdata/sf0.001").count() == 0, name
