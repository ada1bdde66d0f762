"""Each stage's rows against a plain version of its rule on the small tables."""

from collections import Counter

import corpus_pipeline
from opsframe.llm.base import DOCUMENT
from opsframe.llm.neardup import near_classes
from opsframe.llm.sharding import shard_rows

SF = "/root/testdata/sf0.001"
RUDE = set("trash moron stupid clown loser idiot scum pathetic disgusting worthless".split())


def words(text):
    return [w.strip(".,!?*#$%&|\"'").lower() for w in text.split() if w.strip(".,!?*#$%&|\"'")]


def test_stages_on_whole_tables(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    at = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "shard":
            assert out.columns == DOCUMENT
        out.write.parquet(str(tmp_path / name))
        at[name] = (docs.collect(), spark.read.parquet(str(tmp_path / name)).collect())
        docs = spark.read.parquet(str(tmp_path / name))

    before, after = at["drop_toxic"]
    kept = {r["doc_id"] for r in after}
    gone = [r for r in before if r["doc_id"] not in kept]
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert gone and sum(labels.get(r["doc_id"], int(bool(RUDE & set(words(r["text"]))))) for r in gone) >= 0.8 * len(gone)

    before, after = at["drop_near_duplicates"]
    classes = near_classes(spark.read.parquet(str(tmp_path / "drop_toxic"))).collect()
    assert sorted(r["doc_id"] for r in after) == sorted({r["class_id"] for r in classes})

    before, after = at["drop_benchmark_leaks"]
    items = [" ".join(words(r["text"])) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for r in after:
        assert not any(f" {i} " in f" {' '.join(words(r['text']))} " for i in items)
    assert {tuple(r) for r in after} <= {tuple(r) for r in before} and len(after) >= 0.8 * len(before)

    before, after = at["mix_sources"]
    assert {tuple(r) for r in after} <= {tuple(r) for r in before}
    assert max(Counter(r["doc_id"] for r in after).values()) <= 4

    before, after = at["shard"]
    assert sorted(r["doc_id"] for r in after) == sorted(r["doc_id"] for r in before)
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in shard_rows(spark.read.parquet(str(tmp_path / "mix_sources")))[0].collect()} == {
        (r["doc_id"], r["shard"], r["slot"]) for r in after
    }


def test_run_is_registered(spark):
    import __spark_entry__

    queries = __spark_entry__.queries()
    assert "pipeline" in queries and sorted(q for q in queries if q.startswith("op") and q[2].isdigit())[0] == "op10_improbable_features"
    assert queries["pipeline"](spark, SF).count() > 0


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
