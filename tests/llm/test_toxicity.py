import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from opsframe.llm.queries import QUERIES
from opsframe.llm.toxicity import IDENTITY, Model, clean, distinct_words, features_of, fit, held_out, scored, swapped

DOCS = "doc_id long, text string, score int, label string"


def sentences(seed, n):
    rng = random.Random(seed)
    calm = [f"{a}{b}" for a in ("tor", "mel", "kan", "ris") for b in ("a", "ed", "in", "os", "um", "et")]
    bad = ["vexgor", "vexmil", "vexat", "grumf"]
    out = []
    for i in range(n):
        words = [rng.choice(calm) for _ in range(20)]
        toxic = i % 3 == 0
        if toxic:
            words[5] = rng.choice(bad)
        # in this sample, one group is mostly named in toxic sentences
        if rng.random() < (0.7 if toxic else 0.05):
            words[9] = "muslims"
        elif rng.random() < 0.3:
            words[9] = "christians"
        out.append((i, " ".join(words), 0, "x", int(toxic)))
    return out


def test_identity_terms_do_not_move_the_score(spark):
    rows = sentences(1, 900)
    docs = spark.createDataFrame([r[:4] for r in rows], DOCS)
    labels = spark.createDataFrame([(r[0], r[4]) for r in rows], "doc_id long, toxic int")
    plain, model = fit(docs, labels, counterfactual=0.0), fit(docs, labels)
    of = lambda m, w: sum(m.weights.get(f, 0.0) for f in features_of(w))
    gap = lambda m: abs(of(m, "muslims") - of(m, "christians"))
    assert gap(model) < 0.25 < 1.0 < gap(plain)
    fair = model.scorer()
    assert fair("torin muslims meled kana") < 0.3 and fair("rised vexgor kanum") > 0.7
    assert fair("rised vexoff kanum") > 0.1  # an unseen word of the same beginning
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert np.mean([(fair(r[1]) >= 0.3) == bool(r[4]) for r in held]) > 0.95


def test_swaps():
    assert swapped({"the", "jews"}, 5) - {"the"} <= set(IDENTITY[1]) - {"jews"}
    assert len(swapped({"one", "two"}, 7) & {"one", "two"}) == 1 and len(swapped(set(), 3)) == 1


def test_edges(spark):
    model = Model({f: 3.0 for f in features_of("bad")[:1]}, -2.0)
    rows = [(1, None, 1, ""), (2, "", 1, ""), (3, "BAD " * 100_000, 1, ""), (3, "bad", 1, ""), (None, "good", None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    got = scored(docs, model, into="p").collect()
    assert [round(r["p"], 3) for r in got] == [0.119, 0.119, 0.731, 0.731, 0.119]
    kept = clean(docs, model)
    assert kept.columns == docs.columns and kept.count() == 3
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    blank = fit(docs, labels)
    assert not blank.weights and 0 < blank.scorer()("x") < 0.3
    assert scored(docs.limit(0), blank).count() == 0
    assert distinct_words("A1b Éé") == {"a", "b", "éé"}


def test_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    got = QUERIES["op4_counterfactual"](spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    held = got.filter("held_out").join(labels, "doc_id").agg(
        F.avg(((F.col("predicted") == 1) & (F.col("toxic") == 1)).cast("int")).alias("hit"),
        F.avg("toxic").alias("toxic"), F.avg("predicted").alias("predicted"),
    ).first()
    assert held["hit"] / held["toxic"] > 0.85 and held["hit"] / held["predicted"] > 0.93
    assert got.filter(F.col("held_out") != held_out(F.col("doc_id"))).count() == 0
