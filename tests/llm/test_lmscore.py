import math
import random
from collections import Counter

import numpy as np

from opsframe.llm import lmscore as lm
from opsframe.llm.queries import QUERIES

DOCS = "doc_id long, text string, cell int, n long"


def brute(docs, chosen):
    def model(texts):
        words, pairs, contexts = Counter(), Counter(), Counter()
        for t in texts:
            ids = lm.token_ids(t).tolist()
            cells = lm.pair_cells(lm.token_ids(t)).tolist()
            words.update(ids[1:])
            pairs.update(cells)
            contexts.update(ids[:-1])
        return words, pairs, contexts, sum(words.values())

    def loss(m, t):
        words, pairs, contexts, whole = m
        ids, cells = lm.token_ids(t).tolist(), lm.pair_cells(lm.token_ids(t)).tolist()
        out = 0.0
        for a, b, c in zip(ids[:-1], ids[1:], cells, strict=True):
            word = (words[b] + lm.SMOOTHING) / (whole + lm.SMOOTHING * lm.VOCABULARY)
            out -= math.log((min(pairs[c], contexts[a]) + lm.BACKOFF * word) / (contexts[a] + lm.BACKOFF))
        return out / len(cells)

    target, background = model(chosen), model([t for _, t in docs])
    return {d: (loss(target, t), loss(background, t)) if lm.words_of(t) else None for d, t in docs}


def test_scores_equal_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    good, bad = [f"g{i}" for i in range(60)], [f"b{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choice(good if i % 3 else bad) for _ in range(rng.choice([1, 5, 200, 5000])))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "!!"), (103, "g1 g2"), (103, "g1 g2")]
    chosen = [t for i, t in docs if t and i % 3 == 1 and i < 30]
    frame = spark.createDataFrame([(*d, 1, None) for d in docs], DOCS).repartition(4)
    target = spark.createDataFrame([(0, t, 0, 0) for t in chosen], DOCS)
    got = lm.cross_entropy_difference(frame, target).collect()
    want = brute(docs, chosen)
    assert len(got) == len(docs)
    for r in got:
        if want[r["doc_id"]] is None:
            assert (r["n_tokens"], r["score"], r["loss_target"]) == (0, None, None)
        else:
            a, b = want[r["doc_id"]]
            assert abs(r["loss_target"] - a) < 1e-4 and abs(r["loss_background"] - b) < 1e-4
            assert abs(r["score"] - (a - b)) < 2e-4
    long = [r for r in got if r["n_tokens"] >= 200]
    assert max(r["score"] for r in long if r["doc_id"] % 3) < min(r["score"] for r in long if not r["doc_id"] % 3)
    assert lm.cross_entropy_difference(frame.limit(0), target).count() == 0
    assert lm.cross_entropy_difference(frame, target.limit(0)).count() == len(docs)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    got = QUERIES["op9_entropy_difference"](spark, sf)
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_counts_are_those_of_words_and_pairs_themselves(spark, monkeypatch):
    """Against counts of the strings, with more words than the vocabulary has room for and texts in many chunks."""
    monkeypatch.setattr(lm, "_CHUNK", 20_000)
    rng = random.Random(5)
    docs = [(i, " ".join(f"w{j}" for j in range(i * 4000, i * 4000 + 4000))) for i in range(35)]
    docs += [(100 + i, " ".join(f"w{int(rng.random() ** 4 * 140_000)}" for _ in range(3000))) for i in range(30)]
    chosen = [t for i, t in docs if i % 2]

    def model(texts):
        split = [["", *t.split()] for t in texts]
        words = Counter(w for s in split for w in s[1:])
        return words, Counter(p for s in split for p in zip(s, s[1:])), Counter(w for s in split for w in s[:-1]), sum(words.values())

    def loss(m, t):
        words, pairs, contexts, whole = m
        tokens, out = ["", *t.split()], 0.0
        for a, b in zip(tokens, tokens[1:]):
            word = (words[b] + lm.SMOOTHING) / (whole + lm.SMOOTHING * 140_000)
            out -= math.log((pairs[a, b] + lm.BACKOFF * word) / (contexts[a] + lm.BACKOFF))
        return out / (len(tokens) - 1)

    target, background = model(chosen), model([t for _, t in docs])
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in lm.cross_entropy_difference(frame, spark.createDataFrame([(t,) for t in chosen], "text string")).collect()}
    assert len(got) == len(docs)
    for i, t in docs:
        assert abs(got[i]["loss_target"] - loss(target, t)) < 1e-9 and abs(got[i]["loss_background"] - loss(background, t)) < 1e-9


def test_counts_take_as_many_bytes_as_they_need():
    for top in (0, 1, 255, 256, 65_535, 65_536, 1 << 32, (1 << 62) + 1):
        numbers = np.array([0, top, 1, top // 2], np.int64)
        assert lm.unpacked(lm.packed(numbers)).tolist() == numbers.tolist()
    assert lm.unpacked(lm.packed(np.empty(0, np.int64))).tolist() == []
    assert len(lm.packed(np.ones(1000, np.int64))) == 1001
    keys = np.sort(np.random.default_rng(1).integers(0, 1 << 56, 500, np.uint64))
    high = keys | (np.uint64(0xAB) << np.uint64(56))
    assert len(lm.packed_keys(high)) == 3500 and (lm.unpacked_keys(lm.packed_keys(high)) == keys).all()
