import hashlib
import math
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from opsframe.llm import fingerprint as fp

DOCS = "doc_id long, text string, rank int, guest string"


def texts(seed=5, n=60):
    rng = random.Random(seed)
    parts = ["an", "the", "ör", "sil", "mek", "To", "qu", "ié"]
    out = []
    for _ in range(n):
        size = rng.choice([1, 8, 60, 90, 300, 1500])
        out.append(" ".join("".join(rng.choice(parts) for _ in range(rng.choice([1, 2, 3]))) for _ in range(size)))
    return out


def brute_levels(data):
    out = []
    for i in range(len(data) - fp.WINDOW + 1):
        window = data[i : i + fp.WINDOW]
        h = -sum(c / fp.WINDOW * math.log2(c / fp.WINDOW) for c in (window.count(b) for b in set(window)))
        out.append(round(fp.LEVELS * h / math.log2(fp.WINDOW)))
    return out


def brute_places(data):
    ranks = [int(fp._RANK[v]) for v in fp.entropy_levels(np.frombuffer(data, np.uint8))]
    points = [0] * len(ranks)
    for i in range(len(ranks) - fp.RUN + 1):
        points[min(range(i, i + fp.RUN), key=lambda j: (ranks[j], j))] += 1
    return [data[i : i + fp.WINDOW] for i, p in enumerate(points) if p >= fp.POINTS]


@settings(max_examples=25, deadline=None)
@given(st.binary(min_size=fp.WINDOW + 1, max_size=300))
def test_sliding_entropy(data):
    got = fp.entropy_levels(np.frombuffer(data, np.uint8)).tolist()
    assert all(abs(a - b) <= 1 for a, b in zip(got, brute_levels(data), strict=True))


def test_features_are_the_windows_of_most_points():
    every = [t for t in texts() if len(t) >= fp.SHORT]
    together = fp.features(every)
    for text, found in zip(every, together, strict=True):
        want = list(dict.fromkeys(brute_places(text.encode())))
        if len(text) < 2 * fp.SHORT:
            want += {text.encode()[i : i + fp.SHORT_WINDOW] for i in range(len(text.encode()) - fp.SHORT_WINDOW + 1)}
        assert len(found) == len(want)
        assert (fp.features([text])[0] == found).all()
    assert (fp.features(["x" + every[0]])[0][-3:] == together[0][-3:]).all()  # places do not matter


def test_chunks_do_not_matter(monkeypatch):
    long = " ".join(texts(9, 40))
    whole = fp.features([long, long[:700]])
    monkeypatch.setattr(fp, "_CHUNK", 97)
    for a, b in zip(whole, fp.features([long, long[:700]]), strict=True):
        assert (a == b).all()


def test_query_rows(spark):
    bodies = texts() + ["", None, "", "same", "same", "a" * 30_000]
    rows = [(i * 7 % 1000, t, 0, "g") for i, t in enumerate(bodies)] + [(None, "last", 1, "")]
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    got = fp.fingerprints(docs, ranges=9).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows) == len(by)
    for at, (doc, text, _, _) in enumerate(order):
        text, after = text or "", order[(at + 1) % len(order)][1] or ""
        r = by[doc]
        third = len(text) // 3
        changed = text[: len(text) - third] + after[:third]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        a, b, c = fp.digests([text, changed, after])
        assert (r["fingerprint"], r["edited_fingerprint"]) == (fp.written(a), fp.written(b))
        assert r["near_edited"] == fp.likeness(a, b) and r["near_next"] == fp.likeness(a, c)
        assert (fp.read(r["fingerprint"]) == a).all()
    near = sorted((r["near_edited"] - r["near_next"], r["doc_id"], r["n_chars"], r["near_edited"]) for r in got if 60 < r["n_chars"] < 30_000 and r["near_next"] < 1)
    assert near[0][0] > 0.1, near[:4]
    assert fp.fingerprints(docs.limit(0)).count() == 0
    one = fp.fingerprints(docs.limit(1)).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1


def test_equal_keys_and_copies(spark):
    rows = [(1, t, 0, "") for t in texts(2, 30)] + [(1, "copy " * 40, 0, "")] * 20
    got = fp.fingerprints(spark.createDataFrame(rows, DOCS), ranges=6).collect()
    assert len(got) == 50 and len({r["fingerprint"] for r in got if r["n_chars"] == 200}) == 1
