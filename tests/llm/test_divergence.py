import random
import re
from collections import Counter

import numpy as np
import pytest

from opsframe.llm import divergence as dv

DOCS = "doc_id long, text string, lang string, source string, n int, TERM string"


def brute(rows, least, top):
    """The rule over Counters of whole texts; rows are (lang, source, text)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(lower)) for _, _, t in rows]
    out = []
    for lang in {r[0] for r in rows}:
        own = [(r[1], t) for r, t in zip(rows, terms) if r[0] == lang]
        held = Counter(w for _, t in own for w in set(t))
        kept = sorted(w for w, n in held.items() if n >= least)
        counts = {s: Counter() for s, _ in own}
        for s, t in own:
            counts[s].update(w for w in t if held[w] >= least)
        whole = sum(counts.values(), Counter())

        def share(c):
            return {w: 1 + 10**9 * (c[w] + 5) // (sum(c.values()) + 5 * len(kept)) for w in kept}

        p, q = {s: share(c) for s, c in counts.items()}, share(whole)
        for s in counts:
            found = {
                "pair": [(-sum(abs(p[s][w] - p[o][w]) for w in kept), o.encode(), o) for o in counts if o != s],
                "term": [(q[w] - p[s][w], w.encode(), w) for w in kept if counts[s][w] > 0 and p[s][w] > q[w]],
            }
            for part, rows_ in found.items():
                for rank, (value, _, item) in enumerate(sorted(rows_)[: top if part == "term" else None], 1):
                    out.append((lang, s, part, item, -value, rank))
    return sorted(out)


def rows_of(seed, n=400):
    rng = random.Random(seed)
    words = [f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(100)] + ["Äpfel", "straße", "日本語", "x" * 90, "y" * 5000, "É"]
    out = []
    for i in range(n):
        lang = rng.choice(["en", "en", "en", "de", None, "", "日"])
        source = rng.choice(["hot"] * 5 + ["a", "B", None, "é", "z'z"])
        skew = rng.choice([1, 2, 4])
        text = rng.choice([" ", "\t1_", "\n", "%"]).join(words[int(len(words) * rng.random() ** skew)].upper() if rng.random() < 0.2 else words[int(len(words) * rng.random() ** skew)] for _ in range(rng.choice([0, 1, 5, 60])))
        out.append((lang, source, rng.choice([text, text, text, text, None])))
    return out


@pytest.mark.parametrize("small", [False, True])
def test_equal_to_brute_force(spark, monkeypatch, small):
    """Once as is, and once with many shards, many waves, and tasks that send on what they hold again and again."""
    if small:
        for name, value in {"SHARD_CELLS": 1, "WAVE_TERMS": 60, "HELD_TERMS": 50, "HELD_CELLS": 10}.items():
            monkeypatch.setattr(dv, name, value)
    rows = rows_of(1)
    rows += rows[:30] * 2 + [("solo", "only", "one source")] * 3 + [("xx", "p", "!!"), ("xx", "q", ""), ("xx", "r", None)]
    frame = spark.createDataFrame([(i, t, lang, s, 0, "clash") for i, (lang, s, t) in enumerate(rows)], DOCS).repartition(5)
    got = dv.audit(frame, min_documents=6, top=12)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    want = brute(rows, 6, 12)
    assert sorted(map(tuple, got.collect())) == want
    assert any(r[0] == "xx" and r[4] == 0 for r in want) and any(len(r[3]) > 64 for r in want)


def test_no_frequent_terms_and_no_rows(spark):
    frame = spark.createDataFrame([(i, f"word{'x' * i}", "en", f"s{i % 3}", 0, "") for i in range(9)], DOCS)
    assert sorted(map(tuple, dv.audit(frame).collect())) == brute([("en", f"s{i % 3}", f"word{'x' * i}") for i in range(9)], 30, 50)
    assert dv.audit(frame.limit(0)).count() == 0


def test_perfect_hash_is_minimal():
    for n in (0, 1, 2, 5, 64, 3000):
        hashes = np.unique(np.random.default_rng(n).integers(0, 2**64 - 1, n, np.uint64))
        displacement, slot = dv.perfect_hash(hashes)
        assert sorted(slot.tolist()) == list(range(len(hashes)))
        if n:
            bucket = (dv.mix(hashes) % np.uint64(len(displacement))).astype(int)
            assert (dv._slots(hashes, displacement[bucket], np.full(n, n)) == slot).all()


def test_strangers_and_terms_of_equal_hash():
    """Stored terms tell strangers apart; a term whose hash another one has is found behind the slots."""
    terms = [b"one", b"two", b"three", b"z" * 200]
    displacement, slot = dv.perfect_hash(dv.term_hashes(terms))
    by_slot = [terms[i] for i in np.argsort(slot)]
    row = {"lang": "en", "shard": 0, "shards": 1, "displacement": displacement.tobytes(), "hashed": 4, "terms": [*by_slot, b"same hash"]}
    wave = dv.HashWave([row, {**row, "lang": "de", "terms": by_slot}])
    asked = [b"three", b"same hash", b"four", b"z" * 201, b"z" * 200]
    found = wave.places("en", asked).tolist()
    assert found == [by_slot.index(b"three"), 4, -1, -1, by_slot.index(b"z" * 200)]
    assert wave.places("de", asked).tolist() == [found[0], -1, -1, -1, found[4]]


def test_shares_are_exact():
    rng = random.Random(1)
    counts = [0, 1, 10**12, *(rng.randrange(10**14) for _ in range(50))]
    for whole in (10**14 + 5, 7 * 10**15, 3 * 10**14 + 1):
        assert dv.shares(np.array(counts), whole).tolist() == [1 + 10**9 * (c + 5) // whole for c in counts]
