import random
from collections import Counter, defaultdict

import numpy as np

from opsframe.llm import neardup
from opsframe.llm.neardup import components, near_classes, one_per_class, signatures
from opsframe.llm.shingles import mix, words_of

DOCS = "doc_id long, text string, node string, label int"


def brute(docs, n=5, least=0.8):
    """Classes by exact weighted Jaccard over all pairs of texts."""
    bags = []
    for _, text in docs:
        w = words_of(text)
        bags.append(Counter(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else None)
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if (docs[i][1] or "") == (docs[j][1] or ""):
                parent[root(i)] = root(j)
            elif bags[i] and bags[j]:
                same = sum((bags[i] & bags[j]).values())
                if same >= least * sum((bags[i] | bags[j]).values()):
                    parent[root(i)] = root(j)
    groups = defaultdict(set)
    for i in range(len(docs)):
        groups[root(i)].add(docs[i][0])
    return {d: min(g) for g in groups.values() for d in g}


def corpus(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [[rng.choice(vocabulary) for _ in range(rng.choice([3, 6, 40, 120, 900]))] for _ in range(60)]
    for base in list(texts):
        for _ in range(rng.choice([0, 0, 1, 3])):
            copy = list(base)
            for _ in range(max(1, len(copy) // rng.choice([30, 80, 200]))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(copy)
    hot = [rng.choice(vocabulary) for _ in range(200)]
    for _ in range(80):
        copy = list(hot)
        copy[rng.randrange(200)] = "x"
        copy[rng.randrange(200)] = "y"
        texts.append(copy)
    texts += [["ab", "c"] * 100, ["ab", "c"] * 101, ["ab", "c"] * 500, [], ["one"], ["one"], ["One", "!"]]
    docs = [(i * 3, " ".join(t)) for i, t in enumerate(texts)]
    return docs + [(9001, docs[0][1]), (9002, None), (9003, "\n ")]


def test_classes_equal_brute_force(spark):
    docs = corpus()
    rows = [(*d, "x", 1) for d in docs]
    got = near_classes(spark.createDataFrame(rows, DOCS).repartition(4)).collect()
    want = brute(docs)
    assert {r["doc_id"]: r["class_id"] for r in got} == want
    sizes = Counter(want.values())
    assert all(r["class_size"] == sizes[r["class_id"]] for r in got)


def test_agreement_estimates_similarity():
    rng = np.random.default_rng(1)
    close = []
    for _ in range(60):
        ids = mix(rng.integers(1, 2**62, 300).astype(np.uint64))
        wa, wb = rng.uniform(0.1, 3, 300), rng.uniform(0.1, 3, 300)
        both = np.concatenate((ids[:250], ids[50:])), np.concatenate((wa[:250], wb[50:]))
        a, b = signatures(*both, np.repeat([0, 1], 250), 2, 128)
        full_a, full_b = np.r_[wa[:250], np.zeros(50)], np.r_[np.zeros(50), wb[50:]]
        close.append((a == b).mean() - np.minimum(full_a, full_b).sum() / np.maximum(full_a, full_b).sum())
    assert abs(np.mean(close)) < 0.015 and np.std(close) < 0.06
    tiny = signatures(ids[:2], np.array([0.3, 40.0]), np.array([0, 1]), 2, 16)
    assert tiny.all() and (tiny[0] != tiny[1]).all()


def test_components_of_a_long_chain(spark):
    pairs = [(f"{i:03}", f"{i + 1:03}") for i in range(40)] + [("x", "y")]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(pairs, "a string, b string")).collect()}
    assert got == {f"{i:03}": "000" for i in range(41)} | {"x": "x", "y": "x"}


def test_one_document_stays(spark):
    rows = [(2, "a b c d e f g h", "n", 1), (1, "a b c d e f g h", "m", 2), (1, "a b c d e f g h", "m", 2),
            (5, "quite another text of some more words", None, None), (None, None, None, None), (8, "", "", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    out = one_per_class(docs)
    assert out.columns == docs.columns
    assert sorted((r["doc_id"] for r in out.collect())) == [1, 5, 8]
    assert one_per_class(docs.limit(0)).count() == 0 and near_classes(docs.limit(0)).count() == 0


def hot_group(n, seed=5):
    """Texts that lie about 0.8 from each other, some with the same edit, and a few links among those far out."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(500)}" for _ in range(150)]
    edits = [(rng.randrange(150), f"e{i}") for i in range(10)]
    texts = []
    for i in range(n):
        copy = list(base)
        for _ in range(rng.choice([2, 4, 5, 6])):
            place, word = rng.choice(edits) if rng.random() < 0.1 else (rng.randrange(150), f"x{i}")
            copy[place] = word
        texts.append(copy)
    for copy in texts[: n // 10]:
        far = list(copy)
        for _ in range(3):
            far[rng.randrange(len(far))] = "far"
        texts += [far, [*far, "end"]]
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def test_a_large_group_is_not_paired_with_itself(spark, monkeypatch):
    docs, made, alike = hot_group(150), {}, neardup._alike
    rows = spark.createDataFrame([(*d, "x", 1) for d in docs], DOCS)
    want = brute(docs)
    monkeypatch.setattr(neardup, "RARE", 4)
    for few in (4, 10**9):

        def counted(found, *rest, few=few):
            found = neardup._kept(found, "pairs")
            made.setdefault(few, []).append(found.count())
            return alike(found, *rest)

        monkeypatch.setattr(neardup, "_alike", counted)
        monkeypatch.setattr(neardup, "FEW", few)
        assert {r["doc_id"]: r["class_id"] for r in near_classes(rows).collect()} == want
    after_leaders = [sum(made[few][1:]) for few in (4, 10**9)]
    assert len(set(want.values())) > 30 and 2 * after_leaders[0] < after_leaders[1], made


def test_large_buckets_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(neardup, "FEW", 0)
    docs = corpus() + [(20_000 + d, t) for d, t in hot_group(40)]
    monkeypatch.setattr(neardup, "RARE", 3)
    got = near_classes(spark.createDataFrame([(*d, "x", 1) for d in docs], DOCS))
    assert {r["doc_id"]: r["class_id"] for r in got.collect()} == brute(docs)


def test_no_pair_is_compared_twice_or_within_a_class(spark, monkeypatch):
    docs, made, alike = hot_group(60), [], neardup._alike
    rows = spark.createDataFrame([(*d, "x", 1) for d in docs], DOCS)

    def noted(found, *rest):
        found = neardup._kept(found, "pairs")
        links = neardup._kept(alike(found, *rest), "links")
        made.append(({(r["a"], r["b"]) for r in found.collect()}, {(r["a"], r["b"]) for r in links.collect()}))
        return links

    monkeypatch.setattr(neardup, "_alike", noted)
    monkeypatch.setattr(neardup, "FEW", 4)
    assert {r["doc_id"]: r["class_id"] for r in near_classes(rows).collect()} == brute(docs)
    assert sum(len(found) for found, _ in made) == len(set().union(*(found for found, _ in made)))
    label = {}
    for found, links in made:
        assert not any(a in label and label[a] is label.get(b) for a, b in found)
        for a, b in links:
            joined = label.get(a, {a}) | label.get(b, {b})
            label |= dict.fromkeys(joined, joined)
