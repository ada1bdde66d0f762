"""Near-duplicate classes by DartMinHash over weighted word shingles.

A text is a weighted set: its five-word shingles with their counts.  Each unit of weight of an
element is a region into which a hashed Poisson process throws darts, ordered by time.  Every dart
falls on one of k coordinates, and a coordinate keeps its earliest dart; a number of
darts near k ln k fills all coordinates, however large the text.  Two texts agree on a coordinate with the
probability of their weighted Jaccard similarity.  Bands of coordinates are joined, candidates are checked
exactly, and linked texts form classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsframe.llm.base import fresh, quoted
from opsframe.llm.shingles import WORDS, mix, numbered, shingles, weighted_jaccard
from opsframe.session import scratch_folder

COORDINATES = 128
BAND_ROWS = 8
#: Every ordering of the coordinates gives COORDINATES / BAND_ROWS bands.
ORDERINGS = 2
SIMILARITY = 0.8
#: A pair is not looked at more closely if its signatures agree by this much less than asked: 4.5 deviations.
SLACK = 0.16
#: Texts outside a bucket's largest class that are paired with all texts of the bucket; of more, only those that can be alike.
FEW = 16
#: Texts of a group that may hold a shingle which still counts as rare.
RARE = 16
#: Texts of a group whose frequent shingles are set aside before the others are counted.
SAMPLE = 64
_STEP = np.uint64(0x9E3779B97F4A7C15)


def signatures(elements: np.ndarray, weights: np.ndarray, texts: np.ndarray, count: int, k: int) -> np.ndarray:
    """The earliest dart on each of ``k`` coordinates, as hashes, for ``count`` texts at once.

    Element i with weight ``weights[i]`` > 0 belongs to text ``texts[i]``; every text must have one.
    Weights may be any positive reals: a dart of the last, partial unit of an element
    counts only if it falls below the weight.
    """
    units = np.ceil(weights).astype(np.int64)
    owner = np.repeat(np.arange(len(elements)), units)
    unit = np.arange(len(owner)) - np.repeat(np.cumsum(units) - units, units)
    cells = mix(elements[owner] + unit.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    room, home = weights[owner] - unit, texts[owner]
    until = (k * np.log(k) + 2 * k) / np.bincount(texts, weights, count)
    out = np.zeros(count * k, np.uint64)
    open_ = np.ones(count, bool)
    while open_.any():
        live = np.flatnonzero(open_[home])
        clock, turn, found = np.zeros(len(live)), 0, []
        while len(live):
            turn += 1
            dart = mix(cells[live] + np.uint64(turn) * _STEP)
            clock = clock - np.log1p(-((dart >> np.uint64(11)).astype(np.float64) * 2.0**-53))
            inside = clock < until[home[live]]
            live, clock = live[inside], clock[inside]
            found.append((dart[inside], clock, live))
        dart, time, cell = (np.concatenate(x) for x in zip(*found, strict=True))
        scattered = mix(dart ^ _STEP)
        hit = (scattered >> np.uint64(11)).astype(np.float64) * 2.0**-53 < room[cell]
        dart, time, cell = dart[hit], time[hit], cell[hit]
        place = home[cell] * k + (mix(scattered[hit]) % np.uint64(k)).astype(np.int64)
        best = np.full(count * k, np.inf)
        np.minimum.at(best, place, time)
        first = time == best[place]
        out[place[first]] = dart[first]
        open_ &= np.isinf(best.reshape(count, k)).any(axis=1)
        until = until * 2
    return out.reshape(count, k)


def band_layout(k: int = COORDINATES, rows: int = BAND_ROWS, orderings: int = ORDERINGS) -> np.ndarray:
    """Coordinates of each band: the coordinates in several fixed orders, each cut into bands."""
    rng = np.random.default_rng(7)
    return np.concatenate([rng.permutation(k)[: k // rows * rows].reshape(-1, rows) for _ in range(orderings)])


def sign_texts(bodies: list[str | None], words: int, k: int, layout: np.ndarray) -> list[tuple[list[int], bytes] | None]:
    """(hash per band, 16 bits per coordinate) of each text; None for a text without words."""
    runs = [shingles(b, words) for b in bodies]
    full = [i for i, r in enumerate(runs) if len(r)]
    out: list = [None] * len(bodies)
    if not full:
        return out
    parts = []
    for place, i in enumerate(full):
        last = np.flatnonzero(np.concatenate((runs[i][1:] != runs[i][:-1], [True])))
        count = np.diff(np.concatenate(([-1], last)))
        parts.append((runs[i][last], count.astype(np.float64), np.full(len(last), place)))
    signed = signatures(*(np.concatenate(x) for x in zip(*parts, strict=True)), len(full), k)
    bands = np.zeros((len(full), len(layout)), np.uint64)
    for row in range(layout.shape[1]):
        bands = mix(bands + signed[:, layout[:, row]])
    bands = mix(bands + np.arange(len(layout), dtype=np.uint64)).view(np.int64)
    sketch = (signed >> np.uint64(48)).astype("<u2")
    for place, i in enumerate(full):
        out[i] = (bands[place].tolist(), sketch[place].tobytes())
    return out


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def _kept(df: DataFrame, name: str) -> DataFrame:
    """Write a step to the shared folder and go on from the files."""
    folder = scratch_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def _signed(texts: DataFrame, words: int, k: int) -> DataFrame:
    layout = band_layout(k)

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            size = batch["text"].str.len().fillna(0).cumsum()
            for _, part in batch.groupby((size // 200_000).to_numpy()):  # bounded memory, few numpy calls
                signed = sign_texts(list(part["text"]), words, k, layout)
                yield pd.DataFrame({
                    "doc_id": part["doc_id"].to_numpy(), "node": part["node"].to_numpy(),
                    "bands": [s and s[0] for s in signed], "sketch": [s and s[1] for s in signed],
                })

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInPandas(sign, f"doc_id {kind}, node binary, bands array<long>, sketch binary")


def _alike(pairs: DataFrame, sketches: DataFrame, bodies: DataFrame, similarity: float, words: int, k: int) -> DataFrame:
    """Those pairs (a, b) of texts whose weighted Jaccard similarity is high enough, checked on whole texts.

    Signatures are compared first, so that few texts are sent.
    """
    side = lambda df, node, value, name: df.select(F.col("node").alias(node), F.col(value).alias(name))

    def agree(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch[c]), "<u2").reshape(-1, k) for c in ("sa", "sb"))
            yield batch.loc[(x == y).mean(axis=1) >= similarity - SLACK, ["a", "b"]]

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[bytes, np.ndarray] = {}

        def runs(node: bytes, text: str) -> np.ndarray:
            if node not in seen:
                if len(seen) >= 64:
                    seen.clear()
                seen[node] = shingles(text, words)
            return seen[node]

        for batch in batches:
            good = [
                weighted_jaccard(runs(a, x), runs(b, y)) >= similarity - 1e-12
                for a, b, x, y in zip(batch["a"], batch["b"], batch["ta"], batch["tb"], strict=True)
            ]
            yield batch.loc[good, ["a", "b"]]

    sketched = pairs.join(side(sketches, "a", "sketch", "sa"), "a").join(side(sketches, "b", "sketch", "sb"), "b")
    near = sketched.select("a", "b", "sa", "sb").mapInPandas(agree, "a binary, b binary")
    both = near.join(side(bodies, "a", "text", "ta"), "a").join(side(bodies, "b", "text", "tb"), "b")
    return both.select("a", "b", "ta", "tb").mapInPandas(compare, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """(node, label) for all nodes of ``links`` (a, b): label is the least node of its component.

    Each round takes the least label among neighbours, then follows labels to their labels, until
    nothing changes.  Rounds are written, so a lost executor costs one round at most.
    """
    edges = _kept(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), "links")
    labels = _kept(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = (
            edges.join(labels, edges["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        )
        lowered = labels.join(near, labels["node"] == near["a"]).select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label")
        )
        hops = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        after = lowered.join(hops, "label", "left").select(
            "node", "old", F.least("label", F.coalesce("further", "label")).alias("label")
        )
        after = _kept(after, "labels")
        labels = after.select("node", "label")
        if not after.filter("old != label").limit(1).count():
            return labels


def near_classes(
    docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY,
    words: int = WORDS, k: int = COORDINATES,
) -> DataFrame:
    """One row per document: doc_id, node (its text's digest), class_id, class_size, keeper_node.

    ``class_id`` is the least doc_id of the class, ``keeper_node`` the digest of a text under that
    id.  Equal texts are one node, so copies are never paired with each other.  A null text counts
    as an empty one; texts without words are in a class with their equals only; texts shorter
    than a shingle are compared as one run of words.  Repeated rows and null ids (counted last) each keep a row.
    An empty table gives no rows.  Other columns are not looked at.

    Candidates share a band.  In each bucket every text is compared with a leader that most buckets of a group agree on,
    then, unless that has linked them already, with one of the bucket's own.  Then every text outside a bucket's largest class is
    compared with all texts of other classes there, so no pair that shares a bucket is left out.  Where many are
    outside, all are compared with the text nearest to the group's middle first, then with those that hold enough of
    the same shingles or a rare one (see _likely); a pair left out there cannot be alike.
    """
    texts = docs.select(quoted(key).alias("doc_id"), text_key(quoted(text)).alias("node"), quoted(text).alias("text"))
    signed = _kept(_signed(texts, words, k), "signed")
    per_text = signed.groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    sketches = _kept(
        signed.filter("sketch is not null").groupBy("node").agg(F.first("sketch").alias("sketch"), F.first("bands").alias("bands")),
        "sketches",
    )
    every = sketches.select("node", F.posexplode("bands").alias("band", "hash"))
    common, own = F.struct(F.xxhash64("node"), "node"), F.struct(F.xxhash64("node", "band"), "node")
    shared = every.groupBy("band", "hash").agg(
        F.count("*").alias("n"), F.min(common)["node"].alias("common"), F.min(own)["node"].alias("own")
    ).filter("n > 1").drop("n")
    members = _kept(every.join(shared, ["band", "hash"]), "members")
    labelled = per_text.withColumn("label", F.col("node"))
    if not members.isEmpty():
        labels = _linked(members, sketches.drop("bands"), texts, per_text, similarity, words, k)
        if labels is not None:
            labelled = per_text.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    heads = labelled.groupBy("label").agg(
        F.min("least").alias("class_id"), F.sum("n").alias("class_size"),
        F.min(F.struct(F.col("least").isNull(), "least", "node"))["node"].alias("keeper_node"),
    )
    classed = labelled.join(heads, "label").select("node", "class_id", "class_size", "keeper_node")
    return signed.select("doc_id", "node").join(classed, "node").select(
        "doc_id", "node", "class_id", "class_size", "keeper_node"
    )


def _linked(
    members: DataFrame, sketches: DataFrame, texts: DataFrame, per_text: DataFrame, similarity: float, words: int, k: int
) -> DataFrame | None:
    """(node, label) of all texts that are linked to another; None if there are none."""
    named = members.select("node").distinct().join(per_text, "node").select("node", "least")
    one = texts.join(
        named.withColumnsRenamed({"node": "_node", "least": "_least"}),
        (F.col("node") == F.col("_node")) & F.col("doc_id").eqNullSafe(F.col("_least")), "left_semi",
    )
    bodies = _kept(one.groupBy("node").agg(F.first("text").alias("text")), "bodies")
    pick = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    led = lambda name: members.filter(F.col("node") != F.col(name)).select(*pick("node", name)).distinct()
    tried = _kept(led("common"), "tried")
    links = _kept(_alike(tried, sketches, bodies, similarity, words, k), "links")
    labels = components(links) if not links.isEmpty() else None
    left = _kept(_apart(led("own").join(tried, ["a", "b"], "left_anti"), labels), "tried")
    tried = tried.union(left)
    own = _kept(_alike(left, sketches, bodies, similarity, words, k), "links")
    if not own.isEmpty():
        labels = _merged(labels, own)
    now = members.select("band", "hash", "node", "common")
    open_, rest = _by_class(now, labels)
    few = F.col("outside") <= FEW
    pairs = open_.filter(few).join(rest.filter(few).drop("outside"), ["band", "hash"]).filter("label != other_label").select(*pick("node", "other"))
    many = _kept(open_.filter(~few).select(*now.columns, "label"), "many")
    if not many.isEmpty():
        large, rare = _described(many, bodies, similarity, words)
        score = F.struct(F.expr("2 * shared - size").alias("score"), "node", "label")
        centres = large.groupBy("band", "hash").agg(F.max(score).alias("centre"))
        to_centre = large.join(centres, ["band", "hash"]).filter("label != centre.label").select(*pick("node", "centre.node"))
        left = _kept(to_centre.distinct().join(tried, ["a", "b"], "left_anti"), "tried")
        tried = tried.union(left)
        near = _kept(_alike(left, sketches, bodies, similarity, words, k), "links")
        if not near.isEmpty():
            labels = _merged(labels, near)
        pairs = pairs.union(_likely(*_by_class(large.drop("label"), labels), rare, similarity).select(*pick("node", "other")))
    pairs = pairs.distinct().join(tried, ["a", "b"], "left_anti")  # what was found unlike needs no second look
    more = _kept(_alike(pairs, sketches, bodies, similarity, words, k), "more")
    if more.isEmpty():
        return labels
    return _merged(labels, more)


def _merged(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, label) when ``links`` are added to those behind ``labels``: only classes are linked anew, not their texts."""
    if labels is None:
        return components(links)
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    known = _kept(labels.unionByName(ends.join(labels, "node", "left_anti").withColumn("label", F.col("node"))), "labels")
    between = links
    for name in ("a", "b"):
        of = known.select(F.col("node").alias(name), F.col("label").alias(f"of_{name}"))
        between = between.join(of, name).drop(name).withColumnRenamed(f"of_{name}", name)
    tops = components(between.filter("a != b").distinct()).select(F.col("node").alias("label"), F.col("label").alias("top"))
    return _kept(known.join(tops, "label", "left").select("node", F.coalesce("top", "label").alias("label")), "labels")


def _apart(pairs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Those pairs (a, b) whose texts are not in one class yet."""
    if labels is None:
        return pairs
    for name in ("a", "b"):
        pairs = pairs.join(labels.select(F.col("node").alias(name), F.col("label").alias(f"of_{name}")), name, "left")
    return pairs.filter(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")


def _by_class(members: DataFrame, labels: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Members of buckets with several classes, with label and the number outside the largest class; those outside it as other."""
    now = members.withColumn("label", F.col("node"))
    if labels is not None:
        now = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    sizes = now.groupBy("band", "hash", "label").agg(F.count("*").alias("n"))
    main = sizes.groupBy("band", "hash").agg(
        F.max(F.struct("n", "label"))["label"].alias("main"), (F.sum("n") - F.max("n")).alias("outside")
    )
    open_ = now.join(main.filter("outside > 0"), ["band", "hash"])
    others = {"node": "other", "label": "other_label", "size": "other_size", "shared": "other_shared"}
    rest = open_.filter("label != main").drop("main", "common", "group").withColumnsRenamed(others)
    return open_, rest


def _described(many: DataFrame, bodies: DataFrame, similarity: float, words: int) -> tuple[DataFrame, DataFrame]:
    """Members of large buckets with size (shingles) and shared (those that are not rare); (group, node, token) of rare ones.

    Buckets with one leader are a group, as are those whose leader has a leader in common.  A shingle is rare in
    a group if at most RARE of its texts hold it.
    """
    least = lambda name: F.min(F.struct(F.xxhash64(name), name))[name]
    home = many.groupBy("node").agg(least("common").alias("group"))
    leaders = many.select(F.col("common").alias("node")).distinct().join(home, "node")
    members = many.join(_kept(leaders.withColumnRenamed("node", "common"), "leaders"), "common").drop("common")
    nodes = _kept(members.select("group", "node").distinct(), "nodes")
    sample = nodes.groupBy("group", F.pmod(F.xxhash64("node"), F.lit(SAMPLE)).alias("slot")).agg(F.min("node").alias("node"))

    def frequent(rows: pd.DataFrame) -> pd.DataFrame:
        tokens, n = np.unique(np.concatenate([numbered(shingles(t, words)) for t in rows["text"]]), return_counts=True)
        often = tokens[n >= max(2, len(rows) // 20)]
        return pd.DataFrame({"group": [rows["group"].iloc[0]], "often": [often.tobytes()]})

    often = _kept(sample.join(bodies, "node").groupBy("group").applyInPandas(frequent, "group binary, often binary"), "often")

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            tokens = [numbered(shingles(t, words)) for t in batch["text"]]
            apart = [np.setdiff1d(t, np.frombuffer(f, np.uint64), True) for t, f in zip(tokens, batch["often"], strict=True)]
            yield batch[["group", "node"]].assign(size=[len(t) for t in tokens], tokens=[a.view(np.int64) for a in apart])

    told = _kept(
        nodes.join(bodies, "node").join(often, "group").select("group", "node", "text", "often")
        .mapInPandas(describe, "group binary, node binary, size long, tokens array<long>"), "described",
    )
    tokens = told.select("group", "node", F.explode("tokens").alias("token"))
    held = tokens.groupBy("group", "token").agg(F.count("*").alias("n")).filter("n > 1")
    tokens = _kept(tokens.join(held, ["group", "token"]), "tokens")
    also = tokens.filter(F.col("n") > RARE).groupBy("group", "node").agg(F.count("*").alias("also"))
    sizes = told.join(also, ["group", "node"], "left").select(
        "group", "node", "size", (F.col("size") - F.size("tokens") + F.coalesce("also", F.lit(0))).alias("shared")
    )
    return _kept(members.join(sizes, ["group", "node"]), "large"), tokens.filter(F.col("n") <= RARE).drop("n")


def _likely(open_: DataFrame, rest: DataFrame, rare: DataFrame, similarity: float) -> DataFrame:
    """(node, other) of different classes in large buckets, without pairs that cannot be alike.

    Two texts of sizes x and y that are alike have at least similarity / (1 + similarity) * (x + y) shingles in common.  If none of these
    is rare, each text has that many which are not; if one is, they meet there, where at most RARE texts do.
    """
    both = ["group", "node"]
    met = rare.join(open_.select(*both, "label").distinct(), both)
    others = rest.select(F.col("other").alias("node"), "other_label").distinct()
    met_by = rare.join(others, "node").withColumnRenamed("node", "other")
    sharing = met.join(met_by, ["group", "token"]).filter("label != other_label").select("node", "other")
    enough = lambda shared, size: F.col(shared) >= similarity * F.col(size) - 1e-6
    need = similarity * (F.col("size") + F.col("other_size")) - 1e-6
    plain = open_.filter(enough("shared", "size")).join(rest.filter(enough("other_shared", "other_size")).drop("outside"), ["band", "hash"])
    return sharing.union(
        plain.filter("label != other_label").filter(F.least("shared", "other_shared") * (1 + similarity) >= need).select("node", "other")
    )


def one_per_class(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The document of least id of each class, once; all columns kept (see near_classes)."""
    classes = near_classes(docs, key, text, **how)
    keep = classes.filter(F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("node") == F.col("keeper_node"))).select(
        F.col("doc_id").alias(fresh(docs, "_kept_id")), F.col("node").alias(fresh(docs, "_kept_node"))
    ).distinct()
    node = fresh(docs, "_node")
    single = docs.withColumn(node, text_key(quoted(text))).dropDuplicates([key, node])
    matched = quoted(key).eqNullSafe(quoted(keep.columns[0])) & (quoted(node) == quoted(keep.columns[1]))
    return single.join(keep, matched, "left_semi").select(*[quoted(c) for c in docs.columns])
