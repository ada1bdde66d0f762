"""A toxicity classifier whose scores do not move when identity terms are swapped.

Logistic regression on the words of a text and on their beginnings.  Fitting also looks at
counterfactual twins of the labelled texts: a text that names a group is paired with itself naming
another one, and a text that names none with itself with one word turned into such a name.  The squared
difference of the two scores is penalised, so weight goes to what is said and not to whom.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsframe.llm.base import fresh, quoted

#: Labelled rows that a fit may use; more are sampled by a hash of their id.
MAX_TRAIN = 16_000
#: Features kept: those whose number of toxic texts is this many standard deviations from what chance gives.
MIN_DEVIATIONS = 4.0
MIN_TEXTS = 4
MAX_FEATURES = 8_192
THRESHOLD = 0.3
PREFIXES = (3, 4, 5, 6)
#: Names of groups, each list swapped within itself; pass others for other languages or needs.
IDENTITY = (
    ("muslim", "jewish", "christian", "hindu", "buddhist", "catholic", "atheist"),
    ("muslims", "jews", "christians", "hindus", "buddhists", "catholics", "atheists"),
    ("black", "white", "asian", "latino", "african", "european", "arab", "indigenous"),
    ("women", "men", "girls", "boys", "mothers", "fathers"),
    ("woman", "man", "girl", "boy", "mother", "father"),
    ("female", "male"),
    ("gay", "lesbian", "straight", "bisexual", "transgender", "queer"),
    ("immigrants", "refugees", "foreigners", "natives", "citizens"),
    ("disabled", "deaf", "blind", "autistic", "elderly", "young"),
    ("american", "mexican", "chinese", "german", "french", "spanish", "russian", "turkish", "polish"),
    ("musulmans", "juifs", "chrétiens"), ("femmes", "hommes"), ("homosexuels", "hétérosexuels"),
    ("muslime", "juden", "christen"), ("frauen", "männer"), ("schwule", "lesben"),
    ("musulmanes", "judíos", "cristianos"), ("mujeres", "hombres"), ("inmigrantes", "extranjeros"),
)
_WORD = re.compile(r"[^\W\d_]+")


def features_of(word: str) -> list[int]:
    """Hashes of the word and of its beginnings."""
    parts = ["=" + word] + [word[:n] for n in PREFIXES if len(word) > n]
    return [xxhash.xxh3_64_intdigest(p) >> 1 for p in parts]


def distinct_words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def held_out(key: Column) -> Column:
    return F.crc32(key.cast("string")) % 4 == 2


@dataclass
class Model:
    """Weights by feature hash; a text's score adds those of all features it has, once each."""

    weights: dict[int, float]
    bias: float

    def scorer(self) -> Callable[[str | None], float]:
        known: dict[str, tuple[int, ...]] = {}

        def of(word: str) -> tuple[int, ...]:
            if word not in known:
                if len(known) >= 500_000:
                    known.clear()
                known[word] = tuple(f for f in features_of(word) if f in self.weights)
            return known[word]

        def score(text: str | None) -> float:
            found: set[int] = set()
            for word in distinct_words(text):
                found.update(known[word] if word in known else of(word))
            z = self.bias + sum(self.weights[f] for f in sorted(found))
            return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))

        return score


def swapped(words: set[str], seed: int, groups=IDENTITY) -> set[str]:
    """The words of a counterfactual twin: group names swapped, or one word turned into one."""
    other = {t: g[(i + 1 + seed % (len(g) - 1)) % len(g)] for g in groups for i, t in enumerate(g)}
    named = {w for w in words if w in other}
    if named:
        return (words - named) | {other[w] for w in named}
    terms = sorted(other)
    gone = {min(words, key=lambda w: xxhash.xxh3_64_intdigest(w, seed & 0xFFFF))} if words else set()
    return (words - gone) | {terms[seed % len(terms)]}


def training_rows(
    docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, most: int = MAX_TRAIN
) -> DataFrame:
    """At most about ``most`` labelled texts that are not held out: id, text, label.

    An id labelled twice counts as toxic if either label says so; an id on several rows gives its least text, so
    repeated rows do not add to the sample.
    """
    known = (
        labels.select(quoted(key).alias("id"), quoted(label).cast("int").alias("label"))
        .filter("id is not null and label is not null").filter(~held_out(F.col("id")))
        .groupBy("id").agg(F.max("label").alias("label"))
    )
    total = known.count()
    share = int(min(1.0, most / max(1, total)) * (1 << 30))
    chosen = known.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share)
    rows = docs.select(quoted(key).alias("id"), quoted(text).alias("text"))
    found = rows.join(F.broadcast(chosen), "id")  # no more rows than ``most`` allows
    return found.groupBy("id").agg(F.min("text").alias("text"), F.first("label").alias("label"))


def _counts(rows: DataFrame) -> DataFrame:
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n, toxic = Counter(), Counter()
            for text, label in zip(batch["text"], batch["label"], strict=True):
                found = {f for w in distinct_words(text) for f in features_of(w)}
                n.update(found)
                if label:
                    toxic.update(found)
            names = np.fromiter(n, np.int64, len(n))
            yield pd.DataFrame({"feature": names, "n": list(n.values()), "toxic": [toxic[f] for f in n]})

    counted = rows.select("text", "label").mapInPandas(count, "feature long, n long, toxic long")
    return counted.groupBy("feature").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))


def _vectors(rows: DataFrame, chosen: dict[int, int], groups) -> DataFrame:
    """Label, feature places, and the places that only the text or only its twin has."""

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def places(words: set[str]) -> set[int]:
            return {chosen[f] for w in words for f in features_of(w) if f in chosen}

        for batch in batches:
            out = []
            for text, label in zip(batch["text"], batch["label"], strict=True):
                words = distinct_words(text)
                own = places(words)
                twin = places(swapped(words, xxhash.xxh3_64_intdigest(text or ""), groups))
                out.append((int(label), sorted(own), sorted(own - twin), sorted(twin - own)))
            yield pd.DataFrame(out, columns=["label", "own", "lost", "gained"])

    return rows.select("text", "label").mapInPandas(
        vectors, "label int, own array<int>, lost array<int>, gained array<int>"
    )


def _flat(lists: list) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(x) for x in lists], np.int64)
    flat = np.concatenate([np.asarray(x, np.int64) for x in lists]) if lengths.sum() else np.empty(0, np.int64)
    return np.repeat(np.arange(len(lists)), lengths), flat


def fit_weights(
    label: np.ndarray, own: list, lost: list, gained: list, width: int,
    ridge: float = 1e-5, counterfactual: float = 2.0, rounds: int = 400, rate: float = 0.1,
) -> tuple[np.ndarray, float]:
    """Minimise log loss + ridge * |w|^2 + counterfactual * mean (score(x) - score(twin))^2, by Adam."""
    n = len(label)
    row, col = _flat(own)
    drow, dcol = _flat([list(a) + list(b) for a, b in zip(lost, gained, strict=True)])
    sign = np.concatenate([np.r_[np.ones(len(a)), -np.ones(len(b))] for a, b in zip(lost, gained, strict=True)]) if n else np.empty(0)
    share = float(np.clip(label.mean(), 1e-3, 1 - 1e-3)) if n else 0.001
    w, b = np.zeros(width), float(np.log(share / (1 - share)))
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, rounds + 1 if n else 1):
        p = 1 / (1 + np.exp(-np.clip(b + np.bincount(row, w[col], n), -40, 40)))
        error = (p - label) / n
        moved = np.bincount(drow, sign * w[dcol], n)
        grad = np.bincount(col, error[row], width) + 2 * ridge * w
        grad += 2 * counterfactual / n * np.bincount(dcol, sign * moved[drow], width)
        grad = np.r_[grad, error.sum()]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = rate * (1 - step / (rounds + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, b = w - move[:-1], b - float(move[-1])
    return w, b


def fit(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
    most: int = MAX_TRAIN, groups=IDENTITY, counterfactual: float = 2.0,
) -> Model:
    """Fit on labelled rows that are not held out; what reaches the driver is bounded by ``most``."""
    rows = training_rows(docs, labels, key, text, label, most)
    counts = _counts(rows)
    share = rows.agg(F.avg("label")).first()[0] or 0.0
    mean = F.col("n") * F.lit(share)
    far = F.abs(F.col("toxic") - mean) / F.sqrt(mean * (1 - F.lit(share)) + 1e-9)
    top = counts.filter((F.col("n") >= MIN_TEXTS) & (far >= MIN_DEVIATIONS)).orderBy(F.desc(far), "feature").limit(MAX_FEATURES).collect()
    chosen = {r["feature"]: i for i, r in enumerate(top)}
    seen = _vectors(rows, chosen, groups).toPandas()
    w, b = fit_weights(
        seen["label"].to_numpy(float), list(seen["own"]), list(seen["lost"]), list(seen["gained"]),
        len(chosen), counterfactual=counterfactual,
    )
    return Model({f: float(w[i]) for f, i in chosen.items()}, b)


def scored(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with a score between 0 and 1 for the whole of each text; a null text is an empty one."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by MAX_FEATURES

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = shared.value.scorer()
        for batch in batches:
            yield pd.Series([of(t) for t in batch], dtype="float64")

    return docs.withColumn(into, score(quoted(text)))


def clean(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows scored as toxic; all columns kept, whatever they are called.

    A null or empty text has the score of the model's intercept; equal texts share their fate, an empty table stays empty.
    """
    into = fresh(docs, "_toxicity")
    return scored(docs, model, text, into).filter(quoted(into) < threshold).drop(into)
