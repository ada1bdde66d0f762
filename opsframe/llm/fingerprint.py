"""Improbable-feature digests: rare byte windows of a text, in a chain of Bloom filters.

Every 32-byte window has a Shannon entropy, and a rank by rule puts the entropies that are rarer in
texts first.  Within each run of 32 windows the one of lowest rank gains a point, and windows with enough points are features.  Their hashes fill Bloom filters of 256
bytes, a new filter after every 128 features.  Two digests are compared by the overlap of their bits,
scaled from what chance gives (0) to what is possible (1).
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsframe.llm.base import quoted
from opsframe.llm.shingles import mix

WINDOW = 32
RUN = 32
POINTS = 8
#: Texts of fewer code points give all their windows of SHORT_WINDOW bytes instead.
SHORT = 512
SHORT_WINDOW = 8
FILTER_BYTES = 256
FILTER_FEATURES = 128
PROBES = 5
#: Entropies are counted in thousandths of their largest value.
LEVELS = 1000
NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_BITS = FILTER_BYTES * 8
_CHUNK = 1 << 16


def _growth() -> np.ndarray:
    """What one more equal byte adds to the sum of c*log2(c) over a window's byte counts, as integers."""
    c = np.arange(WINDOW + 1, dtype=np.float64)
    total = c * np.log2(np.maximum(c, 1))
    return np.round(np.diff(total) * (1 << 20)).astype(np.int64)


_GROWTH = _growth()


def _rank_rule() -> np.ndarray:
    """Rank by entropy level: text lies near three quarters of the most; far from there is rare.

    Levels below a tenth (runs of one byte) rank last, so that padding gives no features.
    """
    level = np.arange(LEVELS + 1)
    rank = 800 - np.abs(level - 750)
    rank[level < 100] = 1000
    return np.maximum(rank, 0).astype(np.int64)


_RANK = _rank_rule()
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    forward = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n - 1, _BASE, np.uint64))))
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    return forward, np.cumprod(np.concatenate(([np.uint64(1)], np.full(n - 1, inverse, np.uint64))))


_FORWARD, _INVERSE = _powers(_CHUNK + 4 * WINDOW + 1)


def entropy_levels(data: np.ndarray) -> np.ndarray:
    """Entropy level of each window, sliding by one byte, with exact integer sums.

    A byte's count among the 31 bytes before it says what it adds when it enters a window, its count
    among the 31 after it what it takes away on leaving.
    """
    n = len(data)
    before, after = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    for step in range(1, WINDOW):
        same = (data[step:] == data[:-step]).view(np.uint8)
        before[step:] += same
        after[: n - step] += same
    added, taken = _GROWTH[before[WINDOW:]], _GROWTH[after[: n - WINDOW]]
    first = np.bincount(data[:WINDOW], minlength=1).astype(np.int64)
    start = int(sum(int(_GROWTH[:c].sum()) for c in first[first > 0]))
    sums = np.concatenate(([start], start + np.cumsum(added - taken)))
    most = WINDOW * np.log2(WINDOW)
    level = np.round(LEVELS * (1 - sums / (1 << 20) / most)).astype(np.int64)
    return np.clip(level, 0, LEVELS)


def _window_hash(part: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` bytes at each place of a chunk, the same wherever the bytes stand."""
    sums = np.concatenate(
        ([np.uint64(0)], np.cumsum((part.astype(np.uint64) + np.uint64(1)) * _FORWARD[: len(part)], dtype=np.uint64))
    )
    return mix((sums[at + width] - sums[at]) * _INVERSE[at])


def _every_window(data: bytes) -> np.ndarray:
    part = np.frombuffer(data, np.uint8)
    width = min(SHORT_WINDOW, len(part))
    return _window_hash(part, np.arange(len(part) - width + 1), width)


def _rare_windows(texts: list[bytes]) -> list[np.ndarray]:
    """For each text of at least WINDOW + RUN bytes, the hashes of its features in order of place.

    The texts are laid end to end and taken in chunks, so memory is a few bytes per byte of text.
    """
    ends = np.cumsum([len(t) for t in texts])
    whole = np.frombuffer(b"".join(texts), np.uint8)
    last_run = np.repeat(ends, [len(t) for t in texts]) - (WINDOW + RUN - 2)  # a run stays within its text
    points = np.zeros(len(whole), np.uint8)
    reach = WINDOW + RUN - 2
    for begin in range(0, max(1, len(whole) - reach), _CHUNK):
        part = whole[begin : begin + _CHUNK + reach]
        key = (_RANK[entropy_levels(part)] << 20) | np.arange(len(part) - WINDOW + 1)
        width = 1
        while width < RUN:
            key = np.minimum(key[:-width], key[width:])
            width *= 2
        runs = np.arange(begin, begin + len(key))
        won = (key & ((1 << 20) - 1))[runs < last_run[begin : begin + len(key)]]
        count = np.bincount(won, minlength=len(part))[: len(part)]
        points[begin : begin + len(part)] += count.astype(np.uint8)
    chosen = np.flatnonzero(points >= POINTS)
    hashes = [np.empty(0, np.uint64)]
    for begin in range(0, len(whole), _CHUNK):
        here = chosen[(chosen >= begin) & (chosen < begin + _CHUNK)] - begin
        hashes.append(_window_hash(whole[begin : begin + _CHUNK + WINDOW], here, WINDOW))
    return np.split(np.concatenate(hashes), np.searchsorted(chosen, ends[:-1]))


def features(texts: list[str]) -> list[np.ndarray]:
    """Hashes of each text's features, once each, in order of place.

    Texts of under SHORT code points give every window of 8 bytes, as so few of them stand out; up to twice
    that length they give both kinds, so a text stays like its shortened self.
    """
    encoded = [t.encode() for t in texts]
    long = [i for i, t in enumerate(texts) if len(t) >= SHORT]
    rare = dict(zip(long, _rare_windows([encoded[i] for i in long]), strict=True)) if long else {}
    out = []
    for i, text in enumerate(texts):
        found = rare.get(i, np.empty(0, np.uint64))
        if text and len(text) < 2 * SHORT:
            found = np.concatenate((found, _every_window(encoded[i])))
        out.append(found if len(found) or not text else _every_window(encoded[i][:WINDOW]))
    for i, found in enumerate(out):
        _, first = np.unique(found, return_index=True)
        out[i] = found[np.sort(first)]
    return out


def digests(texts: list[str]) -> list[np.ndarray]:
    """Bloom filters of the features: for each text (filters, 32) 64-bit words; no rows for an empty text."""
    out = []
    for found in features(texts):
        count = -(-len(found) // FILTER_FEATURES)
        bits = np.zeros((count, _BITS), np.uint8)
        at = np.arange(len(found)) // FILTER_FEATURES
        for probe in range(PROBES):
            bits[at, (found >> np.uint64(11 * probe)) & np.uint64(_BITS - 1)] = 1
        out.append(np.packbits(bits, axis=1, bitorder="little").view(np.uint64).reshape(count, FILTER_BYTES // 8))
    return out


def written(filters: np.ndarray) -> str:
    return base64.b64encode(filters.tobytes()).decode()


def read(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), np.uint64).reshape(-1, FILTER_BYTES // 8)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: each filter of the shorter chain against its best match in the other, weighted by its bits.

    A score is the overlap above chance, as a share of the most that can overlap above chance.
    Empty digests are alike; an empty one is unlike any other.
    """
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if a.shape == b.shape and (a == b).all():
        return 1.0
    if len(a) > len(b):
        a, b = b, a
    in_a, in_b = np.bitwise_count(a).sum(1).astype(float), np.bitwise_count(b).sum(1).astype(float)
    total = 0.0
    for row, bits in zip(a, in_a, strict=True):
        overlap = np.bitwise_count(row & b).sum(1)
        chance = bits * in_b / _BITS
        score = (overlap - chance) / np.maximum(np.minimum(bits, in_b) - chance, 1)
        total += bits * float(np.clip(score, 0, 1).max())
    return total / float(in_a.sum())


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by the beginning of the next text."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def in_order(docs: DataFrame, key: str = "doc_id", text: str = "text", ranges: int | None = None) -> DataFrame:
    """Rows dealt to ranges of descending key, each range ended by a guest: the first row of the next.

    Returns doc_id, text, range, guest, rank, tie; the last range's guest is the very first row.  Limits are
    approximate quantiles of rank, the negated key plus a fraction from the text's hash, so many texts
    under one key spread over several ranges.  Only the limits and one row per range reach the driver.
    """
    spark = docs.sparkSession
    ranges = ranges or max(8, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(quoted(key).alias("doc_id"), F.coalesce(quoted(text), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text")).withColumn(
        "rank",
        F.coalesce(-F.col("doc_id").cast("double"), F.lit(1e300)) + F.pmod("tie", F.lit(1 << 32)) / 2.0**32,
    )
    cuts = rows.agg(F.percentile_approx("rank", [i / ranges for i in range(1, ranges)], 20 * ranges)).first()[0]
    limits = sorted(set(cuts or []))
    index = F.size(F.filter(F.array(*[F.lit(c) for c in limits]), lambda c: c < F.col("rank"))) if limits else F.lit(0)
    rows = rows.withColumn("range", index)
    place = F.struct("rank", "tie")
    heads = rows.groupBy("range").agg(F.min(place).alias("place")).orderBy("range").collect()
    to = [(heads[i - 1]["range"], h["place"]["rank"], h["place"]["tie"]) for i, h in enumerate(heads)]
    guests = rows.join(
        F.broadcast(spark.createDataFrame(to, "to int, g_rank double, g_tie long")),  # a row per range
        (F.col("rank") == F.col("g_rank")) & (F.col("tie") == F.col("g_tie")),
    )
    guests = guests.groupBy("to").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"))
    own = rows.select("doc_id", "text", "range", F.lit(False).alias("guest"), "rank", "tie")
    return own.unionByName(
        guests.select(
            "doc_id", "text", F.col("to").alias("range"), F.lit(True).alias("guest"),
            F.lit(0.0).alias("rank"), F.lit(0).cast("long").alias("tie"),
        )
    )


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", ranges: int | None = None) -> DataFrame:
    """One row per document: its digest, that of its edited text, and how alike they and the next one's are.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.  The next
    document is the one of next lower key, after the last the first; equal keys are ordered
    by a hash of their texts, null keys come last.  A null text is an empty one, whose digest is "".
    Repeated rows each keep a row.  A table of one row has itself as next.  Other columns are not looked at.
    Rows stream through a task one pair at a time.
    """
    dealt = in_order(docs, key, text, ranges).repartition("range").sortWithinPartitions("range", "guest", "rank", "tie")
    kind = dealt.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: tuple | None = None
        for batch in batches:
            pairs = []
            for row in zip(batch["doc_id"], batch["text"], batch["guest"], strict=True):
                if held is not None:
                    pairs.append((held[0], held[1], row[1]))
                held = None if row[2] else row
                if sum(len(p[1]) for p in pairs) > 100_000:
                    yield rows_of(pairs)
                    pairs = []
            yield rows_of(pairs)

    def rows_of(pairs: list[tuple]) -> pd.DataFrame:
        changed = [edited(a, b) for _, a, b in pairs]
        own = digests([a for _, a, _ in pairs] + [b for _, _, b in pairs[-1:]])
        after = digests(changed)
        # the next document is the next pair's own, unless a range ends in between
        follows = [own[i + 1] if i + 1 == len(pairs) or pairs[i + 1][1] == b else digests([b])[0] for i, (_, _, b) in enumerate(pairs)]
        return pd.DataFrame(
            [
                (
                    name, len(a), hashlib.sha256(c.encode()).hexdigest(), written(f), written(g),
                    likeness(f, g), likeness(f, h),
                )
                for (name, a, _), c, f, g, h in zip(pairs, changed, own[: len(pairs)], after, follows, strict=True)
            ],
            columns=NAMES,
        )

    types = ["long", "string", "string", "string", "double", "double"]
    return dealt.select("doc_id", "text", "guest").mapInPandas(
        work, ", ".join(f"{n} {t}" for n, t in zip(NAMES, [kind, *types], strict=True))
    )
