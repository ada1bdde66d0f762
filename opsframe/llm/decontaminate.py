"""Benchmark decontamination by template windows.

Numbers, units and names become typed placeholders, so a question keeps its windows when its
values are exchanged.  Windows of both sides are joined by hash.  Where a window matches, the exchanged values
must be consistent: one benchmark value stands for one value in the document, all through.
Windows of the lower-cased words as they stand are joined beside them, for copies in another case and items of any kind or length.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsframe.llm.base import fresh, null_safe, quoted
from opsframe.llm.shingles import _ODD, mix, multiplier
from opsframe.session import scratch_folder

WINDOW = 8
#: Words of a window that must stand as they are, not as placeholders.
LITERALS = 4
#: Different windows of an item that a document must hold, or all windows of a shorter item.
WINDOWS_NEEDED = 4
#: Size of the pre-filter over all benchmark windows, whatever their number.
FILTER_BITS = 1 << 23
# Words that count as numbers and as units.
NUMBER_WORDS = frozenset("zero one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand million half".split())
UNITS = frozenset("mm cm m km kg g mg lb lbs oz l ml inch inches feet foot ft mile miles meter meters metre metres second seconds minute minutes hour hours day days week weeks month months year years dollar dollars euro euros cent cents percent usd eur mph kmh litre litres liter liters gram grams kilogram kilograms degrees".split())
_NUMBER = re.compile(r"\d[\d.,:/]*")
_MARKS = string.punctuation + "“”„‘’«»…–—¿¡€£·"
WORD, NUMBER, UNIT, NAME = 0, 1, 2, 3
_PLACE = mix(np.arange(1, 5, dtype=np.uint64))


class Tokens(dict):
    """What a raw token is: its place in growing columns of hash, kind, and two flags about sentences."""

    LIMIT = 400_000

    def __init__(self):
        super().__init__()
        self.hash = np.zeros(1 << 16, np.uint64)
        self.kind = np.zeros(1 << 16, np.int8)
        self.titled = np.zeros(1 << 16, bool)
        self.ends = np.zeros(1 << 16, bool)

    def __missing__(self, raw: str) -> int:
        word = raw if raw.isalnum() else raw.strip(_MARKS)
        low = word.lower()
        kind = WORD
        if word.isalpha():
            kind = NUMBER if low in NUMBER_WORDS else UNIT if low in UNITS else WORD
        elif not any(c.isalnum() for c in word):
            kind = -1  # marks only
        elif _NUMBER.fullmatch(word):
            kind = NUMBER
        place = len(self)
        if place == len(self.hash):
            for name in ("hash", "kind", "titled", "ends"):
                column = getattr(self, name)
                setattr(self, name, np.concatenate((column, np.zeros_like(column))))
        self[raw] = place
        self.hash[place] = xxhash.xxh3_64_intdigest(low)
        self.kind[place] = kind
        self.titled[place] = len(word) > 1 and word[0].isupper() and word[1:].islower()
        self.ends[place] = raw.rstrip("\"')]").endswith((".", "!", "?", ":"))
        return place

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(canonical hash, own hash, kind) of each token of the text."""
        raw = text.split()
        if len(self) > self.LIMIT:
            self.clear()
        at = np.fromiter(map(self.__getitem__, raw), np.int64, len(raw))
        own, kind, titled, ends = self.hash[at], self.kind[at], self.titled[at], self.ends[at]
        real = kind >= 0
        own, kind, titled, ends = own[real], kind[real].copy(), titled[real], ends[real]
        if len(own):
            inside = np.concatenate(([False], ~ends[:-1]))  # the first word of a sentence is no name
            kind[(kind == WORD) & titled & inside] = NAME
        return np.where(kind == WORD, own, _PLACE[kind]), own, kind


def windows(canonical: np.ndarray, kind: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each window, whether it holds enough words); a shorter text is one window of its own."""
    n = min(size, len(canonical))
    if not n:
        return np.empty(0, np.uint64), np.empty(0, bool)
    out = np.zeros(len(canonical) - n + 1, np.uint64)
    for place in range(n):
        out += canonical[place : place + len(out)] * multiplier(place)
    words = np.convolve(kind == WORD, np.ones(n, int), "valid")
    return mix(out + np.uint64(n)), words >= min(LITERALS, n)


def verbatim(own: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """Hash of each window of the words as they stand, apart from all template windows."""
    return mix(windows(own, np.zeros(len(own), np.int8), size)[0] + _ODD[4])


def _slots(own: np.ndarray, kind: np.ndarray, at: int, n: int) -> list[int]:
    part = slice(at, at + n)
    return own[part][kind[part] != WORD].view(np.int64).tolist()


def item_windows(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """All windows of the benchmark, templates and verbatim ones: item_id, verbatim, need, length, place, hash, size, slots.

    The first window is there twice if its first word would be a name inside a sentence, where a copy may stand.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = Tokens()
        for batch in batches:
            out = []
            for item, body in zip(batch["item_id"], batch["text"], strict=True):
                canonical, own, kind = tokens.of(body or "")
                n = min(WINDOW, len(own))
                whole = verbatim(own)
                need = min(WINDOWS_NEEDED, len(np.unique(whole)))
                out += [(item, True, need, len(own), i, h, n, []) for i, h in enumerate(whole.view(np.int64).tolist())]
                if n < LITERALS:
                    continue  # a template this short cannot be told from common speech
                hashes, good = windows(canonical, kind)
                inside = [x[1:] for x in tokens.of("x " + (body or ""))]
                also, fine = windows(inside[0][:n], inside[2][:n])
                sure = good.copy()
                sure[0] &= fine[0]
                need = min(WINDOWS_NEEDED, max(1, len(np.unique(hashes[sure]))))
                out += [(item, False, need, len(own), int(i), int(hashes[i].view(np.int64)), n, _slots(own, kind, i, n)) for i in np.flatnonzero(good)]
                if fine[0] and kind[0] != inside[2][0]:
                    out.append((item, False, need, len(own), 0, int(also[0].view(np.int64)), n, _slots(own, inside[2], 0, n)))
            yield pd.DataFrame(out, columns=["item_id", "verbatim", "need", "length", "place", "hash", "size", "slots"])

    rows = items.select(quoted(key).alias("item_id"), quoted(text).alias("text"))
    kind = rows.schema["item_id"].dataType.simpleString()
    return rows.mapInPandas(work, f"item_id {kind}, verbatim boolean, need int, length int, place int, hash long, size int, slots array<long>")


def _filter_words(wanted: DataFrame) -> np.ndarray:
    """A bit array of fixed size in which every window of the benchmark has its bit set."""
    bits = wanted.select(F.pmod("hash", F.lit(FILTER_BITS)).alias("bit"))
    words = bits.selectExpr("cast(floor(bit / 64) as int) as word", "shiftleft(1L, cast(bit % 64 as int)) as mask")
    out = np.zeros(FILTER_BITS // 64, np.int64)
    for row in words.groupBy("word").agg(F.bit_or("mask").alias("mask")).collect():  # FILTER_BITS / 64 rows at most
        out[row["word"]] = row["mask"]
    return out.view(np.uint64)


def document_hits(docs: DataFrame, filter_words: np.ndarray, sizes: list[int], text: str, carry: list[str]) -> DataFrame:
    """Windows of documents that may be the benchmark's: the carried columns, row (hash of the text), place, hash, size, slots."""
    shared = docs.sparkSession.sparkContext.broadcast(filter_words)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens, bits = Tokens(), shared.value

        def known(hashes: np.ndarray) -> np.ndarray:
            bit = hashes % np.uint64(FILTER_BITS)
            return (bits[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1

        for batch in batches:
            out = []
            for row in zip(*[batch[c] for c in carry], batch["_text"], strict=True):
                canonical, own, kind = tokens.of(row[-1] or "")
                head = (*row[:-1], np.uint64(xxhash.xxh3_64_intdigest(row[-1] or "")).view(np.int64).item())
                for size in sizes:
                    if len(own) < size:
                        continue
                    names, first = np.unique(verbatim(own, size), return_index=True)
                    for i in np.flatnonzero(known(names)):
                        out.append((*head, int(first[i]), int(names[i].view(np.int64)), size, []))
                    if size < LITERALS:
                        continue
                    hashes, good = windows(canonical, kind, size)
                    found = np.flatnonzero(good & known(hashes))
                    filled = np.concatenate(([0], np.cumsum(kind != WORD)))
                    told: set[int] = set()
                    for i in found:
                        name = int(hashes[i].view(np.int64))
                        plain = filled[i + size] == filled[i]
                        if not plain or name not in told:  # a repeat without values tells nothing new
                            told.add(name)
                            out.append((*head, int(i), name, size, _slots(own, kind, i, size)))
            yield pd.DataFrame(out, columns=[*carry, "row", "doc_place", "hash", "size", "doc_slots"])

    rows = docs.select(*carry, quoted(text).alias("_text"))
    types = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in carry)
    return rows.mapInPandas(work, f"{types}, row long, doc_place int, hash long, size int, doc_slots array<long>")


def leaks(docs: DataFrame, items: DataFrame, carry: list[str], text: str = "text", key: str = "item_id", body: str = "text") -> DataFrame:
    """One row per document (its ``carry`` columns) and item it holds.

    Further columns: item_id, windows (different windows of the item found), need, changed (whether values
    were exchanged).  Only windows whose values are exchanged consistently count: within a window by themselves, and
    between windows of one copy by the exchange that most windows agree on; a text may hold several copies, and the best
    one tells.  Windows of the words as they stand, whatever their case, count
    by themselves and may reach their need instead.  Null texts are empty; items of fewer than four words match as
    they stand only; an item shorter than a window is one window; repeated rows of equal carried columns count
    once; empty tables give no rows.
    """
    wanted = item_windows(items, key, body)
    sizes = sorted(r["size"] for r in wanted.select("size").distinct().collect())  # at most WINDOW values
    hits = document_hits(docs, _filter_words(wanted), sizes or [WINDOW], text, carry)
    pairs = hits.join(wanted, ["hash", "size"])
    exchange = F.zip_with("slots", "doc_slots", lambda a, b: F.struct(a.alias("was"), b.alias("now")))
    pairs = pairs.withColumn("exchange", F.array_distinct(exchange))
    functional = F.size(F.array_distinct("slots")) == F.size("exchange")  # one value for each benchmark value
    sound = pairs.filter(functional).withColumn("changed", F.exists("exchange", lambda e: e["was"] != e["now"]))
    keys = [*carry, "item_id"]
    # a copy lies at one distance from the item, or near it where words were put in; pieces far apart share the whole text
    distance = F.col("doc_place") - F.col("place")
    where = F.array(
        F.struct(F.lit(0).alias("kind"), F.col("row"), distance.cast("long").alias("at")),
        F.struct(F.lit(1).alias("kind"), F.col("row"), F.floor(distance / F.col("length")).alias("at")),
        F.struct(F.lit(2).alias("kind"), F.col("row"), F.floor(distance / F.col("length") + 0.5).alias("at")),
        F.struct(F.lit(3).alias("kind"), F.lit(0).cast("long").alias("row"), F.lit(0).cast("long").alias("at")),
    )
    free = F.when(F.size("exchange") > 0, where).otherwise(F.array(F.lit(None).cast("struct<kind:int,row:bigint,at:bigint>")))
    spread = sound.select(*keys, "verbatim", "need", "place", "exchange", "changed", F.explode(free).alias("copy")).distinct()
    folder = scratch_folder(docs.sparkSession, "windows")  # used several times below
    spread.write.parquet(folder)
    spread = docs.sparkSession.read.parquet(folder)
    # windows without values belong to every copy
    fixed = spread.filter("copy is null").groupBy(*keys, "verbatim", "need").agg(
        F.countDistinct("place").alias("fixed"), F.max(F.col("place") == 0).alias("fixed_first")
    )
    filled = spread.filter("copy is not null")
    copies = [*keys, "copy"]
    values = filled.select(*copies, "place", F.explode("exchange").alias("e")).select(*copies, "place", "e.was", "e.now")
    votes = values.groupBy(*copies, "was", "now").agg(F.countDistinct("place").alias("n"))
    best = votes.groupBy(*copies, "was").agg(F.max(F.struct("n", "now"))["now"].alias("now"))
    agreed = best.groupBy(*copies).agg(F.map_from_entries(F.collect_list(F.struct("was", "now"))).alias("agreed"))
    kept = null_safe(filled, agreed, copies).filter(F.forall("exchange", lambda e: F.element_at("agreed", e["was"]) == e["now"]))
    counted = kept.groupBy(*copies, "need").agg(
        F.countDistinct("place").alias("n"), F.max(F.col("place") == 0).alias("first"), F.max("changed").alias("changed")
    )
    # the first window may be there both with a value and without: it is one window
    best = counted.groupBy(*keys, "need").agg(
        F.max(F.struct("n", (~F.col("changed")).alias("same"))).alias("with_first"),
        F.max(F.struct((F.col("n") - F.col("first").cast("int")).alias("n"), (~F.col("changed")).alias("same"))).alias("but_first"),
    ).select(*keys, F.lit(False).alias("verbatim"), "need", "with_first", "but_first")
    parts = fixed.unionByName(best, allowMissingColumns=True).groupBy(*keys, "verbatim", "need").agg(
        *[F.max(c).alias(c) for c in ("fixed", "fixed_first", "with_first", "but_first")]
    )
    found = F.when(F.col("fixed_first"), F.col("but_first")).otherwise(F.col("with_first"))
    leaked = parts.select(
        *keys, "verbatim", "need",
        (F.coalesce("fixed", F.lit(0)) + F.coalesce(found["n"], F.lit(0))).cast("long").alias("windows"),
        F.coalesce(~found["same"], F.lit(False)).alias("changed"),
    ).filter("windows >= need")
    best = leaked.groupBy(*keys).agg(F.max(F.struct("windows", ~F.col("verbatim"), "need", "changed")).alias("best"))
    return best.select(*keys, "best.windows", "best.need", "best.changed")


def leak_pairs(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, windows, need, changed) for every leak; rows that share an id count together, copies row by row."""
    return leaks(docs.select(quoted(key).alias("doc_id"), quoted(text).alias("body")), items, ["doc_id"], "body")


def without_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item; all columns kept, whatever they are called.

    Null and empty texts hold none and stay; equal texts share their fate; without items, or without rows, nothing goes.
    """
    digest = fresh(docs, "_digest")
    leaked = fresh(docs, "_leaked")
    marked = docs.withColumn(digest, F.md5(F.coalesce(quoted(text), F.lit(""))))
    bad = leaks(marked.select(quoted(digest).alias("digest"), quoted(text).alias("body")), items, ["digest"], "body")
    bad = bad.select(F.col("digest").alias(leaked)).distinct()
    return marked.join(bad, quoted(digest) == quoted(leaked), "left_anti").select(*[quoted(c) for c in docs.columns])
