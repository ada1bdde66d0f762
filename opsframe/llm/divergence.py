"""Source divergence audit: exact term counts of every source through minimal perfect hashes.

A first pass counts the documents of every term exactly and keeps the frequent ones.  The kept terms are dealt into shards,
and each shard gets a minimal perfect hash: a displacement per bucket sends its terms to slots without gaps, and the
term stored in the slot tells strangers apart.  The hashes are broadcast in waves of bounded size; a second pass over the texts
looks its terms up and counts them in dense slots per (lang, source) group.  Shares and their differences are whole numbers.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opsframe.llm.base import quoted
from opsframe.llm.shingles import mix
from opsframe.session import scratch_folder

MIN_DOCUMENTS = 30
SMOOTHING = 5
SCALE_STEPS = 3  # thousands, so shares are in billionths
TOP_TERMS = 50
#: Terms a shard is meant to hold, and cells (sources times terms) of a shard in one task.
SHARD_TERMS = 4096
SHARD_CELLS = 1 << 22
#: Terms of one wave of broadcast hashes; more kept terms mean more waves, each a pass over the texts.
WAVE_TERMS = 1 << 20
#: Longer terms are stored in a hash by their SHA-256 digest.
STORED_BYTES = 64
#: Distinct terms, and dense cells, that a task holds before it sends on what it has counted.
HELD_TERMS = 400_000
HELD_CELLS = 1 << 22
_KEYS_PER_BUCKET = 3
_SEED = 42
_TURN = np.uint64(0x9E3779B97F4A7C15)
# What a term is made of, letters A to Z lower-cased and all bytes beyond ASCII.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters, lower-cased, and of characters beyond ASCII, as UTF-8."""
    return text.translate(_LETTERS).split() if text else []


def stored(term: bytes) -> bytes:
    """What a hash keeps of a term to know it again."""
    return term if len(term) <= STORED_BYTES else b"\0" + hashlib.sha256(term).digest()


def term_hashes(terms: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(t, _SEED) for t in terms), np.uint64, len(terms))


def _slots(hashes: np.ndarray, displacement: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    """Slot of each hash; a displacement below zero names the slot itself."""
    turned = mix(hashes + displacement.astype(np.uint64) * _TURN) % np.asarray(n).astype(np.uint64)
    return np.where(displacement < 0, -displacement.astype(np.int64) - 1, turned.astype(np.int64))


def perfect_hash(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Displacements per bucket and each key's slot, 0 to n - 1 without gaps, for distinct hashes."""
    n = len(hashes)
    buckets = max(1, -(-n // _KEYS_PER_BUCKET))
    bucket = (mix(hashes) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    sizes = np.bincount(bucket, minlength=buckets)
    starts = np.cumsum(sizes) - sizes
    displacement, slot, free = np.zeros(buckets, np.int64), np.zeros(n, np.int64), np.ones(n, bool)
    for b in np.argsort(-sizes, kind="stable").tolist():
        own = order[starts[b] : starts[b] + sizes[b]]
        if len(own) < 2:
            break
        tries, at = 32, 0
        while True:
            given = np.arange(at, at + tries)
            places = _slots(hashes[own][:, None], given[None, :], n)
            ordered = np.sort(places, axis=0)
            fits = free[places].all(0) & (ordered[1:] != ordered[:-1]).all(0)
            if fits.any():
                found = int(fits.argmax())
                displacement[b], slot[own] = given[found], places[:, found]
                free[places[:, found]] = False
                break
            at, tries = at + tries, min(tries * 2, 4096)
    single = np.flatnonzero(sizes == 1)
    left = np.flatnonzero(free)
    slot[order[starts[single]]] = left
    displacement[single] = -left - 1
    return displacement, slot


def kept_terms(docs: DataFrame, min_documents: int) -> DataFrame:
    """(lang, term) of the terms that so many documents of a lang hold, counted exactly; ``term`` is binary."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        n = 0

        def out() -> Iterator[pa.RecordBatch]:
            for lang, counts in held.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(counts), pa.string()), pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())],
                    ["lang", "term", "n"],
                )

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                counts = held.setdefault(lang, Counter())
                n -= len(counts)
                counts.update(set(terms_of(text)))
                n += len(counts)
                if n >= HELD_TERMS:
                    yield from out()
                    held, n = {}, 0
        yield from out()

    counted = docs.select("lang", "text").mapInArrow(work, "lang string, term binary, n long")
    return counted.groupBy("lang", "term").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_documents).select("lang", "term")


def hash_tables(kept: DataFrame, sizes: DataFrame) -> DataFrame:
    """One row per (lang, shard): its displacements, the number of hashed terms, and the terms by slot.

    ``sizes`` has (lang, kept, shards).  Terms whose 64-bit hashes are equal, if there are any, follow after the slots.
    """

    def build(rows: pa.Table) -> pa.Table:
        terms = sorted(rows.column("term").to_pylist())
        hashes, first = np.unique(term_hashes(terms), return_index=True)
        displacement, slot = perfect_hash(hashes)
        by_slot = first[np.argsort(slot)]
        rest = sorted(set(range(len(terms))) - set(first.tolist()))
        row = {
            "lang": rows.column("lang")[0].as_py(), "shard": rows.column("shard")[0].as_py(), "shards": rows.column("shards")[0].as_py(),
            "displacement": displacement.tobytes(), "hashed": len(hashes), "terms": [terms[i] for i in [*by_slot.tolist(), *rest]],
        }
        return pa.Table.from_pylist([row], schema=pa.schema([
            ("lang", pa.string()), ("shard", pa.int64()), ("shards", pa.int64()), ("displacement", pa.binary()),
            ("hashed", pa.int64()), ("terms", pa.list_(pa.binary())),
        ]))

    shard = F.shiftrightunsigned(F.xxhash64("term"), 32) % F.col("shards")
    dealt = kept.join(sizes, "lang").select("lang", shard.alias("shard"), "shards", "term")
    return dealt.groupBy("lang", "shard").applyInArrow(
        build, "lang string, shard long, shards long, displacement binary, hashed long, terms array<binary>"
    )


class HashWave:
    """The perfect hashes of one wave: ``places`` leads from terms of a lang to dense places, -1 for strangers."""

    def __init__(self, rows: list) -> None:
        rows = sorted(rows, key=lambda r: (r["lang"], r["shard"]))
        lengths = [len(np.frombuffer(r["displacement"], np.int64)) for r in rows]
        self.displacement = np.concatenate([np.frombuffer(r["displacement"], np.int64) for r in rows])
        self.buckets = np.array(lengths)
        self.bucket_base = np.cumsum(lengths) - lengths
        self.hashed = np.array([r["hashed"] for r in rows])
        counts = np.array([len(r["terms"]) for r in rows])
        self.base = np.cumsum(counts) - counts
        self.shard = np.array([r["shard"] for r in rows])
        self.keys = np.empty(int(counts.sum()), object)
        self.keys[:] = [stored(t) for r in rows for t in r["terms"]]
        #: lang -> (first table, end of its tables, first place, number of places, table of each shard)
        self.langs: dict[str, tuple] = {}
        self.extra: dict[tuple[str, bytes], int] = {}
        for i, r in enumerate(rows):
            lang = r["lang"]
            if lang not in self.langs:
                self.langs[lang] = (i, i, int(self.base[i]), 0, np.full(r["shards"], -1))
            first, _, start, size, table = self.langs[lang]
            table[r["shard"]] = i
            self.langs[lang] = (first, i + 1, start, size + len(r["terms"]), table)
            for j in range(r["hashed"], len(r["terms"])):
                self.extra[lang, stored(r["terms"][j])] = int(self.base[i]) + j - start

    def places(self, lang: str, terms: list[bytes]) -> np.ndarray:
        _, _, start, _, table = self.langs[lang]
        hashes = term_hashes(terms)
        at = table[((hashes >> np.uint64(32)) % np.uint64(len(table))).astype(np.int64)]
        bucket = self.bucket_base[at] + (mix(hashes) % self.buckets[at].astype(np.uint64)).astype(np.int64)
        place = self.base[at] + _slots(hashes, self.displacement[bucket], self.hashed[at])
        own = np.empty(len(terms), object)
        own[:] = [stored(t) for t in terms]
        known = (at >= 0) & (self.keys[place] == own).astype(bool)
        out = np.where(known, place - start, -1)
        if self.extra:
            for i in np.flatnonzero(~known).tolist():
                out[i] = self.extra.get((lang, own[i]), -1)
        return out


_COUNTED = "lang string, shard long, source string, slots binary, counts binary, total long"


def recounted(spark: SparkSession, docs: DataFrame, wave: HashWave) -> DataFrame:
    """Occurrences of the wave's terms by group and shard, as packed slots and counts of what a task saw."""
    shared = spark.sparkContext.broadcast(wave)  # about WAVE_TERMS terms of at most STORED_BYTES

    def packed(dense: dict[tuple[str, str], np.ndarray]) -> Iterator[pa.RecordBatch]:
        wave = shared.value
        for (lang, source), counts in dense.items():
            first, end, start, _, _ = wave.langs[lang]
            used = np.flatnonzero(counts)
            cuts = np.searchsorted(used, wave.base[first + 1 : end] - start)
            rows = []
            for i, places in enumerate(np.split(used, cuts), first):
                if len(places):
                    n, slots = counts[places], places + start - wave.base[i]
                    rows.append((lang, int(wave.shard[i]), source, slots.astype(np.int32).tobytes(), n.tobytes(), int(n.sum())))
            if rows:
                yield pa.RecordBatch.from_pydict(dict(zip(["lang", "shard", "source", "slots", "counts", "total"], zip(*rows), strict=True)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wave = shared.value
        seen: dict[tuple[str, str], Counter] = {}
        dense: dict[tuple[str, str], np.ndarray] = {}
        held = cells = 0

        def count() -> None:
            nonlocal cells
            for group, terms in seen.items():
                places = wave.places(group[0], list(terms))
                counts = np.fromiter(terms.values(), np.int64, len(terms))
                if group not in dense:
                    dense[group] = np.zeros(wave.langs[group[0]][3], np.int64)
                    cells += len(dense[group])
                dense[group][places[places >= 0]] += counts[places >= 0]
            seen.clear()

        for batch in batches:
            for group, text in zip(
                zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True), batch.column("text").to_pylist(), strict=True
            ):
                terms = terms_of(text) if group[0] in wave.langs else None
                if not terms:
                    continue
                counts = seen.setdefault(group, Counter())
                held -= len(counts)
                counts.update(terms)
                held += len(counts)
                if held >= HELD_TERMS:
                    count()
                    held = 0
                    if cells >= HELD_CELLS:
                        yield from packed(dense)
                        dense.clear()
                        cells = 0
        count()
        yield from packed(dense)

    return docs.select("lang", "source", "text").mapInArrow(work, _COUNTED)


def shares(counts: np.ndarray, whole: int) -> np.ndarray:
    """1 + floor(10^9 (count + 5) / whole), digit group by digit group, so nothing overflows below 9 * 10^15 terms."""
    out, rest = np.divmod(counts + SMOOTHING, whole)
    for _ in range(SCALE_STEPS):
        group, rest = np.divmod(rest * 1000, whole)
        out = out * 1000 + group
    return 1 + out


def _compare(top: int):
    """Differences within one (lang, shard): of each two sources, and each source's terms above the lang's share."""
    names = ["lang", "source", "other", "term", "value"]
    kinds = pa.schema([("lang", pa.string()), ("source", pa.string()), ("other", pa.string()), ("term", pa.binary()), ("value", pa.int64())])

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(dict(zip(names, zip(*rows), strict=True)), schema=kinds)

    def work(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang, wholes, kept, terms = key[0].as_py(), {}, 0, []
        dense: dict[str, np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["terms"] is not None:
                    terms = row["terms"]
                elif row["slots"] is None:
                    wholes[row["source"]], kept = row["whole"], row["kept"]
                else:
                    slots = np.frombuffer(row["slots"], np.int32)
                    own = dense.get(row["source"], np.zeros(0, np.int64))
                    if slots[-1] >= len(own):
                        own = np.concatenate([own, np.zeros(int(slots[-1]) + 1 - len(own), np.int64)])
                    own[slots] += np.frombuffer(row["counts"], np.int64)
                    dense[row["source"]] = own
        sources = sorted(wholes, key=str.encode)
        counts = np.zeros((len(sources), len(terms)), np.int64)
        for i, source in enumerate(sources):
            own = dense.get(source, ())
            counts[i, : len(own)] = own
        share = np.zeros_like(counts)
        for i, source in enumerate(sources):
            if kept:
                share[i] = shares(counts[i], wholes[source] + SMOOTHING * kept)
        for i, source in enumerate(sources[:-1]):
            apart = np.abs(share[i + 1 :] - share[i]).sum(1).tolist()
            yield out([(lang, source, other, None, value) for other, value in zip(sources[i + 1 :], apart, strict=True)])
        if terms:
            gains = share - shares(counts.sum(0), sum(wholes.values()) + SMOOTHING * kept)
            rank = np.empty(len(terms), np.int64)
            rank[sorted(range(len(terms)), key=terms.__getitem__)] = np.arange(len(terms))
            for i, source in enumerate(sources):
                own = np.flatnonzero((counts[i] > 0) & (gains[i] > 0))
                best = own[np.lexsort((rank[own], -gains[i, own]))[:top]]
                if len(best):
                    yield out([(lang, source, None, terms[j], int(gains[i, j])) for j in best.tolist()])

    return work


def audit(
    table: DataFrame, lang: str = "lang", source: str = "source", text: str = "text",
    min_documents: int = MIN_DOCUMENTS, top: int = TOP_TERMS,
) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source's terms stand from those of the lang's other sources.

    Part ``pair`` has the summed differences of share to each other source, part ``term`` the terms whose share exceeds that
    in the whole lang most.  Null langs, sources and texts are empty ones.  Repeated rows are documents each;
    ties go to the smaller item by UTF-8; groups without terms have pairs only; a lang of a single source has none; an
    empty table gives no rows; other columns are not looked at.
    """
    spark = table.sparkSession
    empty = F.lit("")
    docs = table.select(
        F.coalesce(quoted(lang).cast("string"), empty).alias("lang"),
        F.coalesce(quoted(source).cast("string"), empty).alias("source"),
        quoted(text).cast("binary").alias("text"),
    )

    def written(df: DataFrame, name: str) -> DataFrame:
        folder = scratch_folder(spark, name)
        df.write.parquet(folder)
        return spark.read.schema(df.schema).parquet(folder)

    groups = written(docs.select("lang", "source").distinct(), "groups")
    most = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 1
    width = max(16, min(SHARD_TERMS, SHARD_CELLS // most))
    kept = written(kept_terms(docs, min_documents), "kept")
    sizes = kept.groupBy("lang").agg(F.count("*").alias("kept"))
    sizes = sizes.withColumn("shards", F.ceil(F.col("kept") / width))
    tables = written(hash_tables(kept, sizes), "hashes")
    waves = -(-kept.count() // WAVE_TERMS)
    counted = scratch_folder(spark, "counts")
    spark.createDataFrame([], _COUNTED).write.parquet(counted)
    for n in range(waves):
        rows = tables.filter(F.pmod(F.xxhash64("lang", "shard"), F.lit(waves)) == n).collect()  # one wave
        if rows:
            recounted(spark, docs, HashWave(rows)).write.mode("append").parquet(counted)
    counts = spark.read.schema(_COUNTED).parquet(counted)

    wholes = counts.groupBy("lang", "source").agg(F.sum("total").alias("whole"))
    whole = groups.join(wholes, ["lang", "source"], "left").join(sizes, "lang", "left").na.fill(0, ["whole", "kept", "shards"])
    shard = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("shards"), F.lit(1)) - 1)).alias("shard")
    laid = (
        counts.drop("total")
        .unionByName(whole.select("lang", "source", "whole", "kept", shard), allowMissingColumns=True)
        .unionByName(tables.select("lang", "shard", "terms"), allowMissingColumns=True)
    )
    compared = laid.groupBy("lang", "shard").applyInArrow(
        _compare(top), "lang string, source string, other string, term binary, value long"
    )
    parts = written(compared, "parts")
    pairs = parts.filter("other is not null").groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    both = pairs.unionByName(pairs.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), "value"))
    terms = parts.filter("term is not null").select("lang", "source", F.col("term").cast("string").alias("item"), "value")
    ranked = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    first = both.withColumnRenamed("other", "item").withColumn("rank", ranked).withColumn("part", F.lit("pair"))
    second = terms.withColumn("rank", ranked).filter(F.col("rank") <= top).withColumn("part", F.lit("term"))
    return first.unionByName(second).select("lang", "source", "part", "item", "value", "rank")
