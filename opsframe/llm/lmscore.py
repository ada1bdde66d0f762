"""Cross-entropy difference: how much better a target model foresees a text than a background model.

Both models are bigram models with the same vocabulary and the same smoothing; one counts the target
texts, the other all texts.  Words, word pairs and contexts are told apart by 63-bit hashes, so no two of
them share a count in practice, and the tables of counts grow with the corpus.  No task and no driver holds a
model: texts are taken in chunks, each chunk's counts go to ranges of the hash space as packed blocks, are added up
there, and the sums of just its own keys come back to the chunk.  A document's
score is the mean difference of the two losses per token; lower is more like the target.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsframe.llm.base import quoted
from opsframe.llm.shingles import _HASH, _ODD, mix, words_of
from opsframe.session import scratch_folder

#: Words that the smoothing makes room for at least; a corpus with more distinct words gets as many.
VOCABULARY = 1 << 17
#: Tokens that a context must have been seen to weigh as much as the unigram below it.
BACKOFF = 5.0
SMOOTHING = 0.5
#: Tokens of a chunk of whole documents; a longer document is a chunk of its own.
_CHUNK = 1_500_000
#: Ranges of the hash space at least (256 or more, see packed_keys), and characters of input for each when there are more.
_RANGES = 256
_RANGE_CHARS = 16_000_000


def token_ids(text: str | None) -> np.ndarray:
    """64-bit hashes of the words, after a mark for the beginning (0)."""
    words = words_of(text)
    return np.fromiter((0, *map(_HASH.__getitem__, words)), np.uint64, len(words) + 1)


def pair_cells(ids: np.ndarray) -> np.ndarray:
    """Key of each word with the one before it; even, as only words have odd keys."""
    return mix(ids[:-1] * _ODD[0] + mix(ids[1:] + _ODD[1])) & ~np.uint64(1)


def _word_keys(ids: np.ndarray) -> np.ndarray:
    return mix(ids[1:] + _ODD[2]) | np.uint64(1)


def _context_keys(ids: np.ndarray) -> np.ndarray:
    return mix(ids[:-1] + _ODD[3]) & ~np.uint64(1)


def packed(numbers: np.ndarray) -> bytes:
    """Whole numbers from 0 in as few bytes each as the largest needs; the first byte says how many."""
    kind = np.min_scalar_type(int(numbers.max(initial=0)))
    return bytes([kind.itemsize]) + numbers.astype(kind).astype(f"<u{kind.itemsize}").tobytes()


def unpacked(block: bytes) -> np.ndarray:
    return np.frombuffer(block, f"<u{block[0]}", offset=1).astype(np.int64)


def packed_keys(keys: np.ndarray) -> bytes:
    """Keys of one range without their highest byte, which all of them share, as there are 256 ranges at least."""
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7].tobytes()


def unpacked_keys(block: bytes) -> np.ndarray:
    """The keys with a highest byte of zero: in the same order, and distinct within their range."""
    out = np.zeros((len(block) // 7, 8), np.uint8)
    out[:, :7] = np.frombuffer(block, np.uint8).reshape(-1, 7)
    return out.view("<u8").ravel()


def _keys(texts: list[np.ndarray]) -> np.ndarray:
    """All keys of some texts: words, then pairs, then contexts, each in the order of the tokens."""
    return np.concatenate([f(ids) for f in (_word_keys, pair_cells, _context_keys) for ids in texts])


def chunked(docs: DataFrame, chosen: DataFrame, bits: int) -> DataFrame:
    """Documents with their chunk, and each chunk's counts by range of the hash space.

    Rows with a ``bucket`` are sorted keys and their counts, ``target`` or not, the first with the chunk's tokens; the
    others are documents.
    """
    fields = ["chunk", "doc_id", "text", "tokens", "bucket", "target", "keys", "counts"]
    both = docs.withColumn("target", F.lit(False)).unionByName(
        chosen.select(F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), "text", F.lit(True).alias("target"))
    )

    def blocks(chunk: int, target: bool, texts: list[np.ndarray]) -> Iterator[pd.DataFrame]:
        keys, counts = np.unique(_keys(texts), return_counts=True)
        buckets = (keys >> np.uint64(64 - bits)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(buckets, prepend=-1))
        n = sum(len(ids) - 1 for ids in texts)
        rows = [
            (chunk, None, None, 0 if a else n, int(buckets[a]), target, packed_keys(keys[a:b]), packed(counts[a:b]))
            for a, b in zip(cuts, [*cuts[1:], len(keys)], strict=True)
        ]
        yield pd.DataFrame(rows, columns=fields, dtype=object)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunk = TaskContext.get().partitionId() << 32
        held: dict[bool, list[np.ndarray]] = {False: [], True: []}
        size = {False: 0, True: 0}
        for batch in batches:
            out = []
            for doc, body, target in zip(batch["doc_id"], batch["text"], batch["target"], strict=True):
                ids, target = token_ids(body), bool(target)
                if size[target] and size[target] + len(ids) > _CHUNK:
                    yield from blocks(chunk, target, held[target])
                    held[target], size[target] = [], 0
                    chunk += not target
                if len(ids) > 1:
                    held[target].append(ids)
                    size[target] += len(ids)
                if not target:
                    out.append((chunk, doc, body, len(ids) - 1, None, None, None, None))
            yield pd.DataFrame(out, columns=fields, dtype=object)
        for target, texts in held.items():
            if texts:
                yield from blocks(chunk, target, texts)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return both.mapInPandas(
        work, f"chunk long, doc_id {kind}, text string, tokens long, bucket long, target boolean, keys binary, counts binary"
    )


def summed(blocks: DataFrame) -> DataFrame:
    """Each chunk's keys with their sums in both models, in the order of the keys; ``words``: distinct words of a range."""

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        keys = [unpacked_keys(k) for k in rows["keys"]]
        ends = np.cumsum([len(k) for k in keys])
        distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
        counts = np.concatenate([unpacked(c) for c in rows["counts"]])
        target = np.repeat(rows["target"].to_numpy(bool), [len(k) for k in keys])
        sums = [np.bincount(place[side], counts[side], len(distinct)).astype(np.int64) for side in (target, ~target)]
        bucket, words = int(rows["bucket"].iloc[0]), int((distinct & np.uint64(1)).sum())
        out = [(None, bucket, None, None, words)]
        for chunk, chosen, end, own in zip(rows["chunk"], rows["target"], ends, keys, strict=True):
            if not chosen:
                part = place[end - len(own) : end]
                out.append((chunk, bucket, packed(sums[0][part]), packed(sums[1][part]), 0))
        return pd.DataFrame(out, columns=["chunk", "bucket", "in_target", "in_all", "words"], dtype=object)

    return blocks.groupBy("bucket").applyInPandas(add, "chunk long, bucket long, in_target binary, in_all binary, words long")


def _losses(words: np.ndarray, pairs: np.ndarray, contexts: np.ndarray, whole: int, vocabulary: int) -> np.ndarray:
    """Nats per token: the pair's share, mixed with the smoothed share of the word."""
    word = (words + SMOOTHING) / (whole + SMOOTHING * vocabulary)
    return -np.log((pairs + BACKOFF * word) / (contexts + BACKOFF))


def score_chunks(docs: DataFrame, sums: DataFrame, wholes: tuple[int, int], vocabulary: int) -> DataFrame:
    """doc_id, n_tokens, loss_target, loss_background, score (their difference) per document."""
    names = ["doc_id", "n_tokens", "loss_target", "loss_background", "score"]

    def work(rows: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"doc_id": rows["doc_id"], "n_tokens": rows["tokens"]}).assign(**dict.fromkeys(names[2:], np.nan))
        full = np.flatnonzero(rows["tokens"].to_numpy() > 0)
        if len(full):
            blocks = blocks.sort_values("bucket")
            distinct, place = np.unique(_keys([token_ids(t) for t in rows["text"].iloc[full]]), return_inverse=True)
            n = rows["tokens"].to_numpy()[full]
            starts = np.cumsum(n) - n
            for name, column, whole in zip(names[2:4], ["in_target", "in_all"], wholes, strict=True):
                total = np.concatenate([unpacked(b) for b in blocks[column]])
                if len(total) != len(distinct):
                    raise ValueError(f"{len(total)} sums for {len(distinct)} keys of a chunk")
                per_token = _losses(*np.split(total[place], 3), whole, vocabulary)
                out.iloc[full, out.columns.get_loc(name)] = np.add.reduceat(per_token, starts) / n
            out["score"] = out["loss_target"] - out["loss_background"]
        return out

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.groupBy("chunk").cogroup(sums.groupBy("chunk")).applyInPandas(
        work, f"doc_id {kind}, n_tokens long, loss_target double, loss_background double, score double"
    )


def cross_entropy_difference(
    docs: DataFrame, chosen: DataFrame, key: str = "doc_id", text: str = "text", body: str = "text"
) -> DataFrame:
    """Score ``docs`` by a model of the ``chosen`` texts against a model of all of ``docs``.

    A null or empty text, or one without words, has no tokens and null losses.  Repeated rows are counted and
    scored each.  Without target texts the target model is flat.  An empty table gives no rows.
    Other columns are not looked at.
    """
    spark = docs.sparkSession
    docs = docs.select(quoted(key).alias("doc_id"), quoted(text).alias("text"))
    chosen = chosen.select(quoted(body).alias("text"))
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = (max(_RANGES, chars // _RANGE_CHARS + 1) - 1).bit_length()
    folder = scratch_folder(spark, "chunks")  # a chunk must stay the same in both steps
    chunked(docs, chosen, bits).write.parquet(folder)
    rows = spark.read.parquet(folder)
    folder = scratch_folder(spark, "sums")
    summed(rows.filter("bucket is not null").select("chunk", "bucket", "target", "keys", "counts")).write.parquet(folder)
    sums = spark.read.parquet(folder)
    wholes = {r["target"]: r["n"] for r in rows.filter("bucket is not null").groupBy("target").agg(F.sum("tokens").alias("n")).collect()}
    words = sums.agg(F.sum("words")).first()[0] or 0
    return score_chunks(
        rows.filter("bucket is null").select("chunk", "doc_id", "text", "tokens"),
        sums.filter("chunk is not null").select("chunk", "bucket", "in_target", "in_all"),
        (wholes.get(True, 0), wholes.get(False, 0)),
        max(VOCABULARY, words),
    )
