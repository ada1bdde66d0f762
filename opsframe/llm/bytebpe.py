"""Byte-level BPE: encode texts by replaying the merges over many texts at once, and decode ids.

A chunk of the corpus is cut into pieces by the pattern and each distinct piece is kept once, its bytes laid out
end to end as positions linked to their neighbours.  An inverted index leads from the rank of a token pair to the
positions where that pair starts.  The lowest rank in the index is taken next and merged at all of its positions in
one step; only the pairs that touch a merged position change, and just those are looked up and filed again.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from opsframe.llm.base import quoted

#: A chunk ends when its distinct pieces have so many bytes, or when it has so many pieces; a text is never cut.
CHUNK_BYTES = 2_500_000
CHUNK_PIECES = 4_000_000
#: Texts of one Arrow batch of results end after so many ids.
_BATCH_IDS = 1_000_000


@dataclass(frozen=True)
class Vocabulary:
    """``tokens[rank]`` and what the replay looks up, bounded by the size of the rank file."""

    tokens: tuple[bytes, ...]
    byte: np.ndarray  # rank of each single byte
    pairs: np.ndarray  # sorted keys left << 32 | right of the pairs that form a token
    ranks: np.ndarray  # rank of the token that each pair forms
    turning: np.ndarray  # ranks that can start a pair of a lower rank
    ranked: dict[bytes, int]

    @staticmethod
    def of(ranked: dict[bytes, int]) -> Vocabulary:
        if sorted(ranked.values()) != list(range(len(ranked))):
            raise ValueError("ranks must run from 0 without gaps")
        missing = [b for b in range(256) if bytes([b]) not in ranked]
        if missing:
            raise ValueError(f"{len(missing)} single bytes have no rank")
        keys, formed = [], []
        for token, rank in ranked.items():
            for cut in range(1, len(token)):
                left, right = ranked.get(token[:cut]), ranked.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    formed.append(rank)
        pairs, ranks = np.array(keys, np.int64), np.array(formed, np.int32)
        order = np.argsort(pairs)
        pairs, ranks = pairs[order], ranks[order]
        turning = np.zeros(len(ranked), bool)
        for part in (pairs >> 32, pairs & 0xFFFFFFFF):
            turning[part[ranks < part]] = True
        tokens = tuple(sorted(ranked, key=ranked.__getitem__))
        return Vocabulary(tokens, np.array([ranked[bytes([b])] for b in range(256)], np.int32), pairs, ranks, turning, ranked)

    @staticmethod
    def load(path: str) -> Vocabulary:
        """Read a rank file on the driver: a base64 token and its rank a line."""
        with open(path, "rb") as lines:
            return Vocabulary.of({base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())})

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that each pair forms, -1 if it forms none."""
        if not len(self.pairs):
            return np.full(len(left), -1, np.int32)
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.pairs[:-1], key)
        return np.where(self.pairs[at] == key, self.ranks[at], np.int32(-1))


class _PairIndex:
    """Positions by the rank of the pair that starts there; the lowest rank comes out first."""

    def __init__(self) -> None:
        self.places: dict[int, list[np.ndarray]] = {}
        self.heap: list[int] = []

    def add(self, ranks: np.ndarray, places: np.ndarray) -> None:
        if len(ranks) > 1:
            order = np.argsort(ranks, kind="stable")
            ranks, places = ranks[order], places[order]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            runs = zip(ranks[[0, *cuts]].tolist(), np.split(places, cuts), strict=True)
        else:
            runs = zip(ranks.tolist(), [places], strict=False)
        for rank, part in runs:
            if rank in self.places:
                self.places[rank].append(part)
            else:
                self.places[rank] = [part]
                heapq.heappush(self.heap, rank)

    def lowest(self) -> tuple[int, np.ndarray]:
        rank = heapq.heappop(self.heap)
        return rank, np.sort(np.concatenate(self.places.pop(rank)))


def encoded_pieces(pieces: list[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pieces, end to end, and how many each piece has.

    A piece that is a token as a whole gets that token, even where merges in order of rank would not lead to it.
    """
    ids, counts = replay(pieces, vocabulary)
    split = ((i, vocabulary.ranked.get(pieces[i])) for i in np.flatnonzero(counts > 1).tolist())
    whole = [(i, rank) for i, rank in split if rank is not None]
    if whole:
        ends = np.cumsum(counts)
        keep = np.ones(len(ids), bool)
        for i, rank in whole:
            ids[ends[i] - counts[i]] = rank
            keep[ends[i] - counts[i] + 1 : ends[i]] = False
            counts[i] = 1
        ids = ids[keep]
    return ids, counts


def replay(pieces: list[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """What the merges alone make of the pieces: ids end to end, and how many each piece has."""
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    total = int(lengths.sum())
    token = vocabulary.byte[np.frombuffer(b"".join(pieces), np.uint8)]
    piece = np.repeat(np.arange(len(pieces), dtype=np.int32), lengths)
    ahead = np.arange(1, total + 1, dtype=np.int32)
    back = np.arange(-1, total - 1, dtype=np.int32)
    same = piece[1:] == piece[:-1]
    ahead[np.append(~same, True)[:total]] = -1
    back[np.append(True, ~same)[:total]] = -1
    #: Rank of the pair that starts at a position now; -1: none, or the position is merged into an earlier one.
    current = np.full(total, -1, np.int32)
    index = _PairIndex()
    starts = np.flatnonzero(ahead >= 0).astype(np.int32)
    current[starts] = vocabulary.rank(token[starts], token[ahead[starts]])
    known = starts[current[starts] >= 0]
    index.add(current[known], known)
    alive = np.ones(total, bool)
    merging = np.zeros(total, bool)
    while index.heap:
        rank, at = index.lowest()
        at = at[current[at] == rank]
        if not len(at):
            continue
        if vocabulary.turning[rank]:  # a merge here may bring up a lower rank, which goes first within its piece
            first = np.append(True, piece[at[1:]] != piece[at[:-1]])
            if not first.all():
                index.add(np.full(int((~first).sum()), rank, np.int32), at[~first])
                at = at[first]
        elif len(at) > 1:  # of pairs that overlap in a run, every second one falls away
            linked = np.append(False, ahead[at[:-1]] == at[1:])
            if linked.any():
                place = np.arange(len(at))
                run = place - np.maximum.accumulate(np.where(linked, 0, place))
                at = at[run % 2 == 0]
        gone = ahead[at]
        after = ahead[gone]
        token[at] = rank
        alive[gone] = False
        current[gone] = -1
        ahead[at] = after
        inner = after >= 0
        back[after[inner]] = at[inner]
        before = back[at]
        before = before[before >= 0]
        merging[at] = True
        before = before[~merging[before]]
        merging[at] = False
        current[at[~inner]] = -1
        touched = np.concatenate([at[inner], before])
        new = vocabulary.rank(token[touched], token[ahead[touched]])
        current[touched] = new
        known = new >= 0
        if known.any():
            index.add(new[known], touched[known])
    return token[alive], np.bincount(piece[alive], minlength=len(pieces))


class _Places(dict):
    """Place of each distinct piece in order of first sight; ``size`` is their bytes."""

    size = 0

    def __missing__(self, piece: str) -> int:
        place = self[piece] = len(self)
        self.size += len(piece.encode())
        return place


def _encoded(texts: list[np.ndarray], places: _Places, vocabulary: Vocabulary) -> Iterator[np.ndarray]:
    """The ids of each text, from the places of its pieces."""
    ids, counts = encoded_pieces([p.encode() for p in places], vocabulary)
    ends = np.cumsum(counts)
    for text in texts:
        n = counts[text]
        shift = np.repeat(ends[text] - np.cumsum(n), n)
        yield ids[np.arange(len(shift)) + shift]


def _id_batches(keys: list, texts: Iterator[np.ndarray], key_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    held, n, first = [], 0, 0
    for place, ids in enumerate(texts, 1):
        held.append(ids.astype(np.int32))
        n += len(ids)
        if n >= _BATCH_IDS or place == len(keys):
            ends = np.concatenate([[0], np.cumsum([len(x) for x in held])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(held), pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(keys[first:place], key_type), lists], ["key", "ids"])
            held, n, first = [], 0, place


def encode(docs: DataFrame, vocabulary: Vocabulary, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and the token ``ids`` of each row's whole text, without special tokens.

    Each match of ``pattern`` is encoded by itself.  A null or empty text has no ids, a null key stays null, repeated
    rows give a row each, and an empty table gives none; strings of special tokens in a text are plain text, and other
    columns are not looked at.  A chunk holds whole texts, so a text must fit into a task.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # as large as the rank file
    rows = docs.select(quoted(key).alias("key"), quoted(text).cast("string").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(pattern).findall
        keys: list = []
        texts: list[np.ndarray] = []
        places, pieces, kind = _Places(), 0, None
        for batch in batches:
            kind = batch.schema.field("key").type
            for row_key, body in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = find(body) if body else []
                keys.append(row_key)
                texts.append(np.fromiter(map(places.__getitem__, found), np.int32, len(found)))
                pieces += len(found)
                if places.size >= CHUNK_BYTES or pieces >= CHUNK_PIECES:
                    yield from _id_batches(keys, _encoded(texts, places, shared.value), kind)
                    keys, texts, places, pieces = [], [], _Places(), 0
        if keys:
            yield from _id_batches(keys, _encoded(texts, places, shared.value), kind)

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(work, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def decode(encoded: DataFrame, vocabulary: Vocabulary, ids: str = "ids", out: str = "bytes") -> DataFrame:
    """``encoded`` with the bytes that ``ids`` stand for in a column ``out``.

    Null ids give null bytes, no ids give no bytes; an id outside the vocabulary is an error.  A column that is called like
    ``out`` already, in any case, is replaced.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary.tokens)
    rows = encoded.drop(*[c for c in encoded.columns if c.lower() == out.lower()])
    place = rows.columns.index(ids)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spell = dict(enumerate(shared.value)).__getitem__
        for batch in batches:
            column = batch.column(place)
            present, sizes = column.is_valid().to_pylist(), column.value_lengths().fill_null(0).to_numpy()
            flat, ends = column.flatten().to_numpy(), np.cumsum(sizes)
            first, texts = 0, []
            for row, (n, end) in enumerate(zip(sizes.tolist(), ends.tolist(), strict=True), 1):
                texts.append(b"".join(map(spell, flat[end - n : end].tolist())) if present[row - 1] else None)
                if row == len(sizes) or end - (ends[first - 1] if first else 0) >= _BATCH_IDS:
                    own = batch.slice(first, row - first)
                    yield pa.RecordBatch.from_arrays([*own.columns, pa.array(texts, pa.binary())], [*batch.schema.names, out])
                    first, texts = row, []

    return rows.mapInArrow(work, T.StructType([*rows.schema, T.StructField(out, T.BinaryType())]))
