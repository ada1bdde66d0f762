"""Snapshots of files by content hash."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Larger files are read in pieces, many tasks a file; no task holds one.
WHOLE_FILE_BYTES = 1 << 25
PIECE_BYTES = 1 << 20
#: Names that make Spark's text reader decompress: such files are read as one value whatever their size.
PACKED_NAME = r"(?i)\.(gz|bz2|lz4|snappy|deflate|zst|zstd|passthrough)$"
_MARK = b"\xef\xbb\xbf"  # the text reader drops it at the start of a file


def file_hashes(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, hash) of the files in a folder, of any size.

    SHA-256 is sequential: the pieces of a large file, read by many tasks, are sorted and run through by one task, which
    holds a piece at a time.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    whole = (F.col("_metadata.file_size") <= WHOLE_FILE_BYTES) | F.col("_metadata.file_name").rlike(PACKED_NAME)
    hashes = files.filter(whole).select("path", F.sha2("content", 256).alias("hash"))
    large = files.filter(~whole).select("path", "length", F.col("_metadata.file_path").alias("uri")).collect()
    if not large:
        return hashes
    lines = spark.read.option("pathGlobFilter", pattern).option("lineSep", "\n").text(folder).filter(~whole)
    lines = lines.select(
        F.col("_metadata.file_path").alias("uri"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("line"),
    )
    return hashes.unionByName(_hashes_of_lines(lines, [(r["path"], r["length"], r["uri"]) for r in large]))


def _hashes_of_lines(lines: DataFrame, files: list[tuple[str, int, str]]) -> DataFrame:
    """(path, hash) of files (path, length, uri), whose lines (uri, block, line) come in order within a block."""
    numbers = {uri: number for number, (_, _, uri) in enumerate(files)}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = 0
        for batch in batches:
            start = 0
            for (uri, block), rows in groupby(zip(batch["uri"].to_pylist(), batch["block"].to_pylist())):
                n = sum(1 for _ in rows)
                text = b"\n".join([*batch["line"].slice(start, n).to_pylist(), b""])
                start += n
                pieces = [text[i : i + PIECE_BYTES] for i in range(0, len(text), PIECE_BYTES)]
                places = range(place, place + len(pieces))
                place += len(pieces)
                columns = [
                    pa.array([numbers[uri]] * len(pieces), pa.int32()),
                    pa.array([block] * len(pieces), pa.int64()),
                    pa.array(places, pa.int64()),
                    pa.array(pieces, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["number", "block", "place", "piece"])

    def pieces_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
        for batch in batches:
            yield from zip(batch["number"].to_pylist(), batch["piece"].to_pylist())

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows in groupby(pieces_of(batches), key=lambda row: row[0]):
            path, length, _ = files[number]
            plain, marked, last, total = hashlib.sha256(), hashlib.sha256(_MARK), b"", 0
            for _, piece in rows:
                plain.update(last)
                marked.update(last)
                last = piece
                total += len(piece)
            # A file without a last line break is one byte shorter than its lines, one with a mark three longer.
            state, total = (marked, total + len(_MARK)) if total < length - 1 else (plain, total)
            if total not in (length, length + 1):
                raise ValueError(f"read {total} bytes of {length}: {path}")
            state.update(last[: len(last) - (total - length)])
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([state.hexdigest()])], ["path", "hash"])

    pieces = lines.mapInArrow(cut, "number int, block long, place long, piece binary")
    dealt = pieces.repartitionById(len(files), "number").sortWithinPartitions("number", "block", "place")
    return dealt.mapInArrow(digest, "path string, hash string")


def file_snapshot(paths: DataFrame, hashes: DataFrame) -> DataFrame:
    """exists and hash per asked path."""
    found = hashes.select("path", "hash", F.lit(True).alias("_there"))
    return paths.join(found, "path", "left").select(
        "path", F.coalesce("_there", F.lit(False)).alias("exists"), "hash"
    )
