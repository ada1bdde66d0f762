"""JSON-lines logs that tolerate torn writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsframe.functions.keys import json_quoted
from opsframe.operators.ordered import ordered_columns


#: Files of a log up to which the table of their splits is broadcast.
LISTED_FILES = 100_000


def read_jsonl_tolerant(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Non-blank lines of the files at ``path``: (path, line_no, text, torn, record).

    ``record`` is the parsed value, a variant or, with ``schema``, a struct; torn
    lines keep their text and never fail the read.  Files may be split: a line's number is its place
    within the split after the lines of the splits before it.  The lines of each split are counted in a
    pass of its own, so texts are never shuffled.
    """
    texts = spark.read.text(path)
    lines = texts.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
        F.col("value"),
    )
    splits = lines.groupBy("path", "_block").agg(F.count("*").alias("_lines"), F.min("_row").alias("_first"))
    # A file has far fewer splits than a task may sort.
    before = ordered_columns(splits, ["path"], ["_block"], running={"_upto": F.col("_lines")}, sizes=(0, 0))
    starts = before.select("path", "_block", "_first", (F.col("_upto") - F.col("_lines")).alias("_before"))
    if len(texts.inputFiles()) <= LISTED_FILES:  # a row a split, of which the driver plans no more than it lists
        starts = F.broadcast(starts)
    line_no = F.col("_before") + F.col("_row") - F.col("_first") + 1
    numbered = lines.join(starts, ["path", "_block"]).withColumn("line_no", line_no)
    text = F.regexp_replace("value", r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    parsed = F.try_parse_json("text")
    record = parsed if schema is None else F.from_json("text", schema)
    return (
        numbered.select("path", "line_no", text.alias("text"))
        .filter(F.col("text") != "")
        .withColumn("torn", parsed.isNull())
        .withColumn("record", F.when(~F.col("torn"), record))
    )


def quarantine_torn(
    log: DataFrame, kept_path: str, corrupt_path: str, stamp: Column
) -> tuple[int, int]:
    """Write good lines and torn lines to two new folders; (kept, moved) counts.

    The caller then switches to the new folder: the log being read is not
    overwritten.  Torn lines are preceded by a comment with their number.
    """
    log.filter(~F.col("torn")).select(F.col("text").alias("value")).write.text(kept_path)
    bad = log.filter("torn")
    note = F.format_string(
        "# torn line %d (quarantined %s)",
        F.col("line_no"),
        F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss'Z'"),
    )
    bad.select(F.concat(note, F.lit("\n"), F.col("text")).alias("value")).write.text(corrupt_path)
    # Counted in what was written, a line a record and two a torn one: an Observation would stay in the session, and
    # learned models whose functions hold the session could then no longer be sent to tasks.
    written = log.sparkSession.read
    return written.text(kept_path).count(), written.text(corrupt_path).count() // 2


def utc_text(moment: Column) -> Column:
    """Date and time to the second in UTC, whatever the session's time zone."""
    seconds = F.floor(F.unix_micros(moment) / 1_000_000).cast("bigint")
    day = F.date_from_unix_date(F.floor(seconds / 86_400).cast("int"))
    left = F.pmod(seconds, F.lit(86_400))
    return F.concat(
        day.cast("string"),
        F.format_string("T%02d:%02d:%02d", F.floor(left / 3600), F.floor(left / 60) % 60, left % 60),
    )


def stamp_text(moment: Column) -> Column:
    """ISO 8601 text of a moment in UTC, with microseconds where there are any."""
    micros = F.pmod(F.unix_micros(moment), F.lit(1_000_000))
    return F.concat(
        utc_text(moment), F.when(micros > 0, F.format_string(".%06d", micros)).otherwise(""), F.lit("+00:00")
    )


def record_lines(records: DataFrame, now: Column, *keep: str) -> DataFrame:
    """JSON line per record (kind, content, provenance), stamped with ``now`` in UTC, beside the columns in ``keep``."""
    stamp = stamp_text(now)
    entries = F.transform(
        F.array_sort(F.map_entries(F.coalesce("provenance", F.expr("map()").cast("map<string,string>")))),
        lambda e: F.concat(json_quoted(e["key"]), F.lit(": "), json_quoted(e["value"])),
    )
    line = F.concat(
        F.lit('{"content": '),
        json_quoted(F.col("content")),
        F.lit(', "kind": '),
        json_quoted(F.col("kind")),
        F.lit(', "provenance": {'),
        F.array_join(entries, ", "),
        F.lit('}, "timestamp": "'),
        stamp,
        F.lit('"}'),
    )
    return records.select(*keep, line.alias("value"))


def append_records(records: DataFrame, path: str, now: Column) -> None:
    """Append stamped records to a JSON-lines log."""
    record_lines(records, now).write.mode("append").text(path)
