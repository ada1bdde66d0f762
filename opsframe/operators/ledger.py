"""Hash-chained ledgers and the searchable memory log."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsframe.functions.canonical import canonical_field, canonical_object, fields_of
from opsframe.functions.keys import json_quoted, json_string
from opsframe.operators.folds import Machine, fold
from opsframe.operators.ordered import join_keys, ordered_columns
from opsframe.session import cut_lineage
from opsframe.sources.jsonl import stamp_text

# Texts of the two kinds of chain damage.
BROKEN_LINK = "previous_hash mismatch"
BROKEN_HASH = "hash mismatch (tampered or rewritten)"

#: Queries, and characters of them, that are broadcast at a time by a search.
BLOCK_QUERIES = 1 << 17
BLOCK_CHARS = 1 << 22
#: Queries up to this length are looked up whole, longer ones by a run of it.
RUN = 16


def build_hash_chain(records: DataFrame, tails: DataFrame | None = None) -> DataFrame:
    """Chain records (chain_id, seq, body): each hash covers the one before it.

    hash = sha256(previous_hash followed by body).  ``tails`` (chain_id, hash)
    seeds chains that already have records.  A chain is sequential by nature; only
    its last hash is held, and a chain too long for one task is handed from slice
    to slice.
    """
    if tails is None:
        seeded = records.withColumn("_seed", F.lit(""))
    else:
        seeds = tails.select("chain_id", F.col("hash").alias("_seed"))
        seeded = records.join(seeds, "chain_id", "left").withColumn(
            "_seed", F.coalesce("_seed", F.lit(""))
        )

    def step(previous, row):
        digest = hashlib.sha256((previous + row[2]).encode()).hexdigest()
        return digest, (previous, digest)

    machine = Machine(
        start=lambda row: row[3],
        step=step,
        outputs=[("previous_hash", "string"), ("hash", "string")],
    )
    chained = fold(
        seeded.select("chain_id", "seq", "body", "_seed"), ["chain_id"], ["seq"], machine
    )
    return chained.drop("_seed")


def chain_issues(ledger: DataFrame) -> DataFrame:
    """One row per damaged link or hash of (chain_id, seq, body, previous_hash, hash).

    ``position`` counts the records of a chain from 0.
    """
    digest = F.sha2(F.concat("previous_hash", "body"), 256)
    return _issues(ledger.withColumn("_digest", digest))


def _issues(checked: DataFrame, first: str = "", sized_by: DataFrame | None = None) -> DataFrame:
    linked = ordered_columns(
        checked,
        ["chain_id"],
        ["seq"],
        number="_nth",
        previous={"_before": ("hash", first)},
        sized_by=sized_by,
    )
    found = F.array_compact(
        F.array(
            F.when(~F.col("previous_hash").eqNullSafe(F.col("_before")), F.lit(BROKEN_LINK)),
            F.when(~F.col("hash").eqNullSafe(F.col("_digest")), F.lit(BROKEN_HASH)),
        )
    )
    return linked.select(
        "chain_id",
        "seq",
        (F.col("_nth") - 1).alias("position"),
        F.explode(found).alias("issue"),
    )


def verify_hash_chain(ledger: DataFrame, torn: DataFrame | None = None) -> DataFrame:
    """Summary per chain: ok, records, torn and number of issues.

    ``torn`` has (chain_id) for every unreadable line.
    """
    records = ledger.groupBy("chain_id").agg(F.count("*").alias("records"))
    issues = chain_issues(ledger).groupBy("chain_id").agg(F.count("*").alias("issues"))
    out = records.join(issues, "chain_id", "left")
    if torn is not None:
        lines = torn.groupBy("chain_id").agg(F.count("*").alias("torn"))
        out = out.join(lines, "chain_id", "full")
    else:
        out = out.withColumn("torn", F.lit(0).cast("bigint"))
    filled = {c: F.coalesce(c, F.lit(0)) for c in ("records", "issues", "torn")}
    out = out.withColumns(filled)
    return out.select(
        "chain_id",
        ((F.col("issues") == 0) & (F.col("torn") == 0)).alias("ok"),
        "records",
        "torn",
        "issues",
    )


def _json_links(lines: DataFrame) -> DataFrame:
    """(chain_id, seq, torn, previous_hash, hash, _digest) per line that is not blank.

    The hashes are kept as canonical JSON, so a hash that is no string, or is missing, compares as what it is.
    """
    text = F.regexp_replace("line", r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    parsed = lines.select("chain_id", "seq", text.alias("_text")).filter(F.col("_text") != "")
    parsed = parsed.withColumn("_fields", fields_of(F.col("_text")))
    fields = F.col("_fields")
    digest = F.sha2(canonical_object(fields, without=["hash"]), 256)
    return parsed.select(
        "chain_id",
        "seq",
        fields.isNull().alias("torn"),
        F.coalesce(canonical_field(fields, "previous_hash"), F.lit("null")).alias("previous_hash"),
        F.coalesce(canonical_field(fields, "hash"), F.lit('""')).alias("hash"),
        F.concat(F.lit('"'), digest, F.lit('"')).alias("_digest"),
    )


def json_ledger_issues(lines: DataFrame) -> DataFrame:
    """Issues of ledgers kept as JSON lines (chain_id, seq, line), by whomever they were written.

    A record's hash covers its canonical JSON without the hash itself: sorted keys, no spaces, ASCII.  Blank
    lines do not count; torn ones, and lines that hold no object, are no records, so the next record must
    link to the last one that can be read.
    """
    return _json_issues(cut_lineage(_json_links(lines)))


def _json_issues(links: DataFrame) -> DataFrame:
    return _issues(links.filter(~F.col("torn")).drop("torn"), '""', links.select("chain_id"))


def verify_json_ledger(lines: DataFrame) -> DataFrame:
    """Summary per chain of JSON lines: ok, records, torn and number of issues."""
    links = cut_lineage(_json_links(lines))  # three steps go on from it: lines are read and parsed once
    counts = links.groupBy("chain_id").agg(
        F.count_if(~F.col("torn")).alias("records"), F.count_if("torn").alias("torn")
    )
    issues = _json_issues(links).groupBy("chain_id").agg(F.count("*").alias("issues"))
    out = join_keys(counts, issues, ["chain_id"], "left").withColumn("issues", F.coalesce("issues", F.lit(0)))
    ok = (F.col("issues") == 0) & (F.col("torn") == 0)
    return out.select("chain_id", ok.alias("ok"), "records", "torn", "issues")


def append_json_ledger(events: DataFrame, now: Column, tails: DataFrame | None = None) -> DataFrame:
    """Records of events (chain_id, seq, event), chained and written as JSON lines that any reader of such ledgers accepts.

    A record is the event's fields and ``timestamp`` (``now``, unless the event has its own), ``previous_hash`` and
    ``hash``; fields of the event under the two last names give way.  ``tails`` (chain_id, hash)
    seeds chains that have records already.  An event that is no JSON object gets no line, and the chain goes on
    past it.  Canonical JSON is worked out before the shuffle; the chain itself is sequential by nature, holds
    one hash, and is handed from slice to slice where it is too long for one task.
    """
    fields = F.col("_fields")
    own_time = canonical_field(fields, "timestamp")
    stamp = F.coalesce(own_time, json_string(stamp_text(now)))
    mark = "\x03"
    body = canonical_object(fields, ["hash"], {"previous_hash": F.lit(f'"{mark}"'), "timestamp": stamp})
    parts = F.split("_body", mark)
    seeded = events.select("chain_id", "seq", "event", fields_of(F.col("event")).alias("_fields"))
    seeded = seeded.select("chain_id", "seq", "event", body.alias("_body"))
    seeded = seeded.select("chain_id", "seq", "event", parts[0].alias("_head"), parts[1].alias("_tail"))
    if tails is None:
        seeded = seeded.withColumn("_seed", F.lit(""))
    else:
        seeds = tails.select("chain_id", F.col("hash").alias("_seed"))
        seeded = join_keys(seeded, seeds, ["chain_id"], "left").withColumn("_seed", F.coalesce("_seed", F.lit("")))

    def step(previous, row):
        if row[3] is None:
            return previous, (None, None)
        digest = hashlib.sha256(f"{row[3]}{previous}{row[4]}".encode()).hexdigest()
        return digest, (previous, digest)

    machine = Machine(start=lambda row: row[5], step=step, outputs=[("previous_hash", "string"), ("hash", "string")])
    chained = fold(seeded, ["chain_id"], ["seq"], machine, events.select("chain_id")).filter("hash is not null")
    fields = fields_of(F.col("event"))
    quoted = {n: F.concat(F.lit('"'), F.col(n), F.lit('"')) for n in ("previous_hash", "hash")}
    stamp = F.coalesce(canonical_field(fields, "timestamp", ascii_only=False, spaced=True), json_quoted(stamp_text(now)))
    line = canonical_object(fields, [], quoted | {"timestamp": stamp}, ascii_only=False, spaced=True)
    return chained.select("chain_id", "seq", "previous_hash", "hash", line.alias("line"))


def ledger_tails(lines: DataFrame) -> DataFrame:
    """(chain_id, hash) of the last readable record of each chain, to seed the next append."""
    links = _json_links(lines).filter(~F.col("torn"))
    last = F.max_by("hash", "seq")
    return links.groupBy("chain_id").agg(F.regexp_replace(last, '^"|"$', "").alias("hash"))


def memory_search(records: DataFrame, query: str, text: str = "json_text") -> DataFrame:
    """Records whose JSON text contains ``query``, ignoring case; none for ''."""
    if not query:
        return records.filter(F.lit(False))
    return records.filter(F.contains(F.lower(text), F.lower(F.lit(query))))


def memory_search_many(
    records: DataFrame, queries: DataFrame, key: str = "record_id", text: str = "json_text", query: str = "query"
) -> DataFrame:
    """(query, key) for every record whose text contains a query, ignoring case.

    The queries go to the records: a block of them is broadcast at a time, and each text is looked up run by run in the
    block's queries of that length.  Longer ones are found by one run of theirs and compared with the text.  No pair of
    query and record is sent before it is a result; more queries mean more blocks, each a pass over the records.
    Null and empty queries match nothing, null texts are never found, repeated queries are answered once and repeated
    records each; ``key`` need not be unique.
    """
    spark = records.sparkSession
    asked = queries.select(F.col(query).alias("query")).filter(F.length("query") > 0).distinct()
    asked = cut_lineage(asked.withColumn("_wanted", F.lower("query")))
    sizes = asked.agg(F.count("*").alias("n"), F.sum(F.length("query").cast("long")).alias("chars")).first()
    blocks = max(1, -(-sizes["n"] // BLOCK_QUERIES), -(-(sizes["chars"] or 0) // BLOCK_CHARS))
    # Dealt out, as few and short records can hold many queries each.
    texts = records.select(F.col(key).alias("_key"), F.lower(text).alias("_text")).filter("_text is not null")
    texts = texts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = [
        _search_block(texts, asked.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == n)) for n in range(blocks)
    ]
    return reduce(DataFrame.unionByName, found).withColumnRenamed("_key", key)


def _search_block(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """(query, _key) for every text (_key, _text) that holds one of the few queries (query, _wanted)."""
    rows = asked.select("query", "_wanted").toArrow()  # about BLOCK_QUERIES rows of BLOCK_CHARS in all
    shared = texts.sparkSession.sparkContext.broadcast(rows.combine_chunks())
    most, kind = RUN, texts.schema["_key"].dataType.simpleString()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, wanted = pa.array(shared.value["query"].to_pylist(), pa.string()), shared.value["_wanted"].to_pylist()
        exact, longer = {}, []  # exact: by length, the numbers of the queries that a run answers
        for number, what in enumerate(wanted):
            if len(what) <= most:
                exact.setdefault(len(what), {}).setdefault(what, []).append(number)
            else:
                starts = range(0, len(what) - most + 1, max(1, (len(what) - most) // 7))
                longer.append((number, {what[i : i + most] for i in starts}))
        shares = Counter(run for _, runs in longer for run in runs)
        led = {}  # by the run that the fewest others share
        for number, runs in longer:
            led.setdefault(min(runs, key=lambda run: (shares[run], run)), []).append(number)
        del shares, longer

        def runs_in(text: str, size: int, known: dict) -> set[str]:
            return {run for i in range(len(text) - size + 1) if (run := text[i : i + size]) in known}

        def rows(part: pa.RecordBatch, owners: list[int], hits: list[int]) -> pa.RecordBatch:
            keys = part["_key"].take(pa.array(owners, pa.int32()))
            return pa.RecordBatch.from_arrays([queries.take(pa.array(hits, pa.int32())), keys], ["query", "_key"])

        for batch in batches:
            for start in range(0, batch.num_rows, 256):  # bounded memory
                part = batch.slice(start, 256)
                owners, hits = [], []
                for place, text in enumerate(part["_text"].to_pylist()):
                    for size, known in exact.items():
                        for run in runs_in(text, size, known):
                            hits += known[run]
                    for run in runs_in(text, most, led):
                        hits += [number for number in led[run] if wanted[number] in text]
                    owners += [place] * (len(hits) - len(owners))
                    if len(hits) >= 1 << 16:
                        yield rows(part, owners, hits)
                        owners, hits = [], []
                yield rows(part, owners, hits)

    return texts.mapInArrow(search, f"query string, _key {kind}")
