"""Queries over ledgers kept as JSON lines, and searches of the memory log."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsframe import fixtures as fx
from opsframe.functions.canonical import canonical_json
from opsframe.functions.keys import json_quoted
from opsframe.operators import ledger as lg
from opsframe.sources import jsonl as js

_NOW = "2024-05-06 07:08:09.000012"
_SMALL = "abcdefghijklmnopqrstuvwxyz"


def _events(spark, d):
    """Turns of a conversation as an event each: keys in no order, a double in another spelling, nested values."""
    turn = F.col("turn").cast("string")
    event = F.concat(
        F.lit('{"turn": '), turn, F.lit(', "text" : '), json_quoted(F.col("text")), F.lit(', "role":"'), F.col("role"),
        F.lit('", "score": '), turn, F.lit('.50,"meta": {"z": ['), turn, F.lit(', 1e2, null, true], "a":"é\\/"}}'),
    )
    return fx.table(spark, d, "conversations").select(F.col("conv_id").alias("chain_id"), F.col("turn").alias("seq"), event.alias("event"))


def canonical(spark, d):
    return _events(spark, d).select("chain_id", "seq", canonical_json(F.col("event")).alias("canonical"))


def append_json_ledger(spark, d):
    return lg.append_json_ledger(_events(spark, d), F.lit(_NOW).cast("timestamp"))


def _damaged(spark, d):
    """Some lines are spaced otherwise, some rewritten, some lost and some torn."""
    line = F.col("line")
    chain, seq = F.col("chain_id"), F.col("seq")
    changed = (
        F.when((chain % 11 == 0) & (seq == 0), F.substring(line, F.lit(1), F.length(line) - 1))
        .when((chain % 7 == 0) & (seq == 1), F.replace(line, F.lit('"turn": 1'), F.lit('"turn": 11')))
        .when(chain % 3 == 0, F.replace(line, F.lit('"turn": '), F.lit('"turn"  :\t')))
        .otherwise(line)
    )
    return append_json_ledger(spark, d).select("chain_id", "seq", changed.alias("line")).filter("not (chain_id % 5 = 0 and seq = 2)")


def json_ledger_issues(spark, d):
    return lg.json_ledger_issues(_damaged(spark, d))


def verify_json_ledger(spark, d):
    return lg.verify_json_ledger(_damaged(spark, d))


def memory_search_many(spark, d):
    """Pieces of the texts, of one to ten characters and in capitals now and then, looked for in the whole log."""
    turns = fx.table(spark, d, "conversations")
    records = turns.selectExpr("role as kind", "text as content", "map('conv', cast(conv_id as string)) as provenance", "conv_id * 1000 + turn as record_id")
    lines = js.record_lines(records, F.lit(_NOW).cast("timestamp"), "record_id").withColumnRenamed("value", "json_text")
    piece = F.substring("text", F.lit(3), (1 + F.col("conv_id") % 10).cast("int"))
    queries = turns.filter("turn < 2").select(F.when(F.col("turn") == 1, F.translate(piece, _SMALL, _SMALL.upper())).otherwise(piece).alias("query"))
    return lg.memory_search_many(lines, queries)


QUERIES = {
    "canonical_json": canonical,
    "append_json_ledger": append_json_ledger,
    "json_ledger_issues": json_ledger_issues,
    "verify_json_ledger": verify_json_ledger,
    "memory_search_many": memory_search_many,
}

_ASCII = r"""array_to_string(list_transform(string_split(CAST(to_json(text) AS VARCHAR), ''), lambda c: CASE WHEN unicode(c) < 127 THEN c
 WHEN unicode(c) < 65536 THEN printf('\u%04x', unicode(c))
 ELSE printf('\u%04x\u%04x', 55296 + (unicode(c) - 65536) // 1024, 56320 + (unicode(c) - 65536) % 1024) END), '')"""
_HEAD = r"""'{"meta":{"a":"\u00e9/","z":[' || turn || ',100.0,null,true]},'"""
_TAIL = f"""',"role":"' || role || '","score":' || turn || '.5,"text":' || {_ASCII}"""
_CHAINED = f"""num AS MATERIALIZED (SELECT conv_id AS chain_id, turn AS seq, turn, role, text, {_HEAD} || '"previous_hash":"' AS head,
 '"' || {_TAIL} || ',"timestamp":"2024-05-06T07:08:09.000012+00:00","turn":' || turn || '}}' AS tail, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
chain AS (SELECT chain_id, seq, n, '' AS previous_hash, sha256(head || tail) AS hash FROM num WHERE n = 1
 UNION ALL SELECT m.chain_id, m.seq, m.n, c.hash, sha256(m.head || c.hash || m.tail) FROM chain c JOIN num m ON m.chain_id = c.chain_id AND m.n = c.n + 1)"""
_LEFT = f"""{_CHAINED},
kept AS (SELECT c.*, m.head, m.tail, c.chain_id % 11 = 0 AND c.seq = 0 AS torn, c.chain_id % 7 = 0 AND c.seq = 1 AS rewritten
 FROM chain c JOIN num m ON m.chain_id = c.chain_id AND m.n = c.n WHERE NOT (c.chain_id % 5 = 0 AND c.seq = 2)),
seen AS (SELECT *, coalesce(lag(hash) OVER w, '') AS prior, row_number() OVER w - 1 AS position FROM kept WHERE NOT torn WINDOW w AS (PARTITION BY chain_id ORDER BY seq)),
issues AS (SELECT chain_id, seq, position, 'previous_hash mismatch' AS issue FROM seen WHERE previous_hash <> prior
 UNION ALL SELECT chain_id, seq, position, 'hash mismatch (tampered or rewritten)' FROM seen
 WHERE hash <> sha256(head || previous_hash || CASE WHEN rewritten THEN replace(tail, '"turn":1}}', '"turn":11}}') ELSE tail END))"""
_LINE = """'{"content": ' || to_json(text) || ', "kind": "' || role || '", "provenance": {"conv": "' || conv_id || '"}, "timestamp": "2024-05-06T07:08:09.000012+00:00"}'"""

ORACLES = {
    "canonical_json": f"""SELECT conv_id AS chain_id, turn AS seq, {_HEAD} || substring({_TAIL}, 2) || ',"turn":' || turn || '}}' AS canonical FROM conversations""",
    "append_json_ledger": f"""WITH RECURSIVE {_CHAINED} SELECT c.chain_id, c.seq, c.previous_hash, c.hash,
 '{{"hash": "' || c.hash || '", "meta": {{"a": "é/", "z": [' || turn || ', 100.0, null, true]}}, "previous_hash": "' || c.previous_hash || '", "role": "' || role
 || '", "score": ' || turn || '.5, "text": ' || to_json(text) || ', "timestamp": "2024-05-06T07:08:09.000012+00:00", "turn": ' || turn || '}}' AS line
 FROM chain c JOIN num m ON m.chain_id = c.chain_id AND m.n = c.n""",
    "json_ledger_issues": f"WITH RECURSIVE {_LEFT} SELECT * FROM issues",
    "verify_json_ledger": f"""WITH RECURSIVE {_LEFT} SELECT k.chain_id, coalesce(i.n, 0) = 0 AND k.torn = 0 AS ok, k.records, k.torn, coalesce(i.n, 0) AS issues
 FROM (SELECT chain_id, count(*) FILTER (NOT torn) AS records, count(*) FILTER (torn) AS torn FROM kept GROUP BY 1) k
 LEFT JOIN (SELECT chain_id, count(*) AS n FROM issues GROUP BY 1) i ON i.chain_id = k.chain_id""",
    "memory_search_many": f"""WITH q AS (SELECT DISTINCT CASE WHEN turn = 1 THEN translate(p, '{_SMALL}', '{_SMALL.upper()}') ELSE p END AS query
 FROM (SELECT turn, substring(text, 3, 1 + conv_id % 10) AS p FROM conversations WHERE turn < 2)),
r AS (SELECT conv_id * 1000 + turn AS record_id, lower({_LINE}) AS body FROM conversations)
SELECT query, record_id FROM q JOIN r ON contains(body, lower(query)) WHERE query <> ''""",
}
