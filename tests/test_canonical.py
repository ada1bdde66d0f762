import hashlib
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from opsframe.functions.canonical import canonical_field, canonical_json, fields_of, is_json


def value(rng, depth=0):
    kind = rng.randrange(9 if depth < 4 else 7)
    if kind == 0:
        return rng.choice([None, True, False])
    if kind == 1:
        return rng.choice([0, -1, 10**20, -(10**40), rng.randrange(-(2**63), 2**63)])
    if kind == 2:
        return rng.choice([0.0, -0.0, 1.0, 1e16, 1e-5, 123456789012345680.0, 1e300, 5e-324, round(rng.uniform(-1e4, 1e4), rng.randrange(6))])
    if kind == 3:
        return rng.choice([math.nan, math.inf, -math.inf, 1.5])
    if kind in (4, 5, 6):
        return "".join(rng.choice(['a', ' ', '"', "\\", "/", "\n", "\t", "\x00", "\x1f", "\x7f", "é", "日", "🙂", ",", ":", "{", "n1", "-", "\u2028"]) for _ in range(rng.randrange(9)))
    if kind == 7:
        return [value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {value_key(rng): value(rng, depth + 1) for _ in range(rng.randrange(5))}


def value_key(rng):
    return rng.choice(["a", "b", "B", "hash", "previous_hash", "a b", "é", "z\n", '"', "\\", "", "日", "n3", "10", "9"]) + rng.choice(["", "x", "é"])


def foreign(rng, record):
    """The record's JSON in another spelling."""
    text = json.dumps(record, ensure_ascii=rng.random() < 0.5, separators=rng.choice([(",", ":"), (", ", ": "), (" ,\t", "  : ")]))
    return rng.choice(["", "  "]) + text + rng.choice(["", " "])


def test_canonical_text_equals_json_dumps(spark):
    rng = random.Random(6)
    records = [{value_key(rng): value(rng) for _ in range(rng.randrange(6))} for _ in range(600)]
    rows = [(i, foreign(rng, r)) for i, r in enumerate(records)]
    rows += [(len(rows), '{"a": 1.50, "b": 1E5, "c": 0.1e-7, "d": -0, "e": -0.0, "f": 12345678901234567890123456789012345678901234567890, "g": 1e999, "\\u00e9\\/": "\\u0041"}')]
    records.append(json.loads(rows[-1][1]))
    frame = spark.createDataFrame(rows, "id int, line string")
    got = {
        r["id"]: r
        for r in frame.select(
            "id",
            canonical_json(F.col("line")).alias("compact"),
            canonical_json(F.col("line"), ascii_only=False, spaced=True).alias("spaced"),
            canonical_json(F.col("line"), without=["hash", "a"]).alias("less"),
            canonical_field(fields_of(F.col("line")), "b").alias("b"),
        ).collect()
    }
    for i, r in enumerate(records):
        assert got[i]["compact"] == json.dumps(r, sort_keys=True, separators=(",", ":"))
        assert got[i]["spaced"] == json.dumps(r, sort_keys=True, ensure_ascii=False)
        assert got[i]["less"] == json.dumps({k: v for k, v in r.items() if k not in ("hash", "a")}, sort_keys=True, separators=(",", ":"))
        assert got[i]["b"] == (json.dumps(r["b"], sort_keys=True, separators=(",", ":")) if "b" in r else None)


@pytest.mark.parametrize("line, ok", [
    ("", False), (None, False), ("{", False), ('{"a": 01}', False), ("{1: 2}", False), ('{"a": 1,}', False), ('{"a": "x', False),
    ("[1, 2]", True), ("3", True), ("NaN", True), ('{"a": [NaN, -Infinity]}', True), ('{"NaN": "Infinity"}', True), ('{"a": NaNa}', False),
    ('{"a": 1.}', False), ('{"a": "\x01"}', False), ("{}", True),
])
def test_lines_that_are_no_json(spark, line, ok):
    row = spark.createDataFrame([(line,)], "line string").select(
        F.coalesce(is_json(F.col("line")), F.lit(False)).alias("ok"), canonical_json(F.col("line")).alias("text")
    ).first()
    assert row["ok"] == ok
    assert (row["text"] is not None) == (ok and line.lstrip().startswith("{"))


def test_long_strings_and_many_escapes(spark):
    record = {"b": "x" * 3_000_000, "a": '\\"\n' * 200_000, "c": list(range(5000))}
    frame = spark.createDataFrame([(json.dumps(record),)], "line string")
    digest = frame.select(F.sha2(canonical_json(F.col("line")), 256)).first()[0]
    assert digest == hashlib.sha256(json.dumps(record, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
