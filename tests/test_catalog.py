"""Every registered query matches its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from check import rows_of
from opsframe.schemas import TABLES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    if name not in ORACLES:
        assert got
        return
    result = duck.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, got) == rows_of(columns, result.fetchall())


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


# Queries whose keys are cut into slices once a task holds so few rows.
SLICED = {
    "assign_sequence": 30,
    "admit_events": 30,
    "admit_events_settled": 50,
    "rate_limit": 6,
    "breaker_states": 50,
    "breaker_trips": 50,
    "illegal_transitions": 12,
    "verify_hash_chain": 3,
    "release_candidates": 5,
    "cron_fires_guarded": 30,
    "autoscale_decisions": 8,
    "read_jsonl_tolerant": 100,
}


@pytest.mark.parametrize("name", SLICED)
def test_query_with_hot_keys(spark, duck, name):
    spark.conf.set("opsframe.rowsPerTask", str(SLICED[name]))
    try:
        df = entry.queries()[name](spark, SF)
        got = [tuple(r) for r in df.collect()]
    finally:
        spark.conf.unset("opsframe.rowsPerTask")
    result = duck.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    assert rows_of(df.columns, got) == rows_of(columns, result.fetchall())
