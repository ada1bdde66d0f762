"""Documents to training shards: the stages, in order, and one run over all of them.

Every stage reads the five columns of documents and drops any other.  Null texts and empty ones are
documents like others: copies of each other, free of leaks, of size zero for the mix.  A null source is a source of its
own, null ids match null ids, and an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from opsframe.llm import decontaminate, mixing, neardup, sharding, toxicity
from opsframe.llm.base import DOCUMENT, table
from opsframe.session import scratch_folder, ship_package


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject.

    It learns from the labels of these very documents, but for the held-out quarter.
    """
    ship_package(spark)
    docs = docs.select(*DOCUMENT)
    return toxicity.clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, that of least id; of rows that share id and text one stays."""
    ship_package(spark)
    return neardup.one_per_class(docs.select(*DOCUMENT))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, its values exchanged or not; equal texts go or stay together."""
    ship_package(spark)
    return decontaminate.without_leaks(docs.select(*DOCUMENT), table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it; a row taken twice comes twice."""
    return mixing.repeats(docs.select(*DOCUMENT))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's shard and place in it; equal rows get a place each."""
    rows, _ = sharding.shard_rows(docs)
    return rows


STAGES = [
    ("drop_toxic", drop_toxic),
    ("drop_near_duplicates", drop_near_duplicates),
    ("drop_benchmark_leaks", drop_benchmark_leaks),
    ("mix_sources", mix_sources),
    ("shard", shard),
]

#: Learned scores and seeded draws are not SQL's to repeat; tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table; each stage's rows are written and read again."""
    ship_package(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        folder = scratch_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)
