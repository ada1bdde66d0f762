"""The partitioned event log on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_event_log(events: DataFrame, path: str, mode: str = "append") -> None:
    """Write by topic and partition, files sorted by sequence number.

    Rows are ranged over (topic, partition, seq), so a topic with a large share of
    the log is written by many tasks, each with a contiguous run of numbers.
    """
    keys = ["topic", "partition", "seq"]
    ranged = events.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranged.write.mode(mode).partitionBy("topic", "partition").parquet(path)


def read_event_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def partition_events(log: DataFrame, topic: str, partition: int) -> DataFrame:
    """One partition in sequence order; only its folder is read."""
    mine = (F.col("topic") == topic) & (F.col("partition") == partition)
    return log.filter(mine).orderBy("seq")
