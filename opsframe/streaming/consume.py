"""Consumer groups and running gauges over an event stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsframe.operators.events import EXHAUSTED

DELIVERY = "id bigint, topic string, payload string, tries bigint, ok boolean, error string"


def apply_handler(messages: DataFrame, handler: Callable[[str], None]) -> DataFrame:
    """Call ``handler(payload)`` for every message; an exception is a failed delivery.

    Returns the messages with ``ok`` and ``error``; one bad message does not
    disturb the others.
    """

    def deliver(batches):
        for pdf in batches:
            verdicts = []
            for payload in pdf["payload"]:
                try:
                    handler(payload)
                    verdicts.append((True, ""))
                except Exception as problem:  # a poison message must not stop the rest
                    verdicts.append((False, str(problem)))
            pdf["ok"] = [v[0] for v in verdicts]
            pdf["error"] = [v[1] for v in verdicts]
            yield pdf

    return messages.select("id", "topic", "payload", "tries").mapInPandas(deliver, DELIVERY)


def read_if_any(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:  # nothing written there yet
        return spark.createDataFrame([], schema)


def deliver_batch(
    fresh: DataFrame, batch: int, folder: str, handler: Callable[[str], None], max_attempts: int
) -> None:
    """Deliver a batch; what fails is tried again, up to ``max_attempts`` times.

    Each round goes to all messages still open, so a poison message delays none of
    the others.  Everything is written to folders named by the batch and replaces
    what an interrupted run of the same batch left there: a restart may
    repeat deliveries (at least once) but never doubles their record.
    """
    spark = fresh.sparkSession
    due = fresh.select("id", "topic", "payload", F.lit(0).cast("bigint").alias("tries"))
    settled = None
    for attempt in range(1, max_attempts + 1):
        path = f"{folder}/rounds/batch={batch}/round={attempt}"
        tried = apply_handler(due, handler).withColumn("tries", F.col("tries") + 1)
        tried.write.mode("overwrite").parquet(path)
        tried = read_if_any(spark, path, DELIVERY)
        over = tried if attempt == max_attempts else tried.filter("ok")
        settled = over if settled is None else settled.unionByName(over)
        due = tried.filter("not ok")
        if due.isEmpty():
            break
    settled.write.mode("overwrite").parquet(f"{folder}/settled/batch={batch}")


def consume_stream(
    events: DataFrame,
    folder: str,
    handler: Callable[[str], None],
    max_attempts: int = 5,
):
    """At-least-once consumer of a stream of (id, topic, payload); a DataStreamWriter.

    Failed messages become dead letters after ``max_attempts`` tries.  The checkpoint
    is the group's offset: a restart continues with the first batch not finished.
    """

    def each(fresh: DataFrame, batch: int) -> None:
        deliver_batch(fresh, batch, folder, handler, max_attempts)

    return events.writeStream.foreachBatch(each).option(
        "checkpointLocation", f"{folder}/checkpoint"
    )


def settled(spark: SparkSession, folder: str) -> DataFrame:
    """Outcome per message: delivered (ok) or dead."""
    return read_if_any(spark, f"{folder}/settled", DELIVERY + ", batch bigint")


def dead_letters(spark: SparkSession, folder: str) -> DataFrame:
    return settled(spark, folder).filter("not ok").select(
        "id",
        "topic",
        F.when(F.col("error") == "", EXHAUSTED).otherwise(F.col("error")).alias("error"),
        F.col("tries").alias("attempts"),
    )


def lag_gauge(changes: DataFrame) -> DataFrame:
    """Pending messages per topic of a stream of (topic, change): +1 publish, -1 settle."""
    return changes.groupBy("topic").agg(F.sum("change").alias("pending"))


def run_to_files(stream: DataFrame, folder: str, schema: str | None = None) -> DataFrame:
    """Run an append stream over all available input and read back what it wrote."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    fields = schema or ", ".join(f"`{n}` {t}" for n, t in stream.dtypes)
    return stream.sparkSession.read.schema(fields).parquet(f"{folder}/out")


def run_to_table(stream: DataFrame, folder: str) -> DataFrame:
    """Run an updating aggregate over all available input; its final rows.

    Every batch replaces the whole small result in a folder of its own number.
    """
    spark = stream.sparkSession

    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/out/batch={batch}")

    query = (
        stream.writeStream.outputMode("complete")
        .foreachBatch(keep)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    fields = ", ".join(f"`{n}` {t}" for n, t in stream.dtypes)
    every = spark.read.schema(f"{fields}, batch bigint").parquet(f"{folder}/out")
    newest = every.agg(F.max("batch")).scalar()
    return every.filter(F.col("batch") == newest).drop("batch")


