"""Extension beyond parity: incremental statistics over streams of new reports or log events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from causeway.operators.storage import remove
from causeway.sources.records import overwrite


def event_trend(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts per window and type of a stream with ``ts`` and ``event_type``; later rows than the watermark allows are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def keep_counts(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep (entity, outcome, n) under ``path``/<batch>, one version per batch; an event contributes once, so counts only add up.

    A batch that is retried writes the same version again, from the version before it; versions before that one are removed.
    """
    spark = stream.sparkSession

    def add(batch: DataFrame, number: int) -> None:
        fresh = batch.groupBy("entity", "outcome").agg(F.count("*").alias("n"))
        if number:
            fresh = latest_counts(spark, path, number).unionByName(fresh).groupBy("entity", "outcome").agg(F.sum("n").alias("n"))
        overwrite(fresh, f"{path}/{number}", yes=True)
        if number > 1:  # the one before is what a retry of this batch starts from
            remove(spark, f"{path}/{number - 2}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_counts(spark: SparkSession, path: str, before: int) -> DataFrame:
    """The counts of the batch before ``before``."""
    return spark.read.parquet(f"{path}/{before - 1}")
