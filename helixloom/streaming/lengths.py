"""Streaming counts of read lengths and activity, and what a stream gives as a table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixloom.session import fresh_path


def length_counts(stream: DataFrame) -> DataFrame:
    """length, reads, bases of a stream of reads; the state is one row a length."""
    return stream.groupBy(F.length("seq").alias("length")).agg(F.count(F.lit(1)).alias("reads"), F.sum(F.length("seq")).alias("bases"))


def hourly_activity(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Events and value by hour and type; rows later than ``late`` are let go."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("value"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Events and value of each user's sessions: runs of events less than ``gap`` apart."""
    window = F.session_window("ts", gap).alias("s")
    return events.withWatermark("ts", late).groupBy(window, "user_id").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("value"))


def drained(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """What a stream has to give now: it runs until its input is used up, with its state and results in the shared folder.

    Each batch is a folder named by its number, which a batch that runs again overwrites, so every batch is written once.
    In complete mode the last batch is the result, else all of them are.
    """
    spark, name = stream.sparkSession, f"drained-{uuid.uuid4().hex}"
    path, done = fresh_path(spark, name), []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{number:09d}")
        done.append(number)

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    if not done:
        return spark.createDataFrame([], stream.schema)
    wanted = [max(done)] if mode == "complete" else sorted(set(done))
    return spark.read.schema(stream.schema).parquet(*[f"{path}/{n:09d}" for n in wanted])
