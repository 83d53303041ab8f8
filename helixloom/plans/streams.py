"""Queries over streams of the driver's tables, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixloom.plans.inputs import AS_BASES, LETTERS, READS, with_views
from helixloom.streaming.lengths import drained, hourly_activity, length_counts, sessions


def _stream(spark, sf_dir, name):
    """The table as a stream of its files; a table that is one file is picked from its folder by name."""
    path = f"{sf_dir}/{name}.parquet"
    rows = spark.read.parquet(path)
    stream = spark.readStream.schema(rows.schema)
    if any(f.endswith(f"/{name}.parquet") for f in rows.inputFiles()):
        return stream.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return stream.parquet(path)


def stream_length_counts(spark, sf_dir):
    letters = F.upper(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]", ""))
    counts = drained(length_counts(_stream(spark, sf_dir, "documents").select(F.translate(letters, LETTERS, AS_BASES).alias("seq"))))
    return counts.withColumn("length", F.col("length").cast("long"))


def stream_hourly_activity(spark, sf_dir):
    rows = drained(hourly_activity(_stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))))
    return rows.select(F.unix_timestamp("w.start").alias("hour"), "event_type", "events", (F.floor(F.col("value") * 100 + 0.5) / 100).alias("value"))


def stream_sessions(spark, sf_dir):
    rows = drained(sessions(_stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))))
    return rows.select("user_id", F.unix_micros("s.start").alias("begin"), "events", (F.floor(F.col("value") * 100 + 0.5) / 100).alias("value"))


QUERIES = {f.__name__: f for f in (stream_length_counts, stream_hourly_activity, stream_sessions)}
ORACLES = {
    "stream_length_counts": with_views("SELECT length(seq) AS length, count(*) AS reads, sum(length(seq))::BIGINT AS bases FROM v_reads GROUP BY 1", READS),
    "stream_hourly_activity": "SELECT epoch(date_trunc('hour', ts))::BIGINT AS hour, event_type, count(*) AS events, floor(sum(value) * 100 + 0.5) / 100 AS value FROM events GROUP BY 1, 2",
    "stream_sessions": """
        WITH g AS (SELECT *, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) > 1800000000, true)::INT AS begins FROM events),
        r AS (SELECT *, sum(begins) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM g)
        SELECT user_id, min(epoch_us(ts)) AS begin, count(*) AS events, floor(sum(value) * 100 + 0.5) / 100 AS value FROM r GROUP BY user_id, run""",
}
