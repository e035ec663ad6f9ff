"""Windowed sums over streams, with a watermark for late rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values
from ..sources.read import shared_folder


def aggregate(stream: DataFrame, ts: str, key: str, value: str, size: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """(start, key, n, value) of tumbling or sliding windows of a stream or a table."""
    at = F.window(ts, size, slide) if slide else F.window(ts, size)
    found = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(at.alias("w"), F.col(key).alias("key")).agg(F.count("*").alias("n"), F.sum(value).alias("value"))
    return found.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "key", "n", values.tidy(F.col("value")).alias("value"))


def sessions(stream: DataFrame, ts: str, key: str, gap: str, late: str = "1 hour") -> DataFrame:
    """(start, end, key, n) of sessions that a gap ends."""
    found = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), F.col(key).alias("key")).agg(F.count("*").alias("n"))
    return found.select(F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"), "key", "n")


def until_read(spark: SparkSession, path: str, query, keys: tuple[str, ...], mode: str = "update") -> DataFrame:
    """The last state by keys of query(stream), the stream being a Parquet table that is read until its end.

    Update mode writes what a batch changed; complete mode, which sessions need, all groups with each batch.
    """
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    found = query(spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/{name}*"))
    out = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/{number}")

    q = found.writeStream.outputMode(mode).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).foreachBatch(keep).start()
    q.awaitTermination()
    states = spark.read.option("recursiveFileLookup", "true").parquet(out)
    if mode == "complete":
        last = states.agg(F.max("_batch").alias("_last"))
        return states.join(F.broadcast(last), F.col("_batch") == F.col("_last")).drop("_batch", "_last")  # one row
    return states.groupBy(*keys).agg(*(F.max_by(c, "_batch").alias(c) for c in found.columns if c not in keys))


def windowed(spark: SparkSession, path: str, ts: str, key: str, value: str, size: str, slide: str | None = None) -> DataFrame:
    """The tumbling or sliding windows of a Parquet table read as a stream."""
    return until_read(spark, path, lambda stream: aggregate(stream, ts, key, value, size, slide, late="3650 days"), ("start", "key"))


def in_sessions(spark: SparkSession, path: str, ts: str, key: str, gap: str) -> DataFrame:
    """The sessions of a Parquet table read as a stream."""
    return until_read(spark, path, lambda stream: sessions(stream, ts, key, gap, late="3650 days"), ("start", "end", "key"), "complete")
