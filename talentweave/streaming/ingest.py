"""Incremental ingest with Structured Streaming; an addition to the batch operators, with the same results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.releases import upsert


def event_stream(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and their mean value by type and window; rows later than the watermark are dropped by definition."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select("w.start", "w.end", "event_type", "n", "mean")


def ingest_latest(stream: DataFrame, target: str, keys: list[str], order: str, checkpoint: str) -> StreamingQuery:
    """Keeps the newest row of each key in versioned directories under `target`; what is there is read once and then stops.

    Each batch writes a new version beside the last and then names it, so a batch that is run again gives the same.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rest = [c for c in batch.columns if c not in keys]
        new = batch.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("x")).select(*keys, "x.*").select(batch.columns)
        if number:
            before = spark.read.schema(batch.schema).parquet(f"{target}/version={number - 1}")
            newest = before.unionByName(new).groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("x")).select(*keys, "x.*").select(batch.columns)
            new = upsert(before, newest, keys)
        new.write.mode("overwrite").parquet(f"{target}/version={number}")

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
