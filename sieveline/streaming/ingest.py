"""Streaming forms of incremental ingest and retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sieveline.operators.similarity import attach


def ingest_batch(batch: DataFrame, manifest_path: str, distance: int) -> None:
    """Append a batch's new images to the manifest with their groups. A batch
    that is run again after a failure finds its rows as exact copies, so it
    adds nothing twice."""
    spark = batch.sparkSession
    known = spark.read.parquet(manifest_path).select("sha256", "hash", "leakage_group")
    groups = attach(batch, known, distance)
    first = batch.groupBy("sha256").agg(F.min_by("hash", "ord").alias("hash"))
    groups.join(first, "sha256").select("sha256", "hash", "leakage_group").write.mode("append").parquet(manifest_path)


def start_ingest(stream: DataFrame, manifest_path: str, checkpoint: str, distance: int = 6) -> StreamingQuery:
    """stream: (sha256, hash, ord). Runs what is there, batch by batch."""
    run = lambda batch, _: ingest_batch(batch, manifest_path, distance)
    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live_counts(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Counts by kind and window of a stream of events (ts, event_type)."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")


def unexpired(files: DataFrame, hours: int) -> DataFrame:
    """Uploads of a stream once each, forgotten after so many hours."""
    return files.withWatermark("mtime", f"{hours} hours").dropDuplicatesWithinWatermark(["name"])


def replay(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
