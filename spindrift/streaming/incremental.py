"""Files as a stream: each micro-batch is scanned and its findings replace those of the same files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_stream(spark: SparkSession, path: str, schema: str = "file_id long, path string, code string") -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def upsert(batch: DataFrame, target: str, batch_id: int) -> None:
    """Findings of a batch as a directory of its own; a batch that comes again overwrites itself, so nothing counts twice."""
    batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")


def scan_stream(files: DataFrame, scan: Callable[[DataFrame], DataFrame], target: str, checkpoint: str):
    """A running query that scans what arrives. latest() reads what it has found."""

    def each(batch: DataFrame, batch_id: int) -> None:
        last = batch.groupBy("file_id").agg(F.max_by(F.struct("path", "code"), "path").alias("f")).select("file_id", "f.*")
        found = last.select("file_id").join(scan(last), "file_id", "left")  # a file without findings leaves a row, which hides older ones
        upsert(found, target, batch_id)

    return files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, target: str) -> DataFrame:
    """Findings of each file's last batch."""
    every = spark.read.parquet(target)
    last = every.groupBy("file_id").agg(F.max("batch").alias("batch"))
    return every.join(last, ["file_id", "batch"]).where("vuln_type IS NOT NULL").drop("batch")


def finding_rate(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by type in tumbling windows of event time, with a watermark when events is a stream."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
