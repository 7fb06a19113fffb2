"""Incremental ingest: new ``.ms`` drops and new rows as streams. Every per-spectrum operator is stateless and
runs unchanged in micro-batches; only deduplication keeps state, bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from peakloom.functions import scalar
from peakloom.sources import ms


def stream_records(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """(spec, content) of ``.ms`` files as they appear under path."""
    schema = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.ms").option("maxFilesPerTrigger", files_per_trigger).load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)\.ms$", 1).alias("spec"), F.decode("content", "UTF-8").alias("content"))


def stream_blocks(spark: SparkSession, path: str) -> DataFrame:
    parsed = ms.parse_records(stream_records(spark, path))
    return parsed.withColumn("spectrum_uid", F.when(F.col("error").isNull(), scalar.spectrum_uid("spec", "block"))).withColumn("shard", scalar.shard_of("spec"))


def write_blocks(blocks: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append to a sharded dataset with everything that is there now, exactly once per file."""
    return blocks.writeStream.format("parquet").partitionBy("shard").option("path", out).option("checkpointLocation",
        checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, by: str, value: str, width: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """(start, by, n, total) per tumbling window; rows later than the watermark are dropped. Works on tables and streams."""
    marked = events.withWatermark(time, late) if events.isStreaming else events
    return marked.groupBy(F.window(time, width).alias("w"), by).agg(F.count("*").alias("n"),
        F.sum(value).alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")


def first_arrivals(events: DataFrame, keys: list[str], time: str, late: str = "1 day") -> DataFrame:
    """Rows without repeats of their keys within the watermark."""
    if not events.isStreaming:
        return events.dropDuplicates(keys)
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
