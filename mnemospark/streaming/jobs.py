"""Structured Streaming: ingest by micro-batch, deduplication, rate windows, debouncing.

State is bounded by watermarks; sinks are idempotent under replay of a batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def event_stream(spark: SparkSession, path: str, pattern: str = "events.parquet") -> DataFrame:
    """A file stream over a folder, or over the part files where the table is a folder itself; event times as instants, so watermarks accept them."""
    folder = f"{path}/{pattern}"
    schema = spark.read.parquet(folder).schema
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    found = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(target)
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 100)
    parts = found is not None and any(f.isDirectory() for f in found)
    stream = reader.parquet(folder) if parts else reader.option("pathGlobFilter", pattern).parquet(path)
    for f in schema:
        if f.dataType.typeName() == "timestamp_ntz":
            stream = stream.withColumn(f.name, F.col(f.name).cast("timestamp"))
    return stream


def deduplicate(stream: DataFrame, keys: list[str], ts: str, within: str) -> DataFrame:
    """The first row of each key within a delay; also serves as a debounce marker."""
    return stream.withWatermark(ts, within).dropDuplicatesWithinWatermark(keys)


def sliding_counts(stream: DataFrame, key: str, ts: str, length: str, slide: str, late: str) -> DataFrame:
    """Events of a key in sliding windows; late rows are accepted up to ``late``."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, length, slide).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def attempt_counters(stream: DataFrame, key: str, ts: str, ttl: str, late: str) -> DataFrame:
    """Attempts of a key in sessions that end ``ttl`` after the last."""
    return stream.withWatermark(ts, late).groupBy(F.session_window(ts, ttl).alias("w"), key).agg(F.count(F.lit(1)).alias("attempts")).select(F.col("w.start").alias("start"), key, "attempts")


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what is there, into Parquet, and stop."""
    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path)


def run_batches(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand each micro-batch to ``step``. The step must be idempotent for its batch number."""
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_batches(path: str, transform: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A step that overwrites its own batch folder, so a replayed batch leaves no second copy."""

    def step(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return step
