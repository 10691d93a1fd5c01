"""Sliding bins over time as a stream: the batch operator's counts, kept up to date as files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream, in order of arrival."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def sliding_counts(events: DataFrame, ts: str = "ts", size: str = "150 minutes", slide: str = "10 minutes", late: str = "1 day", by: tuple[str, ...] = ()) -> DataFrame:
    """``(start, *by, n)`` for every window with events; works on streams and on tables.

    On a stream, windows end once the watermark has passed them; later events
    are dropped by Spark.
    """
    rows = events.withColumn(ts, F.col(ts).cast("timestamp"))
    rows = rows.withWatermark(ts, late) if events.isStreaming else rows
    counted = rows.groupBy(F.window(ts, size, slide).alias("w"), *by).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), *by, "n")


def run_to_files(counts: DataFrame, folder: str) -> DataFrame:
    """Process all available input; every batch writes its changed counts as Parquet below ``folder``, the result is each window's last count.

    A batch that is run again replaces its own files.
    """

    def save(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{folder}/counts/batch={batch}")

    query = counts.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    keys = [c for c in counts.columns if c != "n"]
    rows = counts.sparkSession.read.schema(counts.schema.add("batch", "long")).parquet(f"{folder}/counts")
    return rows.groupBy(*keys).agg(F.max_by("n", "batch").alias("n"))


def run_to_table(counts: DataFrame, name: str, checkpoint: str, mode: str = "complete"):
    """Process all available input into an in-memory table (for looking at small results); returns the finished query."""
    query = counts.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
