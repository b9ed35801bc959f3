"""Streaming twins: running statistics of a cell whose counts arrive as events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_events(spark: SparkSession, path: str, schema: str = "event_id long, ts timestamp, user_id long, event_type string, value double, props string") -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def windowed_totals(events: DataFrame, size: str = "1 day", late: str = "2 days", slide: str | None = None) -> DataFrame:
    """Total, events and distinct kinds of each user in tumbling (or sliding) windows; later events than the watermark are dropped. The same on a table and on a stream."""
    source = events.withWatermark("ts", late) if events.isStreaming else events
    grouped = source.groupBy(F.window("ts", size, slide or size).alias("w"), "user_id")
    return grouped.agg(F.sum("value").alias("total"), F.count("*").alias("n"), F.approx_count_distinct("event_type").alias("kinds")).select(F.col("w.start").alias("start"), "user_id", "total", "n", "kinds")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 days") -> DataFrame:
    """Sessions of each user: events closer together than the gap."""
    source = events.withWatermark("ts", late) if events.isStreaming else events
    return source.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "user_id", "n", "total")


def once(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Events without repeats of an id."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])


def run_to_table(stream: DataFrame, path: str, checkpoint: str, keys: list[str] | None = None) -> DataFrame:
    """Run a stream over all that is there into a table below ``path``, and return it.

    Without ``keys`` rows are appended when they are final: windows and sessions once the watermark
    has passed them, and their state is dropped. With ``keys`` every batch writes the rows that it
    changed, into a folder of its number, so that a batch that is run again replaces itself; the
    table has each key's latest row. Nothing is gathered on the driver.
    """
    if keys is None:
        writer = stream.writeStream.format("parquet").option("path", path).outputMode("append")
    else:
        writer = stream.writeStream.outputMode("update").foreachBatch(lambda rows, number: rows.write.mode("overwrite").parquet(f"{path}/batch={number}"))
    running = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    running.awaitTermination()
    spark = stream.sparkSession
    if keys is None:
        return spark.read.schema(stream.schema).parquet(path)
    rows = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(path)
    values = [c for c in stream.columns if c not in keys]
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("row"))
    return latest.select(*keys, *[F.col("row")[c].alias(c) for c in values]).select(*stream.columns)
