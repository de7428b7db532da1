"""Windowed aggregations over event streams, and how a finite stream is run to its end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the Parquet files in a folder, or of one file; the schema is that of the files there now."""
    stream = spark.readStream.schema(spark.read.parquet(path).schema)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory():
        return stream.parquet(path)
    # a file source lists folders
    return stream.option("pathGlobFilter", place.getName()).parquet(path.rpartition("/")[0])


def tumbling(events: DataFrame, size: str, watermark: str, *keys: str) -> DataFrame:
    """``window_start, keys, n, total`` by event time; events later than the watermark are dropped in append mode."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    return stamped.groupBy(F.window("ts", size).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), *keys, "n", "total")


def sliding(events: DataFrame, size: str, step: str, watermark: str, *keys: str) -> DataFrame:
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    return stamped.groupBy(F.window("ts", size, step).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), *keys, "n", "total")


def sessions(events: DataFrame, gap: str, watermark: str, key: str) -> DataFrame:
    """``key, session_start, session_end, n``: events of a key no more than ``gap`` apart."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    return stamped.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def deduplicated(events: DataFrame, key: str, watermark: str) -> DataFrame:
    """The first event of each key within the watermark's delay."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark).dropDuplicatesWithinWatermark([key])


def run_to_end(stream: DataFrame, folder: str, mode: str = "complete") -> DataFrame:
    """Processes what the source holds now and returns the result table, which is written under ``folder``."""
    spark, path = stream.sparkSession, f"{folder}/stream-{uuid.uuid4().hex}"
    write = lambda batch, number: batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{path}/table")
    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/table")
