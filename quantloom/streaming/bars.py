"""Streaming bars: an extension of the batch operators, with the same results over the same events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType


def stream_bars(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """(code, start, o, h, l, c, v) of tumbling windows over a stream of (code, ts, x); events later than `late` go."""
    return events.withWatermark("ts", late).groupBy("code", F.window("ts", width).alias("w")).agg(F.min_by("x", "ts").alias("o"), F.max("x").alias("h"), F.min("x").alias("l"), F.max_by("x", "ts").alias("c"), F.sum("x").alias("v")).select("code", F.col("w.start").alias("start"), "o", "h", "l", "c", "v")


def run_available(spark: SparkSession, source: str, pattern: str, folder: str) -> DataFrame:
    """Run the stream over the files that are there and return its bars; a new run goes on where the last one ended.

    Each batch's changed bars go to a table below `folder`, which all executors share; of a bar's states the last counts.
    The driver holds none of them, and the watermark drops the state of bars that are past.
    """
    schema = spark.read.parquet(f"{source}/{pattern}").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(source)
    ticks = raw.select(F.col("event_type").alias("code"), F.col("ts").cast("timestamp").alias("ts"), F.round(F.col("value") * 100).cast("long").alias("x"))
    bars = stream_bars(ticks)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/bars/batch={number}")  # a batch run again replaces its rows

    bars.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    states = spark.read.schema(StructType([*bars.schema.fields, StructField("batch", IntegerType())])).parquet(f"{folder}/bars")
    newest = Window.partitionBy("code", "start").orderBy(F.desc("batch"))
    return states.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n", "batch")
