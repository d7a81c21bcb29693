"""Run logs as a stream: the counts of the batch query, kept up to date (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stage_counts(runs: DataFrame) -> DataFrame:
    """(stage, latency) -> runs and slow ones by stage; the same on a stream and on a table."""
    return runs.groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("latency") > 30).alias("slow"))


def windowed(runs: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(ts, stage, latency) -> runs by stage and window of event time."""
    return runs.withWatermark("ts", late).groupBy(F.window("ts", width), "stage").agg(F.count(F.lit(1)).alias("n"))


def watch(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).json(folder)
