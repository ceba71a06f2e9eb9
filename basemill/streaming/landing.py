"""Additive distributions of reads that arrive in a folder of Parquet files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "record_number long, read string, header string, sequence string, separator string, quality string"


def landing_reads(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).parquet(folder)


def running_metric(reads: DataFrame, metric: Callable[[DataFrame], DataFrame], name: str, checkpoint: str):
    """Keeps a metric with a single aggregation (lengths, histogram of qualities, duplication counts) up to date in a
    memory table; its state is one row a group."""
    return metric(reads).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
