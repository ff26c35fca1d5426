"""Sinks. A snapshot is always written to a path of its own, never over its input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_snapshot(df: DataFrame, path: str, partition_by: list[str] | None = None, fmt: str = "parquet") -> str:
    writer = df.write.mode("errorifexists").format(fmt)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
    return path


def write_cache_by_day(cache: DataFrame, path: str) -> str:
    """Cache rows laid out by day, so that retention reads only the days it must."""
    return write_snapshot(cache.withColumn("created_on", F.to_date("created_at")), path, ["created_on"])


def write_json(df: DataFrame, path: str) -> str:
    """One JSON object a line."""
    return write_snapshot(df, path, fmt="json")
