"""Readers. Every one passes an explicit schema, so no job is spent on inference."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfcast.sources import schemas


def read_table(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    """Parquet, JSON lines or CSV with a header, always under ``schema``."""
    reader = spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True).option("enforceSchema", False)
    return reader.format(fmt).load(path)


def read_requests(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return read_table(spark, path, schemas.REQUESTS, fmt)


def stream_requests(spark: SparkSession, path: str, fmt: str = "parquet", files_per_trigger: int = 100) -> DataFrame:
    """The files of a trigger bound what any one key can bring to its task."""
    reader = spark.readStream.schema(schemas.REQUESTS).option("maxFilesPerTrigger", files_per_trigger)
    return reader.format(fmt).load(path)


def read_publisher_stats(spark: SparkSession, path: str) -> DataFrame:
    """Statistics CSV plus ``ordinal``, the position of the row in file order.

    The task-local row number only orders rows of one file split, so the split
    comes first in the ordinal. Compare ordinals; they are not consecutive.
    """
    rows = read_table(spark, path, schemas.PUBLISHER_STATS, "csv")
    return rows.select(
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        ).alias("ordinal"),
        *schemas.PUBLISHER_STATS.names,
    )


def read_cache(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return read_table(spark, path, schemas.CACHE, fmt)


def read_leaderboard(spark: SparkSession, path: str, platform: str | None = None, fmt: str = "parquet") -> DataFrame:
    """Three columns of the board, one platform if given; both reach the scan."""
    board = read_table(spark, path, schemas.LEADERBOARD, fmt)
    return board if platform is None else board.where(F.col("platform") == platform)


def read_appearances(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    return read_table(spark, path, schemas.APPEARANCES, fmt)


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Landed detail records, one JSON object a line."""
    return read_table(spark, path, schemas.CATALOGUE, "json")


def parse_catalogue(records: DataFrame, body: str | Column) -> DataFrame:
    """Detail records that arrived as JSON text in a column."""
    return records.select(F.from_json(body, schemas.CATALOGUE).alias("r")).select("r.*")


def platform_dimension(spark: SparkSession) -> DataFrame:
    """Four rows as a local relation, so that the planner knows how small it is."""
    columns = dict(zip(schemas.PLATFORMS.names, zip(*schemas.PLATFORM_ROWS)))
    return spark.createDataFrame(pa.table({name: list(values) for name, values in columns.items()}), schemas.PLATFORMS)
