"""What several operators need: stored intermediate tables and safe row handling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.session import new_path


def stored(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """``df`` written to a new path of the shared folder and read back.

    This cuts the lineage: a lost executor costs the tasks that ran on it, not the work before
    this table, and generated values such as row numbers can no longer change.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, so that an operator's own columns never clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
