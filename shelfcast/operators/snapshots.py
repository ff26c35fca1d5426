"""Keyed state kept as snapshots: upsert, lookup and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.session import new_path

RETENTION = "INTERVAL 24 HOURS"
# folders of a bucketed snapshot: about its size over 1 GB
BUCKETS = 64
ROW = "key string, data string, created_at timestamp"


def latest_per_key(rows: DataFrame) -> DataFrame:
    """The newest row of each key; equal times are settled by the data."""
    newest = F.max(F.struct("created_at", "data"))
    return rows.groupBy("key").agg(newest.alias("newest")).select("key", "newest.data", "newest.created_at")


def upsert(snapshot: DataFrame, batch: DataFrame) -> DataFrame:
    """Rows of the batch replace those of the snapshot; within the batch the newest stays."""
    both = snapshot.withColumn("in_batch", F.lit(0)).unionByName(batch.withColumn("in_batch", F.lit(1)))
    newest = F.max(F.struct("in_batch", "created_at", "data"))
    return both.groupBy("key").agg(newest.alias("newest")).select("key", "newest.data", "newest.created_at")


class BucketedSnapshot:
    """Keyed state in folders by a hash of the key; a batch rewrites the folders of its keys and no others.

    The new content of the touched buckets is written aside first and only then put in their place, so a batch that
    stopped half-way can be run again: it finds the old or the new rows of each bucket, and both lead to the same.
    """

    def __init__(self, path: str, buckets: int = BUCKETS):
        self.path = path
        self.buckets = buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int").alias("bucket")

    def start(self, spark: SparkSession) -> None:
        """An empty snapshot, unless there is one."""
        spark.createDataFrame([], ROW).write.mode("append").parquet(f"{self.path}/bucket=-1")

    def _read(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(f"{ROW}, bucket int").parquet(self.path)

    def read(self, spark: SparkSession) -> DataFrame:
        return self._read(spark).drop("bucket")

    def upsert(self, batch: DataFrame) -> None:
        """Rows of the batch replace those of the snapshot; within the batch the newest stays."""
        spark = batch.sparkSession
        aside = new_path(spark, "upsert")
        newest = latest_per_key(batch).withColumn("bucket", self.bucket())
        newest.write.parquet(f"{aside}/batch")
        newest = spark.read.schema(f"{ROW}, bucket int").parquet(f"{aside}/batch")
        # as many numbers as there are buckets at most
        touched = [r["bucket"] for r in newest.select("bucket").distinct().collect()]
        if not touched:
            return
        of_touched = self._read(spark).where(F.col("bucket").isin(touched)).drop("bucket")
        merged = upsert(of_touched, newest.drop("bucket")).withColumn("bucket", self.bucket())
        merged.write.parquet(f"{aside}/merged")
        ready = spark.read.schema(f"{ROW}, bucket int").parquet(f"{aside}/merged")
        # one file a bucket
        ready.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)


def write_for_lookup(snapshot: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The snapshot as a table bucketed and sorted by key.

    What is looked up in it is shuffled to its buckets; the snapshot itself, the larger side, stays where it lies, in this
    and in every later batch. The table is of the session's catalogue, its files are in the shared folder.
    """
    spark = snapshot.sparkSession
    path = new_path(spark, "lookup")
    name = path.rsplit("/", 1)[1].replace("-", "_")
    snapshot.repartition(buckets, "key").write.bucketBy(buckets, "key").sortBy("key").option("path", path).saveAsTable(name)
    return spark.table(name)


def single_rows(snapshot: DataFrame) -> DataFrame:
    """Keys that occur exactly once; a doubled key reads as absent."""
    return (
        snapshot.groupBy("key")
        .agg(F.count("*").alias("n"), F.max(F.struct("created_at", "data")).alias("row"))
        .where("n = 1")
        .select("key", "row.data", "row.created_at")
    )


def lookup(rows: DataFrame, key: str, snapshot: DataFrame, now: Column, period_us: int) -> DataFrame:
    """Adds ``data``, ``created_at`` and ``fresh``: a row for the key, younger than the period.

    The snapshot side is unique, so a key with very many rows does not multiply;
    its partition is split by the adaptive skew join.
    """
    found = single_rows(snapshot).withColumnRenamed("key", key)
    age = F.unix_micros(now) - F.unix_micros("created_at")
    return rows.join(found, key, "left").withColumn("fresh", F.coalesce(age < period_us, F.lit(False)))


def is_expired(as_of: Column, retention: str = RETENTION) -> Column:
    return F.col("created_at") < as_of - F.expr(retention)


def surviving(snapshot: DataFrame, as_of: Column, retention: str = RETENTION) -> DataFrame:
    """What is not older than the retention; a row without a time stays.

    Plain comparisons on the column, so that they reach the scan. On a snapshot laid out by
    ``created_on`` only the surviving days are read.
    """
    kept = snapshot.where((F.col("created_at") >= as_of - F.expr(retention)) | F.col("created_at").isNull())
    if "created_on" in snapshot.columns:
        kept = kept.where((F.col("created_on") >= F.to_date(as_of - F.expr(retention))) | F.col("created_on").isNull())
    return kept


def expiry_summary(snapshot: DataFrame, as_of: Column, retention: str = RETENTION) -> DataFrame:
    deleted = F.count_if(is_expired(as_of, retention))
    return snapshot.agg(deleted.alias("deleted")).select(
        F.lit(True).alias("success"),
        F.format_string("Deleted %d expired entries", "deleted").alias("message"),
        as_of.alias("timestamp"),
        "deleted",
    )


def expire(snapshot: DataFrame, as_of: Column, retention: str = RETENTION) -> tuple[DataFrame, DataFrame]:
    """What stays, and a one-row summary of what goes."""
    return surviving(snapshot, as_of, retention), expiry_summary(snapshot, as_of, retention)
