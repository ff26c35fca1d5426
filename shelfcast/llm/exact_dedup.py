"""Exact duplicates by a tree merge of sorted digest runs.

Every input partition turns its rows into one run: the distinct digests it saw, each with the
smallest row that has it and the number of rows. Runs are merged ``fan_in`` at a time in
log(partitions) rounds. A run is cut into lanes by digest, so that the last round is as wide as
the first. In each round the runs that meet are exchanged by (lane, run), sorted, and merged:
equal digests collapse to the smaller row. Copies inside a partition collapse before anything
is exchanged, so a text that a third of all rows share reaches the merge as one entry a partition.

A digest is believed only together with the length of the text and a second, unrelated hash of it;
the three are compared in every round.

Cases: a null text counts as empty, and so does an empty one; a null identifier is larger than any
other; of repeated rows (same identifier, same text) exactly one stays; an empty table gives an
empty result; further columns are never read unless the rows are asked for.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.common import shuffle_partitions, stored, whole_row

# blank, tab, line feed, vertical tab, form feed, carriage return
WHITE_SPACE = r"[\x20\x09-\x0D]+"
SAME_TEXT = ["digest", "n_bytes", "second_hash"]


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), WHITE_SPACE, " ")


def digested(docs: DataFrame, key: str = "doc_id", text: str = "text", with_rows: bool = False) -> DataFrame:
    """One narrow row per document with the evidence that two texts are equal."""
    plain = docs.select(F.col(key).alias("doc_id"), normalised(text).alias("text"), *([whole_row(docs)] if with_rows else []))
    return plain.select(
        "doc_id",
        F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"),
        F.octet_length("text").cast("long").alias("n_bytes"),
        F.xxhash64("text").alias("second_hash"),
        F.monotonically_increasing_id().alias("row_id"),
        F.spark_partition_id().alias("run"),
        *(["row"] if with_rows else []),
    )


def merged_runs(rows: DataFrame, fan_in: int = 8) -> DataFrame:
    """Smallest row and number of rows of each distinct text."""
    lanes = shuffle_partitions(rows)
    smallest = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row_id")
    keys = ["lane", "run", *SAME_TEXT]
    runs = (
        rows.withColumn("lane", F.pmod(F.xxhash64("digest"), F.lit(lanes)).cast("int"))
        .groupBy(*keys)
        .agg(F.min(smallest).alias("first"), F.count(F.lit(1)).alias("group_size"))
    )
    count = (rows.agg(F.max("run")).first()[0] or 0) + 1
    while True:
        count = math.ceil(count / fan_in)
        runs = (
            runs.withColumn("run", F.floor(F.col("run") / fan_in).cast("int"))
            .repartition(lanes, "lane", "run")
            .sortWithinPartitions(*keys)
            .groupBy(*keys)
            .agg(F.min("first").alias("first"), F.sum("group_size").alias("group_size"))
        )
        if count == 1:
            return runs.select(*SAME_TEXT, "first", "group_size")


def decisions(rows: DataFrame, fan_in: int = 8) -> DataFrame:
    """For every digested row which row of its group stays."""
    return rows.join(merged_runs(rows, fan_in), SAME_TEXT).select(
        "doc_id",
        "row_id",
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row_id") == F.col("first.row_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: the identifier that stays, the size of its group, and whether it is the one."""
    return decisions(stored(digested(docs, key, text), "digests")).drop("row_id")


def without_exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay, with all their columns."""
    rows = stored(digested(docs, key, text, with_rows=True), "digested-rows")
    dropped = stored(decisions(rows.drop("row")).where(~F.col("kept")).select("row_id"), "dropped-rows")
    return rows.join(dropped, "row_id", "left_anti").select("row.*")
