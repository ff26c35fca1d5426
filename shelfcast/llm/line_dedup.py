"""Repeated three-line windows.

Every document is cut into overlapping windows of consecutive lines. A window that occurs more than
once anywhere is kept where it occurs first, by (identifier, position), and its lines are removed
everywhere else; the positions that several removed windows cover are merged.

The counts are partial aggregates, so a window that every document has reaches a reducer as one row
a task, and the join back to the occurrences is one that adaptive execution can split.

Cases: lines are compared as they are, without their line ends; a window of blank lines only never counts;
a text with fewer lines than a window, an empty and a null one stay as they are; repeated rows (same
identifier, same text) are one document and get the same result; a null identifier comes after all
others; further columns are kept by ``without_repeated_lines`` and ignored otherwise; an empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.common import stored, whole_row

WIDTH = 3
DOC = ["unknown", "doc_id", "text_hash"]
# what equal windows share, and what the second hash starts from
SAME, SEED = ["window", "evidence"], 1


def lines_of(text: str | Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _named(docs: DataFrame, key: str, text: str, *more: Column) -> DataFrame:
    return docs.select(
        F.col(key).isNull().alias("unknown"),
        F.coalesce(F.col(key), F.lit(0)).alias("doc_id"),
        F.xxhash64(text).alias("text_hash"),
        F.col(text).alias("text"),
        *more,
    )


def windows(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """One row per window: the document, the position of its first line, and two hashes of its lines.

    The second starts from another seed, so windows are taken as equal on 128 bits.
    """
    hashes = F.transform(F.col("lines"), lambda line: F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(SEED), line).alias("b")))
    blank = F.transform(F.col("lines"), lambda line: F.trim(line) == "")
    starts = F.when(F.size("lines") >= width, F.sequence(F.lit(0), F.size("lines") - width))

    def window(i: Column) -> Column:
        parts = [F.get(F.col("hashes"), i + k) for k in range(width)]
        empty = F.lit(True)
        for k in range(width):
            empty = empty & F.get(F.col("blank"), i + k)
        names = (("window", "a"), ("evidence", "b"))
        return F.when(~empty, F.struct(i.alias("position"), *[F.xxhash64(*[p[h] for p in parts]).alias(n) for n, h in names]))

    return (
        _named(docs, key, text)
        .select(*DOC, lines_of(F.col("text")).alias("lines"))
        .select(*DOC, "lines", hashes.alias("hashes"), blank.alias("blank"))
        .select(*DOC, F.explode(F.transform(starts, window)).alias("w"))
        .where(F.col("w").isNotNull())
        .select(*DOC, "w.position", *[f"w.{c}" for c in SAME])
    )


def repeats(found: DataFrame) -> DataFrame:
    """The occurrences that go: all but the first of every window that occurs more than once."""
    first = F.min(F.struct(*DOC, "position"))
    common = found.groupBy(*SAME).agg(first.alias("first"), F.max(F.struct(*DOC, "position")).alias("last"))
    common = common.where(F.col("first") != F.col("last")).drop("last")
    return (
        found.join(common, SAME)
        .where(F.struct(*DOC, "position") != F.col("first"))
        .select(*DOC, "position")
    )


def covered(found: DataFrame, width: int = WIDTH) -> DataFrame:
    """Merged line positions to remove, one row per document that loses any."""
    starts = repeats(found).groupBy(*DOC).agg(F.collect_set("position").alias("starts"))
    spans = F.flatten(F.transform("starts", lambda i: F.sequence(i, i + width - 1)))
    return starts.select(*DOC, F.array_distinct(spans).alias("gone"))


def _cleaned(docs: DataFrame, key: str, text: str, width: int, *more: Column) -> DataFrame:
    gone = covered(stored(windows(docs, key, text, width), "line-windows"), width)
    lines = F.col("lines")
    every = F.sequence(F.lit(0), F.size(lines) - 1)
    kept = F.transform(F.array_except(every, F.col("gone")), lambda i: F.get(lines, i))
    return (
        _named(docs, key, text, F.col(key).alias("own_id"), *more)
        .join(gone, DOC, "left")
        .withColumn("lines", lines_of(F.col("text")))
        .withColumn("clean", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")))
    )


def repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """One row per document: its text without repeated windows, its lines, and how many went."""
    return _cleaned(docs, key, text, width).select(
        F.col("own_id").alias("doc_id"),
        F.col("clean").alias("text"),
        F.size("lines").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).alias("n_removed"),
    )


def without_repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """The documents with all their columns, repeated windows removed from the text."""
    cleaned = _cleaned(docs, key, text, width, whole_row(docs))
    return cleaned.select(*[F.col("clean").alias(c) if c == text else F.col(f"row.`{c}`") for c in docs.columns])
