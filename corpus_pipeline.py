"""Documents from raw to packed: bad text out, copies out, sources mixed, sequences filled.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; ``run`` writes
every stage's result as Parquet to the shared folder and reads it back for the next one.

Cases: a document with a null identifier, null language or null source goes through like others; null and empty texts are one text,
of which one document stays; of repeated rows one stays; an empty table gives an empty result; further columns are kept by
all stages but the last, under their own names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.llm import exact_dedup, language_model, mixing, ngram_join, packing
from shelfcast.llm.common import stored
from shelfcast.llm.queries import table, trusted_ids


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is within their language's limit."""
    return language_model.good_documents(docs, trusted_ids(spark, sf_dir))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return exact_dedup.without_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares four fifths of its five-word shingles."""
    return ngram_join.without_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix: by file, then by row."""
    return mixing.interleaved(docs)


def file_order(docs: DataFrame) -> list[Column]:
    """The order in which a stored table was written."""
    return [F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row")]


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 ids, taken in the order of the mix."""
    return packing.packed(docs, order=file_order(docs))


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mix", mix), ("pack", pack)]

# the model, MinHash and tokenizer stages are not expressible in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}", "snappy")
    return docs
