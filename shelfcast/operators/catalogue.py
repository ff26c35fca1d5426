"""Catalogue records: enrichment, manual entries and per-platform requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.functions.numbers import round_half_up
from shelfcast.functions.text import cropped_image, number_text

# Stand-ins for what a record lacks.
UNKNOWN = "Unknown"
NO_SCORE = "N/A"
DEFAULT_SCORE = 75.0
RATING_FACTOR = 20
MANY_REVIEWS = 1000
DEFAULT_YEAR, DEFAULT_MONTH = 2024, 1


def first_publisher(publishers: Column) -> Column:
    """Name of the first entry, even if that name is null; ``Unknown`` without entries."""
    return F.when(F.size(publishers) > 0, F.try_element_at(publishers, F.lit(1))["name"]).otherwise(UNKNOWN)


def nonzero(x: Column) -> Column:
    return F.coalesce(x != 0, F.lit(False))


def imputed_score(score: Column, rating: Column, reviews: Column) -> Column:
    """A score of 0 counts as missing here; with nothing to go by it stays as it is."""
    value = (
        F.when(nonzero(score), score)
        .when(nonzero(rating), rating * RATING_FACTOR)
        .when(reviews > MANY_REVIEWS, F.lit(DEFAULT_SCORE))
        .otherwise(score)
    )
    return F.when(nonzero(value), round_half_up(value, 2)).otherwise(value)


def nonempty(items: Column) -> Column:
    return F.when(F.size(items) > 0, items)


def release_year(released: Column) -> Column:
    return F.coalesce(F.year(released), F.lit(DEFAULT_YEAR))


def release_month(released: Column) -> Column:
    return F.coalesce(F.month(released), F.lit(DEFAULT_MONTH))


def enrich(records: DataFrame) -> DataFrame:
    """One projection: publisher, score, release parts, picture and display texts."""
    score = imputed_score(F.col("metacritic"), F.col("rating"), F.col("reviews_count"))
    return records.select(
        F.col("id").alias("game_id"),
        "name",
        first_publisher(F.col("publishers")).alias("publisher"),
        score.alias("metacritic"),
        "released",
        release_year(F.col("released")).alias("release_year"),
        release_month(F.col("released")).alias("release_month"),
        nonempty(F.col("platforms")).alias("platforms"),
        cropped_image(F.col("background_image")).alias("image"),
        F.when(nonzero(score), number_text(score)).otherwise(NO_SCORE).alias("score_text"),
        F.coalesce(F.col("released").cast("string"), F.lit(UNKNOWN)).alias("released_text"),
    )


# Fixed value: one character that is not white space, the Unicode blanks and line ends included.
VISIBLE = r"[^\s\x0B\x1c-\x1f\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"


def manual_records(entries: DataFrame) -> DataFrame:
    """Typed-in items as catalogue rows; both fields must have text."""
    return entries.where(F.col("name").rlike(VISIBLE) & F.col("publisher").rlike(VISIBLE)).select(
        "name",
        "publisher",
        F.lit(DEFAULT_SCORE).alias("metacritic"),
        F.lit(None).cast("date").alias("released"),
        F.lit(None).cast("string").alias("background_image"),
        F.array().cast("array<string>").alias("platforms"),
    )


def with_manual(enriched: DataFrame, entries: DataFrame) -> DataFrame:
    """Looked-up and typed-in items in one table."""
    return enriched.unionByName(enrich_manual(entries))


def enrich_manual(entries: DataFrame) -> DataFrame:
    rows = manual_records(entries)
    return enrich(
        rows.select(
            F.lit(None).cast("bigint").alias("id"),
            "name",
            F.array(F.struct(F.col("publisher").alias("name"))).alias("publishers"),
            "platforms",
            "metacritic",
            F.lit(None).cast("double").alias("rating"),
            F.lit(None).cast("bigint").alias("reviews_count"),
            "released",
            "background_image",
        )
    )


def on_enabled_platforms(rows: DataFrame, platforms: DataFrame) -> DataFrame:
    """Rows whose platform is one of the enabled ones, with its names."""
    return rows.join(platforms.where("enabled").drop("enabled"), "platform")
