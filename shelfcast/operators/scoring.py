"""Estimates: features, the unknown-publisher path and the result row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.functions import numbers, text
from shelfcast.operators.publishers import fallback_mean, first_match

# The model's input columns, in their order.
FEATURES = [
    "metacritic_filled",
    "has_metacritic",
    "release_year",
    "release_month",
    "num_publishers",
    "num_developers",
    "games_count",
    "avg_days_to_epic",
    "publisher_speed_score",
    "publisher_encoded",
]
RESULT_FIELDS = [
    "predicted_years",
    "years_whole",
    "months_whole",
    "lower_bound_years",
    "upper_bound_years",
    "sentence",
]
KNOWN, UNKNOWN, FAILED = "known", "unknown", "failed"


def publisher_features(stats: DataFrame, codes: DataFrame) -> DataFrame:
    """What scoring needs to know of each listed publisher, one row each, and its ``path``.

    Statistics without a code or without a mean wait are a failure, not an
    unknown publisher.
    """
    first = first_match(stats, "primary_publisher").withColumnRenamed("primary_publisher", "publisher")
    codes = codes.withColumnsRenamed({"label": "publisher", "code": "publisher_encoded"})
    unusable = F.col("publisher_encoded").isNull() | F.col("avg_days_to_epic").isNull()
    return first.join(codes, "publisher", "left").withColumns(
        {
            "path": F.when(unusable, FAILED).otherwise(KNOWN),
            "publisher_speed_score": numbers.speed_score(F.col("avg_days_to_epic")),
        }
    )


def feature_rows(items: DataFrame, stats: DataFrame, codes: DataFrame) -> DataFrame:
    """The ten features of every item, and ``path``: how it is going to be scored.

    ``items`` needs publisher, metacritic_score, release_year and release_month.
    A score of 0 is a score here.
    """
    score = F.col("metacritic_score")
    return items.join(publisher_features(stats, codes), "publisher", "left").withColumns(
        {
            "path": F.coalesce("path", F.lit(UNKNOWN)),
            "metacritic_filled": F.coalesce(score, F.col("avg_metacritic")),
            "has_metacritic": score.isNotNull().cast("int"),
            "num_publishers": F.lit(1),
            "num_developers": F.lit(1),
        }
    )


def estimates(features: DataFrame, stats: DataFrame, predicted_days: Column) -> DataFrame:
    """Result row of every item from its predicted days; columns only, no second pass."""
    known = F.col("path") == KNOWN
    unknown = F.col("path") == UNKNOWN
    average = F.col("avg_days_to_epic")
    days = F.when(known, predicted_days).when(unknown, fallback_mean(stats))
    timed = features.withColumn("predicted_years", days / numbers.DAYS_PER_YEAR)
    years = F.col("predicted_years")
    rows = timed.withColumns(
        {
            "years_whole": numbers.whole_years(years),
            "months_whole": numbers.whole_months(years),
            "lower_bound_years": F.when(known, numbers.lower_bound(years)).when(unknown, F.lit(0.0)),
            "upper_bound_years": F.when(known, numbers.upper_bound(years)).when(unknown, F.lit(0.0)),
            "publisher_game_count": F.when(known, F.col("games_count")).when(unknown, F.lit(0).cast("bigint")),
        }
    )
    sentence = F.when(
        known & years.isNotNull(),
        text.known_publisher_sentence(
            F.col("publisher"),
            F.col("games_count"),
            numbers.average_years(average),
            numbers.average_months(average),
            F.col("avg_metacritic"),
            F.col("name"),
            F.col("metacritic_score"),
            F.col("years_whole"),
            F.col("months_whole"),
            F.col("lower_bound_years"),
            F.col("upper_bound_years"),
        ),
    ).when(
        unknown & years.isNotNull(),
        text.unknown_publisher_sentence(F.col("publisher"), F.col("years_whole"), F.col("months_whole")),
    )
    return rows.withColumn("sentence", sentence)


def result_columns() -> list[Column]:
    """The fields that are sent, in plain types."""
    types = ["double", "int", "int", "double", "double", "string"]
    return [F.col(name).cast(kind).alias(name) for name, kind in zip(RESULT_FIELDS, types)]


def as_json(rows: DataFrame, column: str = "result") -> DataFrame:
    return rows.withColumn(column, F.to_json(F.struct(*result_columns())))


def with_source(json_text: Column, source: Column) -> Column:
    """A stored JSON result with its ``source`` field set; all other fields stay as they are."""
    fields = F.map_filter(F.from_json(json_text, "map<string,variant>"), lambda name, _: name != "source")
    value = F.parse_json(F.concat(F.lit('"'), source, F.lit('"')))
    return F.to_json(F.map_concat(fields, F.create_map(F.lit("source"), value)))
