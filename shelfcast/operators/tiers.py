"""The tiered estimate: repeat history, model, first-party and no-repeat rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.functions.bands import category_band, confidence_band, confidence_word
from shelfcast.functions.numbers import DAYS_PER_MONTH, round_half_up, rounded_days
from shelfcast.functions.text import fixed, month_duration

# Tier names and category labels.
TIER_HISTORY = "A. Historical Lookup"
TIER_MODEL = "B. Model"
TIER_FIRST_PARTY = "C. First-Party Check"
TIER_NO_REPEAT = "D. Humble Choice Rules"
WITHIN_6, WITHIN_12 = "Within 6 months", "6-12 months"
OVER_12, OVER_24 = "More than 12 months", "More than 24 months"
FIRST_PARTY_LABEL = "Within 12-24 months"
NO_REPEAT_LABEL = "Very Unlikely"
UNKNOWN_LABEL = "Unknown"
NO_REPEAT_PLATFORM = "humble"
NO_WARNING_PLATFORM = "epic"
# the only service whose owner's items are promised within a span; elsewhere they are timed like others
FIRST_PARTY_PLATFORM = "gamepass"
RECENT_DAYS = 365


def category(months: Column) -> Column:
    return (
        F.when(months <= 6, WITHIN_6)
        .when(months <= 12, WITHIN_12)
        .when(months <= 24, OVER_12)
        .when(months.isNotNull(), OVER_24)
        .otherwise(UNKNOWN_LABEL)
    )


def not_negative(x: Column) -> Column:
    """At least 0; null stays null."""
    return F.when(x < 0, F.lit(0.0)).otherwise(x)


def tiered_estimates(
    items: DataFrame,
    history: DataFrame,
    publisher_stats: DataFrame,
    first_party: DataFrame,
    as_of: Column,
    predicted_days: Column | None = None,
    recent_days: int = RECENT_DAYS,
) -> DataFrame:
    """One estimate per item and platform.

    ``items(game_id, platform, publisher, metacritic, released)`` is joined to
    the history and statistics of the same platform; both are unique on the join
    keys, so no row multiplies. The history grows with the items and is never
    broadcast; small sides are, by the adaptive planner from their measured size. ``predicted_days`` defaults to the
    publisher's mean wait.
    """
    stats = publisher_stats.select("publisher", "platform", "games_count", "avg_wait_days", "consistency")
    owned = first_party.select("publisher", "platform").distinct().withColumn("owned", F.lit(True))
    joined = (
        items.join(history.hint("merge"), ["game_id", "platform"], "left")
        .join(stats, ["publisher", "platform"], "left")
        .join(owned, ["publisher", "platform"], "left")
    )
    days = F.col("avg_wait_days") if predicted_days is None else predicted_days

    seen = F.coalesce(F.col("occurrences"), F.lit(0).cast("bigint"))
    no_repeat = (F.col("platform") == NO_REPEAT_PLATFORM) & (seen >= 1)
    tier = (
        F.when(no_repeat, TIER_NO_REPEAT)
        .when(seen >= 2, TIER_HISTORY)
        .when(F.col("owned"), TIER_FIRST_PARTY)
        .otherwise(TIER_MODEL)
    )
    promised = (F.col("tier") == TIER_FIRST_PARTY) & (F.col("platform") == FIRST_PARTY_PLATFORM)
    # an item without a release date starts waiting now
    start = F.coalesce(F.col("released"), as_of)
    repeat_days = not_negative(F.datediff("last_on", as_of) + F.col("mean_gap_days"))
    model_days = not_negative(F.datediff(start, as_of) + F.col("total_days"))
    # the steadier the publisher, the higher; none without a spread
    steadiness = round_half_up(100 * (1 - F.least(F.col("consistency"), F.lit(1.0)))).cast("int")

    timed = (
        joined.withColumns({"tier": tier, "total_days": days, "sample_size": seen})
        .withColumns(
            {
                "remaining_days": F.when(F.col("tier") == TIER_HISTORY, repeat_days).when(
                    F.col("tier").isin(TIER_MODEL, TIER_FIRST_PARTY) & ~promised, model_days
                ),
                "theoretical_wait_time": F.when(F.col("tier") == TIER_NO_REPEAT, repeat_days / DAYS_PER_MONTH),
            }
        )
        .withColumn("predicted_months", F.col("remaining_days") / DAYS_PER_MONTH)
        .withColumn(
            "category",
            F.when(F.col("tier") == TIER_NO_REPEAT, NO_REPEAT_LABEL)
            .when(promised, FIRST_PARTY_LABEL)
            .otherwise(category(F.col("predicted_months"))),
        )
        .withColumn("confidence", F.coalesce(steadiness, F.lit(0)))
    )
    recent = F.coalesce(F.datediff(as_of, F.col("last_on")) <= recent_days, F.lit(False))
    wait = F.col("predicted_months")
    return timed.select(
        "game_id",
        "platform",
        "tier",
        "category",
        category_band(F.col("category")).alias("category_band"),
        reasoning(by_model=predicted_days is not None).alias("reasoning"),
        "confidence",
        confidence_band(F.col("confidence")).alias("confidence_band"),
        confidence_word(F.col("confidence")).alias("confidence_word"),
        F.col("last_on").cast("string").alias("last_appearance_date"),
        "theoretical_wait_time",
        month_duration(F.col("theoretical_wait_time")).alias("theoretical_wait_text"),
        F.date_add(as_of, F.ceil("remaining_days").cast("int")).cast("string").alias("projected_arrival"),
        F.when(F.col("tier") == TIER_MODEL, F.col("total_days")).alias("predicted_total_days"),
        F.when(F.col("tier") == TIER_MODEL, rounded_days(F.col("total_days"))).alias("predicted_total_text"),
        F.col("avg_wait_days").alias("publisher_avg_wait_days"),
        rounded_days(F.col("avg_wait_days")).alias("publisher_avg_wait_text"),
        F.col("metacritic").alias("metacritic_score_used"),
        "predicted_months",
        F.when(wait > 0, month_duration(wait)).alias("predicted_months_text"),
        F.coalesce("games_count", F.lit(0).cast("bigint")).alias("publisher_game_count"),
        "sample_size",
        F.col("consistency").alias("publisher_consistency"),
        fixed(F.col("consistency"), 2).alias("publisher_consistency_text"),
        recent.alias("recently_appeared"),
        (recent & (F.col("platform") != NO_WARNING_PLATFORM)).alias("recent_warning"),
    )


# The fields of a result, in display order.
RESULT_FIELDS = [
    "category",
    "reasoning",
    "confidence",
    "last_appearance_date",
    "theoretical_wait_time",
    "projected_arrival",
    "predicted_total_days",
    "publisher_avg_wait_days",
    "metacritic_score_used",
    "predicted_months",
    "publisher_game_count",
    "tier",
    "sample_size",
    "publisher_consistency",
    "recently_appeared",
]


def as_json(rows: DataFrame, column: str = "result") -> DataFrame:
    """Result fields as JSON text; fields without a value are left out."""
    return rows.withColumn(column, F.to_json(F.struct(*RESULT_FIELDS)))


def reasoning(by_model: bool) -> Column:
    """One line on how the estimate came about."""
    expected = "The model expects %d days from release." if by_model else "The publisher's items wait %d days on average."
    return (
        F.when(F.col("tier") == TIER_NO_REPEAT, F.concat(F.lit("Seen on "), F.col("last_on").cast("string"), F.lit("; items do not return here.")))
        .when(F.col("tier") == TIER_HISTORY, F.format_string("Seen %d times, on average every %d days.", "sample_size", rounded_days(F.col("mean_gap_days"))))
        .when(F.col("tier") == TIER_FIRST_PARTY, F.lit("Published by the owner of the service."))
        .when(F.col("total_days").isNull(), F.lit("No history of the publisher on this service."))
        .otherwise(F.format_string(expected, rounded_days(F.col("total_days"))))
    )
