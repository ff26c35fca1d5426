"""Past appearances: gaps, summaries and first-timers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def appearance_gaps(appearances: DataFrame) -> DataFrame:
    """Days since the item's previous appearance on the same platform.

    Days are made distinct first, so a window holds at most one row per
    calendar day, however often an item is listed.
    """
    order = Window.partitionBy("game_id", "platform").orderBy("appeared_on")
    return (
        appearances.select("game_id", "platform", "appeared_on")
        .distinct()
        .withColumn("gap_days", F.datediff("appeared_on", F.lag("appeared_on").over(order)))
    )


def item_histories(appearances: DataFrame) -> DataFrame:
    """Number of days seen, first and last day per item and platform: all that summaries and waits need.

    Written once, it takes the place of the appearances for everything built on it.
    """
    days = appearances.select("game_id", "platform", "appeared_on").distinct()
    return days.groupBy("game_id", "platform").agg(
        F.count("*").alias("occurrences"), F.min("appeared_on").alias("first_on"), F.max("appeared_on").alias("last_on")
    )


def summary_of(histories: DataFrame) -> DataFrame:
    """The mean gap added. The gaps add up to last minus first, so no ordering is needed."""
    gap = F.datediff("last_on", "first_on") / (F.col("occurrences") - 1)
    return histories.withColumn("mean_gap_days", F.when(F.col("occurrences") > 1, gap)).drop("first_on")


def history_summary(appearances: DataFrame) -> DataFrame:
    """Number of days seen, last day and mean gap per item and platform."""
    return summary_of(item_histories(appearances))


def never_appeared(items: DataFrame, appearances: DataFrame) -> DataFrame:
    return items.join(appearances, ["game_id", "platform"], "left_anti")


def already_appeared(items: DataFrame, appearances: DataFrame) -> DataFrame:
    return items.join(appearances, ["game_id", "platform"], "left_semi")
