"""Publisher statistics, lookups and label codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.session import new_path
from shelfcast.sources.sinks import write_snapshot


def waits(appearances: DataFrame, enriched: DataFrame, day: str = "appeared_on") -> DataFrame:
    """Days from release to each appearance, for items with a publisher and a release date."""
    known = enriched.where(F.col("publisher").isNotNull() & F.col("released").isNotNull())
    # both sides grow with the items, and a file's size says little about the rows made from it: never broadcast
    known = known.select("game_id", "publisher", "released", "metacritic").hint("merge")
    return appearances.join(known, "game_id").withColumn("wait_days", F.datediff(day, "released"))


def first_waits(histories: DataFrame, enriched: DataFrame) -> DataFrame:
    """One wait per item and platform, up to its first day there; ``histories`` has one row of each with ``first_on``."""
    found = waits(histories.select("game_id", "platform", "first_on"), enriched, "first_on")
    return found.groupBy("game_id", "platform", "publisher").agg(
        F.min("wait_days").alias("wait_days"), F.min("metacritic").alias("metacritic")
    )


def wait_moments(first: DataFrame, by: list[str]) -> DataFrame:
    """Mergeable state of the statistics: number, mean and summed squared distance of waits; number and mean of scores."""
    return first.groupBy(*by).agg(
        F.count("wait_days").alias("n"),
        F.avg("wait_days").alias("mean"),
        (F.var_pop("wait_days") * F.count("wait_days")).alias("m2"),
        F.count("metacritic").alias("scores"),
        F.avg("metacritic").alias("mean_score"),
    )


def merge_moments(one: DataFrame, other: DataFrame, by: list[str]) -> DataFrame:
    """The state of both batches, which hold different items; neither batch's items are read again."""
    states = one.unionByName(other).groupBy(*by).agg(F.collect_list(F.struct("n", "mean", "m2", "scores", "mean_score")).alias("all"))
    zero = F.struct(
        F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"),
        F.lit(0).cast("long").alias("scores"), F.lit(0.0).alias("mean_score"),
    )

    def added(a: Column, b: Column) -> Column:
        n, scores = a["n"] + b["n"], a["scores"] + b["scores"]
        apart, apart_score = F.coalesce(b["mean"], F.lit(0.0)) - a["mean"], F.coalesce(b["mean_score"], F.lit(0.0)) - a["mean_score"]
        return F.struct(
            n.alias("n"),
            (a["mean"] + F.when(n > 0, apart * b["n"] / n).otherwise(0.0)).alias("mean"),
            (a["m2"] + F.coalesce(b["m2"], F.lit(0.0)) + F.when(n > 0, apart * apart * a["n"] * b["n"] / n).otherwise(0.0)).alias("m2"),
            scores.alias("scores"),
            (a["mean_score"] + F.when(scores > 0, apart_score * b["scores"] / scores).otherwise(0.0)).alias("mean_score"),
        )

    merged = states.select(*by, F.aggregate("all", zero, added).alias("state")).select(*by, "state.*")
    # nothing seen has no mean
    return merged.withColumns(
        {
            "mean": F.when(F.col("n") > 0, F.col("mean")),
            "m2": F.when(F.col("n") > 0, F.col("m2")),
            "mean_score": F.when(F.col("scores") > 0, F.col("mean_score")),
        }
    )


def statistics_of(moments: DataFrame) -> DataFrame:
    """Number of games, mean wait, mean score and the spread of the waits from their state."""
    spread = F.when(F.col("games_count") > 1, F.sqrt(F.col("m2") / (F.col("games_count") - 1)))
    return (
        moments.withColumnsRenamed({"n": "games_count", "mean": "avg_wait_days", "mean_score": "avg_score"})
        # no spread from a single wait; a mean below 0, listed before release, has the spread of one above
        .withColumn("consistency", F.when(F.col("avg_wait_days") != 0, spread / F.abs("avg_wait_days")))
        .drop("m2", "scores")
    )


def publisher_statistics(appearances: DataFrame, enriched: DataFrame, by: list[str]) -> DataFrame:
    """Number of games, mean wait, mean score and the spread of the waits, per publisher (and platform).

    A game counts once on a platform, with its first appearance there, however often it returns.
    """
    firsts = appearances.groupBy("game_id", "platform").agg(F.min("appeared_on").alias("first_on"))
    return statistics_of(wait_moments(first_waits(firsts, enriched), by))


def first_match(stats: DataFrame, key: str, ordinal: str = "ordinal") -> DataFrame:
    """The row of each key that comes first in the source."""
    rest = [c for c in stats.columns if c not in (key, ordinal)]
    first = F.min_by(F.struct(*rest), F.col(ordinal))
    return stats.groupBy(key).agg(first.alias("first")).select(key, "first.*")


def fallback_mean(stats: DataFrame) -> Column:
    """Mean over publishers, not over items: one value, read once per query."""
    return stats.agg(F.avg("avg_days_to_epic")).scalar()


def label_codes(labels: DataFrame, label: str = "label") -> DataFrame:
    """0, 1, 2, ... for the distinct labels in sorted order.

    The labels are range-partitioned and sorted, and written once, because both
    uses below must see the same ranges; then only the row counts of the
    partitions are added up.
    """
    spark = labels.sparkSession
    placed = (
        labels.select(label)
        .where(F.col(label).isNotNull())
        .distinct()
        .repartitionByRange(label)
        .sortWithinPartitions(label)
        # partition number in the upper bits, row number in the lower 33
        .withColumn("place", F.monotonically_increasing_id())
        .select(label, F.shiftright("place", 33).alias("part"), F.col("place").bitwiseAND((1 << 33) - 1).alias("row"))
    )
    path = write_snapshot(placed, new_path(spark, "labels"))
    placed = spark.read.schema(placed.schema).parquet(path)
    parts = placed.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return placed.join(starts, "part").select(label, (F.col("start") + F.col("row")).alias("code"))
