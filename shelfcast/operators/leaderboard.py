"""Vote counts and the boards built from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.functions.text import breakdown_text

BOARD_SIZE = 10
GLOBAL_NAMES = ("", "all", "global")
GLOBAL_LABEL = "Global"


def vote_counts(votes: DataFrame) -> DataFrame:
    """Votes per game, in the case it was asked for, and platform."""
    return votes.groupBy("game", "platform").agg(F.count("*").alias("score"))


def merge_counts(snapshot: DataFrame, batch: DataFrame) -> DataFrame:
    """Add a batch of counts to a board."""
    return snapshot.unionByName(batch).groupBy("game", "platform").agg(F.sum("score").alias("score"))


def with_rank(board: DataFrame, size: int) -> DataFrame:
    """Position in the board, ties by name. The limit comes first: the window sees ``size`` rows."""
    order = [F.desc("score"), F.asc("game")]
    return board.orderBy(*order).limit(size).withColumn(
        "rank", F.row_number().over(Window.orderBy(*order)).cast("bigint")
    )


def global_board(board: DataFrame, size: int = BOARD_SIZE) -> DataFrame:
    """Highest totals over all platforms, with a platform -> count map.

    The maps are built for the games on the board only.
    """
    top = with_rank(board.groupBy("game").agg(F.sum("score").alias("score")), size)
    entries = F.array_sort(F.collect_list(F.struct("platform", "score")))
    maps = (
        board.join(F.broadcast(top.select("game")), "game", "left_semi")  # ``size`` rows
        .groupBy("game")
        .agg(F.map_from_entries(entries).alias("breakdown"))
    )
    return maps.join(F.broadcast(top), "game").select("rank", "game", "score", "breakdown").orderBy("rank")


def platform_board(board: DataFrame, platform: str, size: int = BOARD_SIZE) -> DataFrame:
    one = board.where(F.col("platform") == platform)
    return with_rank(one, size).select(
        "rank", "game", "score", F.lit(None).cast("map<string,bigint>").alias("breakdown")
    )


def leaderboard(board: DataFrame, platform: str | None = None, size: int = BOARD_SIZE) -> DataFrame:
    """The board of one platform, or the global one if none is named."""
    if not platform or platform in GLOBAL_NAMES:
        rows = global_board(board, size)
    else:
        rows = platform_board(board, platform, size)
    return rows.select(
        F.lit(platform or GLOBAL_LABEL).alias("platform"),
        "rank",
        "game",
        "score",
        "breakdown",
        breakdown_text(F.col("breakdown")).alias("breakdown_text"),
    )


def platform_boards(board: DataFrame, platforms: DataFrame, size: int = BOARD_SIZE) -> DataFrame:
    """The boards of all platforms at once.

    Tasks cut to ``size`` rows per platform before the shuffle.
    """
    order = Window.partitionBy("platform").orderBy(F.desc("score"), F.asc("game"))
    ranked = board.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= size)
    return ranked.join(platforms.where("enabled").select("platform", "short_name"), "platform").select(
        "platform", "short_name", "rank", "game", "score"
    )
