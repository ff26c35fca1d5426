"""Votes and stored results: the two uses of the period rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.operators.keyed_scan import HOT_ROWS, period_openers

# How long a result is kept and how long a client must wait.
HOUR_US = 3_600_000_000
RESULT_TTL_US = 24 * HOUR_US
COOLDOWN_US = HOUR_US
HIT, MISS, ERROR = "cache_hit", "cache_miss", "error"


RESULT_KEYS = ["game_key", "platform"]
VOTE_KEYS = ["client_ip", "game_key", "platform"]


def _judged(
    events: DataFrame, keys: list[str], period_us: int, hot_rows: int | None, bands: int | None, start: DataFrame | None
) -> DataFrame:
    """``period_openers`` of the events, with the openers of ``start`` (keys, at_us, id) before them."""
    if start is None:
        return period_openers(events, keys, period_us, hot_rows, bands)
    earlier = start.select(*keys, "at_us", "id", F.lit(True).alias("eligible"), F.lit(True).alias("carried"))
    both = events.withColumn("carried", F.lit(False)).unionByName(earlier, allowMissingColumns=True)
    return period_openers(both, keys, period_us, hot_rows, bands).where("NOT carried").drop("carried")


def last_openers(judged: DataFrame, keys: list[str], start: DataFrame | None = None) -> DataFrame:
    """The newest opener of every key, those of ``start`` included: what the next batch starts with."""
    found = judged.where("opener_id IS NOT NULL").select(*keys, F.col("opener_us").alias("at_us"), F.col("opener_id").alias("id"))
    if start is not None:
        found = found.unionByName(start.select(*keys, "at_us", "id"))
    return found.groupBy(*keys).agg(F.max(F.struct("at_us", "id")).alias("last")).select(*keys, "last.*")


def with_outcome_source(
    requests: DataFrame,
    period_us: int = RESULT_TTL_US,
    hot_rows: int | None = HOT_ROWS,
    bands: int | None = None,
    start: DataFrame | None = None,
    keep_opener: bool = False,
) -> DataFrame:
    """Adds ``source`` and ``stored_by``, the request whose stored result is the answer.

    ``start`` holds results that were stored before: game_key, platform, at_us and id.

    A stored result answers every request of its game and platform that comes
    less than a day later; only a successful miss stores. A soft error is
    answered as a miss but not stored, a failure is an error.
    """
    events = requests.withColumns(
        {"at_us": F.unix_micros("ts"), "id": F.col("request_id"), "eligible": F.col("outcome") == "ok"}
    )
    scanned = _judged(events, RESULT_KEYS, period_us, hot_rows, bands, start)
    source = (
        F.when(F.col("opener_id") != F.col("id"), HIT)
        .when(F.col("outcome") == "fail", ERROR)
        .otherwise(MISS)
    )
    return scanned.withColumns({"source": source, "stored_by": F.col("opener_id")}).drop(
        "at_us", "id", "eligible", *([] if keep_opener else ["opener_id", "opener_us"])
    )


def with_votes(
    requests: DataFrame,
    period_us: int = COOLDOWN_US,
    hot_rows: int | None = HOT_ROWS,
    bands: int | None = None,
    start: DataFrame | None = None,
    keep_opener: bool = False,
) -> DataFrame:
    """Adds ``voted``: one vote counts per client, game, platform and hour.

    Local traffic always counts, starts no cooldown and is not shuffled. ``start`` holds earlier votes:
    client_ip, game_key, platform, at_us and id.
    """
    remote = requests.where(~F.col("is_local")).withColumns(
        {"at_us": F.unix_micros("ts"), "id": F.col("request_id"), "eligible": F.lit(True)}
    )
    judged = _judged(remote, VOTE_KEYS, period_us, hot_rows, bands, start)
    local = requests.where("is_local").withColumn("voted", F.lit(True))
    openers = ["opener_id", "opener_us"] if keep_opener else []
    voted = (F.col("opener_id") == F.col("id")).alias("voted")
    return judged.select(*requests.columns, voted, *openers).unionByName(local, allowMissingColumns=True)


def accepted_votes(
    requests: DataFrame, period_us: int = COOLDOWN_US, hot_rows: int | None = HOT_ROWS, bands: int | None = None
) -> DataFrame:
    """The requests that count as a vote."""
    return with_votes(requests, period_us, hot_rows, bands).where("voted").drop("voted")
