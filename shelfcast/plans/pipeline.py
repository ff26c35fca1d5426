"""The whole request flow as one set of Spark jobs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.operators import requests as rq
from shelfcast.operators.catalogue import release_month, release_year
from shelfcast.operators.demand import (
    ERROR,
    HIT,
    MISS,
    RESULT_KEYS,
    VOTE_KEYS,
    accepted_votes,
    last_openers,
    with_outcome_source,
    with_votes,
)
from shelfcast.operators.keyed_scan import HOT_ROWS
from shelfcast.operators.leaderboard import merge_counts, vote_counts
from shelfcast.operators.scoring import FAILED, RESULT_FIELDS, estimates, feature_rows, publisher_features
from shelfcast.session import new_path
from shelfcast.sources.readers import read_leaderboard
from shelfcast.sources.sinks import write_snapshot

# Answer codes.
STATUS_OK, STATUS_ERROR = 200, 500


def with_scoring_outcome(requests: DataFrame, stats: DataFrame, codes: DataFrame) -> DataFrame:
    """A request whose publisher cannot be scored is a failure."""
    paths = publisher_features(stats, codes).select("publisher", "path")
    outcome = F.when(F.col("path") == FAILED, "fail").otherwise(F.col("outcome"))
    return requests.join(paths, "publisher", "left").withColumn("outcome", outcome).drop("path")


def answered(requests: DataFrame, stats: DataFrame, codes: DataFrame, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Accepted requests with their source, written once.

    Scoring, hits and votes all read this table, so the cache decision is made
    once and a lost executor costs no second pass over the requests.
    """
    named = with_scoring_outcome(rq.accepted(requests), stats, codes)
    decided = with_outcome_source(named, hot_rows=hot_rows)
    path = write_snapshot(decided, new_path(requests.sparkSession, "answered"))
    return requests.sparkSession.read.schema(decided.schema).parquet(path)


def voting(named: DataFrame, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Requests that were answered with a result and so ask for a vote: hits and stored misses."""
    decided = with_outcome_source(
        named.select("request_id", "ts", "game", "game_key", "platform", "client_ip", "is_local", "outcome"), hot_rows=hot_rows
    )
    return decided.where((F.col("source") == HIT) | stored()).drop("outcome", "source", "stored_by")


def counted_board(requests: DataFrame, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """The counter table of all accepted votes, written once; boards read it more than once."""
    counts = vote_counts(accepted_votes(requests, hot_rows=hot_rows))
    path = write_snapshot(counts, new_path(requests.sparkSession, "board"))
    return read_leaderboard(requests.sparkSession, path)


def stored() -> Column:
    """A successful miss: it was scored and its result kept."""
    return (F.col("source") == MISS) & (F.col("outcome") == "ok")


def scored_results(
    answered_requests: DataFrame, stats: DataFrame, codes: DataFrame, days: Column | None = None
) -> DataFrame:
    """The estimate of every request that was passed on and succeeded, by request id.

    ``days`` is the prediction as a column over feature rows (``model.days_column``). Without one the publisher's mean
    wait takes its place.
    """
    items = answered_requests.where(stored()).select(
        F.col("request_id").alias("stored_by"),
        F.col("game").alias("name"),
        "publisher",
        "metacritic_score",
        release_year(F.col("release_date")).alias("release_year"),
        release_month(F.col("release_date")).alias("release_month"),
    )
    features = feature_rows(items, stats, codes)
    predicted = F.col("avg_days_to_epic") if days is None else days
    features = features.withColumn("predicted_days", predicted)
    return estimates(features, stats, F.col("predicted_days")).select("stored_by", *RESULT_FIELDS)


def responses(
    requests: DataFrame,
    stats: DataFrame,
    codes: DataFrame,
    hot_rows: int | None = HOT_ROWS,
    days: Column | None = None,
) -> DataFrame:
    """One answer per request: status, source, the result and whether it counted as a vote."""
    columns = ["request_id", "status", "game", "platform", "source", "stored_by"]
    status = F.when(F.col("source") == ERROR, STATUS_ERROR).otherwise(STATUS_OK)
    decided = answered(requests, stats, codes, hot_rows).withColumn("status", status)

    # hits and successful misses have a result and ask for a vote; soft errors and
    # failures have neither, so they skip the join instead of forming a hot null key
    has_result = (F.col("source") == HIT) | stored()
    voted = with_votes(
        decided.where(has_result).select(*columns, "ts", "client_ip", "game_key", "is_local"), hot_rows=hot_rows
    ).select(*columns, "voted")
    with_result = voted.join(scored_results(decided, stats, codes, days).hint("merge"), "stored_by", "left")
    without = decided.where(~has_result).select(*columns, F.lit(False).alias("voted"))
    refused = rq.rejected(requests).select("request_id", "status", F.lit(False).alias("voted"))
    return (
        with_result.unionByName(without, allowMissingColumns=True)
        .unionByName(refused, allowMissingColumns=True)
        .select(*columns, *RESULT_FIELDS, "voted")
    )


@dataclass
class FlowState:
    """What a batch of requests finds and leaves: stored results, running cooldowns and the board.

    ``results`` has game_key, platform, at_us, id and the result's fields, ``cooldowns`` has client_ip, game_key,
    platform, at_us and id, ``board`` has game, platform and score. Each is a written table with one row a key.
    """

    results: DataFrame
    cooldowns: DataFrame
    board: DataFrame


def answer_batch(
    requests: DataFrame,
    stats: DataFrame,
    codes: DataFrame,
    state: FlowState | None = None,
    hot_rows: int | None = HOT_ROWS,
    days: Column | None = None,
) -> tuple[DataFrame, FlowState]:
    """The answers to a batch of requests, and the state after it; batches come in the order of time.

    Several batches one after the other answer, count and store what one run over all of them does.
    """
    spark = requests.sparkSession

    def written(df: DataFrame, name: str) -> DataFrame:
        return spark.read.schema(df.schema).parquet(write_snapshot(df, new_path(spark, name)))

    named = with_scoring_outcome(rq.accepted(requests), stats, codes)
    before = state.results if state else None
    decided = written(with_outcome_source(named, hot_rows=hot_rows, start=before, keep_opener=True), "answered")
    results = scored_results(decided, stats, codes, days)
    if state:
        results = results.unionByName(before.select(F.col("id").alias("stored_by"), *RESULT_FIELDS))
    results = written(results, "results")

    asking = decided.where((F.col("source") == HIT) | stored()).drop("opener_id", "opener_us")
    cooling = state.cooldowns if state else None
    voted = written(with_votes(asking, hot_rows=hot_rows, start=cooling, keep_opener=True), "voted")
    counts = vote_counts(voted.where("voted"))

    latest = last_openers(decided, RESULT_KEYS, before)
    after = FlowState(
        written(latest.join(results.hint("merge"), latest["id"] == results["stored_by"]).drop("stored_by"), "stored-results"),
        written(last_openers(voted, VOTE_KEYS, cooling), "cooldowns"),
        written(merge_counts(state.board, counts) if state else counts, "board"),
    )
    columns = ["request_id", "status", "game", "platform", "source", "stored_by"]
    status = F.when(F.col("source") == ERROR, STATUS_ERROR).otherwise(STATUS_OK).alias("status")
    with_result = voted.withColumn("status", status).select(*columns, "voted").join(results.hint("merge"), "stored_by", "left")
    without = decided.where(~((F.col("source") == HIT) | stored())).withColumn("status", status)
    refused = rq.rejected(requests).select("request_id", "status", F.lit(False).alias("voted"))
    answers = (
        with_result.unionByName(without.select(*columns, F.lit(False).alias("voted")), allowMissingColumns=True)
        .unionByName(refused, allowMissingColumns=True)
        .select(*columns, *RESULT_FIELDS, "voted")
    )
    return answers, after
