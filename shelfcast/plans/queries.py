"""Registered queries: each takes (spark, folder of parquet tables) and returns a DataFrame.

Times are shown as microseconds, dates as text and measured doubles with six
decimals, so that another engine can be compared value by value.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.functions.text import without_bold_marks
from shelfcast.operators import catalogue as cat
from shelfcast.operators import demand, history, leaderboard, model, publishers, scoring, snapshots, tiers, titles
from shelfcast.operators import requests as rq
from shelfcast.plans import pipeline
from shelfcast.session import new_path
from shelfcast.sources import derived, readers, schemas, sinks
from shelfcast.sources.readers import platform_dimension
from shelfcast.streaming import live

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

# small enough to cut the busiest keys into cells on the supplied tables
CELL_ROWS, CELL_BANDS = 100, 16
# of the stored tables: about their size over 1 GB
LOOKUP_BUCKETS = 8
# small enough to make common title words hot on the supplied tables
FEW_PAIRS = 5_000


def query(fn: Query) -> Query:
    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return fn(spark, sf_dir)

    REGISTRY[fn.__name__] = run
    return run


def six(name: str) -> Column:
    return F.round(name, 6).alias(name)


def micros(name: str, alias: str) -> Column:
    return F.unix_micros(name).alias(alias)


def named_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rq.accepted(derived.requests(spark, sf_dir))


def vote_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named_requests(spark, sf_dir).select(
        "request_id", "ts", "game", "game_key", "platform", "client_ip", "is_local"
    )


def board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes of answered requests: hits, and misses whose result was stored."""
    return pipeline.counted_board(pipeline.voting(named_requests(spark, sf_dir)))


def statistics(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Publisher statistics and the codes of their labels, written once: lookups, the mean of all and the codes read
    the small table, not the appearances again."""
    stats = derived.publisher_stats(spark, sf_dir)
    stats = spark.read.schema(stats.schema).parquet(sinks.write_snapshot(stats, new_path(spark, "statistics")))
    return stats, publishers.label_codes(derived.publisher_labels(stats))


def request_time() -> Column:
    return F.lit(derived.AS_OF).cast("timestamp")


def history_day() -> Column:
    return F.lit(derived.HISTORY_AS_OF).cast("date")


# -- requests ---------------------------------------------------------------


@query
def requests_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _normalised(named_requests(spark, sf_dir))


def _normalised(named: DataFrame) -> DataFrame:
    game, platform, ip = F.col("game"), F.col("platform"), F.col("client_ip")
    return named.select(
        "request_id", "game", "platform", "client_ip", "is_local",
        rq.result_key(game, platform).alias("result_key"),
        rq.cooldown_key(ip, game, platform).alias("cooldown_key"),
    )


@query
def requests_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rq.rejected(derived.requests(spark, sf_dir)).select("request_id", "status")


@query
def requests_on_platforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.on_enabled_platforms(named_requests(spark, sf_dir), platform_dimension(spark)).select(
        "request_id", "platform", "name", "short_name"
    )


# -- landed files, through the readers --------------------------------------


@query
def requests_from_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.requests(spark, sf_dir).withColumn("platforms", F.array("body_platform"))
    path = sinks.write_json(rows.select(*schemas.REQUESTS.names), new_path(spark, "requests-json"))
    return _normalised(rq.accepted(readers.read_requests(spark, path, "json")))


@query
def stats_from_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statistics file in source order; the first row of a publisher counts."""
    rows = derived.publisher_stats(spark, sf_dir).orderBy("ordinal").select(*schemas.PUBLISHER_STATS.names)
    path = new_path(spark, "stats-csv")
    rows.write.option("header", True).csv(path)
    return _shown_statistics(publishers.first_match(readers.read_publisher_stats(spark, path), "primary_publisher"))


@query
def appearances_from_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "appearances-csv")
    derived.appearances(spark, sf_dir).write.option("header", True).csv(path)
    return _shown_history(history.history_summary(readers.read_appearances(spark, path)))


@query
def catalogue_from_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = sinks.write_json(derived.catalogue(spark, sf_dir), new_path(spark, "catalogue-json"))
    return _shown_catalogue(cat.enrich(readers.read_catalogue(spark, path)))


# -- votes and stored results -----------------------------------------------


def _shown_votes(votes: DataFrame) -> DataFrame:
    return votes.select("request_id", "client_ip", "game", "platform")


@query
def votes_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown_votes(demand.accepted_votes(vote_events(spark, sf_dir)))


@query
def votes_accepted_in_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same result through the way for very large keys."""
    events = vote_events(spark, sf_dir)
    return _shown_votes(demand.accepted_votes(events, hot_rows=CELL_ROWS // 5, bands=CELL_BANDS))


def _cache_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named_requests(spark, sf_dir).select("request_id", "ts", "game_key", "platform", "outcome")


@query
def cache_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = demand.with_outcome_source(_cache_events(spark, sf_dir))
    return decided.select("request_id", "source", "stored_by")


@query
def cache_outcome_in_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same result through the way for very large keys."""
    decided = demand.with_outcome_source(_cache_events(spark, sf_dir), hot_rows=CELL_ROWS, bands=CELL_BANDS)
    return decided.select("request_id", "source", "stored_by")


# -- leaderboards -----------------------------------------------------------


@query
def leaderboard_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaderboard.leaderboard(board(spark, sf_dir)).drop("breakdown")


@query
def leaderboard_platform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaderboard.leaderboard(board(spark, sf_dir), "epic").drop("breakdown")


@query
def leaderboard_all_platforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaderboard.platform_boards(board(spark, sf_dir), platform_dimension(spark))


@query
def leaderboard_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A board from the votes of the first half of the requests plus the counts of the second half."""
    votes = demand.accepted_votes(pipeline.voting(named_requests(spark, sf_dir)))
    path = sinks.write_snapshot(votes.select("game", "platform", "ts"), new_path(spark, "votes"))
    votes = spark.read.parquet(path)
    later = F.col("ts") >= F.lit(derived.BATCH_FROM).cast("timestamp")
    return leaderboard.merge_counts(leaderboard.vote_counts(votes.where(~later)), leaderboard.vote_counts(votes.where(later)))


# -- snapshots --------------------------------------------------------------


def _stored_rows(requests: DataFrame) -> DataFrame:
    return requests.where(F.col("outcome") == "ok").select(
        rq.result_key(F.col("game"), F.col("platform")).alias("key"),
        F.to_json(F.struct("request_id")).alias("data"),
        F.col("ts").alias("created_at"),
    )


@query
def cache_upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of the first half of the requests, overwritten by those of the second."""
    rows = _stored_rows(named_requests(spark, sf_dir))
    later = F.col("created_at") >= F.lit(derived.BATCH_FROM).cast("timestamp")
    snapshot = snapshots.BucketedSnapshot(new_path(spark, "cache"), LOOKUP_BUCKETS)
    snapshot.start(spark)
    snapshot.upsert(rows.where(~later))
    snapshot.upsert(rows.where(later))
    return snapshot.read(spark).select("key", "data", micros("created_at", "created_us"))


@query
def cache_expire(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = snapshots.surviving(derived.cache(spark, sf_dir), request_time())
    return kept.select("key", "data", micros("created_at", "created_us"))


@query
def cache_expire_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = snapshots.expiry_summary(derived.cache(spark, sf_dir), request_time())
    return summary.select("success", "message", "deleted", micros("timestamp", "at_us"))


@query
def cache_lookup_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests answered from a stored snapshot, all at one moment."""
    asked = named_requests(spark, sf_dir).select(
        "request_id", rq.result_key(F.col("game"), F.col("platform")).alias("result_key")
    )
    # the answer is made once per stored result, not once per request
    stored = (
        derived.cache(spark, sf_dir)
        .where(F.col("key").startswith(rq.RESULT_PREFIX + ":"))
        .withColumn("data", scoring.with_source(F.col("data"), F.lit(demand.HIT)))
    )
    stored = snapshots.write_for_lookup(stored, LOOKUP_BUCKETS)
    found = snapshots.lookup(asked, "result_key", stored, request_time(), demand.RESULT_TTL_US)
    return found.select("request_id", "result_key", "fresh", F.when(F.col("fresh"), F.col("data")).alias("response"))


@query
def cooldown_lookup_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remote requests against the recorded votes, all at one moment: which would be blocked."""
    asked = named_requests(spark, sf_dir).where(~F.col("is_local")).select(
        "request_id",
        rq.cooldown_key(F.col("client_ip"), F.col("game"), F.col("platform")).alias("cooldown_key"),
    )
    stored = derived.cache(spark, sf_dir).where(F.col("key").startswith(rq.COOLDOWN_PREFIX + ":"))
    stored = snapshots.write_for_lookup(stored, LOOKUP_BUCKETS)
    found = snapshots.lookup(asked, "cooldown_key", stored, request_time(), demand.COOLDOWN_US)
    return found.select("request_id", "cooldown_key", F.col("fresh").alias("blocked"))


# -- catalogue --------------------------------------------------------------


@query
def catalogue_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown_catalogue(cat.enrich(derived.catalogue(spark, sf_dir)))


def _shown_catalogue(enriched: DataFrame) -> DataFrame:
    return enriched.select(
        "game_id", "name", "publisher", "metacritic", "release_year", "release_month",
        F.array_join("platforms", ",").alias("platforms"), "image", "score_text", "released_text",
    )


@query
def manual_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed-in items next to the looked-up ones."""
    both = cat.with_manual(cat.enrich(derived.catalogue(spark, sf_dir)), derived.manual_entries(spark, sf_dir))
    return both.select("game_id", "name", "publisher", "metacritic", "platforms", "released_text").withColumn(
        "platforms", F.array_join("platforms", ",")
    )


def _search_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return derived.title_queries(spark, sf_dir), derived.titles(spark, sf_dir)


@query
def title_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return titles.title_candidates(*_search_tables(spark, sf_dir))


@query
def title_candidates_hot_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same result through the way for very common words."""
    return titles.title_candidates(*_search_tables(spark, sf_dir), hot_pairs=FEW_PAIRS)


# -- publishers and history -------------------------------------------------


@query
def publisher_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = publishers.publisher_statistics(
        derived.appearances(spark, sf_dir), cat.enrich(derived.catalogue(spark, sf_dir)), ["publisher", "platform"]
    )
    return built.select(
        "publisher", "platform", "games_count", six("avg_wait_days"), six("avg_score"), six("consistency")
    )


@query
def publisher_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown_statistics(publishers.first_match(derived.publisher_stats(spark, sf_dir), "primary_publisher"))


def _shown_statistics(first: DataFrame) -> DataFrame:
    return first.select("primary_publisher", six("avg_days_to_epic"), "games_count", six("avg_metacritic"))


@query
def publisher_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publishers.label_codes(derived.publisher_labels(derived.publisher_stats(spark, sf_dir)))


@query
def title_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same coding over a label set that grows with the data."""
    names = derived.catalogue(spark, sf_dir).select(F.col("name").alias("label"))
    return publishers.label_codes(names)


@query
def appearance_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.appearance_gaps(derived.appearances(spark, sf_dir)).withColumn(
        "appeared_on", F.col("appeared_on").cast("string")
    )


@query
def history_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown_history(history.history_summary(derived.appearances(spark, sf_dir)))


def _shown_history(summary: DataFrame) -> DataFrame:
    return summary.select(
        "game_id", "platform", "occurrences", F.col("last_on").cast("string").alias("last_on"), six("mean_gap_days")
    )


def _items_on_platforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every catalogue item once per service; the services are a fixed handful."""
    services = F.array(*[F.lit(p) for p in ("epic", "gamepass", "psplus", "humble")])
    return cat.enrich(derived.catalogue(spark, sf_dir)).select(
        "game_id", F.explode(services).alias("platform"), "publisher", "metacritic", "released"
    )


@query
def never_appeared(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items_on_platforms(spark, sf_dir).select("game_id", "platform")
    return history.never_appeared(items, derived.appearances(spark, sf_dir))


@query
def already_appeared(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items_on_platforms(spark, sf_dir).select("game_id", "platform")
    return history.already_appeared(items, derived.appearances(spark, sf_dir))


# -- estimates --------------------------------------------------------------


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue items with their score as recorded, zero included."""
    enriched = cat.first_publisher(F.col("publishers"))
    return derived.catalogue(spark, sf_dir).select(
        F.col("id").alias("game_id"),
        "name",
        enriched.alias("publisher"),
        F.col("metacritic").alias("metacritic_score"),
        cat.release_year(F.col("released")).alias("release_year"),
        cat.release_month(F.col("released")).alias("release_month"),
    )


def _features(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    stats, codes = statistics(spark, sf_dir)
    return scoring.feature_rows(_items(spark, sf_dir), stats, codes), stats


@query
def feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = ("metacritic_filled", "avg_days_to_epic", "publisher_speed_score")
    features, _ = _features(spark, sf_dir)
    return features.select(
        "game_id", "path", *[six(c) if c in measured else F.col(c) for c in scoring.FEATURES]
    )


@query
def estimate_postprocessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result rows with the publisher's mean wait in place of a model."""
    features, stats = _features(spark, sf_dir)
    return scoring.estimates(features, stats, F.col("avg_days_to_epic")).select(
        "game_id", "name", "publisher", six("predicted_years"), "years_whole", "months_whole",
        six("lower_bound_years"), six("upper_bound_years"), "sentence", "publisher_game_count",
    )


@query
def estimate_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six sent fields, through JSON text and back."""
    features, stats = _features(spark, sf_dir)
    rows = scoring.as_json(scoring.estimates(features, stats, F.col("avg_days_to_epic")))
    schema = (
        "predicted_years double, years_whole int, months_whole int, lower_bound_years double, "
        "upper_bound_years double, sentence string"
    )
    parsed = rows.select("game_id", F.from_json("result", schema).alias("r")).select("game_id", "r.*")
    return parsed.select(
        "game_id", six("predicted_years"), "years_whole", "months_whole",
        six("lower_bound_years"), six("upper_bound_years"),
        without_bold_marks(F.col("sentence")).alias("sentence"),
    )


SERVICES = ["epic", "gamepass", "psplus", "humble"]


def _epic_trees(spark: SparkSession, sf_dir: str, features: DataFrame) -> DataFrame:
    """The first service's model, whose statistics are those of the feature rows, as node rows."""
    seen = history.item_histories(derived.appearances(spark, sf_dir).where(F.col("platform") == "epic"))
    first = publishers.first_waits(seen, cat.enrich(derived.catalogue(spark, sf_dir)))
    return model.fit_trees(features.join(first.select("game_id", "wait_days").hint("merge"), "game_id"))


@query
def estimate_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted and scored by a model of the first service; the statistics are of that service."""
    features, stats = _features(spark, sf_dir)
    days = model.days_column(_epic_trees(spark, sf_dir, features))
    scored = features.withColumn("predicted_days", days)
    return scoring.estimates(scored, stats, F.col("predicted_days")).select(
        "game_id", "path", six("predicted_days"), six("predicted_years"), "years_whole", "months_whole",
        six("lower_bound_years"), six("upper_bound_years"), "sentence",
    )


@query
def model_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of four models, one per service, on items that they have not seen, beside those of the publisher's mean."""
    histories, _ = _histories(spark, sf_dir)
    first = publishers.first_waits(histories, cat.enrich(derived.catalogue(spark, sf_dir)))
    found = model.held_out_errors(_items(spark, sf_dir), first, SERVICES)
    return found.select("platform", "items", "not_scored", six("model_error"), six("mean_error"))


@query
def tiered_estimate_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiers whose model tier reads the written predictions of four models; the mean wait only where there is none."""
    histories, stats = _histories(spark, sf_dir)
    first = publishers.first_waits(histories, cat.enrich(derived.catalogue(spark, sf_dir)))
    predicted = model.wait_predictions(_items(spark, sf_dir), first, SERVICES)
    items = _items_on_platforms(spark, sf_dir).join(predicted.hint("merge"), ["game_id", "platform"], "left")
    rows = tiers.tiered_estimates(
        items, history.summary_of(histories), stats, derived.first_party(spark, sf_dir), history_day(),
        predicted_days=F.coalesce("predicted_days", "avg_wait_days"),
    )
    return rows.select("game_id", "platform", "tier", "category", six("predicted_total_days"), six("predicted_months"), "sample_size")


@query
def request_pipeline_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole flow with a fitted model's answers to the misses."""
    stats, codes = statistics(spark, sf_dir)
    days = model.days_column(_epic_trees(spark, sf_dir, scoring.feature_rows(_items(spark, sf_dir), stats, codes)))
    return _shown_answers(pipeline.responses(derived.requests(spark, sf_dir), stats, codes, days=days))


def _histories(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Item histories, written once, and the statistics per publisher and service that are built on them."""
    found = history.item_histories(derived.appearances(spark, sf_dir))
    found = spark.read.schema(found.schema).parquet(sinks.write_snapshot(found, new_path(spark, "histories")))
    first = publishers.first_waits(found, cat.enrich(derived.catalogue(spark, sf_dir)))
    return found, publishers.statistics_of(publishers.wait_moments(first, ["publisher", "platform"]))


@query
def tiered_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    histories, stats = _histories(spark, sf_dir)
    measured = (
        "theoretical_wait_time", "predicted_total_days", "publisher_avg_wait_days", "predicted_months",
        "publisher_consistency",
    )
    rows = tiers.tiered_estimates(
        _items_on_platforms(spark, sf_dir), history.summary_of(histories), stats,
        derived.first_party(spark, sf_dir), history_day(),
    )
    return rows.select(*[six(c) if c in measured else F.col(c) for c in rows.columns])


# -- the whole flow ---------------------------------------------------------


@query
def request_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats, codes = statistics(spark, sf_dir)
    answers = pipeline.responses(derived.requests(spark, sf_dir), stats, codes)
    return _shown_answers(answers)


def _shown_answers(answers: DataFrame) -> DataFrame:
    return answers.select(
        "request_id", "status", "game", "platform", "source", "stored_by", six("predicted_years"),
        "years_whole", "months_whole", "sentence", "voted",
    )


def _two_batches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, pipeline.FlowState]:
    """The requests of the first half, then those of the second on the state that the first left."""
    stats, codes = statistics(spark, sf_dir)
    requests = derived.requests(spark, sf_dir)
    later = F.coalesce(F.col("ts") >= F.lit(derived.BATCH_FROM).cast("timestamp"), F.lit(False))
    first, state = pipeline.answer_batch(requests.where(~later), stats, codes)
    second, state = pipeline.answer_batch(requests.where(later), stats, codes, state)
    return first.unionByName(second), state


@query
def request_pipeline_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers, _ = _two_batches(spark, sf_dir)
    return _shown_answers(answers)


@query
def request_pipeline_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, state = _two_batches(spark, sf_dir)
    return state.board


@query
def request_pipeline_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored results after both batches."""
    _, state = _two_batches(spark, sf_dir)
    return state.results.select("game_key", "platform", "id", "at_us", six("predicted_years"), "sentence")


# -- streams ----------------------------------------------------------------


def _request_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = derived.table(spark, sf_dir, "events").schema
    # the pattern takes a single file as well as a folder of part files
    events = spark.readStream.schema(schema).option("maxBytesPerTrigger", 64 << 30).parquet(f"{sf_dir}/events.parquet*")
    return derived.requests_from_events(events)


@query
def stream_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = _request_stream(spark, sf_dir)
    columns = ["request_id", "client_ip", "game", "platform"]
    remote = live.run_to_files(live.live_votes(requests).select(*columns), "votes")
    local = live.run_to_files(live.live_local_votes(requests).select(*columns), "local-votes")
    return remote.unionByName(local)


@query
def stream_votes_in_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same votes, micro-batch by micro-batch through the way for very large keys."""
    requests = _request_stream(spark, sf_dir)
    keys = ["client_ip", "game_key", "platform"]
    judged = live.run_openers_by_batch(
        live.vote_events(requests), keys, demand.COOLDOWN_US, hot_rows=CELL_ROWS // 5, bands=CELL_BANDS
    )
    columns = ["request_id", "client_ip", "game", "platform"]
    remote = judged.where(F.col("opener_id") == F.col("request_id")).select(*columns)
    return remote.unionByName(live.run_to_files(live.live_local_votes(requests).select(*columns), "local-votes"))


@query
def stream_cache_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = live.live_outcome_source(_request_stream(spark, sf_dir))
    return live.run_to_files(decided.select("request_id", "source", "stored_by"), "sources")


@query
def stream_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream's board: what was answered with a result, then who may vote, then counts, batch by batch."""
    stats, codes = statistics(spark, sf_dir)
    return live.run_requests_to_board(_request_stream(spark, sf_dir), stats, codes)


@query
def stream_cache_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = rq.accepted(_request_stream(spark, sf_dir))
    return live.run_to_cache(_stored_rows(requests), buckets=LOOKUP_BUCKETS).select("key", "data", micros("created_at", "created_us"))
