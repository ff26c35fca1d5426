"""Operators on small literal tables."""

import json
import random
from collections import Counter
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from shelfcast.operators import catalogue as cat
from shelfcast.operators import demand, history, leaderboard, model, publishers, scoring, snapshots, tiers, titles
from shelfcast.operators import requests as rq
from shelfcast.plans import pipeline
from shelfcast.sources import derived
from shelfcast.sources.readers import platform_dimension

REQUEST = (
    "request_id bigint, ts timestamp, query_game string, query_platform string, body_game_name string, "
    "body_platform string, forwarded_for string, remote_addr string, publisher string, metacritic_score double, "
    "release_date date, outcome string"
)


def request(row_id, minute, game="G", platform="epic", ip="9.9.9.9", outcome="ok", publisher="P"):
    at = datetime(2024, 1, 1 + minute // 1440, minute % 1440 // 60, minute % 60)
    return (row_id, at, game, platform, None, None, ip, "127.0.0.1", publisher, 70.0, date(2020, 1, 1), outcome)


def requests(spark, *rows):
    return spark.createDataFrame(list(rows), REQUEST)


# -- requests and votes -----------------------------------------------------


def test_query_text_comes_before_body(spark):
    rows = [
        (1, datetime(2024, 1, 1), "", None, "Body", "psplus", None, None, None, None, None, None),
        (2, datetime(2024, 1, 1), "Query", "", "Body", "", None, None, None, None, None, None),
        (3, datetime(2024, 1, 1), None, "epic", "", None, None, None, None, None, None, None),
    ]
    df = requests(spark, *rows)
    named = {r.request_id: (r.game, r.platform, r.game_key) for r in rq.accepted(df).collect()}
    assert named == {1: ("Body", "psplus", "body"), 2: ("Query", "any", "query")}
    assert [(r.request_id, r.status) for r in rq.rejected(df).collect()] == [(3, 400)]


def test_votes_share_a_cooldown_across_case_but_count_apart(spark):
    df = rq.accepted(
        requests(
            spark,
            request(1, 0, "Game"),
            request(2, 30, "GAME"),  # blocked: same key
            request(3, 60, "GAME"),  # exactly an hour after the last vote
            request(4, 30, "Game", platform="psplus"),
            request(5, 30, "Game", ip="9.9.9.8"),
            request(6, 31, "Game", ip=None),  # local: always, without a cooldown
            request(7, 32, "Game", ip=None),
        )
    )
    votes = demand.accepted_votes(df)
    assert sorted(r.request_id for r in votes.collect()) == [1, 3, 4, 5, 6, 7]
    counts = {(r.game, r.platform): r.score for r in leaderboard.vote_counts(votes).collect()}
    assert counts == {("Game", "epic"): 4, ("GAME", "epic"): 1, ("Game", "psplus"): 1}


def test_cache_outcomes(spark):
    day = 1440
    df = rq.accepted(
        requests(
            spark,
            request(1, 0, outcome="soft_error"),  # answered, not stored
            request(2, 1, outcome="fail"),
            request(3, 2),  # stored
            request(4, 3, outcome="fail"),  # a hit never reaches the back end
            request(5, day + 1),  # a hit does not renew
            request(6, day + 2, outcome="fail"),  # exactly a day later: expired
            request(7, day + 3),
            request(8, day + 4, "g"),
            request(9, day + 4, platform="EPIC"),  # the platform keeps its case
        )
    )
    found = {r.request_id: (r.source, r.stored_by) for r in demand.with_outcome_source(df).collect()}
    assert found == {
        1: ("cache_miss", None),
        2: ("error", None),
        3: ("cache_miss", 3),
        4: ("cache_hit", 3),
        5: ("cache_hit", 3),
        6: ("error", None),
        7: ("cache_miss", 7),
        8: ("cache_hit", 7),
        9: ("cache_miss", 9),
    }


# -- leaderboards -----------------------------------------------------------


def board(spark, rows):
    return spark.createDataFrame(rows, "game string, platform string, score bigint")


def test_boards(spark):
    rows = [(f"g{i:02}", p, i % 7 + n) for i in range(30) for n, p in enumerate(["epic", "any", "x"])]
    df = board(spark, rows)
    totals = Counter()
    for game, _, score in rows:
        totals[game] += score
    want = sorted(totals, key=lambda g: (-totals[g], g))[:10]
    top = leaderboard.leaderboard(df).orderBy("rank").collect()
    assert [r.game for r in top] == want
    assert [r["rank"] for r in top] == list(range(1, 11))
    assert all(sum(r.breakdown.values()) == r.score == totals[r.game] for r in top)
    assert {r.platform for r in top} == {"Global"}
    one = leaderboard.leaderboard(df, "x").orderBy("rank").collect()
    assert [r.game for r in one] == sorted({g for g, _, _ in rows}, key=lambda g: (-(int(g[1:]) % 7), g))[:10]
    assert {(r.platform, r.breakdown, r.breakdown_text) for r in one} == {("x", None, "")}
    every = leaderboard.platform_boards(df, platform_dimension(spark)).collect()
    assert [r.game for r in sorted(every, key=lambda r: r["rank"])] == [r.game for r in one]
    assert {(r.platform, r.short_name) for r in every} == {("epic", "Epic")}


@pytest.mark.parametrize("name", [None, "", "all", "global"])
def test_global_scope(spark, name):
    df = board(spark, [("a", "epic", 1), ("a", "any", 2)])
    (row,) = leaderboard.leaderboard(df, name).collect()
    assert (row.platform, row.score, row.breakdown) == (name or "Global", 3, {"any": 2, "epic": 1})
    assert row.breakdown_text == "any: 2, Epic: 1"


def test_merged_counts(spark):
    merged = leaderboard.merge_counts(board(spark, [("a", "p", 2)]), board(spark, [("a", "p", 3), ("b", "p", 1)]))
    assert {(r.game, r.score) for r in merged.collect()} == {("a", 5), ("b", 1)}


# -- snapshots --------------------------------------------------------------

CACHE = "key string, data string, created_at timestamp"


def test_upsert_takes_the_batch_and_its_newest(spark):
    snapshot = spark.createDataFrame([("a", "old", datetime(2024, 1, 9)), ("b", "kept", datetime(2024, 1, 1))], CACHE)
    batch = spark.createDataFrame(
        [("a", "1", datetime(2024, 1, 2)), ("a", "2", datetime(2024, 1, 3)), ("c", "new", datetime(2024, 1, 1))], CACHE
    )
    found = {(r.key, r.data) for r in snapshots.upsert(snapshot, batch).collect()}
    assert found == {("a", "2"), ("b", "kept"), ("c", "new")}


def test_expiry_is_strict_and_whole(spark):
    as_of = F.lit("2024-01-03 00:00:00").cast("timestamp")
    rows = [("day", "", datetime(2024, 1, 2)), ("older", "", datetime(2024, 1, 1, 23, 59, 59)), ("new", "", datetime(2024, 1, 3))]
    kept, summary = snapshots.expire(spark.createDataFrame(rows, CACHE), as_of)
    assert {r.key for r in kept.collect()} == {"day", "new"}
    (row,) = summary.collect()
    assert (row.success, row.message, row.deleted) == (True, "Deleted 1 expired entries", 1)


def test_lookup_reads_a_doubled_key_as_absent(spark):
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    stored = spark.createDataFrame(
        [
            ("one", "{}", datetime(2024, 1, 1, 0, 0, 1)),
            ("day", "{}", datetime(2024, 1, 1)),
            ("two", "{}", datetime(2024, 1, 2)),
            ("two", "{}", datetime(2024, 1, 2)),
        ],
        CACHE,
    )
    asked = spark.createDataFrame([("one",), ("day",), ("two",), ("none",)], "k string")
    found = {r.k: r.fresh for r in snapshots.lookup(asked, "k", stored, now, demand.RESULT_TTL_US).collect()}
    assert found == {"one": True, "day": False, "two": False, "none": False}


# -- catalogue and titles ---------------------------------------------------


def test_manual_records_need_both_texts(spark):
    typed = spark.createDataFrame([(" A ", "P"), ("  ", "P"), ("B", ""), ("C", None)], "name string, publisher string")
    (row,) = cat.enrich_manual(typed).collect()
    assert (row.name, row.publisher, row.metacritic, row.released, row.platforms) == (" A ", "P", 75.0, None, None)
    assert (row.image, row.score_text, row.released_text) == ("", "75", "Unknown")


def test_enabled_platforms_only(spark):
    dimension = platform_dimension(spark).withColumn("enabled", F.col("platform") != "humble")
    rows = spark.createDataFrame([("epic",), ("humble",), ("any",)], "platform string")
    assert [r.short_name for r in cat.on_enabled_platforms(rows, dimension).collect()] == ["Epic"]


def search_by_loop(queries, listed, size=5):
    found = set()
    for query_id, query in queries:
        asked = set(query.lower().split())
        scored = []
        for game_id, name in listed:
            words = set(name.lower().split())
            if asked & words:
                scored.append((-len(asked & words), len(words), len(name), game_id, name))
        for rank, (shared, _, _, game_id, name) in enumerate(sorted(scored)[:size], 1):
            found.add((query_id, rank, game_id, name, -shared))
    return found


@pytest.mark.parametrize("hot_pairs", [0, 5, 60, 400, 10**9])
def test_title_search_matches_loop(spark, hot_pairs):
    rnd = random.Random(11)
    # a few words make up most titles
    vocabulary = ["the"] * 12 + ["of"] * 6 + ["war", "star", "king"] * 3 + [f"w{i}" for i in range(25)]
    listed = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(1, 5)))) for i in range(250)]
    queries = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(1, 4))).upper()) for i in range(60)]
    queries += [(60, "   "), (61, "nothing alike"), (62, " the   THE of "), (63, "the of war star king")]
    found = titles.title_candidates(
        spark.createDataFrame(queries, "query_id bigint, query string"),
        spark.createDataFrame(listed, "game_id bigint, name string"),
        hot_pairs=hot_pairs,
    ).collect()
    assert {tuple(r) for r in found} == search_by_loop(queries, listed)
    assert len(found) == len({(r.query_id, r["rank"]) for r in found})


# -- publishers, history, estimates -----------------------------------------

STATS = "ordinal bigint, primary_publisher string, avg_days_to_epic double, games_count bigint, avg_metacritic double"


def test_first_match_and_fallback(spark):
    stats = spark.createDataFrame(
        [(2, "A", 100.0, 2, 60.0), (1, "A", 200.0, 1, 70.0), (3, "B", None, 3, 80.0), (4, "C", 600.0, 4, 90.0)], STATS
    )
    first = {r.primary_publisher: r.avg_days_to_epic for r in publishers.first_match(stats, "primary_publisher").collect()}
    assert first == {"A": 200.0, "B": None, "C": 600.0}
    # over all rows of the file, nulls skipped
    assert spark.range(1).select(publishers.fallback_mean(stats).alias("m")).first().m == 300.0


def test_label_codes_over_many_partitions(spark):
    labels = [f"p{i * 7919 % 5000:04}" for i in range(5000)] + [None, "p0001", "Ünicode", ""]
    df = spark.createDataFrame([(x,) for x in labels], "label string").repartition(16)
    found = {r.label: r.code for r in publishers.label_codes(df).collect()}
    want = sorted({x for x in labels if x is not None}, key=lambda x: x.encode())
    assert found == {x: i for i, x in enumerate(want)}


def test_statistics_of_two_batches_are_those_of_one_run(spark):
    rnd = random.Random(4)
    rows = [(f"p{rnd.randint(0, 6)}", "epic", rnd.randint(-50, 900), rnd.choice([None, 0.0, 70.5, 91.0])) for _ in range(200)]
    rows += [("lone", "epic", 5, None), ("late", "psplus", 7, 3.0)]
    first = spark.createDataFrame(rows, "publisher string, platform string, wait_days int, metacritic double").withColumn("n", F.monotonically_increasing_id())
    by = ["publisher", "platform"]
    whole = publishers.statistics_of(publishers.wait_moments(first, by))
    parts = [publishers.wait_moments(first.where(F.col("publisher").isin("p1", "late") == late), by) for late in (True, False)]
    parts2 = [publishers.wait_moments(first.where(F.col("n") % 2 == i), by) for i in (0, 1)]
    for a, b in (parts, parts2):
        merged = publishers.statistics_of(publishers.merge_moments(a, b, by))
        got = {(r.publisher, r.platform): r for r in merged.collect()}
        assert len(got) == whole.count()
        for r in whole.collect():
            other = got[r.publisher, r.platform]
            assert other.games_count == r.games_count
            for c in ("avg_wait_days", "avg_score", "consistency"):
                assert (other[c] is None) == (r[c] is None) and (r[c] is None or abs(other[c] - r[c]) < 1e-9)


def test_consistency_needs_two_waits(spark):
    seen = spark.createDataFrame([(1, "epic", date(2020, 1, 11)), (2, "epic", date(2020, 1, 31)), (3, "epic", date(2020, 1, 5))], "game_id bigint, platform string, appeared_on date")
    items = spark.createDataFrame(
        [(1, "A", date(2020, 1, 1), 60.0), (2, "A", date(2020, 1, 1), None), (3, "B", date(2020, 1, 1), 70.0)],
        "game_id bigint, publisher string, released date, metacritic double",
    )
    rows = {r.publisher: r for r in publishers.publisher_statistics(seen, items, ["publisher"]).collect()}
    assert (rows["A"].games_count, rows["A"].avg_wait_days, rows["A"].avg_score) == (2, 20.0, 60.0)
    assert rows["A"].consistency == pytest.approx(200**0.5 / 20)
    assert rows["B"].consistency is None


def test_history(spark):
    days = [date(2020, 1, 1), date(2020, 1, 11), date(2020, 1, 11), date(2020, 3, 1)]
    seen = spark.createDataFrame([(1, "epic", d) for d in days] + [(2, "epic", days[0])], "game_id bigint, platform string, appeared_on date")
    summary = {r.game_id: r for r in history.history_summary(seen).collect()}
    assert (summary[1].occurrences, summary[1].last_on, summary[1].mean_gap_days) == (3, date(2020, 3, 1), 30.0)
    assert (summary[2].occurrences, summary[2].mean_gap_days) == (1, None)
    gaps = [r.gap_days for r in history.appearance_gaps(seen).where("game_id = 1").orderBy("appeared_on").collect()]
    assert gaps == [None, 10, 50]
    items = spark.createDataFrame([(1, "epic"), (1, "humble"), (3, "epic")], "game_id bigint, platform string")
    assert {tuple(r) for r in history.never_appeared(items, seen).collect()} == {(1, "humble"), (3, "epic")}
    assert {tuple(r) for r in history.already_appeared(items, seen).collect()} == {(1, "epic")}


def estimate(spark, publisher="A", score=None, name="N", days=None):
    stats = spark.createDataFrame([(1, "A", 730.0, 1, 71.25), (2, "B", 365.0, 2, None), (3, "C", 365.0, 2, 60.0)], STATS)
    codes = spark.createDataFrame([("A", 0), ("B", 1)], "label string, code bigint")
    items = spark.createDataFrame(
        [(name, publisher, score, 2020, 5)],
        "name string, publisher string, metacritic_score double, release_year int, release_month int",
    )
    features = scoring.feature_rows(items, stats, codes)
    predicted = F.col("avg_days_to_epic") if days is None else F.lit(days)
    (row,) = scoring.estimates(features, stats, predicted).collect()
    return row


def test_estimate_of_a_known_publisher(spark):
    row = estimate(spark, score=80.0)
    assert [row[c] for c in scoring.FEATURES] == [80.0, 1, 2020, 5, 1, 1, 1, 730.0, 0.5, 0]
    assert (row.path, row.predicted_years, row.years_whole, row.months_whole) == ("known", 2.0, 2, 0)
    assert (row.lower_bound_years, row.upper_bound_years) == (1.7, 2.3)
    assert row.sentence == (
        "Based on the publisher 'A', which has released 1 game on Epic Games Store with an average wait time of "
        "2 years and 0 months (averaging a Metacritic score of 71.3), and considering 'N' with a Metacritic score "
        "of 80, the model estimates it will appear free on Epic Games Store approximately 2 years and 0 months "
        "after release, with a confidence interval between 1.7 and 2.3 years."
    )


def test_score_of_zero_counts_and_a_missing_one_is_filled(spark):
    assert (estimate(spark, score=0.0).metacritic_filled, estimate(spark, score=0.0).has_metacritic) == (0.0, 1)
    assert (estimate(spark).metacritic_filled, estimate(spark).has_metacritic) == (71.25, 0)


def test_estimate_of_an_unknown_publisher(spark):
    row = estimate(spark, "Z")
    assert (row.path, row.lower_bound_years, row.upper_bound_years, row.publisher_game_count) == ("unknown", 0.0, 0.0, 0)
    assert (row.years_whole, row.months_whole) == (1, 4)
    assert row.sentence == (
        "Based on the publisher 'Z', which has no historical data in our Epic Games dataset, we cannot make a "
        "reliable prediction. Industry average suggests approximately 1 years and 4 months."
    )
    assert "'None'" in estimate(spark, None).sentence


def test_a_publisher_without_a_code_fails(spark):
    row = estimate(spark, "C")
    assert (row.path, row.predicted_years, row.sentence) == ("failed", None, None)


def test_small_predictions_cross_their_bounds(spark):
    row = estimate(spark, days=7.3)
    assert row.lower_bound_years == 0.1 > row.upper_bound_years


def test_json_result_and_source(spark):
    df = spark.createDataFrame([(2.5, 2, 6, 2.1, 2.9, "s")], "predicted_years double, years_whole int, months_whole int, lower_bound_years double, upper_bound_years double, sentence string")
    text = scoring.as_json(df).first().result
    assert text == (
        '{"predicted_years":2.5,"years_whole":2,"months_whole":6,"lower_bound_years":2.1,"upper_bound_years":2.9,"sentence":"s"}'
    )
    stored = spark.createDataFrame([('{"a":{"b":[1,2.5,null]},"source":"old"}',), ('{"a":2}',), (None,)], "data string")
    found = stored.select(scoring.with_source(F.col("data"), F.lit("cache_hit")).alias("x"))
    assert [r.x for r in found.collect()] == [
        '{"a":{"b":[1,2.5,null]},"source":"cache_hit"}', '{"a":2,"source":"cache_hit"}', None
    ]


def service_rows(spark):
    """Items of a few publishers, one of them without any score, with waits on two services."""
    items = spark.range(400).select(
        F.col("id").alias("game_id"),
        F.element_at(F.array(*map(F.lit, ["A", "B", "Scoreless", "Rare"])), F.when(F.col("id") == 7, 4).otherwise((F.col("id") % 3 + 1)).cast("int")).alias("publisher"),
        F.when((F.col("id") % 3 != 2) & (F.col("id") % 5 != 0), 50.0 + F.col("id") % 40).alias("metacritic_score"),
        (2000 + F.col("id") % 20).cast("int").alias("release_year"),
        (1 + F.col("id") % 12).cast("int").alias("release_month"),
    )
    year, late = F.col("release_year"), F.when(F.col("metacritic_score").isNull(), 500).otherwise(0)
    waits = items.where("game_id % 7 <> 0 OR game_id = 7").select(
        "game_id", "publisher", F.col("metacritic_score").alias("metacritic"), ((year - 1990) * 10 + late).cast("int").alias("wait_days")
    )
    first = waits.withColumn("platform", F.lit("epic")).unionByName(
        waits.withColumn("platform", F.lit("humble")).withColumn("wait_days", F.col("wait_days") + 5000)
    )
    return items, first


def test_a_model_per_service_as_a_column_and_as_sql(spark, tmp_path):
    import duckdb

    items, first = service_rows(spark)
    codes = publishers.label_codes(first.select(F.col("publisher").alias("label")))
    features = model.service_features(items, first, codes, "epic")
    waited = first.where("platform = 'epic'").select("game_id", "wait_days")
    nodes = model.fit_trees(features.join(waited, "game_id"), rounds=3, depth=3)
    assert nodes.where("left >= 0").count() > 0
    rows = features.select("game_id", "path", *scoring.FEATURES, model.days_column(nodes).alias("days"))
    rows.coalesce(1).write.parquet(str(tmp_path / "rows"))
    told = duckdb.sql(f"SELECT days, {model.days_sql(nodes)} AS again FROM '{tmp_path}/rows/*.parquet'").fetchall()
    assert len(told) == 400 and all(a is not None and abs(a - b) < 1e-6 for a, b in told)
    # a publisher without any score is trained on and scored, and missing scores are told apart
    by = {r.game_id: r.days for r in rows.collect()}
    seen = {r.game_id: r.wait_days for r in waited.collect()}
    assert sum(abs(by[i] - seen[i]) for i in seen) / len(seen) < 100
    assert model.fit_trees(features.limit(0).withColumn("wait_days", F.lit(1))).count() == 0
    none = features.select(model.days_column(nodes.limit(0)).alias("d")).where("d IS NOT NULL")
    assert none.count() == 0


def test_predictions_and_errors_per_service(spark):
    items, first = service_rows(spark)
    found = model.wait_predictions(items, first, ["epic", "humble"], rounds=3, depth=3)
    rows = {(r.game_id, r.platform): r.predicted_days for r in found.collect()}
    assert len(rows) == 800
    assert max(rows[i, "epic"] for i in range(400)) < 1500 < 5000 < min(rows[i, "humble"] for i in range(400))
    errors = {r.platform: r for r in model.held_out_errors(items, first, ["epic", "humble"], rounds=5, depth=3).collect()}
    for r in errors.values():
        assert r["items"] + r["not_scored"] > 50 and r["model_error"] < r["mean_error"]


def test_tiers(spark):
    items = spark.createDataFrame(
        [(i, p, pub, 70.0, date(2020, 1, 1)) for i, p, pub in [
            (1, "epic", "A"), (1, "humble", "A"), (2, "epic", "A"), (3, "gamepass", "Own"), (4, "epic", "Z"), (5, "humble", "A")
        ]],
        "game_id bigint, platform string, publisher string, metacritic double, released date",
    )
    seen = spark.createDataFrame(
        [(1, "epic", date(2020, 6, 1)), (1, "epic", date(2020, 12, 1)), (1, "humble", date(2020, 6, 1)),
         (2, "epic", date(2019, 12, 1))],
        "game_id bigint, platform string, appeared_on date",
    )
    stats = spark.createDataFrame(
        [("A", "epic", 3, 800.0, 0.25), ("A", "humble", 1, 100.0, None)],
        "publisher string, platform string, games_count bigint, avg_wait_days double, consistency double",
    )
    owned = spark.createDataFrame([("Own", "gamepass")], "publisher string, platform string")
    rows = tiers.tiered_estimates(items, history.history_summary(seen), stats, owned, F.lit("2021-01-01").cast("date"))
    found = {(r.game_id, r.platform): r for r in rows.collect()}
    repeat = found[1, "epic"]
    assert (repeat.tier[0], repeat.sample_size, repeat.category) == ("A", 2, "Within 6 months")
    assert (repeat.predicted_months, repeat.projected_arrival) == (152 / 30, "2021-06-02")
    assert (repeat.recently_appeared, repeat.recent_warning) == (True, False)
    never = found[1, "humble"]
    assert (never.tier[0], never.category, never.category_band) == ("D", "Very Unlikely", "bg-gray-500")
    # one appearance gives no gap and so no wait if repeats were allowed
    assert (never.theoretical_wait_time, never.predicted_months, never.recent_warning) == (None, None, True)
    once = found[2, "epic"]
    assert (once.tier[0], once.sample_size, once.last_appearance_date) == ("B", 1, "2019-12-01")
    assert (once.predicted_total_days, once.predicted_months, once.confidence) == (800.0, 434 / 30, 75)
    assert (once.category, once.predicted_months_text, once.recently_appeared) == ("More than 12 months", "1y 2m", False)
    assert (found[3, "gamepass"].tier[0], found[3, "gamepass"].category) == ("C", "Within 12-24 months")
    unknown = found[4, "epic"]
    assert (unknown.tier[0], unknown.category, unknown.confidence, unknown.publisher_game_count) == ("B", "Unknown", 0, 0)
    text = json.loads(tiers.as_json(rows).where("game_id = 4").first().result)
    assert set(text) == {
        "category", "reasoning", "confidence", "metacritic_score_used", "publisher_game_count", "tier", "sample_size",
        "recently_appeared",
    }
    # overdue: nothing is left to wait, and nothing is shown
    overdue = found[5, "humble"]
    assert (overdue.tier[0], overdue.predicted_months, overdue.predicted_months_text) == ("B", 0.0, None)


# -- the whole flow ---------------------------------------------------------


def test_request_flow(spark):
    stats = spark.createDataFrame([(1, "P", 730.0, 3, 70.0), (2, "Broken", 100.0, 1, 50.0)], STATS)
    codes = spark.createDataFrame([("P", 0)], "label string, code bigint")
    df = requests(
        spark,
        request(1, 0),
        request(2, 10, publisher="Other"),  # a hit, whatever its own data say
        request(3, 70),
        request(4, 0, "H", outcome="soft_error"),
        request(5, 1, "H", outcome="fail"),
        request(6, 2, "H", publisher="Broken"),  # cannot be scored
        request(7, 3, "H", publisher="Other"),
        request(8, 3, ""),
    )
    for hot_rows in (1, 10**6):
        rows = {r.request_id: r for r in pipeline.responses(df, stats, codes, hot_rows).collect()}
        assert {i: (r.status, r.source, r.stored_by, r.voted) for i, r in rows.items()} == {
            1: (200, "cache_miss", 1, True),
            2: (200, "cache_hit", 1, False),
            3: (200, "cache_hit", 1, True),
            4: (200, "cache_miss", None, False),
            5: (500, "error", None, False),
            6: (500, "error", None, False),
            7: (200, "cache_miss", 7, True),
            8: (400, None, None, False),
        }
        assert rows[2].sentence == rows[1].sentence and "'P'" in rows[1].sentence
        assert rows[7].lower_bound_years == 0.0


def test_a_game_counts_once_however_often_it_returns(spark):
    days = [("2024-01-11",), ("2024-02-01",), ("2024-05-01",)]
    seen = spark.createDataFrame([(1, "epic", d) for (d,) in days], "game_id bigint, platform string, day string").select(
        "game_id", "platform", F.col("day").cast("date").alias("appeared_on")
    )
    items = spark.createDataFrame([(1, "A", "2024-01-01", 80.0)], "game_id bigint, publisher string, day string, metacritic double")
    row = publishers.publisher_statistics(seen, items.withColumn("released", F.col("day").cast("date")), ["publisher"]).first()
    assert (row.games_count, row.avg_wait_days) == (1, 10.0)


def test_spread_is_never_negative(spark):
    seen = spark.createDataFrame([(i, "epic", d) for i, d in ((1, "2023-12-01"), (2, "2023-11-01"))], "game_id bigint, platform string, day string")
    seen = seen.select("game_id", "platform", F.col("day").cast("date").alias("appeared_on"))
    items = spark.createDataFrame([(i, "A", "2024-01-01", 80.0) for i in (1, 2)], "game_id bigint, publisher string, day string, metacritic double")
    row = publishers.publisher_statistics(seen, items.withColumn("released", F.col("day").cast("date")), ["publisher"]).first()
    assert row.avg_wait_days < 0 < row.consistency


def test_retention_keeps_rows_without_a_time(spark):
    rows = spark.createDataFrame([("a", "2024-01-01"), ("b", None), ("c", "2024-01-09")], "key string, at string").select(
        "key", F.lit("{}").alias("data"), F.col("at").cast("timestamp").alias("created_at")
    )
    kept, summary = snapshots.expire(rows, F.lit("2024-01-10").cast("timestamp"))
    assert sorted(r.key for r in kept.collect()) == ["b", "c"] and summary.first().deleted == 1


def test_blanks_of_any_kind_are_no_text(spark):
    blanks = ["\t", "\n\r", "\u00a0\u3000", "\u2028", "\ufeff ", ""]
    rows = [(b, "P") for b in blanks] + [("N", b) for b in blanks] + [(" N\t", "\u00a0P")]
    found = cat.manual_records(spark.createDataFrame(rows, "name string, publisher string")).collect()
    assert [r.name for r in found] == [" N\t"]


def test_requests_without_a_time_are_refused(spark, sf_dir):
    requests = derived.requests(spark, sf_dir)
    named, refused = rq.accepted(requests), rq.rejected(requests)
    assert named.where("ts is null").count() == 0 and refused.where("ts is null").count() > 0
    assert named.count() + refused.count() == requests.count()
