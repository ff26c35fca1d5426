"""Shapes of the plans that matter at scale."""

import random
from functools import partial

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from shelfcast.operators import demand, model, snapshots, titles
from shelfcast.operators.keyed_scan import period_openers
from shelfcast.plans import queries
from shelfcast.plans.queries import REGISTRY


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


SLOW = {"estimate_model", "model_errors", "tiered_estimate_model", "request_pipeline_model", "stream_votes", "stream_votes_in_cells", "stream_cache_outcome", "stream_leaderboard", "stream_cache_upsert"}


@pytest.mark.parametrize("name", sorted(set(REGISTRY) - SLOW))
def test_no_cross_products(spark, sf_dir, name):
    text = plan(REGISTRY[name](spark, sf_dir))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text  # no row-at-a-time functions


def test_whole_keys_take_one_shuffle_and_one_sort(spark):
    events = spark.range(100).select(
        (F.col("id") % 5).alias("k"), F.col("id").alias("at_us"), "id", F.lit(True).alias("eligible")
    )
    text = plan(period_openers(events, ["k"], 10, hot_rows=None)).split("== Initial Plan ==")[0]
    assert text.count("Exchange hashpartitioning") == 1
    assert text.count("Sort [") == 1


def test_local_votes_are_not_shuffled(spark, sf_dir):
    from shelfcast.plans.queries import vote_events

    text = plan(demand.accepted_votes(vote_events(spark, sf_dir), hot_rows=None))
    assert text.count("Exchange hashpartitioning") == 1


def test_hot_words_are_not_joined_by_title(spark):
    listed = spark.range(2000).select(F.col("id").alias("game_id"), F.concat(F.lit("the w"), F.col("id").cast("string")).alias("name"))
    asked = spark.range(50).select(F.col("id").alias("query_id"), F.concat(F.lit("the x"), F.col("id").cast("string")).alias("query"))
    df = titles.title_candidates(asked, listed, hot_pairs=1000)
    assert df.count() == 250
    # tasks cut the lists of hot sets before they are shuffled
    assert plan(df).count("WindowGroupLimit") >= 3


def test_many_common_words_do_not_blow_up(spark):
    common = " ".join(f"w{i}" for i in range(30))
    listed = spark.range(1000).select(F.col("id").alias("game_id"), F.concat(F.lit(common + " t"), F.col("id").cast("string")).alias("name"))
    asked = spark.range(20).select(F.col("id").alias("query_id"), F.lit(common).alias("query"))
    found = titles.title_candidates(asked, listed, hot_pairs=500).collect()
    assert {r.query_id: r.shared for r in found} == dict.fromkeys(range(20), 30)
    assert sorted(r.game_id for r in found if r.query_id == 0) == [0, 1, 2, 3, 4]


def test_titles_of_common_words_read_few_of_all_pairs(spark):
    """Three of forty hot words a title: nearly every pair of titles shares one."""
    rnd = random.Random(2)
    rows = [(i, " ".join(rnd.sample([f"w{j}" for j in range(40)], 3))) for i in range(20_000)]
    listed = spark.createDataFrame(rows, "game_id bigint, name string").repartition(8)
    asked = listed.where("game_id < 2000").selectExpr("game_id AS query_id", "name AS query")
    df = titles.title_candidates(asked, listed, hot_pairs=1000)
    counter = Observation("read")
    hot = spark.createDataFrame([(f"w{j}",) for j in range(40)], "word string")
    listed = titles._with_hot(listed.select("game_id", "name", titles.words("name").alias("title_words")), ["game_id", "name", "title_words"], "title_words", hot)
    searches = asked.select(titles.words("query").alias("query_words")).distinct()
    searches = titles._with_hot(searches, ["query_words"], "query_words", hot)
    titles._through_hot_sets(searches, listed, 5).observe(counter, F.count("*").alias("n")).count()
    assert df.count() == 10_000
    assert counter.get["n"] < 40 * 2000 < 20_000 * 2000 / 100


@pytest.mark.parametrize("name", ["estimate_postprocessed", "tiered_estimate", "request_pipeline"])
def test_appearances_are_scanned_once(spark, sf_dir, name):
    """All that is built on the appearances reads what was written from them: no plan has a second scan."""
    from shelfcast.plans.queries import REGISTRY

    assert "lineitem" not in plan(REGISTRY[name](spark, sf_dir))


def test_a_lookup_shuffles_what_is_asked_and_not_the_snapshot(spark):
    stored = spark.range(3000).select(
        F.concat(F.lit("k"), F.col("id") % 2900).alias("key"), F.lit("{}").alias("data"), F.timestamp_seconds("id").alias("created_at")
    )
    table = snapshots.write_for_lookup(stored, 6)
    asked = spark.range(500).select("id", F.concat(F.lit("k"), F.col("id") * 7).alias("asked"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = snapshots.lookup(asked, "asked", table, F.timestamp_seconds(F.lit(3000)), 3_600_000_000)
        text = plan(df)
        assert text.count("Exchange") == 1 and "Exchange hashpartitioning(asked" in text
        rows = df.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    # 100 keys occur twice and read as absent
    assert sum(r.fresh for r in rows) == sum(100 <= 7 * i < 2900 for i in range(500))


def unmeasured_broadcasts(text, sf_dir):
    """Scans of supplied tables below a broadcast with no shuffle, which would measure the rows, between the two."""
    found, above = [], []
    for line in text.split("== Initial Plan ==")[-1].splitlines():
        node = line.lstrip(" :+-*|")
        depth = len(line) - len(node)
        above = [(d, n) for d, n in above if d < depth]
        if node.startswith("FileScan") and f"{sf_dir}/" in node:
            for _, name in reversed(above):
                if name.startswith("Exchange"):
                    break
                if name.startswith("BroadcastExchange"):
                    found.append(node)
                    break
        above.append((depth, node))
    return found


@pytest.fixture
def plans(spark, monkeypatch):
    """The plans of all that is written meanwhile."""
    from pyspark.sql.classic.dataframe import DataFrame

    seen, write = [], DataFrame.write.fget
    monkeypatch.setattr(DataFrame, "write", property(lambda df: (seen.append(plan(df)), write(df))[1]))
    return seen


UNMEASURED = [
    "publisher_stats",
    "publisher_first_match",
    "feature_rows",
    "estimate_postprocessed",
    "estimate_json",
    "estimate_model",
    "model_errors",
    "tiered_estimate_model",
    "title_candidates",
    "title_candidates_hot_words",
    "request_pipeline_batches",
    "request_pipeline_board",
    "request_pipeline_cache",
    "request_pipeline_model",
    "stream_leaderboard",
]


@pytest.mark.parametrize("name", UNMEASURED)
def test_supplied_rows_are_not_broadcast_by_the_size_of_their_file(spark, sf_dir, plans, monkeypatch, name):
    """A file's size says little about the rows made from it, which the driver would have to hold."""
    # one small model has the plans of all
    monkeypatch.setattr(model, "fit_trees", partial(model.fit_trees, rounds=1, depth=1))
    monkeypatch.setattr(queries, "SERVICES", ["epic"])
    plans.append(plan(REGISTRY[name](spark, sf_dir)))
    assert [x for text in plans for x in unmeasured_broadcasts(text, sf_dir)] == []


def test_only_hot_words_are_broadcast_to_searches_and_titles(spark, plans, tmp_path):
    """What is made from a row after its shuffle is not measured, and a broadcast once planned stays."""
    common = [f"w{i}" for i in range(titles.WIDE + 2)]
    names = {i: " ".join([*(common if i % 3 == 0 else common[i % 5 : i % 5 + 3]), f"t{i}"]) for i in range(60)}
    typed = {i: " ".join(common[1:] if i % 2 else [*common[i % 4 : i % 4 + 2], f"t{i}"]) for i in range(12)}
    # small files, as planned by their size
    spark.createDataFrame(list(names.items()), "game_id bigint, name string").write.parquet(f"{tmp_path}/titles")
    spark.createDataFrame(list(typed.items()), "query_id bigint, query string").write.parquet(f"{tmp_path}/queries")
    df = titles.title_candidates(spark.read.parquet(f"{tmp_path}/queries"), spark.read.parquet(f"{tmp_path}/titles"), hot_pairs=30)
    plans.append(plan(df))
    joins = [line for text in plans for line in text.splitlines() if "BroadcastHashJoin" in line]
    assert joins and [line for line in joins if "LeftSemi" not in line] == []

    expected = set()
    for q, text in typed.items():
        shared = {g: len(set(text.split()) & set(name.split())) for g, name in names.items()}
        best = sorted((g for g in names if shared[g]), key=lambda g: (-shared[g], len(names[g].split()), len(names[g]), g))
        expected |= {(q, rank, g, shared[g]) for rank, g in enumerate(best[:5], 1)}
    assert {(r.query_id, r.rank, r.game_id, r.shared) for r in df.collect()} == expected


def test_stored_results_are_not_broadcast(spark, sf_dir):
    for name in ("request_pipeline", "request_pipeline_batches"):
        assert "SortMergeJoin [stored_by" in plan(REGISTRY[name](spark, sf_dir))
