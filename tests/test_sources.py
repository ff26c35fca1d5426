"""Readers and sinks, and what reaches the scan."""

import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from shelfcast.operators import catalogue as cat
from shelfcast.operators import leaderboard, snapshots
from shelfcast.operators.publishers import first_match
from shelfcast.session import new_path, working_folder
from shelfcast.sources import readers, schemas, sinks


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("fmt", ["parquet", "json"])
def test_requests_round_trip(spark, tmp_path, fmt):
    row = (1, datetime(2024, 1, 1, 2, 3, 4), "G", None, "B", "epic", "1.1.1.1", "2.2.2.2", "P", 71.5, date(2020, 2, 3), ["PC"], "ok")
    df = spark.createDataFrame([row], schemas.REQUESTS)
    path = sinks.write_snapshot(df, str(tmp_path / "r"), fmt=fmt)
    assert [tuple(r) for r in readers.read_requests(spark, path, fmt).collect()] == [row]


def test_statistics_keep_file_order(spark, tmp_path):
    """A file cut into many splits still gives the first row of the file."""
    names = [f"P{i % 50}" for i in range(2000)]
    lines = ["primary_publisher,avg_days_to_epic,games_count,avg_metacritic"]
    lines += [f"{n},{i}.5,{i},70.0" for i, n in enumerate(names)]
    (tmp_path / "stats.csv").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
        stats = readers.read_publisher_stats(spark, str(tmp_path / "stats.csv"))
        assert stats.rdd.getNumPartitions() > 4
        first = {r.primary_publisher: r.games_count for r in first_match(stats, "primary_publisher").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert first == {f"P{i}": i for i in range(50)}


def test_appearances_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("game_id,platform,appeared_on\n1,epic,2020-01-02\n2,humble,\n")
    found = readers.read_appearances(spark, str(tmp_path / "a.csv")).collect()
    assert [tuple(r) for r in found] == [(1, "epic", date(2020, 1, 2)), (2, "humble", None)]


RECORD = {
    "id": 7, "name": "N", "publishers": [{"name": "P", "slug": "x"}, {"name": "Q"}], "platforms": ["PC"],
    "metacritic": None, "rating": 4.25, "reviews_count": 3, "released": "2020-05-06", "background_image": None, "extra": {"a": 1},
}


def test_nested_catalogue_records(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps(RECORD) + "\n" + json.dumps({"id": 8, "name": "M"}) + "\n")
    rows = {r.game_id: r for r in cat.enrich(readers.read_catalogue(spark, str(tmp_path / "c.json"))).collect()}
    assert (rows[7].publisher, rows[7].metacritic, rows[7].release_month, rows[7].platforms) == ("P", 85.0, 5, ["PC"])
    assert (rows[8].publisher, rows[8].metacritic, rows[8].release_year, rows[8].score_text) == ("Unknown", None, 2024, "N/A")
    landed = spark.createDataFrame([(json.dumps(RECORD),)], "body string")
    (row,) = cat.enrich(readers.parse_catalogue(landed, "body")).collect()
    assert row == rows[7]


def test_json_results(spark, tmp_path):
    df = spark.createDataFrame([(1.5, "s")], "predicted_years double, sentence string")
    path = sinks.write_json(df, str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    assert json.loads(text) == {"predicted_years": 1.5, "sentence": "s"}
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_json(df, path)  # never over an existing snapshot


def test_working_folder_is_the_configured_one(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert working_folder(spark) in (folder, f"file:{folder}")
    assert new_path(spark, "x") != new_path(spark, "x")


# -- pushdown and pruning ---------------------------------------------------


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stored")
    board = spark.range(1000).select(
        F.concat(F.lit("g"), (F.col("id") % 100).cast("string")).alias("game"),
        F.when(F.col("id") % 2 == 0, "epic").otherwise("any").alias("platform"),
        F.col("id").alias("score"),
        F.lit("unused").alias("note"),
    )
    cache = spark.range(10).select(
        F.col("id").cast("string").alias("key"),
        F.lit("{}").alias("data"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(days=F.col("id").cast("int"))).alias("created_at"),
    )
    return sinks.write_snapshot(board, str(folder / "board")), sinks.write_cache_by_day(cache, str(folder / "cache"))


def test_board_scan_is_pruned_and_filtered(spark, stored):
    df = leaderboard.leaderboard(readers.read_leaderboard(spark, stored[0]), "epic")
    text = plan(df)
    assert "PushedFilters: [IsNotNull(platform), EqualTo(platform,epic)]" in text
    assert "ReadSchema: struct<game:string,platform:string,score:bigint>" in text
    assert "TakeOrderedAndProject" in text


def test_boards_cut_before_the_shuffle(spark, stored):
    text = plan(leaderboard.platform_boards(readers.read_leaderboard(spark, stored[0]), readers.platform_dimension(spark)))
    assert text.count("WindowGroupLimit") == 2
    assert "BroadcastHashJoin" in text and "LocalTableScan" in text


def test_global_board_aggregates_in_two_steps(spark, stored):
    text = plan(leaderboard.leaderboard(readers.read_leaderboard(spark, stored[0])))
    assert "partial_sum(score" in text and "TakeOrderedAndProject(limit=10" in text
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_retention_reads_only_surviving_days(spark, stored):
    as_of = F.lit("2024-01-09 12:00:00").cast("timestamp")
    kept = snapshots.surviving(spark.read.parquet(stored[1]), as_of)
    text = plan(kept)
    # days and times reach the scan; rows without a time stay
    scanned = text.split("PartitionFilters: [")[1].split("]")[0]
    assert "created_on" in scanned and "2024-01-08" in scanned and "isnull(created_on" in scanned
    assert "PushedFilters: [Or(GreaterThanOrEqual(created_at," in text
    assert sorted(r.key for r in kept.collect()) == ["8", "9"]
