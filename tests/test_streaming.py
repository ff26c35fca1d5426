"""Streams over several files give the rows of the batch operators."""

import os

import pytest
from pyspark.sql import functions as F

from shelfcast.operators import demand, leaderboard, snapshots
from shelfcast.operators import requests as rq
from shelfcast.plans import pipeline
from shelfcast.session import new_path
from shelfcast.sources import derived, readers, schemas
from shelfcast.streaming import live

FILES = 4


@pytest.fixture(scope="module")
def landed(spark, sf_dir):
    """The requests in files of consecutive times."""
    path = new_path(spark, "landed")
    table = derived.requests(spark, sf_dir).withColumn("platforms", F.lit(None).cast("array<string>"))
    table = table.select(*schemas.REQUESTS.names)
    cuts = [r.ts for r in table.where("ts is not null").orderBy("ts").collect()]
    step = -(-len(cuts) // FILES)
    for n in range(FILES):
        last = cuts[min((n + 1) * step, len(cuts)) - 1]
        part = table.where((F.col("ts") >= F.lit(cuts[n * step])) & (F.col("ts") <= F.lit(last)))
        part.coalesce(1).write.mode("append").parquet(path)
    return path


@pytest.fixture()
def stream(spark, landed):
    return readers.stream_requests(spark, landed, files_per_trigger=1)


def test_votes(spark, landed, stream):
    found = live.run_to_files(live.live_votes(stream).select("request_id"), "votes").collect()
    batch = rq.accepted(readers.read_requests(spark, landed)).where(~F.col("is_local"))
    want = demand.accepted_votes(batch).select("request_id").collect()
    assert sorted(r.request_id for r in found) == sorted(r.request_id for r in want)
    local = live.run_to_files(live.live_local_votes(stream).select("request_id"), "local")
    assert local.count() == rq.accepted(readers.read_requests(spark, landed)).where("is_local").count()


@pytest.mark.parametrize("hot_rows", [None, 10])
def test_outcome_source_by_batch(spark, landed, stream, hot_rows):
    """Keys of a few batches, carried from one to the next, in cells and whole."""
    named = rq.accepted(stream).select(
        "request_id", "ts", "game_key", "platform", "outcome",
        F.unix_micros("ts").alias("at_us"), F.col("request_id").alias("id"), (F.col("outcome") == "ok").alias("eligible"),
    )
    period = 5 * demand.RESULT_TTL_US
    found = live.run_openers_by_batch(named, ["game_key", "platform"], period, hot_rows=hot_rows, bands=8)
    want = demand.with_outcome_source(rq.accepted(readers.read_requests(spark, landed)), period)
    got = {(r.request_id, r.opener_id) for r in found.collect()}
    assert got == {(r.request_id, r.stored_by) for r in want.collect()}


def test_late_rows_and_repeated_batches(spark):
    judge = live.OpenersByBatch(new_path(spark, "late"), ["k"], 10, hot_rows=None)
    schema = "k string, at_us bigint, id bigint, eligible boolean"
    judge.add(spark.createDataFrame([("a", 100, 1, True), ("b", 103, 2, True)], schema), 0)
    second = spark.createDataFrame([("a", 102, 3, True), ("a", 109, 4, True), ("a", 110, 5, True), ("b", 112, 6, True)], schema)
    judge.add(second, 1)
    judge.add(second, 1)
    judge.add(spark.createDataFrame([], schema), 2)
    judge.add(spark.createDataFrame([("a", 119, 7, True), ("b", 123, 8, True)], schema), 3)
    found = {r.id: r.opener_id for r in judge.read(spark).collect()}
    # 3 came after 103 had been seen, and is judged as if it were from then
    assert found == {1: 1, 2: 2, 3: 1, 4: 1, 5: 5, 6: 2, 7: 5, 8: 8}


def test_files_out_of_time_order_lose_no_request(spark, sf_dir):
    path = new_path(spark, "interleaved")
    table = derived.requests(spark, sf_dir).withColumn("platforms", F.lit(None).cast("array<string>")).select(*schemas.REQUESTS.names)
    for n in range(FILES):
        table.where(F.col("request_id") % FILES == n).coalesce(1).write.mode("append").parquet(path)
    asked = rq.accepted(readers.read_requests(spark, path))
    stream = readers.stream_requests(spark, path, files_per_trigger=1)
    found = live.run_to_files(live.live_outcome_source(stream), "source")
    assert found.count() == asked.count() == found.select("request_id").distinct().count()
    votes = live.run_to_files(live.live_votes(stream).select("request_id"), "votes").count()
    remote = asked.where(~F.col("is_local"))
    assert remote.select("client_ip", "game_key", "platform").distinct().count() <= votes <= remote.count()


def test_outcome_source(spark, landed, stream):
    found = live.run_to_files(live.live_outcome_source(stream), "source")
    want = demand.with_outcome_source(rq.accepted(readers.read_requests(spark, landed)))
    columns = ["request_id", "source", "stored_by"]
    assert {tuple(r) for r in found.select(columns).collect()} == {tuple(r) for r in want.select(columns).collect()}


def state_rows(query):
    return [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]


def test_state_ends_with_the_period_and_the_run_ends(spark, landed, stream):
    """Only keys of the last period have state, while every row is judged."""
    events = live.vote_events(stream)
    keys = ["client_ip", "game_key", "platform"]
    judged = live.live_openers(events, keys, demand.COOLDOWN_US).select("request_id", "opener_id")
    folder = new_path(spark, "ended")
    query = live.run_now(judged.writeStream.format("parquet").option("path", f"{folder}/rows"), folder)
    batch = rq.accepted(readers.read_requests(spark, landed)).where(~F.col("is_local"))
    assert spark.read.parquet(f"{folder}/rows").count() == batch.count()
    last = batch.agg(F.max("ts")).first()[0]
    open_keys = batch.where(F.col("ts") > F.lit(last) - F.expr("INTERVAL 1 HOUR")).select(*keys).distinct().count()
    every = batch.select(*keys).distinct().count()
    assert len(state_rows(query)) >= FILES
    assert state_rows(query)[-1] <= open_keys < every / 4


def test_a_late_row_is_answered_by_the_open_period_or_judged_at_the_watermark(spark):
    path = new_path(spark, "late-rows")
    schema = "k string, id long, s long"
    for rows in ([("a", 1, 100), ("b", 2, 103)], [("a", 3, 102), ("a", 4, 109), ("a", 5, 110)], [("b", 6, 50), ("c", 7, 5)], [("b", 8, 111), ("c", 9, 119)]):
        spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("s")).coalesce(1).write.mode("append").parquet(path)
    events = spark.readStream.schema("k string, id long, s long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(path)
    events = events.select("k", "id", "ts", F.unix_micros("ts").alias("at_us"), F.lit(True).alias("eligible"), F.col("id").alias("row"))
    found = live.run_to_files(live.live_openers(events, ["k"], 10_000_000).select("row", "opener_id"), "late")
    # 6 is of the time before 103, 7 comes at the watermark, 110, as its key's first, and so covers 9
    assert {r.row: r.opener_id for r in found.collect()} == {1: 1, 2: 2, 3: 1, 4: 1, 5: 5, 6: 2, 7: 7, 8: 2, 9: 7}


def static(spark):
    stats = spark.createDataFrame([], schemas.PUBLISHER_STATS).withColumn("ordinal", F.lit(0).cast("long"))
    return stats, spark.createDataFrame([], "label string, code bigint")


def test_the_board_counts_what_the_batch_flow_counts(spark, landed, stream):
    stats, codes = static(spark)
    asked = rq.accepted(readers.read_requests(spark, landed))
    want = {tuple(r) for r in pipeline.counted_board(pipeline.voting(asked)).collect()}
    folder = new_path(spark, "live")
    board = live.run_requests_to_board(stream, stats, codes, folder=folder)
    assert {tuple(r) for r in board.select("game", "platform", "score").collect()} == want
    assert asked.count() > sum(r[2] for r in want)
    # nothing new: the same folder goes on and counts nothing twice
    again = live.run_requests_to_board(stream, stats, codes, folder=folder)
    assert {tuple(r) for r in again.select("game", "platform", "score").collect()} == want
    last = spark.read.parquet(f"{folder}/cooldowns/batch={FILES - 1}")
    assert last.count() < asked.select("client_ip", "game_key", "platform").distinct().count()


def test_a_stream_goes_on_where_it_was(spark, landed):
    """Files that land between two runs; the state of the first is that of the second."""
    path, folder = new_path(spark, "two-parts"), new_path(spark, "goes-on")
    rows = readers.read_requests(spark, landed)
    middle = rows.select("ts").orderBy("ts").collect()[rows.count() // 2].ts
    schema_of = spark.readStream.schema(schemas.REQUESTS)
    for part in (F.col("ts") < F.lit(middle), F.col("ts") >= F.lit(middle)):
        rows.where(part).coalesce(1).write.mode("append").parquet(path)
        found = live.run_to_files(live.live_outcome_source(schema_of.parquet(path)).select("request_id", "source", "stored_by"), "x", folder)
    want = demand.with_outcome_source(rq.accepted(rows)).select("request_id", "source", "stored_by")
    assert {tuple(r) for r in found.collect()} == {tuple(r) for r in want.collect()}


def test_streams_without_any_file(spark):
    path = new_path(spark, "nothing")
    spark.createDataFrame([], schemas.REQUESTS).limit(0).write.parquet(path)
    for file in spark.read.parquet(path).inputFiles():
        os.remove(file.removeprefix("file://"))
    stream = readers.stream_requests(spark, path)
    events = live.vote_events(stream)
    stats, codes = static(spark)
    found = [
        live.run_to_files(live.live_votes(stream).select("request_id"), "votes"),
        live.run_openers_by_batch(events, ["client_ip", "game_key", "platform"], demand.COOLDOWN_US),
        live.run_to_board(live.live_local_votes(stream)),
        live.run_requests_to_board(stream, stats, codes),
        live.run_to_cache(rq.accepted(stream).select(F.col("game").alias("key"), F.lit("x").alias("data"), F.col("ts").alias("created_at"))),
    ]
    assert [df.count() for df in found] == [0] * 5
    assert found[1].columns[0] == "request_id" and found[3].columns == ["game", "platform", "score"]


def test_board_adds_up_batches(spark, landed, stream):
    folder = new_path(spark, "board")
    board = live.run_to_board(rq.accepted(stream).select("game", "platform"), folder)
    want = leaderboard.vote_counts(rq.accepted(readers.read_requests(spark, landed)))
    assert {tuple(r) for r in board.collect()} == {tuple(r) for r in want.select(board.columns).collect()}
    deltas = live.Deltas(folder, leaderboard.vote_counts, live.board_of)
    assert deltas.read(spark, live.COUNT).select("batch").distinct().count() == FILES


def test_cache_keeps_the_newest(spark, landed, stream):
    def rows(df):
        key = rq.result_key(F.col("game"), F.col("platform"))
        return rq.accepted(df).select(key.alias("key"), F.to_json(F.struct("request_id")).alias("data"), F.col("ts").alias("created_at"))

    found = live.run_to_cache(rows(stream))
    want = snapshots.latest_per_key(rows(readers.read_requests(spark, landed)))
    assert {tuple(r) for r in found.collect()} == {tuple(r) for r in want.collect()}


def test_a_batch_run_again_counts_once_before_and_after_folds(spark):
    deltas = live.Deltas(new_path(spark, "again"), leaderboard.vote_counts, live.board_of)
    deltas.start(spark, live.COUNT)

    def votes(n):
        return spark.createDataFrame([("a", "epic"), (f"g{n % 3}", "any")], "game string, platform string")

    for n in range(10):
        deltas.add(votes(n), n)
        if n in (3, 7):
            assert deltas.fold(spark, live.COUNT) == n == deltas.folded(spark)
            deltas.add(votes(n), n)  # run again after it was folded
        if n == 5:
            deltas.add(votes(n), n)  # and before
    # a fold that was lost before its entry in the ledger
    spark.createDataFrame([("a", "epic", 99)], live.COUNT).write.parquet(f"{deltas.folder}/snapshots/upto=8")
    want = {("a", "epic", 10), ("g0", "any", 4), ("g1", "any", 3), ("g2", "any", 3)}
    assert {tuple(r) for r in live.board_of(deltas.read(spark, live.COUNT)).collect()} == want
    assert deltas.read(spark, live.COUNT).select("batch").distinct().count() == 3  # 7 with all before it, 8 and 9


def test_an_upsert_leaves_untouched_buckets_alone(spark):
    snapshot = snapshots.BucketedSnapshot(new_path(spark, "buckets"), 16)
    snapshot.start(spark)
    time = F.timestamp_seconds(F.col("s")).alias("created_at")

    def batch(rows):
        return spark.createDataFrame(rows, "key string, data string, s long").select("key", "data", time)

    def files():
        return {f: os.path.getmtime(f.removeprefix("file://")) for f in snapshot.read(spark).inputFiles()}

    snapshot.upsert(batch([(f"k{i}", "old", 100) for i in range(200)]))
    before = files()
    # an older time still replaces: the later batch counts; within it the newest
    snapshot.upsert(batch([("k3", "first", 1), ("k3", "new", 50), ("other", "x", 7)]))
    after = files()
    kept = set(before) & set(after)
    assert len(before) - 2 <= len(kept) < len(before) and all(before[f] == after[f] for f in kept)
    rows = {r.key: (r.data, r.created_at.timestamp()) for r in snapshot.read(spark).collect()}
    assert len(rows) == 201 and rows["k3"] == ("new", 50) and rows["k4"][0] == "old" and rows["other"][0] == "x"
    snapshot.upsert(batch([("k3", "first", 1), ("k3", "new", 50), ("other", "x", 7)]))
    snapshot.upsert(batch([]))
    assert {r.key: (r.data, r.created_at.timestamp()) for r in snapshot.read(spark).collect()} == rows
