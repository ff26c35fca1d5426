"""Live versions: the period rule with keyed state, and a running leaderboard."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.readwriter import DataStreamWriter

from shelfcast.operators.demand import (
    COOLDOWN_US,
    ERROR,
    HIT,
    MISS,
    RESULT_KEYS,
    RESULT_TTL_US,
    VOTE_KEYS,
    last_openers,
    with_outcome_source,
    with_votes,
)
from shelfcast.operators.keyed_scan import HOT_ROWS, judge_range, period_openers
from shelfcast.operators.leaderboard import vote_counts
from shelfcast.operators.requests import accepted
from shelfcast.operators.snapshots import BUCKETS, BucketedSnapshot
from shelfcast.plans.pipeline import stored, with_scoring_outcome
from shelfcast.session import new_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class OpenPeriod(StatefulProcessor):
    """Keeps one opener per key, two numbers on disk, until the watermark has passed the end of its period.

    Rows are judged by time within a trigger. A row that comes late is judged as if it came at the watermark, or is
    answered by a period that began later and is still open. So every row is judged and none waits for or falls behind the
    watermark, and only keys of the last period have state.
    """

    def __init__(self, period_us: int, payload: list[str]):
        self.period_us = period_us
        self.payload = payload

    def init(self, handle: StatefulProcessorHandle) -> None:
        schema = T.StructType([T.StructField("at_us", T.LongType()), T.StructField("id", T.LongType())])
        self.handle = handle
        self.state = handle.getValueState("opener", schema)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = tuple(self.state.get()) if self.state.exists() else None
        # one key's rows of one trigger; the source's maxBytesPerTrigger bounds them
        frames = list(rows)
        at, ids, eligible = (np.concatenate([f[c].to_numpy() for f in frames]) for c in ("at_us", "id", "eligible"))
        at = np.maximum(at.astype(np.int64), timerValues.getCurrentWatermarkInMs() * 1000)
        order = np.lexsort((ids, at))
        starts = np.zeros(len(at), bool)
        starts[0] = before is None
        opener_us, opener_id, covered = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), np.zeros(len(at), bool)
        opener = judge_range(
            starts, at[order], ids[order].astype(np.int64), eligible[order].astype(bool), self.period_us, before, opener_us, opener_id, covered
        )
        if opener and opener != before:
            self.state.update(opener)
            self.handle.registerTimer(self._end_ms(opener[0]))
        place = np.empty(len(at), np.int64)
        place[order] = np.arange(len(at))
        first = 0
        for frame in frames:
            mine = place[first : first + len(frame)]
            first += len(frame)
            out = frame[self.payload].copy()
            out["opener_id"] = pd.array(opener_id[mine], dtype="Int64")
            out.loc[~covered[mine], "opener_id"] = pd.NA
            yield out

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # a later opener has a timer of its own
        if self.state.exists() and self._end_ms(self.state.get()[0]) <= timerValues.getCurrentWatermarkInMs():
            self.state.clear()
        yield from ()

    def _end_ms(self, at_us: int) -> int:
        return -(-(at_us + self.period_us) // 1000)

    def close(self) -> None:
        pass


def live_openers(events: DataFrame, keys: list[str], period_us: int, lateness: str = "0 seconds") -> DataFrame:
    """Streaming ``period_openers``, with the same columns; ``events`` has its time in ``ts`` too.

    The watermark only ends periods: as ``ts`` itself does not reach the stateful operator, no row is dropped for being late.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    judged = events.withWatermark("ts", lateness).drop("ts")
    payload = [c for c in judged.columns if c not in ("id", "eligible")]
    fields = [f for f in judged.schema.fields if f.name in payload]
    schema = T.StructType([*fields, T.StructField("opener_id", T.LongType())])
    found = judged.groupBy(*keys).transformWithStateInPandas(
        OpenPeriod(period_us, payload), schema, outputMode="append", timeMode="EventTime"
    )
    return found.withColumn("ts", F.timestamp_micros("at_us")).drop("at_us")


class OpenersByBatch:
    """The period rule of a stream through the batch operator, for very large keys.

    Keyed state hands one key's rows of a trigger to one task. Here every
    micro-batch runs ``period_openers``, which cuts large keys, on its rows and
    the openers carried over. A batch writes its judged rows, the openers that
    are still open and the latest time seen to folders of its own, and reads
    only those of the batch before, so running it again changes nothing. A row
    older than the latest time seen before its batch is judged as if it came at that time.
    """

    def __init__(self, folder: str, keys: list[str], period_us: int, hot_rows: int | None = HOT_ROWS, bands: int | None = None):
        self.folder = folder
        self.keys = keys
        self.period_us = period_us
        self.hot_rows = hot_rows
        self.bands = bands

    def _path(self, kind: str, batch_id: int) -> str:
        return f"{self.folder}/{kind}/batch={batch_id}"

    def prepare(self, events: DataFrame) -> None:
        """An empty first batch, so that there is a table to read before any row has come."""
        longs = [T.StructField(c, T.LongType()) for c in ("opener_id", "opener_us")]
        schema = T.StructType([*events.schema.fields, T.StructField("carried", T.BooleanType()), *longs])
        events.sparkSession.createDataFrame([], schema).write.mode("overwrite").parquet(self._path("judged", -1))

    def add(self, rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        events = rows.withColumn("carried", F.lit(False))
        seen = None
        if batch_id > 0:
            seen = spark.read.parquet(self._path("seen", batch_id - 1)).first()["at_us"]
            carried = spark.read.parquet(self._path("open", batch_id - 1))
            if seen is not None:
                events = events.withColumn("at_us", F.greatest("at_us", F.lit(seen).cast("bigint")))
            events = events.unionByName(carried, allowMissingColumns=True)
        judged = period_openers(events, self.keys, self.period_us, self.hot_rows, self.bands)
        judged.write.mode("overwrite").parquet(self._path("judged", batch_id))

        judged = spark.read.schema(judged.schema).parquet(self._path("judged", batch_id))
        latest = F.greatest(F.max("at_us"), F.lit(seen).cast("bigint"))
        judged.where("NOT carried").agg(latest.alias("at_us")).write.mode("overwrite").parquet(self._path("seen", batch_id))
        now = spark.read.parquet(self._path("seen", batch_id)).first()["at_us"]
        if now is None:
            now = 0
        # an opener covers itself, so the last one of a key is always among its rows
        openers = judged.where(F.col("opener_us") > now - self.period_us).groupBy(*self.keys)
        openers.agg(F.max(F.struct("opener_us", "opener_id")).alias("last")).select(
            *self.keys,
            F.col("last.opener_us").alias("at_us"),
            F.col("last.opener_id").alias("id"),
            F.lit(True).alias("eligible"),
            F.lit(True).alias("carried"),
        ).write.mode("overwrite").parquet(self._path("open", batch_id))

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/judged").where("NOT carried").drop("carried", "batch", "opener_us")


def run_openers_by_batch(
    events: DataFrame,
    keys: list[str],
    period_us: int,
    hot_rows: int | None = HOT_ROWS,
    bands: int | None = None,
    folder: str | None = None,
) -> DataFrame:
    """As ``live_openers``, run over what is there now; large keys are cut. A run with the same folder goes on."""
    spark = events.sparkSession
    folder = folder or new_path(spark, "openers")
    judge = OpenersByBatch(folder, keys, period_us, hot_rows, bands)
    judge.prepare(events)
    run_now(events.writeStream.foreachBatch(judge.add), folder)
    return judge.read(spark)


def run_now(writer: DataStreamWriter, folder: str) -> StreamingQuery:
    """Run a stream over what is there now; its log is kept in the folder, where the next run finds it."""
    query = writer.option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def vote_events(requests: DataFrame) -> DataFrame:
    """Remote requests of a stream, ready for the period rule."""
    return accepted(requests).where(~F.col("is_local")).select(
        "request_id", "ts", "game", "game_key", "platform", "client_ip",
        F.unix_micros("ts").alias("at_us"), F.col("request_id").alias("id"), F.lit(True).alias("eligible"),
    )


def live_votes(requests: DataFrame, period_us: int = COOLDOWN_US) -> DataFrame:
    """Accepted votes of a request stream, local traffic apart."""
    return live_openers(vote_events(requests), ["client_ip", "game_key", "platform"], period_us).where(
        F.col("opener_id") == F.col("request_id")
    )


def live_local_votes(requests: DataFrame) -> DataFrame:
    """Local traffic: always accepted, no state."""
    return accepted(requests).where("is_local")


def live_outcome_source(requests: DataFrame, period_us: int = RESULT_TTL_US) -> DataFrame:
    """``source`` and ``stored_by`` of a request stream."""
    events = accepted(requests).select(
        "request_id", "ts", "game_key", "platform", "outcome",
        F.unix_micros("ts").alias("at_us"), F.col("request_id").alias("id"), (F.col("outcome") == "ok").alias("eligible"),
    )
    judged = live_openers(events, ["game_key", "platform"], period_us)
    source = F.when(F.col("opener_id") != F.col("request_id"), HIT).when(F.col("outcome") == "fail", ERROR).otherwise(MISS)
    return judged.withColumn("source", source).withColumnRenamed("opener_id", "stored_by")


def run_to_files(stream: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Run a stream over what is there now and read back all that it wrote. A run with the same folder goes on."""
    spark = stream.sparkSession
    folder = folder or new_path(spark, name)
    out = f"{folder}/rows"
    run_now(stream.writeStream.format("parquet").option("path", out).outputMode("append"), folder)
    return spark.read.schema(stream.schema).parquet(out)


class Deltas:
    """What each micro-batch of a stream comes to, one folder per batch, folded from time to time.

    A batch writes only its own, already reduced rows, so a trigger costs as much as its batch, and a batch that is
    run again replaces what it wrote. ``fold`` adds the batches up to a snapshot and then writes, into the ledger, up to
    which batch it counts; the ledger's last entry is what readers trust. A batch up to there is not read again, so that
    running it again after a fold changes nothing, nor does a fold that was lost before its entry.
    """

    def __init__(self, folder: str, prepare: Callable[[DataFrame], DataFrame], combine: Callable[[DataFrame], DataFrame]):
        self.folder = folder
        self.prepare = prepare
        self.combine = combine

    def add(self, rows: DataFrame, batch_id: int) -> None:
        self.prepare(rows).write.mode("overwrite").parquet(f"{self.folder}/deltas/batch={batch_id}")

    def start(self, spark: SparkSession, schema: T.StructType) -> None:
        """Empty tables of the given columns, which readers find before any row has come."""
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{self.folder}/deltas/batch=-1")
        spark.createDataFrame([], "upto long, at timestamp").write.mode("append").parquet(f"{self.folder}/ledger")

    def read(self, spark: SparkSession, schema: T.StructType) -> DataFrame:
        """All rows that count, told apart by ``batch``: those of the snapshot, then the batches after it."""
        full = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
        upto = self.folded(spark)
        rows = spark.read.schema(full).parquet(f"{self.folder}/deltas")
        if upto is None:
            return rows
        snapshot = spark.read.schema(schema).parquet(f"{self.folder}/snapshots/upto={upto}")
        return snapshot.withColumn("batch", F.lit(upto).cast("long")).unionByName(rows.where(F.col("batch") > upto))

    def folded(self, spark: SparkSession) -> int | None:
        """The last batch that the snapshot counts."""
        return spark.read.schema("upto long, at timestamp").parquet(f"{self.folder}/ledger").agg(F.max("upto")).first()[0]

    def fold(self, spark: SparkSession, schema: T.StructType) -> int | None:
        """Count all batches that are there into a new snapshot; batches come one at a time, so none is half written."""
        rows = self.read(spark, schema)
        upto = rows.agg(F.max("batch")).first()[0]
        if upto is None or upto < 0 or upto == self.folded(spark):
            return self.folded(spark)
        self.combine(rows).write.mode("overwrite").parquet(f"{self.folder}/snapshots/upto={upto}")
        spark.range(1).select(F.lit(upto).cast("long").alias("upto"), F.current_timestamp().alias("at")).write.mode("append").parquet(
            f"{self.folder}/ledger"
        )
        return upto


COUNT = T.StructType(
    [T.StructField("game", T.StringType()), T.StructField("platform", T.StringType()), T.StructField("score", T.LongType())]
)


def board_of(deltas: DataFrame) -> DataFrame:
    return deltas.groupBy("game", "platform").agg(F.sum("score").alias("score"))


def run_to_board(votes: DataFrame, folder: str | None = None) -> DataFrame:
    """The board after all votes that are there now. A run with the same folder goes on."""
    spark = votes.sparkSession
    folder = folder or new_path(spark, "board")
    deltas = Deltas(folder, vote_counts, board_of)
    deltas.start(spark, COUNT)
    run_now(votes.writeStream.foreachBatch(deltas.add), folder)
    return board_of(deltas.read(spark, COUNT))


class LiveBoard:
    """A request stream's board: each micro-batch decides what is answered, then who votes, then counts.

    Only hits and misses whose result was stored ask for a vote, as in the batch flow. A batch leaves the stored results
    and cooldowns that are still open, and the latest time seen, in folders of its own, and reads those of the batch before, so running
    it again changes nothing, and the state is that of the last day and hour. A row older than the latest time
    seen before its batch is judged as if it came at that time.
    """

    RESULTS = "game_key string, platform string, at_us long, id long"
    COOLDOWNS = "client_ip string, game_key string, platform string, at_us long, id long"
    COLUMNS = ("request_id", "ts", "game", "game_key", "platform", "client_ip", "is_local", "outcome")

    def __init__(self, folder: str, stats: DataFrame, codes: DataFrame, hot_rows: int | None = HOT_ROWS):
        self.folder = folder
        self.stats, self.codes = stats, codes
        self.hot_rows = hot_rows
        self.deltas = Deltas(f"{folder}/board", lambda voted: vote_counts(voted.where("voted")), board_of)

    def _written(self, df: DataFrame, kind: str, batch_id: int) -> DataFrame:
        path = f"{self.folder}/{kind}/batch={batch_id}"
        df.write.mode("overwrite").parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def start(self, spark: SparkSession) -> None:
        self._written(spark.createDataFrame([], self.RESULTS), "results", -1)
        self._written(spark.createDataFrame([], self.COOLDOWNS), "cooldowns", -1)
        self._written(spark.createDataFrame([], "at timestamp"), "seen", -1)
        self.deltas.start(spark, COUNT)

    def add(self, rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        before = {k: spark.read.schema(s).parquet(f"{self.folder}/{k}/batch={batch_id - 1}") for k, s in
                  (("results", self.RESULTS), ("cooldowns", self.COOLDOWNS), ("seen", "at timestamp"))}
        seen = before["seen"].agg(F.max("at")).first()[0]
        named = with_scoring_outcome(accepted(rows), self.stats, self.codes).select(*self.COLUMNS)
        named = named.withColumn("ts", F.greatest("ts", F.lit(seen).cast("timestamp")))
        decided = self._written(with_outcome_source(named, hot_rows=self.hot_rows, start=before["results"], keep_opener=True), "decided", batch_id)
        asking = decided.where((F.col("source") == HIT) | stored()).drop("opener_id", "opener_us")
        voted = self._written(with_votes(asking, hot_rows=self.hot_rows, start=before["cooldowns"], keep_opener=True), "voted", batch_id)
        now = self._written(decided.agg(F.greatest(F.max("ts"), F.lit(seen).cast("timestamp")).alias("at")), "seen", batch_id).first()["at"]
        now_us = F.unix_micros(F.lit(now).cast("timestamp"))
        for kind, judged, keys, period in (("results", decided, RESULT_KEYS, RESULT_TTL_US), ("cooldowns", voted, VOTE_KEYS, COOLDOWN_US)):
            self._written(last_openers(judged, keys, before[kind]).where(F.col("at_us") > now_us - period), kind, batch_id)
        self.deltas.add(voted, batch_id)

    def board(self, spark: SparkSession) -> DataFrame:
        return board_of(self.deltas.read(spark, COUNT))


def run_requests_to_board(
    requests: DataFrame, stats: DataFrame, codes: DataFrame, hot_rows: int | None = HOT_ROWS, folder: str | None = None
) -> DataFrame:
    """The board after all requests that are there now. A run with the same folder goes on."""
    spark = requests.sparkSession
    folder = folder or new_path(spark, "live-board")
    live = LiveBoard(folder, stats, codes, hot_rows)
    live.start(spark)
    run_now(requests.writeStream.foreachBatch(live.add), folder)
    return live.board(spark)


def run_to_cache(rows: DataFrame, folder: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """The keyed snapshot after all rows that are there now: rows of a later batch replace earlier ones."""
    spark = rows.sparkSession
    folder = folder or new_path(spark, "cache")
    snapshot = BucketedSnapshot(f"{folder}/rows", buckets)
    snapshot.start(spark)
    run_now(rows.writeStream.foreachBatch(lambda batch, _: snapshot.upsert(batch)), folder)
    return snapshot.read(spark)
