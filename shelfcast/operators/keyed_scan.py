"""Which event opened the period that covers an event?

Per key and in time order, an eligible event opens a period when no period is
open; the period covers every later event that is less than ``period`` away
from its opener. Events inside a period do not prolong it. The cooldown of
votes and the time-to-live of stored results are both this rule.

The rule is a chain of pointers: from an opener to the first eligible event at
least a period later. Every eligible event gets that pointer by a search in
sorted times, and the openers are what the first event reaches. Reaching is
found by pointer doubling: pointers of 1, 2, 4, ... steps, each made of two of
the last, so that no row waits for the one before it.

A key is normally read by one task, batch by batch. A key with very many rows
is cut into cells of (slice, band): a slice is one period long, a band is a part
of the slice. Three facts make that exact:

* a slice holds at most one opener of a key;
* after an opener at offset ``o`` of a slice, the next one is the first event
  at an offset ``>= o`` of the following slice, so inside a band the chain of
  openers can be followed without looking at other bands;
* a chain that leaves its band enters another cell always at that cell's first
  event, so a band only has to be followed from the first event of each cell.

Bands are followed in parallel. What is left is a chain over cells, cut into
chunks of slices. Within a chunk doubling runs on arrays; across chunks it runs as joins
on pointers from cells to cells of later chunks. No task holds more than a batch, a cell, or
a chunk's cells, however long a key's history is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfcast.session import new_path

HOT_ROWS = 4_000_000
# keys that may be sent to every executor; a longer list is joined
BROADCAST_KEYS = 10_000
# rows of a key at the limit that the count expects to see
SEEN_ROWS = 1_000
# a band for every so many rows of the largest key, and the fewest bands
BAND_ROWS, FEWEST_BANDS = 1_000_000, 64
CHUNK_CELLS = 262_144


def period_openers(
    events: DataFrame,
    keys: list[str],
    period_us: int,
    hot_rows: int | None = HOT_ROWS,
    bands: int | None = None,
    chunk_cells: int = CHUNK_CELLS,
) -> DataFrame:
    """Adds ``opener_id`` and ``opener_us``: null where no period covers the event.

    ``events`` needs the non-null ``keys``, ``at_us`` (microseconds), ``id``
    (unique, orders equal times) and ``eligible`` (boolean). Keys with at least
    ``hot_rows`` rows are cut into cells, all others are read whole. The rows per key
    are counted when this is called, so that the plan only has the parts it needs;
    ``hot_rows=None`` skips the count. ``bands`` follows from the largest key unless given.
    """
    hot = hot_keys(events, keys, hot_rows) if hot_rows is not None else None
    if hot is None:
        return _read_whole_keys(events, keys, period_us)
    told = hot.agg(F.count("*").alias("keys"), F.max("n").alias("rows")).first()
    bands = bands or max(FEWEST_BANDS, 1 << (told["rows"] // BAND_ROWS).bit_length())
    named = hot.drop("n")
    few = F.broadcast(named) if told["keys"] <= BROADCAST_KEYS else named
    cold_events = events.join(few, keys, "left_anti")
    hot_events = events.join(few, keys)
    return _read_whole_keys(cold_events, keys, period_us).unionByName(
        _read_cells(hot_events, period_us, bands, chunk_cells).drop("hot_id")
    )


def _written(df: DataFrame, name: str) -> DataFrame:
    """``df`` in the shared folder: read more than once, worked out once, safe from lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hot_keys(events: DataFrame, keys: list[str], hot_rows: int) -> DataFrame | None:
    """All keys of that many rows, with a number ``hot_id`` and about their rows ``n``, or None if there are none.

    The count only chooses between two exact ways to read a key, so it may look
    at a part of the rows: enough to see about ``SEEN_ROWS`` of a key at the
    limit, which keeps the shuffle of the count small. The results always come
    from all rows.
    """
    share = min(1.0, SEEN_ROWS / hot_rows)
    counted = events.select(*keys)
    if share < 1.0:
        counted = counted.sample(share, seed=7)
    large = counted.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") >= hot_rows * share)
    found = _written(
        large.select(*keys, (F.col("n") / share).cast("long").alias("n"), F.monotonically_increasing_id().alias("hot_id")), "hot-keys"
    )
    return None if found.isEmpty() else found


def reachable(following: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """What can be reached from ``heads`` (booleans); ``following`` has positions, or the length for none."""
    n = len(following)
    jump = np.append(following, n)
    reached = np.append(heads, False)
    while True:
        found = jump[np.flatnonzero(reached)]
        found = found[found < n]
        if not len(found):
            return reached[:n]
        reached[found] = True
        jump = jump[jump]


# -- keys read whole --------------------------------------------------------


def _read_whole_keys(events: DataFrame, keys: list[str], period_us: int) -> DataFrame:
    """One shuffle and one sort; keys and payload cross as Arrow columns, untouched."""
    order = ["at_us", "id"]
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) == 1
    ordered = (
        events.repartition(*keys).withColumn("starts_key", first).sortWithinPartitions(*keys, *order)
    )
    schema = T.StructType(
        events.schema.fields
        + [T.StructField("opener_id", T.LongType()), T.StructField("opener_us", T.LongType())]
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = None
        for batch in batches:
            starts, at, ids, eligible = (
                batch.column(c).to_numpy(zero_copy_only=False) for c in ("starts_key", "at_us", "id", "eligible")
            )
            eligible = np.equal(eligible, True)
            opener_us, covered, by = np.zeros(len(at), np.int64), np.zeros(len(at), bool), np.zeros(len(at), np.int64)
            for a, b in _safe_parts(starts, at, period_us):
                part = slice(a, b)
                carried = judge_range(
                    starts[part], at[part], ids[part], eligible[part], period_us, carried, opener_us[part], by[part], covered[part]
                )
            kept = [batch.column(f.name) for f in schema.fields[:-2]]
            openers = [pa.array(x, pa.int64(), mask=~covered) for x in (by, opener_us)]
            yield pa.RecordBatch.from_arrays([*kept, *openers], schema.names)

    return ordered.mapInArrow(scan, schema)


def _key_spans(starts: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First rows of the keys of a batch, and the time that each spans there."""
    firsts = np.flatnonzero(starts)
    if not len(firsts) or firsts[0] != 0:
        firsts = np.concatenate([[0], firsts])
    return firsts, at[np.append(firsts[1:], len(at)) - 1] - at[firsts]


def _safe_parts(starts: np.ndarray, at: np.ndarray, period_us: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose keys' spans, laid end to end, fit into 64 bits."""
    waiting = [(0, len(at))]
    while waiting:
        a, b = waiting.pop()
        if a == b:
            continue
        _, spans = _key_spans(starts[a:b], at[a:b])
        if b - a > 1 and float(spans.sum(dtype=np.float64)) + len(spans) * (period_us + 1.0) > 2.0**62:
            middle = (a + b) // 2
            waiting += [(middle, b), (a, middle)]
        else:
            yield a, b


def judge_range(
    starts: np.ndarray,
    at: np.ndarray,
    ids: np.ndarray,
    eligible: np.ndarray,
    period_us: int,
    carried: tuple[int, int] | None,
    opener_us: np.ndarray,
    opener_id: np.ndarray,
    covered: np.ndarray,
) -> tuple[int, int] | None:
    """Fill the last three for one range of sorted rows; ``carried`` is the last opener of the key that goes on."""
    n = len(at)
    firsts, spans = _key_spans(starts, at)
    sizes = np.diff(np.append(firsts, n))
    goes_on = not starts[0]
    carried = carried if goes_on else None
    # all keys on one time line, more than a period apart
    base = np.concatenate([[0], np.cumsum(spans[:-1] + period_us + 1)])
    line = at - np.repeat(at[firsts] - base, sizes)
    key = np.repeat(np.arange(len(firsts)), sizes)
    place = np.flatnonzero(eligible)
    times, of_key = line[place], key[place]
    following = np.searchsorted(times, times + period_us)
    inside = np.append(of_key, -1)[following] == of_key
    following = np.where(inside, following, len(place))
    heads = np.diff(of_key, prepend=-1) != 0
    if carried is not None and len(place) and of_key[0] == 0:
        # the key's first opener here comes after the period that is open
        heads[0] = False
        head = int(np.searchsorted(times, line[0] + (carried[0] + period_us - at[0])))
        if head < len(place) and of_key[head] == 0:
            heads[head] = True
    openers = place[reachable(following, heads)]
    last = np.full(n, -1)
    last[openers] = openers
    last = np.maximum.accumulate(last)
    own = last >= np.repeat(firsts, sizes)
    opener_us[:] = at[last]
    opener_id[:] = ids[last]
    if carried is not None:
        before = ~own & (key == 0)
        opener_us[before], opener_id[before] = carried
        own |= before
    covered[:] = own & (at - opener_us < period_us)
    if own[-1]:
        return int(opener_us[-1]), int(opener_id[-1])
    return None


# -- keys cut into cells ----------------------------------------------------

_CELL = "hot_id bigint, band int, slice bigint, leaves_at bigint"
_ENTERED = "hot_id bigint, band int, slice bigint"
_OPENER = "hot_id bigint, slice bigint, at_us bigint, id bigint"


def _read_cells(hot_events: DataFrame, period_us: int, bands: int, chunk_cells: int) -> DataFrame:
    offset = F.pmod("at_us", F.lit(period_us))
    placed = hot_events.withColumns(
        {
            "slice": F.expr(f"(at_us - pmod(at_us, {period_us}L)) div {period_us}L"),
            "band": F.floor(offset / (period_us / bands)).cast("int"),
        }
    )
    openers = _find_openers(placed.where("eligible"), period_us, bands, chunk_cells)

    # a covering opener lies in the event's slice or in the one before
    opener = F.struct("at_us", "id")
    seen_from = F.array(
        F.struct(F.col("slice"), opener.alias("own"), F.lit(None).alias("earlier")),
        F.struct((F.col("slice") + 1).alias("slice"), F.lit(None).alias("own"), opener.alias("earlier")),
    )
    per_slice = (
        openers.select("hot_id", F.inline(seen_from))
        .groupBy("hot_id", "slice")
        .agg(F.max("own").alias("own"), F.max("earlier").alias("earlier"))
    )
    opener = F.when(F.col("own") <= F.struct("at_us", "id"), F.col("own")).when(
        F.col("at_us") - F.col("earlier.at_us") < period_us, F.col("earlier")
    )
    return (
        placed.join(per_slice, ["hot_id", "slice"], "left")
        .withColumns({"opener_id": opener["id"], "opener_us": opener["at_us"]})
        .drop("own", "earlier", "slice", "band")
    )


def _find_openers(placed: DataFrame, period_us: int, bands: int, chunk_cells: int) -> DataFrame:
    # events at the same time count once, which folds copies before they are moved;
    # both passes below read this one shuffle
    rows = (
        placed.groupBy("hot_id", "band", "slice", "at_us")
        .agg(F.min("id").alias("id"))
        .withColumn("entered", F.lit(False))
    )

    def in_band_order(df: DataFrame) -> DataFrame:
        return df.repartition("hot_id", "band").sortWithinPartitions(
            "hot_id", "band", "slice", F.desc("entered"), "at_us", "id"
        )

    cells = in_band_order(rows).mapInPandas(lambda it: _follow_bands(it, period_us), _CELL)
    entered = _entered_cells(_written(cells, "cells"), bands, chunk_cells)
    # a mark in front of an entered cell's rows saves a join
    none = F.lit(0).cast("bigint")
    marks = entered.select(
        "hot_id", "band", "slice", none.alias("at_us"), none.alias("id"), F.lit(True).alias("entered")
    )
    return in_band_order(rows.unionByName(marks)).mapInPandas(
        lambda it: _openers_in_bands(it, period_us), _OPENER
    )


def _by_cell(frames: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[tuple[int, int, int, list[np.ndarray]]]:
    """Whole cells of rows in band order: hot_id, band, slice and the columns."""
    waiting: list[tuple[tuple, list[np.ndarray]]] = []

    def joined() -> tuple:
        place = waiting[0][0]
        parts = [np.concatenate(c) for c in zip(*(held for _, held in waiting))]
        waiting.clear()
        return (*place, parts)

    for frame in frames:
        if not len(frame):
            continue
        names = frame[["hot_id", "band", "slice"]].to_numpy()
        values = [frame[c].to_numpy() for c in columns]
        starts = np.flatnonzero(np.concatenate([[True], (names[1:] != names[:-1]).any(axis=1)]))
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(frame)]):
            place = tuple(names[a].tolist())
            if waiting and waiting[0][0] != place:
                yield joined()
            waiting.append((place, [v[a:b] for v in values]))
    if waiting:
        yield joined()


def _batched(rows: Iterator[tuple], columns: str, size: int = 50_000) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in columns.split(", ")]
    buffer: list[tuple] = []
    for row in rows:
        buffer.append(row)
        if len(buffer) == size:
            yield pd.DataFrame(buffer, columns=names)
            buffer = []
    if buffer:
        yield pd.DataFrame(buffer, columns=names)


def _follow_bands(frames: Iterator[pd.DataFrame], period_us: int) -> Iterator[pd.DataFrame]:
    """For each cell: the slice in which the chain from its first event leaves the band.

    Chains that meet stay together, so they are kept as groups of starting
    slices, in offset order: at most one group per event of the cell before.
    """

    def leaving() -> Iterator[tuple]:
        place, here = None, None
        chains: list[tuple[int, list[int]]] = []  # offset of the last opener, and the slices where these chains start

        def gone(slice_: int, left: list[tuple[int, list[int]]]) -> Iterator[tuple]:
            return ((*place, start, slice_) for _, starts in left for start in starts)

        for hot_id, band, slice_, (at,) in _by_cell(frames, ["at_us"]):
            if (hot_id, band) != place or slice_ != here + 1:
                if place is not None:
                    yield from gone(here + 1, chains)
                chains = []
            place, here = (hot_id, band), slice_
            offsets = at % period_us
            found = np.searchsorted(offsets, [o for o, _ in chains])
            stay = int(np.searchsorted(found, len(offsets)))
            yield from gone(here, chains[stay:])
            moved: dict[int, list[int]] = {0: [slice_]}
            for to, (_, starts) in zip(found[:stay].tolist(), chains):
                if to in moved:
                    # the longer list takes the shorter one
                    held = moved[to]
                    moved[to] = held + starts if len(held) < len(starts) else held
                    if moved[to] is held:
                        held.extend(starts)
                else:
                    moved[to] = starts
            chains = [(int(offsets[to]), starts) for to, starts in moved.items()]
        if place is not None:
            yield from gone(here + 1, chains)

    return _batched(leaving(), _CELL)


def _entered_cells(cells: DataFrame, bands: int, chunk_cells: int) -> DataFrame:
    """The cells a key's chain enters: after leaving a band, the next cell in time order.

    ``code`` numbers cells in time order; a chain that leaves goes on at the first code above its ``target``.
    """
    slices = max(1, chunk_cells // bands)
    width = slices * bands
    coded = cells.select(
        "hot_id",
        (F.col("slice") * bands + F.col("band")).alias("code"),
        (F.col("leaves_at") * bands + F.col("band")).alias("target"),
        F.floor(F.col("slice") / slices).alias("chunk"),
    )
    ends = coded.groupBy("hot_id").agg(F.min("code").alias("code"), (F.max("chunk") - F.min("chunk") + 1).alias("chunks"))
    ends = _written(ends, "chains")
    chunks = ends.agg(F.max("chunks")).first()[0] or 0
    firsts = ends.select("hot_id", "code")
    entries = firsts if chunks <= 1 else _chunk_entries(coded, firsts, width, chunks)
    entries = entries.select("hot_id", F.col("code").alias("entry"), F.floor(F.col("code") / width).alias("chunk"))

    def follow(rows: pa.Table) -> pa.Table:
        codes, following = _in_chunk(rows)
        reached = codes[reachable(following, codes == rows.column("entry")[0].as_py())]
        band = np.mod(reached, bands)
        hot = np.full(len(reached), rows.column("hot_id")[0].as_py())
        return pa.table({"hot_id": pa.array(hot, pa.int64()), "band": pa.array(band, pa.int32()), "slice": (reached - band) // bands})

    return coded.join(entries, ["hot_id", "chunk"]).groupBy("hot_id", "chunk").applyInArrow(follow, _ENTERED)


def _in_chunk(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The codes of a chunk in order, and the position each one's chain goes on at, or the length where it leaves."""
    codes, targets = rows.column("code").to_numpy(), rows.column("target").to_numpy()
    order = np.argsort(codes)
    codes = codes[order]
    return codes, np.searchsorted(codes, targets[order], side="right")


def _chunk_entries(coded: DataFrame, firsts: DataFrame, width: int, chunks: int) -> DataFrame:
    """Where the chain of each key comes into each chunk.

    Every cell gets a pointer to the cell of a later chunk at which a chain through it goes on: its last target in the chunk,
    then the first cell above that, looked up as of the target among the cells of the target's chunk or else at
    the start of the next one. Doubling these pointers takes as many joins as the number of chunks has binary digits.
    """

    def exits(rows: pa.Table) -> pa.Table:
        codes, following = _in_chunk(rows)
        targets = rows.column("target").to_numpy()[np.argsort(rows.column("code").to_numpy())]
        # the last cell of each chain within the chunk, by doubling to the end
        last = np.where(following < len(codes), following, np.arange(len(codes)))
        while not np.array_equal(last, last[last]):
            last = last[last]
        hot = np.full(len(codes), rows.column("hot_id")[0].as_py())
        return pa.table({"hot_id": pa.array(hot, pa.int64()), "code": codes, "target": targets[last]})

    left = _written(coded.groupBy("hot_id", "chunk").applyInArrow(exits, "hot_id bigint, code bigint, target bigint"), "chunk-exits")
    cells = left.select("hot_id", F.col("code").alias("at"), F.lit(False).alias("asks"), "code", F.col("code").alias("found"))
    asked = left.select("hot_id", F.col("target").alias("at"), F.lit(True).alias("asks"), "code", F.lit(None).cast("long").alias("found"))
    seen = cells.unionByName(asked).withColumn("chunk", F.floor(F.col("at") / width))
    # from the latest cell to the earliest: the smallest code above the target
    above = Window.partitionBy("hot_id", "chunk").orderBy(F.desc("at"), F.desc("asks")).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("hot_id").orderBy("chunk").rowsBetween(1, Window.unboundedFollowing)
    starts = seen.groupBy("hot_id", "chunk").agg(F.min("found").alias("first")).withColumn("later", F.min("first").over(after))
    links = (
        seen.withColumn("near", F.min("found").over(above)).where("asks")
        .join(starts.select("hot_id", "chunk", "later"), ["hot_id", "chunk"])
        .select("hot_id", "code", F.coalesce("near", "later").alias("next"))
        .where("next IS NOT NULL")
    )
    jumps, reached = _written(links, "chunk-links"), firsts
    for _ in range((chunks - 1).bit_length()):
        further = reached.join(jumps, ["hot_id", "code"]).select("hot_id", F.col("next").alias("code"))
        reached = _written(reached.unionByName(further), "chunk-entries")
        twice = jumps.select("hot_id", F.col("code").alias("next"), F.col("next").alias("over"))
        jumps = _written(jumps.join(twice, ["hot_id", "next"]).select("hot_id", "code", F.col("over").alias("next")), "chunk-links")
    return reached


def _openers_in_bands(frames: Iterator[pd.DataFrame], period_us: int) -> Iterator[pd.DataFrame]:
    """Follow a band again, this time only from the cells that were entered."""

    def openers() -> Iterator[tuple]:
        place, opener = None, None  # opener: (slice, offset) of the last one in this band
        for hot_id, band, slice_, (at, ids, entered) in _by_cell(frames, ["at_us", "id", "entered"]):
            if (hot_id, band) != place:
                place, opener = (hot_id, band), None
            first = int(bool(entered[0]))
            to = first
            if not first:
                if opener is None or slice_ != opener[0] + 1:
                    continue
                to = int(np.searchsorted(at % period_us, opener[1]))
            if to < len(at):
                opener = (slice_, int(at[to]) % period_us)
                yield hot_id, slice_, int(at[to]), int(ids[to])

    return _batched(openers(), _OPENER)

