"""Sum-of-squares online packing of documents into fixed windows.

A document is its ids and an end id. It is cut at multiples of the window from its start; full pieces are
sequences of their own. Every other piece goes, as it comes, where the sum over all fill levels of
the squared number of windows at that level grows least: into a window at some level, or into a new
one. Only an array with the number of windows at each level is needed to decide, and that rule keeps
levels even, so that a piece of almost any size finds a window it completes.

Texts are read once, where they lie; only piece lengths are exchanged. They are range-partitioned
by the given order, and each partition is a lane with a level array of its own: about ``LANE_PIECES`` pieces,
so that the few windows left open at a lane's end weigh little, and memory does not grow with the input.

Cases: a null or empty text is the end id alone; null identifiers are packed like others; repeated rows are
packed each; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.llm import tokens
from shelfcast.llm.common import stored

WINDOW = 4096
LANE_PIECES = 65_536
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, path: str, key: str, text: str, order: list[Column], window: int) -> DataFrame:
    """Every document's pieces, with the values of ``order``."""
    read = docs.select(F.col(key).alias("doc_id"), F.struct(*order).alias("order"), F.col(text).alias("text"))
    schema = read.drop("text").schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, starts, lengths, sums, totals = [], [], [], [], []
            for i, ids in tokens.encoded(path, batch.column("text").to_pylist()):
                ids = np.append(ids, np.uint32(tokens.END_ID)).astype("<u4")
                for at in range(0, len(ids), window):
                    piece = ids[at : at + window]
                    rows.append(i)
                    starts.append(at)
                    lengths.append(len(piece))
                    sums.append(zlib.crc32(piece.tobytes()))
                    totals.append(len(ids))
            own = batch.select(["doc_id", "order"]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*own.columns, *(pa.array(x, pa.int64()) for x in (starts, lengths, sums, totals))],
                ["doc_id", "order", "start", "length", "ids_crc32", "doc_tokens"],
            )

    for name in ("start", "length", "ids_crc32", "doc_tokens"):
        schema = schema.add(name, "long")
    return read.mapInArrow(cut, schema)


class Levels:
    """Open windows by fill level."""

    def __init__(self, window: int, first_id: int = 0):
        self.window, self.next_id = window, first_id
        self.count = np.zeros(window + 1, dtype=np.int64)
        self.open: dict[int, list[int]] = defaultdict(list)

    def place(self, size: int) -> tuple[int, int]:
        """The sequence and the offset there for a piece of ``size`` ids."""
        best, level = 2 * self.count[size] + (size < self.window), 0
        found = np.flatnonzero(self.count[1 : self.window - size + 1]) + 1
        if len(found):
            to = found + size
            cost = 2 * (self.count[to] - self.count[found]) + 1 + (to < self.window)
            # of equal costs the fullest window
            k = len(cost) - 1 - int(np.argmin(cost[::-1]))
            if cost[k] <= best:
                level = int(found[k])
        if level:
            sequence = self.open[level].pop()
            self.count[level] -= 1
        else:
            sequence, self.next_id = self.next_id, self.next_id + 1
        filled = level + size
        if filled < self.window:
            self.open[filled].append(sequence)
            self.count[filled] += 1
        return sequence, level


def packed(
    docs: DataFrame,
    path: str | None = None,
    key: str = "doc_id",
    text: str = "text",
    order: list[Column] | None = None,
    window: int = WINDOW,
    lane_pieces: int = LANE_PIECES,
) -> DataFrame:
    """One row per piece with its sequence and its offset there; pieces are taken in ``order`` (by default: by key)."""
    cut = stored(pieces(docs, path or tokens.default_path(), key, text, order or [F.col(key).alias("key")], window), "pieces")
    lanes = max(1, round(cut.count() / lane_pieces))

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        levels = None
        for rows in batches:
            if levels is None and len(rows):
                levels = Levels(window, int(rows["lane"].iloc[0]) << 40)
            spots = [levels.place(int(n)) for n in rows["length"]]
            rows["sequence_id"] = np.array([s for s, _ in spots], dtype=np.int64)
            rows["offset"] = np.array([o for _, o in spots], dtype=np.int64)
            yield rows.drop(columns="lane")

    rest = F.xxhash64("doc_id", "start", "ids_crc32")
    return (
        cut.repartitionByRange(lanes, "order", "start", rest)
        .sortWithinPartitions("order", "start", rest)
        .select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.spark_partition_id().cast("long").alias("lane"))
        .mapInPandas(fill, PIECE + ", sequence_id long, offset long")
    )
