"""Interleaving sources to target weights by Pfair scheduling.

Every source's documents are cut into blocks. While no source has run out, a source of weight w out of W is
to have w/W of the slots; when one has given all its blocks, its share goes to the others by their weights. After t
slots this gives every source a target, a fraction of blocks. Block i is released at the last slot that begins before the
target passes i, and due at the first that ends with i + 1 or more reached; in every slot the released block that is due first
goes out. The targets add up to t, so every block meets its window and no source is ever a whole block ahead of or behind
its target. Weights are taken as the exact fractions that they are and windows are whole-number arithmetic: nothing
is rounded, so the bound holds however many blocks there are.

Every source has blocks and windows of its own, however many sources there are; those without a weight given by hand
share that of the others by their blocks. No document is dropped or repeated.

Documents are numbered within their source by hash bucket: the totals of the earlier buckets plus
the rank within the bucket. So a source with most of the rows is numbered by as many tasks as others.

Bounds: one task walks over the blocks, a row in ``BLOCK_ROWS`` of the table, without reading documents. It holds a few
numbers per source, and the blocks of unfinished parts of ``CHUNK``. The schedule is sent to every executor
up to ``BROADCAST_BLOCKS``, beyond that it is joined.

Cases: documents without a source are a source; null identifiers and repeated rows are numbered like
others, ties in an arbitrary order; empty and null texts are documents; a source without documents takes
no slots; a weight that is not positive is refused; an empty table gives an empty result; further columns are
kept by ``interleaved``.
"""

from __future__ import annotations

import heapq
import math
from array import array
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.llm.common import stored, whole_row

BLOCK_ROWS = 32
QUANTUM = 1024
BUCKETS = 1024
# blocks of a source in one row of the schedule, and blocks of a schedule that may be sent to every executor: 16 bytes each
CHUNK, BROADCAST_BLOCKS = 64, 1_000_000
# what stands for a missing source and for all sources without a weight of their own
NO_SOURCE, OTHERS = "\x00none", "\x00others"


def shares(weights: dict[str, float], quantum: int = QUANTUM) -> dict[str, int]:
    """Whole shares of a period, at least one each, by largest remainder."""
    if not weights:
        return {}
    if any(not w > 0 for w in weights.values()):
        raise ValueError("weights must be positive")
    if len(weights) > quantum:
        raise ValueError(f"a period of {quantum} slots has no whole share for each of {len(weights)} sources")
    spare, total = quantum - len(weights), sum(weights.values())
    exact = {s: spare * w / total for s, w in weights.items()}
    whole = {s: 1 + int(x) for s, x in exact.items()}
    by_rest = sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s))
    for s in by_rest[: quantum - sum(whole.values())]:
        whole[s] += 1
    return whole


def period(share: dict[str, int]) -> dict[str, list[int]]:
    """Earliest deadline first over one period: the slots of every source's blocks."""
    length = sum(share.values())
    slots: dict[str, list[int]] = {s: [] for s in share}
    released: dict[int, list[str]] = {0: sorted(share)}
    ready: list[tuple[int, str]] = []
    for t in range(length):
        for s in released.pop(t, []):
            heapq.heappush(ready, (-(-(len(slots[s]) + 1) * length // share[s]), s))
        _, s = heapq.heappop(ready)
        slots[s].append(t)
        i = len(slots[s])
        if i < share[s]:
            released.setdefault(max(t + 1, i * length // share[s]), []).append(s)
    return slots


def phases(blocks: dict[str, int], weights: dict[str, float], quantum: int = QUANTUM) -> list[dict]:
    """For each phase and source: its first block, the first after, the phase's first slot, and the slots of a period."""
    done, start, out = dict.fromkeys(blocks, 0), 0, []
    while left := {s: n - done[s] for s, n in blocks.items() if n > done[s]}:
        share = shares({s: weights[s] for s in left}, quantum)
        slots = period(share)
        length = sum(share.values())
        ends = min((n - 1) // share[s] * length + slots[s][(n - 1) % share[s]] + 1 for s, n in left.items())
        for s in left:
            took = ends // length * share[s] + sum(t < ends % length for t in slots[s])
            if took:
                out.append(
                    {"source": s, "first": done[s], "after": done[s] + took, "start": start, "length": length, "slots": slots[s]}
                )
            done[s] += took
        start += ends
    return out


def scheduled(blocks: dict[str, int], weights: dict[str, Fraction]) -> Iterator[tuple[str, int]]:
    """The source and number of the block of every slot, in order: earliest deadline first."""
    scale = math.lcm(*(w.denominator for w in weights.values()))
    weight = {s: int(weights[s] * scale) for s in blocks}
    # sources in the order in which their targets are reached, with the blocks and the weight of those that end before
    ending = sorted(blocks, key=lambda s: Fraction(blocks[s], weight[s]))
    ended, left = [0], [sum(weight.values())]
    for s in ending:
        ended.append(ended[-1] + blocks[s])
        left.append(left[-1] - weight[s])

    def reached(s: str, i: int) -> tuple[int, bool]:
        """The time in slots at which the target of ``s`` is i: its whole part, and whether it is whole."""
        low, high = 0, len(ending) - 1
        while low < high:
            middle = (low + high) // 2
            if blocks[ending[middle]] * weight[s] < i * weight[ending[middle]]:
                low = middle + 1
            else:
                high = middle
        whole, rest = divmod(left[low] * i, weight[s])
        return ended[low] + whole, not rest

    def window(s: str, i: int) -> int:
        whole, even = reached(s, i + 1)
        next_release[s] = whole
        return whole if even else whole + 1

    next_release: dict[str, int] = {}
    ready = [(window(s, 0), s, 0) for s in sorted(blocks)]
    heapq.heapify(ready)
    waiting: list[tuple[int, str, int]] = []
    for t in range(sum(blocks.values())):
        while waiting and waiting[0][0] <= t:
            _, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (window(s, i), s, i))
        due, s, i = heapq.heappop(ready)
        if due <= t:
            raise AssertionError(f"block {i} of {s!r} is late")
        yield s, i
        if i + 1 < blocks[s]:
            heapq.heappush(waiting, (next_release[s], s, i + 1))


def targets(blocks: dict[str, int], sizes: dict[str, int], weights: dict[str, float] | None, others: float, power: float) -> dict[str, Fraction]:
    """Every source's weight: the given one, its part of the others' by blocks, or its size to a power if none is given."""
    if weights is None:
        return {s: Fraction(n**power) for s, n in sizes.items()}
    rest = sum(n for s, n in blocks.items() if s not in weights)
    together = Fraction(weights.get(OTHERS, others))
    return {s: Fraction(weights[s]) if s in weights else together * n / rest for s, n in blocks.items()}


def schedule(sizes: DataFrame, weights: dict[str, float] | None, others: float, power: float, block_rows: int, quantum: int | None) -> DataFrame:
    """Slots and first positions of all blocks, ``CHUNK`` of a source in a row, from ``sizes(source, n)``."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[str, int] = {}
        for batch in batches:
            rows.update(zip(batch.column("own").to_pylist(), batch.column("n").to_pylist()))
        if not rows:
            return
        blocks = {s: -(-n // block_rows) for s, n in rows.items()}
        wanted = targets(blocks, rows, weights, others, power)
        if quantum:
            wanted = {s: Fraction(q) for s, q in shares(wanted, quantum).items()}
        open_: dict[str, tuple[array, array]] = {}
        out: list[tuple] = []
        place = 0

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in out], pa.string()),
                    pa.array([r[1] for r in out], pa.int64()),
                    pa.array([r[2] for r in out], pa.list_(pa.int64())),
                    pa.array([r[3] for r in out], pa.list_(pa.int64())),
                ],
                ["own", "chunk", "slots", "places"],
            )

        for t, (s, i) in enumerate(scheduled(blocks, wanted)):
            slots, places = open_.setdefault(s, (array("q"), array("q")))
            slots.append(t)
            places.append(place)
            place += min(block_rows, rows[s] - i * block_rows)
            if len(slots) == CHUNK or i + 1 == blocks[s]:
                out.append((s, i // CHUNK, slots, places))
                del open_[s]
            if len(out) == 1000:
                yield told()
                out.clear()
        if out:
            yield told()

    kind = "own string, chunk long, slots array<long>, places array<long>"
    return stored(sizes.coalesce(1).mapInArrow(walk, kind), "schedule")


def tempered_weights(docs: DataFrame, source: str = "source", power: float = 0.5, most: int | None = None) -> dict[str, float]:
    """Targets between the sources' own sizes (power 1) and equal shares (power 0).

    With ``most``, only the largest sources have their own; the others together have that of a source as large as all of them.
    """
    sizes = docs.groupBy(source_of(source).alias("source")).count()
    ordered = sizes.orderBy(F.desc("count"), "source")
    largest = (ordered if most is None else ordered.limit(most)).collect()
    weights = {r["source"]: r["count"] ** power for r in largest}
    if len(largest) == most:
        rest = sizes.agg(F.sum("count")).first()[0] - sum(r["count"] for r in largest)
        weights |= {OTHERS: rest**power} if rest else {}
    return weights


def source_of(source: str = "source") -> Column:
    return F.coalesce(F.col(source).cast("string"), F.lit(NO_SOURCE))


def _numbered(docs: DataFrame, key: str, text: str, source: str, buckets: int, rows: bool) -> tuple[DataFrame, DataFrame]:
    """Every row with its number within its source, and the sizes of the sources."""
    order = F.xxhash64(key, text)
    found = docs.select(
        source_of(source).alias("own"),
        F.pmod(order, F.lit(buckets)).cast("int").alias("bucket"),
        F.col(key).alias("doc_id"),
        order.alias("order"),
        *([whole_row(docs)] if rows else []),
    )
    totals = stored(found.groupBy("own", "bucket").agg(F.count(F.lit(1)).alias("n")), "source-buckets")
    before = Window.partitionBy("own").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("own", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    inside = Window.partitionBy("own", "bucket").orderBy("order", F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(inside))
    numbered = ranked.join(starts, ["own", "bucket"])
    sizes = totals.groupBy("own").agg(F.sum("n").alias("n"))
    return numbered.withColumn("number", F.col("earlier") + F.col("rank") - 1), sizes


def mixed(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    others: float = 1.0,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    block_rows: int = BLOCK_ROWS,
    quantum: int | None = None,
    buckets: int = BUCKETS,
    rows: bool = True,
    power: float = 0.5,
) -> DataFrame:
    """Every document with its source, its source's block, the block's slot, and its gapless position in the mix.

    With ``rows`` the whole documents come along, as a struct. ``weights`` are the targets of named sources, ``others`` that of all
    the rest together, unless it is among them; ``mixed_source`` is the source that has the target. Without ``weights``
    every source's target is its size to ``power``. ``quantum`` asks for targets in whole shares of so many.
    """
    if any(not w > 0 for w in [*(weights or {}).values(), others]):
        raise ValueError("weights must be positive")
    numbered, sizes = _numbered(docs, key, text, source, buckets, rows)
    plan = schedule(sizes, weights, others, power, block_rows, quantum)
    few = (plan.agg(F.sum(F.size("slots"))).first()[0] or 0) <= BROADCAST_BLOCKS
    block = F.floor(F.col("number") / block_rows)
    own = F.col("own")
    named = own if weights is None else F.when(own.isin(list(weights)), own).otherwise(F.lit(OTHERS))
    within = (F.col("block") % CHUNK).cast("int")
    return (
        numbered.withColumn("block", block)
        .withColumn("chunk", F.floor(F.col("block") / CHUNK))
        .join(F.broadcast(plan) if few else plan, ["own", "chunk"])
        .select(
            "doc_id",
            named.alias("mixed_source"),
            F.nullif(own, F.lit(NO_SOURCE)).alias("source"),
            "block",
            F.get("slots", within).alias("slot"),
            (F.get("places", within) + F.col("number") % block_rows).alias("position"),
            *(["row"] if rows else []),
        )
    )


def interleaved(docs: DataFrame, weights: dict[str, float] | None = None, others: float = 1.0, **options) -> DataFrame:
    """The documents with all their columns, in the order of the mix: by partition, then by row."""
    placed = mixed(docs, weights, others, **options)
    return placed.repartitionByRange("position").sortWithinPartitions("position").select("row.*")
