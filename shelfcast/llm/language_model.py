"""Quality by perplexity under an interpolated modified Kneser-Ney n-gram model of trusted text.

The model's symbols are the bytes of the text in UTF-8, so any language and any misspelt word has a probability, and
an n-gram is one 64-bit number. All trusted documents are counted, whole.

1. Where documents lie, they are gathered into blocks of ``BLOCK_BYTES``. A block asks for each n-gram
   that occurs in it once, and adds the counts of its trusted documents. Requests are cut into shards by a hash of the n-gram.
2. From the summed counts follow continuation counts, discounts and back-off weights of every order, and the
   probability of every n-gram that was asked for, all by joins and groupings.
3. Requests meet the probabilities by shard; the answers go back to their blocks, where the documents are scored. A shard's
   requests grow with the text and its probabilities hardly do, so blocks are dealt to lanes: as many as
   keep a shard's requests of one lane at ``LANE_BYTES``, each with the shard's probabilities.

So what is exchanged is each block's distinct n-grams instead of every occurrence, and no table is held whole
anywhere.

A document that a model was trained on is no surprise to it. So a second model counts one half of the trusted
documents only, and a language's threshold is a quantile of the other half's perplexity under that one. A language with too few
for that quantile has its median plus what all languages' documents are above their own. A few words say little, so
for the comparison every document is taken as if ``PRIOR_BYTES`` of average text came with it.

The two readings of the documents must give the same blocks, so the input has to be a stored table; each block carries a
checksum, and a difference ends the job.

Cases: null and empty texts have no perplexity and are not kept; a missing language is a language; languages with few trusted
documents held out use the threshold of all; texts of any length are scored whole; repeated rows are scored each; a null identifier is never
trusted; without trusted documents nothing has a threshold and every document with text is kept; an empty table gives an empty result;
further columns are kept by ``good_documents`` only.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.common import shuffle_partitions, stored
from shelfcast.llm.shingles import mixed

ORDER = 5
BLOCK_BYTES = 6_000_000
# n-grams that the blocks of a lane ask of a shard, at 8 bytes each
LANE_BYTES = 64_000_000
# identifiers of trusted documents that may be sent to every executor: 16 bytes each
BROADCAST_ROWS = 2_000_000
# share of a language's trusted documents below the threshold, and how many it takes for a median of its own; a quantile
# of its own takes 1 / (1 - QUANTILE), as with fewer one outlier would set it
QUANTILE, LEAST_TRUSTED = 0.995, 50
PRIOR_BYTES = 32
# perplexities are compared by their logarithm in thousandths
STEPS = 1000
# discounts where too few n-grams were seen to estimate them
DEFAULT_DISCOUNTS = (0.5, 1.0, 1.5)


class Grams:
    """The n-grams of some texts, one per byte, each with the bytes before it; texts start with empty bytes."""

    def __init__(self, texts: list[str | None], order: int):
        parts, pad = [], bytes(order - 1)
        for text in texts:
            parts += [pad, (text or "").encode("utf-8", "replace")]
        data = b"".join(parts)
        self.checksum = zlib.crc32(data)
        self.sizes = np.fromiter((len(p) for p in parts[1::2]), np.int64, len(texts))
        flat = np.frombuffer(data, dtype=np.uint8)
        self.starts = np.cumsum(self.sizes) - self.sizes
        keys = np.zeros(max(0, len(flat) - order + 1), dtype=np.int64)
        for k in range(order):
            keys <<= 8
            keys |= flat[k : k + len(keys)]
        # windows that end in the empty bytes before the next text are not n-grams of any
        gaps = (self.starts + self.sizes + np.arange(len(texts)) * (order - 1))[:-1]
        real = np.ones(len(keys), dtype=bool)
        for k in range(order - 1):
            real[gaps + k] = False
        self.keys = keys[real] if len(texts) > 1 else keys

    def of(self, i: int) -> np.ndarray:
        return self.keys[self.starts[i] : self.starts[i] + self.sizes[i]]


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (mixed(keys.view(np.uint64)) % np.uint64(shards)).astype(np.int64)


def blocks_of(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[int, pa.Table]]:
    """The task's rows in order, in numbered blocks of about ``BLOCK_BYTES`` of text."""
    first = TaskContext.get().partitionId() << 32
    waiting, held, number = [], 0, 0
    for batch in batches:
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_numpy()
        at = 0
        while at < len(sizes):
            # as many rows as still fit, one at least
            fits = int(np.searchsorted(np.cumsum(sizes[at:]), BLOCK_BYTES - held, side="right"))
            if fits == 0 and not waiting:
                fits = 1
            if fits:
                waiting.append(batch.slice(at, fits))
                held += int(sizes[at : at + fits].sum())
                at += fits
            if at < len(sizes):
                yield first + number, pa.Table.from_batches(waiting)
                waiting, held, number = [], 0, number + 1
    if waiting:
        yield first + number, pa.Table.from_batches(waiting)


def requests(flagged: DataFrame, text: str, order: int, shards: int) -> DataFrame:
    """Per block and shard: the distinct n-grams, and how often all and half of the trusted documents have each."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in blocks_of(batches, text):
            grams = Grams(rows.column(text).to_pylist(), order)
            keys = np.unique(grams.keys)
            counts, half = np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=np.int64)
            trusted, held_out = rows.column("trusted").to_numpy(), rows.column("held_out").to_numpy()
            for wanted, into in ((trusted & ~held_out, (counts, half)), (held_out, (counts,))):
                if wanted.any():
                    some, n = np.unique(np.concatenate([grams.of(i) for i in np.flatnonzero(wanted)]), return_counts=True)
                    for c in into:
                        c[np.searchsorted(keys, some)] += n
            shard = shard_of(keys, shards)
            order_by_shard = np.argsort(shard, kind="stable")
            cuts = np.searchsorted(shard[order_by_shard], np.arange(1, shards))
            parts = [p for p in np.split(order_by_shard, cuts)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([block] * shards, pa.int64()),
                    pa.array([grams.checksum] * shards, pa.int64()),
                    pa.array(range(shards), pa.int32()),
                    pa.array([keys[p] for p in parts], pa.list_(pa.int64())),
                    pa.array([counts[p] for p in parts], pa.list_(pa.int64())),
                    pa.array([half[p] for p in parts], pa.list_(pa.int64())),
                    pa.array([len(p) for p in parts], pa.int32()),
                ],
                ["block", "checksum", "shard", "grams", "counts", "half", "n_grams"],
            )

    kind = "block long, checksum long, shard int, grams array<long>, counts array<long>, half array<long>, n_grams int"
    return flagged.select(text, "trusted", "held_out").mapInArrow(ask, kind)


def discounts(grams: DataFrame, models: list[str]) -> dict[str, tuple[float, float, float]]:
    """Each model's three discounts of an order, from how many n-grams occur once to four times."""
    times = [F.count_if(F.col(m) == i).alias(f"{m}_{i}") for m in models for i in (1, 2, 3, 4)]
    told = grams.agg(*times).first()
    out = {}
    for m in models:
        n1, n2, n3, n4 = (told[f"{m}_{i}"] for i in (1, 2, 3, 4))
        out[m] = DEFAULT_DISCOUNTS
        if n1 and n2 and n3:
            y = n1 / (n1 + 2 * n2)
            found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
            out[m] = tuple(d if 0 < d <= i else default for i, d, default in zip((1, 2, 3), found, DEFAULT_DISCOUNTS))
    return out


def suffix(order: int) -> Column:
    """The n-gram without its first byte, for n-grams of ``order`` bytes."""
    return F.col("gram").bitwiseAND(F.lit((1 << 8 * (order - 1)) - 1))


def probabilities(asked: DataFrame, models: list[str], order: int = ORDER) -> DataFrame:
    """Every n-gram asked for with its probability under each model, in place of its counts.

    ``asked`` has a row for each n-gram and, under the name of each model, how often that model's text has it. The probability
    is that of the last byte after the others, interpolated over all orders down to the uniform distribution.
    """
    grams = {order: asked}
    for k in range(order, 1, -1):
        # in how many longer n-grams it occurs; the row is there even if in none
        seen = [F.count_if(F.col(m) > 0).alias(m) for m in models]
        grams[k - 1] = stored(grams[k].groupBy(suffix(k).alias("gram")).agg(*seen), "continuations")
    below = None
    for k in range(1, order + 1):
        context = F.shiftright("gram", 8).alias("context")
        taken = {
            m: F.when(F.col(m) == 1, d[0]).when(F.col(m) == 2, d[1]).when(F.col(m) > 2, d[2]).otherwise(0.0)
            for m, d in discounts(grams[k], models).items()
        }
        sums = [F.sum(m).alias(f"{m}_total") for m in models] + [F.sum(taken[m]).alias(f"{m}_given") for m in models]
        contexts = grams[k].groupBy(context).agg(*sums)
        rows = grams[k].select("gram", *models, context, suffix(k).alias("tail")).join(contexts, "context")
        if below is not None:
            rows = rows.join(below.select(F.col("gram").alias("tail"), *[F.col(m).alias(f"{m}_low") for m in models]), "tail")

        def interpolated(m: str, first: bool) -> Column:
            low, total = F.lit(1 / 256) if first else F.col(f"{m}_low"), F.col(f"{m}_total")
            # a context that was never seen leaves it to the lower order
            return F.when(total > 0, (F.col(m) - taken[m] + F.col(f"{m}_given") * low) / total).otherwise(low).alias(m)

        below = stored(rows.select("gram", *[interpolated(m, below is None) for m in models]), "probabilities")
    return below


def lanes_of(asked: DataFrame, shards: int) -> int:
    """How many lanes the blocks are dealt to, from the number of n-grams that they ask for."""
    total = asked.agg(F.sum("n_grams")).first()[0] or 0
    return max(1, -(-8 * total // (shards * LANE_BYTES)))


def answers(asked: DataFrame, found: DataFrame, shards: int, lanes: int) -> DataFrame:
    """Per block and shard: the logarithms of both models' probabilities, in the order of the request's n-grams."""

    @F.pandas_udf("int")
    def shard(grams: pd.Series) -> pd.Series:
        return pd.Series(shard_of(grams.to_numpy(), shards).astype(np.int32))

    def reply(requested: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values("gram")
        keys = table["gram"].to_numpy()
        at = [np.searchsorted(keys, np.asarray(g, dtype=np.int64)) for g in requested["grams"]]
        out = requested[["block", "checksum", "shard"]].copy()
        for name in ("whole", "half"):
            logs = np.log(table[name].to_numpy()).astype(np.float32)
            out[name] = pd.Series([logs[i].tobytes() for i in at], index=out.index, dtype=object)
        return out

    own_lane = F.pmod(F.xxhash64("block"), F.lit(lanes)).cast("int").alias("lane")
    every_lane = F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane")
    table = found.select("gram", "whole", "half", shard("gram").alias("shard")).select("*", every_lane)
    return (
        asked.select("block", "checksum", "shard", "grams", own_lane)
        .groupBy("shard", "lane")
        .cogroup(table.groupBy("shard", "lane"))
        .applyInPandas(reply, "block long, checksum long, shard int, whole binary, half binary")
    )


def scored(flagged: DataFrame, replies: DataFrame, text: str, order: int, shards: int, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of every row, with its length in bytes and the logarithms of its perplexity.

    The second one, ``unseen``, is that under the half model, for documents held out of it.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in blocks_of(batches, text):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema) as writer:
                writer.write_table(rows)
            packed = zstandard.ZstdCompressor(level=3).compress(sink.getvalue())
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([packed], pa.binary())], ["block", "rows"])

    def score(packed: pa.Table, replied: pa.Table) -> pa.Table:
        if not packed.num_rows:
            return target.empty_table()
        data = zstandard.ZstdDecompressor().decompress(packed.column("rows")[0].as_py())
        rows = pa.ipc.open_stream(data).read_all()
        grams = Grams(rows.column(text).to_pylist(), order)
        if replied.num_rows != shards or set(replied.column("checksum").to_pylist()) != {grams.checksum}:
            raise RuntimeError("the documents differ between two readings; write them to a table first")
        by_gram = np.argsort(grams.keys)
        ordered = grams.keys[by_gram]
        new = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, bool)
        keys = ordered[new]
        shard, place = shard_of(keys, shards), np.cumsum(new) - 1
        held_out = rows.column("held_out").to_numpy()
        out = rows.select(keep).append_column("n_bytes", pa.array(grams.sizes, pa.int64()))
        for name, model, known in (("log_perplexity", "whole", grams.sizes > 0), ("unseen", "half", held_out & (grams.sizes > 0))):
            mean = np.zeros(len(grams.sizes))
            if known.any():
                logs = np.zeros(len(keys))
                for s, values in zip(replied.column("shard").to_pylist(), replied.column(model).to_pylist()):
                    logs[shard == s] = np.frombuffer(values, dtype=np.float32)
                each = np.empty(len(ordered))
                each[by_gram] = logs[place]
                until = np.concatenate([[0.0], np.cumsum(each)])
                sums = until[grams.starts + grams.sizes] - until[grams.starts]
                mean = -sums / np.maximum(grams.sizes, 1)
            out = out.append_column(name, pa.array(mean, pa.float64(), mask=~known))
        return out.cast(target)

    from pyspark.sql.pandas.types import to_arrow_schema

    kept = flagged.select(*[F.col(f"`{c}`") for c in keep]).schema
    kept = kept.add("n_bytes", "long").add("log_perplexity", "double").add("unseen", "double")
    target = to_arrow_schema(kept)
    own = flagged.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, text, "held_out"])])
    packed = own.mapInArrow(pack, "block long, rows binary")
    return packed.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(score, kept)


def average(scores: DataFrame) -> float:
    """Mean logarithm of the held-out documents' perplexity, by bytes."""
    told = scores.where("unseen is not null").agg(F.sum(F.col("unseen") * F.col("n_bytes")) / F.sum("n_bytes")).first()
    return told[0] or 0.0


def step_of(log_perplexity: str, mean: float) -> Column:
    """The logarithm in thousandths, drawn to the average for short texts."""
    n = F.col("n_bytes")
    smoothed = (F.col(log_perplexity) * n + mean * PRIOR_BYTES) / (n + PRIOR_BYTES)
    return F.round(smoothed * STEPS).cast("long")


def thresholds(scores: DataFrame, mean: float, quantile: float = QUANTILE, least: int = LEAST_TRUSTED) -> DataFrame:
    """(language, limit): the quantile of held-out documents' steps, exact, from the counts of each step; never the largest.

    Languages with too few documents for the quantile, but ``least`` at least, get their median plus the quantile of
    how far such languages' documents are above their medians.
    """
    seen = scores.where("unseen is not null").groupBy(language().alias("language"), step_of("unseen", mean).alias("step"))
    both = stored(seen.agg(F.count(F.lit(1)).alias("n")), "perplexity-steps")
    enough = round(1 / (1 - quantile)) if quantile < 1 else math.inf

    def together(counts: DataFrame) -> DataFrame:
        return counts.groupBy("step").agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("language"), "step", "n")

    def limits(counts: DataFrame, share: float) -> DataFrame:
        # a row per step of 1/1000, of which a language has some thousands
        listed = counts.groupBy("language").agg(F.sum("n").alias("total"), F.sort_array(F.collect_list(F.struct("step", "n"))).alias("steps"))
        start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("limit"))
        needed = F.greatest(F.lit(1), F.least(F.ceil(F.col("total") * share), F.col("total") - 1))

        def walk(state: Column, x: Column) -> Column:
            now = state["seen"] + x["n"]
            limit = F.when(state["limit"].isNotNull(), state["limit"]).when(now >= needed, x["step"])
            return F.struct(now.alias("seen"), limit.alias("limit"))

        return listed.select("language", "total", F.aggregate("steps", start, walk)["limit"].alias("limit"))

    own = limits(both, quantile).where(F.col("total") >= enough)
    medians = stored(limits(both, 0.5).where(F.col("total") >= least), "perplexity-medians")
    above = both.join(medians.select("language", F.col("limit").alias("median")), "language")
    excess = limits(together(above.select((F.col("step") - F.col("median")).alias("step"), "n")), quantile)
    few = medians.where(F.col("total") < enough).crossJoin(excess.select(F.col("limit").alias("excess")))
    few = few.select("language", "total", (F.col("limit") + F.col("excess")).alias("limit"))
    return own.unionByName(few).unionByName(limits(together(both), quantile)).select("language", "limit")


def language(column: str = "lang") -> Column:
    return F.coalesce(F.col(column), F.lit("\x00none"))


def judged(scores: DataFrame, limits: DataFrame, mean: float) -> DataFrame:
    """Scores with the limit of their language, or of all, and whether the document is kept."""
    common = limits.where("language is null").agg(F.max("limit")).first()[0]
    own = limits.where("language is not null").select("language", F.col("limit").alias("own"))
    limit = F.coalesce("own", F.lit(common).cast("long"))
    return (
        scores.withColumn("language", language())
        .join(own, "language", "left")
        .withColumn("step", step_of("log_perplexity", mean))
        .withColumn("limit", limit)
        .withColumn("kept", F.col("log_perplexity").isNotNull() & (F.col("limit").isNull() | (F.col("step") <= F.col("limit"))))
        .drop("language", "own")
    )


def flagged_documents(docs: DataFrame, trusted: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents as a struct with key, text, language and whether they are trusted."""
    ids = stored(trusted.select(F.col(key).cast("long").alias("trusted_id")).where("trusted_id is not null").distinct(), "trusted")
    few = ids.count() <= BROADCAST_ROWS
    own = docs.select(
        F.col(key).cast("long").alias("doc_id"), F.col("text").alias("text"), F.col("lang").alias("lang"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("text",)]).alias("rest"),
    )
    joined = own.join(F.broadcast(ids) if few else ids, own["doc_id"] == ids["trusted_id"], "left")
    other_half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1
    joined = joined.withColumn("trusted", F.col("trusted_id").isNotNull()).drop("trusted_id")
    joined = joined.withColumn("held_out", F.col("trusted") & other_half)
    # a join by shuffle leaves no order that a second reading would repeat
    return joined if few else stored(joined, "flagged")


def _model(flagged: DataFrame, order: int, shards: int) -> DataFrame:
    """Stored answers for every block of ``flagged``."""
    asked = stored(requests(flagged, "text", order, shards), "requests")
    listed = asked.select(F.explode(F.arrays_zip("grams", "counts", "half")).alias("x"))
    sums = [F.sum("x.counts").alias("whole"), F.sum("x.half").alias("half")]
    table = stored(listed.groupBy(F.col("x.grams").alias("gram")).agg(*sums), "gram-counts")
    found = probabilities(table, ["whole", "half"], order)
    return stored(answers(asked, found, shards, lanes_of(asked, shards)), "answers")


def perplexities(docs: DataFrame, trusted: DataFrame, key: str = "doc_id", order: int = ORDER, quantile: float = QUANTILE) -> DataFrame:
    """One row per document: its perplexity, its language's limit, and whether it is kept.

    ``step``, the smoothed logarithm in thousandths, is what is held against ``limit``.
    """
    shards = shuffle_partitions(docs)
    flagged = flagged_documents(docs, trusted, key)
    replies = _model(flagged, order, shards)
    scores = stored(scored(flagged, replies, "text", order, shards, ["doc_id", "lang", "trusted"]), "scores")
    mean = average(scores)
    return judged(scores, stored(thresholds(scores, mean, quantile), "limits"), mean)


def good_documents(docs: DataFrame, trusted: DataFrame, key: str = "doc_id", order: int = ORDER, quantile: float = QUANTILE) -> DataFrame:
    """The documents that are kept, with all their columns."""
    shards = shuffle_partitions(docs)
    flagged = flagged_documents(docs, trusted, key)
    replies = _model(flagged, order, shards)
    scores = stored(scored(flagged, replies, "text", order, shards, ["lang"]), "scores")
    mean = average(scores)
    limits = stored(thresholds(scores, mean, quantile), "limits")
    rows = scored(flagged, replies, "text", order, shards, ["rest", "text", "lang"])
    columns = [F.col("text") if c == "text" else F.col(f"rest.`{c}`") for c in docs.columns]
    return judged(rows, limits, mean).where("kept").select(*columns)
