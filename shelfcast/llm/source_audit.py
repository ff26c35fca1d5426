"""How far each source's words depart from its language: distances between sources, and the words that a source overuses.

1. Texts are read once. Tasks count terms, and documents that hold them, per language and source in a bounded dictionary, so
   that a term reaches the shuffle as a row per task, language and source. One exchange by (lang, term) sums these, and there
   the terms in enough documents of the language are kept.
2. Overused terms: the larger a term's count in the group, the smaller its count in the language and the earlier it
   stands in UTF-8, the higher it ranks. So a term with at least ``top`` others that are no worse in all three (its
   dominators) cannot be on the list. Each task keeps, per group, the terms with fewer dominators, its skyband; skybands are
   merged by parts, as many times as their size asks for, and what is left is ranked by the exact value.
3. Distances: sources of a language form tiles, its terms buckets. For each pair of tiles and each bucket, one task sums
   how much the two sources' shares differ beyond what two sources without the term differ, which is added once for all terms.

All arithmetic is on integers: ``share`` divides in two steps, so that counts up to 9 * 10^13 stay within 64 bits.

Bounds: a counting dictionary holds ``MOST_HELD`` terms, a distance task two tiles of about ``TILE`` sources and some
``BUCKET_ROWS`` counts; a hot language or source only has more buckets. Every pair of sources of a language is in the
result, so the result itself grows with the square of a language's sources.

Cases: null text, lang and source count as empty; a group without terms, and a language without kept terms, still have
their distances; repeated rows count each; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.llm.common import stored

LEAST_DOCS, TOP = 30, 50
# fixed values of the smoothed share
SCALE, ADDED = 1_000_000_000, 5
STEPS = (100_000, 10_000)
MOST_HELD = 300_000
TILE, BUCKET_ROWS = 256, 16_384
CANDIDATES, FAN_IN = 65_536, 16
# letters of ASCII and every byte of other characters are of a term; capitals become small, all else a blank
OF_A_TERM = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def counted(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """Per task: rows (lang, source, term, n, docs), and one without a term for each group."""
    empty = F.lit("")
    read = docs.select(
        F.coalesce(F.col(lang).cast("string"), empty).alias("lang"),
        F.coalesce(F.col(source).cast("string"), empty).alias("source"),
        F.coalesce(F.col(text), empty).cast("binary").alias("text"),
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for (of_lang, of_source), (times, holders) in found.items():
                terms, n = [None, *times], [0, *times.values()]
                columns = [
                    pa.array([of_lang] * len(terms)),
                    pa.array([of_source] * len(terms)),
                    pa.array(terms, pa.binary()).cast(pa.string()),
                    pa.array(n, pa.int64()),
                    pa.array([0, *map(holders.__getitem__, times)], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])
            found.clear()

        for batch in batches:
            groups = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text"))
            for of_lang, of_source, data in groups:
                terms = data.as_py().translate(OF_A_TERM).split()
                times, holders = found[of_lang, of_source]
                held -= len(times)
                times.update(terms)
                holders.update(set(terms))
                held += len(times)
                if held >= MOST_HELD:
                    yield from flush()
                    held = 0
        yield from flush()

    return read.mapInArrow(count, "lang string, source string, term string, n long, docs long")


def kept_terms(docs: DataFrame, text: str, lang: str, source: str, least_docs: int) -> DataFrame:
    """Counts of kept terms by group, with the language's count; rows without a term name all groups."""
    of_term = Window.partitionBy("lang", "term")
    return (
        counted(docs, text, lang, source)
        .repartition("lang", "term")
        .groupBy("lang", "term", "source")
        .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        .withColumn("lang_n", F.sum("n").over(of_term))
        .withColumn("lang_docs", F.sum("docs").over(of_term))
        .withColumn("nth", F.row_number().over(of_term.orderBy("source")))
        .where(F.col("term").isNull() | (F.col("lang_docs") >= least_docs))
        .select("lang", "source", "term", "n", "lang_n", "nth")
    )


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + ADDED) / (total + ADDED * terms)), in two steps of a long division."""
    by = (total + ADDED * terms).alias("by")
    first = (n + ADDED) * STEPS[0]
    return F.call_function("div", first, by) * STEPS[1] + F.call_function("div", (first % by) * STEPS[1], by) + 1


def shares(n: np.ndarray, by: np.ndarray) -> np.ndarray:
    """The same for arrays."""
    whole, rest = np.divmod((n + ADDED) * STEPS[0], by)
    return whole * STEPS[1] + rest * STEPS[1] // by + 1


def skyband(n: np.ndarray, lang_n: np.ndarray, k: int, chunk: int = 256) -> np.ndarray:
    """Positions with fewer than k dominators among earlier ones: as large an ``n``, as small a ``lang_n``."""
    # of equal points only the first k can stay
    order = np.lexsort((np.arange(len(n)), lang_n, n))
    new = np.ones(len(n), bool)
    new[1:] = (n[order][1:] != n[order][:-1]) | (lang_n[order][1:] != lang_n[order][:-1])
    starts = np.flatnonzero(new)
    nth = np.arange(len(n)) - np.repeat(starts, np.diff([*starts, len(n)]))
    points = np.sort(order[nth < k])
    kept = np.zeros(0, np.int64)
    for at in range(0, len(points), chunk):
        part = points[at : at + chunk]
        a, b = n[part][:, None], lang_n[part][:, None]
        above = ((n[kept][None, :] >= a) & (lang_n[kept][None, :] <= b)).sum(1)
        beside = ((n[part][None, :] >= a) & (lang_n[part][None, :] <= b) & np.tri(len(part), k=-1, dtype=bool)).sum(1)
        kept = np.concatenate([kept, part[above + beside < k]])
    return kept


def _banded(rows: pa.Table, k: int) -> pa.Table:
    rows = rows.take(pc.sort_indices(rows.column("term").cast(pa.binary())))
    stays = skyband(rows.column("n").to_numpy(), rows.column("lang_n").to_numpy(), k)
    return rows.take(pa.array(stays))


def overused(counts: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    """Of each group the ``top`` kept terms that it uses most above its language."""
    group_share, lang_share = share(F.col("n"), F.col("total"), F.col("v")), share(F.col("lang_n"), F.col("lang_total"), F.col("v"))
    rows = (
        counts.where("n > 0")
        .join(groups.select("lang", "source", "total", "lang_total", "v"), ["lang", "source"])
        .withColumn("value", group_share - lang_share)
        .where("value > 0")
        .select("lang", "source", "term", "n", "lang_n", "value")
    )
    schema = rows.schema

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def banded() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(waiting)
            waiting.clear()
            table = table.sort_by([("lang", "ascending"), ("source", "ascending")])
            names = pc.binary_join_element_wise(table.column("lang"), table.column("source"), "\0").combine_chunks()
            sizes = pc.run_end_encode(names).run_ends.to_numpy()
            for a, b in zip([0, *sizes[:-1]], sizes):
                yield from _banded(table.slice(a, b - a), top).to_batches()

        for batch in batches:
            waiting.append(batch)
            if sum(map(len, waiting)) >= CANDIDATES:
                yield from banded()
        if sum(map(len, waiting)):
            yield from banded()

    bands = stored(rows.mapInArrow(local, schema), "skybands")
    most = bands.groupBy("lang", "source").count().agg(F.max("count")).first()[0] or 0
    lanes = -(-most // CANDIDATES)
    while True:
        lane = F.pmod(F.xxhash64("term"), F.lit(max(1, lanes))).alias("lane")
        bands = bands.groupBy("lang", "source", lane).applyInArrow(lambda table: _banded(table, top), schema)
        if lanes <= 1:
            break
        bands, lanes = stored(bands, "skybands"), -(-lanes // FAN_IN)
    best_first = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term")
    return bands.select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", F.row_number().over(best_first).alias("rank")
    ).where(F.col("rank") <= top)


def distances(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """The summed difference of shares between all pairs of a language's sources."""
    by = (F.col("total") + ADDED * F.col("v")).alias("by")
    langs = groups.groupBy("lang").agg(
        F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles"), F.least(F.count(F.lit(1)), F.lit(TILE)).alias("wide"), F.sum("rows").alias("rows")
    )
    room = F.greatest(F.lit(BUCKET_ROWS), 4 * F.col("wide") * F.col("wide"))
    langs = langs.select("lang", "tiles", F.greatest(F.lit(1), F.ceil(F.col("rows") / room)).cast("int").alias("buckets"))
    tile = F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int").alias("tile")
    every = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    low, high = F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b")
    left = (
        counts.where("n > 0").join(langs, "lang")
        .select("lang", "source", "term", "n", tile, F.pmod(F.xxhash64("term"), F.col("buckets")).cast("int").alias("bucket"), every)
        .select("lang", low, high, "bucket", "tile", "source", "term", "n")
    )
    of_tile = groups.join(langs, "lang").groupBy("lang", "tiles", "buckets", "v", tile).agg(F.collect_list(F.struct("source", by)).alias("sources"))
    right = (
        of_tile.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select("lang", low, high, "v", "tile", "sources", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)).alias("bucket"))
        .select(*(F.col(c).alias(f"of_{c}") for c in ("lang", "a", "b", "bucket", "v", "tile", "sources")))
    )

    def differ(rows: pa.Table, told: pa.Table) -> pa.Table:
        tiles = {r["of_tile"]: r["of_sources"] for r in told.to_pylist()}
        lang, a, b, bucket, v = (told.column(f"of_{c}")[0].as_py() for c in ("lang", "a", "b", "bucket", "v"))
        names = {t: [s["source"] for s in tiles.get(t, [])] for t in (a, b)}
        divisors = {t: np.array([s["by"] for s in tiles.get(t, [])], np.int64) for t in (a, b)}
        if not v:
            divisors = {t: np.ones_like(d) for t, d in divisors.items()}
        without = {t: shares(np.zeros(len(d), np.int64), d) for t, d in divisors.items()}
        apart = np.abs(without[a][:, None] - without[b][None, :])
        total = apart * (v if bucket == 0 else 0)
        terms = rows.column("term").combine_chunks().dictionary_encode().indices.to_numpy() if len(rows) else np.zeros(0, np.int64)
        order = np.argsort(terms, kind="stable")
        terms, n, of_tile = terms[order], rows.column("n").to_numpy()[order], rows.column("tile").to_numpy()[order]
        place = {t: {s: i for i, s in enumerate(names[t])} for t in (a, b)}
        where = np.array([place[t][s] for t, s in zip(rows.column("tile").to_pylist(), rows.column("source").to_pylist())], np.int64)[order]
        step = max(1, (1 << 20) // max(1, len(names[a]), len(names[b])))
        for first in range(0, (int(terms[-1]) + 1) if len(terms) else 0, step):
            part = slice(*np.searchsorted(terms, [first, first + step]))
            size = int(terms[part][-1]) - first + 1
            found = {}
            for t in {a, b}:
                dense = np.zeros((size, len(names[t])), np.int64)
                mine = of_tile[part] == t
                dense[terms[part][mine] - first, where[part][mine]] = n[part][mine]
                found[t] = shares(dense, divisors[t][None, :])
            for i in range(len(names[a])):
                total[i] += np.abs(found[b] - found[a][:, i : i + 1]).sum(0) - size * apart[i]
        x, y = np.nonzero(np.tri(len(names[a]), k=-1, dtype=bool)) if a == b else np.indices(total.shape).reshape(2, -1)
        return pa.table(
            {
                "lang": pa.array([lang] * len(x), pa.string()),
                "one": pa.array([names[a][i] for i in x], pa.string()),
                "two": pa.array([names[b][i] for i in y], pa.string()),
                "value": pa.array(total[x, y], pa.int64()),
            }
        )

    key = ["lang", "a", "b", "bucket"]
    met = left.groupBy(*key).cogroup(right.groupBy(*(f"of_{c}" for c in key))).applyInArrow(differ, "lang string, one string, two string, value long")
    sums = met.groupBy("lang", "one", "two").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct(F.col("one").alias("source"), F.col("two").alias("item")), F.struct(F.col("two").alias("source"), F.col("one").alias("item"))))
    farthest = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return sums.select("lang", both.alias("both"), "value").select("lang", "both.*", "value").select(
        "lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(farthest).alias("rank")
    )


def divergence(
    docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP
) -> DataFrame:
    """Per language and source: lang, source, part, item, value, rank."""
    kept = stored(kept_terms(docs, text, lang, source, least_docs), "kept-terms")
    counts = kept.where(F.col("term").isNotNull()).select("lang", "source", "term", "n", "lang_n")
    has = F.col("term").isNotNull()
    # kept rows of a language sum to its total; each kept term is the first of its language once
    sums = kept.groupBy("lang", "source").agg(
        F.coalesce(F.sum(F.when(has, F.col("n"))), F.lit(0)).alias("total"),
        F.count(F.when(has, 1)).alias("rows"),
        F.count(F.when(has & (F.col("nth") == 1), 1)).alias("firsts"),
    )
    sums = stored(sums, "groups")
    of_lang = sums.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.sum("firsts").alias("v"))
    groups = stored(sums.join(of_lang, "lang"), "groups")
    return distances(counts, groups).unionByName(overused(counts, groups, top))
