"""Nearest vectors by inner product: inverted lists scanned with adaptive numbers of dimensions.

Vectors get one more component that makes all of them equally long, so that the largest inner product is
the smallest distance, and are turned by a random rotation, so that any leading part of a difference stands for
all of it. K-means on a bounded sample gives the lists; every row goes to its nearest one. A query probes the nearest
lists, in two rounds. The nearest few, which hold ``BOUND_ROWS`` vectors, are read whole; the last of the k best there is
the query's bound. With it the other lists are read in blocks of columns: after each block, the first included, a test on the
partial distance drops every vector that by now cannot, up to a small error probability, be below the bound, and only the
others are read on. All queries of a list are taken at once, first as matrices, then, when few pairs are left, pair by pair.
Survivors are scored in double precision on the original vectors.

How many lists a query probes is fitted too: as few as find ``recall`` of the true neighbours of sample rows within
the sample; more where those hold too few vectors.

Skew: of equal vectors only the k + 1 smallest identifiers can be among anyone's k nearest, so the
others are left out before the index is built, which is exact; equal queries are searched once. Large lists, and
lists with many queries, are cut into cells of bounded size.

Sizes: the sample has ``SAMPLE_ROWS`` rows, or 16 a list up to ``MOST_SAMPLE_ROWS``; so there are at most ``MOST_LISTS`` lists, and
beyond their square of rows lists grow longer. Both bound what is sent to tasks.

Cases: null and zero vectors and those with null or non-finite components take no part, nor do rows without
an identifier or of another dimension than most; repeated rows count once; a query's own rows are never among
its results; ties go to the smaller identifier; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.llm.common import shuffle_partitions, stored

SAMPLE_ROWS, MOST_SAMPLE_ROWS = 16_384, 65_536
MOST_LISTS = MOST_SAMPLE_ROWS // 16
BOUND_ROWS = 512
CELL_ROWS, CELL_QUERIES, AT_ONCE = 4096, 2048, 256
BLOCK = 16
# share of pairs below which these are read one by one
FEW = 0.25
# of the published test: larger drops fewer vectors by mistake
CAUTION = 2.1


@dataclass
class Index:
    """What tasks need: the rotation, the common length, the lists' centres, and the lists to probe."""

    rotation: np.ndarray
    longest: float
    centres: np.ndarray
    probes: int

    def turned(self, vectors: np.ndarray, query: bool = False) -> np.ndarray:
        """Vectors with the further component, padded to whole blocks and rotated."""
        out = np.zeros((len(vectors), len(self.rotation)))
        out[:, : vectors.shape[1]] = vectors
        if not query:
            rest = self.longest**2 - (vectors**2).sum(1)
            out[:, vectors.shape[1]] = np.sqrt(np.maximum(rest, 0))
        return out @ self.rotation


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2 * a @ b.T


def fitted(sample: np.ndarray, rows: int, longest: float, k: int, recall: float, seed: int) -> Index:
    """Rotation, centres and number of probes from a sample."""
    rng = np.random.default_rng(seed)
    width = -(-(sample.shape[1] + 1) // BLOCK) * BLOCK
    rotation = np.linalg.qr(rng.standard_normal((width, width)))[0]
    index = Index(rotation, longest, np.zeros((1, width)), 1)
    turned = index.turned(sample)
    lists = int(min(MOST_LISTS, max(1, round(rows**0.5)), max(1, len(sample) // 16)))
    centres = turned[rng.choice(len(turned), lists, replace=False)]
    for _ in range(10):
        nearest = np.concatenate([squared_distances(part, centres).argmin(1) for part in np.array_split(turned, 16)])
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, turned)
        sizes = np.bincount(nearest, minlength=lists)
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
    nearest = np.concatenate([squared_distances(part, centres).argmin(1) for part in np.array_split(turned, 16)])
    index.centres = centres
    asked = rng.choice(len(sample), min(512, len(sample)), replace=False)
    scores = sample[asked] @ sample.T
    scores[np.arange(len(asked)), asked] = -np.inf
    true = np.argsort(-scores, axis=1)[:, : min(k, max(1, len(sample) - 1))]
    order = np.argsort(squared_distances(index.turned(sample[asked], query=True), centres), axis=1)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(lists)[None, :].repeat(len(asked), 0), axis=1)
    needed = np.sort(np.take_along_axis(place, nearest[true], axis=1).ravel()) + 1
    index.probes = int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))])
    return index


def scan(vectors: np.ndarray, queries: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Pairs (query, vector) whose squared distance may be within the query's limit, and how many components were read.

    After each block of columns a pair is dropped when its partial distance is too large for its share of the columns.
    """
    width = vectors.shape[1]
    partial, pairs, read = np.zeros((len(queries), len(vectors))), None, 0
    for first in range(0, width, BLOCK):
        v, q = vectors[:, first : first + BLOCK], queries[:, first : first + BLOCK]
        done = first + BLOCK
        allowed = limits * (done / width) * (1 + CAUTION / done**0.5) ** 2 if done < width else limits * (1 + 1e-9) + 1e-9
        if pairs is None:
            read += partial.size * BLOCK
            partial += squared_distances(q, v)
            stays = partial <= allowed[:, None]
            if done == width or np.count_nonzero(stays) < FEW * stays.size:
                pairs = np.nonzero(stays)
                partial = partial[pairs]
        elif len(partial):
            read += partial.size * BLOCK
            apart = v[pairs[1]] - q[pairs[0]]
            partial = partial + np.einsum("ij,ij->i", apart, apart)
            stays = partial <= allowed[pairs[0]]
            pairs, partial = (pairs[0][stays], pairs[1][stays]), partial[stays]
    return pairs[0], pairs[1], read


def best_pairs(ids: np.ndarray, plain: np.ndarray, asked: np.ndarray, pairs: tuple[np.ndarray, np.ndarray], k: int) -> tuple:
    """Of each query's pairs the k with the largest inner products, as (query, vector, score)."""
    which, near = pairs
    scores = np.concatenate(
        [np.zeros(0), *(np.einsum("ij,ij->i", plain[near[a : a + 65536]], asked[which[a : a + 65536]]) for a in range(0, len(near), 65536))]
    )
    order = np.lexsort((ids[near], -scores, which))
    which, near, scores = which[order], near[order], scores[order]
    starts = np.flatnonzero(np.diff(which, prepend=-1))
    nth = np.arange(len(which)) - np.repeat(starts, np.diff([*starts, len(which)]))
    return which[nth < k], near[nth < k], scores[nth < k]


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """Distinct rows that take part, as (vec_id, vector) of one dimension."""
    v = F.col("vector")
    rows = (
        vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("vector"))
        .where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0))
        .where(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
        .where(F.exists(v, lambda x: x != 0))
    )
    most = rows.groupBy(F.size(v).alias("size")).count().orderBy(F.desc("count"), "size").first()
    return rows.where(F.size(v) == (most["size"] if most else 0)).dropDuplicates(["vec_id", "vector"])


def _stacked(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    key: str = "vec_id",
    vector: str = "embedding",
    recall: float = 0.95,
    seed: int = 7,
) -> DataFrame:
    """The k nearest rows to each query: query_id, rank, vec_id, score. ``is_query`` speaks of ``vec_id``."""
    spark = vectors.sparkSession
    rows = stored(usable(vectors, key, vector), "vectors")
    smallest = Window.partitionBy("vector").orderBy("vec_id")
    candidates = stored(
        rows.withColumn("nth", F.row_number().over(smallest)).where(F.col("nth") <= k + 1).drop("nth"), "candidates"
    )
    squares = F.aggregate("vector", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    told = candidates.agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.max(squares)).alias("longest")).first()
    result = "qid long, vec_id long, score double"
    if not told["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sampled = min(MOST_SAMPLE_ROWS, max(SAMPLE_ROWS, 16 * round(told["n"] ** 0.5)))
    sample = candidates.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sampled).select("vector").toPandas()
    index = fitted(_stacked(sample["vector"]), told["n"], told["longest"], k, recall, seed)

    def to_lists(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                b["list"] = squared_distances(index.turned(_stacked(b["vector"])), index.centres).argmin(1).astype(np.int32)
                yield b

    kind = dict(rows.dtypes)["vector"]
    listed = stored(candidates.mapInPandas(to_lists, f"vec_id long, vector {kind}, list int"), "lists")
    sizes = {r["list"]: r["count"] for r in listed.groupBy("list").count().collect()}  # at most MOST_LISTS rows
    held = np.array([sizes.get(i, 0) for i in range(len(index.centres))])

    def to_probes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            order = np.argsort(squared_distances(index.turned(_stacked(b["vector"]), query=True), index.centres), axis=1)
            within = np.cumsum(held[order], axis=1)

            def lists_for(rows: int, within: np.ndarray = within) -> np.ndarray:
                return (within < np.minimum(rows, within[:, -1:])).sum(1) + 1

            # further lists until there are enough vectors to choose from
            sure = lists_for(max(k + 1, BOUND_ROWS))
            probes = np.maximum(index.probes, sure)
            b["lists"], b["sure"] = [o[:p].astype(np.int32) for o, p in zip(order, probes)], sure.astype(np.int32)
            yield b

    asked = rows.where(is_query)
    classes = asked.groupBy("vector").agg(F.min("vec_id").alias("qid"))
    spread_over = classes.repartition(shuffle_partitions(classes), "qid")
    probing = stored(spread_over.mapInPandas(to_probes, f"vector {kind}, qid long, lists array<int>, sure int"), "probes")
    pairs = probing.select("qid", "vector", "sure", F.posexplode("lists").alias("nth", "list"))

    def spread(total: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(total).cast("int") - 1))

    def own(id_column: str, total: str) -> Column:
        return F.pmod(F.xxhash64(id_column), F.col(total)).cast("int")

    def search(found: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"qid": [], "vec_id": [], "score": []})]
        if len(found) and len(queries):
            found = found.sort_values("vec_id", ignore_index=True)
            ids, plain = found["vec_id"].to_numpy(), _stacked(found["vector"])
            turned = index.turned(plain)
            for at in range(0, len(queries), AT_ONCE):
                some = queries.iloc[at : at + AT_ONCE]
                asked = _stacked(some["vector"])
                # equally long vectors: the bound on the score is one on the distance
                limits = index.longest**2 + (asked**2).sum(1) - 2 * some["bound"].to_numpy()
                which, near, _ = scan(turned, index.turned(asked, query=True), limits)
                which, near, scores = best_pairs(ids, plain, asked, (which, near), k + 1)
                out.append(pd.DataFrame({"qid": some["qid"].to_numpy()[which], "vec_id": ids[near], "score": scores}))
        return pd.concat(out, ignore_index=True).astype({"qid": "int64", "vec_id": "int64", "score": "float64"})

    def met(some: DataFrame) -> DataFrame:
        """The best k + 1 of each cell for the given (qid, vector, list, bound)."""
        cell = ["list", "sub", "part"]
        # one row for each list, which bounds the broadcast
        cells = F.broadcast(
            listed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / CELL_ROWS).alias("subs"))
            .join(some.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / CELL_QUERIES).alias("parts")), "list")
        )
        left = listed.join(cells, "list").withColumn("sub", own("vec_id", "subs")).withColumn("part", spread("parts"))
        right = some.join(cells, "list").withColumn("part", own("qid", "parts")).withColumn("sub", spread("subs"))
        by_cell = left.select(*cell, "vec_id", "vector").groupBy(*cell)
        return by_cell.cogroup(right.select(*cell, "qid", "vector", "bound").groupBy(*cell)).applyInPandas(search, result)

    best_first = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")

    def cut(found: DataFrame) -> DataFrame:
        return found.withColumn("nth", F.row_number().over(best_first)).where(F.col("nth") <= k + 1).drop("nth")

    unbound = F.lit(-np.inf)
    nearest_lists = stored(cut(met(pairs.where("nth < sure").withColumn("bound", unbound))), "nearest-lists")
    bounds = nearest_lists.groupBy("qid").agg(F.when(F.count(F.lit(1)) > k, F.min("score")).otherwise(unbound).alias("bound"))
    further = stored(pairs.where("nth >= sure").join(bounds, "qid", "left").fillna(-np.inf, ["bound"]), "further-lists")
    by_class = cut(nearest_lists.unionByName(met(further)))
    members = asked.join(classes, "vector").select(F.col("vec_id").alias("query_id"), "qid").distinct()
    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        members.join(by_class, "qid")
        .where(F.col("vec_id") != F.col("query_id"))
        .withColumn("rank", F.row_number().over(by_query))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
