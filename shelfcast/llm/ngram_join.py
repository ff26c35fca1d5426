"""Documents that share most of their word n-grams: a Jaccard join by MinHash banding.

1. Each text becomes its set of five-word shingles, a MinHash signature, and ``bands`` band hashes. With
   ``rows`` hashes a band, two sets of similarity s meet in at least one band with probability
   1 - (1 - s^rows)^bands; the number of bands follows from the recall wanted at the threshold.
2. Documents with equal sets are one class, whatever their number; only classes go on.
3. Classes are shuffled on band hashes. Of buckets with the same members one is kept. Which bucket a
   pair is verified in follows from the two classes' own lists of buckets, so each pair is verified once.
4. A bucket is cut into blocks of bounded size, and each pair of blocks is a task's group with the whole sets of
   its members. It returns what was found per class: its number of links, and one link to
   the smallest class that its links lead to there. No pairs are written unless asked for.
5. Classes joined by links, directly or through others, get one class id, by contracting the graph in rounds.

Nothing is capped: a bucket of m classes takes m^2 / (2 * BLOCK^2) groups.

Cases: null text counts as empty; a text without words links to none, but equal ones are copies; one
with fewer than five words has a single shingle; a null identifier comes after all others; repeated
rows are copies; an empty table gives an empty result; further columns are kept by ``without_near_duplicates`` only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.common import stored, whole_row
from shelfcast.llm.shingles import WORDS, mixed, shingle_sets

THRESHOLD, RECALL, ROWS = 0.8, 0.9999, 5
BLOCK = 256
# rows of (identifier, hash, number) that may be sent to every executor: about 32 bytes each
BROADCAST_ROWS = 500_000
SEED = 20_241_105
KEY = ["unknown", "doc_id", "text_hash"]


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def _named(docs: DataFrame, key: str, text: str, *more: Column) -> DataFrame:
    return docs.select(
        F.col(key).isNull().alias("unknown"),
        F.coalesce(F.col(key), F.lit(0)).cast("long").alias("doc_id"),
        F.xxhash64(text).alias("text_hash"),
        F.col(text).alias("text"),
        *more,
    )


def signatures(docs: DataFrame, bands: int, rows: int = ROWS, words: int = WORDS) -> DataFrame:
    """Per document: its key, the size and two hashes of its set, and its band hashes."""
    with np.errstate(over="ignore"):
        seeds = mixed(np.arange(1, 2 * bands * rows + 1, dtype=np.uint64) * np.uint64(SEED))
    factors, terms = seeds[: bands * rows] | np.uint64(1), seeds[bands * rows :]

    def bands_of(found: np.ndarray) -> np.ndarray:
        least = np.full(bands * rows, np.iinfo(np.uint64).max, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for at in range(0, len(found), 2048):
                part = found[at : at + 2048]
                np.minimum(least, (part[None, :] * factors[:, None] + terms[:, None]).min(1), out=least)
            out = np.arange(1, bands + 1, dtype=np.uint64)
            for column in least.reshape(bands, rows).T:
                out = mixed(out * np.uint64(3) + column)
        return out.view(np.int64)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, sums, xors, signed = [], [], [], []
            hashes = batch.column("text_hash").to_pylist()
            for found, text_hash in zip(shingle_sets(batch.column("text").to_pylist(), words), hashes):
                sizes.append(len(found))
                if len(found):
                    again = mixed(found)
                    sums.append(int(again.sum(dtype=np.uint64).view(np.int64)))
                    xors.append(int(np.bitwise_xor.reduce(mixed(again)).view(np.int64)))
                    signed.append(bands_of(found))
                else:
                    sums.append(text_hash)
                    xors.append(0)
                    signed.append(np.zeros(0, dtype=np.int64))
            ends = np.cumsum([0, *map(len, signed)]).astype(np.int32)
            flat = np.concatenate(signed) if signed else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in KEY),
                    pa.array(sizes, pa.int32()),
                    pa.array(sums, pa.int64()),
                    pa.array(xors, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                ],
                [*KEY, "size", "set_sum", "set_xor", "bands"],
            )

    kind = "unknown boolean, doc_id long, text_hash long, size int, set_sum long, set_xor long, bands array<long>"
    return docs.select(*KEY, F.coalesce("text", F.lit("")).alias("text")).mapInArrow(sign, kind)


def classes_of(signed: DataFrame) -> DataFrame:
    """One row per distinct set, with its first document and its number of documents."""
    return signed.groupBy("size", "set_sum", "set_xor").agg(
        F.min(F.struct(*KEY)).alias("first"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands")
    ).withColumn("node", F.monotonically_increasing_id())


def shared_buckets(classes: DataFrame) -> DataFrame:
    """(node, bucket, members) for every bucket of at least two classes, one of those with the same members."""
    every = classes.select("node", F.explode("bands").alias("bucket"))
    tag = F.xxhash64("node")
    filled = every.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("members"), F.bit_xor(tag).alias("tags"), F.bit_xor(F.xxhash64(tag)).alias("more_tags")
    ).where(F.col("members") > 1)
    distinct = filled.groupBy("members", "tags", "more_tags").agg(F.min("bucket").alias("bucket"))
    return every.join(distinct.select("bucket", "members"), "bucket").select("node", "bucket", "members")


def candidate_sets(docs: DataFrame, candidates: DataFrame, words: int = WORDS) -> DataFrame:
    """The whole shingle set of each candidate class, read from the text of its first document."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s.tobytes() for s in shingle_sets(batch.column("text").to_pylist(), words)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], ["node", "set"])

    few = candidates.count() <= BROADCAST_ROWS
    texts = docs.join(F.broadcast(candidates) if few else candidates, KEY).select("node", "text")
    # repeated rows give a class more than once
    return texts.mapInArrow(build, "node long, set binary").dropDuplicates(["node"])


def _linked(group: pd.DataFrame, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions and similarity of the linked pairs of a block pair that belong to this bucket."""
    nodes, bucket = group["node"].to_numpy(), group["bucket"].iloc[0]
    sets = [np.frombuffer(s, dtype=np.uint64) for s in group["set"]]
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    low, high = int(group["low"].iloc[0]), int(group["high"].iloc[0])
    block = group["block"].to_numpy()
    a, b = np.triu_indices(len(nodes), 1)
    wanted = np.minimum(sizes[a], sizes[b]) >= threshold * np.maximum(sizes[a], sizes[b]) - 1e-9
    if low != high:
        wanted &= block[a] != block[b]
    a, b = a[wanted], b[wanted]
    # the pair's own bucket is the smallest that both are in
    width = max(map(len, group["own"]))
    own = np.full((len(nodes), width), np.iinfo(np.int64).max)
    for i, buckets in enumerate(group["own"]):
        own[i, : len(buckets)] = buckets
    earlier = [set(int(x) for x in row if x < bucket) for row in own]
    if any(earlier):
        mine = np.fromiter((earlier[i].isdisjoint(earlier[j]) for i, j in zip(a, b)), bool, len(a))
        a, b = a[mine], b[mine]
    if not len(a):
        return a, b, np.zeros(0)
    if len(a) <= 64:
        common = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a, b)])
    else:
        values, place, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(sets)), sizes)
        rank = np.cumsum(counts > 1) - 1
        shared = counts[place] > 1
        row, column = row[shared], rank[place[shared]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        met = np.zeros((len(sets), len(sets)), dtype=np.float32)
        total = int(column[-1]) + 1 if len(column) else 0
        for at in range(0, total, 4096):
            first, last = np.searchsorted(column, [at, at + 4096])
            dense = np.zeros((len(sets), min(4096, total - at)), dtype=np.float32)
            dense[row[first:last], column[first:last] - at] = 1
            met += dense @ dense.T
        common = met[a, b].astype(np.int64)
    similarity = common / (sizes[a] + sizes[b] - common)
    kept = similarity >= threshold
    return a[kept], b[kept], similarity[kept]


def _roots(count: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest position each position is linked to, directly or not."""
    root = np.arange(count)
    while True:
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            return root


def verified(sets: DataFrame, buckets: DataFrame, copies: DataFrame, threshold: float, pairs: bool = False) -> DataFrame:
    """Links of every block pair: summed up per class, or as pairs."""
    own = F.sort_array(F.collect_list(F.struct("bucket", "members"))).alias("buckets")
    listed = buckets.groupBy("node").agg(own)
    ready = sets.join(listed, "node").join(copies, "node")
    blocks = F.ceil(F.col("b.members") / BLOCK).cast("int")
    spread = (
        ready.select("node", "set", "copies", F.col("buckets.bucket").alias("own"), F.explode("buckets").alias("b"))
        .withColumn("block", F.pmod(F.xxhash64("node", "b.bucket"), blocks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select(
            F.col("b.bucket").alias("bucket"), "node", "set", "copies", "own", "block",
            F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
        )
    )

    def find(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("node", ignore_index=True)
        a, b, similarity = _linked(group, threshold)
        nodes = group["node"].to_numpy()
        if pairs:
            return pd.DataFrame({"a": nodes[a], "b": nodes[b], "similarity": similarity})
        weights, n = group["copies"].to_numpy(), len(nodes)
        links = np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
        documents = np.bincount(a, weights[b], n) + np.bincount(b, weights[a], n)
        kept = links > 0
        return pd.DataFrame(
            {"node": nodes, "root": nodes[_roots(n, a, b)], "links": links, "documents": documents.astype(np.int64)}
        )[kept]

    kind = "a long, b long, similarity double" if pairs else "node long, root long, links long, documents long"
    return spread.groupBy("bucket", "low", "high").applyInPandas(find, kind)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for all nodes of the edges (a, b): contraction to the smallest neighbour, round by round."""
    edges = stored(edges.where("a <> b").distinct(), "edges")
    names = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    names = stored(names.select("node", F.col("node").alias("component")), "components")
    while edges.take(1):
        both = edges.union(edges.select("b", "a"))
        parent = both.groupBy("a").agg(F.min("b").alias("p")).select("a", F.least("a", "p").alias("p"))
        # twice to the parent's parent, so that chains shrink by more than a step a round
        for _ in range(2):
            parent = stored(parent, "parents")
            above = parent.select(F.col("a").alias("p"), F.col("p").alias("pp"))
            parent = parent.join(above, "p").select("a", F.col("pp").alias("p"))
        parent = stored(parent, "parents")
        to = lambda c: parent.select(F.col("a").alias(c), F.col("p").alias(f"{c}_to"))
        names = stored(
            names.join(to("component"), "component", "left").select("node", F.coalesce("component_to", "component").alias("component")),
            "components",
        )
        edges = stored(
            edges.join(to("a"), "a").join(to("b"), "b").select(F.col("a_to").alias("a"), F.col("b_to").alias("b")).where("a <> b").distinct(),
            "edges",
        )
    return names


def _searched(named: DataFrame, threshold: float, recall: float, rows: int, words: int):
    signed = stored(signatures(named, bands_for(threshold, recall, rows), rows, words), "signatures")
    classes = stored(classes_of(signed), "classes")
    buckets = stored(shared_buckets(classes), "buckets")
    wanted = buckets.select("node").distinct()
    candidates = stored(classes.join(wanted, "node").select("first.*", "node"), "candidates")
    sets = candidate_sets(named, candidates, words)
    return signed, classes, buckets, sets


def near_duplicates(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    threshold: float = THRESHOLD,
    recall: float = RECALL,
    rows: int = ROWS,
    words: int = WORDS,
) -> DataFrame:
    """One row per document.

    ``class_id`` is the smallest identifier among the documents it is linked to, directly or through
    others, ``copy_of`` the smallest with the same shingles, ``n_links`` the number of different shingle
    sets it is linked to, and ``n_linked_docs`` the number of other documents, copies included.
    """
    return _classified(_named(docs, key, text), threshold, recall, rows, words).drop("text_hash", "first_of_class", "unknown")


def _classified(named: DataFrame, threshold: float, recall: float, rows: int, words: int) -> DataFrame:
    signed, classes, buckets, sets = _searched(named, threshold, recall, rows, words)
    links = stored(verified(sets, buckets, classes.select("node", "copies"), threshold), "links")
    names = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    sums = links.groupBy("node").agg(F.sum("links").alias("links"), F.sum("documents").alias("documents"))
    placed = classes.join(names, "node", "left").join(sums, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = placed.groupBy("component").agg(F.min("first").alias("smallest"))
    told = stored(
        placed.join(smallest, "component").select(
            "size", "set_sum", "set_xor", "first", "smallest", "copies",
            F.coalesce("links", F.lit(0)).alias("n_links"), F.coalesce("documents", F.lit(0)).alias("documents"),
        ),
        "class-links",
    )

    def own(c: str) -> Column:
        return F.when(~F.col(f"{c}.unknown"), F.col(f"{c}.doc_id"))

    return signed.drop("bands").join(told, ["size", "set_sum", "set_xor"]).select(
        "unknown",
        "text_hash",
        F.when(~F.col("unknown"), F.col("doc_id")).alias("doc_id"),
        own("smallest").alias("class_id"),
        own("first").alias("copy_of"),
        F.col("n_links").cast("long"),
        (F.col("documents") + F.col("copies") - 1).alias("n_linked_docs"),
        (F.struct("unknown", "doc_id", "text_hash") == F.col("smallest")).alias("first_of_class"),
    )


def linked_pairs(
    docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, recall: float = RECALL,
    rows: int = ROWS, words: int = WORDS,
) -> DataFrame:
    """All links as pairs of the first documents of two classes, with their similarity. Grows with the square of large groups."""
    _, classes, buckets, sets = _searched(_named(docs, key, text), threshold, recall, rows, words)
    found = verified(sets, buckets, classes.select("node", "copies"), threshold, pairs=True)
    name = lambda c: classes.select(F.col("node").alias(c), F.col("first.doc_id").alias(f"{c}_id"))
    return found.join(name("a"), "a").join(name("b"), "b").select("a_id", "b_id", "similarity")


def without_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The smallest document of each class with all its columns."""
    named = _named(docs, key, text)
    settings = {"threshold": THRESHOLD, "recall": RECALL, "rows": ROWS, "words": WORDS} | options
    told = _classified(named, **settings).select(F.col("unknown"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "text_hash", "first_of_class")
    told = stored(told, "near-decisions")
    dropped = stored(told.where(~F.col("first_of_class")).select(*KEY).distinct(), "dropped-rows")
    rows = _named(docs, key, text, whole_row(docs)).drop("text").join(dropped, KEY, "left_anti")
    # rows that are there more than once, identifier and text, need one more look; there are rarely any
    again = stored(told.where("first_of_class").groupBy(*KEY).count().where("count > 1").drop("count"), "repeated-rows")
    if again.take(1):
        rows = rows.join(again, KEY, "left_anti").unionByName(rows.join(again, KEY, "left_semi").dropDuplicates(KEY))
    return rows.select("row.*")
