"""The best documents for each of many queries, scored by shared terms, with common parts of queries worked out once.

1. Texts are read once, into blocks (``word_blocks``) with per-document term frequencies. Block dictionaries give the
   number of documents of each term that some item holds, and so its weight.
2. Items are dealt into batches of bounded size. A task mines each batch for shared term sets: terms that the same
   items hold become one set, then the pair of sets that most items hold together becomes a new one, again and again,
   until no pair is in two items. What remains is a graph: terms at the leaves, shared sets above, items on top.
3. Each block goes through the graph once a batch. A set's accumulator, the partial scores of the block's documents, is
   added up once, used by everything above it, and dropped after its last use.
4. A task keeps the best ``k`` of each item over its blocks; these meet in a window that cuts again before it shuffles.

Scores are 64-bit integers and do not depend on the order of additions, so sharing changes no result.

Bounds: a batch has about ``BATCH_ITEMS`` items or ``BATCH_BYTES`` of item text, and its graph, which is all that tasks are sent, has
a size in proportion; one item is never parted. Pairs are mined among a batch's first ``MOST_PAIRS`` pairs, which bounds the
work of mining and changes how much is shared, never a score. A term in all documents is one row a block in any shuffle.

Cases: null and empty texts have no terms and are not counted; an item without terms that occur has no result, one with
fewer than ``k`` documents all of them; repeated rows are documents, or items, of their own; a null identifier comes after all
others among equal scores; empty tables give an empty result; further columns are not read.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.llm.common import stored
from shelfcast.llm.word_blocks import dictionary, word_blocks, word_entries

K = 20
BATCH_ITEMS, BATCH_BYTES, MOST_PAIRS = 512, 1 << 20, 300_000
# letters and digits of ASCII and every byte of other characters are of a term; capitals become small, all else a blank
OF_A_TERM = bytes(
    b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)
)
NO_KEY = np.iinfo(np.int64).max


def terms_of() -> Callable[[bytes], list[bytes]]:
    return lambda data: data.translate(OF_A_TERM).split()


@dataclass
class Graph:
    """A batch of items as sums of shared sets. Leaves come first; ``parts`` of a set are leaves or earlier sets."""

    terms: dict[bytes, int] = field(default_factory=dict)
    weights: list[int] = field(default_factory=list)
    leaves: list[tuple[int, int]] = field(default_factory=list)  # (term, how often the item holds it)
    parts: list[list[int]] = field(default_factory=list)  # of the sets, which are numbered after the leaves
    items: list[tuple[int, int | None, list[int]]] = field(default_factory=list)  # number, identifier, sets and leaves

    def uses(self) -> Counter:
        return Counter(n for parts in [*self.parts, *(p for _, _, p in self.items)] for n in parts)


def mined(items: list[tuple[int, int | None, dict[bytes, int]]], weights: dict[bytes, int], most_pairs: int = MOST_PAIRS) -> Graph:
    """The graph of items given as (number, identifier, terms with repeats)."""
    graph = Graph()
    holders: dict[tuple[int, int], list[int]] = defaultdict(list)
    for at, (_, _, held) in enumerate(items):
        for term, times in sorted(held.items()):
            if term not in graph.terms:
                graph.terms[term] = len(graph.terms)
                graph.weights.append(weights[term])
            holders[graph.terms[term], times].append(at)
    graph.leaves = list(holders)
    alike: dict[tuple[int, ...], list[int]] = defaultdict(list)
    for leaf, who in enumerate(holders.values()):
        alike[tuple(who)].append(leaf)

    def new_set(parts: list[int]) -> int:
        graph.parts.append(parts)
        return len(graph.leaves) + len(graph.parts) - 1

    own: list[list[int]] = [[] for _ in items]
    shared: list[set[int]] = [set() for _ in items]
    for who, leaves in alike.items():
        if len(who) == 1:
            own[who[0]] += leaves
        else:
            node = leaves[0] if len(leaves) == 1 else new_set(leaves)
            for at in who:
                shared[at].add(node)
    together: dict[tuple[int, int], set[int]] = defaultdict(set)
    left = most_pairs
    for at, nodes in enumerate(shared):
        ordered = sorted(nodes)
        for i, a in enumerate(ordered):
            if left <= 0:
                break
            for b in ordered[i + 1 :]:
                together[a, b].add(at)
            left -= len(ordered) - i - 1
    heap = [(-len(who), pair) for pair, who in together.items() if len(who) > 1]
    heapq.heapify(heap)
    while heap:
        count, (a, b) = heapq.heappop(heap)
        who = {at for at in together.pop((a, b), ()) if a in shared[at] and b in shared[at]}
        if len(who) != -count:
            if len(who) > 1:
                together[a, b] = who
                heapq.heappush(heap, (-len(who), (a, b)))
            continue
        node = new_set([a, b])
        beside: dict[int, set[int]] = defaultdict(set)
        for at in who:
            shared[at] -= {a, b}
            for other in shared[at]:
                if left > 0:
                    beside[other].add(at)
                    left -= 1
            shared[at].add(node)
        for other, both in beside.items():
            if len(both) > 1:
                together[other, node] = both
                heapq.heappush(heap, (-len(both), (other, node)))
    graph.items = [(number, name, sorted(shared[at]) + own[at]) for at, (number, name, _) in enumerate(items)]
    return graph


def scores(graph: Graph, docs: int, entries: dict[int, tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[int, np.ndarray]]:
    """Each item's position and the scores of all documents of a block; ``entries`` has the documents and values of a term."""
    left, held = graph.uses(), {}

    def add(total: np.ndarray, node: int) -> None:
        if node < len(graph.leaves):
            term, times = graph.leaves[node]
            if term in entries:
                who, values = entries[term]
                total[who] += values * times
            return
        total += held[node] if node in held else value(node)
        left[node] -= 1
        if left[node]:
            return
        held.pop(node, None)

    def value(top: int) -> np.ndarray:
        # parts before wholes, without recursion: chains of sets can be long
        waiting = [top]
        while waiting:
            node = waiting[-1]
            parts = graph.parts[node - len(graph.leaves)]
            missing = [p for p in parts if p >= len(graph.leaves) and p not in held]
            if missing:
                waiting += missing
                continue
            waiting.pop()
            if node not in held:
                total = np.zeros(docs, np.int64)
                held[node] = total
                for p in parts:
                    add(total, p)
        return held[top]

    for at, (_, _, parts) in enumerate(graph.items):
        total = np.zeros(docs, np.int64)
        for p in parts:
            add(total, p)
        yield at, total


def best(values: np.ndarray, keys: np.ndarray, missing: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest values above 0; of equal ones those with smaller keys, and missing keys last."""
    found = np.flatnonzero(values > 0)
    if len(found) > k:
        least = np.partition(values[found], len(found) - k)[len(found) - k]
        found = found[values[found] >= least]
    return found[np.lexsort((keys[found], missing[found], -values[found]))[:k]]


def block_entries(row: dict, codes: np.ndarray, terms: np.ndarray, weights: np.ndarray, mean: Callable) -> dict:
    """The documents and values of each term of the graph in a block."""
    who, every, tf = word_entries(row)
    to_term = np.full(max(codes.max(), every.max(initial=0)) + 1, -1, np.int64)
    to_term[codes] = terms
    found = np.flatnonzero(to_term[every] >= 0)
    term, tf, who = to_term[every[found]], tf[found], who[found]
    m = mean(np.array(row["n_words"], np.int64))[who]
    values = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))
    order = np.argsort(term, kind="stable")
    term, who, values = term[order], who[order], values[order]
    starts = np.flatnonzero(np.diff(term, prepend=-1))
    return {int(term[a]): (who[a:b], values[a:b]) for a, b in zip(starts, [*starts[1:], len(term)])}


def item_terms(items: DataFrame, key: str, text: str) -> DataFrame:
    """One row per item and term: number, item_id, n_bytes, term, times."""
    read = items.select(
        F.monotonically_increasing_id().alias("number"), F.col(key).cast("long").alias("item_id"), F.col(text).cast("binary").alias("text")
    )

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = terms_of()
        for batch in batches:
            rows = [(n, i, t, times) for n, i, text in zip(*(c.to_pylist() for c in batch.columns)) for t, times in Counter(of(text or b"")).items()]
            yield pa.RecordBatch.from_pylist(
                [{"number": n, "item_id": i, "term": t, "times": times} for n, i, t, times in rows],
                schema=pa.schema([("number", pa.int64()), ("item_id", pa.int64()), ("term", pa.binary()), ("times", pa.int64())]),
            )

    return read.mapInArrow(split, "number long, item_id long, term binary, times long")


def graphs(asked: DataFrame, weights: DataFrame, batches: int) -> DataFrame:
    """One row per batch of items: its mined graph."""

    def mine(rows: pa.Table) -> pa.Table:
        items: dict[int, tuple[int, int | None, dict[bytes, int]]] = {}
        known = {}
        for r in rows.sort_by("number").to_pylist():
            items.setdefault(r["number"], (r["number"], r["item_id"], {}))[2][r["term"]] = r["times"]
            known[r["term"]] = r["weight"]
        return pa.table({"graph": pa.array([pickle.dumps(vars(mined(list(items.values()), known)))], pa.binary())})

    return (
        asked.join(weights, "term")
        .withColumn("batch", F.pmod(F.xxhash64("number"), F.lit(batches)))
        .groupBy("batch")
        .applyInArrow(mine, "graph binary")
    )


def ranked(
    docs: DataFrame,
    items: DataFrame,
    k: int = K,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    batch_items: int = BATCH_ITEMS,
) -> DataFrame:
    """Each item's best documents: item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    asked = stored(item_terms(items, item_key, item_text), "item-terms")
    size = asked.agg(F.countDistinct("number").alias("items"), F.sum(F.length("term") + 1).alias("bytes")).first()
    batches = max(1, math.ceil(size["items"] / batch_items), math.ceil((size["bytes"] or 0) / BATCH_BYTES))
    blocks = stored(word_blocks(docs, terms_of, key, text), "terms")
    told = blocks.select(
        F.sum(F.aggregate("n_words", F.lit(0).cast("long"), lambda total, n: total + n)).alias("words"),
        F.sum(F.size(F.filter("n_words", lambda n: n > 0))).alias("docs"),
    ).first()
    n_docs, n_words = told["docs"] or 0, told["words"] or 0
    hits = stored(dictionary(blocks).join(asked.select(F.col("term").alias("word")).distinct(), "word"), "hits")
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.sum("docs") + 1).cast("double")))
    weights = hits.groupBy(F.col("word").alias("term")).agg(weight.cast("long").alias("weight"))
    held = blocks.select("block", "keys", "n_words", "sizes", "steps", "freqs")
    found = None
    # one pass over the blocks a batch; a graph's size is bounded by that of a batch
    for row in stored(graphs(asked, weights, batches), "graphs").toLocalIterator():
        part = _searched(held, hits, Graph(**pickle.loads(row["graph"])), n_docs, n_words, k)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _searched(held: DataFrame, hits: DataFrame, graph: Graph, n_docs: int, n_words: int, k: int) -> DataFrame:
    """The best k documents of each item in each block."""

    def mean(n: np.ndarray) -> np.ndarray:
        # 25 * n * N can pass 64 bits, but not its quotient and rest by L
        whole, rest = np.divmod(n, n_words)
        return 75 + 25 * n_docs * whole + np.array([25 * n_docs * int(r) // n_words for r in rest], np.int64)

    def search(rows: pa.Table, found: pa.Table) -> pa.Table:
        out: dict[str, list] = {"number": [], "item_id": [], "doc_id": [], "score": []}
        pairs = [(c, graph.terms[w]) for c, w in zip(found.column("code").to_pylist(), found.column("word").to_pylist()) if w in graph.terms]
        if pairs:
            codes, terms = np.array(pairs, np.int64).T
            for row in rows.to_pylist():
                missing = np.array([x is None for x in row["keys"]])
                keys = np.array([NO_KEY if x is None else x for x in row["keys"]], np.int64)
                entries = block_entries(row, codes, terms, np.array(graph.weights, np.int64), mean)
                for at, values in scores(graph, len(keys), entries):
                    number, name, _ = graph.items[at]
                    for i in best(values, keys, missing, k):
                        out["number"].append(number)
                        out["item_id"].append(name)
                        out["doc_id"].append(row["keys"][i])
                        out["score"].append(int(values[i]))
        return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})

    of_block = hits.select(F.col("block").alias("of_block"), "code", "word")
    return held.groupBy("block").cogroup(of_block.groupBy("of_block")).applyInArrow(
        search, "number long, item_id long, doc_id long, score long"
    )
