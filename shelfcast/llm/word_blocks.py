"""Documents as blocks: a dictionary of the block's distinct words, and each document's words as codes with frequencies.

A block is one row, written by the task that read its texts. What an operator wants to know about words it joins to
the dictionaries, one row per block and distinct word, and never to the words of each document; so a word that is in every
document is one row a block. A block ends at ``MOST_WORDS`` words, ``MOST_CHARS`` characters or ``MOST_DOCS``
documents, or after the single document that goes beyond these; documents are never parted. Codes are in order of how many documents
of the block hold the word, then of its first document; each document's codes ascend and are kept as differences, which
are small for common words and 1 for words of that document alone, and so take about a byte.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_WORDS, MOST_CHARS, MOST_DOCS = 1 << 18, 1 << 24, 8192
SCHEMA = (
    "block long, keys array<long>, n_bytes array<long>, n_words array<long>, sizes binary, steps binary, freqs binary,"
    " words array<binary>, word_docs array<long>"
)
CODEC = "zstd"


def squeezed(values: np.ndarray) -> bytes:
    """An array as compressed bytes after its length."""
    return len(values).to_bytes(8, "little") + pa.compress(values.tobytes(), codec=CODEC, asbytes=True)


def spread_out(data: bytes, kind: type) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    plain = pa.decompress(data[8:], decompressed_size=n * np.dtype(kind).itemsize, codec=CODEC, asbytes=True)
    return np.frombuffer(plain, kind)


class Block:
    """A block that is being filled."""

    def __init__(self):
        self.code: defaultdict[bytes | str, int] = defaultdict()
        self.code.default_factory = self.code.__len__
        self.keys: list[int | None] = []
        self.n_bytes: list[int] = []
        self.n_words: list[int] = []
        self.codes: list[np.ndarray] = []
        self.freqs: list[np.ndarray] = []
        self.chars = 0

    def full(self) -> bool:
        return len(self.code) >= MOST_WORDS or self.chars >= MOST_CHARS or len(self.keys) >= MOST_DOCS

    def add(self, key: int | None, n_bytes: int, words: Iterable[bytes | str]) -> None:
        found = Counter(words)
        self.keys.append(key)
        self.n_bytes.append(n_bytes)
        self.codes.append(np.fromiter(map(self.code.__getitem__, found), np.uint32, len(found)))
        self.freqs.append(np.fromiter(found.values(), np.uint32, len(found)))
        self.n_words.append(int(self.freqs[-1].sum(dtype=np.int64)))
        self.chars += n_bytes

    def row(self, block: int) -> pa.RecordBatch:
        codes, freqs = np.concatenate(self.codes), np.concatenate(self.freqs)
        sizes = np.array([len(c) for c in self.codes], dtype=np.int64)
        word_docs = np.bincount(codes, minlength=len(self.code))
        by_docs = np.argsort(-word_docs, kind="stable")
        renamed = np.empty(len(by_docs), np.int64)
        renamed[by_docs] = np.arange(len(by_docs))
        codes = renamed[codes]
        who = np.repeat(np.arange(len(sizes)), sizes)
        order = np.argsort(who * (len(by_docs) + 1) + codes)
        codes, freqs = codes[order], freqs[order]
        steps = np.diff(codes, prepend=0)
        firsts = (np.cumsum(sizes) - sizes)[sizes > 0]
        steps[firsts] = codes[firsts]
        words = [w if isinstance(w, bytes) else w.encode() for w in self.code]
        columns = [
            pa.array([block], pa.int64()),
            *(pa.array([x], pa.list_(pa.int64())) for x in (self.keys, self.n_bytes, self.n_words)),
            *(pa.array([squeezed(x)], pa.binary()) for x in (sizes, steps.astype(np.uint32), freqs)),
            pa.array([[words[i] for i in by_docs]], pa.list_(pa.binary())),
            pa.array([word_docs[by_docs]], pa.list_(pa.int64())),
        ]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SCHEMA.split(", ")])


def word_entries(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's entries: position of the document, code and frequency of the word."""
    sizes = spread_out(row["sizes"], np.int64)
    total = np.cumsum(spread_out(row["steps"], np.uint32).astype(np.int64))
    before = np.concatenate([[0], total])[np.cumsum(sizes) - sizes]
    return np.repeat(np.arange(len(sizes)), sizes), total - np.repeat(before, sizes), spread_out(row["freqs"], np.uint32).astype(np.int64)


def word_blocks(docs: DataFrame, words_of: Callable[[], Callable[[bytes], Iterable[bytes | str]]], key: str, text: str) -> DataFrame:
    """The blocks of all documents; ``words_of`` is called once a task and gives what splits a text in UTF-8."""
    read = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, block = words_of(), Block()
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for k, t in zip(batch.column("key").to_pylist(), batch.column("text")):
                data = t.as_py()
                block.add(k, len(data), split(data))
                if block.full():
                    yield block.row(number)
                    block, number = Block(), number + 1
        if block.keys:
            yield block.row(number)

    return read.mapInArrow(build, SCHEMA)


def dictionary(blocks: DataFrame) -> DataFrame:
    """One row per block and distinct word: block, code, word, and the documents of the block that hold it."""
    return blocks.select("block", F.posexplode(F.arrays_zip("words", "word_docs")).alias("code", "found")).select(
        "block", "code", F.col("found.words").alias("word"), F.col("found.word_docs").alias("docs")
    )
