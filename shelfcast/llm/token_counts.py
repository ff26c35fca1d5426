"""Token counts of documents, without their ids.

A byte-level vocabulary never merges across pre-tokens, so a text has as many tokens as its pre-tokens have pieces.
Texts are read once, into blocks (``word_blocks``) that hold per-document frequencies of pre-tokens. The blocks'
dictionaries are dealt by a hash of the pre-token into buckets, where each distinct pre-token is cut into pieces once; its
number of pieces goes back to the blocks, and every document sums frequency times pieces.

Pre-tokens are found by the tokenizer's own splitter, or, in texts of printable Latin-1 characters, tabs and line
ends, by its published pattern over these characters, which is faster and the same there. A special string inside a text is one token.

Bounds: a block has some 262,000 distinct pre-tokens at most, or those of one text; a pre-token that is in all documents is one
entry a block. There is a bucket for every ``BUCKET_WORDS`` entries of the dictionaries. A task holds one row of a bucket
and the counts of at most ``MOST_KNOWN`` pre-tokens; beyond these it starts anew and some are cut again.

Cases: a null or empty text has no bytes and no tokens; null identifiers and repeated rows are counted like others; an
empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.common import stored
from shelfcast.llm.word_blocks import spread_out, squeezed, word_blocks, word_entries

LIMIT = 1024
BUCKET_WORDS, MOST_KNOWN = 500_000, 1_000_000
RESULT = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xff]*")


def plain_pattern() -> re.Pattern:
    """The vocabulary's pattern, with the letters and numbers of Latin-1 written out."""
    letters, numbers = ("".join(c for c in map(chr, range(256)) if unicodedata.category(c)[0] == kind) for kind in "LN")
    # fixed value: contractions, letters, numbers and other marks with a leading blank, white space
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^\s{letters}{numbers}]+|\s+(?!\S)|\s+")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def loaded(path: str):
    """The tokenizer, and the special strings that it finds inside texts."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        told = json.load(file)
    plain_tokens = all(not t[x] for t in told["added_tokens"] for x in ("single_word", "lstrip", "rstrip", "normalized"))
    splitter = told["pre_tokenizer"] or {}
    if told["normalizer"] or not plain_tokens or splitter.get("type") != "ByteLevel" or splitter.get("add_prefix_space"):
        raise ValueError("only byte-level vocabularies without normalisation or prefix are split as this module does")
    return Tokenizer.from_file(path), [t["content"] for t in told["added_tokens"]]


def pre_tokens(path: str) -> Callable[[], Callable[[bytes], list[str]]]:
    def make() -> Callable[[bytes], list[str]]:
        tokenizer, special = loaded(path)
        split = tokenizer.pre_tokenizer.pre_tokenize_str
        # longer ones first, as the tokenizer finds them
        between = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        find = plain_pattern().findall

        def of(data: bytes) -> list[str]:
            text = data.decode()
            parts = between.split(text) if between else [text]
            out: list[str] = []
            for i, part in enumerate(parts):
                if i % 2:
                    out.append(part)
                elif PLAIN.fullmatch(part):
                    out += find(part)
                else:
                    out += [part[a:b] for _, (a, b) in split(part)]
            return out

        return of

    return make


def dealt(blocks: DataFrame, buckets: int) -> DataFrame:
    """Each block's dictionary in parts, by a hash of the word."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, words in zip(batch.column("block").to_pylist(), batch.column("words").to_pylist()):
                if not words:
                    continue
                every = np.array([*words, None], dtype=object)[:-1]
                bucket = (pd.util.hash_array(every) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                found, starts = np.unique(bucket[order], return_index=True)
                parts = [order[a:b] for a, b in zip(starts, [*starts[1:], len(order)])]
                lengths = np.fromiter(map(len, words), np.uint32, len(words))
                columns = [
                    pa.array([block] * len(found), pa.int64()),
                    pa.array(found, pa.int64()),
                    *(pa.array([squeezed(x) for x in each], pa.binary()) for each in ([p.astype(np.uint32) for p in parts], [lengths[p] for p in parts])),
                    pa.array([squeezed(np.frombuffer(b"".join(every[p]), np.uint8)) for p in parts], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["block", "bucket", "codes", "lengths", "words"])

    return blocks.select("block", "words").mapInArrow(deal, "block long, bucket long, codes binary, lengths binary, words binary")


def pieces(parts: DataFrame, path: str) -> DataFrame:
    """The number of pieces of each word; a word is cut once, as all its rows are in one bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, special = loaded(path)
        known: dict[bytes, int] = {}
        at = None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["bucket"] != at or len(known) > MOST_KNOWN:
                    known, at = {s.encode(): 1 for s in special}, row["bucket"]
                until = np.concatenate([[0], np.cumsum(spread_out(row["lengths"], np.uint32).astype(np.int64))])
                data = spread_out(row["words"], np.uint8).tobytes()
                words = [data[a:b] for a, b in zip(until[:-1], until[1:])]
                new = [w for w in words if w not in known]
                found = tokenizer.encode_batch_fast([w.decode() for w in new], add_special_tokens=False)
                known.update(zip(new, (len(e.ids) for e in found)))
                out.append(squeezed(np.fromiter(map(known.__getitem__, words), np.uint32, len(words))))
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("codes"), pa.array(out, pa.binary())], ["of_block", "codes", "pieces"])

    return parts.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(count, "of_block long, codes binary, pieces binary")


def token_counts(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, over_limit."""
    path = path or default_path()
    blocks = stored(word_blocks(docs, pre_tokens(path), key, text), "pre-tokens")
    words = blocks.agg(F.sum(F.size("words"))).first()[0] or 0
    answers = pieces(dealt(blocks, max(1, -(-words // BUCKET_WORDS))), path)

    def summed(held: pa.Table, told: pa.Table) -> pa.Table:
        codes = [spread_out(x, np.uint32) for x in told.column("codes").to_pylist()]
        found = [spread_out(x, np.uint32) for x in told.column("pieces").to_pylist()]
        sizes = np.zeros(sum(map(len, codes)), np.int64)
        if codes:
            sizes[np.concatenate(codes)] = np.concatenate(found)
        out = []
        for row in held.to_pylist():
            who, every, freqs = word_entries(row)
            tokens = np.zeros(len(row["keys"]), np.int64)
            np.add.at(tokens, who, sizes[every] * freqs)
            columns = [pa.array(row["keys"], pa.int64()), pa.array(row["n_bytes"], pa.int64()), pa.array(tokens), pa.array(tokens > limit)]
            out.append(pa.Table.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens", "over_limit"]))
        return pa.concat_tables(out)

    held = blocks.select("block", "keys", "n_bytes", "sizes", "steps", "freqs")
    return held.groupBy("block").cogroup(answers.groupBy("of_block")).applyInArrow(summed, RESULT)
