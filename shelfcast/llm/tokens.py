"""Token ids of whole texts, for use inside tasks.

A text's ids are those of its words, since the vocabulary drops white space and never joins across it. So
Arrow splits and dictionary-encodes the words of a chunk, and only its distinct words are tokenised. Words of
printable Latin-1 characters are split by the tokenizer's own pattern, and pieces that are new to the Python worker
go straight to its merge model; any other word takes the tokenizer's full way.
"""

from __future__ import annotations

import json
import os
import sys
import types
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

END_ID = 2
CHUNK_CHARS = 4_000_000
MOST_CACHED = 300_000
# stands between the words' ids while they are worked out; no vocabulary has so many ids
WORD_END = np.uint32(0xFFFFFFFF)

# printable Latin-1 without the no-break space, and line feeds: no normalisation changes these but lower case
PLAIN = regex.compile(r"[\x21-\x7e\xa1-\xff\n]+")
# fixed values: contractions, letters, single digits, runs of anything else
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BLANK = regex.compile(r"[ \t\n\x0b\x0c\r]")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_characters() -> dict[int, str]:
    """The character that byte-level vocabularies write for a byte: itself if it shows, else the next from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class WordIds:
    """Ids of texts, with a bounded cache of their pieces."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        self.special = [t["content"] for t in told["added_tokens"]]
        if told["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] != PIECES:
            raise ValueError("the vocabulary does not split words as this module does")
        self.pieces = regex.compile(PIECES + r"|\n")
        self.characters = _byte_characters()
        self.known: dict[str, bytes] = {"\n": WORD_END.tobytes()}

    def _learn(self, pieces: list[str]) -> None:
        """Cache the ids of pieces that are new."""
        if len(self.known) > MOST_CACHED:
            self.known = {"\n": WORD_END.tobytes()}
        tokenize, new = self.tokenizer.model.tokenize, list(set(pieces).difference(self.known))
        shown = [p if p.isascii() else p.encode().decode("latin-1").translate(self.characters) for p in new]
        self.known.update(zip(new, [array("I", [t.id for t in tokenize(p)]).tobytes() for p in shown]))

    def _plain(self, joined: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that end with a line feed each, and where each word's ids end."""
        pieces = self.pieces.findall(joined.lower())
        self._learn(pieces)
        ids = np.frombuffer(b"".join(map(self.known.__getitem__, pieces)), np.uint32)
        ends = np.flatnonzero(ids == WORD_END)
        return ids[ids != WORD_END], ends - np.arange(len(ends))

    def _is_plain(self, joined: str) -> bool:
        return bool(PLAIN.fullmatch(joined)) and not any(s in joined for s in self.special)

    def _ids_of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after the other, and where each word's end."""
        line, nothing = (pa.scalar(x, pa.large_string()) for x in ("\n", ""))
        joined = pc.binary_join_element_wise(words, line, nothing).buffers()[2].to_pybytes().decode()
        if self._is_plain(joined):
            return self._plain(joined)
        parts, sizes = [], np.zeros(len(words), np.int64)
        for i, w in enumerate(words.to_pylist()):
            if self._is_plain(w):
                part = self._plain(w + "\n")[0]
            else:
                part = np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, np.uint32)
            parts.append(part)
            sizes[i] = len(part)
        return np.concatenate(parts), np.cumsum(sizes)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each has."""
        split = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        words, ends = split.flatten(), split.offsets.to_numpy()
        if not len(words):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        coded = words.dictionary_encode()
        store, until = self._ids_of(coded.dictionary)
        each = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], until])), pa.array(store))
        laid = each.take(coded.indices)
        until = laid.offsets.to_numpy()
        return laid.values.to_numpy(), until[ends[1:]] - until[ends[:-1]]


def worker_cache(path: str) -> WordIds:
    """One per Python worker, kept between its tasks."""
    kept = sys.modules.setdefault("_word_ids_of_this_worker", types.ModuleType("_word_ids_of_this_worker"))
    if path not in vars(kept):
        vars(kept)[path] = WordIds(path)
    return vars(kept)[path]


def _parts(text: str, most: int) -> Iterator[str]:
    """The text in parts of about ``most`` characters, cut at white space."""
    at = 0
    while len(text) - at > most:
        cut = BLANK.search(text, at + most)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.end()
    yield text[at:]


def encoded(path: str, texts: list[str | None], most: int = CHUNK_CHARS) -> Iterator[tuple[int, np.ndarray]]:
    """The position and the ids of each text, in order; memory is bounded by ``most`` and the longest text's ids."""
    words = worker_cache(path)
    waiting: list[tuple[int, str]] = []

    def flush() -> Iterator[tuple[int, np.ndarray]]:
        ids, sizes = words.encode([t for _, t in waiting])
        at = 0
        for (i, _), n in zip(waiting, sizes):
            yield i, ids[at : at + n]
            at += n
        waiting.clear()

    chars = 0
    for i, text in enumerate(texts):
        text = text or ""
        if len(text) > most:
            yield from flush()
            chars = 0
            yield i, np.concatenate([words.encode([part])[0] for part in _parts(text, most)])
            continue
        waiting.append((i, text))
        chars += len(text)
        if chars >= most:
            yield from flush()
            chars = 0
    if waiting:
        yield from flush()
