"""Word shingles of whole texts as 64-bit hashes, for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

WORDS = 5
CHUNK_CHARS = 4_000_000
NOT_A_WORD = r"[^\pL\pN_]+"


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; the constants are its published ones."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and where each text's words end."""
    lowered = pc.utf8_lower(pa.array(texts, pa.large_string()))
    split = pc.split_pattern_regex(lowered, NOT_A_WORD)
    coded = split.flatten().dictionary_encode()
    words = coded.dictionary.to_numpy(zero_copy_only=False)
    codes, ends = coded.indices.to_numpy(), split.offsets.to_numpy()
    filled = np.array([w != "" for w in words], dtype=bool) if len(words) else np.zeros(0, bool)
    hashes = pd.util.hash_array(words.astype(object), categorize=False) if len(words) else np.zeros(0, np.uint64)
    keep = filled[codes] if len(codes) else np.zeros(0, bool)
    kept_until = np.concatenate([[0], np.cumsum(keep)])
    return hashes[codes[keep]] if len(codes) else hashes, kept_until[ends]


def shingle_sets(texts: list[str | None], words: int = WORDS, most: int = CHUNK_CHARS) -> Iterator[np.ndarray]:
    """Sorted distinct shingles of each text.

    A text with fewer than ``words`` words has one shingle of all of them, one without words has none.
    """
    at = 0
    while at < len(texts):
        chunk, chars = [], 0
        while at < len(texts) and (not chunk or chars < most):
            chunk.append(texts[at] or "")
            chars += len(chunk[-1])
            at += 1
        hashes, ends = _word_hashes(chunk)
        full = np.zeros(max(0, len(hashes) - words + 1), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for k in range(words):
                full = mixed(full * np.uint64(3) + hashes[k : k + len(full)])
            for start, end in zip(ends[:-1], ends[1:]):
                if end - start >= words:
                    yield np.unique(full[start : end - words + 1])
                elif end > start:
                    one = np.uint64(end - start)
                    for h in hashes[start:end]:
                        one = mixed(one * np.uint64(3) + h)
                    yield np.array([one], dtype=np.uint64)
                else:
                    yield np.zeros(0, dtype=np.uint64)
