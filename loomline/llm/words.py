"""Words, word hashes and Arrow plumbing shared by the text operators.

A word is a maximal run of letters and digits, in lower case.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

WORD = re.compile(r"[^\W_]+")
CHUNK_CHARS = 4_000_000
_CACHE_WORDS = 200_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.uint64(0xBF58476D1CE4E5B9)


class _Hashes(dict):
    """Word -> 64-bit hash, the same in every process."""

    def __missing__(self, word: str) -> int:
        if len(self) >= _CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


_hashes = _Hashes()


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def hash_words(found: list[str]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, found), np.uint64, len(found))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * _ODD
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of all runs of ``n`` words, in order; empty if there are fewer words."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:m].copy()
    for k in range(1, n):
        out = mix(out + _MIX) + hashes[k : k + m]
    return mix(out)


def chunks(texts: list[str | None], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of about ``limit`` characters, at least one text each."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t) if t else 0
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def arrow_map(fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], rows: int = 2048):
    """A function for ``mapInArrow`` that hands on slices of at most ``rows`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                out = fn(batch.slice(at, rows))
                if out is not None and out.num_rows:
                    yield out

    return run
