"""Words of many texts at once with numpy: where they are and a 64-bit hash of each.

A word is a run of anything but blank and tab to carriage return; A-Z count as a-z. A word's hash is a polynomial over
random 64-bit values of its bytes, so the hash of any piece of a text comes from two prefix sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from copy import copy
from functools import lru_cache

import numpy as np
import pyarrow as pa

_rng = np.random.default_rng(20_240_601)
BYTE_VALUES = _rng.integers(1, 2**63, 256, dtype=np.uint64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.zeros(256, dtype=bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
#: Texts are worked on in blocks of at most so many bytes, or one text if it is longer: 2**20 powers do for them.
BLOCK_BYTES = (1 << 20) - 2


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@lru_cache(2)
def _powers(log2: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << log2
    up, down = np.full(n, _BASE, dtype=np.uint64), np.full(n, _INVERSE, dtype=np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n + 1 of each."""
    return _powers(max(20, int(n).bit_length()))


class Words:
    """The words of a block of texts: data (lower-cased bytes), start, end, doc and hash of each, n_docs."""

    def __init__(self, texts: list[bytes]):
        self.n_docs = len(texts)
        self.data = data = LOWER[np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)]
        blank = BLANK[data]
        edge = np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8))
        self.start, self.end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        self.doc = np.searchsorted(self.first, self.start, side="right") - 1
        up, down = powers(len(data))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE_VALUES[data] * up[: len(data)], dtype=np.uint64)])
        self.hash = mixed((self.sums[self.end] - self.sums[self.start]) * down[self.start])

    def subset(self, docs: np.ndarray) -> Words:
        """The words of some of the texts, which are numbered anew."""
        number = np.full(self.n_docs, -1)
        number[docs] = np.arange(len(docs))
        out = copy(self)
        out.doc, out.n_docs = number[self.doc], len(docs)
        mine = out.doc >= 0
        out.doc, out.start, out.end, out.hash = out.doc[mine], self.start[mine], self.end[mine], self.hash[mine]
        return out

    def per_doc(self) -> np.ndarray:
        """The number of words of each text."""
        return np.bincount(self.doc, minlength=self.n_docs)


def blocks(batches: Iterator[pa.RecordBatch], text: str, keep: list[str]) -> Iterator[tuple[list[bytes], pa.RecordBatch]]:
    """(texts as bytes, the kept columns) for blocks of at most BLOCK_BYTES or one text; a null text is empty."""
    for batch in batches:
        column = batch.column(text)
        kept = batch.select(keep)
        at, size = 0, 0
        texts: list[bytes] = []
        for k, x in enumerate(column.cast(pa.large_binary())):
            b = x.as_buffer().to_pybytes() if x.is_valid else b""
            if texts and size + len(b) > BLOCK_BYTES:
                yield texts, kept.slice(at, k - at)
                at, size, texts = k, 0, []
            texts.append(b)
            size += len(b) + 1
        if texts:
            yield texts, kept.slice(at, len(texts))


class HashTable:
    """Sorted 64-bit hashes with an index on their leading bits, so that a lookup reads a few neighbours only."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        bits = max(1, len(hashes).bit_length() + 1)
        self.shift = np.uint64(64 - bits)
        buckets = (hashes >> self.shift).astype(np.int64)
        self.index = np.searchsorted(buckets, np.arange((1 << bits) + 1)).astype(np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash, -1 if it isn't there."""
        out = np.full(len(h), -1, dtype=np.int32)
        bucket = (h >> self.shift).astype(np.int64)
        at, end = self.index[bucket], self.index[bucket + 1]
        todo = np.flatnonzero(at < end)
        at, end, h = at[todo], end[todo], h[todo]
        while len(todo):
            same = self.hashes[at] == h
            out[todo[same]] = at[same]
            more = ~same & (at + 1 < end)
            todo, at, end, h = todo[more], at[more] + 1, end[more], h[more]
        return out
