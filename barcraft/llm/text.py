"""Vectorised word splitting and hashing over Arrow batches, shared by the corpus operators.

A word is a run of bytes outside 0x09-0x0D and 0x20, which on UTF-8 is the pattern
``[^\\x20\\x09-\\x0D]+``.  All hashes are fixed functions of the bytes: they agree
between workers, retries and runs.  Words are hashed by a polynomial modulo 2**64 at once; sums
of that kind collide by construction on certain strings of 1,024 bytes and more, whatever the
base, so words over LONG_WORD bytes are hashed each by a hash of another kind.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes from which a word is hashed on its own.
LONG_WORD = 256
#: Text bytes that are hashed at once; bounds a worker's memory whatever the batch size.
CHUNK_BYTES = 1 << 19
#: Powers that are kept; more are made for one very long text and dropped.
_KEPT = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_ROLL = 0xD1342543DE82EF95
_ROLL_INV = pow(_ROLL, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, _KEPT), base, np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if len(have) == _KEPT:
            _powers[base] = have
    return have[:n]


def prefix_of(hashes: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``rolling`` gives the hash of any run."""
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * _power(_ROLL, len(hashes)), out=total[1:])
    return total


def rolling(prefix: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Order-dependent 64-bit rolling hash of each run of n hashes: a subtraction, a product
    and a finaliser per run, whatever n is."""
    m = len(prefix) - n
    if m <= 0:
        return np.zeros(0, np.uint64)
    return mix((prefix[n:] - prefix[:-n]) * _power(_ROLL_INV, m) + np.uint64(n + 1000003 * seed))


def texts_of(batch: pa.RecordBatch, column: str = "text", rows: int = 512) -> Iterator[tuple[int, list[bytes | None]]]:
    """(first row, texts as bytes) of a batch, some rows at a time: a batch of long texts is
    never copied as a whole."""
    values = batch.column(column).cast(pa.binary())
    for lo in range(0, len(values), rows):
        yield lo, values.slice(lo, rows).to_pylist()


def chunks(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[int, int, list[bytes]]]:
    """(first row, last row + 1, texts as bytes) with about CHUNK_BYTES at most; null is empty."""
    for base, texts in texts_of(batch, column):
        start = size = 0
        for i, t in enumerate(texts):
            if size and size + len(t or b"") > CHUNK_BYTES:
                yield base + start, base + i, [x or b"" for x in texts[start:i]]
                start, size = i, 0
            size += len(t or b"")
        if start < len(texts):
            yield base + start, base + len(texts), [x or b"" for x in texts[start:]]


class Words:
    """Words of some texts: byte ranges in ``data``, their 64-bit hashes, and ``first``:
    words of text i are ``first[i]:first[i + 1]``.  ``affixes`` asks for hashes of each
    word's first k bytes (k > 0) or last -k bytes (k < 0), in ``affix``."""

    def __init__(self, texts: list[bytes], affixes: tuple[int, ...] = ()):
        self.data = b" ".join(texts)
        raw = np.frombuffer(self.data, np.uint8)
        space = _SPACE[raw]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
        self.start, self.end = edge[::2], edge[1::2]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        begins = np.concatenate(([0], np.cumsum(sizes + 1)))
        self.first = np.searchsorted(self.start, begins)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.hash = np.empty(len(self.start), np.uint64)
        self.affix = [np.empty(len(self.start), np.uint64) for _ in affixes]
        long = np.flatnonzero(self.end - self.start > LONG_WORD)
        # prefix sums over a stretch of bytes at a time, so that they stay small
        cuts = np.unique(np.concatenate((np.searchsorted(self.start, np.arange(0, len(raw), CHUNK_BYTES)), [len(self.start)])))
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            at, until = int(self.start[lo]), int(self.end[hi - 1])
            prefix = np.zeros(until - at + 1, np.uint64)
            np.cumsum((raw[at:until].astype(np.uint64) + np.uint64(1)) * _power(_BASE, until - at), out=prefix[1:])
            begin, end = self.start[lo:hi] - at, self.end[lo:hi] - at
            inverse = _power(_BASE_INV, until - at + 1)
            self.hash[lo:hi] = mix((prefix[end] - prefix[begin]) * inverse[begin] + (end - begin).astype(np.uint64))
            for k, out in zip(affixes, self.affix, strict=True):
                a, b = (begin, np.minimum(begin + k, end)) if k > 0 else (np.maximum(end + k, begin), end)
                out[lo:hi] = mix((prefix[b] - prefix[a]) * inverse[a] + (b - a + 1000 * (k + 64)).astype(np.uint64))
        for i in long.tolist():
            self.hash[i] = xxhash.xxh3_64_intdigest(self.data[self.start[i] : self.end[i]])

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @cached_property
    def prefix(self) -> np.ndarray:
        return prefix_of(self.hash)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Start words of the n-word windows that lie in one text, and their hashes."""
        m = len(self.hash) - n + 1
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.doc[: m] == self.doc[n - 1 :]) if n > 1 else np.arange(m)
        return at, rolling(self.prefix, n)[at]
