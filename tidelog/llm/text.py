"""Vectorised text primitives, shared by the operators that run in Arrow batches.

A *word* is a maximal run of bytes outside space, \\t, \\n, \\v, \\f and \\r. Everything here works
on UTF-8 bytes of whole texts, a bounded chunk of texts at a time; a null text counts as empty.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93  # odd, so that powers have inverses modulo 2^64
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9)) ^ np.uint64(0x94D049BB133111EB)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64; kept per process and grown by doubling."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = n + n // 8 if n > CHUNK_BYTES else CHUNK_BYTES + (1 << 16)
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of several texts in one buffer; text i has words lo[i]:hi[i] and bytes at[i]:at[i]+size[i]."""

    buf: np.ndarray
    at: np.ndarray
    size: np.ndarray
    start: np.ndarray
    end: np.ndarray
    lo: np.ndarray
    hi: np.ndarray

    @property
    def count(self) -> np.ndarray:
        return self.hi - self.lo

    @property
    def doc(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.at)), self.count)

    def per_text(self, of_byte: np.ndarray) -> np.ndarray:
        """Sum of a per-byte value over each text."""
        total = np.concatenate([[0], np.cumsum(of_byte, dtype=np.int64)])
        return total[self.at + self.size] - total[self.at]

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word: equal words have equal hashes on every machine."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        n = len(self.buf)
        total = np.cumsum(_BYTE[self.buf] * _power(_BASE, n), dtype=np.uint64)
        before = np.where(self.start > 0, total[self.start - 1], np.uint64(0))
        raw = (total[self.end - 1] - before) * _power(_INVERSE, n)[self.start]
        return mix(raw + (self.end - self.start).astype(np.uint64) * _GOLD)

    def windows(self, k: int, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each run of k words inside one text, and the index of its first word."""
        h = self.hashes() if hashes is None else hashes
        if len(h) < k:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        n = len(h) - k + 1
        out = h[:n].copy()
        for i in range(1, k):
            out = mix(out * _GOLD + h[i : i + n])
        left = np.repeat(self.hi, self.count)[:n] - np.arange(n)  # words from here to the end of the text
        first = np.flatnonzero(left >= k)
        return out[first], first


def split(texts: list[bytes]) -> Words:
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    at = np.concatenate([[0], np.cumsum(size + 1)[:-1]]) if texts else np.zeros(0, np.int64)
    edge = np.diff(IS_SPACE[buf].view(np.int8), prepend=np.int8(1))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    lo = np.searchsorted(start, at)
    hi = np.searchsorted(start, at + size)
    return Words(buf, at, size, start, end, lo, hi)


def slices(batches: Iterable[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that few texts are held twice at a time."""
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)


def as_bytes(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def chunked(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Index ranges of about `limit` bytes each; a longer text is a range of its own."""
    lo = total = 0
    for i, t in enumerate(texts):
        if i > lo and total + len(t) > limit:
            yield lo, i
            lo, total = i, 0
        total += len(t) + 1
    if lo < len(texts):
        yield lo, len(texts)


def per_text(names: dict[str, pa.DataType], compute, keep: list[str], text: str = "text"):
    """A mapInArrow function that appends compute(list of texts) -> {name: values} to the kept columns."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = as_bytes(b.column(text))
            parts = [compute(texts[lo:hi]) for lo, hi in chunked(texts)]
            made = []
            for n, kind in names.items():
                if parts and isinstance(parts[0][n], np.ndarray):
                    made.append(pa.array(np.concatenate([p[n] for p in parts])).cast(kind))
                else:
                    made.append(pa.array([x for p in parts for x in p[n]], kind))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), *made], [*keep, *names])

    return run
