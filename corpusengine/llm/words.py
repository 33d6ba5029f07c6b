"""Words of many texts at once, as numpy arrays, for use inside Spark tasks.

Texts are joined into one byte buffer; word bounds come from a table of separator bytes, and the 64-bit hash of any run
of bytes is the difference of two prefix sums times a power, so that hashing costs a few passes however many words there are.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[str, np.ndarray] = {}

#: Bytes of text that are held as one buffer; a longer text is a buffer of its own. Two workers share an executor with its JVM.
BATCH_BYTES = 250_000
#: What a text takes besides its own length, as empty texts have results too.
ROW_BYTES = 256


@dataclass
class Words:
    """``doc[i]`` is the text, ``start[i]:end[i]`` the bytes and ``hash[i]`` the hash of word i; ``first[d]:first[d + 1]`` are the words of text d."""

    buf: np.ndarray
    sums: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def run_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the bytes ``start[i]:end[i]``."""
        return mix((self.sums[end] - self.sums[start]) * power("inverse", len(self.buf))[start])


def power(kind: str, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) <= n:
        steps = np.full(max(n + 1, BATCH_BYTES + 1), _INVERSE if kind == "inverse" else _BASE)
        steps[0] = 1
        have = _powers[kind] = np.multiply.accumulate(steps)
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each n consecutive hashes, in order."""
    k = len(hashes) - n + 1
    if k <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:k].copy()
    for j in range(1, n):
        out *= _BASE
        out += hashes[j : j + k]
    return mix(out)


def tokenise(texts: Iterable[str | None]) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the texts with A-Z lower-cased; none in null or empty ones."""
    parts = [(t or "").encode("utf-8", "replace") for t in texts]
    ends = np.cumsum([len(p) + 1 for p in parts], dtype=np.int64) if parts else np.zeros(0, np.int64)
    buf = _LOWER[np.frombuffer(b"\n".join([*parts, b""]), np.uint8)]
    word = np.zeros(len(buf) + 2, np.int8)
    word[1:-1] = ~_SPACE[buf]
    turn = np.flatnonzero(np.diff(word))
    start, end = turn[0::2], turn[1::2]
    sums = np.ones(len(buf) + 1, np.uint64)
    sums[0] = 0
    sums[1:] += buf
    sums[1:] *= power("base", len(buf))[: len(buf)]
    np.cumsum(sums, out=sums)
    first = np.concatenate([[0], np.searchsorted(start, ends)]).astype(np.int64)
    out = Words(buf, sums, start, end, first, np.zeros(0, np.uint64))
    out.hash = out.run_hash(start, end)
    return out


def spaced(w: Words) -> tuple[memoryview, np.ndarray]:
    """All words with one blank after each, and where each begins: words i to j - 1 are the bytes ``at[i]:at[j] - 1``."""
    lengths = w.end - w.start
    at = np.concatenate([[0], np.cumsum(lengths + 1)])
    source = np.repeat(w.start - at[:-1], lengths + 1) + np.arange(at[-1])
    joined = w.buf[np.minimum(source, len(w.buf) - 1)] if len(source) else np.zeros(0, np.uint8)
    joined[at[1:] - 1] = 32
    return memoryview(joined.tobytes()), at


def batches(frames: Iterable, column: str = "text", size: int = BATCH_BYTES) -> Iterator:
    """Slices of pandas frames whose texts make up about ``size`` characters each, a row counting ROW_BYTES besides; one row at least.

    At the end of a task's rows the worker, which waits for other tasks, gives back what its allocators keep.
    """
    for frame in frames:
        if not len(frame):
            continue
        lengths = frame[column].fillna("").str.len().to_numpy(np.int64)
        part = np.cumsum(lengths + ROW_BYTES) // size
        for at in np.split(np.arange(len(frame)), np.flatnonzero(np.diff(part)) + 1):
            yield frame.iloc[at]
    frame = None
    given_back()


def given_back() -> None:
    """Returns memory that was freed, but kept by Arrow and by the C library (where that is glibc), to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
