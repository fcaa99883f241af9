"""Vectorised scans over Arrow string columns (numpy, inside Spark tasks).

A batch of texts is one byte buffer plus offsets.  Words are maximal runs of
bytes other than space and 0x09-0x0D; they get 64-bit hashes from a polynomial
prefix sum over random byte values, so no Python object is made per word.
Hash equality stands for word equality (2**-64 per pair).
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
WHITE = np.zeros(256, dtype=bool)
WHITE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 1 << 64)


def process_cache() -> dict:
    """A dict that lives as long as the Python worker (this package's functions
    travel by value, so their module globals last for one task only)."""
    return sys.__dict__.setdefault("_lensmap_llm_cache", {})


def fresh_worker() -> None:
    """Give back what earlier tasks left in this Python worker: the tokenizers that another
    stage keeps (some 200 MB with their pieces) and memory that is free but still held."""
    kept = process_cache()
    for name in [x for x in kept if isinstance(x, tuple)]:
        del kept[name]
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finalizer (splitmix64)."""
    x = np.asarray(x, dtype=U)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTE_VALUE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n (kept per process)."""
    kept = process_cache()
    if "up" not in kept or len(kept["up"]) < n:
        m = max(n, 1 << 16)
        for key, b in (("up", BASE), ("down", BASE_INV)):
            out = np.empty(m, dtype=U)
            out[0] = 1
            have, step = 1, b
            while have < m:  # doubling: out[have:2*have] = out[:have] * b**have
                k = min(have, m - have)
                out[have:have + k] = out[:k] * U(step)
                have, step = have + k, (step * step) & MASK
            kept[key] = out
    return kept["up"], kept["down"]


def to_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as the empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string())
    _, offs, data = col.buffers()
    o = np.frombuffer(offs, dtype=np.int64)[col.offset:col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[o[0]:o[-1]], o - o[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``max_bytes`` of text (a longer text stands alone)."""
    for b in batches:
        if b.num_rows == 0:
            continue
        _, o = to_bytes(b.column(b.schema.get_field_index(text)))
        i = 0
        while i < b.num_rows:
            j = int(np.searchsorted(o, o[i] + max_bytes, side="right")) - 1
            j = min(max(j, i + 1), b.num_rows)
            yield b.slice(i, j - i)
            i = j


class Words:
    """Word starts, ends and owning row of every word of a batch of texts."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray):
        self.n_docs = len(offs) - 1
        solid = ~WHITE[buf]
        edge = np.zeros(len(buf) + 1, dtype=bool)
        edge[offs] = True
        before = np.empty(len(buf), dtype=bool)
        after = np.empty(len(buf), dtype=bool)
        if len(buf):
            before[0], before[1:] = False, solid[:-1]
            after[-1], after[:-1] = False, solid[1:]
        self.start = np.flatnonzero(solid & (~before | edge[:-1]))
        self.end = np.flatnonzero(solid & (~after | edge[1:])) + 1
        self.doc = np.searchsorted(offs, self.start, side="right") - 1
        self.count = np.bincount(self.doc, minlength=self.n_docs).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.count)])


def span_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray, values: np.ndarray = BYTE_VALUE) -> np.ndarray:
    """64-bit hash of each span of bytes, the same wherever the span stands."""
    up, down = powers(len(buf) + 1)
    pre = np.empty(len(buf) + 1, dtype=U)
    pre[0] = 0
    np.cumsum(values[buf] * up[:len(buf)], out=pre[1:])
    h = (pre[end] - pre[start]) * down[start]
    return mix(h ^ ((end - start).astype(U) << U(40)))


def shingle_hash(words: Words, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, doc) of every k-word shingle; a text with 1..k-1 words has one, its whole sequence."""
    n = len(h)
    if n >= k:
        s = h[:n - k + 1].copy()
        for i in range(1, k):
            s = mix(s * U(BASE) + h[i:n - k + 1 + i])
        inside = words.doc[:n - k + 1] == words.doc[k - 1:]
        s, d = s[inside], words.doc[:n - k + 1][inside]
    else:
        s, d = np.zeros(0, U), np.zeros(0, np.int64)
    short = np.flatnonzero((words.count > 0) & (words.count < k))
    if len(short):
        extra = np.array([_fold(h[words.first[i]:words.first[i + 1]]) for i in short], dtype=U)
        s, d = np.concatenate([s, extra]), np.concatenate([d, short])
    return s, d


def _fold(h: np.ndarray) -> int:
    x = int(mix(np.array([len(h)], dtype=U))[0])
    for v in h:
        x = int(mix(np.array([(x * BASE + int(v)) & MASK], dtype=U))[0])
    return x


def distinct_per_doc(value: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (doc, value) pairs, sorted by doc, then value."""
    order = np.lexsort((value, doc))
    v, d = value[order], doc[order]
    keep = np.ones(len(v), dtype=bool)
    keep[1:] = (v[1:] != v[:-1]) | (d[1:] != d[:-1])
    return v[keep], d[keep]


def sums(x: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sum of x within [offs[i], offs[i+1])."""
    c = np.concatenate([[0], np.cumsum(x, dtype=np.int64)])
    return c[offs[1:]] - c[offs[:-1]]
