"""Byte-level BPE over batches of texts, each distinct piece encoded once.

A byte-level BPE tokenizer splits a text into pieces by a fixed pattern and
never merges across them, so a text's ids are its pieces' ids in a row.  For
texts of plain characters (the table below) the pieces are found with numpy,
hashed, and only pieces not seen lately go through the tokenizers library; any
other text is given to the library whole.  The ids are the same either way.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pandas as pd

from lensmap.llm.textscan import U, mix, span_hash

LETTER, DIGIT, OTHER, SPACE = 0, 1, 2, 3
_PLAIN = re.compile("[\t\n\r\x20-\x7e¡«»¿À-ɏ‐-‧€]*")
_CLASS = np.full(0x20AD, OTHER, dtype=np.int8)
_CLASS[[9, 10, 13, 32]] = SPACE
_CLASS[48:58] = DIGIT
_CLASS[65:91] = _CLASS[97:123] = LETTER
_CLASS[0xC0:0x250] = LETTER
_CLASS[[0xD7, 0xF7]] = OTHER
_VALUE = mix(np.arange(1, 0x20AE, dtype=U) * U(0x9E3779B97F4A7C15))
CACHE_PIECES = 240_000


def _alphabet() -> dict[int, str]:
    """Printable stand-in of every byte, as byte-level BPE vocabularies have it."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    return {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PieceEncoder:
    """ids of texts by a byte-level BPE tokenizer file (the GPT-2 split pattern)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.map = str.maketrans({chr(b): c for b, c in _alphabet().items()})
        self.cache: dict[int, tuple[int, ...]] = {}
        self.old: dict[int, tuple[int, ...]] = {}

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def piece(self, s: str) -> tuple[int, ...]:
        return tuple(t.id for t in self.model.tokenize(s.encode().decode("latin-1").translate(self.map)))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        plain = [i for i, t in enumerate(texts)
                 if t and _PLAIN.fullmatch(t) and not any(a in t for a in self.added)]
        out = [np.zeros(0, np.uint32)] * len(texts)
        done = set(plain)
        for i, t in enumerate(texts):
            if i not in done and t:
                out[i] = self.whole(t)
        if plain:
            for i, ids in zip(plain, self._plain([texts[i] for i in plain])):
                out[i] = ids
        return out

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        big = "".join(texts)
        cp = np.frombuffer(big.encode("utf-32-le"), dtype=np.uint32)
        offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        start = np.flatnonzero(_piece_starts(cp, offs))
        end = np.concatenate([start[1:], [len(cp)]])
        code, distinct = pd.factorize(span_hash(cp, start, end, _VALUE))
        where = np.empty(len(distinct), dtype=np.int64)
        where[code[::-1]] = np.arange(len(code))[::-1]
        lo, hi = start[where].tolist(), end[where].tolist()
        if len(self.cache) > CACHE_PIECES // 2:      # what was used since the last turn stays, the rest goes with the next
            self.old, self.cache = self.cache, {}
        ids, cache, old, piece = [], self.cache, self.old, self.piece
        for k, h in enumerate(distinct.tolist()):
            got = cache.get(h)
            if got is None:
                cache[h] = got = old.get(h) or piece(big[lo[k]:hi[k]])
            ids.append(got)
        size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        pool = np.fromiter(chain.from_iterable(ids), dtype=np.uint32, count=int(size.sum()))
        at = np.concatenate([[0], np.cumsum(size)])[:-1]
        n = size[code]
        run = np.concatenate([[0], np.cumsum(n)])
        flat = pool[np.repeat(at[code] - run[:-1], n) + np.arange(run[-1])]
        cut = run[np.searchsorted(start, offs)]
        return [flat[cut[i]:cut[i + 1]] for i in range(len(texts))]


def _piece_starts(cp: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """True where a piece begins: runs of letters, digits or other characters, each
    with one space before it; of white space all but a last character that is
    followed by something; 's 't 're 've 'm 'll 'd on their own."""
    c = _CLASS[cp]
    n = len(c)
    first = np.zeros(n + 1, dtype=bool)
    first[offs] = True
    last = first[1:]
    first = first[:-1]
    white = c == SPACE
    prev = np.concatenate([np.array([-1], np.int8), c[:-1]])
    prev[first] = -1
    after_space = np.concatenate([[False], cp[:-1] == 32]) & ~first
    before_solid = np.concatenate([~white[1:], [False]]) & ~last
    start = first | (~white & (c != prev) & ~after_space) | (white & ((prev != SPACE) | before_solid))
    for p in np.flatnonzero(start & (cp == 39)).tolist():
        stop = int(offs[np.searchsorted(offs, p, side="right")])
        nxt = "".join(map(chr, cp[p + 1:min(p + 3, stop)]))
        k = 3 if nxt in ("re", "ve", "ll") else 2 if nxt[:1] in ("s", "t", "m", "d") and nxt else 0
        if k:
            start[p + 1] = False
            if p + k < stop and c[p + k] == LETTER:
                start[p + k] = True
    return start
