"""Small tables with every odd case, and brute-force versions of the operators."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "t long, h string, d string, key int, n int, size int, cid long, row int, words int, hash string, pos int")
LOW = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def sentence(rng: random.Random, n: int) -> str:
    out = []
    for i in range(n):
        w = "".join(rng.choice(["the", "on", "er", "an", "re", "ti", "é", "ß", "in", "at"]) for _ in range(rng.randint(1, 4)))
        out.append(w.capitalize() if i == 0 else w)
    return " ".join(out) + "."


def documents(seed: int = 3, n: int = 60) -> list[tuple]:
    """Rows with copies, near copies, shared passages, junk, nulls, empty and long texts, repeated rows."""
    rng = random.Random(seed)
    passage = sentence(rng, 70)
    texts = ["\n".join(sentence(rng, rng.randint(5, 40)) for _ in range(rng.randint(1, 8))) for _ in range(n)]
    for i in range(0, n, 6):
        texts[i] = texts[i] + "\n" + passage + "\n" + sentence(rng, 9)
    for i in range(1, n, 9):
        w = texts[i - 1].split(" ")
        w[len(w) // 2] = "changed"
        texts[i] = " ".join(w)
    texts[4], texts[14] = texts[5], texts[5]
    texts[7] = "Junk junk " * 200
    texts[8] = "same line here\n" * 30
    texts[9] = "WORD!! " * 60
    texts[10] = "a b"
    texts[11] = " \t\n\x0b\x0c\r "
    texts[12] = "word*** other### " * 40
    texts[13] = texts[2] * 40  # long, with repeats inside
    texts += [None, "", "   ", "nul\x00 and \x1c control\x85 and nbsp x", "日本語 テキスト 漢字 " * 40, passage]
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, texts[5], None, None, None), (None, None, None, None, None), (-7, texts[20], "de", "s1", 5)]
    extra = (1, "h", "d", 2, 3, 4, 5, 6, 7, "x", 8)
    return [r + extra for r in rows]


def words(text) -> list[bytes]:
    return (text or "").encode().split()


def crc(i) -> int | None:
    return None if i is None else zlib.crc32(str(i).encode())


def repeats(texts: list, length: int = 200) -> list[tuple]:
    """(n_bytes, n_removed, n_spans, kept_sha256) of every text."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i:i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        hit = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                hit[i:i + length] = b"\1" * length
        spans = sum(1 for i, x in enumerate(hit) if x and not (i and hit[i - 1]))
        kept = bytes(c for c, x in zip(b, hit) if not x)
        out.append((len(b), sum(hit), spans, hashlib.sha256(kept).hexdigest()))
    return out


def shingles(text, k: int) -> frozenset:
    w = (text or "").encode().translate(LOW).split()
    return frozenset(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def jaccard_groups(texts: list, k: int, num: int, den: int = 100) -> list[int]:
    """Index of the first text of each text's component."""
    sets = [shingles(t, k) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    at = defaultdict(list)
    for i, s in enumerate(sets):
        for j, c in Counter(j for g in s for j in at[g]).items():
            if den * c >= num * (len(s) + len(sets[j]) - c):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        for g in s:
            at[g].append(i)
    return [find(i) for i in range(len(texts))]
