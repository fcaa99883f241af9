"""Suffix-array deduplication: interval trees over bucketed enhanced suffix arrays.

Finds the byte strings of at least ``length`` bytes that start at two or more
places of a corpus, and removes every byte that one of them covers.

Buckets.  A window is ``length`` bytes; its anchor is the gram of GRAM bytes
with the least hash in it, leftmost among equals.  Equal windows have equal
anchors at the same place, so windows can only be equal within the bucket of
their anchor's hash.  The windows of one anchor follow each other; the bytes
they span are a context.  Anchors whose hash is found once are done with after
a count of hashes; only the other contexts are shuffled, each distinct one once
per task, with a weight.

Interval tree.  A task lays the contexts of whole buckets end to end and builds
their suffix array by prefix doubling (ranks of 8, 16, ... 128 bytes), with the
longest common prefixes of neighbours.  A scan with a stack gives the tree of
common-prefix intervals; an interval is a maximal repeat when the bytes before
its suffixes differ (or a suffix opens its context: what stands before it
belongs to another bucket), and all its suffixes are its occurrences, not just
neighbours.  Runs of suffixes whose left bytes all agree hold no maximal repeat
and are skipped at once.  The union of the maximal repeats' occurrences is the
union of all repeated windows.

Hot buckets.  A bucket found in more than HOT texts, or more than HOT times in
a text (or a piece of a long one), is not gathered: its contexts are cut into pieces of 8 windows, keyed by the bytes all 8 share, and
buckets still as large into single windows, whose buckets hold one distinct
string each.  Nothing is capped; every level is exact.

Equal texts count once (hash of the text); a text found twice with ``length``
bytes or more is covered as a whole.  Hashes are 64-bit.

Defined cases: a null text is empty; texts under ``length`` bytes keep
everything; a repeated row or null doc_id is a document like any other; an
empty table gives an empty result; extra columns are ignored; a text longer
than PIECE is scanned in overlapping pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lensmap.llm.textscan import U, mix, slices, span_hash, to_bytes
from lensmap.session import materialize

GRAM = 48
PIECE = 2 << 20
WIDTHS = (1 << 30, 8, 1)   # windows per key at each level
HOT = 3000                 # texts with a key, or its places in one text, that one task gathers
BATCH = 3 << 20            # bytes of contexts under one suffix array
KEYS = "key long, t long, piece long, n int"


# ---- windows, anchors, runs ------------------------------------------------------------------

def window_runs(buf: np.ndarray, offs: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """Runs of windows with one anchor: doc, lo, hi (first and last window start), p and h (anchor)."""
    w = length - GRAM + 1
    n = len(buf) - length + 1
    empty = {k: np.zeros(0, np.int64) for k in ("doc", "lo", "hi", "p")} | {"h": np.zeros(0, U)}
    if n <= 0:
        return empty
    at = np.arange(len(buf) - GRAM + 1)
    h = span_hash(buf, at, at + GRAM)
    low = U((1 << 24) - 1)
    key = (h & ~low) | at.astype(U)
    pad = -len(key) % w
    grid = np.concatenate([key, np.full(pad, ~U(0))]).reshape(-1, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    p = (np.minimum(behind[:n], ahead[w - 1:w - 1 + n]) & low).astype(np.int64)
    s = np.arange(n)
    doc = np.searchsorted(offs, s, side="right") - 1
    ok = s + length <= offs[doc + 1]
    s, p, doc = s[ok], p[ok], doc[ok]
    if not len(s):
        return empty
    new = np.concatenate([[True], (p[1:] != p[:-1]) | (doc[1:] != doc[:-1])])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(s)]]) - 1
    return {"doc": doc[first], "lo": s[first], "hi": s[last], "p": p[first], "h": h[p[first]]}


def _split(buf: np.ndarray, r: dict, width: int, length: int) -> dict:
    """Runs cut on the grid of ``width`` windows by their distance to the anchor; h becomes the piece's key."""
    q_lo, q_hi = (r["p"] - r["hi"]) // width, (r["p"] - r["lo"]) // width
    n = q_hi - q_lo + 1
    i = np.repeat(np.arange(len(n)), n)
    q = q_lo[i] + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
    p = r["p"][i]
    lo = np.maximum(r["lo"][i], p - q * width - width + 1)
    hi = np.minimum(r["hi"][i], p - q * width)
    core = p - q * width  # the bytes every window of the piece has
    h = span_hash(buf, core, core + length - width + 1)
    return {"doc": r["doc"][i], "lo": lo, "hi": hi, "p": p, "h": mix(h ^ mix(r["h"][i] + q.astype(U)))}


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, int, int | None]]:
    """(rows, bytes, offsets, base, windows): a longer text comes in overlapping pieces of ``windows`` starts."""
    for b in slices(batches, max_bytes=PIECE):
        buf, offs = to_bytes(b.column("text"))
        if len(buf) <= 2 * PIECE:
            yield b, buf, offs, 0, None
        else:
            for o in range(0, len(buf), PIECE):
                part = buf[o:o + PIECE + 4096]
                yield b, part, np.array([0, len(part)]), o, PIECE


def _runs(buf, offs, limit, length):
    r = window_runs(buf, offs, length)
    if limit is not None:  # windows from ``limit`` on belong to the next piece
        keep = r["lo"] < limit
        r = {k: v[keep] for k, v in r.items()}
        r["hi"] = np.minimum(r["hi"], limit - 1)
    return r


def _member(doc: np.ndarray, h: np.ndarray, lists: pa.ListArray) -> np.ndarray:
    """Whether h[i] is in the list of row doc[i]."""
    size = np.diff(lists.offsets.to_numpy())
    owner = np.repeat(np.arange(len(size)), size)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(U)
    salt = lambda d: mix(d.astype(U) + U(1))
    return np.isin(mix(h ^ salt(doc)), mix(flat ^ salt(owner)))


def _lists(b: pa.RecordBatch, name: str) -> pa.ListArray:
    col = b.column(name)
    return pa.ListArray.from_arrays(pa.array(col.offsets.to_numpy() - col.offsets[0].as_py(), pa.int32()), col.flatten())


def _level_runs(b, buf, offs, limit, length, level, parents):
    r = _runs(buf, offs, limit, length)
    for k in range(1, level + 1):
        if k == level and parents is not None:
            keep = _member(r["doc"], r["h"], _lists(b, parents))
            r = {x: v[keep] for x, v in r.items()}
        r = _split(buf, r, WIDTHS[k], length)
    return r


def _keys(length: int, level: int):
    """key, t, piece (its start in a long text) and n, the runs with the key in that piece."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, buf, offs, base, limit in _pieces(batches):
            r = _level_runs(b, buf, offs, limit, length, level, "hot" if level else None)
            if not len(r["h"]):
                continue
            order = np.lexsort((r["h"], r["doc"]))
            h, d = r["h"][order], r["doc"][order]
            first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])]))
            n = np.diff(np.concatenate([first, [len(h)]]))
            t = b.column("t").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[first].view(np.int64)), pa.array(t[d[first]]), pa.array(np.full(len(first), base, np.int64)),
                 pa.array(n.astype(np.int32))],
                names=["key", "t", "piece", "n"])
    return run


def _occurrences(length: int, level: int):
    """key, cid (hash of the context), t, at (its first window's start in the text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, buf, offs, base, limit in _pieces(batches):
            r = _level_runs(b, buf, offs, limit, length, level, "parents")
            keep = _member(r["doc"], r["h"], _lists(b, "want"))
            r = {x: v[keep] for x, v in r.items()}
            cid = mix(span_hash(buf, r["lo"], r["hi"] + length) ^ (r["p"] - r["lo"]).astype(U))
            t = b.column("t").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [pa.array(r["h"].view(np.int64)), pa.array(cid.view(np.int64)), pa.array(t[r["doc"]]),
                 pa.array(r["lo"] - offs[r["doc"]] + base)], names=["key", "cid", "t", "at"])
    return run


def _contexts(length: int, level: int):
    """key, cid, weight and, on the first meeting in this task, the context's bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], int] = {}
        for b, buf, offs, _, limit in _pieces(batches):
            r = _level_runs(b, buf, offs, limit, length, level, "parents")
            keep = _member(r["doc"], r["h"], _lists(b, "want"))
            r = {x: v[keep] for x, v in r.items()}
            cid = mix(span_hash(buf, r["lo"], r["hi"] + length) ^ (r["p"] - r["lo"]).astype(U)).view(np.int64)
            raw, key, ids, ctx = buf.tobytes(), [], [], []
            for k, c, lo, hi in zip(r["h"].view(np.int64).tolist(), cid.tolist(), r["lo"].tolist(), r["hi"].tolist()):
                if (k, c) in seen:
                    seen[k, c] += 1
                else:
                    seen[k, c] = 1
                    key.append(k)
                    ids.append(c)
                    ctx.append(raw[lo:hi + length])
            if key:
                yield _weights(key, ids, [0] * len(key), ctx)
        items = list(seen.items())
        for i in range(0, len(items), 100_000):
            part = items[i:i + 100_000]
            yield _weights([k for (k, _), _ in part], [c for (_, c), _ in part], [n for _, n in part], [None] * len(part))

    def _weights(key, ids, n, ctx):
        return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(ids, pa.int64()),
                                           pa.array(n, pa.int32()), pa.array(ctx, pa.binary())],
                                          names=["key", "cid", "n", "ctx"])
    return run


# ---- the enhanced suffix array ---------------------------------------------------------------

def _dense(key: np.ndarray) -> np.ndarray:
    order = np.argsort(key)
    k = key[order]
    rank = np.empty(len(key), dtype=np.int64)
    rank[order] = np.cumsum(np.concatenate([[0], k[1:] != k[:-1]]))
    return rank


class SuffixArray:
    """Suffixes of ``buf`` that begin at ``starts`` and stop at ``ends``, in order.

    sa: the starts in order; lcp[i]: common prefix of sa[i-1] and sa[i] (0 for i = 0)."""

    def __init__(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        m, depth = len(buf), int((ends - starts).max())
        blocks = -(-depth // 128)
        pad = 128 * (blocks + 1)
        b = np.concatenate([buf, np.zeros(pad + 8, np.uint8)])
        word = np.zeros(m + pad, dtype=U)
        for k in range(8):
            word |= b[k:k + m + pad].astype(U) << U(56 - 8 * k)
        names = {8: _dense(word)}
        for size in (8, 16, 32, 64):
            r = names[size]
            nxt = np.concatenate([r[size:], np.zeros(size, np.int64)])
            names[2 * size] = _dense((r.astype(U) << U(32)) | nxt.astype(U))
        top = names[128]
        self.order = np.lexsort([top[starts + 128 * k] for k in range(blocks - 1, -1, -1)])
        self.sa, end = starts[self.order], ends[self.order]
        x, y = self.sa[:-1], self.sa[1:]
        common, most = np.zeros(len(x), dtype=np.int64), np.minimum(end[:-1] - x, end[1:] - y)
        for size in [128] * blocks + [64, 32, 16, 8]:
            same = (common < most) & (names[size][np.minimum(x + common, m)] == names[size][np.minimum(y + common, m)])
            common[same] += size
        live = np.ones(len(x), dtype=bool)
        for _ in range(7):
            live &= (common < most) & (b[np.minimum(x + common, m)] == b[np.minimum(y + common, m)])
            common[live] += 1
        self.lcp = np.concatenate([[0], np.minimum(common, most)])


def maximal_intervals(lcp: np.ndarray, diverse: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(length, first, last) of the common-prefix intervals of at least ``least`` that are left-diverse.

    ``lcp[0]`` is taken as 0; ``diverse[i]`` counts, up to suffix i, the neighbours
    whose left bytes differ, so an interval is diverse when the count grows in it."""
    stack: list[tuple[int, int]] = []  # (length, first)
    n = len(lcp)
    for i in range(1, n + 1):
        here, first = (int(lcp[i]) if i < n else 0), i - 1
        while stack and stack[-1][0] > here:
            size, first = stack.pop()
            if size >= least and diverse[i - 1] > diverse[first]:
                yield size, first, i - 1
        if here > 0 and (not stack or stack[-1][0] < here):
            stack.append((here, first))


def repeat_intervals(ctx: list[bytes], weight: list[int], length: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """Maximal repeats among contexts: (length, [(context, offset), ...] of all occurrences).

    A context of weight 2 or more is a repeat of its own."""
    for i, n in enumerate(weight):
        if n > 1:
            yield len(ctx[i]), [(i, 0)]
    if len(ctx) < 2:
        return
    size = np.array([len(c) for c in ctx])
    offs = np.concatenate([[0], np.cumsum(size)])
    buf = np.frombuffer(b"".join(ctx), dtype=np.uint8)
    n = size - length + 1
    owner = np.repeat(np.arange(len(ctx)), n)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    a = SuffixArray(buf, offs[owner] + inside, offs[owner + 1])
    owner, inside = owner[a.order], inside[a.order]
    left = np.where(inside > 0, buf[np.maximum(a.sa - 1, 0)].astype(np.int64), -1 - np.arange(len(owner)))
    group = np.cumsum(a.lcp < length) - 1  # suffixes that share ``length`` bytes
    differs = np.concatenate([[0], (left[1:] != left[:-1]) & (a.lcp[1:] >= length)]).astype(np.int64)
    first = np.flatnonzero(a.lcp < length)
    last = np.concatenate([first[1:], [len(group)]])
    count = np.cumsum(differs)
    for lo, hi in zip(first, last):
        if hi - lo > 1 and count[hi - 1] > count[lo]:
            lcp = a.lcp[lo:hi].copy()
            lcp[0] = 0
            for size_, x, y in maximal_intervals(lcp, count[lo:hi], length):
                yield size_, list(zip(owner[lo + x:lo + y + 1].tolist(), inside[lo + x:lo + y + 1].tolist()))


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, int, int, bytes]]]:
    """Whole buckets of rows sorted by (key, cid), some MB at a time: (key, cid, weight, context)."""
    rows, size, last = [], 0, None
    for b in batches:
        for k, c, n, x in zip(*(b.column(i).to_pylist() for i in range(4))):
            if rows and rows[-1][:2] == [k, c]:
                rows[-1][2] += n
                rows[-1][3] = rows[-1][3] if x is None else x
                continue
            if k != last and size > BATCH:
                yield rows
                rows, size = [], 0
            rows.append([k, c, n, x])
            size += 280
            last = k
    if rows:
        yield rows


def _grouped(rows):
    """Buckets of one context apart (nothing to compare), the rest together."""
    key = np.array([r[0] for r in rows])
    alone = np.ones(len(rows), dtype=bool)
    same = key[1:] == key[:-1]
    alone[1:] &= ~same
    alone[:-1] &= ~same
    return [r for r, x in zip(rows, alone) if x], [r for r, x in zip(rows, alone) if not x]


def _covers(length: int):
    """key, cid and the parts of the context that maximal repeats cover."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _buckets(batches):
            one, many = _grouped(rows)
            cover: dict[tuple[int, int], list] = {}
            for k, c, n, x in one:
                if n > 1:
                    cover[k, c] = [[0, len(x)]]
            spans: dict[int, dict[int, int]] = {}
            for size, places in repeat_intervals([r[3] for r in many], [r[2] for r in many], length):
                for i, off in places:
                    s = spans.setdefault(i, {})
                    s[off] = max(s.get(off, 0), size)
            for i, s in spans.items():
                out = []
                for off in sorted(s):
                    if out and off <= out[-1][0] + out[-1][1]:
                        out[-1][1] = max(out[-1][1], off + s[off] - out[-1][0])
                    else:
                        out.append([off, s[off]])
                cover[many[i][0], many[i][1]] = out
            if cover:
                lists = [[{"off": o, "len": n} for o, n in v] for v in cover.values()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k for k, _ in cover], pa.int64()), pa.array([c for _, c in cover], pa.int64()),
                     pa.array(lists, pa.list_(pa.struct([("off", pa.int32()), ("len", pa.int32())])))],
                    names=["key", "cid", "parts"])
    return run


def _groups(length: int):
    """group (a name), size, key, cid, off: every occurrence of every maximal repeat, by context."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _buckets(batches):
            one, many = _grouped(rows)
            found = [(len(r[3]), [(r, 0)], r[3]) for r in one if r[2] > 1]
            for size, places in repeat_intervals([r[3] for r in many], [r[2] for r in many], length):
                i, off = places[0]
                found.append((size, [(many[j], o) for j, o in places], many[i][3][off:off + size]))
            out = [(hashlib.md5(text[:size]).hexdigest(), size, r[0], r[1], off) for size, places, text in found for r, off in places]
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int32()))],
                    names=["repeat", "size", "key", "cid", "off"])
    return run


# ---- the Spark plan --------------------------------------------------------------------------

def _levels(texts: DataFrame, length: int) -> Iterator[tuple[DataFrame, int]]:
    """(candidates, level): texts with the keys (``want``) whose contexts are compared at that level."""
    cand, keys = None, materialize(texts.mapInArrow(_keys(length, 0), KEYS), "repeat-keys")
    for level in range(len(WIDTHS)):
        many = F.lit(False) if level == len(WIDTHS) - 1 else F.col("places") > HOT
        # equal texts repeat their rows, so n is not summed; two pieces of one text are two places
        again = (keys.groupBy("key").agg(F.min("t").alias("a"), F.max("t").alias("z"), F.max("n").alias("n"),
                                         F.min("piece").alias("p"), F.max("piece").alias("q"),
                                         F.greatest(F.count("*"), F.max("n")).alias("places"))
                 .filter("a <> z or n > 1 or p <> q").select("key", many.alias("many")))
        again = materialize(again, "repeat-again")  # so that the join's sides are plain, and a frequent key can be split
        mine = (keys.join(again, "key").groupBy("t").agg(
            F.collect_set(F.when(~F.col("many"), F.col("key"))).alias("want"),
            F.collect_set(F.when(F.col("many"), F.col("key"))).alias("hot_next")))
        if level == 0:
            one = texts.groupBy("t").agg(F.first("text").alias("text"))
            src = one.join(mine, "t").select("t", "text", "want", "hot_next", F.array().cast("array<long>").alias("parents"))
        else:
            src = cand.join(mine, "t").select("t", "text", "want", "hot_next", F.col("hot").alias("parents"))
        src = materialize(src, f"repeat-texts-{level}")
        yield src.select("t", "text", "want", "parents"), level
        cand = src.filter(F.size("hot_next") > 0).select("t", "text", F.col("hot_next").alias("hot"))
        if level == len(WIDTHS) - 1 or cand.isEmpty():
            return
        keys = materialize(cand.mapInArrow(_keys(length, level + 1), KEYS).distinct(), "repeat-keys")


def _texts(docs: DataFrame, length: int) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    return docs.select(F.xxhash64(t).alias("t"), t.alias("text")).filter(F.octet_length("text") >= length)


def repeat_groups(docs: DataFrame, length: int = 200) -> DataFrame:
    """Maximal repeats with all their occurrences: repeat (md5 of the string), size, t (xxhash64 of the text), at.

    A string longer than a context (its anchor's windows) comes as the overlapping
    strings of its contexts."""
    out = None
    for cand, level in _levels(_texts(docs, length), length):
        occ = cand.mapInArrow(_occurrences(length, level), "key long, cid long, t long, at long")
        groups = (cand.mapInArrow(_contexts(length, level), "key long, cid long, n int, ctx binary")
                  .repartition("key").sortWithinPartitions("key", "cid")
                  .mapInArrow(_groups(length), "repeat string, size int, key long, cid long, off int"))
        rows = occ.join(groups, ["key", "cid"]).select("repeat", "size", "t", (F.col("at") + F.col("off")).alias("at"))
        out = rows if out is None else out.unionByName(rows)
    return out.distinct()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for t, text, spans in zip(*(b.column(c) for c in ("t", "text", "spans"))):
            raw = text.as_py().encode()
            v = spans.values
            lo, n = v.field("lo").to_numpy(), v.field("len").to_numpy()
            order = np.argsort(lo, kind="stable")
            lo, hi = lo[order], (lo + n)[order]
            reach = np.maximum.accumulate(hi)
            first = np.flatnonzero(np.concatenate([[True], lo[1:] > reach[:-1]]))
            begin, end = lo[first], reach[np.concatenate([first[1:], [len(lo)]]) - 1]
            kept, at = [], 0
            for x, y in zip(begin.tolist(), end.tolist()):
                kept.append(raw[at:x])
                at = y
            kept.append(raw[at:])
            out.append((t.as_py(), int((end - begin).sum()), len(begin), hashlib.sha256(b"".join(kept)).hexdigest()))
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string()))],
                names=["t", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of ``docs``."""
    parts, first = [], None
    for cand, level in _levels(_texts(docs, length), length):
        first = cand if first is None else first
        occ = cand.mapInArrow(_occurrences(length, level), "key long, cid long, t long, at long")
        covers = (cand.mapInArrow(_contexts(length, level), "key long, cid long, n int, ctx binary")
                  .repartition("key").sortWithinPartitions("key", "cid")
                  .mapInArrow(_covers(length), "key long, cid long, parts array<struct<off:int,len:int>>"))
        parts.append(occ.join(covers, ["key", "cid"]).select("t", "at", F.explode("parts").alias("p"))
                     .select("t", (F.col("at") + F.col("p.off")).alias("lo"), F.col("p.len").cast("long").alias("len")))
    spans = parts[0]
    for p in parts[1:]:
        spans = spans.unionByName(p)
    spans = spans.groupBy("t").agg(F.collect_list(F.struct("lo", "len")).alias("spans"))
    done = first.select("t", "text").join(spans, "t").mapInArrow(_cut, "t long, n_removed long, n_spans long, kept_sha256 string")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text).alias("t"), F.octet_length(text).cast("long").alias("n_bytes"),
                       F.sha2(text, 256).alias("sha"))
    copies = (rows.filter(F.col("n_bytes") >= length).groupBy("t").agg(F.count("*").alias("n")).filter("n > 1").select("t"))
    by_t = (done.join(copies.withColumn("copied", F.lit(True)), "t", "full"))
    whole = F.coalesce("copied", F.lit(False))
    return (rows.join(by_t, "t", "left").select(
        "doc_id", "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256")))


def op4(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
