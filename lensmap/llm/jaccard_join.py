"""N-gram Jaccard join by prefix filters over partition signatures.

Texts are sets of ``k``-word shingles (64-bit hashes); two link when their
Jaccard similarity is at least ``num / den``.  Equal sets are one class.

Keys.  Two linked sets of known sizes differ in at most D shingles, so of P
parts of the hash space at least P - D have the same content in both.  Those
contents are put in a global order (rich in uncommon shingles first, empty ones
last), and a set's first D + 1 of them are its keys: linked sets share one
(prefix filter).  A key stands for several shingles, so texts that share a few
stock phrases do not meet.  P and the hash seed belong to a size class, and a
set has keys for its own class and, if it may link with a smaller set of the
class below, for that one.  A set with content in D parts or fewer (only such
sets can have nothing but empty parts in common) has the shingles of its plain
prefix as keys, too.  Shingles that many texts have ("common") are those that a
first pass counts most often near the front of the hash order (at most COMMON,
broadcast).  Which they are decides how many candidates there are, never which
links are found.

Candidates without all pairs.  What counts is the component.  First every class
is compared with one hub (the most central class of a key, the one whose keys
others share most - of the hubs the one it shares most keys with); links found
join into components.  Then only keys that still hold more than one component
are looked at.  Long texts share hundreds of keys with the same few others, so
the classes of all keys with one hub are a group (where that takes no more rows
than the keys one by one; else each key is one): a class and its sketch stand
there once, not once a key.  The classes of a group meet in blocks of at most
BLOCK (two blocks at a time, so memory is bounded however large the group) with
sketches: the parities of the shingles hashed to four bits a shingle and more,
whose distance is at most that of the sets.  Pairs of different components whose
sketches are near enough are verified on the whole sets - for ROUNDS rounds only
TRIES of a class in a block, as links found spare the others, then all.  No
level drops a pair that may link.

Every key's share of the rows is small (a class has one row a key, and a task
gives a class's keys once however often the class is repeated); components are found by alternating large-star and small-star
rounds over the links, written each round.

Words are maximal runs of other than space and 0x09-0x0D, A-Z lowered.  Texts
with 1 to k - 1 words have one shingle, the whole sequence.

Defined cases: null and wordless texts have the empty set and link with
nothing; repeated rows have equal sets; a null doc_id is never the smallest
(a component of nulls has a null id); empty tables give empty results; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lensmap.llm.textscan import LOWER, U, Words, distinct_per_doc, fresh_worker, mix, shingle_hash, slices, span_hash, to_bytes
from lensmap.operators.partitioning import broadcast_if_small
from lensmap.session import materialize

SMALL = 8          # keys of so many classes or fewer give all their pairs at once
BLOCK = 256        # classes of a group that meet at a time
BLOCK_SHINGLES = 1 << 22  # and the shingles they have together on average: a byte of sketch each at most
COMMON = 1 << 20   # shingles that count as common: 8 MB at most
ROUNDS = 4         # of trying other components before all their pairs are listed
TRIES = 16         # classes tried by a class in such a round
OFTEN = 16         # and found in more texts than this
SCAN_BYTES = 1 << 19  # of text hashed at once; its arrays take some forty times that
PART_SEED, SKETCH_SEED = 0xA5A5A5A5, 0x51ED270B0B5D1A77


def shingle_sets(col: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, one text after the other; and their offsets."""
    buf, offs = to_bytes(col)
    buf = LOWER[buf]
    w = Words(buf, offs)
    h, doc = shingle_hash(w, span_hash(buf, w.start, w.end), k)
    h, doc = distinct_per_doc(h, doc)
    return h, np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(offs) - 1))])


def prefix_len(n, num: int, den: int):
    return n - (n * num + den - 1) // den + 1


def front_len(n, num: int, den: int):
    """The prefix and a third of it more."""
    p = prefix_len(n, num, den)
    return np.minimum(n, p + (p + 2) // 3)


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices of all [first[i], first[i] + size[i])."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _class_ids(h: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, U), np.cumsum(mix(h + U(1)), dtype=U)])
    n = np.diff(offs).astype(U)
    return mix((total[offs[1:]] - total[offs[:-1]]) ^ (n << U(44)))


def _scan(k: int, num: int, den: int):
    """A row per text (kind 0); at the end of a task the shingles it met more than once near
    the front of the hash order, with their counts (kind 1, in ``keys`` and ``counts``)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        seen: set[int] = set()  # a class counts once in a task
        front: list[np.ndarray] = []
        for b in slices(batches, max_bytes=SCAN_BYTES):
            h, offs = shingle_sets(b.column("text"), k)
            n = np.diff(offs)
            ids = _class_ids(h, offs).view(np.int64)
            new = np.array([c not in seen and not seen.add(c) for c in ids.tolist()], dtype=bool)
            p = np.where((n > 0) & new, np.minimum(n, front_len(n, num, den) * 4 // 3 + 4), 0)
            front.append(h[_ranges(offs[:-1], p)])
            rows = len(n)
            none = pa.ListArray.from_arrays(pa.array(np.zeros(rows + 1), pa.int32()), pa.array([], pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(rows), pa.int32()), b.column("doc_id"), b.column("t"), pa.array(n),
                 pa.array(ids, mask=n == 0), none, none], names=["kind", "doc_id", "t", "n", "cid", "keys", "counts"])
        key, count = np.unique(np.concatenate(front) if front else np.zeros(0, U), return_counts=True)
        key, count = key[count > 1].view(np.int64), count[count > 1]
        for i in range(0, len(key), 50_000):
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([1], pa.int32()), *(pa.array([None], pa.int64()) for _ in range(4)),
                 one(key[i:i + 50_000]), one(count[i:i + 50_000])],
                names=["kind", "doc_id", "t", "n", "cid", "keys", "counts"])
    return run


def size_classes(n: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Class of each size and the first size of every class; linked sizes are in the same or neighbouring classes."""
    firsts, most = [1], (int(n.max()) if len(n) else 1) * den // num * 2 + 4
    while len(firsts) < 3 or firsts[-3] <= most:
        firsts.append(max(firsts[-1] * den // num, firsts[-1] * 5 // 4) + 1)
    f = np.array(firsts)
    return np.searchsorted(f, n, side="right") - 1, f


def _differ(a, b, num: int, den: int):
    """Most shingles by which linked sets of these sizes differ."""
    return (a + b) * (den - num) // (den + num)


def _roles(n: np.ndarray, num: int, den: int) -> tuple[np.ndarray, ...]:
    """doc, class, parts and ``most``, one for each size and each class it has keys for.

    ``most``: the shingles by which a set of this size differs at most from one
    it links with by the keys of that class (those of its own class and the next;
    a set of the next class has them for sets of this class)."""
    own, f = size_classes(n, num, den)
    top, above = f[own + 1] - 1, f[np.minimum(own + 2, len(f) - 1)] - 1
    down = np.flatnonzero((own > 0) & (n * num <= (f[own] - 1) * den))
    up = np.flatnonzero(n > 0)
    doc = np.concatenate([up, down])
    g = np.concatenate([own[up], own[down] - 1])
    mine = np.concatenate([_differ(n[up], np.minimum(n[up] * den // num, above[up]), num, den),
                           _differ(n[down], f[own[down]] - 1, num, den)])
    low = f[g + 1] - 1  # the largest of class g, and what it may link with in the next
    parts = _differ(low, np.minimum(low * den // num, f[g + 2] - 1), num, den) + 1
    return doc, g, parts + 2 + parts // 8, mine  # some parts more than needed, so that the poorest are not used


def _keys(h: np.ndarray, offs: np.ndarray, common: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """doc and key of every key of the sets."""
    n = np.diff(offs)
    doc, g, parts, most = _roles(n, num, den)
    size = n[doc]
    at = _ranges(offs[:-1][doc], size)
    base = np.concatenate([[0], np.cumsum(parts)])
    place = np.repeat(base[:-1], size) + (mix(h[at] ^ U(PART_SEED)) % np.repeat(parts, size).astype(U)).astype(np.int64)
    value = mix(h[at] + U(7))
    count = np.bincount(place, minlength=base[-1])
    rare = np.bincount(place[~common[at]], minlength=base[-1])
    half = lambda x: np.bincount(place, weights=x.astype(np.float64), minlength=base[-1]).astype(U)  # noqa: E731  exact: under 2**53
    total = half(value & U(0xFFFFFFFF)) + (half(value >> U(32)) << U(32))
    owner = np.repeat(np.arange(len(doc)), parts)
    part = (np.arange(base[-1]) - np.repeat(base[:-1], parts)).astype(U)
    sig = mix(total ^ mix(part + (g.astype(U) << U(32))[owner]))
    least = lambda x: U(255) - np.minimum(x, 255).astype(U)
    order = np.argsort((owner.astype(U) << U(32)) | (least(rare) << U(24)) | (least(count) << U(16)) | (sig >> U(48)), kind="stable")
    first = (np.arange(base[-1]) - np.repeat(base[:-1], parts) <= most[owner]) & (count[order] > 0)
    docs, keys = [doc[owner[first]]], [sig[order[first]]]
    poor = np.flatnonzero(np.bincount(owner[count > 0], minlength=len(doc)) <= most)
    if len(poor):  # these may have only empty parts in common with a set they link with
        at = _ranges(offs[:-1][doc[poor]], size[poor])
        v, c, who = h[at], common[at], np.repeat(np.arange(len(poor)), size[poor])
        v = v[np.lexsort((v, c, who))]
        p = prefix_len(size[poor], num, den)
        keys.append(mix(v[_ranges(np.cumsum(size[poor]) - size[poor], p)] ^ mix(np.repeat(g[poor].astype(U) + U(1 << 63), p))))
        docs.append(np.repeat(doc[poor], p))
    return np.concatenate(docs), np.concatenate(keys)


def _prefixes(k: int, num: int, den: int, last: np.ndarray):
    """cid and keys of every set, once a task (``last``: the ascending hashes of common shingles, put last)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        seen: set[int] = set()
        for b in slices(batches, max_bytes=SCAN_BYTES):
            h, offs = shingle_sets(b.column("text"), k)
            ids = _class_ids(h, offs).view(np.int64)
            new = np.array([c not in seen and not seen.add(c) for c in ids.tolist()], dtype=bool)
            n = np.diff(offs)
            h, ids, n = h[np.repeat(new, n)], ids[new], n[new]
            common = np.zeros(len(h), dtype=bool)
            if len(last):
                common = last[np.minimum(np.searchsorted(last, h), len(last) - 1)] == h
            doc, keys = _keys(h, np.concatenate([[0], np.cumsum(n)]), common, num, den)
            # a set's keys together, as they come
            o = np.argsort(doc, kind="stable")
            yield pa.RecordBatch.from_arrays([pa.array(ids[doc[o]]), pa.array(keys[o].view(np.int64))], names=["cid", "key"])
    return run


def _sketches(h: np.ndarray, offs: np.ndarray) -> list[bytes]:
    """Parities of each set's shingles hashed to 64 * 2**x bits, 512 and four bits a shingle at least.

    With fewer bits so many shingles cancel out that sets well under the threshold look near.
    The halves of a sketch, taken together, are the sketch of half the bits."""
    n = np.diff(offs)
    words = np.maximum(8, 1 << np.ceil(np.log2(np.maximum(n, 64) / 16)).astype(np.int64))
    out: list[bytes] = [b""] * len(n)
    for w in np.unique(words).tolist():
        mine, bits = np.flatnonzero(words == w), 64 * w
        at = np.repeat(np.arange(len(mine)) * bits, n[mine]) + (
            mix(h[_ranges(offs[:-1][mine], n[mine])] ^ U(SKETCH_SEED)) % U(bits)).astype(np.int64)
        odd = (np.bincount(at, minlength=len(mine) * bits) & 1).astype(np.uint8)
        for i, row in zip(mine.tolist(), np.packbits(odd.reshape(-1, bits), axis=1)):
            out[i] = row.tobytes()
    return out


def _sets(k: int, num: int, den: int):
    """cid, n, sketch and the whole set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        for b in slices(batches, max_bytes=SCAN_BYTES):
            h, offs = shingle_sets(b.column("text"), k)
            whole = [h[o:e].tobytes() for o, e in zip(offs[:-1].tolist(), offs[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(_class_ids(h, offs).view(np.int64)), pa.array(np.diff(offs)), pa.array(_sketches(h, offs), pa.binary()),
                 pa.array(whole, pa.binary())], names=["cid", "n", "sketch", "whole"])
    return run


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two ascending arrays of distinct values."""
    if len(a) > len(b):
        a, b = b, a
    i = np.searchsorted(b, a)
    return int((b[np.minimum(i, len(b) - 1)] == a).sum()) if len(b) else 0


def _verify(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        for b in batches:
            keep = np.zeros(b.num_rows, dtype=bool)
            wa, wb = b.column("wa"), b.column("wb")
            for i in range(b.num_rows):
                x, y = np.frombuffer(wa[i].as_buffer(), U), np.frombuffer(wb[i].as_buffer(), U)
                both = _common(x, y)
                keep[i] = both * den >= num * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(keep))
    return run


def _fold(sketch: np.ndarray, words: int) -> np.ndarray:
    while len(sketch) > words:
        sketch = sketch[:len(sketch) // 2] ^ sketch[len(sketch) // 2:]
    return sketch


def _near_pairs(side, cid, comp, n, sketch, num: int, den: int, tries: int, turn: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Pairs of a block (row numbers) that may link and are of different components, and whether
    any was left out.  ``side``: pairs of one side are met in another block, if there are two sides.
    ``tries`` (0: all): so many of a row, the nearest at turn 0, others later."""
    m = len(n)
    far, size = np.zeros((m, m), dtype=np.int64), np.array([len(x) for x in sketch])
    for words in np.unique(size).tolist():  # of the shorter sketch of a pair
        at, mine = np.flatnonzero(size >= words), np.flatnonzero(size == words)
        s = np.stack([_fold(sketch[i], words) for i in at])
        short = s[size[at] == words]
        step = max(1, (1 << 20) // (len(at) * words))
        for i in range(0, len(mine), step):
            d = np.bitwise_count(short[i:i + step, None, :] ^ s[None, :, :]).sum(axis=2, dtype=np.int64)
            far[np.ix_(mine[i:i + step], at)] = d
            far[np.ix_(at, mine[i:i + step])] = d.T
    a, b = n[:, None], n[None, :]
    ok = (far <= _differ(a, b, num, den)) & (np.minimum(a, b) * den >= np.maximum(a, b) * num) & (comp[:, None] != comp[None, :])
    if side.any() and not side.all():
        ok &= side[:, None] != side[None, :]
    x, y = np.nonzero(np.triu(ok, 1))
    if not tries or m <= SMALL or len(x) <= tries:
        return x, y, False
    if turn:
        c = cid.view(U)
        far = (mix(c[:, None] ^ c[None, :] ^ U(turn)) >> U(1)).astype(np.int64)
    far[~ok] = np.iinfo(np.int64).max
    best = np.argpartition(far, min(tries, m) - 1, axis=1)[:, :tries]
    chosen = np.zeros((m, m), dtype=bool)
    np.put_along_axis(chosen, best, True, axis=1)
    chosen &= ok
    kept = chosen[x, y] | chosen[y, x]
    return x[kept], y[kept], not kept.all()


def _meet(num: int, den: int, tries: int, turn: int):
    """Candidate pairs (a, b, left: others were left out) of rows that stand block by block (group, i, j)."""
    def pairs(t: pa.RecordBatch, first: np.ndarray) -> pa.RecordBatch:
        side, cid, comp, n = (t.column(c).to_numpy(zero_copy_only=False) for c in ("side", "cid", "comp", "n"))
        sketch = t.column("sketch")
        out_a, out_b, out_left = [], [], []
        for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
            if hi - lo > 1 and (comp[lo:hi] != comp[lo]).any():
                rows = [np.frombuffer(sketch[i].as_buffer(), U) for i in range(lo, hi)]
                x, y, left = _near_pairs(side[lo:hi], cid[lo:hi], comp[lo:hi], n[lo:hi], rows, num, den, tries, turn)
                out_a.append(cid[lo:hi][x])
                out_b.append(cid[lo:hi][y])
                out_left.append(np.full(len(x), left))
        a, b, left = (np.concatenate([*x, np.zeros(0, kind)]) for x, kind in ((out_a, np.int64), (out_b, np.int64), (out_left, bool)))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(left.astype(bool))],
                                          names=["a", "b", "left"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        held = None  # the last block, which the next batch may go on with
        for b in batches:
            t = b if held is None else pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            if t.num_rows == 0:
                continue
            group, i, j = (t.column(c).to_numpy() for c in ("group", "i", "j"))
            new = np.flatnonzero((group[1:] != group[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            if len(new):
                yield pairs(t, np.concatenate([[0], new]))
            held = t.slice(int(new[-1]) if len(new) else 0)
        if held is not None:
            yield pairs(held, np.array([0, held.num_rows]))
    return run


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for every node of the links (a, b): comp is the least node it reaches.

    Alternating large-star and small-star rounds until nothing changes."""
    e = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    mark = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        e = materialize(small, "links")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(
                e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
        mark = now


def stars(links: DataFrame) -> DataFrame:
    """(node, comp) for every node of the links: comp is the least node at most two links away.

    One round, for labels that need not be whole: nodes of one label are connected."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("b"), F.least("a", "m").alias("m"))
    return materialize(both.join(least, "b").groupBy("a").agg(F.min("m").alias("m")).select(
        F.col("a").alias("node"), F.col("m").alias("comp")), "links")


class JaccardJoin:
    """One join: ``rows`` (doc_id, t, n, cid) and, after ``run``, ``links`` (a, b) and ``comps`` (cid, comp).

    ``links`` is a connecting subset of the links between classes: pairs already in one
    component are not compared, so links cannot be counted per document.  ``comps`` is whole."""

    def __init__(self, docs: DataFrame, k: int = 5, num: int = 80, den: int = 100):
        self.k, self.num, self.den = k, num, den
        text = F.coalesce("text", F.lit(""))
        self.src = docs.select(F.xxhash64(text).alias("t"), text.alias("text"))
        scanned = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("t"), text.alias("text"))
        self.scan = materialize(scanned.mapInArrow(
            _scan(k, num, den), "kind int, doc_id long, t long, n long, cid long, keys array<long>, counts array<long>"), "jaccard-scan")
        self.rows = self.scan.filter("kind = 0").select("doc_id", "t", "n", "cid")

    def _common_shingles(self) -> np.ndarray:
        """Ascending hashes of the shingles put last in order 1, COMMON at most."""
        often = (self.scan.filter("kind = 1").select(F.explode(F.arrays_zip("keys", "counts")).alias("x"))
                 .groupBy("x.keys").agg(F.sum("x.counts").alias("c")).filter(F.col("c") > OFTEN))
        often = materialize(often.select(F.col("keys").alias("key"), "c"), "jaccard-often")
        least = OFTEN
        while often.filter(F.col("c") > least).count() > COMMON:
            least *= 2
        got = often.filter(F.col("c") > least).select("key").toArrow().column("key").to_numpy()
        return np.sort(got.astype(np.int64).view(U))

    def _found(self, pairs: DataFrame) -> DataFrame:
        """Links among candidate pairs (a, b)."""
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()
        whole = lambda x: self.sets.select(F.col("cid").alias(x), F.col("whole").alias("w" + x))
        return materialize(pairs.join(whole("a"), "a").join(whole("b"), "b").mapInArrow(
            _verify(self.num, self.den), "a long, b long"), "jaccard-links")

    @staticmethod
    def _label(rows: DataFrame, comps: DataFrame | None) -> DataFrame:
        """rows with ``comp``, the class itself where it has no link."""
        if comps is None:
            return rows.withColumn("comp", F.col("cid"))
        return (rows.join(comps.withColumnRenamed("node", "cid"), "cid", "left")
                .withColumn("comp", F.coalesce("comp", "cid")))

    @staticmethod
    def _hubs(rows: DataFrame) -> DataFrame:
        """(a, b): each class of (key, cid, hub) rows with the hub it shares most keys with."""
        n = rows.filter("cid <> hub").groupBy("cid", "hub").agg(F.count("*").alias("c"))
        return n.groupBy("cid").agg(F.max(F.struct("c", "hub")).alias("m")).select(F.col("cid").alias("a"), F.col("m.hub").alias("b"))

    def run(self) -> "JaccardJoin":
        of = Window.partitionBy("key")
        rows = (self.src.mapInArrow(_prefixes(self.k, self.num, self.den, self._common_shingles()), "cid long, key long")
                .withColumn("a", F.min("cid").over(of)).withColumn("z", F.max("cid").over(of))
                .filter("a <> z").drop("a", "z"))
        rows = materialize(rows.distinct(), "jaccard-keys")
        # share of a class's keys that others have: most of all for the text that copies were made of
        one = self.rows.filter("n > 0").groupBy("cid").agg(F.min("t").alias("t"), F.max("n").alias("n"))
        central = materialize(rows.groupBy("cid").agg(F.count("*").alias("c")).join(one, "cid")
                              .select("cid", "t", (F.col("c") / F.col("n")).alias("share")), "jaccard-central")
        # whole sets and sketches, for classes with a candidate only
        mine = broadcast_if_small(central.select("t"), 16)  # so that the other texts are not shuffled
        self.sets = materialize(self.src.join(mine, "t").dropDuplicates(["t"]).mapInArrow(
            _sets(self.k, self.num, self.den), "cid long, n long, sketch binary, whole binary"), "jaccard-sets")
        hub = F.max(F.struct("share", "cid")).over(of)["cid"]
        links = self._found(self._hubs(rows.join(central.select("cid", "share"), "cid").withColumn("hub", hub)))
        comps = stars(links)  # most groups are stars, and the others are only tried again
        groups = self._groups(rows, central, comps)
        for turn in range(ROUNDS + 1):
            pairs = self._candidates(groups, comps, TRIES if turn < ROUNDS else 0, turn)
            n, left = pairs.agg(F.count("*"), F.max("left")).first()
            if n:
                links = links.unionByName(self._found(pairs))
            if not left:  # these were all
                break
            comps = components(links)
        self.links = links
        self.comps = components(links).withColumnRenamed("node", "cid")
        return self

    def _groups(self, rows: DataFrame, central: DataFrame, comps: DataFrame) -> DataFrame:
        """Written (group, cid, n): classes that share a key which holds several components share a group.

        A group is all keys of one hub, or one key where the blocks of the hub's keys have fewer rows."""
        at = self._label(rows.join(central.select("cid", "share"), "cid"), comps)
        mixed = materialize(
            at.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("z"), F.count("*").alias("size"),
                                  F.max(F.struct("share", "cid"))["cid"].alias("hub"))
            .filter("a <> z").select("key", "hub", "size"), "jaccard-mixed")
        cost = lambda n: n * F.ceil(n / BLOCK)
        joint = rows.join(mixed, "key").select("hub", "cid").distinct().groupBy("hub").agg(F.count("*").alias("n"))
        apart = mixed.groupBy("hub").agg(F.sum(cost(F.col("size"))).alias("cost"))
        joint = materialize(joint.join(apart, "hub").filter(cost(F.col("n")) <= F.col("cost"))
                            .select("hub", F.lit(True).alias("joint")), "jaccard-hubs")
        group = F.when(F.col("joint"), F.xxhash64(F.lit("hub"), F.col("hub"))).otherwise(F.col("key"))
        group = mixed.join(broadcast_if_small(joint, 16), "hub", "left").select("key", group.alias("group"))
        return materialize(rows.join(group, "key").select("group", "cid").distinct()
                           .join(self.sets.select("cid", "n"), "cid"), "jaccard-groups")

    def _candidates(self, groups: DataFrame, comps: DataFrame, tries: int, turn: int) -> DataFrame:
        """Written pairs (a, b) of different components that share a group and may link by their sketches.

        A group's classes are dealt to blocks, and each two blocks meet once."""
        at = self._label(groups, comps)
        blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int")
        mixed = (at.groupBy("group").agg(F.min("comp").alias("a"), F.max("comp").alias("z"), blocks.alias("blocks"))
                 .filter("a <> z").select("group", "blocks"))
        at = (at.join(mixed, "group").withColumn("mine", F.pmod(F.xxhash64("cid"), "blocks").cast("int"))
              .join(self.sets.select("cid", "sketch"), "cid")
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .select("group", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"),
                      (F.col("mine") > F.col("other")).alias("side"), "cid", "comp", "n", "sketch"))
        at = at.repartition("group", "i", "j").sortWithinPartitions("group", "i", "j")
        pairs = at.mapInArrow(_meet(self.num, self.den, tries, turn), "a long, b long, left boolean")
        return materialize(pairs.groupBy("a", "b").agg(F.max("left").alias("left")), "jaccard-near")


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs``."""
    j = JaccardJoin(docs, k, num, den).run()
    label = j._label(j.rows.filter("n > 0").groupBy("cid").agg(F.min("doc_id").alias("rep")), j.comps.withColumnRenamed("cid", "node"))
    least = label.groupBy("comp").agg(F.min("rep").alias("component_id"))
    of = label.join(least, "comp").select("cid", "component_id")
    return (j.rows.join(of, "cid", "left")
            .select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")))


def drop_near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs`` with one row of each component (its smallest doc_id; of equal rows one), and all wordless texts."""
    j = JaccardJoin(docs, k, num, den).run()
    r = j._label(j.rows, j.comps.withColumnRenamed("cid", "node"))
    name = [F.col("doc_id").isNull().alias("x"), "doc_id", "t"]
    best = r.filter("n > 0").groupBy("comp").agg(F.min(F.struct(*name)).alias("m"))
    rows = (r.filter("n > 0").groupBy("comp", "doc_id", "t").agg(F.count("*").alias("c"))
            .join(best, "comp").withColumn("stays", F.struct(*name) == F.col("m")))
    rows = materialize(rows.select(F.col("doc_id").alias("i"), F.col("t").alias("h"), "stays", "c"), "jaccard-verdicts")
    x = docs.select(F.struct("*").alias("d")).withColumn("t", F.xxhash64(F.coalesce("d.text", F.lit("")))).withColumn("id", F.col("d.doc_id").cast("long"))
    same = (F.col("t") == F.col("h")) & F.col("id").eqNullSafe(F.col("i"))
    # documents that go, and those that are there several times, are named; the others are not touched
    named = broadcast_if_small(materialize(rows.filter("not stays or c > 1").select("i", "h"), "jaccard-named"), 32)
    out = x.join(named, same, "left_anti").select("d.*")
    again = materialize(rows.filter("stays and c > 1").select("i", "h"), "jaccard-again")
    if again.isEmpty():
        return out
    first = x.join(broadcast_if_small(again, 32), same, "left_semi").groupBy("t", "id").agg(F.first("d").alias("d"))
    return out.unionByName(first.select("d.*"))


def op7(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=3, num=90, den=100)
