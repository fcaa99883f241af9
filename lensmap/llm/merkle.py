"""Merkle manifest of a dataset, with octopus multiproofs.

Every row is a leaf.  The leaves of a source, by doc_id, form a tree of runs of
three; the sources' subroots, by source, form a tree on top of them.

1. ``place``: leaves are range-partitioned by (tree, order), so that a hot
   source spreads over many tasks; positions follow from the number of rows
   before a task, written in the same pass as the rows.
2. ``grow``: blocks of 3**BLOCK_LEVELS neighbouring nodes give all their levels
   in one task, the tops of the blocks are the input of the next round; a round
   divides a tree by 729, so few rounds suffice at any size.  Small trees share
   a block; no task holds more than two blocks.
3. ``prove``: a block of leaves to be proved computes the minimal union of node
   coordinates its proofs need and cannot derive (the octopus), fetches them in
   one join for all blocks, derives the shared interiors, and expands every
   leaf's own proof locally.  Any subset of the leaves may be proved.

Defined cases: null fields are told from empty ones in the leaf (``-``); a null
source is a tree of its own, the first; a null doc_id comes first in its tree,
equal ids are ordered by leaf digest (and equal rows, whose digests are equal,
in any order: each gets a proof of its own place); a null doc_id is not
tampered with; a lone leaf is its tree's root and has an empty proof; an empty
table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lensmap.operators.partitioning import broadcast_if_small
from lensmap.session import materialize, release

ARITY = 3
BLOCK_LEVELS = 6                # a block spans 3**6 = 729 positions
TOP = -1                        # tree id of the tree over the subroots
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODE = "tree long, level int, idx long, digest string"


def leaf_digest(fields: list[Column]) -> Column:
    """SHA-256 of the fields, each ``-`` (null) or its UTF-8 length, a colon and its text."""
    text = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text)), 256)


def _h(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# -- positions ---------------------------------------------------------------

def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, at = TaskContext.get().partitionId(), 0
    for b in batches:
        n = b.num_rows
        yield pa.RecordBatch.from_arrays(
            [*b.columns, pa.array(np.full(n, task, np.int32)), pa.array(np.arange(at, at + n))], names=[*b.schema.names, "task", "at"])
        at += n


def _runs(rows: DataFrame, tree: str, order: list[str], what: str) -> tuple[DataFrame, DataFrame]:
    """(rows in order with task and at, one row per task and tree: shift, start, size).

    Position in the tree = at + shift; ``start`` (the rows of all trees before it) names a tree."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", task int, at long"
    ordered = materialize(rows.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order)
                          .mapInArrow(_numbered, schema), what)
    runs_table = materialize(ordered.groupBy("task", tree).agg(F.count("*").alias("n"), F.min("at").alias("first")), what + "-runs")
    tasks = runs_table.groupBy("task").agg(F.sum("n").alias("rows"))       # one row a task, put in order by one window
    before = tasks.select("task", F.coalesce(F.sum("rows").over(
        Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    runs = runs_table.join(F.broadcast(before), "task")
    trees = runs.groupBy(F.col(tree).alias("_tree")).agg(F.min(F.col("before") + F.col("first")).alias("start"), F.sum("n").alias("size"))
    spans = runs.join(trees, F.col(tree).eqNullSafe(F.col("_tree"))).select(
        F.col("task").alias("_task"), "_tree", (F.col("before") - F.col("start")).alias("shift"), "start", "size")
    spans = materialize(spans, what + "-spans")
    release(runs_table)
    return ordered, spans


def _at_place(ordered: DataFrame, spans: DataFrame, tree: str) -> DataFrame:
    """The rows with pos and the columns of their span; a hot tree's rows are spread by task."""
    j = ordered.join(broadcast_if_small(spans, 128), (F.col("task") == F.col("_task")) & F.col(tree).eqNullSafe(F.col("_tree")))
    return j.withColumn("pos", F.col("at") + F.col("shift")).drop("task", "at", "_task", "_tree", "shift")


def place(leaves: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """The leaves with ``tree`` (id), ``size`` of the tree, ``pos`` in it, and their tree's ``rank``
    among ``trees`` trees.  ``order`` must tell rows of a tree apart, but for equal ones."""
    ordered, spans = _runs(leaves, tree, order, "merkle-leaves")
    every = spans.select("start").distinct().withColumn("one", F.lit(0))
    top, top_spans = _runs(every, "one", ["start"], "merkle-trees")
    ranks = _at_place(top.withColumnRenamed("start", "_start"), top_spans, "one").select(
        F.col("_start").alias("start"), F.col("pos").alias("rank"), F.col("size").alias("trees"))
    out = materialize(_at_place(ordered, spans.join(ranks, "start"), tree).withColumnRenamed("start", "tree"), "merkle-placed")
    release(ordered, spans, top, top_spans)
    return out


def _block(tree: Column, pos: Column, span: int) -> Column:
    """Number of the block of a position: blocks of a tree are ``span`` long, trees follow each other."""
    return F.floor((tree + F.floor(pos / span) * span) / span).cast("long")


# -- nodes -------------------------------------------------------------------

def _sizes(size: int) -> list[int]:
    """Nodes of every level of a tree."""
    out = [size]
    while out[-1] > 1:
        out.append(-(-out[-1] // ARITY))
    return out


def _by_tree(t: pa.Table) -> Iterator[tuple[int, int, pa.Table]]:
    """(tree, size, its rows by position) of a block."""
    t = t.sort_by([("tree", "ascending"), ("pos", "ascending")])
    tree = t["tree"].to_numpy()
    cut = [0, *(np.flatnonzero(tree[1:] != tree[:-1]) + 1).tolist(), len(tree)]
    for a, b in zip(cut, cut[1:]):
        if b > a:
            yield int(tree[a]), t["size"][a].as_py(), t.slice(a, b - a)


def grow(leaves: DataFrame, levels: int = BLOCK_LEVELS) -> list[DataFrame]:
    """Written tables of all nodes above the leaves (tree, size, pos, digest), a round each."""
    span = ARITY ** levels

    def climb(t: pa.Table) -> pa.Table:
        out = []
        for tree, size, rows in _by_tree(t):
            pos, digest = rows["pos"].to_numpy(), rows["digest"].to_pylist()
            for part in np.split(np.arange(len(pos)), np.flatnonzero(pos[1:] // span != pos[:-1] // span) + 1):
                at, row = int(pos[part[0]]), [digest[i] for i in part]
                for level, n in enumerate(_sizes(size)[:levels]):
                    if n == 1:
                        break
                    row = [_h(row[i:i + ARITY]) for i in range(0, len(row), ARITY)]
                    at //= ARITY
                    out += [(tree, level + 1, at + i, d) for i, d in enumerate(row)]
        cols = list(zip(*out)) or [[]] * 4
        return pa.table({"tree": pa.array(cols[0], pa.int64()), "level": pa.array(cols[1], pa.int32()),
                         "idx": pa.array(cols[2], pa.int64()), "digest": pa.array(cols[3], pa.string())})

    rounds, scale = [], 1
    cur = leaves.select("tree", F.col("tree").alias("place"), "size", "pos", "digest")
    largest = cur.agg(F.max("size")).first()[0] or 0
    while largest > 1:
        up = cur.groupBy(_block(F.col("place"), F.col("pos"), span).alias("block")).applyInArrow(climb, NODE)
        nodes = materialize(up.withColumn("level", F.col("level") + levels * len(rounds)), "merkle-nodes")
        rounds.append(nodes)
        scale, largest = scale * span, -(-largest // span)
        if largest > 1:
            big = leaves.filter(F.col("size") > scale).select("tree", "size").distinct()
            cur = (nodes.filter(F.col("level") == levels * len(rounds)).join(broadcast_if_small(big, 32), "tree")
                   .select("tree", F.floor(F.col("tree") / scale).cast("long").alias("place"),
                           F.ceil(F.col("size") / scale).cast("long").alias("size"), F.col("idx").alias("pos"), "digest"))
    return rounds


def nodes_of(leaves: DataFrame) -> DataFrame:
    """All nodes of placed leaves: NODE, the tree over the subroots as tree TOP."""
    below = grow(leaves)
    own = [leaves.select("tree", F.lit(0).alias("level"), F.col("pos").alias("idx"), "digest"), *below]
    nodes = own[0]
    for more in own[1:]:
        nodes = nodes.unionByName(more)
    trees = leaves.select("tree", "size", "rank", "trees").distinct()
    # the last level of a tree: the least l with 3**l >= size
    last = F.expr(f"aggregate(sequence(1, 40), 0, (l, i) -> if(cast(power({ARITY}, l) as decimal(38, 0)) < size, i, l))")
    subroots = materialize(nodes.filter("idx = 0").join(trees.withColumn("level", last), ["tree", "level"]).select(
        F.lit(TOP).cast("long").alias("tree"), F.col("trees").alias("size"), F.col("rank").alias("pos"), "digest"), "merkle-subroots")
    top = [subroots.select("tree", F.lit(0).alias("level"), F.col("pos").alias("idx"), "digest"), *grow(subroots)]
    for more in top:
        nodes = nodes.unionByName(more)
    return nodes


# -- proofs ------------------------------------------------------------------

def missing(known: np.ndarray, size: int) -> list[tuple[int, np.ndarray]]:
    """The octopus: (level, nodes) that the proofs of the ``known`` leaves need and cannot derive."""
    out = []
    for level, n in enumerate(_sizes(size)[:-1]):
        parents = np.unique(known // ARITY)
        children = (parents[:, None] * ARITY + np.arange(ARITY)).ravel()
        out.append((level, np.setdiff1d(children[children < n], known)))
        known = parents
    return out


def _wanted(key: tuple, t: pa.Table) -> pa.Table:
    """Coordinates a block fetches: its missing nodes, and the roots to check against."""
    tree, level, idx = [], [], []

    def want(of: int, size: int, known: np.ndarray) -> None:
        for lv, nodes in [*missing(known, size), (len(_sizes(size)) - 1, np.zeros(1, np.int64))]:
            tree.append(np.full(len(nodes), of))
            level.append(np.full(len(nodes), lv, np.int32))
            idx.append(nodes)
    for of, size, rows in _by_tree(t):
        want(of, size, np.unique(rows["pos"].to_numpy()))
    want(TOP, t["trees"][0].as_py(), np.unique(t["rank"].to_numpy()))
    flat = [np.concatenate(x) for x in (tree, level, idx)]
    return pa.table({"block": pa.array(np.full(len(flat[0]), key[0].as_py()), pa.int64()), "tree": pa.array(flat[0], pa.int64()),
                     "level": pa.array(flat[1], pa.int32()), "idx": pa.array(flat[2], pa.int64())})


class _Tree:
    """A tree as far as a block knows it: its own leaves, and what it fetched."""

    def __init__(self, size: int, leaves: dict[int, str], fetched: dict[tuple[int, int], str]):
        self.sizes, self.levels, self.around = _sizes(size), [], {}
        known = leaves
        for level, n in enumerate(self.sizes):
            here = known | {i: d for (lv, i), d in fetched.items() if lv == level and i not in known}
            self.levels.append(here)
            if n > 1:   # shared interiors, each derived once
                known = {p: _h([here[i] for i in range(p * ARITY, min(p * ARITY + ARITY, n))]) for p in {i // ARITY for i in known}}

    def path(self, pos: int) -> Iterator[tuple[str, str]]:
        """(siblings to the left, siblings to the right), level by level."""
        for level, n in enumerate(self.sizes[:-1]):
            at = (level, pos)
            if at not in self.around:
                first, here = pos // ARITY * ARITY, self.levels[level]
                self.around[at] = ("".join(here[i] for i in range(first, pos)),
                                   "".join(here[i] for i in range(pos + 1, min(first + ARITY, n))))
            yield self.around[at]
            pos //= ARITY


PROOF = ("doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, "
         "verified boolean, proof array<struct<left:string,right:string>>")


def _expand(with_path: bool):
    def expand(rows: pa.Table, fetched: pa.Table) -> pa.Table:
        got: dict[int, dict] = {}
        for tree, level, idx, d in zip(*(fetched[c].to_pylist() for c in ("tree", "level", "idx", "digest"))):
            got.setdefault(tree, {})[level, idx] = d
        out, mine = [], []
        for tree, size, part in _by_tree(rows):
            leaves = dict(zip(part["pos"].to_pylist(), part["digest"].to_pylist()))
            mine.append((_Tree(size, leaves, got.get(tree, {})), got[tree][len(_sizes(size)) - 1, 0], part))
        if mine:
            trees = rows["trees"][0].as_py()
            top = _Tree(trees, {p["rank"][0].as_py(): t.levels[-1][0] for t, _, p in mine}, got[TOP])
            root = got[TOP][len(top.sizes) - 1, 0]
        for t, subroot, part in mine:
            above = list(top.path(part["rank"][0].as_py()))
            tail = "".join(left + right for left, right in above)
            for doc, pos, leaf, altered in zip(*(part[c].to_pylist() for c in ("doc_id", "pos", "digest", "altered"))):
                steps = list(t.path(pos))
                fold = leaf if altered is None else altered
                for left, right in (*steps, *above):
                    fold = hashlib.sha256(f"{left}{fold}{right}".encode()).hexdigest()
                proof = "".join(left + right for left, right in steps) + tail
                out.append((doc, leaf, subroot, root, hashlib.sha256(proof.encode()).hexdigest(), fold, fold == root,
                            [{"left": a, "right": b} for a, b in (*steps, *above)] if with_path else None))
        kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_(), pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))]
        cols = list(zip(*out)) or [[]] * 8
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds)], names=[
            "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "proof"])
    return expand


def prove(leaves: DataFrame, nodes: DataFrame, with_path: bool = False) -> DataFrame:
    """PROOF of each of the placed ``leaves`` (any subset of a manifest's leaves), checked
    for the digest ``altered`` where there is one, else for the leaf itself."""
    span = ARITY ** BLOCK_LEVELS
    blocks = leaves.withColumn("block", _block(F.col("tree"), F.col("pos"), span))
    wanted = materialize(blocks.select("block", "tree", "size", "pos", "rank", "trees").groupBy("block").applyInArrow(
        _wanted, "block long, tree long, level int, idx long"), "merkle-wanted")
    fetched = materialize(wanted.join(nodes, ["tree", "level", "idx"]).select("block", "tree", "level", "idx", "digest"),
                          "merkle-fetched")
    release(wanted)
    cols = ["block", "tree", "size", "pos", "rank", "trees", "doc_id", "digest", "altered"]
    return blocks.select(*cols).groupBy("block").cogroup(fetched.groupBy("block")).applyInArrow(_expand(with_path), PROOF)


def manifest_leaves(docs: DataFrame, altered: Column | None = None) -> DataFrame:
    """Placed leaves of ``docs``; ``altered`` is the text to check instead of a row's own (null: its own)."""
    fields = [F.col(f) for f in FIELDS]
    other = F.when(altered.isNotNull(), leaf_digest([*fields[:-1], altered])) if altered is not None else F.lit(None).cast("string")
    rows = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", leaf_digest(fields).alias("digest"),
                                   other.alias("altered"), F.monotonically_increasing_id().alias("seq")), "merkle-rows")
    placed = place(rows, "source", ["doc_id", "digest", "seq"])
    release(rows)
    return placed


def without_newlines(every: int = 2) -> Column:
    """The tampering to be caught: texts without newlines where crc32 of the id is a multiple of ``every``."""
    hit = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % every == 0
    return F.when(hit, F.replace(F.col("text"), F.lit("\n"), F.lit("")))


def op12(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    leaves = manifest_leaves(docs, without_newlines())
    return prove(leaves, nodes_of(leaves)).drop("proof")


def _sql_leaf(text: str) -> str:
    values = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
    return "sha256(concat(" + ", ".join(f"coalesce(strlen({v})::VARCHAR || ':' || {v}, '-')" for v in values) + "))"


SQL = rf"""
WITH RECURSIVE
c AS (SELECT *, row_number() OVER () AS rid, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(
               range(0, 8 * len(doc_id::VARCHAR)),
               lambda i: CASE WHEN i % 8 = 0 THEN ascii((doc_id::VARCHAR)[(i // 8 + 1)::INTEGER])::BIGINT ELSE 0::BIGINT END)),
               lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1)))) AS crc FROM documents),
p AS (SELECT rid, doc_id, leaf, alt, dense_rank() OVER (ORDER BY source NULLS FIRST) AS tree,
             row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS pos,
             count(*) OVER (PARTITION BY source) AS n
      FROM (SELECT rid, doc_id, source, {_sql_leaf("text")} AS leaf,
                   CASE WHEN crc % 2 = 0 THEN {_sql_leaf("replace(text, chr(10), '')")} ELSE {_sql_leaf("text")} END AS alt
            FROM c)),
nd AS (SELECT tree, 0 AS lvl, pos AS idx, leaf AS dg, n FROM p
       UNION ALL SELECT tree, lvl + 1, idx // 3, sha256(string_agg(dg, '' ORDER BY idx)), (n + 2) // 3
                 FROM nd WHERE n > 1 GROUP BY tree, lvl, n, idx // 3),
sub AS (SELECT tree, lvl, dg FROM nd WHERE n = 1),
tp AS (SELECT 0 AS lvl, tree - 1 AS idx, dg, (SELECT count(*) FROM sub) AS n FROM sub
       UNION ALL SELECT lvl + 1, idx // 3, sha256(string_agg(dg, '' ORDER BY idx)), (n + 2) // 3
                 FROM tp WHERE n > 1 GROUP BY lvl, n, idx // 3),
rn AS (SELECT tree, lvl, idx // 3 AS run, list(dg ORDER BY idx) AS l FROM nd WHERE n > 1 GROUP BY ALL),
tr AS (SELECT lvl, idx // 3 AS run, list(dg ORDER BY idx) AS l FROM tp WHERE n > 1 GROUP BY ALL),
f AS (SELECT rid, tree, 0 AS lvl, pos AS idx, alt AS dg, '' AS proof FROM p
      UNION ALL SELECT rid, f.tree, f.lvl + 1, idx // 3,
                       sha256(array_to_string(l[:idx % 3], '') || dg || array_to_string(l[idx % 3 + 2:], '')),
                       proof || array_to_string(l[:idx % 3], '') || array_to_string(l[idx % 3 + 2:], '')
                FROM f JOIN rn ON f.tree = rn.tree AND f.lvl = rn.lvl AND f.idx // 3 = rn.run),
g AS (SELECT rid, 0 AS lvl, f.tree - 1 AS idx, f.dg, proof FROM f JOIN sub ON f.tree = sub.tree AND f.lvl = sub.lvl
      UNION ALL SELECT rid, g.lvl + 1, idx // 3,
                       sha256(array_to_string(l[:idx % 3], '') || dg || array_to_string(l[idx % 3 + 2:], '')),
                       proof || array_to_string(l[:idx % 3], '') || array_to_string(l[idx % 3 + 2:], '')
                FROM g JOIN tr ON g.lvl = tr.lvl AND g.idx // 3 = tr.run),
r AS (SELECT lvl, dg FROM tp WHERE n = 1)
SELECT p.doc_id, p.leaf, sub.dg AS subroot, r.dg AS root, sha256(g.proof) AS proof_sha256, g.dg AS folded_root,
       g.dg = r.dg AS verified
FROM p JOIN sub USING (tree) JOIN g USING (rid) JOIN r ON g.lvl = r.lvl
"""
