"""op12 against a recursive brute-force manifest."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lensmap.llm import merkle
from tests.llm.data import SCHEMA, crc


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, text):
    fields = (r[0], r[3], r[2], r[4], text)
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def tree(digests):
    """(root, siblings of every leaf, level by level, as pairs left and right)."""
    rows, paths = list(digests), [[] for _ in digests]
    at = list(range(len(rows)))
    while len(rows) > 1:
        for path, i in zip(paths, at):
            run = i // 3 * 3
            path.append(("".join(rows[run:i]), "".join(rows[i + 1:run + 3])))
        rows = [h(*rows[i:i + 3]) for i in range(0, len(rows), 3)]
        at = [i // 3 for i in at]
    return rows[0] if rows else None, paths


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        mine = sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        trees[s] = mine, *tree([leaf(r, r[1]) for r in mine])
    root, above = tree([trees[s][1] for s in names])
    out = []
    for s, top in zip(names, above):
        for r, path in zip(trees[s][0], trees[s][2]):
            hit = r[0] is not None and crc(r[0]) % 2 == 0 and r[1] is not None
            fold = leaf(r, r[1].replace("\n", "")) if hit else leaf(r, r[1])
            for a, b in path + top:
                fold = h(a, fold, b)
            proof = h(*(a + b for a, b in path + top))
            out.append((r[0], leaf(r, r[1]), trees[s][1], root, proof, fold, fold == root))
    return Counter(out)


def run(docs):
    leaves = merkle.manifest_leaves(docs, merkle.without_newlines())
    got = merkle.prove(leaves, merkle.nodes_of(leaves)).drop("proof")
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return Counter(tuple(r) for r in got.collect())


def test_odd_documents(odd, odd_rows):
    got = run(odd)
    assert got == brute(odd_rows)
    assert {k[6] for k in got} == {True, False}


def test_large_and_lone_sources(spark):
    """A hot source over two rounds of blocks, many lone ones, a null one."""
    rng = random.Random(5)
    rows = [(i, f"text\n{rng.random()}", "en", "hot" if i % 3 else f"s{i}" if i % 2 else None, i) for i in range(2400)]
    docs = spark.createDataFrame([(*r, *[None] * 11) for r in rows], SCHEMA).repartition(5)
    assert run(docs) == brute(rows)


@pytest.mark.parametrize("n", [0, 1, 3, 4])
def test_few_rows(spark, n):
    rows = [(i, "a\nb", None, "s", 3) for i in range(n)]
    docs = spark.createDataFrame([(*r, *[None] * 11) for r in rows], SCHEMA)
    assert run(docs) == (brute(rows) if rows else Counter())


@pytest.mark.parametrize("size", [1, 2, 3, 28, 100, 730])
def test_octopus_is_minimal(size):
    """The union of the coordinates has what the proofs need and nothing derivable."""
    rng = np.random.default_rng(size)
    known = np.unique(rng.integers(0, size, max(1, size // 5)))
    need, have = set(), {(0, int(i)) for i in known}
    for i in known:
        at, n, level = int(i), size, 0
        while n > 1:
            need |= {(level, j) for j in range(at // 3 * 3, min(at // 3 * 3 + 3, n))}
            at, n, level = at // 3, -(-n // 3), level + 1
            have.add((level, at))
    got = [(level, int(i)) for level, nodes in merkle.missing(known, size) for i in nodes]
    assert len(got) == len(set(got)) and set(got) == need - have


def test_proof_of_a_subset(spark):
    rows = [(i, f"t{i}", "en", f"s{i % 2}", i) for i in range(1700)]
    docs = spark.createDataFrame([(*r, *[None] * 11) for r in rows], SCHEMA)
    leaves = merkle.manifest_leaves(docs)
    nodes = merkle.nodes_of(leaves)
    got = merkle.prove(leaves.filter(F.col("doc_id") % 37 == 5), nodes, with_path=True).collect()
    assert sorted(r.doc_id for r in got) == [i for i in range(1700) if i % 37 == 5]
    for r in got:
        fold = r.leaf
        for step in r.proof:
            fold = h(step.left, fold, step.right)
        assert fold == r.root == r.folded_root and r.verified
        assert r.proof_sha256 == h(*(s.left + s.right for s in r.proof))
