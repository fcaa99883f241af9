"""V1-V8: exact top-k against numpy brute force, ties, bad vectors,
predicate before / threshold after, tiled = broadcast."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lensmap.functions import vector as V
from lensmap.operators import knn


def brute(q, c, ids, k, metric):
    out = {}
    for qi, qv in q.items():
        rows = []
        for cid, cv in zip(ids, c):
            if metric == "COSINE":
                nq, nc = np.linalg.norm(qv), np.linalg.norm(cv)
                if nq == 0 or nc == 0:
                    continue
                d = float(np.dot(qv, cv) / (nq * nc))
                key, s = -d, (d + 1) / 2
            elif metric == "L2":
                d = float(np.sum((qv - cv) ** 2))
                key, s = d, 1 / (1 + d)
            else:
                d = float(np.dot(qv, cv))
                key, s = -d, min(1.0, max(0.0, d))
            rows.append((key, cid, d, s))
        rows.sort()
        out[qi] = [(r + 1, cid, d, s) for r, (key, cid, d, s) in enumerate(rows[:k])]
    return out


def frames(spark, n=60, nq=12, dim=8, seed=7):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(n, dim)).astype(np.float32)
    q = rng.normal(size=(nq, dim)).astype(np.float32)
    ids = [f"id{i:03d}" for i in range(n)]
    cdf = spark.createDataFrame([(i, v.tolist(), i[-1]) for i, v in zip(ids, c)],
                                "id string, vector array<float>, tag string")
    qdf = spark.createDataFrame([(f"q{i}", v.tolist()) for i, v in enumerate(q)],
                                "query_id string, vector array<float>")
    return cdf, qdf, c, {f"q{i}": v.astype(np.float64) for i, v in enumerate(q)}, ids


def collect(df):
    got = {}
    for r in df.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["distance"], r["score"]))
    return got


def assert_same(got, exp):
    assert set(got) == set(k for k, v in exp.items() if v)
    for k, rows in exp.items():
        g = got.get(k, [])
        assert [(r, i) for r, i, _, _ in g] == [(r, i) for r, i, _, _ in rows]
        for (_, _, d1, s1), (_, _, d2, s2) in zip(g, rows):
            assert d1 == pytest.approx(d2, abs=1e-9) and s1 == pytest.approx(s2, abs=1e-9)


@pytest.mark.parametrize("metric", ["COSINE", "L2", "IP"])
def test_knn_matches_brute_force(spark, metric):
    cdf, qdf, c, q, ids = frames(spark)
    got = collect(knn.knn_join(qdf, cdf, k=5, metric=metric))
    assert_same(got, brute(q, c.astype(np.float64), ids, 5, metric))


@pytest.mark.parametrize("metric", ["COSINE", "L2"])
def test_tiled_equals_broadcast(spark, metric):
    cdf, qdf, c, q, ids = frames(spark, n=200)
    a = collect(knn.knn_join(qdf, cdf, k=7, metric=metric))
    b = collect(knn.knn_join(qdf, cdf, k=7, metric=metric, broadcast_bytes=2000))
    assert [(k, [(r, i) for r, i, _, _ in v]) for k, v in sorted(a.items())] == \
        [(k, [(r, i) for r, i, _, _ in v]) for k, v in sorted(b.items())]


def test_predicate_before_threshold_after(spark):
    cdf, qdf, c, q, ids = frames(spark)
    keep = [i for i, cid in enumerate(ids) if cid[-1] in "0123"]
    exp = brute(q, c[keep].astype(np.float64), [ids[i] for i in keep], 5, "COSINE")
    got = collect(knn.knn_join(qdf, cdf, k=5, predicate="tag < '4'"))
    assert_same(got, exp)
    thr = knn.knn_join(qdf, cdf, k=5, predicate=F.col("tag") < "4", threshold=0.6)
    got_t = collect(thr)
    for qid, rows in got_t.items():
        # threshold keeps a prefix of the ranked list with its ranks
        assert rows == [r for r in got[qid] if r[3] >= 0.6]
        assert [r[0] for r in rows] == list(range(1, len(rows) + 1))


def test_ties_break_by_id_and_bad_vectors(spark):
    cand = spark.createDataFrame([
        ("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", [2.0, 0.0]),   # all cos = 1
        ("z", [0.0, 0.0]),                                         # zero vector: no score
        ("w", [1.0, 0.0, 0.0]),                                    # wrong length
        ("n", None)], "id string, vector array<float>")
    q = spark.createDataFrame([("q", [3.0, 0.0]), ("zero", [0.0, 0.0]), ("bad", [1.0])],
                              "query_id string, vector array<float>")
    with pytest.raises(ValueError, match="several lengths"):   # which one is meant is the caller's to say
        knn.knn_join(q, cand, k=3)
    rows = knn.knn_join(q, cand, k=3, dim=2).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.id) for r in rows] == [("q", 1, "a"), ("q", 2, "b"), ("q", 3, "c")]
    arr = knn.knn_arrays(q, cand, k=3, dim=2).orderBy("query_id").collect()
    assert {r.query_id: len(r.hits) for r in arr} == {"bad": 0, "q": 3, "zero": 0}


def test_k_rules(spark):
    assert knn.resolve_k(0) == 5 and knn.resolve_k(None) == 5
    with pytest.raises(ValueError):
        knn.resolve_k(101)
    cdf, qdf, *_ = frames(spark, n=3)
    out = knn.knn_join(qdf, cdf, k=10).groupBy("query_id").count().collect()
    assert all(r["count"] == 3 for r in out)   # fewer candidates than k


def test_scores_in_range_and_column_metrics(spark):
    cdf, qdf, *_ = frames(spark)
    for m in ("COSINE", "L2", "IP"):
        s = knn.knn_join(qdf, cdf, k=5, metric=m).agg(F.min("score"), F.max("score")).first()
        assert -1e-12 <= s[0] <= s[1] <= 1 + 1e-12
    # the column-expression metrics agree with the block scorer
    pair = cdf.alias("a").join(cdf.alias("b"), F.col("a.id") == F.col("b.id"))
    r = pair.select(V.cosine_similarity("a.vector", "b.vector"), V.l2_squared("a.vector", "b.vector"),
                    V.score(V.distance("a.vector", "b.vector", "L2"), "L2")).first()
    assert r[0] == pytest.approx(1.0) and r[1] == 0.0 and r[2] == 1.0


def test_plan_has_no_exchange_on_query_side(spark):
    cdf, qdf, *_ = frames(spark)
    plan = knn.knn_join(qdf, cdf, k=5)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "CartesianProduct" not in plan \
        and "BroadcastNestedLoopJoin" not in plan


def test_mass_ties_take_the_exact_path(spark):
    # 40 identical candidates (more than k + shortlist slack) plus noise:
    # the float32 shortlist cannot certify the cut, the row is redone in
    # float64 and ties still break by id.
    rows = [(f"t{i:02d}", [1.0, 2.0, 3.0]) for i in range(40)]
    rows += [(f"n{i:02d}", [float(i), -1.0, 0.5]) for i in range(30)]
    cand = spark.createDataFrame(rows, "id string, vector array<float>")
    q = spark.createDataFrame([("q", [1.0, 2.0, 3.0])], "query_id string, vector array<float>")
    for metric in ("COSINE", "L2", "IP"):
        got = [r.id for r in knn.knn_join(q, cand, k=5, metric=metric).orderBy("rank").collect()]
        if metric == "IP":
            exp = [r[0] for r in sorted(rows, key=lambda r: (-float(np.dot(r[1], [1, 2, 3])), r[0]))[:5]]
        else:
            exp = ["t00", "t01", "t02", "t03", "t04"]
        assert got == exp, metric


def test_score_block_certified_equals_float64():
    rng = np.random.default_rng(11)
    mat = rng.normal(size=(3000, 48)).astype(np.float32)
    ids = None
    for metric in ("COSINE", "L2", "IP"):
        norms = np.sqrt(np.einsum("ij,ij->i", mat.astype(np.float64), mat.astype(np.float64)))
        if metric == "L2":
            norms = norms * norms
        m = knn._matrix(ids, mat, norms, {})
        q = rng.normal(size=(300, 48)).astype(np.float32).astype(np.float64)
        a = knn.score_block(q, m, metric, 10, 1024)
        b = knn._score_block_f64(q, m, metric, 10, 1024)
        assert (a[1] == b[1]).all()
        assert np.allclose(a[0], b[0], rtol=0, atol=1e-12)


def test_mapping_plan_is_shuffle_free_and_tiled_arrays_agree(spark):
    from lensmap.operators import records as R
    cdf, qdf, *_ = frames(spark, n=120)
    kn = cdf.withColumn("insight", F.concat(F.lit("i"), "id")).withColumn("aspect", F.col("tag"))
    fb = qdf.withColumnRenamed("query_id", "id")
    mapped = R.map_feedback(fb, kn)
    plan = mapped._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    a = {r.id: [(m.id, round(m.score, 12)) for m in r.mapped_perspectives] for r in mapped.collect()}
    tiled = R.map_feedback(fb, kn, broadcast_bytes=4000)
    b = {r.id: [(m.id, round(m.score, 12)) for m in r.mapped_perspectives] for r in tiled.collect()}
    assert a == b and all(len(v) == 5 for v in a.values())


def test_arrays_threshold_both_paths_and_key_name(spark):
    cdf, qdf, *_ = frames(spark, n=150)
    kw = dict(k=6, threshold=0.8, query_id="query_id")
    a = {r.query_id: [(h.rank, h.id) for h in r.hits] for r in knn.knn_arrays(qdf, cdf, **kw).collect()}
    b = {r.query_id: [(h.rank, h.id) for h in r.hits]
         for r in knn.knn_arrays(qdf, cdf, broadcast_bytes=3000, **kw).collect()}
    assert a == b and any(len(v) < 6 for v in a.values())
    with pytest.raises(ValueError):
        knn.knn_join(qdf.withColumnRenamed("query_id", "id"), cdf, query_id="id")


@pytest.mark.parametrize("metric", ["COSINE", "L2", "IP"])
def test_score_block_against_some_parts(metric):
    """Each query meets the parts it wants and no others; ties go by row, also across parts."""
    rng = np.random.default_rng(12)
    mat = rng.normal(size=(400, 6)).astype(np.float32)
    mat[200:260] = mat[0]
    m64 = mat.astype(np.float64)
    norms = (m64 * m64).sum(1) if metric == "L2" else np.sqrt((m64 * m64).sum(1))
    m = knn._matrix(None, mat, norms, {})
    part = rng.integers(0, 9, 400)
    want = rng.random((50, 9)) < 0.4
    want[0], want[1] = False, True
    q = np.concatenate([rng.normal(size=(49, 6)), m64[:1]])
    key, idx = knn.score_block(q, m, metric, 7, 64, knn.Parts(part, want))
    full, rows = knn._score_block_f64(q, m, metric, 400, 64)
    for i in range(50):
        keep = want[i][part[rows[i]]]
        right = rows[i][keep][:7]
        found = idx[i][np.isfinite(key[i])]
        assert found.tolist() == right.tolist()
        assert np.allclose(key[i][:len(right)], full[i][keep][:7])


@pytest.mark.parametrize("metric", ["COSINE", "L2", "IP"])
def test_scoring_holds_a_bounded_part_of_the_scores(metric):
    """Neither the scores of a block nor a float64 copy of all candidates is ever held whole."""
    import tracemalloc
    rng = np.random.default_rng(13)
    mat = rng.normal(size=(120_000, 16)).astype(np.float32)
    lengths = knn._lengths(mat)
    m = knn._matrix(None, mat, lengths * lengths if metric == "L2" else lengths, {})
    q = rng.normal(size=(600, 16))
    tracemalloc.start()
    knn.score_block(q, m, metric, 5, 16384)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < mat.nbytes * 1.1 + 24 * knn.BLOCK_SCORES
