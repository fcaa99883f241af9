"""Exact k-nearest-neighbour join (V5) with predicate (V6), threshold (V7)
and rank (V8).

Plan shape
----------
The candidate side (a knowledge catalogue, a collection) is filtered by the
predicate, validated, then measured with one grouped aggregate: rows,
dimension and bytes.  When it fits the broadcast budget
(``spark.lensmap.knn.broadcastBytes``) it is shipped once to every executor as
a float32 matrix sorted by id, and the query side is scored by an Arrow UDF
inside a plain ``select``: each Arrow batch of query vectors is multiplied
block-wise against the matrix (float32 BLAS), a shortlist of k+16 per query
survives, and the shortlist is rescored exactly in float64 (an error bound
certifies the shortlist; uncertain rows are recomputed in float64).  The query
side is never shuffled, never joined back, and no pair rows exist - each query
emits at most k hits.

When the candidates exceed the budget, they are put into cells, and blocks of
queries meet blocks of those cells that can still hold one of their hits
(``cells.search``: a first pass bounds the k-th hit, the triangle inequality
rules cells out); every group is scored the same way and gives its top-k per
query, and a per-query top-k over the partial hits is the exact global answer
(top-k of a union = top-k of the per-part top-k).  Queries carry a row key of
their own, so both paths answer alike whatever the query ids.

Order: distance in the metric's direction, then id ascending - a total order,
so results are deterministic and the blocked merge is exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vector as V
from ..session import (KNN_BROADCAST_BYTES, KNN_BROADCAST_BYTES_DEFAULT,
                       KNN_CANDIDATE_TILE, KNN_CANDIDATE_TILE_DEFAULT,
                       KNN_QUERY_BLOCK, KNN_QUERY_BLOCK_DEFAULT, conf_int, materialize)

DEFAULT_K = 5
MAX_K = 100


def resolve_k(k: int | None) -> int:
    """``top_k or default``: 0/None give 5; the store accepts 1..100."""
    k = int(k or DEFAULT_K)
    if k < 1 or k > MAX_K:
        raise ValueError(f"top_k must be in 1..{MAX_K}, got {k}")
    return k


def hit_type(payload: list[tuple[str, T.DataType]] | None = None) -> T.ArrayType:
    fields = [T.StructField("rank", T.IntegerType(), False),
              T.StructField("id", T.StringType(), False),
              T.StructField("distance", T.DoubleType(), False),
              T.StructField("score", T.DoubleType(), False)]
    for name, dt in payload or []:
        fields.append(T.StructField(name, dt, True))
    return T.ArrayType(T.StructType(fields), containsNull=False)


# --------------------------------------------------------------------------
# Candidate preparation and the size check
# --------------------------------------------------------------------------

def prepare_candidates(candidates: DataFrame, *, id_col: str = "id",
                       vector_col: str = "vector", metric: str = V.COSINE,
                       predicate: Column | str | None = None,
                       payload: list[str] | None = None) -> DataFrame:
    """V6 predicate first, then the columns the search needs and nothing else."""
    df = candidates
    if predicate is not None:
        df = df.where(F.expr(predicate) if isinstance(predicate, str) else predicate)
    cols = [F.col(id_col).cast("string").alias("id"), F.col(vector_col).alias("vector")]
    cols += [F.col(p) for p in payload or []]
    df = df.select(*cols).where(F.col("id").isNotNull() & F.col("vector").isNotNull())
    return df


def measure_candidates(cand: DataFrame, payload: list[str] | None = None,
                       dim: int | None = None) -> dict:
    """Row count, dimension and bytes to ship - one grouped aggregate.

    ``dim`` is the declared dimension (a collection's manifest, an embedder's
    ``dim``); rows of any other length cannot be scored (C5) and are neither
    counted nor shipped.  Without it all candidates must have one length:
    which of several is meant is not for this function to guess.  The
    aggregate has one row per distinct vector length, so collecting it is
    bounded.
    """
    per_row = F.octet_length("id") + F.size("vector") * 4
    for p in payload or []:
        per_row = per_row + F.coalesce(F.octet_length(F.col(p).cast("string")), F.lit(0))
    by_len = (cand.groupBy(F.size("vector").alias("d"))
              .agg(F.count(F.lit(1)).alias("n"), F.sum(per_row.cast("long")).alias("bytes"))
              .collect())
    if dim is None and len(by_len) > 1:
        raise ValueError("candidate vectors have several lengths "
                         f"({', '.join(str(r['d']) for r in sorted(by_len, key=lambda r: r['d']))}); pass dim")
    if dim is None and by_len:
        dim = int(by_len[0]["d"])
    row = next((r for r in by_len if r["d"] == dim), None)
    if dim is None or row is None:
        return {"n": 0, "dim": dim, "bytes": 0}
    return {"n": int(row["n"]), "dim": int(dim), "bytes": int(row["bytes"] or 0)}


SLICE_ROWS = 1 << 14            # rows of a matrix that are float64 at once
BLOCK_SCORES = 1 << 22          # scores of one product of queries and candidates


def _lengths(mat: np.ndarray) -> np.ndarray:
    """L2 norm of every row in float64, a slice of rows at a time."""
    out = np.zeros(len(mat))
    for s in range(0, len(mat), SLICE_ROWS):
        m64 = mat[s:s + SLICE_ROWS].astype(np.float64)
        out[s:s + SLICE_ROWS] = np.sqrt(np.einsum("ij,ij->i", m64, m64))
    return out


def _matrix(ids, mat, norms, payload) -> dict:
    """What every executor holds for a candidate tile: plain picklable values.

    ``norms`` are L2 norms (squared for the L2 metric); ``cmax`` is the
    largest L2 norm, used by the float32 error bound.
    """
    cmax = float(_lengths(mat).max()) if len(mat) else 0.0
    return {"ids": ids, "mat": mat, "norms": norms, "payload": payload, "cmax": cmax}


def _collect_matrix(cand: DataFrame, dim: int, metric: str,
                    payload: list[str]) -> dict:
    """Collect a size-checked candidate tile and sort it by id.

    Rows with a different length than ``dim`` are not scoreable (C5) and are
    left out; for COSINE so are zero vectors (their similarity is undefined).
    """
    return _arrow_matrix(cand.where(F.size("vector") == dim).toArrow(), dim, metric, payload)


def _arrow_matrix(tbl: pa.Table, dim: int, metric: str, payload: list[str]) -> dict:
    """The matrix of a table of candidates of one length, sorted by id."""
    ids = tbl.column("id").combine_chunks()
    if len(ids):
        order = pc.array_sort_indices(ids)          # code-point = byte order
        tbl = tbl.take(order)
        ids = tbl.column("id").combine_chunks()
    vec = tbl.column("vector").combine_chunks()
    if len(vec):
        mat = pc.list_flatten(vec).to_numpy(zero_copy_only=False).astype(np.float32)
        mat = mat.reshape(len(vec), dim)
    else:
        mat = np.zeros((0, dim), dtype=np.float32)
    norms = _lengths(mat)
    if metric == V.L2:
        norms = norms * norms                       # keep squared norms for L2
    keep = np.isfinite(norms)
    if metric == V.COSINE:
        keep &= norms > 0
    if not keep.all():
        idx = pa.array(np.nonzero(keep)[0])
        tbl, mat, norms = tbl.take(idx), mat[keep], norms[keep]
        ids = tbl.column("id").combine_chunks()
    pay = {p: tbl.column(p).combine_chunks() for p in payload}
    return _matrix(ids, np.ascontiguousarray(mat), norms, pay)


# --------------------------------------------------------------------------
# Block scoring with a running top-k (runs inside Python workers)
# --------------------------------------------------------------------------

class Parts:
    """Parts (cells) of a matrix's rows, and which of them each query is scored against."""

    def __init__(self, part: np.ndarray, want: np.ndarray):
        self.part, self.want = part, want                       # part of each row; queries x parts
        self.order = np.argsort(part, kind="stable")            # rows by part, ascending inside it
        self.start = np.searchsorted(part[self.order], np.arange(want.shape[1] + 1))

    def rows(self, rows) -> Parts:
        """The same parts for some of the queries."""
        out = object.__new__(Parts)
        out.__dict__.update(self.__dict__, want=self.want[rows])
        return out

    def tiles(self, tile: int):
        """(rows of the matrix, queries that want them)."""
        for c in np.nonzero(self.want.any(axis=0))[0]:
            wanted = np.nonzero(self.want[:, c])[0]
            for s in range(self.start[c], self.start[c + 1], tile):
                yield self.order[s:min(s + tile, self.start[c + 1])], wanted


def _topk_merge(best_key, best_idx, key, idx, k):
    """Keep the k smallest (key, idx) pairs per row of [best | new]."""
    allk = np.concatenate([best_key, key], axis=1)
    alli = np.concatenate([best_idx, idx], axis=1)
    if allk.shape[1] <= k:
        return allk, alli
    part = np.argpartition(allk, k - 1, axis=1)[:, :k]
    selk = np.take_along_axis(allk, part, axis=1)
    seli = np.take_along_axis(alli, part, axis=1)
    # argpartition picks arbitrarily among keys equal to the k-th one; rows
    # where such a tie straddles the cut are redone with the id tie-break.
    kth = selk.max(axis=1)
    n_all = (allk == kth[:, None]).sum(axis=1)
    n_sel = (selk == kth[:, None]).sum(axis=1)
    for r in np.nonzero((n_all > n_sel) & np.isfinite(kth))[0]:
        o = np.lexsort((alli[r], allk[r]))[:k]
        selk[r], seli[r] = allk[r][o], alli[r][o]
    return selk, seli


def _score_block_f64(q: np.ndarray, m: dict, metric: str, k: int,
                     tile: int, parts: Parts | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Reference path: every score in float64 (used for rows the fast path
    cannot certify)."""
    b, n = q.shape[0], m["mat"].shape[0]
    step = max(1, BLOCK_SCORES // max(1, min(tile, n)))
    if b > step:
        out = [_score_block_f64(q[s:s + step], m, metric, k, tile, parts and parts.rows(slice(s, s + step)))
               for s in range(0, b, step)]
        return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])
    kk = min(k, n)
    best_key = np.full((b, 0), np.inf)
    best_idx = np.zeros((b, 0), dtype=np.int64)
    qn = _query_norms(q, metric)
    if metric == V.L2:                              # differences, not |q|^2 + |c|^2 - 2 q.c
        tile = max(1, min(tile, (1 << 22) // max(1, b * q.shape[1])))
    for s in range(0, n, tile):
        e = min(n, s + tile)
        c = m["mat"][s:e].astype(np.float64)
        if metric == V.L2:
            diff = q[:, None, :] - c[None, :, :]
            key = np.einsum("bnd,bnd->bn", diff, diff)
            key[~np.isfinite(key)] = np.inf
        else:
            key = _keys(q @ c.T, qn, m["norms"][s:e], metric)
        if parts is not None:
            key[~parts.want[:, parts.part[s:e]]] = np.inf
        idx = np.broadcast_to(np.arange(s, e, dtype=np.int64), key.shape)
        best_key, best_idx = _topk_merge(best_key, best_idx, key, idx, kk)
    return _sorted(best_key, best_idx)


def _query_norms(q: np.ndarray, metric: str):
    if metric == V.COSINE:
        return np.sqrt(np.einsum("ij,ij->i", q, q))
    if metric == V.L2:
        return np.einsum("ij,ij->i", q, q)
    return None


def _keys(dots: np.ndarray, qn, cn, metric: str) -> np.ndarray:
    """Ascending order keys from dot products (float64); +inf = no score."""
    with np.errstate(divide="ignore", invalid="ignore"):
        if metric == V.COSINE:
            key = -(dots / (qn[:, None] * cn[None, :]))
        elif metric == V.L2:
            key = np.maximum(qn[:, None] + cn[None, :] - 2.0 * dots, 0.0)
        else:
            key = -dots
    key[~np.isfinite(key)] = np.inf
    return key


def _sorted(key, idx):
    if key.shape[1]:
        o = np.lexsort((idx, key), axis=1)
        key = np.take_along_axis(key, o, axis=1)
        idx = np.take_along_axis(idx, o, axis=1)
    return key, idx


SHORTLIST_SLACK = 16
F32_UNIT = 2.0 ** -24


def _prepared(m: dict, metric: str) -> np.ndarray:
    """float32 matrix whose product with the (augmented) query block is the
    ascending ranking key; built once per executor process and kept in the
    broadcast value.

    COSINE: -c/|c|  (query normalised)      -> -cos
    L2:     [-2c, |c|^2] (query gets a 1)   -> |c|^2 - 2 q.c  (= key - |q|^2)
    IP:     -c                              -> -q.c
    """
    key = "_prep_" + metric
    if key not in m:
        mat, norms = m["mat"], m["norms"]
        prep = np.empty((len(mat), mat.shape[1] + (metric == V.L2)), np.float32)
        for s in range(0, len(mat), SLICE_ROWS):
            c, n = mat[s:s + SLICE_ROWS].astype(np.float64), norms[s:s + SLICE_ROWS, None]
            if metric == V.COSINE:
                p = -(c / n)
            elif metric == V.L2:
                p = np.concatenate([-2.0 * c, n], axis=1)
            else:
                p = -c
            prep[s:s + SLICE_ROWS] = p.astype(np.float32)
        m[key] = prep
    return m[key]


def _shortlist_merge(best_key, best_idx, key, s, k2):
    """Best k2 of the tile (selected in place), then merged with the running
    best - the full tile is never copied.  ``s``: the tile's first row, or its rows."""
    if key.shape[1] > k2:
        part = np.argpartition(key, k2 - 1, axis=1)[:, :k2]
        key = np.take_along_axis(key, part, axis=1)
        idx = part.astype(np.int64) + s if np.isscalar(s) else s[part]
    else:
        idx = np.broadcast_to(np.arange(s, s + key.shape[1], dtype=np.int64) if np.isscalar(s) else s, key.shape)
    allk = np.concatenate([best_key, key], axis=1)
    alli = np.concatenate([best_idx, idx], axis=1)
    if allk.shape[1] <= k2:
        return allk, alli
    part = np.argpartition(allk, k2 - 1, axis=1)[:, :k2]
    return np.take_along_axis(allk, part, axis=1), np.take_along_axis(alli, part, axis=1)


def score_block(q: np.ndarray, m: dict, metric: str, k: int,
                tile: int, parts: Parts | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Exact top-k of one query block against the whole matrix, or against the
    ``parts`` of it that each query wants.  Queries are taken so many at a time
    that a product holds BLOCK_SCORES at most.

    Returns (key, idx) of shape (b, k'), sorted by (key, idx); key is the
    ascending order key in float64, +inf marks "no hit".

    Fast path: one float32 BLAS product per tile yields a ranking key
    directly; the best ``k + 16`` per query form a shortlist that is
    rescored in float64 and ranked.  The float32 keys are within a bound B
    of the exact ones (a dot product of length d is off by at most
    gamma_d |q| |c|, gamma_d ~ d 2^-24, plus the roundings of the prepared
    matrix), so no candidate outside the shortlist can enter the top-k when
    the shortlist's last key exceeds the k-th one by more than 2B.  Rows
    that cannot be certified so are recomputed fully in float64: results
    equal the float64 computation.
    """
    b, n = q.shape[0], m["mat"].shape[0]
    kk = min(k, n)
    if b == 0 or kk == 0:
        return np.full((b, 0), np.inf), np.zeros((b, 0), dtype=np.int64)
    step = max(1, BLOCK_SCORES // max(1, min(tile, n)))
    if b > step and parts is None:
        out = [score_block(q[s:s + step], m, metric, k, tile) for s in range(0, b, step)]
        return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])
    d = q.shape[1]
    k2 = min(n, kk + SHORTLIST_SLACK)
    prep = _prepared(m, metric)
    qabs = np.sqrt(np.einsum("ij,ij->i", q, q))
    if metric == V.COSINE:
        with np.errstate(divide="ignore", invalid="ignore"):
            qa = (q / qabs[:, None]).astype(np.float32)
    elif metric == V.L2:
        qa = np.concatenate([q, np.ones((b, 1))], axis=1).astype(np.float32)
    else:
        qa = q.astype(np.float32)
    if parts is None:
        best_key = np.full((b, 0), np.inf, dtype=np.float32)
        best_idx = np.zeros((b, 0), dtype=np.int64)
        for s in range(0, n, tile):
            e = min(n, s + tile)
            best_key, best_idx = _shortlist_merge(best_key, best_idx, qa @ prep[s:e].T, s, k2)
        scored = np.full(b, n)
    else:
        best_key = np.full((b, k2), np.inf, dtype=np.float32)
        best_idx = np.zeros((b, k2), dtype=np.int64)
        for cols, rows in parts.tiles(tile):
            c = prep[cols].T
            for s in range(0, len(rows), step):
                r = rows[s:s + step]
                best_key[r], best_idx[r] = _shortlist_merge(best_key[r], best_idx[r], qa[r] @ c, cols, k2)
        scored = parts.want @ np.diff(parts.start)
    best_key = best_key.astype(np.float64)
    best_key[~np.isfinite(best_key)] = np.inf
    o = np.argsort(best_key, axis=1, kind="stable")
    best_key = np.take_along_axis(best_key, o, axis=1)
    best_idx = np.take_along_axis(best_idx, o, axis=1)
    # Bound B of |float32 key - exact key| per query (generous constants).
    gamma = 2.0 * (d + 4) * F32_UNIT
    cmax = m["cmax"]
    if metric == V.COSINE:
        bound = np.full(b, 3.0 * gamma)
    elif metric == V.L2:
        bound = 2.0 * gamma * (qabs * cmax + cmax * cmax + 1.0)
    else:
        bound = gamma * (qabs * cmax + 1.0)
    kth = best_key[:, kk - 1]
    # Only finite keys certify anything; products that could leave the float32
    # range are left to float64.
    fits = (qabs * cmax < 1e36) & (cmax * cmax < 1e36) & (qabs < 1e36)
    if metric == V.COSINE:
        fits = qabs > 0
    certain = fits & ((scored <= k2) | (np.isfinite(kth) & (best_key[:, k2 - 1] > kth + 2.0 * bound)))
    # Exact rescoring of the shortlist in float64.
    out_key = np.full((b, kk), np.inf)
    out_idx = np.zeros((b, kk), dtype=np.int64)
    qn = _query_norms(q, metric)
    ok_rows = np.nonzero(certain)[0]
    for c0 in range(0, len(ok_rows), 256):
        rows = ok_rows[c0:c0 + 256]
        ids = best_idx[rows]
        cand = m["mat"][ids].astype(np.float64)                # (r, k2, d)
        with np.errstate(divide="ignore", invalid="ignore"):
            if metric == V.COSINE:
                key = -(np.einsum("rkd,rd->rk", cand, q[rows]) / (qn[rows][:, None] * m["norms"][ids]))
            elif metric == V.L2:
                cand -= q[rows][:, None, :]
                key = np.einsum("rkd,rkd->rk", cand, cand)
            else:
                key = -np.einsum("rkd,rd->rk", cand, q[rows])
        key[~np.isfinite(key) | ~np.isfinite(best_key[rows])] = np.inf
        key, ids = _sorted(key, ids)
        out_key[rows], out_idx[rows] = key[:, :kk], ids[:, :kk]
    redo = np.nonzero(~certain & ((qabs > 0) | (metric != V.COSINE)))[0]
    if len(redo):
        rk, ri = _score_block_f64(q[redo], m, metric, k, tile, parts and parts.rows(redo))
        out_key[redo], out_idx[redo] = rk, ri
    return out_key, out_idx


def _key_to_distance_score(key: np.ndarray, metric: str):
    if metric == V.L2:
        d = key
        return d, 1.0 / (1.0 + d)
    d = -key
    if metric == V.COSINE:
        return d, (d + 1.0) / 2.0
    return d, np.clip(d, 0.0, 1.0)


_BLAS_LIMITED = []


def limit_blas_threads() -> None:
    """One BLAS thread per task, once per Python worker, unless the platform
    already chose (``OPENBLAS_NUM_THREADS``).  Each Spark task owns one core;
    nested BLAS threads only oversubscribe it.  Best effort, no effect on
    results."""
    if _BLAS_LIMITED:
        return
    _BLAS_LIMITED.append(True)
    import os
    if os.environ.get("OPENBLAS_NUM_THREADS"):
        return
    try:
        import ctypes
        import glob
        libdir = os.path.dirname(np.__file__) + ".libs"
        for path in glob.glob(os.path.join(libdir, "*openblas*.so*")):
            lib = ctypes.CDLL(path)
            for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads"):
                if hasattr(lib, name):
                    getattr(lib, name)(1)
                    return
    except Exception:
        pass


def _make_scorer(bc, dim: int, metric: str, k: int, payload_names: list[str],
                 qblock: int, tile: int, out_type: T.DataType):

    def score_arrow(vectors: pa.Array) -> pa.Array:
        limit_blas_threads()
        m = bc.value
        if isinstance(vectors, pa.ChunkedArray):
            vectors = vectors.combine_chunks()
        nq = len(vectors)
        lens = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
        ok = lens == dim
        rows = np.nonzero(ok)[0]
        counts = np.zeros(nq, dtype=np.int32)
        keys, idxs = [], []
        if len(rows) and m["mat"].shape[0]:
            sub = vectors.take(pa.array(rows)) if len(rows) < nq else vectors
            q_all = pc.list_flatten(sub).to_numpy(zero_copy_only=False)
            q_all = q_all.astype(np.float64).reshape(len(rows), dim)
            for s in range(0, len(rows), qblock):
                key, idx = score_block(q_all[s:s + qblock], m, metric, k, tile)
                fin = np.isfinite(key)
                counts[rows[s:s + qblock]] = fin.sum(axis=1)
                keys.append(key[fin])                # row-major: per query, in order
                idxs.append(idx[fin])
        key = np.concatenate(keys) if keys else np.zeros(0)
        idx = np.concatenate(idxs) if idxs else np.zeros(0, dtype=np.int64)
        dist, sc = _key_to_distance_score(key, metric)
        offsets = np.zeros(nq + 1, dtype=np.int32)
        np.cumsum(counts, out=offsets[1:])
        rank = (np.arange(len(key)) - np.repeat(offsets[:-1], counts) + 1).astype(np.int32)
        take = pa.array(idx, type=pa.int64())
        arrays = [pa.array(rank, pa.int32()), m["ids"].take(take),
                  pa.array(dist, pa.float64()), pa.array(sc, pa.float64())]
        names = ["rank", "id", "distance", "score"]
        for p in payload_names:
            arrays.append(m["payload"][p].take(take))
            names.append(p)
        struct = pa.StructArray.from_arrays(arrays, names)
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), struct)

    # Deterministic in fact; declared otherwise so Catalyst never duplicates
    # the scorer into a pushed-down filter (it would run twice).
    return F.arrow_udf(score_arrow, out_type).asNondeterministic()


def _block_scorer(dim: int, metric: str, k: int, payload: list[str], qblock: int, tile: int, place: np.ndarray):
    """Top-k of one block of queries against the cells each wants of one block of candidates (cogroup).

    ``place`` is every cell's place in its block, ``want`` a query's bits over these places."""

    def run(qt: pa.Table, ct: pa.Table) -> pa.Table:
        limit_blas_threads()
        names = ["_qk", "id", "distance", "score", *payload]
        types = [pa.int64(), pa.string(), pa.float64(), pa.float64(), *(ct.schema.field(p).type for p in payload)]
        if not len(qt) or not len(ct):
            return pa.Table.from_arrays([pa.array([], t) for t in types], names=names)
        m = _arrow_matrix(ct, dim, metric, ["cell", *payload])
        part = place[m["payload"]["cell"].to_numpy(zero_copy_only=False)]
        qk = qt.column("_qk").to_numpy()
        out_k, out_i, out_d = [], [], []
        for s in range(0, len(qt), qblock):
            some = qt.slice(s, qblock)
            q = pc.list_flatten(some.column("vector").combine_chunks()).to_numpy(zero_copy_only=False)
            bits = np.frombuffer(b"".join(some.column("want").to_pylist()), np.uint8).reshape(len(some), -1)
            want = np.unpackbits(bits, axis=1, count=int(part.max()) + 1 if len(part) else 1).astype(bool)
            key, idx = score_block(q.astype(np.float64).reshape(len(some), dim), m, metric, k, tile, Parts(part, want))
            fin = np.isfinite(key)
            out_k.append(np.repeat(qk[s:s + qblock], fin.sum(axis=1)))
            out_d.append(key[fin])
            out_i.append(idx[fin])
        take = pa.array(np.concatenate(out_i), pa.int64())
        dist, sc = _key_to_distance_score(np.concatenate(out_d), metric)
        cols = [pa.array(np.concatenate(out_k), pa.int64()), m["ids"].take(take).cast(pa.string()),
                pa.array(dist, pa.float64()), pa.array(sc, pa.float64())]
        return pa.Table.from_arrays([*cols, *(m["payload"][p].take(take) for p in payload)], names=names)
    return run


# --------------------------------------------------------------------------
# Public operators
# --------------------------------------------------------------------------


class KnnPlan:
    """A candidate side prepared for searching.  Reusable across query sets."""

    def __init__(self, spark: SparkSession, cand: DataFrame, metric: str, k: int,
                 payload: list[str], payload_types: list[tuple[str, T.DataType]],
                 stats: dict, dim: int | None, budget: int):
        self.spark, self.cand, self.metric, self.k = spark, cand, metric, k
        self.payload, self.payload_types = payload, payload_types
        self.stats, self.dim, self.budget = stats, dim, budget
        self.out_type = hit_type(payload_types)
        self._broadcasts = []
        self.report: dict | None = None     # set to a dict: how many pairs a blocked search scored

    @property
    def broadcastable(self) -> bool:
        return not self.stats["n"] or self.stats["bytes"] <= self.budget

    def _scorer(self, cand: DataFrame) -> Column:
        m = _collect_matrix(cand, self.dim, self.metric, self.payload)
        if self.broadcastable:
            self.cand.unpersist()
        bc = self.spark.sparkContext.broadcast(m)
        self._broadcasts.append(bc)
        qb = conf_int(self.spark, KNN_QUERY_BLOCK, KNN_QUERY_BLOCK_DEFAULT)
        tile = conf_int(self.spark, KNN_CANDIDATE_TILE, KNN_CANDIDATE_TILE_DEFAULT)
        return _make_scorer(bc, self.dim, self.metric, self.k, self.payload, qb, tile,
                            self.out_type)

    def hits_column(self, vector: Column) -> Column:
        """Array of hits per query row (broadcast path only)."""
        if not self.broadcastable:
            raise ValueError("candidates exceed the broadcast budget; use knn_join")
        if self.dim is None:
            return F.array().cast(self.out_type)
        return self._scorer(self.cand)(vector)

    def search_blocks(self, queries: DataFrame, vector: str) -> tuple[DataFrame, DataFrame]:
        """(hits, queries) beyond the broadcast budget: candidates in cells, each
        query against the cells that can hold one of its hits (``cells.search``).

        Queries and candidates are written once with a row key of their own, so
        that repeated and null ids stay apart.  ``hits`` carries ``_qk``, the
        row key of the query.
        """
        from . import cells
        q = materialize(queries.withColumn("_qk", F.monotonically_increasing_id()), "knn-queries")
        assigned, made = cells.build(self.cand, n=self.stats["n"], dim=self.dim, metric=self.metric)
        self.cand.unpersist()
        hits = cells.search(q.select("_qk", F.col(vector).alias("vector")), assigned, made, k=self.k, dim=self.dim,
                            payload=self.payload, payload_types=self.payload_types, report=self.report,
                            row_bytes=self.stats["bytes"] / max(1, self.stats["n"]))
        return hits, q

    def search_flat(self, queries: DataFrame, query_id: str, vector: str,
                    keep: list[str] | None = None) -> DataFrame:
        """Flat hits ``(query_id, rank, id, distance, score, payload...)``."""
        keep = [c for c in (keep or []) if c != query_id]
        if self.broadcastable:
            hits = self.hits_column(F.col(vector))
            return (queries.select(F.col(query_id), *keep, F.explode(hits).alias("h"))
                    .select(query_id, *keep, "h.*"))
        top, q = self.search_blocks(queries.select(*dict.fromkeys([query_id, vector, *keep])), vector)
        return (top.join(q.select("_qk", query_id, *keep), "_qk")
                .select(query_id, *keep, "rank", "id", "distance", "score", *self.payload))

    def release(self):
        for bc in self._broadcasts:
            try:
                bc.destroy()
            except Exception:
                pass
        self._broadcasts = []


def plan_knn(candidates: DataFrame, *, k: int | None = DEFAULT_K, metric: str = V.COSINE,
             id_col: str = "id", vector_col: str = "vector",
             predicate: Column | str | None = None, payload: list[str] | None = None,
             broadcast_bytes: int | None = None, dim: int | None = None) -> KnnPlan:
    spark = candidates.sparkSession
    metric = V.normalize_metric(metric)
    k = resolve_k(k)
    payload = list(payload or [])
    cand = prepare_candidates(candidates, id_col=id_col, vector_col=vector_col,
                              metric=metric, predicate=predicate, payload=payload)
    # Measured, then collected (or tiled): computed once, kept until released.
    cand = cand.persist(StorageLevel.MEMORY_AND_DISK)
    stats = measure_candidates(cand, payload, dim)
    dim = stats["dim"]
    cand = cand.where(F.size("vector") == dim) if dim is not None else cand
    budget = broadcast_bytes or conf_int(spark, KNN_BROADCAST_BYTES, KNN_BROADCAST_BYTES_DEFAULT)
    ptypes = [(p, cand.schema[p].dataType) for p in payload]
    return KnnPlan(spark, cand, metric, k, payload, ptypes, stats, dim, budget)


def knn_join(queries: DataFrame, candidates: DataFrame, *, k: int | None = DEFAULT_K,
             metric: str = V.COSINE, query_id: str = "query_id",
             query_vector: str = "vector", candidate_id: str = "id",
             candidate_vector: str = "vector", predicate: Column | str | None = None,
             threshold: float | None = None, payload: list[str] | None = None,
             keep: list[str] | None = None,
             broadcast_bytes: int | None = None, dim: int | None = None) -> DataFrame:
    """V5-V8: exact top-k per query, flat ``(query_id, rank, id, distance, score)``.

    ``predicate`` filters candidates before ranking (V6); ``threshold`` keeps
    ``score >= threshold`` after ranking (V7).  Because score is monotone in
    rank, the survivors are a prefix and keep their 1-based ranks (V8).
    """
    if query_id == "id":
        raise ValueError("name the query key something other than 'id' (the hit column)")
    plan = plan_knn(candidates, k=k, metric=metric, id_col=candidate_id,
                    vector_col=candidate_vector, predicate=predicate, payload=payload,
                    broadcast_bytes=broadcast_bytes, dim=dim)
    out = plan.search_flat(queries, query_id, query_vector, keep=keep)
    if threshold is not None:
        out = out.where(F.col("score") >= F.lit(float(threshold)))
    return out


def knn_arrays(queries: DataFrame, candidates: DataFrame, *, output_col: str = "hits",
               k: int | None = DEFAULT_K, metric: str = V.COSINE,
               query_vector: str = "vector", query_id: str | None = None,
               candidate_id: str = "id", candidate_vector: str = "vector",
               predicate: Column | str | None = None, threshold: float | None = None,
               payload: list[str] | None = None,
               broadcast_bytes: int | None = None, dim: int | None = None) -> DataFrame:
    """Every query row keeps its columns and gains an array of hits.

    Broadcast path: a single ``select`` over the queries (no shuffle, no
    join).  Beyond the budget: blocked search, regrouped and joined back on
    a row key of its own, so both paths give every row the same hits
    (``query_id`` is not needed; it is accepted for callers that name one).
    """
    plan = plan_knn(candidates, k=k, metric=metric, id_col=candidate_id,
                    vector_col=candidate_vector, predicate=predicate, payload=payload,
                    broadcast_bytes=broadcast_bytes, dim=dim)
    thr = None if threshold is None else F.lit(float(threshold))
    if plan.broadcastable:
        hits = plan.hits_column(F.col(query_vector))
        if thr is not None:
            hits = F.filter(hits, lambda h: h["score"] >= thr)
        return queries.withColumn(output_col, hits)
    struct = F.struct("rank", "id", "distance", "score", *plan.payload)
    top, q = plan.search_blocks(queries, query_vector)
    if thr is not None:
        top = top.where(F.col("score") >= thr)
    grouped = (top.groupBy("_qk")
               .agg(F.array_sort(F.collect_list(struct)).alias("_hits"))     # k hits at most
               .withColumnRenamed("_qk", "_hk"))
    out = q.join(grouped, q["_qk"] == grouped["_hk"], "left")
    return out.select(*[q[c] for c in queries.columns if c != output_col],
                      F.coalesce("_hits", F.array().cast(plan.out_type)).alias(output_col))
