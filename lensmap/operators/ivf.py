"""IVF search (V11): inverted lists of k-means cells, probed until nothing can win.

Build: k-means centres (fitted on a bounded sample, see ``cells``), every
candidate in the list of its nearest centre, count and radius of every list.

Search: by default a query's cells are probed until the bound of every other
cell is behind its k-th hit, so the result equals the exact join (V5); how many
candidates were scored is reported.  ``nprobe`` fixes the number of probed cells
instead and trades recall for work.  Cells and queries meet in groups of bounded
size (``cells.score_probes``), however skewed the lists are.

An index of a collection is kept beside it by version: ``collection_index``
builds it once per version and number of lists, and reads it afterwards.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vector as V
from ..session import materialize
from . import cells as C
from . import knn

KEPT = "_index"                 # folder of a collection's indexes


@dataclass
class IvfIndex:
    assigned: DataFrame       # (id, vector, cell, off = distance from the centre, _ck = row key)
    cells: C.Cells            # centres, counts, radii
    metric: str
    nlist: int
    dim: int


def build_ivf(candidates: DataFrame, *, nlist: int, metric: str = V.COSINE,
              id_col: str = "id", vector_col: str = "vector", seed: int = 7,
              max_iter: int = 20, dim: int | None = None) -> IvfIndex:
    """Candidates without a direction (COSINE) or with non-finite parts have no cell and no score."""
    metric = V.normalize_metric(metric)
    cand = knn.prepare_candidates(candidates, id_col=id_col, vector_col=vector_col)
    stats = knn.measure_candidates(cand, dim=dim)
    dim = dim or stats["dim"]
    if not dim:
        raise ValueError("an index needs candidates, or dim")
    assigned, made = C.build(cand, n=stats["n"], dim=dim, metric=metric, n_cells=nlist, seed=seed, max_iter=max_iter)
    return IvfIndex(assigned, made, metric, len(made.centers), dim)


def ivf_search(queries: DataFrame, index: IvfIndex, *, k: int = knn.DEFAULT_K, nprobe: int | None = None,
               query_id: str = "query_id", query_vector: str = "vector", block: int | None = None,
               query_block: int | None = None, report: dict | None = None) -> DataFrame:
    """Top-k per query, exact unless ``nprobe`` limits the probed cells.

    Returns ``(query_id, rank, id, distance, score)`` like :func:`knn.knn_join`.
    ``report`` (a dict) receives ``scored`` and ``pairs``, see ``cells.search``.
    """
    k = knn.resolve_k(k)
    q = materialize(queries.select(F.col(query_id).cast("string").alias(query_id), F.col(query_vector).alias("vector"),
                                   F.monotonically_increasing_id().alias("_qk")), "ivf-queries")
    nprobe = None if nprobe is None else max(1, min(int(nprobe), index.nlist))
    hits = C.search(q.select("_qk", "vector"), index.assigned, index.cells, k=k, dim=index.dim, block=block,
                    query_block=query_block, nprobe=nprobe, report=report)
    return hits.join(q.select("_qk", query_id), "_qk").select(query_id, "rank", "id", "distance", "score")


def save_ivf(index: IvfIndex, path: str) -> None:
    """Write an index; it is complete once its cells, written last, are."""
    spark = index.assigned.sparkSession
    index.assigned.write.parquet(f"{path}/lists")
    c = index.cells
    rows = [(i, index.metric, [float(x) for x in c.centers[i]], int(c.count[i]), float(c.radius[i])) for i in range(len(c.centers))]
    spark.createDataFrame(rows, "cell int, metric string, center array<double>, n long, radius double").coalesce(1) \
        .write.parquet(f"{path}/cells")


def load_ivf(spark: SparkSession, path: str) -> IvfIndex:
    rows = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()      # one row a cell
    centers = np.array([r["center"] for r in rows])
    made = C.Cells(rows[0]["metric"], centers, np.array([r["n"] for r in rows]), np.array([r["radius"] for r in rows]))
    return IvfIndex(spark.read.parquet(f"{path}/lists"), made, made.metric, len(rows), centers.shape[1])


def collection_index(store, name: str, nlist: int) -> IvfIndex:
    """The index of a collection's current version, built and kept if it is not there yet."""
    m = store.manifest(name)
    home = store._path(name, KEPT)
    prefix = f"{m['version']}-{nlist}-"
    for st in store._fs.listStatus(home) if store._fs.exists(home) else []:
        found = st.getPath()
        if found.getName().startswith(prefix) and store._fs.exists(store._Path(found, "cells/_SUCCESS")):
            return load_ivf(store.spark, found.toString())
    index = build_ivf(store.read(name, ["id", "vector"], manifest=m), nlist=nlist, metric=m["metric"], dim=m["dim"])
    path = f"{store.root}/{name}/{KEPT}/{prefix}{uuid.uuid4().hex[:12]}"
    save_ivf(index, path)
    return load_ivf(store.spark, path)
