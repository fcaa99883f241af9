"""Vector metrics as Spark column expressions (V1-V4).

These run JVM-side with higher-order functions and are meant for scoring
given pairs (a re-score, validation, a single query).  The many-to-many
nearest-neighbour search lives in :mod:`lensmap.operators.knn`, which scores
whole blocks with a matrix product instead of pair rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Metric names as the collection settings spell them.
COSINE = "COSINE"
L2 = "L2"
IP = "IP"
METRICS = (COSINE, L2, IP)


def normalize_metric(metric: str | None) -> str:
    m = (metric or COSINE).upper()
    if m in ("COSINE", "COS"):
        return COSINE
    if m in ("L2", "EUCLIDEAN"):
        return L2
    # Any other name is scored like an inner product and clamped (V3/V4).
    return IP


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a, b) -> Column:
    """Inner product in DOUBLE; null when either side is null or lengths differ."""
    a, b = _c(a), _c(b)
    prods = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    s = F.aggregate(prods, F.lit(0.0).cast("double"), lambda acc, x: acc + x)
    return F.when(F.size(a) == F.size(b), s)


def norm(a) -> Column:
    a = _c(a)
    return F.sqrt(F.aggregate(a, F.lit(0.0).cast("double"),
                              lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine_similarity(a, b) -> Column:
    """V1: cosine similarity in [-1, 1]; null for a zero vector or length mismatch."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def l2_squared(a, b) -> Column:
    """V2: squared Euclidean distance (what the vector store reports for L2)."""
    a, b = _c(a), _c(b)
    diffs = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")))
    s = F.aggregate(diffs, F.lit(0.0).cast("double"), lambda acc, x: acc + x * x)
    return F.when(F.size(a) == F.size(b), s)


def distance(a, b, metric: str) -> Column:
    """The raw 'distance' the store reports for ``metric`` (V1/V2/V3)."""
    m = normalize_metric(metric)
    if m == COSINE:
        return cosine_similarity(a, b)
    if m == L2:
        return l2_squared(a, b)
    return dot(a, b)


def score(distance_col, metric: str) -> Column:
    """V4: normalised score in [0, 1] from a raw distance."""
    d = _c(distance_col)
    m = normalize_metric(metric)
    if m == COSINE:
        return (d + F.lit(1.0)) / F.lit(2.0)
    if m == L2:
        return F.lit(1.0) / (F.lit(1.0) + d)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), d))


def order_key(distance_col, metric: str) -> Column:
    """Ascending sort key: smaller is nearer, for every metric."""
    d = _c(distance_col)
    return d if normalize_metric(metric) == L2 else -d
