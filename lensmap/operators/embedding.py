"""Embedding stage (E1-E8) and the embedding cache.

Flow for a record set (E2)::

    records --md5--> distinct non-blank (text_hash, text)          E4
            --anti join cache(text_hash, model)--> misses           E3
            --embedder, in waves that are saved--> vectors          E1, E5
            --union cache hits--> join back on text_hash            E2
            --embedding IS NULL--> dropped + reported               E6

The text is hashed once, each distinct text is embedded once per model, the
model runs only on cache misses, and the per-record join is an equi-join on
``text_hash`` (AQE splits a hot hash, e.g. many empty feedbacks, on the
record side; the vector side holds one row per hash).
"""

from __future__ import annotations

import hashlib
import math
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as TX
from ..session import ensure_checkpoint_dir
from ..session import materialize as materialize_df
from .partitioning import spread

VECTOR_TYPE = T.ArrayType(T.FloatType(), containsNull=False)
EMBED_SCHEMA = T.StructType([
    T.StructField("text_hash", T.StringType(), False),
    T.StructField("embedding", VECTOR_TYPE, True),
    T.StructField("attempts", T.IntegerType(), False),
    T.StructField("errors", T.IntegerType(), False),
    T.StructField("seconds", T.DoubleType(), False),
    T.StructField("error", T.StringType(), True),
])

# Fixed values for the built-in hashing embedder.
HASH_BASE = 1_000_003          # polynomial base over code points
HASH_MODULUS = 2_147_483_647   # prime 2^31-1; bucket = (g mod M) mod dim
BLOCK_BYTES = 1 << 20          # text hashed at once
CACHE_BUCKETS = 32             # buckets of a new cache (more for one of many GB)
TEXTS_PER_WAVE = 50_000        # texts a real model embeds between two saves of the cache
DEFAULT_RETRIES = 3            # attempts per text (E5)
DEFAULT_BACKOFF = 1.0          # seconds; waits 1 s, 2 s between attempts


def is_blank(text) -> Column:
    """``not text or not text.strip()``: null, empty or whitespace only."""
    return TX.is_blank(text)


# ---------------------------------------------------------------------------
# Deterministic character n-gram hashing embedder (Arrow UDF)
# ---------------------------------------------------------------------------

def _hash_vectors(texts: pa.Array, dim: int, n: int) -> pa.Array:
    """L2-normalised counts of hashed character n-grams, one list per text.

    A text shorter than n counts as one n-gram padded with code point 0.
    Blank/null texts give null (they are never embedded).
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    rows = len(texts)
    if not rows:
        return pa.ListArray.from_arrays(pa.array([0], pa.int32()), pa.array([], pa.float32()))
    flat = np.zeros((rows, dim), dtype=np.float32)
    valid = np.zeros(rows, dtype=bool)
    # Blocks of bounded text and count matrix (a longer text stands alone).
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    r0, step = 0, max(1, (1 << 22) // dim)
    while r0 < rows:
        done = size[r0 - 1] if r0 else 0
        r1 = min(r0 + step, max(r0 + 1, int(np.searchsorted(size, done + BLOCK_BYTES, side="right"))))
        flat[r0:r1], valid[r0:r1] = _hash_block(texts.slice(r0, r1 - r0).to_pylist(), dim, n)
        r0 = r1
    offsets = pa.array(np.arange(0, (rows + 1) * dim, dim, dtype=np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(flat.ravel()), mask=pa.array(~valid))


def _hash_block(texts: list, dim: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, valid) of a block: all texts' code points as one array, one
    bincount over row x bucket; grams that would cross two texts are masked."""
    ok = np.array([t is not None and bool(t.strip()) for t in texts], dtype=bool)
    size = np.array([len(t) if k else 0 for t, k in zip(texts, ok)], dtype=np.int64)
    padded = np.where(ok, np.maximum(size, n), 0)       # short texts end in code point 0
    cps = np.zeros(int(padded.sum()), dtype=np.int64)
    row = np.repeat(np.arange(len(texts)), padded)
    first = np.cumsum(padded) - padded
    inside = np.arange(len(cps)) - first[row]
    cps[inside < size[row]] = np.frombuffer(
        "".join(t for t, k in zip(texts, ok) if k).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    w = max(0, len(cps) - n + 1)
    g = np.zeros(w, dtype=np.int64)
    for j in range(n):
        g += cps[j:j + w] * HASH_BASE ** (n - 1 - j)
    whole = inside[:w] <= padded[row[:w]] - n
    cell = row[:w][whole] * dim + (g[whole] % HASH_MODULUS) % dim
    cnt = np.bincount(cell, minlength=len(texts) * dim).reshape(len(texts), dim).astype(np.float64)
    norm = np.sqrt(np.einsum("ij,ij->i", cnt, cnt))
    return (cnt / np.where(norm > 0, norm, 1.0)[:, None]).astype(np.float32), ok


class HashEmbedder:
    """Character n-gram feature hashing; deterministic, model-free.

    Plays the role of the embedding model in tests and benchmarks.  It is a
    per-text function, so it runs as a column expression (Arrow UDF) with no
    shuffle; the same hash can be written in SQL for oracle checks.
    """

    def __init__(self, dim: int = 128, n: int = 3):
        if n < 1 or n > 3:
            raise ValueError("n must be 1..3 (keeps the polynomial hash inside int64)")
        self.dim, self.n = int(dim), int(n)
        self.model = f"hash-{self.n}gram-{self.dim}"
        self.expensive = False

    def column(self, text) -> Column:
        dim, n = self.dim, self.n

        def embed_arrow(texts: pa.Array) -> pa.Array:
            return _hash_vectors(texts, dim, n)

        # The function is deterministic; declaring it otherwise stops Catalyst
        # from copying it into a pushed-down filter (an expensive UDF would
        # then run twice).  Retried tasks recompute identical vectors.
        udf = F.arrow_udf(embed_arrow, VECTOR_TYPE).asNondeterministic()
        return udf(F.col(text) if isinstance(text, str) else text)

    def embed(self, texts: DataFrame) -> DataFrame:
        """(text_hash, text) -> EMBED_SCHEMA rows; never fails, never retries."""
        return texts.select(
            "text_hash", self.column("text").alias("embedding"),
            F.lit(1).alias("attempts"), F.lit(0).alias("errors"),
            F.lit(0.0).alias("seconds"), F.lit(None).cast("string").alias("error"))


# ---------------------------------------------------------------------------
# E1a + E5: user-supplied model behind mapInPandas, with retries
# ---------------------------------------------------------------------------

class FunctionEmbedder:
    """Wrap a batch embedding function ``list[str] -> list[list[float] | None]``.

    ``client_factory`` (optional) is called once per partition and its result
    passed as ``client=`` to the function - connections are opened per task,
    not per row.  When a batch of several texts fails, its texts are tried one
    by one, ``retries`` attempts each (the shared call is not an attempt of a
    text alone); a batch of one text is that text's first attempt.  Before
    attempt a + 1 the task waits ``backoff * 2**(a - 1)`` seconds; a text that
    still fails gets a null embedding and its whole error (E5, E6).
    ``dim`` is the length of the model's vectors (needed to create
    collections); a vector of another length counts as a failed attempt.
    ``partitions`` sets how many tasks call the model at once.
    """

    def __init__(self, fn: Callable, model: str, *, batch_size: int = 32,
                 retries: int = DEFAULT_RETRIES, backoff: float = DEFAULT_BACKOFF,
                 client_factory: Callable | None = None, partitions: int | None = None,
                 dim: int | None = None):
        self.fn, self.model, self._dim = fn, model, dim
        self.batch_size, self.retries, self.backoff = batch_size, retries, backoff
        self.client_factory, self.partitions = client_factory, partitions
        self.expensive = True

    @property
    def dim(self) -> int:
        """Vector length: as given, else that of one probe text's vector."""
        if self._dim is None:
            client = self.client_factory() if self.client_factory else None
            vec = (self.fn(["dim"], client=client) if self.client_factory else self.fn(["dim"]))[0]
            if vec is None:
                raise ValueError("the model gave no vector for the probe text; pass dim")
            self._dim = len(vec)
        return self._dim

    def embed(self, texts: DataFrame) -> DataFrame:
        fn, bs, retries, backoff = self.fn, self.batch_size, self.retries, self.backoff
        factory, dim = self.client_factory, self._dim

        def call(client, batch):
            res = list(fn(batch, client=client) if factory else fn(batch))
            if len(res) != len(batch):
                raise ValueError("embedder returned a different number of vectors")
            for v in res:
                if dim is not None and v is not None and len(v) != dim:
                    raise ValueError(f"vector length {len(v)} is not {dim}")
            return res

        def run(batches):
            client = factory() if factory else None
            for pdf in batches:
                hashes = pdf["text_hash"].tolist()
                texts_ = pdf["text"].tolist()
                emb, att, errs, secs, msg = [], [], [], [], []
                for s in range(0, len(texts_), bs):
                    chunk = texts_[s:s + bs]
                    t0 = time.time()
                    why = None
                    try:
                        res = call(client, chunk)
                    except Exception as ex:  # whole batch failed: go text by text
                        res, why = [None] * len(chunk), f"{type(ex).__name__}: {ex}"
                    dt = time.time() - t0
                    alone = len(chunk) == 1          # its batch call was the first attempt
                    for i, text in enumerate(chunk):
                        vec, a, e, sec, m = res[i], 1, 0, dt / len(chunk), None
                        if vec is None:
                            a = e = 1 if alone else 0
                            sec, m = 0.0, (why or "ValueError: no vector returned") if alone else None
                            while a < retries:
                                if a and backoff > 0:
                                    time.sleep(backoff * (2 ** (a - 1)))
                                a += 1
                                t1 = time.time()
                                try:
                                    vec = call(client, [text])[0]
                                    if vec is None:
                                        raise ValueError("no vector returned")
                                    sec += time.time() - t1
                                    m = None
                                    break
                                except Exception as ex:  # counted per failed attempt
                                    e += 1
                                    m = f"{type(ex).__name__}: {ex}"
                                    vec = None
                        emb.append(None if vec is None else np.asarray(vec, dtype=np.float32))
                        att.append(a)
                        errs.append(e)
                        secs.append(sec)
                        msg.append(m)
                yield pd.DataFrame({"text_hash": hashes, "embedding": emb, "attempts": att,
                                    "errors": errs, "seconds": secs, "error": msg})

        src = texts.select("text_hash", "text")
        if self.partitions:
            src = src.repartition(self.partitions)
        return src.mapInPandas(run, EMBED_SCHEMA)


# ---------------------------------------------------------------------------
# Embedding cache as a Parquet table partitioned by model
# ---------------------------------------------------------------------------

CACHE_SCHEMA = T.StructType([
    T.StructField("text_hash", T.StringType(), False),
    T.StructField("embedding", VECTOR_TYPE, True),
    T.StructField("model", T.StringType(), False),
    T.StructField("ts", T.DoubleType(), False),
])


def model_key(model: str) -> str:
    """Partition value for a model name: any name, safe as a folder name."""
    return "".join(ch if ch.isalnum() or ch in "._-" else "_" for ch in model)


class EmbeddingCache:
    """Hash-keyed cache of embeddings on shared storage, bucketed by hash.

    Layout: ``<path>/model_key=<escaped model>/gen=<n>-<buckets>/*.parquet`` with
    columns ``(text_hash, embedding, model, ts)``, an external Spark table
    clustered by ``text_hash``.  Joins and aggregates by hash therefore move the
    batch's hashes only, never the cache.  Saving writes hashes that are not
    there yet, one file a bucket; ``compact`` rewrites the entries as the next
    generation, which takes over once it is complete.  ``enabled=False`` turns
    the cache off.
    """

    def __init__(self, spark: SparkSession, path: str, model: str, enabled: bool = True, num_buckets: int = CACHE_BUCKETS):
        self.spark, self.path, self.model, self.enabled = spark, path.rstrip("/"), model, enabled
        self.num_buckets = num_buckets
        self._Path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _generations(self) -> list[tuple[int, int]]:
        """Complete generations as (number, buckets), oldest first."""
        home = self._Path(f"{self.path}/model_key={model_key(self.model)}")
        if not self._fs.exists(home):
            return []
        found = []
        for st in self._fs.listStatus(home):
            name = st.getPath().getName()
            if name.startswith("gen=") and self._fs.exists(self._Path(st.getPath(), "_SUCCESS")):
                found.append(tuple(int(x) for x in name[4:].split("-")))
        return sorted(found)

    def _table(self, generation: int, buckets: int) -> str:
        """Name of the external table over a generation, known to this session."""
        where = f"{self.path}/model_key={model_key(self.model)}/gen={generation}-{buckets}"
        name = "lensmap_cache_" + hashlib.md5(where.encode("utf-8")).hexdigest()[:16]
        place = where.replace("\\", "\\\\").replace("'", "\\'")
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (text_hash STRING, embedding ARRAY<FLOAT>, model STRING, ts DOUBLE) "
                       f"USING parquet CLUSTERED BY (text_hash) SORTED BY (text_hash) INTO {buckets} BUCKETS LOCATION '{place}'")
        self.spark.catalog.refreshTable(name)
        return name

    def _entries(self) -> DataFrame | None:
        """Saved rows of this model (a hash may stand twice after two saves at once); None without a cache."""
        have = self._generations() if self.enabled else []
        return self.spark.table(self._table(*have[-1])).where(F.col("model") == self.model) if have else None

    def load(self, hashes: DataFrame | None = None) -> DataFrame:
        """Entries for this model, one per text_hash (the latest wins).

        ``hashes`` (a ``text_hash`` column) restricts the cache to the texts at
        hand: they are dealt into the cache's buckets (or broadcast, if small),
        and the latest entry is taken inside a bucket.
        """
        raw = self._entries()
        if raw is None:
            return self.spark.createDataFrame([], CACHE_SCHEMA)
        if hashes is not None:
            raw = raw.join(hashes.select("text_hash"), "text_hash", "left_semi")
        return (raw.groupBy("text_hash")
                .agg(F.max_by("embedding", "ts").alias("embedding"), F.max("ts").alias("ts"))
                .select("text_hash", "embedding", F.lit(self.model).alias("model"), "ts"))

    def _insert(self, rows: DataFrame, generation: int, buckets: int) -> None:
        """Append (text_hash, embedding, ts) rows, a file per bucket."""
        (rows.select("text_hash", "embedding", F.lit(self.model).alias("model"), "ts")
         .repartition(buckets, "text_hash").sortWithinPartitions("text_hash").write.insertInto(self._table(generation, buckets)))

    def save(self, fresh: DataFrame) -> None:
        """Add successful entries whose hash is not in the cache; a no-op
        when disabled.  Saving the same rows again changes nothing."""
        if not self.enabled:
            return
        have = self._generations()
        generation, buckets = have[-1] if have else (0, self.num_buckets)
        rows = (fresh.where(F.col("embedding").isNotNull()).select("text_hash", "embedding")
                .withColumn("ts", F.unix_micros(F.current_timestamp()) / 1e6))
        if have:
            known = self.spark.table(self._table(generation, buckets)).where(F.col("model") == self.model)
            rows = rows.join(known.select("text_hash"), "text_hash", "left_anti")
        self._insert(rows.dropDuplicates(["text_hash"]), generation, buckets)

    def compact(self, num_buckets: int | None = None) -> None:
        """Rewrite the cache as a new generation: one entry per hash, one file per
        bucket (and another number of buckets, if given); older ones are removed.
        No other writer may be active."""
        have = self._generations()
        if not have:
            return
        buckets = num_buckets or have[-1][1]
        rows = (self.spark.table(self._table(*have[-1])).groupBy("text_hash", "model")
                .agg(F.max_by("embedding", "ts").alias("embedding"), F.max("ts").alias("ts")))
        generation = have[-1][0] + 1
        target = self._Path(f"{self.path}/model_key={model_key(self.model)}/gen={generation}-{buckets}")
        self._fs.delete(target, True)            # of a run that died
        (rows.select("text_hash", "embedding", "model", "ts").repartition(buckets, "text_hash").sortWithinPartitions("text_hash")
         .write.insertInto(self._table(generation, buckets)))
        for old in have:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._table(*old)}")
            self._fs.delete(self._Path(f"{self.path}/model_key={model_key(self.model)}/gen={old[0]}-{old[1]}"), True)


# ---------------------------------------------------------------------------
# The embed stage over a record set
# ---------------------------------------------------------------------------

@dataclass
class EmbedResult:
    records: DataFrame      # input + text_hash + embedding (null: blank or failed)
    vectors: DataFrame      # text_hash, embedding, source ('cache'|'model'), attempts, errors, seconds, error
    fresh: DataFrame        # newly embedded rows (to be cached)
    embedded: DataFrame     # records with an embedding (E6 keep)
    failed: DataFrame       # records without one, with the reason (E6 report)
    out_col: str = "embedding"


def _in_waves(misses: DataFrame, n: int, embedder, cache: EmbeddingCache, per_wave: int) -> DataFrame:
    """``n`` texts embedded in waves of about ``per_wave``, each written and saved
    to the cache before the next begins.  A job that dies loses the calls of one
    wave at most; run again, it finds the finished waves in the cache.  Texts are
    dealt to waves by their hash and written by wave once, so a wave reads its own.
    """
    waves = max(1, math.ceil(n / max(1, per_wave)))
    spark = misses.sparkSession
    base = f"{ensure_checkpoint_dir(spark)}/lensmap-embed-waves-{uuid.uuid4().hex}"
    todo, done = f"{base}/texts", f"{base}/vectors"
    (misses.withColumn("wave", F.pmod(F.xxhash64("text_hash"), F.lit(waves)).cast("int"))
     .write.partitionBy("wave").parquet(todo))
    texts = spark.read.schema("text_hash string, text string, wave int").parquet(todo)
    for w in range(waves):
        some = texts.where(F.col("wave") == w).drop("wave")
        if not getattr(embedder, "partitions", None):
            some = spread(some)
        embedder.embed(some).write.parquet(f"{done}/wave={w}")
        cache.save(spark.read.schema(EMBED_SCHEMA).parquet(f"{done}/wave={w}"))
    return spark.read.schema(EMBED_SCHEMA).parquet(done)


def embed_records(records: DataFrame, text_col: str, embedder, *,
                  cache: EmbeddingCache | None = None,
                  out_col: str = "embedding", materialize: bool = True,
                  texts_per_wave: int = TEXTS_PER_WAVE) -> EmbedResult:
    """Embed every record's text once per distinct text, cache first.

    With a cache, a real model works in waves of ``texts_per_wave`` whose results
    are saved at once (``_in_waves``).

    ``materialize`` writes the records with their text and hash once to a
    table in the shared checkpoint folder: the dedup, the join back and the statistics
    read it instead of re-running the text expressions (and Catalyst cannot
    push an expensive filter into the scan and evaluate it twice).
    """
    rec = records.withColumn("text_hash", F.when(~is_blank(text_col), TX.text_hash(text_col)))
    if cache is None and not getattr(embedder, "expensive", True) and hasattr(embedder, "column"):
        return _embed_inline(rec, text_col, embedder, out_col)
    if materialize:
        rec = materialize_df(rec, "embed-records")
    known = rec.where(F.col("text_hash").isNotNull())
    if cache is None:
        hits = None
        misses = known.select("text_hash", F.col(text_col).alias("text")).dropDuplicates(["text_hash"])   # E4
    else:
        # Hashes alone are made distinct and looked up, once; a text is
        # fetched only for a hash that the cache does not hold.
        hashes = materialize_df(known.select("text_hash").distinct(), "embed-hashes")
        cached = materialize_df(cache.load(hashes), "embed-hits")
        hits = cached.select("text_hash", "embedding", F.lit("cache").alias("source"),
                             F.lit(0).alias("attempts"), F.lit(0).alias("errors"),
                             F.lit(0.0).alias("seconds"), F.lit(None).cast("string").alias("error"))
        missing = hashes.join(cached.select("text_hash"), "text_hash", "left_anti")
        if getattr(embedder, "expensive", False):
            missing = materialize_df(missing, "embed-missing")
        misses = (known.select("text_hash", F.col(text_col).alias("text"))
                  .join(missing, "text_hash", "left_semi").dropDuplicates(["text_hash"]))
    # A real model is called once: the join-back, the cache write and the
    # statistics all read written tables (shared storage).
    if not getattr(embedder, "expensive", False):
        fresh = embedder.embed(misses)
    elif cache is None or not cache.enabled:
        fresh = materialize_df(embedder.embed(misses), "embed-fresh")
    else:
        fresh = _in_waves(misses, missing.count(), embedder, cache, texts_per_wave)
    fresh = fresh.withColumn("source", F.lit("model"))
    vectors = fresh.select("text_hash", "embedding", "source", "attempts", "errors",
                           "seconds", "error")
    if hits is not None:
        vectors = vectors.unionByName(hits)
    joined = rec.join(vectors.select("text_hash", F.col("embedding").alias(out_col),
                                     F.col("error").alias("_embed_error")),
                      "text_hash", "left")
    embedded = joined.where(F.col(out_col).isNotNull()).drop("_embed_error")
    failed = (joined.where(F.col(out_col).isNull())
              .withColumn("reason", F.when(F.col("text_hash").isNull(), F.lit("blank text"))
                          .otherwise(F.coalesce(F.col("_embed_error"), F.lit("embedding failed"))))
              .drop(out_col, "_embed_error"))
    return EmbedResult(joined.drop("_embed_error"), vectors, fresh, embedded, failed, out_col)


def _embed_inline(rec: DataFrame, text_col: str, embedder, out_col: str) -> EmbedResult:
    """A cheap deterministic embedder without a cache: embedding a text costs
    less than deduplicating and joining it back, so every record is embedded
    in place - one pass, no shuffle.  ``vectors`` (one row per distinct
    hash, for the statistics) is only computed if asked for."""
    joined = rec.withColumn(out_col, embedder.column(text_col))
    vectors = (joined.where(F.col("text_hash").isNotNull())
               .select("text_hash", F.col(out_col).alias("embedding"))
               .dropDuplicates(["text_hash"])
               .select("text_hash", "embedding", F.lit("model").alias("source"),
                       F.lit(1).alias("attempts"), F.lit(0).alias("errors"),
                       F.lit(0.0).alias("seconds"), F.lit(None).cast("string").alias("error")))
    embedded = joined.where(F.col(out_col).isNotNull())
    failed = (joined.where(F.col(out_col).isNull())
              .withColumn("reason", F.when(F.col("text_hash").isNull(), F.lit("blank text"))
                          .otherwise(F.lit("embedding failed")))
              .drop(out_col))
    return EmbedResult(joined, vectors, vectors.drop("source"), embedded, failed, out_col)


def embed_stats(records: DataFrame, vectors: DataFrame,
                embedding_col: str = "embedding") -> DataFrame:
    """E7/E8 as one row.

    Blank texts are neither hits nor misses; misses = distinct uncached
    hashes; hits = the other non-blank records; every failed attempt is an
    error; ``avg_processing_time = processing_time / max(1, generated)``.
    """
    r = records.agg(F.count(F.lit(1)).alias("total_count"),
                    F.count("text_hash").alias("requests"),
                    F.count(F.col(embedding_col)).alias("success_count"))
    v = vectors.where(F.col("source") == "model").agg(
        F.count(F.lit(1)).alias("cache_misses"),
        F.count("embedding").alias("embeddings_generated"),
        F.coalesce(F.sum("errors"), F.lit(0)).cast("long").alias("errors"),
        F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("processing_time"))
    # Two single-row aggregates side by side (equi-join on a constant key).
    s = r.withColumn("_one", F.lit(1)).join(v.withColumn("_one", F.lit(1)), "_one")
    total = F.col("requests")
    hits = (F.col("requests") - F.col("cache_misses")).alias("cache_hits")
    rate = F.when(total > 0, (F.col("requests") - F.col("cache_misses")) / total * 100.0) \
        .otherwise(F.lit(0.0))
    return s.select(
        hits, "cache_misses", "embeddings_generated", "processing_time", "errors",
        F.format_string("%.2f%%", rate).alias("cache_hit_rate"),
        total.alias("total_requests"),
        (F.col("processing_time") / F.greatest(F.lit(1), F.col("embeddings_generated")))
        .alias("avg_processing_time"),
        "total_count", "success_count",
        (F.col("total_count") - F.col("success_count")).alias("failure_count"))
