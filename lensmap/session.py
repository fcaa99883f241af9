"""Session helpers: one place for the configuration every job relies on.

Library functions never create a session; they take the caller's.  The
helpers here are for tests, the bench and the driver entry point, and for
reading lensmap settings (``spark.lensmap.*``) from whatever session is live.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings read from the session (``spark.conf``) with these defaults.
KNN_BROADCAST_BYTES = "spark.lensmap.knn.broadcastBytes"
KNN_BROADCAST_BYTES_DEFAULT = 128 * 1024 * 1024
KNN_QUERY_BLOCK = "spark.lensmap.knn.queryBlock"
KNN_QUERY_BLOCK_DEFAULT = 2048
KNN_CANDIDATE_TILE = "spark.lensmap.knn.candidateTile"
KNN_CANDIDATE_TILE_DEFAULT = 16384


def build_session(master: str | None = None, app: str = "lensmap",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Session used by tests, bench and the driver entry.

    On a cluster the platform supplies master, memory and the checkpoint
    folder; here we only fill in what is unset.
    """
    master = master or os.environ.get("LENSMAP_MASTER", "local[8]")
    b = (SparkSession.builder.master(master).appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.driver.memory", os.environ.get("LENSMAP_DRIVER_MEMORY", "16g"))
         .config("spark.python.worker.reuse", "true")
         # One BLAS thread per Python worker: the cores are already busy with
         # one task each; nested BLAS threads only oversubscribe them.
         .config("spark.executorEnv.OPENBLAS_NUM_THREADS", "1")
         .config("spark.executorEnv.OMP_NUM_THREADS", "1")
         .config("spark.executorEnv.MKL_NUM_THREADS", "1"))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared folder there and we use it as is.  Only in local
    mode, where driver and executors are one process, do we make a scratch
    folder of our own; on a cluster an unset folder is an error, because
    executors would each write to their own disks.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if d:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(d)
        return d.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    d = tempfile.mkdtemp(prefix="lensmap-ckpt-")
    spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def conf_int(spark: SparkSession, key: str, default: int) -> int:
    v = spark.conf.get(key, None)
    return int(v) if v not in (None, "") else int(default)


def materialize(df, what: str = "stage"):
    """Write ``df`` once to a Parquet table under the shared checkpoint folder
    and read it back.

    Cuts the lineage like ``checkpoint()``, survives executor loss (the data
    is on shared storage), and - unlike a checkpointed plan, whose inherited
    constraints can break later unions in Catalyst - reads back as a plain
    table scan with pruning and pushdown.

    The owner of a table that nothing reads any more removes it with
    ``release``.
    """
    import uuid
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/lensmap-{what}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lensmap_path = path
    return out


def release(*tables) -> int:
    """Remove materialized tables that nothing reads any more."""
    paths = [t._lensmap_path for t in tables if getattr(t, "_lensmap_path", None)]
    return release_materialized(tables[0].sparkSession, paths) if paths else 0


def release_materialized(spark: SparkSession, paths: list[str]) -> int:
    """Delete materialized stage tables (returns how many existed).  Only
    folders of this package directly under the checkpoint folder."""
    base = ensure_checkpoint_dir(spark)
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    n = 0
    for p in paths:
        if not p.startswith(base + "/lensmap-") or "/" in p[len(base) + 1:].rstrip("/"):
            raise ValueError(f"not a materialized table: {p}")
        hp = jvm.org.apache.hadoop.fs.Path(p)
        fs = hp.getFileSystem(jsc.hadoopConfiguration())
        if fs.exists(hp):
            fs.delete(hp, True)
            n += 1
    return n
