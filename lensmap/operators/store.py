"""Collections as versioned, bucketed Parquet.

Layout on shared storage::

    <root>/<name>/_manifest/<version>.json      tiny pointer files
    <root>/<name>/v=<attempt>/bucket=<b>/*.parquet

A manifest lists, per bucket, the attempts whose files make up the bucket, in
the order of their commits.  Every write goes to a folder of its own, which only
the committed manifest names: what a writer that died left behind is never read
and never in the way (``vacuum`` removes it).

*Commits.*  A manifest is written under a temporary name and renamed to the next
version; the rename fails if that version exists.  A writer that comes second
takes the newer manifest, applies its change to it and tries again, so that two
writers never undo each other; a writer whose collection was recreated or dropped
in the meantime is refused.  Recreating (C2) is a version without rows.  The
file system has to rename atomically (HDFS and its like).

*Appends and upserts.*  Both write only the batch.  The rows of an upsert hide
the rows of the same ids in earlier attempts (merge on read): ``read`` drops a
row if a later upsert of its bucket holds its id.  ``compact`` folds the attempts
of a bucket into one; an upsert does so by itself once a bucket has MAX_ATTEMPTS.

*Counts.*  A manifest carries the visible rows of every bucket; a commit adds
what it appended and subtracts what it hid, so ``info`` reads manifests alone.

Bucket = pmod(xxhash64(id), num_buckets): everything about an id is in one bucket.
"""

from __future__ import annotations

import json
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vector as V
from ..session import materialize, release
from .partitioning import broadcast_if_small

ENTITY_SCHEMA = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("vector", T.ArrayType(T.FloatType(), containsNull=True), True),
    T.StructField("text_for_embedding", T.StringType(), True),
    T.StructField("metadata", T.VariantType(), True),
])
# Schema limits of a collection.
MAX_ID_BYTES = 100
MAX_TEXT_BYTES = 65535
DEFAULT_DIM = 1024
DEFAULT_BUCKETS = 64
ROWS_PER_FILE = 1_000_000
MAX_ATTEMPTS = 16               # attempts of a bucket beyond which an upsert folds it
COMMIT_TRIES = 100


class CollectionError(RuntimeError):
    pass


class VersionTaken(CollectionError):
    """Another writer committed this version first."""


class CollectionStore:
    def __init__(self, spark: SparkSession, root: str, num_buckets: int = DEFAULT_BUCKETS):
        self.spark, self.root, self.num_buckets = spark, root.rstrip("/"), num_buckets
        jvm = spark.sparkContext._jvm
        self._Path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._Path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # -- small-file helpers (manifests only; data never passes the driver) --
    def _path(self, *parts: str):
        return self._Path("/".join([self.root, *parts]))

    def _read_text(self, p) -> str:
        stream = self._fs.open(p)
        try:
            reader = self.spark.sparkContext._jvm.java.io.BufferedReader(
                self.spark.sparkContext._jvm.java.io.InputStreamReader(stream, "UTF-8"))
            lines, line = [], reader.readLine()
            while line is not None:
                lines.append(line)
                line = reader.readLine()
            return "\n".join(lines)
        finally:
            stream.close()

    def _write_new(self, p, text: str) -> None:
        """The file appears whole or not at all; VersionTaken if it exists."""
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        tmp = self._Path(p.getParent(), f".{p.getName()}.{uuid.uuid4().hex}.tmp")
        out = self._fs.create(tmp, False)
        try:
            out.write(bytearray(text.encode("utf-8")))
        finally:
            out.close()
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        how = gateway.new_array(rename, 1)
        how[0] = rename.NONE                 # refuses an existing target
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            if self._fs.exists(p):
                raise VersionTaken(str(p))
            files.rename(tmp, p, how)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception):
                raise VersionTaken(str(p)) from e
            raise
        finally:
            self._fs.delete(tmp, False)

    def _versions(self, name: str) -> list[int]:
        d = self._path(name, "_manifest")
        if not self._fs.exists(d):
            return []
        names = (s.getPath().getName() for s in self._fs.listStatus(d))
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _latest(self, name: str) -> dict | None:
        """The newest readable manifest, dropped or not.  A manifest that does not
        parse (a torn file of a writer without rename) is passed over; ``next``
        is the number after all files, readable or not."""
        versions = self._versions(name)
        for v in reversed(versions):
            try:
                return json.loads(self._read_text(self._path(name, "_manifest", f"{v}.json"))) | {"next": versions[-1] + 1}
            except ValueError:
                continue
        return None

    def manifest(self, name: str) -> dict:
        m = self._latest(name)
        if m is None or m.get("dropped"):
            raise CollectionError(f"collection {name} does not exist")
        return m

    def _commit(self, m: dict) -> dict:
        """Write a manifest as version ``next``."""
        m = {k: v for k, v in m.items() if k != "next"} | {"version": m["next"]}
        self._write_new(self._path(m["name"], "_manifest", f"{m['version']}.json"), json.dumps(m))
        return m

    def _change(self, base: dict, change) -> dict:
        """Commit ``change(manifest)``, on the newest manifest again if another writer was first."""
        for _ in range(COMMIT_TRIES):
            m = self.manifest(base["name"])
            if m["epoch"] != base["epoch"]:
                raise CollectionError(f"collection {base['name']} was recreated while it was written to")
            try:
                return self._commit(change(m))
            except VersionTaken:
                continue
        raise CollectionError(f"collection {base['name']}: {COMMIT_TRIES} commits lost to other writers")

    # -- C1/C2/C6/C7 --------------------------------------------------------
    def exists(self, name: str) -> bool:
        m = self._latest(name)
        return m is not None and not m.get("dropped")

    def create(self, name: str, dim: int = DEFAULT_DIM, metric: str = V.COSINE,
               force: bool = False) -> dict:
        """C1 (+C2 with ``force``): an existing collection is kept as is unless
        forced; unlike the reference we refuse a different dim/metric.

        A forced recreate is one commit: readers see the old rows or none, and a
        crash before it leaves the old collection."""
        metric = V.normalize_metric(metric)
        for _ in range(COMMIT_TRIES):
            m = self._latest(name)
            if m is not None and not m.get("dropped") and not force:
                if m["dim"] != dim or m["metric"] != metric:
                    raise CollectionError(
                        f"collection {name} exists with dim={m['dim']} metric={m['metric']}")
                return m
            try:
                return self._commit({"name": name, "dim": int(dim), "metric": metric, "num_buckets": self.num_buckets,
                                     "next": max([-1, *self._versions(name)]) + 1, "epoch": uuid.uuid4().hex, "buckets": {},
                                     "attempts": {}, "live": {}, "created": time.time()})
            except VersionTaken:
                continue
        raise CollectionError(f"collection {name}: {COMMIT_TRIES} commits lost to other writers")

    def drop(self, name: str) -> bool:
        """True if it existed.  The collection is gone with one commit, its files after that."""
        m = self._latest(name)
        if m is None or m.get("dropped"):
            return False
        self._change(m, lambda cur: cur | {"dropped": True, "buckets": {}, "attempts": {}, "live": {}})
        self._fs.delete(self._path(name), True)
        return True

    def list(self) -> list[str]:
        """Collection names."""
        root = self._Path(self.root)
        if not self._fs.exists(root):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(root)
                      if s.isDirectory() and self.exists(s.getPath().getName()))

    # -- S5 -----------------------------------------------------------------
    def _paths(self, m: dict, keep) -> list[str]:
        return [f"{self.root}/{m['name']}/v={a}/bucket={b}" for b, vs in m["buckets"].items() for i, a in enumerate(vs) if keep(b, i, a)]

    def _files(self, m: dict, paths: list[str]) -> DataFrame:
        """Rows of bucket folders, with the attempt's commit number and a key of the row."""
        order = F.create_map(*(x for a, about in m["attempts"].items() for x in (F.lit(a), F.lit(about["seq"]))))
        schema = T.StructType([*ENTITY_SCHEMA.fields, T.StructField("v", T.StringType()), T.StructField("bucket", T.IntegerType())])
        return (self.spark.read.schema(schema).option("basePath", f"{self.root}/{m['name']}").parquet(*paths)
                .withColumn("_seq", F.element_at(order, F.col("v")))
                .withColumn("_key", F.xxhash64("_metadata.file_path", "_metadata.row_index")).drop("v"))

    def _visible(self, m: dict, buckets: list[int] | None = None) -> DataFrame | None:
        """Current rows (ENTITY_SCHEMA, bucket, _key); None if there are none.

        Buckets without an upsert after their first attempt are scanned as they
        are.  In the others a row is hidden by a later upsert of its id: the ids
        of those upserts, with their last commit number, are anti-joined (and
        broadcast if the manifest's counts prove them small)."""
        wanted = [b for b in m["buckets"] if buckets is None or int(b) in buckets]
        deltas = {b: [a for a in m["buckets"][b][1:] if m["attempts"][a]["upsert"]] for b in wanted}
        plain = self._paths(m, lambda b, i, a: b in deltas and not deltas[b])
        merged = self._paths(m, lambda b, i, a: bool(deltas.get(b)))
        parts = [self._files(m, plain).drop("_seq")] if plain else []
        if merged:
            later = self._files(m, self._paths(m, lambda b, i, a: a in deltas.get(b, ())))
            last = later.groupBy("id").agg(F.max("_seq").alias("_last")).withColumnRenamed("id", "_id")
            rows = sum(m["attempts"][a]["rows"].get(b, 0) for b, some in deltas.items() for a in some)
            if rows * (MAX_ID_BYTES + 32) <= 32 << 20:
                last = F.broadcast(last)
            parts.append(self._files(m, merged).join(last, (F.col("id") == F.col("_id")) & (F.col("_seq") < F.col("_last")),
                                                     "left_anti").drop("_seq"))
        return (parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])) if parts else None

    def read(self, name: str, columns: list[str] | None = None, buckets: list[int] | None = None,
             row_key: str | None = None, manifest: dict | None = None) -> DataFrame:
        """Current rows of a collection (optionally only some buckets).

        ``row_key`` adds a column that tells every stored row apart, repeated
        ids included (a hash of its file and its place in it); ``manifest`` reads
        that version, so that two reads see the same rows."""
        df = self._visible(manifest or self.manifest(name), buckets)
        if df is None:
            df = self.spark.createDataFrame([], ENTITY_SCHEMA).withColumn("_key", F.lit(0).cast("long"))
        return df.select(*(columns or ENTITY_SCHEMA.fieldNames()), *([F.col("_key").alias(row_key)] if row_key else []))

    # -- C5 -----------------------------------------------------------------
    @staticmethod
    def validate(entities: DataFrame, dim: int) -> tuple[DataFrame, DataFrame]:
        """(accepted, rejected with reason) by the collection's limits."""
        reason = (F.when(F.col("id").isNull(), F.lit("missing id"))
                  .when(F.octet_length("id") > MAX_ID_BYTES, F.lit("id longer than 100 bytes"))
                  .when(F.octet_length(F.coalesce("text_for_embedding", F.lit("")))
                        > MAX_TEXT_BYTES, F.lit("text longer than 65535 bytes"))
                  .when(F.col("vector").isNull(), F.lit("missing vector"))
                  .when(F.size("vector") != dim, F.lit(f"vector length is not {dim}")))
        tagged = entities.withColumn("_reason", reason)
        return (tagged.where(F.col("_reason").isNull()).drop("_reason"),
                tagged.where(F.col("_reason").isNotNull()).withColumnRenamed("_reason", "reason"))

    def _bucket(self, m: dict) -> Column:
        return F.pmod(F.xxhash64("id"), F.lit(m["num_buckets"])).cast("int")

    def _written_buckets(self, name: str, attempt: str) -> list[str]:
        d = self._path(name, f"v={attempt}")
        if not self._fs.exists(d):
            return []
        return [s.getPath().getName().split("=", 1)[1] for s in self._fs.listStatus(d)
                if s.isDirectory() and s.getPath().getName().startswith("bucket=")]

    def _checked(self, m: dict, entities: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(written table, accepted, rejected): the batch is computed once.

        ``_seq`` is the order of the records: the column ``gpos`` where the
        entities carry one (T6), else the order in which rows arrive here."""
        seq = F.col("gpos").cast("long") if "gpos" in entities.columns else F.monotonically_increasing_id()
        ordered = entities.select(
            F.col("id").cast("string").alias("id"), F.col("vector").cast(ENTITY_SCHEMA["vector"].dataType).alias("vector"),
            F.col("text_for_embedding").cast("string").alias("text_for_embedding"), "metadata", seq.alias("_seq"))
        table = materialize(ordered.withColumn("bucket", self._bucket(m)), "batch")
        ok, bad = self.validate(table, m["dim"])
        return table, ok, bad.drop("bucket", "_seq")

    @staticmethod
    def _last_of_each(ok: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(one row per id, the last by ``_seq``; the written ids it reads).  Only ids are dealt out to
        find those that come more than once (or without any ``_seq``); only their rows are grouped."""
        again = materialize(ok.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.count("_seq").alias("known"))
                            .where("n > 1 OR known = 0").select("id"), "repeated-ids")
        columns = [*ENTITY_SCHEMA.fieldNames(), "bucket"]
        if again.isEmpty():
            return ok.select(columns), again
        ids = broadcast_if_small(again, MAX_ID_BYTES + 32)
        last = (ok.join(ids, "id", "left_semi").groupBy("id", "bucket")
                .agg(F.max_by(F.struct("vector", "text_for_embedding", "metadata"), "_seq").alias("r")).select("id", "r.*", "bucket"))
        return ok.join(ids, "id", "left_anti").select(columns).unionByName(last), again

    @staticmethod
    def _rejected(table: DataFrame, bad: DataFrame) -> DataFrame:
        """The rejected rows as a table of their own; the batch is not needed any more."""
        bad = materialize(bad, "rejected")
        release(table)
        return bad

    def _write(self, name: str, rows: DataFrame) -> tuple[str, dict[str, int]]:
        """Write rows (with ``bucket``) as an attempt of their own: (attempt, rows per bucket).

        Tasks by size: a large bucket is written by several, small ones share."""
        attempt = f"a{uuid.uuid4().hex[:16]}"
        path = f"{self.root}/{name}/v={attempt}"
        rows.hint("rebalance", "bucket").write.partitionBy("bucket").option("maxRecordsPerFile", ROWS_PER_FILE) \
            .mode("errorifexists").parquet(path)
        if not self._written_buckets(name, attempt):
            return attempt, {}
        written = self.spark.read.schema("id string, bucket int").parquet(path).groupBy("bucket").count()
        return attempt, {str(r["bucket"]): r["count"] for r in written.collect()}      # <= num_buckets rows

    @staticmethod
    def _added(m: dict, attempt: str, rows: dict[str, int], hidden: dict[str, int], upsert: bool) -> dict:
        """The manifest with an attempt after all others."""
        buckets = {b: list(vs) for b, vs in m["buckets"].items()}
        live = dict(m["live"])
        for b, n in rows.items():
            buckets.setdefault(b, []).append(attempt)
            live[b] = live.get(b, 0) + n - hidden.get(b, 0)
        about = {"seq": m["next"], "upsert": upsert, "rows": rows}
        return m | {"buckets": buckets, "live": live, "attempts": m["attempts"] | {attempt: about}}

    # -- C3 -----------------------------------------------------------------
    def append(self, name: str, entities: DataFrame) -> tuple[bool, DataFrame]:
        """Insert as given (ids as strings); invalid rows are rejected and
        returned.  Returns (inserted_anything_or_empty_input, rejected)."""
        m = self.manifest(name)
        table, ok, bad = self._checked(m, entities)
        attempt, rows = self._write(name, ok.drop("_seq"))
        self._change(m, lambda cur: self._added(cur, attempt, rows, {}, False))
        return True, self._rejected(table, bad)

    # -- C4 -----------------------------------------------------------------
    def upsert(self, name: str, entities: DataFrame) -> tuple[bool, DataFrame]:
        """C4: one row per id, last write wins; only the batch is written.

        Within the incoming batch the last record per id (by ``gpos``, see
        ``_checked``) wins; repeated ids collapse in a partial aggregate.
        """
        m = self.manifest(name)
        table, ok, bad = self._checked(m, entities)
        new, again = self._last_of_each(ok)
        attempt, rows = self._write(name, new)
        release(again)

        def change(cur: dict) -> dict:
            return self._added(cur, attempt, rows, self._hidden(cur, name, attempt, rows), True)
        done = self._change(m, change)
        if any(len(vs) > MAX_ATTEMPTS for vs in done["buckets"].values()):
            self.compact(name, MAX_ATTEMPTS)
        return True, self._rejected(table, bad)

    def _hidden(self, m: dict, name: str, attempt: str, rows: dict[str, int]) -> dict[str, int]:
        """Rows per bucket that the upsert hides: ids alone are read, of touched buckets."""
        old = self._visible(m, [int(b) for b in rows])
        if old is None or not rows:
            return {}
        ids = self.spark.read.schema("id string").parquet(f"{self.root}/{name}/v={attempt}").select("id")
        if sum(rows.values()) * (MAX_ID_BYTES + 32) <= 32 << 20:
            ids = F.broadcast(ids)
        found = old.select("id", "bucket").join(ids, "id", "left_semi").groupBy("bucket").count()
        return {str(r["bucket"]): r["count"] for r in found.collect()}                   # <= num_buckets rows

    def compact(self, name: str, more_than: int = 1) -> dict:
        """Fold buckets of more than ``more_than`` attempts into one attempt each.

        What other writers add meanwhile stays after it; a bucket whose folded
        attempts were changed meanwhile is left as it is."""
        m = self.manifest(name)
        many = [b for b, vs in m["buckets"].items() if len(vs) > more_than]
        if not many:
            return m
        attempt, rows = self._write(name, self._visible(m, [int(b) for b in many]).drop("_key"))

        def change(cur: dict) -> dict:
            buckets = {b: list(vs) for b, vs in cur["buckets"].items()}
            for b in many:
                if buckets.get(b, [])[:len(m["buckets"][b])] == m["buckets"][b]:
                    buckets[b][:len(m["buckets"][b])] = [attempt] if b in rows else []
            used = {a for vs in buckets.values() for a in vs}
            attempts = cur["attempts"] | {attempt: {"seq": m["version"], "upsert": False, "rows": rows}}
            return cur | {"buckets": buckets, "attempts": {a: x for a, x in attempts.items() if a in used}}
        return self._change(m, change)

    def vacuum(self, name: str) -> int:
        """Remove data folders the current manifest does not name, and indexes of
        older versions (returns how many data folders).  Only when no reader of
        an older version and no writer is active."""
        m = self.manifest(name)
        used = {f"v={a}" for vs in m["buckets"].values() for a in vs}
        home = self._path(name, "_index")
        for st in self._fs.listStatus(home) if self._fs.exists(home) else []:
            if not st.getPath().getName().startswith(f"{m['version']}-"):
                self._fs.delete(st.getPath(), True)
        n = 0
        for st in self._fs.listStatus(self._path(name)):
            if st.getPath().getName().startswith("v=") and st.getPath().getName() not in used:
                n += bool(self._fs.delete(st.getPath(), True))
        return n

    # -- C8 -----------------------------------------------------------------
    def info(self, names: list[str] | None = None) -> DataFrame:
        """(name, row_count, status, dim, metric, num_buckets, version).

        The counts are those of the manifests; no data file is read.  A collection
        that cannot be read is reported with status 'error' and row_count 0
        instead of failing the whole report.
        """
        rows = []
        for n in names if names is not None else self.list():
            try:
                m = self.manifest(n)
                rows.append((n, sum(m["live"].values()), "loaded", m["dim"], m["metric"],
                             m["num_buckets"], m["version"]))
            except Exception:
                rows.append((n, 0, "error", None, None, None, None))
        return self.spark.createDataFrame(
            rows, "name string, row_count long, status string, dim int, metric string, "
                  "num_buckets int, version int")
