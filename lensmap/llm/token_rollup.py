"""Token counts: rollups maintained from signed deltas, in idempotent batches.

``TokenRollup(root)`` keeps, under a shared folder, one ledger of signed rows
and one small table of signed totals per committed batch:

    batches/<batch>-<attempt>/ledger   doc_id, source, lang, tokenizer_version, sign, tokens
    batches/<batch>-<attempt>/totals   source, lang, tokenizer_version, docs, tokens
    commits/<batch>                    the attempt that counts

``commit`` turns changes into deltas: an insert is +new, a delete -old, a
revised count -old +new, where old is what the ledger holds for the key
(doc_id, tokenizer_version).  Totals are additive, so ``totals`` only sums the
per-batch totals.  An attempt becomes visible by its marker alone, and a batch
id with a marker is not applied again: a job that dies anywhere is simply run
again.  One writer at a time.

Only the keys of a batch are looked up in the ledger (semi join), and every
aggregate has a map side; a hot source or language costs nothing beyond its
partial sums.

Defined cases: null doc_id, source, lang and tokenizer_version are values of
their own; a null count is 0; several changes to one key in one batch: a delete
wins, else the largest (n_tokens, source, lang); an insert of a live key is a
revision, a revision of an absent key an insert, a delete of an absent key
nothing; groups whose totals come back to no document are left out; empty
batches commit and change nothing.  Extra columns are ignored.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lensmap.session import ensure_checkpoint_dir, materialize

KEY = ["doc_id", "tokenizer_version"]
GROUP = ["source", "lang", "tokenizer_version"]
LEDGER = "doc_id long, source string, lang string, tokenizer_version string, sign int, tokens long"

# Regex tokenizers the query counts with: (version, pattern).
TOKENIZERS = {
    "words-1": r"[^\x20\x09-\x0D]+",
    "pieces-1": r"[A-Za-z\x{80}-\x{10FFFF}]+|[0-9]|[!-/:-@\[-`{-~]",
}

SYMBOLS = r"[#*$%&|<>!]"  # left out of a recount


def count_tokens(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("long")


class TokenRollup:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def committed(self) -> dict[str, str]:
        """batch id -> attempt; one small row per batch."""
        fs, p = self._fs(f"{self.root}/commits")
        if not fs.exists(p):
            return {}
        rows = self.spark.read.schema("batch string, attempt string").parquet(f"{self.root}/commits/*").collect()
        return {r["batch"]: r["attempt"] for r in rows}

    def _table(self, name: str, schema: str) -> DataFrame:
        at = [f"{self.root}/batches/{b}-{a}/{name}" for b, a in sorted(self.committed().items())]
        return self.spark.read.schema(schema).parquet(*at) if at else self.spark.createDataFrame([], schema)

    def ledger(self) -> DataFrame:
        return self._table("ledger", LEDGER)

    def live(self, ledger: DataFrame) -> DataFrame:
        """Current (doc_id, source, lang, tokenizer_version, tokens) entries of signed rows."""
        return (ledger.groupBy("doc_id", *GROUP).agg(F.sum("sign").alias("n"), F.sum("tokens").alias("tokens"))
                .filter("n > 0").drop("n"))

    def totals(self) -> DataFrame:
        """source, lang, tokenizer_version, n_docs, n_tokens over all committed batches."""
        schema = "source string, lang string, tokenizer_version string, docs long, tokens long"
        return (self._table("totals", schema).groupBy(*GROUP)
                .agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens")).filter("n_docs <> 0"))

    def deltas(self, changes: DataFrame) -> DataFrame:
        """Signed ledger rows of a batch of (op, doc_id, source, lang, tokenizer_version, n_tokens)."""
        one = changes.groupBy(*KEY).agg(F.max(F.struct(
            (F.col("op") == "delete").alias("gone"), F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n"),
            "source", "lang")).alias("c"))
        same = [F.col(f"l.{k}").eqNullSafe(F.col(f"k.{k}")) for k in KEY]
        mine = self.ledger().alias("l").join(one.select(*KEY).alias("k"), same, "left_semi")
        old = self.live(mine)
        minus = old.alias("l").join(one.alias("k"), same).select(
            *[F.col(f"l.{c}") for c in ("doc_id", *GROUP)], F.lit(-1).alias("sign"), (-F.col("l.tokens")).alias("tokens"))
        plus = one.filter("not c.gone").select(
            "doc_id", "c.source", "c.lang", "tokenizer_version", F.lit(1).alias("sign"), F.col("c.n").alias("tokens"))
        return plus.unionByName(minus)

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply a batch; False (and no effect) if it is already committed."""
        if batch in self.committed():
            return False
        attempt = uuid.uuid4().hex
        at = f"{self.root}/batches/{batch}-{attempt}"
        self.deltas(changes).write.parquet(f"{at}/ledger")
        (self.spark.read.schema(LEDGER).parquet(f"{at}/ledger").groupBy(*GROUP)
         .agg(F.sum(F.col("sign").cast("long")).alias("docs"), F.sum("tokens").alias("tokens"))
         .write.parquet(f"{at}/totals"))
        mark = self.spark.createDataFrame([(batch, attempt)], "batch string, attempt string").coalesce(1)
        mark.write.parquet(f"{at}/mark")
        return self._publish(f"{at}/mark", batch)

    def _publish(self, mark: str, batch: str) -> bool:
        """Make a whole marker the batch's by one rename; False if another attempt was first."""
        jvm = self.spark.sparkContext._jvm
        fs, source = self._fs(mark)
        target = self._fs(f"{self.root}/commits/{batch}")[1]
        fs.mkdirs(target.getParent())
        if fs.exists(target):
            return False
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.NONE                 # refuses an existing target
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            files.rename(source, target, how)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception):
                return False
            raise
        return True


def counts_of(text: Column) -> Column:
    """array<struct<tokenizer_version, n_tokens>>: the text's count under every tokenizer."""
    return F.array(*[F.struct(F.lit(v).alias("tokenizer_version"), count_tokens(text, p).alias("n_tokens"))
                     for v, p in TOKENIZERS.items()])


def changes_of(counted: DataFrame, op: str, counts: str = "counts") -> DataFrame:
    """One change per document and tokenizer version, from rows with a column of counts (``counts_of``).

    Texts are counted before anything is joined, so that only ids and counts are shuffled."""
    return (counted.select("doc_id", "source", "lang", F.explode(counts).alias("c"))
            .select(F.lit(op).alias("op"), "doc_id", "source", "lang", "c.tokenizer_version", "c.n_tokens"))


def op3(spark, sf_dir: str) -> DataFrame:
    """Load every document, take down the toxic ones, recount the low-quality
    ones without symbols, replay the take-down; totals of what is left."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    plain = F.regexp_replace("text", SYMBOLS, "")
    counted = docs.select("doc_id", "source", "lang", counts_of(F.col("text")).alias("counts"),
                          F.when(F.col("text").rlike(SYMBOLS), counts_of(plain)).alias("changed"))
    counted = materialize(counted.withColumn("plain", F.coalesce("changed", "counts")).drop("changed"), "rollup-counts")
    r = TokenRollup(spark, f"{ensure_checkpoint_dir(spark)}/lensmap-rollup-{uuid.uuid4().hex}")
    r.commit("load", changes_of(counted, "insert"))
    toxic = counted.join(labels.filter("toxic = 1").select("doc_id"), "doc_id", "left_semi")
    r.commit("takedown", changes_of(toxic, "delete"))
    low = counted.join(labels.filter("quality = 0 and toxic = 0").select("doc_id"), "doc_id", "left_semi")
    r.commit("recount", changes_of(low, "revise", "plain"))
    r.commit("takedown", changes_of(toxic, "delete"))
    return r.totals()


SQL = r"""
WITH x AS (SELECT d.source, d.lang,
                  CASE WHEN d.doc_id IN (SELECT doc_id FROM labels WHERE quality = 0 AND toxic = 0)
                       THEN regexp_replace(text, '[#*$%&|<>!]', '', 'g') ELSE text END AS text
           FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)),
c AS (SELECT source, lang, 'words-1' AS tokenizer_version,
             coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS n FROM x
      UNION ALL
      SELECT source, lang, 'pieces-1',
             coalesce(len(regexp_extract_all(text, '[A-Za-z\x{80}-\x{10FFFF}]+|[0-9]|[!-/:-@\[-`{-~]')), 0) FROM x)
SELECT source, lang, tokenizer_version, count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_tokens
FROM c GROUP BY ALL
"""
