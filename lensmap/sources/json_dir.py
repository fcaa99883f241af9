"""Directory-of-JSON scan (S1-S3), error reports (S2) and positional default ids.

A file holds either a top-level array (many records) or anything else (one
record).  Files that do not parse are skipped whole and reported (S2).
Records stay VARIANT, so a missing key and an explicit JSON null remain
different (``variant_get(...) IS NULL`` versus ``is_variant_null``).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.partitioning import number_rows, running_offsets
from ..session import ensure_checkpoint_dir

RECORD_SCHEMA = T.StructType([
    T.StructField("file", T.StringType(), False),
    T.StructField("pos", T.IntegerType(), False),
    T.StructField("item", T.VariantType(), True),
    T.StructField("gpos", T.LongType(), False),
])


# Folders of files that one scan lists: the driver keeps a record of every listed file.
FOLDERS_AT_ONCE = 32


class DirectoryNotFound(FileNotFoundError):
    pass


def _exists(spark: SparkSession, path: str) -> bool:
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(jsc.hadoopConfiguration()).exists(p)


def _has_json(spark: SparkSession, path: str, suffix: str = ".json") -> bool:
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(jsc.hadoopConfiguration())
    it = fs.listStatusIterator(p)
    while it.hasNext():
        st = it.next()
        name = st.getPath().getName()
        if st.isFile() and name.endswith(suffix) and not name.startswith(("_", ".")):
            return True
    return False


def _strict_json(batches):
    """Parse each file with Python's json (the reference's parser) and hand
    Spark a normalised text: trailing garbage makes a file bad; duplicate keys
    resolve last-wins as in Python."""
    import json

    import pandas as pd
    for pdf in batches:
        out = []
        for v in pdf["value"]:
            try:
                out.append(json.dumps(json.loads(v), ensure_ascii=False))
            except Exception:
                out.append(None)
        yield pd.DataFrame({"file": pdf["file"], "value": pdf["value"], "norm": out})


def read_json_files(spark: SparkSession, directory: str | list[str], glob: str = "*.json",
                    strict: bool = False) -> DataFrame:
    """One row per ``*.json`` file (non-recursive): (file, value, doc VARIANT).

    S3: a missing directory raises; a directory without JSON gives no rows.
    Spark skips names starting with ``_`` or ``.``, which a plain glob would not.
    ``directory`` may be several of them.
    """
    directory = [directory] if isinstance(directory, str) else directory
    for d in directory:
        if not _exists(spark, d):
            raise DirectoryNotFound(f"directory does not exist: {d}")
    if not any(_has_json(spark, d, glob.lstrip("*")) for d in directory):
        return spark.createDataFrame([], "file string, value string, doc variant")
    raw = (spark.read.option("pathGlobFilter", glob)
           .text(directory, wholetext=True)
           .select(F.col("_metadata.file_path").alias("file"), "value"))
    if strict:
        # Optional: Spark's parser accepts trailing garbage after a value and
        # rejects duplicate keys; Python's json does the opposite.  One file
        # per row, validated in Arrow batches.
        norm = raw.mapInPandas(_strict_json, "file string, value string, norm string")
        return norm.select("file", "value", F.try_parse_json("norm").alias("doc"))
    return raw.withColumn("doc", F.try_parse_json("value"))


def bad_files(files: DataFrame) -> DataFrame:
    """Files skipped because they do not parse: (file, error)."""
    return (files.where(F.col("doc").isNull())
            .select("file", F.lit("invalid JSON").alias("error")))


def bad_files_in_folders(spark: SparkSession, home: str, glob: str = "*.json", strict: bool = False) -> DataFrame:
    """S2 over the files in the folders of ``home``, for more files than the driver can list at
    once: FOLDERS_AT_ONCE folders are read at a time, and what is reported of them is written
    to a table."""
    if not _exists(spark, home):
        raise DirectoryNotFound(f"directory does not exist: {home}")
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    p = jvm.org.apache.hadoop.fs.Path(home)
    folders = sorted(s.getPath().toString() for s in p.getFileSystem(jsc.hadoopConfiguration()).listStatus(p)
                     if s.isDirectory() and not s.getPath().getName().startswith(("_", ".")))
    path = f"{ensure_checkpoint_dir(spark)}/lensmap-bad-files-{uuid.uuid4().hex}"
    for i in range(0, len(folders), FOLDERS_AT_ONCE):
        bad = bad_files(read_json_files(spark, folders[i:i + FOLDERS_AT_ONCE], glob, strict))
        bad.hint("rebalance").write.mode("append").parquet(path)
    return spark.read.schema("file string, error string").parquet(path) if folders else \
        spark.createDataFrame([], "file string, error string")


def explode_records(files: DataFrame) -> DataFrame:
    """Records (file, pos, item) plus gpos = position in the concatenation
    of all files ordered by name (T6)."""
    good = files.where(F.col("doc").isNotNull())
    arr = F.coalesce(F.try_variant_get("doc", "$", "array<variant>"), F.array("doc"))
    per_file = good.select("file", arr.alias("items"))
    counted = per_file.withColumn("n", F.size("items").cast("long"))
    with_off = running_offsets(counted, ["file"], "n", "offset")
    return (with_off.select("file", "offset", F.posexplode("items").alias("pos", "item"))
            .select("file", F.col("pos").cast("int").alias("pos"), "item",
                    (F.col("offset") + F.col("pos")).cast("long").alias("gpos")))


def scan_json_dir(spark: SparkSession, directory: str, glob: str = "*.json",
                  strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """S1+S2: (records, bad_files) of a directory."""
    files = read_json_files(spark, directory, glob, strict)
    if not files.columns or "doc" not in files.columns:
        return spark.createDataFrame([], RECORD_SCHEMA), spark.createDataFrame([], "file string, error string")
    return explode_records(files), bad_files(files)


def _lines(spark: SparkSession, directory: str, glob: str = "*.json*") -> DataFrame:
    """Every line of the directory's files: (file, blk = start of its split, value)."""
    if not _exists(spark, directory):
        raise DirectoryNotFound(f"directory does not exist: {directory}")
    return (spark.read.option("pathGlobFilter", glob).text(directory)
            .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("blk"), "value"))


def scan_json_lines(spark: SparkSession, directory: str, glob: str = "*.json*",
                    parts: bool = False) -> tuple[DataFrame, DataFrame]:
    """Splittable variant for very large inputs, one JSON record per line: (records, bad lines).

    Blank lines are skipped; lines that do not parse are reported as (file,
    line, error), lines counted from 1 in their file, blank ones included; with
    ``parts`` the files are parts of one file, which Spark writes and reads by
    many tasks, and lines are counted through all of them in name order.
    gpos is the position among the records in the order of file name and line.
    The input is read once: records, line numbers and positions come from one
    written table (``number_rows``).
    """
    blank = F.trim("value") == ""
    parsed = _lines(spark, directory, glob).select("file", "blk", blank.alias("blank"), F.try_parse_json("value").alias("item"))
    ok = ~F.col("blank") & F.col("item").isNotNull()
    rows = number_rows(parsed, ["file", "blk"], {"line": F.lit(True), "gpos": ok}, within={"line": [] if parts else ["file"]})
    bad = rows.where(~F.col("blank") & F.col("item").isNull()).select(
        "file", (F.col("line") + 1).alias("line"), F.lit("invalid JSON line").alias("error"))
    return rows.where(F.col("gpos").isNotNull()).select("file", F.lit(0).alias("pos"), "item", "gpos"), bad


def count_records(spark: SparkSession, directory: str, json_lines: bool = False, strict: bool = False) -> int:
    """Records and bad lines (``json_lines``) or records of good files of a directory, by a count of
    its own that takes nothing from a scan: the other side of a run's balance."""
    if json_lines:
        return _lines(spark, directory).where(F.trim("value") != "").count()
    files = read_json_files(spark, directory, strict=strict)
    n = F.coalesce(F.size(F.try_variant_get("doc", "$", "array<variant>")), F.lit(1))
    return files.where(F.col("doc").isNotNull()).agg(F.sum(n)).first()[0] or 0
