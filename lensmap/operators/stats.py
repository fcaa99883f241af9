"""Aggregations over collections and runs (A1-A4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Run status words.
STATUS_OK = "成功"
STATUS_PARTIAL = "部分成功"
STATUS_FAILED = "失败"


def collection_stats(spark: SparkSession, sources: dict[str, callable]) -> DataFrame:
    """A4: per collection (name, row_count, status); a collection that fails to
    read becomes a row with status 'error' and row_count 0.

    ``sources`` maps a name to a function returning its DataFrame; counts are
    distributed jobs, the loop is over collection names only.
    """
    rows = []
    for name, fn in sources.items():
        try:
            rows.append((name, int(fn().count()), "loaded"))
        except Exception:
            rows.append((name, 0, "error"))
    return spark.createDataFrame(rows, "name string, row_count long, status string")


def collections_summary(info: DataFrame) -> DataFrame:
    """A1: number of collections, number loaded, total rows."""
    return info.agg(F.count(F.lit(1)).alias("collections"),
                    F.count_if(F.col("status") == "loaded").alias("loaded"),
                    F.coalesce(F.sum("row_count"), F.lit(0)).cast("long").alias("total_rows"))


def run_status(knowledge_n, feedback_n, errors_n):
    """A3: no errors -> success; errors but some records -> partial; else failed."""
    return (F.when(errors_n == 0, F.lit(STATUS_OK))
            .when((knowledge_n + feedback_n) > 0, F.lit(STATUS_PARTIAL))
            .otherwise(F.lit(STATUS_FAILED)))


def run_summary(knowledge: DataFrame, feedback: DataFrame, errors: DataFrame,
                seconds: float) -> DataFrame:
    """A2 (+A3): knowledge count, feedback count, seconds, status, error count.

    Counted after the work is done (the reference wrote them before).
    """
    k = knowledge.agg(F.count(F.lit(1)).alias("knowledge_records"))
    f = feedback.agg(F.count(F.lit(1)).alias("feedback_records"))
    e = errors.agg(F.count(F.lit(1)).alias("error_count"))
    one = F.lit(1)
    s = (k.withColumn("_o", one).join(f.withColumn("_o", one), "_o")
         .join(e.withColumn("_o", one), "_o").drop("_o"))
    return s.select("knowledge_records", "feedback_records",
                    F.lit(float(seconds)).alias("processing_seconds"),
                    run_status(F.col("knowledge_records"), F.col("feedback_records"),
                               F.col("error_count")).alias("status"),
                    "error_count")
