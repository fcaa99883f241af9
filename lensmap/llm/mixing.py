"""Mixing sources to target weights (native: DataFrame functions only).

Tokens are aggregated per source, targets follow from the sources' weights and
a ceiling of ``max_repeat`` times the source, the repetition rate is
target / size, and each document is emitted floor(rate) times plus once more
when a hash of its id falls below the fraction.

Sources: one partial aggregate, whatever their skew; the per-source table (one
row a source) carries the target computation, and is broadcast to the documents
only when its counted rows stay under ``BROADCAST_SOURCES``; beyond that it is
an equi-join, where a hot source is split by AQE on the document side.

Defined cases: a null text has size 0; null sources form one source, ordered
last; a document with a null id is hashed under the text 'null'; rows with the
same id share one decision (a repeated row is repeated in the result, too); a
source without tokens has target 0 and emits nothing; an empty table gives an
empty result.  Input columns may have any names: they travel inside a struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lensmap.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
BROADCAST_SOURCES = 20_000  # rows of (source, size, target): a few MB


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit_hash(key: Column, seed: str) -> Column:
    """Uniform number in [0, 1) from the first 52 bits of md5(seed:key)."""
    text = F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def cyclic_weights(sources: DataFrame) -> DataFrame:
    """Adds ``weight`` 1, 2, 3, 1, ... in code point order of ``source``, null last."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    return sources.withColumn("weight", (F.pmod(rank - 1, F.lit(3)) + 1).cast("long"))


def source_targets(weighted: DataFrame, max_repeat: int = 3) -> DataFrame:
    """(source, source_size, weight) -> the same with ``target`` and ``rate``.

    Fixed point of "share by weight, stop at max_repeat x size, reshare": every
    target is min(ceiling, level x weight).  In order of ceiling / weight the
    level left after the first k ceilings is (total - their sum) / (other
    weights); the first k whose level does not pass its own ceiling is final.
    """
    every = Window.partitionBy()
    at = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = at.rowsBetween(Window.unboundedPreceding, -1)
    t = (weighted.withColumn("ceiling", F.col("source_size") * max_repeat)
         .withColumn("ratio", F.col("ceiling").cast("double") / F.col("weight"))
         .withColumn("left", F.sum("source_size").over(every) - F.coalesce(F.sum("ceiling").over(before), F.lit(0)))
         .withColumn("others", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
         .withColumn("level", F.col("left").cast("double") / F.col("others"))
         .withColumn("rank", F.row_number().over(at)))
    final = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("rank", "level"))).over(every)["level"]
    target = F.least(F.col("ceiling").cast("double"), final * F.col("weight"))
    return (t.withColumn("target", target)
            .withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
            .select("source", "source_size", "weight", "target", "rate"))


def mix_plan(docs: DataFrame, max_repeat: int = 3, seed: str = "mix-1", size: Column | None = None,
             weights=cyclic_weights) -> DataFrame:
    """One row per input row: d (all input columns), size, source_size, target, copies."""
    sized = docs.select(F.struct("*").alias("d")).select(
        "d", F.col("d.source").alias("src"),
        (word_count(F.col("d.text")) if size is None else size).alias("size"))
    totals = (docs.select("source", (word_count(F.col("text")) if size is None else size).alias("n"))
              .groupBy("source").agg(F.sum("n").alias("source_size")))
    targets = materialize(source_targets(weights(totals), max_repeat), "mix-targets")
    side = targets.select(F.col("source").alias("t_source"), "source_size", "target", "rate")
    if targets.count() <= BROADCAST_SOURCES:
        side = F.broadcast(side)
    j = sized.join(side, F.col("src").eqNullSafe(F.col("t_source")), "left")
    whole = F.floor("rate")
    extra = (unit_hash(F.col("d.doc_id"), seed) < F.col("rate") - whole).cast("long")
    return j.select("d", "size", "source_size", "target", (whole + extra).alias("copies"))


def mix_sources(docs: DataFrame, max_repeat: int = 3, seed: str = "mix-1", weights=cyclic_weights) -> DataFrame:
    """The mixed documents: every row ``copies`` times, with the columns of ``docs``."""
    plan = mix_plan(docs, max_repeat, seed, weights=weights)
    return plan.select("d", F.explode(F.expr("array_repeat(0, cast(copies as int))"))).select("d.*")


def op9(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_plan(docs).select(
        F.col("d.doc_id").alias("doc_id"), "size", "source_size", "target",
        (F.col("size") * F.col("copies")).alias("taken"), F.col("copies"))


SQL = r"""
WITH d AS (SELECT doc_id, source,
                  coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
           FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size,
             ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight FROM s),
r AS (SELECT *, source_size * 3 AS ceiling, (source_size * 3)::DOUBLE / weight AS ratio FROM w),
l AS (SELECT *, row_number() OVER o AS rnk,
             ((sum(source_size) OVER ())::BIGINT - coalesce(sum(ceiling) OVER b, 0)::BIGINT)::DOUBLE
             / ((sum(weight) OVER ())::BIGINT - coalesce(sum(weight) OVER b, 0)::BIGINT)::DOUBLE AS lvl
      FROM r WINDOW o AS (ORDER BY ratio, source ASC NULLS LAST),
           b AS (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT arg_min(lvl, rnk) AS lvl FROM l WHERE lvl <= ratio),
t AS (SELECT l.source, l.source_size, least(l.ceiling::DOUBLE, f.lvl * l.weight) AS target FROM l, f),
x AS (SELECT d.doc_id, d.size, t.source_size, t.target,
             CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
             ('0x' || substr(md5('mix-1:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE
             / 4503599627370496.0 AS u
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       size * (floor(rate)::BIGINT + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS taken,
       floor(rate)::BIGINT + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END AS copies
FROM x
"""
