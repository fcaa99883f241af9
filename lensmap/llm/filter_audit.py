"""Filter interaction audit: what every order of five filters keeps, removes and repeats.

Four filters judge a text alone (``text_failures``, over one scan's statistics).  The fifth, E, is an existential self-join: a row fails it
if some row of the table has the same text and a smaller doc_id, whatever the
other filters do to that row.

1. ``row_facts``: id, part, 64-bit text hash and the bits of the failures A-D of
   every row, written once, without the text.  Distinct words are counted by
   64-bit hashes.
2. ``duplicate_ids``: E.  Hashes that stand in more than one row are aggregated
   first; only rows with such a hash and a doc_id above the hash's least one can
   fail.  They meet one row per (hash, text) - the least doc_id of the text, a
   partial aggregate - in a left-semi join on hash, exact text and smaller
   doc_id.  A hash held by more than 1/HOT_SHARE of all rows (at most HOT_SHARE
   of them exist, so that list is broadcast) is salted: its rows spread over
   ``fan`` keys and its few texts are repeated for each of them.
3. ``combinations``: the ids of E are united with the ids of the other failures;
   the bits of an id are aggregated, and rows are counted per (part, bits).
4. ``audit``: at most 32 rows a part give every figure of all 120 orders.

Defined cases: a null text is empty (equal to other empty texts); a null and an
empty part are one; a null doc_id is never smaller nor larger than another, so
it neither fails E nor makes others fail; repeated rows count each, and do not
make each other fail; a label counts if any row of ``labels`` for the doc_id has
it, null labels count as 0; without rows there is no part and the result is
empty.  Input columns are picked by name, other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lensmap.llm.textscan import U, Words, mix, slices, span_hash, sums, to_bytes
from lensmap.operators.partitioning import broadcast_if_small
from lensmap.session import materialize, release

LETTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(LETTERS)]
HOT_SHARE = 1024
SYMBOL = np.zeros(256, dtype=bool)
SYMBOL[[ord(c) for c in "#$%&*|"]] = True
DUP_BIT = 1 << LETTERS.index("E")


STATS = ("n_words", "n_distinct", "n_upper", "n_chars", "n_symbols")


def text_failures() -> list[Column]:
    """Failure conditions A-D over the statistics STATS of a text."""
    return [F.col("n_words") < 200,
            F.col("n_distinct") * 100 < F.col("n_words") * 50,
            F.col("n_upper") * 100 > F.col("n_chars") * 3,
            F.col("n_symbols") > 0]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """STATS of every text, by numpy over slices of the batch; the text itself is left behind."""
    for b in slices(batches, max_bytes=1 << 20):
        buf, offs = to_bytes(b.column("text"))
        w = Words(buf, offs)
        again = pd.Series(mix(span_hash(buf, w.start, w.end) ^ mix(w.doc.astype(U) + U(1)))).duplicated().to_numpy()
        stats = (w.count, np.bincount(w.doc[~again], minlength=b.num_rows), sums((buf >= 65) & (buf <= 90), offs),
                 sums((buf & 0xC0) != 0x80, offs), sums(SYMBOL[buf], offs))
        yield pa.RecordBatch.from_arrays(
            [*(b.column(c) for c in ("doc_id", "part", "h")), *(pa.array(x.astype(np.int64)) for x in stats)],
            names=["doc_id", "part", "h", *STATS])


def _keyed(docs: DataFrame, part: str) -> DataFrame:
    """doc_id, part, text and its hash, nulls resolved."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
                       F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))


def row_facts(docs: DataFrame, part: str = "lang", failures=text_failures) -> DataFrame:
    """doc_id, part, h, bits (bit i: filter i of A-D fails) of every row."""
    stats = _keyed(docs, part).mapInArrow(_scan, "doc_id long, part string, h long, " + ", ".join(f"{c} long" for c in STATS))
    bits = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(failures())), F.lit(0))
    return stats.select("doc_id", "part", "h", bits.cast("int").alias("bits"))


def duplicate_ids(docs: DataFrame, facts: DataFrame, part: str = "lang", hot_share: int = HOT_SHARE) -> DataFrame:
    """doc_id, part, h of the rows whose text stands under a smaller doc_id, too.

    ``facts`` is the written table of ``row_facts``."""
    limit = max(1, facts.count() // hot_share)
    seen = facts.groupBy("h").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"))
    dup = materialize(seen.filter("n > 1 and least is not null")
                      .select("h", "least", F.ceil(F.col("n") / limit).cast("int").alias("fan")), "audit-hashes")
    hot = F.broadcast(dup.filter("fan > 1").select("h", "fan"))      # at most hot_share rows: their n add up to all rows
    salted = dup.select("h", "least", F.explode(F.sequence(F.lit(0), F.col("fan") - 1)).alias("salt"))
    rows = (_keyed(docs, part).join(hot, "h", "left")
            .withColumn("salt", F.when(F.col("fan") > 1, F.pmod(F.xxhash64("doc_id", F.lit("salt")), F.col("fan")).cast("int"))
                        .otherwise(0)).drop("fan")
            .join(broadcast_if_small(salted, 32), ["h", "salt"]))
    later = rows.filter(F.col("doc_id") > F.col("least")).select("doc_id", "part", "h", "salt", "text")
    first = rows.groupBy("h", "text").agg(F.min("doc_id").alias("smaller")).join(hot, "h", "left").select(
        F.col("h").alias("h2"), F.col("text").alias("text2"), "smaller",
        F.explode(F.sequence(F.lit(0), F.coalesce("fan", F.lit(1)) - 1)).alias("salt2"))
    same = ((F.col("h") == F.col("h2")) & (F.col("salt") == F.col("salt2")) & (F.col("text") == F.col("text2"))
            & (F.col("smaller") < F.col("doc_id")))
    return later.join(first, same, "left_semi").select("doc_id", "part", "h")


def combinations(facts: DataFrame, duplicates: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, bits, n, good, toxic): rows, and rows with each label, per set of failures."""
    ids = facts.select("doc_id", "part", "h", "bits", F.lit(1).alias("rows")).unionByName(
        duplicates.select("doc_id", "part", "h", F.lit(DUP_BIT).alias("bits"), F.lit(0).alias("rows")))
    one = ids.groupBy("doc_id", "part", "h").agg(F.bit_or("bits").alias("bits"), F.sum("rows").alias("rows"))
    flags = (labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
             .agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("long")).alias("q"),
                  F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("long")).alias("t")))
    return (one.join(flags, "doc_id", "left").groupBy("part", "bits")
            .agg(F.sum("rows").alias("n"), F.sum(F.col("rows") * F.coalesce("q", F.lit(0))).alias("good"),
                 F.sum(F.col("rows") * F.coalesce("t", F.lit(0))).alias("toxic")))


def audit(combos: DataFrame) -> DataFrame:
    """The report, one row per part, order and step: every combination's row meets all steps
    (a constant number), so each part has all of them, zeros included."""
    k = len(LETTERS)
    orders = ", ".join(f"'{o}'" for o in ORDERS)
    bit = "shiftleft(1, ascii(substr(filter_order, {}, 1)) - ascii('A'))"
    s = (combos.select("*", F.explode(F.sequence(F.lit(0), F.lit(len(ORDERS) * k - 1))).alias("i"))
         .withColumn("filter_order", F.expr(f"element_at(array({orders}), cast(i div {k} as int) + 1)"))
         .withColumn("step", F.expr(f"cast(i % {k} as int) + 1"))
         .withColumn("own", F.expr(bit.format("step")))
         .withColumn("earlier", F.expr(f"aggregate(sequence(1, step), 0, (a, j) -> if(j = step, a, a + {bit.format('j')}))")))
    fails = F.col("bits").bitwiseAND(F.col("own")) != 0
    gone = F.col("bits").bitwiseAND(F.col("earlier")) != 0
    # a row with f failures is removed first by each of them in 1/f of the orders
    fair = (F.lit(len(ORDERS)) / F.bit_count("bits")).cast("long") * F.col("n")
    total = lambda keep, what="n": F.sum(F.when(keep, F.col(what) if isinstance(what, str) else what).otherwise(0)).cast("long")
    return s.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~gone).alias("kept"), total(fails & ~gone).alias("removed"), total(fails & gone).alias("redundant"),
        total(F.col("bits") == F.col("own")).alias("unique_fails"), total(fails & ~gone, "good").alias("good_lost"),
        total(fails & ~gone, "toxic").alias("toxic_lost"), total(fails, fair).alias("shapley"))


def filter_audit(docs: DataFrame, labels: DataFrame, part: str = "lang", failures=text_failures) -> DataFrame:
    """The report of ``docs`` (doc_id, text and the column ``part``)."""
    facts = materialize(row_facts(docs, part, failures), "audit-facts")
    combos = materialize(combinations(facts, duplicate_ids(docs, facts, part), labels), "audit-combinations")
    release(facts)
    return audit(combos)


def op11(spark, sf_dir: str) -> DataFrame:
    return filter_audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS q, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS x
      FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (SELECT rid, part, coalesce(q, 0) AS q, coalesce(x, 0) AS x,
             [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w),
              100 * (len(t) - len(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * len(t), regexp_matches(t, '[#$%&*|]'),
              coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, false)] AS fails
      FROM d LEFT JOIN l USING (doc_id)),
g(letter, i) AS (VALUES ('A', 1), ('B', 2), ('C', 3), ('D', 4), ('E', 5)),
o AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.i, b.i, c.i, d.i, e.i] AS ord
      FROM g a, g b, g c, g d, g e
      WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
c AS (SELECT part, fails, count(*) AS n, sum(q) AS good, sum(x) AS toxic FROM f GROUP BY part, fails),
s AS (SELECT part, filter_order, step, ord[step] AS own, fails[ord[step]] AS hit,
             len(list_filter(ord[1:step - 1], lambda z: fails[z])) > 0 AS gone,
             len(list_filter(fails, lambda z: z)) = 1 AS single, n, good, toxic
      FROM c, o, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, filter_order, step::INTEGER AS step, own,
             coalesce(sum(n) FILTER (NOT hit AND NOT gone), 0)::BIGINT AS kept,
             coalesce(sum(n) FILTER (hit AND NOT gone), 0)::BIGINT AS removed,
             coalesce(sum(n) FILTER (hit AND gone), 0)::BIGINT AS redundant,
             coalesce(sum(n) FILTER (hit AND single), 0)::BIGINT AS unique_fails,
             coalesce(sum(good) FILTER (hit AND NOT gone), 0)::BIGINT AS good_lost,
             coalesce(sum(toxic) FILTER (hit AND NOT gone), 0)::BIGINT AS toxic_lost
      FROM s GROUP BY part, filter_order, step, own)
SELECT * EXCLUDE (own), (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r
"""
