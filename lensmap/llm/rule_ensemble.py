"""Quality classifier: a sparse rule ensemble over text statistics.

1. ``statistics``: one numpy pass gives every text a row of numbers (FEATURES).
2. Shallow trees (Spark ML random forest, two depths) are fitted to labelled
   rows; every path from a root to an inner node or leaf is a rule, a
   conjunction of ``feature <= t`` / ``feature > t``.
3. A lasso logistic regression (Spark ML, elasticNetParam 1) weighs the rules;
   most weights are 0.
4. The rules left are compiled into one Spark column expression, the score.

The classifier is fitted on at most MAX_TRAIN labelled rows, the ones with the
least hashes of their ids; everything else covers every row.  Labels, language,
source and ids are never inputs of the score.

Defined cases: a null or empty text has all statistics 0 and a score like any
other; a doc_id with several labels counts as 1 if their mean is at least 0.5;
null labels are ignored; repeated rows score alike; a null doc_id is never held
out and has no label; without labels, or with one kind only, the score is the
smoothed share (ones + 1) / (rows + 2); an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lensmap.llm.textscan import LOWER, U, Words, mix, slices, span_hash, sums, to_bytes
from lensmap.session import materialize

MAX_TRAIN = 20_000
FEATURES = ("log_words", "word_len", "symbols", "upper", "bangs", "bare_words", "echoes", "distinct", "top_word",
            "repeats", "dup_lines", "stops", "digits", "lines", "long_words", "symbol_words")


def _flag(chars: str) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[[ord(c) for c in chars]] = True
    return out


_SYMBOL, _STOP, _DIGIT = _flag("#*$%&|<>"), _flag(".,;:?"), _flag("0123456789")
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, max_bytes=2 << 20):
        buf, offs = to_bytes(b.column("text"))
        n = b.num_rows
        w = Words(buf, offs)
        h = span_hash(LOWER[buf], w.start, w.end)
        doc, count = w.doc, np.maximum(w.count, 1)
        lead = (buf & 0xC0) != 0x80
        chars = sums(lead & ~_flag(" \t\n\v\f\r")[buf], offs)
        per = lambda mask: np.bincount(doc[mask], minlength=n)
        cum = lambda f: np.concatenate([[0], np.cumsum(f[buf], dtype=np.int64)])
        letters, symbols = cum(_LETTER), cum(_SYMBOL)
        length = w.end - w.start
        echo = np.concatenate([[False], (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])])[:len(h)]
        key = mix(h ^ mix(doc.astype(U) + U(1)))
        code, first = pd.factorize(key)
        tf = np.bincount(code, minlength=len(first))
        owner = np.zeros(len(first), np.int64)
        owner[code] = doc
        top = np.zeros(n, np.int64)
        np.maximum.at(top, owner, tf)
        if len(h) >= 3:
            s = mix(mix(key[:-2] * U(3) + h[1:-1]) * U(5) + h[2:])
            at = np.flatnonzero(doc[:-2] == doc[2:])
            hit = at[pd.Series(s[at]).duplicated(keep=False).to_numpy()]
            cover = np.zeros(len(h), dtype=bool)
            for i in range(3):
                cover[hit + i] = True
        else:
            cover = np.zeros(len(h), dtype=bool)
        cut = np.unique(np.concatenate([np.flatnonzero(buf == 10) + 1, offs]))
        lo, hi = cut[:-1], cut[1:]
        line_doc = np.searchsorted(offs, lo, side="right") - 1
        line = span_hash(buf, lo, hi - (buf[hi - 1] == 10)) if len(lo) else np.zeros(0, U)
        dup = pd.Series(mix(line ^ mix(line_doc.astype(U) + U(1)))).duplicated().to_numpy()
        n_lines = np.maximum(np.bincount(line_doc, minlength=n), 1)
        ascii_letters = np.maximum(sums(_UPPER[LOWER_TO_UPPER[buf]], offs), 1)
        safe = np.maximum(chars, 1)
        cols = [np.log1p(w.count), chars / count, sums(_SYMBOL[buf], offs) / safe, sums(_UPPER[buf], offs) / ascii_letters,
                sums(buf == 33, offs) / count, per(letters[w.end] == letters[w.start]) / count, per(echo) / count,
                np.bincount(owner, minlength=n) / count, top / count, per(cover) / count,
                np.bincount(line_doc[dup], minlength=n) / n_lines, sums(_STOP[buf], offs) / count,
                sums(_DIGIT[buf], offs) / safe, n_lines / count, per(length > 20) / count,
                per(symbols[w.end] > symbols[w.start]) / count]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(np.asarray(c, dtype=np.float64)) for c in cols)],
                                         names=["doc_id", *FEATURES])


LOWER_TO_UPPER = np.arange(256, dtype=np.uint8)
LOWER_TO_UPPER[97:123] -= 32


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and FEATURES of every row."""
    schema = "doc_id long, " + ", ".join(f"{f} double" for f in FEATURES)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_stats, schema)


def held_out(doc_id: Column, mod: int = 4, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod == fold, F.lit(False))


Rule = tuple[tuple[int, str, float], ...]


def tree_rules(tree) -> set[Rule]:
    """Every path of a fitted tree, as conjunctions without redundant conditions."""
    rules: set[Rule] = set()

    def walk(node, path: dict[tuple[int, str], float]) -> None:
        if path:
            rules.add(tuple(sorted((f, op, t) for (f, op), t in path.items())))
        if node.subtreeDepth() == 0:
            return
        f, t = node.split().featureIndex(), float(node.split().threshold())
        walk(node.leftChild(), path | {(f, "<="): min(t, path.get((f, "<="), t))})
        walk(node.rightChild(), path | {(f, ">"): max(t, path.get((f, ">"), t))})

    walk(tree._call_java("rootNode"), {})
    return rules


def rule_column(rule: Rule) -> Column:
    out = None
    for f, op, t in rule:
        c = F.col(FEATURES[f])
        c = (c <= F.lit(t)) if op == "<=" else (c > F.lit(t))
        out = c if out is None else out & c
    return out.cast("double")


def fit(train: DataFrame, seed: int = 11, reg: float = 0.0005) -> tuple[list[tuple[Rule, float]], float]:
    """(rules with their non-zero weights, intercept) from rows of FEATURES and ``label``.

    Rows are ordered and in one partition, so that reruns agree (MAX_TRAIN rows at most)."""
    train = materialize(train.coalesce(1).sortWithinPartitions("label", *FEATURES), "rules-train")
    n, ones = train.agg(F.count("*"), F.sum("label")).first()
    if not n or ones in (0, n):
        p = ((ones or 0) + 1) / (n + 2)
        return [], float(np.log(p / (1 - p)))
    data = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(train).select("x", "label").cache()
    rules: set[Rule] = set()
    for depth, trees in ((2, 10), (4, 12)):
        forest = RandomForestClassifier(featuresCol="x", maxDepth=depth, numTrees=trees, seed=seed + depth,
                                        featureSubsetStrategy="onethird", minInstancesPerNode=max(2, n // 500)).fit(data)
        for t in forest.trees:
            rules |= tree_rules(t)
    data.unpersist()
    order = sorted(rules)
    if not order:
        p = (ones + 1) / (n + 2)
        return [], float(np.log(p / (1 - p)))
    table = train.select("label", F.array(*[rule_column(r) for r in order]).alias("v"))
    from pyspark.ml.functions import array_to_vector
    table = table.select(array_to_vector("v").alias("x"), "label").cache()
    model = LogisticRegression(featuresCol="x", elasticNetParam=1.0, regParam=reg, standardization=False, maxIter=60).fit(table)
    table.unpersist()
    return [(r, float(w)) for r, w in zip(order, model.coefficients.toArray()) if w != 0.0], float(model.intercept)


def score_column(rules: list[tuple[Rule, float]], intercept: float) -> Column:
    """The compiled ensemble: logistic of the weighted rules, rounded to 12 places."""
    total = F.lit(intercept)
    for r, w in rules:
        total = total + F.lit(w) * rule_column(r)
    return F.round(1 / (1 + F.exp(-total)), 12)


def quality_scores(docs: DataFrame, labels: DataFrame, cut: float = 0.7, max_train: int = MAX_TRAIN) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    stats = materialize(statistics(docs), "rules-stats")
    y = (labels.filter("quality is not null and doc_id is not null").groupBy("doc_id")
         .agg((F.avg("quality") >= 0.5).cast("double").alias("label")).withColumnRenamed("doc_id", "id"))
    y = y.filter(~held_out(F.col("id"))).orderBy(F.xxhash64(F.col("id").cast("long")), "id").limit(max_train)
    train = stats.join(y, stats["doc_id"] == y["id"]).select("label", *FEATURES)
    rules, intercept = fit(train)
    out = stats.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score_column(rules, intercept).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= cut).cast("int"))


def op5(spark, sf_dir: str) -> DataFrame:
    return quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
