"""Quality rules: cross-document line frequency, per host.

Each line is normalised (A-Z lowered, white space collapsed) and hashed; for
every (host, line) the distinct documents are counted, lines found in more
documents than the host's limit are removed, and a document with too little
left is rejected.  The host is ``source``.  Exact copies count as one document:
a document is known by the hash of its text, so that a page published many
times is left to the duplicate stages and does not wear itself out.

The limit of a host is ``share`` of its distinct documents, but ``min_docs`` at
least and ``max_docs`` at most: a line found in more than ``max_docs`` documents
goes however large the host is.
A document is depleted when removal leaves it under ``keep_share`` of its
words, or under ``min_words`` of them.

One numpy pass per batch of texts gives the statistics and the hashes of each
document's lines, written once; counting is two partial aggregates (distinct
(host, line, text), then per (host, line)), and only lines above the limit
meet the documents again, in an equi-join whose document side AQE may split.

Defined cases: null text is empty; null source is a host of its own; repeated
rows are judged alike, each in its own row; empty texts fail the base rule; an
empty table gives an empty result.  Input columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lensmap.llm.textscan import LOWER, U, Words, fresh_worker, mix, powers, slices, span_hash, sums, to_bytes
from lensmap.session import materialize

SYMBOL = np.zeros(256, dtype=bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True

STATS = ("row long, doc_id long, host string, text_hash long, n_words long, word_chars long, n_symbols long, "
         "n_dup_lines long, n_repeat_words long, lines array<long>, line_words array<int>")


def _fold_words(h: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hash of each run [first, last) of word hashes."""
    up, down = powers(len(h) + 1)
    pre = np.concatenate([np.zeros(1, U), np.cumsum(h * up[:len(h)], dtype=U)])
    return mix((pre[last] - pre[first]) * down[first] ^ (last - first).astype(U)).view(np.int64)


def _normalised(w: Words, lowered: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, hash, row) of each row that has a word, one line a row."""
    rows = np.flatnonzero(w.count)
    h = span_hash(lowered, w.start, w.end)
    return w.count[rows], _fold_words(h, w.first[rows], w.first[rows + 1]), rows


def line_scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fresh_worker()
    part, at = TaskContext.get().partitionId(), 0
    for b in slices(batches, max_bytes=1 << 20):
        buf, offs = to_bytes(b.column("text"))
        n = b.num_rows
        w = Words(buf, offs)
        raw = span_hash(buf, w.start, w.end)
        low = span_hash(LOWER[buf], w.start, w.end)
        lead = (buf & 0xC0) != 0x80  # first byte of a code point
        in_word = np.zeros(len(buf) + 1, dtype=np.int8)
        np.add.at(in_word, w.start, 1)
        np.add.at(in_word, w.end, -1)
        solid = np.cumsum(in_word[:-1], dtype=np.int8).astype(bool)
        # lines: cut at \n and at text ends; those without a word are skipped
        cut = np.unique(np.concatenate([np.flatnonzero(buf == 10) + 1, offs[1:], offs[:-1]]))
        line = np.searchsorted(cut, w.start, side="right") - 1
        first = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]])) if len(line) else np.zeros(0, np.int64)
        last = np.concatenate([first[1:], [len(line)]]) if len(line) else first
        doc = w.doc[first]
        lo = cut[line[first]]
        hi = np.concatenate([cut, [len(buf)]])[line[first] + 1] if len(first) else lo
        hi = np.where((hi > lo) & (buf[np.maximum(hi - 1, 0)] == 10), hi - 1, hi) if len(first) else hi
        exact = span_hash(buf, lo, hi)
        dup = pd.Series(mix(exact ^ mix(doc.astype(U) + U(1)))).duplicated().to_numpy()
        norm = _fold_words(low, first, last)
        # words inside 3-word windows found twice or more in their text
        if len(raw) >= 3:
            s = mix(mix(raw[:-2] * U(3) + raw[1:-1]) * U(5) + raw[2:])
            same = w.doc[:-2] == w.doc[2:]
            at3 = np.flatnonzero(same)
            again = pd.Series(mix(s[at3] ^ mix(w.doc[at3].astype(U) + U(1)))).duplicated(keep=False).to_numpy()
            hit = at3[again]
            cover = np.zeros(len(raw), dtype=bool)
            for i in range(3):
                cover[hit + i] = True
            repeat = np.bincount(w.doc[cover], minlength=n)
        else:
            repeat = np.zeros(n, np.int64)
        # distinct lines of a document, with the words of all their occurrences
        lines = pd.DataFrame({"d": doc, "h": norm, "w": (last - first).astype(np.int32)}).groupby(["d", "h"], sort=True)["w"].sum()
        d = lines.index.get_level_values(0).to_numpy()
        lists = np.concatenate([[0], np.cumsum(np.bincount(d, minlength=n))]).astype(np.int32) if len(d) else np.zeros(n + 1, np.int32)
        cols = [
            pa.array((np.int64(part) << 40) + at + np.arange(n, dtype=np.int64)),
            b.column("doc_id").cast(pa.int64()), b.column("host").cast(pa.string()), b.column("text_hash"),
            pa.array(w.count), pa.array(sums(solid & lead, offs)), pa.array(sums(SYMBOL[buf], offs)),
            pa.array(np.bincount(doc[dup], minlength=n).astype(np.int64)), pa.array(repeat.astype(np.int64)),
            pa.ListArray.from_arrays(lists, pa.array(lines.index.get_level_values(1).to_numpy().astype(np.int64))),
            pa.ListArray.from_arrays(lists, pa.array(lines.to_numpy().astype(np.int32))),
        ]
        at += n
        yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in STATS.split(", ")])


def line_quality(docs: DataFrame, min_docs: int = 20, share: float = 0.01, keep_share: float = 0.5,
                 min_words: int = 25, gone: bool = False, max_docs: int = 100) -> DataFrame:
    """One row per document: row, statistics, removed_words, base_failed, kept;
    with ``gone`` also the hashes of its removed lines."""
    stats = materialize(docs.select(
        "doc_id", F.col("source").alias("host"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"),
        "text").mapInArrow(line_scan, STATS), "lines")
    limits = (stats.groupBy("host", "text_hash").agg(F.lit(1).alias("one"))
              .groupBy("host").agg(F.greatest(F.lit(min_docs), F.least(F.lit(max_docs), F.count("*") * share)).alias("limit")))
    lines = stats.select("row", "host", "text_hash", F.explode(F.arrays_zip("lines", "line_words")).alias("l")).select(
        "row", "host", "text_hash", F.col("l.lines").alias("line"), F.col("l.line_words").alias("words"))
    # (host, line) as one hash, so that the keys of a hot host spread
    lines = lines.withColumn("key", F.xxhash64(F.coalesce("host", F.lit("")), F.col("host").isNull(), F.col("line")))
    seen = (lines.groupBy("key", "text_hash").agg(F.first("host").alias("host"))
            .groupBy("key").agg(F.count("*").alias("docs"), F.first("host").alias("host")).filter(F.col("docs") > min_docs))
    often = (seen.join(limits.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h")))
             .filter(F.col("docs") > F.col("limit")).select("key"))
    removed = lines.join(often, "key", "left_semi").groupBy("row").agg(
        F.sum("words").alias("removed"), *([F.collect_set("line").alias("gone")] if gone else []))
    j = stats.drop("lines", "line_words").join(removed, "row", "left")
    left = F.col("n_words") - F.coalesce("removed", F.lit(0))
    base = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    depleted = (left < min_words) | (left < F.col("n_words") * keep_share)
    return (j.withColumn("removed_words", F.coalesce("removed", F.lit(0)).cast("long"))
            .withColumn("base_failed", base).withColumn("kept", ~base & ~depleted).drop("removed"))


def op6(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return line_quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                     "base_failed", "kept", "removed_words")


def _strip(text: pd.Series, gone: pd.Series) -> pd.Series:
    """Texts without the lines whose normalised hash is listed."""
    out = text.copy()
    for i in np.flatnonzero(gone.notna().to_numpy() & text.notna().to_numpy()):
        lines = text.iloc[i].split("\n")
        buf, offs = to_bytes(pa.array(lines))
        _, hashes, owner = _normalised(Words(buf, offs), LOWER[buf])
        bad = set(owner[np.isin(hashes, np.asarray(gone.iloc[i], dtype=np.int64))].tolist())
        out.iloc[i] = "\n".join(x for k, x in enumerate(lines) if k not in bad)
    return out


def keep_quality(docs: DataFrame, **limits) -> DataFrame:
    """The rows of ``docs`` that the rules keep, without the removed lines, with
    the columns of ``docs`` (``n_chars``, where there is one, counted anew).

    A verdict is a function of (source, text), so it joins back on the two."""
    v = line_quality(docs, gone=True, **limits).filter("not kept or gone is not null")
    v = v.groupBy("host", "text_hash").agg(F.first("kept").alias("kept"), F.first("gone").alias("gone"))
    x = docs.select(F.struct("*").alias("d")).withColumn("x_hash", F.xxhash64(F.coalesce("d.text", F.lit(""))))
    j = (x.join(v, (F.col("x_hash") == F.col("text_hash")) & F.col("d.source").eqNullSafe(F.col("host")), "left")
         .filter(F.coalesce("kept", F.lit(True))))
    strip = F.pandas_udf(_strip, "string")
    j = j.select("d", strip("d.text", "gone").alias("t"))
    d = F.col("d").withField("text", F.col("t"))
    if "n_chars" in docs.columns:
        d = d.withField("n_chars", F.when(F.col("d.text") == F.col("t"), F.col("d.n_chars"))
                        .otherwise(F.length("t").cast(docs.schema["n_chars"].dataType)))
    return j.select(d.alias("d")).select("d.*")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)),
                              lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
win AS (SELECT rid, i, array_to_string(w[i:i + 2], ' ') AS k
        FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (
          SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM (
            SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM win) WHERE c > 1) GROUP BY rid),
ln AS (SELECT rid, source, t, len(lw) AS n, translate(array_to_string(lw, ' '),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS l
       FROM (SELECT rid, source, t, regexp_extract_all(unnest(ls), '[^\x20\x09-\x0D]+') AS lw FROM d)),
lim AS (SELECT source, greatest(20, least(100, count(DISTINCT t) * 0.01)) AS lim FROM d GROUP BY source),
often AS (SELECT ln.source, l FROM ln JOIN lim ON ln.source IS NOT DISTINCT FROM lim.source
          GROUP BY ln.source, l, lim HAVING count(DISTINCT t) > lim),
rem AS (SELECT rid, sum(n) AS n FROM ln JOIN often o ON ln.l = o.l AND ln.source IS NOT DISTINCT FROM o.source GROUP BY rid),
s AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, len(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
             (len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
             coalesce(rem.n, 0)::BIGINT AS removed_words
      FROM d LEFT JOIN rep USING (rid) LEFT JOIN rem USING (rid)),
b AS (SELECT *, n_words < 50 OR n_repeat_words * 100 > n_words * 50 AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_words - removed_words >= 25 AND n_words - removed_words >= n_words * 0.5 AS kept,
       removed_words
FROM b
"""
