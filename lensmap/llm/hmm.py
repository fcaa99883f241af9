"""Hidden Markov language model: Baum-Welch over partitions, scaled forward scores.

A text is its lower-cased (A-Z) words and one end token.  Hidden states follow a
Markov chain; a state emits a word class (a hash of the word; the end has its
own), and the class emits the word:

    P(w | state) = B[state, class(w)] * (c(w) + 1) / (N_class + V_class + 1)

c(w) is the word's count in the training texts, N_class and V_class are the
tokens and distinct words of the class there; the added one is the class's share
for words never seen.  So the latent part is of fixed size (states x classes)
whatever the vocabulary, and the lexical part is the whole vocabulary, which
stays a distributed table.

1. ``encode``: one numpy pass turns slices of a few MB of text into index
   sequences over the slice's distinct words (written once).
2. ``word_totals``: (slice, word) counts are summed in their tasks, then by word;
   ``word_counts`` joins them back to the slices, where a word has one row per
   slice and the join may split a frequent one.
3. ``train``: Baum-Welch on whole texts.  A text is cut into windows only to make
   the recursion a matrix operation: the product of each window's transition and
   emission matrices carries the exact forward message to its first token and the
   exact backward message to its last, and the transitions between windows are
   counted, so the counts are those of the uncut text.  Expected counts are summed
   inside each partition, then over groups of partitions; the driver sees a bounded
   number of states x classes tables.  The start is the training texts' class counts,
   unevenly shared among the states.  ``PASSES`` passes take the slices in ``PARTS``
   hashed parts and re-estimate after each (stepwise EM); then rounds over all
   slices run until the likelihood of a token settles (``TOL``) or ``ROUNDS`` are done.
4. ``score``: the scaled forward recursion runs over whole texts, from first word
   to end, so the log probability is exact under the model.

Defined cases: a null or empty text is the end token alone; a null doc_id is
never held out; repeated rows are scored (and counted) each; without training
texts N = V = 0 and the untrained uniform model scores; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lensmap.llm.textscan import LOWER, Words, slices, span_hash, to_bytes
from lensmap.session import materialize

STATES = 8
CLASSES = 2048      # class 0 is the end token
WINDOW = 512        # tokens of a window
BLOCK = 400_000     # tokens whose messages are held at once (a window at least)
PARTS = 8           # parts of a stepwise pass
PASSES = 2          # stepwise passes
STEP = 0.7          # part k's counts enter with weight (k + 2) ** -STEP
ROUNDS = 6          # Baum-Welch rounds over all training texts at most
FLOOR = 1e-4        # share of a distribution that is spread over everything
SCALE = 4           # steps between two scalings of a message
TOL = 0.01          # nats of a token's likelihood under which it has settled
END = np.uint64(0)  # hash of the end token (word hashes of 0 are moved to 1)

SLICE = ("slice long, doc_id array<long>, held array<boolean>, n_tokens array<int>, words array<long>, "
         "tf array<int>, idx binary")


def word_class(h: np.ndarray) -> np.ndarray:
    """Class of each word hash: 0 for the end, else 1..CLASSES-1."""
    c = (h % np.uint64(CLASSES - 1)).astype(np.int64) + 1
    c[h == END] = 0
    return c


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, at = TaskContext.get().partitionId(), 0
    z = zstandard.ZstdCompressor(level=1)
    for b in slices(batches, max_bytes=3 << 20):
        buf, offs = to_bytes(b.column("text"))
        buf = LOWER[buf]
        w = Words(buf, offs)
        h = np.maximum(span_hash(buf, w.start, w.end), np.uint64(1))
        n = w.count + 1
        ends = np.cumsum(n) - 1
        seq = np.zeros(int(n.sum()), dtype=np.uint64)
        seq[np.arange(len(h)) + w.doc] = h
        seq[ends] = END
        code, words = pd.factorize(seq)
        order = np.argsort(-np.bincount(code, minlength=len(words)), kind="stable")
        rank = np.empty(len(words), dtype=np.int64)
        rank[order] = np.arange(len(words))
        idx = rank[code].astype("<u4")
        held = np.array(b.column("held").to_pylist(), dtype=bool)
        train = np.repeat(~held, n)
        tf = np.bincount(idx[train], minlength=len(words)).astype(np.int32)
        planes = np.concatenate([(idx & 0xFFFF).astype("<u2").view(np.uint8), (idx >> 16).astype("<u2").view(np.uint8)])
        one = lambda a, t: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), pa.array(a, t))
        yield pa.RecordBatch.from_arrays(
            [pa.array([(part << 24) + at], pa.int64()), one(b.column("doc_id").to_pylist(), pa.int64()),
             one(held, pa.bool_()), one(n.astype(np.int32), pa.int32()), one(words[order].view(np.int64), pa.int64()),
             one(tf, pa.int32()), pa.array([z.compress(planes.tobytes())], pa.binary())],
            names=[c.split()[0] for c in SLICE.split(", ")])
        at += 1


def unpack_idx(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype="<u2")
    n = len(raw) // 2
    return raw[:n].astype(np.int64) | raw[n:].astype(np.int64) << 16


def encode(docs: DataFrame, mod: int = 7, fold: int = 2) -> DataFrame:
    """One row per slice of texts (see SLICE); held: crc32(doc_id) mod ``mod`` is ``fold``."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod == fold, F.lit(False))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held"), "text").mapInArrow(_encode, SLICE)


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for s, w, tf in zip(b.column("slice").to_pylist(), b.column("words"), b.column("tf")):
            h, n = w.values, tf.values
            for i in range(0, len(h), 50_000):
                k = len(h[i:i + 50_000])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(k, s)), pa.array(np.arange(i, i + k, dtype=np.int32)), h[i:i + k], n[i:i + k]],
                    names=["slice", "i", "word", "tf"])


def _word_rows(slices_: DataFrame) -> DataFrame:
    return slices_.select("slice", "words", "tf").mapInArrow(_explode, "slice long, i int, word long, tf int")


def word_totals(slices_: DataFrame) -> DataFrame:
    """word, c: its count in the training texts (0 where only held-out texts have it)."""
    return _word_rows(slices_).groupBy("word").agg(F.sum("tf").alias("c"))


def word_counts(slices_: DataFrame, totals: DataFrame) -> DataFrame:
    """slice, i (index of the word in its slice), word, c."""
    return _word_rows(slices_).select("slice", "i", "word").join(totals.hint("shuffle_hash"), "word").select("slice", "i", "word", "c")


class Model:
    """start (K), A (K x K), B (K x classes); rows are distributions."""

    def __init__(self, start, A, B):
        self.start, self.A, self.B = start, A, B

    @classmethod
    def untrained(cls, k: int = STATES, classes: int = CLASSES):
        return cls(np.full(k, 1 / k), np.full((k, k), 1 / k), np.full((k, classes), 1 / classes))

    @classmethod
    def begin(cls, n_class: np.ndarray, k: int = STATES):
        """States that tend to stay, each with its own uneven share of the class counts."""
        base = (n_class + 0.5) * np.random.default_rng(7).uniform(0.5, 1.5, size=(k, len(n_class)))
        A = np.full((k, k), 0.1 / (k - 1)) + np.eye(k) * (0.9 - 0.1 / (k - 1))
        return cls(np.full(k, 1 / k), A, base / base.sum(axis=1, keepdims=True))

    @classmethod
    def of(cls, counts: np.ndarray, k: int = STATES, classes: int = CLASSES):
        """Maximisation step; every state and class keeps a share of ``FLOOR`` at least, whatever the corpus' size."""
        start, A = counts[:k], counts[k:k + k * k].reshape(k, k)
        B = counts[k + k * k:k + k * k + k * classes].reshape(k, classes)
        every = B.sum(axis=0) + 1.0
        B = B + every / every.sum() * 10.0
        norm = lambda x, low: (1 - FLOOR) * x / x.sum(axis=-1, keepdims=True) + FLOOR * low
        return cls(norm(start + 0.1, 1 / k), norm(A + 0.1, 1 / k), norm(B, every / every.sum()))


TINY = np.float32(1e-30)


def _unit(x: np.ndarray, axis) -> np.ndarray:
    return x / np.maximum(x.sum(axis=axis, keepdims=True), TINY)


def _messages(A, Bt, start, cls, lo, size, nth, last) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per window: forward message of the token before it, prior of its first token's state, backward message of its last token.

    ``nth`` is a window's place in its text, ``last`` whether it ends the text."""
    S, K = len(lo), len(A)
    before, prior, after = np.zeros((S, K), dtype=np.float32), np.tile(start, (S, 1)), np.ones((S, K), dtype=np.float32)
    cut = np.flatnonzero((nth > 0) | ~last)  # windows of texts with more than one
    if not len(cut):
        return before, prior, after
    full = cut[np.argsort(-size[cut], kind="stable")]
    live = np.searchsorted(-size[full], -np.arange(1, int(size[full[0]]) + 1), side="right")
    P = np.tile(np.eye(K, dtype=np.float32), (len(full), 1, 1))
    for t, n in enumerate(live.tolist()):
        Q = (P[:n].reshape(-1, K) @ A).reshape(n, K, K) if t else P[:n]
        np.multiply(Q, Bt[cls[lo[full[:n]] + t]][:, None, :], out=P[:n])
        if t % SCALE == SCALE - 1:
            P[:n] /= np.maximum(P[:n].max(axis=(1, 2), keepdims=True), TINY)
    P /= np.maximum(P.max(axis=(1, 2), keepdims=True), TINY)
    at = np.empty(S, dtype=np.int64)
    at[full] = np.arange(len(full))
    by_place = cut[np.argsort(nth[cut], kind="stable")]
    ends = np.cumsum(np.bincount(nth[by_place]))
    groups = np.split(by_place, ends[:-1])
    for g in groups[1:]:
        before[g] = _unit(np.einsum("ni,nij->nj", prior[g - 1], P[at[g - 1]]), 1)
        prior[g] = before[g] @ A
    for g in groups[:0:-1]:
        after[g - 1] = _unit(np.einsum("nij,nj->ni", P[at[g]], after[g]), 1) @ A.T
    return before, prior, after


def expected_counts(m: Model, cls: np.ndarray, n_tokens: np.ndarray, window: int = WINDOW, block: int = BLOCK) -> np.ndarray:
    """Baum-Welch counts of texts laid end to end: start, A, B flattened, then log likelihood and tokens."""
    K, C = m.B.shape
    out_start, out_a, out_b, loglik = np.zeros(K), np.zeros((K, K)), np.zeros((K, C)), 0.0
    n_tokens = n_tokens[n_tokens > 0]
    if len(n_tokens):
        offs = np.concatenate([[0], np.cumsum(n_tokens)])
        per = (n_tokens + window - 1) // window
        doc = np.repeat(np.arange(len(n_tokens)), per)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
        lo = offs[doc] + nth * window
        size = np.minimum(offs[doc + 1] - lo, window)
        last = nth == per[doc] - 1
        mean = m.B.mean(axis=0)  # emissions are used as ratios to it, so that messages need scaling now and then only
        Bt = np.ascontiguousarray((m.B / mean).T.astype(np.float32))
        loglik = float(np.bincount(cls, minlength=C) @ np.log(mean))
        A, start = m.A.astype(np.float32), m.start.astype(np.float32)
        before, prior, after = _messages(A, Bt, start, cls, lo, size, nth, last)
        cuts = np.flatnonzero(np.diff(np.cumsum(size) // block)) + 1
        for w in np.split(np.arange(len(lo)), cuts):
            w = w[np.argsort(-size[w], kind="stable")]
            loglik += _window_counts(A, Bt, cls, lo[w], size[w], before[w], prior[w], after[w], out_start, out_a, out_b)
    return np.concatenate([out_start, (out_a * m.A).ravel(), out_b.ravel(), [loglik, float(n_tokens.sum())]])


def _window_counts(A, Bt, cls, lo, size, before, prior, after, out_start, out_a, out_b) -> float:
    """Adds the counts of windows (longest first) given their messages; returns their log likelihood.

    The transition between two windows is counted in the second."""
    K, T, loglik = len(A), int(size[0]), 0.0
    At = np.ascontiguousarray(A.T)
    live = np.searchsorted(-size, -np.arange(1, T + 1), side="right").tolist()
    alphas, emis, seen = [], [], []
    a = prior
    for t, n in enumerate(live):
        o = cls[lo[:n] + t]
        e = Bt[o]
        a = (a[:n] @ A if t else a[:n]) * e
        if t % SCALE == SCALE - 1:
            s = np.maximum(a.sum(axis=1, keepdims=True), TINY)
            loglik += float(np.log(s).sum(dtype=np.float64))
            a /= s
            e /= s
        alphas.append(a)
        emis.append(e)
        seen.append(o)
    end = np.concatenate([alphas[t][(live[t + 1] if t + 1 < T else 0):live[t]] for t in range(T - 1, -1, -1)])
    loglik += float(np.log(np.maximum(end.sum(axis=1), TINY)).sum(dtype=np.float64))
    tail = after / np.maximum((end * after).sum(axis=1, keepdims=True), TINY)  # so that forward . backward is 1 everywhere
    beta = tail[:0]
    for t in range(T - 1, -1, -1):
        n = live[t]
        if len(beta) < n:
            beta = np.concatenate([beta, tail[len(beta):n]])
        eb = emis[t] * beta
        if t:
            out_a += alphas[t - 1][:n].T @ eb
        else:
            inner = before.any(axis=1)
            first = eb / np.maximum((prior * eb).sum(axis=1, keepdims=True), TINY)
            out_start += (prior * first)[~inner].sum(axis=0)
            out_a += before[inner].T @ first[inner]
        np.multiply(alphas[t], beta, out=emis[t])
        beta = eb @ At
    g, o = np.concatenate(emis).T.astype(np.float64, order="C"), np.concatenate(seen)
    for j in range(K):
        out_b[j] += np.bincount(o, weights=g[j], minlength=out_b.shape[1])
    return loglik


def _training(row_words, row_idx, row_held, row_n) -> tuple[np.ndarray, np.ndarray]:
    """Classes and lengths of the training texts of a slice."""
    cls = word_class(row_words.view(np.uint64))[unpack_idx(row_idx)]
    keep = ~row_held
    return cls[np.repeat(keep, row_n)], row_n[keep]


def _np(scalar) -> np.ndarray:
    return scalar.values.to_numpy(zero_copy_only=False)


def _estep(m: Model, groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for w, i, held, n in zip(b.column("words"), b.column("idx"), b.column("held"), b.column("n_tokens")):
                cls, size = _training(_np(w), i.as_py(), _np(held).astype(bool), _np(n).astype(np.int64))
                got = expected_counts(m, cls, size)
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId() % groups], pa.int64()), pa.array([total.tobytes()], pa.binary())],
                names=["g", "counts"])
    return run


def _add(t: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py()) for x in t.column("counts"))
    return pa.table({"g": t.column("g")[:1], "counts": pa.array([total.tobytes()], pa.binary())})


def _counts(src: DataFrame, m: Model, groups: int) -> np.ndarray | None:
    """Expected counts of the slices (see ``expected_counts``), None without training tokens."""
    rows = (src.mapInArrow(_estep(m, groups), "g long, counts binary").groupBy("g")
            .applyInArrow(_add, "g long, counts binary").orderBy("g").collect())
    total = sum(np.frombuffer(r["counts"]) for r in rows) if rows else np.zeros(1)
    return total if total[-1] else None


def train(slices_: DataFrame, n_class: np.ndarray, rounds: int = ROUNDS) -> Model:
    """``n_class``: training tokens per class."""
    if not n_class.any():
        return Model.untrained()
    src = slices_.select("slice", "words", "idx", "held", "n_tokens")
    groups = int(src.rdd.getNumPartitions() ** 0.5) + 1
    m, stats, k = Model.begin(n_class), None, 0
    total = float(n_class.sum())
    for part in [*range(PARTS)] * PASSES:  # counts of a part stand for all tokens
        got = _counts(src.filter(F.pmod(F.xxhash64("slice"), F.lit(PARTS)) == part), m, groups)
        if got is not None:
            got = got * (total / got[-1])
            weight = (k + 2) ** -STEP if k else 1.0
            stats, k = got if stats is None else (1 - weight) * stats + weight * got, k + 1
            m = Model.of(stats)
    seen = -np.inf
    for _ in range(rounds):
        got = _counts(src, m, groups)
        m, settled = Model.of(got), got[-2] / got[-1] - seen < TOL
        if settled:
            break
        seen = got[-2] / got[-1]
    return m


def forward(m: Model, cls: np.ndarray, n_tokens: np.ndarray) -> np.ndarray:
    """Natural log probability of each class sequence (texts laid end to end)."""
    offs = np.concatenate([[0], np.cumsum(n_tokens)])[:-1]
    order = np.argsort(-n_tokens, kind="stable")
    lo, size = offs[order], n_tokens[order]
    live = np.searchsorted(-size, -np.arange(1, int(size[0]) + 1), side="right").tolist() if len(size) else []
    mean = m.B.mean(axis=0)  # as in expected_counts
    Bt = np.ascontiguousarray((m.B / mean).T)
    out = np.add.reduceat(np.log(mean)[cls], offs)[order] if len(size) else np.zeros(0)
    a = np.tile(m.start, (len(size), 1))
    for t, n in enumerate(live):
        if len(a) > n:  # texts that ended
            out[n:len(a)] += np.log(a[n:].sum(axis=1))
        a = (a[:n] @ m.A if t else a[:n]) * Bt[cls[lo[:n] + t]]
        if t % SCALE == SCALE - 1:
            s = a.sum(axis=1)
            a /= s[:, None]
            out[:n] += np.log(s)
    out[:len(a)] += np.log(a.sum(axis=1))
    back = np.empty(len(size))
    back[order] = out
    return back


SCORE = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _scorer(m: Model, N: int, V: int, n_class: np.ndarray, v_class: np.ndarray):
    share = np.log10(n_class + v_class + 1.0)

    def run(enc: pa.Table, counts: pa.Table) -> pa.Table:
        i = counts.column("i").to_numpy()
        c, word = np.empty(len(i), np.int64), np.empty(len(i), np.uint64)
        c[i] = counts.column("c").to_numpy()
        word[i] = counts.column("word").to_numpy().view(np.uint64)
        of = word_class(word)
        base = np.log10((c + 1.0) / (N + V + 1.0))
        lex = np.where(of == 0, 0.0, np.log10(c + 1.0) - share[of])
        rows = []
        for ids, held, n, blob in zip(*(enc.column(x) for x in ("doc_id", "held", "n_tokens", "idx"))):
            n, idx = _np(n).astype(np.int64), unpack_idx(blob.as_py())
            cut = np.concatenate([[0], np.cumsum(n)])[:-1]
            total = lambda x: np.add.reduceat(x[idx], cut)
            score = total(lex) + forward(m, of[idx], n) / np.log(10)
            rows.append(pa.table([ids.values, held.values, pa.array(n), pa.array(total((c > 0).astype(np.int64))),
                                  pa.array(np.full(len(n), N)), pa.array(total(base)), pa.array(score)],
                                 names=[x.split()[0] for x in SCORE.split(", ")]))
        return pa.concat_tables(rows)
    return run


def class_column(word):
    """``word_class`` of a signed 64-bit hash column."""
    unsigned = word.cast("decimal(20)") + F.when(word < 0, F.lit(str(1 << 64)).cast("decimal(20)")).otherwise(0)
    return F.when(word == 0, 0).otherwise((unsigned % (CLASSES - 1)).cast("int") + 1)


def score(docs: DataFrame, mod: int = 7, fold: int = 2, rounds: int = ROUNDS, model: Model | None = None) -> DataFrame:
    """One row per document: see SCORE; ``score`` and ``base_score`` are log10 probabilities (of ``model``, if given)."""
    enc = materialize(encode(docs, mod, fold), "hmm-slices")
    totals = materialize(word_totals(enc), "hmm-words")
    per = (totals.filter("c > 0").groupBy(class_column(F.col("word")).alias("cls"))
           .agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect())  # CLASSES rows
    n_class, v_class = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in per:
        n_class[r["cls"]], v_class[r["cls"]] = r["n"], r["v"]
    m = model or train(enc, n_class, rounds)
    return (enc.select("slice", "doc_id", "held", "n_tokens", "idx").groupBy("slice")
            .cogroup(word_counts(enc, totals).groupBy("slice"))
            .applyInArrow(_scorer(m, int(n_class.sum()), int(v_class.sum()), n_class, v_class), SCORE))


def op10(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
