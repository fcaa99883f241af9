"""op3, op5, op6, op8, op9, op10 and the pipeline on the odd documents."""

import math
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from lensmap.llm import hmm, line_rules, mixing, queries, rule_ensemble, templates, token_rollup
from lensmap.plans.oracle import check, duck
from tests.llm.data import LOW, crc, words


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, sf_dir, name):
    c = check(spark, duck(sf_dir), sf_dir, name, queries.QUERIES[name], queries.ORACLES[name])
    assert c.match, c.detail


def brute_lines(rows, min_docs, share, keep, least):
    low = lambda x: tuple(x.encode().translate(LOW).split())
    seen, hosts = {}, {}
    for r in rows:
        hosts.setdefault(r[3], set()).add(r[1] or "")
        for x in (r[1] or "").split("\n"):
            if low(x):
                seen.setdefault((r[3], low(x)), set()).add(r[1] or "")
    out = []
    for r in rows:
        t, w = r[1] or "", words(r[1])
        lines = [x for x in t.split("\n") if x.encode().split()]
        c = Counter(zip(w, w[1:], w[2:]))
        rep = {p for i, g in enumerate(zip(w, w[1:], w[2:])) if c[g] > 1 for p in (i, i + 1, i + 2)}
        gone = sum(len(low(x)) for x in lines if len(seen[r[3], low(x)]) > max(min_docs, share * len(hosts[r[3]])))
        base = len(w) < 50 or 100 * len(rep) > 50 * len(w)
        left = len(w) - gone
        out.append((r[0], len(w), sum(len(x.decode()) for x in w), sum(ch in "#*$%&|<>" for ch in t),
                    len(lines) - len(set(lines)), len(rep), base, not base and left >= least and left >= keep * len(w), gone))
    return out


def test_line_rules(odd, odd_rows):
    got = line_rules.line_quality(odd, min_docs=2, share=0.1, keep_share=0.8, min_words=40)
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept, r.removed_words)
                  for r in got.collect())
    assert got == Counter(brute_lines(odd_rows, 2, 0.1, 0.8, 40))
    assert any(k[7] for k in got) and any(k[8] for k in got)


def test_line_limit_does_not_grow_with_the_host(spark):
    text = lambda i, line: "\n".join([line, " ".join(f"w{i}x{j}" for j in range(60))])
    rows = [(i, text(i, "seen in thirty of them" if i < 30 else f"own line {i}"), "big") for i in range(6000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    gone = lambda **how: line_rules.line_quality(d, **how).filter("removed_words > 0").count()
    assert gone(min_docs=5, max_docs=25) == 30 and gone(min_docs=5, max_docs=40) == 0


def test_keep_quality_strips_lines(odd, odd_rows):
    how = {"min_docs": 2, "share": 0.1, "keep_share": 0.3, "min_words": 25}
    out = line_rules.keep_quality(odd, **how)
    assert out.columns == odd.columns
    want = [r for r, b in zip(odd_rows, brute_lines(odd_rows, 2, 0.1, 0.3, 25)) if b[7]]
    assert Counter(r.doc_id for r in out.collect()) == Counter(r[0] for r in want)
    left = brute_lines([tuple(r) for r in out.collect()], 10 ** 9, 1, 0, 0)
    full = Counter((b[0], b[1] - b[8]) for r, b in zip(odd_rows, brute_lines(odd_rows, 2, 0.1, 0.3, 25)) if b[7])
    assert Counter((b[0], b[1]) for b in left) == full


def test_line_rules_empty(none):
    assert line_rules.line_quality(none).collect() == []
    assert line_rules.keep_quality(none).collect() == []


def targets(size, cap=3):
    """Targets by the rounds of the rule itself: share, stop at the ceiling, reshare."""
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, out, free = sum(size.values()), {}, set(order)
    while free:
        level = (total - sum(out.values())) / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > cap * size[s]}
        if not full:
            out |= {s: level * weight[s] for s in free}
            break
        out |= {s: cap * size[s] for s in full}
        free -= full
    return out


def test_mixing(odd, odd_rows):
    size = Counter()
    for r in odd_rows:
        size[r[3]] += len(words(r[1]))
    want = targets(size)
    plan = mixing.mix_plan(odd).collect()
    assert len(plan) == len(odd_rows)
    for r in plan:
        s = r.d.source
        assert r.source_size == size[s] and math.isclose(r.target, want[s], rel_tol=1e-9, abs_tol=1e-9)
        assert r["size"] == len(words(r.d.text)) and 0 <= r.copies <= 3
    out = mixing.mix_sources(odd)
    assert out.columns == odd.columns and out.count() == sum(r.copies for r in plan)
    assert Counter(map(tuple, out.collect())) == Counter(map(tuple, mixing.mix_sources(odd.repartition(5)).collect()))


def test_mixing_targets_with_ceilings(spark):
    size = {"a": 10, "b": 1000, "c": 5, "": 0, None: 700, "é": 3}
    t = mixing.source_targets(mixing.cyclic_weights(spark.createDataFrame(list(size.items()), "source string, source_size long")))
    got = {r.source: r.target for r in t.collect()}
    for s, x in targets(size).items():
        assert math.isclose(got[s], x, rel_tol=1e-9, abs_tol=1e-9)
    assert math.isclose(sum(got.values()), sum(size.values()))


def test_mixing_comes_near_its_targets(spark):
    docs = spark.range(20000).selectExpr("id doc_id", "concat_ws(' ', array_repeat('w', cast(id % 50 as int))) text",
                                         "concat('s', id % 4) source")
    for r in mixing.mix_plan(docs).groupBy("d.source").agg({"target": "first", "size": "sum"}).collect():
        pass
    rows = mixing.mix_plan(docs).selectExpr("d.source s", "target", "size * copies taken").groupBy("s").agg(
        {"target": "max", "taken": "sum"}).collect()
    assert all(abs(r["sum(taken)"] / r["max(target)"] - 1) < 0.05 for r in rows)


def test_mixing_empty(none):
    assert mixing.mix_sources(none).collect() == []


def test_rollup_batches(spark, tmp_path):
    schema = "op string, doc_id long, source string, lang string, tokenizer_version string, n_tokens long, sign int"
    df = lambda *rows: spark.createDataFrame([(*r, 9) for r in rows], schema)
    r = token_rollup.TokenRollup(spark, str(tmp_path / "roll"))
    assert r.totals().collect() == []
    assert r.commit("b1", df(("insert", 1, "a", "en", "v1", 10), ("insert", 2, "a", "en", "v1", 5), ("insert", 2, "a", "en", "v2", 7),
                             ("insert", None, None, None, None, None), ("insert", 3, "b", "de", "v1", 4), ("insert", 3, "b", "de", "v1", 6)))
    assert not r.commit("b1", df(("insert", 8, "a", "en", "v1", 100)))  # a replay changes nothing
    assert r.commit("b2", df(("revise", 1, "a", "fr", "v1", 12), ("delete", 2, "a", "en", "v1", 0), ("delete", 77, "a", "en", "v1", 0),
                             ("revise", 5, "c", "en", "v1", 1)))
    assert r.commit("empty", df())
    got = {(x.source, x.lang, x.tokenizer_version): (x.n_docs, x.n_tokens) for x in r.totals().collect()}
    assert got == {("a", "fr", "v1"): (1, 12), ("a", "en", "v2"): (1, 7), (None, None, None): (1, 0), ("b", "de", "v1"): (1, 6),
                   ("c", "en", "v1"): (1, 1)}
    # an attempt that died before its mark is not seen, and the batch can be run again
    r.deltas(df(("insert", 50, "z", "en", "v1", 9))).write.parquet(f"{r.root}/batches/b3-dead/ledger")
    assert ("z", "en", "v1") not in {(x.source, x.lang, x.tokenizer_version) for x in r.totals().collect()}
    assert r.commit("b3", df(("insert", 50, "z", "en", "v1", 9)))
    live = r.live(r.ledger()).collect()
    assert sum(x.tokens for x in live) == sum(x.n_tokens for x in r.totals().collect())


def test_rollup_of_documents(odd, odd_rows, spark, tmp_path):
    r = token_rollup.TokenRollup(spark, str(tmp_path / "roll"))
    rows = [x for x in odd_rows if x[0] is not None]
    counted = odd.filter("doc_id is not null").dropDuplicates(["doc_id"]).withColumn("counts", token_rollup.counts_of(odd["text"]))
    r.commit("all", token_rollup.changes_of(counted, "insert"))
    want = Counter()
    for x in {x[0]: x for x in rows}.values():
        want[x[3], x[2]] += len(words(x[1]))
    got = {(x.source, x.lang): x.n_tokens for x in r.totals().filter("tokenizer_version = 'words-1'").collect()}
    assert got == dict(want)


def test_rollup_dies_while_it_marks_a_batch(spark, tmp_path, monkeypatch):
    r = token_rollup.TokenRollup(spark, str(tmp_path / "roll"))
    rows = [("insert", i, "s", "en", "words-1", 10) for i in range(5)]
    batch = spark.createDataFrame(rows, "op string, doc_id long, source string, lang string, tokenizer_version string, n_tokens long")
    with monkeypatch.context() as m:
        m.setattr(token_rollup.TokenRollup, "_publish", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            r.commit("one", batch)
    assert r.committed() == {} and r.totals().collect() == []
    assert r.commit("one", batch) is True and r.commit("one", batch) is False
    # a second writer whose work overlapped the first one's
    late = token_rollup.TokenRollup(spark, str(tmp_path / "roll"))
    with monkeypatch.context() as m:
        m.setattr(token_rollup.TokenRollup, "committed", lambda self: {})
        assert late.commit("one", batch) is False
    assert [(x.n_docs, x.n_tokens) for x in r.totals().collect()] == [(5, 50)]


QUESTION = "A train leaves Boston with 40 cars and travels 300 miles in 5 hours while Alice waits for 40 minutes near the old station"


def test_templates(spark):
    swap = QUESTION.replace("300", "450").replace("5 hours", "9 hours").replace("Alice", "Carol").replace("40", "62").replace("Boston", "Denver")
    broken = QUESTION.replace("with 40", "with 41").replace("for 40", "for 99").replace("300", "7").replace("Alice", "Boston")
    other = "the old mill by the river has been closed since the flood took away the bridge and the road to it"
    docs = [(1, "Intro words here. " + QUESTION + " And more follows."), (2, "before it. " + swap),
            (3, other), (4, None), (5, ""), (None, QUESTION), (7, QUESTION[:60]), (8, "x " * 50_000 + swap), (1, QUESTION), (9, broken)]
    d = spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id long, text string, h int, item_id int")
    b = spark.createDataFrame([(11, QUESTION), (12, None), (13, "too short"), (14, "the old mill by the road")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in templates.contaminated(d, b).collect()}
    assert got == {(1, 11), (2, 11), (None, 11), (8, 11), (9, 11)}
    # values that change on the way: 8 of 9 slots of the last one agree
    how = {"min_consistent": 0.9}
    assert {(r.doc_id, r.item_id) for r in templates.contaminated(d, b, **how).collect()} == got - {(9, 11)}
    kept = templates.decontaminate(d, b, **how)
    assert kept.columns == d.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 7, 9]
    assert templates.decontaminate(d, b.limit(0)).count() == len(docs)
    assert templates.contaminated(d.limit(0), b).collect() == []


SLOT_HEAVY = ["Find 3 + 4 * 2 - 7", "What Is The Capital Of The Northern Province Of Old Carinthia", "Solve 12 + 5 = 17 and 8 + 9 = 17 for 3 numbers",
              "Der Hund Fritz jagt die Katze Mimi durch den Garten von Frau Schulze", "12 34 56 78 90 12", "Alice Bob Carol Dave Eve Mallory Trent"]


def template_tables(spark):
    stock = "this passage is often quoted by people who like to quote"          # five windows of every item below
    items = [(i, t) for i, t in enumerate(SLOT_HEAVY)]
    items += [(100 + i, f"question {chr(97 + i)}x asks why {stock} when nobody {chr(97 + i)}y was there to hear the bell ring {chr(97 + i)}z") for i in range(20)]
    items += [(200, "Yes"), (201, "Paris, France"), (202, "the red door"), (203, "Opening words stand here without a name"), (204, ""), (205, None)]
    filler = "some plain words come first and then a little more of them "
    texts = [filler + t + " and on it goes." for t in SLOT_HEAVY] + [t + "\n" + filler for t in SLOT_HEAVY]
    texts += [f"{filler}{chr(97 + i % 26)}{chr(97 + i // 26)} {stock} {filler}" for i in range(60)]
    texts += [filler + items[8][1], "he said Yes to Paris, France and to the red door", "one line\n  paris france!\nthe Red Door.", "YES",
              "spliced in after a comma, Opening words stand here without a name", "Then. " + items[-3][1], "3 4 2 7", None, "", "5 * 5"]
    texts += ["Find 9 + 8 * 7 - 6", "What Is The Name Of The Southern District Of New Slavonia"]           # other contents of the same shape
    docs = [(i, t) for i, t in enumerate(texts)]
    return docs, items


def test_templates_against_sql(spark):
    import duckdb
    import pandas as pd
    docs, items = template_tables(spark)
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(docs, columns=["doc_id", "text"]))
    con.register("benchmark", pd.DataFrame(items, columns=["item_id", "text"]))
    want = sorted(con.execute(templates.SQL).fetchall())
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = templates.contaminated(d, b)
    assert got.columns == ["doc_id", "item_id", "n_windows", "n_slots"]
    assert sorted(tuple(r) for r in got.collect()) == want
    found = {(x[0], x[1]) for x in want}
    n = len(SLOT_HEAVY)
    assert {(i, i) for i in range(n)} | {(n + i, i) for i in range(n)} <= found        # verbatim copies, in prose and as lines
    at = 2 * n + 60
    assert {(at, items[8][0]), (at + 2, 201), (at + 2, 202), (at + 3, 200), (at + 4, 203), (at + 5, 203)} <= found
    assert not {x[0] for x in want} & {at + 1, at + 6, at + 7, at + 8, at + 9, at + 10, at + 11, *range(2 * n, at)}


def test_a_stock_phrase_pairs_nothing(spark):
    """Texts and items that only share a phrase of fewer windows than a hit needs do not meet."""
    docs, items = template_tables(spark)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    made = templates.materialize(templates._items(spark.createDataFrame(items, "item_id long, text string"), 8, 0.5, 6), "t")
    found = templates._found(d, made)
    seen = []
    keep = templates.materialize
    try:
        templates.materialize = lambda df, what: seen.append((what, df.count())) or keep(df, what)
        templates._diagonals(found, made)
    finally:
        templates.materialize = keep
    shared = found.join(made, "hash").select("h", "item_id").distinct().count()
    assert shared >= 60 * 20 and dict(seen)["template-anchored"] < 60


def test_rule_ensemble_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = rule_ensemble.quality_scores(docs, labels)
    assert got.count() == docs.count()
    j = got.join(labels, "doc_id").filter("held_out").toPandas()
    assert (j.predicted == j.quality).mean() > 0.95
    assert all((crc(i) % 4 == 2) for i in j.doc_id)


def test_rule_ensemble_odd(odd, none, spark):
    labels = spark.createDataFrame([(i, int(i % 2), 0) for i in range(40)] + [(None, 1, 0), (3, None, 0), (5, 0, 0)],
                                   "doc_id long, quality int, toxic int")
    rows = rule_ensemble.quality_scores(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert all(r.held_out == (r.doc_id is not None and crc(r.doc_id) % 4 == 2) for r in rows)
    assert {r.score for r in rule_ensemble.quality_scores(odd, labels.limit(0)).collect()} == {0.5}
    assert rule_ensemble.quality_scores(none, labels).collect() == []
    # labels of held-out rows change nothing
    from pyspark.sql import functions as F
    flipped = labels.withColumn("quality", F.when(rule_ensemble.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    key = lambda r: (r.doc_id is not None, r.doc_id or 0, r.score)
    assert sorted(rule_ensemble.quality_scores(odd, flipped).collect(), key=key) == sorted(rows, key=key)


def test_language_model(odd, odd_rows):
    got = hmm.score(odd).collect()
    tok = lambda t: [*(t or "").encode().translate(LOW).split(), None]
    held = lambda i: i is not None and crc(i) % 7 == 2
    c = Counter(w for r in odd_rows if not held(r[0]) for w in tok(r[1]))
    n, v = sum(c.values()), len(c)
    want = Counter()
    for r in odd_rows:
        t = tok(r[1])
        want[r[0], held(r[0]), len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 6)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)


def test_language_model_empty(none):
    assert hmm.score(none).collect() == []


def test_forward_is_exact_and_training_raises_likelihood():
    rng = np.random.default_rng(0)
    m = hmm.Model(rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(5), 3))
    seqs = [rng.integers(0, 5, n) for n in (1, 4, 6)]
    got = hmm.forward(m, np.concatenate(seqs), np.array([1, 4, 6]))
    import itertools
    for s, g in zip(seqs, got):
        p = sum(m.start[z[0]] * m.B[z[0], s[0]] * math.prod(m.A[a, b] * m.B[b, o] for a, b, o in zip(z, z[1:], s[1:]))
                for z in itertools.product(range(3), repeat=len(s)))
        assert math.isclose(math.log(p), g, rel_tol=1e-9)
    long = rng.integers(0, 5, 50_000)  # no underflow
    assert np.isfinite(hmm.forward(m, long, np.array([50_000]))).all()
    # counts equal the posterior sums of all paths, however a text is cut into windows
    for window, block in ((6, 100), (4, 100), (2, 100), (2, 3), (1, 1)):
        start, A, B, lik = np.zeros(3), np.zeros((3, 3)), np.zeros((3, 5)), 0.0
        for s in seqs:
            paths = {z: m.start[z[0]] * m.B[z[0], s[0]] * math.prod(m.A[a, b] * m.B[b, o] for a, b, o in zip(z, z[1:], s[1:]))
                     for z in itertools.product(range(3), repeat=len(s))}
            total = sum(paths.values())
            lik += math.log(total)
            for z, p in paths.items():
                start[z[0]] += p / total
                for a, b in zip(z, z[1:]):
                    A[a, b] += p / total
                for a, o in zip(z, s):
                    B[a, o] += p / total
        c = hmm.expected_counts(m, np.concatenate(seqs), np.array([1, 4, 6]), window, block)
        assert np.allclose(c, np.concatenate([start, A.ravel(), B.ravel(), [lik, 11]]), atol=1e-4)


def test_language_model_score(spark, odd, odd_rows):
    """Scores of a given model equal plain Python over whole texts; words without training count included."""
    from lensmap.llm.textscan import span_hash
    rng = np.random.default_rng(3)
    k, classes = hmm.STATES, hmm.CLASSES
    m = hmm.Model(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(classes), k))
    tok = lambda t: [*(t or "").encode().translate(LOW).split(), None]
    held = lambda i: i is not None and crc(i) % 7 == 2

    def cls(w):
        buf = np.frombuffer(w or b"", np.uint8)
        return 0 if w is None else max(int(span_hash(buf, np.array([0]), np.array([len(buf)]))[0]), 1) % (classes - 1) + 1

    c = Counter(w for r in odd_rows if not held(r[0]) for w in tok(r[1]))
    n_class, v_class = Counter(), Counter()
    for w, x in c.items():
        n_class[cls(w)] += x
        v_class[cls(w)] += 1

    def plain(t):
        out, a = 0.0, None
        for w in tok(t):
            j = cls(w)
            a = (m.start if a is None else a @ m.A) * m.B[:, j]
            lex = 1.0 if w is None else (c[w] + 1) / (n_class[j] + v_class[j] + 1)
            out += math.log10(a.sum()) + math.log10(lex)
            a = a / a.sum()
        return round(out, 5)

    want = Counter((r[0], plain(r[1])) for r in odd_rows)
    assert Counter((r.doc_id, round(r.score, 5)) for r in hmm.score(odd, model=m).collect()) == want


def test_pipeline(spark, odd, tmp_path):
    """Every stage on the odd documents: columns stay, and each result is the operator's own."""
    sf = str(tmp_path)
    spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").write.parquet(f"{sf}/benchmark.parquet")
    docs = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == odd.columns
        docs = spark.createDataFrame(out.collect(), odd.schema)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    pytest.importorskip("tokenizers")
    from tests.llm.test_files import want_ids
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in last), key=lambda r: r[1]) == want_ids(
        [(r.doc_id, r.text) for r in docs.collect()])


def test_pipeline_run(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and got.count() > 0


def test_window_hashes_are_those_of_the_windows(spark):
    """Hashes put together from those of words are the hashes of each window's tokens."""
    from pyspark.sql import functions as F
    docs, _ = template_tables(spark)
    docs += [(900, "They met John Mary Ann Smith, Bob; 4 Ada in New York and Old Rome 3 km on"), (901, "a b c d e f"), (902, "ΑΣ ΟΔΟΣ said Émile to Ñandú Ⅷ times İn ①x 3")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = templates.window_hashes(d.select("doc_id", templates._clean(F.col("text")).alias("c")), [5, 6, 7, 8])
    w = d.select("doc_id", templates.marked_words(F.col("text")).alias("w"))
    w = w.withColumn("t", templates.template(F.col("w"))).withColumn("p", templates.plain(F.col("w")))
    want = w
    for k in (5, 6, 7, 8):
        each = F.transform(F.sequence(F.lit(1), F.size("t") - (k - 1)), lambda i: templates.token_hash(
            templates._window(F.col("t"), F.col("p"), i, F.lit(k)), F.lit(k), [k]))  # noqa: B023
        want = want.withColumn(f"hash{k}", F.when(F.size("t") >= k, each).otherwise(F.array().cast("array<long>")))
    names = ["doc_id", "hash5", "hash6", "hash7", "hash8"]
    assert sorted(map(tuple, got.select(names).collect())) == sorted(map(tuple, want.select(names).collect()))
