"""op11 against brute force on the odd documents."""

from itertools import permutations

import pytest

from lensmap.llm import filter_audit


def brute(rows, labels, part=2):
    quality = {d for d, q, _ in labels if d is not None and q == 1}
    toxic = {d for d, _, t in labels if d is not None and t == 1}
    ids = {}
    for r in rows:
        if r[0] is not None:
            ids.setdefault(r[1] or "", []).append(r[0])
    fails = []
    for r in rows:
        t = r[1] or ""
        w = t.encode().split()
        fails.append({x for x, bad in zip("ABCDE", (
            len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
            any(c in "#$%&*|" for c in t), r[0] is not None and any(i < r[0] for i in ids.get(t, [])))) if bad})
    out = {}
    for p in {r[part] or "" for r in rows}:
        mine = [(f, r[0]) for f, r in zip(fails, rows) if (r[part] or "") == p]
        share = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            for step, x in enumerate(order):
                before = set(order[:step])
                here = [d for f, d in mine if x in f and not f & before]
                share[x] += len(here)
                out[p, "".join(order), step + 1] = [
                    sum(not f & before and x not in f for f, _ in mine), len(here),
                    sum(x in f and bool(f & before) for f, _ in mine), sum(f == {x} for f, _ in mine),
                    sum(d in quality for d in here), sum(d in toxic for d in here), x]
        for k in out:
            if k[0] == p:
                out[k][6] = share[out[k][6]] if isinstance(out[k][6], str) else out[k][6]
    return {k: tuple(v) for k, v in out.items()}


def labels_of(rows):
    out = [(r[0], int(i % 3 > 0), int(i % 4 == 0)) for i, r in enumerate(rows) if i % 2 == 0]
    return out + [out[3], (out[3][0], None, 1), (out[4][0], 1, None), (10 ** 6, 1, 1)]


def rows_of(df):
    cols = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    got = df.collect()
    out = {(r.part, r.filter_order, r.step): tuple(r[c] for c in cols) for r in got}
    assert len(out) == len(got)
    return out


def test_audit(spark, odd, odd_rows):
    labels = labels_of(odd_rows)
    got = rows_of(filter_audit.filter_audit(odd, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    assert got == brute(odd_rows, labels)


@pytest.mark.parametrize("hot_share", [2, 7, 1000])
def test_hot_groups_are_salted(spark, hot_share):
    rows = ([(i, "hot text", "en") for i in range(60)] + [(i, None if i % 2 else "", None) for i in range(60, 90)]
            + [(i, f"text {i % 13}", "de") for i in range(90, 130)] + [(5, "hot text", "en"), (None, "hot text", "en")])
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    facts = docs.sparkSession.createDataFrame(filter_audit.row_facts(docs).collect(), filter_audit.row_facts(docs).schema)
    got = sorted(r.doc_id for r in filter_audit.duplicate_ids(docs, facts, hot_share=hot_share).collect())
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    assert got == sorted(i for i, t, _ in rows if i is not None and least[t or ""] < i)


def test_other_filters_and_parts(spark, odd, odd_rows):
    from pyspark.sql import functions as F
    never = lambda: [F.lit(False)] * 4
    got = rows_of(filter_audit.filter_audit(odd, spark.createDataFrame([], "doc_id long, quality int, toxic int"),
                                            part="source", failures=never))
    assert {k[0] for k in got} == {r[3] or "" for r in odd_rows}
    assert all(v[1] == 0 for k, v in got.items() if k[1][k[2] - 1] != "E")
    assert any(v[1] > 0 for v in got.values())


def test_empty(spark, none):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.filter_audit(none, empty).collect() == []
