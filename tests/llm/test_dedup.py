"""op4 and op7 against brute force."""

from collections import Counter

import numpy as np
import pytest

from lensmap.llm import jaccard_join, suffix_repeats
from tests.llm.data import jaccard_groups, repeats


@pytest.mark.parametrize("hot", [3000, 1])
def test_remove_repeats(odd, odd_rows, hot, monkeypatch):
    monkeypatch.setattr(suffix_repeats, "HOT", hot)
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_repeats.remove_repeats(odd).collect())
    want = Counter((r[0], *x) for r, x in zip(odd_rows, repeats([r[1] for r in odd_rows])))
    assert got == want


def test_remove_repeats_empty(none):
    assert suffix_repeats.remove_repeats(none).collect() == []


def test_long_texts_in_pieces(spark, monkeypatch):
    rng = np.random.default_rng(1)
    a = "".join(chr(97 + x) for x in rng.integers(0, 26, 30_000))
    texts = [a, "q" * 100 + a[5_000:25_000], "z" * 700]
    monkeypatch.setattr(suffix_repeats, "PIECE", 4096)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_repeats.remove_repeats(docs).collect()}
    assert got == dict(enumerate(repeats(texts)))


@pytest.mark.parametrize("hot", [3000, 0])
def test_long_text_repeats_itself_across_pieces(spark, hot, monkeypatch):
    rng = np.random.default_rng(2)
    a = "".join(chr(97 + x) for x in rng.integers(0, 26, 30_000))
    s = "".join(chr(97 + x) for x in rng.integers(0, 26, 260))
    texts = [a[:1_000] + s + a[1_000:20_000] + s + a[20_000:], "z" * 700]
    monkeypatch.setattr(suffix_repeats, "PIECE", 4096)
    monkeypatch.setattr(suffix_repeats, "HOT", hot)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_repeats.remove_repeats(docs).collect()}
    assert got == dict(enumerate(repeats(texts)))
    assert got[0][1] >= 2 * len(s)


def test_frequent_key_inside_one_text_is_split(spark, monkeypatch):
    """A string that stands often in one text only, each time in another context, goes to the finer levels."""
    rng = np.random.default_rng(5)
    some = lambda n: "".join(chr(97 + x) for x in rng.integers(0, 26, n))
    s = some(230)
    texts = ["".join(s + some(60) for _ in range(60)), some(900)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    levels = lambda: [level for _, level in suffix_repeats._levels(suffix_repeats._texts(docs, 200), 200)]
    assert levels() == [0]
    monkeypatch.setattr(suffix_repeats, "HOT", 50)
    assert levels() == [0, 1, 2]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_repeats.remove_repeats(docs).collect()}
    assert got == dict(enumerate(repeats(texts)))


def test_repeat_groups_hold_all_occurrences(spark):
    s = "".join(chr(97 + (i * i * 7 + i // 3) % 26) for i in range(230))
    texts = ["A" + s + "1", "B" + s + "2", "C" + s + "3" + "x" * 50]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ids = {r.t: r.doc_id for r in docs.selectExpr("doc_id", "xxhash64(text) t").collect()}
    rows = suffix_repeats.repeat_groups(docs, 200).collect()
    covered = {}
    for r in rows:
        i = ids[r.t]
        covered.setdefault(i, set()).update(range(r["at"], r["at"] + r["size"]))
        assert texts[i][r["at"]:r["at"] + r["size"]] in s
    assert covered == {i: set(range(1, 231)) for i in range(3)}
    assert all(n == 3 for n in Counter((r.repeat, r["size"]) for r in rows).values())


def test_suffix_array_and_intervals():
    rng = np.random.default_rng(4)
    buf = rng.integers(97, 100, 600).astype(np.uint8)
    starts, ends = np.arange(560), np.full(560, 600)
    a = suffix_repeats.SuffixArray(buf, starts, ends)
    raw = buf.tobytes()
    lcp = lambda x, y: next((i for i in range(600 - max(x, y)) if raw[x + i] != raw[y + i]), 600 - max(x, y))
    assert [lcp(int(x), int(y)) for x, y in zip(a.sa, a.sa[1:])] == a.lcp[1:].tolist()
    left = np.where(a.sa > 0, buf[np.maximum(a.sa - 1, 0)].astype(int), -1)
    diverse = np.cumsum(np.concatenate([[0], left[1:] != left[:-1]]))
    got = {(raw[a.sa[x]:a.sa[x] + n], y - x + 1) for n, x, y in suffix_repeats.maximal_intervals(a.lcp, diverse, 5)}
    seen = Counter(raw[i:i + n] for n in range(5, 40) for i in range(560) if i + n <= 600)
    want = {(s, c) for s, c in seen.items() if c > 1
            and len({raw[i - 1] if i else -1 for i in range(560) if raw[i:i + len(s)] == s}) > 1
            and len({raw[i + len(s):i + len(s) + 1] for i in range(560) if raw[i:i + len(s)] == s}) > 1}
    assert got == want


@pytest.mark.parametrize("k, num, small", [(3, 90, 8), (5, 80, 8), (3, 60, 1)])
def test_components(odd, odd_rows, k, num, small, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SMALL", small)
    rows = [r for r in odd_rows if r[0] is not None]
    groups = jaccard_groups([r[1] for r in odd_rows], k, num)
    least = {}
    for r, g in zip(odd_rows, groups):
        if r[0] is not None:
            least[g] = min(least.get(g, r[0]), r[0])
    from tests.llm.data import shingles
    want = Counter((r[0], len(shingles(r[1], k)), r[0] if not shingles(r[1], k) else least.get(g)) for r, g in zip(odd_rows, groups))
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(odd, k, num, 100).collect())
    assert rows and got == want


def test_one_of_each_group_stays(odd, odd_rows):
    kept = jaccard_join.drop_near_duplicates(odd, 5, 80, 100)
    assert kept.columns == odd.columns
    groups = jaccard_groups([r[1] for r in odd_rows], 5, 80)
    from tests.llm.data import shingles
    full = {g for r, g in zip(odd_rows, groups) if shingles(r[1], 5)}
    wordless = sum(not shingles(r[1], 5) for r in odd_rows)
    got = [tuple(r) for r in kept.collect()]
    assert len(got) == len(full) + wordless
    ids = {r[0] for r in got}
    for g in full:
        mine = [r[0] for r, x in zip(odd_rows, groups) if x == g and r[0] is not None]
        assert not mine or min(mine) in ids


def test_jaccard_empty(none):
    assert jaccard_join.jaccard_components(none, 3, 90, 100).collect() == []
    assert jaccard_join.drop_near_duplicates(none).collect() == []


def test_chain_of_links_is_one_component(spark):
    w = [f"w{i}" for i in range(300)]
    texts = [" ".join(w[:i * 5] + [f"x{j}" for j in range(i * 5)][:0] + w[i * 5:]) for i in range(1)]
    cur = list(w)
    for i in range(30):  # each differs a little from the one before, the ends a lot
        cur = list(cur)
        for j in range(3):
            cur[(i * 7 + j) % 300] = f"n{i}_{j}"
        texts.append(" ".join(cur))
    docs = spark.createDataFrame([(100 - i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(docs, 3, 90, 100).collect()}
    groups = jaccard_groups(texts, 3, 90)
    for i, g in enumerate(groups):
        assert got[100 - i] == min(100 - k for k, x in enumerate(groups) if x == g)


def test_jaccard_scans_hold_a_slice_of_a_batch():
    """The arrays of a scan belong to one small slice of its batch, and slices change no row."""
    import tracemalloc

    import pyarrow as pa
    rng = np.random.default_rng(1)
    words = np.array([f"w{i:05d}" for i in range(3000)])
    texts = [" ".join(words[rng.integers(0, 3000, 400)]) for _ in range(2000)]
    b = pa.RecordBatch.from_arrays([pa.array(range(2000), pa.int64()), pa.array(range(2000), pa.int64()), pa.array(texts)],
                                   names=["doc_id", "t", "text"])
    scans = jaccard_join._prefixes(5, 80, 100, np.zeros(0, np.uint64)), jaccard_join._sets(5, 80, 100)
    for scan in scans:
        whole = pa.Table.from_batches(scan([b]))
        parts = pa.Table.from_batches(scan(b.slice(i, 50) for i in range(0, 2000, 50)))
        assert whole.combine_chunks().equals(parts.combine_chunks())
        tracemalloc.start()
        for _ in scan([b]):
            pass
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 25 << 20


def test_texts_of_stock_phrases_share_no_keys():
    """Keys are met by near copies, not by every two texts that share shingles; linked sets always share one."""
    import pyarrow as pa
    rng = np.random.default_rng(3)
    phrases = [" ".join(f"p{i}w{j}" for j in range(4)) for i in range(400)]
    texts = [" ".join(phrases[i] for i in rng.integers(0, 400, 60)) for _ in range(300)]
    b = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    keys = pa.Table.from_batches(jaccard_join._prefixes(3, 90, 100, np.zeros(0, np.uint64))([b]))
    holders = {}
    for c, x in zip(keys.column("cid").to_pylist(), keys.column("key").to_pylist()):
        holders.setdefault(x, set()).add(c)
    assert sum(len(x) * (len(x) - 1) // 2 for x in holders.values()) < 30


@pytest.mark.parametrize("num", [90, 80, 60])
def test_linked_sets_share_a_key(num):
    rng = np.random.default_rng(num)
    sets = []
    for n in [1, 2, 3, 4, 5, 6, 7, 9, 12, 17, 25, 40, 90, 300] * 6:
        s = list(rng.integers(0, 1 << 62, n))
        sets.append(s)
        for _ in range(4):  # copies with as many shingles gone or new as a link allows, or nearly
            gone = int(rng.integers(0, n * (100 - num) // 100 + 2))
            new = int(rng.integers(0, max(1, n * (100 - num) // num + 2 - gone)))
            sets.append(list(rng.permutation(s)[:max(1, n - gone)]) + list(rng.integers(0, 1 << 62, new)))
    sets = [np.unique(np.array(s, dtype=np.uint64)) for s in sets]
    h, offs = np.concatenate(sets), np.cumsum([0] + [len(s) for s in sets])
    doc, key = jaccard_join._keys(h, offs, h % np.uint64(5) == 0, num, 100)
    mine = [set(key[doc == i].tolist()) for i in range(len(sets))]
    sketches = [np.frombuffer(x, np.uint64) for x in jaccard_join._sketches(h, offs)]
    linked = 0
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= num * (len(sets[i]) + len(sets[j]) - both):
                assert mine[i] & mine[j]
                w = min(len(sketches[i]), len(sketches[j]))
                far = np.bitwise_count(jaccard_join._fold(sketches[i], w) ^ jaccard_join._fold(sketches[j], w)).sum()
                assert far <= len(sets[i]) + len(sets[j]) - 2 * both
                linked += 1
    assert linked > 100


def test_components_block_by_block(odd, odd_rows, monkeypatch):
    """Keys of several blocks and rounds in which a class tries one other give the same components."""
    for name, value in {"SMALL": 1, "BLOCK": 2, "TRIES": 1, "ROUNDS": 1}.items():
        monkeypatch.setattr(jaccard_join, name, value)
    monkeypatch.setattr(jaccard_join.JaccardJoin, "_hubs", staticmethod(lambda rows: rows.limit(0).selectExpr("cid a", "hub b")))
    groups = jaccard_groups([r[1] for r in odd_rows], 3, 60)
    least = {}
    for r, g in zip(odd_rows, groups):
        if r[0] is not None:
            least[g] = min(least.get(g, r[0]), r[0])
    got = {(r.doc_id, r.component_id) for r in jaccard_join.jaccard_components(odd, 3, 60, 100).collect() if r.n_shingles}
    assert got == {(r[0], least.get(g)) for r, g in zip(odd_rows, groups) if (r[1] or "").encode().split()}


def test_near_copies_under_the_threshold_are_told_by_their_sketches():
    """Sets somewhat under the threshold are no candidates, also where a much smaller set is in their block."""
    rng = np.random.default_rng(8)
    core = rng.integers(0, 1 << 62, 863)  # similarity of any two: 863 / 1137
    sets = [np.unique(np.concatenate([core, rng.integers(0, 1 << 62, 137)]).astype(np.uint64)) for _ in range(60)]
    sets.append(np.unique(np.concatenate([sets[0][:-40], rng.integers(0, 1 << 62, 40).astype(np.uint64)])))  # links with the first
    sets.append(np.unique(rng.integers(0, 1 << 62, 60).astype(np.uint64)))
    n = np.array([len(x) for x in sets])
    rows = [np.frombuffer(x, np.uint64) for x in jaccard_join._sketches(np.concatenate(sets), np.cumsum([0, *n]))]
    at = np.arange(len(sets))
    x, y, left = jaccard_join._near_pairs(at < 0, at, at, n, rows, 80, 100, 0, 0)
    assert (0, 60) in set(zip(x.tolist(), y.tolist())) and not left
    assert len(x) < 60


def test_long_texts_meet_once_a_group(spark, tmp_path, monkeypatch):
    """Texts that share hundreds of keys and do not link are listed a few times each, not once a key."""
    rng = np.random.default_rng(9)
    base = [f"w{i}" for i in range(1500)]

    def edited(words, count):
        out = list(words)
        for i in rng.permutation(len(out))[:count]:
            out[i] = f"n{rng.integers(1 << 40)}"
        return out

    texts = [edited(base, 60) for _ in range(12)]
    texts = [" ".join(t) for t in texts + [edited(texts[0], 8), edited(texts[5], 8)]]
    real = jaccard_join._meet

    def counted(*args):
        run = real(*args)

        def tee(batches):
            for b in batches:
                with open(tmp_path / "rows", "a") as f:
                    f.write(f"{b.num_rows}\n")
                yield b
        return lambda batches: run(tee(batches))

    monkeypatch.setattr(jaccard_join, "_meet", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(docs, 3, 80, 100).collect()}
    groups = jaccard_groups(texts, 3, 80)
    assert got == {i: groups.index(g) for i, g in enumerate(groups)} and len(set(got.values())) == 12
    met = sum(map(int, (tmp_path / "rows").read_text().split()))
    assert 0 < met <= 10 * len(texts)


@pytest.mark.parametrize("apart", [False, True])
def test_components_of_groups_in_blocks(spark, apart, monkeypatch):
    """Hubs' groups dealt to many blocks, and keys left as groups of their own, find the same components."""
    for name, value in {"SMALL": 1, "BLOCK": 3, "BLOCK_SHINGLES": 200, "TRIES": 1, "ROUNDS": 2}.items():
        monkeypatch.setattr(jaccard_join, name, value)
    rng = np.random.default_rng(10)
    texts = []
    for f in range(3):
        cur = [f"f{f}w{i}" for i in range(120)]
        for i in range(14):  # some links, some pairs little under the threshold
            nxt = list(cur)
            for j in rng.permutation(120)[:int(rng.integers(1, 9))]:
                nxt[j] = f"n{rng.integers(1 << 40)}"
            texts.append(" ".join(nxt))
            if i % 3 == 0:
                cur = nxt
    if apart:
        real = jaccard_join.broadcast_if_small
        monkeypatch.setattr(jaccard_join, "broadcast_if_small",
                            lambda df, *a: real(df.limit(0) if "joint" in df.columns else df, *a))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(docs, 3, 70, 100).collect()}
    groups = jaccard_groups(texts, 3, 70)
    assert got == {i: groups.index(g) for i, g in enumerate(groups)}
    assert 3 <= len(set(got.values())) < len(texts)
