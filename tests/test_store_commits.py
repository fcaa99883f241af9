"""Commits of the store: crashes, torn files, several writers, merge on read, counts."""

import os
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lensmap.operators import store as S
from lensmap.operators.store import CollectionError, CollectionStore


def rows(spark, ids, text="t", dim=1):
    return spark.createDataFrame([(str(i), [float(n)] * dim, text) for n, i in enumerate(ids)],
                                 "id string, vector array<float>, text_for_embedding string").withColumn(
        "metadata", F.lit(None).cast("variant"))


def content(st, name="c"):
    return sorted((r.id, r.text_for_embedding) for r in st.read(name).collect())


def new_store(spark, tmp_path, buckets=2):
    st = CollectionStore(spark, str(tmp_path / "s"), num_buckets=buckets)
    st.create("c", dim=1)
    return st


def test_torn_manifest_is_passed_over(spark, tmp_path):
    st = new_store(spark, tmp_path)
    st.upsert("c", rows(spark, range(5)))
    v = st.manifest("c")["version"]
    (tmp_path / "s" / "c" / "_manifest" / f"{v + 1}.json").write_text('{"name": "c", "dim')
    (tmp_path / "s" / "c" / "_manifest" / f"{v + 2}.json").write_text("")
    assert len(content(st)) == 5
    st.upsert("c", rows(spark, range(3, 8), "new"))
    assert st.manifest("c")["version"] == v + 3 and len(content(st)) == 8
    assert st.create("c", dim=1)["version"] == v + 3


def test_a_manifest_appears_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    st = new_store(spark, tmp_path)
    folder = tmp_path / "s" / "c" / "_manifest"
    before = {p.name for p in folder.glob("[0-9]*")}

    class Dying:
        def write(self, data):
            raise OSError("no space left")

        def close(self):
            pass
    real = st._fs

    class Files:
        def __getattr__(self, name):
            return getattr(real, name)

        def create(self, p, overwrite):
            Path(p.toUri().getPath()).write_text('{"half')
            return Dying()
    st._fs = Files()
    with pytest.raises(OSError):
        st.append("c", rows(spark, range(3)))
    st._fs = real
    assert {p.name for p in folder.glob("[0-9]*")} == before
    st.append("c", rows(spark, range(3)))
    assert len(content(st)) == 3


def test_two_writers_do_not_undo_each_other(spark, tmp_path):
    st, other = new_store(spark, tmp_path), CollectionStore(spark, str(tmp_path / "s"))
    st.upsert("c", rows(spark, range(6), "old"))
    real, calls = st._commit, []

    def late(m):
        if not calls:                                   # the other writer commits between our write and our commit
            calls.append(1)
            other.upsert("c", rows(spark, [4, 5, 6, 7], "theirs"))
            other.append("c", rows(spark, [100], "appended"))
        return real(m)
    st._commit = late
    st.upsert("c", rows(spark, [0, 4, 9], "ours"))
    want = {str(i): "old" for i in range(4)} | {"5": "theirs", "6": "theirs", "7": "theirs", "0": "ours", "4": "ours", "9": "ours", "100": "appended"}
    assert content(st) == sorted(want.items())
    assert st.info(["c"]).first().row_count == len(want)


def test_writer_of_a_recreated_collection_is_refused(spark, tmp_path):
    st, other = new_store(spark, tmp_path), CollectionStore(spark, str(tmp_path / "s"))
    real = st._write

    def slow(name, df):
        out = real(name, df)
        other.create("c", dim=1, force=True)
        return out
    st._write = slow
    with pytest.raises(CollectionError, match="recreated"):
        st.append("c", rows(spark, range(3)))
    st._write = real
    assert content(st) == []
    st.append("c", rows(spark, range(2)))
    assert len(content(st)) == 2


def test_crash_inside_force_keeps_the_old_rows(spark, tmp_path, monkeypatch):
    st = new_store(spark, tmp_path)
    st.append("c", rows(spark, range(4)))
    with monkeypatch.context() as m:
        m.setattr(CollectionStore, "_commit", lambda self, x: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            st.create("c", dim=2, force=True)
    assert len(content(st)) == 4 and st.manifest("c")["dim"] == 1
    assert st.create("c", dim=2, force=True)["dim"] == 2 and content(st) == []


def test_crash_inside_drop(spark, tmp_path):
    st = new_store(spark, tmp_path)
    st.append("c", rows(spark, range(4)))
    real = st._fs

    class Files:
        def __getattr__(self, name):
            return getattr(real, name)

        def delete(self, p, recursive):
            if recursive:
                raise OSError("lost")
            return real.delete(p, recursive)
    st._fs = Files()
    with pytest.raises(OSError):
        st.drop("c")
    st._fs = real
    assert not st.exists("c") and st.list() == []
    with pytest.raises(CollectionError):
        st.read("c")
    st.create("c", dim=1)
    assert content(st) == [] and st.list() == ["c"]


def test_random_writes_equal_a_plain_model(spark, tmp_path):
    """Appends, upserts and folds in any order: rows as in a list, counts without reading data."""
    rng = random.Random(6)
    st = new_store(spark, tmp_path, buckets=3)
    model = []
    for step in range(14):
        ids = [rng.randint(0, 25) for _ in range(rng.randint(0, 12))]
        what = rng.choice(["append", "upsert", "upsert", "compact"])
        if what == "append":
            st.append("c", rows(spark, ids, f"s{step}"))
            model += [(str(i), f"s{step}") for i in ids]
        elif what == "upsert":
            st.upsert("c", rows(spark, ids, f"s{step}"))
            model = [x for x in model if int(x[0]) not in ids] + [(str(i), f"s{step}") for i in sorted(set(ids))]
        else:
            st.compact("c")
        assert st.info(["c"]).first().row_count == len(model)
        assert content(st) == sorted(model), (step, what)
    st.compact("c")
    assert content(st) == sorted(model) and all(len(vs) == 1 for vs in st.manifest("c")["buckets"].values())
    st.vacuum("c")
    assert content(st) == sorted(model)


def test_row_keys_are_unique_and_stable(spark, tmp_path):
    st = new_store(spark, tmp_path)
    st.append("c", rows(spark, [1, 1, 2, 3]))
    st.upsert("c", rows(spark, [2], "new"))
    m = st.manifest("c")
    one = st.read("c", ["id"], row_key="k", manifest=m)
    st.compact("c")
    keys = {(r.id, r.k) for r in one.collect()}
    assert len({k for _, k in keys}) == 4
    assert keys == {(r.id, r.k) for r in st.read("c", ["id"], row_key="k", manifest=m).collect()}


def test_a_small_upsert_writes_little(spark, tmp_path):
    st = CollectionStore(spark, str(tmp_path / "s"), num_buckets=16)
    st.create("c", dim=8)
    big = spark.range(200_000).select(F.col("id").cast("string").alias("id"), F.array_repeat(F.rand(1).cast("float"), 8).alias("vector"),
                                      F.lit("t").alias("text_for_embedding"), F.lit(None).cast("variant").alias("metadata"))
    st.upsert("c", big)
    size = lambda: sum(p.stat().st_size for p in (tmp_path / "s").rglob("*.parquet"))
    before = size()
    st.upsert("c", rows(spark, range(0, 100), "new", dim=8))
    assert size() - before < 200_000
    assert st.read("c").where("text_for_embedding = 'new'").count() == 100
    assert st.info(["c"]).first().row_count == 200_000 == st.read("c").count()


def test_info_reads_no_data(spark, tmp_path):
    st = new_store(spark, tmp_path)
    st.append("c", rows(spark, range(9)))
    for p in (tmp_path / "s").rglob("*.parquet"):
        os.truncate(p, 0)
    assert st.info(["c"]).first().row_count == 9


def test_an_upsert_folds_long_chains(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "MAX_ATTEMPTS", 3)
    st = new_store(spark, tmp_path, buckets=1)
    for i in range(5):
        st.upsert("c", rows(spark, range(i, i + 3), f"s{i}"))
        assert all(len(vs) <= 3 for vs in st.manifest("c")["buckets"].values())
    assert content(st) == [("0", "s0"), ("1", "s1"), ("2", "s2"), ("3", "s3"), ("4", "s4"), ("5", "s4"), ("6", "s4")]


def test_upsert_leaves_no_batch_and_groups_repeated_ids_only(spark, tmp_path, monkeypatch):
    """Rows of ids that come once are not aggregated; the written batch is gone afterwards, rejected rows can still be read."""
    from lensmap.operators import store as S
    kept, materialize = [], S.materialize
    monkeypatch.setattr(S, "materialize", lambda df, what="stage": kept.append((what, materialize(df, what))) or kept[-1][1])
    st = CollectionStore(spark, str(tmp_path / "s"), num_buckets=2)
    st.create("c", dim=1)
    rows = [("a", 1.0, 3), ("b", 2.0, 1), ("a", 5.0, 4), ("a", 3.0, 2), ("c", 4.0, 7), ("x" * 101, 6.0, 8), (None, 7.0, 9), ("b", 8.0, None)]
    batch = spark.createDataFrame(rows, "id string, v double, gpos long").select(
        "id", F.array(F.col("v").cast("float")).alias("vector"), F.lit("t").alias("text_for_embedding"), F.lit(None).cast("variant").alias("metadata"), "gpos")
    for write, want in ((st.upsert, {("a", 5.0), ("b", 2.0), ("c", 4.0)}), (st.append, {("a", 5.0), ("b", 2.0), ("c", 4.0)})):
        _, bad = write("c", batch if write == st.upsert else batch.where("v > 5"))
        assert {(r.id, r.vector[0]) for r in st.read("c").collect()} >= want
        assert sorted(r.reason for r in bad.collect()) == ["id longer than 100 bytes", "missing id"]
    left = {what for what, t in kept if (tmp_path.parent / t._lensmap_path.removeprefix("file:")).exists()}
    assert left == {"rejected"}
    assert st.read("c").where("id = 'b'").count() == 2 and sum(st.manifest("c")["live"].values()) == 4
