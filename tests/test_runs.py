"""Whole runs, crashes, and the two sides of every size switch."""

import json
import sys
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from lensmap import session
from lensmap.operators import embedding as EM
from lensmap.operators import ivf, knn
from lensmap.operators.partitioning import row_positions
from lensmap.operators.store import CollectionStore
from lensmap.plans.mapping_run import run_mapping
from lensmap.sources import json_dir
from lensmap.streaming.ingest import ingest_feedback


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import this file


def test_positions_of_many_rows_with_a_payload(spark, tmp_path):
    path = str(tmp_path / "lines")
    n = 200_000
    (spark.range(n).select(F.col("id").alias("k"), F.repeat(F.lit("payload "), 20).alias("p"))
     .repartitionByRange(7, "k").sortWithinPartitions("k").write.json(path))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        rec, bad = json_dir.scan_json_lines(spark, path)
        got = rec.select(F.try_variant_get("item", "$.k", "bigint").alias("k"), "gpos",
                         F.try_variant_get("item", "$.p", "string").alias("p"))
        assert got.filter("k = gpos").count() == n == got.select("gpos").distinct().count()
        assert bad.count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_row_positions_with_filtered_splits(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1000).selectExpr("cast(id as string) value").repartition(4).sortWithinPartitions("value").write.text(path)
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("blk"), "value")
    got = row_positions(rows.filter("value % 3 <> 0"), ["file", "blk"], "at").collect()
    assert sorted(r["at"] for r in got) == list(range(len(got)))
    assert [(r.file, r.value) for r in sorted(got, key=lambda r: r["at"])] == sorted((r.file, r.value) for r in got)


@pytest.mark.parametrize("then", ["6 cores", "128k"])
def test_no_record_is_lost_when_the_splits_change(spark, tmp_path, monkeypatch, then):
    """Splits follow from cores and settings, and both may change while a job runs."""
    path = tmp_path / "lines"
    path.mkdir()
    n = 40_000
    with open(path / "a.json", "w") as f:
        for i in range(n):
            f.write(json.dumps({"k": i, "p": "payload " * (i % 13)}) + "\n")
            if i % 1000 == 7:
                f.write("broken {\n" if i % 2000 == 7 else "\n")
    bytes_key, cores_key = "spark.sql.files.maxPartitionBytes", "spark.sql.files.minPartitionNum"
    old = spark.conf.get(bytes_key)
    try:
        rec, bad = json_dir.scan_json_lines(spark, str(path))
        if then == "128k":
            spark.conf.set(bytes_key, then)
        else:
            spark.conf.set(cores_key, "6")
        got = rec.select(F.try_variant_get("item", "$.k", "bigint").alias("k"), "gpos").collect()
        assert sorted((r.k, r.gpos) for r in got) == [(i, i) for i in range(n)]
        want, line = [], 0
        for i in range(n):
            line += 1
            if i % 1000 == 7:
                line += 1
                if i % 2000 == 7:
                    want.append(line)
        assert sorted(r.line for r in bad.collect()) == want
        assert json_dir.count_records(spark, str(path), json_lines=True) == n + len(want)
    finally:
        spark.conf.set(bytes_key, old)
        spark.conf.unset(cores_key)


def test_line_numbers_over_many_splits_and_files(spark, tmp_path):
    d = tmp_path / "many"
    d.mkdir()
    want, order = [], []
    for f in range(3):
        with open(d / f"f{f}.json", "w") as out:
            for i in range(3000):
                text = "" if i % 17 == 3 else "nope" if i % 29 == 5 else json.dumps({"f": f, "i": i, "p": "x" * (i % 50)})
                out.write(text + "\n")
                if text == "nope":
                    want.append((f"f{f}.json", i + 1))
                elif text:
                    order.append((f, i))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        rec, bad = json_dir.scan_json_lines(spark, str(d))
        assert sorted((r.file.rsplit("/", 1)[1], r.line) for r in bad.collect()) == want
        got = rec.select(F.try_variant_get("item", "$.f", "int").alias("f"), F.try_variant_get("item", "$.i", "int").alias("i"), "gpos").collect()
        assert [(r.f, r.i) for r in sorted(got, key=lambda r: r.gpos)] == order
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def model(texts):
    """A remote model of 16 dimensions; plain function of the text."""
    return EM._hash_vectors(pa.array(texts, pa.string()), 16, 3).to_pylist()


def feedback_dir(tmp_path, n=600, per=50):
    d = tmp_path / "fb"
    d.mkdir()
    for f in range(0, n, per):
        (d / f"f{f:06d}.json").write_text(json.dumps([{"raw_text": f"text number {i} with words"} for i in range(f, f + per)]))
    (d / "bad.json").write_text('[{"raw_text": "x"}] trailing')
    k = tmp_path / "kn"
    k.mkdir()
    (k / "k.json").write_text(json.dumps([{"insight_id": f"k{i}", "insight": f"words about number {i}", "aspect": "a"} for i in range(9)]))
    return str(k), str(d)


def test_run_with_a_real_model_stores_every_record(spark, tmp_path):
    k, d = feedback_dir(tmp_path)
    emb = EM.FunctionEmbedder(model, "remote", batch_size=8, partitions=4)
    assert emb.dim == 16
    kw = dict(store_root=str(tmp_path / "store"), out_dir=str(tmp_path / "out"), embedder=emb,
              cache_path=str(tmp_path / "cache"), strict=True)
    r = run_mapping(spark, k, d, **kw)
    assert r.feedback.count() == 600 == r.feedback.select("id").distinct().count()
    assert r.bad_files.count() == 1
    b = {x.kind: x.asDict() for x in r.balance.collect()}
    assert b["feedback"] == {"kind": "feedback", "scanned": 600, "failed": 0, "rejected": 0, "replaced": 0, "stored": 600, "lost": 0}
    s = {x.kind: x for x in r.embed_stats.collect()}
    assert s["feedback"].cache_misses == 600 and s["knowledge"].success_count == 9
    again = run_mapping(spark, k, d, **kw)
    s = {x.kind: x for x in again.embed_stats.collect()}
    assert s["feedback"].cache_misses == 0 and s["feedback"].cache_hits == 600
    assert again.feedback.count() == 600


def test_cache_holds_what_was_embedded_before_a_failure(spark, tmp_path, monkeypatch):
    k, d = feedback_dir(tmp_path, n=50)
    emb = EM.FunctionEmbedder(model, "remote", batch_size=8, dim=16)
    monkeypatch.setattr("lensmap.plans.mapping_run.sinks.save_entities", lambda *a: 1 / 0)
    kw = dict(store_root=str(tmp_path / "store"), out_dir=str(tmp_path / "out"), embedder=emb, cache_path=str(tmp_path / "cache"))
    with pytest.raises(ZeroDivisionError):
        run_mapping(spark, k, d, **kw)
    assert EM.EmbeddingCache(spark, kw["cache_path"], "remote").load().count() >= 50


def test_stream_with_a_real_model(spark, tmp_path):
    _, d = feedback_dir(tmp_path, n=100)
    st = CollectionStore(spark, str(tmp_path / "store"), num_buckets=2)
    emb = EM.FunctionEmbedder(lambda ts: [None if "number 7 " in t else v for t, v in zip(ts, model(ts))], "remote",
                              dim=16, retries=1, backoff=0.0)
    kw = dict(store=st, knowledge=None, embedder=emb, checkpoint_location=str(tmp_path / "cp"), failed_path=str(tmp_path / "failed"),
              quarantine_path=str(tmp_path / "bad"))
    ingest_feedback(spark, d, **kw).awaitTermination(180)
    assert st.read("feedback").count() == 100 and spark.read.parquet(kw["failed_path"]).count() == 1
    assert spark.read.parquet(kw["quarantine_path"]).count() == 0       # lenient parsing takes the file with trailing text


@pytest.mark.parametrize("batch, calls", [(1, 3), (4, 4)])
def test_three_attempts_for_a_text(spark, tmp_path, batch, calls):
    log = str(tmp_path / "calls")

    def fn(texts):
        with open(log, "a") as f:
            f.write("bad\n" * ("bad" in texts))
        if "bad" in texts:
            raise RuntimeError("x" * 900)
        return model(texts)
    emb = EM.FunctionEmbedder(fn, "m", batch_size=batch, backoff=0.0, dim=16)
    df = spark.createDataFrame([("h1", "good"), ("h2", "bad")], "text_hash string, text string").coalesce(1)
    rows = {r.text_hash: r for r in emb.embed(df).collect()}
    assert open(log).read().count("bad") == calls      # three of its own; a shared batch call comes before them
    assert rows["h2"].attempts == 3 and rows["h2"].errors == 3 and len(rows["h2"].error) > 900
    assert rows["h1"].attempts == 1 and rows["h1"].embedding is not None


def test_crash_before_the_commit_is_repaired_by_a_replay(spark, tmp_path, monkeypatch):
    st = CollectionStore(spark, str(tmp_path / "s"), num_buckets=2)
    st.create("c", dim=1)
    rows = spark.createDataFrame([(str(i), [float(i)], "t") for i in range(20)], "id string, vector array<float>, text_for_embedding string")
    rows = rows.withColumn("metadata", F.lit(None).cast("variant"))
    for write in (st.upsert, st.append):
        with monkeypatch.context() as m:
            m.setattr(CollectionStore, "_commit", lambda self, x: 1 / 0)
            with pytest.raises(ZeroDivisionError):
                write("c", rows)
        before = st.read("c").count()
        write("c", rows)
        assert st.read("c").count() == (20 if write == st.upsert else before + 20)
    st.compact("c")
    assert st.read("c").count() == 40 and st.vacuum("c") >= 2 and st.read("c").count() == 40


def test_later_record_of_an_id_wins_after_shuffles(spark, tmp_path):
    st = CollectionStore(spark, str(tmp_path / "s"), num_buckets=4)
    st.create("c", dim=1)
    rows = [(str(i % 40), [float(i)], f"t{i}", i) for i in range(400)]
    df = spark.createDataFrame(rows, "id string, vector array<float>, text_for_embedding string, gpos long")
    df = df.withColumn("metadata", F.lit(None).cast("variant")).repartition(7, "text_for_embedding")
    st.upsert("c", df)
    assert {r.id: r.text_for_embedding for r in st.read("c").collect()} == {str(i): f"t{360 + i}" for i in range(40)}


def test_empty_cache(spark, tmp_path):
    c = EM.EmbeddingCache(spark, str(tmp_path / "c"), "m")
    assert c.load().count() == 0
    c.save(spark.createDataFrame([], "text_hash string, embedding array<float>"))
    assert c.load().count() == 0


def hits(df):
    return sorted((str(r.query_id), r["rank"], r.id, round(r.distance, 9)) for r in df.collect())


def test_both_sides_of_the_broadcast_budget_answer_alike(spark):
    rng = np.random.default_rng(3)
    cand = spark.createDataFrame([("hot" if i % 3 == 0 else f"c{i}", rng.normal(size=4).astype(np.float32).tolist()) for i in range(300)]
                                 + [("odd", [1.0, 2.0])], "id string, vector array<float>")
    q = spark.createDataFrame([(x, rng.normal(size=4).astype(np.float32).tolist()) for x in ["a", "a", "b", None, None, "c"]] + [("d", [1.0])],
                              "query_id string, vector array<float>")
    for metric in ("COSINE", "L2", "IP"):
        a = knn.knn_join(q, cand, k=5, metric=metric, dim=4, keep=["vector"])
        b = knn.knn_join(q, cand, k=5, metric=metric, dim=4, keep=["vector"], broadcast_bytes=600)
        assert len(hits(a)) == 30 and hits(a) == hits(b)
        x = knn.knn_arrays(q, cand, k=5, metric=metric, dim=4)
        y = knn.knn_arrays(q, cand, k=5, metric=metric, dim=4, broadcast_bytes=600)
        key = lambda r: (str(r.query_id), tuple(r.vector), [(h.rank, h.id, round(h.distance, 9)) for h in r.hits])
        assert sorted(map(key, x.collect())) == sorted(map(key, y.collect()))


@pytest.mark.parametrize("metric, shift, scale", [("L2", 1e5, 1e-2), ("L2", 0.0, 1e19), ("IP", 0.0, 1e19), ("IP", 1e5, 1.0), ("COSINE", 1e5, 1.0)])
def test_large_norms(metric, shift, scale):
    rng = np.random.default_rng(5)
    c = (shift + scale * rng.normal(size=(400, 8))).astype(np.float32)
    q = (shift + scale * rng.normal(size=(20, 8))).astype(np.float32).astype(np.float64)
    c64 = c.astype(np.float64)
    norms = np.sqrt((c64 ** 2).sum(axis=1))
    m = knn._matrix(pa.array([str(i) for i in range(400)]), c, norms ** 2 if metric == "L2" else norms, {})
    key, idx = knn.score_block(q, m, metric, 5, 128)
    if metric == "L2":
        want = ((q[:, None, :] - c64[None]) ** 2).sum(axis=2)
    elif metric == "IP":
        want = -(q @ c64.T)
    else:
        want = -(q @ c64.T) / np.sqrt((q ** 2).sum(axis=1))[:, None] / norms[None]
    order = np.argsort(want, axis=1, kind="stable")[:, :5]
    assert np.isfinite(key).all()
    assert np.allclose(key, np.take_along_axis(want, order, axis=1), rtol=1e-9, atol=0 if metric != "COSINE" else 1e-12)
    assert (np.take_along_axis(want, idx, axis=1) == np.take_along_axis(want, idx, axis=1)).all()


def test_ivf_with_a_zero_vector(spark):
    rng = np.random.default_rng(2)
    rows = [(str(i), rng.normal(size=4).astype(np.float32).tolist()) for i in range(60)] + [("zero", [0.0] * 4), ("nan", [float("nan")] * 4)]
    df = spark.createDataFrame(rows, "id string, vector array<float>")
    index = ivf.build_ivf(df, nlist=4, dim=4)
    out = ivf.ivf_search(df.select(F.col("id").alias("query_id"), "vector"), index, k=3, nprobe=4)
    assert out.select("query_id").distinct().count() == 60


def test_cluster_needs_a_shared_folder(monkeypatch):
    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None),
                           sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(fake)
