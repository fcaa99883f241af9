"""E1-E8, S8, S9."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lensmap.operators import embedding as EM
from lensmap.session import ensure_checkpoint_dir


def recs(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "rid int, t string")


def test_hash_embedder_is_normalised_and_deterministic(spark):
    df = recs(spark, ["hello world", "hello world", "ab", "  ", None, "维😀"])
    emb = EM.HashEmbedder(dim=16)
    rows = df.select("rid", emb.column("t").alias("v")).orderBy("rid").collect()
    v = [r.v for r in rows]
    assert v[0] == v[1] and v[3] is None and v[4] is None
    for x in (v[0], v[2], v[5]):
        assert len(x) == 16 and np.linalg.norm(np.array(x, dtype=np.float64)) == pytest.approx(1, abs=1e-6)


def test_stats_dedup_and_cache(spark, tmp_path):
    texts = ["a", "b", "a", "", "c", "b", "   "]
    emb = EM.HashEmbedder(dim=8)
    cache = EM.EmbeddingCache(spark, str(tmp_path / "cache"), emb.model)
    res = EM.embed_records(recs(spark, texts), "t", emb, cache=cache)
    s = EM.embed_stats(res.records, res.vectors).first()
    # blank texts are neither hits nor misses; in-run duplicates are hits
    assert (s.cache_hits, s.cache_misses, s.total_requests) == (2, 3, 5)
    assert s.cache_hit_rate == "40.00%" and s.embeddings_generated == 3
    assert (s.total_count, s.success_count, s.failure_count) == (7, 5, 2)
    cache.save(res.fresh)
    res2 = EM.embed_records(recs(spark, ["a", "d", "b"]), "t", emb, cache=cache)
    src = dict(res2.records.join(res2.vectors.select("text_hash", "source"), "text_hash")
               .select("t", "source").collect())
    assert src == {"a": "cache", "b": "cache", "d": "model"}
    s2 = EM.embed_stats(res2.records, res2.vectors).first()
    assert (s2.cache_hits, s2.cache_misses) == (2, 1)
    # embeddings from the cache equal fresh ones
    a = res.records.where("t = 'a'").first().embedding
    assert res2.records.where("t = 'a'").first().embedding == a


def test_cache_is_per_model_and_latest_wins(spark, tmp_path):
    path = str(tmp_path / "cache")
    e8, e4 = EM.HashEmbedder(dim=8), EM.HashEmbedder(dim=4)
    df = recs(spark, ["x", "y"])
    c8 = EM.EmbeddingCache(spark, path, e8.model)
    c8.save(EM.embed_records(df, "t", e8).fresh)
    c8.save(EM.embed_records(df, "t", e8).fresh)
    assert c8.load().count() == 2
    assert EM.EmbeddingCache(spark, path, e4.model).load().count() == 0
    assert EM.EmbeddingCache(spark, path, e8.model, enabled=False).load().count() == 0
    assert EM.model_key("org/model:v1") == "org_model_v1"


def test_function_embedder_retries_and_drops(spark):
    calls = {}

    def model(batch):
        out = []
        for t in batch:
            calls[t] = calls.get(t, 0) + 1
            if t.startswith("bad"):
                raise RuntimeError("boom")
            if t.startswith("flaky") and calls[t] < 3:      # first two calls fail
                raise TimeoutError("slow")
            out.append([float(len(t)), 1.0])
        return out

    emb = EM.FunctionEmbedder(model, "fake", batch_size=2, retries=3, backoff=0.0)
    res = EM.embed_records(recs(spark, ["ok1", "bad1", "flaky1", "ok2", ""]), "t", emb)
    v = {r.text_hash: r for r in res.vectors.collect()}
    by_text = dict(res.records.select("t", "text_hash").collect())
    bad, flaky = v[by_text["bad1"]], v[by_text["flaky1"]]
    assert bad.embedding is None and bad.attempts == 3 and bad.errors == 3
    assert "RuntimeError" in bad.error
    assert flaky.embedding is not None and flaky.errors >= 1 and flaky.attempts == flaky.errors + 1
    assert v[by_text["ok1"]].attempts == 1 and v[by_text["ok1"]].errors == 0
    failed = dict(res.failed.select("t", "reason").collect())
    assert failed == {"bad1": "RuntimeError: boom", "": "blank text"}
    assert res.embedded.count() == 3
    s = EM.embed_stats(res.records, res.vectors).first()
    assert s.errors == bad.errors + flaky.errors and s.embeddings_generated == 3


def test_checkpoint_dir_from_session(spark):
    d = ensure_checkpoint_dir(spark)
    assert d and spark.conf.get("spark.checkpoint.dir") == d


def test_cache_lookup_moves_only_the_batch(spark, tmp_path):
    """Bucketed by hash: no exchange between the cache's scan, the join and the aggregate."""
    cache = EM.EmbeddingCache(spark, str(tmp_path / "cache"), "m", num_buckets=6)
    cache.save(spark.range(500).select(F.md5(F.col("id").cast("string")).alias("text_hash"),
                                       F.array(F.col("id").cast("float")).alias("embedding")))
    batch = spark.range(490, 510).select(F.md5(F.col("id").cast("string")).alias("text_hash"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = EM.EmbeddingCache(spark, str(tmp_path / "cache"), "m").load(batch)     # buckets are found in the folder's name
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Bucketed: true" in plan
        assert got.count() == 10
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_saving_twice_keeps_one_entry(spark, tmp_path):
    path = str(tmp_path / "it's a cache")
    cache = EM.EmbeddingCache(spark, path, "org/model", num_buckets=3)
    rows = recs(spark, ["a", "b", "c"]).select(F.md5("t").alias("text_hash"), F.array(F.col("rid").cast("float")).alias("embedding"))
    cache.save(rows)
    cache.save(rows.unionByName(rows))
    cache.save(rows.withColumn("embedding", F.lit(None).cast("array<float>")))
    stored = lambda: sorted((r.text_hash, list(r.embedding)) for r in spark.read.parquet(path).collect())
    assert stored() == sorted((r.text_hash, list(r.embedding)) for r in rows.collect())
    before = stored()
    cache.compact(num_buckets=5)
    assert stored() == before and cache.load().count() == 3
    cache.save(rows)
    assert stored() == before
    cache.save(recs(spark, ["d"]).select(F.md5("t").alias("text_hash"), F.array(F.lit(9.0).cast("float")).alias("embedding")))
    assert cache.load().count() == 4
    # a generation that a dying compaction left behind is not read
    (tmp_path / "it's a cache" / "model_key=org_model" / "gen=7-2").mkdir()
    assert cache.load().count() == 4


def test_a_second_run_calls_the_model_only_for_unfinished_waves(spark, tmp_path):
    log, flag = tmp_path / "calls", tmp_path / "die"

    def fn(texts):
        import os
        with open(str(log), "a") as f:
            f.write("".join(t + "\n" for t in texts))
        if os.path.exists(str(flag)) and sum(1 for _ in open(str(log))) > 60:
            raise KeyboardInterrupt("executor lost")          # not an error of a text: the task dies
        return [[float(len(t)), 1.0] for t in texts]
    emb = EM.FunctionEmbedder(fn, "m", batch_size=5, dim=2, partitions=1)
    texts = [f"text {i}" for i in range(120)]
    flag.write_text("")
    cache = EM.EmbeddingCache(spark, str(tmp_path / "cache"), "m", num_buckets=2)
    with pytest.raises(Exception):
        EM.embed_records(recs(spark, texts * 2), "t", emb, cache=cache, texts_per_wave=20)
    kept = cache.load().count()
    assert 20 <= kept < 120
    flag.unlink()
    log.write_text("")
    res = EM.embed_records(recs(spark, texts * 2), "t", emb, cache=cache, texts_per_wave=20)
    called = log.read_text().splitlines()
    assert len(called) == len(set(called)) == 120 - kept
    assert res.embedded.count() == 240 and cache.load().count() == 120
    s = EM.embed_stats(res.records, res.vectors).first()
    assert (s.cache_misses, s.cache_hits, s.embeddings_generated) == (120 - kept, 120 + kept, 120 - kept)
    log.write_text("")
    again = EM.embed_records(recs(spark, texts), "t", emb, cache=cache)
    assert again.embedded.count() == 120 and log.read_text() == ""
