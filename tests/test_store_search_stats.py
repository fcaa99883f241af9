"""C1-C8, S5, V9, V10, T11-T14, A1-A4."""

import json

import pytest
from pyspark.sql import functions as F

from lensmap.operators import search as SE
from lensmap.operators import stats as ST
from lensmap.operators.embedding import HashEmbedder
from lensmap.operators.store import CollectionError, CollectionStore


def ents(spark, rows, dim=2):
    return spark.createDataFrame(
        [(i, v, t, json.dumps(m)) for i, v, t, m in rows],
        "id string, vector array<float>, text_for_embedding string, m string") \
        .withColumn("metadata", F.parse_json("m")).drop("m")


def test_create_append_upsert_drop(spark, tmp_path):
    st = CollectionStore(spark, str(tmp_path / "store"), num_buckets=4)
    st.create("c", dim=2)
    st.create("c", dim=2)                                  # exists: kept
    with pytest.raises(CollectionError):
        st.create("c", dim=3)
    a = ents(spark, [("1", [1.0, 0.0], "a", {"v": 1}), ("2", [0.0, 1.0], "b", {"v": 1})])
    b = ents(spark, [("2", [0.5, 0.5], "b2", {"v": 2}), ("3", [1.0, 1.0], "c", {"v": 2}),
                     ("4", [1.0], "bad", {}), ("x" * 101, [1.0, 1.0], "long id", {})])
    st.append("c", a)
    ok, bad = st.append("c", a)
    assert st.read("c").count() == 4                       # append keeps duplicates
    st.create("u", dim=2)
    st.upsert("u", a)
    _, bad = st.upsert("u", b)
    rows = {r.id: r for r in st.read("u").collect()}
    assert sorted(rows) == ["1", "2", "3"]                 # last write wins, invalid rejected
    assert rows["2"].text_for_embedding == "b2"
    assert sorted(r.reason for r in bad.collect()) == ["id longer than 100 bytes", "vector length is not 2"]
    v = st.manifest("u")["version"]
    st.upsert("u", b)                                      # idempotent
    assert st.read("u").count() == 3 and st.manifest("u")["version"] == v + 1
    assert st.list() == ["c", "u"]
    info = {r.name: r for r in st.info().collect()}
    assert info["u"].row_count == 3 and info["u"].status == "loaded" and info["u"].dim == 2
    bad_info = st.info(["missing"]).first()
    assert bad_info.status == "error" and bad_info.row_count == 0
    assert st.drop("c") is True and st.drop("c") is False and st.list() == ["u"]
    st.create("u", dim=4, force=True)                      # C2: recreate
    assert st.read("u").count() == 0 and st.manifest("u")["dim"] == 4


def test_upsert_rewrites_only_touched_buckets(spark, tmp_path):
    st = CollectionStore(spark, str(tmp_path / "store"), num_buckets=8)
    st.create("c", dim=1)
    many = ents(spark, [(str(i), [float(i)], "t", {}) for i in range(40)], dim=1)
    st.upsert("c", many)
    before = st.manifest("c")["buckets"]
    st.upsert("c", ents(spark, [("5", [0.0], "new", {})], dim=1))
    after = st.manifest("c")["buckets"]
    changed = [b for b in after if after[b] != before.get(b)]
    assert len(changed) == 1 and st.read("c").count() == 40


def test_semantic_search_and_projections(spark, tmp_path):
    emb = HashEmbedder(dim=16)
    st = CollectionStore(spark, str(tmp_path / "store"), num_buckets=2)
    st.create("knowledge", dim=16)
    kn = spark.createDataFrame(
        [("k1", "价格太贵", "价格", "negative", None), ("k2", "服务很好", "服务", "positive", "desc " * 40),
         ("k3", "质量一般", None, None, None)],
        "id string, insight string, aspect string, sentiment string, description string")
    kn = kn.select("id", emb.column(F.concat(F.lit("观点："), "insight")).alias("vector"),
                   F.col("insight").alias("text_for_embedding"),
                   F.to_variant_object(F.struct("insight", "aspect", "sentiment", "description"))
                   .alias("metadata"))
    st.upsert("knowledge", kn)
    q = spark.createDataFrame([("q1", "价格贵"), ("q2", "服务")], "query_id string, query string")
    hits = SE.semantic_search(q, st, "knowledge", emb, top_k=2)
    assert hits.groupBy("query_id").count().collect()[0]["count"] == 2
    thr = SE.semantic_search(q, st, "knowledge", emb, top_k=3, threshold=0.99)
    assert thr.count() < 6
    rows = SE.knowledge_rows(SE.semantic_search(q, st, "knowledge", emb, top_k=3)).collect()
    k3 = [r for r in rows if r.id == "k3"][0]
    assert k3.aspect == "N/A" and k3.sentiment == "N/A" and k3.insight == "质量一般..."
    det = SE.detail_rows(SE.semantic_search(q, st, "knowledge", emb, top_k=5), "knowledge").collect()
    assert max(r.rank for r in det) <= 3
    assert [r.description for r in det if r.id == "k2"][0] == ("desc " * 40)[:100] + "..."
    env = json.loads(SE.result_json(hits, q, "knowledge", 0.0).where("query_id = 'q1'").first().json)
    assert env["total_results"] == 2 and env["collection"] == "knowledge"
    assert [r["id"] for r in env["results"]] == [r.id for r in hits.where("query_id='q1'").orderBy("rank").collect()]
    with pytest.raises(CollectionError):
        SE.semantic_search(q, st, "nope", emb)


def test_json_path_access(spark):
    df = spark.createDataFrame([('{"k": 3, "s": "x"}',), ('{"s": null}',)], "p string")
    r = df.select(F.parse_json("p").alias("metadata")) \
        .select(SE.meta("k"), SE.meta("s", "dflt"), SE.meta("zz", "dflt")).collect()
    assert [tuple(x) for x in r] == [("3", "x", "dflt"), (None, "dflt", "dflt")]


def test_stats(spark, tmp_path):
    info = spark.createDataFrame([("a", 3, "loaded"), ("b", 0, "error"), ("c", 5, "loaded")],
                                 "name string, row_count long, status string")
    s = ST.collections_summary(info).first()
    assert (s.collections, s.loaded, s.total_rows) == (3, 2, 8)
    kn = spark.range(3)
    fb = spark.range(2)
    none = spark.range(0)
    assert ST.run_summary(kn, fb, none, 1.5).first().status == "成功"
    assert ST.run_summary(kn, fb, spark.range(1), 1.5).first().status == "部分成功"
    assert ST.run_summary(none, none, spark.range(1), 0.0).first().status == "失败"
    cs = ST.collection_stats(spark, {"ok": lambda: spark.range(4),
                                     "broken": lambda: spark.read.parquet(str(tmp_path / "no"))})
    assert {r.name: (r.row_count, r.status) for r in cs.collect()} == \
        {"ok": (4, "loaded"), "broken": (0, "error")}


def test_upsert_writes_one_file_per_touched_bucket(spark, tmp_path):
    st = CollectionStore(spark, str(tmp_path / "store"), num_buckets=4)
    st.create("c", dim=1)
    rows = ents(spark, [(str(i), [float(i)], "t", {}) for i in range(200)], dim=1).repartition(8)
    st.upsert("c", rows)
    (v,) = {a for vs in st.manifest("c")["buckets"].values() for a in vs}
    files = list((tmp_path / "store" / "c" / f"v={v}").rglob("*.parquet"))
    assert len(files) == 4
