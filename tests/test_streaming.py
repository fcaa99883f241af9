"""Incremental ingest: two runs over a growing folder."""

import json

from pyspark.sql import functions as F

from lensmap.operators.embedding import HashEmbedder
from lensmap.operators.store import CollectionStore
from lensmap.streaming.ingest import ingest_feedback


def test_incremental_ingest(spark, tmp_path):
    emb = HashEmbedder(dim=16)
    st = CollectionStore(spark, str(tmp_path / "store"), num_buckets=2)
    st.create("knowledge", dim=16)
    kn = spark.createDataFrame([("k1", "价格贵"), ("k2", "服务好")], "id string, insight string")
    st.upsert("knowledge", kn.select("id", emb.column("insight").alias("vector"),
                                     F.col("insight").alias("text_for_embedding"),
                                     F.to_variant_object(F.struct("insight")).alias("metadata")))
    src = tmp_path / "fb"
    src.mkdir()
    (src / "a.json").write_text(json.dumps([{"fb_id": "f1", "raw_text": "太贵了"},
                                            {"raw_text": "服务不错"}], ensure_ascii=False))
    (src / "bad.json").write_text("{oops")
    kw = dict(store=st, knowledge=st.read("knowledge"), embedder=emb,
              checkpoint_location=str(tmp_path / "ckpt"), quarantine_path=str(tmp_path / "q"))
    ingest_feedback(spark, str(src), **kw).awaitTermination(120)
    first = {r.id for r in st.read("feedback").collect()}
    assert first == {"f1", "feedback_b0_0"} or ("f1" in first and len(first) == 2)
    (src / "b.json").write_text(json.dumps({"fb_id": "f1", "raw_text": "还是太贵"}, ensure_ascii=False))
    ingest_feedback(spark, str(src), **kw).awaitTermination(120)
    rows = {r.id: r for r in st.read("feedback").collect()}
    assert len(rows) == 2                                  # f1 upserted, not duplicated
    assert rows["f1"].text_for_embedding == "用户反馈：还是太贵"
    m = json.loads(st.read("feedback").where("id = 'f1'")
                   .select(F.to_json("metadata")).first()[0])
    assert m["match_count"] == 2
    assert spark.read.parquet(str(tmp_path / "q")).count() == 1
