"""S1-S3, S6, S7, T6, T9, T10, R1-R3."""

import json

import pytest
from pyspark.sql import functions as F

from lensmap.operators import records as R
from lensmap.operators.embedding import HashEmbedder
from lensmap.sources import json_dir, sinks


def write(d, name, obj, raw=False):
    d.mkdir(parents=True, exist_ok=True)
    (d / name).write_text(obj if raw else json.dumps(obj, ensure_ascii=False), encoding="utf-8")


@pytest.fixture()
def knowledge_dir(tmp_path):
    d = tmp_path / "kn"
    write(d, "a.json", [
        {"insight_id": "k1", "aspect": "价格", "insight": "价格太贵，不划算。", "sentiment": "negative",
         "examples": ["太贵了!!!", "", "不值", "第四个"], "keywords": ["价格", "贵"], "confidence": 0.9},
        {"aspect": "服务", "insight": "服务态度好", "status": None},
        {"insight": "—。—", "insight_id": None},
        {}])
    write(d, "b.json", {"insight_id": 7, "aspect": "质量", "insight": "质量不错", "description": "耐用"})
    write(d, "c.json", '{"bad json', raw=True)
    write(d, "d.json", [])
    write(d, "notes.txt", "ignored", raw=True)
    return str(d)


def test_scan_arrays_objects_bad_files_and_positions(spark, knowledge_dir):
    rec, bad = json_dir.scan_json_dir(spark, knowledge_dir)
    rows = rec.orderBy("gpos").collect()
    assert [(r.file.rsplit("/", 1)[1], r.pos, r.gpos) for r in rows] == \
        [("a.json", 0, 0), ("a.json", 1, 1), ("a.json", 2, 2), ("a.json", 3, 3), ("b.json", 0, 4)]
    assert [r.file.rsplit("/", 1)[1] for r in bad.collect()] == ["c.json"]


def test_scan_empty_and_missing_dir(spark, tmp_path):
    (tmp_path / "empty").mkdir()
    rec, bad = json_dir.scan_json_dir(spark, str(tmp_path / "empty"))
    assert rec.count() == 0 and bad.count() == 0
    with pytest.raises(json_dir.DirectoryNotFound):
        json_dir.scan_json_dir(spark, str(tmp_path / "nope"))


def test_json_lines_mode(spark, tmp_path):
    d = tmp_path / "jl"
    write(d, "a.json", '{"fb_id": 1}\n{"fb_id": 2}\nnot json\n', raw=True)
    write(d, "b.json", '{"fb_id": 3}\n', raw=True)
    rec, bad = json_dir.scan_json_lines(spark, str(d))
    got = sorted((r.gpos, r.fid) for r in rec.select(
        "gpos", F.try_variant_get("item", "$.fb_id", "int").alias("fid")).collect())
    assert got == [(0, 1), (1, 2), (2, 3)] and bad.count() == 1


def test_build_knowledge_ids_texts_metadata(spark, knowledge_dir):
    rec, _ = json_dir.scan_json_dir(spark, knowledge_dir)
    res = R.build_knowledge(rec, HashEmbedder(dim=16))
    ent = {r.id: r for r in res.entities.select(
        "id", "text_for_embedding", F.to_json("metadata").alias("m")).collect()}
    assert set(ent) == {"k1", "knowledge_1", "knowledge_2", "knowledge_3", "7"}
    assert ent["k1"].text_for_embedding == ("维度：价格 | 观点：价格太贵不划算 | 情感：negative | "
                                            "例子：太贵了! | 不值 | 关键词：价格 贵")
    assert ent["knowledge_2"].text_for_embedding == "—。—"       # fallback to raw insight
    assert ent["knowledge_3"].text_for_embedding == "未知内容"
    m1, m2, m7 = (json.loads(ent[k].m) for k in ("k1", "knowledge_1", "7"))
    assert m1["status"] == "active" and m1["confidence"] == 0.9 and "insight_id" not in m1
    assert m1["examples"] == ["太贵了!!!", "", "不值", "第四个"] and m1["type"] == "knowledge"
    assert m2["status"] is None and "description" not in m2 and m2["sentiment"] == ""
    assert m7["description"] == "耐用" and m7["embedding_dim"] == 16
    assert m1["text_length"] == len(ent["k1"].text_for_embedding)


def test_build_feedback_metadata_and_mapping(spark, knowledge_dir, tmp_path):
    emb = HashEmbedder(dim=16)
    krec, _ = json_dir.scan_json_dir(spark, knowledge_dir)
    kn = R.build_knowledge(krec, emb).entities
    d = tmp_path / "fb"
    write(d, "x.json", [
        {"fb_id": "f1", "raw_text": "这车比同级别贵两万，不划算。", "summary": "价格贵",
         "channel": "app", "_secret": 1, "type": "override", "insight_manul": "null"},
        {"raw_text": "", "product": "X"},
        {"raw_text": "服务很好!!", "insight_pred": ["服务"]}])
    frec, _ = json_dir.scan_json_dir(spark, str(d))
    res = R.build_feedback(frec, emb, kn)
    got = {r.id: (r.text_for_embedding, json.loads(r.m)) for r in res.entities.select(
        "id", "text_for_embedding", F.to_json("metadata").alias("m")).collect()}
    assert set(got) == {"f1", "feedback_1", "feedback_2"}
    t1, m1 = got["f1"]
    assert t1 == "摘要：价格贵 | 原文：这车比同级别贵两万不划算"
    assert m1["type"] == "override" and "_secret" not in m1 and m1["fb_id"] == "f1"
    assert m1["channel"] == "app" and m1["raw_text"] == "这车比同级别贵两万，不划算。"
    assert m1["match_count"] == 5 and len(m1["mapped_perspectives"]) == 5
    scores = [p["score"] for p in m1["mapped_perspectives"]]
    assert scores == sorted(scores, reverse=True)
    assert set(m1["mapped_perspectives"][0]) == {"id", "score", "insight", "aspect"}
    t2, m2 = got["feedback_1"]
    assert t2 == "空内容" and m2["summary"] is None and m2["product"] == "X"
    # no knowledge: mapping is empty, records kept
    res0 = R.build_feedback(frec, emb, None)
    m = [json.loads(r[0]) for r in res0.entities.select(F.to_json("metadata")).collect()]
    assert all(x["mapped_perspectives"] == [] and x["match_count"] == 0 for x in m)


def test_sinks(spark, knowledge_dir, tmp_path):
    rec, _ = json_dir.scan_json_dir(spark, knowledge_dir)
    ent = R.build_knowledge(rec, HashEmbedder(dim=8)).entities
    p = sinks.save_entities(ent, str(tmp_path / "out"), sinks.KNOWLEDGE_JSON)
    back = spark.read.json(p)
    assert back.count() == 5 and "metadata" in back.columns
    raw = "".join(f.read_text(encoding="utf-8") for f in (tmp_path / "out" / sinks.KNOWLEDGE_JSON).glob("part-*"))
    assert "价格" in raw                                   # not ASCII-escaped
    summ = spark.createDataFrame([(5, 3, 1.5, "成功", 0)],
                                 "knowledge_records long, feedback_records long, "
                                 "processing_seconds double, status string, error_count long")
    sp = sinks.save_run_stats(summ, str(tmp_path / "out"), settings={"vector_dim": 8},
                              saved_files=[sinks.KNOWLEDGE_JSON])
    row = spark.read.json(sp).first()
    assert row.processing_stats.knowledge_records == 5 and row.settings.vector_dim == 8


def test_run_mapping_end_to_end(spark, knowledge_dir, tmp_path):
    from lensmap.plans.mapping_run import run_mapping
    d = tmp_path / "fb"
    write(d, "x.json", [{"fb_id": "f1", "raw_text": "太贵了"}, {"raw_text": "服务很好"}])
    write(d, "y.json", "[broken", raw=True)
    emb = HashEmbedder(dim=16)
    kw = dict(store_root=str(tmp_path / "store"), out_dir=str(tmp_path / "out"), embedder=emb,
              cache_path=str(tmp_path / "cache"))
    res = run_mapping(spark, knowledge_dir, str(d), **kw)
    s = res.summary.first()
    assert (s.knowledge_records, s.feedback_records) == (5, 2)
    assert s.status == "部分成功" and s.error_count == 2          # two unparsable files
    assert {r.name: r.row_count for r in res.collections.collect()} == {"knowledge": 5, "feedback": 2}
    assert spark.read.json(str(tmp_path / "out" / "processing_stats.json")).count() == 1
    # a second run reuses the cache and upserts: same rows, no duplicates
    res2 = run_mapping(spark, knowledge_dir, str(d), **kw)
    assert res2.feedback.count() == 2 and res2.knowledge.count() == 5


def test_strict_json_and_dispatch(spark, tmp_path):
    d = tmp_path / "s"
    write(d, "a.json", '[{"x": 1}] trailing', raw=True)
    write(d, "b.json", '{"x": 1, "x": 2}', raw=True)
    loose_rec, loose_bad = json_dir.scan_json_dir(spark, str(d))
    strict_rec, strict_bad = json_dir.scan_json_dir(spark, str(d), strict=True)
    name = lambda df: sorted(r.file.rsplit("/", 1)[1] for r in df.collect())
    assert name(loose_bad) == ["b.json"] and name(strict_bad) == ["a.json"]
    assert strict_rec.select(F.try_variant_get("item", "$.x", "int")).first()[0] == 2
    with pytest.raises(R.UnknownRecordType):
        R.build_dictionary("other", strict_rec, HashEmbedder(dim=4))
    empty = spark.createDataFrame([], json_dir.RECORD_SCHEMA)
    assert R.build_dictionary("knowledge", empty, HashEmbedder(dim=4)).entities.count() == 0


def test_json_lines_of_one_file_in_parts(spark, tmp_path):
    """Lines and positions count through the parts, blank lines and an empty part included."""
    d = tmp_path / "parts"
    write(d, "part-0.json", '{"a": 1}\n\nnot json\n', raw=True)
    write(d, "part-1.json", '', raw=True)
    write(d, "part-2.json", 'bad\n{"a": 2}\nworse\n', raw=True)
    rec, bad = json_dir.scan_json_lines(spark, str(d), parts=True)
    assert sorted(r.line for r in bad.collect()) == [3, 4, 6]
    assert sorted((r.gpos, r.a) for r in rec.select("gpos", F.try_variant_get("item", "$.a", "int").alias("a")).collect()) == [(0, 1), (1, 2)]
    _, per_file = json_dir.scan_json_lines(spark, str(d))
    assert sorted(r.line for r in per_file.collect()) == [1, 3, 3]


def _tables(spark, path, docs, pages=()):
    spark.createDataFrame([(i, t, "en", "s", 0 if t is None else len(t)) for i, t in docs],
                          "doc_id long, text string, lang string, source string, n_chars int").coalesce(1).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, "u", h) for i, h in pages], "page_id long, url string, html string").coalesce(1) \
        .write.parquet(f"{path}/pages.parquet")


def test_bad_line_report_is_written_by_many_tasks(spark, tmp_path, monkeypatch):
    """Every task writes its part of the file; lines are those of the whole."""
    from lensmap.plans import catalog
    _tables(spark, tmp_path / "t", [(i, f"on the way {i}" if i % 3 == 0 else f"text {i}") for i in range(900)])
    out = tmp_path / "written"
    monkeypatch.setattr(catalog, "scratch", lambda s, what: str(out))
    keep = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted(r.line for r in catalog.QUERIES["S2_bad_line_report"](spark, str(tmp_path / "t")).collect())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", keep)
    assert got == [i + i // 3 + 2 for i in range(0, 900, 3)]
    assert len(list(out.glob("part-*.txt"))) > 1


def test_json_files_of_a_task_stay_in_name_order(spark, tmp_path, monkeypatch):
    """Tasks grow with the files, so positions in name order are those of the documents."""
    from lensmap.plans import catalog
    monkeypatch.setattr(catalog, "FILES_PER_TASK", 4)
    _tables(spark, tmp_path / "t", [(i, f"text {i}") for i in range(3000)], [(i, "<p>") for i in range(30)])
    out = tmp_path / "written"
    monkeypatch.setattr(catalog, "scratch", lambda s, what: str(out))
    rows = catalog.QUERIES["T6_default_id"](spark, str(tmp_path / "t")).collect()
    assert sorted((r.doc_id, r.id) for r in rows) == [(i, f"record_{i}") for i in range(3000)]
    names = sorted(p.name for p in out.glob("part-*.txt"))
    assert len(names) == 60 and len({n.split("-")[1] for n in names}) > 8


def test_bad_files_listed_by_folders(spark, tmp_path, monkeypatch):
    """The driver lists the files of some folders at a time, however many there are."""
    from lensmap.plans import catalog
    home, read, listed = tmp_path / "t", json_dir.read_json_files, []
    home.mkdir()
    spark.createDataFrame([(i, "x", "en", "s", 1) for i in range(230)], "doc_id long, text string, lang string, source string, n_chars int") \
        .write.parquet(str(home / "documents.parquet"))
    html = ["<p>no JSON</p>", None, "", "[1, 2]", "{}", "{"]
    spark.createDataFrame([(i, "u", html[i % 6]) for i in range(90)], "page_id long, url string, html string") \
        .write.parquet(str(home / "pages.parquet"))

    def counted(*a, **kw):
        out = read(*a, **kw)
        listed.append(len(out.inputFiles()))
        return out
    monkeypatch.setattr(json_dir, "read_json_files", counted)
    monkeypatch.setattr(catalog, "FILES_PER_TASK", 4)
    want = catalog.QUERIES["S2_bad_file_report"](spark, str(home)).collect()
    monkeypatch.setattr(json_dir, "FOLDERS_AT_ONCE", 2, raising=False)
    listed.clear()
    got = catalog.QUERIES["S2_bad_file_report"](spark, str(home)).collect()
    assert got == want and [r.error for r in got] == ["invalid JSON"] and got[0].n_files >= 30
    assert sum(listed) == 95 and max(listed) <= 24


def test_bad_files_of_folders(spark, tmp_path):
    for name, text in {"a/1.json": "{}", "a/2.json": "{", "b/1.json": "x", "b/_no.json": "x", "c/1.txt": "x", "_d/1.json": "x"}.items():
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_text(text)
    got = json_dir.bad_files_in_folders(spark, str(tmp_path / "in")).collect()
    assert sorted(r.file.split("/in/")[1] for r in got) == ["a/2.json", "b/1.json"]
    (tmp_path / "none").mkdir()
    assert json_dir.bad_files_in_folders(spark, str(tmp_path / "none")).collect() == []
    with pytest.raises(json_dir.DirectoryNotFound):
        json_dir.bad_files_in_folders(spark, str(tmp_path / "absent"))
