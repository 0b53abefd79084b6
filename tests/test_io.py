"""Readers and sinks over real files in a fresh temporary folder."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from textpairs.operators import clean as C
from textpairs.operators import vocab as V
from textpairs.sources import readers as RD
from textpairs.sources import sinks as S
from textpairs.streaming import stream as K


def _write(folder, name, lines):
    path = os.path.join(folder, name)
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")
    return path


def test_classification_readers(spark):
    d = tempfile.mkdtemp(prefix="tp-io-")
    p1 = _write(d, "afqmc.json", [json.dumps({"sentence1": "a", "sentence2": "b", "label": "1"})])
    p2 = _write(d, "tnews.json", [json.dumps({"sentence": "s", "label": "100", "label_desc": "news_story"})])
    p3 = _write(d, "sft.json", [json.dumps({"instruction": "用<>标注出句子中的错别字", "input": "x", "response": "y"})])
    assert RD.read_pair_classification(spark, p1).first()["label"] == "1"
    assert RD.read_classification(spark, p2).first()["label_desc"] == "news_story"
    ins = RD.read_instructions(spark, p3)
    assert ins.select(C.instruction_type("instruction")).first()[0] == "detect"
    bad = _write(d, "bad.json", [json.dumps({"sentence": "s"})])
    with pytest.raises(Exception):
        RD.read_classification(spark, bad).collect()


def test_confusion_reader(spark):
    d = tempfile.mkdtemp(prefix="tp-conf-")
    for f, m in (("stroke.json", {"忌": ["记", "纪"]}), ("pinyin_sim.json", {"忌": ["机"]}), ("pinyin_sam.json", {})):
        with open(os.path.join(d, f), "w", encoding="utf-8") as h:
            json.dump(m, h, ensure_ascii=False)
    _write(d, "word_freq.txt", ["瓮", "", "记"])
    conf, words = RD.read_confusions(spark, d)
    rows = sorted((r["kind"], r["ch"], r["idx"], r["cand"]) for r in conf.collect())
    assert rows == [("shape", "忌", 0, "记"), ("shape", "忌", 1, "纪"), ("similar_sound", "忌", 0, "机")]
    assert [(r["idx"], r["ch"]) for r in words.orderBy("idx").collect()] == [(0, "瓮"), (1, "记")]


def test_source_target_and_messages(spark):
    d = tempfile.mkdtemp(prefix="tp-st-")
    paths = [_write(d, f"rSIGHAN{y}.jsonl", [json.dumps({"source": "切纪", "target": "切忌"}, ensure_ascii=False), "bad"])
             for y in (13, 14, 15)]
    st = RD.read_source_target(spark, paths)
    assert st.where("valid").count() == 3 and st.where("not valid").count() == 3
    with pytest.raises(Exception):
        RD.read_source_target(spark, paths + [os.path.join(d, "missing.jsonl")]).count()
    mp = os.path.join(d, "messages.json")
    with open(mp, "w", encoding="utf-8") as h:
        json.dump([{"src": "切纪", "trg": "切忌", "pred": "切忌"}], h, ensure_ascii=False)
    m = RD.read_messages(spark, mp).first()
    assert m["src_tokens"] == ["切", "纪"]


def test_sinks_roundtrip(spark):
    d = tempfile.mkdtemp(prefix="tp-sink-")
    t = spark.createDataFrame([("切纪", "切忌", "切忌"), ("切忌", "切忌", "切记")], "src string, tgt string, pred string")
    S.write_buckets(S.bucket_rows(t), os.path.join(d, "buckets"))
    assert spark.read.text(os.path.join(d, "buckets")).where("bucket = 'fp'").first()["value"] == "切(忌->记)"
    S.write_messages(t.withColumnRenamed("tgt", "trg"), os.path.join(d, "msgs"))
    assert spark.read.json(os.path.join(d, "msgs")).count() == 2
    S.append_runs(spark.createDataFrame([(1, 0.5)], "step int, f1 double"), os.path.join(d, "runs"))
    S.append_runs(spark.createDataFrame([(2, 0.6)], "step int, f1 double"), os.path.join(d, "runs"))
    assert spark.read.parquet(os.path.join(d, "runs")).count() == 2
    S.write_shards(spark.range(250).select(F.col("id").cast("string").alias("value")), os.path.join(d, "shards"), 100)
    files = [f for f in os.listdir(os.path.join(d, "shards")) if f.startswith("part-")]
    assert len(files) >= 3
    per_cat = spark.createDataFrame([("sig", 1.0, 0), ("gam", 2.0, 1), ("xyz", 3.0, 2)], "cat string, f1 double, format long")
    avg = spark.createDataFrame([(2.0,)], "f1 double")
    rep = json.loads(S.report_json(per_cat, "cat", ["f1"], ["format"], avg).first()["report"])
    assert list(rep["results"]) == ["GAM", "SIG", "XYZ"]
    assert rep["results"]["SIG"]["dropped"]["format"] == 0 and rep["average"]["f1"] == 2.0


def test_inventory_guard(spark):
    d = tempfile.mkdtemp(prefix="tp-inv-")
    _write(d, "train.example.jsonl", ["{}"])
    with pytest.raises(Exception):
        RD.inventory(spark.read.text(d)).collect()
    assert RD.inventory(spark.read.text(d), allow_example=True).first()["n_rows"] == 1


def test_stream_routing(spark):
    d = tempfile.mkdtemp(prefix="tp-stream-")
    os.makedirs(os.path.join(d, "in"))
    _write(os.path.join(d, "in"), "a.jsonl", ['{"src":"切纪","tgt":"切忌"}', "bad{", '{"src":"ab","tgt":"a"}'])
    vocab = V.basic_vocab(spark, "切纪忌ab")
    st = K.classified_stream(K.pair_stream(spark, os.path.join(d, "in")), vocab, 128)
    q = K.route(st, os.path.join(d, "good"), os.path.join(d, "bad"), os.path.join(d, "ck"))
    q.awaitTermination()
    assert spark.read.parquet(os.path.join(d, "good")).count() == 1
    assert sorted(r["reason"] for r in spark.read.parquet(os.path.join(d, "bad")).collect()) == ["invalid", "length_mismatch"]
    # restart with one more file: the exactly-once file source only reads the new one
    _write(os.path.join(d, "in"), "b.jsonl", ['{"src":"切忌","tgt":"切忌"}'])
    q = K.route(K.classified_stream(K.pair_stream(spark, os.path.join(d, "in")), vocab, 128),
                os.path.join(d, "good"), os.path.join(d, "bad"), os.path.join(d, "ck"))
    q.awaitTermination()
    assert spark.read.parquet(os.path.join(d, "good")).count() == 2
