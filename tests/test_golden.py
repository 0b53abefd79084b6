"""Golden cases worked out by hand from the reference's rules (FIXTURES.md section 2)."""

import json

from pyspark.sql import functions as F

from textpairs.functions import text as T
from textpairs.operators import clean as C
from textpairs.operators import layouts as L
from textpairs.operators import metrics as M
from textpairs.operators import runs as RU
from textpairs.operators import vocab as V
from textpairs.sources import readers as RD
from textpairs.sources import sinks as S


def test_waterfall_golden(spark):
    lines = [
        ('{"src":"切纪","tgt":"切忌"}', "accepted"),
        ('{"src":1,"tgt":"a"}', "invalid"),
        ('{"src":"a"}', "invalid"),
        ("[1]", "invalid"),
        ("bad{", "invalid"),
        ("", "empty"),
        ('{"src":"","tgt":"a"}', "empty"),
        ('{"src":"ab","tgt":"a"}', "length_mismatch"),
        ('{"src":"a b","tgt":"abc"}', "token_mismatch"),
        (json.dumps({"src": "a" * 63, "tgt": "b" * 63}), "seq_length"),
        (json.dumps({"src": "a" * 62, "tgt": "b" * 62}), "accepted"),
    ]
    df = spark.createDataFrame([(i, l) for i, (l, _) in enumerate(lines)], "i int, line string")
    p = RD.with_json_pair(df, "line").select("i", "valid", "error", "src", "tgt")
    vocab = V.basic_vocab(spark, "切纪忌ab")
    got = {r["i"]: r["reason"] for r in C.classify_pairs(p, vocab, 128).collect()}
    assert [got[i] for i in range(len(lines))] == [r for _, r in lines]
    # audit semantics: a blank line is invalid
    pa = RD.with_json_pair(df, "line", blank_as="invalid").select("i", "valid", "error", "src", "tgt")
    got_a = {r["i"]: r["reason"] for r in C.classify_pairs(pa, vocab, 128).collect()}
    assert got_a[5] == "invalid"


def test_error_kinds(spark):
    good = '{"src":"a","tgt":"b"}'
    lines = ['{"src":1,"tgt":"a"}', '{"src":"a"}', "bad{", good + " x", good + ' {"c":1}', good + " x}", good + "]", good + "}",
             good + ', {"c":1}', good + ', "y":2', "[" + good + "]", '"src"', '{"src":null,"tgt":"b"}']
    df = spark.createDataFrame(list(enumerate(lines)), "i int, line string")
    got = {r["i"]: r for r in RD.with_json_pair(df, "line").collect()}
    expected = []
    for line in lines:
        try:
            obj = json.loads(line)
            kind = ("bad_json" if not isinstance(obj, dict) else "missing_field" if not {"src", "tgt"} <= set(obj)
                    else None if all(isinstance(obj[k], str) for k in ("src", "tgt")) else "non_string")
        except ValueError:
            kind = "bad_json"
        expected.append(kind)
    assert [got[i]["error"] for i in range(len(lines))] == expected
    assert not any(r["valid"] for r in got.values())


def test_the_last_of_a_repeated_key_counts(spark):
    df = spark.createDataFrame([('{"src":1,"src":"a","tgt":"b"}',), ('{"src":"a","tgt":"b","tgt":2}',)], "line string")
    got = RD.with_json_pair(df, "line").collect()
    assert [(r["valid"], r["error"], r["src"]) for r in got] == [(True, None, "a"), (False, "non_string", None)]


def _triples(spark):
    rows = [("切纪", "切忌", "切忌"), ("切纪", "切忌", "切纪"), ("切纪", "切忌", "切记"),
            ("切忌", "切忌", "切忌"), ("切忌", "切忌", "切记")]
    return spark.createDataFrame(rows, "src string, tgt string, pred string")


def test_metrics_safe_and_guarded(spark):
    t = _triples(spark)
    r = M.correction_metrics(t, [], "safe").first()
    assert (r["samples"], r["positives"], r["negatives"]) == (5, 3, 2)
    assert abs(r["precision"] - 100 / 3) < 1e-9 and abs(r["recall"] - 100 / 3) < 1e-9
    assert abs(r["f1"] - 100 / 3) < 1e-9 and abs(r["fpr"] - 50.0) < 1e-9
    g = M.correction_metrics(t, [], "guarded").first()
    assert abs(g["precision"] - 1 / 3) < 1e-9 and abs(g["recall"] - 1 / 3) < 1e-9
    assert abs(g["wpr"] - 1 / 3) < 1e-9
    pos_only = t.where(F.col("src") != F.col("tgt"))
    assert M.correction_metrics(pos_only, [], "safe").first()["fpr"] == 0.0
    assert M.correction_metrics(pos_only, [], "eps").first()["fpr"] == 0.0
    assert M.correction_metrics(pos_only, [], "guarded").first()["fpr"] == 1.0


def test_annotation(spark):
    t = _triples(spark)
    rows = S.bucket_rows(t).select("src", "pred", "bucket", "annotation").collect()
    ann = {(r["src"], r["pred"]): (r["bucket"], r["annotation"]) for r in rows}
    assert ann[("切纪", "切忌")] == ("tp", "切(纪->忌)")
    assert ann[("切忌", "切记")] == ("fp", "切(忌->记)")
    assert ann[("切纪", "切记")][0] == "wp"


def test_punct_equal_not_symmetric(spark):
    df = spark.createDataFrame([("好。", "好!"), ("好a", "好。"), ("好。", "好a")], "a string, b string")
    got = [r[0] for r in df.select(T.punct_equal_text("a", "b", T.PUNCT_LONG)).collect()]
    assert got == [True, False, True]


def test_layout_i01(spark):
    vocab = V.basic_vocab(spark, "切纪忌")
    cv = V.CharVocab(vocab)
    df = spark.createDataFrame([("切纪", "切忌")], "src string, tgt string")
    df = df.select(cv.encode("src").alias("s"), cv.encode("tgt").alias("t"))
    ids = {k: cv.id_of(k) for k in V.SPECIALS}
    r = df.select(L.rephrase_stream("s", "t", 10, ids[V.CLS], ids[V.SEP], ids[V.MASK], ids[V.PAD]).alias("f")).first()["f"]
    inv = {v: k for k, v in cv.ids.items()}
    assert [inv[i] for i in r["input_ids"]] == [V.CLS, "切", "纪", V.SEP, V.MASK, V.MASK, V.SEP, V.PAD, V.PAD, V.PAD]
    assert [inv.get(i, i) for i in r["labels"]] == [-100] * 4 + ["切", "忌"] + [-100] * 4
    assert r["source_mask"] == [False, True, True] + [False] * 7
    assert r["mft_candidates"] == [False, True] + [False] * 8
    assert r["attention_mask"] == [1] * 7 + [0] * 3


def test_best3_retention(spark):
    runs = spark.createDataFrame([(0, 1, 50.0), (0, 2, 60.0), (0, 3, 50.0), (0, 4, 70.0)], "run int, step int, f1 double")
    kept = [r["step"] for r in RU.top_runs(runs, "run", "step", "f1", 3).orderBy("rank").collect()]
    assert kept == [4, 2, 1]


def test_strict_tsv_trap(spark):
    df = spark.createDataFrame([("abc\t",), ("发 动\t发 动",)], "line string")
    rows = df.select(RD.parse_tsv_strict("line", "PERMISSIVE").alias("p")).select("p.*").collect()
    assert rows[0]["valid"] is False
    assert rows[1]["src_tokens"] == ["发", "动"]
    lenient = df.select(RD.parse_tsv_lenient("line").alias("p")).select("p.*").collect()
    assert lenient[0]["valid"] is True and lenient[0]["tgt_tokens"] == []


def test_slots():
    assert C.slots(128) == 62 and C.slots(127) == 62 and C.slots(127, "batch") == 61
