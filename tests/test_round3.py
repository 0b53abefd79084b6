"""Steps that large tables showed to be repeated, interpreted or carried whole."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from textpairs.functions import text as T
from textpairs.operators import noise as N
from textpairs.operators import reports as R
from textpairs.plans import q_cycles, q_features, q_rest, q_sources
from textpairs.session import METHOD_LIMIT, prepare
from textpairs.sources import derived as D
from textpairs.sources import readers as RD
from textpairs.sources import sinks as S

DOCS = [(1, "The cat sat.\non  the mat\n\nx", "en", "web"), (2, "Ein Satz  hier", "de", None), (3, None, "en", "web"),
        (4, "", None, "book"), (5, "café 你好 bath\nbath", "en", "book"), (5, "word " * 60, "en", "book"), *[(i, f"line {i}\nand another%{i} one", "en", "web") for i in range(10, 60)]]


def docs(spark, tmp_path) -> str:
    d = spark.createDataFrame(DOCS, "doc_id bigint, text string, lang string, source string")
    d.write.mode("overwrite").parquet(f"{tmp_path}/sf/documents.parquet")
    return f"{tmp_path}/sf"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_large_methods_are_not_left_to_the_interpreter(spark):
    assert prepare(spark).conf.get(METHOD_LIMIT[0]) == METHOD_LIMIT[1]


def test_tsv_columns_equal_the_line_parsers(spark):
    lines = [None, "", "\t", "a b\tc d", " a  b \t c d\x1c", "ab\tcd", "a\tb\tc", "a b\t", "abc", "　a b\t  c \n", "x y\t \x0b"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string")
    for made, parser in ((RD.with_tsv_strict(df, "line", ["i"], "PERMISSIVE"), RD.parse_tsv_strict("line", "PERMISSIVE")),
                         (RD.with_tsv_lenient(df, "line", ["i"]), RD.parse_tsv_lenient("line"))):
        assert sorted(made.collect()) == sorted(df.select("i", parser.alias("p")).select("i", "p.*").collect())


def test_trim_and_tokens_are_pythons(spark):
    texts = [c + "a" + c + "b" + c for c in map(chr, range(0x3001)) if c.isspace()] + ["", "   ", "​ a", "a​"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, t string")
    for r in df.select("t", T.py_trim("t").alias("trim"), T.ws_tokens("t").alias("tokens")).collect():
        assert (r["trim"], r["tokens"]) == (r["t"].strip(), r["t"].split())


def test_lines_are_split_once_each(spark, tmp_path):
    sf = docs(spark, tmp_path)
    for query in (q_rest.b02_equal_length, q_sources.a01_tsv_strict, q_sources.a02_tsv_lenient, q_sources.b04_eval_waterfall):
        assert plan(query(spark, sf)).count(", \t, -1)") == 1


def test_batches_encode_what_they_keep(spark, tmp_path):
    sf = docs(spark, tmp_path)
    made = q_features._batch(spark, sf, 5)
    whole = q_features._whole(spark, sf)
    for c in ("s_ids", "t_ids"):
        whole = whole.withColumn(c, q_features.C.drop_ids(F.slice(c, 1, 5), q_features.DROPPED))
    want = whole.where(F.size("s_ids") == F.size("t_ids"))
    assert sorted(made.collect(), key=str) == sorted(want.collect(), key=str) and made.count() > 3
    assert plan(made).count("filter(") == 2


def test_first_error_is_found_once(spark):
    rows = [(str(i), a, b) for i, (a, b) in enumerate([("abcd", "abxd"), ("ab", "ab"), ("", ""), ("abc", "abcde"), ("xbc", "abc"), (None, "a")])]
    df = spark.createDataFrame(rows, "k string, src string, tgt string")
    near = N.inject_near_error(df, "src", "tgt", "k", D.confusion_df(spark), D.words_df(spark), len(D.ALPHABET))
    assert plan(near).count("zip_with(") == 1
    assert near.columns[:3] == ["k", "src", "tgt"] and near.count() == len(rows)
    first = df.select("k", T.first_diff(F.split("src", ""), F.split("tgt", "")).alias("d")).collect()
    assert [r["d"] for r in sorted(first)] == [2, -1, -1, -1, 0, None]


def test_lost_tokens_are_counted_once(spark):
    df = spark.createDataFrame([("a", ["x", "[UNK]"]), ("a", ["y"]), (None, None)], "lang string, t array<string>")
    df = df.withColumn("kept", T.strip_specials("t", ["[UNK]"]))
    out = R.changed_lengths(df, "t", "kept", ["lang"])
    assert plan(out).count("filter(") == 1
    assert sorted(out.collect(), key=str) == [("a", 2, 1, 1), (None, 1, 0, None)]


def test_triples_from_their_parts(spark, tmp_path):
    sf = docs(spark, tmp_path)
    cols = ["guid", "src", "tgt", "pred"]
    made = D.from_parts(D.triple_parts(spark, sf, "guid")).select(*cols)
    assert sorted(made.collect()) == sorted(D.triples(spark, sf).select(*cols).collect()) != []


def test_lines_are_made_behind_the_shuffle(spark, tmp_path):
    rows = spark.range(50).select(F.col("id").alias("i"))
    seen = []

    def made(ordered):
        seen.append(ordered.columns)
        return ordered.select(F.format_string("%03d", "i").alias("v"))

    assert S.write_lines(rows, str(tmp_path / "out"), "v", ["i"], made=made) == 50
    assert seen == [["i"]]
    assert [r["value"] for r in sorted(spark.read.text(str(tmp_path / "out")).collect())] == [f"{i:03d}" for i in range(50)]


def test_cycle_files_do_not_grow(spark, tmp_path, monkeypatch):
    sf = docs(spark, tmp_path)
    monkeypatch.setattr(q_cycles, "FILE_LINES", 2, raising=False)
    q_cycles.write_sentences(spark, sf, str(tmp_path / "in"))
    paths = sorted(p for p in os.listdir(tmp_path / "in") if p.endswith(".txt"))
    lines = [(tmp_path / "in" / p).read_text().splitlines() for p in paths]
    assert max(map(len, lines)) == 2
    want = [r["tgt"] for r in D.sentences(spark, sf).orderBy("doc_id", "sent_no", "tgt").select("doc_id", "sent_no", "tgt").collect()]
    assert sorted(sum(lines, [])) == sorted(want) and sum(lines, [])[:4] == want[:4]
