"""Task unions, one-pass averages, rare characters, Han noise, committed sinks."""
import math
import random

import pytest
from pyspark.sql import functions as F

from textpairs.functions.text import HAN_CLASS
from textpairs.operators import metrics as M
from textpairs.operators import multitask as MT
from textpairs.operators import noise as N
from textpairs.operators import reports as R
from textpairs.plans.indexing import row_index
from textpairs.sources import sinks as S


def test_unlike_tasks_get_one_schema(spark):
    a = spark.createDataFrame([("x", [1, 2, 3], [4, 5, 6])], "id string, src array<int>, trg_ids array<int>")
    b = spark.createDataFrame([(7, [9, 9, 9], [8, 8, 8], [1, 0, 1])], "n bigint, ids array<int>, trg_ids array<int>, mask array<int>")
    fields = {"ids": 0, "trg_ids": 0, "ref": "trg_ids", "mask": -100}
    u = MT.unite([MT.Task(0, a, "id", {"ids": "src"}), MT.Task(5, b, "n", fills={"ref": -1})], fields, 3)
    assert u.columns == ["task_id", "key", "ids", "trg_ids", "ref", "mask"]
    assert sorted(map(tuple, u.collect())) == [
        (0, "x", [1, 2, 3], [4, 5, 6], [4, 5, 6], [-100, -100, -100]), (5, "7", [9, 9, 9], [8, 8, 8], [-1, -1, -1], [1, 0, 1])]
    for bad, error in ((a, "3 places"), ):
        with pytest.raises(Exception, match=error):
            MT.unite([MT.Task(0, bad, "id", {"ids": "src"})], fields, 4).collect()
    with pytest.raises(ValueError, match="no array"):
        MT.unite([MT.Task(0, a, "id", {"ids": "src"}, {"mask": "ref", "ref": "mask"})], fields, 3)
    with pytest.raises(ValueError, match="differ"):
        MT.unite([MT.Task(0, a, "id"), MT.Task(0, a, "id")], fields, 3)


def test_mixed_batches_hold_every_row_once(spark):
    rows = spark.range(50).select((F.col("id") % 3).cast("int").alias("task_id"), F.col("id").cast("string").alias("key"), F.array("id").alias("ids"))
    got = MT.mixed_batches(rows, 8, 1).collect()
    assert sorted((r["batch_id"], r["place"]) for r in got) == [(i // 8, i % 8) for i in range(50)]
    assert all(r["ids"] == [int(r["key"])] for r in got)
    assert len({r["task_id"] for r in got if r["batch_id"] == 0}) > 1


def test_averages_equal_two_passes(spark):
    rng = random.Random(1)
    rows = [(rng.choice("abc"), s := rng.choice(["x", "y"]), rng.choice(["x", "y"]), rng.choice([s, "x", "z"])) for _ in range(200)]
    df = spark.createDataFrame(rows, "cat string, src string, tgt string, pred string")
    got = {r["rule"]: r for r in M.averages(df, "cat").collect()}
    old = {r["rule"]: r for r in M.macro_average(M.correction_metrics(df, ["cat"]), "cat").collect()}
    micro = M.correction_metrics(df, []).first()
    for m in ("precision", "recall", "f1", "fpr"):
        assert got["mean_valid"][m] == old["mean_valid"][m] and got["fixed"][m] == old["fixed"][m] and got["micro"][m] == micro[m]
    assert {r["rule"]: r["f1"] for r in M.averages(df.limit(0), "cat").collect()} == {"mean_valid": 0.0, "fixed": 0.0, "micro": 0.0}


def test_rare_characters_are_a_weighted_quantile(spark):
    texts = spark.createDataFrame([("a" * 90 + "bbbb" + "ccc" + "dd" + "e",), ("",), (None,)], "t string")
    counts = R.character_counts(texts, "t")
    assert {r["ch"] for r in R.rare_characters(counts, 0.06).collect()} == {"e", "d", "c"}
    conf = spark.createDataFrame([("k", "a", 0, x) for x in "abcdez"], "kind string, ch string, idx int, cand string")
    assert tuple(R.rare_candidates(conf, counts, 0.06).first()) == ("k", 6, 1, 4)


def test_the_class_decides_with_and_without_a_list(spark):
    texts = ["一a鿿b", "abc", "", "㐀一", "丁丂七"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    n = [r[0] for r in df.select(N.count_eligible(F.col("t"), HAN_CLASS)).collect()]
    assert n == [sum(0x4E00 <= ord(c) <= 0x9FFF for c in t) for t in texts]
    at = [r[0] for r in df.where("t = '一a鿿b'").select(N.nth_eligible(F.col("t"), HAN_CLASS, F.lit(1))).collect()]
    assert at == [3]


def test_written_lines_are_checked(spark, tmp_path):
    rows = spark.range(40).select("id", F.concat(F.lit("v"), F.col("id")).alias("v"), (F.col("id") % 2).cast("string").alias("bucket"))
    out = str(tmp_path / "out")
    assert S.write_lines(rows, out, "v", ["id"], "bucket") == 40
    back = S.read_committed(spark, out, schema="value string, bucket string")
    assert sorted((r["bucket"], r["value"]) for r in back.collect()) == sorted((str(i % 2), f"v{i}") for i in range(40))
    got = [r["value"] for r in back.where("bucket = '1'").withColumn("f", F.col("_metadata.file_path"))
           .withColumn("i", F.monotonically_increasing_id()).orderBy("f", "i").collect()]
    assert got == [f"v{i}" for i in range(1, 40, 2)]
    with pytest.raises(Exception, match="line feed"):
        S.write_lines(rows.withColumn("v", F.lit("a\nb")), str(tmp_path / "bad"), "v")
    (tmp_path / "half").mkdir()
    (tmp_path / "half" / "part-0.txt").write_text("x\n")
    with pytest.raises(OSError, match="commit mark"):
        S.read_committed(spark, str(tmp_path / "half"))


def test_offsets_are_broadcast(spark):
    """Numbering must not shuffle the data a second time."""
    df = spark.range(10_000).select(F.col("id"), (F.col("id") % 3).alias("g"), F.rand(1).alias("x"))
    for groups in ((), ("g",)):
        plan = row_index(df, ["x", "id"], groups)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    x = spark.createDataFrame([(float(i % 10), float(i % 7)) for i in range(500)], "x double, y double")
    plan = M.average_ranks(x, "x", "r")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert not math.isnan(M.spearman(x, "x", "y").first()["spearman"])


def test_scratch_of_a_run_is_removed(spark):
    from pathlib import Path

    from textpairs import session
    kept = session.scratch_path(spark, "kept")
    spark.range(3).write.parquet(kept)
    with session.scratch_run(spark) as outer:
        a = session.scratch_path(spark, "a")
        with session.scratch_run(spark) as inner:
            b = session.scratch_path(spark, "b")
            assert a.startswith(outer) and b.startswith(inner) and inner.startswith(outer)
            spark.range(3).write.parquet(b)
        spark.range(3).write.parquet(a)
        assert spark.read.parquet(a).count() == 3 and not Path(b.removeprefix("file:")).exists()
    assert not Path(a.removeprefix("file:")).exists() and spark.read.parquet(kept).count() == 3


def test_json_lines_are_one_whole_object(spark):
    import json

    from textpairs.sources import readers as RD
    lines = ['{"src":"a","tgt":"b"}', ' {"src":"a","tgt":"b"}\t', '{"src":"a","tgt":"b"}]', '{"src":"a","tgt":"b"}] [', '{"src":"a","tgt":"b"},{"src":"a","tgt":"b"}',
             '{"src":"a","tgt":"b"} {}', '{"src":"a","tgt":"b"},1],[{"src":"a","tgt":"b"}', '[{"src":"a","tgt":"b"}]', '{"src":"a","tgt":"b"', '{"src":"a","tgt":null}',
             '{"src":"}],[{","tgt":"\\u005d"}', '{"src":1,"tgt":"b"}', '{"src":"a"}', '{"src":"x","src":"a","tgt":"b"}', '{"src":"a","tgt":"b"}x}', '""', "null", "{}"]
    got = RD.with_json_pair(spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string"), "line").collect()

    def valid(x):
        try:
            v = json.loads(x)
        except ValueError:
            return False
        return isinstance(v, dict) and isinstance(v.get("src"), str) and isinstance(v.get("tgt"), str)
    assert {r["i"]: r["valid"] for r in got} == {i: valid(x) for i, x in enumerate(lines)}
    assert next(r for r in got if r["i"] == 10)["src"] == "}],[{" and next(r for r in got if r["i"] == 13)["src"] == "a"
