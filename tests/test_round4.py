"""Steps that large tables showed to keep copies or to follow the number of partitions."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from textpairs.operators import noise as N
from textpairs.plans import q_cycles, q_files
from textpairs.session import checkpoint_root
from textpairs.sources import derived as D
from textpairs.sources import ranges as R
from textpairs.streaming import cycles as CY


def kept(spark) -> int:
    top = checkpoint_root(spark).removeprefix("file:")
    return sum(os.path.getsize(f"{d}/{f}") for d, _, names in os.walk(top) for f in names)


def test_array_files_are_not_kept_twice(spark, tmp_path):
    docs = [(i, "\n".join(f'say "{i}" {{{j}}} \\ word ' + "abc " * 150 for j in range(20)), "en", "web") for i in range(40)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    before = kept(spark)
    rows = q_files.a11_message_array(spark, str(tmp_path))
    want = D.triples(spark, str(tmp_path)).select("src", F.col("tgt").alias("trg"), "pred")
    written = want.select(F.sum(F.octet_length(F.to_json(F.struct("*"))) + 2)).first()[0]
    got = rows.collect()
    assert kept(spark) - before < 1.2 * written  # the arrays, and no copy of the rows or of the pieces
    assert sorted((r["src"], r["trg"], r["pred"]) for r in got) == sorted(map(tuple, want.collect()))
    for shard in range(q_files.ARRAYS):
        mine = [r for r in got if r["shard"] == shard]
        assert sorted(r["obj"] for r in mine) == list(range(len(mine))) != []


@pytest.mark.parametrize("bytes_", [31, 200, 100_000])
def test_objects_over_range_borders(spark, tmp_path, bytes_):
    texts = ["", "}", '"}, {"', "x" * 90, "\\", '\\"}', "}{][", "é字😀" * 9, "{" * 40]
    (tmp_path / "in").mkdir()
    want = {}
    for f, objects in (("a.json", [{"src": a, "trg": b, "pred": [a, {"n": b}]} for a in texts for b in texts]), ("b.json", [{"src": "long" * 100}]), ("c.json", [])):
        (tmp_path / "in" / f).write_text(json.dumps(objects, ensure_ascii=False, indent=1 if f == "a.json" else None) + "\n")
        want[f] = objects
    keys = {"spark.sql.files.maxPartitionBytes": str(bytes_), "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        got = R.json_array_objects(spark, str(tmp_path / "in"), "*.json").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    for f, objects in want.items():
        rows = sorted((r["obj"], r["json"]) for r in got if r["file_path"].endswith(f))
        assert [o for o, _ in rows] == list(range(len(objects))) and [json.loads(j) for _, j in rows] == objects


def test_ranges_that_were_not_scanned_are_an_error():
    import pyarrow as pa
    rows = [("f", 0, None, None, None, None, None, "[{")]
    names = ["file_path", "block", "inside", "depth", "obj", "first", "last", "value"]
    with pytest.raises(ValueError, match="other ranges"):
        list(R._groups(False)(iter([pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows])])))


def test_state_follows_the_shards(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("".join(f"row {i}\n" for i in range(60)))
    files = CY.manifest(spark, str(tmp_path / "in"))
    before = spark.conf.get(CY.PARTITIONS)
    spark.conf.set(CY.PARTITIONS, "37")
    try:
        for cycles in (1, 2):
            s = CY.cycle_stream(spark, files, 3, cycles).withColumn("none", F.lit(None).cast("string"))
            CY.run_available(CY.shuffled(s, 4, 7), str(tmp_path / "out"), str(tmp_path / "ck"), 3)
        assert spark.conf.get(CY.PARTITIONS) == "37"
    finally:
        spark.conf.set(CY.PARTITIONS, before)
    stores = [p for p in os.listdir(tmp_path / "ck" / "state" / "0") if p.isdigit()]
    assert 3 <= len(stores) <= 12
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r["cycle"], r["raw_idx"], r["value"], r["none"]) for r in rows) == [(c, i, f"row {i}", None) for c in (0, 1) for i in range(60)]


@pytest.mark.parametrize("shards", [1, 2, 3, 7])
def test_shards_are_spread(spark, shards):
    n = CY.state_partitions(spark, shards)
    dealt = spark.range(shards).repartition(n, "id").select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert shards <= n <= 4 * shards and (shards > 3 or [r["count"] for r in dealt] == [1] * shards)


def test_cycles_shuffle_the_text_once(spark, tmp_path, monkeypatch):
    docs = [(i, "\n".join(f"line {i} of {j} " + "abc " * 9 for j in range(7)), "en", "web") for i in range(30)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    seen, shuffled = [], CY.shuffled
    monkeypatch.setattr(CY, "shuffled", lambda rows, *a: (seen.append(rows.columns), shuffled(rows, *a))[1])
    rows = q_cycles.k01_cycle_shuffle(spark, str(tmp_path)).collect()
    assert len(seen) == 2 and not any("src" in c for c in seen)
    assert sorted((r["cycle"], r["raw_idx"]) for r in rows) == [(c, i) for c in (0, 1) for i in range(210)]
    assert all(len(r["src"]) == len(r["tgt"]) and sum(a != b for a, b in zip(r["src"], r["tgt"])) <= 1 for r in rows)
    assert sum(r["src"] != r["tgt"] for r in rows) > 300


def test_eligible_characters_of_known_number(spark):
    texts = ["", "abc", "A.b.C-d", "x\u0001y\u0001z", "😀a😀b", "é字", "....z", "a" * 50 + "." * 50 + "b"]
    rows = [(t, k) for t in texts for k in range(sum("a" <= c <= "z" for c in t))] + [("", None), ("é字", None), (None, None)]
    df = spark.createDataFrame(rows, "t string, k int").withColumn("n", N.count_eligible(F.col("t"), "[a-z]"))
    for r in df.withColumn("at", N.nth_eligible(F.col("t"), "[a-z]", F.col("k"), F.col("n"))).collect():
        places = [i for i, c in enumerate(r["t"] or "", 1) if "a" <= c <= "z"]
        assert r["n"] == (None if r["t"] is None else len(places))
        assert r["k"] is None or r["at"] == places[r["k"]]
    noisy = N.inject_noise(df.select("t", F.coalesce("t", F.lit("-")).alias("key")), "t", "key", D.confusion_df(spark), D.words_df(spark), 26)
    assert "translate" not in plan_of(df.select("n")) and plan_of(noisy).count("translate(") == 1


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()
