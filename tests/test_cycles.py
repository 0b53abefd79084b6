"""The endless shuffled stream and batches across cycles."""
import pytest
from pyspark.sql import functions as F

from textpairs.operators import mix as MX
from textpairs.streaming import cycles as CY


def write(folder, sizes):
    folder.mkdir(parents=True)
    n = 0
    for f, size in enumerate(sizes):
        (folder / f"f{f:02d}.txt").write_text("".join(f"row {n + i}\n" for i in range(size)))
        n += size
    return n


def by_hand(n, shards, cycles, size, seed):
    """(cycle, raw_idx) in the order each shard gives them."""
    out = {}
    for shard in range(shards):
        got = out[shard] = []
        for c in range(cycles):
            held, seen = [], 0
            for i in range(shard, n, shards):
                if len(held) < size:
                    held.append(i)
                else:
                    at = CY.draw(seed, c, shard, seen, size)
                    got.append((c, held[at]))
                    held[at] = i
                seen += 1
            order = list(range(len(held)))
            for i in range(len(order) - 1, 0, -1):
                j = CY.draw(seed, c, shard, seen + i, i + 1)
                order[i], order[j] = order[j], order[i]
            got += [(c, held[i]) for i in order]
    return out


@pytest.mark.parametrize("stops, per_trigger", [([2], 1), ([1, 2], 3)])
def test_two_cycles_shuffled_and_restarted(spark, tmp_path, stops, per_trigger):
    n = write(tmp_path / "in", [5, 1, 9, 4])
    files = CY.manifest(spark, str(tmp_path / "in"))
    assert [f[1:] for f in files] == [(5, 0), (1, 5), (9, 6), (4, 15)]
    for cycles in stops:
        s = CY.cycle_stream(spark, files, 2, cycles, per_trigger)
        CY.run_available(CY.shuffled(s.withColumn("at", F.lit(1)), 4, 7), str(tmp_path / "out"), str(tmp_path / "ck"))
    # files are written per micro-batch and shard in the order rows leave the buffer
    rows = (spark.read.parquet(str(tmp_path / "out")).withColumn("f", F.col("_metadata.file_path"))
            .withColumn("m", F.col("_metadata.file_modification_time")).withColumn("i", F.monotonically_increasing_id()).collect())
    expected = by_hand(n, 2, 2, 4, 7)
    for shard in (0, 1):
        got = [r for r in rows if r["shard"] == shard]
        assert sorted((r["cycle"], r["raw_idx"]) for r in got) == sorted(expected[shard])
        assert all(r["value"] == f"row {r['raw_idx']}" for r in got)
        chunks = {}
        for r in sorted(got, key=lambda r: (r["m"], r["f"], r["i"])):
            chunks.setdefault(r["m"], []).append((r["cycle"], r["raw_idx"]))
        assert sum((c for _, c in sorted(chunks.items())), []) == expected[shard]
        for c in (0, 1):
            order = [i for k, i in expected[shard] if k == c]
            assert order != sorted(order)
    assert [i for c, i in expected[0] if c == 0] != [i for c, i in expected[0] if c == 1]


def test_without_buffer_and_endless(spark, tmp_path):
    write(tmp_path / "in", [3, 2])
    s = CY.shuffled(CY.cycle_stream(spark, CY.manifest(spark, str(tmp_path / "in")), 1, 0, 2), 0)
    q = s.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        for _ in range(600):
            if q.lastProgress and q.lastProgress["batchId"] >= 3:
                break
            q.awaitTermination(0.1)
    finally:
        q.stop()
    got = spark.read.parquet(str(tmp_path / "out")).groupBy("cycle").count().orderBy("cycle").collect()
    assert [tuple(r) for r in got][:3] == [(0, 5), (1, 5), (2, 5)]


def test_a_cycle_without_rows_is_an_error(spark, tmp_path):
    write(tmp_path / "in", [1])
    files = CY.manifest(spark, str(tmp_path / "in"))
    with pytest.raises(Exception, match="cycle without output"):
        CY.run_available(CY.shuffled(CY.cycle_stream(spark, files, 2, 1), 4), str(tmp_path / "out"), str(tmp_path / "ck"))
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError, match="no lines"):
        CY.manifest(spark, str(tmp_path / "none"))


def test_batches_run_on_across_cycles(spark):
    df = MX.cycles(spark.range(10).select(F.col("id").cast("string").alias("k"), F.lit(0).alias("shard")), 3)
    rows = MX.with_batch(df, "k", 4, 1, "shard", "cycle", across=True).orderBy("pos_in_shard").collect()
    assert [r["pos_in_shard"] for r in rows] == list(range(30))
    assert [r["cycle"] for r in rows] == [0] * 10 + [1] * 10 + [2] * 10
    assert [r["batch_id"] for r in rows] == [i // 4 for i in range(30)]
    assert len({tuple(r["k"] for r in rows[i:i + 10]) for i in (0, 10, 20)}) == 3
