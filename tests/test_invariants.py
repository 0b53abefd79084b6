"""Invariants: noise, partition independence, exact ordered index, line index."""

import os
import tempfile

from pyspark.sql import functions as F

from textpairs.operators import noise as N
from textpairs.plans.indexing import line_index, row_index
from textpairs.sources import derived as D

SF = "/root/testdata/sf0.001"


def test_noise_changes_at_most_one_char(spark):
    p = D.pairs(spark, SF).select("src", "tgt", "noise_pos").collect()
    assert p
    for r in p:
        assert len(r["src"]) == len(r["tgt"])
        diff = sum(a != b for a, b in zip(r["src"], r["tgt"]))
        assert diff <= 1
        if diff == 1:
            assert r["noise_pos"] is not None


def test_noise_independent_of_partitioning(spark):
    base = D.sentences(spark, SF)
    conf, words = D.confusion_df(spark), D.words_df(spark)
    outs = []
    for n in (1, 3, 16):
        d = N.inject_noise(base.repartition(n), "tgt", "k", conf, words, len(D.ALPHABET), out_col="src")
        outs.append(sorted((r["guid"], r["src"]) for r in d.select("guid", "src").collect()))
    assert outs[0] == outs[1] == outs[2]


def test_nth_eligible_matches_python(spark):
    df = spark.createDataFrame([("ab1c2d", 0), ("ab1c2d", 2), ("ab1c2d", 3), ("1x", 0)], "t string, k int")
    got = [r[0] for r in df.select(N.nth_eligible(F.col("t"), "[a-z]", F.col("k"))).collect()]
    exp = []
    for t, k in [("ab1c2d", 0), ("ab1c2d", 2), ("ab1c2d", 3), ("1x", 0)]:
        exp.append([i + 1 for i, c in enumerate(t) if c.isalpha()][k])
    assert got == exp


def test_row_index_exact(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5003).alias("v"), (F.col("id") % 3).alias("g"))
    out = row_index(df, ["v"], ["g"], out_col="i", num_partitions=7).collect()
    by_g = {}
    for r in out:
        by_g.setdefault(r["g"], []).append((r["v"], r["i"]))
    for g, rows in by_g.items():
        rows.sort()
        assert [i for _, i in rows] == list(range(len(rows)))


def test_line_index_over_files(spark):
    d = tempfile.mkdtemp(prefix="tp-lines-")
    with open(os.path.join(d, "1.txt"), "w") as f:
        f.write("a\nb\n\nc\n")
    with open(os.path.join(d, "2.txt"), "w") as f:
        f.write("long line one\nlong line two\n")
    rows = line_index(spark.read.text(d)).select("line_idx", "value").orderBy("line_idx").collect()
    assert [r["value"] for r in rows] == ["a", "b", "", "c", "long line one", "long line two"]
    assert [r["line_idx"] for r in rows] == list(range(6))


def test_near_error_brute_force(spark):
    """H02 against a pure-Python model of the rule on real derived pairs."""
    from textpairs.functions import rng
    p = D.pairs(spark, SF).select("guid", "k", "src", "tgt")
    out = N.inject_near_error(p, "src", "tgt", "k", D.confusion_df(spark), D.words_df(spark), len(D.ALPHABET),
                              seed=7, char_class=D.CHAR_CLASS)
    hashed = out.select("src", "tgt", "noisy", "noise_pos",
                        rng.hash32(F.col("k"), rng.purpose("near", 7)).alias("h")).collect()
    for r in hashed:
        s, t = r["src"], r["tgt"]
        n = len(s)
        first = next((i for i in range(min(n, len(t))) if s[i] != t[i]), -1)
        i = first if first >= 0 else n - 1
        near = list(range(max(0, i - 5), min(n, i + 6))) if n > 0 else []
        if not near:
            assert r["noisy"] == s
            continue
        choice = near[r["h"] % len(near)]
        if choice == first or not ("a" <= s[choice] <= "z"):
            assert r["noisy"] == s and r["noise_pos"] is None
        else:
            assert r["noise_pos"] == choice + 1
            assert len(r["noisy"]) == n and r["noisy"][:choice] == s[:choice] and r["noisy"][choice + 1:] == s[choice + 1:]
