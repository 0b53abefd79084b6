"""Property tests: Spark Column functions against pure-Python models of the rules, on
random strings (hypothesis), and the skew-proof prefix sum with one hot key."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textpairs.functions import text as T
from textpairs.plans.indexing import prefix_sum

ALPH = "ab.。,!x"
words = st.text(alphabet=ALPH, min_size=0, max_size=8)


def py_equals(a, b, marks):
    if len(a) != len(b):
        return False
    return all(x in marks or x == y for x, y in zip(a, b))


def py_annotate(a, b):
    out = list(a)
    for i, (x, y) in enumerate(zip(a, b)):
        if x != y:
            out[i] = f"({x}->{y})"
    return "".join(out)


def py_first_diff(a, b):
    for i, (x, y) in enumerate(zip(a, b)):
        if x != y:
            return i
    return -1


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(words, words), min_size=1, max_size=60))
def test_text_functions_match_python(spark, pairs):
    df = spark.createDataFrame(pairs, "a string, b string")
    rows = df.select("a", "b", T.punct_equal_text("a", "b", T.PUNCT_LONG).alias("eq"),
                     T.annotate_text("a", "b").alias("ann"),
                     T.first_diff(T.chars("a"), T.chars("b")).alias("fd")).collect()
    for r in rows:
        assert r["eq"] == py_equals(r["a"], r["b"], T.PUNCT_LONG), (r["a"], r["b"])
        assert r["ann"] == py_annotate(r["a"], r["b"])
        assert r["fd"] == py_first_diff(r["a"], r["b"])


def test_prefix_sum_hot_key(spark):
    rnd = random.Random(7)
    rows = [(0 if i % 3 == 0 else rnd.randint(1, 50), i, rnd.randint(0, 3)) for i in range(3000)]  # key 0: a third
    df = spark.createDataFrame(rows, "g int, o int, v int")
    out = prefix_sum(df, ["o"], "v", "cum", group_cols=["g"], exclusive=True, num_partitions=9).collect()
    expect, run = {}, {}
    for g, o, v in sorted(rows, key=lambda r: (r[0], r[1])):
        expect[(g, o)] = run.get(g, 0)
        run[g] = run.get(g, 0) + v
    assert {(r["g"], r["o"]): r["cum"] for r in out} == expect
