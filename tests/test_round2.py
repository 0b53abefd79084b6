"""Wide sums, layouts, alignment, labels and the encoder against hand-worked values."""
import math

import pytest
from pyspark.sql import functions as F

from textpairs.operators import align as A
from textpairs.operators import layouts as L
from textpairs.operators import metrics as M
from textpairs.operators import mix as MX
from textpairs.operators import reports as R
from textpairs.operators import vocab as V
from textpairs.session import bounded_broadcast, constant_table


def test_rank_correlation_beyond_the_range_of_bigint(spark):
    n = 3_000_000
    df = spark.range(n).select(F.col("id").alias("x"), (F.lit(2 * n) - F.col("id") * 2).alias("y"))
    r = M.spearman(df, "x", "y").first()
    assert (r["n"], r["spearman"]) == (n, pytest.approx(-1.0))


def test_mcc_with_counts_beyond_bigint_products(spark):
    big = 4_000_000_000
    cm = spark.createDataFrame([(0, 0, big), (1, 1, big), (0, 1, big // 4), (1, 0, big // 4)], "label int, pred int, n bigint")
    stats = M.class_stats(cm)
    got = stats.agg(M._products("n_pred", "n_true").alias("pt")).first()["pt"]
    assert int(got) == 2 * (big + big // 4) ** 2


def test_perplexity_is_the_exponential_of_the_mean(spark):
    df = spark.createDataFrame([("a", 100), ("a", 250), ("b", 100_000)], "run string, cents bigint")
    got = {r["run"]: r for r in M.perplexity(df, "cents", ["run"]).collect()}
    assert got["a"]["perplexity"] == pytest.approx(math.exp(1.75), rel=1e-12)
    assert got["b"]["perplexity"] == math.inf


def test_a_row_with_a_null_text_is_not_missing(spark):
    s = spark.createDataFrame([("1", None), ("2", "b")], "guid string, src string")
    t = spark.createDataFrame([("1", "x"), ("3", "y")], "guid string, tgt string")
    p = spark.createDataFrame([("1", None), ("2", "z")], "guid string, pred string")
    got = {r["guid"]: r["status"] for r in A.align(s, t, p).collect()}
    assert got == {"1": "ok", "2": "missing_target", "3": "missing_source"}


def test_an_unknown_label_fails_the_query(spark):
    table = V.label_table(spark, "t", ["0", "1"])
    ok = spark.createDataFrame([("1",)], "label string")
    assert V.label_id_or_fail(ok, table).first()["label_id"] == 1
    for bad in ("2", None):
        with pytest.raises(Exception, match="unknown label"):
            V.label_id_or_fail(spark.createDataFrame([(bad,)], "label string"), table).collect()


def test_encoder_ids_limits_and_unknowns(spark):
    cv = V.CharVocab(V.basic_vocab(spark, "切纪忌ab"))
    df = spark.createDataFrame([("切 a\u200bz\U0001F600忌",), ("",), (None,)], "x string")
    got = [(r["all"], r["two"]) for r in df.select(cv.encode("x").alias("all"), cv.encode("x", 2).alias("two")).collect()]
    assert got == [([5, 8, 1, 1, 7], [5, 8]), ([], []), (None, None)]


def _arrays(spark, lay, **cols):
    df = spark.range(1).select(*[F.array(*[F.lit(x) for x in v]).cast("array<int>").alias(k) if isinstance(v, list)
                                 else F.lit(v).alias(k) for k, v in cols.items()])
    return df.select(lay.alias("l")).select("l.*").first().asDict()


def test_prompted_classification_layout(spark):
    got = _arrays(spark, L.prompted_classification("t", "y", 2, 4, 2, 2, 3, 4, 0), t=[7, 8, 9], y=1)
    assert got == {"src_ids": [2, 7, 8, 3, 3, 3, 4, 4], "attention_mask": [1] * 8, "prompt_mask": [0, 0, 0, 0, 1, 1, 0, 0],
                   "active_bits": [-100] * 6 + [1, 1], "trg_ids": [1, 0, 0, 0, 0, 0, 0, 0]}


def test_instruction_layout_in_both_styles(spark):
    parts = dict(p=[5], i=[6, 7], s=[8], r=[9], d=False)
    plain = _arrays(spark, L.instruction("p", "i", "s", "r", 12, 3, 0, "d"), **parts)
    assert plain["input_ids"] == [5, 6, 7, 8, 9, 3] + [0] * 6
    assert plain["src_ref"] == [-100, 6, 7, -100, -100, 3] + [0] * 6
    assert plain["labels"] == [-100] * 4 + [9, 3] + [-100] * 6
    marked = _arrays(spark, L.instruction("p", "i", "s", "r", 6, 3, 0, "d", (195, 196)), **{**parts, "d": True})
    assert marked["input_ids"] == [195, 5, 6, 8, 196, 9] and marked["overflow"] == 1
    assert marked["src_ref"] == [195, -100, -100, -100, 196, -100]


def test_causal_references(spark):
    got = _arrays(spark, L.causal("s", "t", 8, 2, 3, 4, 0), s=[7, 8], t=[9, 8])
    assert got["input_ids"] == [0, 2, 7, 8, 3, 9, 8, 4] and got["labels"] == [-100] * 5 + [9, 8, 4]
    assert got["regu_src"] == [-100, -100, 7, 8, 3, -100, -100, -100]
    assert got["target_ref"] == [-100, 2, 9, 8, 4, -100, -100, -100]
    arrows = _arrays(spark, L.causal("s", "t", 16, 2, 3, 4, 0, True, 50), s=[7, 8], t=[9, 8])
    assert arrows["labels"][-7:] == [7, 50, 9, 8, 50, 8, 4]


def test_prompted_rephrase_rejects_or_cuts(spark):
    long = dict(s=[9] * 60, t=[8] * 60)
    rejected = _arrays(spark, L.prompted_rephrase("s", "t", 64, 2, 2, 3, 4, 0), **long)
    assert rejected["fits"] is False and rejected["src_ids"] is None
    cut = _arrays(spark, L.prompted_rephrase("s", "t", 64, 2, 2, 3, 4, 0, parity=True), **long)
    assert cut["fits"] is False and len(cut["src_ids"]) == 64
    anchored = _arrays(spark, L.prompted_rephrase("s", "t", 16, 1, 2, 3, 4, 0, anchor=[50]), s=[7], t=[8])
    assert anchored["src_ids"][:7] == [2, 2, 7, 50, 3, 4, 3] and anchored["trg_ref_ids"][:7] == [2, 2, 8, 50, 3, 8, 3]
    assert anchored["block_flag"][:7] == [0, 1, 0, 0, 1, 0, 0]


def test_two_sentence_segments(spark):
    got = _arrays(spark, L.classification("a", "b", "y", 8, 2, 3, 0, task_id=3), a=[7], b=[8, 9], y=5)
    assert got == {"src_ids": [2, 7, 3, 8, 9, 3, 0, 0], "attention_mask": [1] * 6 + [0, 0], "task_id": 3,
                   "token_type_ids": [0, 0, 0, 1, 1, 1, 0, 0], "trg_ids": [5] * 8}


def test_broadcast_hint_follows_the_size_estimate(spark):
    small = constant_table(spark, [(1,)], "x int")
    assert "strategy=broadcast" in bounded_broadcast(small)._jdf.queryExecution().analyzed().toString()
    large = spark.range(1 << 40)
    assert "strategy=broadcast" not in bounded_broadcast(large)._jdf.queryExecution().analyzed().toString()


def test_noise_report_counts_errors_per_sentence(spark):
    rows = [("a", "abc", "abc"), ("a", "xbz", "abc"), ("a", "abcd", "abX"), ("a", "", "a"), ("b", "same", "same")]
    df = spark.createDataFrame([(*r, None, None) for r in rows], "lang string, src string, tgt string, noise_kind string, noise_pos int")
    got = {r["lang"]: (r["n_errors"], r["errors_per_sentence"]) for r in R.noise_report(df, ["lang"]).collect()}
    assert got == {"a": (3, 0.75), "b": (0, 0.0)}


def test_a_cycle_without_output_is_an_error(spark):
    df = spark.range(3)
    assert MX.cycles(df, 2).count() == 6 and MX.cycles(df.limit(0), 0).count() == 0
    with pytest.raises(ValueError, match="cycle without output"):
        MX.cycles(df.where("id > 5"), 2)
