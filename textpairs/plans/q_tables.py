"""Queries over the driver's other tables: classification metrics, runs, spans, scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rng
from ..operators import metrics as M
from ..operators import mix as MX
from ..operators import runs as RU
from ..operators import scores as SC
from ..operators import vocab as V
from ..session import constant_table
from ..sources import derived as D
from . import oracle as O
from .queries import register

H = O.H


# ------------------------------------------------------------------ classifier stand-in on embeddings

def _emb_scores(spark, sf):
    """Score table: the 64 values of each embedding viewed as 4 positions x 16 tokens."""
    e = D.table(spark, sf, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("j", "score"))
    return e.select(F.col("vec_id").alias("id"), "label", (F.col("j") / 16).cast("int").alias("pos"),
                    (F.col("j") % 16).cast("int").alias("token"), "score")


def _emb_pred(spark, sf):
    """Predicted class = place of the largest of all 64 values (ties: the lowest), modulo 10."""
    v = F.col("embedding")
    place = F.array_position(v, F.array_max(v)) - 1
    return D.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label", (place % 10).cast("int").alias("pred"))


EMB_PRED = """ep AS (
  SELECT vec_id AS id, label, (list_position(embedding, list_max(embedding)) - 1) % 10 AS pred
  FROM embeddings)"""

CLASS_STATS = """cm AS (SELECT label, pred, count(*) AS n FROM ep GROUP BY label, pred),
cs AS (
  SELECT cls, coalesce(tp, 0) AS tp, coalesce(n_true, 0) AS n_true, coalesce(n_pred, 0) AS n_pred
  FROM (SELECT label AS cls, sum(n) AS n_true, sum(CASE WHEN label = pred THEN n ELSE 0 END) AS tp FROM cm GROUP BY label) t
  FULL JOIN (SELECT pred AS cls2, sum(n) AS n_pred FROM cm GROUP BY pred) p ON t.cls = p.cls2)"""

CLASS_STATS = CLASS_STATS.replace("SELECT cls, coalesce", "SELECT coalesce(cls, cls2) AS cls, coalesce")


@register("d07_accuracy", f"WITH {EMB_PRED}\nSELECT count(*) AS n, count_if(pred = label) AS correct, "
          "CAST(count_if(pred = label) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS accuracy FROM ep")
def d07_accuracy(spark, sf):
    """D07 + E08: accuracy of the argmax classifier on embeddings."""
    return M.accuracy(_emb_pred(spark, sf), "pred", "label").select("n", "correct", "accuracy")


@register("d08_f1", f"""WITH {EMB_PRED}, {CLASS_STATS},
f AS (SELECT cls, tp, n_true, n_pred, CASE WHEN _p + _r > 0 THEN 2.0 * _p * _r / (_p + _r) ELSE 0.0 END AS f1
      FROM (SELECT *, CASE WHEN n_pred > 0 THEN CAST(tp AS DOUBLE) / CAST(n_pred AS DOUBLE) ELSE 0.0 END AS _p,
                      CASE WHEN n_true > 0 THEN CAST(tp AS DOUBLE) / CAST(n_true AS DOUBLE) ELSE 0.0 END AS _r FROM cs) x)
SELECT count(*) AS n_classes, CAST(sum(tp) AS DOUBLE) / CAST(sum(n_true) AS DOUBLE) AS f1_micro,
       list_reduce(list(f1 ORDER BY cls), lambda a, b: a + b) / CAST(count(*) AS DOUBLE) AS f1_macro,
       list_reduce(list(f1 * CAST(n_true AS DOUBLE) ORDER BY cls), lambda a, b: a + b) / CAST(sum(n_true) AS DOUBLE) AS f1_weighted
FROM f""")
def d08_f1(spark, sf):
    """F1 micro / macro / weighted from the confusion matrix."""
    return M.f1_scores(_emb_pred(spark, sf), "pred", "label")


@register("d09_mcc", f"""WITH {EMB_PRED}, {CLASS_STATS},
a AS (SELECT sum(tp) AS c, sum(n_true) AS s, sum(n_pred * n_true) AS pt, sum(n_pred * n_pred) AS pp,
             sum(n_true * n_true) AS tt FROM cs)
SELECT s AS n, CASE WHEN den > 0 THEN num / den ELSE 0.0 END AS mcc
FROM (SELECT s, CAST(c AS DOUBLE) * CAST(s AS DOUBLE) - CAST(pt AS DOUBLE) AS num,
             sqrt((CAST(s AS DOUBLE) * CAST(s AS DOUBLE) - CAST(pp AS DOUBLE)) *
                  (CAST(s AS DOUBLE) * CAST(s AS DOUBLE) - CAST(tt AS DOUBLE))) AS den FROM a) b""")
def d09_mcc(spark, sf):
    """Multiclass Matthews correlation."""
    return M.mcc(_emb_pred(spark, sf), "pred", "label")


@register("d10_spearman", """WITH ev AS (SELECT value AS x, CAST(json_extract(props, '$.k') AS INTEGER) AS y FROM events),
rx AS (SELECT x, 2 * cum - n + 1 AS rx FROM (SELECT x, n, sum(n) OVER (ORDER BY x ROWS UNBOUNDED PRECEDING) AS cum
       FROM (SELECT x, count(*) AS n FROM ev GROUP BY x) a) b),
ry AS (SELECT y, 2 * cum - n + 1 AS ry FROM (SELECT y, n, sum(n) OVER (ORDER BY y ROWS UNBOUNDED PRECEDING) AS cum
       FROM (SELECT y, count(*) AS n FROM ev GROUP BY y) a) b),
r AS (SELECT rx, ry FROM ev JOIN rx USING (x) JOIN ry USING (y)),
a AS (SELECT count(*) AS n, sum(rx) AS sx, sum(ry) AS sy, sum(rx * ry) AS sxy, sum(rx * rx) AS sxx, sum(ry * ry) AS syy FROM r)
SELECT n, CASE WHEN den > 0 THEN num / den END AS spearman
FROM (SELECT n, CAST(n AS DOUBLE) * CAST(sxy AS DOUBLE) - CAST(sx AS DOUBLE) * CAST(sy AS DOUBLE) AS num,
             sqrt((CAST(n AS DOUBLE) * CAST(sxx AS DOUBLE) - CAST(sx AS DOUBLE) * CAST(sx AS DOUBLE)) *
                  (CAST(n AS DOUBLE) * CAST(syy AS DOUBLE) - CAST(sy AS DOUBLE) * CAST(sy AS DOUBLE))) AS den FROM a) b""")
def d10_spearman(spark, sf):
    """Spearman correlation of events.value and the k of events.props."""
    ev = D.table(spark, sf, "events").select(F.col("value").alias("x"),
                                             F.get_json_object("props", "$.k").cast("int").alias("y"))
    return M.spearman(ev, "x", "y")


# ------------------------------------------------------------------ runs from events (step = event_id)

def _runs(spark, sf):
    e = D.table(spark, sf, "events")
    return e.select(F.col("user_id").alias("run"), F.col("event_id").alias("step"), "event_type", "value",
                    F.round(F.col("value") * 100).cast("bigint").alias("cents"))


RUNS = "runs AS (SELECT user_id AS run, event_id AS step, event_type, value, CAST(round(value * 100) AS BIGINT) AS cents FROM events)"


@register("e01_top_runs", f"""WITH {RUNS}
SELECT run, rank, step, value FROM (
  SELECT run, step, value, row_number() OVER (PARTITION BY run ORDER BY value DESC, step ASC) AS rank FROM runs) t
WHERE rank <= 3""")
def e01_top_runs(spark, sf):
    """Best three checkpoints per run, ties keep the earlier step."""
    return RU.top_runs(_runs(spark, sf), "run", "step", "value", 3).select(
        "run", F.col("rank").cast("bigint"), "step", "value")


@register("e02_last_runs", f"""WITH {RUNS}
SELECT run, rank, step FROM (
  SELECT run, step, row_number() OVER (PARTITION BY run ORDER BY step DESC) AS rank FROM runs) t WHERE rank <= 2""")
def e02_last_runs(spark, sf):
    """Keep the last two checkpoints per run."""
    return RU.last_runs(_runs(spark, sf), "run", "step", 2).select("run", F.col("rank").cast("bigint"), "step")


@register("e03_best_epoch", f"""WITH {RUNS}
SELECT run, max(value) AS best_metric,
       CASE WHEN max(value) > 0.0 THEN arg_min(step, struct_pack(neg := -value, s := step)) END AS best_epoch
FROM runs GROUP BY run""")
def e03_best_epoch(spark, sf):
    """First epoch reaching the maximum (strictly greater wins)."""
    return RU.best_epoch(_runs(spark, sf), "run", "step", "value")


@register("d12_perplexity", f"""WITH {RUNS}
SELECT run, count(*) AS n_steps, CAST(sum(cents) AS DOUBLE) / (CAST(count(*) AS DOUBLE) * 100.0) AS mean_loss
FROM runs GROUP BY run""")
def d12_perplexity(spark, sf):
    """Mean loss per run (exact fixed-point sum); the perplexity, its exponential, differs in the
    last bit between math libraries and is compared in the tests instead."""
    return M.perplexity(_runs(spark, sf), "cents", ["run"]).drop("perplexity")


@register("e09_loss_windows", f"""WITH {RUNS}
SELECT run, CAST(floor((step + 1 - 1) / 100) AS BIGINT) AS window, count(*) AS n_steps,
       CAST(sum(cents) AS DOUBLE) / (CAST(count(*) AS DOUBLE) * 100.0) AS mean_loss
FROM runs GROUP BY run, CAST(floor((step + 1 - 1) / 100) AS BIGINT)""")
def e09_loss_windows(spark, sf):
    """Mean loss per window of 100 steps (step = event_id + 1)."""
    r = _runs(spark, sf).withColumn("step", F.col("step") + 1)
    return RU.loss_windows(r, "run", "step", "cents", 100)


@register("d16_seed_summary", f"""WITH {RUNS},
per_seed AS (SELECT event_type, run AS seed, max(cents) AS best_cents FROM runs GROUP BY event_type, run)
SELECT event_type, n AS n_seeds, CAST(s AS DOUBLE) / (CAST(n AS DOUBLE) * 100.0) AS mean,
       CASE WHEN n > 1 THEN sqrt((CAST(n AS DOUBLE) * CAST(ss AS DOUBLE) - CAST(s AS DOUBLE) * CAST(s AS DOUBLE))
                                / (CAST(n AS DOUBLE) * CAST(n - 1 AS DOUBLE))) / 100.0 END AS std,
       CAST(mx AS DOUBLE) / 100.0 AS best, best_seed
FROM (SELECT event_type, count(*) AS n, sum(best_cents) AS s, sum(best_cents * best_cents) AS ss, max(best_cents) AS mx,
             arg_min(seed, struct_pack(neg := -best_cents, s := seed)) AS best_seed
      FROM per_seed GROUP BY event_type) t""")
def d16_seed_summary(spark, sf):
    """Mean / sample std over seeds of each config's best score, plus the best seed.
    Moments are exact integer sums of hundredths (order independent)."""
    per_seed = _runs(spark, sf).groupBy("event_type", F.col("run").alias("seed")).agg(F.max("cents").alias("best_cents"))
    a = per_seed.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("best_cents").alias("s"),
        F.sum(F.col("best_cents") * F.col("best_cents")).alias("ss"), F.max("best_cents").alias("mx"),
        F.max_by("seed", F.struct(F.col("best_cents"), -F.col("seed"))).alias("best_seed"))
    d = lambda c: F.col(c).cast("double")
    std = F.sqrt((d("n") * d("ss") - d("s") * d("s")) / (d("n") * (F.col("n") - 1).cast("double"))) / F.lit(100.0)
    return a.select("event_type", F.col("n").alias("n_seeds"), (d("s") / (d("n") * F.lit(100.0))).alias("mean"),
                    F.when(F.col("n") > 1, std).alias("std"), (d("mx") / F.lit(100.0)).alias("best"), "best_seed")


# ------------------------------------------------------------------ spans (E06 + D11) on lineitem

SPAN_SQL = """WITH s AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag = 'A' AS is_end,
         CAST(l_partkey % 100 + 1 AS INTEGER) AS label,
         CAST(CASE WHEN l_suppkey % 3 = 0 THEN l_partkey % 100 + 2 ELSE l_partkey % 100 + 1 END AS INTEGER) AS pred
  FROM lineitem),
i AS (SELECT *, coalesce(sum(CAST(is_end AS INTEGER)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS island FROM s),
spans AS (SELECT l_orderkey, island, max(CAST(is_end AS INTEGER)) AS closed, count_if(NOT is_end) AS n_tok,
                 count_if(NOT is_end AND pred = label) AS n_match FROM i GROUP BY l_orderkey, island)
SELECT count(*) AS n_spans, count_if(n_match = n_tok) AS n_exact, sum(n_tok) AS n_tokens, sum(n_match) AS n_matched,
       CASE WHEN count(*) > 0 THEN CAST(count_if(n_match = n_tok) AS DOUBLE) / CAST(count(*) AS DOUBLE) ELSE 0.0 END AS slacc,
       CASE WHEN sum(n_tok) > 0 THEN CAST(sum(n_match) AS DOUBLE) / CAST(sum(n_tok) AS DOUBLE) ELSE 0.0 END AS tlacc
FROM spans WHERE closed = 1"""


@register("d11_span_accuracy", SPAN_SQL)
def d11_span_accuracy(spark, sf):
    """E06 + D11: per order, a (pred, label) token stream cut at delimiter rows
    (returnflag A); sentence and token accuracy over closed spans."""
    li = D.table(spark, sf, "lineitem")
    s = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.pmod("l_partkey", F.lit(100)) + 1).cast("int").alias("label"),
                  F.when(F.pmod("l_suppkey", F.lit(3)) == 0, F.pmod("l_partkey", F.lit(100)) + 2)
                  .otherwise(F.pmod("l_partkey", F.lit(100)) + 1).cast("int").alias("pred"), "l_returnflag")
    # (orderkey, linenumber) repeats in this data: partkey, suppkey make the order total
    spans = RU.segment(s, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], F.col("l_returnflag") == "A")
    out = M.span_accuracy(spans)
    return out.select("n_spans", "n_exact", F.col("n_tokens").cast("bigint"), F.col("n_matched").cast("bigint"), "slacc", "tlacc")


# ------------------------------------------------------------------ score tables

@register("e08_argmax", """SELECT vec_id AS id, CAST(p AS INTEGER) AS pos,
       CAST(list_position(embedding[p * 16 + 1: p * 16 + 16], list_max(embedding[p * 16 + 1: p * 16 + 16])) - 1 AS INTEGER) AS pred
FROM embeddings, range(4) r(p)""")
def e08_argmax(spark, sf):
    """Argmax token per (row, position); ties to the lowest id."""
    return SC.argmax(_emb_scores(spark, sf), ("id", "pos"), "token", "score", "pred")


@register("l03_decode", """SELECT vec_id AS id, array_to_string(list_transform(range(4), lambda p:
         CAST(list_position(embedding[p * 16 + 1: p * 16 + 16], list_max(embedding[p * 16 + 1: p * 16 + 16])) - 1 AS VARCHAR)), ' ') AS tokens
FROM embeddings""")
def l03_decode(spark, sf):
    """Position argmax decode into an ordered token string per row."""
    dec = SC.decode(SC.argmax(_emb_scores(spark, sf), ("id", "pos"), "token", "score", "pred"), "id", "pos", "pred")
    return dec.select("id", F.array_join(F.transform("tokens", lambda x: x.cast("string")), " ").alias("tokens"))


LABEL_WORDS = [(lab, wp, 2 * lab + wp) for lab in range(8) for wp in range(2)]  # label l -> tokens 2l, 2l+1
LW_SQL = "lw(label_id, word_pos, word_id) AS (VALUES " + ", ".join(f"({a}, {b}, {c})" for a, b, c in LABEL_WORDS) + ")"


def _label_words(spark):
    return constant_table(spark, LABEL_WORDS, "label_id int, word_pos int, word_id int")


@register("l01_label_product", f"""WITH {LW_SQL},
s AS (SELECT vec_id AS id, label_id, embedding[16 * 0 + 2 * label_id + 1] * embedding[16 * 1 + 2 * label_id + 2] AS sc
      FROM embeddings, (SELECT DISTINCT label_id FROM lw) l)
SELECT id, arg_max(label_id, struct_pack(s := sc, neg := -label_id)) AS pred_label FROM s GROUP BY id""")
def l01_label_product(spark, sf):
    """Label score = word 1 at position 0 x word 2 at position 1; argmax label."""
    s = _emb_scores(spark, sf).select("id", "pos", "token", "score")
    return SC.label_score_product(s, _label_words(spark))


@register("l02_label_sum", f"""WITH {LW_SQL},
s AS (SELECT vec_id AS id, label_id, sum(embedding[word_id + 1]) AS sc FROM embeddings, lw GROUP BY vec_id, label_id)
SELECT id, arg_max(label_id, struct_pack(s := sc, neg := -label_id)) AS pred_label FROM s GROUP BY id""")
def l02_label_sum(spark, sf):
    """Label score = sum of its words' scores at position 0; argmax label."""
    s = _emb_scores(spark, sf).select("id", "pos", "token", "score")
    return SC.label_score_sum(s, _label_words(spark), at_pos=0)


@register("l04_copy_mix", """WITH s AS (
  SELECT vec_id AS id, p AS pos, t AS token, embedding[p * 16 + t + 1] AS score,
         CAST((vec_id + p) % 16 AS INTEGER) AS src_token
  FROM embeddings, range(4) r(p), range(16) q(t)),
m AS (SELECT id, pos, token, least(greatest(0.5 * CASE WHEN token = src_token THEN 1.0 ELSE 0.0 END
                                             + 0.5 * CAST(score AS DOUBLE), 1e-10), 1.0 - 1e-7) AS mixed FROM s)
SELECT id, CAST(pos AS INTEGER) AS pos, CAST(arg_max(token, struct_pack(m := mixed, neg := -token)) AS INTEGER) AS pred
FROM m GROUP BY id, pos""")
def l04_copy_mix(spark, sf):
    """Copy-mix decode with a source token per position, clipped, argmax."""
    sc = _emb_scores(spark, sf).select("id", "pos", "token", "score")
    src = sc.select("id", "pos").distinct().withColumn("src_token", F.pmod(F.col("id") + F.col("pos"), F.lit(16)).cast("int"))
    return SC.copy_mix(sc, src, 0.5).select("id", F.col("pos").cast("int"), F.col("pred").cast("int"))


# ------------------------------------------------------------------ C03 label ids, C08 split leaks, J07

@register("c03_label_ids", """WITH lt(label, label_id) AS (VALUES ('1', 0), ('0', 1))
SELECT doc_id, CAST(quality AS VARCHAR) AS label, label_id FROM labels JOIN lt ON CAST(labels.quality AS VARCHAR) = lt.label""")
def c03_label_ids(spark, sf):
    """Label -> id by the prompt order ["1", "0"] (order is part of the table)."""
    lab = D.table(spark, sf, "labels").select("doc_id", F.col("quality").cast("string").alias("label"))
    return V.label_id_or_fail(lab, V.label_table(spark, "quality", ["1", "0"])).select("doc_id", "label", "label_id")


@register("c08_split_leaks", O.with_base("pairs", f"""
SELECT split_a, split_b, count(*) AS shared_pairs FROM (
  SELECT DISTINCT a.h, a.split AS split_a, b.split AS split_b
  FROM (SELECT DISTINCT sha256(src || chr(1) || tgt) AS h, split FROM sp) a
  JOIN (SELECT DISTINCT sha256(src || chr(1) || tgt) AS h, split FROM sp) b ON a.h = b.h AND a.split < b.split) t
GROUP BY split_a, split_b""", f"""sp AS (SELECT src, tgt, CASE WHEN {H('k', 'split')} % 10 < 8 THEN 'train'
                                   WHEN {H('k', 'split')} % 10 = 8 THEN 'dev' ELSE 'test' END AS split FROM pairs)"""))
def c08_split_leaks(spark, sf):
    """Exact pairs shared between train/dev/test (repeated lines leak across splits)."""
    p = D.pairs(spark, sf)
    r = F.pmod(rng.hash32(F.col("k"), rng.purpose("split", D.SEED)), F.lit(10))
    sp = p.withColumn("split", F.when(r < 8, "train").when(r == 8, "dev").otherwise("test"))
    return V.split_leaks(sp, "split", "src", "tgt")


@register("j07_split_dev", O.with_base("sent", f"""
SELECT lang, split, count(*) AS n FROM (
  SELECT lang, CASE WHEN CAST({H('guid', 'dev')} AS DOUBLE) / 4294967296.0 < 0.1 THEN 'dev' ELSE 'train' END AS split FROM sent) t
GROUP BY lang, split"""))
def j07_split_dev(spark, sf):
    """A fixed 10 % of train as dev by hash bucket."""
    s = MX.split_dev(D.sentences(spark, sf), "guid", 0.1, D.SEED)
    return s.groupBy("lang", "split").agg(F.count(F.lit(1)).alias("n"))

