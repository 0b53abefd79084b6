"""Operators over a model score table ``(id, pos, token, score)``.

The table is long and partitioned by row id; every operator is a group-by on
``(id, pos)`` (partial aggregation per task), joins only with small label tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bounded_broadcast


def argmax(scores: DataFrame, keys=("id", "pos"), token: str = "token", score: str = "score",
           out: str = "pred") -> DataFrame:
    """Highest score per key; ties go to the lowest token id."""
    best = F.max_by(F.col(token), F.struct(F.col(score), -F.col(token)))
    return scores.groupBy(*keys).agg(best.alias(out))


def decode(preds: DataFrame, key: str = "id", pos: str = "pos", token: str = "pred",
           attention: DataFrame | None = None) -> DataFrame:
    """Ordered token list per row (+ G20: 0 where attention is 0)."""
    if attention is not None:
        preds = preds.join(attention, [key, pos], "left").withColumn(
            token, F.when(F.col("attention") == 0, F.lit(0)).otherwise(F.col(token)))
    arr = F.sort_array(F.collect_list(F.struct(F.col(pos), F.col(token))))
    return preds.groupBy(key).agg(F.transform(arr, lambda x: x[token]).alias("tokens"))


def label_score_product(scores: DataFrame, label_words: DataFrame, key: str = "id") -> DataFrame:
    """score(label) = score(word 1 at pos 0) x score(word 2 at pos 1); argmax label.

    ``label_words``: (label_id, word_pos, word_id) with word_pos 0 and 1.
    """
    lw = bounded_broadcast(label_words)
    j = scores.join(lw, (scores["pos"] == lw["word_pos"]) & (scores["token"] == lw["word_id"]))
    per_label = j.groupBy(key, "label_id").agg(
        F.max(F.when(F.col("word_pos") == 0, F.col("score"))).alias("_s0"),
        F.max(F.when(F.col("word_pos") == 1, F.col("score"))).alias("_s1"))
    per_label = per_label.withColumn("label_score", F.col("_s0") * F.col("_s1"))
    return per_label.groupBy(key).agg(F.max_by("label_id", F.struct(F.col("label_score"), -F.col("label_id"))).alias("pred_label"))


def label_score_sum(scores: DataFrame, label_words: DataFrame, key: str = "id", at_pos: int = 0) -> DataFrame:
    """score(label) = sum of its words' scores at one position; argmax label."""
    lw = bounded_broadcast(label_words.select("label_id", "word_id").distinct())
    s = scores.where(F.col("pos") == at_pos)
    j = s.join(lw, s["token"] == lw["word_id"])
    per_label = j.groupBy(key, "label_id").agg(F.sum("score").alias("label_score"))
    return per_label.groupBy(key).agg(F.max_by("label_id", F.struct(F.col("label_score"), -F.col("label_id"))).alias("pred_label"))


def copy_mix(scores: DataFrame, source_tokens: DataFrame, c: float = 0.5, key: str = "id") -> DataFrame:
    """``c * 1[token = src] + (1 - c) * p`` clipped to [1e-10, 1 - 1e-7]; argmax.

    ``source_tokens``: (id, pos, src_token).
    """
    j = scores.join(source_tokens, [key, "pos"], "left")
    mixed = (F.lit(c) * F.when(F.col("token") == F.col("src_token"), F.lit(1.0)).otherwise(F.lit(0.0))
             + F.lit(1.0 - c) * F.col("score").cast("double"))
    j = j.withColumn("mixed", F.least(F.greatest(mixed, F.lit(1e-10)), F.lit(1.0 - 1e-7)))
    return argmax(j, (key, "pos"), "token", "mixed", "pred")
