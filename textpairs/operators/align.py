"""Alignment of sources, labels and predictions (C05) and decode helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def align(src: DataFrame, trg: DataFrame, pred: DataFrame, key: str = "guid") -> DataFrame:
    """Equi-join on the key (full outer): nothing is silently truncated.

    ``status`` is ``ok``, ``missing_prediction``, ``missing_target`` or ``missing_source``, by
    whether the side has the key; a row whose text is null is there.
    The join shuffles the three sides by key once (co-partitioned); a skewed key is split
    by AQE's skew-join handling.
    """
    sides = [df.withColumn(flag, F.lit(True)) for df, flag in ((src, "_has_src"), (trg, "_has_trg"), (pred, "_has_pred"))]
    j = sides[0].join(sides[1], key, "full").join(sides[2], key, "full")
    status = (F.when(F.col("_has_src").isNull(), F.lit("missing_source"))
              .when(F.col("_has_trg").isNull(), F.lit("missing_target"))
              .when(F.col("_has_pred").isNull(), F.lit("missing_prediction"))
              .otherwise(F.lit("ok")))
    return j.withColumn("status", status).drop("_has_src", "_has_trg", "_has_pred")


def split_at_first(tokens: str | Column, sep: str) -> Column:
    """struct(before, after) around the first ``sep`` (after starts at it)."""
    t = _c(tokens)
    p = F.array_position(t, sep)
    n = F.size(t)
    before = F.when(p > 0, F.slice(t, 1, (p - 1).cast("int"))).otherwise(t)
    after = F.when(p > 0, F.slice(t, p.cast("int"), (n - p + 1).cast("int"))).otherwise(F.array().cast("array<string>"))
    return F.struct(before.alias("before"), after.alias("after"))


def take_at_mask(inputs: str | Column, outputs: str | Column, mask_token: str) -> Column:
    """Model output at MASK positions, the input token elsewhere."""
    return F.zip_with(_c(inputs), _c(outputs), lambda i, o: F.when(i == mask_token, o).otherwise(i))


def gather_at_mask(inputs: str | Column, outputs: str | Column, mask_token) -> Column:
    """Outputs at positions whose input is the mask token."""
    z = F.arrays_zip(_c(inputs).alias("i"), _c(outputs).alias("o"))
    return F.transform(F.filter(z, lambda x: x["i"] == mask_token), lambda x: x["o"])


def gather_offset(outputs: str | Column, n_src: str | Column, n_trg: str | Column) -> Column:
    """``outputs[n_src+2 : n_src+2+n_trg]`` (0-based), i.e. the target slots of I01."""
    return F.slice(_c(outputs), (_c(n_src) + 3).cast("int"), _c(n_trg).cast("int"))


def remove_anchor(tokens: str | Column, anchor_len: int | Column) -> Column:
    """Drop the first ``anchor_len`` items."""
    n = anchor_len if isinstance(anchor_len, Column) else F.lit(anchor_len)
    t = _c(tokens)
    return F.when(F.size(t) > n, F.slice(t, (n + 1).cast("int"), (F.size(t) - n).cast("int"))).otherwise(
        F.slice(t, 1, 0))


def target_start(labels: str | Column, ignore: int = -100) -> Column:
    """1-based position of the first label != ignore (0 when none)."""
    return F.array_position(F.transform(_c(labels), lambda x: x != ignore), True)


def split_causal(tokens: str | Column, labels: str | Column, ignore: int = -100) -> Column:
    """struct(prompt, target) split at the first non-ignored label."""
    t = _c(tokens)
    p = target_start(labels, ignore)
    return F.struct(F.when(p > 0, F.slice(t, 1, (p - 1).cast("int"))).otherwise(t).alias("prompt"),
                    F.when(p > 0, F.slice(t, p.cast("int"), (F.size(t) - p + 1).cast("int"))).otherwise(F.slice(t, 1, 0)).alias("target"))


def zero_unattended(preds: str | Column, attention: str | Column) -> Column:
    """Prediction 0 where attention is 0."""
    return F.zip_with(_c(preds), _c(attention), lambda p, a: F.when(a == 0, F.lit(0)).otherwise(p))
