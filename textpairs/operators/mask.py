"""Masking (H03-H10) over fixed-length id arrays.

Each position's draw is ``unit(key:position, purpose)`` so the mask depends only on
(seed, cycle, row, position): the same row gets the same mask on any partitioning and on
retry. Everything is one projection (``transform``/``zip_with``), no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rng


def _c(x: str | Column) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def mask_candidates(source_mask: str | Column, equal_flags: str | Column, mode: str = "noerror") -> Column:
    """Candidate positions. ``noerror``: source positions where src == ref;
    ``error``: where they differ; ``all``: every source position. Specials never."""
    sm, eq = _c(source_mask), _c(equal_flags)
    if mode == "noerror":
        return F.zip_with(sm, eq, lambda a, b: a & b)
    if mode == "error":
        return F.zip_with(sm, eq, lambda a, b: a & ~b)
    if mode == "all":
        return sm
    raise ValueError(f"unsupported mask mode: {mode}")


def draw(key: str | Column, candidates: str | Column, rate: float, seed: int = 42, cycle: int = 0,
         name: str = "mask") -> Column:
    """Bernoulli selection of candidate positions: ``unit(key:i) < rate``."""
    k = _c(key)
    p = rng.purpose(name, seed, cycle)
    return F.transform(_c(candidates), lambda c, i: c & (
        rng.unit(F.concat(k.cast("string"), F.lit(":"), i.cast("string")), p) < F.lit(rate)))


def apply_mask(df: DataFrame, key: str, candidates: str | Column, rate: float, mask_id: int,
               ids: str = "input_ids", labels: str | None = "labels", targets: str | None = "mft_targets",
               seed: int = 42, cycle: int = 0, also: Sequence[str] = (), when: Column | None = None,
               out_selected: str = "selected") -> DataFrame:
    """Mask selected positions and restore their label.

    Selected positions become ``mask_id`` in ``ids`` (and in every column of ``also``: the
    joint mask H07); the label there becomes the **target** id from ``targets``. ``when``
    gates the whole row (task-gated mask H08).
    """
    sel = draw(key, candidates, rate, seed, cycle)
    if when is not None:
        sel = F.when(when, sel).otherwise(F.transform(_c(candidates), lambda c: F.lit(False)))
    d = df.withColumn(out_selected, sel)
    for col in [ids, *also]:
        d = d.withColumn(col, F.zip_with(col, out_selected, lambda x, s: F.when(s, F.lit(mask_id)).otherwise(x)))
    if labels is not None and targets is not None:
        d = d.withColumn(labels, F.zip_with(F.arrays_zip(F.col(labels).alias("l"), F.col(targets).alias("t")),
                                            out_selected, lambda lt, s: F.when(s, lt["t"]).otherwise(lt["l"])))
    return d


def any_position_mask(df: DataFrame, key: str, special_flags: str, rate: float, mask_id: int,
                      ids: str = "input_ids", seed: int = 42, cycle: int = 0) -> DataFrame:
    """Any non-special position (no equality condition)."""
    cand = F.transform(special_flags, lambda s: ~s)
    return apply_mask(df, key, cand, rate, mask_id, ids, None, None, seed, cycle)


def reference_candidates(ids: str | Column, ref: str | Column, special_flags: str | Column) -> Column:
    """Positions where ``ids == ref`` (ref = -100 outside the source), not special."""
    return F.zip_with(F.arrays_zip(_c(ids).alias("x"), _c(ref).alias("r")), _c(special_flags),
                      lambda xr, s: (xr["x"] == xr["r"]) & ~s)


def mask_report(df: DataFrame, candidates: str, selected: str, by: Sequence[str] = ()) -> DataFrame:
    """Realised mask rate = selected / candidates."""
    a = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.size(F.filter(candidates, lambda x: x))).alias("n_candidates"),
        F.sum(F.size(F.filter(selected, lambda x: x))).alias("n_masked"))
    return a.withColumn("mask_rate", F.when(F.col("n_candidates") > 0,
                                            F.col("n_masked").cast("double") / F.col("n_candidates").cast("double"))
                        .otherwise(F.lit(0.0)))
