"""Run selection and ordered operators.

All windows are partitioned by a run / stream key; none is a global single-partition
window. Top-k uses ``row_number`` per partition (Spark plans a per-partition top-k limit).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_runs(runs: DataFrame, run: str, step: str, metric: str, k: int = 3) -> DataFrame:
    """Best ``k`` checkpoints per run by metric (desc), ties keep the earlier step."""
    w = Window.partitionBy(run).orderBy(F.col(metric).desc(), F.col(step).asc())
    return runs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def last_runs(runs: DataFrame, run: str, step: str, n: int) -> DataFrame:
    """Keep the last ``n`` checkpoints per run by step number."""
    w = Window.partitionBy(run).orderBy(F.col(step).desc())
    return runs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def best_epoch(runs: DataFrame, run: str, epoch: str, metric: str, start: float = 0.0) -> DataFrame:
    """Strictly greater wins (first maximum); nothing above ``start`` -> NULL epoch."""
    best = F.max_by(F.col(epoch), F.struct(F.col(metric), -F.col(epoch)))
    a = runs.groupBy(run).agg(F.max(metric).alias("best_metric"), best.alias("_e"))
    return a.withColumn("best_epoch", F.when(F.col("best_metric") > start, F.col("_e"))).drop("_e")


def select_config(runs: DataFrame, domain: str, config: Sequence[str], split: str, metric: str) -> DataFrame:
    """Per domain pick the config by the **dev** score only and report its test score
    once; the leaky choice (best on test) is reported side by side."""
    cfg = F.struct(*[F.col(c) for c in config])
    # mean as sum / count: exact and order independent when the metric is integral
    mean = lambda: (F.sum(metric).cast("double") / F.count(F.lit(1)).cast("double"))
    dev = runs.where(F.col(split) == "dev").groupBy(domain, *config).agg(mean().alias("dev_score"))
    test = runs.where(F.col(split) == "test").groupBy(domain, *config).agg(mean().alias("test_score"))
    j = dev.join(test, [domain, *config], "full")
    pick = lambda score: F.max_by(cfg, F.struct(F.col(score), *[F.col(c) for c in config]))
    a = j.groupBy(domain).agg(pick("dev_score").alias("by_dev"), pick("test_score").alias("by_test"))
    key = lambda name: [F.col(f"{name}.{c}").alias(c) for c in config]
    dev_pick = a.select(domain, *key("by_dev")).join(j, [domain, *config], "left").select(
        domain, *[F.col(c).alias(f"dev_{c}") for c in config], F.col("dev_score"), F.col("test_score").alias("reported_test"))
    test_pick = a.select(domain, *key("by_test")).join(j, [domain, *config], "left").select(
        domain, *[F.col(c).alias(f"leaky_{c}") for c in config], F.col("test_score").alias("leaky_test"))
    return dev_pick.join(test_pick, domain)


def segment(stream: DataFrame, key: Sequence[str], order: Sequence[str], is_end: Column) -> DataFrame:
    """Gaps and islands. Each row's island is the number of delimiters before it in
    its stream; the delimiter row closes its island and is excluded; islands without a
    delimiter (the tail) are discarded. Returns one row per closed span. The running count
    uses ``plans.indexing.prefix_sum`` (no window over a whole stream key)."""
    from ..plans.indexing import prefix_sum
    d = stream.withColumn("_end", is_end)
    # exclusive running count of delimiters; range-partitioned so a hot stream key is split
    d = prefix_sum(d, order, F.col("_end").cast("int"), "_island", group_cols=key, exclusive=True)
    spans = d.groupBy(*key, "_island").agg(
        F.max(F.col("_end").cast("int")).alias("_closed"),
        F.count_if(~F.col("_end")).alias("n_tok"),
        F.count_if(~F.col("_end") & (F.col("pred") == F.col("label"))).alias("n_match"))
    return spans.where(F.col("_closed") == 1).withColumnRenamed("_island", "span_no").drop("_closed")


def head_by(df: DataFrame, key: Sequence[str], order: Sequence[str | Column], n: int) -> DataFrame:
    """First ``n`` rows per key in order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


def loss_windows(steps: DataFrame, run: str, step: str, loss_cents: str, n: int = 100) -> DataFrame:
    """Mean loss per window of ``n`` steps (steps 1..n, n+1..2n, ...), summed exactly."""
    win = F.floor((F.col(step) - 1) / F.lit(n)).cast("bigint")
    a = steps.groupBy(run, win.alias("window")).agg(F.count(F.lit(1)).alias("n_steps"),
                                                   F.sum(loss_cents).alias("_cents"))
    return a.withColumn("mean_loss", F.col("_cents").cast("double") / (F.col("n_steps").cast("double") * F.lit(100.0))).drop("_cents")
