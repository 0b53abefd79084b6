"""Sharding, shuffling, cycles, batches and task mixing.

Randomness is a hash of (row key, seed, cycle), so a shuffle is a sort on that hash:
deterministic, retry-safe and independent of partitioning. Batches need consecutive
row numbers per shard: ``plans.indexing.row_index`` computes them with range partitions
and offsets, never a single-partition window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rng
from ..plans.indexing import row_index
from ..session import bounded_broadcast


def shuffle_key(key: str | Column, seed: int = 42, cycle: int = 0) -> Column:
    """The shuffle order of a row (full shuffle by hash)."""
    k = key if isinstance(key, Column) else F.col(key)
    return rng.hash32(k, rng.purpose("shuffle", seed, cycle))


def cycles(df: DataFrame, n: int) -> DataFrame:
    """Repeat the data ``n`` times with a ``cycle`` column (cycle c uses seed
    ``seed + c * 1000003`` in the reference; here the cycle is part of every draw). Data without
    a row is an error: a cycle would give nothing."""
    if n > 0 and df.isEmpty():
        raise ValueError("cycle without output: the data is empty")
    spark = df.sparkSession
    return df.crossJoin(bounded_broadcast(spark.range(n).select(F.col("id").alias("cycle"))))


def with_shard(df: DataFrame, index_col: str, shard_count: int) -> DataFrame:
    """Shard of each row from its raw index."""
    return df.withColumn("shard", F.pmod(F.col(index_col), F.lit(shard_count)))


def with_batch(df: DataFrame, key: str, batch_size: int, seed: int = 42, shard_col: str | None = "shard",
               cycle_col: str | None = None, across: bool = False) -> DataFrame:
    """J02 + J04: shuffle by hash, then consecutive ``batch_size`` rows per shard (and
    cycle) form a batch; the last partial batch is kept. With ``across`` the numbers of a shard run on
    from cycle to cycle, as in an endless stream: a batch may hold the end of one and the start of the next."""
    cyc = F.col(cycle_col).cast("string") if cycle_col else F.lit("0")
    d = df.withColumn("_order", rng.hash32(F.concat_ws(":", F.col(key).cast("string"), cyc),
                                           rng.purpose("shuffle", seed)))
    groups = [c for c in (shard_col, None if across else cycle_col) if c]
    order = ([cycle_col] if across and cycle_col else []) + ["_order", key]
    d = row_index(d, order, groups, out_col="pos_in_shard")
    return d.withColumn("batch_id", F.floor(F.col("pos_in_shard") / F.lit(batch_size)).cast("bigint")).drop("_order")


def mix_proportional(tasks: Sequence[DataFrame], key: str, seed: int = 42) -> DataFrame:
    """J05 (F02 + J02): union of tasks, one shuffle over the union."""
    u = tasks[0]
    for t in tasks[1:]:
        u = u.unionByName(t)
    return u.withColumn("mix_order", rng.hash32(F.col(key), rng.purpose("mix", seed)))


def mix_rotate(union: DataFrame, task_col: str, key: str, batch_size: int, n_tasks: int, seed: int = 42) -> DataFrame:
    """Step k takes a batch of task ``k % T``: batches are numbered per task after a
    per-task shuffle and interleaved by ``batch * T + task_no``."""
    d = union.withColumn("_order", rng.hash32(F.col(key), rng.purpose("rotate", seed)))
    d = row_index(d, ["_order", key], [task_col], out_col="pos_in_task")
    d = d.withColumn("task_batch", F.floor(F.col("pos_in_task") / F.lit(batch_size)).cast("bigint"))
    return d.withColumn("step", F.col("task_batch") * F.lit(n_tasks) + F.col("task_no")).drop("_order")


def split_dev(df: DataFrame, key: str, fraction: float = 0.1, seed: int = 42) -> DataFrame:
    """Fixed share of train as dev by hash bucket (stable, not ``randomSplit``)."""
    u = rng.unit(F.col(key), rng.purpose("dev", seed))
    return df.withColumn("split", F.when(u < F.lit(fraction), F.lit("dev")).otherwise(F.lit("train")))


def mix_report(batched: DataFrame, window_col: str, task_col: str) -> DataFrame:
    """Share of each task per window of batches."""
    a = batched.groupBy(window_col, task_col).agg(F.count(F.lit(1)).alias("n"))
    tot = a.groupBy(window_col).agg(F.sum("n").alias("_t"))
    return a.join(tot, window_col).withColumn("share", F.col("n").cast("double") / F.col("_t").cast("double")).drop("_t")
