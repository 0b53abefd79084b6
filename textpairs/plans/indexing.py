"""Exact row numbers in a total order without a single-partition window.

``row_index`` range-partitions on (group, order) so that even a group holding a third of
all rows is spread over many tasks, sorts inside partitions, tags rows with
``monotonically_increasing_id`` (consecutive inside a partition) and reliably checkpoints
that frame so the ids are stable. A small table of per-(partition, group) counts is turned
into offsets (a window over that small table only) and joined back with a broadcast: without
groups it has one row per partition; with groups its rows are counted first, and beyond the bound
the join is a shuffled one.

``line_index`` does the same for text files: the splits of a file are numbered by
``(_metadata.file_path, file_block_start)`` and lines inside a split keep file order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_root, counted_broadcast


def _cols(xs: Sequence[str | Column]) -> list[Column]:
    return [x if isinstance(x, Column) else F.col(x) for x in xs]


def _offsets(offsets: DataFrame, grouped: bool) -> DataFrame:
    """The offsets for the join back. The optimizer's estimate of an aggregate follows its input, so it
    would never be taken for small: one row per partition needs no check, others are counted."""
    return counted_broadcast(offsets) if grouped else F.broadcast(offsets)


def row_index(df: DataFrame, order_cols: Sequence[str | Column], group_cols: Sequence[str] = (),
              out_col: str = "idx", num_partitions: int | None = None) -> DataFrame:
    """0-based index of each row in ``order_cols`` order (per group when ``group_cols``).

    ``order_cols`` must make the order total (ties would make the index arbitrary).
    """
    spark = df.sparkSession
    checkpoint_root(spark)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = _cols(list(group_cols)) + _cols(order_cols)
    tagged = (df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_mid", F.monotonically_increasing_id())
              .checkpoint(eager=True))
    g = list(group_cols)
    counts = tagged.groupBy("_pid", *g).agg(F.count(F.lit(1)).alias("_cnt"), F.min("_mid").alias("_first"))
    w = Window.partitionBy(*g).orderBy("_pid") if g else Window.orderBy("_pid")
    offsets = counts.withColumn("_off", F.sum("_cnt").over(w) - F.col("_cnt")).drop("_cnt")
    out = tagged.join(_offsets(offsets, bool(g)), ["_pid", *g])
    return out.withColumn(out_col, F.col("_off") + F.col("_mid") - F.col("_first")).drop(
        "_pid", "_mid", "_off", "_first")


def line_index(lines: DataFrame, out_col: str = "line_idx") -> DataFrame:
    """Global 0-based line index over text files sorted by path, in file order.

    ``lines`` must come from ``spark.read.text`` (it carries ``_metadata``). The index counts
    every physical line, blank ones included, and runs across files.
    """
    t = (lines.withColumn("_file", F.col("_metadata.file_path"))
         .withColumn("_block", F.col("_metadata.file_block_start"))
         .withColumn("_mid", F.monotonically_increasing_id()))
    blocks = t.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_cnt"), F.min("_mid").alias("_first"))
    w = Window.orderBy("_file", "_block")  # one row per file split: small
    offsets = blocks.withColumn("_off", F.sum("_cnt").over(w) - F.col("_cnt")).drop("_cnt")
    out = t.join(_offsets(offsets, True), ["_file", "_block"])
    return out.withColumn(out_col, F.col("_off") + F.col("_mid") - F.col("_first")).withColumnRenamed(
        "_file", "file_path").drop("_block", "_mid", "_off", "_first")


def prefix_sum(df: DataFrame, order_cols: Sequence[str | Column], value: str | Column, out_col: str,
               group_cols: Sequence[str] = (), exclusive: bool = False,
               num_partitions: int | None = None) -> DataFrame:
    """Running sum of ``value`` in ``order_cols`` order (per group), skew-proof.

    Rows are range-partitioned on (group, order) into buckets, so one group holding a third
    of all rows is still cut across many tasks. Inside a bucket a window partitioned by
    (bucket, group) gives the local running sum; the per-(bucket, group) totals form a small
    table whose exclusive running sum (per group, in bucket order) is the offset of each
    bucket, joined back with a size-checked broadcast. ``exclusive`` excludes the row itself.
    """
    spark = df.sparkSession
    checkpoint_root(spark)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    g = list(group_cols)
    keys = _cols(g) + _cols(order_cols)
    v = value if isinstance(value, Column) else F.col(value)
    b = (df.withColumn("_ps_v", v).repartitionByRange(n, *keys)
         .withColumn("_ps_b", F.spark_partition_id()).checkpoint(eager=True))
    w_local = Window.partitionBy("_ps_b", *g).orderBy(*_cols(order_cols)).rowsBetween(Window.unboundedPreceding, 0)
    local = b.withColumn("_ps_local", F.sum("_ps_v").over(w_local))
    totals = b.groupBy("_ps_b", *g).agg(F.sum("_ps_v").alias("_ps_tot"))
    w_off = Window.partitionBy(*g).orderBy("_ps_b") if g else Window.orderBy("_ps_b")
    offsets = totals.withColumn("_ps_off", F.sum("_ps_tot").over(w_off) - F.col("_ps_tot")).drop("_ps_tot")
    out = local.join(_offsets(offsets, bool(g)), ["_ps_b", *g])
    total = F.col("_ps_off") + F.col("_ps_local")
    if exclusive:
        total = total - F.col("_ps_v")
    return out.withColumn(out_col, total).drop("_ps_b", "_ps_v", "_ps_local", "_ps_off")
