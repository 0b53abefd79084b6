"""Union of unlike tasks' training features and its batches.

Tasks come with their own layouts (tagging, rephrasing, classification, prompted classification) and
so with different fields. ``unite`` gives them one schema: fields are matched by name, what a
task lacks is filled by a rule, and every array must have the common length. The batch order is
numbered over keys alone; the arrays are shuffled once, by the join that brings them to their batch.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rng
from ..plans.indexing import row_index


@dataclass(frozen=True)
class Task:
    """One task's features: rows with a key and the layout's fields as columns. ``names`` maps a
    common field to the task's own column; ``fills`` overrides the fill of a missing field."""
    task_id: int
    rows: DataFrame
    key: str
    names: Mapping[str, str] = field(default_factory=dict)
    fills: Mapping[str, int | str] = field(default_factory=dict)


def _sized(arr: Column, length: int, task_id: int, name: str) -> Column:
    """The array, or an error when its length is not the common one."""
    wrong = F.concat(F.lit(f"task {task_id}: {name} has "), F.size(arr).cast("string"), F.lit(f" places, not {length}"))
    return F.when(F.size(arr) == length, arr.cast("array<int>")).otherwise(
        F.raise_error(F.coalesce(wrong, F.lit(f"task {task_id}: {name} is null"))).cast("array<int>"))


def unite(tasks: Sequence[Task], fields: Mapping[str, int | str], length: int) -> DataFrame:
    """(task_id, key, fields) of all tasks. ``fields`` gives each common field's fill: a number for
    every place, or the name of another field whose array is taken instead. An array of another length
    is an error, never cut or padded in silence."""
    if len({t.task_id for t in tasks}) != len(tasks):
        raise ValueError("task ids must differ")
    out = None
    for t in tasks:
        def column(name: str, seen: tuple[str, ...] = ()) -> Column:
            own = t.names.get(name, name)
            if own in t.rows.columns:
                return _sized(F.col(own), length, t.task_id, name)
            fill = t.fills.get(name, fields[name])
            if not isinstance(fill, str):
                return F.array_repeat(F.lit(fill), length)
            if fill in seen or fill not in fields:
                raise ValueError(f"task {t.task_id}: no array to fill {name} with")
            return column(fill, (*seen, name))

        rows = t.rows.select(F.lit(t.task_id).alias("task_id"), F.col(t.key).cast("string").alias("key"),
                             *[column(n).alias(n) for n in fields])
        out = rows if out is None else out.unionByName(rows)
    return out


def mixed_batches(features: DataFrame, batch_size: int, seed: int = 42, cycle: int = 0) -> DataFrame:
    """One shuffle over the union; ``batch_id`` and ``place`` of every row, its arrays with it.
    Only (task_id, key) is sorted and numbered."""
    order = rng.hash32(F.concat_ws(":", F.col("task_id").cast("string"), "key"), rng.purpose("mix", seed, cycle))
    keys = row_index(features.select("task_id", "key", order.alias("mix_order")), ["mix_order", "task_id", "key"], out_col="pos")
    placed = keys.select("task_id", "key", F.floor(F.col("pos") / batch_size).cast("bigint").alias("batch_id"),
                         F.pmod("pos", F.lit(batch_size)).cast("int").alias("place"))
    return features.join(placed, ["task_id", "key"])


def write_batches(batched: DataFrame, folder: str, batches_per_file: int = 64) -> None:
    """Batches as Parquet, whole batches in order within a file."""
    n = int(batched.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (batched.withColumn("chunk", F.floor(F.col("batch_id") / batches_per_file))
     .repartitionByRange(n, "chunk").sortWithinPartitions("chunk", "batch_id", "place").drop("chunk")
     .write.mode("overwrite").parquet(folder))
