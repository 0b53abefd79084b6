"""Connected components by alternating large and small stars, as joins over an edge table.

Each half round is written to the shared checkpoint folder, so lineage stays short. A hub keeps
one row per neighbour, never a list of them; the per-node minimum is a map-side combined
aggregate that is written before it is joined, so AQE may split a hub's join partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _minimum(e: DataFrame) -> DataFrame:
    return cut(e.groupBy("u").agg(F.min("v").alias("m")), "cc-min")


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return (both.join(_minimum(both), "u").where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u != v").distinct())


def _small_star(e: DataFrame) -> DataFrame:
    """Edges point from the larger node u to the smaller v."""
    m = _minimum(e)
    moved = e.join(m, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(m.withColumnRenamed("m", "v")).distinct()


def _mark(e: DataFrame) -> tuple:
    r = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def connected_components(edges: DataFrame, a: str = "u", b: str = "v") -> DataFrame:
    """(node, root) for every node that has an edge; root is the smallest node reachable.
    Self edges and repeated edges are harmless; nulls are dropped; no edges give no rows."""
    u, v = F.col(a), F.col(b)
    e = cut(edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"))
            .where(u.isNotNull() & v.isNotNull() & (u != v)).distinct(), "cc-edges")
    mark = _mark(e)
    while mark[0]:
        e = cut(_small_star(cut(_large_star(e), "cc-large")), "cc-small")
        new = _mark(e)
        if new == mark:
            break
        mark = new
    # every tree is a star now: u hangs from its root v
    return (e.select(F.col("u").alias("node"), F.col("v").alias("root"))
            .unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()))
