"""Operator 12, Merkle manifest of a dataset: concatenated-level strings.

Rows become leaf digests, each group's leaves are numbered in order, and aligned blocks of
``BLOCK`` = 16 x 16 consecutive nodes keep a level as one hex string. A parent is the digest of a
fixed-width substring (16 digests of 64 hex digits), a level's parents are again one string, and
what stands left and right of a node's own 64 digits in its run's substring are its sibling segments.
A block's last digest is a node of the next tower of blocks; towers are built until each group has
one block, and the groups' roots form one more set of towers. Going down again, every block
hands its entries the segments of their own two levels and those of all levels above.

All of it is built-in SQL functions. The numbering is range-partitioned on (group, order), so a group
that holds a third of all rows is spread over the cluster; a block holds at most ``BLOCK`` entries and a
tower has 1/256 of the rows of the one below; the number of jobs follows the number of towers,
log256 of the rows. Only one digest, the root, reaches the driver.

Edge cases: a null column is ``-`` in its leaf; a null group is a group of its own, before all others; a
null key comes first in its group; rows of equal key are ordered by their leaf; repeated rows are leaves
of their own; a lone leaf is its group's root; an empty table has no root and gives no rows; columns
beside the named ones are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.indexing import row_index
from .common import cut, let, table

FAN, DIGEST = 16, 64
BLOCK, WIDE = FAN * FAN, FAN * DIGEST
GROUP = ["has_group", "group_key"]
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts, concatenated."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` if null, else byte count, ``:`` and the value as text."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(
        F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    """Leaf digest of a row."""
    return digest(*map(field, values))


def parents(level: Column) -> Column:
    """The next level's string: digests of the runs of 16 nodes (the last run may be shorter)."""
    runs = F.sequence(F.lit(0), F.floor((F.length(level) - 1) / WIDE).cast("int"))
    return F.array_join(F.transform(runs, lambda r: F.sha2(F.substring(level, r * WIDE + 1, F.lit(WIDE)), 256)), "")


def _flanks(run: Column, p: Column) -> Column:
    """What stands before and behind node ``p`` of a run's string."""
    return F.struct(F.substring(run, F.lit(1), p * DIGEST).alias("before"),
                    F.substring(run, p * DIGEST + DIGEST + 1, F.lit(WIDE)).alias("after"))


def _blocks(nodes: DataFrame, extra: list[str]) -> DataFrame:
    """One row per aligned block of (group, i, h): its entries in order, its level strings and its last
    digest. A group's only block stops at a single node; every other block goes up two levels."""
    keyed = nodes.select(*GROUP, F.floor(F.col("i") / BLOCK).alias("block"),
                         F.struct(F.pmod("i", F.lit(BLOCK)).alias("i"), "h", *extra).alias("e"))
    made = cut(keyed.groupBy(*GROUP, "block").agg(F.sort_array(F.collect_list("e")).alias("entries"))
               .withColumn("l0", F.array_join(F.col("entries.h"), "")), "blocks")
    # a group's first block is its only one unless there is a second: one row a group on both sides
    second = made.where("block = 1").select(*GROUP, F.lit(False).alias("only"))
    first = made.where("block = 0").join(second, GROUP, "left").withColumn("only", F.coalesce("only", F.lit(True)))
    every = first.unionByName(made.where("block > 0").withColumn("only", F.lit(False)))
    n = F.size("entries")
    every = (every.withColumn("l1", F.when(~F.col("only") | (n > 1), parents(F.col("l0"))))
             .withColumn("l2", F.when(~F.col("only") | (n > FAN), parents(F.col("l1")))))
    return cut(every.withColumn("top", F.coalesce("l2", "l1", "l0")), "levels")


def _entries(blocks: DataFrame, above: DataFrame, extra: list[str]) -> DataFrame:
    """(group, i, h, extra, subroot, segments): entries of all blocks; ``above`` has each block's
    segments from its top digest up."""
    def one(e: Column, r: Column, p: Column, run: Column) -> Column:
        own = F.when(F.col("l1").isNull(), F.array().cast("array<struct<before:string,after:string>>")).when(
            F.col("l2").isNull(), F.array(_flanks(run, p))).otherwise(F.array(_flanks(run, p), _flanks(F.col("l1"), r)))
        return F.struct(e["i"].alias("i"), e["h"].alias("h"), *[e[x].alias(x) for x in extra], own.alias("own"))

    runs = F.sequence(F.lit(0), F.floor((F.size("entries") - 1) / FAN).cast("int"))
    rows = F.flatten(F.transform(runs, lambda r: let(
        F.substring(F.col("l0"), r * WIDE + 1, F.lit(WIDE)),
        lambda run: F.transform(F.slice(F.col("entries"), r * FAN + 1, F.lit(FAN)), lambda e, p: one(e, r, p, run)))))
    joined = blocks.join(above, [*GROUP, "block"])
    return (joined.select(*GROUP, "block", "subroot", F.col("segments").alias("upper"), F.explode(rows).alias("e"))
            .select(*GROUP, (F.col("block") * BLOCK + F.col("e.i")).alias("i"), "e.h", *[F.col(f"e.{x}") for x in extra],
                    "subroot", F.concat("e.own", "upper").alias("segments")))


@dataclass
class Towers:
    """Blocks of all towers, lowest first, and each group's root (group, subroot)."""
    blocks: list[DataFrame]
    roots: DataFrame
    extra: list[str]

    def entries(self, above: DataFrame) -> DataFrame:
        """Entries of the lowest tower with all their segments; ``above`` (group, segments) has what
        lies above each group's root."""
        found = None
        for level in range(len(self.blocks) - 1, -1, -1):
            b = self.blocks[level]
            up = (b.where("only").select(*GROUP, "block", F.col("top").alias("subroot")).join(above, GROUP)
                  .select(*GROUP, "block", "subroot", "segments"))
            if found is not None:
                up = up.unionByName(found.select(*GROUP, F.col("i").alias("block"), "subroot", "segments"))
            found = _entries(b, up, self.extra if level == 0 else [])
            if level:
                found = cut(found.drop("h"), "segments")
        return found


def towers(nodes: DataFrame, extra: list[str] = []) -> Towers:
    """Towers over nodes (group, i, h, extra): i numbers each group's nodes from 0."""
    blocks, carried = [], list(extra)
    while True:
        b = _blocks(nodes, carried)
        blocks.append(b)
        nodes, carried = b.where("not only").select(*GROUP, F.col("block").alias("i"), F.col("top").alias("h")), []
        if nodes.isEmpty():
            break
    roots = None
    for b in blocks:
        top = b.where("only").select(*GROUP, F.col("top").alias("subroot"))
        roots = top if roots is None else roots.unionByName(top)
    return Towers(blocks, roots, list(extra))


def proofs(rows: DataFrame, extra: list[str] = []) -> tuple[DataFrame, str | None]:
    """From rows (grp, key, h, extra): (grp, key, h, extra, subroot, segments) and the root. ``segments``
    are the siblings before and after the node's place, level by level up to the root."""
    kept = ["key", *extra]
    keyed = rows.select(F.col("grp").isNotNull().alias(GROUP[0]), F.coalesce("grp", F.lit("")).alias(GROUP[1]), "h", *kept)
    # written first: the range partitioning reads its input twice, and texts should be hashed once
    numbered = row_index(cut(keyed, "leaves"), ["key", "h"], GROUP, out_col="i")
    low = towers(numbered, kept)
    # the groups' roots in the groups' order are the nodes of one more tree
    high = row_index(low.roots.withColumnRenamed("subroot", "h"), GROUP, out_col="i").select(
        F.lit(False).alias(GROUP[0]), F.lit("").alias(GROUP[1]), "i", "h", F.struct(*GROUP).alias("of"))
    tree = towers(high, ["of"])
    last = tree.roots.first()  # one digest
    none = tree.roots.select(*GROUP, F.array().cast("array<struct<before:string,after:string>>").alias("segments"))
    above = cut(tree.entries(none).select("of.*", "segments"), "above")
    out = low.entries(above).select(F.when(F.col(GROUP[0]), F.col(GROUP[1])).alias("grp"), *kept, "h", "subroot", "segments")
    return out, last["subroot"] if last else None


def fold(node: Column, segments: Column) -> Column:
    """The root recomputed from a leaf and its sibling segments."""
    return F.aggregate(segments, node, lambda h, s: digest(s["before"], h, s["after"]))


def proof_digest(segments: Column) -> Column:
    """Digest of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(segments, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def op12_manifest(spark, sf_dir) -> DataFrame:
    """Leaf, roots and proof of every document, and whether its row, lower-cased for one id in five,
    still leads to the root."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    whole = [F.col(c) for c in COLUMNS]
    rows = docs.select(F.col("source").alias("grp"), F.col("doc_id").alias("key"), leaf(*whole).alias("h"),
                       F.when(touched, leaf(*whole[:-1], lowered)).alias("changed"))
    found, root = proofs(rows, ["changed"])
    return (found.select(F.col("key").alias("doc_id"), F.col("h").alias("leaf"), "subroot", F.lit(root).cast("string").alias("root"),
                         proof_digest(F.col("segments")).alias("proof_sha256"),
                         fold(F.coalesce("changed", "h"), F.col("segments")).alias("folded_root"))
            .withColumn("verified", F.col("folded_root") == F.col("root")))


_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''),
    lambda c: ascii(c)::BIGINT)), lambda v, c: list_reduce(list_prepend(xor(v, c), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
    lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""
_LEAF = "sha256(" + " || ".join(
    f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in [*COLUMNS[:-1], "{text}"]) + ")"
_TREE = """{name} AS (
  SELECT {key} AS grp, 0 AS lvl, i, {h} AS h, count(*) OVER (PARTITION BY {key}) AS n FROM {rows}
  UNION ALL
  SELECT grp, lvl + 1, i // 16, sha256(string_agg(h, '' ORDER BY i)), (max(n) + 15) // 16
  FROM {name} WHERE n > 1 GROUP BY grp, lvl, i // 16)"""
_PATH = """SELECT l.{id} AS id, r.lvl + {add} AS lvl, {{'b': substr(r.s, 1, 64 * ((l.i >> (4 * r.lvl)) & 15)),
         'a': substr(r.s, 64 * ((l.i >> (4 * r.lvl)) & 15) + 65)}} AS s
  FROM {rows} l JOIN (SELECT grp, lvl, i // 16 AS run, string_agg(h, '' ORDER BY i) AS s FROM {tree} WHERE n > 1 GROUP BY ALL) r
    ON r.grp IS NOT DISTINCT FROM {key} AND r.run = l.i >> (4 * r.lvl + 4)"""
ORACLE_SQL = f"""WITH RECURSIVE
hashed AS (SELECT doc_id, source, {_LEAF.format(text="text")} AS leaf, CASE WHEN {_CRC} % 5 = 0 THEN
    {_LEAF.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS changed FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
    row_number() OVER () AS at FROM hashed),
{_TREE.format(name="low", key="source", h="leaf", rows="leaves")},
subroots AS (SELECT grp AS source, h AS subroot, row_number() OVER (ORDER BY grp NULLS FIRST) - 1 AS i FROM low WHERE n = 1),
{_TREE.format(name="high", key="1", h="subroot", rows="subroots")},
own AS ({_PATH.format(id="at", add=0, rows="leaves", tree="low", key="l.source")}),
above AS ({_PATH.format(id="source", add=100, rows="subroots", tree="high", key="1")}),
segments AS (SELECT id, list(s ORDER BY lvl) AS s FROM (
    SELECT * FROM own UNION ALL SELECT l.at, a.lvl, a.s FROM leaves l JOIN above a ON a.id IS NOT DISTINCT FROM l.source) GROUP BY id),
folded AS (SELECT doc_id, leaf, subroot, (SELECT h FROM high WHERE n = 1) AS root,
    sha256(array_to_string(list_transform(coalesce(s, []), lambda x: x.b || x.a), '')) AS proof_sha256,
    list_reduce(list_prepend({{'b': coalesce(changed, leaf), 'a': ''}}, coalesce(s, [])),
      lambda h, x: {{'b': sha256(x.b || h.b || x.a), 'a': ''}}).b AS folded_root
  FROM leaves l JOIN subroots r ON r.source IS NOT DISTINCT FROM l.source LEFT JOIN segments g ON g.id = l.at)
SELECT *, folded_root = root AS verified FROM folded"""
