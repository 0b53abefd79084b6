"""Queries over written files: inventory, digests, one JSON array, the evaluation sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.indexing import row_index
from ..session import scratch_path
from ..sources import derived as D
from ..sources import ranges as R
from ..sources import readers as RD
from ..sources import sinks as S
from . import oracle as O
from .queries import punct_eq_sql, register

SHARD = 500
ARRAYS = 4


def write_sentence_shards(spark, sf, folder: str) -> None:
    """The sentences as ``shard=N`` text files of ``SHARD`` lines in corpus order, one file a shard."""
    s = D.sentences(spark, sf).select("doc_id", "sent_no", "line")
    s = row_index(s, ["doc_id", "sent_no"], out_col="idx").withColumn("shard", F.floor(F.col("idx") / SHARD))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (s.repartitionByRange(n, "shard").sortWithinPartitions("shard", "idx").select("shard", F.col("line").alias("value"))
     .write.mode("overwrite").partitionBy("shard").text(folder))


_SHARD_CTE = f"""
placed AS (SELECT line, row_number() OVER (ORDER BY doc_id, sent_no) - 1 AS idx FROM sent),
shards AS (SELECT idx // {SHARD} AS shard, idx % {SHARD} AS i, line FROM placed)"""


def _shard(path: str):
    return F.regexp_extract(path, r"shard=(\d+)", 1).cast("bigint").alias("shard")


@register("a12_text_inventory", O.with_base("sent", """
SELECT shard, CAST(sum(strlen(line) + 1) AS BIGINT) AS n_bytes, count(*) AS n_lines,
       count_if(trim(translate(line, chr(9) || chr(13) || chr(11) || chr(12), '    ')) <> '') AS n_rows
FROM shards GROUP BY shard""", _SHARD_CTE))
def a12_text_inventory(spark, sf):
    """Bytes, lines and rows that are not blank of every text file below a folder, found recursively; no
    match and sample files are errors before the scan."""
    folder = scratch_path(spark, "shards")
    write_sentence_shards(spark, sf, folder)
    return R.text_inventory(spark, folder, "*.txt").select(_shard("file_path"), "n_bytes", "n_lines", "n_rows")


@register("a21_file_digests", O.with_base("sent", f"""
SELECT shard, CAST(sum(strlen(line) + 1) AS BIGINT) AS n_bytes, count(*) AS n_lines,
       sha256(sum(strlen(line) + 1)::VARCHAR || ':' || count(*)::VARCHAR || ':' || CASE WHEN count(*) = 1 THEN max(sha256(line))
         ELSE sha256(string_agg(sha256(line), '' ORDER BY i)) END) AS digest
FROM shards GROUP BY shard""", _SHARD_CTE))
def a21_file_digests(spark, sf):
    """Digest of every file, from line digests taken in parallel over byte ranges and composed in order."""
    folder = scratch_path(spark, "shards")
    write_sentence_shards(spark, sf, folder)
    return R.file_digests(spark, folder, "*.txt").select(_shard("name"), "n_bytes", "n_lines", "digest")


# ------------------------------------------------------------------ A11: one array

@register("a11_message_array", O.with_base("triples", """
SELECT shard, row_number() OVER (PARTITION BY shard ORDER BY guid) - 1 AS obj, src, tgt AS trg, pred,
       CAST(length(pred) AS INTEGER) AS n_pred
FROM (SELECT *, ('0x' || substr(md5(guid), 1, 1))::BIGINT % 4 AS shard FROM triples) t"""))
def a11_message_array(spark, sf):
    """Messages written as four files of one JSON array each and scanned in byte ranges: the object
    boundaries are found from the string and nesting state composed over the ranges."""
    shard = F.pmod(F.conv(F.substring(F.md5("guid"), 1, 1), 16, 10).cast("bigint"), F.lit(ARRAYS)).alias("shard")
    ends = F.broadcast(D.sentences(spark, sf).groupBy(shard).agg((F.count("*") - 1).alias("last")))  # four rows
    t = D.triple_parts(spark, sf, "guid").select("*", shard).join(ends, "shard")  # src, pred and the JSON text are made of these behind the sort
    t = t.repartitionById(ARRAYS, F.col("shard").cast("int")).sortWithinPartitions("shard", "guid").drop("guid")
    t = t.withColumn("i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))  # a task's rows from 0: one shard's
    line = F.concat(F.when(F.col("i") == 0, "[").otherwise(""), F.to_json(F.struct("src", F.col("tgt").alias("trg"), "pred")),
                    F.when(F.col("i") == F.col("last"), "]").otherwise(","))
    folder = scratch_path(spark, "arrays")
    D.from_parts(t).select("shard", line.alias("value")).write.mode("overwrite").partitionBy("shard").text(folder)
    rows = R.read_message_array(spark, f"{folder}/shard=*", "*.txt")
    return rows.select(_shard("file_path"), "obj", "src", "trg", "pred", F.size("pred_tokens").alias("n_pred"))
