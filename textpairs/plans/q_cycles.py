"""Query: the endless shuffled stream over written files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rng
from ..operators import noise as N
from ..session import scratch_path
from ..sources import derived as D
from ..streaming import cycles as CY
from . import oracle as O
from .queries import register

_CYCLE_SQL, _CYCLE_LAST = O.noise_ctes("cyc", "tgt", "src", prefix="y")


SHARDS = 3
FILE_LINES = 10_000  # a micro-batch is a number of files, so its size must not follow the corpus


def write_sentences(spark, sf, folder: str) -> None:
    """The clean sentences as text files of at most ``FILE_LINES`` lines whose path order is the corpus order."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (D.sentences(spark, sf).select("doc_id", "sent_no", "tgt").repartitionByRange(n, "doc_id", "sent_no")
     .sortWithinPartitions("doc_id", "sent_no").select("tgt").write.mode("overwrite")
     .option("maxRecordsPerFile", FILE_LINES).text(folder))


@register("k01_cycle_shuffle", O.with_base("sent", f"""
SELECT cycle, raw_idx, raw_idx % 3 AS shard, tgt, src FROM {_CYCLE_LAST}""", """
cyc AS (SELECT tgt, raw_idx, cycle, CAST(raw_idx AS VARCHAR) || ':' || CAST(cycle AS VARCHAR) AS k
  FROM (SELECT tgt, row_number() OVER (ORDER BY doc_id, sent_no) - 1 AS raw_idx FROM sent) s, range(2) r(cycle)),
""" + _CYCLE_SQL))
def k01_cycle_shuffle(spark, sf):
    """K01 + J01 + J03 + K05: the sentences' files replayed as two cycles through the streaming source, three
    shards, noise drawn anew in each cycle, mixed in a state buffer of 500 rows a shard; the stream is
    stopped after the first cycle and goes on from its checkpoint. Every row of both cycles, once."""
    root = scratch_path(spark, "cycles")
    write_sentences(spark, sf, f"{root}/in")
    files = CY.manifest(spark, f"{root}/in", "*.txt")
    for cycles in (1, 2):
        lines = CY.cycle_stream(spark, files, SHARDS, cycles, files_per_trigger=64)
        lines = lines.withColumnRenamed("value", "tgt").withColumn("k", rng.row_key("raw_idx", "cycle"))
        noisy = N.inject_noise(lines, "tgt", "k", D.confusion_df(spark), D.words_df(spark), len(D.ALPHABET), seed=D.SEED,
                               char_class=D.CHAR_CLASS, out_col="src", apply=~F.col("ended"))
        noisy = noisy.withColumn("at", F.coalesce("noise_pos", F.lit(0)))  # src is made of these behind the buffer
        rows = CY.shuffled(noisy.select("cycle", "raw_idx", "shard", "ended", "tgt", "at", "noise_to"), 500, D.SEED)
        rows = rows.withColumn("src", N.replaced(F.col("tgt"), F.nullif("at", F.lit(0)), F.col("noise_to"))).drop("at", "noise_to")
        CY.run_available(rows, f"{root}/out", f"{root}/checkpoint", SHARDS)
    return spark.read.parquet(f"{root}/out").select("cycle", "raw_idx", "shard", "tgt", "src")
