"""Operator 4, quality classifier by importance resampling.

Two generative models over hashed token unigrams and bigrams, one of the target (documents of at
most ``rules.TRUSTED`` rows labelled quality 1) and one of the raw corpus (every document), give
each document the log importance weight sum(log target - log raw) of its n-grams. Documents are
then drawn without replacement by Gumbel top-k: weight plus a Gumbel draw seeded by the document's
id, the ``k`` largest are kept. The draw depends on neither order nor partitioning.

``k`` is a share of the corpus: ``share``, or else the share of quality 1 among the labelled rows,
plus three standard errors so that chance does not cost target-like documents. The k-th largest
key is found by counting keys in ever narrower ranges; no task sorts the corpus.

Edge cases: null or empty text has no n-grams and weight 0; documents whose key equals the k-th
largest are all kept (repeated rows of one document share their draw); a null doc_id has the draw
of the null id; without labels of quality 1 all weights are 0, without any labels everything is
kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rules
from .common import cut, table

BUCKETS, SEED, BINS, FEW = 10_000, 20_240_501, 4096, 10_000


def target_share(labels: DataFrame) -> float:
    r = labels.where(F.col("quality").isin(0, 1)).agg(F.count("*").alias("n"), F.avg("quality").alias("p")).first()
    if not r["n"]:
        return 1.0
    return min(1.0, r["p"] + 3 * math.sqrt(r["p"] * (1 - r["p"]) / r["n"]))


def kth_largest(keys: DataFrame, col: str, k: int) -> float | None:
    """The k-th largest value of a double column: counts per range, then one sorted remainder of
    at most FEW rows (or a range of one value)."""
    here, above = keys.select(col), 0
    while True:
        r = here.agg(F.min(col).alias("lo"), F.max(col).alias("hi"), F.count(col).alias("n")).first()
        lo, hi, n = r["lo"], r["hi"], r["n"]
        if not n or k <= 0:
            return None
        if above + n <= k:
            return lo
        if lo == hi:
            return lo
        if n <= FEW:
            return here.orderBy(F.desc(col)).limit(k - above).agg(F.min(col)).first()[0]
        place = F.least(F.floor((F.col(col) - F.lit(lo)) / F.lit(hi - lo) * F.lit(BINS)), F.lit(BINS - 1))
        for b, m in sorted(((x["b"], x["m"]) for x in here.groupBy(place.alias("b"))
                            .agg(F.count("*").alias("m")).collect()), reverse=True):
            if above + m >= k:
                here = here.where(place == F.lit(b))
                break
            above += m


def weigh(docs: DataFrame, labels: DataFrame, n: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_grams, log_weight and gumbel_key of every row."""
    model = rules.fit(docs, labels, n)
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11).cast("double") + 0.5) / F.lit(2.0 ** 53)
    return (rules.score(docs.select("doc_id", "text"), model)
            .select("doc_id", "n_grams", (F.col("score") * F.col("n_grams")).alias("log_weight"))
            .withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(u))))


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None) -> DataFrame:
    """Every row with its weight, key and ``kept``."""
    keys = cut(weigh(docs, labels), "resample-keys")
    total = keys.count()
    k = round(total * (target_share(labels) if share is None else share))
    least = kth_largest(keys, "gumbel_key", k)
    kept = F.lit(False) if least is None else F.col("gumbel_key") >= F.lit(least)
    return keys.withColumn("kept", kept)


def op4_importance_resampling(spark, sf_dir) -> DataFrame:
    """Importance weight and Gumbel top-k choice for every document."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
