"""Reports (D13-D16, D18, D19): single aggregates over classified rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import chars
from ..session import bounded_broadcast
from ..plans.indexing import prefix_sum
from .clean import REASONS


def audit(df: DataFrame, by: Sequence[str] = (), reason: str = "reason") -> DataFrame:
    """Counters of the waterfall in one aggregate; ``unk_rate`` 0.0 without tokens."""
    r = F.col(reason)
    a = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count_if(r == "accepted").alias("accepted"),
        F.count_if(r == "invalid").alias("invalid_records"),
        F.count_if(r == "empty").alias("empty_records"),
        F.count_if(r == "length_mismatch").alias("dropped_length_mismatch"),
        F.count_if(r == "token_mismatch").alias("dropped_token_mismatch"),
        F.count_if(r == "seq_length").alias("dropped_seq_length"),
        F.sum("n_unk").cast("bigint").alias("unknown_tokens"),
        F.sum("n_tok").cast("bigint").alias("total_tokens"))
    return a.withColumn("unk_rate", F.when(F.col("total_tokens") > 0, F.col("unknown_tokens").cast("double")
                                           / F.col("total_tokens").cast("double")).otherwise(F.lit(0.0)))


def overflow_report(df: DataFrame, length_col: str, cap: int, by: Sequence[str] = ()) -> DataFrame:
    """Rows, rows over capacity and their percentage per group."""
    a = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(length_col) > cap).alias("n_over"))
    return a.withColumn("pct_over", F.col("n_over").cast("double") * F.lit(100.0) / F.col("n").cast("double"))


def dropped_counts(df: DataFrame, category: str, reason: str = "reason",
                   reasons: Sequence[str] = ("format", "length_mismatch", "token_mismatch", "seq_length")) -> DataFrame:
    """Dropped rows per category and reason, pivoted to one column per reason."""
    p = df.where(F.col(reason) != "accepted").groupBy(category).pivot(reason, list(reasons)).count()
    for r in reasons:
        p = p.withColumn(r, F.coalesce(F.col(r), F.lit(0)).cast("bigint"))
    return p


def seed_summary(runs: DataFrame, by: Sequence[str], seed: str, metric: str) -> DataFrame:
    """Mean and sample standard deviation over seeds, plus the single best seed."""
    return runs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_seeds"),
        F.avg(metric).alias("mean"),
        F.stddev_samp(metric).alias("std"),
        F.max(metric).alias("best"),
        F.max_by(F.col(seed), F.struct(F.col(metric), -F.col(seed))).alias("best_seed"))


def confusion_report(conf: DataFrame, vocab: DataFrame | None = None) -> DataFrame:
    """Per kind: characters, candidates, duplicates, self-mappings, candidates
    missing from the vocabulary (would encode to UNK)."""
    c = conf
    if vocab is not None:
        v = vocab.select(F.col("token").alias("cand"), F.lit(True).alias("_in_vocab"))
        c = c.join(bounded_broadcast(v), "cand", "left")
    else:
        c = c.withColumn("_in_vocab", F.lit(True))
    per_char = c.groupBy("kind", "ch").agg(
        F.count(F.lit(1)).alias("_n"), F.count_distinct("cand").alias("_nd"),
        F.count_if(F.col("cand") == F.col("ch")).alias("_self"),
        F.count_if(F.col("_in_vocab").isNull()).alias("_oov"))
    return per_char.groupBy("kind").agg(
        F.count(F.lit(1)).alias("n_chars"), F.sum("_n").alias("n_candidates"),
        F.sum(F.col("_n") - F.col("_nd")).alias("n_duplicates"), F.sum("_self").alias("n_self"),
        F.sum("_oov").alias("n_oov"), F.max("_n").alias("max_candidates"))


def character_counts(texts: DataFrame, col: str) -> DataFrame:
    """(ch, n): occurrences of every character of a corpus, combined before the shuffle."""
    return (texts.where(F.col(col) != "").select(F.explode(F.split(col, "")).alias("ch"))
            .groupBy("ch").agg(F.count(F.lit(1)).alias("n")))


def rare_characters(counts: DataFrame, share: float = 0.01) -> DataFrame:
    """(ch, n) of the least frequent characters that together make up at most ``share`` of the corpus: an
    exact weighted quantile over the distinct characters, never over the corpus."""
    running = prefix_sum(counts, ["n", "ch"], "n", "upto")
    total = counts.agg(F.sum("n")).first()[0] or 0
    return running.where(F.col("upto") <= F.lit(share) * F.lit(total)).select("ch", "n")


def rare_candidates(conf: DataFrame, counts: DataFrame, share: float = 0.01) -> DataFrame:
    """Per kind the candidates, how many of them the corpus never has, and how many are rare (never
    seen, or among :func:`rare_characters`)."""
    common = counts.join(rare_characters(counts, share).select("ch"), "ch", "left_anti").select(
        F.col("ch").alias("cand"), F.lit(True).alias("_common"))
    seen = counts.select(F.col("ch").alias("cand"), F.lit(True).alias("_seen"))
    c = conf.join(seen, "cand", "left").join(common, "cand", "left")
    return c.groupBy("kind").agg(F.count(F.lit(1)).alias("n_candidates"), F.count_if(F.col("_seen").isNull()).alias("n_unseen"),
                                 F.count_if(F.col("_common").isNull()).alias("n_rare"))


def changed_lengths(df: DataFrame, before: str, after: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows, and rows whose token list lost tokens when its special ones were stripped."""
    from ..sources.readers import once
    d = once(df, list(by), (F.size(before) - F.size(after)).cast("bigint").alias("_lost"))
    return d.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("_lost") != 0).alias("n_changed"),
                              F.sum("_lost").alias("n_lost"))


def dedupe_confusion(conf: DataFrame, drop_self: bool = True) -> DataFrame:
    """distinct candidates per (kind, ch), first index kept, optional self removal."""
    c = conf.where(F.col("cand") != F.col("ch")) if drop_self else conf
    first = c.groupBy("kind", "ch", "cand").agg(F.min("idx").alias("idx"))
    from pyspark.sql import Window
    w = Window.partitionBy("kind", "ch").orderBy("idx")
    return first.withColumn("idx", (F.row_number().over(w) - 1).cast("int")).select("kind", "ch", "idx", "cand")


def noise_report(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Unchanged share, share per noise kind, changed characters per sentence (positions
    both sides have and that differ, as in D21)."""
    differ = F.zip_with(chars("src"), chars("tgt"), lambda a, b: a != b)
    errors = F.when(F.col("src") == F.col("tgt"), F.lit(0)).otherwise(F.size(F.filter(differ, lambda x: x)))
    a = pairs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("src") == F.col("tgt")).alias("n_unchanged"),
        F.count_if(F.col("noise_kind") == "same_sound").alias("n_same_sound"),
        F.count_if(F.col("noise_kind") == "similar_sound").alias("n_similar_sound"),
        F.count_if(F.col("noise_kind") == "shape").alias("n_shape"),
        F.count_if(F.col("noise_kind") == "word").alias("n_word"),
        F.count_if(F.col("noise_pos").isNotNull()).alias("n_noised"),
        F.sum(errors.cast("bigint")).alias("n_errors"))
    share = lambda c: F.when(F.col("n_noised") > 0, F.col(c).cast("double") / F.col("n_noised").cast("double")).otherwise(F.lit(0.0))
    return (a.withColumn("unchanged_share", F.col("n_unchanged").cast("double") / F.col("n").cast("double"))
            .withColumn("same_sound_share", share("n_same_sound"))
            .withColumn("similar_sound_share", share("n_similar_sound"))
            .withColumn("shape_share", share("n_shape"))
            .withColumn("word_share", share("n_word"))
            .withColumn("errors_per_sentence", F.col("n_errors").cast("double") / F.col("n").cast("double")))


__all__ = ["audit", "overflow_report", "dropped_counts", "seed_summary", "confusion_report",
           "dedupe_confusion", "noise_report", "character_counts", "rare_characters", "rare_candidates", "changed_lengths", "REASONS"]
