"""Operator 5, quality rules: hashed n-gram log-likelihood ratio of a trusted and a raw model.

DataFrame functions only. A text's tokens are its lower-case runs of letters, digits and
underscores and its runs of other marks; token unigrams and bigrams are hashed into ``BUCKETS``
buckets. The raw multinomial counts every document, the trusted one the documents of at most
``TRUSTED`` labelled rows with quality 1 (smallest hashes of the id). A document's score is the sum
of log(trusted / raw) over its n-grams divided by their number, in text order, so it does not
depend on partitions; it is kept when the score is ``MIN_SCORE`` or more and no base rule fails.

The fitted ratios are ``BUCKETS`` numbers, whatever the corpus; the driver hands them to the scoring
pass as one constant array.

Edge cases: null text has no words and fails the base rules; a text without tokens scores 0; a
null doc_id is passed through and never trusted; repeated rows are counted and returned each time;
with no labels the trusted model is flat after smoothing against itself and every score is 0;
other columns are ignored.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, let, table, unused

BUCKETS, TRUSTED, SMOOTHING, MIN_SCORE = 1 << 15, 20_000, 1.0, -0.25
MIN_WORDS, WINDOW, REPEAT_PERCENT = 20, 8, 30
SYMBOLS = "#*$%&|<>"
TOKEN = r"[a-z0-9_\p{L}\p{N}]++|[^\p{L}\p{N}_\s]++"  # ASCII named first and no way back: only for speed


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside windows of ``window`` words that occur twice or more in the array: windows
    are compared by hash, sorted once, and their overlapping cover is summed. ``window`` is a power
    of two."""
    zero = F.lit(0)

    def cover(hashes: Column) -> Column:
        placed = F.array_sort(F.transform(hashes, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

        def twice(s: Column) -> Column:
            none = F.array(F.lit(None).cast("struct<x:bigint,i:int>"))
            before = F.concat(none, F.slice(s, F.lit(1), F.size(s) - 1))
            after = F.concat(F.slice(s, F.lit(2), F.size(s) - 1), none)
            return F.array_sort(F.transform(
                F.filter(F.arrays_zip(s.alias("m"), before.alias("b"), after.alias("a")),
                         lambda z: (z["m"]["x"] == z["b"]["x"]) | (z["m"]["x"] == z["a"]["x"])),
                lambda z: z["m"]["i"]))

        def total(p: Column) -> Column:
            steps = F.zip_with(F.slice(p, F.lit(2), F.size(p) - 1), F.slice(p, F.lit(1), F.size(p) - 1),
                               lambda b, a: F.least(F.lit(window), b - a))
            return F.aggregate(steps, F.lit(window), lambda acc, x: acc + x)

        return let(let(placed, twice), total)

    def joined(h: Column, step: int) -> Column:
        n = F.size(h) - step
        return F.zip_with(F.slice(h, F.lit(1), n), F.slice(h, F.lit(1 + step), n), lambda a, b: F.xxhash64(a, b))

    def windows(h: Column, step: int) -> Column:  # hashes of 2, 4, ... words by doubling
        return joined(h, step) if 2 * step == window else let(joined(h, step), lambda x: windows(x, 2 * step))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < window + 1, zero).otherwise(
        let(let(hashes, lambda h: windows(h, 1)),
            lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), zero).otherwise(cover(g))))


def base_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed (columns of these
    names are replaced, others stay)."""
    w, ls = unused(docs, "words", "lines")
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(t, f"{WS}+"), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike("[^ \\t\\n\\x0B\\f\\r]"))
    out = (docs.withColumn(w, words).withColumn(ls, lines)
           .withColumn("n_words", F.size(w).cast("long"))
           .withColumn("word_chars", F.length(F.array_join(w, "")).cast("long"))
           .withColumn("n_symbols", (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"))
           .withColumn("n_dup_lines", (F.size(ls) - F.size(F.array_distinct(ls))).cast("long"))
           .withColumn("n_repeat_words", repeated_words(F.col(w)).cast("long")))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed).drop(w, ls)


def bucket(gram: Column, n: int) -> Column:
    """Bucket of an n-gram's hash."""
    return F.pmod(gram, F.lit(n)).cast("int")


def gram_hashes(text: Column) -> Column:
    """Hash of every token unigram and bigram of a text."""
    def grams(h: Column) -> Column:
        pairs = F.zip_with(F.slice(h, F.lit(1), F.greatest(F.size(h) - 1, F.lit(0))),
                           F.slice(h, F.lit(2), F.greatest(F.size(h) - 1, F.lit(0))),
                           lambda a, b: F.xxhash64(a, b))
        return F.concat(h, pairs)

    tokens = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), 0)
    return let(F.transform(tokens, lambda w: F.xxhash64(w)), grams)


def trusted_ids(labels: DataFrame, limit: int = TRUSTED) -> DataFrame:
    """At most ``limit`` ids of rows labelled quality 1, the same ones for any order of the rows."""
    return (labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit))


def fit(docs: DataFrame, labels: DataFrame, n: int = BUCKETS, text: str = "text") -> list[float]:
    """log(trusted / raw) of every bucket."""
    (own,) = unused(docs, "trusted_id")
    trusted = trusted_ids(labels).select(F.col("doc_id").alias(own))  # at most TRUSTED ids
    grams = (docs.join(F.broadcast(trusted), docs["doc_id"] == trusted[own], "left")
             .select(F.col(own).isNotNull().alias("good"), F.explode(gram_hashes(F.col(text))).alias("gram")))
    counts = grams.groupBy(bucket(F.col("gram"), n).alias("bucket")).agg(F.count("*").alias("raw"), F.count_if("good").alias("good"))
    rows = {r["bucket"]: (r["raw"], r["good"]) for r in counts.collect()}  # BUCKETS rows at most
    n_raw, n_good = (sum(r[i] for r in rows.values()) for i in (0, 1))
    if not n_good:
        return [0.0] * n
    out = []
    for b in range(n):
        raw, good = rows.get(b, (0, 0))
        out.append(math.log((good + SMOOTHING) / (n_good + SMOOTHING * n))
                   - math.log((raw + SMOOTHING) / (n_raw + SMOOTHING * n)))
    return out


def score(docs: DataFrame, model: list[float], text: str = "text") -> DataFrame:
    """Adds n_grams and score (columns of these names are replaced, others stay)."""
    n = len(model)
    (b_,) = unused(docs, "grams")
    ratio = F.from_json(F.lit(json.dumps(model)), "array<double>")  # folded to a constant once
    total = let(ratio, lambda m: F.aggregate(F.col(b_), F.lit(0.0), lambda acc, g: acc + F.get(m, bucket(g, n))))
    return (docs.withColumn(b_, gram_hashes(F.col(text))).withColumn("n_grams", F.size(b_).cast("long"))
            .withColumn("score", F.when(F.col("n_grams") > 0, total / F.col("n_grams")).otherwise(F.lit(0.0)))
            .drop(b_))


def op5_quality_rules(spark, sf_dir) -> DataFrame:
    """Base rules and log-likelihood-ratio verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    out = score(base_rules(docs), model)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      (~F.col("base_failed") & (F.col("score") >= MIN_SCORE)).alias("kept"), "score", "n_grams")
