"""Operator 13, importance resampling towards a target by bit-sliced bucket counts.

Features are all runs of one to three words, hashed into ``BUCKETS`` buckets by CRC-32. A bucket's
gain is the floored, scaled log ratio of its smoothed share in the target to its share in the
documents, a whole number. A document's weight is the sum of its features' gains, taken without
multiplying: its bucket counts are cut into bit planes of 10,000 bits (plane j holds bit j of every
count), the gains into bit planes of their magnitudes, one set for each sign; two planes are joined
with AND, counted with popcount, and the counts are added up times powers of two. All of it is
integer arithmetic, so weights are exact and do not depend on order or partitions.

Two passes over the texts: one adds up the buckets of all documents (each task sends one partial
table of at most ``BUCKETS`` rows, Spark adds them), one scores. Only the gains, ``BUCKETS`` whole
numbers, are collected and shipped. The draw numbers the scores with a range-partitioned sort, so it
may hold any share of the rows. Texts are read in slices of ``SLICE`` bytes cut between words: memory
follows the slice and the longest word, not the text.

Edge cases: null, empty or wordless text has no features and weight 0; a null id has no score and is not
drawn, but its text counts in the statistics; repeated rows are documents of their own; equal scores
go to the smaller id, then to the smaller weight; an empty target or an empty table works by the
smoothing; columns beside the named ones are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.indexing import row_index
from .common import arrow_map, arrow_schema, cut, map_columns, table

BUCKETS, RUN, SCALE, SEED = 10_000, 3, 1000, 42
LEAST_WORDS, PERCENT = 20, 5
SLICE = 1 << 20

# Bytes of lower-cased UTF-8 that belong to words: digits, letters, all of non-ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
GAP = re.compile(rb"[^0-9a-z\x80-\xff]")


def hashes(text: bytes | None):
    """(words, feature hashes) of every slice of the text. The hash of a longer run goes on from that
    of the run without its last word, so what crosses a slice is two numbers."""
    data, pos = (text or b"").lower(), 0  # bytes: A-Z only
    one = two = None
    while pos < len(data):
        gap = GAP.search(data, pos + SLICE)
        end = gap.start() if gap else len(data)
        words = WORD.findall(data, pos, end)
        pos = end
        if not words:
            continue
        single = list(map(crc32, words))
        tails = [b" " + w for w in words]
        if one is None:
            pairs = list(map(crc32, tails[1:], single))
            triples = list(map(crc32, tails[2:], pairs))
        else:
            pairs = list(map(crc32, tails, [one, *single]))
            triples = (list(map(crc32, tails, [two, *pairs])) if two is not None
                       else list(map(crc32, tails[1:], pairs)))
        one, two = single[-1], pairs[-1] if pairs else None
        yield len(words), np.array(single + pairs + triples, dtype=np.uint32)


def bucket_counts(text: bytes | None) -> tuple[int, np.ndarray]:
    """Number of words and the count of every bucket."""
    n, counts = 0, np.zeros(BUCKETS, dtype=np.int64)
    for words, h in hashes(text):
        n += words
        counts += np.bincount(h % BUCKETS, minlength=BUCKETS)
    return n, counts


def planes(values: np.ndarray) -> np.ndarray:
    """Bit planes of whole numbers from 0 up: row j holds bit j of all of them, as 64-bit words."""
    top = int(values.max(initial=0)).bit_length()
    bits = np.zeros((top, -(-len(values) // 64) * 64), dtype=np.uint8)
    bits[:, :len(values)] = values[None, :] >> np.arange(top)[:, None] & 1
    return np.packbits(bits, axis=1).view(np.uint64)


class SlicedGains:
    """Bit planes of the gains' magnitudes, one set for each sign."""

    def __init__(self, gains: np.ndarray):
        self.signed = [(1, planes(np.maximum(gains, 0))), (-1, planes(np.maximum(-gains, 0)))]

    def weight(self, counts: np.ndarray) -> int:
        """Sum of count times gain over all buckets."""
        sliced, total = planes(counts), 0
        for sign, gain in self.signed:
            both = np.bitwise_count(sliced[:, None, :] & gain[None, :, :]).sum(axis=2, dtype=np.int64)
            total += sign * sum(int(c) << int(j + k) for (j, k), c in np.ndenumerate(both) if c)
        return total


def bucket_totals(texts: DataFrame, column: str = "text") -> DataFrame:
    """(bucket, n): features of all texts; one partial table a task."""
    sch = arrow_schema("bucket int, n bigint")

    def run(batches):
        total = np.zeros(BUCKETS, dtype=np.int64)
        for b in batches:
            for text in b.column(0).cast(pa.binary()).to_pylist():
                for _, h in hashes(text):
                    total += np.bincount(h % BUCKETS, minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], schema=sch)

    return (arrow_map(texts.select(column), run, "bucket int, n bigint")
            .groupBy("bucket").agg(F.sum("n").alias("n")))


def gains(raw: DataFrame, target: DataFrame) -> np.ndarray:
    """Gain of every bucket, from (bucket, n) of the documents and of the target (``BUCKETS`` rows each)."""
    s, t = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for out, totals in ((s, raw), (t, target)):
        for r in totals.collect():  # at most BUCKETS rows
            out[r["bucket"]] = r["n"]
    all_s, all_t = float(s.sum()), float(t.sum())
    ratio = (t + 1) * (all_s + BUCKETS) / ((s + 1) * (all_t + BUCKETS))
    return np.array([math.floor(SCALE * math.log(x)) for x in ratio], dtype=np.int64)


def noise(doc_id: int, seed: int = SEED) -> int:
    """Floored, scaled Gumbel noise of a document, from its id alone."""
    h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-SCALE * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every document."""
    sliced = SlicedGains(gain)

    def run(batch: pa.RecordBatch):
        words, features, weights, scores = [], [], [], []
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
            n, counts = bucket_counts(t)
            w = sliced.weight(counts) if n else 0
            words.append(n)
            features.append(int(counts.sum()))
            weights.append(w)
            scores.append(None if i is None else w + noise(i))
        yield {"doc_id": batch.column(0), "n_words": words, "n_features": features, "weight": weights, "score": scores}

    return map_columns(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).alias("text")),
                       "doc_id bigint, n_words bigint, n_features bigint, weight bigint, score bigint", run)


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every document; the ``percent`` highest
    scores among the documents of at least ``least_words`` words have a rank, from 1."""
    scored = cut(weigh(docs, gains(bucket_totals(docs), bucket_totals(target))), "scored")
    able = (F.col("n_words") >= least_words) & F.col("score").isNotNull()
    k = scored.where(able).count() * percent // 100
    names = scored.columns
    placed = row_index(scored.where(able).withColumn("down", -F.col("score")), ["down", "doc_id", "weight", "n_features"],
                       out_col="place")
    drawn = placed.select(*names, F.when(F.col("place") < k, F.col("place") + 1).alias("rank"))
    return drawn.unionByName(scored.where(~able).withColumn("rank", F.lit(None).cast("bigint")))


def op13_target_resampling(spark, sf_dir) -> DataFrame:
    """Weight towards ``benchmark``, score and rank in the draw of every document."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_features", "weight", "score", "rank")
