"""Pair validation and predicates.

The reject waterfalls are single ``CASE WHEN`` columns evaluated in one projection: no extra
pass over the data, and the counters of D13 are one aggregate over that column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vocab as V

REASONS = ["accepted", "invalid", "empty", "length_mismatch", "token_mismatch", "seq_length"]
EVAL_REASONS = ["accepted", "format", "length_mismatch", "token_mismatch", "seq_length"]

# ---------------------------------------------------------------------------
# The instruction texts that mark a detection example.
DETECTION_INSTRUCTIONS = ["用<>标注出句子中的错别字"]
# ---------------------------------------------------------------------------


def slots(max_seq: int, rule: str = "stream", prompt_len: int = 0) -> int:
    """Number of source (= target) slots for a sequence length.

    ``stream``: (max-3)//2 (CLS src SEP tgt SEP); ``batch``: max//2-2; ``prompt``:
    max//2-prompt_len; ``causal_arrows``: max//4-1; ``causal``: max//2-2.
    """
    if rule == "stream":
        return (max_seq - 3) // 2
    if rule in ("batch", "causal"):
        return max_seq // 2 - 2
    if rule == "prompt":
        return max_seq // 2 - prompt_len
    if rule == "causal_arrows":
        return max_seq // 4 - 1
    raise ValueError(rule)


def filter_equal_length(df: DataFrame, src: str = "src_tokens", trg: str = "trg_tokens") -> DataFrame:
    """Keep pairs whose token lists have equal length (silent drop, as the reference)."""
    return df.where(F.size(src) == F.size(trg))


def classify_pairs(df: DataFrame, vocab: DataFrame | V.CharVocab, max_seq: int = 128, src: str = "src",
                   tgt: str = "tgt", valid: str = "valid") -> DataFrame:
    """Training waterfall, first match wins.

    invalid -> empty (either side) -> length_mismatch (characters) -> token_mismatch ->
    seq_length (tokens > slots) -> accepted. ``n_tok``/``n_unk`` count both sides for rows
    that reached the token stage (token_mismatch, seq_length, accepted), as the reference
    adds them before the token checks. All counting is codegen'd string functions.
    """
    cv = vocab if isinstance(vocab, V.CharVocab) else V.CharVocab(vocab)
    cap = slots(max_seq, "stream")
    s, t = F.col(src), F.col(tgt)
    d = df.withColumn("_ns", cv.n_tokens(s)).withColumn("_nt", cv.n_tokens(t))
    reason = (F.when(~F.col(valid), F.lit("invalid"))
              .when((s == "") | (t == ""), F.lit("empty"))
              .when(F.length(s) != F.length(t), F.lit("length_mismatch"))
              .when(F.col("_ns") != F.col("_nt"), F.lit("token_mismatch"))
              .when(F.col("_ns") > cap, F.lit("seq_length"))
              .otherwise(F.lit("accepted")))
    from ..sources.readers import once
    d = once(d, [c for c in d.columns if c != "reason"], reason.alias("reason"))
    tokenised = F.col("reason").isin("token_mismatch", "seq_length", "accepted")
    d = (d.withColumn("n_tok", F.when(tokenised, F.col("_ns") + F.col("_nt")).otherwise(F.lit(0)))
         .withColumn("n_unk", F.when(tokenised, cv.n_unk(s) + cv.n_unk(t)).otherwise(F.lit(0))))
    return d.drop("_ns", "_nt")


def encode_accepted(classified: DataFrame, vocab: DataFrame | V.CharVocab, src: str = "src",
                    tgt: str = "tgt") -> DataFrame:
    """C02 on accepted rows only: ``src_ids``/``tgt_ids`` (Arrow-batched lookup)."""
    cv = vocab if isinstance(vocab, V.CharVocab) else V.CharVocab(vocab)
    acc = classified.where(F.col("reason") == "accepted")
    return acc.withColumn("src_ids", cv.encode(src)).withColumn("tgt_ids", cv.encode(tgt))


def classify_eval_pairs(df: DataFrame, vocab: DataFrame | V.CharVocab, max_seq: int = 128,
                        src_tokens: str = "src_tokens", tgt_tokens: str = "tgt_tokens",
                        valid: str = "valid") -> DataFrame:
    """Evaluation waterfall: format -> length_mismatch (tokens) -> token_mismatch ->
    seq_length -> accepted. No empty check: ``[]`` vs ``[]`` is accepted (a negative).
    A token produces ids for each of its id-bearing characters (character model)."""
    cv = vocab if isinstance(vocab, V.CharVocab) else V.CharVocab(vocab)
    cap = slots(max_seq, "stream")
    ns = cv.n_tokens(F.array_join(F.col(src_tokens), ""))
    nt = cv.n_tokens(F.array_join(F.col(tgt_tokens), ""))
    d = df.withColumn("_ns", F.when(F.col(valid), ns)).withColumn("_nt", F.when(F.col(valid), nt))
    reason = (F.when(~F.col(valid), F.lit("format"))
              .when(F.size(src_tokens) != F.size(tgt_tokens), F.lit("length_mismatch"))
              .when(F.col("_ns") != F.col("_nt"), F.lit("token_mismatch"))
              .when(F.col("_ns") > cap, F.lit("seq_length"))
              .otherwise(F.lit("accepted")))
    from ..sources.readers import once
    return once(d, [c for c in d.columns if c not in ("reason", "_ns", "_nt")], reason.alias("reason"))


def truncate_pairs(df: DataFrame, n: int, cols: Sequence[str] = ("src_tokens", "tgt_tokens")) -> DataFrame:
    """Cut token arrays to the slot capacity."""
    for c in cols:
        df = df.withColumn(c, F.slice(c, 1, n))
    return df


def without_ids(ids_cols: Sequence[str], unk_id: int) -> Column:
    """Whether no id array of the row holds UNK."""
    cond = F.lit(True)
    for c in ids_cols:
        cond = cond & ~F.array_contains(c, unk_id)
    return cond


def drop_ids(col: str | Column, ids: Sequence[int]) -> Column:
    """Remove listed ids before building features (default: none)."""
    c = col if isinstance(col, Column) else F.col(col)
    if not ids:
        return c
    bad = F.array(*[F.lit(i) for i in ids])
    return F.filter(c, lambda x: ~F.array_contains(bad, x))


def instruction_type(instruction: str | Column) -> Column:
    """``detect`` if the instruction is in the fixed list, else ``correct``."""
    c = instruction if isinstance(instruction, Column) else F.col(instruction)
    return F.when(c.isin(*DETECTION_INSTRUCTIONS), F.lit("detect")).otherwise(F.lit("correct"))


def shard(index_col: str | Column, shard_count: int) -> Column:
    """Shard id of a raw line index (blank and bad lines count)."""
    c = index_col if isinstance(index_col, Column) else F.col(index_col)
    return F.pmod(c, F.lit(shard_count))


def shard_id(rank: int, worker: int, workers: int) -> int:
    """``rank * workers + worker``."""
    return rank * workers + worker


def missing_categories(expected: DataFrame, present: DataFrame, key: str = "category",
                       exempt: Sequence[str] = ("sig",)) -> DataFrame:
    """Expected categories without data (left-anti join); ``exempt`` ones are skipped."""
    e = expected.where(~F.col(key).isin(*exempt)) if exempt else expected
    return e.join(present.select(key).distinct(), key, "left_anti")


def after_step(df: DataFrame, start_step: int, grad_accum: int = 1, batch_col: str = "batch_id") -> DataFrame:
    """Resume: skip the first ``start_step * grad_accum`` batches."""
    return df.where(F.col(batch_col) >= start_step * grad_accum)
