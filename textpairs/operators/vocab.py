"""Vocabulary encoding (C02), label maps (C03), label words (C04), split leaks.

A vocabulary is a table ``(token string, id int)`` bounded by the model's vocabulary (about
21k rows for a character model). Token and UNK counts are codegen'd ``regexp_replace``
lengths against a character class built from it; ids come from a constant array by code
point. No join, no shuffle, no Python.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import bounded_broadcast, constant_table

# ---------------------------------------------------------------------------
# Reserved special tokens (names as in BERT vocabularies).
PAD, UNK, CLS, SEP, MASK = "[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]"
SPECIALS = [PAD, UNK, CLS, SEP, MASK]
IGNORE = -100
# ---------------------------------------------------------------------------

# Characters that produce no token (whitespace and control characters, as a BERT
# basic tokenizer drops them).
NO_TOKEN_CLASS = "(?U)^[\\s\\p{Cc}\\p{Cf}]$"


def basic_vocab(spark: SparkSession, symbols: str) -> DataFrame:
    """Vocabulary: the five specials at ids 0..4, then one row per symbol."""
    rows = [(t, i) for i, t in enumerate(SPECIALS)]
    rows += [(ch, len(SPECIALS) + i) for i, ch in enumerate(dict.fromkeys(symbols))]
    return constant_table(spark, rows, "token string, id int")


def token_text(text: str | Column) -> Column:
    """The text without characters that produce no token (codegen'd)."""
    c = text if isinstance(text, Column) else F.col(text)
    return F.regexp_replace(c, NO_TOKEN_RUN, "")


NO_TOKEN_RUN = "(?U)[\\s\\p{Cc}\\p{Cf}]+"


def _class_of(chars_: list[str]) -> str:
    """Regex character class over code points, consecutive runs compressed to ranges."""
    cps = sorted({ord(c) for c in chars_})
    parts, i = [], 0
    while i < len(cps):
        j = i
        while j + 1 < len(cps) and cps[j + 1] == cps[j] + 1:
            j += 1
        parts.append(f"\\x{{{cps[i]:x}}}" if i == j else f"\\x{{{cps[i]:x}}}-\\x{{{cps[j]:x}}}")
        i = j + 1
    return "[" + "".join(parts) + "]" if parts else "[^\\s\\S]"


class CharVocab:
    """A character vocabulary prepared for codegen'd counting and batched encoding.

    Its single-character tokens (at most one per code point) are read once to build (a) one
    regex character class, so token and UNK counts are two ``regexp_replace`` calls per row
    inside whole-stage codegen, and (b) the encoder's constant array of ids.
    """

    def __init__(self, vocab: DataFrame):
        # characters and specials only: bounded by the number of code points
        rows = vocab.where((F.length("token") == 1) | F.col("token").isin(*SPECIALS)).select("token", "id").collect()
        self.ids = {r["token"]: int(r["id"]) for r in rows}
        self.single = [t for t in self.ids if len(t) == 1]
        self.cls = _class_of(self.single)
        self.unk = self.ids[UNK]

    def id_of(self, token: str) -> int:
        return self.ids[token]

    def n_tokens(self, text: str | Column) -> Column:
        return F.length(token_text(text))

    def n_unk(self, text: str | Column) -> Column:
        return F.length(F.regexp_replace(token_text(text), self.cls, ""))

    def encode(self, text: str | Column, limit: int | None = None) -> Column:
        """Ids of the tokens of ``text`` (UNK for unknown), of the first ``limit`` if given.

        Ids stand in one constant array by code point, so a lookup is an array access; the
        text is cut before it is split."""
        top = max(map(ord, self.single), default=0)
        ids = [self.unk] * (top + 2)
        for t in self.single:
            ids[ord(t)] = self.ids[t]
        t = token_text(text)
        if limit is not None:
            t = F.substring(t, 1, limit)
        table = F.from_json(F.lit(json.dumps(ids)), "array<int>")  # folded to a constant once
        found = F.transform(F.split(t, ""), lambda c: F.get(table, F.least(F.ascii(c), F.lit(top + 1))))
        return F.when(t == "", F.array().cast("array<int>")).otherwise(found)


def label_table(spark: SparkSession, task: str, labels: Sequence[str]) -> DataFrame:
    """Label -> id by list order (the order is part of the table, trap T12)."""
    return constant_table(spark, [(task, lab, i) for i, lab in enumerate(labels)],
                          "task string, label string, label_id int")


def label_id_or_fail(df: DataFrame, labels: DataFrame, label_col: str = "label") -> DataFrame:
    """Adds ``label_id``; an unknown label fails the query."""
    lab = labels.select(F.col("label").alias(label_col), "label_id")
    out = df.join(bounded_broadcast(lab), label_col, "left")
    unknown = F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(F.col(label_col), F.lit("null")))).cast("int")
    return out.withColumn("label_id", F.coalesce("label_id", unknown))


def with_label_words(df: DataFrame, words: DataFrame, vocab: DataFrame, label_col: str = "label") -> DataFrame:
    """Label -> ordered words -> ids. ``words``: (task, label, label_id, word_pos, word)."""
    unk = vocab.where(F.col("token") == UNK).first()["id"]
    w = (words.join(bounded_broadcast(vocab), F.col("word") == F.col("token"), "left")
         .withColumn("word_id", F.coalesce("id", F.lit(unk))))
    per_label = (w.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("word_pos", "word", "word_id"))).alias("_w"))
                 .select(F.col("label").alias(label_col), F.transform("_w", lambda x: x["word"]).alias("label_words"),
                         F.transform("_w", lambda x: x["word_id"]).alias("label_word_ids")))
    return df.join(bounded_broadcast(per_label), label_col, "left")


def split_leaks(df: DataFrame, split_col: str, src_col: str, tgt_col: str) -> DataFrame:
    """Pairs present in two splits. Hash the pair, one shuffle by hash, then a self
    join on the hash of the distinct (hash, split) rows: each pair appears once per split,
    so the join is bounded by the number of splits squared per pair."""
    h = F.sha2(F.concat_ws("\u0001", F.col(src_col), F.col(tgt_col)), 256)
    d = df.select(h.alias("pair_hash"), F.col(split_col).alias("split")).distinct()
    a = d.select("pair_hash", F.col("split").alias("split_a"))
    b = d.select("pair_hash", F.col("split").alias("split_b"))
    j = a.join(b, "pair_hash").where(F.col("split_a") < F.col("split_b"))
    return j.groupBy("split_a", "split_b").agg(F.count(F.lit(1)).alias("shared_pairs"))
