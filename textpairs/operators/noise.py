"""Confusion lookup (C01), neighbourhood positions (C07) and noise injection.

Randomness is keyed by the row key plus a purpose string (seed, cycle), so the result
does not depend on partitioning and a retried task draws the same noise.
Confusion sets are small dimension tables (bounded by the character vocabulary): they
are joined with a size-checked broadcast, one candidate is then picked by index from the
joined array (no fan-out join followed by sampling).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rng
from ..session import bounded_broadcast

KINDS = ("same_sound", "similar_sound", "shape", "word")

# ---------------------------------------------------------------------------
# The roll thresholds of the one-error generator (40/30/20/10 %).
ROLL_SAME_SOUND = 4
ROLL_SIMILAR_SOUND = 7
ROLL_SHAPE = 9
ROLL_BASE = 10
# ---------------------------------------------------------------------------


def candidate_arrays(conf: DataFrame) -> DataFrame:
    """Long confusion table ``(kind, ch, idx, cand)`` -> ``(kind, ch, cands)`` ordered by idx."""
    return (conf.groupBy("kind", "ch")
            .agg(F.sort_array(F.collect_list(F.struct("idx", "cand"))).alias("_pairs"))
            .select("kind", "ch", F.transform("_pairs", lambda x: x["cand"]).alias("cands")))


def eligible_positions(text: Column, char_class: str) -> Column:
    """1-based positions whose character is in ``char_class`` (empty for empty text).

    Array form, used where a position list is needed (H02); H01 uses ``nth_eligible``.
    """
    cs = F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.split(text, ""))
    hits = F.transform(cs, lambda c, i: F.when(c.rlike("^" + char_class + "$"), i + 1))
    return F.filter(hits, lambda i: i.isNotNull())


_MARK = "\u0001"


_CLASS_TOKEN = re.compile(r"\\x\{([0-9a-fA-F]+)\}|\\(.)|(.)", re.S)


def class_chars(char_class: str) -> str | None:
    """Explicit characters of a simple bracket class (``[a-z]``, ``[\\x{4e00}-\\x{9fff}]``,
    literals and ranges only); None for anything else (negation, nested classes...)."""
    if not (char_class.startswith("[") and char_class.endswith("]")) or char_class.startswith("[^"):
        return None
    body = char_class[1:-1]
    if "[" in body or "&&" in body:
        return None
    items = []
    for m in _CLASS_TOKEN.finditer(body):
        if m.group(1):
            items.append(chr(int(m.group(1), 16)))
        elif m.group(2):
            if m.group(2).isalnum():
                return None  # \d, \w, \p{..}: not a literal
            items.append(m.group(2))
        else:
            items.append(m.group(3))
    out, i = [], 0
    while i < len(items):
        if i + 2 < len(items) and items[i + 1] == "-":
            out.extend(chr(c) for c in range(ord(items[i]), ord(items[i + 2]) + 1))
            i += 3
        else:
            out.append(items[i])
            i += 1
    return "".join(dict.fromkeys(out))


LISTED = 512  # characters of a class that is written out; a larger one (Han: 20,992) is tested by its ranges


def _listed(char_class: str) -> str | None:
    chars_ = class_chars(char_class)
    return chars_ if chars_ and len(chars_) <= LISTED else None


def count_eligible(text: Column, char_class: str) -> Column:
    """Number of characters of ``text`` in the single-character class (codegen'd).

    Small simple classes delete the runs between their characters, which are few where most
    characters are eligible; others delete runs of the class. Either is one regex."""
    if _listed(char_class):
        return F.length(F.regexp_replace(text, f"[^{char_class[1:-1]}]+", ""))
    return F.length(text) - F.length(F.regexp_replace(text, char_class + "+", ""))


def nth_eligible(text: Column, char_class: str, k: Column, n: Column | None = None) -> Column:
    """1-based position of the (k+1)-th character in ``char_class``, of which the text has ``n``: where that is
    known, only the characters up to the last place it can have are looked at.

    Eligible characters are mapped to a marker (lengths unchanged), then
    ``substring_index`` cuts before the (k+1)-th marker: its length + 1 is the position.
    Pure codegen string functions; no per-character lambda.
    """
    chars_ = _listed(char_class)
    if n is not None:
        text = text.substr(F.lit(1), (k + 1 + F.length(text) - n).cast("int"))
    safe = F.replace(text, F.lit(_MARK), F.lit("\u0002"))
    if chars_:
        marked = F.translate(safe, chars_, _MARK * len(chars_))
    else:
        marked = F.regexp_replace(safe, char_class, _MARK)
    return F.length(F.call_function("substring_index", marked, F.lit(_MARK), (k + 1).cast("int"))) + 1


def roll_kind(key: Column, seed: int, cycle: int, roll: Column | None = None) -> Column:
    if roll is None:
        roll = F.pmod(rng.hash32(key, rng.purpose("kind", seed, cycle)), F.lit(ROLL_BASE))
    return (F.when(roll < ROLL_SAME_SOUND, F.lit("same_sound"))
            .when(roll < ROLL_SIMILAR_SOUND, F.lit("similar_sound"))
            .when(roll < ROLL_SHAPE, F.lit("shape"))
            .otherwise(F.lit("word")))


def _replace_at(text: Column, pos: Column, repl: Column) -> Column:
    return F.concat(text.substr(F.lit(1), pos - 1), repl,
                    F.when(pos + 1 > F.length(text), F.lit("")).otherwise(text.substr(pos + 1, F.length(text))))


def replaced(text: Column, pos: Column, repl: Column) -> Column:
    """The text with ``repl`` at the 1-based ``pos``; unchanged where ``pos`` is null."""
    return F.when(pos.isNull(), text).otherwise(_replace_at(text, pos, repl))


def inject_noise(df: DataFrame, text_col: str, key_col: str, conf: DataFrame, words: DataFrame,
                 n_words: int, seed: int = 42, cycle: int = 0, char_class: str = "[a-z]",
                 out_col: str = "noisy", apply: Column | None = None,
                 positions: Column | None = None) -> DataFrame:
    """One-error noise.

    No eligible character (or ``apply`` false) -> unchanged. Otherwise one eligible position is
    chosen uniformly, a roll picks the candidate source (same sound 40 %, similar sound 30 %,
    shape 20 %, word list 10 %), a missing or empty candidate list falls back to the word
    list, and one candidate is chosen uniformly (it may equal the original).
    Extra columns: ``noise_pos`` (1-based, NULL when unchanged), ``noise_kind``,
    ``noise_from``, ``noise_to``.
    """
    key, text = F.col(key_col), F.col(text_col)
    pos_purpose = rng.purpose("pos", seed, cycle)
    if positions is not None:
        d = df.withColumn("_elig", positions).withColumn("_n", F.size("_elig"))
        d = d.withColumn("noise_pos", F.when(F.col("_n") > 0, F.element_at(
            "_elig", (rng.pick(key, pos_purpose, F.col("_n")) + 1).cast("int"))))
    else:
        n = count_eligible(text, char_class)
        if apply is not None:
            n = F.when(apply, n).otherwise(F.lit(0))
        d = df.withColumn("_n", n).withColumn("_elig", F.lit(None))
        d = d.withColumn("noise_pos", F.when(F.col("_n") > 0, nth_eligible(
            text, char_class, rng.pick(key, pos_purpose, F.col("_n")), F.col("_n"))))
    d = d.withColumn("_roll", F.pmod(rng.hash32(key, rng.purpose("kind", seed, cycle)), F.lit(ROLL_BASE)))
    d = (d.withColumn("noise_from", F.when(F.col("noise_pos").isNotNull(),
                                           text.substr(F.col("noise_pos"), F.lit(1))))
         .withColumn("noise_kind", F.when(F.col("noise_pos").isNotNull(),
                                          roll_kind(key, seed, cycle, F.col("_roll")))))
    arr = candidate_arrays(conf).select(F.col("kind").alias("_k"), F.col("ch").alias("_c"),
                                        F.col("cands").alias("_cands"))
    d = d.join(bounded_broadcast(arr),
               (F.col("noise_kind") == F.col("_k")) & (F.col("noise_from") == F.col("_c")), "left")
    d = d.withColumn("_hc", rng.hash32(key, rng.purpose("cand", seed, cycle)))
    d = d.withColumn("_widx", F.pmod(F.col("_hc"), F.lit(n_words)))
    d = d.join(bounded_broadcast(words.select(F.col("idx").alias("_widx"), F.col("ch").alias("_wch"))),
               "_widx", "left")
    nc = F.coalesce(F.size("_cands"), F.lit(0))
    cand = F.when(nc > 0, F.element_at("_cands", (F.pmod(F.col("_hc"), nc.cast("bigint"))
                                                  + 1).cast("int"))).otherwise(F.col("_wch"))
    d = d.withColumn("noise_to", F.when(F.col("noise_pos").isNotNull(), cand))
    d = d.withColumn(out_col, replaced(text, F.col("noise_pos"), F.col("noise_to")))
    return d.drop("_elig", "_n", "_k", "_c", "_cands", "_widx", "_wch", "_roll", "_hc")


def near_positions(src: Column, trg: Column, window: int = 5, first: Column | None = None) -> Column:
    """0-based positions in ``[max(0,i-w), min(n,i+w+1))`` around the first error ``i``.

    With no difference the reference's loop variable stays at the last index, so ``i = n-1``.
    Empty text gives ``[]`` (the reference fails there). ``first`` is E10's position where a column has it.
    """
    from ..functions.text import first_diff
    n = F.length(src)
    if first is None:
        first = first_diff(F.split(src, ""), F.split(trg, ""))
    i = F.when(first >= 0, first).otherwise(n - 1)
    lo = F.greatest(F.lit(0), i - window)
    hi = F.least(n, i + window + 1) - 1
    return F.when((n > 0) & (hi >= lo), F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))


def inject_near_error(df: DataFrame, src_col: str, trg_col: str, key_col: str, conf: DataFrame,
                      words: DataFrame, n_words: int, seed: int = 42, cycle: int = 0,
                      char_class: str = "[a-z]", window: int = 5, out_col: str = "noisy") -> DataFrame:
    """Second error near the first one.

    A position is chosen uniformly in the neighbourhood (C07). If it is the error position
    itself or its character is not eligible the row is unchanged; otherwise the H01 roll and
    candidate choice apply at that position.
    """
    src, trg, key = F.col(src_col), F.col(trg_col), F.col(key_col)
    from ..functions.text import first_diff
    from ..sources.readers import once
    first = first_diff(F.split(src, ""), F.split(trg, ""))
    d = once(df, df.columns, first.alias("_diff"), F.length(src).alias("_len"))
    d = d.withColumn("_near", near_positions(src, trg, window, F.col("_diff")))
    d = d.withColumn("_first", F.when(F.col("_len") > 0, F.col("_diff"))).drop("_diff", "_len")
    d = d.withColumn("_choice", F.element_at("_near", (rng.pick(
        key, rng.purpose("near", seed, cycle), F.size("_near")) + 1).cast("int")))
    ok = (F.col("_choice").isNotNull() & (F.col("_choice") != F.col("_first"))
          & src.substr(F.col("_choice") + 1, F.lit(1)).rlike("^" + char_class + "$"))
    chosen = F.when(ok, F.array(F.col("_choice") + 1)).otherwise(F.array().cast("array<int>"))
    out = inject_noise(d, src_col, key_col, conf, words, n_words, seed, cycle, char_class,
                       out_col, positions=chosen)
    return out.drop("_near", "_first", "_choice")
