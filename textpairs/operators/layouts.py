"""Fixed-length training arrays.

Every layout is one projection of ``concat`` / ``array_repeat`` / ``slice`` over id arrays:
narrow, no shuffle, written as Parquet by the caller.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vocab import IGNORE


def _c(x: str | Column) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def rep(value, n: Column | int) -> Column:
    """``array_repeat`` with a non-negative count."""
    cnt = n if isinstance(n, Column) else F.lit(n)
    return F.array_repeat(F.lit(value), F.greatest(cnt, F.lit(0)).cast("int"))


def pad_right(arr: str | Column, n: int | Column, fill) -> Column:
    """Right pad (or cut) to length ``n``."""
    a, n = _c(arr), n if isinstance(n, Column) else F.lit(n)
    return F.slice(F.concat(a, rep(fill, n - F.size(a))), F.lit(1), n)


def pad_left(arr: str | Column, n: int, fill) -> Column:
    """Left pad; longer arrays keep their last ``n`` items."""
    a = _c(arr)
    padded = F.concat(rep(fill, F.lit(n) - F.size(a)), a)
    return F.slice(padded, F.greatest(F.size(padded) - n + 1, F.lit(1)), n)


def rephrase_stream(src_ids: str, tgt_ids: str, max_seq: int, cls: int, sep: int, mask: int, pad: int) -> Column:
    """``[CLS] src [SEP] MASK*n [SEP]`` + PAD, with labels on target slots only.

    Struct of input_ids, attention_mask, labels, source_mask, mft_candidates, mft_targets.
    Rows must already be accepted by B03 (never cut here).
    """
    s, t = _c(src_ids), _c(tgt_ids)
    n = F.size(s)
    used = n * 2 + 3
    padn = F.lit(max_seq) - used
    ids = F.concat(F.array(F.lit(cls)), s, F.array(F.lit(sep)), rep(mask, F.size(t)), F.array(F.lit(sep)), rep(pad, padn))
    att = F.concat(rep(1, used), rep(0, padn))
    labels = F.concat(rep(IGNORE, n + 2), t, F.array(F.lit(IGNORE)), rep(IGNORE, padn))
    smask = F.concat(F.array(F.lit(False)), rep(True, n), rep(False, F.size(t) + 2), rep(False, padn))
    eq = F.zip_with(s, t, lambda a, b: a == b)
    cand = F.concat(F.array(F.lit(False)), eq, rep(False, F.size(t) + 2), rep(False, padn))
    mtg = F.concat(F.array(F.lit(IGNORE)), t, rep(IGNORE, F.size(t) + 2), rep(IGNORE, padn))
    return F.struct(ids.alias("input_ids"), att.alias("attention_mask"), labels.alias("labels"),
                    smask.alias("source_mask"), cand.alias("mft_candidates"), mtg.alias("mft_targets"))


def rephrase_batch(src_ids: str, tgt_ids: str, max_seq: int, cls: int, sep: int, mask: int, pad: int) -> Column:
    """Ids as I01 after cutting both sides to ``max//2-2``; label
    ``[CLS] src [SEP] trg [SEP]``; ref ``[CLS] trg [SEP] trg [SEP]``; all padded."""
    cap = max_seq // 2 - 2
    s, t = F.slice(_c(src_ids), 1, cap), F.slice(_c(tgt_ids), 1, cap)
    c, e = F.array(F.lit(cls)), F.array(F.lit(sep))
    ids = F.concat(c, s, e, rep(mask, F.size(t)), e)
    lab = F.concat(c, s, e, t, e)
    ref = F.concat(c, t, e, t, e)
    att = rep(1, F.size(ids))
    return F.struct(pad_right(ids, max_seq, pad).alias("src_ids"), pad_right(att, max_seq, 0).alias("attention_mask"),
                    pad_right(lab, max_seq, pad).alias("trg_ids"), pad_right(ref, max_seq, pad).alias("trg_ref_ids"))


def tagging(src_ids: str, tgt_ids: str, max_seq: int, cls: int, sep: int, pad: int) -> Column:
    """``[CLS] src [SEP]`` vs ``[CLS] trg [SEP]``, cut to max-2 and padded."""
    cap = max_seq - 2
    s, t = F.slice(_c(src_ids), 1, cap), F.slice(_c(tgt_ids), 1, cap)
    c, e = F.array(F.lit(cls)), F.array(F.lit(sep))
    ids, lab = F.concat(c, s, e), F.concat(c, t, e)
    return F.struct(pad_right(ids, max_seq, pad).alias("src_ids"),
                    pad_right(rep(1, F.size(ids)), max_seq, 0).alias("attention_mask"),
                    pad_right(lab, max_seq, pad).alias("trg_ids"))


def prompted_rephrase(src_ids: str, tgt_ids: str, max_seq: int, prompt_len: int, cls: int, sep: int,
                      mask: int, pad: int, parity: bool = False, anchor: list[int] | None = None) -> Column:
    """``CLS*P src anchor SEP*P MASK*n`` inside an outer CLS ... SEP, block flags marking the
    prompt slots, labels and the reference (the target also in the source's place). Sides are cut
    to ``max//2 - P``. A row whose layout is still longer than ``max_seq`` has null arrays and
    ``fits`` false; with ``parity`` it is cut instead, losing target slots."""
    cap = max_seq // 2 - prompt_len
    s, t = F.slice(_c(src_ids), 1, cap), F.slice(_c(tgt_ids), 1, cap)
    c, e = F.array(F.lit(cls)), F.array(F.lit(sep))
    mid = F.array(*[F.lit(x) for x in anchor or []]).cast("array<int>")
    joined = lambda first, last: F.concat(c, rep(cls, prompt_len), first, mid, rep(sep, prompt_len), last, e)
    ids, lab, ref = joined(s, rep(mask, F.size(t))), joined(s, t), joined(t, t)
    flags = F.concat(F.array(F.lit(0)), rep(1, prompt_len), rep(0, F.size(s) + F.size(mid)), rep(1, prompt_len),
                     rep(0, F.size(t) + 1))
    fits = F.size(ids) <= max_seq
    put = lambda arr, fill: F.when(fits | F.lit(parity), pad_right(arr, max_seq, fill))
    return F.struct(fits.alias("fits"), put(ids, pad).alias("src_ids"), put(rep(1, F.size(ids)), 0).alias("attention_mask"),
                    put(lab, pad).alias("trg_ids"), put(ref, pad).alias("trg_ref_ids"), put(flags, 0).alias("block_flag"))


def classification(a_ids: str, b_ids: str | None, label_id: str, max_seq: int, cls: int, sep: int, pad: int,
                   task_id: int = 0) -> Column:
    """One or two sentences with segment ids; the label id repeated to full length."""
    c, e = F.array(F.lit(cls)), F.array(F.lit(sep))
    first = F.concat(c, _c(a_ids), e)
    second = F.array().cast("array<int>") if b_ids is None else F.concat(_c(b_ids), e)
    ids = F.concat(first, second)
    segments = F.concat(rep(0, F.size(first)), rep(1, F.size(second)))
    return F.struct(pad_right(ids, max_seq, pad).alias("src_ids"),
                    pad_right(rep(1, F.size(ids)), max_seq, 0).alias("attention_mask"),
                    pad_right(segments, max_seq, 0).alias("token_type_ids"), F.lit(task_id).alias("task_id"),
                    F.array_repeat(_c(label_id), max_seq).alias("trg_ids"))


def prompted_classification(text_ids: str, label_id: str, mask_len: int, max_seq: int, prompt_len: int,
                            cls: int, sep: int, mask: int, pad: int) -> Column:
    """``CLS text SEP`` (cut to ``max_seq`` with both) + ``SEP*P`` + ``MASK*m``. Active bits are 1
    at the mask slots and -100 elsewhere, prompt mask 1 at the prompt slots, labels the label id first and
    then zeros; total length ``max + P + 2``."""
    total = max_seq + prompt_len + 2
    text = F.concat(F.array(F.lit(cls)), F.slice(_c(text_ids), 1, max_seq - 2), F.array(F.lit(sep)))
    n = F.size(text)
    ids = F.concat(text, rep(sep, prompt_len), rep(mask, mask_len))
    return F.struct(pad_right(ids, total, pad).alias("src_ids"),
                    pad_right(rep(1, F.size(ids)), total, 0).alias("attention_mask"),
                    pad_right(F.concat(rep(0, n), rep(1, prompt_len)), total, 0).alias("prompt_mask"),
                    pad_right(F.concat(rep(IGNORE, n + prompt_len), rep(1, mask_len)), total, IGNORE).alias("active_bits"),
                    pad_right(F.array(_c(label_id)), total, 0).alias("trg_ids"))


def causal(src_ids: str, tgt_ids: str, max_seq: int, cls: int, sep: int, eos: int, pad: int,
           arrows: bool = False, arrow_id: int | None = None) -> Column:
    """Left-padded ``CLS src SEP trg EOS``; labels only on the target (+EOS). ``regu_src`` has the
    source and its SEP in their places, ``target_ref`` CLS and the target from the start; -100 elsewhere."""
    cap = max_seq // 4 - 1 if arrows else max_seq // 2 - 2
    s, t = F.slice(_c(src_ids), 1, cap), F.slice(_c(tgt_ids), 1, cap)
    if arrows:
        n = F.least(F.size(s), F.size(t))
        t = F.flatten(F.zip_with(F.slice(s, F.lit(1), n), F.slice(t, F.lit(1), n), lambda a, b: F.array(a, F.lit(arrow_id), b)))
    c, t = F.array(F.lit(cls)), F.concat(t, F.array(F.lit(eos)))
    source = F.concat(s, F.array(F.lit(sep)))
    ids = F.concat(c, source, t)
    lab = F.concat(rep(IGNORE, F.size(source) + 1), t)
    regu = F.concat(rep(IGNORE, 1), source, rep(IGNORE, F.size(t)))
    # one place per place of the input: the target, cut or followed by -100
    ref = pad_right(F.concat(c, t, rep(IGNORE, F.size(t))), F.size(ids), IGNORE)
    return F.struct(pad_left(ids, max_seq, pad).alias("input_ids"),
                    pad_left(rep(1, F.size(ids)), max_seq, 0).alias("attention_mask"),
                    pad_left(lab, max_seq, IGNORE).alias("labels"), pad_left(regu, max_seq, IGNORE).alias("regu_src"),
                    pad_left(ref, max_seq, IGNORE).alias("target_ref"))


def instruction(prefix_ids: str, input_ids: str, suffix_ids: str, response_ids: str, max_seq: int,
                eos: int, pad: int, detect: str | Column | None = None,
                markers: tuple[int, int] | None = None) -> Column:
    """``prefix input suffix response EOS``, labels -100 on the prompt; ``src_ref`` holds the input
    ids at their positions and the EOS at its own (-100 elsewhere, PAD behind) for H09; detect rows
    have no input ids in it. ``markers`` are the ids put before the prompt and before the response
    (the other style has none). Each part is cut to max//2-2; ``overflow`` is what did not fit."""
    cap = max_seq // 2 - 2
    p, i, s, r = (F.slice(_c(x), 1, cap) for x in (prefix_ids, input_ids, suffix_ids, response_ids))
    user, assistant = (F.array(*([F.lit(x)] if markers else [])).cast("array<int>") for x in markers or (0, 0))
    n_prompt = F.size(user) + F.size(p) + F.size(i) + F.size(s) + F.size(assistant)
    ids = F.concat(user, p, i, s, assistant, r, F.array(F.lit(eos)))
    lab = F.concat(rep(IGNORE, n_prompt), r, F.array(F.lit(eos)))
    held = i if detect is None else F.when(_c(detect), rep(IGNORE, F.size(i))).otherwise(i)
    ref = F.concat(user, rep(IGNORE, F.size(p)), held, rep(IGNORE, F.size(s)), assistant, rep(IGNORE, F.size(r)),
                   F.array(F.lit(eos)))
    return F.struct(pad_right(ids, max_seq, pad).alias("input_ids"), pad_right(rep(1, F.size(ids)), max_seq, 0).alias("attention_mask"),
                    pad_right(lab, max_seq, IGNORE).alias("labels"), pad_right(ref, max_seq, pad).alias("src_ref"),
                    F.greatest(F.size(ids) - max_seq, F.lit(0)).alias("overflow"))


def eval_record(src_ids: str, tgt_ids: str, max_seq: int, cls: int, sep: int, mask: int, pad: int) -> Column:
    """I01's ids plus ``n_src``/``n_trg``; attention = ids != PAD."""
    s, t = _c(src_ids), _c(tgt_ids)
    ids = pad_right(F.concat(F.array(F.lit(cls)), s, F.array(F.lit(sep)), rep(mask, F.size(t)), F.array(F.lit(sep))),
                    max_seq, pad)
    return F.struct(ids.alias("input_ids"), F.transform(ids, lambda x: (x != pad).cast("int")).alias("attention_mask"),
                    F.size(s).alias("n_src"), F.size(t).alias("n_trg"))


def loss_labels(input_ids: str | Column, labels: str | Column) -> Column:
    """Positions where input == label become -100."""
    return F.zip_with(_c(input_ids), _c(labels), lambda x, y: F.when(x == y, F.lit(IGNORE)).otherwise(y))
