"""Queries: tagging and causal layouts, arrow interleave/recovery, triple alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rng
from ..functions.text import arrow_interleave, arrow_recover
from ..operators import align as A
from ..operators import layouts as L
from ..operators import noise as N
from ..operators import vocab as V
from ..sources import derived as D
from . import oracle as O
from .q_features import CLS, MASK, PAD, SEP, WHOLE_CTE, _clean_sql, _ids_sql, _ids_str, _rep, _str, _whole, x_chars
from .q_sources import _H2_BASE, _H2_LAST, _H2_NOISE
from .queries import register

H = O.H
MAXS = D.MAX_SEQ


@register("i03_tagging", O.with_base("pairs", f"""
SELECT guid,
  {_ids_str(f"[{CLS}] || s_ids[1:{MAXS - 2}] || [{SEP}] || {_rep(PAD, f'{MAXS} - len(s_ids[1:{MAXS - 2}]) - 2')}")} AS src_ids,
  {_ids_str(f"[{CLS}] || t_ids[1:{MAXS - 2}] || [{SEP}] || {_rep(PAD, f'{MAXS} - len(t_ids[1:{MAXS - 2}]) - 2')}")} AS trg_ids
FROM whole""", WHOLE_CTE))
def i03_tagging(spark, sf):
    """Tagging layout ``[CLS] src [SEP]`` vs ``[CLS] trg [SEP]`` of every well-formed pair,
    cut and padded."""
    t = _whole(spark, sf)
    lay = L.tagging("s_ids", "t_ids", MAXS, CLS, SEP, PAD)
    return t.select("guid", _str(lay["src_ids"]).alias("src_ids"), _str(lay["trg_ids"]).alias("trg_ids"))


def _left(a: str, v: int) -> str:
    """Left pad to MAXS; longer arrays keep their last MAXS items."""
    return f"({_rep(v, f'{MAXS} - len({a})')} || ({a})[greatest(len({a}) - {MAXS} + 1, 1):])"


_C8 = MAXS // 2 - 2


def _tag(x: str) -> str:
    """Tagging layout of the ids in column ``x``."""
    return _ids_str(f"([{CLS}] || {x}[1:{MAXS - 2}] || [{SEP}] || {_rep(PAD, str(MAXS))})[1:{MAXS}]")


@register("i04_noisy_tagging", O.with_base("pairs", f"""
SELECT guid, {_tag('s')} AS src_ids, {_tag('t')} AS trg_ids, {_tag('z')} AS trg_ref_ids
FROM (SELECT guid, {_ids_sql(_clean_sql('src'))} AS s, {_ids_sql(_clean_sql('tgt'))} AS t,
             {_ids_sql(_clean_sql('noisy'))} AS z FROM {_H2_LAST}) x""", _H2_BASE + ",\n" + _H2_NOISE))
def i04_noisy_tagging(spark, sf):
    """Tagging layout with the source made noisier (H02) as the reference column."""
    p = D.pairs(spark, sf).select("guid", "k", "src", "tgt")
    p = N.inject_near_error(p, "src", "tgt", "k", D.confusion_df(spark), D.words_df(spark), len(D.ALPHABET), seed=7,
                            char_class=D.CHAR_CLASS)
    cv = V.CharVocab(D.vocab(spark))
    ids = p.select("guid", *[cv.encode(c, MAXS - 2).alias(c) for c in ("src", "tgt", "noisy")])
    lay, ref = L.tagging("src", "tgt", MAXS, CLS, SEP, PAD), L.tagging("noisy", "tgt", MAXS, CLS, SEP, PAD)
    return ids.select("guid", _str(lay["src_ids"]).alias("src_ids"), _str(lay["trg_ids"]).alias("trg_ids"),
                      _str(ref["src_ids"]).alias("trg_ref_ids"))


_M11 = MAXS // 2 - 2


def _fill(a: str) -> str:
    return _ids_str(f"({a} || {_rep(PAD, str(MAXS))})[1:{MAXS}]")


@register("i11_mono_vectorise", O.with_base("pairs", f"""
SELECT guid, {_fill(f'[{CLS}] || s || [{SEP}] || ' + _rep(MASK, 'len(t)') + f' || [{SEP}]')} AS src_ids,
       {_fill(f'[{CLS}] || s || [{SEP}] || t || [{SEP}]')} AS trg_ids, {_fill(f'[{CLS}] || t || [{SEP}] || t || [{SEP}]')} AS trg_ref_ids
FROM (SELECT guid, {_ids_sql(_clean_sql('src'))}[1:{_M11}] AS s, {_ids_sql(_clean_sql('tgt'))}[1:{_M11}] AS t FROM pairs) x"""))
def i11_mono_vectorise(spark, sf):
    """Clean sentences (A05) made wrong on the way (H01) and laid out like I02, nothing dropped."""
    cv = V.CharVocab(D.vocab(spark))
    ids = D.pairs(spark, sf).select("guid", *[cv.encode(c, _M11).alias(c) for c in ("src", "tgt")])
    d = ids.select("guid", L.rephrase_batch("src", "tgt", MAXS, CLS, SEP, MASK, PAD).alias("l"))
    return d.select("guid", *[_str(f"l.{c}").alias(c) for c in ("src_ids", "trg_ids", "trg_ref_ids")])


@register("i08_causal", O.with_base("pairs", f"""
SELECT guid, {_ids_str(_left(f'([{CLS}] || s || t)', PAD))} AS input_ids,
       {_ids_str(_left(f'({_rep(-100, "len(s) + 1")} || t)', -100))} AS labels,
       {_ids_str(_left(f'([-100] || s || {_rep(-100, "len(t)")})', -100))} AS regu_src,
       {_ids_str(_left(f'(([{CLS}] || t || {_rep(-100, "len(s)")})[1:len(s) + len(t) + 1])', -100))} AS target_ref
FROM (SELECT guid, s_ids[1:{_C8}] || [{SEP}] AS s, t_ids[1:{_C8}] || [{SEP}] AS t FROM whole) x""", WHOLE_CTE))
def i08_causal(spark, sf):
    """Left-padded ``CLS src SEP trg EOS`` of every well-formed pair, labels on the target
    (EOS = SEP here), with the source and target references."""
    d = _whole(spark, sf).select("guid", L.causal("s_ids", "t_ids", MAXS, CLS, SEP, SEP, PAD).alias("l"))
    return d.select("guid", *[_str(f"l.{c}").alias(c) for c in ("input_ids", "labels", "regu_src", "target_ref")])


@register("g10_arrows", O.with_base("pairs", f"""
SELECT guid, array_to_string(inter, ' ') AS interleaved,
       CASE WHEN len(inter) % 3 = 0 THEN array_to_string(list_filter(inter, lambda v, i: i % 3 = 0), '') END AS recovered
FROM (SELECT guid, flatten(list_transform(range(1, least(len(cs), len(ct)) + 1), lambda i: [cs[i], '>', ct[i]])) AS inter
      FROM (SELECT guid, {x_chars('src')} AS cs, {x_chars('tgt')} AS ct FROM pairs) a) b"""))
def g10_arrows(spark, sf):
    """G10 + G11: arrow interleave of src/tgt characters and recovery of every third item."""
    p = D.pairs(spark, sf)
    inter = arrow_interleave(F.when(F.col("src") == "", F.array().cast("array<string>")).otherwise(F.split("src", "")),
                             F.when(F.col("tgt") == "", F.array().cast("array<string>")).otherwise(F.split("tgt", "")))
    d = p.select("guid", inter.alias("inter"))
    return d.select("guid", F.array_join("inter", " ").alias("interleaved"),
                    F.array_join(arrow_recover("inter"), "").alias("recovered"))


@register("c05_align", O.with_base("triples", f"""
SELECT status, count(*) AS n FROM (
  SELECT CASE WHEN s.guid IS NULL THEN 'missing_source' WHEN t.guid IS NULL THEN 'missing_target'
              WHEN p.guid IS NULL THEN 'missing_prediction' ELSE 'ok' END AS status
  FROM (SELECT guid FROM triples) s
  FULL JOIN (SELECT guid FROM triples) t ON s.guid = t.guid
  FULL JOIN (SELECT guid FROM triples WHERE {H('k', 'answered')} % 17 <> 0) p ON coalesce(s.guid, t.guid) = p.guid) x
GROUP BY status"""))
def c05_align(spark, sf):
    """Sources, targets and predictions (one in 17 unanswered) aligned by guid with a
    full outer join; missing predictions are reported, not dropped."""
    t = D.triples(spark, sf)
    src = t.select("guid", F.when(F.length("src") > 1, F.col("src")).alias("src"))  # null texts are still there
    trg = t.select("guid", "tgt")
    answered = F.pmod(rng.hash32(F.col("k"), rng.purpose("answered", D.SEED)), F.lit(17)) != 0
    pred = t.where(answered).select("guid", "pred")
    return A.align(src, trg, pred).groupBy("status").agg(F.count(F.lit(1)).alias("n"))
