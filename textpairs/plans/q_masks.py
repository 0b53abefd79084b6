"""Queries: instruction layout with reference masking (I09, H09) and the mask variants
H06 (equal positions), H07 (joint draw on a second array), H08 (task-gated)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean as C
from ..operators import layouts as L
from ..operators import mask as MK
from ..operators import prompts as P
from ..operators import vocab as V
from ..sources import derived as D
from . import oracle as O
from .q_features import CLS, MASK, PAD, SEP, _batch, _ids_sql, _ids_str, _rep, _str, _turn_pairs, batch_cte
from .q_sources import NOTOK
from .queries import register

H = O.H
MAXS = D.MAX_SEQ
MAXI = 256  # instruction rows: four parts and EOS seldom exceed it; the rest is counted in overflow
PART, PARTI = MAXS // 2 - 2, MAXI // 2 - 2
INSTR, DETECT = "Correct the text", C.DETECTION_INSTRUCTIONS[0]
RATE = 0.2


def _part_sql(text: str) -> str:
    return f"({_ids_sql(f'regexp_replace({text}, {chr(39)}{NOTOK}{chr(39)}, {chr(39)}{chr(39)}, {chr(39)}g{chr(39)})')})[1:{PARTI}]"


_PREFIX = f"'Instruction:' || chr(10) || instr || chr(10) || chr(10) || 'Input:' || chr(10)"
_SUFFIX = "chr(10) || chr(10) || 'Response:' || chr(10)"
USER, ASSISTANT = 195, 196


def _fix(a: str, fill: int) -> str:
    return f"(({a}) || {_rep(fill, MAXI)})[1:{MAXI}]"


def _i09_sql(user: str, assistant: str) -> str:
    """One marker style: the marker ids before the prompt and before the response."""
    n = f"len({user}) + len(p) + len(i) + len(s) + len({assistant})"
    return f"""SELECT conv_id, turn, guid, total, {_fix(f"{user} || p || i || s || {assistant} || r || [{SEP}]", PAD)} AS ids,
      {_fix(f"{_rep(-100, n)} || r || [{SEP}]", -100)} AS lab,
      {_fix(f"{user} || {_rep(-100, 'len(p)')} || (CASE WHEN detect THEN {_rep(-100, 'len(i)')} ELSE i END) || {_rep(-100, 'len(s)')} || {assistant} || {_rep(-100, 'len(r)')} || [{SEP}]", PAD)} AS ref
    FROM (SELECT *, {n} + len(r) + 1 AS total FROM x) x0"""


@register("i09_instruction_mask", f"""WITH tp AS (SELECT u.conv_id, u.turn, u.text AS src, a.text AS trg FROM conversations u
  JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'),
tq AS (SELECT *, conv_id % 3 = 0 AS detect, CASE WHEN conv_id % 3 = 0 THEN '{DETECT}' ELSE '{INSTR}' END AS instr FROM tp),
x AS (SELECT conv_id, turn, detect, CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS guid,
             {_part_sql(_PREFIX)} AS p, {_part_sql('src')} AS i, {_part_sql(_SUFFIX)} AS s, {_part_sql('trg')} AS r FROM tq),
y AS (SELECT 'plain' AS style, * FROM ({_i09_sql('[]::INTEGER[]', '[]::INTEGER[]')}) a
      UNION ALL SELECT 'marked', * FROM ({_i09_sql(f'[{USER}]', f'[{ASSISTANT}]')}) b),
z AS (SELECT *, list_filter(range(0, {MAXI}), lambda k: ids[k + 1] > 4 AND ids[k + 1] = ref[k + 1]
      AND CAST({H("guid || ':' || CAST(k AS VARCHAR)", 'mask')} AS DOUBLE) / 4294967296.0 < {RATE}) AS hit FROM y)
SELECT style, conv_id, turn, CAST(greatest(total - {MAXI}, 0) AS INTEGER) AS overflow, {_ids_str('lab')} AS labels,
       {_ids_str('ref')} AS src_ref,
       {_ids_str(f'list_transform(range(0, {MAXI}), lambda k: CASE WHEN list_contains(hit, k) THEN {MASK} ELSE ids[k + 1] END)')} AS input_ids
FROM z""")
def i09_instruction_mask(spark, sf):
    """B09 + G07 + I09 + H09: instruction-tuning rows in both marker styles (prefix, input, suffix,
    response, each cut to max//2-2, EOS), one conversation in three with a detect instruction;
    labels only on the response, and the reference-masked MFT draw over the positions equal to the
    reference (specials and UNK excluded). Whole arrays are returned, masked input included."""
    cv = V.CharVocab(D.vocab(spark))
    tp = _turn_pairs(spark, sf)
    instr = F.when(F.col("conv_id") % 3 == 0, F.lit(DETECT)).otherwise(F.lit(INSTR))
    d = tp.select("conv_id", "turn", F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("guid"),
                  C.instruction_type(instr).alias("itype"),
                  cv.encode(F.concat(F.lit(P.INSTRUCTION_PREFIX), instr, F.lit(P.INPUT_MARK)), PARTI).alias("p"),
                  cv.encode("src", PARTI).alias("i"), cv.encode(F.lit(P.RESPONSE_MARK), PARTI).alias("s"),
                  cv.encode("trg", PARTI).alias("r"))
    lay = lambda markers: L.instruction("p", "i", "s", "r", MAXI, SEP, PAD, F.col("itype") == "detect", markers)
    d = d.select("conv_id", "turn", "guid", F.explode(F.array(
        F.struct(F.lit("plain").alias("style"), lay(None).alias("l")),
        F.struct(F.lit("marked").alias("style"), lay((USER, ASSISTANT)).alias("l")))).alias("e"))
    d = d.select("conv_id", "turn", "guid", "e.style", "e.l.*")
    special = F.transform("input_ids", lambda x: x <= MASK)
    d = d.withColumn("cand", MK.reference_candidates("input_ids", "src_ref", special))
    m = MK.apply_mask(d, "guid", "cand", RATE, MASK, ids="input_ids", labels=None, targets=None, seed=D.SEED)
    return m.select("style", "conv_id", "turn", "overflow", *[_str(c).alias(c) for c in ("labels", "src_ref", "input_ids")])


@register("h06_h08_masks", O.with_base("pairs", f"""
SELECT lang, count(*) AS n_rows, sum(len(c)) AS n_candidates, sum(nm) AS n_masked, sum(nm) AS n_joint,
       sum(CASE WHEN lang = 'en' THEN nm ELSE 0 END) AS n_gated
FROM (SELECT lang, c, len(list_filter(c, lambda k: CAST({H("guid || ':' || CAST(k AS VARCHAR)", 'mask')} AS DOUBLE) / 4294967296.0 < {RATE})) AS nm
      FROM (SELECT lang, guid, list_filter(range(1, len(s_ids) + 1), lambda k: s_ids[k] > 4) AS c FROM batch) b) x
GROUP BY lang""", batch_cte(PART)))
def h06_h08_masks(spark, sf):
    """H06 + H07 + H08 on I02 rows of every well-formed pair: candidates are positions where input
    equals label and are not special (the source); one draw masks the input and a second array
    together (joint), and a task-gated run masks only task 1 (here: the en domain)."""
    ids = _batch(spark, sf, PART)
    lay = ids.select("guid", "lang", L.rephrase_batch("s_ids", "t_ids", MAXS, CLS, SEP, MASK, PAD).alias("l"))
    d = lay.select("guid", "lang", "l.src_ids", "l.trg_ids", F.col("l.trg_ref_ids").alias("noisy"))
    special = F.transform("src_ids", lambda x: x <= MASK)
    d = d.withColumn("cand", MK.reference_candidates("src_ids", "trg_ids", special)).withColumn("own", F.col("src_ids"))
    j = MK.apply_mask(d, "guid", "cand", RATE, MASK, ids="src_ids", labels=None, targets=None, seed=D.SEED, also=["noisy"])
    g = MK.apply_mask(j.withColumn("task_id", F.when(F.col("lang") == "en", 1).otherwise(2)), "guid", "cand", RATE,
                      MASK, ids="own", labels=None, targets=None, seed=D.SEED, when=F.col("task_id") == 1,
                      out_selected="sel_gated")
    cnt = lambda c: F.size(F.filter(c, lambda x: x))
    both = F.size(F.filter(F.arrays_zip(F.col("src_ids").alias("a"), F.col("noisy").alias("b")),
                           lambda z: (z["a"] == MASK) & (z["b"] == MASK)))
    return (g.select("lang", cnt("cand").alias("c"), cnt("selected").alias("m"), both.alias("j"), cnt("sel_gated").alias("g"))
            .groupBy("lang").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("c").alias("n_candidates"),
                                 F.sum("m").alias("n_masked"), F.sum("j").alias("n_joint"), F.sum("g").alias("n_gated")))
