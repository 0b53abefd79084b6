"""Queries: config selection, confusion-set reports, written-file scans, more layouts,
decode helpers, mask variants, cycles, tokenizer hook, truncation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rng
from ..functions.text import simple_difference, strip_prefix
from ..operators import align as A
from ..operators import clean as C
from ..operators import layouts as L
from ..operators import mask as MK
from ..operators import metrics as M
from ..operators import mix as MX
from ..operators import noise as N
from ..operators import reports as R
from ..operators import runs as RU
from ..operators import udf as U
from ..session import scratch_path
from ..sources import derived as D
from ..sources import readers as RD
from . import oracle as O
from .q_features import CLS, MASK, PAD, SEP, _batch, _ids_str, _rep, _str, batch_cte
from .q_tables import RUNS, _runs
from .queries import register

H = O.H
MAXS = D.MAX_SEQ


# ------------------------------------------------------------------ E04 config selection

@register("e04_select_config", f"""WITH {RUNS},
sp AS (SELECT *, CASE WHEN {H('CAST(step AS VARCHAR)', 'split')} % 2 = 0 THEN 'dev' ELSE 'test' END AS split FROM runs),
dev AS (SELECT event_type, run, CAST(sum(cents) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS dev_score FROM sp WHERE split = 'dev' GROUP BY ALL),
test AS (SELECT event_type, run, CAST(sum(cents) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS test_score FROM sp WHERE split = 'test' GROUP BY ALL),
j AS (SELECT coalesce(dev.event_type, test.event_type) AS event_type, coalesce(dev.run, test.run) AS run, dev_score, test_score
      FROM dev FULL JOIN test ON dev.event_type = test.event_type AND dev.run = test.run),
pick AS (SELECT event_type, arg_max(run, struct_pack(s := dev_score, r := run)) FILTER (WHERE dev_score IS NOT NULL) AS by_dev,
                arg_max(run, struct_pack(s := test_score, r := run)) FILTER (WHERE test_score IS NOT NULL) AS by_test FROM j GROUP BY event_type)
SELECT p.event_type, p.by_dev AS dev_run, a.dev_score, a.test_score AS reported_test, p.by_test AS leaky_run, b.test_score AS leaky_test
FROM pick p LEFT JOIN j a ON a.event_type = p.event_type AND a.run = p.by_dev
            LEFT JOIN j b ON b.event_type = p.event_type AND b.run = p.by_test""")
def e04_select_config(spark, sf):
    """Per event type choose the run (config) by its dev score only and report its test
    score; the leaky choice by test score side by side. Scores in exact hundredths."""
    r = _runs(spark, sf)
    r = r.withColumn("split", F.when(F.pmod(rng.hash32(F.col("step").cast("string"), rng.purpose("split", D.SEED)),
                                            F.lit(2)) == 0, "dev").otherwise("test"))
    out = RU.select_config(r, "event_type", ["run"], "split", "cents")
    return out.select("event_type", "dev_run", "dev_score", "reported_test", "leaky_run", "leaky_test")


# ------------------------------------------------------------------ D18 / F03 confusion reports

def _mined_plus_rules(spark, sf):
    pairs = M.error_pairs(D.pairs(spark, sf))  # (wrong, right, n)
    from pyspark.sql import Window
    w = Window.partitionBy("right").orderBy(F.col("n").desc(), F.col("wrong"))
    mined = pairs.select(F.lit("mined").alias("kind"), F.col("right").alias("ch"),
                         (F.row_number().over(w) - 1).cast("int").alias("idx"), F.col("wrong").alias("cand"))
    return D.confusion_df(spark).unionByName(mined).unionByName(
        D.confusion_df(spark).where(F.col("kind") == "shape").withColumn("kind", F.lit("mined")).withColumn("idx", F.col("idx") + 1000))


_MINED_SQL = """ep AS (SELECT substr(src, i, 1) AS wrong, substr(tgt, i, 1) AS "right", count(*) AS n
  FROM (SELECT src, tgt, unnest(range(1, least(length(src), length(tgt)) + 1)) AS i FROM pairs WHERE src <> tgt) a
  WHERE substr(src, i, 1) <> substr(tgt, i, 1) GROUP BY ALL),
allc AS (SELECT kind, ch, idx, cand FROM conf
  UNION ALL SELECT 'mined', "right", CAST(row_number() OVER (PARTITION BY "right" ORDER BY n DESC, wrong) - 1 AS INTEGER), wrong FROM ep
  UNION ALL SELECT 'mined', ch, idx + 1000, cand FROM conf WHERE kind = 'shape')"""


@register("d18_confusion_report", O.with_base("pairs", """
SELECT kind, count(*) AS n_chars, sum(_n) AS n_candidates, sum(_n - _nd) AS n_duplicates, sum(_self) AS n_self,
       sum(_oov) AS n_oov, max(_n) AS max_candidates
FROM (SELECT kind, ch, count(*) AS _n, count(DISTINCT cand) AS _nd, count_if(cand = ch) AS _self,
             count_if(NOT (unicode(cand) BETWEEN 33 AND 126)) AS _oov FROM allc GROUP BY kind, ch) t
GROUP BY kind""", _MINED_SQL))
def d18_confusion_report(spark, sf):
    """Quality of the rule confusion set plus a set mined from the data's error pairs
    (duplicates, self-mappings, candidates outside the vocabulary, sizes)."""
    return R.confusion_report(_mined_plus_rules(spark, sf), D.vocab(spark)).select(
        "kind", "n_chars", "n_candidates", "n_duplicates", "n_self", "n_oov", "max_candidates")


@register("f03_dedupe_confusion", O.with_base("pairs", """
SELECT kind, ch, CAST(row_number() OVER (PARTITION BY kind, ch ORDER BY idx) - 1 AS INTEGER) AS idx, cand
FROM (SELECT kind, ch, cand, min(idx) AS idx FROM allc WHERE cand <> ch GROUP BY kind, ch, cand) t""", _MINED_SQL))
def f03_dedupe_confusion(spark, sf):
    """distinct candidates per (kind, char), first index kept, self-mappings removed."""
    return R.dedupe_confusion(_mined_plus_rules(spark, sf))


# ------------------------------------------------------------------ A04 + F01 over written files

_YEARS = {"13": "documents", "14": "conversations", "15": "benchmark"}


@register("f01_sighan_union", "SELECT year, valid, count(*) AS n FROM (" + " UNION ALL ".join(
    f"SELECT '{y}' AS year, {H(f'CAST({k} AS VARCHAR)', 'cut')} % 13 <> 0 AS valid FROM {t}"
    for y, (t, k) in {"13": ("documents", "doc_id"), "14": ("conversations", "CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR)"),
                      "15": ("benchmark", "item_id")}.items()) + ") u GROUP BY year, valid")
def f01_sighan_union(spark, sf):
    """A04 + F01: three {source, target} JSONL files (one per table, one line in 13 cut)
    written to the shared folder, scanned together; per-file valid and format counts."""
    root = scratch_path(spark, "sighan")
    srcs = {
        "13": D.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("key"), "text"),
        "14": D.table(spark, sf, "conversations").select(F.concat_ws(":", F.col("conv_id").cast("string"),
                                                                     F.col("turn").cast("string")).alias("key"), "text"),
        "15": D.table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("key"), "text"),
    }
    paths = []
    for year, df in srcs.items():
        js = F.to_json(F.struct(F.col("text").alias("source"), F.col("text").alias("target")))
        cut = F.pmod(rng.hash32(F.col("key"), rng.purpose("cut", D.SEED)), F.lit(13)) == 0
        line = F.when(cut, F.substring(js, 1, 10)).otherwise(js)
        path = f"{root}/rSIGHAN{year}"
        df.select(line.alias("value")).write.text(path)
        paths.append(path)
    st = RD.read_source_target(spark, paths)
    year = F.regexp_extract("file_path", "rSIGHAN([0-9]+)", 1)
    return st.groupBy(year.alias("year"), "valid").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ I02, I05, I12 layouts

_B = MAXS // 2 - 2


def _pad(a: str, v: int) -> str:
    """Right pad or cut to MAXS."""
    return f"({a} || {_rep(v, f'{MAXS} - len({a})')})[1:{MAXS}]"


@register("i02_batch_layout", O.with_base("pairs", f"""
SELECT guid, {_ids_str('inp')} AS src_ids, {_ids_str('lab')} AS trg_ids, {_ids_str('ref')} AS trg_ref_ids,
       {_ids_str('list_transform(range(1, len(inp) + 1), lambda i: CASE WHEN inp[i] = lab[i] THEN -100 ELSE lab[i] END)')} AS loss_labels
FROM (SELECT guid,
        {_pad(f"([{CLS}] || s || [{SEP}] || {_rep(MASK, 'len(t)')} || [{SEP}])", PAD)} AS inp,
        {_pad(f"([{CLS}] || s || [{SEP}] || t || [{SEP}])", PAD)} AS lab,
        {_pad(f"([{CLS}] || t || [{SEP}] || t || [{SEP}])", PAD)} AS ref
      FROM (SELECT guid, s_ids AS s, t_ids AS t FROM batch) x) y""", batch_cte(_B)))
def i02_batch_layout(spark, sf):
    """B07 + I02 + I12: batch rephrase layout of every well-formed pair (both sides cut to max//2-2,
    listed ids dropped, pairs left unequal skipped) with label and reference arrays; loss labels
    are -100 wherever the input equals the label."""
    t = _batch(spark, sf, _B)
    lay = L.rephrase_batch("s_ids", "t_ids", MAXS, CLS, SEP, MASK, PAD)
    d = t.select("guid", lay.alias("l"))
    return d.select("guid", _str("l.src_ids").alias("src_ids"), _str("l.trg_ids").alias("trg_ids"),
                    _str("l.trg_ref_ids").alias("trg_ref_ids"),
                    _str(L.loss_labels("l.src_ids", "l.trg_ids")).alias("loss_labels"))


_P = 3
_CAP5 = MAXS // 2 - _P


_FIT5 = f"1 + {_P} + len(s) + {_P} + len(t) + 1 <= {MAXS}"


def _i05_sql(first: str, last: str) -> str:
    seq = f"([{CLS}] || {_rep(CLS, str(_P))} || {first} || {_rep(SEP, str(_P))} || {last} || [{SEP}])"
    return f"CASE WHEN {_FIT5} THEN {_ids_str(_pad(seq, PAD))} END"


@register("i05_prompted_layout", O.with_base("pairs", f"""
SELECT guid, {_FIT5} AS fits, {_i05_sql('s', _rep(MASK, 'len(t)'))} AS src_ids, {_i05_sql('s', 't')} AS trg_ids,
       {_i05_sql('t', 't')} AS trg_ref_ids,
       CASE WHEN {_FIT5} THEN {_ids_str(_pad(f"([0] || {_rep(1, str(_P))} || {_rep(0, 'len(s)')} || {_rep(1, str(_P))} || {_rep(0, 'len(t) + 1')})", 0))} END AS block_flag
FROM (SELECT guid, s_ids AS s, t_ids AS t FROM batch) x""", batch_cte(_CAP5)))
def i05_prompted_layout(spark, sf):
    """Prompted rephrase layout with prompt length 3, block flags, labels and reference;
    rows that would exceed max_seq are rejected (``fits`` false, null arrays), not cut."""
    t = _batch(spark, sf, _CAP5)
    d = t.select("guid", L.prompted_rephrase("s_ids", "t_ids", MAXS, _P, CLS, SEP, MASK, PAD).alias("l"))
    return d.select("guid", F.col("l.fits").alias("fits"), *[_str(f"l.{c}").alias(c) for c in
                                                            ("src_ids", "trg_ids", "trg_ref_ids", "block_flag")])


@register("g14_decode", O.with_base("pairs", f"""
SELECT guid, array_to_string(t_ids, ' ') AS at_mask, array_to_string(t_ids, ' ') AS by_offset FROM batch""", batch_cte(_B)))
def g14_decode(spark, sf):
    """A model output (here the layout's own labels) read back at the MASK positions
    (G13/G14) and by offset n_src+2 (G15); both must give the target ids of every pair."""
    t = _batch(spark, sf, _B)
    f = t.select("guid", F.size("s_ids").alias("n"), L.rephrase_batch("s_ids", "t_ids", MAXS, CLS, SEP, MASK, PAD).alias("l"))
    return f.select("guid", _str(A.gather_at_mask("l.src_ids", F.col("l.trg_ids"), F.lit(MASK))).alias("at_mask"),
                    _str(A.gather_offset(F.col("l.trg_ids"), F.col("n"), F.col("n"))).alias("by_offset"))


@register("h05_any_mask_report", O.with_base("pairs", f"""
SELECT lang, count(*) AS n_rows, sum(len(c)) AS n_candidates, sum(n_masked) AS n_masked,
       CASE WHEN sum(len(c)) > 0 THEN CAST(sum(n_masked) AS DOUBLE) / CAST(sum(len(c)) AS DOUBLE) ELSE 0.0 END AS mask_rate
FROM (SELECT lang, c, len(list_filter(c, lambda i:
        CAST({H("guid || ':' || CAST(i AS VARCHAR)", 'mask')} AS DOUBLE) / 4294967296.0 < 0.15)) AS n_masked
      FROM (SELECT lang, guid, list_filter(range(1, len(s_ids) + 1), lambda i: s_ids[i] > 4) AS c FROM batch) x) a
GROUP BY lang""", batch_cte(_B)))
def h05_any_mask_report(spark, sf):
    """Any non-special position masked at rate 0.15, realised rate per domain (UNK
    counts as special, as in a BERT tokenizer's special-token mask)."""
    t = _batch(spark, sf, _B)
    f = t.select("guid", "lang", L.rephrase_batch("s_ids", "t_ids", MAXS, CLS, SEP, MASK, PAD).alias("l")).select(
        "guid", "lang", F.col("l.src_ids").alias("input_ids"))
    f = f.withColumn("special", F.transform("input_ids", lambda x: x <= MASK))
    m = MK.any_position_mask(f, "guid", "special", 0.15, MASK, seed=D.SEED)
    cand = F.transform("special", lambda s: ~s)
    return MK.mask_report(m.withColumn("cand", cand), "cand", "selected", ["lang"])


_CYC_SQL, _CYC_LAST = O.noise_ctes("cyc", "tgt", "src", prefix="m")


@register("j03_cycles", O.with_base("sent", f"""
SELECT cycle, count(*) AS n, count_if(src <> tgt) AS n_changed, count_if(noise_pos IS NOT NULL) AS n_noised
FROM {_CYC_LAST} GROUP BY cycle""", "cyc AS (SELECT * REPLACE (k || '#' || CAST(c AS VARCHAR) AS k), c AS cycle FROM sent, range(3) r(c)),\n" + _CYC_SQL))
def j03_cycles(spark, sf):
    """J03 + H01: three cycles over the corpus; every cycle draws fresh noise (the cycle is
    part of the row key), the data is never copied to the driver."""
    s = MX.cycles(D.sentences(spark, sf), 3)
    s = s.withColumn("k", F.concat(F.col("k"), F.lit("#"), F.col("cycle").cast("string")))
    p = N.inject_noise(s, "tgt", "k", D.confusion_df(spark), D.words_df(spark), len(D.ALPHABET),
                       seed=D.SEED, char_class=D.CHAR_CLASS, out_col="src")
    return p.groupBy("cycle").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("src") != F.col("tgt")).alias("n_changed"),
                                  F.count_if(F.col("noise_pos").isNotNull()).alias("n_noised"))


@register("m02_tokenizer_hook", O.with_base("sent", """
SELECT lang, count(*) AS n_lines, sum(len(list_filter(string_split(line, ' '), lambda w: w <> ''))) AS n_tokens
FROM sent GROUP BY lang"""))
def m02_tokenizer_hook(spark, sf):
    """A user tokenizer (here Python's whitespace split) as an Arrow-batched pandas UDF."""
    tok = U.tokenizer_udf(lambda x: x.split())
    s = D.sentences(spark, sf).select("lang", tok(F.col("line")).alias("toks"))
    return s.groupBy("lang").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.size("toks")).alias("n_tokens"))


@register("b06_truncate", O.with_base("sent", f"""
SELECT lang, count_if(length(tgt) > {_B}) AS n_cut, sum(least(length(tgt), {_B})) AS n_tokens_kept FROM sent GROUP BY lang"""))
def b06_truncate(spark, sf):
    """B05 + B06: both sides cut to the batch slot capacity max//2-2; rows cut and tokens kept."""
    cap = C.slots(MAXS, "batch")
    s = D.sentences(spark, sf).withColumn("tokens", F.split("tgt", "")).withColumn(
        "tokens", F.when(F.col("tgt") == "", F.array().cast("array<string>")).otherwise(F.col("tokens")))
    cut = C.truncate_pairs(s.withColumn("orig", F.size("tokens")), cap, ["tokens"])
    return cut.groupBy("lang").agg(F.count_if(F.col("orig") > cap).alias("n_cut"),
                                   F.sum(F.size("tokens")).alias("n_tokens_kept"))


@register("g09_strip_prefix", """WITH tp AS (SELECT u.conv_id, u.turn, u.text AS src, a.text AS trg FROM conversations u
  JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user')
SELECT conv_id, turn, src || '->' || chr(10) || trg || chr(10) AS difference, trg AS stripped FROM tp""")
def g09_strip_prefix(spark, sf):
    """G04 + G09: simple difference text of a turn pair, and the generated continuation
    recovered by stripping the prompt prefix from prompt + response."""
    from .q_features import _turn_pairs
    tp = _turn_pairs(spark, sf)
    return tp.select("conv_id", "turn", simple_difference("src", "trg").alias("difference"),
                     strip_prefix(F.concat("src", "trg"), "src").alias("stripped"))

