"""Queries: file-based TSV scan with guids, simple filters, classification layouts, eval
records, causal split, anchor removal, streaming noise + running evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rng
from ..operators import align as A
from ..operators import clean as C
from ..operators import layouts as L
from ..operators import metrics as M
from ..operators import mix as MX
from ..operators import vocab as V
from ..session import constant_table, scratch_path
from ..sources import derived as D
from ..sources import readers as RD
from ..streaming import stream as K
from . import oracle as O
from .q_features import CLS, MASK, PAD, SEP, WHOLE_CTE, _batch, _clean_sql, _ids_sql, _ids_str, _rep, _str, _whole, batch_cte
from .q_sources import EVAL_CTE, LENIENT_CTE, NOTOK, TSV_CTE, WATERFALL_CTE, _eval_classified, _ws_clean, _ws_count, classified
from .queries import SAFE_SELECT, _counts_sql, _FLAGS_EXACT, register

H = O.H
MAXS = D.MAX_SEQ


# ------------------------------------------------------------------ B01 over a written TSV file

@register("b01_tsv_file_guid", O.with_base("pairs", f"""
SELECT 'train-' || CAST(row_number() OVER (ORDER BY doc_id, sent_no) - 1 AS VARCHAR) AS guid,
       len(parts) = 2 AS valid,
       CASE WHEN len(parts) = 2 THEN {_ws_count('parts[1]')} END AS n_src,
       CASE WHEN len(parts) = 2 THEN {_ws_clean('parts[2]')} END AS trg_text
FROM (SELECT doc_id, sent_no, string_split(regexp_replace(line, '^\\s+|\\s+$', '', 'g'), chr(9)) AS parts FROM tl) t""", TSV_CTE))
def b01_tsv_file_guid(spark, sf):
    """A01 + E05 + B01: TSV lines written as files (in line order), scanned by the strict
    reader (PERMISSIVE); guid = ``train-{line index}`` counted before any filter."""
    lines = D.tsv_lines(spark, sf)
    path = scratch_path(spark, "tsv")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (lines.repartitionByRange(n, "doc_id", "sent_no").sortWithinPartitions("doc_id", "sent_no")
     .select(F.col("line").alias("value")).write.text(path))
    p = RD.read_pairs_tsv(spark, path, "train", "PERMISSIVE")
    return p.select("guid", "valid", F.size("src_tokens").alias("n_src"),
                    F.array_join("trg_tokens", " ").alias("trg_text"))


@register("b02_equal_length", O.with_base("pairs", """
SELECT lang, count(*) AS n_kept FROM lp WHERE valid AND len(st) = len(tt) GROUP BY lang""", LENIENT_CTE))
def b02_equal_length(spark, sf):
    """Lenient pairs whose token lists have equal length (the silent filter)."""
    p = RD.with_tsv_lenient(D.tsv_lines(spark, sf), "line", ["lang"])
    kept = C.filter_equal_length(p.where("valid"), "src_tokens", "tgt_tokens")
    return kept.groupBy("lang").agg(F.count(F.lit(1)).alias("n_kept"))


@register("b07_filter_unk", O.with_base("pairs", """
SELECT lang, count(*) AS n_pairs, count_if(NOT list_contains(s_ids, 1) AND NOT list_contains(t_ids, 1)) AS n_without_unk
FROM whole GROUP BY lang""", WHOLE_CTE))
def b07_filter_unk(spark, sf):
    """Well-formed pairs, and those left after dropping pairs with an UNK id."""
    ids = _whole(spark, sf).withColumn("_ok", C.without_ids(["s_ids", "t_ids"], 1))
    return ids.groupBy("lang").agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if("_ok").alias("n_without_unk"))


@register("b13_after_step", O.with_base("pairs", f"""
SELECT shard, count(*) AS n_rows FROM (
  SELECT shard, (row_number() OVER (PARTITION BY shard ORDER BY {H("guid || ':0'", 'shuffle')}, guid) - 1) // 32 AS batch_id
  FROM (SELECT guid, reason, (row_number() OVER (ORDER BY doc_id, sent_no) - 1) % 4 AS shard FROM wc) a
  WHERE reason = 'accepted') b
WHERE batch_id >= 2 * 3 GROUP BY shard""", WATERFALL_CTE))
def b13_after_step(spark, sf):
    """Resume at step 2 with gradient accumulation 3: the first 6 batches per shard
    are skipped."""
    from ..plans.indexing import row_index
    c = classified(spark, sf).select("doc_id", "sent_no", "guid", "reason")  # the index moves no text
    c = row_index(c, ["doc_id", "sent_no"], out_col="raw_idx")
    c = MX.with_shard(c, "raw_idx", 4).where(F.col("reason") == "accepted")
    b = MX.with_batch(c, "guid", 32, D.SEED, "shard")
    return C.after_step(b, 2, 3).groupBy("shard").agg(F.count(F.lit(1)).alias("n_rows"))


# ------------------------------------------------------------------ I06 / I07 with C03 / C04

_LABEL_WORDS = [("quality", "1", 0, 0, "y"), ("quality", "1", 0, 1, "e"), ("quality", "1", 0, 2, "s"),
                ("quality", "0", 1, 0, "n"), ("quality", "0", 1, 1, "o")]


def _doc_ids(spark, sf, limit):
    """Labelled documents with the ids of their text's first ``limit`` tokens."""
    cv = V.CharVocab(D.vocab(spark))
    lab = D.table(spark, sf, "labels").select("doc_id", F.col("quality").cast("string").alias("label"))
    docs = D.table(spark, sf, "documents").select("doc_id", "text", "source")
    return lab.join(docs, "doc_id").select("doc_id", "label", cv.encode("text", limit).alias("ids"),
                                           cv.encode("source").alias("b_ids"))


_DOC_IDS_SQL = f"""dl AS (SELECT l.doc_id, CAST(l.quality AS VARCHAR) AS label,
    {_ids_sql("regexp_replace(d.text, '" + NOTOK + "', '', 'g')")} AS ids, {_ids_sql('d.source')} AS b_ids
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""
_T6 = MAXS - 20  # leaves room for the second sentence


@register("i06_classification", f"""WITH {_DOC_IDS_SQL},
lt(label, label_id) AS (VALUES ('0', 0), ('1', 1)),
x AS (SELECT doc_id, label_id, [{CLS}] || ids[1:{_T6}] || [{SEP}] AS a, b_ids || [{SEP}] AS b FROM dl JOIN lt USING (label))
SELECT doc_id, label_id, {_ids_str(f"(a || b || {_rep(PAD, MAXS)})[1:{MAXS}]")} AS src_ids,
       {_ids_str(f"({_rep(0, 'len(a)')} || {_rep(1, 'len(b)')} || {_rep(0, MAXS)})[1:{MAXS}]")} AS token_type_ids,
       {_ids_str(_rep('label_id', MAXS))} AS trg_ids, CAST(3 AS INTEGER) AS task_id,
       CAST(least(len(a) + len(b), {MAXS}) AS INTEGER) AS n_attended
FROM x""")
def i06_classification(spark, sf):
    """C03 + I06: two-sentence classification layout (the document's text, cut, and its source's
    name) with segment ids, task id and the label id repeated over the sequence."""
    d = V.label_id_or_fail(_doc_ids(spark, sf, _T6), V.label_table(spark, "quality", ["0", "1"]))
    out = d.select("doc_id", "label_id", L.classification("ids", "b_ids", "label_id", MAXS, CLS, SEP, PAD, task_id=3).alias("l"))
    return out.select("doc_id", "label_id", *[_str(f"l.{c}").alias(c) for c in ("src_ids", "token_type_ids", "trg_ids")],
                      F.col("l.task_id").alias("task_id"),
                      F.aggregate("l.attention_mask", F.lit(0), lambda a, x: a + x).alias("n_attended"))


_P7 = 2
_TOTAL7 = MAXS + _P7 + 2


def _p7(a: str, fill: int) -> str:
    return _ids_str(f"({a} || {_rep(fill, _TOTAL7)})[1:{_TOTAL7}]")


@register("i07_prompted_classification", f"""WITH {_DOC_IDS_SQL},
lw(label, label_id, word_pos, word) AS (VALUES {", ".join(f"('{l}', {i}, {p}, '{w}')" for _, l, i, p, w in _LABEL_WORDS)}),
lwi AS (SELECT label, label_id, list(unicode(word) - 28 ORDER BY word_pos) AS wids FROM lw GROUP BY label, label_id),
x AS (SELECT doc_id, label_id, wids, len(wids) AS m, [{CLS}] || ids[1:{MAXS - 2}] || [{SEP}] AS t FROM dl JOIN lwi USING (label))
SELECT doc_id, {_ids_str('wids')} AS label_word_ids,
  {_p7(f"t || {_rep(SEP, str(_P7))} || {_rep(MASK, 'm')}", PAD)} AS src_ids,
  {_p7(f"{_rep(0, 'len(t)')} || {_rep(1, str(_P7))}", 0)} AS prompt_mask,
  {_p7(f"{_rep(-100, f'len(t) + {_P7}')} || {_rep(1, 'm')}", -100)} AS active_bits,
  {_p7('[label_id]', 0)} AS trg_ids
FROM x""")
def i07_prompted_classification(spark, sf):
    """C04 + I07: prompted classification ``<text> <pt> <mask>``: one mask slot per word of the label
    ("yes" / "no"), prompt mask, active bits, label id first; the label's word ids beside them."""
    d = _doc_ids(spark, sf, MAXS - 2)
    words = constant_table(spark, _LABEL_WORDS, "task string, label string, label_id int, word_pos int, word string")
    d = V.label_id_or_fail(d, words.select("label", "label_id").distinct())
    d = V.with_label_words(d, words, D.vocab(spark), "label")
    lay = L.prompted_classification("ids", "label_id", F.size("label_word_ids"), MAXS, _P7, CLS, SEP, MASK, PAD)
    out = d.select("doc_id", "label_word_ids", lay.alias("l"))
    return out.select("doc_id", _str("label_word_ids").alias("label_word_ids"),
                      *[_str(f"l.{c}").alias(c) for c in ("src_ids", "prompt_mask", "active_bits", "trg_ids")])


# ------------------------------------------------------------------ I10 + G20, G16/G17

@register("i10_eval_records", O.with_base("pairs", f"""
SELECT guid, CAST(len(s_ids) AS INTEGER) AS n_src, CAST(len(t_ids) AS INTEGER) AS n_trg,
       CAST(2 * len(s_ids) + 3 AS INTEGER) AS n_attended,
       CAST(coalesce(list_sum(s_ids), 0) + {CLS} + 2 * {SEP} + {MASK} * len(t_ids) AS BIGINT) AS pred_sum,
       array_to_string(st, ' ') AS src_text, array_to_string(tt, ' ') AS trg_text
FROM (SELECT guid, st, tt, {_ids_sql(_clean_sql("array_to_string(st, '')"))} AS s_ids,
             {_ids_sql(_clean_sql("array_to_string(tt, '')"))} AS t_ids FROM ev WHERE reason = 'accepted') x""", EVAL_CTE))
def i10_eval_records(spark, sf):
    """I10 + G20: evaluation records (ids, attention = ids != PAD, n_src, n_trg, the original tokens)
    of the pairs that the evaluation waterfall accepts; a copy model's predictions zeroed where
    attention is 0 (their sum checks the zeroing)."""
    cv = V.CharVocab(D.vocab(spark))
    acc = _eval_classified(spark, sf).where(F.col("reason") == "accepted")
    ids = acc.select("guid", "src_tokens", "tgt_tokens", cv.encode(F.array_join("src_tokens", "")).alias("s_ids"),
                     cv.encode(F.array_join("tgt_tokens", "")).alias("t_ids"))
    rec = ids.select("guid", "src_tokens", "tgt_tokens", L.eval_record("s_ids", "t_ids", MAXS, CLS, SEP, MASK, PAD).alias("r"))
    preds = A.zero_unattended(F.transform("r.input_ids", lambda x: x + F.lit(0)), "r.attention_mask")
    return rec.select("guid", F.col("r.n_src").alias("n_src"), F.col("r.n_trg").alias("n_trg"),
                      F.aggregate("r.attention_mask", F.lit(0), lambda a, x: a + x).alias("n_attended"),
                      F.aggregate(preds, F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint")).alias("pred_sum"),
                      F.array_join("src_tokens", " ").alias("src_text"), F.array_join("tgt_tokens", " ").alias("trg_text"))


@register("g17_causal_split", O.with_base("pairs", f"""
SELECT guid, CAST(pad + 2 + len(s) AS INTEGER) AS prompt_len, {_ids_str("t || [" + str(SEP) + "]")} AS target
FROM (SELECT guid, s, t, greatest({MAXS} - (len(s) + len(t) + 3), 0) AS pad
      FROM (SELECT guid, s_ids[1:{MAXS // 2 - 2}] AS s, t_ids[1:{MAXS // 2 - 2}] AS t FROM whole) a) b""", WHOLE_CTE))
def g17_causal_split(spark, sf):
    """Causal rows of every well-formed pair split at the first label that is not -100
    (prompt vs target)."""
    ids = _whole(spark, sf)
    lay = ids.select("guid", L.causal("s_ids", "t_ids", MAXS, CLS, SEP, SEP, PAD).alias("c"))
    sp = A.split_causal("c.input_ids", "c.labels")
    return lay.select("guid", F.size(sp["prompt"]).alias("prompt_len"), _str(sp["target"]).alias("target"))


@register("g16_anchor_removal", O.with_base("pairs", f"""
SELECT guid, {_ids_str(_rep(MASK, 'len(t_ids)') + ' || [' + str(SEP) + ']')} AS after_anchor,
       CAST(len(s_ids) + 1 AS INTEGER) AS before_len
FROM batch""", batch_cte(MAXS // 2 - 2)))
def g16_anchor_removal(spark, sf):
    """G13 + G16: split the I02 input of every pair at the first SEP (before = CLS + source), then
    drop the one-item anchor ([SEP]) from the part after it."""
    t = _batch(spark, sf, MAXS // 2 - 2)
    f = t.select("guid", L.rephrase_batch("s_ids", "t_ids", MAXS, CLS, SEP, MASK, PAD).alias("l"))
    unpadded = F.filter("l.src_ids", lambda x: x != PAD)
    sp = A.split_at_first(F.transform(unpadded, lambda x: x.cast("string")), str(SEP))
    rest = A.remove_anchor(sp["after"], 1)
    return f.select("guid", F.array_join(rest, " ").alias("after_anchor"), F.size(sp["before"]).alias("before_len"))


# ------------------------------------------------------------------ K05 + K06 on a stream

@register("k06_stream_eval", O.with_base("triples", SAFE_SELECT.format(by="lang, "), _FLAGS_EXACT + ",\n" + _counts_sql(["lang"])))
def k06_stream_eval(spark, sf):
    """K05 + K06: clean sentences arrive as JSONL files; the stream adds H01 noise online
    (stream-static broadcast joins), the rule corrector's output, and keeps running
    outcome counts per domain; ratios are computed on read of the final snapshot."""
    root = scratch_path(spark, "evalstream")
    s = D.sentences(spark, sf).select(F.to_json(F.struct("k", "lang", "tgt")).alias("value"))
    s.write.option("maxRecordsPerFile", 50_000).text(f"{root}/in")
    raw = spark.readStream.format("text").option("maxFilesPerTrigger", 64).load(f"{root}/in")
    rows = raw.select(F.from_json("value", "k string, lang string, tgt string").alias("r")).select("r.*")
    negative = F.pmod(rng.hash32(F.col("k"), rng.purpose("neg", D.SEED)), F.lit(5)) == 0
    from ..operators.noise import inject_noise
    noisy = inject_noise(rows, "tgt", "k", D.confusion_df(spark), D.words_df(spark), len(D.ALPHABET),
                         seed=D.SEED, char_class=D.CHAR_CLASS, out_col="src", apply=~negative)
    trip = noisy.withColumn("pred", D.stand_in_prediction())
    q = K.snapshot(K.running_eval(trip, ["lang"]), f"{root}/out", f"{root}/ckpt")
    q.awaitTermination()
    counts = spark.read.parquet(f"{root}/out")
    out = M.ratios(counts, "safe")
    return out.select("lang", "samples", "positives", "negatives", "tp", "fp", "fn", "wp", "prd_pos",
                      "precision", "recall", "f1", "fpr")

