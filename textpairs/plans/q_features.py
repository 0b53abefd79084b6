"""Queries: layouts, masks, batches, line index, streaming, hooks, prompts, mixing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import extract_response
from ..operators import clean as C
from ..operators import layouts as L
from ..operators import mask as MK
from ..operators import metrics as M
from ..operators import mix as MX
from ..operators import prompts as P
from ..operators import udf as U
from ..operators import vocab as V
from ..plans.indexing import line_index, row_index
from ..session import constant_table, scratch_path
from ..sources import derived as D
from ..sources import readers as RD
from ..sources import sinks as S
from ..streaming import stream as K
from . import oracle as O
from .q_sources import JSONL_CTE, NOTOK, WATERFALL_CTE, classified
from .queries import SAFE_SELECT, _counts_sql, _FLAGS_EXACT, register

H = O.H
CAP = C.slots(D.MAX_SEQ)
PAD, UNK, CLS, SEP, MASK = range(5)


def _ids_sql(x: str) -> str:
    return (f"list_transform({x_chars(x)}, lambda c: CASE WHEN unicode(c) BETWEEN 33 AND 126 "
            f"THEN unicode(c) - 28 ELSE 1 END)")


def x_chars(x: str) -> str:
    return f"(CASE WHEN {x} = '' THEN []::VARCHAR[] ELSE string_split({x}, '') END)"


def _rep(v: int, n: str) -> str:
    return f"list_transform(range(greatest({n}, 0)), lambda i: {v})"


def _ids_str(a: str) -> str:
    return f"array_to_string({a}, ' ')"


def _features(spark, sf):
    cv = V.CharVocab(D.vocab(spark))
    acc = C.encode_accepted(classified(spark, sf), cv)
    f = L.rephrase_stream("src_ids", "tgt_ids", D.MAX_SEQ, CLS, SEP, MASK, PAD)
    return acc.select("guid", "doc_id", "sent_no", "lang", "source", f.alias("f")).select(
        "guid", "doc_id", "sent_no", "lang", "source", "f.*")


DROPPED = [6]  # ids removed before a batch layout is built


def _whole(spark, sf, limit=None):
    """Ids of both sides of every well-formed pair, whole: the batch layouts cut for themselves. With
    ``limit`` only the first ids, for a layout that begins with that cut."""
    cv = V.CharVocab(D.vocab(spark))
    lines = D.jsonl_lines(spark, sf).select("guid", "lang", "line")
    return (RD.with_json_pair(lines, "line").where("valid")
            .select("guid", "lang", cv.encode("src", limit).alias("s_ids"), cv.encode("tgt", limit).alias("t_ids")))


def _batch(spark, sf, cap: int):
    """Pairs as the batch layouts take them: both sides cut, listed ids dropped, unequal ones skipped."""
    cut = [C.drop_ids(F.slice(c, 1, cap), DROPPED).alias(c) for c in ("s_ids", "t_ids")]
    w = RD.once(_whole(spark, sf, cap), ["guid", "lang"], *cut)
    return w.where(F.size("s_ids") == F.size("t_ids"))


def _clean_sql(x: str) -> str:
    return f"regexp_replace({x}, '{NOTOK}', '', 'g')"


WHOLE_CTE = JSONL_CTE + f""",
whole AS (SELECT guid, lang, {_ids_sql(_clean_sql('psrc'))} AS s_ids, {_ids_sql(_clean_sql('ptgt'))} AS t_ids FROM jv WHERE valid)"""


def batch_cte(cap: int) -> str:
    return WHOLE_CTE + f""",
batch AS (SELECT * FROM (
  SELECT guid, lang, list_filter(s_ids[1:{cap}], lambda i: i <> {DROPPED[0]}) AS s_ids,
         list_filter(t_ids[1:{cap}], lambda i: i <> {DROPPED[0]}) AS t_ids FROM whole) x WHERE len(s_ids) = len(t_ids))"""


FEAT_CTE = WATERFALL_CTE + f""",
acc AS (SELECT guid, doc_id, sent_no, lang, source, {_ids_sql('psrc')} AS s_ids, {_ids_sql('ptgt')} AS t_ids
        FROM wc WHERE reason = 'accepted'),
feat AS (SELECT *, len(s_ids) AS n FROM acc)"""


def _str(col: str):
    return F.array_join(F.transform(col, lambda x: x.cast("string")), " ")


@register("i01_layout", O.with_base("pairs", f"""
SELECT guid,
  {_ids_str(f"[{CLS}] || s_ids || [{SEP}] || {_rep(MASK, 'n')} || [{SEP}] || {_rep(PAD, f'{D.MAX_SEQ} - 2 * n - 3')}")} AS input_ids,
  {_ids_str(f"{_rep(-100, 'n + 2')} || t_ids || [-100] || {_rep(-100, f'{D.MAX_SEQ} - 2 * n - 3')}")} AS labels,
  CAST(2 * n + 3 AS INTEGER) AS n_attended,
  CAST(len(list_filter(range(1, n + 1), lambda i: s_ids[i] = t_ids[i])) AS INTEGER) AS n_mft_candidates
FROM feat""", FEAT_CTE))
def i01_layout(spark, sf):
    """I01 (+ C02 encode): fixed-length rephrase features of accepted pairs."""
    f = _features(spark, sf)
    return f.select("guid", _str("input_ids").alias("input_ids"), _str("labels").alias("labels"),
                    F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("n_attended"),
                    F.size(F.filter("mft_candidates", lambda x: x)).alias("n_mft_candidates"))


@register("h10_mask_report", O.with_base("pairs", f"""
SELECT lang, count(*) AS n_rows, sum(n_cand) AS n_candidates, sum(n_masked) AS n_masked,
       CASE WHEN sum(n_cand) > 0 THEN CAST(sum(n_masked) AS DOUBLE) / CAST(sum(n_cand) AS DOUBLE) ELSE 0.0 END AS mask_rate
FROM (SELECT lang, len(c) AS n_cand,
             len(list_filter(c, lambda i: CAST({H("guid || ':' || CAST(i AS VARCHAR)", 'mask')} AS DOUBLE) / 4294967296.0 < 0.3)) AS n_masked
      FROM (SELECT lang, guid, list_filter(range(1, n + 1), lambda i: s_ids[i] = t_ids[i]) AS c FROM feat) a) b
GROUP BY lang""", FEAT_CTE))
def h10_mask_report(spark, sf):
    """H03 (noerror) + H04 masking of I01 features, and the realised mask rate."""
    f = _features(spark, sf)
    cand = MK.mask_candidates("source_mask", "mft_candidates", "noerror")
    m = MK.apply_mask(f.withColumn("cand", cand), "guid", "cand", 0.3, MASK, seed=D.SEED)
    return MK.mask_report(m, "cand", "selected", ["lang"])


_MODES = {"noerror": "s_ids[i] = t_ids[i]", "error": "s_ids[i] <> t_ids[i]", "all": "TRUE"}


@register("h03_h04_masked_arrays", O.with_base("pairs", " UNION ALL ".join(f"""
SELECT '{mode}' AS mode, guid,
       {_ids_str(f"[{CLS}] || list_transform(range(1, n + 1), lambda i: CASE WHEN list_contains(hit, i) THEN {MASK} ELSE s_ids[i] END) || [{SEP}] || {_rep(MASK, 'n')} || [{SEP}] || {_rep(PAD, f'{D.MAX_SEQ} - 2 * n - 3')}")} AS input_ids,
       {_ids_str(f"[-100] || list_transform(range(1, n + 1), lambda i: CASE WHEN list_contains(hit, i) THEN t_ids[i] ELSE -100 END) || [-100] || t_ids || [-100] || {_rep(-100, f'{D.MAX_SEQ} - 2 * n - 3')}")} AS labels
FROM (SELECT *, list_filter(range(1, n + 1), lambda i: {cond}
      AND CAST({H("guid || ':' || CAST(i AS VARCHAR)", 'mask')} AS DOUBLE) / 4294967296.0 < 0.3) AS hit FROM feat) f"""
    for mode, cond in _MODES.items()), FEAT_CTE))
def h03_h04_masked_arrays(spark, sf):
    """H03 + H04: I01 features masked in all three modes; a masked position's label is the target
    id. Whole arrays."""
    f = _features(spark, sf).select("guid", F.explode(F.array(*[F.lit(m) for m in _MODES])).alias("mode"), "input_ids",
                                    "labels", "source_mask", "mft_candidates", "mft_targets")
    cand = F.coalesce(*[F.when(F.col("mode") == m, MK.mask_candidates("source_mask", "mft_candidates", m)) for m in _MODES])
    m = MK.apply_mask(f.withColumn("cand", cand), "guid", "cand", 0.3, MASK, seed=D.SEED)
    return m.select("mode", "guid", _str("input_ids").alias("input_ids"), _str("labels").alias("labels"))


@register("j04_batches", O.with_base("pairs", f"""
SELECT guid, shard, CAST(pos_in_shard // 32 AS BIGINT) AS batch_id, pos_in_shard
FROM (SELECT guid, shard, row_number() OVER (PARTITION BY shard ORDER BY {H("guid || ':0'", 'shuffle')}, guid) - 1 AS pos_in_shard
      FROM (SELECT guid, reason, (row_number() OVER (ORDER BY doc_id, sent_no) - 1) % 4 AS shard FROM wc) a
      WHERE reason = 'accepted') b""", WATERFALL_CTE))
def j04_batches(spark, sf):
    """B11 + J01 + J02 + J04: raw line index (all lines count), 4 shards, hash shuffle,
    consecutive batches of 32 per shard (exact numbering, no single-partition window)."""
    c = classified(spark, sf).select("doc_id", "sent_no", "guid", "reason")  # the index moves no text
    c = row_index(c, ["doc_id", "sent_no"], out_col="raw_idx")
    c = MX.with_shard(c, "raw_idx", 4).where(F.col("reason") == "accepted")
    b = MX.with_batch(c, "guid", 32, D.SEED, "shard")
    return b.select("guid", "shard", "batch_id", "pos_in_shard")


@register("e05_line_index", O.with_base("sent", """
SELECT row_number() OVER (ORDER BY doc_id, sent_no) - 1 AS line_idx, line FROM sent"""))
def e05_line_index(spark, sf):
    """The document lines written as text files (range-partitioned, in order), read
    back with the text source; global line index from split offsets."""
    s = D.sentences(spark, sf)
    path = scratch_path(spark, "lines")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (s.repartitionByRange(n, "doc_id", "sent_no").sortWithinPartitions("doc_id", "sent_no")
     .select("line").write.mode("overwrite").text(path))
    return line_index(spark.read.text(path)).select("line_idx", F.col("value").alias("line"))


def _write_lines(lines, path):
    lines.select(F.col("line").alias("value")).write.mode("append").option("maxRecordsPerFile", 50_000).text(path)


def _classified_stream(spark, root):
    return K.classified_stream(K.pair_stream(spark, f"{root}/in", 64), D.vocab(spark), D.MAX_SEQ)


@register("k03_stream_stats", O.with_base("pairs", """
SELECT reason, count(*) AS n, CAST(sum(n_tok) AS BIGINT) AS n_tok, CAST(sum(n_unk) AS BIGINT) AS n_unk
FROM wc GROUP BY reason""", WATERFALL_CTE))
def k03_stream_stats(spark, sf):
    """JSONL files streamed with the file source (availableNow), classified by the batch waterfall, running counts per reason kept as
    streaming state and snapshotted after every micro-batch."""
    root = scratch_path(spark, "stream")
    _write_lines(D.jsonl_lines(spark, sf), f"{root}/in")
    q = K.snapshot(K.running_stats(_classified_stream(spark, root)), f"{root}/out", f"{root}/ckpt")
    q.awaitTermination()
    return spark.read.parquet(f"{root}/out")


@register("k01_feature_stream", O.with_base("pairs", f"""
SELECT {_ids_str(f"[{CLS}] || s_ids || [{SEP}] || {_rep(MASK, 'n')} || [{SEP}] || {_rep(PAD, f'{D.MAX_SEQ} - 2 * n - 3')}")} AS input_ids,
       {_ids_str(f"{_rep(-100, 'n + 2')} || t_ids || [-100] || {_rep(-100, f'{D.MAX_SEQ} - 2 * n - 3')}")} AS labels
FROM feat""", FEAT_CTE))
def k01_feature_stream(spark, sf):
    """JSONL files streamed, classified, encoded and laid out as I01 training rows."""
    root = scratch_path(spark, "features")
    _write_lines(D.jsonl_lines(spark, sf), f"{root}/in")
    rows = K.feature_stream(_classified_stream(spark, root), D.vocab(spark), D.MAX_SEQ)
    K.append(rows, f"{root}/out", f"{root}/ckpt").awaitTermination()
    return spark.read.parquet(f"{root}/out").select(_str("input_ids").alias("input_ids"), _str("labels").alias("labels"))


@register("k02_route_restart", O.with_base("pairs", "SELECT reason, count(*) AS n FROM wc GROUP BY reason", WATERFALL_CTE))
def k02_route_restart(spark, sf):
    """K02 + K04: accepted and rejected rows routed to two folders; the stream is stopped, more files
    arrive, and it goes on from its checkpoint without reading the first ones again."""
    root = scratch_path(spark, "route")
    lines = D.jsonl_lines(spark, sf).withColumn("late", F.pmod(F.xxhash64("guid"), F.lit(2)) == 1)
    for late in (False, True):
        _write_lines(lines.where(F.col("late") == late), f"{root}/in")
        K.route(_classified_stream(spark, root), f"{root}/good", f"{root}/bad", f"{root}/ckpt").awaitTermination()
    good = spark.read.parquet(f"{root}/good").select(F.lit("accepted").alias("reason"))
    return (good.unionByName(spark.read.parquet(f"{root}/bad").select("reason"))
            .groupBy("reason").agg(F.count(F.lit(1)).alias("n")))


@register("m01_corrector_hook", O.with_base("triples", SAFE_SELECT.format(by="lang, "),
          _FLAGS_EXACT.replace("FROM triples", "FROM (SELECT * EXCLUDE (pred), src AS pred FROM triples) t") + ",\n" + _counts_sql(["lang"])))
def m01_corrector_hook(spark, sf):
    """A user corrector (here the copy baseline) run in Arrow batches with
    mapInPandas, then scored by D03."""
    p = D.pairs(spark, sf).select("lang", "src", "tgt")
    pred = U.correct_batches(p, lambda xs: list(xs), "src", "pred", 256)
    out = M.correction_metrics(pred, ["lang"], "safe")
    return out.select("lang", "samples", "positives", "negatives", "tp", "fp", "fn", "wp", "prd_pos",
                      "precision", "recall", "f1", "fpr")


# ------------------------------------------------------------------ prompts

def _turn_pairs(spark, sf):
    c = D.table(spark, sf, "conversations")
    u = c.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("src"))
    a = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("trg"), F.col("role").alias("r2"))
    return u.join(a.where(F.col("r2") == "assistant").drop("r2"), ["conv_id", "turn"])


TURN_PAIRS = """tp AS (SELECT u.conv_id, u.turn, u.text AS src, a.text AS trg FROM conversations u
  JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user')"""


@register("c06_chat_prompts", f"""WITH {TURN_PAIRS},
fs AS (SELECT string_agg(src || chr(10) || trg || chr(10), '' ORDER BY conv_id, turn) AS few_shot
       FROM (SELECT * FROM tp ORDER BY conv_id, turn LIMIT 3) t)
SELECT item_id, 'system' AS role0, '{P.CHAT_SYSTEM}' AS content0,
       '{P.CHAT_PREFIX.replace(chr(10), "' || chr(10) || '")}' || coalesce(few_shot, '') || text AS content1
FROM benchmark, fs""")
def c06_chat_prompts(spark, sf):
    """C06 + J08 + G08: the first three user->assistant pairs as a shared few-shot block
    (one-row broadcast), a chat prompt for every benchmark item."""
    tp = _turn_pairs(spark, sf).withColumn("ord", F.struct("conv_id", "turn"))
    block = P.few_shot_block(tp, "ord", "src", "trg", 3)
    b = P.with_few_shot(D.table(spark, sf, "benchmark"), block)
    msgs = P.chat_prompt("text", "few_shot")
    return b.select("item_id", msgs[0]["role"].alias("role0"), msgs[0]["content"].alias("content0"),
                    msgs[1]["content"].alias("content1"))


@register("g07_instruction_prompts", f"""WITH {TURN_PAIRS}
SELECT conv_id, turn, CASE WHEN src IN ('{C.DETECTION_INSTRUCTIONS[0]}') THEN 'detect' ELSE 'correct' END AS instruction_type,
       p AS prompt,
       string_split(string_split(p || trg, chr(10) || chr(10))[-2], chr(10))[-1] AS input_line,
       string_split(p || trg, chr(10))[-1] AS last_line
FROM (SELECT *, 'Instruction:' || chr(10) || 'Correct the text' || chr(10) || chr(10) || 'Input:' || chr(10) || src
                || chr(10) || chr(10) || 'Response:' || chr(10) AS p FROM tp) t""")
def g07_instruction_prompts(spark, sf):
    """B09 + G07 + G06: instruction prompts from user turns, the assistant turn appended as
    the generated response, then input / last-line extraction."""
    tp = _turn_pairs(spark, sf)
    d = tp.withColumn("prompt", P.render_prompt(F.lit("Correct the text"), "src"))
    ex = extract_response(F.concat("prompt", "trg"))
    return d.select("conv_id", "turn", C.instruction_type("src").alias("instruction_type"), "prompt",
                    ex["input"].alias("input_line"), ex["last_line"].alias("last_line"))


# ------------------------------------------------------------------ mixing

def _tasks(spark, sf):
    s = D.sentences(spark, sf).select(F.lit(0).alias("task_no"), F.col("guid").alias("key"))
    pg = D.table(spark, sf, "pages").select(F.lit(1).alias("task_no"), F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("key"))
    cv = D.table(spark, sf, "conversations").select(F.lit(2).alias("task_no"), F.concat(
        F.lit("c"), F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string")).alias("key"))
    return [s, pg, cv]


TASKS_SQL = """tasks AS (
  SELECT 0 AS task_no, guid AS key FROM sent
  UNION ALL SELECT 1, 'p' || CAST(page_id AS VARCHAR) FROM pages
  UNION ALL SELECT 2, 'c' || CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) FROM conversations)"""


@register("j06_rotate_mix", O.with_base("sent", f"""
SELECT step, task_no, count(*) AS n FROM (
  SELECT task_no, (row_number() OVER (PARTITION BY task_no ORDER BY {H('key', 'rotate')}, key) - 1) // 16 * 3 + task_no AS step
  FROM tasks) t GROUP BY step, task_no""", TASKS_SQL))
def j06_rotate_mix(spark, sf):
    """F02 + J06: union of three tasks; step k takes a batch of 16 from task k % 3."""
    u = MX.mix_proportional(_tasks(spark, sf), "key")
    r = MX.mix_rotate(u, "task_no", "key", 16, 3, D.SEED)
    return r.groupBy("step", "task_no").agg(F.count(F.lit(1)).alias("n"))


@register("j09_mix_report", O.with_base("sent", f"""
SELECT win, task_no, n, CAST(n AS DOUBLE) / CAST(sum(n) OVER (PARTITION BY win) AS DOUBLE) AS share FROM (
  SELECT win, task_no, count(*) AS n FROM (
    SELECT task_no, (row_number() OVER (ORDER BY {H('key', 'mix')}, key) - 1) // 64 // 10 AS win FROM tasks) a
  GROUP BY win, task_no) b""", TASKS_SQL))
def j09_mix_report(spark, sf):
    """J05 + J09: proportional mix (one shuffle of the union), batches of 64, share of each
    task per window of 10 batches."""
    u = MX.mix_proportional(_tasks(spark, sf), "key", D.SEED)
    u = row_index(u, ["mix_order", "key"], out_col="pos")
    u = u.withColumn("win", F.floor(F.col("pos") / 64 / 10).cast("bigint"))
    return MX.mix_report(u, "win", "task_no").select("win", "task_no", "n", "share")


# ------------------------------------------------------------------ inventory, fingerprint, D17, B12

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


@register("a12_inventory", " UNION ALL ".join(
    f"SELECT '{t}.parquet' AS file_name, count(*) AS n_rows FROM {t}" for t in TABLES))
def a12_inventory(spark, sf):
    """Rows per input file (with the sample-file guard) over every driver table."""
    out = None
    for t in TABLES:
        inv = RD.inventory(D.table(spark, sf, t)).select("file_name", "n_rows")
        out = inv if out is None else out.unionByName(inv)
    return out


@register("a21_fingerprint", """
SELECT count(*) AS n_rows, CAST(sum(('0x' || substr(md5(CAST(doc_id AS VARCHAR) || chr(1) || coalesce(text, chr(2)) || chr(1)
       || coalesce(lang, chr(2))), 1, 8))::BIGINT) AS BIGINT) AS checksum FROM documents""")
def a21_fingerprint(spark, sf):
    """Order-free fingerprint of a corpus (rows, checksum); file digests are in the tests."""
    return S.content_digest(D.table(spark, sf, "documents"), ["doc_id", "text", "lang"])


@register("d17_project_precision", O.with_base("triples", f"""
SELECT lang, ratio, pp AS proj_precision, CASE WHEN pp + rr > 0 THEN 2.0 * pp * rr / (pp + rr) ELSE 0.0 END AS proj_f1
FROM (SELECT *, CASE WHEN rr + ff * ratio > 0 THEN rr / (rr + ff * ratio) ELSE 0.0 END AS pp FROM (SELECT lang, recall / 100.0 AS rr, fpr / 100.0 AS ff FROM ({SAFE_SELECT.format(by='lang, ')}) m) a,
     (VALUES (1.0::DOUBLE), (2.0::DOUBLE), (5.0::DOUBLE), (10.0::DOUBLE)) r(ratio)) z""", _FLAGS_EXACT + ",\n" + _counts_sql(["lang"])))
def d17_project_precision(spark, sf):
    """Precision implied by each domain's recall and FPR at class ratios 1, 2, 5, 10."""
    m = M.correction_metrics(D.triples(spark, sf), ["lang"], "safe").select(
        "lang", (F.col("recall") / F.lit(100.0)).alias("rr"), (F.col("fpr") / F.lit(100.0)).alias("ff"))
    ratios = constant_table(spark, [(1.0,), (2.0,), (5.0,), (10.0,)], "ratio double")
    out = M.project_precision(m, ratios, "rr", "ff")
    return out.select("lang", "ratio", "proj_precision", "proj_f1")


EXPECTED = [f"src{i}" for i in range(24)]


@register("b12_missing_categories", "SELECT category FROM (VALUES " + ", ".join(f"('{c}')" for c in EXPECTED)
          + ") e(category) WHERE category NOT IN (SELECT DISTINCT source FROM documents)")
def b12_missing_categories(spark, sf):
    """Expected evaluation categories without any data (left-anti join)."""
    exp = constant_table(spark, [(c,) for c in EXPECTED], "category string")
    present = D.table(spark, sf, "documents").select(F.col("source").alias("category"))
    return C.missing_categories(exp, present, "category", exempt=())

