"""Queries: scans, waterfalls, audit, noise and sinks over lines derived from documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import PUNCT_LONG, first_diff
from ..operators import clean as C
from ..operators import metrics as M
from ..operators import noise as N
from ..operators import reports as R
from ..operators import runs as RU
from ..sources import derived as D
from ..sources import readers as RD
from ..sources import sinks as S
from . import oracle as O
from .queries import chars_sql, punct_eq_sql, register

H = O.H
CAP = C.slots(D.MAX_SEQ)

# ------------------------------------------------------------------ shared SQL fragments

JSONL_CTE = f"""jl AS (
  SELECT guid, doc_id, sent_no, lang, source, k,
    CASE {H('k', 'fmt')} % 13
      WHEN 0 THEN substr(json_object('src', src, 'tgt', tgt)::VARCHAR, 1, 5)
      WHEN 1 THEN json_object('src', src)::VARCHAR
      WHEN 2 THEN json_object('src', 7, 'tgt', tgt)::VARCHAR
      WHEN 3 THEN ''
      WHEN 4 THEN json_object('src', substr(src, 1, 1) || ' ' || substr(src, 3), 'tgt', tgt)::VARCHAR
      WHEN 5 THEN json_object('src', src, 'tgt', substr(tgt, 1, greatest(length(tgt) - 1, 0)))::VARCHAR
      WHEN 6 THEN json_object('src', '', 'tgt', tgt)::VARCHAR
      WHEN 7 THEN json_object('src', src, 'tgt', tgt)::VARCHAR || ' {{"c":1}}'
      WHEN 8 THEN json_object('src', src, 'tgt', tgt)::VARCHAR || ' x}}'
      WHEN 9 THEN '{{"src":0,' || substr(json_object('src', src, 'tgt', tgt)::VARCHAR, 2)
      ELSE json_object('src', src, 'tgt', tgt)::VARCHAR END AS raw
  FROM pairs),
jl2 AS (  -- of a repeated key the last value counts; DuckDB would read the first
  SELECT *, CASE WHEN starts_with(raw, '{{"src":0,') THEN '{{' || substr(raw, 10) ELSE raw END AS line FROM jl),
jp AS (
  SELECT *, CASE WHEN line = '' THEN NULL
                 WHEN NOT json_valid(line) OR json_type(line) <> 'OBJECT' THEN 'bad_json'
                 WHEN json_type(line, '$.src') IS NULL OR json_type(line, '$.tgt') IS NULL THEN 'missing_field'
                 WHEN json_type(line, '$.src') <> 'VARCHAR' OR json_type(line, '$.tgt') <> 'VARCHAR' THEN 'non_string'
            END AS error
  FROM jl2),
jv AS (
  SELECT *, line = '' OR error IS NULL AS valid,
         CASE WHEN line = '' THEN '' WHEN error IS NULL THEN json_extract_string(line, '$.src') END AS psrc,
         CASE WHEN line = '' THEN '' WHEN error IS NULL THEN json_extract_string(line, '$.tgt') END AS ptgt
  FROM jp)"""

NOTOK = "[\\s\\p{Z}\\p{Cc}\\p{Cf}]"
UNKCLS = "[!-~\\s\\p{Z}\\p{Cc}\\p{Cf}]"


def ntok(x: str) -> str:
    return f"length(regexp_replace({x}, '{NOTOK}', '', 'g'))"


def nunk(x: str) -> str:
    return f"length(regexp_replace({x}, '{UNKCLS}', '', 'g'))"


WATERFALL_CTE = JSONL_CTE + f""",
wf AS (
  SELECT *, CASE WHEN NOT valid THEN 'invalid'
                 WHEN psrc = '' OR ptgt = '' THEN 'empty'
                 WHEN length(psrc) <> length(ptgt) THEN 'length_mismatch'
                 WHEN {ntok('psrc')} <> {ntok('ptgt')} THEN 'token_mismatch'
                 WHEN {ntok('psrc')} > {CAP} THEN 'seq_length'
                 ELSE 'accepted' END AS reason
  FROM jv),
wc AS (
  SELECT *, CASE WHEN reason IN ('token_mismatch', 'seq_length', 'accepted')
                 THEN {ntok('psrc')} + {ntok('ptgt')} ELSE 0 END AS n_tok,
            CASE WHEN reason IN ('token_mismatch', 'seq_length', 'accepted')
                 THEN {nunk('psrc')} + {nunk('ptgt')} ELSE 0 END AS n_unk
  FROM wf)"""


def classified(spark, sf):
    lines = D.jsonl_lines(spark, sf).select("guid", "doc_id", "sent_no", "lang", "source", "line")
    p = RD.with_json_pair(lines, "line").drop("line")
    return C.classify_pairs(p, D.vocab(spark), D.MAX_SEQ)


@register("a03_jsonl_validate", O.with_base("pairs", "SELECT guid, valid, error, psrc AS src, ptgt AS tgt FROM jv", JSONL_CTE))
def a03_jsonl_validate(spark, sf):
    """Strict JSONL pair validation with the three error kinds."""
    lines = D.jsonl_lines(spark, sf).select("guid", "line")
    return RD.with_json_pair(lines, "line").select("guid", "valid", "error", "src", "tgt")


@register("b03_reject_waterfall", O.with_base("pairs", "SELECT guid, reason, CAST(n_tok AS INTEGER) AS n_tok, CAST(n_unk AS INTEGER) AS n_unk FROM wc", WATERFALL_CTE))
def b03_reject_waterfall(spark, sf):
    """B03 + C02: first-match reject reason with token and UNK counts."""
    return classified(spark, sf).select("guid", "reason", F.col("n_tok").cast("int"), F.col("n_unk").cast("int"))


_AUDIT_SELECT = """SELECT lang, count(*) AS total_records, count_if(reason = 'accepted') AS accepted,
       count_if(reason = 'invalid') AS invalid_records, count_if(reason = 'empty') AS empty_records,
       count_if(reason = 'length_mismatch') AS dropped_length_mismatch,
       count_if(reason = 'token_mismatch') AS dropped_token_mismatch,
       count_if(reason = 'seq_length') AS dropped_seq_length,
       CAST(sum(n_unk) AS BIGINT) AS unknown_tokens, CAST(sum(n_tok) AS BIGINT) AS total_tokens,
       CASE WHEN sum(n_tok) > 0 THEN CAST(sum(n_unk) AS DOUBLE) / CAST(sum(n_tok) AS DOUBLE) ELSE 0.0 END AS unk_rate
FROM wc GROUP BY lang"""


@register("d13_audit", O.with_base("pairs", _AUDIT_SELECT, WATERFALL_CTE))
def d13_audit(spark, sf):
    """Audit counters per domain in one aggregate."""
    return R.audit(classified(spark, sf), ["lang"])


@register("e07_first_rejects", O.with_base("pairs", """
SELECT reason, rn, guid FROM (
  SELECT reason, guid, row_number() OVER (PARTITION BY reason ORDER BY doc_id, sent_no) AS rn FROM wc
  WHERE reason <> 'accepted') t WHERE rn <= 5""", WATERFALL_CTE))
def e07_first_rejects(spark, sf):
    """First five rejected lines per reason, in line order."""
    c = classified(spark, sf).where(F.col("reason") != "accepted")
    return RU.head_by(c, ["reason"], ["doc_id", "sent_no"], 5).select("reason", F.col("rn").cast("bigint"), "guid")


# ------------------------------------------------------------------ TSV scans

TSV_CTE = f"""tl AS (
  SELECT guid, doc_id, sent_no, lang, source, k,
    CASE {H('k', 'tsv')} % 11
      WHEN 0 THEN array_to_string(string_split(src, ''), ' ')
      WHEN 1 THEN array_to_string(string_split(src, ''), ' ') || chr(9) || array_to_string(string_split(tgt, ''), ' ')
                  || chr(9) || array_to_string(string_split(tgt, ''), ' ')
      WHEN 2 THEN array_to_string(string_split(src, ''), ' ') || chr(9)
      WHEN 3 THEN src || chr(9) || tgt
      ELSE array_to_string(string_split(src, ''), ' ') || chr(9) || array_to_string(string_split(tgt, ''), ' ') END AS line
  FROM pairs)"""


def _ws_clean(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g')"


def _ws_count(x: str) -> str:
    return f"(CASE WHEN {_ws_clean(x)} = '' THEN 0 ELSE len(string_split({_ws_clean(x)}, ' ')) END)"


@register("a01_tsv_strict", O.with_base("pairs", f"""
SELECT guid, len(parts) = 2 AS valid,
       CASE WHEN len(parts) = 2 THEN {_ws_count('parts[1]')} END AS n_src,
       CASE WHEN len(parts) = 2 THEN {_ws_count('parts[2]')} END AS n_trg,
       CASE WHEN len(parts) = 2 THEN {_ws_clean('parts[1]')} END AS src_text,
       CASE WHEN len(parts) = 2 THEN {_ws_clean('parts[2]')} END AS trg_text
FROM (SELECT guid, string_split(regexp_replace(line, '^\\s+|\\s+$', '', 'g'), chr(9)) AS parts FROM tl) t""", TSV_CTE))
def a01_tsv_strict(spark, sf):
    """Strip, split on tab (exactly two fields), whitespace tokens (PERMISSIVE flags)."""
    p = RD.with_tsv_strict(D.tsv_lines(spark, sf), "line", ["guid"], "PERMISSIVE")
    return p.select("guid", "valid", F.size("src_tokens").alias("n_src"), F.size("trg_tokens").alias("n_trg"),
                    F.array_join("src_tokens", " ").alias("src_text"), F.array_join("trg_tokens", " ").alias("trg_text"))


def _side_tokens_sql(x: str) -> str:
    """A02 side rule in SQL: whitespace split when it holds a space, else characters."""
    return (f"(CASE WHEN contains({x}, ' ') THEN (CASE WHEN {_ws_clean(x)} = '' THEN []::VARCHAR[] "
            f"ELSE string_split({_ws_clean(x)}, ' ') END) ELSE {chars_sql(x)} END)")


LENIENT_CTE = TSV_CTE + f""",
lp AS (
  SELECT *, len(parts) = 2 AS valid,
         CASE WHEN len(parts) = 2 THEN {_side_tokens_sql('parts[1]')} END AS st,
         CASE WHEN len(parts) = 2 THEN {_side_tokens_sql('parts[2]')} END AS tt
  FROM (SELECT *, string_split(line, chr(9)) AS parts FROM tl) t)"""


@register("a02_tsv_lenient", O.with_base("pairs", """
SELECT guid, valid, len(st) AS n_src, len(tt) AS n_tgt, array_to_string(st, ' ') AS src_text,
       array_to_string(tt, ' ') AS tgt_text FROM lp""", LENIENT_CTE))
def a02_tsv_lenient(spark, sf):
    """Lenient spaced-pair parse (bad lines flagged, sides split by the space rule)."""
    p = RD.with_tsv_lenient(D.tsv_lines(spark, sf), "line", ["guid"])
    return p.select("guid", "valid", F.size("src_tokens").alias("n_src"), F.size("tgt_tokens").alias("n_tgt"),
                    F.array_join("src_tokens", " ").alias("src_text"), F.array_join("tgt_tokens", " ").alias("tgt_text"))


def _eval_classified(spark, sf):
    p = RD.with_tsv_lenient(D.tsv_lines(spark, sf), "line", ["guid", "lang", "source"])
    return C.classify_eval_pairs(p, D.vocab(spark), D.MAX_SEQ)


def _ntok_list(x: str) -> str:
    return f"len(list_filter({x}, lambda c: NOT regexp_matches(c, '^{NOTOK}$')))"


EVAL_CTE = LENIENT_CTE + f""",
ev AS (
  SELECT *, CASE WHEN NOT valid THEN 'format'
                 WHEN len(st) <> len(tt) THEN 'length_mismatch'
                 WHEN {_ntok_list('st')} <> {_ntok_list('tt')} THEN 'token_mismatch'
                 WHEN {_ntok_list('st')} > {CAP} THEN 'seq_length'
                 ELSE 'accepted' END AS reason
  FROM lp)"""


@register("b04_eval_waterfall", O.with_base("pairs", "SELECT guid, reason FROM ev", EVAL_CTE))
def b04_eval_waterfall(spark, sf):
    """Evaluation waterfall (no empty check)."""
    return _eval_classified(spark, sf).select("guid", "reason")


@register("d15_dropped", O.with_base("pairs", """
SELECT source, count_if(reason = 'format') AS format, count_if(reason = 'length_mismatch') AS length_mismatch,
       count_if(reason = 'token_mismatch') AS token_mismatch, count_if(reason = 'seq_length') AS seq_length
FROM ev GROUP BY source HAVING count_if(reason <> 'accepted') > 0""", EVAL_CTE))
def d15_dropped(spark, sf):
    """Dropped counts per category and reason (pivot)."""
    return R.dropped_counts(_eval_classified(spark, sf), "source")


@register("d14_overflow", O.with_base("sent", f"""
SELECT lang, count(*) AS n, count_if(length(tgt) > {CAP}) AS n_over,
       CAST(count_if(length(tgt) > {CAP}) AS DOUBLE) * 100.0 / CAST(count(*) AS DOUBLE) AS pct_over
FROM sent GROUP BY lang"""))
def d14_overflow(spark, sf):
    """Sentences over the slot capacity per domain."""
    return R.overflow_report(D.sentences(spark, sf).withColumn("len", F.length("tgt")), "len", CAP, ["lang"])


# ------------------------------------------------------------------ noise

@register("h01_noise", O.with_base("pairs", """
SELECT guid, CAST(noise_pos AS INTEGER) AS noise_pos, noise_kind, noise_from, noise_to, src FROM pairs"""))
def h01_noise(spark, sf):
    """One-error noise with position, kind, original and replacement."""
    return D.pairs(spark, sf).select("guid", F.col("noise_pos").cast("int"), "noise_kind", "noise_from", "noise_to", "src")


@register("d19_noise_report", O.with_base("pairs", """
SELECT lang, n, n_unchanged, n_same_sound, n_similar_sound, n_shape, n_word, n_noised,
       CAST(n_unchanged AS DOUBLE) / CAST(n AS DOUBLE) AS unchanged_share,
       CASE WHEN n_noised > 0 THEN CAST(n_same_sound AS DOUBLE) / CAST(n_noised AS DOUBLE) ELSE 0.0 END AS same_sound_share,
       CASE WHEN n_noised > 0 THEN CAST(n_similar_sound AS DOUBLE) / CAST(n_noised AS DOUBLE) ELSE 0.0 END AS similar_sound_share,
       CASE WHEN n_noised > 0 THEN CAST(n_shape AS DOUBLE) / CAST(n_noised AS DOUBLE) ELSE 0.0 END AS shape_share,
       CASE WHEN n_noised > 0 THEN CAST(n_word AS DOUBLE) / CAST(n_noised AS DOUBLE) ELSE 0.0 END AS word_share
FROM (SELECT lang, count(*) AS n, count_if(src = tgt) AS n_unchanged,
             count_if(noise_kind = 'same_sound') AS n_same_sound, count_if(noise_kind = 'similar_sound') AS n_similar_sound,
             count_if(noise_kind = 'shape') AS n_shape, count_if(noise_kind = 'word') AS n_word,
             count_if(noise_pos IS NOT NULL) AS n_noised
      FROM pairs GROUP BY lang) t"""))
def d19_noise_report(spark, sf):
    """Noise audit per domain (unchanged share, share per candidate source)."""
    return R.noise_report(D.pairs(spark, sf), ["lang"]).drop("n_errors", "errors_per_sentence")


@register("d19_errors_per_sentence", O.with_base("pairs", """
SELECT lang, count(*) AS n, CAST(sum(e) AS BIGINT) AS n_errors, CAST(sum(e) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS errors_per_sentence
FROM (SELECT lang, len(list_filter(range(1, least(length(src), length(tgt)) + 1), lambda i: substr(src, i, 1) <> substr(tgt, i, 1))) AS e
      FROM pairs) a GROUP BY lang"""))
def d19_errors_per_sentence(spark, sf):
    """Mean count of differing positions per sentence, per domain."""
    return R.noise_report(D.pairs(spark, sf), ["lang"]).select("lang", "n", "n_errors", "errors_per_sentence")


@register("d21_error_pairs", O.with_base("pairs", """
SELECT wrong, "right", count(*) AS n FROM (
  SELECT substr(src, i, 1) AS wrong, substr(tgt, i, 1) AS "right"
  FROM (SELECT src, tgt, unnest(range(1, least(length(src), length(tgt)) + 1)) AS i FROM pairs WHERE src <> tgt) a
  WHERE substr(src, i, 1) <> substr(tgt, i, 1)) b
GROUP BY wrong, "right\""""))
def d21_error_pairs(spark, sf):
    """Counts of (wrong -> right) characters over differing positions."""
    return M.error_pairs(D.pairs(spark, sf))


@register("e10_first_diff", O.with_base("pairs", f"""
SELECT guid, CAST(coalesce(list_position(list_transform(list_filter(list_zip({chars_sql('src')}, {chars_sql('tgt')}),
         lambda z: z[1] IS NOT NULL), lambda z: z[2] IS NOT NULL AND z[1] <> z[2]), TRUE), 0) - 1 AS INTEGER) AS first_diff
FROM pairs"""))
def e10_first_diff(spark, sf):
    """First differing position (0-based), -1 when none."""
    p = D.pairs(spark, sf)
    return p.select("guid", first_diff(F.split("src", ""), F.split("tgt", "")).cast("int").alias("first_diff"))


@register("c07_near_positions", O.with_base("pairs", """
SELECT guid, CAST(CASE WHEN n > 0 AND hi >= lo THEN hi - lo + 1 ELSE 0 END AS INTEGER) AS n_near,
       CAST(CASE WHEN n > 0 AND hi >= lo THEN lo END AS INTEGER) AS near_lo,
       CAST(CASE WHEN n > 0 AND hi >= lo THEN hi END AS INTEGER) AS near_hi
FROM (SELECT guid, n, greatest(0, i - 5) AS lo, least(n, i + 6) - 1 AS hi
      FROM (SELECT guid, length(src) AS n,
                   coalesce(nullif(coalesce(list_position(list_transform(list_filter(list_zip(""" + chars_sql('src') + ", " + chars_sql('tgt') + """),
                     lambda z: z[1] IS NOT NULL), lambda z: z[2] IS NOT NULL AND z[1] <> z[2]), TRUE), 0) - 1, -1),
                     length(src) - 1) AS i
            FROM pairs) a) b"""))
def c07_near_positions(spark, sf):
    """Neighbourhood (range join) of +-5 positions around the first error."""
    p = D.pairs(spark, sf).withColumn("near", N.near_positions(F.col("src"), F.col("tgt"), 5))
    n = F.size("near")
    return p.select("guid", n.cast("int").alias("n_near"),
                    F.when(n > 0, F.element_at("near", 1)).cast("int").alias("near_lo"),
                    F.when(n > 0, F.element_at("near", -1)).cast("int").alias("near_hi"))


_FIRST = ("coalesce(list_position(list_transform(list_filter(list_zip(" + chars_sql('src') + ", " + chars_sql('tgt') + "), "
          "lambda z: z[1] IS NOT NULL), lambda z: z[2] IS NOT NULL AND z[1] <> z[2]), TRUE), 0) - 1")
_H2_BASE = f"""h2a AS (SELECT guid, k, src, tgt, length(src) AS n, {_FIRST} AS fd FROM pairs),
h2b AS (SELECT *, CASE WHEN n > 0 AND least(n, i + 6) - 1 >= greatest(0, i - 5)
                       THEN range(greatest(0, i - 5), least(n, i + 6)) ELSE []::BIGINT[] END AS near
        FROM (SELECT *, CASE WHEN fd >= 0 THEN fd ELSE n - 1 END AS i FROM h2a) a),
h2c AS (SELECT *, CASE WHEN len(near) > 0 THEN near[{H('k', 'near', 7)} % len(near) + 1] END AS choice FROM h2b),
h2d AS (SELECT *, CASE WHEN choice IS NOT NULL AND choice <> fd AND regexp_matches(substr(src, choice + 1, 1), '^[a-z]$')
                       THEN [choice + 1] ELSE []::BIGINT[] END AS pos2 FROM h2c)"""
_H2_NOISE, _H2_LAST = O.noise_ctes("h2d", "src", "noisy", seed=7, prefix="q", elig="pos2")


@register("h02_near_error", O.with_base("pairs", f"SELECT guid, CAST(noise_pos AS INTEGER) AS noise_pos, noisy FROM {_H2_LAST}",
                                        _H2_BASE + ",\n" + _H2_NOISE))
def h02_near_error(spark, sf):
    """A second error near the first (+-5 around the first difference); also checked
    against a brute-force Python model in tests."""
    p = D.pairs(spark, sf)
    out = N.inject_near_error(p.select("guid", "k", "src", "tgt"), "src", "tgt", "k", D.confusion_df(spark),
                              D.words_df(spark), len(D.ALPHABET), seed=7, char_class=D.CHAR_CLASS)
    return out.select("guid", F.col("noise_pos").cast("int"), "noisy")


# ------------------------------------------------------------------ sinks as queries

def _annot_sql(a: str, b: str) -> str:
    """G03 in SQL: zip the two character lists once; entries past the end of ``a`` dropped."""
    ca, cb = chars_sql(a), chars_sql(b)
    return (f"array_to_string(list_transform(list_filter(list_zip({ca}, {cb}), lambda z: z[1] IS NOT NULL), "
            f"lambda z: CASE WHEN z[2] IS NOT NULL AND z[1] <> z[2] THEN '(' || z[1] || '->' || z[2] || ')' "
            f"ELSE z[1] END), '')")


@register("a14_error_buckets", O.with_base("triples", f"""
SELECT guid, bucket, CASE WHEN bucket IN ('tp', 'fn') THEN {_annot_sql('src', 'tgt')}
                          WHEN bucket = 'fp' THEN {_annot_sql('tgt', 'pred')}
                          ELSE {_annot_sql('src', 'pred')} END AS annotation
FROM (SELECT *, CASE WHEN src <> tgt AND pred = tgt THEN 'tp' WHEN src <> tgt AND pred = src THEN 'fn'
                     WHEN src <> tgt THEN 'wp' WHEN pred <> tgt THEN 'fp' END AS bucket FROM triples) t
WHERE bucket IS NOT NULL"""))
def a14_error_buckets(spark, sf):
    """A14 + G03: bucket rows (tp/fn/fp/wp) with their difference annotation."""
    return S.bucket_rows(D.triples(spark, sf)).select("guid", "bucket", "annotation")


@register("a15_responses", O.with_base("triples", """
SELECT guid, 'input: ' || array_to_string(string_split(src, ''), ' ') || chr(9) || 'label: ' ||
       array_to_string(string_split(tgt, ''), ' ') || chr(9) || 'prediction: ' ||
       array_to_string(string_split(pred, ''), ' ') || chr(9) || CASE WHEN tgt = pred THEN 'correct' ELSE 'wrong' END AS line
FROM triples"""))
def a15_responses(spark, sf):
    """Response dump lines with space-joined tokens."""
    t = D.triples(spark, sf)
    return t.select("guid", S.response_line(F.split("src", ""), F.split("tgt", ""), F.split("pred", "")).alias("line"))


@register("a16_predictions", O.with_base("triples", f"""
SELECT guid, src AS input, pred AS prediction,
       CASE WHEN {punct_eq_sql('src', 'pred', PUNCT_LONG)} THEN 'correct' ELSE 'wrong' END AS type
FROM triples"""))
def a16_predictions(spark, sf):
    """A16 + G05: prediction records typed by punctuation-blind equality (long list)."""
    t = D.triples(spark, sf)
    return t.select("guid", F.col("src").alias("input"), F.col("pred").alias("prediction"),
                    S.prediction_type("src", "pred").alias("type"))

