"""Queries: noise on Han text, rare candidates, perplexity, changed lengths, evaluation output as files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import HAN_CLASS, strip_specials
from ..operators import metrics as M
from ..operators import noise as N
from ..operators import reports as R
from ..session import scratch_path
from ..sources import derived as D
from ..sources import sinks as S
from . import oracle as O
from .q_extra import _MINED_SQL, _mined_plus_rules
from .q_sources import PUNCT_LONG, _annot_sql
from .q_tables import RUNS, _runs
from .queries import chars_sql, punct_eq_sql, register

# ------------------------------------------------------------------ B08, H01, H02 on Han text

# The letters a to z as Han characters spread over U+4E00 to U+9FFF; everything else stays as it is.
HAN = "".join(chr(0x4E00 + i * 839) for i in range(len(D.ALPHABET)))
_TO_HAN = f"translate({{}}, '{D.ALPHABET}', '{HAN}')"
_HAN_RANGE = "[一-鿿]"


def _han_ctes() -> str:
    one, last = O.noise_ctes("han", "tgt", "src", cls=_HAN_RANGE, prefix="x")
    one = one.replace("LEFT JOIN confa ca", "LEFT JOIN hconf ca").replace("LEFT JOIN words w", "LEFT JOIN hwords w")
    return f"""
hwords AS (SELECT idx, {_TO_HAN.format('ch')} AS ch FROM words),
hconf AS (SELECT kind, {_TO_HAN.format('ch')} AS ch, list({_TO_HAN.format('cand')} ORDER BY idx) AS cands FROM conf GROUP BY kind, conf.ch),
han AS (SELECT guid, k, {_TO_HAN.format('tgt')} AS tgt FROM sent),
{one},
noisy AS (SELECT * FROM {last})"""


@register("b08_han_noise", O.with_base("sent", f"""
SELECT guid, CAST(length(tgt) - length(regexp_replace(tgt, '{_HAN_RANGE}', '', 'g')) AS INTEGER) AS n_han,
       CAST(noise_pos AS INTEGER) AS noise_pos, noise_kind, noise_from, noise_to, src FROM noisy""", _han_ctes()))
def b08_han_noise(spark, sf):
    """B08 + H01: the sentences with their letters as Han characters; the Han class alone decides which
    positions may change, the confusion tables are Han too."""
    han = lambda c: F.translate(c, D.ALPHABET, HAN)
    s = D.sentences(spark, sf).select("guid", "k", han("tgt").alias("tgt"))
    conf = D.confusion_df(spark).select("kind", han("ch").alias("ch"), "idx", han("cand").alias("cand"))
    words = D.words_df(spark).select("idx", han("ch").alias("ch"))
    noisy = N.inject_noise(s, "tgt", "k", conf, words, len(HAN), seed=D.SEED, char_class=HAN_CLASS, out_col="src")
    return noisy.select("guid", N.count_eligible(F.col("tgt"), HAN_CLASS).cast("int").alias("n_han"),
                        F.col("noise_pos").cast("int").alias("noise_pos"), "noise_kind", "noise_from", "noise_to", "src")


# ------------------------------------------------------------------ D18, D12, G12

@register("d18_rare_candidates", O.with_base("pairs", """
SELECT kind, count(*) AS n_candidates, count_if(seen.ch IS NULL) AS n_unseen, count_if(seen.ch IS NULL OR seen.rare) AS n_rare
FROM allc LEFT JOIN seen ON seen.ch = allc.cand GROUP BY kind""", _MINED_SQL + """,
counted AS (SELECT ch, count(*) AS n FROM (SELECT unnest(string_split(tgt, '')) AS ch FROM pairs WHERE tgt <> '') a GROUP BY ch),
seen AS (SELECT ch, sum(n) OVER (ORDER BY n, ch) <= 0.05::DOUBLE * (SELECT sum(n) FROM counted) AS rare FROM counted)"""))
def d18_rare_candidates(spark, sf):
    """Candidates that the corpus never has, or only among its rarest characters (together at most a
    twentieth of it): an exact weighted quantile over distinct characters."""
    counts = R.character_counts(D.sentences(spark, sf), "tgt").checkpoint()  # one row a character
    return R.rare_candidates(_mined_plus_rules(spark, sf), counts, 0.05)


@register("d12_perplexity_value", f"""WITH {RUNS},
m AS (SELECT run, count(*) AS n_steps, exp(CAST(sum(cents) AS DOUBLE) / (CAST(count(*) AS DOUBLE) * 100.0) / 100.0) AS p FROM runs GROUP BY run)
SELECT run, n_steps, CASE WHEN isinf(p) THEN p ELSE CAST(printf('%.9e', p) AS DOUBLE) END AS perplexity FROM m""")
def d12_perplexity_value(spark, sf):
    """Perplexity per run (the values, in hundredths, as losses), to ten significant digits: the last
    bits of an exponential differ between math libraries."""
    p = M.perplexity(_runs(spark, sf).withColumn("cents", F.col("cents").cast("decimal(38,0)")), "cents", ["run"])
    value = F.exp(F.col("mean_loss") / 100.0)
    shown = F.format_string("%.9e", value).cast("double")
    return p.select("run", "n_steps", F.when(F.abs(value) == float("inf"), value).otherwise(shown).alias("perplexity"))


@register("g12_changed_lengths", O.with_base("sent", f"""
SELECT lang, count(*) AS n_rows, count_if(n_unk > 0) AS n_changed, CAST(sum(n_unk) AS BIGINT) AS n_lost
FROM (SELECT lang, len(list_filter({chars_sql('tgt')}, lambda c: NOT unicode(c) BETWEEN 33 AND 126)) AS n_unk FROM sent) t
GROUP BY lang"""))
def g12_changed_lengths(spark, sf):
    """Decoded sentences, characters outside the vocabulary as UNK; stripping the special tokens drops
    those too, and the rows whose length changed are counted."""
    known = F.lit(D.VOCAB_SYMBOLS)
    tokens = F.when(F.col("tgt") == "", F.array().cast("array<string>")).otherwise(F.transform(
        F.split("tgt", ""), lambda c: F.when(F.instr(known, c) > 0, c).otherwise("[UNK]")))
    s = D.sentences(spark, sf).select("lang", tokens.alias("tokens"))
    s = s.withColumn("kept", strip_specials("tokens", ["[CLS]", "[UNK]", "[MASK]", "[SEP]", "[PAD]"]))
    return R.changed_lengths(s, "tokens", "kept", ["lang"])


# ------------------------------------------------------------------ A14-A16, written and read back

@register("a14_written_buckets", O.with_base("triples", f"""
SELECT bucket, CASE WHEN bucket IN ('tp', 'fn') THEN {_annot_sql('src', 'tgt')} WHEN bucket = 'fp' THEN {_annot_sql('tgt', 'pred')}
                    ELSE {_annot_sql('src', 'pred')} END AS annotation
FROM (SELECT *, CASE WHEN src <> tgt AND pred = tgt THEN 'tp' WHEN src <> tgt AND pred = src THEN 'fn'
                     WHEN src <> tgt THEN 'wp' WHEN pred <> tgt THEN 'fp' END AS bucket FROM triples) t
WHERE bucket IS NOT NULL"""))
def a14_written_buckets(spark, sf):
    """Error buckets as text files, a folder per bucket, in the order of the evaluated rows; read back
    through the folders' names once the commit mark is there."""
    folder = scratch_path(spark, "buckets")
    S.write_buckets(S.bucket_rows(D.triples(spark, sf)), folder, ["doc_id", "sent_no"])
    return S.read_committed(spark, folder, schema="value string, bucket string").select("bucket", F.col("value").alias("annotation"))


@register("a15_written_responses", O.with_base("triples", """
SELECT 'input: ' || array_to_string(string_split(src, ''), ' ') || chr(9) || 'label: ' ||
       array_to_string(string_split(tgt, ''), ' ') || chr(9) || 'prediction: ' ||
       array_to_string(string_split(pred, ''), ' ') || chr(9) || CASE WHEN tgt = pred THEN 'correct' ELSE 'wrong' END AS line
FROM triples"""))
def a15_written_responses(spark, sf):
    """The response dump as text files in row order, read back."""
    line = S.response_line(F.split("src", ""), F.split("tgt", ""), F.split("pred", ""))
    folder = scratch_path(spark, "responses")
    S.write_responses(D.triple_parts(spark, sf, "doc_id", "sent_no"), folder, order=["doc_id", "sent_no"],
                      made=lambda parts: D.from_parts(parts).select(line.alias("line")))
    return S.read_committed(spark, folder).select(F.col("value").alias("line"))


@register("a16_written_predictions", O.with_base("triples", f"""
SELECT src AS input, pred AS prediction, CASE WHEN {punct_eq_sql('src', 'pred', PUNCT_LONG)} THEN 'correct' ELSE 'wrong' END AS type
FROM triples"""))
def a16_written_predictions(spark, sf):
    """Prediction records as JSON lines, read back with their declared fields."""
    t = D.triples(spark, sf)
    folder = scratch_path(spark, "predictions")
    S.write_predictions(t.select(F.col("src").alias("input"), F.col("pred").alias("prediction"),
                                 S.prediction_type("src", "pred").alias("type")), folder)
    return S.read_committed(spark, folder, "json", "input string, prediction string, type string")
