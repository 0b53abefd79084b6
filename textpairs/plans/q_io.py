"""Queries: file round trips through the classification/instruction readers (A06-A08), the
append-only run log (A18) and corpus shards (A20), on data derived from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import strip_specials
from ..operators import clean as C
from ..operators import metrics as M
from ..session import scratch_path
from ..sources import derived as D
from ..sources import readers as RD
from ..sources import sinks as S
from . import oracle as O
from .q_features import _turn_pairs
from .queries import chars_sql, register

TURNS = """tp AS (SELECT u.conv_id, u.turn, u.text AS src, a.text AS trg FROM conversations u
  JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user')"""


def _jsonl(df, cols, name, spark):
    path = scratch_path(spark, name)
    df.select(F.to_json(F.struct(*cols)).alias("value")).write.text(path)
    return path


@register("a06_pair_classification", f"""WITH {TURNS}
SELECT CASE WHEN length(src) <= length(trg) THEN '1' ELSE '0' END AS label, count(*) AS n,
       sum(length(src) + length(trg)) AS n_chars
FROM tp GROUP BY 1""")
def a06_pair_classification(spark, sf):
    """Sentence-pair classification JSONL (turn pairs, label = reply not shorter)
    written and read back with the strict reader; rows and characters per label."""
    tp = _turn_pairs(spark, sf).select(F.col("src").alias("sentence1"), F.col("trg").alias("sentence2"),
                                       F.when(F.length("src") <= F.length("trg"), "1").otherwise("0").alias("label"))
    path = _jsonl(tp, ["sentence1", "sentence2", "label"], "afqmc", spark)
    r = RD.read_pair_classification(spark, path)
    return r.groupBy("label").agg(F.count(F.lit(1)).alias("n"),
                                  F.sum(F.length("sentence1") + F.length("sentence2")).alias("n_chars"))


@register("a07_classification", """SELECT CAST(l.quality AS VARCHAR) AS label,
       CASE WHEN l.quality = 1 THEN 'good' ELSE 'poor' END AS label_desc, count(*) AS n, sum(length(d.text)) AS n_chars
FROM labels l JOIN documents d ON l.doc_id = d.doc_id GROUP BY 1, 2""")
def a07_classification(spark, sf):
    """Single-sentence classification JSONL (labelled documents, whole texts) written
    and read back; rows and characters per label."""
    lab = D.table(spark, sf, "labels").join(D.table(spark, sf, "documents"), "doc_id")
    rows = lab.select(F.col("text").alias("sentence"), F.col("quality").cast("string").alias("label"),
                      F.when(F.col("quality") == 1, "good").otherwise("poor").alias("label_desc"))
    path = _jsonl(rows, ["sentence", "label", "label_desc"], "tnews", spark)
    r = RD.read_classification(spark, path)
    return r.groupBy("label", "label_desc").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("sentence")).alias("n_chars"))


@register("a08_instructions", f"""WITH {TURNS}
SELECT CASE WHEN ins = '{C.DETECTION_INSTRUCTIONS[0]}' THEN 'detect' ELSE 'correct' END AS instruction_type,
       count(*) AS n, sum(length(src)) AS n_input_chars
FROM (SELECT *, CASE WHEN turn % 4 = 0 THEN '{C.DETECTION_INSTRUCTIONS[0]}' ELSE 'Correct the text' END AS ins FROM tp) t
GROUP BY 1""")
def a08_instructions(spark, sf):
    """A08 + B09: instruction JSONL (every other user turn asks for detection) written and
    read back; rows per instruction type."""
    tp = _turn_pairs(spark, sf)
    ins = F.when(F.col("turn") % 4 == 0, F.lit(C.DETECTION_INSTRUCTIONS[0])).otherwise(F.lit("Correct the text"))
    rows = tp.select(ins.alias("instruction"), F.col("src").alias("input"), F.col("trg").alias("response"))
    path = _jsonl(rows, ["instruction", "input", "response"], "sft", spark)
    r = RD.read_instructions(spark, path)
    return r.groupBy(C.instruction_type("instruction").alias("instruction_type")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("input")).alias("n_input_chars"))


@register("a18_run_log", """SELECT event_type, count(*) AS n_rows, max(value) AS best
FROM (SELECT event_type, value FROM events UNION ALL SELECT event_type, value FROM events) t GROUP BY event_type""")
def a18_run_log(spark, sf):
    """Evaluation rows appended twice to one log (append-only), then read back."""
    path = scratch_path(spark, "runs")
    ev = D.table(spark, sf, "events").select("event_type", "event_id", "value")
    S.append_runs(ev, path)
    S.append_runs(ev, path)
    log = spark.read.parquet(path)
    return log.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_rows"), F.max("value").alias("best"))


@register("a20_shards", """SELECT count(*) AS n_rows, TRUE AS within_cap FROM documents, unnest(string_split(text, chr(10))) u(line)""")
def a20_shards(spark, sf):
    """Every document line written as text shards of at most 500 lines, read back;
    total lines and whether every shard respects the cap."""
    path = scratch_path(spark, "shards")
    S.write_shards(D.sentences(spark, sf).select(F.col("line").alias("value")), path, 500)
    per_file = spark.read.text(path).groupBy(F.col("_metadata.file_name").alias("f")).agg(F.count(F.lit(1)).alias("n"))
    return per_file.agg(F.sum("n").alias("n_rows"), (F.max("n") <= 500).alias("within_cap"))


def _a19_sql() -> str:
    from . import oracle as O
    from .q_sources import EVAL_CTE
    from .queries import SAFE_SELECT, _FLAGS_EXACT, _counts_sql
    extra = (_FLAGS_EXACT + ",\n" + _counts_sql(["source"]) + ",\n" + EVAL_CTE + f""",
pc AS ({SAFE_SELECT.format(by='source, ')}),
dr AS (SELECT source, count_if(reason = 'format') AS format FROM ev WHERE reason <> 'accepted' GROUP BY source),
per_cat AS (SELECT pc.source, samples, f1, coalesce(dr.format, 0) AS format FROM pc LEFT JOIN dr ON pc.source = dr.source),
av AS (SELECT list_reduce(list(CASE WHEN samples > 0 THEN f1 ELSE 0.0 END ORDER BY source), lambda a, b: a + b)
              / CAST(count_if(samples > 0) AS DOUBLE) AS avg_f1 FROM per_cat)""")
    body = """SELECT row_number() OVER (ORDER BY source) - 1 AS pos, upper(source) AS cat, samples, f1, format, avg_f1
FROM per_cat, av"""
    return O.with_base("triples", body, extra)


@register("a19_report", _a19_sql())
def a19_report(spark, sf):
    """A19 + D03 + D06 + D15: the evaluation report as one JSON document (categories in the
    fixed order, unknown ones after it by name, dropped counts per category, macro average),
    parsed back into rows (position of each category in the document included)."""
    from ..operators import metrics as M
    from ..operators import reports as R
    from .q_sources import _eval_classified

    per_cat = M.correction_metrics(D.triples(spark, sf), ["source"], "safe").select("source", "samples", "f1")
    dropped = R.dropped_counts(_eval_classified(spark, sf), "source").select("source", "format")
    per_cat = per_cat.join(dropped, "source", "left").withColumn("format", F.coalesce("format", F.lit(0)).cast("bigint"))
    avg = M.macro_average(per_cat.withColumn("f1", F.col("f1")), "source", ["f1"]).where(F.col("rule") == "mean_valid").select("f1")
    doc = S.report_json(per_cat, "source", ["samples", "f1"], ["format"], avg)
    schema = "struct<results: map<string, struct<samples: bigint, f1: double, dropped: struct<format: bigint>>>, average: struct<f1: double>>"
    parsed = doc.select(F.from_json("report", schema).alias("r"))
    rows = parsed.select(F.posexplode("r.results").alias("pos", "cat", "v"), F.col("r.average.f1").alias("avg_f1"))
    return rows.select(F.col("pos").cast("bigint"), "cat", F.col("v.samples").alias("samples"), F.col("v.f1").alias("f1"),
                       F.col("v.dropped.format").alias("format"), "avg_f1")


@register("a05_sentences", O.with_base("sent", """
SELECT regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS text, count(*) AS n FROM sent
WHERE regexp_replace(line, '^\\s+|\\s+$', '', 'g') <> '' GROUP BY 1"""))
def a05_sentences(spark, sf):
    """Document lines written as text files and scanned as clean sentences (stripped, blank ones
    dropped)."""
    path = scratch_path(spark, "sentences")
    D.sentences(spark, sf).select("line").write.text(path)
    return RD.read_sentences(spark, path).groupBy("text").agg(F.count(F.lit(1)).alias("n"))


@register("a17_messages", O.with_base("triples", f"""
SELECT src, tgt AS trg, pred, CAST(len({chars_sql('src')}) AS INTEGER) AS n_src,
       CAST(len({chars_sql('pred')}) AS INTEGER) AS n_pred FROM triples"""))
def a17_messages(spark, sf):
    """A17 + A11: messages written as JSON lines and read back with their character lists."""
    path = scratch_path(spark, "messages")
    S.write_messages(D.triples(spark, sf).select("src", F.col("tgt").alias("trg"), "pred"), path)
    m = RD.read_messages(spark, path, lines=True)
    return m.select("src", "trg", "pred", F.size("src_tokens").alias("n_src"), F.size("pred_tokens").alias("n_pred"))


@register("a10_confusion_file", O.with_base("pairs", """
SELECT 'shape' AS kind, "right" AS ch, CAST(row_number() OVER (PARTITION BY "right" ORDER BY n DESC, wrong) - 1 AS INTEGER) AS idx,
       wrong AS cand
FROM (SELECT substr(src, i, 1) AS wrong, substr(tgt, i, 1) AS "right", count(*) AS n
      FROM (SELECT src, tgt, unnest(range(1, least(length(src), length(tgt)) + 1)) AS i FROM pairs WHERE src <> tgt) a
      WHERE substr(src, i, 1) <> substr(tgt, i, 1) GROUP BY ALL) ep"""))
def a10_confusion_file(spark, sf):
    """A10 + D21: a confusion map mined from the pairs, written as one JSON object (a row per character of
    the alphabet) and read as the long table."""
    per = (M.error_pairs(D.pairs(spark, sf)).groupBy("right")
           .agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "wrong"))).alias("w")))
    entries = F.collect_list(F.struct("right", F.transform("w", lambda x: x["wrong"])))
    path = scratch_path(spark, "confusion")
    per.agg(F.to_json(F.map_from_entries(entries)).alias("value")).write.text(path)
    return RD.read_confusion_map(spark, path, "shape")


@register("g12_strip_specials", O.with_base("sent", """
SELECT guid, tgt AS stripped, CAST(len(string_split(tgt, '')) AS INTEGER) AS n FROM sent WHERE tgt <> ''"""))
def g12_strip_specials(spark, sf):
    """Decoded token lists with special tokens at both ends and in the middle, without them."""
    s = D.sentences(spark, sf).where(F.col("tgt") != "").select("guid", F.split("tgt", "").alias("t"))
    half = F.floor(F.size("t") / 2).cast("int")
    put = F.concat(F.array(F.lit("[CLS]")), F.slice("t", F.lit(1), half), F.array(F.lit("[UNK]"), F.lit("[MASK]")),
                   F.slice("t", half + 1, F.size("t")), F.array(F.lit("[SEP]"), F.lit("[PAD]")))
    kept = strip_specials(put, ["[CLS]", "[UNK]", "[MASK]", "[SEP]", "[PAD]"])
    return s.select("guid", F.array_join(kept, "").alias("stripped"), F.size(kept).alias("n"))
