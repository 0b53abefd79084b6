"""Queries: one training set from unlike tasks, batches across cycles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import layouts as L
from ..operators import mix as MX
from ..operators import multitask as MT
from ..operators import vocab as V
from ..session import constant_table, scratch_path
from ..sources import derived as D
from . import oracle as O
from .indexing import row_index
from .q_features import _ids_str, _rep, _str, _whole, CLS, H, MASK, PAD, SEP, WATERFALL_CTE, WHOLE_CTE
from .q_rest import _doc_ids, _DOC_IDS_SQL, _LABEL_WORDS, _P7, _T6, _TOTAL7, MAXS
from .q_sources import classified
from .queries import register

BATCH = 32
# What a task without the field gets. Classification has no separate reference, so its
# labels stand in for it; tagging has no prompt and no active label places.
FIELDS = {"input_ids": PAD, "attention_mask": 0, "token_type_ids": 0, "trg_ids": 0, "trg_ref_ids": "trg_ids",
          "prompt_mask": 0, "active_bits": -100}
N = _TOTAL7


def _cut(a: str, fill: int | str) -> str:
    return f"({a} || {_rep(fill, str(N))})[1:{N}]"


def _tag7(x: str) -> str:
    return _cut(f"[{CLS}] || {x}[1:{N - 2}] || [{SEP}]", PAD)


_ROW = "{task} AS task_id, {key} AS key, {input} AS input_ids, {att} AS attention_mask, {seg} AS token_type_ids, {trg} AS trg_ids, " \
       "{ref} AS trg_ref_ids, {prompt} AS prompt_mask, {bits} AS active_bits"
_ZEROS, _IGNORED = _rep(0, str(N)), _rep(-100, str(N))
UNION_CTE = WHOLE_CTE + f""",
{_DOC_IDS_SQL},
pair_label(label, label_id) AS (VALUES ('0', 0), ('1', 1)),
pairs6 AS (SELECT doc_id, label_id, [{CLS}] || ids[1:{_T6}] || [{SEP}] AS a, b_ids || [{SEP}] AS b FROM dl JOIN pair_label USING (label)),
words7(label, label_id, word_pos, word) AS (VALUES {", ".join(f"('{l}', {i}, {p}, '{w}')" for _, l, i, p, w in _LABEL_WORDS)}),
slots7 AS (SELECT label, label_id, count(*) AS m FROM words7 GROUP BY label, label_id),
text7 AS (SELECT doc_id, label_id, m, [{CLS}] || ids[1:{MAXS - 2}] || [{SEP}] AS t FROM dl JOIN slots7 USING (label)),
united AS (
  SELECT {_ROW.format(task=0, key="guid", input=_tag7("s_ids"), att=_cut(_rep(1, f"least(len(s_ids), {N - 2}) + 2"), 0),
                      seg=_ZEROS, trg=_tag7("t_ids"), ref=_tag7("t_ids"), prompt=_ZEROS, bits=_IGNORED)} FROM whole
  UNION ALL
  SELECT {_ROW.format(task=1, key="CAST(doc_id AS VARCHAR)", input=_cut("a || b", PAD), att=_cut(_rep(1, "len(a) + len(b)"), 0),
                      seg=_cut(f"{_rep(0, 'len(a)')} || {_rep(1, 'len(b)')}", 0), trg=_rep("label_id", str(N)),
                      ref=_rep("label_id", str(N)), prompt=_ZEROS, bits=_IGNORED)} FROM pairs6
  UNION ALL
  SELECT {_ROW.format(task=2, key="CAST(doc_id AS VARCHAR)", input=_cut(f"t || {_rep(SEP, str(_P7))} || {_rep(MASK, 'm')}", PAD),
                      att=_cut(_rep(1, f"len(t) + {_P7} + m"), 0), seg=_ZEROS, trg=_cut("[label_id]", 0), ref=_cut("[label_id]", 0),
                      prompt=_cut(f"{_rep(0, 'len(t)')} || {_rep(1, str(_P7))}", 0),
                      bits=_cut(f"{_rep(-100, f'len(t) + {_P7}')} || {_rep(1, 'm')}", -100))} FROM text7)"""


def tasks(spark, sf):
    """Tagging of every well-formed pair, two-sentence classification of the labelled documents with their
    source, prompted classification of the same documents: three layouts, one length."""
    tag = _whole(spark, sf).select("guid", L.tagging("s_ids", "t_ids", N, CLS, SEP, PAD).alias("l")).select("guid", "l.*")
    docs = _doc_ids(spark, sf, MAXS)
    pair = V.label_id_or_fail(docs, V.label_table(spark, "quality", ["0", "1"])).withColumn("ids", F.slice("ids", 1, _T6))
    pair = pair.select("doc_id", L.classification("ids", "b_ids", "label_id", N, CLS, SEP, PAD).alias("l")).select(
        "doc_id", F.col("l").dropFields("task_id").alias("l")).select("doc_id", "l.*")
    words = constant_table(spark, _LABEL_WORDS, "task string, label string, label_id int, word_pos int, word string")
    text = V.with_label_words(V.label_id_or_fail(docs, words.select("label", "label_id").distinct()), words, D.vocab(spark), "label")
    text = text.select("doc_id", L.prompted_classification("ids", "label_id", F.size("label_word_ids"), MAXS, _P7,
                                                           CLS, SEP, MASK, PAD).alias("l")).select("doc_id", "l.*")
    return [MT.Task(0, tag, "guid", {"input_ids": "src_ids"}), MT.Task(1, pair, "doc_id", {"input_ids": "src_ids"}),
            MT.Task(2, text, "doc_id", {"input_ids": "src_ids"})]


@register("f02_task_union", O.with_base("pairs", f"""
SELECT task_id, key, CAST(pos // {BATCH} AS BIGINT) AS batch_id, CAST(pos % {BATCH} AS INTEGER) AS place,
       {", ".join(f"{_ids_str(c)} AS {c}" for c in FIELDS)}
FROM (SELECT *, row_number() OVER (ORDER BY {H("CAST(task_id AS VARCHAR) || ':' || key", 'mix')}, task_id, key) - 1 AS pos FROM united) u""",
    UNION_CTE))
def f02_task_union(spark, sf):
    """F02 + J05: features of three unlike tasks (I03, I06, I07) in one schema and one length, missing
    fields filled per task; shuffled as one set into batches that are written whole and read back."""
    batched = MT.mixed_batches(MT.unite(tasks(spark, sf), FIELDS, N), BATCH, D.SEED)
    folder = scratch_path(spark, "mixed-batches")
    MT.write_batches(batched, folder)
    return spark.read.parquet(folder).select("task_id", "key", "batch_id", "place", *[_str(c).alias(c) for c in FIELDS])


# ------------------------------------------------------------------ J04 across cycles, B13

_ACROSS = f"""
across AS (SELECT guid, shard, cycle, row_number() OVER (PARTITION BY shard
    ORDER BY cycle, {H("guid || ':' || CAST(cycle AS VARCHAR)", 'shuffle')}, guid) - 1 AS pos
  FROM (SELECT guid, reason, (row_number() OVER (ORDER BY doc_id, sent_no) - 1) % 4 AS shard FROM wc) a, range(3) r(cycle)
  WHERE reason = 'accepted')"""


def _across(spark, sf):
    c = classified(spark, sf).select("doc_id", "sent_no", "guid", "reason")
    c = MX.with_shard(row_index(c, ["doc_id", "sent_no"], out_col="raw_idx"), "raw_idx", 4).where(F.col("reason") == "accepted")
    return MX.with_batch(MX.cycles(c.select("guid", "shard"), 3), "guid", BATCH, D.SEED, "shard", "cycle", across=True)


@register("j04_batches_across_cycles", O.with_base("pairs", f"""
SELECT guid, shard, cycle, CAST(pos // {BATCH} AS BIGINT) AS batch_id, pos AS pos_in_shard FROM across""",
    WATERFALL_CTE + "," + _ACROSS))
def j04_batches_across_cycles(spark, sf):
    """J03 + J04: three cycles of the accepted pairs, each in its own shuffled order; per shard the batches
    run on over the borders of cycles, so only the last batch of all may be short."""
    return _across(spark, sf).select("guid", "shard", "cycle", "batch_id", "pos_in_shard")


@register("b13_resume_across_cycles", O.with_base("pairs", f"""
SELECT guid, shard, cycle, CAST(pos // {BATCH} AS BIGINT) - 12 AS batch_id FROM across WHERE pos // {BATCH} >= 12""",
    WATERFALL_CTE + "," + _ACROSS))
def b13_resume_across_cycles(spark, sf):
    """B13 on batches across cycles: what is left after six steps of two batches each, numbered from 0."""
    from ..operators import clean as C
    left = C.after_step(_across(spark, sf), 6, 2)
    return left.select("guid", "shard", "cycle", (F.col("batch_id") - 12).alias("batch_id"))
