"""Registered queries: one Spark plan per operator of the inventory, each with its oracle SQL.

Every query reads the driver's tables (or data Spark derives from them) in full.
Column names are identical on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..sources import derived as D
from . import oracle as O

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[QueryFn, str | None]] = {}


def register(name: str, sql: str | None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def chars_sql(x: str) -> str:
    return f"(CASE WHEN {x} = '' THEN []::VARCHAR[] ELSE string_split({x}, '') END)"


def punct_eq_sql(a: str, b: str, marks: list[str]) -> str:
    """G05 in SQL over strings ``a``, ``b`` (first argument's marks are ignored).

    Equal strings and different lengths are decided without splitting; otherwise the two
    character lists are zipped once (no per-element re-split)."""
    m = "[" + ", ".join(f"'{x}'" for x in marks) + "]"
    ca, cb = chars_sql(a), chars_sql(b)
    return (f"(CASE WHEN {a} = {b} THEN TRUE WHEN length({a}) <> length({b}) THEN FALSE "
            f"ELSE coalesce(list_bool_and(list_transform(list_zip({ca}, {cb}), "
            f"lambda z: list_contains({m}, z[1]) OR z[1] = z[2])), TRUE) END)")


# ----------------------------------------------------------------------------------------
# D: correction metrics over (src, tgt, pred) derived from documents; lang = domain.

_COUNTS_SQL = """cnt AS (
  SELECT {by}count(*) AS samples, count_if(is_pos) AS positives, count_if(is_neg) AS negatives,
         count_if(is_tp) AS tp, count_if(is_fp) AS fp, count_if(is_fn) AS fn, count_if(is_wp) AS wp,
         count_if(is_changed) AS prd_pos
  FROM flags {group})"""

_FLAGS_EXACT = """flags AS (
  SELECT *, src <> tgt AS is_pos, src = tgt AS is_neg, src <> tgt AND pred = tgt AS is_tp,
         src <> tgt AND pred = src AS is_fn, src <> tgt AND pred <> tgt AND pred <> src AS is_wp,
         src = tgt AND pred <> tgt AS is_fp, pred <> src AS is_changed
  FROM triples)"""


def _counts_sql(by: list[str]) -> str:
    return _COUNTS_SQL.format(by="".join(f"{b}, " for b in by),
                              group=("GROUP BY " + ", ".join(by)) if by else "")


def _dbl(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


SAFE_SELECT = f"""SELECT {{by}}samples, positives, negatives, tp, fp, fn, wp, prd_pos,
       _p * 100.0 AS precision, _r * 100.0 AS recall,
       (CASE WHEN _p + _r > 0 THEN 2.0 * _p * _r / (_p + _r) ELSE 0.0 END) * 100.0 AS f1,
       (CASE WHEN negatives > 0 THEN {_dbl('fp')} / {_dbl('negatives')} ELSE 0.0 END) * 100.0 AS fpr
FROM (SELECT *, CASE WHEN prd_pos > 0 THEN {_dbl('tp')} / {_dbl('prd_pos')} ELSE 0.0 END AS _p,
                CASE WHEN positives > 0 THEN {_dbl('tp')} / {_dbl('positives')} ELSE 0.0 END AS _r
      FROM cnt) r"""

EPS_SELECT = f"""SELECT {{by}}samples, positives, negatives, tp, fp, fn, prd_pos, precision, recall,
       2.0 * (precision * recall) / (precision + recall + 1e-12) AS f1,
       1.0 * {_dbl('fp')} / ({_dbl('negatives')} + 1e-12) AS fpr
FROM (SELECT *, 1.0 * {_dbl('tp')} / ({_dbl('prd_pos')} + 1e-12) AS precision,
                1.0 * {_dbl('tp')} / ({_dbl('positives')} + 1e-12) AS recall FROM cnt) r"""

GUARDED_SELECT = f"""SELECT {{by}}samples, positives, negatives, tp, fp, fn, wp, prd_pos, precision, recall,
       CASE WHEN positives = 0 THEN 0.0 ELSE 2.0 * (precision * recall) / (precision + recall + 1e-12) END AS f1,
       ({_dbl('fp')} + 1e-12) / ({_dbl('negatives')} + 1e-12) AS fpr{{wpr}}
FROM (SELECT *, CASE WHEN positives = 0 THEN 0.0 WHEN prd_pos > 0 THEN 1.0 * {_dbl('tp')} / {_dbl('prd_pos')}
                     ELSE 0.0 END AS precision,
                CASE WHEN positives = 0 THEN 0.0 ELSE 1.0 * {_dbl('tp')} / {_dbl('positives')} END AS recall
      FROM cnt) r"""

_WPR = f",\n       CASE WHEN positives = 0 THEN 0.0 ELSE 1.0 * {_dbl('wp')} / {_dbl('positives')} END AS wpr"

_METRIC_COLS = ["samples", "positives", "negatives", "tp", "fp", "fn", "wp", "prd_pos",
                "precision", "recall", "f1", "fpr"]


def _metric_sql(form: str, by: list[str], flags: str = _FLAGS_EXACT) -> str:
    b = "".join(f"{x}, " for x in by)
    if form == "safe":
        sel = SAFE_SELECT.format(by=b)
    elif form == "eps":
        sel = EPS_SELECT.format(by=b)
    else:
        sel = GUARDED_SELECT.format(by=b, wpr=_WPR if form == "guarded" else "")
    return O.with_base("triples", sel, flags + ",\n" + _counts_sql(by))


def _metric_df(spark, sf, form, by=("lang",)):
    out = M.correction_metrics(D.triples(spark, sf), list(by), form)
    cols = list(by) + _METRIC_COLS
    if form == "eps":
        cols.remove("wp")
    if form == "guarded":
        cols.append("wpr")
    return out.select(*cols)


@register("d03_correction_safe", _metric_sql("safe", ["lang"]))
def d03_correction_safe(spark, sf):
    """Flagship: zero-safe percent P/R/F1/FPR per domain."""
    return _metric_df(spark, sf, "safe")


@register("d01_correction_eps", _metric_sql("eps", ["lang"]))
def d01_correction_eps(spark, sf):
    return _metric_df(spark, sf, "eps")


@register("d02_correction_guarded", _metric_sql("guarded", ["lang"]))
def d02_correction_guarded(spark, sf):
    return _metric_df(spark, sf, "guarded")


_FLAGS_PUNCT = f"""flags AS (
  SELECT *, NOT {punct_eq_sql('src', 'tgt', M.PUNCT_SHORT)} AS is_pos, {punct_eq_sql('src', 'tgt', M.PUNCT_SHORT)} AS is_neg,
         NOT {punct_eq_sql('src', 'tgt', M.PUNCT_SHORT)} AND {punct_eq_sql('tgt', 'pred', M.PUNCT_SHORT)} AS is_tp,
         NOT {punct_eq_sql('src', 'tgt', M.PUNCT_SHORT)} AND {punct_eq_sql('src', 'pred', M.PUNCT_SHORT)} AS is_fn,
         NOT {punct_eq_sql('src', 'tgt', M.PUNCT_SHORT)} AND NOT {punct_eq_sql('pred', 'tgt', M.PUNCT_SHORT)}
             AND NOT {punct_eq_sql('pred', 'src', M.PUNCT_SHORT)} AS is_wp,
         {punct_eq_sql('src', 'tgt', M.PUNCT_SHORT)} AND NOT {punct_eq_sql('pred', 'tgt', M.PUNCT_SHORT)} AS is_fp,
         NOT {punct_eq_sql('pred', 'src', M.PUNCT_SHORT)} AS is_changed
  FROM triples)"""


@register("d04_correction_punct", _metric_sql("punct", ["lang"], _FLAGS_PUNCT))
def d04_correction_punct(spark, sf):
    return _metric_df(spark, sf, "punct")


_DETECT_SQL = O.with_base("triples", EPS_SELECT.format(by="lang, "), """cnt AS (
  SELECT lang, count(*) AS samples, count_if(src <> tgt) AS positives, count_if(src = tgt) AS negatives,
         count_if(src <> tgt AND pred <> src) AS tp, count_if(src <> tgt AND pred = src) AS fn,
         count_if(src = tgt AND pred <> tgt) AS fp, count_if(src <> pred) AS prd_pos
  FROM triples GROUP BY lang)""")


@register("d05_detection", _DETECT_SQL)
def d05_detection(spark, sf):
    out = M.detection_metrics(D.triples(spark, sf), ["lang"])
    return out.select("lang", "samples", "positives", "negatives", "tp", "fp", "fn", "prd_pos",
                      "precision", "recall", "f1", "fpr")


_MACRO_SQL = O.with_base("triples", f"""
SELECT 'mean_valid' AS rule, {', '.join(f"CASE WHEN n_valid > 0 THEN sv_{m} / {_dbl('n_valid')} ELSE 0.0 END AS {m}" for m in ('precision', 'recall', 'f1', 'fpr'))}
FROM agg
UNION ALL
SELECT 'fixed' AS rule, {', '.join(f"sa_{m} / 8.0 AS {m}" for m in ('precision', 'recall', 'f1', 'fpr'))}
FROM agg
UNION ALL
SELECT 'micro' AS rule, precision, recall, f1, fpr FROM ({SAFE_SELECT.format(by='').replace('FROM cnt', 'FROM cnt_all')}) m""",
    _FLAGS_EXACT + ",\n" + _counts_sql(["source"]) + ",\n" + _counts_sql([]).replace("cnt AS", "cnt_all AS") + f""",
per_cat AS ({SAFE_SELECT.format(by='source, ')}),
agg AS (
  SELECT count_if(samples > 0) AS n_valid,
         {', '.join(f"list_reduce(list(CASE WHEN samples > 0 THEN {m} ELSE 0.0 END ORDER BY source), lambda a, b: a + b) AS sv_{m}, list_reduce(list({m} ORDER BY source), lambda a, b: a + b) AS sa_{m}" for m in ('precision', 'recall', 'f1', 'fpr'))}
  FROM per_cat)""")


@register("d06_macro_average", _MACRO_SQL)
def d06_macro_average(spark, sf):
    """Per-category (source) safe metrics, macro by both rules, plus the micro row: grouping sets, one pass."""
    return M.averages(D.triples(spark, sf), "source")


# Query modules register themselves on import (kept last: they import ``register``).
from . import q_sources  # noqa: E402,F401
from . import q_tables  # noqa: E402,F401
from . import q_features  # noqa: E402,F401
from . import q_more  # noqa: E402,F401
from . import q_extra  # noqa: E402,F401
from . import q_rest  # noqa: E402,F401
from . import q_masks  # noqa: E402,F401
from . import q_io  # noqa: E402,F401
from . import q_tasks  # noqa: E402,F401
from . import q_cycles  # noqa: E402,F401
from . import q_files  # noqa: E402,F401
from . import q_quality  # noqa: E402,F401
