"""Sentence-level correction/detection metrics and classification metrics.

Every metric is a ``groupBy(...).agg(count_if(...))`` (partial aggregation on the map side,
a tiny shuffle of one row per group and partition), followed by a projection computing the
ratios. Ratios are computed from exact integer counts with a fixed operation order, so they
are bit-identical whatever the partitioning. Sums of doubles over groups use an ordered fold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import PUNCT_LONG, PUNCT_SHORT, annotate_text, punct_equal_text
from ..session import bounded_broadcast, counted_broadcast

EPS = 1e-12


def _c(x: str | Column) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def with_outcome(df: DataFrame, src: str = "src", tgt: str = "tgt", pred: str = "pred",
                 eq: str = "exact", marks: list[str] = PUNCT_LONG) -> DataFrame:
    """Outcome flags ``is_pos is_neg is_tp is_fn is_wp is_fp is_changed``.

    ``eq="exact"`` compares whole strings; ``eq="punct"`` uses G05 with the reference's
    argument order (t,p) for tp, (s,p) for fn, (p,t)/(p,s) for wp and changed.
    """
    s, t, p = _c(src), _c(tgt), _c(pred)
    if eq == "exact":
        st, tp_, sp, pt, ps = s == t, t == p, s == p, p == t, p == s
    elif eq == "punct":
        st = punct_equal_text(s, t, marks)
        tp_ = punct_equal_text(t, p, marks)
        sp = punct_equal_text(s, p, marks)
        pt = punct_equal_text(p, t, marks)
        ps = punct_equal_text(p, s, marks)
    else:
        raise ValueError(f"unknown equality {eq!r}")
    return (df.withColumn("is_pos", ~st).withColumn("is_neg", st)
            .withColumn("is_tp", ~st & tp_)
            .withColumn("is_fn", ~st & sp)
            .withColumn("is_wp", ~st & ~pt & ~ps)
            .withColumn("is_fp", st & ~pt)
            .withColumn("is_changed", ~ps))


def outcome_counts(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts per group from B10 flags."""
    return _counted(df.groupBy(*by))


def _counted(groups, *more: Column) -> DataFrame:
    return groups.agg(
        *more,
        F.count(F.lit(1)).alias("samples"),
        F.count_if("is_pos").alias("positives"),
        F.count_if("is_neg").alias("negatives"),
        F.count_if("is_tp").alias("tp"),
        F.count_if("is_fp").alias("fp"),
        F.count_if("is_fn").alias("fn"),
        F.count_if("is_wp").alias("wp"),
        F.count_if("is_changed").alias("prd_pos"),
    )


def _d(x: str) -> Column:
    return F.col(x).cast("double")


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def ratios(counts: DataFrame, form: str = "safe") -> DataFrame:
    """D01 ``eps``, D02 ``guarded`` (+ wpr), D03 ``safe`` (percent), D04 ``punct`` ratios."""
    tp, pp, pos, neg, fp, wp = _d("tp"), _d("prd_pos"), _d("positives"), _d("negatives"), _d("fp"), _d("wp")
    if form == "eps":
        p = F.lit(1.0) * tp / (pp + F.lit(EPS))
        r = F.lit(1.0) * tp / (pos + F.lit(EPS))
        out = counts.withColumn("precision", p).withColumn("recall", r)
        out = out.withColumn("f1", F.lit(2.0) * (F.col("precision") * F.col("recall"))
                             / (F.col("precision") + F.col("recall") + F.lit(EPS)))
        return out.withColumn("fpr", F.lit(1.0) * fp / (neg + F.lit(EPS)))
    if form in ("guarded", "punct"):
        # The reference divides by the changed count unguarded; ours gives 0.0 there.
        none = F.col("positives") == 0
        p = F.when(none, F.lit(0.0)).otherwise(_ratio(F.lit(1.0) * tp, pp))
        r = F.when(none, F.lit(0.0)).otherwise(F.lit(1.0) * tp / pos)
        out = counts.withColumn("precision", p).withColumn("recall", r)
        out = out.withColumn("f1", F.when(none, F.lit(0.0)).otherwise(
            F.lit(2.0) * (F.col("precision") * F.col("recall"))
            / (F.col("precision") + F.col("recall") + F.lit(EPS))))
        out = out.withColumn("fpr", (fp + F.lit(EPS)) / (neg + F.lit(EPS)))
        if form == "guarded":
            out = out.withColumn("wpr", F.when(none, F.lit(0.0)).otherwise(F.lit(1.0) * wp / pos))
        return out
    if form == "safe":
        p = _ratio(tp, pp)
        r = _ratio(tp, pos)
        out = counts.withColumn("_p", p).withColumn("_r", r)
        f1 = F.when(F.col("_p") + F.col("_r") > 0,
                    F.lit(2.0) * F.col("_p") * F.col("_r") / (F.col("_p") + F.col("_r"))).otherwise(F.lit(0.0))
        return (out.withColumn("_f", f1)
                .withColumn("precision", F.col("_p") * F.lit(100.0))
                .withColumn("recall", F.col("_r") * F.lit(100.0))
                .withColumn("f1", F.col("_f") * F.lit(100.0))
                .withColumn("fpr", _ratio(fp, neg) * F.lit(100.0))
                .drop("_p", "_r", "_f"))
    raise ValueError(f"unknown form {form!r}")


def correction_metrics(df: DataFrame, by: Sequence[str] = (), form: str = "safe",
                       src: str = "src", tgt: str = "tgt", pred: str = "pred") -> DataFrame:
    """Sentence-level correction metrics per group."""
    eq = "punct" if form == "punct" else "exact"
    marks = PUNCT_SHORT if form == "punct" else PUNCT_LONG
    return ratios(outcome_counts(with_outcome(df, src, tgt, pred, eq, marks), by), form)


def detection_metrics(df: DataFrame, by: Sequence[str] = (), src: str = "src", tgt: str = "tgt",
                      pred: str = "pred") -> DataFrame:
    """tp = positive and changed at all; fp = negative and changed; epsilon form."""
    s, t, p = _c(src), _c(tgt), _c(pred)
    counts = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("samples"),
        F.count_if(s != t).alias("positives"),
        F.count_if(s == t).alias("negatives"),
        F.count_if((s != t) & (p != s)).alias("tp"),
        F.count_if((s != t) & (p == s)).alias("fn"),
        F.count_if((s == t) & (p != t)).alias("fp"),
        F.count_if(s != p).alias("prd_pos"),
    ).withColumn("wp", F.lit(0).cast("bigint"))
    return ratios(counts, "eps").drop("wp")


def ordered_sum(values: Column, order: Column) -> Column:
    """Aggregate: sum of doubles in ``order`` (deterministic result, small groups only)."""
    arr = F.array_sort(F.collect_list(F.struct(order.alias("o"), values.alias("v"))))
    return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x["v"])


def macro_average(per_cat: DataFrame, cat_col: str, metrics: Sequence[str] = ("precision", "recall", "f1", "fpr"),
                  fixed_divisor: int = 8) -> DataFrame:
    """Two macro rules over per-category rows.

    ``mean_valid``: mean over categories with samples > 0 (0.0 when none);
    ``fixed``: sum over all categories divided by a fixed count (8 in the reference).
    Sums run in category order.
    """
    valid = F.col("samples") > 0
    aggs = [F.count_if(valid).alias("n_valid")]
    for m in metrics:
        aggs.append(ordered_sum(F.when(valid, F.col(m)).otherwise(F.lit(0.0)), F.col(cat_col)).alias(f"_sv_{m}"))
        aggs.append(ordered_sum(F.col(m), F.col(cat_col)).alias(f"_sa_{m}"))
    a = per_cat.agg(*aggs)
    rows = []
    for rule in ("mean_valid", "fixed"):
        cols = [F.lit(rule).alias("rule")]
        for m in metrics:
            if rule == "mean_valid":
                cols.append(F.when(F.col("n_valid") > 0, F.col(f"_sv_{m}") / F.col("n_valid").cast("double"))
                            .otherwise(F.lit(0.0)).alias(m))
            else:
                cols.append((F.col(f"_sa_{m}") / F.lit(float(fixed_divisor))).alias(m))
        rows.append(a.select(*cols))
    return rows[0].unionByName(rows[1])


def averages(df: DataFrame, cat_col: str, metrics: Sequence[str] = ("precision", "recall", "f1", "fpr"),
             fixed_divisor: int = 8, form: str = "safe") -> DataFrame:
    """D06 in one pass over the sentences: grouping sets count every category and all of them together, and
    three rows come from those few counts: both macro rules and ``micro``, the ratios of the summed counts."""
    flags = with_outcome(df)
    sets = flags.groupingSets([[F.col(cat_col)], []], F.col(cat_col))
    rows = ratios(_counted(sets, F.grouping_id().alias("_all")), form)
    part = F.col("_all") == 0
    valid = part & (F.col("samples") > 0)
    aggs = [F.count_if(valid).alias("n_valid")]
    for m in metrics:
        aggs += [ordered_sum(F.when(valid, F.col(m)).otherwise(0.0), F.col(cat_col)).alias(f"_v_{m}"),
                 ordered_sum(F.when(part, F.col(m)).otherwise(0.0), F.col(cat_col)).alias(f"_a_{m}"),
                 F.max(F.when(~part, F.col(m))).alias(f"_m_{m}")]
    n = F.col("n_valid")
    rules = [("mean_valid", lambda m: F.when(n > 0, F.col(f"_v_{m}") / n.cast("double")).otherwise(0.0)),
             ("fixed", lambda m: F.col(f"_a_{m}") / F.lit(float(fixed_divisor))),
             ("micro", lambda m: F.coalesce(F.col(f"_m_{m}"), F.lit(0.0)))]
    made = F.array(*[F.struct(F.lit(rule).alias("rule"), *[of(m).alias(m) for m in metrics]) for rule, of in rules])
    return rows.agg(*aggs).select(F.inline(made))


def accuracy(df: DataFrame, pred: str = "pred", label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """D07."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(pred) == F.col(label)).alias("correct")) \
        .withColumn("accuracy", F.col("correct").cast("double") / F.col("n").cast("double"))


def confusion_matrix(df: DataFrame, pred: str = "pred", label: str = "label") -> DataFrame:
    return df.groupBy(F.col(label).alias("label"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def class_stats(cm: DataFrame) -> DataFrame:
    """Per class: tp, predicted count, true count (classes = labels union predictions)."""
    t = cm.groupBy(F.col("label").alias("cls")).agg(F.sum("n").alias("n_true"),
                                                   F.sum(F.when(F.col("label") == F.col("pred"), F.col("n"))
                                                         .otherwise(F.lit(0))).alias("tp"))
    p = cm.groupBy(F.col("pred").alias("cls")).agg(F.sum("n").alias("n_pred"))
    return (t.join(p, "cls", "full")
            .select("cls", F.coalesce("tp", F.lit(0)).alias("tp"), F.coalesce("n_true", F.lit(0)).alias("n_true"),
                    F.coalesce("n_pred", F.lit(0)).alias("n_pred")))


def f1_scores(df: DataFrame, pred: str = "pred", label: str = "label") -> DataFrame:
    """F1 micro, macro and weighted (sklearn semantics, 0 for undefined ratios)."""
    cs = class_stats(confusion_matrix(df, pred, label))
    cs = (cs.withColumn("_p", _ratio(_d("tp"), _d("n_pred"))).withColumn("_r", _ratio(_d("tp"), _d("n_true")))
          .withColumn("_f", F.when(F.col("_p") + F.col("_r") > 0,
                                   F.lit(2.0) * F.col("_p") * F.col("_r") / (F.col("_p") + F.col("_r")))
                      .otherwise(F.lit(0.0))))
    a = cs.agg(F.sum("tp").alias("tp"), F.sum("n_true").alias("n"), F.count(F.lit(1)).alias("n_classes"),
               ordered_sum(F.col("_f"), F.col("cls")).alias("_sf"),
               ordered_sum(F.col("_f") * _d("n_true"), F.col("cls")).alias("_sw"))
    return a.select(
        F.col("n_classes"),
        (_d("tp") / _d("n")).alias("f1_micro"),
        (F.col("_sf") / _d("n_classes")).alias("f1_macro"),
        (F.col("_sw") / _d("n")).alias("f1_weighted"))


def _products(a: str, b: str) -> Column:
    """Exact sum of products of two counts, beyond the range of bigint."""
    return F.sum((F.col(a).cast("decimal(19,0)") * F.col(b).cast("decimal(19,0)")).cast("decimal(38,0)"))


def mcc(df: DataFrame, pred: str = "pred", label: str = "label") -> DataFrame:
    """Multiclass Matthews correlation from exact integer sums; 0 when undefined."""
    cs = class_stats(confusion_matrix(df, pred, label))
    a = cs.agg(F.sum("tp").alias("c"), F.sum("n_true").alias("s"),
               _products("n_pred", "n_true").alias("pt"), _products("n_pred", "n_pred").alias("pp"),
               _products("n_true", "n_true").alias("tt"))
    num = _d("c") * _d("s") - _d("pt")
    den = F.sqrt((_d("s") * _d("s") - _d("pp")) * (_d("s") * _d("s") - _d("tt")))
    return a.select(F.col("s").alias("n"), F.when(den > 0, num / den).otherwise(F.lit(0.0)).alias("mcc"))


def average_ranks(df: DataFrame, col: str, out: str) -> DataFrame:
    """Twice the average rank (an integer) of ``col``; ties share the mean rank.

    Grouped by distinct value first; the running sum runs over distinct values only, with
    range-partitioned offsets (``plans.indexing.prefix_sum``).
    """
    from ..plans.indexing import prefix_sum
    counts = df.groupBy(F.col(col).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    cum = prefix_sum(counts, ["_v"], "_n", "_cum")  # range-partitioned, no global window
    ranks = cum.select("_v", (F.col("_cum") * 2 - F.col("_n") + 1).alias(out))  # 2 * mean(cum - n + 1, cum)
    # one row per distinct value: broadcast when they are few, so a value shared by a third of all
    # rows never lands in one join task (many distinct values: AQE splits what skew is left)
    return df.join(counted_broadcast(ranks), F.col(col).eqNullSafe(F.col("_v"))).drop("_v")


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Spearman rank correlation (average ranks for ties), Pearson on exact rank sums."""
    r = average_ranks(average_ranks(df.select(x, y), x, "_rx"), y, "_ry")
    a = r.agg(F.count(F.lit(1)).alias("n"), F.sum("_rx").alias("sx"), F.sum("_ry").alias("sy"),
              _products("_rx", "_ry").alias("sxy"), _products("_rx", "_rx").alias("sxx"),
              _products("_ry", "_ry").alias("syy"))
    num = _d("n") * _d("sxy") - _d("sx") * _d("sy")
    den = F.sqrt((_d("n") * _d("sxx") - _d("sx") * _d("sx")) * (_d("n") * _d("syy") - _d("sy") * _d("sy")))
    return a.select("n", F.when(den > 0, num / den).otherwise(F.lit(None).cast("double")).alias("spearman"))


def span_accuracy(segments: DataFrame) -> DataFrame:
    """D11 over closed spans ``(n_tok, n_match)``: sentence and token accuracy."""
    a = segments.agg(F.count(F.lit(1)).alias("n_spans"),
                     F.count_if(F.col("n_match") == F.col("n_tok")).alias("n_exact"),
                     F.sum("n_tok").alias("n_tokens"), F.sum("n_match").alias("n_matched"))
    return (a.withColumn("slacc", _ratio(_d("n_exact"), _d("n_spans")))
            .withColumn("tlacc", _ratio(_d("n_matched"), _d("n_tokens"))))


def perplexity(steps: DataFrame, loss_cents: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean loss and ``exp(mean)`` (overflow -> +inf). Loss is summed exactly in
    fixed point (hundredths) so the mean does not depend on summation order."""
    a = steps.groupBy(*by).agg(F.count(F.lit(1)).alias("n_steps"), F.sum(loss_cents).alias("_cents"))
    mean = _d("_cents") / (_d("n_steps") * F.lit(100.0))
    return a.withColumn("mean_loss", mean).withColumn("perplexity", F.exp(F.col("mean_loss"))).drop("_cents")


def project_precision(metrics: DataFrame, ratios_df: DataFrame, recall: str = "recall",
                      fpr: str = "fpr") -> DataFrame:
    """Precision implied by recall and FPR at negative:positive ratio r (fractions)."""
    j = metrics.crossJoin(bounded_broadcast(ratios_df))
    p = F.col(recall) / (F.col(recall) + F.col(fpr) * F.col("ratio"))
    j = j.withColumn("proj_precision", F.when(F.col(recall) + F.col(fpr) * F.col("ratio") > 0, p).otherwise(F.lit(0.0)))
    return j.withColumn("proj_f1", F.when(F.col("proj_precision") + F.col(recall) > 0,
                                          F.lit(2.0) * F.col("proj_precision") * F.col(recall)
                                          / (F.col("proj_precision") + F.col(recall))).otherwise(F.lit(0.0)))


def error_pairs(df: DataFrame, src: str = "src", tgt: str = "tgt") -> DataFrame:
    """Counts of (wrong -> right) characters where src and tgt differ (zip to shorter)."""
    s, t = _c(src), _c(tgt)
    zipped = F.arrays_zip(F.split(s, "").alias("w"), F.split(t, "").alias("r"))
    diff = F.filter(zipped, lambda z: z["w"].isNotNull() & z["r"].isNotNull() & (z["w"] != z["r"]))
    z = df.where(s != t).select(F.explode(diff).alias("z"))
    return (z.select(F.col("z.w").alias("wrong"), F.col("z.r").alias("right"))
            .groupBy("wrong", "right").agg(F.count(F.lit(1)).alias("n")))


def annotation(src: str | Column, tgt: str | Column) -> Column:
    return annotate_text(src, tgt)
