"""Evaluation of a scored table ``(label, score)`` (V1-V8).

Shape: every metric starts from one map-side-combined aggregation (to a
one-row confusion count, or to counts per distinct score). Curves and
rank statistics need running totals over distinct scores; those use the
bucketed prefix sum in :mod:`popsight.plans.cumulative`, never a window over
all rows in one task. Scalar results are combined through scalar
subqueries, not joins.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, f1_score, ratio, ratio_or_zero
from ..plans.cumulative import default_buckets, running_totals
from ..plans.histogram import equal_width_histogram


def scored_table(df: DataFrame, label: str = "label", positive=1,
                 score: str = "score") -> DataFrame:
    """(label int 0/1, score double) from any table with a label and a score."""
    return df.select(F.when(col(label) == F.lit(positive), F.lit(1)).otherwise(F.lit(0))
                     .alias("label"), col(score).cast("double").alias("score"))


def ranked_score() -> Column:
    """The score by which rows are ranked: a null or NaN score comes last and is
    never predicted, so its row counts as a negative prediction everywhere."""
    s = F.col("score").cast("double")
    return F.when(s.isNull() | F.isnan(s), F.lit(float("-inf"))).otherwise(s)


def _counts(scored: DataFrame, threshold: float) -> DataFrame:
    pred = ranked_score() >= F.lit(float(threshold))
    y = F.col("label") == F.lit(1)
    return scored.agg(
        F.count_if(~y & ~pred).alias("tn"), F.count_if(~y & pred).alias("fp"),
        F.count_if(y & ~pred).alias("fn"), F.count_if(y & pred).alias("tp"))


def confusion_matrix(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """V1: one row tn, fp, fn, tp at ``score >= threshold``."""
    return _counts(scored, threshold)


def score_counts(scored: DataFrame) -> DataFrame:
    """Counts of positives and negatives per distinct score."""
    y = F.col("label") == F.lit(1)
    return scored.groupBy(ranked_score().alias("score")).agg(F.count_if(y).cast("bigint").alias("pos"),
                                       F.count_if(~y).cast("bigint").alias("neg"))


def _cumulative(scored: DataFrame, buckets: int | None = None) -> tuple[DataFrame, Column, Column]:
    """Running totals over distinct scores (highest first) plus P and N.

    One small action first -- cut points of the distinct scores and the two
    class totals, all from a single aggregation -- so the main plan carries
    them as literals: no subquery is re-evaluated, no window runs in one
    task over the data."""
    counts = score_counts(scored)
    buckets = buckets or default_buckets(scored.sparkSession)
    probs = [i / buckets for i in range(1, buckets)]
    st = counts.agg(F.percentile_approx("score", probs, 10000).alias("b"),
                    F.sum("pos").alias("p"), F.sum("neg").alias("n")).first()
    bounds = sorted({float(v) for v in (st["b"] or []) if v is not None and math.isfinite(v)})
    p, n = F.lit(int(st["p"] or 0)), F.lit(int(st["n"] or 0))
    return running_totals(counts, "score", ["pos", "neg"], descending=True, bounds=bounds), p, n


def _auc_term() -> Column:
    # AUC numerator = sum_s pos(s) * (2 * (N - cum_neg(s)) + neg(s))   (ties count half)
    #               = 2 N P - sum_s pos(s) * (2 cum_neg(s) - neg(s)); the sum stays exact
    return (F.col("pos").cast("decimal(38,0)")
            * (F.lit(2) * F.col("cum_neg") - F.col("neg")).cast("decimal(38,0)"))


def _auc(sum_term: Column, p: Column, n: Column) -> Column:
    num = (F.lit(2) * p.cast("decimal(38,0)") * n.cast("decimal(38,0)")
           - sum_term).cast("double")
    return F.try_divide(num, F.lit(2.0) * p.cast("double") * n.cast("double"))


def _ap_term() -> Column:
    return F.col("pos").cast("double") * (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg")))


def rank_metrics(scored: DataFrame) -> DataFrame:
    """V5 and V6 from ONE pass over the running totals: roc_auc, average_precision."""
    cum, p, n = _cumulative(scored)
    sums = cum.agg(F.sum(_auc_term()).alias("t"), F.sum(_ap_term()).alias("s"))
    return sums.select(_auc(F.col("t"), p, n).alias("roc_auc"),
                       F.round(F.try_divide(F.col("s"), p.cast("double")), 12)
                       .alias("average_precision"))


def roc_auc(scored: DataFrame) -> DataFrame:
    """V5: area under ROC = P(score+ > score-) + 1/2 P(tie); null with one class.
    The numerator is summed as an exact integer, then divided once."""
    cum, p, n = _cumulative(scored)
    t = cum.agg(F.sum(_auc_term()).alias("t"))
    return t.select(_auc(F.col("t"), p, n).alias("roc_auc"))


def average_precision(scored: DataFrame) -> DataFrame:
    """V6: step-wise average precision, sum over distinct scores (descending)
    of (recall gain) x (precision there); null without positives."""
    cum, p, _ = _cumulative(scored)
    ap = cum.agg(F.sum(_ap_term()).alias("s"))
    return ap.select(F.round(F.try_divide(F.col("s"), p.cast("double")), 12)
                     .alias("average_precision"))


def roc_curve(scored: DataFrame) -> DataFrame:
    """V4: one (fpr, tpr) point per distinct score, highest score first, plus
    the start point (threshold null, 0, 0)."""
    cum, p, n = _cumulative(scored)
    pts = cum.select(F.col("score").alias("threshold"),
                     ratio(F.col("cum_neg"), n).alias("fpr"),
                     ratio(F.col("cum_pos"), p).alias("tpr"))
    start = scored.sparkSession.range(1).select(
        F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"),
        F.lit(0.0).alias("tpr"))
    return start.unionByName(pts)


def pr_curve(scored: DataFrame) -> DataFrame:
    """V7: (precision, recall) per distinct score plus the end point
    (threshold null, precision 1, recall 0)."""
    cum, p, _ = _cumulative(scored)
    recall = F.when(p == 0, F.lit(1.0)).otherwise(ratio(F.col("cum_pos"), p))
    pts = cum.select(F.col("score").alias("threshold"),
                     (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg")))
                     .alias("precision"),
                     recall.alias("recall"))
    end = scored.sparkSession.range(1).select(
        F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"),
        F.lit(0.0).alias("recall"))
    return pts.unionByName(end)


def _f1(p: Column, r: Column) -> Column:
    return f1_score(p, r)


def overall_metrics(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """V2: accuracy, f1 (positive class), roc_auc, pr_auc (= V6) in one row."""
    c = _counts(scored, threshold)
    rm = rank_metrics(scored).select(F.struct("roc_auc", "average_precision")).scalar()
    auc, ap = rm.getField("roc_auc"), rm.getField("average_precision")
    n = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    p1 = ratio_or_zero(F.col("tp"), F.col("tp") + F.col("fp"))
    r1 = ratio_or_zero(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.select(ratio(F.col("tn") + F.col("tp"), n).alias("accuracy"),
                    _f1(p1, r1).alias("f1_score"),
                    auc.alias("roc_auc"), ap.alias("pr_auc"))


def classification_report(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """V3: precision, recall, f1, support per class, then accuracy (in the f1
    column), macro and support-weighted averages. Undefined ratios are 0."""
    c = _counts(scored, threshold)
    tn, fp, fn, tp = (F.col(x) for x in ("tn", "fp", "fn", "tp"))
    p0, r0 = ratio_or_zero(tn, tn + fn), ratio_or_zero(tn, tn + fp)
    p1, r1 = ratio_or_zero(tp, tp + fp), ratio_or_zero(tp, tp + fn)
    s0, s1 = (tn + fp).cast("double"), (tp + fn).cast("double")
    n = s0 + s1
    wide = c.select(
        p0.alias("p0"), r0.alias("r0"), _f1(p0, r0).alias("f0"), s0.alias("s0"),
        p1.alias("p1"), r1.alias("r1"), _f1(p1, r1).alias("f1"), s1.alias("s1"),
        n.alias("n"), ratio(tn + tp, n).alias("acc"))
    return wide.selectExpr("""stack(5,
        0, '0', p0, r0, f0, s0,
        1, '1', p1, r1, f1, s1,
        2, 'accuracy', CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), acc, n,
        3, 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n,
        4, 'weighted avg', try_divide(p0 * s0 + p1 * s1, n), try_divide(r0 * s0 + r1 * s1, n),
           try_divide(f0 * s0 + f1 * s1, n), n)
        AS (row_order, class, precision, recall, f1_score, support)""").select(
        F.col("row_order").cast("int").alias("row_order"), "class", "precision", "recall",
        "f1_score", F.col("support").cast("bigint").alias("support"))


def score_histogram(scored: DataFrame, bins: int = 50) -> DataFrame:
    """V8: per class, ``bins`` equal-width bins over that class's own score
    range, with density = count / (n * width)."""
    return equal_width_histogram(scored, "score", bins, by=["label"])
