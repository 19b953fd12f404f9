"""The threshold and campaign slice on ``persons``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import predict_with_threshold
from ..operators import evaluate as ev
from ..operators import threshold as th
from . import persons_input, register, sql_with


def scored(spark, sf_dir):
    return ev.scored_table(persons_input(spark, sf_dir), label="label", positive="50000+.",
                           score="score")


def sweep(spark, sf_dir):
    return th.threshold_sweep(scored(spark, sf_dir))


def impact(spark, sf_dir):
    return th.business_impact(sweep(spark, sf_dir))


SCORED_CTE = ("s", "SELECT CASE WHEN label = '50000+.' THEN 1 ELSE 0 END AS label, score "
                   "FROM persons")
GRID_CTE = ("g", "SELECT CAST(0.1 AS DOUBLE) + CAST(range AS DOUBLE) * CAST(0.01 AS DOUBLE) "
                 "AS threshold FROM range(0, 81)")
COUNTS_CTE = ("c", """
  SELECT threshold,
    CAST(SUM(CASE WHEN score >= threshold AND label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
    CAST(SUM(CASE WHEN score >= threshold AND label = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
    CAST(SUM(CASE WHEN NOT (score >= threshold) AND label = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn,
    CAST(SUM(CASE WHEN NOT (score >= threshold) AND label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fn
  FROM g CROSS JOIN s GROUP BY threshold""")
PR_CTE = ("m", """
  SELECT *,
    CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE CAST(0 AS DOUBLE) END AS precision,
    CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE CAST(0 AS DOUBLE) END AS recall
  FROM c""")
SWEEP_CTE = ("sweep", """
  SELECT threshold, precision, recall,
    CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall)
         ELSE CAST(0 AS DOUBLE) END AS f1,
    tp, fp, tn, fn
  FROM m""")
IMPACT_CTE = ("impact", """
  SELECT threshold, precision, recall,
    tp + fp AS total_targeted, tp AS high_earners_reached, fp AS low_earners_reached,
    fn AS high_earners_missed,
    CAST(tp AS DOUBLE) * CAST(40 AS DOUBLE) + CAST(fp AS DOUBLE) * CAST(3 AS DOUBLE) AS total_revenue,
    CAST(tp + fp AS DOUBLE) * CAST(15 AS DOUBLE) AS total_cost
  FROM sweep""")
IMPACT2_CTE = ("impact2", """
  SELECT *, total_revenue - total_cost AS net_profit FROM impact""")
IMPACT3_CTE = ("impact3", """
  SELECT *,
    CASE WHEN total_cost > 0 THEN net_profit / total_cost * 100 ELSE CAST(0 AS DOUBLE) END AS roi,
    CASE WHEN high_earners_reached > 0 THEN total_cost / high_earners_reached
         ELSE CAST(0 AS DOUBLE) END AS cpa_high_earner,
    CASE WHEN total_targeted > 0 THEN net_profit / total_targeted
         ELSE CAST(0 AS DOUBLE) END AS profit_per_target
  FROM impact2""")
SWEEP_CTES = (SCORED_CTE, GRID_CTE, COUNTS_CTE, PR_CTE, SWEEP_CTE)
IMPACT_CTES = SWEEP_CTES + (IMPACT_CTE, IMPACT2_CTE, IMPACT3_CTE)


@register("t1_threshold_sweep", sql_with(*SWEEP_CTES, select="SELECT * FROM sweep"))
def q_t1(spark, sf_dir):
    return sweep(spark, sf_dir)


@register("t2_optimal_threshold_f1", sql_with(
    *SWEEP_CTES, select="SELECT * FROM sweep ORDER BY f1 DESC, threshold LIMIT 1"))
def q_t2(spark, sf_dir):
    return th.optimal_threshold_f1(sweep(spark, sf_dir))


@register("t3_optimal_threshold_precision", sql_with(*SWEEP_CTES, select="""
  SELECT threshold, precision, recall, f1, tp, fp, tn, fn FROM sweep
  ORDER BY CASE WHEN precision >= 0.7 THEN 1 ELSE 0 END DESC,
           CASE WHEN precision >= 0.7 THEN recall ELSE precision END DESC, threshold
  LIMIT 1"""))
def q_t3(spark, sf_dir):
    return th.optimal_threshold_precision(sweep(spark, sf_dir))


@register("t4_optimal_threshold_recall", sql_with(*SWEEP_CTES, select="""
  SELECT threshold, precision, recall, f1, tp, fp, tn, fn FROM sweep
  ORDER BY CASE WHEN recall >= 0.8 THEN 1 ELSE 0 END DESC,
           CASE WHEN recall >= 0.8 THEN precision ELSE recall END DESC, threshold
  LIMIT 1"""))
def q_t4(spark, sf_dir):
    return th.optimal_threshold_recall(sweep(spark, sf_dir))


@register("t5_business_impact", sql_with(*IMPACT_CTES, select="SELECT * FROM impact3"))
def q_t5(spark, sf_dir):
    return impact(spark, sf_dir)


@register("t6_optimal_business_threshold", sql_with(
    *IMPACT_CTES, select="SELECT * FROM impact3 ORDER BY net_profit DESC, threshold LIMIT 1"))
def q_t6(spark, sf_dir):
    return th.optimal_business_threshold(impact(spark, sf_dir))


@register("t7_breakeven_threshold", sql_with(*IMPACT_CTES, select="""
  SELECT MIN(CASE WHEN net_profit >= 0 THEN threshold END) AS breakeven_threshold
  FROM impact3"""))
def q_t7(spark, sf_dir):
    return th.breakeven_threshold(impact(spark, sf_dir))


@register("t8_optimal_roi_threshold", sql_with(
    *IMPACT_CTES, select="SELECT * FROM impact3 ORDER BY roi DESC, threshold LIMIT 1"))
def q_t8(spark, sf_dir):
    return th.optimal_roi_threshold(impact(spark, sf_dir))


@register("t9_nearest_threshold", sql_with(
    *SWEEP_CTES, select="SELECT * FROM sweep ORDER BY ABS(threshold - 0.5), threshold LIMIT 1"))
def q_t9(spark, sf_dir):
    return th.nearest_threshold(sweep(spark, sf_dir), 0.5)


_T10_PICKS = """
  SELECT 'default_threshold' AS strategy, * FROM (
    SELECT * FROM wide ORDER BY ABS(threshold - 0.5), threshold LIMIT 1)
  UNION ALL SELECT 'optimal_f1', * FROM (SELECT * FROM wide ORDER BY f1 DESC, threshold LIMIT 1)
  UNION ALL SELECT 'optimal_business', * FROM (
    SELECT * FROM wide ORDER BY net_profit DESC, threshold LIMIT 1)"""
_T10_VALUES = """
  SELECT strategy,
    CASE WHEN strategy = 'default_threshold' THEN CAST(0.5 AS DOUBLE) ELSE threshold END AS threshold,
    precision * 100 AS precision_pct, recall * 100 AS recall_pct, f1,
    CAST(total_targeted AS DOUBLE) AS total_targeted,
    CAST(high_earners_reached AS DOUBLE) AS high_earners_reached,
    CAST(low_earners_reached AS DOUBLE) AS low_earners_reached, net_profit, roi
  FROM picks"""
_T10_LONG = " UNION ALL ".join(
    f"SELECT strategy, {n} AS metric_order, '{label}' AS metric, {c} AS value FROM vals"
    for n, (label, c) in enumerate(th.COMPARISON_METRICS, start=1))


@register("t10_strategy_comparison", sql_with(
    *IMPACT_CTES,
    ("wide", "SELECT sweep.*, i.total_targeted, i.high_earners_reached, i.low_earners_reached, "
             "i.high_earners_missed, i.total_revenue, i.total_cost, i.net_profit, i.roi, "
             "i.cpa_high_earner, i.profit_per_target "
             "FROM sweep JOIN impact3 i ON sweep.threshold = i.threshold"),
    ("picks", _T10_PICKS), ("vals", _T10_VALUES), ("long", _T10_LONG),
    select="""
  SELECT CAST(metric_order AS INTEGER) AS metric_order, metric,
    MAX(CASE WHEN strategy = 'default_threshold' THEN value END) AS default_threshold,
    MAX(CASE WHEN strategy = 'optimal_f1' THEN value END) AS optimal_f1,
    MAX(CASE WHEN strategy = 'optimal_business' THEN value END) AS optimal_business
  FROM long GROUP BY metric_order, metric"""))
def q_t10(spark, sf_dir):
    sw = sweep(spark, sf_dir)
    return th.strategy_comparison(sw, th.business_impact(sw))


@register("p10_predict_with_threshold", sql_with(select="""
  SELECT person_id, CASE WHEN label = '50000+.' THEN 1 ELSE 0 END AS label, score,
         CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS prediction
  FROM persons"""))
def q_p10(spark, sf_dir):
    p = persons_input(spark, sf_dir)
    return p.select("person_id",
                    F.when(F.col("label") == "50000+.", 1).otherwise(0).alias("label"),
                    "score", predict_with_threshold("score", 0.5).alias("prediction"))
