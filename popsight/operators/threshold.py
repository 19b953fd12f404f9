"""Threshold sweep and campaign analysis over a scored table ``(label, score)``.

Scale shape: the scored table is reduced in ONE map-side-combined
aggregation to counts per (grid cell, class) -- at most 82 x 2 rows no matter
how many rows are scored -- and everything after that (running totals,
campaign money, best-threshold picks) runs on that bounded table. No
nested-loop join of rows against the grid, no global sort of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col, f1_score, ratio_or_zero

# The sweep grid 0.10, 0.11, ..., 0.90 (81 points).
GRID_START = 0.1
GRID_STEP = 0.01
GRID_POINTS = 81


def grid_threshold(i: Column) -> Column:
    """Threshold of grid point ``i`` in double arithmetic (0.1 + i * 0.01)."""
    return F.lit(GRID_START) + i.cast("double") * F.lit(GRID_STEP)


def grid_index(score: str | Column) -> Column:
    """Largest grid index ``i`` with ``threshold(i) <= score``; -1 if none.

    The division gives a candidate that float rounding can put one cell off;
    comparing against the exact grid values fixes it, so ``score >= t`` is
    decided exactly as the row-by-row comparison would.
    """
    s = col(score)
    clamped = F.least(F.greatest(s, F.lit(-1.0)), F.lit(2.0))
    c0 = F.least(F.greatest(F.floor((clamped - F.lit(GRID_START)) / F.lit(GRID_STEP)),
                            F.lit(-1)), F.lit(GRID_POINTS - 1))
    up = (c0 < F.lit(GRID_POINTS - 1)) & (grid_threshold(c0 + 1) <= s)
    down = (c0 >= F.lit(0)) & (grid_threshold(c0) > s)
    fixed = F.when(up, c0 + 1).when(down, c0 - 1).otherwise(c0)
    return F.when(s.isNull() | F.isnan(s), F.lit(-1)).otherwise(fixed).cast("int")


def threshold_sweep(scored: DataFrame, label: str = "label", score: str = "score",
                    positive=1) -> DataFrame:
    """For thresholds 0.10..0.90 -> threshold, precision, recall, f1,
    tp, fp, tn, fn (precision/recall/f1 are 0 when undefined)."""
    spark = scored.sparkSession
    y = col(label) == F.lit(positive)
    counts = (scored
              .select(grid_index(score).alias("k"), y.alias("y"))
              .groupBy("k")
              .agg(F.count_if(F.col("y")).alias("pos"),
                   F.count_if(~F.col("y") | F.col("y").isNull()).alias("neg")))
    cells = (spark.range(-1, GRID_POINTS).select(F.col("id").cast("int").alias("k"))
             .join(F.broadcast(counts), "k", "left")
             .select("k", F.coalesce("pos", F.lit(0)).alias("pos"),
                     F.coalesce("neg", F.lit(0)).alias("neg")))
    # Running totals from the top grid cell down: rows with score >= t(k).
    # Bounded to 82 rows, so an unpartitioned window is cheap here.
    down = Window.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy()
    run = cells.select(
        "k",
        F.sum("pos").over(down).alias("tp"),
        F.sum("neg").over(down).alias("fp"),
        F.sum("pos").over(whole).alias("p_total"),
        F.sum("neg").over(whole).alias("n_total"))
    out = (run.where(F.col("k") >= 0)
           .select(grid_threshold(F.col("k")).alias("threshold"),
                   F.col("tp").cast("bigint").alias("tp"),
                   F.col("fp").cast("bigint").alias("fp"),
                   (F.col("n_total") - F.col("fp")).cast("bigint").alias("tn"),
                   (F.col("p_total") - F.col("tp")).cast("bigint").alias("fn")))
    p = ratio_or_zero(F.col("tp"), F.col("tp") + F.col("fp"))
    r = ratio_or_zero(F.col("tp"), F.col("tp") + F.col("fn"))
    out = out.withColumn("precision", p).withColumn("recall", r)
    f1 = f1_score(F.col("precision"), F.col("recall"))
    return out.select("threshold", "precision", "recall", f1.alias("f1"),
                      "tp", "fp", "tn", "fn")


def _top1(df: DataFrame, *order: Column) -> DataFrame:
    """First row in the given order (ties already broken by the caller)."""
    return df.orderBy(*order).limit(1)


def optimal_threshold_f1(sweep: DataFrame) -> DataFrame:
    """The sweep row with the highest F1; lowest threshold on ties."""
    return _top1(sweep, F.desc("f1"), F.asc("threshold"))


def optimal_threshold_precision(sweep: DataFrame, min_precision: float = 0.7) -> DataFrame:
    """Among rows with precision >= 0.7 the highest recall; if none, the
    highest precision. Lowest threshold on ties."""
    ok = F.col("precision") >= F.lit(min_precision)
    key = F.when(ok, F.col("recall")).otherwise(F.col("precision"))
    return _top1(sweep, F.desc(ok.cast("int")), F.desc(key), F.asc("threshold"))


def optimal_threshold_recall(sweep: DataFrame, min_recall: float = 0.8) -> DataFrame:
    """T4: among rows with recall >= 0.8 the highest precision; if none, the
    highest recall. Lowest threshold on ties."""
    ok = F.col("recall") >= F.lit(min_recall)
    key = F.when(ok, F.col("precision")).otherwise(F.col("recall"))
    return _top1(sweep, F.desc(ok.cast("int")), F.desc(key), F.asc("threshold"))


def optimize_threshold(sweep: DataFrame, objective: str = "balanced") -> DataFrame:
    """Dispatch on the objective name; unknown objectives fail up front."""
    if objective == "balanced":
        return optimal_threshold_f1(sweep)
    if objective == "precision":
        return optimal_threshold_precision(sweep)
    if objective == "recall":
        return optimal_threshold_recall(sweep)
    raise ValueError(f"unknown objective {objective!r}: use balanced, precision or recall")


def _with_campaign(df: DataFrame, marketing_cost: float, high_value: float,
                   low_value: float) -> DataFrame:
    """Add the campaign-money columns to any table with tp, fp, fn."""
    tp, fp = F.col("tp").cast("double"), F.col("fp").cast("double")
    targeted = F.col("tp") + F.col("fp")
    out = df.select(
        "*",
        targeted.cast("bigint").alias("total_targeted"),
        F.col("tp").cast("bigint").alias("high_earners_reached"),
        F.col("fp").cast("bigint").alias("low_earners_reached"),
        F.col("fn").cast("bigint").alias("high_earners_missed"),
        (tp * F.lit(high_value) + fp * F.lit(low_value)).alias("total_revenue"),
        (targeted.cast("double") * F.lit(float(marketing_cost))).alias("total_cost"))
    out = out.withColumn("net_profit", F.col("total_revenue") - F.col("total_cost"))
    return out.select(
        "*",
        F.when(F.col("total_cost") > 0,
               F.col("net_profit") / F.col("total_cost") * F.lit(100.0))
        .otherwise(F.lit(0.0)).alias("roi"),
        F.when(F.col("high_earners_reached") > 0,
               F.col("total_cost") / F.col("high_earners_reached"))
        .otherwise(F.lit(0.0)).alias("cpa_high_earner"),
        F.when(F.col("total_targeted") > 0,
               F.col("net_profit") / F.col("total_targeted"))
        .otherwise(F.lit(0.0)).alias("profit_per_target"))


IMPACT_COLUMNS = ("threshold", "precision", "recall", "total_targeted", "high_earners_reached",
                  "low_earners_reached", "high_earners_missed", "total_revenue", "total_cost",
                  "net_profit", "roi", "cpa_high_earner", "profit_per_target")


def business_impact(sweep: DataFrame, marketing_cost: float = 15,
                    high_earner_purchase: float = 200, low_earner_purchase: float = 60,
                    high_earner_conversion: float = 0.20,
                    low_earner_conversion: float = 0.05) -> DataFrame:
    """T5: campaign money per threshold. Defaults give net = 25*tp - 12*fp."""
    high_value = float(high_earner_purchase * high_earner_conversion)
    low_value = float(low_earner_purchase * low_earner_conversion)
    return _with_campaign(sweep, marketing_cost, high_value, low_value).select(*IMPACT_COLUMNS)


def optimal_business_threshold(impact: DataFrame) -> DataFrame:
    """The row with the highest net profit; lowest threshold on ties."""
    return _top1(impact, F.desc("net_profit"), F.asc("threshold"))


def breakeven_threshold(impact: DataFrame) -> DataFrame:
    """Lowest threshold whose net profit is >= 0 (null if none); one row."""
    return impact.agg(F.min(F.when(F.col("net_profit") >= 0, F.col("threshold")))
                      .alias("breakeven_threshold"))


def optimal_roi_threshold(impact: DataFrame) -> DataFrame:
    """The row with the highest ROI; lowest threshold on ties."""
    return _top1(impact, F.desc("roi"), F.asc("threshold"))


def nearest_threshold(sweep: DataFrame, target: float = 0.5) -> DataFrame:
    """The sweep row whose threshold is closest to ``target``."""
    return _top1(sweep, F.abs(F.col("threshold") - F.lit(float(target))), F.asc("threshold"))


# The strategy-comparison layout (metric order and names).
COMPARISON_METRICS = (
    ("Threshold", "threshold"),
    ("Precision (%)", "precision_pct"),
    ("Recall (%)", "recall_pct"),
    ("F1-Score", "f1"),
    ("People Targeted", "total_targeted"),
    ("High Earners Reached", "high_earners_reached"),
    ("Low Earners Reached", "low_earners_reached"),
    ("Net Profit ($)", "net_profit"),
    ("ROI (%)", "roi"),
)


def strategy_comparison(sweep: DataFrame, impact: DataFrame | None = None,
                        default_threshold: float = 0.5, **costs) -> DataFrame:
    """The 9 comparison metrics for the default threshold, the best-F1
    threshold and the best-profit threshold, every cell filled from the
    sweep/campaign row of that threshold. The three rows are picked in ONE
    aggregation over the (81-row) sweep. Output: metric_order, metric,
    default_threshold, optimal_f1, optimal_business."""
    high_value = float(costs.get("high_earner_purchase", 200)
                       * costs.get("high_earner_conversion", 0.20))
    low_value = float(costs.get("low_earner_purchase", 60)
                      * costs.get("low_earner_conversion", 0.05))
    wide = _with_campaign(sweep, costs.get("marketing_cost", 15), high_value, low_value)
    row = F.struct(
        F.col("threshold").alias("threshold"),
        (F.col("precision") * F.lit(100.0)).alias("precision_pct"),
        (F.col("recall") * F.lit(100.0)).alias("recall_pct"),
        F.col("f1").alias("f1"),
        F.col("total_targeted").cast("double").alias("total_targeted"),
        F.col("high_earners_reached").cast("double").alias("high_earners_reached"),
        F.col("low_earners_reached").cast("double").alias("low_earners_reached"),
        F.col("net_profit").alias("net_profit"), F.col("roi").alias("roi"))
    t = F.col("threshold")
    picks = wide.agg(
        # nearest to the default (lower threshold on ties), best F1 and best
        # profit (lowest threshold on ties)
        F.min_by(row, F.struct(F.abs(t - F.lit(float(default_threshold))), t))
        .alias("default_threshold"),
        F.max_by(row, F.struct(F.col("f1"), -t)).alias("optimal_f1"),
        F.max_by(row, F.struct(F.col("net_profit"), -t)).alias("optimal_business"))
    picks = picks.withColumn("default_threshold", F.col("default_threshold").withField(
        "threshold", F.lit(float(default_threshold))))
    stack = ", ".join(
        f"{n}, '{label}', default_threshold.{c}, optimal_f1.{c}, optimal_business.{c}"
        for n, (label, c) in enumerate(COMPARISON_METRICS, start=1))
    return picks.selectExpr(
        f"stack({len(COMPARISON_METRICS)}, {stack}) AS (metric_order, metric, "
        "default_threshold, optimal_f1, optimal_business)")
