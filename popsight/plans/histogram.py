"""Equal-width histograms with numpy's bin rules, per group.

Edges are ``lo + i * (hi - lo) / bins`` with the last edge exactly ``hi``;
a value goes to bin ``i`` when ``edge_i <= x < edge_{i+1}``, the last bin is
closed, and a constant group uses ``[v - 0.5, v + 0.5]``. The division
``(x - lo) / (hi - lo) * bins`` only guesses the bin; one comparison with the
neighbouring edges makes it exact.

Shape: one aggregation for per-group min/max/count (one row per group), one
map-side-combined count per (group, bin), and a left join from the dense
(group x bins) grid so empty bins report 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import stored


def _edge(lo: Column, hi: Column, step: Column, i: Column, bins: int) -> Column:
    return F.when(i >= F.lit(bins), hi).otherwise(lo + i.cast("double") * step)


def equal_width_histogram(df: DataFrame, value: str, bins: int = 50,
                          by: list[str] | None = None) -> DataFrame:
    """Rows: *by, bin (0-based), bin_lower, bin_upper, count, density, n.

    The groups' parameters are written first, so their size is known when the
    join is planned: Spark broadcasts them below its threshold and joins by
    shuffle above it, where AQE splits a hot group."""
    keys = list(by or [])
    x = F.col(value).cast("double")
    if not keys:
        return _single_histogram(df, x, bins)
    data = df.select(*keys, x.alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    stats = data.groupBy(*keys).agg(F.min("x").alias("mn"), F.max("x").alias("mx"),
                                    F.count("*").alias("n"))
    same = F.col("mn") == F.col("mx")
    stats = stats.select(
        *keys, "n",
        F.when(same, F.col("mn") - F.lit(0.5)).otherwise(F.col("mn")).alias("lo"),
        F.when(same, F.col("mx") + F.lit(0.5)).otherwise(F.col("mx")).alias("hi"))
    stats = stored(stats.withColumn("step", (F.col("hi") - F.col("lo")) / F.lit(float(bins))), "bins")

    lo, hi, step = F.col("lo"), F.col("hi"), F.col("step")
    guess = F.floor((F.col("x") - lo) / (hi - lo) * F.lit(float(bins)))
    c = F.least(F.greatest(guess, F.lit(0)), F.lit(bins - 1))
    below = F.col("x") < _edge(lo, hi, step, c, bins)
    above = (c != F.lit(bins - 1)) & (F.col("x") >= _edge(lo, hi, step, c + 1, bins))
    b = F.when(below, c - 1).when(above, c + 1).otherwise(c).cast("int")
    joined = data.join(stats, keys)
    counts = joined.select(*keys, b.alias("bin")).groupBy(*keys, "bin").agg(
        F.count("*").alias("count"))

    grid = stats.select(*keys, "n", "lo", "hi", "step",
                        F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    i = F.col("bin")
    lower = _edge(lo, hi, step, i, bins)
    upper = _edge(lo, hi, step, i + 1, bins)
    out = grid.join(counts, keys + ["bin"], "left").select(
        *keys, "bin", lower.alias("bin_lower"), upper.alias("bin_upper"),
        F.coalesce(F.col("count"), F.lit(0)).cast("bigint").alias("count"), "n")
    density = (F.col("count").cast("double") / (F.col("bin_upper") - F.col("bin_lower"))
               / F.col("n").cast("double"))
    return out.select(*keys, "bin", "bin_lower", "bin_upper", "count",
                      density.alias("density"), "n")


def _single_histogram(df: DataFrame, x: Column, bins: int) -> DataFrame:
    """One group: its min/max/count (one row) become literals, so binning is
    a projection and no join is needed."""
    data = df.select(x.alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    st = data.agg(F.min("x").alias("mn"), F.max("x").alias("mx"), F.count("*").alias("n")).first()
    schema = "bin int, bin_lower double, bin_upper double, count bigint, density double, n bigint"
    if not st["n"]:
        return df.sparkSession.createDataFrame([], schema)
    lo_v, hi_v = (st["mn"] - 0.5, st["mx"] + 0.5) if st["mn"] == st["mx"] else (st["mn"], st["mx"])
    lo, hi = F.lit(float(lo_v)), F.lit(float(hi_v))
    step = F.lit((hi_v - lo_v) / float(bins))
    guess = F.floor((F.col("x") - lo) / (hi - lo) * F.lit(float(bins)))
    c = F.least(F.greatest(guess, F.lit(0)), F.lit(bins - 1))
    below = F.col("x") < _edge(lo, hi, step, c, bins)
    above = (c != F.lit(bins - 1)) & (F.col("x") >= _edge(lo, hi, step, c + 1, bins))
    b = F.when(below, c - 1).when(above, c + 1).otherwise(c).cast("int")
    counts = data.select(b.alias("bin")).groupBy("bin").agg(F.count("*").alias("count"))
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    i = F.col("bin")
    out = grid.join(counts, "bin", "left").select(
        "bin", _edge(lo, hi, step, i, bins).alias("bin_lower"),
        _edge(lo, hi, step, i + 1, bins).alias("bin_upper"),
        F.coalesce(F.col("count"), F.lit(0)).cast("bigint").alias("count"))
    n = F.lit(int(st["n"]))
    return out.select("*", (F.col("count").cast("double") / (F.col("bin_upper") - F.col("bin_lower"))
                            / n.cast("double")).alias("density"), n.alias("n"))
