"""Segmentation metrics, profiles, personas and rules.

Points are rows with an array<double>-castable feature column and a segment
id. Cluster statistics (count, mean, variance and squared norm per dimension) come
from ONE scan: one mergeable moment aggregate per cluster (Spark ML's
``Summarizer``), combined map-side to k rows a task, whatever the number of dimensions. Inertia and
Calinski-Harabasz follow from these alone; metrics that need every point's
distance read the points once more, with the centroids as one packed value
(a scalar subquery, not literals in the plan; the silhouette takes them to Arrow batches): no join of points against
centroids and no pairs of points. The silhouette comes in two forms: squared Euclidean (closed
form, here) and Euclidean (:mod:`popsight.operators.silhouette`).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions.columns import persona_age_group
from ..plans.store import stored
from ..schema import q
from .encode import standard_scale
from .profile import income_crosstab

#: Numbers of centroids (k x d) that one packed value or the driver may hold: 32 MB.
MAX_CENTROID_NUMBERS = 4_000_000


def _x(features: str) -> Column:
    return F.col(q(features)).cast("array<double>")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, y: acc + y)


def _sqdist(x: Column, c: Column) -> Column:
    return _sum(F.zip_with(x, c, lambda a, b: (a - b) * (a - b)))


def _norm2(x: Column) -> Column:
    return _sum(F.transform(x, lambda y: y * y))


@dataclass
class ClusterStats:
    """Per cluster one stored row: segment, n, mean, sq (sum of squared norms), within
    (sum of squared distances to the mean). ``k``, ``d`` and ``total`` are
    counted; whatever holds k x d numbers elsewhere checks them first."""
    table: DataFrame
    k: int
    d: int
    total: int

    def check(self) -> None:
        if self.k * self.d > MAX_CENTROID_NUMBERS:
            raise ValueError(f"{self.k} centroids of {self.d} dimensions are more than {MAX_CENTROID_NUMBERS} numbers; "
                             "inertia() and calinski_harabasz() work from the table")

    @cached_property
    def mean(self) -> dict[int, list[float]]:
        """Mean vector per segment on the driver."""
        self.check()
        return {r["segment"]: list(r["mean"]) for r in self.table.select("segment", "mean").collect()}

    def packed(self) -> Column:
        """All centroids as one array value: (segment, mean, n, sq), by segment."""
        self.check()
        return self.table.agg(F.array_sort(F.collect_list(F.struct("segment", "mean", "n", "sq")))).scalar()

    def own(self, points: DataFrame, features: str, segment: str) -> DataFrame:
        """(segment, squared distance to the own centroid) of every point. The centroids
        are joined by segment: Spark broadcasts the stored table below its threshold."""
        c = self.table.select(F.col("segment").alias("_s"), F.col("mean").alias("_m"))
        return points.select(F.col(q(segment)).alias("segment"), _x(features).alias("_x")).join(
            c, F.col("segment") == F.col("_s")).select("segment", _sqdist(F.col("_x"), F.col("_m")).alias("d"))


def cluster_stats(points: DataFrame, features: str = "features", segment: str = "segment"
                  ) -> ClusterStats:
    """One grouped scan with one mergeable aggregate; points without features or segment
    are left out."""
    x = _x(features)
    moments = Summarizer.metrics("mean", "variance", "normL2").summary(array_to_vector(x))
    raw = (points.where(x.isNotNull() & F.col(q(segment)).isNotNull()).groupBy(F.col(q(segment)).alias("segment"))
           .agg(F.count("*").alias("n"), moments.alias("m")))
    table = stored(raw.select(
        "segment", "n", vector_to_array("m.mean").alias("mean"), _norm2(vector_to_array("m.normL2")).alias("sq"),
        (_sum(vector_to_array("m.variance")) * (F.col("n") - 1)).alias("within")), "clusters")
    r = table.agg(F.count("*").alias("k"), F.max(F.size("mean")).alias("d"), F.sum("n").alias("n")).first()
    return ClusterStats(table, r["k"], r["d"] or 0, r["n"] or 0)


def assign_nearest(points: DataFrame, centroids: dict[int, list[float]],
                   features: str = "features", out: str = "segment") -> DataFrame:
    """K2: nearest centroid (squared Euclidean, smallest id on ties) and the
    squared distance to it."""
    if sum(map(len, centroids.values())) > MAX_CENTROID_NUMBERS:
        raise ValueError(f"more than {MAX_CENTROID_NUMBERS} numbers of centroids")
    ids = sorted(centroids)
    packed = points.sparkSession.createDataFrame([(ids, [[float(v) for v in centroids[k]] for k in ids])],
                                                 "ids array<int>, means array<array<double>>")
    best = F.array_min(F.transform("_centroids", lambda c: F.struct(
        _sqdist(_x(features), c["means"]).alias("d"), c["ids"].alias("c"))))
    return (points.withColumn("_centroids", packed.select(F.arrays_zip("ids", "means")).scalar())
            .withColumn("_best", best).withColumn(out, F.col("_best.c"))
            .withColumn("distance", F.col("_best.d")).drop("_best", "_centroids"))


def lloyd(points: DataFrame, start: dict[int, list[float]], steps: int, features: str = "features",
          out: str = "segment") -> tuple[DataFrame, dict[int, list[float]]]:
    """K1 from given centroids: ``steps`` times assign every point to the nearest centroid
    (smallest id on ties) and move each centroid to the mean of its points; one that has lost
    all its points stays. Returns the points with their segment under the last centroids
    and the squared distance, and these centroids. Each step is one scan with one mergeable aggregate."""
    points = points.where(F.col(q(features)).isNotNull())
    centroids = dict(start)
    for _ in range(steps):
        centroids |= cluster_stats(assign_nearest(points, centroids, features, "_seg"), features, "_seg").mean
    return assign_nearest(points, centroids, features, out), centroids


def inertia(stats: ClusterStats) -> DataFrame:
    """K3: sum over points of the squared distance to their own centroid, from the
    clusters' variances: no further scan."""
    return stats.table.agg(F.sum("within").alias("inertia"))


def silhouette_sq(points: DataFrame, stats: ClusterStats, features: str = "features",
                  segment: str = "segment") -> DataFrame:
    """K4: mean silhouette with squared Euclidean distance, exact and linear:
    the mean squared distance from x to cluster C is
    ||x||^2 + Y_C / n_C - 2 x . mean_C; the own cluster is rescaled by
    n / (n - 1) to leave x itself out; singleton clusters score 0. A batch of points meets all
    centroids in one matrix product."""
    stats.check()
    clusters = stats.table.select("segment", "mean", "n", "sq").orderBy("segment").collect()         # k rows
    n = np.array([r["n"] for r in clusters], float)
    mean, spread = np.array([r["mean"] for r in clusters], float).reshape(len(n), stats.d), np.array([r["sq"] for r in clusters], float) / n
    known = stats.table.agg(F.array_sort(F.collect_list("segment"))).scalar()
    own = F.array_position(known, F.col(q(segment)).cast(stats.table.schema["segment"].dataType))
    rows = points.select(F.coalesce(own.cast("int") - 1, F.lit(-1)).alias("_own"), _x(features).alias("_x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, step = mean.shape[1], max(1, 1_000_000 // max(1, len(n)))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                own, vectors, m = part.column("_own").to_numpy(), part.column("_x"), part.num_rows
                if (own < 0).any():
                    raise ValueError("a point has no segment")
                whole, flat = np.ones(m, bool), vectors.flatten()
                if vectors.null_count or flat.null_count or len(flat) != m * width or len({*vectors.value_lengths().to_pylist()}) > 1:
                    values = [v if v is not None and len(v) == width and None not in v else None for v in vectors.to_pylist()]
                    whole = np.array([v is not None for v in values], bool)
                    x = np.array([v if v is not None else [0.0] * width for v in values], float).reshape(m, width)
                else:
                    x = flat.to_numpy(zero_copy_only=False).reshape(m, width)
                to = (x ** 2).sum(1)[:, None] + spread - 2.0 * (x @ mean.T)
                a, b, each = np.zeros(m), np.zeros(m), np.arange(m)
                a[:] = to[each, own] * n[own] / np.maximum(n[own] - 1, 1)
                to[each, own] = np.nan
                if len(n) > 1:
                    b[:] = np.fmin.reduce(to, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(a, mask=~whole | (n[own] <= 1)), pa.array(b, mask=~whole | (len(n) < 2))], ["_a", "_b"])

    return rows.mapInArrow(run, "_a double, _b double").agg(F.avg(silhouette_of(F.col("_a"), F.col("_b"))).alias("silhouette"))


def silhouette_of(a: Column, b: Column) -> Column:
    """One point's silhouette from its mean distance to its own and to the nearest other cluster."""
    return (F.when(a.isNull() | b.isNull(), F.lit(0.0))
            .when(a < b, F.lit(1.0) - a / b).when(a > b, b / a - F.lit(1.0)).otherwise(F.lit(0.0)))


def calinski_harabasz(stats: ClusterStats) -> DataFrame:
    """K5: (between / (k - 1)) / (within / (n - k)); 1.0 when within is 0. From the
    cluster table alone: no further scan."""
    k, n = stats.k, stats.total
    if k < 2:
        raise ValueError("calinski_harabasz needs at least two segments")
    t = stats.table
    grand = t.agg(Summarizer.metrics("mean").summary(array_to_vector("mean"), F.col("n").cast("double")).alias("g")).select(
        vector_to_array("g.mean")).scalar()
    between = F.sum(F.col("n") * _sqdist(F.col("mean"), F.col("_grand"))).alias("b")
    return t.withColumn("_grand", grand).agg(between, F.sum("within").alias("w")).select(
        F.when(F.col("w") == 0, F.lit(1.0)).otherwise(
            F.col("b") * F.lit(float(n - k)) / (F.col("w") * F.lit(float(k - 1)))).alias("calinski_harabasz"))


def davies_bouldin(points: DataFrame, stats: ClusterStats, features: str = "features",
                   segment: str = "segment") -> DataFrame:
    """K6: mean over clusters of max_j (s_i + s_j) / d_ij, with s the mean
    Euclidean distance of a cluster's points to its centroid; coincident centroids count 0.
    The points are read once; then k rows meet the packed centroids."""
    spread = stats.own(points, features, segment).groupBy("segment").agg(F.avg(F.sqrt("d")).alias("s"))
    rows = stored(spread.join(stats.table.select("segment", "mean"), "segment"), "spreads")      # k rows
    stats.check()
    others = rows.agg(F.collect_list(F.struct("segment", "mean", "s"))).scalar()
    ratio = F.transform("_others", lambda o: F.when(o["segment"] == F.col("segment"), F.lit(None)).otherwise(F.coalesce(
        F.try_divide(F.col("s") + o["s"], F.sqrt(_sqdist(F.col("mean"), o["mean"]))), F.lit(0.0))))
    return rows.withColumn("_others", others).agg(
        F.avg(F.coalesce(F.array_max(ratio), F.lit(0.0))).alias("davies_bouldin"))


# ------------------------------------------------------------- K8 / K9 / K10


def segment_profiles(df: DataFrame, segment: str = "segment", label: str = "label",
                     age: str = "age", weeks: str = "weeks_worked",
                     gains: str = "capital_gains", dividends: str = "dividends",
                     basis: str = "raw") -> DataFrame:
    """K8: per segment size, %, mean and sample std of age, low/high income %,
    mean weeks worked, % with capital gains, mean gains, % with dividends.
    ``basis='scaled'`` standardises the numeric columns first (the reference's
    meaning: means are z-means and "has gains" is "above the mean")."""
    cols = [age, weeks, gains, dividends]
    data = standard_scale(df, cols) if basis == "scaled" else df
    g = data.groupBy(F.col(q(segment)).alias("segment")).agg(
        F.count("*").alias("size"),
        F.avg(F.col(q(age))).alias("avg_age"), F.stddev_samp(F.col(q(age))).alias("age_std"),
        F.count_if(F.col(q(label)) == 0).alias("_low"), F.count_if(F.col(q(label)) == 1).alias("_high"),
        F.avg(F.col(q(weeks))).alias("avg_weeks_worked"),
        F.count_if(F.col(q(gains)) > 0).alias("_gains"),
        F.avg(F.col(q(gains))).alias("avg_capital_gains"),
        F.count_if(F.col(q(dividends)) > 0).alias("_div"))
    total = F.sum("size").over(Window.partitionBy())     # one row per segment: bounded
    return g.select(
        "segment", "size", (F.col("size") / total * F.lit(100.0)).alias("percentage"),
        "avg_age", "age_std",
        (F.col("_low") / F.col("size") * F.lit(100.0)).alias("low_income_pct"),
        (F.col("_high") / F.col("size") * F.lit(100.0)).alias("high_income_pct"),
        "avg_weeks_worked",
        (F.col("_gains") / F.col("size") * F.lit(100.0)).alias("pct_with_capital_gains"),
        "avg_capital_gains",
        (F.col("_div") / F.col("size") * F.lit(100.0)).alias("pct_with_dividends"))


def segment_personas(df: DataFrame, categorical: list[str], segment: str = "segment",
                     label: str = "label", age: str = "age", weeks: str = "weeks_worked",
                     gains: str = "capital_gains", dividends: str = "dividends") -> DataFrame:
    """K9: per segment the mode of each categorical column (smallest on ties,
    'Unknown' when the segment has no value), mean age and its age group,
    mean weeks, high-income %, % with gains, % with dividends."""
    seg = F.col(q(segment))
    num = df.groupBy(seg.alias("segment")).agg(
        F.count("*").alias("size"), F.avg(F.col(q(age)).cast("double")).alias("avg_age"),
        F.avg(F.col(q(weeks)).cast("double")).alias("avg_weeks_worked"),
        (F.count_if(F.col(q(label)) == 1) / F.count("*") * F.lit(100.0)).alias("high_income_rate"),
        (F.count_if(F.col(q(gains)) > 0) / F.count("*") * F.lit(100.0))
        .alias("pct_with_capital_gains"),
        (F.count_if(F.col(q(dividends)) > 0) / F.count("*") * F.lit(100.0))
        .alias("pct_with_dividends"))
    num = num.withColumn("age_group", persona_age_group(F.col("avg_age")))
    # modes per (segment, column): one unpivot + one grouped count
    numeric = {c for c in categorical if isinstance(df.schema[c].dataType, NumericType)}
    long = df.select(seg.alias("segment"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(q(c)).cast("string").alias("value"),
                 (F.col(q(c)).cast("double") if c in numeric else F.lit(None).cast("double"))
                 .alias("dvalue"))
        for c in categorical])).alias("kv")).select("segment", "kv.*").where(
        F.col("value").isNotNull())
    # ties -> smallest value (numeric order for numeric columns)
    best = (long.groupBy("segment", "column_name", "value", "dvalue").agg(F.count("*").alias("cnt"))
            .groupBy("segment", "column_name")
            .agg(F.min(F.struct((-F.col("cnt")).alias("neg"), "dvalue", "value")).alias("b"))
            .groupBy("segment").pivot("column_name", categorical).agg(F.first("b.value")))
    out = num.join(best, "segment", "left")
    return out.select("segment", "size",
                      *[F.coalesce(F.col(q(c)), F.lit("Unknown")).alias(c) for c in categorical],
                      "avg_age", "age_group", "avg_weeks_worked", "high_income_rate",
                      "pct_with_capital_gains", "pct_with_dividends")


def segment_income_crosstab(df: DataFrame, segment: str = "segment", label: str = "label"
                            ) -> DataFrame:
    """Income split (% low, % high) per segment."""
    return income_crosstab(df, segment, label, negative=0, positive=1, by_name="segment")


# ------------------------------------------------------------- K12

# Tiers, strategies, channels and messages of the segment rules.
TIER_PREMIUM = ("Premium", "High-touch relationship building, premium product offerings", "High")
TIER_CORE = ("Core", "Balanced approach, focus on value proposition and quality", "Medium")
TIER_GROWTH = ("Growth", "Volume-based, cost-effective marketing with accessibility focus", "Low")
CHANNELS_INVESTORS = ("Financial advisors", "Private banking", "Wealth management seminars",
                      "Premium publications")
MESSAGING_INVESTORS = ("Wealth preservation", "Investment opportunities", "Exclusive access",
                       "Legacy planning")
CHANNELS_PROFESSIONALS = ("LinkedIn", "Professional networks", "Email", "Business publications")
MESSAGING_PROFESSIONALS = ("Career advancement", "Time-saving solutions", "Premium quality",
                           "Status")
CHANNELS_WORKERS = ("Social media", "Email", "Mobile apps", "Workplace programs")
MESSAGING_WORKERS = ("Value for money", "Convenience", "Work-life balance", "Practical solutions")
CHANNELS_RETIREES = ("Traditional media", "Community centers", "Direct mail", "Local events")
MESSAGING_RETIREES = ("Reliability", "Trust", "Community", "Legacy")
CHANNELS_STARTERS = ("Social media", "Digital platforms", "Student programs", "Community outreach")
MESSAGING_STARTERS = ("Affordability", "Accessibility", "Future potential", "Opportunity")


def _arr(vals) -> Column:
    return F.array(*[F.lit(v) for v in vals])


def segment_rules(profiles: DataFrame, personas: DataFrame) -> DataFrame:
    """Value tier by high-income % (> 20 Premium, > 8 Core, else Growth)
    with its strategy and budget; channels and messaging by the first rule
    that holds: gains % > 50 or dividends % > 30 (investors); mean weeks
    > 0.5 (a z-mean: above average) with high-income % > 10 (professionals)
    or not (workers); mean age > 55 (retirees); else starters. A segment
    without persona uses age 35."""
    p = profiles.select("segment", "high_income_pct", "avg_weeks_worked",
                        "pct_with_capital_gains", "pct_with_dividends")
    j = p.join(personas.select("segment", F.col("avg_age").alias("_age")), "segment", "left")
    hi = F.coalesce(F.col("high_income_pct"), F.lit(0.0))
    weeks = F.coalesce(F.col("avg_weeks_worked"), F.lit(0.0))
    gains = F.coalesce(F.col("pct_with_capital_gains"), F.lit(0.0))
    div = F.coalesce(F.col("pct_with_dividends"), F.lit(0.0))
    age = F.coalesce(F.col("_age"), F.lit(35.0))

    def tier(i):
        return (F.when(hi > 20, F.lit(TIER_PREMIUM[i])).when(hi > 8, F.lit(TIER_CORE[i]))
                .otherwise(F.lit(TIER_GROWTH[i])))

    investors = (gains > 50) | (div > 30)
    working = weeks > 0.5
    pro = working & (hi > 10)
    retired = age > 55

    def pick(a, b, c, d, e):
        return (F.when(investors, _arr(a)).when(pro, _arr(b)).when(working, _arr(c))
                .when(retired, _arr(d)).otherwise(_arr(e)))

    channels = pick(CHANNELS_INVESTORS, CHANNELS_PROFESSIONALS, CHANNELS_WORKERS,
                    CHANNELS_RETIREES, CHANNELS_STARTERS)
    messaging = pick(MESSAGING_INVESTORS, MESSAGING_PROFESSIONALS, MESSAGING_WORKERS,
                     MESSAGING_RETIREES, MESSAGING_STARTERS)
    return j.select("segment", tier(0).alias("value_tier"), hi.alias("high_income_rate"),
                    tier(1).alias("marketing_strategy"), channels.alias("recommended_channels"),
                    F.concat_ws(", ", messaging).alias("messaging_focus"),
                    tier(2).alias("budget_allocation"))
