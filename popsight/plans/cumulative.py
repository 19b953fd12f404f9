"""Exact running totals over an ordered key without a single-task window.

A window ``orderBy`` with no ``partitionBy`` moves every row to one task.
Curves over distinct scores (ROC, PR, average precision) need running totals
over a table that can itself be data-sized (continuous scores), so the order
range is cut into quantile buckets: bucket bounds come from one
``percentile_approx`` sketch (a bounded list of ``buckets`` values), per-bucket
totals (<= buckets rows) give every bucket its offset, and a window
partitioned by bucket finishes the sums in parallel. Bucket edges only decide
which task does the work; the sums are exact whatever the bounds are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_COL = "_bucket"


def bucket_of(value: Column, bounds: list[float]) -> Column:
    """Number of bounds strictly below ``value`` as a balanced CASE tree:
    log2(len(bounds)) comparisons per row, all inside codegen."""
    def build(lo: int, hi: int) -> Column:
        # answer lies in [lo, hi]; bounds[lo:hi] decide it
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value <= F.lit(bounds[mid]), build(lo, mid)).otherwise(build(mid + 1, hi))
    return build(0, len(bounds)) if bounds else F.lit(0)


def default_buckets(spark) -> int:
    """Ranges to sort in parallel: as many as the session has shuffle partitions, 64 at least."""
    return max(64, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def running_totals(df: DataFrame, order_col: str, value_cols: list[str],
                   descending: bool = True, bounds: list[float] | None = None,
                   buckets: int | None = None, prefix: str = "cum_") -> DataFrame:
    """Add ``cum_<c>`` = sum of ``c`` over all rows whose ``order_col`` comes at
    or before this row's in the given direction (inclusive). ``order_col``
    should be unique per row (group first). Without ``bounds`` the cut points
    come from one sketch pass over ``df``."""
    if bounds is None:
        buckets = buckets or default_buckets(df.sparkSession)
        probs = [i / buckets for i in range(1, buckets)]
        qs = df.agg(F.percentile_approx(order_col, probs, 10000)).first()[0] or []
        bounds = sorted({float(v) for v in qs if v is not None and math.isfinite(v)})
    g = df.withColumn(BUCKET_COL, bucket_of(F.col(order_col), bounds))

    totals = g.groupBy(BUCKET_COL).agg(*[F.sum(c).alias(c) for c in value_cols])
    border = F.desc(BUCKET_COL) if descending else F.asc(BUCKET_COL)
    before = Window.orderBy(border).rowsBetween(Window.unboundedPreceding, -1)
    # <= len(bounds)+1 rows: bounded, safe to order in one task and to broadcast.
    offsets = totals.select(
        BUCKET_COL, *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_off_{c}")
                      for c in value_cols])

    korder = F.desc(order_col) if descending else F.asc(order_col)
    inner = (Window.partitionBy(BUCKET_COL).orderBy(korder)
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    joined = g.join(F.broadcast(offsets), BUCKET_COL)
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[(F.sum(c).over(inner) + F.col(f"_off_{c}")).alias(f"{prefix}{c}")
          for c in value_cols])
