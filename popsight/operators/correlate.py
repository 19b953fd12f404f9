"""Correlation.

Pearson r per column pair over pairwise-complete rows. Two scans of the
table, whatever the number of columns:

1. per column: count, sum, smallest and largest value;
2. the block Gram matrix of (z, z * z, m), where m marks the present values and
   z is the value less the column's mean, 0 where it is missing: m'm counts the common
   rows of a pair, z'm and (z * z)'m sum a column over them, z'z holds the products.

Every task adds up its own blocks with matrix products (Arrow batches; hundreds of columns would
otherwise be tens of thousands of aggregate functions) and hands over one row per column;
Spark sums these cell by cell, d * d cells a task with partial sums before the exchange.

Shifting by the mean keeps the sums numerically stable. A column that is constant on
the data (min = max) gives null, never a divide-by-zero error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import present
from ..schema import is_numeric


def _column_moments(values: DataFrame, d: int) -> list[tuple]:
    """(count, sum, min, max) per column: d rows on the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, lo, hi = np.zeros(d, np.int64), np.zeros(d), np.full(d, np.inf), np.full(d, -np.inf)
        for batch in batches:
            for i in range(d):
                x = batch.column(i).drop_null().to_numpy(zero_copy_only=False)
                if len(x):
                    n[i] += len(x)
                    total[i] += x.sum()
                    lo[i], hi[i] = min(lo[i], x.min()), max(hi[i], x.max())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), pa.array(n), pa.array(total), pa.array(lo), pa.array(hi)],
                                         ["i", "n", "s", "lo", "hi"])

    got = {r["i"]: r for r in values.mapInArrow(run, "i int, n long, s double, lo double, hi double").groupBy("i").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()}
    return [(got[i]["n"], got[i]["s"], got[i]["lo"], got[i]["hi"]) if i in got else (0, 0.0, 0.0, 0.0) for i in range(d)]


def _gram(values: DataFrame, shift: np.ndarray) -> DataFrame:
    """One row per pair (i, j): k common rows; over these a = sum z_i, b = sum z_j,
    aa = sum z_i^2, bb = sum z_j^2, ab = sum z_i z_j."""
    d = len(shift)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zz, zm, qm, mm = (np.zeros((d, d)) for _ in range(4))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float)
            here = ~np.isnan(x)
            z, m = np.where(here, x - shift, 0.0), here.astype(float)
            zz += z.T @ z
            zm += z.T @ m
            qm += (z * z).T @ m
            mm += m.T @ m
        blocks = [mm, zm, zm.T, qm, qm.T, zz]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32))] + [pa.array(b.tolist(), pa.list_(pa.float64())) for b in blocks],
                                         ["i", "k", "a", "b", "aa", "bb", "ab"])

    names = ["k", "a", "b", "aa", "bb", "ab"]
    rows = values.mapInArrow(run, "i int, " + ", ".join(f"{c} array<double>" for c in names))
    cells = rows.select("i", F.posexplode(F.arrays_zip(*names)).alias("j", "c")).where("i <= j")
    return cells.groupBy("i", "j").agg(*[F.sum(f"c.{c}").alias(c) for c in names])


def correlation_matrix(df: DataFrame, cols: list[str] | None = None,
                       exclude=("weight", "year"), digits: int | None = 9) -> DataFrame:
    """Long matrix (i, j, feature1, feature2, r) for every ordered pair,
    diagonal included; null where a column is constant on the pair's rows."""
    cols = cols or [c for c in df.columns if is_numeric(df, c) and c not in exclude]
    d = len(cols)
    values = df.select(*[present(df, c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    moments = _column_moments(values, d)
    shift = np.array([s / n if n else 0.0 for n, s, _, _ in moments])
    constant = F.array(*[F.lit(not n or lo == hi) for n, _, lo, hi in moments])      # one flag per column
    cov, vx, vy = (f"({p} / k - ({x} / k) * ({y} / k))" for p, x, y in (("ab", "a", "b"), ("aa", "a", "a"), ("bb", "b", "b")))
    r = F.expr(f"CASE WHEN k > 0 THEN CASE WHEN {vx} > 0 AND {vy} > 0 THEN CASE WHEN i = j THEN 1.0D ELSE {cov} / sqrt({vx} * {vy}) END END END")
    r = F.when(~F.get(constant, F.col("i")) & ~F.get(constant, F.col("j")), F.round(r, digits) if digits is not None else r)
    if any(n for n, *_ in moments):
        half = _gram(values, shift).select("i", "j", r.alias("r"))
    else:                                                        # no value at all
        half = df.sparkSession.createDataFrame([(i, j, None) for i in range(d) for j in range(i, d)], "i int, j int, r double")
    both = half.select(F.explode(F.when(F.col("i") == F.col("j"), F.array(F.struct("i", "j"))).otherwise(F.array(
        F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))))).alias("at"), "r")
    names = F.array(*[F.lit(c) for c in cols])
    return both.select("at.i", F.col("at.j").cast("int").alias("j"), F.get(names, F.col("at.i")).alias("feature1"),
                       F.get(names, F.col("at.j")).alias("feature2"), F.col("r").cast("double").alias("r"))


def correlation_lower_triangle(corr: DataFrame) -> DataFrame:
    """The cells a k=1 upper mask leaves visible (j <= i)."""
    return corr.where(F.col("j") <= F.col("i"))


def high_correlation_pairs(corr: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Pairs i < j with |r| above the threshold."""
    return corr.where((F.col("i") < F.col("j")) & (F.abs(F.col("r")) > F.lit(threshold))).select(
        "feature1", "feature2", F.col("r").alias("correlation"))


def correlation_wide(corr: DataFrame, cols: list[str]) -> DataFrame:
    """S6 shape: one row per feature with a column per feature."""
    return (corr.groupBy("i", "feature1").pivot("feature2", cols).agg(F.first("r"))
            .orderBy("i").drop("i").withColumnRenamed("feature1", "feature"))
