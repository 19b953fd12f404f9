"""K4, Euclidean silhouette (the form the reference prints) in time linear in the points.

The exact value needs the distance of every pair of points. Here each
cluster is stood for by a sample drawn with probability proportional to size:

1. a pilot of ``pilot`` points per cluster (smallest hashes of the key);
2. one scan sums, for each pilot point, the distances of its cluster's points to it;
3. one scan gives each point the probability
   ``p = min(1, sample * max(1/n, max over pilots of distance / sum))``: points far out, which weigh most
   in a mean distance, are the likeliest. A point is drawn if a hash of its key lies below p;
4. one scan estimates each point's mean distance to each cluster as the mean over the drawn
   points, weighted by 1 / p (the point itself left out), and from these its silhouette.

Because p covers a fixed share of every point's possible part in the sum, the relative error
of a mean distance is of the order 1 / sqrt(sample) at most, whatever the number of
points or their spread, and less where distances are alike; the silhouette's error is at most about four times the
largest of these. A cluster of at most ``sample`` points is drawn whole, with p = 1: if all are, the result is exact.

Distances are blocks of matrix products in Arrow batches: a point meets k * sample vectors, which
Spark's row functions would take one number at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.store import stored
from ..plans.topk import top_k_per_group
from ..schema import q
from .segment import silhouette_of

#: Numbers (drawn points x dimensions) that go to every task at most: 160 MB.
MAX_SAMPLE_NUMBERS = 20_000_000
_TOP = float(2 ** 53)


def _uniform(key: Column, seed: int) -> Column:
    """Number in [0, 1) that follows from the key and the seed."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 11) / F.lit(_TOP)


def _drawn(rows: list) -> dict:
    """Per segment the vectors of the drawn points."""
    out: dict = {}
    for r in rows:
        out.setdefault(r["_s"], []).append(r["_x"])
    return {s: np.array(v, float) for s, v in out.items()}


def _checked(rows: int, d: int) -> None:
    if rows * d > MAX_SAMPLE_NUMBERS:
        raise ValueError(f"{rows} drawn points of {d} dimensions are more than {MAX_SAMPLE_NUMBERS} numbers: use a smaller sample")


def _with_distances(points: DataFrame, drawn: dict, give, schema: str) -> DataFrame:
    """mapInArrow over (_id, _s, _x): ``give`` gets the ids, the segments and a function that returns a
    segment's distances (rows x drawn points), and yields result batches."""
    squares = {s: (v ** 2).sum(1) for s, v in drawn.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width = max(1, max(len(v) for v in drawn.values()))
            step = max(1, 4_000_000 // width)                  # distances held at once
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                if not part.num_rows:
                    continue
                x = part.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                s = part.column("_s").to_numpy(zero_copy_only=False)

                def to(c, mask=slice(None)):
                    y, v = x[mask], drawn[c]
                    d2 = (y * y).sum(1)[:, None] + squares[c][None] - 2 * (y @ v.T)
                    near = d2 < 1e-6 * (squares[c][None] + 1)   # rounding eats small differences: take these anew
                    d2 = np.maximum(d2, 0)
                    for i, j in zip(*np.nonzero(near)):
                        d2[i, j] = ((y[i] - v[j]) ** 2).sum()
                    return np.sqrt(d2)

                yield from give(part, s, to)

    return points.mapInArrow(run, schema)


def silhouette(points: DataFrame, features: str = "features", segment: str = "segment", key: str = "id",
               sample: int = 1024, pilot: int = 16, seed: int = 42) -> DataFrame:
    """One row: silhouette (mean Euclidean silhouette over all points), points,
    drawn (points in the samples), exact (whether all are).

    ``key`` names a column that tells points apart. Points without features or segment are
    left out; a cluster of one point scores 0; one cluster alone gives 0, no
    point gives null. ``sample`` bounds what a cluster's sample is expected to hold: sample * (pilot + 1)
    points at most, about 2 * sample in practice.
    """
    rows = stored(points.where(F.col(q(features)).isNotNull() & F.col(q(segment)).isNotNull()).select(
        F.col(q(key)).alias("_id"), F.col(q(segment)).cast("long").alias("_s"), F.col(q(features)).cast("array<double>").alias("_x")),
        "silhouette-points")
    counted = {r["_s"]: r["n"] for r in rows.groupBy("_s").agg(F.count("*").alias("n")).collect()}      # k rows
    if not counted:
        return rows.agg(F.avg(F.lit(None).cast("double")).alias("silhouette"), F.count("*").alias("points"),
                        F.lit(0).cast("long").alias("drawn"), F.lit(True).alias("exact"))
    d = rows.select(F.size("_x")).first()[0]
    large = {s: n for s, n in counted.items() if n > sample}

    whole = rows.where(~F.col("_s").isin(list(large))) if large else rows
    picked = whole.withColumn("p", F.lit(1.0))
    if large:
        _checked(len(large) * pilot, d)
        many = rows.where(F.col("_s").isin(list(large)))
        first = top_k_per_group(many.withColumn("_u", F.xxhash64(F.lit(seed), "_id")), ["_s"], [F.asc("_u"), F.asc("_id")], pilot)
        pilots = _drawn(first.select("_s", "_x").collect())           # k x pilot points

        def totals(part, s, to):
            for c in np.unique(s):
                yield pa.RecordBatch.from_arrays([pa.array([int(c)]), pa.array([to(c, s == c).sum(0).tolist()])], ["_s", "w"])

        each = _with_distances(many, pilots, totals, "_s long, w array<double>")
        sums: dict = {}
        for r in (each.select("_s", F.posexplode("w").alias("j", "w")).groupBy("_s", "j").agg(F.sum("w").alias("w")).collect()):
            sums.setdefault(r["_s"], {})[r["j"]] = r["w"]                 # k x pilot numbers
        weight = {s: np.array([w[j] for j in sorted(w)]) for s, w in sums.items()}

        def chances(part, s, to):
            p = np.zeros(len(s))
            for c in np.unique(s):
                own = s == c
                share = to(c, own) / np.where(weight[c] > 0, weight[c], np.inf)
                p[own] = np.minimum(1.0, sample * np.maximum(share.max(1), 1.0 / large[c]))
            yield pa.RecordBatch.from_arrays([part.column("_id"), part.column("_s"), part.column("_x"), pa.array(p)], ["_id", "_s", "_x", "p"])

        kind = rows.schema["_id"].dataType.simpleString()
        likely = _with_distances(many, pilots, chances, f"_id {kind}, _s long, _x array<double>, p double")
        picked = picked.unionByName(likely.where(_uniform(F.col("_id"), seed + 1) < F.col("p")))
    # about 2 x sample points per cluster
    limit = MAX_SAMPLE_NUMBERS // max(d, 1) + 1
    chosen = picked.select("_id", "_s", "_x", "p").limit(limit).collect()
    _checked(len(chosen), d)
    drawn, odds = _drawn(chosen), {r["_id"]: 1.0 / r["p"] for r in chosen}
    weights: dict = {}
    for r in chosen:
        weights.setdefault(r["_s"], []).append(1.0 / r["p"])
    weights = {s: np.array(w) for s, w in weights.items()}

    def means(part, s, to):
        a, b = np.full(len(s), np.nan), np.full(len(s), np.inf)
        itself = np.array([odds.get(i, 0.0) for i in part.column("_id").to_pylist()])     # its own weight, if drawn
        for c, w in weights.items():
            total, own = to(c) @ w, s == c
            rest = w.sum() - itself[own]
            a[own] = np.where(rest > 1e-9, total[own] / np.where(rest > 1e-9, rest, 1), np.nan)
            b[~own] = np.minimum(b[~own], total[~own] / w.sum())
        yield pa.RecordBatch.from_arrays([pa.array(a, from_pandas=True), pa.array(np.where(np.isinf(b), np.nan, b), from_pandas=True)], ["a", "b"])

    done = _with_distances(rows, drawn, means, "a double, b double")
    return done.agg(F.avg(silhouette_of(F.col("a"), F.col("b"))).alias("silhouette"), F.count("*").alias("points")).select(
        "silhouette", "points", F.lit(len(chosen)).cast("long").alias("drawn"), F.lit(not large).alias("exact"))
