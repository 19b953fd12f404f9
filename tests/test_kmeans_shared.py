"""Fits that share their passes end where Spark's own fits end."""

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from popsight.operators import kmeans as km
from popsight.operators import model as mo


@pytest.fixture(scope="module")
def vectors(spark):
    x = F.array(*[F.rand(i) + F.floor(F.rand(9) * 4) * (i + 1) for i in range(3)])
    return spark.range(0, 3000, 1, 3).select(array_to_vector(x).alias("features")).cache()


def _spark_fit(vectors, k, seed):
    m = KMeans(k=k, seed=seed, maxIter=300, tol=1e-4, initMode="k-means||").fit(vectors)
    return np.array(m.clusterCenters()), m.summary.trainingCost, m.summary.numIter


def test_shared_fits_equal_sparks(spark, vectors, monkeypatch):
    monkeypatch.setattr(km, "BLOCK_BYTES", 24 * 70)                 # many blocks, the last of a batch shorter
    points = km.packed(vectors, "features")
    assert points.counts == {0: 1000, 1: 1000, 2: 1000} and points.width == 3
    for f in km.fits(points, [2, 5], [42, 43, 2 ** 40]):
        centers, inertia, iterations = _spark_fit(vectors, f.k, f.seed)
        assert f.iterations == iterations and f.inertia == pytest.approx(inertia, rel=1e-9)
        assert f.centers == pytest.approx(centers, abs=1e-9)
    points.blocks.unpersist()


def test_few_distinct_points_and_odd_tables(spark):
    twice = spark.createDataFrame([(float(i % 3), 1.0) for i in range(40)], "a double, b double").coalesce(1).select(
        array_to_vector(F.array("a", "b")).alias("features")).cache()
    for f in km.fits(km.packed(twice, "features"), [2, 4], [1, 2]):
        centers, inertia, iterations = _spark_fit(twice, f.k, f.seed)
        assert f.centers == pytest.approx(centers, abs=1e-12) and f.iterations == iterations
        assert f.inertia == pytest.approx(inertia, abs=1e-9)
    with pytest.raises(ValueError, match="No samples"):
        km.fits(km.packed(twice.limit(0), "features"), [2], [1])
    nan = twice.limit(1).select(array_to_vector(F.array(F.lit(float("nan")), F.lit(0.0))).alias("features"))
    with pytest.raises(Exception, match="NaN or Infinity"):
        km.packed(nan, "features")


def test_sweep_reads_the_vectors_once(spark, vectors, monkeypatch):
    """no fit of its own, and no copy of the vectors, per k and restart."""
    fits = []
    monkeypatch.setattr(KMeans, "fit", lambda self, data: fits.append(self) or pytest.fail("a fit of its own"))
    rows = mo.k_sweep(vectors, ks=(2, 4), restarts=3, seed=42).collect()
    monkeypatch.undo()
    assert not fits and [r["n_clusters"] for r in rows] == [2, 4] and sum(r["selected"] for r in rows) == 1
    for r in rows:
        best = min(_spark_fit(vectors, r["n_clusters"], s)[1] for s in (42, 43, 44))
        assert r["inertia"] == pytest.approx(best, rel=1e-9)
        assert -1 < r["silhouette"] <= 1 and r["calinski_harabasz"] > 0 and r["davies_bouldin"] > 0


def test_squared_silhouette_in_batches(spark):
    from popsight.operators import segment as sg
    rows = [(0, [0.0, 0.0]), (0, [0.0, 2.0]), (1, [5.0, 0.0]), (1, [5.0, 1.0]), (1, [6.0, 3.0]), (2, [9.0, 9.0])]      # 2: one point, scores 0
    points = spark.createDataFrame([*rows, (1, None), (0, [1.0, None])], "segment int, x array<double>")
    seg, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    far = ((x[:, None] - x[None]) ** 2).sum(2)
    want = []
    for i, s in enumerate(seg):
        if (seg == s).sum() > 1:
            a, b = far[i, seg == s].sum() / ((seg == s).sum() - 1), min(far[i, seg == t].mean() for t in {*seg} - {s})
            want.append((b - a) / max(a, b))
    whole = points.where("x is not null and not exists(x, v -> v is null)")
    stats = sg.cluster_stats(whole, "x", "segment")
    out = sg.silhouette_sq(whole, stats, "x", "segment")
    assert "MapInArrow" in out._jdf.queryExecution().executedPlan().toString()          # no lambda per point, cluster and number
    assert out.first()[0] == pytest.approx(sum(want) / 6, abs=1e-12)
    assert sg.silhouette_sq(points, stats, "x", "segment").first()[0] == pytest.approx(sum(want) / 8, abs=1e-12)     # a point without numbers scores 0
    with pytest.raises(Exception, match="no segment"):
        sg.silhouette_sq(whole.withColumn("segment", F.when(F.col("segment") > 0, F.col("segment"))), stats, "x", "segment").collect()
