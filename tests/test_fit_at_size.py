"""Fits at size: tasks follow the rows, nothing is cached twice, few k-means fits hold a large table at once."""

import threading
import time

import pytest
from pyspark.ml.clustering import KMeans
from pyspark.sql import functions as F

from popsight.operators import model as mo


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(0, 900, 1, 3).select(F.col("id").alias("person_id"), F.rand(1).alias("a"), F.rand(2).alias("b"), F.lit(1.0).alias("weight"))
    return df.withColumn("label", (F.col("a") + F.col("b") * F.col("b") > 0.9).cast("int")).cache()


def test_node_ids_are_not_cached_and_trees_stay(spark, rows):
    data = mo.training_weights(mo.vectorize(rows, ["a", "b"], ["label", "weight"]), "label", "weight", 1.5)
    est = mo.gbt_estimator(dict(n_estimators=6, max_depth=4, gamma=0.0), 42, 1000.0)
    assert not est.getCacheNodeIds()
    assert est.fit(data).toDebugString.split("\n")[1:] == est.copy().setCacheNodeIds(True).fit(data).toDebugString.split("\n")[1:]


def test_training_reads_as_many_tasks_as_its_rows_need(spark, rows, monkeypatch):
    seen = []
    real = mo.gbt_estimator

    class Fit:
        def __init__(self, est):
            self.est = est

        def fit(self, data):
            seen.append((data.rdd.getNumPartitions(), data.count(), data.is_cached))
            return self.est.fit(data)

    monkeypatch.setattr(mo, "gbt_estimator", lambda *a, **k: Fit(real(*a, **k)))
    monkeypatch.setattr(mo, "TASK_ROWS", 200)
    monkeypatch.setattr(mo, "sample_candidates", lambda n, seed: [dict(mo.DEFAULT_GBT, n_estimators=2, max_depth=2)])
    assert [mo.fit_tasks(n) for n in (0, 1, 200, 201, 900)] == [1, 1, 1, 2, 5]
    bm = mo.fit_boosted_trees(rows, ["a", "b"], params=dict(n_estimators=3, max_depth=2))
    assert seen == [(5, 900, False)] and len(bm.model.trees) == 3
    seen.clear()
    monkeypatch.setattr(mo, "TASK_ROWS", 10_000)
    mo.search_params(rows, ["a", "b"], n_iter=1, folds=3, parallelism=1)
    assert [p for p, _, _ in seen[:3]] == [1, 1, 1] and sum(n for _, n, _ in seen[:3]) == 1800


def test_restarts_share_the_memory(spark, rows, monkeypatch):
    vectors = mo.vectorize(rows, ["a", "b"], ["person_id"])
    busy, most, lock, real = [0], [0], threading.Lock(), KMeans.fit

    def counted(self, data):
        with lock:
            busy[0] += 1
            most[0] = max(most[0], busy[0])
        time.sleep(0.3)
        try:
            return real(self, data)
        finally:
            with lock:
                busy[0] -= 1

    monkeypatch.setattr(KMeans, "fit", counted)
    wide = mo.fit_kmeans(vectors, 3, restarts=4, parallelism=3)
    assert most[0] == 3
    most[0] = 0
    monkeypatch.setattr(mo, "FIT_BYTES", 900 * 116 * 2 - 1)             # not two copies
    narrow = mo.fit_kmeans(vectors, 3, restarts=4, parallelism=3)
    assert most[0] == 1 and (narrow.seed, narrow.iterations) == (wide.seed, wide.iterations)
    assert narrow.inertia == pytest.approx(wide.inertia, rel=1e-12)
