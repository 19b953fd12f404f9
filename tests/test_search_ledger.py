"""The search's ledger: a second run reads the finished fits, a lost driver's search goes on, other data start anew."""

import pytest
from pyspark.sql import functions as F

from popsight.operators import model as mo


def test_search_resumes_from_its_ledger(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(mo, "SEARCH_SPACE", dict(mo.SEARCH_SPACE, max_depth=(2, 3), n_estimators=(2, 3)))
    df = spark.range(240).select(F.col("id").alias("person_id"), F.rand(1).alias("a"), F.rand(2).alias("b"), F.lit(1.0).alias("weight")
                                 ).withColumn("label", (F.col("a") + F.col("b") > 1).cast("int")).cache()
    path, fits = f"{tmp_path}/ledger", []
    real = mo.gbt_estimator

    def counted(params, *a, **k):
        fits.append(params)
        if len(fits) == stop:
            raise RuntimeError("driver lost")
        return real(params, *a, **k)

    monkeypatch.setattr(mo, "gbt_estimator", counted)
    options = dict(n_iter=3, folds=2, parallelism=1, ledger=path)
    stop = 4
    with pytest.raises(RuntimeError, match="driver lost"):
        mo.search_params(df, ["a", "b"], **options)
    stop, done = 0, spark.read.parquet(path).count()
    fits.clear()
    bm, table = mo.search_params(df, ["a", "b"], **options)
    assert 3 <= done < 6 and len(fits) == 6 - done + 1                        # the rest, and the refit of the best
    fits.clear()
    _, again = mo.search_params(df, ["a", "b"], **options)
    assert len(fits) == 1 and again.collect() == table.collect()          # the refit alone
    assert table.where("best").count() == 1 and bm.params["n_estimators"] in (2, 3)
    fits.clear()
    mo.search_params(df.where("person_id < 200"), ["a", "b"], **dict(options, n_iter=1))
    assert len(fits) == 3                                                 # other rows: nothing is taken over


def test_registered_search_scores_all_candidates(spark, monkeypatch):
    """20 candidates x 3 folds and the refit of the best, as the reference does."""
    from popsight.catalog import model as cm
    monkeypatch.setattr(mo, "SEARCH_SPACE", dict(mo.SEARCH_SPACE, max_depth=(1, 2), n_estimators=(1, 1)))
    rows = spark.range(0, 150, 1, 1).select(
        F.col("id").alias("person_id"), *[F.rand(i).alias(c) for i, c in enumerate(cm.FEATURES)], F.lit(1.0).alias("weight"),
        F.when(F.col("id") % 5 == 0, "test").otherwise("train").alias("split"), (F.col("id") % 3 == 0).cast("int").alias("label")).cache()
    monkeypatch.setattr(cm, "_split", lambda spark, sf_dir: rows)
    fits, real = [], mo.gbt_estimator
    monkeypatch.setattr(mo, "gbt_estimator", lambda params, *a, **k: fits.append(params) or real(params, *a, **k))
    table = cm.q_g2(spark, "").collect()
    assert [r["candidate"] for r in table] == list(range(20)) and sum(r["best"] for r in table) == 1
    wanted = mo.sample_candidates(20, 42)
    assert len(fits) == 61 and all(fits.count(c) - (fits[-1] == c) == 3 for c in wanted) and fits[-1] in wanted
