"""Block Gram correlation: 300 columns in two scans, pairwise-complete rows, degenerate columns."""

import numpy as np
import pandas as pd
import pytest

from popsight.operators import correlate as co


def test_300_columns_in_two_scans(spark, monkeypatch):
    g = np.random.default_rng(1)
    n, d = 400, 300
    x = g.standard_normal((n, d)) + 1e6 * g.random(d)
    x[:, 1] = 2 * x[:, 0] + 0.01 * x[:, 2]
    x[g.random((n, d)) < 0.05] = np.nan
    x[:, 7] = 3.0
    pdf = pd.DataFrame(x, columns=[f"c {i}" for i in range(d)])
    df = spark.createDataFrame(pdf).repartition(4)
    plans = []
    for name in ("_column_moments", "_gram"):
        f = getattr(co, name)
        monkeypatch.setattr(co, name, lambda v, *a, f=f: (plans.append(v), f(v, *a))[1])
    out = co.correlation_matrix(df, digits=None)
    assert len(plans) == 2                                        # one scan for the moments, one for all products
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") + plan.count("LocalTableScan") == 1
    got = out.toPandas()
    assert len(got) == d * d
    m = got.pivot(index="i", columns="j", values="r").to_numpy()
    want = pdf.corr().to_numpy()
    assert np.isnan(m[7]).all() and np.isnan(m[:, 7]).all()
    keep = [i for i in range(d) if i != 7]
    assert np.abs(m[np.ix_(keep, keep)] - want[np.ix_(keep, keep)]).max() < 1e-8
    assert set(got.feature1) == set(pdf.columns)


def test_degenerate(spark):
    rows = [(1.0, None, 5, None, 1.0), (2.0, 4.0, 5, None, None), (3.0, None, 5, None, 2.0)]
    df = spark.createDataFrame(rows, "a double, b double, c int, d double, e double")
    got = {(r.feature1, r.feature2): r.r for r in co.correlation_matrix(df).collect()}
    assert got["a", "a"] == 1.0 and got["a", "e"] == got["e", "a"] == pytest.approx(1.0)
    assert all(got[x] is None for x in got if set(x) & {"b", "c", "d"})
    empty = co.correlation_matrix(df.limit(0)).collect()
    assert len(empty) == 25 and all(r.r is None for r in empty)
