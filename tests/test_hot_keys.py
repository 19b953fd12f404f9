"""One value holding a third of all rows: results stay exact and whole."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from popsight.functions.columns import row_key
from popsight.operators import evaluate as ev
from popsight.operators import missing as mi
from popsight.operators import profile as pf
from popsight.operators import threshold as th
from popsight.plans.quantiles import exact_percentiles


@pytest.fixture(scope="module")
def hot(spark):
    rng = np.random.default_rng(8)
    n = 9000
    score = np.where(np.arange(n) % 3 == 0, 0.55, np.round(rng.uniform(0, 1, n), 4))
    label = (rng.uniform(size=n) < score).astype(int)
    cat = np.where(np.arange(n) % 3 == 0, "hot", np.array([f"c{i % 500}" for i in range(n)]))
    rows = [(int(i), int(y), float(s), str(c)) for i, (y, s, c) in enumerate(zip(label, score, cat))]
    return spark.createDataFrame(rows, "id long, label int, score double, cat string"), \
        (label, score, cat)


def test_hot_value_counts_and_topk(spark, hot):
    df, (_, _, cat) = hot
    top = pf.value_distribution(df, "cat", 10).orderBy("rank").toPandas()
    assert top.value.iloc[0] == "hot" and top["count"].iloc[0] == 3000
    assert top["count"].sum() == len(cat)          # whole: top 10 + other = all rows


def test_hot_score_rank_metrics(spark, hot):
    df, (y, p, _) = hot
    r = ev.rank_metrics(df.select("label", "score")).first()
    pos, neg = p[y == 1], p[y == 0]
    auc = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) \
        / (len(pos) * len(neg))
    assert r.roc_auc == pytest.approx(auc, abs=1e-12)
    sweep = th.threshold_sweep(df.select("label", "score")).toPandas()
    assert ((sweep.tp + sweep.fp + sweep.tn + sweep.fn) == len(y)).all()


def test_hot_value_percentiles(spark, hot):
    df, (_, p, _) = hot
    got = exact_percentiles(df, [], "score", [0.25, 0.5, 0.75])
    vals = [r.value for r in got.orderBy("p_index").collect()]
    assert np.allclose(vals, np.quantile(p, [0.25, 0.5, 0.75]), atol=1e-12)


def test_hot_duplicates_and_row_key(spark, hot):
    df, _ = hot
    dup = df.select("cat").where("cat = 'hot'").unionByName(df.select("cat"))
    assert mi.drop_duplicates(dup).count() == 501
    # null-marked keys keep rows apart that a plain concat would merge
    k = spark.createDataFrame([("a", None, "b"), ("a", "b", None)], "x string, y string, z string")
    assert k.select(row_key(["x", "y", "z"]).alias("k")).distinct().count() == 2
