import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from popsight.operators import evaluate as ev
from popsight.operators import threshold as th
from popsight.sources.tables import persons
from tests.conftest import SF_SMALL


def scored(spark, rows):
    return spark.createDataFrame(rows, "label int, score double")


def test_grid_index_matches_row_by_row_comparison(spark):
    grid = [0.1 + i * 0.01 for i in range(81)]
    rng = np.random.default_rng(7)
    vals = list(rng.uniform(-0.2, 1.2, 300)) + grid + [np.nextafter(g, 0) for g in grid] + \
        [np.nextafter(g, 1) for g in grid] + [float("nan"), None, 5.0, -3.0]
    df = spark.createDataFrame([(None if v is None else float(v),) for v in vals], "score double")
    got = [r[0] for r in df.select(th.grid_index("score")).collect()]
    for v, k in zip(vals, got):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            assert k == -1
            continue
        expect = max([i for i, g in enumerate(grid) if v >= g], default=-1)
        assert k == expect, (v, k, expect)


def test_sweep_invariants_and_fixture_numbers(spark):
    s = ev.scored_table(persons(spark, SF_SMALL), "label", "50000+.", "score")
    sweep = th.threshold_sweep(s).orderBy("threshold").toPandas()
    n = s.count()
    assert len(sweep) == 81
    assert ((sweep.tp + sweep.fp + sweep.tn + sweep.fn) == n).all()
    assert (np.diff(sweep.recall) <= 1e-12).all()
    impact = th.business_impact(th.threshold_sweep(s)).toPandas()
    assert np.allclose(impact.net_profit, 25 * impact.high_earners_reached
                       - 12 * impact.low_earners_reached)
    best = th.optimal_business_threshold(th.business_impact(th.threshold_sweep(s))).first()
    assert round(best.threshold, 2) == 0.71
    assert (best.high_earners_reached, best.low_earners_reached) == (73, 20)
    assert best.net_profit == 1585
    f1 = th.optimal_threshold_f1(th.threshold_sweep(s)).first()
    assert round(f1.threshold, 2) == 0.71 and (f1.tn, f1.fn) == (1398, 34)


def test_sweep_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 500)
    p = np.round(rng.uniform(0, 1, 500), 3)
    df = scored(spark, [(int(a), float(b)) for a, b in zip(y, p)])
    sweep = th.threshold_sweep(df).orderBy("threshold").toPandas()
    for row in sweep.itertuples():
        pred = p >= row.threshold
        assert row.tp == int(((y == 1) & pred).sum())
        assert row.fp == int(((y == 0) & pred).sum())
        assert row.fn == int(((y == 1) & ~pred).sum())


def test_none_predicted_gives_zero_metrics(spark):
    sweep = th.threshold_sweep(scored(spark, [(1, 0.05), (0, 0.05)])).toPandas()
    assert (sweep.precision == 0).all() and (sweep.recall == 0).all() and (sweep.f1 == 0).all()


def test_unknown_objective_fails_up_front(spark):
    with pytest.raises(ValueError):
        th.optimize_threshold(th.threshold_sweep(scored(spark, [(1, 0.5)])), "cost")


def test_scored_ties_ap_and_auc(spark):
    df = scored(spark, [(1, .9), (0, .9), (1, .5), (0, .1)])
    r = ev.rank_metrics(df).first()
    assert r.average_precision == pytest.approx(0.5 * 0.5 + 0.5 * 2 / 3)
    assert r.roc_auc == pytest.approx(0.625)


def test_one_class_gives_null(spark):
    r = ev.rank_metrics(scored(spark, [(0, .3), (0, .8)])).first()
    assert r.roc_auc is None and r.average_precision is None


def _auc_brute(y, p):
    pos, neg = p[y == 1], p[y == 0]
    return ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) \
        / (len(pos) * len(neg))


def _ap_brute(y, p):
    order = np.argsort(-p, kind="stable")
    ys, ps = y[order], p[order]
    ap, P = 0.0, y.sum()
    for s in np.unique(ps)[::-1]:
        sel = ps >= s
        tp = ys[sel].sum()
        prec = tp / sel.sum()
        ap += ys[ps == s].sum() / P * prec
    return ap


def test_rank_metrics_and_curves_match_brute_force(spark):
    rng = np.random.default_rng(11)
    y = rng.integers(0, 2, 3000)
    p = np.round(rng.beta(2, 3, 3000) + 0.2 * y, 3)   # many ties, many buckets
    df = scored(spark, [(int(a), float(b)) for a, b in zip(y, p)])
    r = ev.rank_metrics(df).first()
    assert r.roc_auc == pytest.approx(_auc_brute(y, p), abs=1e-12)
    assert r.average_precision == pytest.approx(_ap_brute(y, p), abs=1e-9)
    roc = ev.roc_curve(df).where("threshold IS NOT NULL").toPandas().sort_values("threshold")
    for row in roc.sample(50, random_state=1).itertuples():
        sel = p >= row.threshold
        assert row.tpr == pytest.approx(((y == 1) & sel).sum() / (y == 1).sum())
        assert row.fpr == pytest.approx(((y == 0) & sel).sum() / (y == 0).sum())
    pr = ev.pr_curve(df).toPandas()
    assert len(pr) == len(np.unique(p)) + 1


def test_histogram_matches_numpy(spark):
    vals = [float(v) for v in range(11)]             # 0..10, max lands in the last bin
    df = spark.createDataFrame([(0, v) for v in vals] + [(1, 0.3), (1, 0.3)],
                               "label int, score double")
    h = ev.score_histogram(df, 50).toPandas()
    h0 = h[h.label == 0].sort_values("bin")
    counts, edges = np.histogram(vals, bins=50)
    dens, _ = np.histogram(vals, bins=50, density=True)
    assert list(h0["count"]) == list(counts) and h0["count"].sum() == 11
    assert h0["count"].iloc[-1] == 1
    assert np.allclose(h0.bin_lower, edges[:-1]) and np.allclose(h0.density, dens)
    h1 = h[h.label == 1]
    c1, _ = np.histogram([0.3, 0.3], bins=50)
    assert list(h1.sort_values("bin")["count"]) == list(c1)


def test_classification_report_rows(spark):
    df = scored(spark, [(1, .9), (0, .9), (1, .4), (0, .1)])
    rep = {r["class"]: r for r in ev.classification_report(df, 0.5).collect()}
    assert rep["1"].precision == 0.5 and rep["1"].recall == 0.5
    assert rep["accuracy"].f1_score == 0.5 and rep["accuracy"].support == 4


def test_metrics_do_not_depend_on_row_order(spark):
    rng = np.random.default_rng(21)
    rows = [(int(a), float(b)) for a, b in zip(rng.integers(0, 2, 2000),
                                                np.round(rng.uniform(0, 1, 2000), 2))]
    a = ev.rank_metrics(scored(spark, rows)).first()
    b = ev.rank_metrics(scored(spark, rows[::-1]).repartition(7)).first()
    assert a.roc_auc == b.roc_auc and a.average_precision == b.average_precision
    s1 = th.threshold_sweep(scored(spark, rows)).orderBy("threshold").collect()
    s2 = th.threshold_sweep(scored(spark, rows[::-1]).repartition(5)).orderBy("threshold").collect()
    assert s1 == s2


def test_published_f1_arithmetic(spark):
    from popsight.functions.columns import f1_score
    # (threshold, precision, recall, published F1) from the baseline report
    published = [(0.50, 0.478, 0.675, 0.560), (0.71, 0.580, 0.583, 0.582),
                 (0.81, 0.649, 0.518, 0.576), (0.87, 0.701, 0.464, 0.558)]
    df = spark.createDataFrame([(t, p, r) for t, p, r, _ in published], "t double, p double, r double")
    got = [row[0] for row in df.orderBy("t").select(f1_score(F.col("p"), F.col("r"))).collect()]
    for g, (_, _, _, f1) in zip(got, published):
        assert abs(g - f1) < 0.0015
