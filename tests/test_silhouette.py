"""Euclidean silhouette against all pairs; error of the sampled form; cluster statistics in one scan."""

import duckdb
import numpy as np
import pytest

from popsight.operators import segment as sg
from popsight.operators.silhouette import silhouette

SF = "/root/testdata/sf0.01"


def exact(x, lab):
    d = np.sqrt(np.maximum(((x[:, None] - x[None]) ** 2).sum(-1), 0))
    out = []
    for i in range(len(x)):
        own = lab == lab[i]
        others = [d[i, lab == c].mean() for c in set(lab) if c != lab[i]]
        if own.sum() == 1 or not others:
            out.append(0.0)
            continue
        a, b = d[i, own].sum() / (own.sum() - 1), min(others)
        out.append((b - a) / max(a, b) if max(a, b) else 0.0)
    return float(np.mean(out))


def frame(spark, x, lab):
    return spark.createDataFrame([(i, int(c), [float(v) for v in r]) for i, (c, r) in enumerate(zip(lab, x))],
                                 "id long, segment int, features array<double>").repartition(5)


def clusters(seed, sizes, d=3, spread=4.0):
    g = np.random.default_rng(seed)
    x = np.vstack([g.normal(g.normal(0, spread, d), g.uniform(0.5, 2), (n, d)) for n in sizes])
    return x, np.repeat(np.arange(len(sizes)), sizes)


def test_exact_when_the_sample_holds_all(spark):
    x, lab = clusters(1, (40, 25, 1, 7))
    x[3] = x[4]                                                   # equal points
    r = silhouette(frame(spark, x, lab)).first()
    assert r.exact and r.points == r.drawn == len(x) and r.silhouette == pytest.approx(exact(x, lab), abs=1e-9)
    one = silhouette(frame(spark, x[:10], lab[:10])).first()
    assert one.silhouette == 0.0
    none = silhouette(frame(spark, x, lab).limit(0)).first()
    assert none.silhouette is None and none.points == 0


def test_sampled_error(spark):
    """Far-out points included, which plain sampling would miss or overrate."""
    x, lab = clusters(2, (900, 500, 60), d=8)
    x[5] += 300
    want = exact(x, lab)
    for sample, most in ((64, 0.02), (256, 0.01)):
        r = silhouette(frame(spark, x, lab), sample=sample).first()
        assert not r.exact and r.drawn < len(x) and abs(r.silhouette - want) < most
    same = [silhouette(frame(spark, x, lab), sample=64).first().silhouette for _ in range(2)]
    assert same[0] == pytest.approx(same[1], abs=1e-9)            # seeded by the keys


def test_sampled_error_on_embeddings(spark):
    rows = duckdb.sql(f"SELECT vec_id, label, embedding FROM read_parquet('{SF}/embeddings.parquet') ORDER BY vec_id").fetchall()
    x, lab = np.array([r[2] for r in rows], float), np.array([r[1] for r in rows])
    want = exact(x, lab)
    r = silhouette(frame(spark, x, lab), sample=32).first()
    assert not r.exact and abs(r.silhouette - want) < 0.01


def test_no_pairs_in_the_plan(spark):
    x, lab = clusters(3, (30, 20))
    plan = silhouette(frame(spark, x, lab))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Cartesian" not in plan


def test_cluster_statistics_read_the_points_once(spark, monkeypatch):
    seen = []
    kept = sg.stored
    monkeypatch.setattr(sg, "stored", lambda df, name: (seen.append(df._jdf.queryExecution().executedPlan().toString()), kept(df, name))[1])
    x, lab = clusters(4, (30, 20, 10))
    st = sg.cluster_stats(frame(spark, x, lab))
    assert len(seen) == 1 and seen[0].count("Scan ExistingRDD") == 1 and "Generate" not in seen[0]
    for df in (sg.inertia(st), sg.calinski_harabasz(st)):
        assert "ExistingRDD" not in df._jdf.queryExecution().executedPlan().toString()


def test_centroids_beyond_the_bound(spark, monkeypatch):
    x, lab = clusters(5, (30, 20, 10))
    df = frame(spark, x, lab)
    st = sg.cluster_stats(df)
    monkeypatch.setattr(sg, "MAX_CENTROID_NUMBERS", 4)
    w = sum(((x[lab == k] - x[lab == k].mean(0)) ** 2).sum() for k in range(3))
    assert sg.inertia(st).first()[0] == pytest.approx(w)           # the table is enough
    with pytest.raises(ValueError, match="centroids"):
        sg.silhouette_sq(df, st)
