import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from popsight.operators import correlate as co
from popsight.operators import encode as en
from popsight.operators import segment as sg
from popsight.plans.cumulative import running_totals
from popsight.plans.topk import top_k_per_group


def test_label_codes_and_unseen(spark):
    fit = spark.createDataFrame([("10",), ("2",), ("1",)], "x string")
    codes = en.fit_label_codes(fit, ["x"])
    assert {r.value: r.code for r in codes.table.collect()} == {"1": 0, "10": 1, "2": 2}
    new = spark.createDataFrame([("2",), ("9",), (None,)], "x string")
    assert sorted(r.x for r in en.label_encode_transform(new, codes).collect()) == [-1, -1, 2]
    # a code table above the broadcast threshold is joined by shuffle: same answer
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shuffled = en.label_encode_transform(new, codes)
        assert sorted(r.x for r in shuffled.collect()) == [-1, -1, 2]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_constant_column_scales_to_zero(spark):
    df = spark.createDataFrame([(1, 5), (2, 5), (3, 5)], "a long, b long")
    p = en.standard_scale_fit(df, ["a", "b"])
    out = en.standard_scale_transform(df, p).toPandas()
    assert (out.b == 0).all()
    assert out.a.mean() == pytest.approx(0) and out.a.std(ddof=0) == pytest.approx(1)
    lazy = en.standard_scale(df, ["a", "b"]).toPandas()
    assert np.allclose(lazy.a, out.a) and (lazy.b == 0).all()


def test_unseen_target_raises(spark):
    df = spark.createDataFrame([("x",)], "label string")
    with pytest.raises(Exception):
        en.encode_target(df, ["a", "b"]).collect()


def test_stratified_split_exact_disjoint_reproducible(spark):
    rows = [(i, 1 if i % 9 == 0 else 0) for i in range(5000)]
    df = spark.createDataFrame(rows, "person_id long, label int")
    sp = en.stratified_split(df, "label", "person_id", 0.2, 42).toPandas()
    assert len(sp) == 5000 and sp.person_id.is_unique
    for lab, grp in sp.groupby("label"):
        assert (grp.split == "test").sum() == round(0.2 * len(grp))
    # same as ranking each class by md5('42:' || key)
    import hashlib
    exp = set()
    for lab in (0, 1):
        keys = [i for i, l in rows if l == lab]
        keys.sort(key=lambda k: (hashlib.md5(f"42:{k}".encode()).hexdigest(), k))
        exp |= set(keys[:round(0.2 * len(keys))])
    assert set(sp[sp.split == "test"].person_id) == exp
    again = en.stratified_split(df, "label", "person_id", 0.2, 42).toPandas()
    assert set(again[again.split == "test"].person_id) == exp


def test_correlation_pairwise_and_constant(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(size=300)
    b = a * 0.5 + rng.normal(size=300)
    c = np.where(rng.uniform(size=300) < 0.1, np.nan, b + a)
    pdf = pd.DataFrame({"a": a, "b": b, "c": c, "k": 1.0})
    df = spark.createDataFrame([(float(x), float(y), None if np.isnan(z) else float(z), 1.0)
                                for x, y, z in zip(a, b, c)], "a double, b double, c double, k double")
    got = co.correlation_matrix(df, ["a", "b", "c", "k"]).toPandas()
    ref = pdf.corr()
    for r in got.itertuples():
        expect = ref.loc[r.feature1, r.feature2]
        if np.isnan(expect):
            assert r.r is None or np.isnan(r.r)
        else:
            assert r.r == pytest.approx(expect, abs=1e-8)


def _brute_sq_silhouette(X, lab):
    D = ((X[:, None, :] - X[None, :, :]) ** 2).sum(-1)
    s = []
    for i in range(len(X)):
        own = lab == lab[i]
        if own.sum() == 1:
            s.append(0.0)
            continue
        a = D[i, own].sum() / (own.sum() - 1)
        b = min(D[i, lab == c].mean() for c in set(lab) if c != lab[i])
        s.append((b - a) / max(a, b))
    return float(np.mean(s))


def test_cluster_metrics_match_brute_force(spark):
    rng = np.random.default_rng(4)
    X = np.vstack([rng.normal(m, 1, (40, 3)) for m in (0, 3, 6)])
    lab = np.repeat([0, 1, 2], 40)
    df = spark.createDataFrame([(int(l), [float(v) for v in x]) for l, x in zip(lab, X)],
                               "segment int, features array<double>")
    st = sg.cluster_stats(df)
    sil = sg.silhouette_sq(df, st).first()[0]
    assert sil == pytest.approx(_brute_sq_silhouette(X, lab), abs=1e-9)
    assert -1 <= sil <= 1
    cent = np.array([X[lab == k].mean(0) for k in range(3)])
    w = sum(((X[lab == k] - cent[k]) ** 2).sum() for k in range(3))
    assert sg.inertia(st).first()[0] == pytest.approx(w)
    bt = sum((lab == k).sum() * ((cent[k] - X.mean(0)) ** 2).sum() for k in range(3))
    assert sg.calinski_harabasz(st).first()[0] == pytest.approx(bt * (120 - 3) / (w * 2))
    s = [np.linalg.norm(X[lab == k] - cent[k], axis=1).mean() for k in range(3)]
    db = np.mean([max((s[i] + s[j]) / np.linalg.norm(cent[i] - cent[j])
                      for j in range(3) if j != i) for i in range(3)])
    assert sg.davies_bouldin(df, st).first()[0] == pytest.approx(db)
    near = sg.assign_nearest(df.drop("segment"), st.mean).toPandas()
    brute = np.argmin(((X[:, None, :] - cent[None]) ** 2).sum(-1), axis=1)
    assert list(near.segment) == list(brute)


def test_running_totals_exact(spark):
    rng = np.random.default_rng(9)
    keys = rng.choice(100000, 4000, replace=False).astype(float)
    v = rng.integers(0, 5, 4000)
    df = spark.createDataFrame([(float(k), int(x)) for k, x in zip(keys, v)], "k double, v long")
    got = running_totals(df, "k", ["v"], descending=True, bounds=None, buckets=16).toPandas()
    order = np.argsort(-keys)
    exp = dict(zip(keys[order], np.cumsum(v[order])))
    assert all(exp[r.k] == r.cum_v for r in got.itertuples())


def test_top_k_per_group_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(int(g), f"v{i}", int(c)) for i, (g, c) in
            enumerate(zip(rng.integers(0, 3, 3000), rng.integers(0, 50, 3000)))]
    df = spark.createDataFrame(rows, "g int, value string, count long")
    got = top_k_per_group(df, ["g"], [F.desc("count"), F.asc("value")], 7, shards=16).toPandas()
    pdf = pd.DataFrame(rows, columns=["g", "value", "count"])
    for g, grp in pdf.groupby("g"):
        exp = grp.sort_values(["count", "value"], ascending=[False, True]).head(7)
        assert list(got[got.g == g].sort_values("rank").value) == list(exp.value)


def test_exact_percentiles_match_spark(spark):
    from popsight.plans.quantiles import exact_percentiles
    rng = np.random.default_rng(0)
    vals = np.concatenate([rng.normal(size=3000), np.full(2000, 1.5), rng.uniform(-1e3, 1e3, 1000)])
    df = spark.createDataFrame([(int(i % 3), float(v)) for i, v in enumerate(vals)], "g int, v double")
    probs = [0.0, 0.25, 0.5, 0.75, 1.0, 0.333]
    got = exact_percentiles(df, ["g"], "v", probs).toPandas()
    for g in range(3):
        exp = df.where(F.col("g") == g).agg(F.percentile("v", probs)).first()[0]
        mine = got[got.g == g].sort_values("p_index").value.tolist()
        assert np.allclose(mine, exp, rtol=0, atol=1e-12)
    one = exact_percentiles(df, [], "v", probs).sort("p_index").toPandas()
    assert np.allclose(one.value, df.agg(F.percentile("v", probs)).first()[0], atol=1e-12)


def test_percentiles_of_many_groups_and_one_hot_group(spark):
    """12,001 groups, one of them with half of the rows, and a null group."""
    from popsight.plans.quantiles import exact_percentiles
    rng = np.random.default_rng(6)
    small = [(int(g), float(v)) for g, v in zip(range(12_000), rng.normal(size=12_000))]
    hot = [(-1, float(v)) for v in rng.normal(size=12_000)]
    none = [(None, 1.0), (None, 2.0), (5, float("nan")), (6, None)]
    df = spark.createDataFrame(small + hot + none, "g int, v double")
    probs = [0.1, 0.5]
    got = {(r.g, r.p_index): r.value for r in exact_percentiles(df, ["g"], "v", probs).collect()}
    assert len(got) == 2 * 12_002
    assert all(got[g, i] == v for g, v in small for i in (0, 1))
    assert np.allclose([got[-1, 0], got[-1, 1]], np.quantile([v for _, v in hot], probs), atol=1e-12)
    assert np.allclose([got[None, 0], got[None, 1]], [1.1, 1.5])


def test_split_matches_a_sort_and_parts_repeated_keys(spark):
    import hashlib
    rng = np.random.default_rng(3)
    rows = [(int(k), ["a", "b", None][int(c)]) for k, c in zip(rng.permutation(3000), rng.integers(0, 3, 3000))]
    rows += [(9999, "r")] * 10 + [(1, "one")]
    got = en.stratified_split(spark.createDataFrame(rows, "person_id long, label string"), test_size=0.25)
    got = [(r.person_id, r.label, r.split) for r in got.collect()]
    assert len(got) == len(rows)
    for cls in ("a", "b", None):
        keys = sorted((k for k, c in rows if c == cls), key=lambda k: hashlib.md5(f"42:{k}".encode()).hexdigest())
        assert {k for k, c, s in got if c == cls and s == "test"} == set(keys[:int(0.25 * len(keys) + 0.5)])
    assert sum(s == "test" for _, c, s in got if c == "r") == 3
    assert [s for _, c, s in got if c == "one"] == ["train"]
    empty = en.stratified_split(spark.createDataFrame([], "person_id long, label string"))
    assert empty.count() == 0 and empty.columns == ["person_id", "label", "split"]


def test_mode_of_integers_above_2_53(spark):
    from popsight.operators import missing as mi
    big = 2 ** 53 + 1
    df = spark.createDataFrame([(big, 1.5), (big, 1.5), (None, None), (-big, float("nan"))], "x long, y double")
    got = mi.impute_mode(df, ["x", "y"]).collect()
    assert sorted(r.x for r in got) == [-big, big, big, big]
    assert all(r.y == 1.5 for r in got)
    tie = mi.impute_mode(spark.createDataFrame([(-big,), (-big - 1,), (None,)], "x long"), ["x"]).collect()
    assert sorted(r.x for r in tie) == [-big - 1, -big - 1, -big]


def test_label_codes_of_many_categories(spark):
    """12,000 categories, one of them half of all rows."""
    df = spark.range(48_000).select(F.when(F.col("id") % 2 == 0, F.lit("hot")).otherwise(
        F.concat(F.lit("v"), (F.col("id") % 24_000).cast("string"))).alias("a"), "id")
    codes = en.fit_label_codes(df, ["a"])
    values = [r.value for r in codes.table.orderBy("code").collect()]
    assert len(values) == 12_001 and values == sorted(values)
    out = en.label_encode_transform(df, codes)
    assert out.columns == ["a", "id"]
    place = {v: i for i, v in enumerate(values)}
    for r in out.where("id % 997 = 0").collect():
        assert r.a == place["hot" if r.id % 2 == 0 else f"v{r.id % 24_000}"]
    assert out.where(F.col("a") == place["hot"]).count() == 24_000


def test_small_deviation_is_not_constant(spark):
    df = spark.createDataFrame([(i * 1e-12, 0.1) for i in range(10)], "x double, k double")
    p = en.standard_scale_fit(df, ["x", "k"])
    xs = np.arange(10) * 1e-12
    assert p["x"] == pytest.approx((xs.mean(), xs.std()), rel=1e-9) and p["k"][1] == 1.0
