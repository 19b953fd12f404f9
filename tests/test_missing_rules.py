"""One rule for missing values: NaN is null, a missing score is never predicted."""

import pytest
from pyspark.sql import functions as F

from popsight.catalog import persons_input, queries
from popsight.operators import correlate, encode, evaluate, missing, profile
from popsight.schema import Roles

SF_SMALL = "/root/testdata/sf0.001"

NAN = float("nan")


@pytest.fixture(scope="module")
def gaps(spark):
    return spark.createDataFrame([(1.0, 1.0, 1), (NAN, 2.0, 2), (3.0, 5.0, 3), (None, 4.0, 4)], "x double, y double, k int")


def test_nan_is_null(gaps):
    got = [r.x for r in missing.impute_median(gaps, ["x"]).orderBy("k").collect()]
    assert got == [1.0, 2.0, 3.0, 2.0]
    assert encode.standard_scale_fit(gaps, ["x"])["x"] == (2.0, 1.0)
    r = {(x.feature1, x.feature2): x.r for x in correlate.correlation_matrix(gaps, ["x", "y"]).collect()}
    assert r["x", "y"] == pytest.approx(1.0)
    assert missing.null_counts(gaps, ["x"]).first().missing_count == 2


def test_no_eligible_columns(spark):
    df = spark.createDataFrame([(1,)], "k int")
    assert missing.implicit_missing_patterns(df, Roles()).count() == 0
    assert missing.missing_indicator_map(df, Roles()).count() == 0


def test_null_scores_are_last(spark):
    rows = [(i % 2, i / 100) for i in range(100)] + [(1, None)] * 5 + [(1, NAN)] * 5
    s = spark.createDataFrame(rows, "label int, score double")
    c = evaluate.confusion_matrix(s, 0.5).first()
    assert (c.tn, c.fp, c.fn, c.tp) == (25, 25, 35, 25)
    pairs = [(p, n) for a, p in rows if a for b, n in rows if not b]
    low = [(-1 if x is None or x != x else x) for x, _ in pairs]
    want = sum((a > n) + 0.5 * (a == n) for a, (_, n) in zip(low, pairs)) / len(pairs)
    assert evaluate.roc_auc(s).first()[0] == pytest.approx(want, abs=1e-9)


def test_crosstab_without_null_labels(spark):
    df = spark.createDataFrame([("a", "p"), ("a", "n"), ("a", None), ("a", None)], "g string, t string")
    r = profile.income_crosstab(df, "g", "t", positive="p", negative="n").first()
    assert (r.pct_positive, r.pct_negative) == (50.0, 50.0)


def test_split_of_dotted_names(spark):
    df = spark.range(100).select(F.col("id"), (F.col("id") % 2).alias("label"), F.lit(1).alias("a.b"))
    out = encode.stratified_split(df, "label", "id", test_size=0.2, seed=1)
    assert out.columns == ["id", "label", "a.b", "split"] and out.count() == 100


def test_registered_input_is_pruned(spark):
    plan = queries()["p6_positive_subset"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" in plan and "ExistingRDD" not in plan
    assert "PushedFilters: [IsNotNull(wage_per_hour)" in plan
    assert len(persons_input(spark, SF_SMALL).columns) > 10


def test_nan_in_profiles(spark):
    w = spark.createDataFrame([(1.0, "a"), (2.0, "a"), (NAN, "a"), (4.0, "a"), (None, "a")], "w double, g string")
    r = profile.weight_summary(w, "w").first()
    assert (r["min"], r["max"], r["median"], r["mean"]) == (1.0, 4.0, 2.0, pytest.approx(7 / 3))
    assert profile.dataset_summary(w).first().total_missing_cells == 2
    b = profile.boxplot_stats(w, "w", "g").first()
    assert (b.n, b.outliers, b.median) == (3, 0, 2.0)
    h = profile.numeric_histogram(w, rules=(("w", None, None),), bins=3).collect()
    assert sum(x["count"] for x in h) == 3 and h[0].mean == pytest.approx(7 / 3, abs=1e-9) and h[0].median == 2.0


def test_nan_in_preprocessing(spark):
    df = spark.createDataFrame([(1.0, "x", "n"), (NAN, "y", "p"), (3.0, "x", "n"), (None, "x", "p")], "v double, c string, label string")
    roles = Roles(label="label", continuous=("v",))
    fitted, out = encode.preprocess_fit(df, roles)
    got = sorted(r.v for r in out.collect())
    assert got == pytest.approx([-2 ** 0.5, 0.0, 0.0, 2 ** 0.5])          # both gaps filled with the median 2
    again = encode.preprocess_transform(df, fitted).collect()
    assert sorted(r.v for r in again) == pytest.approx(got)
