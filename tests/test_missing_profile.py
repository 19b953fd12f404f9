import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from popsight.functions import columns as fc
from popsight.operators import missing as mi
from popsight.operators import profile as pf
from popsight.schema import Roles


def test_mode_ties_smallest_and_all_null_unknown(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("b",), ("a",), (None,)], "x string")
    assert [r.x for r in mi.impute_mode(df, ["x"]).collect()][-1] == "a"
    nulls = spark.createDataFrame([(None,), (None,)], "x string")
    assert {r.x for r in mi.impute_mode(nulls, ["x"]).collect()} == {"Unknown"}


def test_numeric_mode_ties_use_numeric_order(spark):
    df = spark.createDataFrame([(10,), (9,), (10,), (9,), (None,)], "x long")
    assert [r.x for r in mi.impute_mode(df, ["x"]).collect()][-1] == 9


def test_median_even_count(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (10,), (None,)], "x long")
    assert [r.x for r in mi.impute_median(df, ["x"]).collect()][-1] == 2.5


def test_not_in_universe_counts_and_nulling(spark):
    rows = [("Not in universe",), ("Not in universe under 1 year old",), ("?",), (None,), ("x",)]
    df = spark.createDataFrame(rows, "s string")
    pat = mi.implicit_missing_patterns(df, Roles(recodes=()), top=15).first()
    assert (pat.not_in_universe, pat.question_mark, pat.explicit_na, pat.total) == (2, 1, 1, 4)
    nulled = mi.sentinels_to_null(df, Roles(recodes=()))
    assert nulled.where("s IS NULL").count() == 3       # 2 more than before


def test_duplicates_with_nulls(spark):
    df = spark.createDataFrame([("x", None), ("x", None), (None, 1)], "a string, b long")
    assert mi.drop_duplicates(df).count() == 2
    assert mi.count_duplicates(df).first().duplicate_rows == 1


def test_missing_profile_top_n_rule(spark):
    # '?' is the 11th most frequent value -> not reported; 'Unknown' is 1st
    vals = ["Unknown"] * 20 + [f"v{i}" for i in range(10) for _ in range(5)] + ["?"] * 2
    df = spark.createDataFrame([(v,) for v in vals] + [(None,)], "s string")
    r = mi.missing_profile(df).first()
    assert r.potential_missing_indicators == "Unknown" and r.missing_count == 1
    num = spark.createDataFrame([(-1,), (99,), (5,)], "x long")
    assert mi.missing_profile(num).first().potential_missing_indicators == "-1, 99"


def test_age_buckets_and_persona_groups(spark):
    df = spark.createDataFrame([(a,) for a in (0, 1, 25, 26, 65, 66, 100, 101)], "age long")
    got = [r[0] for r in df.select(fc.age_bucket("age")).collect()]
    assert got == [None, "0-25", "0-25", "26-35", "56-65", "65+", "65+", None]
    p = spark.createDataFrame([(a,) for a in (24.9, 25.0, 44.9, 64.9, 65.0)], "age double")
    got = [r[0] for r in p.select(fc.persona_age_group("age")).collect()]
    assert [g.split(" (")[0] for g in got] == ["Young Adults", "Early Career", "Mid Career",
                                              "Pre-Retirement", "Retirement Age"]


def test_top_values_match_pandas(spark):
    rng = np.random.default_rng(5)
    vals = [f"k{int(v)}" for v in rng.zipf(1.5, 2000) if v < 200]
    df = spark.createDataFrame([(v,) for v in vals], "x string")
    got = pf.value_distribution(df, "x", 10).orderBy("rank").toPandas()
    vc = pd.Series(vals).value_counts().rename_axis("x").reset_index(name="count")
    top = vc.sort_values(["count", "x"], ascending=[False, True]).head(10)
    assert list(got["value"][:10]) == list(top["x"])
    assert got["count"].iloc[10] == len(vals) - top["count"].sum()
    assert got["unique_count"].iloc[0] == len(set(vals))


def test_infer_column_types(spark):
    rows = [(i % 3, float(i), str(i % 2)) for i in range(200)]
    df = spark.createDataFrame(rows, "c long, d double, s string")
    t = {r.column_name: r.inferred_type for r in pf.infer_column_types(df).collect()}
    assert t == {"c": "categorical_numeric", "d": "continuous_numeric", "s": "categorical_string"}


def test_boxplot_whiskers(spark):
    vals = [1, 2, 3, 4, 5, 6, 7, 8, 100]
    df = spark.createDataFrame([(0, float(v)) for v in vals], "g int, x double")
    r = pf.boxplot_stats(df, "x", "g").first()
    q1, q3 = np.percentile(vals, [25, 75])
    assert (r.q1, r.q3) == (q1, q3)
    assert r.whisker_high == 8 and r.whisker_low == 1 and r.outliers == 1


def test_distinct_values_are_counted_in_their_own_type(spark):
    df = spark.createDataFrame([(0.0, 0.1, 2**53), (-0.0, 0.1, 2**53 + 1), (float("nan"), None, None)],
                               "z double, f float, w long")
    got = {r.column_name: r.n_distinct for r in pf.infer_column_types(df).collect()}
    assert got == {"z": 1, "f": 1, "w": 2}
    assert [(r.value, r["count"]) for r in pf.value_distribution(df, "f").collect()] == [("0.1", 2)]


def test_low_cardinality_bound_keeps_the_edge(spark):
    """49 values stay, 50 go, whatever the hashed bits of the first pass prove."""
    df = spark.range(1000).select((F.col("id") % 49).alias("few"), (F.col("id") % 50).alias("many"),
                                  (F.col("id") * 0.5).alias("most"))
    assert {r.column_name for r in pf.low_cardinality_distributions(df).collect()} == {"few"}
    assert pf.low_cardinality_distributions(df.select("most")).count() == 0
