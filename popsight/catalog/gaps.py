"""The one rule for missing values (NaN is null) on queries of persons in which
some numbers are NaN. The oracle reads the same rows with NULL in their place."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import weeks_band_segment
from ..operators import encode as en
from ..operators import missing as mi
from ..operators import profile as pf
from ..schema import PERSONS_ROLES
from ..sources.tables import persons_sql
from . import oracles_so_far, persons_input, register
from .encode import _round_numeric

#: column -> (modulus, remainder) of the person_id whose value is missing
GAPS = {"age": (10, 3), "dividends": (7, 2), "weight": (9, 4), "capital_gains": (11, 5)}


def persons_nan(spark, sf_dir):
    return persons_input(spark, sf_dir).withColumns({
        c: F.when(F.col("person_id") % m == r, F.lit(float("nan"))).otherwise(F.col(c).cast("double")) for c, (m, r) in GAPS.items()})


def nulled_nan(spark, sf_dir):
    return mi.sentinels_to_null(persons_nan(spark, sf_dir), PERSONS_ROLES)


def _with_gaps(name: str) -> str:
    """The query's oracle over persons with NULL where ``persons_nan`` has NaN."""
    parts = ", ".join(f"CASE WHEN person_id % {m} <> {r} THEN CAST({c} AS DOUBLE) END AS {c}" for c, (m, r) in GAPS.items())
    sql, plain = oracles_so_far()[name], f"persons AS ({persons_sql()})"
    if plain not in sql:
        raise ValueError(f"{name} doesn't start from persons")
    return sql.replace(plain, f"persons_full AS ({persons_sql()}), persons AS (SELECT * REPLACE ({parts}) FROM persons_full)")


@register("a2_basic_stats_nan", _with_gaps("a2_basic_stats"))
def q_a2(spark, sf_dir):
    return pf.basic_stats(nulled_nan(spark, sf_dir))


@register("a9_weight_summary_nan", _with_gaps("a9_weight_summary"))
def q_a9(spark, sf_dir):
    return pf.weight_summary(persons_nan(spark, sf_dir))


@register("a14_numeric_histogram_nan", _with_gaps("a14_numeric_histogram"))
def q_a14(spark, sf_dir):
    return pf.numeric_histogram(persons_nan(spark, sf_dir))


@register("a16_boxplot_stats_age_nan", _with_gaps("a16_boxplot_stats_age"))
def q_a16(spark, sf_dir):
    p = persons_nan(spark, sf_dir).withColumn("segment", weeks_band_segment("weeks_worked"))
    return pf.boxplot_stats(p, "age", "segment")


@register("e5_preprocess_fit_transform_nan", _with_gaps("e5_preprocess_fit_transform"))
def q_e5(spark, sf_dir):
    _, out = en.preprocess_fit(persons_nan(spark, sf_dir).drop("score"), PERSONS_ROLES)
    return _round_numeric(out).withColumn("weight", F.when(~F.isnan("weight"), F.col("weight")))


@register("m7_columns_with_missing_nan", _with_gaps("m7_columns_with_missing"))
def q_m7(spark, sf_dir):
    return mi.columns_with_missing(nulled_nan(spark, sf_dir))


@register("a10_dataset_summary_nan", _with_gaps("a10_dataset_summary"))
def q_a10(spark, sf_dir):
    return pf.dataset_summary(nulled_nan(spark, sf_dir))
