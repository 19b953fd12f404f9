"""Projections, filters and schema-driven column lists.

All of these are projections or filters that Catalyst pushes into the scan
(``PushedFilters`` / pruned ``ReadSchema``); schema questions are answered
from ``df.schema`` on the driver (metadata, not data).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as fc
from ..schema import PERSONS_ROLES, Roles, is_numeric, q
from .frequencies import Frequencies, frequencies


def split_features_target(df: DataFrame, roles: Roles = PERSONS_ROLES
                          ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """X = every column but label and weight; y = label; w = weight."""
    x = df.drop(roles.label, roles.weight)
    return x, df.select(roles.label), df.select(roles.weight)


def select_available(df: DataFrame, wanted: list[str]) -> DataFrame:
    """The requested columns that exist, in request order."""
    have = set(df.columns)
    return df.select(*[F.col(q(c)) for c in wanted if c in have])


# The 15 segmentation features, raw survey names.
SEGMENTATION_FEATURES_RAW = (
    "age", "sex", "race", "marital stat", "education",
    "weeks worked in year", "class of worker", "major occupation code", "major industry code",
    "capital gains", "capital losses", "dividends from stocks", "wage per hour",
    "detailed household and family stat", "family members under 18",
)

# The same list with the persons table's names where it has the column
# (persons lacks the major codes and the household columns).
SEGMENTATION_FEATURES = (
    "age", "sex", "race", "marital_stat", "education",
    "weeks_worked", "class_of_worker", "major occupation code", "major industry code",
    "capital_gains", "capital_losses", "dividends", "wage_per_hour",
    "detailed household and family stat", "family members under 18",
)


def numeric_column_names(df: DataFrame, exclude=("weight", "year")) -> list[str]:
    return [c for c in df.columns if is_numeric(df, c) and c not in exclude]


def numeric_columns(df: DataFrame, exclude=("weight", "year")) -> DataFrame:
    """Numeric columns minus ``exclude``."""
    return df.select(*[F.col(q(c)) for c in numeric_column_names(df, exclude)])


def feature_group_lists(df: DataFrame, roles: Roles = PERSONS_ROLES
                        ) -> tuple[list[str], list[str]]:
    """(numeric, categorical): the continuous names present; everything else
    but label/weight/year (and id columns) is categorical."""
    skip = set(roles.exclude) | set(roles.ids)
    numeric = [c for c in roles.continuous if c in df.columns and c not in skip]
    categorical = [c for c in df.columns if c not in skip and c not in numeric]
    return numeric, categorical


def _schema_table(df: DataFrame, rows: list[tuple[int, str, str]], names: tuple[str, str, str],
                  freq: Frequencies | None = None) -> DataFrame:
    """A (position, name, value) table about ``df``'s columns with each one's
    ``non_null`` rows and ``distinct_values``, from the frequency table."""
    if not rows:
        return df.sparkSession.createDataFrame([], f"{names[0]} int, {names[1]} string, {names[2]} string, "
                                               "non_null bigint, distinct_values bigint")
    listed = df.sparkSession.createDataFrame(rows, f"{names[0]} int, {names[1]} string, {names[2]} string")
    per = (freq or frequencies(df, [c for _, c, _ in rows], keep=False)).per_column([c for _, c, _ in rows]).select(
        F.col("column_name").alias("_c"), "non_null", F.col("n_distinct").alias("distinct_values"))
    # one row per column of the table on either side
    return listed.join(F.broadcast(per), F.col(names[1]) == F.col("_c"), "left").select(
        *names, *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("non_null", "distinct_values")])


def feature_groups(df: DataFrame, roles: Roles = PERSONS_ROLES, freq: Frequencies | None = None) -> DataFrame:
    """(position, feature, feature_group) with group numeric/categorical,
    and each feature's non-null rows and distinct values."""
    numeric, categorical = feature_group_lists(df, roles)
    rows = [(i, c, "numeric" if c in numeric else "categorical")
            for i, c in enumerate(df.columns) if c in numeric or c in categorical]
    return _schema_table(df, rows, ("position", "feature", "feature_group"), freq)


def detect_roles(df: DataFrame) -> DataFrame:
    """P5: target = the last column; weight = the first column whose name
    contains 'weight' or 'wgt' (any case). Rows (position, column_name, role, non_null, distinct_values)."""
    rows = [(len(df.columns) - 1, df.columns[-1], "target")]
    for i, c in enumerate(df.columns):
        if "weight" in c.lower() or "wgt" in c.lower():
            rows.append((i, c, "weight"))
            break
    return _schema_table(df, rows, ("position", "column_name", "role"))


def positive_subset(df: DataFrame, column: str, upper: float | None = None) -> DataFrame:
    """Rows with ``column > 0`` (and ``< upper`` when given); NaN, which
    Spark orders above all numbers, is missing and not positive."""
    cond = F.col(q(column)) > 0
    if df.schema[column].dataType.typeName() in ("double", "float"):
        cond = cond & ~F.isnan(F.col(q(column)))
    if upper is not None:
        cond = cond & (F.col(q(column)) < F.lit(upper))
    return df.where(cond)


def with_age_bucket(df: DataFrame, age: str = "age") -> DataFrame:
    """Adds age_group (right-closed buckets, 0 and >100 -> null) and its order."""
    return df.withColumn("age_group", fc.age_bucket(age)).withColumn(
        "age_group_order", fc.age_bucket_order(age))


def with_persona_age_group(df: DataFrame, age: str = "age") -> DataFrame:
    """Adds age_group from the persona rules (< 25, < 35, ...)."""
    return df.withColumn("age_group", fc.persona_age_group(F.col(q(age)).cast("double")))


def with_truncated_label(df: DataFrame, column: str, n: int = 30) -> DataFrame:
    """Adds ``<column>_label`` = the first ``n`` characters."""
    return df.withColumn(f"{column}_label", fc.truncate_label(q(column), n))
