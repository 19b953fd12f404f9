"""P1-P9 on persons."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import project as pr
from ..schema import PERSONS_ROLES
from ..sources.tables import PERSONS_COLUMNS
from . import persons_frequencies, persons_input, register, sql_with

COLS = [c for c, _ in PERSONS_COLUMNS]
NUM = [c for c, t in PERSONS_COLUMNS if t != "string"]


def _cols(cols) -> str:
    return ", ".join(f'"{c}"' if " " in c else c for c in cols)


@register("p1_split_features_target", sql_with(
    select=f"SELECT {_cols(c for c in COLS if c not in ('label', 'weight'))} FROM persons"))
def q_p1(spark, sf_dir):
    x, _, _ = pr.split_features_target(persons_input(spark, sf_dir), PERSONS_ROLES)
    return x


@register("p2_select_available", sql_with(
    select=f"SELECT {_cols(c for c in pr.SEGMENTATION_FEATURES if c in COLS)} FROM persons"))
def q_p2(spark, sf_dir):
    return pr.select_available(persons_input(spark, sf_dir), list(pr.SEGMENTATION_FEATURES))


@register("p3_numeric_columns", sql_with(
    select=f"SELECT {_cols(c for c in NUM if c not in ('label', 'weight', 'year'))} FROM persons"))
def q_p3(spark, sf_dir):
    return pr.numeric_columns(persons_input(spark, sf_dir), exclude=("label", "weight", "year"))


def _column_table(rows, names) -> str:
    """One row per (position, column, value): the column's counts come from persons."""
    return " UNION ALL ".join(
        f"SELECT {p} AS {names[0]}, '{c}' AS {names[1]}, '{v}' AS {names[2]}, COUNT({_cols([c])}) AS non_null, "
        f"COUNT(DISTINCT {_cols([c])}) AS distinct_values FROM persons" for p, c, v in rows)


_P4_NUM = [c for c in PERSONS_ROLES.continuous if c in COLS]
_P4_ROWS = [(i, c, "numeric" if c in _P4_NUM else "categorical") for i, c in enumerate(COLS)
            if c not in PERSONS_ROLES.exclude and c not in PERSONS_ROLES.ids]


@register("p4_feature_groups", sql_with(
    select=_column_table(_P4_ROWS, ("position", "feature", "feature_group"))))
def q_p4(spark, sf_dir):
    return pr.feature_groups(persons_input(spark, sf_dir), PERSONS_ROLES, persons_frequencies(spark, sf_dir))


@register("p5_detect_roles", sql_with(
    select=_column_table([(19, "label", "target"), (18, "weight", "weight")],
                         ("position", "column_name", "role"))))
def q_p5(spark, sf_dir):
    # the survey layout ends with the label: drop the fixture's extra score column
    return pr.detect_roles(persons_input(spark, sf_dir).drop("score"))


@register("p6_positive_subset", sql_with(
    select="SELECT person_id, wage_per_hour FROM persons WHERE wage_per_hour > 0 "
           "AND wage_per_hour < 2000"))
def q_p6(spark, sf_dir):
    return pr.positive_subset(persons_input(spark, sf_dir), "wage_per_hour", 2000).select(
        "person_id", "wage_per_hour")


@register("p7_age_bucket", sql_with(select="""
  SELECT person_id, age,
    CASE WHEN age > 0 AND age <= 25 THEN '0-25' WHEN age > 25 AND age <= 35 THEN '26-35'
         WHEN age > 35 AND age <= 45 THEN '36-45' WHEN age > 45 AND age <= 55 THEN '46-55'
         WHEN age > 55 AND age <= 65 THEN '56-65' WHEN age > 65 AND age <= 100 THEN '65+' END AS age_group,
    CASE WHEN age > 0 AND age <= 25 THEN 1 WHEN age > 25 AND age <= 35 THEN 2
         WHEN age > 35 AND age <= 45 THEN 3 WHEN age > 45 AND age <= 55 THEN 4
         WHEN age > 55 AND age <= 65 THEN 5 WHEN age > 65 AND age <= 100 THEN 6 END AS age_group_order
  FROM persons"""))
def q_p7(spark, sf_dir):
    return pr.with_age_bucket(persons_input(spark, sf_dir).select("person_id", "age"))


PERSONA_CASE = """CASE WHEN {a} < 25 THEN 'Young Adults (18-24)' WHEN {a} < 35 THEN 'Early Career (25-34)'
         WHEN {a} < 45 THEN 'Mid Career (35-44)' WHEN {a} < 55 THEN 'Established (45-54)'
         WHEN {a} < 65 THEN 'Pre-Retirement (55-64)' ELSE 'Retirement Age (65+)' END"""


@register("p8_persona_age_group", sql_with(
    select=f"SELECT person_id, age, {PERSONA_CASE.format(a='CAST(age AS DOUBLE)')} AS age_group "
           "FROM persons"))
def q_p8(spark, sf_dir):
    return pr.with_persona_age_group(persons_input(spark, sf_dir).select("person_id", "age"))


@register("p9_truncate_label", sql_with(select="""
  SELECT migration, substring(migration, 1, 30) AS migration_label, COUNT(*) AS n
  FROM persons GROUP BY migration"""))
def q_p9(spark, sf_dir):
    counts = persons_input(spark, sf_dir).groupBy("migration").agg(F.count("*").alias("n"))
    return pr.with_truncated_label(counts, "migration", 30).select(
        "migration", "migration_label", "n")
