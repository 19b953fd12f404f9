"""C1-C3 on persons (numeric minus weight/year) and on lineitem."""

from __future__ import annotations

from ..operators import correlate as co
from ..sources.tables import PERSONS_COLUMNS, table
from . import persons_input, register, sql_with

NUM = [c for c, t in PERSONS_COLUMNS if t != "string" and c not in ("weight", "year")]
LI_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def corr_sql(source: str, cols: list[str]) -> str:
    rows = []
    for i in range(len(cols)):
        for j in range(i, len(cols)):
            a = f"CASE WHEN {cols[j]} IS NOT NULL THEN CAST({cols[i]} AS DOUBLE) END"
            b = f"CASE WHEN {cols[i]} IS NOT NULL THEN CAST({cols[j]} AS DOUBLE) END"
            r = (f"ROUND(CASE WHEN STDDEV_POP({a}) * STDDEV_POP({b}) <> 0 THEN "
                 f"COVAR_POP({a}, {b}) / (STDDEV_POP({a}) * STDDEV_POP({b})) END, 9)")
            rows.append(f"SELECT {i} AS i, {j} AS j, '{cols[i]}' AS feature1, "
                        f"'{cols[j]}' AS feature2, {r} AS r FROM {source}")
    half = "\nUNION ALL ".join(rows)
    return (f"SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, feature1, feature2, r "
            f"FROM (SELECT * FROM ({half}) UNION ALL "
            f"SELECT j, i, feature2, feature1, r FROM ({half}) WHERE i <> j)")


@register("c1_correlation_matrix", sql_with(select=corr_sql("persons", NUM)))
def q_c1(spark, sf_dir):
    return co.correlation_matrix(persons_input(spark, sf_dir), NUM)


@register("c1_correlation_matrix_lineitem", corr_sql("lineitem", LI_NUM))
def q_c1_li(spark, sf_dir):
    return co.correlation_matrix(table(spark, sf_dir, "lineitem"), LI_NUM)


@register("c2_correlation_lower_triangle", sql_with(
    select=f"SELECT * FROM ({corr_sql('persons', NUM)}) WHERE j <= i"))
def q_c2(spark, sf_dir):
    return co.correlation_lower_triangle(co.correlation_matrix(persons_input(spark, sf_dir), NUM))


@register("c3_high_correlation_pairs", sql_with(
    select=f"SELECT feature1, feature2, r AS correlation FROM ({corr_sql('persons', NUM)}) "
           "WHERE i < j AND ABS(r) > 0.7"))
def q_c3(spark, sf_dir):
    return co.high_correlation_pairs(co.correlation_matrix(persons_input(spark, sf_dir), NUM), 0.7)
