"""A1-A10, A12, A14-A17 on persons (A11 and A13 live with the split)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import WEEKS_BAND_SQL, age_bucket, weeks_band_segment
from ..operators import profile as pf
from ..sources.tables import PERSONS_COLUMNS
from . import persons_frequencies, persons_input, register, sql_chain, sql_with
from .evaluate import histogram_sql
from .missing import NULLED_CTE, nulled

COLS = [c for c, _ in PERSONS_COLUMNS]
TYPES = dict(PERSONS_COLUMNS)
NUM = [c for c, t in PERSONS_COLUMNS if t != "string"]
STR = [c for c, t in PERSONS_COLUMNS if t == "string"]


def _types_sql(source: str, columns=None) -> str:
    columns = list(columns or PERSONS_COLUMNS)
    numeric = ("bigint", "int", "double", "float", "smallint", "tinyint")
    rows = "\nUNION ALL ".join(
        f"SELECT {i} AS position, '{c}' AS column_name, '{t}' AS dtype, "
        f"COUNT(DISTINCT {c}) AS n_distinct, COUNT(*) AS n_rows, "
        f"{'true' if t in numeric else 'false'} AS numeric FROM {source}"
        for i, (c, t) in enumerate(columns))
    return f"""
  SELECT CAST(position AS INTEGER) AS position, column_name, dtype,
    CAST(n_distinct AS BIGINT) AS n_distinct, CAST(n_rows AS BIGINT) AS n_rows,
    CASE WHEN NOT numeric THEN 'categorical_string'
         WHEN n_distinct / n_rows < 0.05 AND n_distinct < 50 THEN 'categorical_numeric'
         ELSE 'continuous_numeric' END AS inferred_type
  FROM ({rows})"""


@register("a1_infer_column_types", sql_with(select=_types_sql("persons")))
def q_a1(spark, sf_dir):
    return pf.infer_column_types(persons_input(spark, sf_dir), freq=persons_frequencies(spark, sf_dir))


def _stats_sql(source: str, cols: list[str], names=("column_name", "q25", "q75")) -> str:
    rows = "\nUNION ALL ".join(
        f"SELECT {i} AS position, '{c}' AS {names[0]}, MIN(CAST({c} AS DOUBLE)) AS min, "
        f"MAX(CAST({c} AS DOUBLE)) AS max, ROUND(AVG(CAST({c} AS DOUBLE)), 9) AS mean, "
        f"ROUND(MEDIAN(CAST({c} AS DOUBLE)), 9) AS median, "
        f"ROUND(STDDEV_SAMP(CAST({c} AS DOUBLE)), 9) AS std, "
        f"ROUND(QUANTILE_CONT(CAST({c} AS DOUBLE), 0.25), 9) AS {names[1]}, "
        f"ROUND(QUANTILE_CONT(CAST({c} AS DOUBLE), 0.75), 9) AS {names[2]}, "
        f"COUNT({c}) AS n FROM {source}" for i, c in enumerate(cols))
    return f"SELECT * EXCLUDE (n) REPLACE (CAST(position AS INTEGER) AS position) FROM ({rows}) WHERE n > 0"


@register("a2_basic_stats", sql_with(NULLED_CTE, select=_stats_sql("nulled", NUM)))
def q_a2(spark, sf_dir):
    return pf.basic_stats(nulled(spark, sf_dir))


@register("a3_describe_numeric", sql_with(select=_stats_sql(
    "persons", list(pf.SUMMARY_COLUMNS), ("feature", "q1", "q3"))))
def q_a3(spark, sf_dir):
    return pf.describe_numeric(persons_input(spark, sf_dir))


def top_values_sql(counts_sql: str, top_n: int = 10, other: str = "other",
                   other_if_positive: bool = False) -> str:
    """Oracle twin of ``profile.top_values`` over a (column_name, value, count) query."""
    pos = " AND total - kept > 0" if other_if_positive else ""
    return f"""
  WITH cnt AS ({counts_sql}),
  pc AS (SELECT column_name, COUNT(*) AS unique_count, SUM(count) AS total FROM cnt GROUP BY column_name),
  rk AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY column_name ORDER BY count DESC, value) AS rank FROM cnt),
  top AS (SELECT column_name, rank, value, count FROM rk WHERE rank <= {top_n}),
  kept AS (SELECT column_name, SUM(count) AS kept FROM top GROUP BY column_name),
  oth AS (SELECT pc.column_name, {top_n + 1} AS rank, '{other}' AS value, total - kept AS count
          FROM pc JOIN kept ON pc.column_name = kept.column_name WHERE unique_count > {top_n}{pos})
  SELECT t.column_name, CAST(t.rank AS INTEGER) AS rank, t.value, CAST(t.count AS BIGINT) AS count,
         CAST(pc.unique_count AS BIGINT) AS unique_count
  FROM (SELECT * FROM top UNION ALL SELECT * FROM oth) t JOIN pc ON t.column_name = pc.column_name"""


def counts_sql(source: str, cols: list[str]) -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, COUNT(*) AS count "
        f"FROM {source} WHERE {c} IS NOT NULL GROUP BY {c}" for c in cols)


@register("a4_value_distribution", sql_chain(top_values_sql(counts_sql("persons", ["birth_country"]))))
def q_a4(spark, sf_dir):
    return pf.value_distribution(persons_input(spark, sf_dir), "birth_country", 10)


@register("a4_value_distribution_lineitem", top_values_sql(counts_sql("lineitem", ["l_suppkey"])))
def q_a4_li(spark, sf_dir):
    from ..sources.tables import table
    return pf.value_distribution(table(spark, sf_dir, "lineitem"), "l_suppkey", 10)


_A5_COLS = ["education", "marital_stat", "race", "sex"]


@register("a5_categorical_top", sql_chain(
    top_values_sql(counts_sql("persons", _A5_COLS), 10, "Other", True)))
def q_a5(spark, sf_dir):
    return pf.categorical_top(persons_input(spark, sf_dir), _A5_COLS, 10)


@register("a6_low_cardinality_distributions", sql_chain(
    top_values_sql(
        f"SELECT * FROM ({counts_sql('persons', COLS)}) WHERE column_name IN "
        f"(SELECT column_name FROM ({_types_sql('persons')}) "
        "WHERE inferred_type <> 'continuous_numeric' OR n_distinct < 50)")))
def q_a6(spark, sf_dir):
    return pf.low_cardinality_distributions(persons_input(spark, sf_dir), freq=persons_frequencies(spark, sf_dir))


@register("a7_target_distribution", sql_with(select="""
  SELECT label AS value, COUNT(*) AS count, COUNT(*) / SUM(COUNT(*)) OVER () * 100 AS percentage
  FROM persons GROUP BY label"""))
def q_a7(spark, sf_dir):
    return pf.target_distribution(persons_input(spark, sf_dir), "label")


@register("a7_target_distribution_lineitem", """
  SELECT l_returnflag AS value, COUNT(*) AS count, COUNT(*) / SUM(COUNT(*)) OVER () * 100 AS percentage
  FROM lineitem GROUP BY l_returnflag""")
def q_a7_li(spark, sf_dir):
    from ..sources.tables import table
    return pf.target_distribution(table(spark, sf_dir, "lineitem"), "l_returnflag")


@register("a8_imbalance_ratio", sql_with(select="""
  SELECT MAX(c) / MIN(c) AS imbalance_ratio FROM (SELECT COUNT(*) AS c FROM persons GROUP BY label)"""))
def q_a8(spark, sf_dir):
    return pf.imbalance_ratio(persons_input(spark, sf_dir), "label")


@register("a9_weight_summary", sql_with(select="""
  SELECT MIN(weight) AS min, MAX(weight) AS max, ROUND(AVG(weight), 9) AS mean,
         ROUND(MEDIAN(weight), 9) AS median, ROUND(STDDEV_SAMP(weight), 9) AS std,
         COUNT(*) FILTER (WHERE weight = 0) AS zero_weights,
         COUNT(*) FILTER (WHERE weight < 0) AS negative_weights
  FROM persons WHERE weight IS NOT NULL"""))
def q_a9(spark, sf_dir):
    return pf.weight_summary(persons_input(spark, sf_dir), "weight")


@register("a10_dataset_summary", sql_with(NULLED_CTE, select=f"""
  SELECT COUNT(*) AS total_records, {len(COLS)} AS total_features,
    CAST({' + '.join(f'COUNT(*) FILTER (WHERE {c} IS NULL)' for c in COLS)} AS BIGINT) AS total_missing_cells,
    CAST(COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM nulled)) AS BIGINT) AS duplicate_rows
  FROM nulled"""))
def q_a10(spark, sf_dir):
    return pf.dataset_summary(nulled(spark, sf_dir))


@register("a12_scale_pos_weight", sql_with(select="""
  SELECT COUNT(*) FILTER (WHERE label <> '50000+.') AS negatives,
         COUNT(*) FILTER (WHERE label = '50000+.') AS positives,
         CASE WHEN COUNT(*) FILTER (WHERE label = '50000+.') > 0 THEN
           COUNT(*) FILTER (WHERE label <> '50000+.') / COUNT(*) FILTER (WHERE label = '50000+.') END
           AS scale_pos_weight
  FROM persons"""))
def q_a12(spark, sf_dir):
    return pf.scale_pos_weight(persons_input(spark, sf_dir), "label", "50000+.")


_A14_LONG = "\nUNION ALL ".join(
    f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM persons WHERE {c} IS NOT NULL"
    + (f" AND {c} > {lo}" if lo is not None else "") + (f" AND {c} < {hi}" if hi is not None else "")
    for c, lo, hi in pf.HISTOGRAM_RULES)
_A14_CTES, _A14_SELECT = histogram_sql("hl", "value", "feature")


@register("a14_numeric_histogram", sql_with(
    ("hl", _A14_LONG), *_A14_CTES, ("h", _A14_SELECT),
    ("st", "SELECT feature, ROUND(AVG(value), 9) AS mean, ROUND(MEDIAN(value), 9) AS median "
           "FROM hl GROUP BY feature"),
    select="SELECT h.feature, bin, bin_lower, bin_upper, count, mean, median "
           "FROM h JOIN st ON h.feature = st.feature"))
def q_a14(spark, sf_dir):
    return pf.numeric_histogram(persons_input(spark, sf_dir))


def _crosstab_sql(group_expr: str, order: bool = False, top: int | None = None) -> str:
    sql = f"""
  SELECT grp AS "group", n, n_neg / n * 100 AS pct_negative, n_pos / n * 100 AS pct_positive
  FROM (SELECT {group_expr} AS grp, COUNT(*) AS n,
               COUNT(*) FILTER (WHERE label = '- 50000.') AS n_neg,
               COUNT(*) FILTER (WHERE label = '50000+.') AS n_pos
        FROM persons WHERE {group_expr} IS NOT NULL GROUP BY {group_expr})"""
    if order or top:
        sql += " ORDER BY pct_positive DESC, grp"
    if top:
        sql += f" LIMIT {top}"
    return sql


_AGE_SQL = ("CASE WHEN age > 0 AND age <= 25 THEN '0-25' WHEN age > 25 AND age <= 35 THEN '26-35' "
            "WHEN age > 35 AND age <= 45 THEN '36-45' WHEN age > 45 AND age <= 55 THEN '46-55' "
            "WHEN age > 55 AND age <= 65 THEN '56-65' WHEN age > 65 AND age <= 100 THEN '65+' END")


@register("a15_income_crosstab_education", sql_with(select=_crosstab_sql("education", True, 10)))
def q_a15_edu(spark, sf_dir):
    return pf.income_crosstab(persons_input(spark, sf_dir), "education", sort_by_positive=True, top=10)


@register("a15_income_crosstab_age", sql_with(select=_crosstab_sql(_AGE_SQL)))
def q_a15_age(spark, sf_dir):
    return pf.income_crosstab(persons_input(spark, sf_dir), age_bucket("age"))


@register("a15_income_crosstab_marital", sql_with(select=_crosstab_sql("marital_stat", True)))
def q_a15_marital(spark, sf_dir):
    return pf.income_crosstab(persons_input(spark, sf_dir), "marital_stat", sort_by_positive=True)


@register("a15_income_crosstab_sex", sql_with(select=_crosstab_sql("sex")))
def q_a15_sex(spark, sf_dir):
    return pf.income_crosstab(persons_input(spark, sf_dir), "sex")


def _box_sql(value: str) -> str:
    return f"""
  WITH d AS (SELECT {WEEKS_BAND_SQL} AS grp, CAST({value} AS DOUBLE) AS x FROM persons
             WHERE {value} IS NOT NULL),
  qs AS (SELECT grp, QUANTILE_CONT(x, 0.25) AS q1, QUANTILE_CONT(x, 0.5) AS median,
                QUANTILE_CONT(x, 0.75) AS q3 FROM d GROUP BY grp),
  f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM qs)
  SELECT d.grp AS "group", ROUND(q1, 9) AS q1, ROUND(median, 9) AS median, ROUND(q3, 9) AS q3,
    MIN(CASE WHEN x >= lo AND x <= hi THEN x END) AS whisker_low,
    MAX(CASE WHEN x >= lo AND x <= hi THEN x END) AS whisker_high,
    COUNT(*) FILTER (WHERE NOT (x >= lo AND x <= hi)) AS outliers, COUNT(*) AS n
  FROM d JOIN f ON d.grp = f.grp GROUP BY d.grp, q1, median, q3"""


@register("a16_boxplot_stats_age", sql_chain(_box_sql("age")))
def q_a16_age(spark, sf_dir):
    p = persons_input(spark, sf_dir).withColumn("segment", weeks_band_segment("weeks_worked"))
    return pf.boxplot_stats(p, "age", "segment")


@register("a16_boxplot_stats_weeks", sql_chain(_box_sql("weeks_worked")))
def q_a16_weeks(spark, sf_dir):
    p = persons_input(spark, sf_dir).withColumn("segment", weeks_band_segment("weeks_worked"))
    return pf.boxplot_stats(p, "weeks_worked", "segment")


@register("a16_boxplot_stats_lineitem", """
  WITH d AS (SELECT l_returnflag AS grp, CAST(l_quantity AS DOUBLE) AS x FROM lineitem
             WHERE l_quantity IS NOT NULL),""" + _box_sql("x").split("WHERE x IS NOT NULL),", 1)[1]
          .replace("d.grp AS \"group\"", "d.grp AS \"group\""))
def q_a16_li(spark, sf_dir):
    from ..sources.tables import table
    return pf.boxplot_stats(table(spark, sf_dir, "lineitem"), "l_quantity", "l_returnflag")


@register("a17_segment_sizes", sql_with(select=f"""
  SELECT {WEEKS_BAND_SQL} AS segment, COUNT(*) AS count,
         COUNT(*) / SUM(COUNT(*)) OVER () * 100 AS percentage
  FROM persons GROUP BY 1"""))
def q_a17(spark, sf_dir):
    p = persons_input(spark, sf_dir).withColumn("segment", weeks_band_segment("weeks_worked"))
    return pf.segment_sizes(p, "segment")


_A14E_CTES, _A14E_SELECT = histogram_sql("hl", "value", "feature")


@register("a14_numeric_histogram_events", "WITH " + ",\n".join(
    f"{n} AS ({q})" for n, q in
    [("hl", "SELECT 'value' AS feature, CAST(value AS DOUBLE) AS value FROM events "
            "WHERE value IS NOT NULL")] + list(_A14E_CTES)
    + [("h", _A14E_SELECT),
       ("st", "SELECT feature, ROUND(AVG(value), 9) AS mean, ROUND(MEDIAN(value), 9) AS median "
              "FROM hl GROUP BY feature")])
    + "\nSELECT h.feature, bin, bin_lower, bin_upper, count, mean, median "
      "FROM h JOIN st ON h.feature = st.feature")
def q_a14_events(spark, sf_dir):
    from ..sources.tables import table
    return pf.numeric_histogram(table(spark, sf_dir, "events"), rules=(("value", None, None),))


# lineitem's columns and Spark types (second input).
LINEITEM_COLUMNS = (
    ("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"),
    ("l_linenumber", "int"), ("l_quantity", "double"), ("l_extendedprice", "double"),
    ("l_discount", "double"), ("l_tax", "double"), ("l_returnflag", "string"),
    ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz"),
)


@register("a1_infer_column_types_lineitem", _types_sql("lineitem", LINEITEM_COLUMNS))
def q_a1_li(spark, sf_dir):
    from ..sources.tables import table
    return pf.infer_column_types(table(spark, sf_dir, "lineitem"))
