"""M1-M9 and S3 on persons (M7-M9 after M4 so real nulls exist)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import null_tokens
from ..operators import missing as mi
from ..schema import PERSONS_ROLES
from ..sources.tables import PERSONS_COLUMNS, table
from . import persons_frequencies, persons_input, register, sql_with

COLS = [c for c, _ in PERSONS_COLUMNS]
NUM = [c for c, t in PERSONS_COLUMNS if t != "string"]
STR = [c for c, t in PERSONS_COLUMNS if t == "string"]
POS = {c: i for i, c in enumerate(COLS)}
RECODES = list(PERSONS_ROLES.recodes)
CONTINUOUS = list(PERSONS_ROLES.continuous)
# categorical = everything but continuous, label/weight/year and the id columns
CATEGORICAL = [c for c in COLS if c not in CONTINUOUS + list(PERSONS_ROLES.exclude)
               + list(PERSONS_ROLES.ids)]

NULLED_SELECT = ", ".join(
    c if c in PERSONS_ROLES.ids else
    f"CASE WHEN {c} NOT IN ('Not in universe', '?') THEN {c} END AS {c}" if c in STR else
    f"CASE WHEN {c} <> 0 THEN {c} END AS {c}" if c in RECODES else
    f"CASE WHEN {c} <> 9999 THEN {c} END AS {c}" if c == PERSONS_ROLES.wage else c
    for c in COLS)
NULLED_CTE = ("nulled", f"SELECT {NULLED_SELECT} FROM persons")


def nulled(spark, sf_dir):
    return mi.sentinels_to_null(persons_input(spark, sf_dir), PERSONS_ROLES)


def _union(template: str, cols: list[str]) -> str:
    return "\nUNION ALL ".join(template.format(c=c, i=POS[c]) for c in cols)


def null_counts_sql(source: str) -> str:
    return _union(
        f"SELECT {{i}} AS position, '{{c}}' AS column_name, COUNT(*) FILTER (WHERE {{c}} IS NULL) "
        f"AS missing_count, COUNT(*) AS n FROM {source}", COLS)


_M1_NUM = _union(
    "SELECT {i} AS position, concat_ws(', ', CASE WHEN bool_or({c} = -1) THEN '-1' END, "
    "CASE WHEN bool_or({c} = 99) THEN '99' END, CASE WHEN bool_or({c} = 999) THEN '999' END) "
    "AS indicators FROM persons", NUM)
_M1_VALS = _union("SELECT {i} AS position, CAST({c} AS VARCHAR) AS value FROM persons", STR)


@register("m1_missing_profile", sql_with(
    ("nc", null_counts_sql("persons")),
    ("num_ind", _M1_NUM),
    ("vals", _M1_VALS),
    ("cnt", "SELECT position, value, COUNT(*) AS cnt FROM vals WHERE value IS NOT NULL "
            "GROUP BY position, value"),
    ("rk", "SELECT *, ROW_NUMBER() OVER (PARTITION BY position ORDER BY cnt DESC, value) AS rn "
           "FROM cnt"),
    ("str_ind", "SELECT position, string_agg(value, ', ' ORDER BY rn) AS indicators FROM rk "
                "WHERE rn <= 10 AND trim(value) IN ('?', 'Unknown', 'Not in universe') "
                "GROUP BY position"),
    select="""
  SELECT CAST(nc.position AS INTEGER) AS position, column_name, CAST(missing_count AS BIGINT) AS missing_count,
         missing_count / n * 100 AS missing_percentage,
         COALESCE(i.indicators, '') AS potential_missing_indicators
  FROM nc LEFT JOIN (SELECT * FROM num_ind UNION ALL SELECT * FROM str_ind) i
    ON nc.position = i.position"""))
def q_m1(spark, sf_dir):
    return mi.missing_profile(persons_input(spark, sf_dir), top_n=10, freq=persons_frequencies(spark, sf_dir))


_M2_ROWS = "\nUNION ALL ".join(
    (f"SELECT {POS[c]} AS position, '{c}' AS column_name, "
     f"COUNT(*) FILTER (WHERE contains({c}, 'Not in universe')) AS not_in_universe, "
     f"COUNT(*) FILTER (WHERE {c} = '?') AS question_mark, CAST(NULL AS BIGINT) AS zero_code, "
     f"COUNT(*) FILTER (WHERE {c} IS NULL) AS explicit_na, COUNT(*) AS n FROM persons")
    if c in STR else
    (f"SELECT {POS[c]}, '{c}', NULL, NULL, COUNT(*) FILTER (WHERE {c} = 0), "
     f"COUNT(*) FILTER (WHERE {c} IS NULL), COUNT(*) FROM persons")
    for c in COLS if c in STR or c in RECODES)


@register("m2_implicit_missing_patterns", sql_with(
    ("r", _M2_ROWS),
    ("t", "SELECT *, CAST(COALESCE(not_in_universe, 0) + COALESCE(question_mark, 0) "
          "+ COALESCE(zero_code, 0) + explicit_na AS BIGINT) AS total FROM r"),
    select="""
  SELECT CAST(position AS INTEGER) AS position, column_name,
         CAST(not_in_universe AS BIGINT) AS not_in_universe, CAST(question_mark AS BIGINT) AS question_mark,
         CAST(zero_code AS BIGINT) AS zero_code, CAST(explicit_na AS BIGINT) AS explicit_na,
         total, total / n * 100 AS percentage
  FROM t WHERE total > 0 ORDER BY percentage DESC, position LIMIT 15"""))
def q_m2(spark, sf_dir):
    return mi.implicit_missing_patterns(persons_input(spark, sf_dir), PERSONS_ROLES, top=15)


_M3_ROWS = "\nUNION ALL ".join(
    (f"SELECT {POS[c]} AS position, 0 AS k, '{c}' AS column_name, 'Not in universe' AS indicator "
     f"FROM persons HAVING bool_or({c} = 'Not in universe')\n"
     f"UNION ALL SELECT {POS[c]}, 1, '{c}', '?' FROM persons HAVING bool_or({c} = '?')")
    if c in STR else
    f"SELECT {POS[c]}, 0, '{c}', '0'" if c in RECODES else
    f"SELECT {POS[c]}, 1, '{c}', '9999'"
    for c in COLS if c in STR or c in RECODES or c == PERSONS_ROLES.wage)


@register("m3_missing_indicator_map", sql_with(
    ("r", _M3_ROWS),
    select="SELECT CAST(position AS INTEGER) AS position, CAST(k AS INTEGER) AS k, column_name, "
           "indicator FROM r"))
def q_m3(spark, sf_dir):
    return mi.missing_indicator_map(persons_input(spark, sf_dir), PERSONS_ROLES)


@register("m4_sentinels_to_null", sql_with(NULLED_CTE, select="SELECT * FROM nulled"))
def q_m4(spark, sf_dir):
    return nulled(spark, sf_dir)


@register("m5_drop_duplicates", sql_with(select="SELECT DISTINCT * FROM persons"))
def q_m5(spark, sf_dir):
    return mi.drop_duplicates(persons_input(spark, sf_dir))


@register("m5_duplicate_report", sql_with(select="""
  SELECT CAST(rows AS BIGINT) AS rows, CAST(distinct_rows AS BIGINT) AS distinct_rows,
         CAST(rows - distinct_rows AS BIGINT) AS duplicate_rows,
         (rows - distinct_rows) / rows * 100 AS duplicate_percentage
  FROM (SELECT (SELECT COUNT(*) FROM persons) AS rows,
               (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM persons)) AS distinct_rows)"""))
def q_m5_report(spark, sf_dir):
    return mi.duplicate_report(persons_input(spark, sf_dir))


@register("m6_count_duplicates", sql_with(select="""
  SELECT CAST((SELECT COUNT(*) FROM persons)
              - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM persons)) AS BIGINT) AS duplicate_rows"""))
def q_m6(spark, sf_dir):
    return mi.count_duplicates(persons_input(spark, sf_dir))


@register("m7_columns_with_missing", sql_with(
    NULLED_CTE, ("nc", null_counts_sql("nulled")), select="""
  SELECT CAST(position AS INTEGER) AS position, column_name, CAST(missing_count AS BIGINT) AS missing_count,
         missing_count / n * 100 AS missing_percentage,
         CAST(SUM(missing_count) OVER () AS BIGINT) AS total_missing_cells
  FROM nc QUALIFY missing_count > 0"""))
def q_m7(spark, sf_dir):
    return mi.columns_with_missing(nulled(spark, sf_dir))


_M8_COLS = [c for c in CONTINUOUS]


@register("m8_impute_median", sql_with(
    NULLED_CTE,
    ("med", "SELECT " + ", ".join(f"MEDIAN(CAST({c} AS DOUBLE)) AS m_{c}" for c in _M8_COLS)
            + " FROM nulled"),
    select="SELECT " + ", ".join(
        f"COALESCE(CAST({c} AS DOUBLE), m_{c}) AS {c}" if c in _M8_COLS else c for c in COLS)
    + " FROM nulled, med"))
def q_m8(spark, sf_dir):
    return mi.impute_median(nulled(spark, sf_dir), _M8_COLS)


def _mode_sql(c: str, numeric: bool) -> str:
    order = f"cnt DESC, v" if numeric else "cnt DESC, v"
    return (f"(SELECT v FROM (SELECT {c} AS v, COUNT(*) AS cnt FROM nulled WHERE {c} IS NOT NULL "
            f"GROUP BY {c}) ORDER BY {order} LIMIT 1)")


_M9_COLS = [c for c in CATEGORICAL]


@register("m9_impute_mode", sql_with(
    NULLED_CTE,
    select="SELECT " + ", ".join(
        (f"COALESCE({c}, {_mode_sql(c, True)}) AS {c}" if c in NUM else
         f"COALESCE({c}, {_mode_sql(c, False)}, 'Unknown') AS {c}") if c in _M9_COLS else c
        for c in COLS) + " FROM nulled"))
def q_m9(spark, sf_dir):
    return mi.impute_mode(nulled(spark, sf_dir), _M9_COLS)


@register("s3_null_tokens", """
  SELECT l_orderkey, l_linenumber,
         CASE WHEN trim(l_returnflag) NOT IN ('N') THEN l_returnflag END AS l_returnflag
  FROM lineitem""")
def q_s3(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber",
                     null_tokens("l_returnflag", ("N",)).alias("l_returnflag"))


def _m1_sql(source: str, columns) -> str:
    cols = [c for c, _ in columns]
    pos = {c: i for i, c in enumerate(cols)}
    num = [c for c, t in columns if t in ("bigint", "int", "double", "float")]
    strs = [c for c, t in columns if t == "string"]
    nc = "\nUNION ALL ".join(
        f"SELECT {pos[c]} AS position, '{c}' AS column_name, "
        f"COUNT(*) FILTER (WHERE {c} IS NULL) AS missing_count, COUNT(*) AS n FROM {source}"
        for c in cols)
    ni = "\nUNION ALL ".join(
        f"SELECT {pos[c]} AS position, concat_ws(', ', CASE WHEN bool_or({c} = -1) THEN '-1' END, "
        f"CASE WHEN bool_or({c} = 99) THEN '99' END, CASE WHEN bool_or({c} = 999) THEN '999' END) "
        f"AS indicators FROM {source}" for c in num)
    vals = "\nUNION ALL ".join(
        f"SELECT {pos[c]} AS position, CAST({c} AS VARCHAR) AS value FROM {source}" for c in strs)
    return f"""
  WITH nc AS ({nc}), num_ind AS ({ni}), vals AS ({vals}),
  cnt AS (SELECT position, value, COUNT(*) AS cnt FROM vals WHERE value IS NOT NULL
          GROUP BY position, value),
  rk AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY position ORDER BY cnt DESC, value) AS rn FROM cnt),
  str_ind AS (SELECT position, string_agg(value, ', ' ORDER BY rn) AS indicators FROM rk
              WHERE rn <= 10 AND trim(value) IN ('?', 'Unknown', 'Not in universe') GROUP BY position)
  SELECT CAST(nc.position AS INTEGER) AS position, column_name,
         CAST(missing_count AS BIGINT) AS missing_count, missing_count / n * 100 AS missing_percentage,
         COALESCE(i.indicators, '') AS potential_missing_indicators
  FROM nc LEFT JOIN (SELECT * FROM num_ind UNION ALL SELECT * FROM str_ind) i
    ON nc.position = i.position"""


def _lineitem_columns():
    from .profile import LINEITEM_COLUMNS
    return LINEITEM_COLUMNS


@register("m1_missing_profile_lineitem", _m1_sql("lineitem", _lineitem_columns()))
def q_m1_li(spark, sf_dir):
    return mi.missing_profile(table(spark, sf_dir, "lineitem"), top_n=10)
