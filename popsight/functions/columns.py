"""Column-expression helpers (JVM-side, codegen-friendly; no Python UDFs)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num: Column, den: Column) -> Column:
    """num / den as double; null when den is 0 or null (never raises under ANSI)."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def ratio_or_zero(num: Column, den: Column) -> Column:
    """num / den, 0.0 when undefined (the reference's ``x / y if y > 0 else 0``)."""
    return F.coalesce(ratio(num, den), F.lit(0.0))


def percent(num: Column, den: Column) -> Column:
    """num / den * 100 (null when den is 0)."""
    return ratio(num, den) * F.lit(100.0)


def binary_label(label: str | Column, positive: str | int = 1) -> Column:
    """0/1 int from a label column and its positive value."""
    return F.when(col(label) == F.lit(positive), F.lit(1)).otherwise(F.lit(0))


def predict_with_threshold(score: str | Column, threshold: float = 0.5) -> Column:
    """P10: ``score >= t`` as 0/1 (inclusive)."""
    return F.when(col(score) >= F.lit(float(threshold)), F.lit(1)).otherwise(F.lit(0))


# Age buckets of the income-by-age chart (right-closed,
# lowest edge excluded) and their labels.
AGE_BUCKET_EDGES = (0, 25, 35, 45, 55, 65, 100)
AGE_BUCKET_LABELS = ("0-25", "26-35", "36-45", "46-55", "56-65", "65+")


def age_bucket(age: str | Column) -> Column:
    """(0,25] -> '0-25', (25,35] -> '26-35', ... (65,100] -> '65+';
    outside (0, 100] (including 0) -> null."""
    a = col(age)
    expr = None
    for lo, hi, label in zip(AGE_BUCKET_EDGES[:-1], AGE_BUCKET_EDGES[1:], AGE_BUCKET_LABELS):
        cond = (a > F.lit(lo)) & (a <= F.lit(hi))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr


def age_bucket_order(age: str | Column) -> Column:
    """Sort key (1..6) that goes with :func:`age_bucket`."""
    a = col(age)
    expr = None
    for n, (lo, hi) in enumerate(zip(AGE_BUCKET_EDGES[:-1], AGE_BUCKET_EDGES[1:]), start=1):
        cond = (a > F.lit(lo)) & (a <= F.lit(hi))
        expr = F.when(cond, F.lit(n)) if expr is None else expr.when(cond, F.lit(n))
    return expr


# Marketing age groups for persona means.
PERSONA_AGE_GROUPS = (
    (25, "Young Adults (18-24)"),
    (35, "Early Career (25-34)"),
    (45, "Mid Career (35-44)"),
    (55, "Established (45-54)"),
    (65, "Pre-Retirement (55-64)"),
)
PERSONA_AGE_TOP = "Retirement Age (65+)"


def persona_age_group(age: str | Column) -> Column:
    """First of ``age < 25, < 35, < 45, < 55, < 65``, else 65+."""
    a = col(age)
    expr = None
    for bound, label in PERSONA_AGE_GROUPS:
        expr = F.when(a < F.lit(bound), F.lit(label)) if expr is None else \
            expr.when(a < F.lit(bound), F.lit(label))
    return expr.otherwise(F.lit(PERSONA_AGE_TOP))


def truncate_label(c: str | Column, n: int = 30) -> Column:
    """First ``n`` characters."""
    return F.substring(col(c), 1, n)


# read_csv's default NA tokens.
DEFAULT_NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)


def null_tokens(c: str | Column, tokens=DEFAULT_NA_TOKENS) -> Column:
    """S3: a string value whose trimmed text is an NA token becomes null."""
    x = col(c)
    return F.when(~F.trim(x).isin(list(tokens)), x)


def row_key(cols: list[str]) -> Column:
    """Stable row identity over all columns: md5 of the null-marked,
    delimited values (``concat_ws`` alone would merge rows that differ
    only in where a null sits)."""
    parts = [F.coalesce(F.concat(F.lit("v"), F.col(f"`{c}`").cast("string")), F.lit("n"))
             for c in cols]
    return F.md5(F.concat_ws("\u0001", *parts))


def weeks_band_segment(weeks: str | Column = "weeks_worked") -> Column:
    """Deterministic stand-in segment for checking segment operators without a
    fitted model: weeks worked 0 -> 0, 1-39 -> 1, 40+ -> 2."""
    w = col(weeks)
    return F.when(w == 0, F.lit(0)).when(w <= 39, F.lit(1)).otherwise(F.lit(2))


WEEKS_BAND_SQL = ("CASE WHEN weeks_worked = 0 THEN 0 WHEN weeks_worked <= 39 THEN 1 "
                  "ELSE 2 END")


def present(df: DataFrame, name: str) -> Column:
    """A column with NaN read as null, the library's one rule for missing values."""
    c = F.col("`" + name.replace("`", "``") + "`")
    return F.when(~F.isnan(c), c) if df.schema[name].dataType.typeName() in ("double", "float") else c


def f1_score(precision: Column, recall: Column) -> Column:
    """2PR / (P + R), 0 when both are 0 (the sweep's and report's F1)."""
    return F.when(precision + recall > 0,
                  F.lit(2.0) * precision * recall / (precision + recall)).otherwise(F.lit(0.0))
