"""The survey's raw layout: headerless file, names with spaces, NA tokens. The
same operators as elsewhere, with ``RAW_ROLES`` and the raw column names."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..functions.columns import weeks_band_segment
from ..operators import encode as en
from ..operators import profile as pf
from ..operators import project as pr
from ..operators import segment as sg
from ..operators.missing import sentinels_to_null
from ..schema import PERSONS_ROLES, RAW_ROLES, q
from ..sources import io
from . import _ORACLES, persons_input, register, sql_with
from .encode import COLS, TYPES, _nulled, raw
from .segment import PERSONA_CATS

# Raw survey names of the persons columns that differ.
RAW_NAMES = {
    "class_of_worker": "class of worker",
    "industry_code": "detailed industry recode",
    "occupation_code": "detailed occupation recode",
    "wage_per_hour": "wage per hour",
    "marital_stat": "marital stat",
    "capital_gains": "capital gains",
    "capital_losses": "capital losses",
    "dividends": "dividends from stocks",
    "num_employer": "num persons worked for employer",
    "weeks_worked": "weeks worked in year",
}
ROLES = replace(RAW_ROLES, ids=("person_id",))
SUMMARY_RAW = [RAW_NAMES.get(c, c) for c in pf.SUMMARY_COLUMNS]
HISTOGRAM_RULES_RAW = tuple((RAW_NAMES.get(c, c), lo, hi) for c, lo, hi in pf.HISTOGRAM_RULES)
PERSONA_CATS_RAW = [RAW_NAMES.get(c, c) for c in PERSONA_CATS]


def to_raw_names(df):
    return df.select(*[F.col(q(c)).alias(RAW_NAMES.get(c, c)) for c in df.columns])


def raw_file(spark, sf_dir, df, na: str = ""):
    """``df`` in the raw layout, written headerless with its names file and read back."""
    base = io.scratch_path(spark, "raw-layout")
    named = to_raw_names(df)
    io.write_headerless(named, f"{base}/data", na=na)
    io.write_names(named, f"{base}/columns")
    names = io.read_column_names(spark, f"{base}/columns")
    types = {RAW_NAMES.get(c, c): t for c, t in TYPES.items()}
    return io.read_headerless_csv(spark, f"{base}/data", names, types)


def _renamed(sql: str, cols) -> str:
    return f"SELECT {', '.join(f'{c} AS \"{RAW_NAMES.get(c, c)}\"' for c in cols)} FROM ({sql})"


def _renamed_features(sql: str) -> str:
    cases = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in RAW_NAMES.items())
    return f"SELECT * REPLACE (CASE feature {cases} ELSE feature END AS feature) FROM ({sql})"


@register("s1_read_raw_layout", _renamed(sql_with(select=_nulled("persons")), COLS))
def q_s1_raw(spark, sf_dir):
    """Missing cells stand as NA in the file and are null when read."""
    return raw_file(spark, sf_dir, sentinels_to_null(raw(spark, sf_dir), PERSONS_ROLES), na="NA")


@register("p2_select_available_raw", _renamed(
    _ORACLES["p2_select_available"], [c for c in pr.SEGMENTATION_FEATURES if c in COLS]))
def q_p2_raw(spark, sf_dir):
    return pr.select_available(to_raw_names(raw(spark, sf_dir)), list(pr.SEGMENTATION_FEATURES_RAW))


@register("a3_describe_numeric_raw", _renamed_features(_ORACLES["a3_describe_numeric"]))
def q_a3_raw(spark, sf_dir):
    return pf.describe_numeric(to_raw_names(raw(spark, sf_dir)), SUMMARY_RAW)


@register("a14_numeric_histogram_raw", _renamed_features(_ORACLES["a14_numeric_histogram"]))
def q_a14_raw(spark, sf_dir):
    return pf.numeric_histogram(to_raw_names(raw(spark, sf_dir)), HISTOGRAM_RULES_RAW)


@register("e5_preprocess_raw", _renamed(_ORACLES["e5_preprocess_fit_transform"], COLS))
def q_e5_raw(spark, sf_dir):
    """From the raw file: read, clean, impute, encode and scale."""
    _, out = en.preprocess_fit(raw_file(spark, sf_dir, raw(spark, sf_dir)), ROLES)
    return out.select(*[F.round(q(c), 9).alias(c) if c in ROLES.continuous else F.col(q(c))
                        for c in out.columns])


def _segments_raw(spark, sf_dir):
    """Raw names with a weeks-band segment and the encoded label."""
    p = persons_input(spark, sf_dir).withColumn("segment", weeks_band_segment("weeks_worked")).withColumn(
        "label", F.when(F.col("label") == "50000+.", 1).otherwise(0))
    return to_raw_names(p)


_CHART = dict(weeks="weeks worked in year", gains="capital gains", dividends="dividends from stocks")


@register("k8_segment_profiles_raw", _ORACLES["k8_segment_profiles_scaled"])
def q_k8_raw(spark, sf_dir):
    out = sg.segment_profiles(_segments_raw(spark, sf_dir), basis="scaled", **_CHART)
    means = ("avg_age", "age_std", "avg_weeks_worked", "avg_capital_gains")
    return out.select(*[F.round(c, 9).alias(c) if c in means else F.col(c) for c in out.columns])


_K9_COLS = ["segment", "size", *PERSONA_CATS, "avg_age", "age_group", "avg_weeks_worked",
            "high_income_rate", "pct_with_capital_gains", "pct_with_dividends"]


@register("k9_segment_personas_raw", "SELECT " + ", ".join(
    f'{c} AS "{RAW_NAMES.get(c, c) if c in PERSONA_CATS else c}"' for c in _K9_COLS)
    + f" FROM ({_ORACLES['k9_segment_personas']})")
def q_k9_raw(spark, sf_dir):
    out = sg.segment_personas(_segments_raw(spark, sf_dir), PERSONA_CATS_RAW, **_CHART)
    return out.select(*[F.round(c, 9).alias(c) if c in ("avg_age", "avg_weeks_worked") else F.col(q(c))
                        for c in out.columns])
