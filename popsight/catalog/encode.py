"""Encoding, scaling, split and the preprocessing pipeline
on persons (without the fixture's ``score`` column)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import encode as en
from ..operators.missing import drop_duplicates, sentinels_to_null
from ..operators.project import feature_group_lists
from ..schema import PERSONS_ROLES
from ..sources.tables import PERSONS_COLUMNS
from . import persons_input, register, sql_with

COLS = [c for c, _ in PERSONS_COLUMNS if c != "score"]
TYPES = dict(PERSONS_COLUMNS)
CONT = [c for c in PERSONS_ROLES.continuous if c in COLS]
CAT = [c for c in COLS if c not in CONT and c not in PERSONS_ROLES.exclude
       and c not in PERSONS_ROLES.ids]
SEL = ", ".join(COLS)


def raw(spark, sf_dir):
    return persons_input(spark, sf_dir).drop("score")


def _round_numeric(df):
    return df.select(*[F.round(F.col(c), 9).alias(c) if c in CONT else F.col(c)
                       for c in df.columns])


# ------------------------------------------------------------- SQL builders

def _nulled(src: str) -> str:
    parts = []
    for c in COLS:
        if c in PERSONS_ROLES.ids:
            parts.append(c)
        elif TYPES[c] == "string":
            parts.append(f"CASE WHEN {c} NOT IN ('Not in universe', '?') THEN {c} END AS {c}")
        elif c in PERSONS_ROLES.recodes:
            parts.append(f"CASE WHEN {c} <> 0 THEN {c} END AS {c}")
        elif c == PERSONS_ROLES.wage:
            parts.append(f"CASE WHEN {c} <> 9999 THEN {c} END AS {c}")
        else:
            parts.append(c)
    return f"SELECT {', '.join(parts)} FROM {src}"


def _split(src: str) -> str:
    """Rows of ``src`` with split = test for the round(0.2 n) smallest md5
    keys per label."""
    return f"""SELECT *, CASE WHEN ROW_NUMBER() OVER (PARTITION BY label
                 ORDER BY md5('42:' || CAST(person_id AS VARCHAR)), person_id)
               <= ROUND(0.2 * COUNT(*) OVER (PARTITION BY label)) THEN 'test' ELSE 'train' END AS split
             FROM {src}"""


def _fill_ctes(p: str, fit_src: str) -> list[tuple[str, str]]:
    med = ", ".join(f"MEDIAN(CAST({c} AS DOUBLE)) AS {c}" for c in CONT)
    mode = ", ".join(
        f"(SELECT v FROM (SELECT {c} AS v, COUNT(*) AS cnt FROM {fit_src} WHERE {c} IS NOT NULL "
        f"GROUP BY {c}) ORDER BY cnt DESC, v LIMIT 1) AS {c}" for c in CAT)
    return [(f"{p}_med", f"SELECT {med} FROM {fit_src}"), (f"{p}_mode", f"SELECT {mode}")]


def _fill_select(p: str, src: str) -> str:
    parts = []
    for c in COLS:
        if c in CONT:
            parts.append(f"COALESCE(CAST(t.{c} AS DOUBLE), {p}_med.{c}) AS {c}")
        elif c in CAT:
            default = ", 'Unknown'" if TYPES[c] == "string" else ""
            parts.append(f"COALESCE(t.{c}, {p}_mode.{c}{default}) AS {c}")
        else:
            parts.append(f"t.{c}")
    return f"SELECT {', '.join(parts)} FROM {src} t, {p}_med, {p}_mode"


def _codes(src: str) -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{c}' AS column_name, v AS value, "
        f"CAST(ROW_NUMBER() OVER (ORDER BY v) - 1 AS INTEGER) AS code "
        f"FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS v FROM {src} WHERE {c} IS NOT NULL)"
        for c in CAT)


def _encode_scale(p: str, fit_src: str, target_src: str, digits: int = 9) -> list:
    sc = ", ".join(f"ROUND(AVG({c}), 10) AS m_{c}, ROUND(STDDEV_POP({c}), 10) AS s_{c}"
                   for c in CONT)
    ctes = [(f"{p}_codes", _codes(fit_src)),
            (f"{p}_cls", f"SELECT v, CAST(ROW_NUMBER() OVER (ORDER BY v) - 1 AS INTEGER) AS code "
                         f"FROM (SELECT DISTINCT CAST(label AS VARCHAR) AS v FROM {fit_src})"),
            (f"{p}_sc", f"SELECT {sc} FROM {fit_src}")]
    parts, joins = [], []
    for c in COLS:
        if c in CONT:
            parts.append(f"ROUND((t.{c} - m_{c}) / CASE WHEN s_{c} IS NULL OR s_{c} = 0 THEN 1 "
                         f"ELSE s_{c} END, {digits}) AS {c}")
        elif c in CAT:
            parts.append(f"CAST(COALESCE(k_{c}.code, -1) AS INTEGER) AS {c}")
            joins.append(f"LEFT JOIN {p}_codes k_{c} ON k_{c}.column_name = '{c}' "
                         f"AND k_{c}.value = CAST(t.{c} AS VARCHAR)")
        elif c == "label":
            parts.append("cls.code AS label")
        else:
            parts.append(f"t.{c}")
    select = (f"SELECT {', '.join(parts)} FROM {target_src} t CROSS JOIN {p}_sc "
              f"JOIN {p}_cls cls ON cls.v = CAST(t.label AS VARCHAR) " + " ".join(joins))
    return ctes, select


def _e5_ctes() -> list[tuple[str, str]]:
    ctes = [("e5_d", f"SELECT DISTINCT {SEL} FROM persons"), ("e5_n", _nulled("e5_d"))]
    ctes += _fill_ctes("e5", "e5_n")
    ctes.append(("e5_i", _fill_select("e5", "e5_n")))
    enc, select = _encode_scale("e5", "e5_i", "e5_i")
    return ctes + enc + [("e5", select)]


def _e6_ctes() -> list[tuple[str, str]]:
    ctes = [("e6_d", f"SELECT DISTINCT {SEL} FROM persons"), ("e6_sp", _split("e6_d")),
            ("e6_train", f"SELECT {SEL} FROM e6_sp WHERE split = 'train'"),
            ("e6_test", f"SELECT {SEL} FROM e6_sp WHERE split = 'test'"),
            ("e6_ntr", _nulled("e6_train")), ("e6_nte", _nulled("e6_test"))]
    ctes += _fill_ctes("e6", "e6_ntr")
    ctes += [("e6_itr", _fill_select("e6", "e6_ntr")), ("e6_ite", _fill_select("e6", "e6_nte"))]
    enc, select = _encode_scale("e6", "e6_itr", "e6_ite")
    return ctes + enc + [("e6", select)]


# ------------------------------------------------------------- Spark side

def imputed(spark, sf_dir):
    base = sentinels_to_null(drop_duplicates(raw(spark, sf_dir)), PERSONS_ROLES)
    numeric, categorical = feature_group_lists(base, PERSONS_ROLES)
    meds, mo = en._fit_fill(base, numeric, categorical)
    return en._fill(base, meds, mo, numeric, categorical)


def processed(spark, sf_dir):
    _, out = en.preprocess_fit(raw(spark, sf_dir), PERSONS_ROLES)
    return _round_numeric(out)


def split_processed(spark, sf_dir):
    return en.stratified_split(processed(spark, sf_dir), "label", "person_id", 0.2, 42)


def raw_split(spark, sf_dir):
    return en.stratified_split(drop_duplicates(raw(spark, sf_dir)), "label", "person_id", 0.2, 42)


@register("e1_label_encode_fit", sql_with(*_e5_ctes()[:5], select=_codes("e5_i")))
def q_e1(spark, sf_dir):
    return en.label_encode_fit(imputed(spark, sf_dir), CAT)


_E2_CTES = [("e2_d", f"SELECT DISTINCT {SEL} FROM persons"), ("e2_sp", _split("e2_d")),
            ("e2_codes", _codes("(SELECT * FROM e2_sp WHERE split = 'train')"))]
_E2_SELECT = ("SELECT t.person_id, " + ", ".join(
    f"CAST(COALESCE(k_{c}.code, -1) AS INTEGER) AS {c}" for c in CAT)
    + " FROM (SELECT * FROM e2_sp WHERE split = 'test') t " + " ".join(
    f"LEFT JOIN e2_codes k_{c} ON k_{c}.column_name = '{c}' AND k_{c}.value = CAST(t.{c} AS VARCHAR)"
    for c in CAT))


@register("e2_label_encode_transform", sql_with(*_E2_CTES, select=_E2_SELECT))
def q_e2(spark, sf_dir):
    train, test = en.train_test(raw_split(spark, sf_dir))
    codes = en.fit_label_codes(train, CAT)
    return en.label_encode_transform(test.select("person_id", *CAT), codes)


@register("e3_encode_target", sql_with(select="""
  SELECT person_id, CAST(DENSE_RANK() OVER (ORDER BY label) - 1 AS INTEGER) AS label FROM persons"""))
def q_e3(spark, sf_dir):
    p = persons_input(spark, sf_dir)
    return en.encode_target(p.select("person_id", "label"), en.target_classes(p, "label"))


@register("e4_standard_scale", sql_with(
    ("sc", "SELECT " + ", ".join(f"ROUND(AVG({c}), 10) AS m_{c}, "
                                 f"ROUND(STDDEV_POP(CAST({c} AS DOUBLE)), 10) AS s_{c}"
                                 for c in CONT)
     + " FROM persons"),
    select="SELECT person_id, " + ", ".join(
        f"ROUND((CAST({c} AS DOUBLE) - m_{c}) / CASE WHEN s_{c} IS NULL OR s_{c} = 0 THEN 1 "
        f"ELSE s_{c} END, 9) AS {c}" for c in CONT) + " FROM persons, sc"))
def q_e4(spark, sf_dir):
    p = persons_input(spark, sf_dir).select("person_id", *CONT)
    return _round_numeric(en.standard_scale(p, CONT))


@register("e5_preprocess_fit_transform", sql_with(*_e5_ctes(), select="SELECT * FROM e5"))
def q_e5(spark, sf_dir):
    return processed(spark, sf_dir)


@register("e6_preprocess_transform", sql_with(*_e6_ctes(), select="SELECT * FROM e6"))
def q_e6(spark, sf_dir):
    train, test = en.train_test(raw_split(spark, sf_dir))
    fitted, _ = en.preprocess_fit(train, PERSONS_ROLES, dedup=False)
    return _round_numeric(en.preprocess_transform(test, fitted))


_E7_CTES = _e5_ctes() + [("e7", _split("e5"))]


@register("e7_stratified_split", sql_with(*_E7_CTES, select="SELECT * FROM e7"))
def q_e7(spark, sf_dir):
    return split_processed(spark, sf_dir)


@register("e8_concat_splits", sql_with(*_E7_CTES, select=f"""
  SELECT {', '.join(COLS)} FROM e7 WHERE split = 'train'
  UNION ALL SELECT {', '.join(COLS)} FROM e7 WHERE split = 'test'"""))
def q_e8(spark, sf_dir):
    train, test = en.train_test(split_processed(spark, sf_dir))
    return en.concat_splits(train, test)


@register("a11_class_balance", sql_with(*_E7_CTES, select="""
  SELECT split, label, COUNT(*) AS count,
         COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY split) * 100 AS percentage
  FROM e7 GROUP BY split, label"""))
def q_a11(spark, sf_dir):
    return en.class_balance(split_processed(spark, sf_dir), "label")


@register("a13_preprocessing_metadata", sql_with(*_E7_CTES, select=f"""
  SELECT (SELECT COUNT(*) FROM persons) AS total_records, (SELECT COUNT(*) FROM e5) AS processed_records,
    (SELECT COUNT(*) FROM persons) - (SELECT COUNT(*) FROM e5) AS records_removed,
    COUNT(*) FILTER (WHERE split = 'train') AS train_samples,
    COUNT(*) FILTER (WHERE split = 'test') AS test_samples,
    '{", ".join(CONT)}' AS numeric_features, '{", ".join(CAT)}' AS categorical_features,
    '- 50000., 50000+.' AS target_classes,
    COUNT(*) FILTER (WHERE split = 'train' AND label = 0) AS train_class_0,
    COUNT(*) FILTER (WHERE split = 'train' AND label = 1) AS train_class_1,
    COUNT(*) FILTER (WHERE split = 'test' AND label = 0) AS test_class_0,
    COUNT(*) FILTER (WHERE split = 'test' AND label = 1) AS test_class_1
  FROM e7"""))
def q_a13(spark, sf_dir):
    r = raw(spark, sf_dir)
    fitted, out = en.preprocess_fit(r, PERSONS_ROLES)
    sp = en.stratified_split(out, "label", "person_id", 0.2, 42)
    return en.preprocessing_metadata(r, out, sp, fitted, "label")
