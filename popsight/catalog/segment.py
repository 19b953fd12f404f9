"""K2-K6 on embeddings (label = cluster id), K8-K10 and K12 on persons with
the weeks-band segment (the fitted-model versions live in catalog.model)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import WEEKS_BAND_SQL, weeks_band_segment
from ..operators import segment as sg
from ..operators.silhouette import silhouette
from ..sources.tables import table
from . import persons_input, register, sql_with
from .project import PERSONA_CASE


def points(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.col("embedding").alias("features"), F.col("label").alias("segment"))


PTS = ("pts", "SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS x, "
              "generate_subscripts(embedding, 1) AS pos FROM embeddings")
CENT = ("cent", "SELECT label, pos, AVG(x) AS mu FROM pts GROUP BY label, pos")
ST = ("st", "SELECT label, COUNT(*) AS n FROM embeddings GROUP BY label")
INERTIA = ("w", "SELECT SUM((p.x - c.mu) * (p.x - c.mu)) AS inertia FROM pts p "
                "JOIN cent c ON p.label = c.label AND p.pos = c.pos")


def _ctes(*ctes):
    body = ",\n".join(f"{n} AS ({q})" for n, q in ctes)
    return f"WITH {body}\n"


@register("k2_assign_nearest", _ctes(PTS, CENT, ("d", """
  SELECT p.vec_id, c.label AS seg, SUM((p.x - c.mu) * (p.x - c.mu)) AS d
  FROM pts p JOIN cent c ON p.pos = c.pos GROUP BY p.vec_id, c.label""")) + """
  SELECT vec_id, seg AS segment, ROUND(d, 6) AS distance FROM d
  QUALIFY ROW_NUMBER() OVER (PARTITION BY vec_id ORDER BY d, seg) = 1""")
def q_k2(spark, sf_dir):
    p = points(spark, sf_dir)
    stats = sg.cluster_stats(p)
    out = sg.assign_nearest(p.drop("segment"), stats.mean)
    return out.select("vec_id", "segment", F.round("distance", 6).alias("distance"))


@register("k3_inertia", _ctes(PTS, CENT, INERTIA) + "SELECT ROUND(inertia, 6) AS inertia FROM w")
def q_k3(spark, sf_dir):
    p = points(spark, sf_dir)
    return sg.inertia(sg.cluster_stats(p)).select(F.round("inertia", 6).alias("inertia"))


@register("k4_silhouette_sq", _ctes(
    PTS, CENT, ST,
    ("sq", "SELECT label, SUM(x * x) AS y FROM pts GROUP BY label"),
    ("nrm", "SELECT vec_id, label, SUM(x * x) AS nx FROM pts GROUP BY vec_id, label"),
    ("dots", "SELECT p.vec_id, c.label AS cl, SUM(p.x * c.mu) AS dt FROM pts p "
             "JOIN cent c ON p.pos = c.pos GROUP BY p.vec_id, c.label"),
    ("dd", "SELECT d.vec_id, nrm.label AS own, d.cl, nrm.nx + sq.y / st.n - 2 * d.dt AS dist, "
           "st.n AS ncl FROM dots d JOIN nrm ON nrm.vec_id = d.vec_id "
           "JOIN sq ON sq.label = d.cl JOIN st ON st.label = d.cl"),
    ("ab", "SELECT vec_id, MAX(CASE WHEN cl = own AND ncl > 1 THEN dist * ncl / (ncl - 1) END) AS a, "
           "MIN(CASE WHEN cl <> own THEN dist END) AS b FROM dd GROUP BY vec_id")) + """
  SELECT ROUND(AVG(CASE WHEN a IS NULL OR b IS NULL THEN 0 WHEN a < b THEN 1 - a / b
                        WHEN a > b THEN b / a - 1 ELSE 0 END), 6) AS silhouette FROM ab""")
def q_k4(spark, sf_dir):
    p = points(spark, sf_dir)
    return sg.silhouette_sq(p, sg.cluster_stats(p)).select(
        F.round("silhouette", 6).alias("silhouette"))


@register("k4_silhouette", """
  WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
  st AS (SELECT label, COUNT(*) AS n FROM e GROUP BY label),
  m AS (SELECT a.vec_id, a.label AS own, b.label AS cl, SUM(list_distance(a.x, b.x)) AS s
        FROM e a CROSS JOIN e b GROUP BY a.vec_id, a.label, b.label),
  ab AS (SELECT vec_id, MAX(CASE WHEN cl = own AND n > 1 THEN s / (n - 1) END) AS a,
                MIN(CASE WHEN cl <> own THEN s / n END) AS b
         FROM m JOIN st ON st.label = m.cl GROUP BY vec_id)
  SELECT ROUND(AVG(CASE WHEN a IS NULL OR b IS NULL THEN 0 WHEN a < b THEN 1 - a / b
                        WHEN a > b THEN b / a - 1 ELSE 0 END), 6) AS silhouette, COUNT(*) AS points FROM ab""")
def q_k4_euclidean(spark, sf_dir):
    """All points of ``embeddings``; clusters of more than 1,024 points are sampled."""
    return silhouette(points(spark, sf_dir), key="vec_id", sample=1024).select(
        F.round("silhouette", 6).alias("silhouette"), "points")


@register("k5_calinski_harabasz", _ctes(
    PTS, CENT, ST, INERTIA,
    ("g", "SELECT pos, SUM(x) / (SELECT COUNT(*) FROM embeddings) AS gm FROM pts GROUP BY pos"),
    ("bt", "SELECT SUM(st.n * (c.mu - g.gm) * (c.mu - g.gm)) AS b FROM cent c "
           "JOIN g ON c.pos = g.pos JOIN st ON st.label = c.label")) + """
  SELECT ROUND(CASE WHEN inertia = 0 THEN 1.0 ELSE
    b * ((SELECT COUNT(*) FROM embeddings) - (SELECT COUNT(*) FROM st))
      / (inertia * ((SELECT COUNT(*) FROM st) - 1)) END, 6) AS calinski_harabasz
  FROM w, bt""")
def q_k5(spark, sf_dir):
    p = points(spark, sf_dir)
    return sg.calinski_harabasz(sg.cluster_stats(p)).select(
        F.round("calinski_harabasz", 6).alias("calinski_harabasz"))


@register("k6_davies_bouldin", _ctes(
    PTS, CENT,
    ("pd", "SELECT p.vec_id, p.label, SQRT(SUM((p.x - c.mu) * (p.x - c.mu))) AS dist FROM pts p "
           "JOIN cent c ON p.label = c.label AND p.pos = c.pos GROUP BY p.vec_id, p.label"),
    ("sp", "SELECT label, AVG(dist) AS s FROM pd GROUP BY label"),
    ("cd", "SELECT a.label AS i, b.label AS j, SQRT(SUM((a.mu - b.mu) * (a.mu - b.mu))) AS d "
           "FROM cent a JOIN cent b ON a.pos = b.pos AND a.label <> b.label GROUP BY a.label, b.label"),
    ("r", "SELECT cd.i, MAX((si.s + sj.s) / cd.d) AS m FROM cd JOIN sp si ON si.label = cd.i "
          "JOIN sp sj ON sj.label = cd.j GROUP BY cd.i")) + """
  SELECT ROUND(AVG(m), 6) AS davies_bouldin FROM r""")
def q_k6(spark, sf_dir):
    p = points(spark, sf_dir)
    return sg.davies_bouldin(p, sg.cluster_stats(p)).select(
        F.round("davies_bouldin", 6).alias("davies_bouldin"))


LLOYD_START, LLOYD_STEPS = (0, 1, 2), 3      # vectors that are the first centroids; updates


def _lloyd_ctes():
    ctes = [("pts", "SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings"),
            ("c0", f"SELECT CAST(vec_id AS INTEGER) AS seg, pos, x AS mu FROM pts WHERE vec_id IN {LLOYD_START}")]
    for i in range(LLOYD_STEPS + 1):
        ctes += [(f"d{i}", f"SELECT p.vec_id, c.seg, SUM((p.x - c.mu) * (p.x - c.mu)) AS d FROM pts p "
                           f"JOIN c{i} c ON p.pos = c.pos GROUP BY p.vec_id, c.seg"),
                 (f"s{i}", f"SELECT * FROM d{i} QUALIFY ROW_NUMBER() OVER (PARTITION BY vec_id ORDER BY d, seg) = 1"),
                 (f"c{i + 1}", f"SELECT s.seg, p.pos, AVG(p.x) AS mu FROM s{i} s JOIN pts p ON s.vec_id = p.vec_id GROUP BY s.seg, p.pos")]
    return _ctes(*ctes)


def _lloyd(spark, sf_dir):
    p = points(spark, sf_dir).drop("segment")
    first = p.where(F.col("vec_id").isin(list(LLOYD_START))).collect()
    return sg.lloyd(p, {r["vec_id"]: list(r["features"]) for r in first}, LLOYD_STEPS)[0]


@register("k1_lloyd_steps", _lloyd_ctes() + f"""
  SELECT seg AS segment, COUNT(*) AS size, ROUND(SUM(d), 6) AS inertia FROM s{LLOYD_STEPS} GROUP BY seg""")
def q_k1_lloyd(spark, sf_dir):
    """Three Lloyd steps over all embeddings from three given vectors."""
    return _lloyd(spark, sf_dir).groupBy(F.col("segment").cast("int").alias("segment")).agg(
        F.count("*").alias("size"), F.round(F.sum("distance"), 6).alias("inertia"))


@register("k13_lloyd_assignments", _lloyd_ctes() + f"SELECT vec_id, seg AS segment FROM s{LLOYD_STEPS}")
def q_k13_lloyd(spark, sf_dir):
    return _lloyd(spark, sf_dir).select("vec_id", F.col("segment").cast("int").alias("segment"))


# ------------------------------------------------------------- persons


def seg_persons(spark, sf_dir):
    p = persons_input(spark, sf_dir)
    return p.withColumn("segment", weeks_band_segment("weeks_worked")).withColumn(
        "label", F.when(F.col("label") == "50000+.", 1).otherwise(0))


SEGP = ("sp", f"SELECT * REPLACE (CASE WHEN label = '50000+.' THEN 1 ELSE 0 END AS label), "
              f"{WEEKS_BAND_SQL} AS segment FROM persons")
SCALED = ("sz", """SELECT * REPLACE (
    (age - (SELECT ROUND(AVG(age), 10) FROM sp)) / COALESCE(NULLIF((SELECT ROUND(STDDEV_POP(age), 10) FROM sp), 0), 1) AS age,
    (weeks_worked - (SELECT ROUND(AVG(weeks_worked), 10) FROM sp))
      / COALESCE(NULLIF((SELECT ROUND(STDDEV_POP(weeks_worked), 10) FROM sp), 0), 1) AS weeks_worked,
    (capital_gains - (SELECT ROUND(AVG(capital_gains), 10) FROM sp))
      / COALESCE(NULLIF((SELECT ROUND(STDDEV_POP(capital_gains), 10) FROM sp), 0), 1) AS capital_gains,
    (dividends - (SELECT ROUND(AVG(dividends), 10) FROM sp))
      / COALESCE(NULLIF((SELECT ROUND(STDDEV_POP(dividends), 10) FROM sp), 0), 1) AS dividends)
  FROM sp""")


def _profile_sql(src: str) -> str:
    return f"""
  SELECT segment, COUNT(*) AS size, COUNT(*) / SUM(COUNT(*)) OVER () * 100 AS percentage,
    ROUND(AVG(age), 9) AS avg_age, ROUND(STDDEV_SAMP(age), 9) AS age_std,
    COUNT(*) FILTER (WHERE label = 0) / COUNT(*) * 100 AS low_income_pct,
    COUNT(*) FILTER (WHERE label = 1) / COUNT(*) * 100 AS high_income_pct,
    ROUND(AVG(weeks_worked), 9) AS avg_weeks_worked,
    COUNT(*) FILTER (WHERE capital_gains > 0) / COUNT(*) * 100 AS pct_with_capital_gains,
    ROUND(AVG(capital_gains), 9) AS avg_capital_gains,
    COUNT(*) FILTER (WHERE dividends > 0) / COUNT(*) * 100 AS pct_with_dividends
  FROM {src} GROUP BY segment"""


_R9 = ("avg_age", "age_std", "avg_weeks_worked", "avg_capital_gains")


def _r9(df):
    return df.select(*[F.round(c, 9).alias(c) if c in _R9 else F.col(c) for c in df.columns])


@register("k8_segment_profiles", sql_with(SEGP, select=_profile_sql("sp")))
def q_k8(spark, sf_dir):
    return _r9(sg.segment_profiles(seg_persons(spark, sf_dir)))


@register("k8_segment_profiles_scaled", sql_with(SEGP, SCALED, select=_profile_sql("sz")))
def q_k8s(spark, sf_dir):
    return _r9(sg.segment_profiles(seg_persons(spark, sf_dir), basis="scaled"))


PERSONA_CATS = ["education", "marital_stat", "occupation_code", "sex"]


def _mode_cte(c: str) -> tuple[str, str]:
    return (f"m_{c}", f"""SELECT segment, CAST(v AS VARCHAR) AS {c} FROM (
      SELECT segment, v, ROW_NUMBER() OVER (PARTITION BY segment ORDER BY cnt DESC, v) AS rn
      FROM (SELECT segment, {c} AS v, COUNT(*) AS cnt FROM sp WHERE {c} IS NOT NULL
            GROUP BY segment, {c})) WHERE rn = 1""")


_PERSONA_NUM = ("pn", """
  SELECT segment, COUNT(*) AS size, AVG(CAST(age AS DOUBLE)) AS avg_age,
    AVG(CAST(weeks_worked AS DOUBLE)) AS avg_weeks_worked,
    COUNT(*) FILTER (WHERE label = 1) / COUNT(*) * 100 AS high_income_rate,
    COUNT(*) FILTER (WHERE capital_gains > 0) / COUNT(*) * 100 AS pct_with_capital_gains,
    COUNT(*) FILTER (WHERE dividends > 0) / COUNT(*) * 100 AS pct_with_dividends
  FROM sp GROUP BY segment""")
_PERSONA_SELECT = (
    "SELECT pn.segment, size, " + ", ".join(f"COALESCE(m_{c}.{c}, 'Unknown') AS {c}"
                                          for c in PERSONA_CATS)
    + ", ROUND(avg_age, 9) AS avg_age, " + PERSONA_CASE.format(a="avg_age") + " AS age_group, "
    "ROUND(avg_weeks_worked, 9) AS avg_weeks_worked, high_income_rate, pct_with_capital_gains, "
    "pct_with_dividends FROM pn " + " ".join(
        f"LEFT JOIN m_{c} ON m_{c}.segment = pn.segment" for c in PERSONA_CATS))


def personas(spark, sf_dir):
    return sg.segment_personas(seg_persons(spark, sf_dir), PERSONA_CATS)


@register("k9_segment_personas", sql_with(SEGP, _PERSONA_NUM, *[_mode_cte(c) for c in PERSONA_CATS],
                                          select=_PERSONA_SELECT))
def q_k9(spark, sf_dir):
    out = personas(spark, sf_dir)
    return out.select(*[F.round(c, 9).alias(c) if c in ("avg_age", "avg_weeks_worked")
                        else F.col(c) for c in out.columns])


@register("k10_segment_income_crosstab", sql_with(SEGP, select="""
  SELECT segment, COUNT(*) AS n,
    COUNT(*) FILTER (WHERE label = 0) / COUNT(*) * 100 AS pct_negative,
    COUNT(*) FILTER (WHERE label = 1) / COUNT(*) * 100 AS pct_positive
  FROM sp GROUP BY segment"""))
def q_k10(spark, sf_dir):
    return sg.segment_income_crosstab(seg_persons(spark, sf_dir))


def _rules_sql() -> str:
    def arr(vals):
        return "'" + ", ".join(vals) + "'"
    return f"""
  SELECT segment,
    CASE WHEN hi > 20 THEN 'Premium' WHEN hi > 8 THEN 'Core' ELSE 'Growth' END AS value_tier,
    ROUND(hi, 9) AS high_income_rate,
    CASE WHEN hi > 20 THEN '{sg.TIER_PREMIUM[1]}' WHEN hi > 8 THEN '{sg.TIER_CORE[1]}'
         ELSE '{sg.TIER_GROWTH[1]}' END AS marketing_strategy,
    CASE WHEN gains > 50 OR dv > 30 THEN {arr(sg.CHANNELS_INVESTORS)}
         WHEN wk > 0.5 AND hi > 10 THEN {arr(sg.CHANNELS_PROFESSIONALS)}
         WHEN wk > 0.5 THEN {arr(sg.CHANNELS_WORKERS)}
         WHEN age > 55 THEN {arr(sg.CHANNELS_RETIREES)} ELSE {arr(sg.CHANNELS_STARTERS)} END
      AS recommended_channels,
    CASE WHEN gains > 50 OR dv > 30 THEN {arr(sg.MESSAGING_INVESTORS)}
         WHEN wk > 0.5 AND hi > 10 THEN {arr(sg.MESSAGING_PROFESSIONALS)}
         WHEN wk > 0.5 THEN {arr(sg.MESSAGING_WORKERS)}
         WHEN age > 55 THEN {arr(sg.MESSAGING_RETIREES)} ELSE {arr(sg.MESSAGING_STARTERS)} END
      AS messaging_focus,
    CASE WHEN hi > 20 THEN 'High' WHEN hi > 8 THEN 'Medium' ELSE 'Low' END AS budget_allocation
  FROM (SELECT pr.segment, COALESCE(pr.high_income_pct, 0) AS hi, COALESCE(pr.avg_weeks_worked, 0) AS wk,
               COALESCE(pr.pct_with_capital_gains, 0) AS gains, COALESCE(pr.pct_with_dividends, 0) AS dv,
               COALESCE(pn.avg_age, 35) AS age
        FROM ({_profile_sql('sz')}) pr LEFT JOIN pn ON pn.segment = pr.segment)"""


@register("k12_segment_rules", sql_with(SEGP, SCALED, _PERSONA_NUM, select=_rules_sql()))
def q_k12(spark, sf_dir):
    sp = seg_persons(spark, sf_dir)
    prof = sg.segment_profiles(sp, basis="scaled")
    rules = sg.segment_rules(prof, sg.segment_personas(sp, PERSONA_CATS))
    return rules.select("segment", "value_tier", F.round("high_income_rate", 9)
                        .alias("high_income_rate"), "marketing_strategy",
                        F.concat_ws(", ", "recommended_channels").alias("recommended_channels"),
                        "messaging_focus", "budget_allocation")
