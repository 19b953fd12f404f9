"""V1-V8 on the persons scored table."""

from __future__ import annotations

from ..operators import evaluate as ev
from . import register, sql_with
from .threshold import SCORED_CTE, scored

CNT_CTE = ("cnt", """
  SELECT score, COUNT(*) FILTER (WHERE label = 1) AS pos, COUNT(*) FILTER (WHERE label = 0) AS neg
  FROM s GROUP BY score""")
TOT_CTE = ("tot", "SELECT SUM(pos) AS p, SUM(neg) AS n FROM cnt")
CUM_CTE = ("cum", """
  SELECT score, pos, neg,
    SUM(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_pos,
    SUM(neg) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_neg
  FROM cnt""")
CURVE_CTES = (SCORED_CTE, CNT_CTE, TOT_CTE, CUM_CTE)
CONF_CTE = ("conf", """
  SELECT COUNT(*) FILTER (WHERE label = 0 AND NOT score >= 0.5) AS tn,
         COUNT(*) FILTER (WHERE label = 0 AND score >= 0.5) AS fp,
         COUNT(*) FILTER (WHERE label = 1 AND NOT score >= 0.5) AS fn,
         COUNT(*) FILTER (WHERE label = 1 AND score >= 0.5) AS tp
  FROM s""")
AUC_SQL = """
  SELECT CASE WHEN p > 0 AND n > 0 THEN
    CAST(SUM(CAST(pos AS HUGEINT) * CAST(2 * (n - cum_neg) + neg AS HUGEINT)) AS DOUBLE)
      / (CAST(2 AS DOUBLE) * CAST(p AS DOUBLE) * CAST(n AS DOUBLE)) END AS roc_auc
  FROM cum, tot GROUP BY p, n"""
AP_SQL = """
  SELECT CASE WHEN p > 0 THEN ROUND(SUM(CAST(pos AS DOUBLE) * (cum_pos / (cum_pos + cum_neg)))
                                    / CAST(p AS DOUBLE), 12) END AS average_precision
  FROM cum, tot GROUP BY p"""


@register("v1_confusion_matrix", sql_with(SCORED_CTE, CONF_CTE, select="SELECT * FROM conf"))
def q_v1(spark, sf_dir):
    return ev.confusion_matrix(scored(spark, sf_dir), 0.5)


@register("v2_overall_metrics", sql_with(
    *CURVE_CTES, CONF_CTE, ("auc", AUC_SQL), ("ap", AP_SQL), select="""
  SELECT (tn + tp) / (tn + fp + fn + tp) AS accuracy,
    CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE CAST(0 AS DOUBLE) END AS f1_score,
    roc_auc, average_precision AS pr_auc
  FROM (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE CAST(0 AS DOUBLE) END AS pr,
               CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE CAST(0 AS DOUBLE) END AS rc
        FROM conf), auc, ap"""))
def q_v2(spark, sf_dir):
    return ev.overall_metrics(scored(spark, sf_dir), 0.5)


_V3_W = """
  SELECT p0, r0, CASE WHEN p0 + r0 > 0 THEN 2 * p0 * r0 / (p0 + r0) ELSE CAST(0 AS DOUBLE) END AS f0, s0,
         p1, r1, CASE WHEN p1 + r1 > 0 THEN 2 * p1 * r1 / (p1 + r1) ELSE CAST(0 AS DOUBLE) END AS f1, s1,
         s0 + s1 AS n, (tn + tp) / (s0 + s1) AS acc
  FROM (SELECT tn, tp,
          CASE WHEN tn + fn > 0 THEN tn / (tn + fn) ELSE CAST(0 AS DOUBLE) END AS p0,
          CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE CAST(0 AS DOUBLE) END AS r0,
          CAST(tn + fp AS DOUBLE) AS s0,
          CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE CAST(0 AS DOUBLE) END AS p1,
          CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE CAST(0 AS DOUBLE) END AS r1,
          CAST(tp + fn AS DOUBLE) AS s1
        FROM conf)"""


@register("v3_classification_report", sql_with(SCORED_CTE, CONF_CTE, ("w", _V3_W), select="""
  SELECT 0 AS row_order, '0' AS class, p0 AS precision, r0 AS recall, f0 AS f1_score,
         CAST(s0 AS BIGINT) AS support FROM w
  UNION ALL SELECT 1, '1', p1, r1, f1, CAST(s1 AS BIGINT) FROM w
  UNION ALL SELECT 2, 'accuracy', NULL, NULL, acc, CAST(n AS BIGINT) FROM w
  UNION ALL SELECT 3, 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, CAST(n AS BIGINT) FROM w
  UNION ALL SELECT 4, 'weighted avg', (p0 * s0 + p1 * s1) / n, (r0 * s0 + r1 * s1) / n,
                   (f0 * s0 + f1 * s1) / n, CAST(n AS BIGINT) FROM w"""))
def q_v3(spark, sf_dir):
    return ev.classification_report(scored(spark, sf_dir), 0.5)


@register("v4_roc_curve", sql_with(*CURVE_CTES, select="""
  SELECT CAST(NULL AS DOUBLE) AS threshold, CAST(0 AS DOUBLE) AS fpr, CAST(0 AS DOUBLE) AS tpr
  UNION ALL
  SELECT score, CASE WHEN n > 0 THEN cum_neg / n END, CASE WHEN p > 0 THEN cum_pos / p END
  FROM cum, tot"""))
def q_v4(spark, sf_dir):
    return ev.roc_curve(scored(spark, sf_dir))


@register("v5_roc_auc", sql_with(*CURVE_CTES, select=AUC_SQL))
def q_v5(spark, sf_dir):
    return ev.roc_auc(scored(spark, sf_dir))


@register("v6_average_precision", sql_with(*CURVE_CTES, select=AP_SQL))
def q_v6(spark, sf_dir):
    return ev.average_precision(scored(spark, sf_dir))


@register("v7_pr_curve", sql_with(*CURVE_CTES, select="""
  SELECT score AS threshold, cum_pos / (cum_pos + cum_neg) AS precision,
         CASE WHEN p = 0 THEN CAST(1 AS DOUBLE) ELSE cum_pos / p END AS recall
  FROM cum, tot
  UNION ALL SELECT CAST(NULL AS DOUBLE), CAST(1 AS DOUBLE), CAST(0 AS DOUBLE)"""))
def q_v7(spark, sf_dir):
    return ev.pr_curve(scored(spark, sf_dir))


def histogram_sql(source: str, value: str, key: str, bins: int = 50) -> tuple:
    """CTEs + select for numpy-rule equal-width histograms of ``value`` per
    ``key`` over the relation ``source`` (oracle side)."""
    ctes = (
        ("hst", f"""SELECT {key}, MIN({value}) AS mn, MAX({value}) AS mx, COUNT(*) AS n
                    FROM {source} WHERE {value} IS NOT NULL AND NOT isnan({value}) GROUP BY {key}"""),
        ("hst2", """SELECT *, (hi - lo) / CAST(%d AS DOUBLE) AS step FROM (
                    SELECT %s, n, CASE WHEN mn = mx THEN mn - 0.5 ELSE mn END AS lo,
                           CASE WHEN mn = mx THEN mx + 0.5 ELSE mx END AS hi FROM hst)"""
         % (bins, key)),
        ("hj", f"""SELECT {source}.{key}, CAST({value} AS DOUBLE) AS x, lo, hi, step,
                    LEAST(GREATEST(FLOOR((CAST({value} AS DOUBLE) - lo) / (hi - lo)
                                         * CAST({bins} AS DOUBLE)), 0), {bins - 1}) AS c
                   FROM {source} JOIN hst2 ON {source}.{key} = hst2.{key}
                   WHERE {value} IS NOT NULL AND NOT isnan({value})"""),
        ("hb", f"""SELECT {key}, CAST(CASE
                     WHEN x < (CASE WHEN c >= {bins} THEN hi ELSE lo + c * step END) THEN c - 1
                     WHEN c <> {bins - 1} AND x >= (CASE WHEN c + 1 >= {bins} THEN hi
                                                   ELSE lo + (c + 1) * step END) THEN c + 1
                     ELSE c END AS INTEGER) AS bin FROM hj"""),
        ("hc", f"SELECT {key}, bin, COUNT(*) AS cnt FROM hb GROUP BY {key}, bin"),
        ("hg", f"""SELECT {key}, n, CAST(range AS INTEGER) AS bin,
                     CASE WHEN range >= {bins} THEN hi ELSE lo + CAST(range AS DOUBLE) * step END AS bin_lower,
                     CASE WHEN range + 1 >= {bins} THEN hi ELSE lo + CAST(range + 1 AS DOUBLE) * step END AS bin_upper
                   FROM hst2, range(0, {bins})"""),
    )
    select = f"""
      SELECT hg.{key}, hg.bin, bin_lower, bin_upper, CAST(COALESCE(cnt, 0) AS BIGINT) AS count,
             CAST(COALESCE(cnt, 0) AS DOUBLE) / (bin_upper - bin_lower) / CAST(n AS DOUBLE) AS density, n
      FROM hg LEFT JOIN hc ON hg.{key} = hc.{key} AND hg.bin = hc.bin"""
    return ctes, select


_V8_CTES, _V8_SELECT = histogram_sql("s", "score", "label")


@register("v8_score_histogram", sql_with(SCORED_CTE, *_V8_CTES, select=_V8_SELECT))
def q_v8(spark, sf_dir):
    return ev.score_histogram(scored(spark, sf_dir), 50)


# ------------------------------------------------------------- second input:
# documents with a quality label, scored by a monotone function of length.

def documents_scored(spark, sf_dir):
    from pyspark.sql import functions as F
    from ..sources.tables import table
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality")
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    j = lab.join(docs, "doc_id")
    score = F.col("n_chars").cast("double") / (F.col("n_chars").cast("double") + F.lit(1000.0))
    return j.select(F.col("quality").cast("int").alias("label"), score.alias("score"))


DOC_SCORED_CTE = ("s", "SELECT CAST(l.quality AS INTEGER) AS label, "
                       "CAST(d.n_chars AS DOUBLE) / (CAST(d.n_chars AS DOUBLE) + 1000.0) AS score "
                       "FROM labels l JOIN documents d ON l.doc_id = d.doc_id")


def _doc_sql(*ctes, select):
    body = ",\n".join(f"{n} AS ({q})" for n, q in ctes)
    return f"WITH {body}\n{select}"


@register("v2_overall_metrics_documents", _doc_sql(
    DOC_SCORED_CTE, CNT_CTE, TOT_CTE, CUM_CTE, CONF_CTE, ("auc", AUC_SQL), ("ap", AP_SQL), select="""
  SELECT (tn + tp) / (tn + fp + fn + tp) AS accuracy,
    CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE CAST(0 AS DOUBLE) END AS f1_score,
    roc_auc, average_precision AS pr_auc
  FROM (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE CAST(0 AS DOUBLE) END AS pr,
               CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE CAST(0 AS DOUBLE) END AS rc
        FROM conf), auc, ap"""))
def q_v2_docs(spark, sf_dir):
    return ev.overall_metrics(documents_scored(spark, sf_dir), 0.5)


@register("v4_roc_curve_documents", _doc_sql(DOC_SCORED_CTE, CNT_CTE, TOT_CTE, CUM_CTE, select="""
  SELECT CAST(NULL AS DOUBLE) AS threshold, CAST(0 AS DOUBLE) AS fpr, CAST(0 AS DOUBLE) AS tpr
  UNION ALL
  SELECT score, CASE WHEN n > 0 THEN cum_neg / n END, CASE WHEN p > 0 THEN cum_pos / p END
  FROM cum, tot"""))
def q_v4_docs(spark, sf_dir):
    return ev.roc_curve(documents_scored(spark, sf_dir))


@register("t1_threshold_sweep_documents", _doc_sql(
    DOC_SCORED_CTE, *__import__("popsight.catalog.threshold", fromlist=["x"]).SWEEP_CTES[1:],
    select="SELECT * FROM sweep"))
def q_t1_docs(spark, sf_dir):
    from ..operators import threshold as th
    return th.threshold_sweep(documents_scored(spark, sf_dir))
