"""Quality rules with risk-controlled thresholds.

Every rule compares one statistic of a text with a cutoff from a fixed grid,
from lenient to strict. Labelled documents (quality 1 or 0) are the holdout:
for each stratum and rule the grid is walked from its lenient end, and a cutoff
is certified while the exact binomial test rejects "this cutoff refuses more
than ``risk / n_rules`` of the stratum's good documents" at the level
``delta / (n_strata * n_rules)``. The walk stops at the first cutoff that
isn't certified (fixed-sequence testing), the level is Bonferroni's over
strata and rules: with probability 1 - delta no stratum loses more than
``risk`` of its good documents to all rules together. Among the certified
cutoffs the most lenient one that refuses as many labelled bad documents as
the strictest is taken. Strata without enough labels get no cutoff.

Statistics come from an Arrow UDF over whole texts; counting, testing per
stratum and applying run in Spark, nothing but the number of strata reaches
the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, q, ship, stored, table

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_punct")
STATS_TYPE = ", ".join(f"{c} bigint" for c in STATS)
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Rule -> (statistic, grid from lenient to strict); a text whose statistic is above the cutoff is refused.
RULES: dict[str, tuple[str, tuple[float, ...]]] = {
    "symbols": ("n_symbols / greatest(n_words, 1)", (2.0, 1.5, 1.0, 0.75, 0.5, 0.35, 0.25, 0.15)),
    "dup_lines": ("n_dup_lines / greatest(n_lines, 1)", (0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2)),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", (0.45, 0.4, 0.35, 0.3, 0.25, 0.2)),
    "capitals": ("n_upper / greatest(word_chars, 1)", (0.8, 0.7, 0.6, 0.5, 0.4, 0.3)),
    "punctuation": ("n_punct / greatest(n_words, 1)", (3.0, 2.0, 1.5, 1.0, 0.75, 0.5)),
    "word_length": ("word_chars / greatest(n_words, 1)", (40.0, 30.0, 20.0, 15.0, 12.0)),
}


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words inside windows of ``width`` words that occur twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    key = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    if len(ids) == len(words):
        return 0
    first, base = key, len(ids)
    for k in range(1, width):                      # windows of 2, 3, ... words as dense numbers
        pair = first[:n] * base + key[k:k + n]
        if k < width - 1 and base ** (k + 2) >= 1 << 62:
            pair = np.unique(pair, return_inverse=True)[1]
        first = pair
    _, inverse, counts = np.unique(first, return_inverse=True, return_counts=True)
    twice = counts[inverse] > 1
    if not twice.any():
        return 0
    covered = np.zeros(len(words), bool)
    for k in range(width):
        covered[k:k + n] |= twice
    return int(covered.sum())


def text_stats(text: str) -> tuple[int, ...]:
    """The values of STATS for one text; words are split at ASCII white space."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    chars = len(text) - sum(text.count(c) for c in BLANKS)
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return (n, chars, sum(text.count(c) for c in SYMBOLS), len(lines) - len(set(lines)), repeated_words(words),
            len(lines), len(raw) - len(raw.translate(None, UPPER)), len(raw) - len(raw.translate(None, b"!?;:")))


@lean
def _stats(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        yield pd.DataFrame([text_stats(t or "") for t in texts], columns=list(STATS), dtype="int64")


def stats_of(text: Column) -> Column:
    """Struct of STATS for a text column (null: no words)."""
    return F.pandas_udf(_stats, STATS_TYPE)(F.coalesce(text.cast("string"), F.lit("")))


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


def binomial_below(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p), exact: terms from k downwards."""
    if k >= n:
        return 1.0
    log_term = (math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
                + k * math.log(p) + (n - k) * math.log1p(-p))
    if k > n * p:                                  # no use: above 1/2 or so
        return 1.0
    term, total = math.exp(log_term), 0.0
    for i in range(k, -1, -1):
        total += term
        if term < total * 1e-17:
            break
        term *= i / (n - i + 1) * (1 - p) / p
    return min(1.0, total)


def certify(good: int, refused_good: list[int], refused_bad: list[int], risk: float, level: float) -> int:
    """Index of the chosen cutoff on the grid, or -1."""
    last = -1
    for i, k in enumerate(refused_good):
        if good == 0 or binomial_below(k, good, risk) > level:
            break
        last = i
    if last < 0:
        return -1
    return next(i for i in range(last + 1) if refused_bad[i] == refused_bad[last])



def fit_cutoffs(labelled: DataFrame, stratum: str, quality: str, risk: float = 0.05,
                delta: float = 0.05, rules: dict = RULES) -> DataFrame:
    """Cutoffs (_stratum, rule, cutoff) of ``labelled``, which has the columns of
    STATS, a stratum (null is a stratum of its own) and a 0/1 quality (rows
    with a null quality are left out). One row per stratum and certified rule."""
    lab = labelled.filter(F.col(q(quality)).isNotNull()).select(
        F.col(q(stratum)).cast("string").alias("_stratum"), (F.col(q(quality)) > 0).alias("_good"), *STATS)
    grid = [(r, i, c) for r, (_, cuts) in rules.items() for i, c in enumerate(cuts)]
    counts = lab.groupBy("_stratum", "_good").agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum((F.expr(rules[r][0]) > F.lit(c)).cast("long")).alias(f"{r}_{i}") for r, i, c in grid])
    strata = lab.select("_stratum").distinct().count()
    level = delta / max(1, strata * len(rules))

    def select(pdf: pd.DataFrame) -> pd.DataFrame:
        good, bad = pdf[pdf["_good"]], pdf[~pdf["_good"]]
        out = []
        for r, (_, cuts) in rules.items():
            names = [f"{r}_{i}" for i in range(len(cuts))]
            i = certify(int(good["_n"].sum()), [int(good[c].sum()) for c in names],
                        [int(bad[c].sum()) for c in names], risk / len(rules), level)
            if i >= 0:
                out.append((pdf["_stratum"].iloc[0], r, float(cuts[i])))
        return pd.DataFrame(out, columns=["_stratum", "rule", "cutoff"])

    return counts.groupBy("_stratum").applyInPandas(select, "_stratum string, rule string, cutoff double")


BROADCAST_STRATA = 50_000    # strata up to which the cutoffs are broadcast


def with_cutoffs(df: DataFrame, stratum: str, cutoffs: DataFrame) -> DataFrame:
    """``df`` with ``_cut``, a map from rule to the cutoff of the row's stratum.
    The cutoffs are broadcast when there are few strata (counted); else Spark
    joins as it sees fit."""
    wide = stored(cutoffs.groupBy("_stratum").agg(F.map_from_entries(
        F.collect_list(F.struct("rule", "cutoff"))).alias("_cut")), "cutoffs")   # one entry per rule
    if wide.count() <= BROADCAST_STRATA:
        wide = F.broadcast(wide)
    return df.join(wide, F.col(q(stratum)).cast("string").eqNullSafe(F.col("_stratum")), "left").drop("_stratum")


def passes(stats: str | None = None, rules: dict = RULES) -> Column:
    """True where base rules and all certified cutoffs (``_cut``) are met."""
    def col(expr: str) -> Column:
        if stats:
            for c in STATS:
                expr = expr.replace(c, f"{stats}.{c}")
        return F.expr(expr)
    ok = ~base_failed(col("n_words"), col("n_repeat_words"))
    for r, (stat, _) in rules.items():
        ok &= F.coalesce(col(stat) <= F.col("_cut")[r], F.lit(True))
    return ok


def labelled_stats(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics (with doc_id) of the documents that labels cover; a document
    with several labels counts once, as good if any label says so."""
    one = (labels.filter(F.col("quality").isNotNull()).groupBy("doc_id")
           .agg(F.max("quality").alias("_quality")))
    return stats.join(one, "doc_id")


def op2_risk_controlled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document. Null and empty texts have no
    words and fail the base rules; repeated rows are judged one by one; without
    labels only the base rules hold."""
    docs = table(spark, sf_dir, "documents")
    stats = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                               F.col("lang").cast("string").alias("_lang"), stats_of(F.col("text")).alias("_s"))
                   .select("doc_id", "_lang", "_s.*"), "quality")
    cut = fit_cutoffs(labelled_stats(stats, table(spark, sf_dir, "labels")), "_lang", "_quality")
    return with_cutoffs(stats, "_lang", cut).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed(F.col("n_words"), F.col("n_repeat_words")).alias("base_failed"), passes().alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id",
              stratum: str = "lang") -> DataFrame:
    """Rows of ``docs`` (all their columns) that pass. The cutoffs are fitted on
    this table's own labelled documents; texts aren't shuffled, so their
    statistics are computed once for the fit and once for the filter."""
    stats = stored(docs.select(F.col(q(doc_id)).alias("doc_id"), F.col(q(stratum)).cast("string").alias("_lang"),
                               stats_of(F.col(q(text))).alias("_s")).select("doc_id", "_lang", "_s.*"), "quality")
    cut = fit_cutoffs(labelled_stats(stats, labels), "_lang", "_quality")
    row = docs.select(F.struct(*[F.col(q(c)) for c in docs.columns]).alias("_row"),
                      F.col(q(stratum)).cast("string").alias("_lang"), stats_of(F.col(q(text))).alias("_s"))
    return with_cutoffs(row, "_lang", cut).filter(passes("_s")).select("_row.*")


ship(__name__)
