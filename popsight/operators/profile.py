"""Profiling aggregations.

Shape: column-wise statistics are one ``agg`` over the table melted with
``stack``; value frequencies are one unpivot + one grouped count (map-side
combined); top-k per column uses the sharded exact top-k in
:mod:`popsight.plans.topk`; group-wise tables are one ``groupBy``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import present, ratio
from ..plans.histogram import equal_width_histogram
from ..plans.quantiles import exact_percentile_columns, exact_percentiles
from ..plans.store import stored
from ..plans.topk import top_k_per_group
from ..schema import is_numeric, q
from .frequencies import HAS_VALUE, Frequencies, as_text, column_value_counts, frequencies
from .missing import _lit, _stack, duplicate_report


def infer_column_types(df: DataFrame, ratio_limit: float = 0.05, distinct_limit: int = 50,
                       freq: Frequencies | None = None) -> DataFrame:
    """A1: numeric with distinct/rows < 0.05 and distinct < 50 ->
    categorical_numeric; other numeric -> continuous_numeric; otherwise
    categorical_string. Nulls count in rows, not in distinct. Rows and
    distinct values come from the same grouped count (one pass)."""
    cols = df.columns
    per_col = (freq or frequencies(df, cols, keep=False)).per_column(cols)

    def lookup(values):
        return F.element_at(F.create_map(*[x for c, v in zip(cols, values)
                                           for x in (F.lit(c), F.lit(v))]), F.col("column_name"))

    numeric = lookup([is_numeric(df, c) for c in cols])
    r = F.coalesce(ratio(F.col("n_distinct"), F.col("n_rows")), F.lit(0.0))
    kind = (F.when(~numeric, F.lit("categorical_string"))
            .when((r < F.lit(ratio_limit)) & (F.col("n_distinct") < F.lit(distinct_limit)),
                  F.lit("categorical_numeric"))
            .otherwise(F.lit("continuous_numeric")))
    return per_col.select(lookup(list(range(len(cols)))).cast("int").alias("position"),
                          "column_name",
                          lookup([df.schema[c].dataType.simpleString() for c in cols])
                          .alias("dtype"),
                          "n_distinct", "n_rows", kind.alias("inferred_type"))


def _num_stats(df: DataFrame, cols: list[str], names: dict[str, str]) -> DataFrame:
    aggs = []
    for i, c in enumerate(cols):
        raw = F.col(q(c)).cast("double")
        x = F.when(~F.isnan(raw), raw)          # NaN counts as missing, like null
        aggs += [F.min(x).alias(f"_mn{i}"), F.max(x).alias(f"_mx{i}"),
                 F.avg(x).alias(f"_av{i}"), F.stddev_samp(x).alias(f"_sd{i}"),
                 F.count(x).alias(f"_c{i}")]
    row = df.agg(*aggs).first()    # one pass for the moments
    qs = exact_percentile_columns(df, cols, [0.25, 0.5, 0.75])

    def lit(v) -> str:
        return "CAST(NULL AS DOUBLE)" if v is None else f"CAST({float(v)!r} AS DOUBLE)"
    rows = [[str(i), _lit(c), lit(row[f"_mn{i}"]), lit(row[f"_mx{i}"]), lit(row[f"_av{i}"]),
             lit(row[f"_sd{i}"]), lit(qs[c][0]), lit(qs[c][1]), lit(qs[c][2]),
             str(int(row[f"_c{i}"]))] for i, c in enumerate(cols)]
    long = _stack(df.sparkSession.range(1), rows,
                  ["position", "column_name", "min", "max", "mean", "std", "q25", "median",
                   "q75", "n"])
    r9 = lambda c: F.round(F.col(c), 9)  # noqa: E731  float sums: order-independent digits
    return long.where(F.col("n") > 0).select(
        F.col("position").cast("int").alias("position"),
        F.col("column_name").alias(names.get("column_name", "column_name")),
        F.col("min"), F.col("max"), r9("mean").alias("mean"), r9("median").alias("median"),
        r9("std").alias("std"), r9("q25").alias(names.get("q25", "q25")),
        r9("q75").alias(names.get("q75", "q75")))


def basic_stats(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """A2: numeric columns over non-null values: min, max, mean, median,
    sample std, q25, q75 (linear interpolation); an empty column has no row."""
    cols = cols or [c for c in df.columns if is_numeric(df, c)]
    return _num_stats(df, cols, {})


# The six chart columns of the summary table (persons names).
SUMMARY_COLUMNS = ("age", "wage_per_hour", "capital_gains", "capital_losses", "dividends",
                   "weeks_worked")


def describe_numeric(df: DataFrame, cols: list[str] = SUMMARY_COLUMNS) -> DataFrame:
    """A3: feature, mean, std, min, q1, median, q3, max."""
    out = _num_stats(df, list(cols), {"column_name": "feature", "q25": "q1", "q75": "q3"})
    return out.select("position", "feature", "mean", "std", "min", "q1", "median", "q3", "max")


def value_counts_long(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column_name, value, count) over non-null values."""
    return as_text(df.schema, column_value_counts(df, cols))


def top_values(counts: DataFrame, top_n: int = 10, other_label: str = "other",
               other_if_positive: bool = False) -> DataFrame:
    """Top ``top_n`` values per column (count desc, value asc) plus one
    ``other`` row with the rest when a column has more than ``top_n`` values.
    Rows: column_name, rank (other = top_n + 1), value, count, unique_count."""
    per_col = counts.groupBy("column_name").agg(F.count("*").alias("unique_count"),
                                                 F.sum("count").alias("total"))
    top = top_k_per_group(counts, ["column_name"], [F.desc("count"), F.asc("value")], top_n)
    kept = top.groupBy("column_name").agg(F.sum("count").alias("kept"))
    other = (per_col.join(kept, "column_name")
             .where(F.col("unique_count") > top_n)
             .select("column_name", F.lit(top_n + 1).alias("rank"),
                     F.lit(other_label).alias("value"),
                     (F.col("total") - F.col("kept")).alias("count")))
    if other_if_positive:
        other = other.where(F.col("count") > 0)
    rows = top.select("column_name", "rank", "value", "count").unionByName(other)
    return rows.join(per_col.select("column_name", "unique_count"), "column_name").select(
        "column_name", F.col("rank").cast("int").alias("rank"), "value",
        F.col("count").cast("bigint").alias("count"),
        F.col("unique_count").cast("bigint").alias("unique_count"))


def value_distribution(df: DataFrame, column: str, top_n: int = 10) -> DataFrame:
    """A4: non-null value counts, most frequent first; more than ``top_n``
    values -> the top ``top_n`` plus ``other``; with the unique count."""
    return top_values(value_counts_long(df, [column]), top_n, "other")


def categorical_top(df: DataFrame, cols: list[str], top_n: int = 10) -> DataFrame:
    """A5: A4 for several columns, tail labelled ``Other`` and kept only if > 0."""
    return top_values(value_counts_long(df, cols), top_n, "Other", other_if_positive=True)


def low_cardinality_distributions(df: DataFrame, top_n: int = 10, distinct_limit: int = 50,
                                  freq: Frequencies | None = None) -> DataFrame:
    """A4 for every column that A1 calls categorical or that has fewer
    than 50 distinct values. A first pass sets a bit per hashed value of each
    numeric column (4 KB a column): as many bits as the limit prove that many
    distinct values, and such a column's cells are never unpivoted or
    shuffled. The exact counts decide on all others. A shared frequency table
    has all counts: then there is no first pass."""
    numeric = [c for c in df.columns if is_numeric(df, c)]
    many = set() if freq else _surely_many(df, numeric, distinct_limit)
    cols = [c for c in df.columns if c not in many]
    if not cols:
        return top_values(value_counts_long(df, df.columns).limit(0), top_n, "other")
    all_counts = freq.of(cols) if freq else column_value_counts(df, cols)
    per_col = all_counts.groupBy("column_name").agg(
        F.sum("count").alias("n_rows"), F.count_if(F.expr(HAS_VALUE)).alias("n_distinct"))
    is_num = F.col("column_name").isin(numeric) if numeric else F.lit(False)
    chosen = per_col.where(~is_num | (F.col("n_distinct") < distinct_limit)).select("column_name")
    # one row per column of the table: a bounded side, safe to broadcast
    counts = all_counts.join(F.broadcast(chosen), "column_name", "left_semi")
    return top_values(as_text(df.schema, counts), top_n, "other")


def _surely_many(df: DataFrame, numeric: list[str], limit: int) -> set[str]:
    """Numeric columns with at least ``limit`` distinct values for certain:
    equal values set the same bit, so the set bits are a lower bound."""
    if not numeric:
        return set()
    bits = [F.bitmap_count(F.bitmap_construct_agg(F.bitmap_bit_position(F.when(
        present(df, c).isNotNull(), F.xxhash64(F.col(q(c)).cast("double") + F.lit(0.0))))))
        for c in numeric]
    row = df.agg(*[b.alias(f"b{i}") for i, b in enumerate(bits)]).first()   # one number per column
    return {c for i, c in enumerate(numeric) if row[f"b{i}"] >= limit}


def target_distribution(df: DataFrame, target: str = "label") -> DataFrame:
    """Count and percentage per target value."""
    g = df.groupBy(F.col(q(target)).cast("string").alias("value")).agg(F.count("*").alias("count"))
    total = F.sum("count").over(Window.partitionBy())  # one row per class: bounded
    return g.select("value", "count", (F.col("count") / total * F.lit(100.0)).alias("percentage"))


def imbalance_ratio(df: DataFrame, target: str = "label") -> DataFrame:
    """Largest class count / smallest class count."""
    g = df.groupBy(F.col(q(target))).agg(F.count("*").alias("count"))
    return g.agg((F.max("count") / F.min("count")).alias("imbalance_ratio"))


def weight_summary(df: DataFrame, weight: str = "weight") -> DataFrame:
    """Min, max, mean, median, sample std, zero and negative counts over
    present weights (not null, not NaN)."""
    w = present(df, weight).cast("double")
    med = exact_percentile_columns(df, [weight], [0.5])[weight][0]
    return df.where(w.isNotNull()).agg(
        F.min(w).alias("min"), F.max(w).alias("max"), F.round(F.avg(w), 9).alias("mean"),
        F.round(F.lit(med).cast("double"), 9).alias("median"),
        F.round(F.stddev_samp(w), 9).alias("std"),
        F.count_if(w == 0).alias("zero_weights"), F.count_if(w < 0).alias("negative_weights"))


def dataset_summary(df: DataFrame) -> DataFrame:
    """A10: rows, columns, total missing cells (null or NaN, as M7 counts them),
    duplicate rows (one row)."""
    nulls = sum((F.count_if(present(df, c).isNull()) for c in df.columns), F.lit(0))
    dups = duplicate_report(df).select("duplicate_rows").scalar()
    return df.agg(F.count("*").alias("total_records"), nulls.alias("total_missing_cells")).select(
        "total_records", F.lit(len(df.columns)).alias("total_features"),
        F.col("total_missing_cells").cast("bigint").alias("total_missing_cells"),
        dups.alias("duplicate_rows"))


def scale_pos_weight(df: DataFrame, label: str = "label", positive=1) -> DataFrame:
    """Negatives / positives (unweighted); null without positives."""
    y = F.col(q(label)) == F.lit(positive)
    return df.agg(F.count_if(~y).alias("negatives"), F.count_if(y).alias("positives")).select(
        "negatives", "positives",
        ratio(F.col("negatives"), F.col("positives")).alias("scale_pos_weight"))


# Per-column subset rules of the distribution chart
# (values > 0 for the money columns, wage also below 2000).
HISTOGRAM_RULES = (
    ("age", None, None),
    ("wage_per_hour", 0, 2000),
    ("capital_gains", 0, None),
    ("capital_losses", 0, None),
    ("dividends", 0, None),
    ("weeks_worked", None, None),
)


def numeric_histogram(df: DataFrame, rules=HISTOGRAM_RULES, bins: int = 50) -> DataFrame:
    """For each chart column, the P6 subset, 50 equal-width bins over
    its [min, max] (last bin closed), plus the subset's mean and median."""
    parts = []
    for c, lower, upper in rules:
        x = present(df, c).cast("double")
        cond = x.isNotNull()
        if lower is not None:
            cond = cond & (x > F.lit(lower))
        if upper is not None:
            cond = cond & (x < F.lit(upper))
        parts.append(F.when(cond, F.struct(F.lit(c).alias("feature"), x.alias("value"))))
    long = df.select(F.explode(F.filter(F.array(*parts), lambda s: s.isNotNull())).alias("kv")
                     ).select("kv.feature", "kv.value")
    hist = equal_width_histogram(long, "value", bins, by=["feature"])
    med = exact_percentiles(long, ["feature"], "value", [0.5]).select(
        "feature", F.round("value", 9).alias("median"))              # one row per feature
    stats = long.groupBy("feature").agg(F.round(F.avg("value"), 9).alias("mean")) \
        .join(F.broadcast(med), "feature")
    return hist.join(F.broadcast(stats), "feature").select(
        "feature", "bin", "bin_lower", "bin_upper", "count", "mean", "median")


def income_crosstab(df: DataFrame, by: str | Column, target: str = "label",
                    negative: str = "- 50000.", positive: str = "50000+.",
                    sort_by_positive: bool = False, top: int | None = None,
                    by_name: str = "group") -> DataFrame:
    """Row-normalised % of each target value per group; a missing cell
    is 0; rows with a null group or target are dropped. Optionally highest positive % first, top n."""
    g = F.col(q(by)) if isinstance(by, str) else by
    t = F.col(q(target))
    out = (df.where(g.isNotNull() & t.isNotNull())
           .groupBy(g.alias(by_name))
           .agg(F.count("*").alias("n"), F.count_if(t == F.lit(negative)).alias("_neg"),
                F.count_if(t == F.lit(positive)).alias("_pos"))
           .select(by_name, "n",
                   (F.col("_neg") / F.col("n") * F.lit(100.0)).alias("pct_negative"),
                   (F.col("_pos") / F.col("n") * F.lit(100.0)).alias("pct_positive")))
    if sort_by_positive or top:
        out = out.orderBy(F.desc("pct_positive"), F.asc(by_name))
        if top:
            out = out.limit(top)
    return out


def boxplot_stats(df: DataFrame, value: str, by: str, whis: float = 1.5) -> DataFrame:
    """Per group q1, median, q3 (linear), whiskers = the furthest data
    points within 1.5 IQR of the box, and the count of points outside. The
    boxes are written first: a table of known size, which Spark broadcasts
    only below its threshold."""
    x = present(df, value).cast("double")
    data = df.select(F.col(q(by)).alias("group"), x.alias("x")).where(F.col("x").isNotNull())
    qs = (exact_percentiles(data, ["group"], "x", [0.25, 0.5, 0.75])
          .groupBy("group").pivot("p_index", [0, 1, 2]).agg(F.first("value"))
          .select("group", F.col("0").alias("q1"), F.col("1").alias("median"),
                  F.col("2").alias("q3")))
    qs = qs.withColumn("lo_fence", F.col("q1") - F.lit(whis) * (F.col("q3") - F.col("q1"))) \
           .withColumn("hi_fence", F.col("q3") + F.lit(whis) * (F.col("q3") - F.col("q1")))
    j = data.join(stored(qs, "boxes"), "group")
    inside = (F.col("x") >= F.col("lo_fence")) & (F.col("x") <= F.col("hi_fence"))
    out = j.groupBy("group", "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("x"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("x"))).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"), F.count("*").alias("n"))
    return out.select("group", F.round("q1", 9).alias("q1"), F.round("median", 9).alias("median"),
                      F.round("q3", 9).alias("q3"), "whisker_low", "whisker_high", "outliers", "n")


def segment_sizes(df: DataFrame, segment: str = "segment") -> DataFrame:
    """Count and % per segment, ordered by segment."""
    g = df.groupBy(F.col(q(segment)).alias("segment")).agg(F.count("*").alias("count"))
    total = F.sum("count").over(Window.partitionBy())  # one row per segment: bounded
    return g.select("segment", "count", (F.col("count") / total * F.lit(100.0))
                    .alias("percentage")).orderBy("segment")
