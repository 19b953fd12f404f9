"""Missing values and duplicates (M1-M9).

Shape: per-column questions are answered in ONE aggregation pass over the
table (one ``agg`` holding every column's ``count_if``), then melted to a
long (column, ...) table with ``stack`` -- never a loop of per-column jobs.
Value-frequency questions unpivot to (column, value) and group once, with
map-side combining, so hot values collapse before the shuffle. Fitted fill
values travel as one scalar subquery (a struct or a map with one entry per
column), so filling is a pure projection: no join, no collect.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, IntegralType

from ..functions.columns import present
from ..plans.quantiles import exact_percentile_columns
from ..plans.store import stored
from ..plans.topk import top_k_per_group
from ..schema import PERSONS_ROLES, Roles, is_numeric, is_string, q
from .frequencies import HAS_VALUE, Frequencies, column_value_counts

# Sentinel spellings.
STRING_SENTINELS = ("?", "Unknown", "Not in universe")   # profile, after strip()
NUMERIC_SENTINELS = (-1, 99, 999)                         # profile
NIU = "Not in universe"
QUESTION = "?"
RECODE_NA = 0
WAGE_ERROR = 9999


def _stack(df: DataFrame, rows: list[list[str]], names: list[str]) -> DataFrame:
    """Melt a one-row table: each entry of ``rows`` is a list of SQL
    expressions (one per output column)."""
    if not rows:                    # no eligible column: an empty table, names kept
        return df.selectExpr(*[f"NULL AS {n}" for n in names]).limit(0)
    body = ", ".join(", ".join(r) for r in rows)
    return df.selectExpr(f"stack({len(rows)}, {body}) AS ({', '.join(names)})")


def _lit(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def null_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """position, column, missing_count, missing_percentage for every column."""
    cols = list(columns or df.columns)
    agg = df.agg(F.count("*").alias("_n"),
                 *[F.count_if(present(df, c).isNull()).alias(f"_m{i}") for i, c in enumerate(cols)])
    long = _stack(agg, [[str(i), _lit(c), f"_m{i}", "_n"] for i, c in enumerate(cols)],
                  ["position", "column_name", "missing_count", "n"])
    return long.select(F.col("position").cast("int").alias("position"), "column_name",
                       F.col("missing_count").cast("bigint").alias("missing_count"),
                       (F.col("missing_count") / F.col("n") * F.lit(100.0))
                       .alias("missing_percentage"))


def unpivot_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value) with every value cast to string; nulls dropped."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(q(c)).cast("string").alias("value"))
        for c in columns])).alias("kv")).select("kv.column_name", "kv.value")
    return long.where(F.col("value").isNotNull())


def missing_profile(df: DataFrame, top_n: int = 10,
                    columns: list[str] | None = None, freq: Frequencies | None = None) -> DataFrame:
    """M1: per column missing_count, missing_percentage and the potential
    missing indicators: for numeric columns which of -1, 99, 999 occur; for
    string columns those of the ``top_n`` most frequent values (ties: smaller
    value first) whose stripped text is ``?``, ``Unknown`` or
    ``Not in universe``, in frequency order, joined with ', '.
    Null counts and numeric sentinel flags come from one aggregation; string
    values are counted once and ranked by the sharded top-k. With a shared frequency
    table all of it comes from there."""
    cols = list(columns or df.columns)
    nums = [c for c in cols if is_numeric(df, c)]
    strs = [c for c in cols if is_string(df, c)]
    if freq:
        return _missing_from(freq, cols, nums, strs, top_n)
    aggs = [F.count("*").alias("_n")]
    for i, c in enumerate(cols):
        aggs.append(F.count_if(present(df, c).isNull()).alias(f"_m{i}"))
        if c in nums:
            aggs += [F.bool_or(F.col(q(c)) == F.lit(v)).alias(f"_f{i}_{j}")
                     for j, v in enumerate(NUMERIC_SENTINELS)]
    rows = []
    for i, c in enumerate(cols):
        ind = ("concat_ws(', ', " + ", ".join(
            f"CASE WHEN _f{i}_{j} THEN '{v}' END" for j, v in enumerate(NUMERIC_SENTINELS)) + ")"
            if c in nums else "CAST(NULL AS STRING)")
        rows.append([str(i), _lit(c), f"_m{i}", "_n", ind])
    long = _stack(df.agg(*aggs), rows, ["position", "column_name", "missing_count", "n",
                                         "indicators"])
    base = long.select(F.col("position").cast("int").alias("position"), "column_name",
                       F.col("missing_count").cast("bigint").alias("missing_count"),
                       (F.col("missing_count") / F.col("n") * F.lit(100.0))
                       .alias("missing_percentage"), "indicators")
    ind = None
    if strs:
        counts = unpivot_values(df, strs).groupBy("column_name", "value").agg(
            F.count("*").alias("cnt"))
        ranked = top_k_per_group(counts, ["column_name"], [F.desc("cnt"), F.asc("value")], top_n) \
            .where(F.trim("value").isin(list(STRING_SENTINELS)))
        str_ind = ranked.groupBy("column_name").agg(F.concat_ws(", ", F.transform(
            F.sort_array(F.collect_list(F.struct("rank", "value"))),
            lambda x: x.getField("value"))).alias("indicators"))
        pos = F.create_map(*[x for i, c in enumerate(cols) if c in strs
                             for x in (F.lit(c), F.lit(i))])
        ind = str_ind.select(F.try_element_at(pos, F.col("column_name")).cast("int").alias("position"),
                             "indicators")
    out = base
    if ind is not None:
        # one row per string column: a bounded side
        out = base.join(F.broadcast(ind.select(F.col("position").cast("int").alias("position"),
                                               F.col("indicators").alias("_s"))),
                        "position", "left")
    else:
        out = base.withColumn("_s", F.lit(None).cast("string"))
    return out.select("position", "column_name", "missing_count", "missing_percentage",
                      F.coalesce("indicators", "_s", F.lit("")).alias("potential_missing_indicators"))


def _missing_from(freq: Frequencies, cols: list[str], nums: list[str], strs: list[str], top_n: int) -> DataFrame:
    """M1 from a frequency table."""
    counts, spark = freq.of(cols), freq.table.sparkSession
    has = F.expr(HAS_VALUE)
    number = F.coalesce(F.col("whole").cast("double"), F.col("real"), F.col("text").cast("double") if any(
        isinstance(freq.schema[c].dataType, DecimalType) for c in nums) else F.lit(None).cast("double"))
    found = F.filter(F.array(*[F.when(F.max((number == F.lit(float(v))).cast("int")) == 1, F.lit(str(v))) for v in NUMERIC_SENTINELS]),
                     lambda x: x.isNotNull())
    names = spark.createDataFrame([(i, c, c in nums) for i, c in enumerate(cols)], "position int, _name string, _number boolean")
    per = counts.groupBy("column_name").agg(F.sum("count").alias("n"), F.coalesce(F.sum(F.when(~has, F.col("count"))), F.lit(0)).alias("m"))
    flags = freq.of(nums).groupBy("column_name").agg(F.concat_ws(", ", found).alias("f")) if nums else None
    out = names.join(F.broadcast(per), F.col("_name") == F.col("column_name"), "left").drop("column_name")       # rows per column on all sides
    if nums:
        out = out.join(F.broadcast(flags), F.col("_name") == F.col("column_name"), "left").drop("column_name")
    texts = freq.of(strs).where("text IS NOT NULL").select("column_name", F.col("text").alias("value"), F.col("count").alias("cnt"))
    ranked = top_k_per_group(texts, ["column_name"], [F.desc("cnt"), F.asc("value")], top_n).where(
        F.trim("value").isin(list(STRING_SENTINELS)))
    marks = ranked.groupBy("column_name").agg(F.concat_ws(", ", F.transform(
        F.sort_array(F.collect_list(F.struct("rank", "value"))), lambda x: x["value"])).alias("s"))
    out = out.join(F.broadcast(marks), F.col("_name") == F.col("column_name"), "left")
    return out.select("position", F.col("_name").alias("column_name"), F.coalesce("m", F.lit(0)).cast("bigint").alias("missing_count"),
                      (F.col("m") / F.col("n") * F.lit(100.0)).alias("missing_percentage"),
                      F.coalesce(F.when(F.col("_number"), F.col("f")) if nums else F.lit(None), "s", F.lit("")).alias("potential_missing_indicators"))


def implicit_missing_patterns(df: DataFrame, roles: Roles = PERSONS_ROLES,
                              top: int = 15) -> DataFrame:
    """M2: implicit missingness per column. Strings: rows containing
    ``Not in universe`` + rows equal to ``?`` + nulls; the two recode columns:
    zeros + nulls; other numeric columns are not counted. Columns with a total
    above 0, highest percentage first (column order on ties), first ``top``."""
    rows, aggs = [], [F.count("*").alias("_n")]
    for i, c in enumerate(df.columns):
        x = F.col(q(c))
        if is_string(df, c):
            aggs += [F.count_if(x.contains(NIU)).alias(f"_a{i}"),
                     F.count_if(x == F.lit(QUESTION)).alias(f"_b{i}"),
                     F.count_if(x.isNull()).alias(f"_z{i}")]
            rows.append([str(i), _lit(c), f"_a{i}", f"_b{i}", "CAST(NULL AS BIGINT)", f"_z{i}"])
        elif c in roles.recodes:
            aggs += [F.count_if(x == F.lit(RECODE_NA)).alias(f"_c{i}"),
                     F.count_if(x.isNull()).alias(f"_z{i}")]
            rows.append([str(i), _lit(c), "CAST(NULL AS BIGINT)", "CAST(NULL AS BIGINT)",
                         f"_c{i}", f"_z{i}"])
    agg = df.agg(*aggs)
    long = _stack(agg, [r + ["_n"] for r in rows],
                  ["position", "column_name", "not_in_universe", "question_mark", "zero_code",
                   "explicit_na", "n"])
    total = (F.coalesce("not_in_universe", F.lit(0)) + F.coalesce("question_mark", F.lit(0))
             + F.coalesce("zero_code", F.lit(0)) + F.col("explicit_na"))
    out = long.select(F.col("position").cast("int").alias("position"), "column_name",
                      "not_in_universe", "question_mark", "zero_code", "explicit_na",
                      total.cast("bigint").alias("total"), "n")
    out = out.where(F.col("total") > 0).select(
        "position", "column_name", "not_in_universe", "question_mark", "zero_code", "explicit_na",
        "total", (F.col("total") / F.col("n") * F.lit(100.0)).alias("percentage"))
    return out.orderBy(F.desc("percentage"), F.asc("position")).limit(top)


def missing_indicator_map(df: DataFrame, roles: Roles = PERSONS_ROLES) -> DataFrame:
    """M3: (position, column, indicator) -- for string columns
    ``Not in universe`` / ``?`` when present (exact match); 0 for the recode
    columns and 9999 for the wage column (always)."""
    aggs, rows = [F.lit(1).alias("_one")], []
    for i, c in enumerate(df.columns):
        x = F.col(q(c))
        if is_string(df, c):
            aggs += [F.bool_or(x == F.lit(NIU)).alias(f"_a{i}"),
                     F.bool_or(x == F.lit(QUESTION)).alias(f"_b{i}")]
            rows.append([str(i), "0", _lit(c), _lit(NIU), f"coalesce(_a{i}, false)"])
            rows.append([str(i), "1", _lit(c), _lit(QUESTION), f"coalesce(_b{i}, false)"])
        else:
            if c in roles.recodes:
                rows.append([str(i), "0", _lit(c), _lit(str(RECODE_NA)), "true"])
            if c == roles.wage:
                rows.append([str(i), "1", _lit(c), _lit(str(WAGE_ERROR)), "true"])
    long = _stack(df.agg(*aggs), rows, ["position", "k", "column_name", "indicator", "present"])
    return long.where(F.col("present").cast("boolean")).select(F.col("position").cast("int").alias("position"),
                                        F.col("k").cast("int").alias("k"), "column_name", "indicator")


def sentinels_to_null(df: DataFrame, roles: Roles = PERSONS_ROLES) -> DataFrame:
    """M4: every mapped sentinel becomes null (exact equality). Nulling a
    sentinel that never occurs changes nothing, so this needs no pass over
    the data: it is one projection."""
    out = []
    for c in df.columns:
        x = F.col(q(c))
        if c in roles.ids:
            out.append(x.alias(c))
        elif is_string(df, c):
            out.append(F.when(~x.isin(NIU, QUESTION), x).alias(c))
        elif c in roles.recodes:
            out.append(F.when(x != F.lit(RECODE_NA), x).alias(c))
        elif c == roles.wage:
            out.append(F.when(x != F.lit(WAGE_ERROR), x).alias(c))
        else:
            out.append(x.alias(c))
    return df.select(*out)


def drop_duplicates(df: DataFrame, exclude: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """M5: whole-row dedup (nulls equal), ignoring ``exclude`` columns.
    One shuffle on the row hash with map-side combining, so a value repeated
    a billion times collapses before it moves."""
    subset = [c for c in df.columns if c not in exclude]
    return df.dropDuplicates(subset) if exclude else df.dropDuplicates()


def _row_hashes(df: DataFrame) -> list[Column]:
    """128 bits of a row as two hashes; rows that are equal in a grouping (nulls, NaN, zeros of either
    sign) have equal ones. Where nulls sit is hashed, too, since a hash passes over them."""
    cells = [F.col(q(c)) + F.lit(0.0).cast(f.dataType) if f.dataType.typeName() in ("double", "float") else F.col(q(c))
             for c, f in zip(df.columns, df.schema.fields)]
    gaps = [F.isnull(F.col(q(c))) for c, f in zip(df.columns, df.schema.fields) if f.nullable]
    return [F.xxhash64(F.lit(s), *cells, *gaps).alias(f"_h{s}") for s in (1, 2)]


def duplicate_report(df: DataFrame) -> DataFrame:
    """M5 report / M6: rows, distinct rows, duplicates removed and their %.

    Rows are counted by a 128-bit hash first; what is shuffled are hashes. Whole rows are
    compared only where a hash repeats: these hashes are written, so that Spark knows
    their size and broadcasts them below its threshold; rows of unique hashes are then dropped
    before any exchange. Different rows that share a hash are told apart by that comparison."""
    names = ["_h1", "_h2"]
    hashed = df.select(*_row_hashes(df)).groupBy(*names).agg(F.count("*").alias("n"))
    again = stored(hashed.where("n > 1"), "repeated-hashes")
    cells = [f"_c{i}" for i in range(len(df.columns))]
    rows = df.select(*[F.col(q(c)).alias(x) for c, x in zip(df.columns, cells)], *_row_hashes(df))
    different = rows.join(again, names, "left_semi").groupBy(*cells).agg(F.lit(1)).agg(F.count("*").alias("d"))
    total = df.agg(F.count("*").alias("rows"))
    repeats = again.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("s"))
    distinct = F.col("rows") - repeats.scalar() + different.scalar()
    return total.select("rows", distinct.alias("distinct_rows")).select(
        "rows", "distinct_rows", (F.col("rows") - F.col("distinct_rows")).alias("duplicate_rows"),
        (F.try_divide(F.col("rows") - F.col("distinct_rows"), F.col("rows")) * F.lit(100.0)).alias("duplicate_percentage"))


def count_duplicates(df: DataFrame) -> DataFrame:
    """M6: rows minus distinct rows (one row)."""
    return duplicate_report(df).select("duplicate_rows")


def columns_with_missing(df: DataFrame) -> DataFrame:
    """M7: columns with at least one null, plus the table's total null cells."""
    nc = null_counts(df)
    total = F.sum("missing_count").over(Window.partitionBy())  # one row per column: bounded
    return (nc.select("*", total.cast("bigint").alias("total_missing_cells"))
            .where(F.col("missing_count") > 0))


def medians(df: DataFrame, cols: list[str], approx: bool = False) -> dict[str, float | None]:
    """Each column's median: exact by default (distributed order-statistic
    search, see :mod:`popsight.plans.quantiles`), or the percentile sketch
    with ``approx=True``."""
    if approx:
        row = df.agg(*[F.percentile_approx(F.col(q(c)).cast("double"), 0.5, 10000).alias(c)
                       for c in cols]).first()
        return {c: row[c] for c in cols}
    return {c: v[0] for c, v in exact_percentile_columns(df, cols, [0.5]).items()}


def impute_median(df: DataFrame, cols: list[str], approx: bool = False,
                  fitted: dict[str, float | None] | None = None) -> DataFrame:
    """M8: numeric nulls -> the column's exact (interpolated) median. Columns
    without nulls are unchanged in value (the fill is a ``coalesce``)."""
    if not cols:
        return df
    m = fitted if fitted is not None else medians(df, cols, approx)
    fill = {c: F.coalesce(present(df, c).cast("double"), F.lit(m.get(c)).cast("double")).alias(c)
            for c in cols}
    return df.select(*[fill.get(c, F.col(q(c))) for c in df.columns])


def modes(df: DataFrame, cols: list[str], freq: Frequencies | None = None) -> DataFrame:
    """(column, value, dvalue, count): the most frequent non-null value per
    column, smallest value on ties (numeric order for numeric columns).
    ``value`` is the text of a string or integer mode, ``dvalue`` the double
    of a numeric one. Integers are grouped and compared as integers. From the frequency
    table: no per-column job and no value list held in one buffer."""
    counts = (freq.of(cols) if freq else column_value_counts(df, cols)).where(HAS_VALUE)
    decimals = [c for c in cols if isinstance(df.schema[c].dataType, DecimalType)]
    if decimals:                                              # counted as text, compared as numbers
        number = F.when(F.col("column_name").isin(decimals), F.col("text").cast("double"))
        counts = counts.withColumn("real", F.coalesce("real", number)).withColumn("text", F.when(number.isNull(), F.col("text")))
    best = counts.groupBy("column_name").agg(
        F.min(F.struct((-F.col("count")).alias("neg"), F.col("whole"), F.col("real"), F.col("text"))).alias("b"))
    return best.select("column_name", F.coalesce("b.text", F.col("b.whole").cast("string")).alias("value"),
                       F.coalesce("b.real", F.col("b.whole").cast("double")).alias("dvalue"),
                       (-F.col("b.neg")).alias("count"))


def impute_mode(df: DataFrame, cols: list[str], fitted: DataFrame | None = None,
                unknown: str = "Unknown") -> DataFrame:
    """M9: nulls -> the column's mode (smallest on ties); a string column
    with no value at all -> ``'Unknown'``."""
    if not cols:
        return df
    m = fitted if fitted is not None else modes(df, cols)
    maps = m.agg(F.map_from_entries(F.collect_list(F.struct("column_name", "value"))).alias("s"),
                 F.map_from_entries(F.collect_list(F.struct("column_name", "dvalue"))).alias("d"))
    packed = maps.select(F.struct("s", "d").alias("m")).scalar()
    fill = {}
    for c in cols:
        x = present(df, c)
        if is_numeric(df, c):
            kind = df.schema[c].dataType
            v = F.try_element_at(packed.getField("s" if isinstance(kind, IntegralType) else "d"),
                                 F.lit(c)).cast(kind)
            fill[c] = F.coalesce(x, v).alias(c)
        else:
            v = F.try_element_at(packed.getField("s"), F.lit(c))
            fill[c] = F.coalesce(x.cast("string"), v, F.lit(unknown)).alias(c)
    return df.select(*[fill.get(c, F.col(q(c))) for c in df.columns])
