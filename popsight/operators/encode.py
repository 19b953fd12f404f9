"""Encoding, scaling, stratified split and the preprocessing pipeline (E1-E8,
A11, A13).

Fit steps are eager, like Spark ML estimators: each is one aggregation whose
result is bounded by the number of columns (medians, modes, means, standard
deviations), or a code table in the shared folder. Transform steps are
projections with the bounded values as literals, and lookups of codes. The cleaned table a fit reads several times is written
once to the shared folder, so the dedup shuffle is not redone per
parameter and executor loss cannot force a full recompute.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, LongType, StringType, StructField, StructType

from ..functions.columns import present
from ..plans.store import stored
from ..schema import PERSONS_ROLES, Roles, is_numeric, q
from .missing import drop_duplicates, medians, modes, sentinels_to_null
from .project import feature_group_lists

# ---------------------------------------------------------------- E1 / E2


def label_encode_fit(df: DataFrame, cols: list[str], partitions: int | None = None
                     ) -> DataFrame:
    """(column_name, value, code) with codes 0..n-1 in ascending string
    order of the column's distinct values (cast to string).

    No task holds a whole column: the distinct (column, value) pairs are
    range-partitioned on (column, value), their partition ids pinned by
    writing them, ranked inside each partition, and shifted by the
    number of the column's values in earlier partitions (a bounded table of
    counts per partition and column)."""
    distinct = _distinct_pairs(df, cols)
    spark = df.sparkSession
    n_parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    ranged = stored(distinct.repartitionByRange(n_parts, "column_name", "value")
                    .withColumn("_pid", F.spark_partition_id()), "codes")
    per = ranged.groupBy("_pid", "column_name").agg(F.count("*").alias("_n"))
    before = (Window.partitionBy("column_name").orderBy("_pid")
              .rowsBetween(Window.unboundedPreceding, -1))
    # <= partitions x columns rows: bounded, broadcast
    offs = per.select("_pid", "column_name",
                      F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    local = Window.partitionBy("_pid", "column_name").orderBy("value")
    return (ranged.join(F.broadcast(offs), ["_pid", "column_name"])
            .select("column_name", "value",
                    (F.row_number().over(local) - 1 + F.col("_off")).cast("int").alias("code")))


@dataclass
class LabelCodes:
    """Fitted label codes: (column_name, value, code) of ``cols``."""
    cols: list[str]
    table: DataFrame | None = None
    n: int | None = None

    def size(self) -> int:
        """Number of codes of all columns, counted once."""
        if self.n is None:
            self.n = self.table.count() if self.table is not None else 0
        return self.n


#: Codes that are broadcast column by column at most (about 20 MB).
MAX_BROADCAST_CODES = 200_000
#: Copies of a code in the shared lookup, over which the rows of a hot value are spread.
LOOKUP_SALTS = 8


def _distinct_pairs(df: DataFrame, cols: list[str]) -> DataFrame:
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(q(c)).cast("string").alias("value"))
        for c in cols])).alias("kv")).select("kv.*").where(F.col("value").isNotNull())
    return long.groupBy("column_name", "value").agg(F.lit(1).alias("_one")).drop("_one")


def fit_label_codes(df: DataFrame, cols: list[str]) -> LabelCodes:
    """E1 as fitted state: the code table, written once to the shared folder
    so that every transform reads it with its size known."""
    return LabelCodes(cols, stored(label_encode_fit(df, cols), "label-codes") if cols else None)


def label_encode_transform(df: DataFrame, codes: LabelCodes, unseen: int = -1) -> DataFrame:
    """Replace each categorical value by its code; unseen and missing
    values -> -1. Up to ``MAX_BROADCAST_CODES`` codes (counted) each column meets its
    broadcast codes in place: no exchange at all. Beyond that one shared lookup serves all columns."""
    if not codes.cols:
        return df
    if codes.size() > MAX_BROADCAST_CODES:
        return _shared_lookup(df, codes, unseen)
    out, new = df, {}
    for i, c in enumerate(codes.cols):
        t = codes.table.where(F.col("column_name") == c).select(
            F.col("value").alias(f"_value_{i}"), F.col("code").alias(f"_code_{i}"))
        out = out.join(F.broadcast(t), F.col(q(c)).cast("string") == F.col(f"_value_{i}"), "left")
        new[c] = F.coalesce(f"_code_{i}", F.lit(unseen)).cast("int").alias(c)
    return out.select(*[new.get(c, F.col(q(c))) for c in df.columns])


def _shared_lookup(df: DataFrame, codes: LabelCodes, unseen: int) -> DataFrame:
    """Codes of all columns by one join of (column, value) cells, put together by row.

    The rows are written with a number each, so that the cells and the rows agree on it whatever
    is recomputed. A cell is a number, a column's position and a value; those of a value that many rows
    hold are spread over ``LOOKUP_SALTS`` copies of its code. The rows themselves are exchanged once, by
    number, however many columns there are."""
    cols = {c: i for i, c in enumerate(codes.cols)}
    rows = stored(df.select(F.struct(*[F.col(q(c)).alias(f"c{i}") for i, c in enumerate(df.columns)]).alias("row"),
                            F.monotonically_increasing_id().alias("id")), "to-encode")
    at = {c: i for i, c in enumerate(df.columns)}
    cells = rows.select("id", F.explode(F.array(*[F.struct(
        F.lit(i).alias("p"), F.col(f"row.c{at[c]}").cast("string").alias("v")) for c, i in cols.items()])).alias("c")).select(
        "id", "c.*", F.pmod(F.xxhash64("id"), F.lit(LOOKUP_SALTS)).alias("salt")).where("v is not null")
    position = F.array_position(F.array(*[F.lit(c) for c in cols]), F.col("column_name")).cast("int") - 1
    table = codes.table.select(position.alias("p"), F.col("value").alias("v"), "code",
                               F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(LOOKUP_SALTS - 1).cast("bigint"))).alias("salt"))
    found = cells.join(table, ["p", "v", "salt"]).groupBy("id").agg(
        F.map_from_entries(F.collect_list(F.struct("p", "code"))).alias("codes"))       # one entry a column
    joined = rows.join(found, "id", "left")
    return joined.select(*[
        F.coalesce(F.try_element_at("codes", F.lit(cols[c])), F.lit(unseen)).cast("int").alias(c) if c in cols
        else F.col(f"row.c{i}").alias(c) for i, c in enumerate(df.columns)])


# ---------------------------------------------------------------- E3


MAX_CLASSES = 10_000


def target_classes(df: DataFrame, label: str = "label") -> list[str]:
    """Distinct target values in ascending order. More than ``MAX_CLASSES``
    of them are no class label: an error, not a list on the driver."""
    v = df.select(F.col(q(label)).cast("string").alias("v")).where(F.col("v").isNotNull())
    found = [r[0] for r in v.distinct().limit(MAX_CLASSES + 1).collect()]
    if len(found) > MAX_CLASSES:
        raise ValueError(f"{label} has more than {MAX_CLASSES} distinct values: not a class label")
    return sorted(found)


def encode_target(df: DataFrame, classes: list[str], label: str = "label") -> DataFrame:
    """Class -> its index in ascending order; a class not seen at fit
    time is an error (raised inside the task, like the reference)."""
    arr = F.array(*[F.lit(c) for c in classes])
    pos = F.array_position(arr, F.col(q(label)).cast("string"))
    code = F.when(pos > 0, (pos - 1).cast("int")).otherwise(
        F.raise_error(F.concat(F.lit("unseen label: "), F.col(q(label)).cast("string"))))
    return df.withColumn(label, code.cast("int"))


# ---------------------------------------------------------------- E4


# A float sum's last bits depend on the order partitions are merged in; fitted
# means and standard deviations are rounded to this many decimals, and to as
# many more as a deviation below 1 needs to keep its digits, so that every
# run sees the same parameters.
PARAM_DIGITS = 10

# A standard deviation below this share of the mean is what float sums leave
# of a constant column.
CONSTANT_SHARE = 1e-14


def standard_scale_fit(df: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    """E4 fit: (mean, population std) per column over present values, from
    one aggregation; std 0 (or none) -> 1."""
    if not cols:
        return {}
    row = df.agg(*[e for i, c in enumerate(cols) for x in [present(df, c).cast("double")]
                   for e in (F.avg(x).alias(f"m{i}"), F.stddev_pop(x).alias(f"s{i}"))]).first()
    out = {}
    for i, c in enumerate(cols):
        mean, std = row[f"m{i}"] or 0.0, row[f"s{i}"] or 0.0
        if not std > abs(mean) * CONSTANT_SHARE:
            std = 0.0
        digits = PARAM_DIGITS + (max(0, -math.floor(math.log10(std))) if std else 0)
        out[c] = (round(mean, digits), round(std, digits) or 1.0)
    return out


def standard_scale_transform(df: DataFrame, params: dict[str, tuple[float, float]]) -> DataFrame:
    """E4 transform: (x - mean) / std; NaN, like null, gives null."""
    return df.select(*[
        ((present(df, c).cast("double") - F.lit(params[c][0])) / F.lit(params[c][1])).alias(c)
        if c in params else F.col(q(c)) for c in df.columns])


def standard_scale(df: DataFrame, cols: list[str]) -> DataFrame:
    """Fit and transform of the same table."""
    return standard_scale_transform(df, standard_scale_fit(df, cols))


# ---------------------------------------------------------------- E5 / E6


@dataclass
class Preprocessor:
    """Fitted preprocessing state: bounded and driver-side but for the code table."""
    roles: Roles
    numeric: list[str]
    categorical: list[str]
    medians: dict[str, float | None] = field(default_factory=dict)
    modes: dict[str, tuple[str | None, float | None]] = field(default_factory=dict)
    classes: list[str] = field(default_factory=list)
    codes: LabelCodes | None = None
    scaler: dict[str, tuple[float, float]] = field(default_factory=dict)


def _fit_fill(df: DataFrame, numeric: list[str], categorical: list[str]):
    meds: dict[str, float | None] = {}
    if numeric:
        meds = medians(df, numeric)
    mo: dict[str, tuple[str | None, float | None]] = {}
    if categorical:
        for r in modes(df, categorical).collect():   # one row per column
            mo[r["column_name"]] = (r["value"], r["dvalue"])
    return meds, mo


def _fill(df: DataFrame, meds, mo, numeric, categorical, unknown: str = "Unknown") -> DataFrame:
    out = []
    for c in df.columns:
        x = present(df, c) if c in numeric or c in categorical else F.col(q(c))
        if c in numeric:
            m = meds.get(c)
            x = F.coalesce(x.cast("double"), F.lit(m).cast("double")) if m is not None \
                else x.cast("double")
        elif c in categorical:
            sval, dval = mo.get(c, (None, None))
            if is_numeric(df, c):
                # integers travel as text: a double would round those above 2^53
                whole = isinstance(df.schema[c].dataType, IntegralType) and sval is not None
                mode = F.lit(sval if whole else dval).cast(df.schema[c].dataType)
                x = F.coalesce(x, mode) if whole or dval is not None else x
            else:
                x = F.coalesce(x, F.lit(sval if sval is not None else unknown))
        out.append(x.alias(c))
    return df.select(*out)


def preprocess_fit(df: DataFrame, roles: Roles = PERSONS_ROLES, dedup: bool = True,
                   materialize: bool = True) -> tuple[Preprocessor, DataFrame]:
    """E5: dedup -> sentinels to null -> feature groups -> impute (median /
    mode) -> encode target -> label-encode categoricals -> scale numeric.
    Returns the fitted state and the transformed table."""
    base = drop_duplicates(df) if dedup else df
    base = sentinels_to_null(base, roles)
    if materialize:
        base = stored(base, "cleaned")
    numeric, categorical = feature_group_lists(base, roles)
    meds, mo = _fit_fill(base, numeric, categorical)
    imputed = _fill(base, meds, mo, numeric, categorical)
    classes = target_classes(imputed, roles.label)
    codes = fit_label_codes(imputed, categorical)
    scaler = standard_scale_fit(imputed, numeric)
    fitted = Preprocessor(roles, numeric, categorical, meds, mo, classes, codes, scaler)
    return fitted, _encode_scale(imputed, fitted)


def _encode_scale(imputed: DataFrame, p: Preprocessor) -> DataFrame:
    out = encode_target(imputed, p.classes, p.roles.label)
    out = label_encode_transform(out, p.codes)
    return standard_scale_transform(out, p.scaler)


def preprocess_transform(df: DataFrame, p: Preprocessor, refit: bool = False) -> DataFrame:
    """No dedup; sentinels to null; impute with the fitted values (or,
    with ``refit=True``, with medians/modes of ``df`` itself as the reference
    does); fitted target classes, codes (unseen -> -1) and scaler."""
    base = sentinels_to_null(df, p.roles)
    meds, mo = _fit_fill(base, p.numeric, p.categorical) if refit else (p.medians, p.modes)
    return _encode_scale(_fill(base, meds, mo, p.numeric, p.categorical), p)


# ---------------------------------------------------------------- E7 / E8


def split_hash(key: str | Column, seed: int = 42) -> Column:
    """md5 of '<seed>:<key>' (hex): the split's random order, equal on any
    engine with md5."""
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), k.cast("string")))


HASH_STEP = 4      # hex digits of the split hash that one narrowing step adds
HASH_DIGITS = 32   # md5


def stratified_split(df: DataFrame, label: str = "label", key: str = "person_id",
                     test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """Exact stratified split -- in each class the round(test_size * n)
    rows with the smallest (hash, key) are ``test``, the rest ``train``.

    The rows are neither sorted nor shuffled. The hash at which a class is
    cut is found a few digits at a time: each step counts the rows that share
    the class's prefix so far by their next digits (map-side combined, at
    most 16^4 buckets a class) and follows the bucket that holds the
    cut, until all of that bucket is test. A step divides what is undecided
    by 65,536, so 1e11 rows take three steps, each reading label and key
    alone. The split itself is then one comparison per row. Only rows of one
    repeated key, which no digit can part, are ranked. A null label is a class."""
    spark = df.sparkSession
    h = split_hash(key, seed)
    rows = df.select(F.col(q(label)).alias("_class"), h.alias("_h"))
    schema = StructType([StructField("_cut_class", df.schema[label].dataType),
                         StructField("_prefix", StringType()), StructField("_need", LongType()),
                         StructField("_n", LongType())])
    per_class = Window.partitionBy("_class")
    running = per_class.orderBy("_p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cuts = None
    for digits in range(HASH_STEP, HASH_DIGITS + 1, HASH_STEP):
        if cuts is None:
            open_ = rows.withColumn("_need", F.lit(None).cast("bigint"))
        else:   # one row per class
            open_ = rows.join(F.broadcast(cuts), F.col("_class").eqNullSafe(F.col("_cut_class"))
                              & F.col("_h").startswith(F.col("_prefix")))
        counts = open_.groupBy("_class", F.substring("_h", 1, digits).alias("_p")).agg(
            F.count("*").alias("_n"), F.max("_need").alias("_need"))
        ends = counts.select("_class", "_p", "_n", F.sum("_n").over(running).alias("_end"), F.coalesce(
            "_need", F.round(F.lit(float(test_size)) * F.sum("_n").over(per_class)).cast("bigint")
        ).alias("_want"))
        found = [(r["_class"], r["_p"], r["_need"], r["_n"]) for r in ends.where(
            (F.col("_want") > F.col("_end") - F.col("_n")) & (F.col("_want") <= F.col("_end"))).select(
            "_class", "_p", (F.col("_want") - F.col("_end") + F.col("_n")).alias("_need"), "_n").collect()]
        cuts = spark.createDataFrame(found, schema)
        if all(need == n for _, _, need, n in found):
            break

    width = F.length("_prefix")
    joined = df.withColumn("_h", h).join(F.broadcast(cuts), F.col(q(label)).eqNullSafe(F.col("_cut_class")),
                                         "left")
    head = F.substring(F.col("_h"), F.lit(1), width)
    cols = [F.col(q(c)) for c in df.columns]
    side = F.when(head <= F.col("_prefix"), F.lit("test")).otherwise(F.lit("train")).alias("split")
    if all(need == n for _, _, need, n in found):
        return joined.select(*cols, side)
    tied = F.coalesce((F.col("_h") == F.col("_prefix")) & (F.col("_need") < F.col("_n")), F.lit(False))
    rank = F.row_number().over(Window.partitionBy(label, "_h").orderBy(q(key)))
    repeated = joined.where(tied).withColumn("_r", rank).select(
        *cols, F.when(F.col("_r") <= F.col("_need"), F.lit("test")).otherwise(F.lit("train")).alias("split"))
    return joined.where(~tied).select(*cols, side).unionByName(repeated)


def train_test(split: DataFrame) -> tuple[DataFrame, DataFrame]:
    return (split.where(F.col("split") == "train").drop("split"),
            split.where(F.col("split") == "test").drop("split"))


def concat_splits(train: DataFrame, test: DataFrame) -> DataFrame:
    """Append test to train (by column name)."""
    return train.unionByName(test)


def class_balance(split: DataFrame, label: str = "label") -> DataFrame:
    """Count and share (%) of each class within each split."""
    g = split.groupBy("split", label).agg(F.count("*").alias("count"))
    total = F.sum("count").over(Window.partitionBy("split"))   # <= splits * classes rows
    return g.select("split", F.col(label).alias("label"), "count",
                    (F.col("count") / total * F.lit(100.0)).alias("percentage"))


def preprocessing_metadata(raw: DataFrame, processed: DataFrame, split: DataFrame,
                           p: Preprocessor, label: str = "label") -> DataFrame:
    """One row -- rows before/after/removed, train/test rows, feature
    lists, target classes and class counts per split."""
    y = F.col(label) == F.lit(1)
    s = split.agg(F.count_if(F.col("split") == "train").alias("train_samples"),
                  F.count_if(F.col("split") == "test").alias("test_samples"),
                  F.count_if((F.col("split") == "train") & ~y).alias("train_class_0"),
                  F.count_if((F.col("split") == "train") & y).alias("train_class_1"),
                  F.count_if((F.col("split") == "test") & ~y).alias("test_class_0"),
                  F.count_if((F.col("split") == "test") & y).alias("test_class_1"))
    total = raw.agg(F.count("*")).scalar()
    processed_n = processed.agg(F.count("*")).scalar()
    return s.select(
        total.alias("total_records"), processed_n.alias("processed_records"),
        (total - processed_n).alias("records_removed"), "train_samples", "test_samples",
        F.lit(", ".join(p.numeric)).alias("numeric_features"),
        F.lit(", ".join(p.categorical)).alias("categorical_features"),
        F.lit(", ".join(p.classes)).alias("target_classes"),
        "train_class_0", "train_class_1", "test_class_0", "test_class_1")
