"""One typed frequency table of a whole table, shared by whatever asks for values:
column types (A1), low-cardinality distributions (A6), missing profile (M1), modes (M9),
feature groups and roles (P4, P5).

One unpivot and one map-side-combined grouped count give every column's values with
their counts; stored by column, a lookup of some columns reads only these. A column of
mostly different values has as many rows here as in its table: profile keys and
the like with ``cols``, or with the operators' own paths.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, FloatType, FractionalType, IntegralType, StructType

from ..functions.columns import present
from ..plans.store import store_path

HAS_VALUE = "text IS NOT NULL OR whole IS NOT NULL OR real IS NOT NULL"


def column_value_counts(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(column_name, text, whole, real, count), one row per distinct value,
    missing values (null, NaN) counted as one: one unpivot and one
    map-side-combined grouped count for every column at once. Integers and
    floats are grouped and shuffled in their own type (-0.0 is 0.0), anything
    else as text."""
    cols = list(cols or df.columns)

    def cell(c: str) -> Column:
        kind = df.schema[c].dataType
        used = ("whole" if isinstance(kind, IntegralType)
                else "real" if isinstance(kind, FractionalType) and not isinstance(kind, DecimalType)
                else "text")
        return F.struct(F.lit(c).alias("column_name"), *[
            (present(df, c) if slot == used else F.lit(None)).cast(to).alias(slot)
            for slot, to in (("text", "string"), ("whole", "bigint"), ("real", "double"))])

    long = df.select(F.explode(F.array(*[cell(c) for c in cols])).alias("kv")).select("kv.*")
    return long.groupBy("column_name", "text", "whole", "real").agg(F.count("*").alias("count"))


def as_text(schema: StructType, counts: DataFrame) -> DataFrame:
    """(column_name, value, count) of typed counts, missing values left out;
    every value's text is what its own column's type prints."""
    floats = [f.name for f in schema.fields if isinstance(f.dataType, FloatType)]
    real = F.col("real").cast("string")
    if floats:
        real = F.when(F.col("column_name").isin(floats),
                      F.col("real").cast("float").cast("string")).otherwise(real)
    return counts.where(HAS_VALUE).select(
        "column_name", F.coalesce("text", F.col("whole").cast("string"), real).alias("value"), "count")


@dataclass
class Frequencies:
    """Typed value counts of the columns ``cols`` of a table with ``schema``."""
    table: DataFrame
    schema: StructType
    cols: list[str]

    def of(self, cols: list[str]) -> DataFrame:
        """The counts of some columns; of a stored table only their folders are read."""
        lacking = [c for c in cols if c not in self.cols]
        if lacking:
            raise ValueError(f"no frequencies of {', '.join(lacking)}")
        return self.table.where(F.col("column_name").isin(list(cols)))

    def per_column(self, cols: list[str] | None = None) -> DataFrame:
        """(column_name, n_rows, non_null, n_distinct), one row per column of a table with rows."""
        has = F.expr(HAS_VALUE)
        return self.of(cols or self.cols).groupBy("column_name").agg(
            F.sum("count").alias("n_rows"), F.coalesce(F.sum(F.when(has, F.col("count"))), F.lit(0)).cast("bigint").alias("non_null"),
            F.count_if(has).cast("bigint").alias("n_distinct"))


def frequencies(df: DataFrame, cols: list[str] | None = None, keep: bool = True) -> Frequencies:
    """The frequency table of ``df``; with ``keep`` written by column into the
    session's shared folder, so that all who read it share one unpivot."""
    cols = list(cols or df.columns)
    table = column_value_counts(df, cols)
    if keep:
        spark = df.sparkSession
        path = store_path(spark, "frequencies")
        table.write.partitionBy("column_name").parquet(path)
        table = spark.read.schema(table.schema).parquet(path)
    return Frequencies(table, df.schema, cols)
