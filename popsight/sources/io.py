"""Sources and sinks.

Reads and writes are Spark's own (text, CSV, JSON, Parquet, ML writers), so
they are split across tasks and land in a shared file system. Scratch output
of the registered queries goes under the session's checkpoint folder (the
shared folder the cluster names in ``spark.checkpoint.dir``), never a
machine-local temporary directory.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from ..functions.columns import DEFAULT_NA_TOKENS, null_tokens, present
from ..schema import is_string, q
from ..session import ensure_checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint location."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{root}/popsight-io/{name}-{uuid.uuid4().hex}"


# ------------------------------------------------------------- S1 / S2 / S4


def read_column_names(spark: SparkSession, path: str) -> list[str]:
    """One stripped name per line, in file order (a tiny file: the
    names are schema, read whole)."""
    lines = spark.read.text(path).select(F.trim("value").alias("v")).where(F.col("v") != "")
    return [r["v"] for r in lines.collect()]


def schema_of(names: list[str], types: dict[str, str] | None) -> StructType | None:
    if not types:
        return None
    return StructType([StructField(n, _parse_datatype_string(types[n]), True) for n in names])


def read_headerless_csv(spark: SparkSession, path: str, names: list[str],
                        types: dict[str, str] | None = None, na_tokens=DEFAULT_NA_TOKENS) -> DataFrame:
    """Headerless comma file with blanks after the commas skipped; names
    given; types declared (or inferred with one extra pass when omitted).
    A text among ``na_tokens`` is null, in a column of declared numbers as any
    text that is no number; a NaN is null. Values may be quoted."""
    reader = (spark.read.option("header", "false").option("ignoreLeadingWhiteSpace", "true")
              .option("escape", '"'))
    schema = schema_of(names, types)
    if schema is not None:
        df = reader.schema(schema).csv(path)
    else:
        df = reader.option("inferSchema", "true").csv(path).toDF(*names)
    return df.select(*[(null_tokens(F.col(q(c)), na_tokens) if is_string(df, c) else present(df, c)).alias(c)
                       for c in df.columns])


def read_table(spark: SparkSession, path: str, fmt: str = "csv",
               schema: StructType | str | None = None) -> DataFrame:
    """A stage output -- CSV with a header (declared schema preferred) or Parquet."""
    if fmt == "parquet":
        return spark.read.parquet(path)
    r = spark.read.option("header", "true")
    return r.schema(schema).csv(path) if schema is not None else \
        r.option("inferSchema", "true").csv(path)


# ------------------------------------------------------------- S5 / S6 / S7


def write_headerless(df: DataFrame, path: str, sep: str = ", ", na: str = "") -> None:
    """Write rows in the survey's raw layout: no header, ``sep`` between
    values, ``na`` for a missing one; a value that holds a comma or a quote is quoted."""
    def cell(c: str) -> Column:
        v = F.col(q(c)).cast("string")
        quoted = F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))
        return F.coalesce(F.when(v.rlike('[,"]'), quoted).otherwise(v), F.lit(na))

    line = F.concat_ws(sep, *[cell(c) for c in df.columns])
    df.select(line.alias("value")).write.mode("overwrite").text(path)


def write_names(df: DataFrame, path: str) -> None:
    """The sidecar names file: one column name per line (one small task)."""
    spark = df.sparkSession
    spark.createDataFrame([(c,) for c in df.columns], "value string").coalesce(1) \
        .write.mode("overwrite").text(path)


def write_table(df: DataFrame, path: str, fmt: str = "csv", order: list[str] | None = None
                ) -> None:
    """Header CSV (or Parquet) with the given column order."""
    out = df.select(*[F.col(q(c)) for c in (order or df.columns)])
    w = out.write.mode("overwrite")
    if fmt == "parquet":
        w.parquet(path)
    else:
        w.option("header", "true").csv(path)


def write_matrix_csv(wide: DataFrame, path: str) -> None:
    """A correlation matrix in wide form (row name first), one file."""
    wide.coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def report_json(df: DataFrame, name: str = "report") -> DataFrame:
    """S7 shape: each row of ``df`` as one JSON document."""
    return df.select(F.to_json(F.struct(*[F.col(q(c)) for c in df.columns])).alias(name))


def write_report_json(df: DataFrame, path: str) -> None:
    """Nested report rows as JSON lines."""
    df.write.mode("overwrite").json(path)


# ------------------------------------------------------------- S8


def save_preprocessor(p, path: str, spark: SparkSession) -> None:
    """Fitted preprocessing state as JSON (small parameters) plus the
    label-code table as Parquet."""
    state = dict(roles=p.roles.__dict__, numeric=p.numeric, categorical=p.categorical,
                 medians=p.medians, modes={k: list(v) for k, v in p.modes.items()},
                 classes=p.classes, scaler={k: list(v) for k, v in p.scaler.items()},
                 code_cols=p.codes.cols if p.codes is not None else [])
    spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1) \
        .write.mode("overwrite").text(f"{path}/state")
    if p.codes is not None and p.codes.table is not None:
        p.codes.table.write.mode("overwrite").parquet(f"{path}/codes")


def load_preprocessor(spark: SparkSession, path: str):
    """Read back what :func:`save_preprocessor` wrote."""
    from ..operators.encode import LabelCodes, Preprocessor
    from ..schema import Roles
    state = json.loads("".join(r["value"] for r in spark.read.text(f"{path}/state").collect()))
    roles_d = state["roles"]
    roles = Roles(**{k: tuple(v) if isinstance(v, list) else v for k, v in roles_d.items()})
    codes = LabelCodes(state["code_cols"],
                       spark.read.parquet(f"{path}/codes") if state["code_cols"] else None)
    return Preprocessor(roles, state["numeric"], state["categorical"], state["medians"],
                        {k: tuple(v) for k, v in state["modes"].items()}, state["classes"],
                        codes, {k: tuple(v) for k, v in state["scaler"].items()})


def save_model(model, path: str) -> None:
    """S8 for Spark ML models (boosted trees, k-means, PCA)."""
    model.write().overwrite().save(path)
