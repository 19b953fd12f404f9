"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def q(name: str) -> str:
    """Backtick-quote a column name."""
    return "`" + name.replace("`", "``") + "`"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Only a local session (tests) that
    names none gets a scratch folder; a cluster without one is an error,
    because executors could not share what they write."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="llm-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def stored(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: cuts the
    lineage, survives lost executors, keeps column pruning for later readers."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(q(name)).cast("string"), F.lit(""))


def whole_row(df: DataFrame) -> Column:
    """All columns of a row as one struct, so that columns an operator adds
    can't clash with the caller's."""
    return F.struct(*[F.col(q(c)) for c in df.columns])


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over a task's batches; when the task ends, what it has freed goes back to the system, as
    the worker lives on for later tasks of its executor."""
    @functools.wraps(run)
    def task(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):       # not every libc has it
                ctypes.CDLL(None).malloc_trim(0)
    return task


def ship(module: str) -> None:
    """Send the functions of a module to Python workers by value, so that
    executors need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


ship(__name__)
