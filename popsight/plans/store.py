"""Columnar intermediates in the session's shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir

_WRITTEN: dict[str, list[str]] = {}


def store_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for an intermediate, remembered for ``clean_up``."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/popsight-store/{name}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet under the folder in ``spark.checkpoint.dir`` and
    read back: cuts the lineage like a reliable checkpoint, but later
    readers still prune columns and push filters into the scan."""
    spark = df.sparkSession
    path = store_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clean_up(spark: SparkSession) -> int:
    """Delete the intermediates that this session has written; results that still read them must
    have been written or collected before. Returns their number."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
    return len(paths)
