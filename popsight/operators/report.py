"""Whole report documents, assembled from several operators' tables.

A document is one row with one column per section: a struct for a table of one row, an
array of structs, ordered by key, for a table of several. Written as JSON it is what a stage
hands to its reader; ``flatten`` turns it back into rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType

from ..schema import q

#: Rows of a section: columns, classes, segments, strategies. More is no report, and an error.
MAX_ITEMS = 100_000


def document(spark: SparkSession, sections: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """One row; sections: name -> (table, key columns). Without keys the table has one
    row at most (none gives a null section)."""
    out = []
    for name, (table, keys) in sections.items():
        fields = [F.col(q(c)) for c in [*keys, *(c for c in table.columns if c not in keys)]]
        rows = F.collect_list(F.struct(*fields))
        most = MAX_ITEMS if keys else 1
        whole = F.when(F.size(rows) <= most, F.array_sort(rows) if keys else F.get(rows, F.lit(0))).otherwise(
            F.raise_error(F.lit(f"section {name} has more than {most} rows")))
        out.append(table.agg(whole).scalar().alias(name))
    return spark.range(1).select(*out)


def flatten(doc: DataFrame, keys: dict[str, list[str]]) -> DataFrame:
    """Rows (section, item, field, number, text) of documents: every value of every section, numbers as
    double, all else as text; ``item`` is the row's key, empty in a section of one row."""
    def value(name: str, row: Column, kind, item: Column, own: list[str]) -> list[Column]:
        out = []
        for f in kind.fields:
            if f.name in own:
                continue
            text = isinstance(f.dataType, (StringType, BooleanType, ArrayType))
            x = row.getField(f.name)
            shown = F.concat_ws(", ", x) if isinstance(f.dataType, ArrayType) else x.cast("string")
            out.append(F.struct(F.lit(name).alias("section"), item.alias("item"), F.lit(f.name).alias("field"),
                                (F.lit(None) if text else x).cast("double").alias("number"),
                                (shown if text else F.lit(None)).cast("string").alias("text")))
        return out

    def of_row(name: str, kind, own: list[str]):
        return lambda r: F.array(*value(name, r, kind, F.concat_ws("/", *[r.getField(k).cast("string") for k in own]), own))

    cells = []
    for s in doc.schema.fields:
        own = keys.get(s.name, [])
        if isinstance(s.dataType, ArrayType):
            cells.append(F.flatten(F.transform(F.col(q(s.name)), of_row(s.name, s.dataType.elementType, own))))
        else:
            cells.append(F.when(F.col(q(s.name)).isNotNull(), F.array(*value(s.name, F.col(q(s.name)), s.dataType, F.lit(""), own))))
    present = F.filter(F.array(*cells), lambda c: c.isNotNull())
    return doc.select(F.explode(F.flatten(present)).alias("c")).select("c.*")
