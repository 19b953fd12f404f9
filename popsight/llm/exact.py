"""Exact dedup by content sort.

Texts are normalised (white space deleted) and put in content order: the first
64 bytes, then the SHA-256 of all bytes, which settles long common beginnings
with a key of fixed size, then the bytes themselves. Spark samples that key for
splitters and range-partitions the rows (``repartitionByRange``); inside an equal
text the key goes on with length, id and row, so that a text held by a third
of all rows is spread over as many partitions as it fills. Spark's
external sort places equals next to each other; a task then streams its
partition once and compares the whole bytes of neighbours. The first row of a
run of equals is the one that stays.

A run can go on in the next partition. Only the first and the last run of a
partition can, so each task hands over the text of these two; ends whose
digests agree are compared in full by a join, and the driver chains what it
gets: at most two rows of numbers per partition. Texts are shuffled once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import q, ship, stored, table, whole_row

PREFIX = 64
SPACE = r"[\x20\x09-\x0D]+"


def _runs(carried: bool):
    """The rows of a sorted partition with their run of equal texts: its number, its
    size here, the id of its first row, and for the partition's first and last run the
    text (on the run's first row). Holds one batch, and ids of the run that is open."""
    names = ["doc_id", "keep_id", "group_size", "first", "run", "text_sha256", "pid", "border"] + ["_row"] * carried

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        number, text, sha, held, rows = -1, None, None, [], []

        def made(ids: pa.Array, lengths: np.ndarray, first_run: int, shas: pa.Array, borders: list, row) -> pa.RecordBatch:
            starts = np.cumsum(lengths) - lengths
            of = np.repeat(np.arange(len(lengths)), lengths)
            first = np.zeros(len(ids), bool)
            first[starts] = True
            border: list = [None] * len(ids)
            for k, value in borders:
                border[starts[k]] = value
            return pa.RecordBatch.from_arrays(
                [ids, ids.take(pa.array(starts[of])), pa.array(lengths[of]), pa.array(first), pa.array(of + first_run),
                 shas.take(pa.array(of)), pa.array(np.full(len(ids), pid)), pa.array(border, pa.binary())] + [row] * carried, names)

        def close(last: bool) -> pa.RecordBatch:
            ids = pa.concat_arrays(held)
            return made(ids, np.array([len(ids)]), number, pa.array([sha]), [(0, text)] if last or number == 0 else [],
                        pa.concat_arrays(rows) if carried else None)

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            norm, ids, shas = batch.column("norm"), batch.column("id"), batch.column("sha")
            row = batch.column("_row") if carried else None
            new = np.ones(n, bool)
            new[0] = text is None or norm[0].as_py() != text
            if n > 1:
                new[1:] = ~pc.equal(norm.slice(1), norm.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            at = np.flatnonzero(new)

            def keep(lo: int, hi: int) -> None:                # copies, so that the batch can go
                part = pa.array(np.arange(lo, hi))
                held.append(ids.take(part))
                if carried:
                    rows.append(row.take(part))

            if not len(at):
                keep(0, n)
                continue
            if at[0]:
                keep(0, at[0])
            if held:
                yield close(False)
                held.clear()
                rows.clear()
            whole = len(at) - 1                                # runs that end in this batch
            if whole:
                a, b = int(at[0]), int(at[-1])
                borders = [(0, norm[a].as_py())] if number < 0 else []
                yield made(ids.slice(a, b - a), np.diff(at), number + 1, shas.take(pa.array(at[:-1])), borders,
                           row.slice(a, b - a) if carried else None)
            number += len(at)
            text, sha = norm[int(at[-1])].as_py(), shas[int(at[-1])].as_py()
            keep(int(at[-1]), n)
        if held:
            yield close(True)

    return run


def _chains(edges: list, linked: set) -> list[tuple]:
    """(pid, run, keep_id, size, whether it goes on from the partition before) of every run
    that goes over partitions. edges: first and last run of every partition, in order."""
    out, chain = [], []

    def close() -> None:
        if len(chain) > 1:
            size = sum(e["group_size"] for e in chain)
            out.extend((e["pid"], e["run"], chain[0]["keep_id"], size, i > 0) for i, e in enumerate(chain))

    for e in edges:
        if not (chain and (chain[-1]["pid"], e["pid"]) in linked and e["run"] == 0):
            close()
            chain = []
        chain.append(e)
    close()
    return out


def content_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", partitions: int | None = None,
                   carry: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical without the characters
    ``[\\x20\\x09-\\x0D]``; a null text counts as empty. Of equals the row with the
    most code points in its original text stays, then the smallest doc_id (null
    last); of rows that tie in both exactly one is ``kept``. ``group_size`` counts
    rows, repeated ones too. An empty table gives an empty result. Other columns are
    left out, or kept whole as struct ``_row`` with ``carry``. ``partitions``:
    ranges, by default the session's shuffle partitions.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    original = F.coalesce(F.col(q(text)).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(q(doc_id)).cast("long").alias("id"), F.length(original).alias("chars"),
        F.regexp_replace(original, SPACE, "").alias("norm"), *([whole_row(docs).alias("_row")] if carry else []))
    rows = rows.select("*", F.substring("norm", 1, PREFIX).alias("prefix"), F.sha2(F.col("norm").cast("binary"), 256).alias("sha"),
                       F.monotonically_increasing_id().alias("at"))      # tells repeated rows apart, no more
    inside = [F.desc("chars"), F.asc_nulls_last("id"), F.asc("at")]
    ordered = (rows.repartitionByRange(n, F.asc("prefix"), F.asc("sha"), *inside)
               .sortWithinPartitions(F.asc("prefix"), F.asc("sha"), F.asc("norm"), *inside)
               .select("id", F.col("norm").cast("binary").alias("norm"), "sha", *(["_row"] if carry else [])))
    schema = StructType.fromDDL("doc_id long, keep_id long, group_size long, first boolean, run long, text_sha256 string, "
                                "pid long, border binary")
    runs = stored(ordered.mapInArrow(_runs(carry), schema.add(ordered.schema["_row"]) if carry else schema), "content-runs")

    ends = runs.filter("border is not null")
    # two rows of numbers per partition at most
    edges = sorted(ends.select("pid", "run", "keep_id", "group_size", "text_sha256").collect(), key=lambda e: (e["pid"], e["run"]))
    maybe = [(a["pid"], a["run"], b["pid"]) for a, b in zip(edges, edges[1:])
             if a["pid"] < b["pid"] and a["text_sha256"] == b["text_sha256"]]
    more: list[tuple] = []
    if maybe:
        pairs = spark.createDataFrame(maybe, "a long, r long, b long")
        left = ends.select(F.col("pid").alias("a"), F.col("run").alias("r"), F.col("border").alias("left"))
        right = ends.filter("run = 0").select(F.col("pid").alias("b"), F.col("border").alias("right"))
        same = pairs.join(left, ["a", "r"]).join(right, "b").filter(F.col("left") == F.col("right")).select("a", "b")
        more = _chains(edges, {(x["a"], x["b"]) for x in same.collect()})
    if more:
        # two rows per partition at most
        known = F.broadcast(spark.createDataFrame(more, "pid long, run long, _keep long, _size long, _goes_on boolean"))
        runs = runs.join(known, ["pid", "run"], "left")
        chained = F.col("_size").isNotNull()
        keep, size = F.when(chained, F.col("_keep")).otherwise(F.col("keep_id")), F.coalesce("_size", "group_size")
        kept = F.col("first") & ~F.coalesce("_goes_on", F.lit(False))
    else:
        keep, size, kept = F.col("keep_id"), F.col("group_size"), F.col("first")
    return runs.select("doc_id", keep.alias("keep_id"), size.alias("group_size"), kept.alias("kept"), "text_sha256",
                       *(["_row"] if carry else []))


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", partitions: int | None = None) -> DataFrame:
    """The rows of ``docs`` that ``content_groups`` keeps, with all their columns."""
    return content_groups(docs, doc_id, text, partitions, carry=True).filter("kept").select("_row.*")


def op11_content_sort_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with the row that stays of its equals. Nulls, empty
    texts, ties, repeated rows and an empty table: see ``content_groups``."""
    return content_groups(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER w = 1 AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm ORDER BY length(text) DESC, doc_id NULLS LAST)
"""

ship(__name__)
