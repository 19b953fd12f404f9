"""Sharding: a consistent-hash ring with virtual nodes and bounded loads.

The ring has a fixed number of cells. Every shard owns ``vnodes`` cells (its
virtual nodes); a key belongs to the first virtual node at or after its own
cell, clockwise. A shard takes at most its bound of rows; rows beyond it go on
clockwise to the next virtual node whose shard has room. With
``load_factor=1`` the bounds are floor(N/n) and ceil(N/n) and add up to N, so
shard counts differ by one at most; a larger factor moves fewer rows when
shards are added.

Spark counts rows per cell, one aggregation with map-side combining. What the
driver sees is one number per virtual node (``n_shards * vnodes`` rows,
whatever the input): from these it works out which rank interval of each arc
stays and which goes on. Rows get their rank inside their arc from
cell counts plus a row number inside a small bucket of a cell, so no arc and
no shard is ever one task's work. Only DataFrame functions are used.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import q, stored, table

MAX_NODES = 1 << 16          # virtual nodes on a ring; bounds the driver's and the broadcast tables
ROWS_PER_BUCKET = 5_000      # target size of one ranking bucket
COPIES_PER_STEP = 100_000    # repeated identical rows are unfolded in steps of this size


def ring(n_shards: int, vnodes: int = 64) -> tuple[list[int], list[int], int]:
    """(cell of each virtual node in ring order, its shard, number of cells).

    A virtual node takes the first free cell at or after its hash. Shards are
    placed one after the other, so a further shard moves none of the earlier
    nodes (as long as the number of cells is the same)."""
    if n_shards < 1 or vnodes < 1 or n_shards * vnodes > MAX_NODES:
        raise ValueError(f"n_shards * vnodes must be between 1 and {MAX_NODES}")
    cells = MAX_NODES * 4
    owner: dict[int, int] = {}
    for shard in range(n_shards):
        for v in range(vnodes):
            h = int.from_bytes(hashlib.blake2b(f"{shard}:{v}".encode(), digest_size=8).digest(), "big")
            cell = h % cells
            while cell in owner:
                cell = (cell + 1) % cells
            owner[cell] = shard
    at = sorted(owner)
    return at, [owner[c] for c in at], cells


def flow(counts: list[int], owners: list[int], n_shards: int, load_factor: float = 1.0) -> list[tuple]:
    """Rank intervals (arc, lo, hi, shard, first slot) of bounded loads.

    First every arc fills its own shard, in ring order; then what is left of
    each arc goes one virtual node further, and so on, until all is placed."""
    total, n = sum(counts), len(owners)
    if load_factor < 1:
        raise ValueError("load_factor must be at least 1")
    if load_factor == 1:
        room = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    else:
        room = [-(-int(total * load_factor) // n_shards) + 1] * n_shards
    used, done, out = [0] * n_shards, [0] * n, []
    left = [a for a in range(n) if counts[a]]
    step = 0
    while left:
        rest = []
        for a in left:
            s = owners[(a + step) % n]
            take = min(counts[a] - done[a], room[s] - used[s])
            if take:
                out.append((a, done[a], done[a] + take, s, used[s]))
                used[s] += take
                done[a] += take
            if done[a] < counts[a]:
                rest.append(a)
        left, step = rest, step + 1
    return out


def assign_shards(df: DataFrame, keys: list[str], n_shards: int, vnodes: int = 64,
                  load_factor: float = 1.0, identity: list[str] | None = None) -> DataFrame:
    """Rows of ``df`` (columns ``identity``, by default all) with ``shard`` (int)
    and ``slot`` (long, gapless from 0 in each shard).

    keys: columns whose hash is a row's place on the ring. Nulls hash like any
    value; ties (equal keys) are ranked by the other columns; identical rows
    are counted before the shuffle, ranked as one and unfolded afterwards, each
    with its own slot. An empty table gives an empty result. Columns named
    ``shard`` or ``slot`` in ``df`` must not be in ``identity``.
    """
    spark = df.sparkSession
    cols = identity or df.columns
    if {"shard", "slot"} & set(cols):
        raise ValueError("shard and slot are the names of the result's columns")
    at, owners, cells = ring(n_shards, vnodes)
    arc_of, j = [], 0
    for c in range(cells):                       # the first virtual node at or after the cell
        while j < len(at) and at[j] < c:
            j += 1
        arc_of.append(j % len(at))
    # `cells` rows whatever the input: proven bound of the broadcast
    arcs = F.broadcast(spark.createDataFrame(list(enumerate(arc_of)), "_cell int, _arc int"))

    rows = (df.select(F.struct(*[F.col(q(c)) for c in cols]).alias("_r"),
                      F.xxhash64(*[F.col(q(c)) for c in keys]).alias("_h"),
                      F.xxhash64(F.lit(7), *[F.col(q(c)) for c in cols]).alias("_g"))
            .groupBy("_r", "_h", "_g").agg(F.count(F.lit(1)).alias("_n"))
            .withColumn("_cell", F.pmod(F.col("_h"), F.lit(cells)).cast("int")))
    rows = stored(rows, "ring-rows")
    # buckets follow each cell's own rows, so that a key which many rows share is split; one row per cell at most: bounded broadcast
    buckets = F.broadcast(rows.groupBy("_cell").agg(F.ceil(F.count(F.lit(1)) / ROWS_PER_BUCKET).alias("_buckets")))
    rows = (rows.join(arcs, "_cell").join(buckets, "_cell")
            .withColumn("_b", F.pmod(F.col("_g"), F.col("_buckets")).cast("int")).drop("_buckets"))

    sizes = rows.groupBy("_arc", "_cell", "_b").agg(F.sum("_n").alias("_m"))
    before = Window.partitionBy("_arc").orderBy("_cell", "_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_first", F.coalesce(F.sum("_m").over(before), F.lit(0)))

    counts = [0] * len(owners)
    for r in rows.groupBy("_arc").agg(F.sum("_n").alias("n")).collect():   # one row per virtual node at most
        counts[r[0]] = r[1]
    plan = flow(counts, owners, n_shards, load_factor)
    per_arc: dict[int, list] = {}
    for a, lo, hi, s, slot in plan:
        per_arc.setdefault(a, []).append((lo, hi, s, slot))
    # at most one row per virtual node, with at most n_shards intervals each
    where = F.broadcast(spark.createDataFrame(
        list(per_arc.items()), "_arc int, _to array<struct<lo:bigint,hi:bigint,shard:int,slot:bigint>>"))

    inside = (Window.partitionBy("_arc", "_cell", "_b").orderBy("_g", "_h", "_r")
              .rowsBetween(Window.unboundedPreceding, -1))
    ranked = (rows.withColumn("_k", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
              .join(starts.select("_arc", "_cell", "_b", "_first"), ["_arc", "_cell", "_b"])
              .withColumn("_lo", F.col("_first") + F.col("_k"))
              .withColumn("_hi", F.col("_lo") + F.col("_n") - 1))
    each = (ranked.withColumn("_s", F.explode(F.sequence("_lo", "_hi", F.lit(COPIES_PER_STEP).cast("bigint"))))
            .withColumn("_rank", F.explode(F.sequence(
                F.col("_s"), F.least(F.col("_s") + (COPIES_PER_STEP - 1), F.col("_hi"))))))
    hit = F.filter("_to", lambda x: (x["lo"] <= F.col("_rank")) & (F.col("_rank") < x["hi"]))[0]
    return (each.join(where, "_arc").withColumn("_x", hit)
            .select("_r.*", F.col("_x.shard").alias("shard"),
                    (F.col("_x.slot") + F.col("_rank") - F.col("_x.lo")).alias("slot")))


def op1_bounded_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 39 under the law ``rows``: the ring's bounds
    are exact, so counts are at most one apart. A null text has size 16 and
    the CRC of no bytes."""
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"))
    return assign_shards(docs, ["doc_id"], 40).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
