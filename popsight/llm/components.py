"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): every node that has a link to a smaller one, with the
    smallest node of its component. ``edges``: columns a, b (longs); loops,
    repeated and reversed links are fine, nulls are left out.

    Each round ties all larger neighbours of a node to its smallest neighbour
    (large star), then all smaller ones (small star), until nothing changes: O(log^2 n)
    rounds. Minima are aggregated before the shuffle and joined back, so a
    node with very many links is never one group; each round is written to
    the shared folder. The driver sees two numbers a round."""
    now = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                 .filter("u is not null and v is not null").distinct(), "edges")
    sign = _sign(now)
    for _ in range(max_rounds):
        if not sign[0]:
            break
        both = now.union(now.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large, "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        now = stored(small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
                     .filter("u <> v").distinct(), "small-star")
        then, sign = sign, _sign(now)
        if then == sign:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _sign(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
