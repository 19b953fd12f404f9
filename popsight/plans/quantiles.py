"""Exact percentiles by radix selection, without moving the values.

Spark's exact ``percentile`` / ``median`` keep a map of every distinct value
of a group in the aggregation buffer, so the final merge of a continuous
column holds all of its distinct values in one task. Here, for any number of
columns and groups of any size:

1. every value gets an order-preserving 64-bit integer (an integer is its own; a
   double's sign, exponent and fraction put together);
2. one scan counts rows, smallest and largest value per group and top 16 bits (integers of up to
   16 bits are buckets of their own, so such columns are done here).
   The counts are combined map-side: what is shuffled is bounded by 131,072 rows
   a group and task, whatever the number of rows and distinct values;
3. running totals over a group's buckets show which buckets
   hold the two ranks around ``p * (n - 1)``. A bucket whose smallest and
   largest value agree is done; any other is cut into 65,536 equal steps between them,
   and the next scan counts the rows inside. A bucket spans 2**48, 2**32, 2**16,
   1 integers at most after one, two, three, four scans, so there are four scans at most;
   later scans read only columns that have an open bucket;
4. the values at the two ranks are linearly interpolated exactly like Spark's
   ``percentile``.

Open buckets (two per group and probability at most) travel to the next scan through
the driver while there are at most ``MAX_LOCAL`` of them, else as a stored table, joined by
group; Spark broadcasts either only if it is small.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..schema import q
from .store import stored

BITS = 16
MAX_LOCAL = 10_000


def with_order_key(rows: DataFrame, value: str, key: str) -> DataFrame:
    """``rows`` with ``key`` = the order-preserving 64-bit integer of the double ``value`` (not NaN)
    wherever ``key`` is null: the IEEE-754 magnitude bits with the value's sign, worked out with
    exact powers of two. One projection a step, so that no step is computed twice."""
    x, todo, keep = F.col(value), F.col(key).isNull(), rows.columns
    out = rows.select("*", F.when(todo, F.abs(x)).alias("_m"))
    out = out.select("*", F.when(todo, F.floor(F.log2("_m"))).alias("_g"))
    out = out.select("*", F.when(todo, F.pow(F.lit(2.0), F.col("_g"))).alias("_p"))
    # the logarithm may be off by one next to a power of two
    off = F.when(F.col("_p") > F.col("_m"), -1).when(F.col("_p") * F.lit(2.0) <= F.col("_m"), 1).otherwise(0)
    out = out.select("*", F.when(todo, off).alias("_off"))
    # a power of two beyond the largest double: its half fits
    power = F.when(F.col("_off") == 0, F.col("_p")).otherwise(F.pow(F.lit(2.0), F.col("_g") + F.col("_off")))
    normal = ((F.col("_g") + F.col("_off") + F.lit(1022)) * F.lit(1 << 52)
              + (F.col("_m") / power * F.lit(float(1 << 52))).cast("bigint"))
    tiny = (F.col("_m") * F.lit(2.0 ** 537) * F.lit(2.0 ** 537)).cast("bigint")
    bits = (F.when(F.col("_m") < F.lit(2.0 ** -1022), tiny)
            .when(F.col("_m") == F.lit(float("inf")), F.lit(2047 << 52)).otherwise(normal))
    out = out.select("*", F.when(todo, bits).alias("_bits"))
    made = F.when(F.col(key).isNotNull(), F.col(key)).when(x < 0, -F.col("_bits")).otherwise(F.col("_bits")).alias(key)
    return out.select(*[made if c == key else F.col(q(c)) for c in keep])


def _cell(x: Column, integral: bool) -> list[Column]:
    """A value as (_x double, _v its order key if it is an integer); NaN is null, -0.0 is 0.0."""
    if integral:
        return [x.cast("double").alias("_x"), x.cast("bigint").alias("_v")]
    d = x.cast("double") + F.lit(0.0)
    return [F.when(~F.isnan(d), d).alias("_x"), F.lit(None).cast("bigint").alias("_v")]


def _same(left: list[str], right: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right)])


def _kept(nodes: DataFrame) -> DataFrame:
    """A small table through the driver (a local relation: its size is known and what filters
    it needs no job), a large one in the shared folder."""
    spark = nodes.sparkSession
    local = nodes.limit(MAX_LOCAL + 1).toArrow()
    return spark.createDataFrame(local, nodes.schema) if local.num_rows <= MAX_LOCAL else stored(nodes, "percentiles")


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows with their order key _v and first bucket _d."""
    v, small = F.col("_v"), F.lit(1 << (BITS - 1))
    own = (F.when((v >= -small) & (v < small), v).when(v >= small, small + F.shiftright("_v", 64 - BITS))
           .when(v < -small, F.shiftright("_v", 64 - BITS) - small))
    return with_order_key(rows.select("*", own.alias("_d")), "_x", "_v")


def _select(rows: DataFrame, keys: list[str], probs: list[float], narrow: Callable[[list], DataFrame] | None = None) -> DataFrame:
    """Percentiles of ``rows`` (*keys, _x, _v) without missing values; keys has one column at least.
    ``narrow``: gives the rows of some values of the first key, for later scans.

    A node is a wanted rank (p_index, pos, side, _rank: its number in the bucket) with the bucket that
    holds it (smallest and largest value _a, _b and key _lo, _hi)."""
    rows = _keyed(rows)
    names = [f"_o{i}" for i in range(len(keys))]
    counted = [F.count("*").alias("_c"), F.min("_x").alias("_a"), F.max("_x").alias("_b"),
               F.min("_v").alias("_lo"), F.max("_v").alias("_hi")]
    wanted = ["p_index", "pos", "side", "_rank"]

    def chosen(ranks: DataFrame) -> DataFrame:
        """The wanted ranks that lie in their row's bucket, counted from its start."""
        return ranks.where((F.col("_rank") >= F.col("_end") - F.col("_c")) & (F.col("_rank") < F.col("_end"))).select(
            *keys, "_a", "_b", "_lo", "_hi", "p_index", "pos", "side", (F.col("_rank") - F.col("_end") + F.col("_c")).alias("_rank"))

    def running(*by: str) -> Column:
        return F.sum("_c").over(Window.partitionBy(*by).orderBy("_d").rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("_end")

    counts = rows.groupBy(*keys, F.coalesce("_d", F.shiftright("_v", 64 - BITS)).alias("_d")).agg(*counted)
    total = F.sum("_c").over(Window.partitionBy(*keys))
    place = [(i, s, (total - 1) * F.lit(float(p)), f) for i, p in enumerate(probs) for s, f in ((0, F.floor), (1, F.ceil))]
    ranks = F.array(*[F.struct(F.lit(i).alias("p_index"), pos.alias("pos"), F.lit(s).alias("side"), f(pos).cast("bigint").alias("_rank"))
                      for i, s, pos, f in place])
    level = chosen(counts.select("*", running(*keys), ranks.alias("_r")).select("*", F.inline("_r")))
    done = []
    while True:
        nodes = _kept(level)
        closed = F.col("_a") == F.col("_b")
        done.append(nodes.where(closed).select(*keys, "p_index", "pos", "side", "_a"))
        open_ = nodes.where(~closed)
        if len(done) == 64 // BITS or open_.isEmpty():
            break
        buckets = open_.select(*[F.col(k).alias(o) for k, o in zip(keys, names)], "_lo", "_hi").distinct().select(
            *names, F.col("_lo").alias("_l"), F.col("_hi").alias("_h"),
            (F.floor((F.col("_hi") - F.col("_lo")) / F.lit(float(1 << BITS))) + 1).alias("_step"))     # two per group and probability at most
        # a key is never null; said this way, no test for it is pushed below the steps that make it and repeats them
        v = F.coalesce("_v", F.lit(0))
        inside = _same(keys, names) & (v >= F.col("_l")) & (v <= F.col("_h"))
        if narrow:
            rows = _keyed(narrow(sorted({r[0] for r in open_.select(keys[0]).collect()})))      # two per probability and key at most
        near = rows.drop("_d").join(buckets, inside).drop(*names)
        counts = (near.groupBy(*keys, "_l", F.floor((F.col("_v") - F.col("_l")) / F.col("_step")).alias("_d")).agg(*counted)
                  .select("*", running(*keys, "_l")))
        again = open_.select(*[F.col(k).alias(o) for k, o in zip(keys, names)], F.col("_lo").alias("_from"), *wanted)
        level = chosen(counts.join(again, _same(keys, names) & (F.col("_l") == F.col("_from"))))
    found = reduce(DataFrame.unionByName, done).groupBy(*keys, "p_index").agg(
        F.max("pos").alias("pos"), F.max(F.when(F.col("side") == 0, F.col("_a"))).alias("_l"),
        F.max(F.when(F.col("side") == 1, F.col("_a"))).alias("_h"))
    low, high = F.floor("pos"), F.ceil("pos")
    return found.select(*keys, "p_index", F.when(
        (low == high) | (F.col("_l") == F.col("_h")), F.col("_l")).otherwise(
        (high - F.col("pos")) * F.col("_l") + (F.col("pos") - low) * F.col("_h")).alias("value"))


def exact_percentiles(long: DataFrame, group_cols: list[str], value: str, probs: list[float]) -> DataFrame:
    """Rows (*group_cols, p_index, value): the exact percentile ``probs[p_index]``
    of ``value`` within each group (nulls and NaN ignored; a null group is a
    group; a group without values has no row)."""
    keys = [f"_k{i}" for i in range(len(group_cols))]
    integral = isinstance(long.schema[value].dataType, IntegralType)
    rows = long.select(*[F.col(q(g)).alias(k) for g, k in zip(group_cols, keys)], *_cell(F.col(q(value)), integral)
                       ).where(F.col("_x").isNotNull())
    if keys:
        out = _select(rows, keys, probs)
    else:                      # one group: a key that is no constant for the optimizer, so that joins stay equi-joins
        out = _select(rows.withColumn("_k0", F.isnull("_x")), ["_k0"], probs)
    return out.select(*[F.col(k).alias(g) for k, g in zip(keys, group_cols)], "p_index", "value")


def exact_percentile_columns(df: DataFrame, cols: list[str], probs: list[float]) -> dict[str, list[float | None]]:
    """{column: [percentile per prob]} for several numeric columns at once
    (one unpivot; columns without values map to Nones)."""
    if not cols:
        return {}
    def long(some: list[int]) -> DataFrame:
        return df.select(F.explode(F.array(*[
            F.struct(F.lit(i).alias("_k0"), *_cell(F.col(q(cols[i])), isinstance(df.schema[cols[i]].dataType, IntegralType)))
            for i in some])).alias("kv")).select("kv.*").where(F.col("_x").isNotNull())

    res = {c: [None] * len(probs) for c in cols}
    # one row per column and probability
    for r in _select(long(list(range(len(cols)))), ["_k0"], probs, long).collect():
        res[cols[r["_k0"]]][r["p_index"]] = r["value"]
    return res
