"""Temperature mixing of sources.

A source with the token share p gets the weight p**alpha / sum(p**alpha).
alpha = 1 keeps the shares, 0 makes all sources equal, more than 1 favours the large ones.
The exponent is found by bisection: the smallest alpha for which the
entropy is at most ``target_entropy`` (a share of its maximum) and no source is
repeated more than ``max_repeats`` times; so the entropy equals the target, unless even equal
weights lie below it or the repetition limit binds first. The budget defaults to the smallest
that still passes over every source once, so no document is dropped.

The weights are realised as budgeted block permutations: each source's
documents lie in hash blocks; every epoch permutes the blocks and the documents
inside them; whole epochs are followed by one cut where the source's budget
is reached. A row's part in the cut epoch follows from its own hashes and the
source's cut point alone, so texts are never shuffled. A source's weight follows from its
size alone: the driver sees one row per different source size (k different sizes need k * k / 2 tokens),
the tables per source stay in Spark, which broadcasts them below its threshold. A source
with a third of all rows is just more blocks; its cut is found by the leading byte of the
block keys first, then among the blocks of that byte. Only DataFrame functions.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import q, stored, table, whole_row

ROWS_PER_BLOCK = 4_096
LARGEST_ALPHA = 2.0 ** 20


def tokens(text: Column) -> Column:
    """Words of a text (null: none) plus one, so that every document counts."""
    return (F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)) + 1).cast("long")


def weights(shares: dict, alpha: float) -> dict:
    top = max(math.log(p) for p in shares.values())
    raw = {s: math.exp(alpha * (math.log(p) - top)) for s, p in shares.items()}
    total = sum(raw[s] for s in sorted(raw, key=str))
    return {s: w / total for s, w in raw.items()}


def entropy(w: dict) -> float:
    """Entropy as a share of its maximum (1: all equal)."""
    return -sum(x * math.log(x) for x in w.values() if x) / math.log(len(w)) if len(w) > 1 else 1.0


@dataclass
class Mixture:
    """What the exponent comes to: tokens of the budget, entropy, largest repetition, and per
    source size (weight, whole epochs, tokens of the cut epoch)."""
    alpha: float
    budget: float
    entropy: float
    repeats: float
    plan: dict[int, tuple[float, int, int]]


def _at(sizes: Counter, alpha: float, budget: float | None) -> Mixture:
    """The mixture of an exponent; sizes: tokens of a source -> number of such sources."""
    log = {n: math.log(n) for n in sizes}
    top = max(log.values())
    raw = {n: math.exp(alpha * (log[n] - top)) for n in sizes}
    total = math.fsum(raw[n] * c for n, c in sizes.items())
    # of a weight that is too small for a double only the logarithm is used
    small = {n: alpha * (log[n] - top) - math.log(total) for n in sizes}
    need = max(log[n] - small[n] for n in sizes)               # log of the budget that passes over every source once
    b = budget or (math.exp(need) if need < 700 else math.inf)
    many = sum(sizes.values())
    h = -math.fsum(c * raw[n] / total * small[n] for n, c in sizes.items()) / math.log(many) if many > 1 else 1.0
    rise = max(small[n] - log[n] for n in sizes) + (math.log(b) if math.isfinite(b) else need)
    return Mixture(alpha, b, h, math.exp(rise) if rise < 700 else math.inf, {n: (raw[n] / total, 0, 0) for n in sizes})


def _edge(holds, no: float, yes: float, steps: int) -> float:
    """Nearest point to ``no`` where ``holds``, by bisection; it holds at ``yes``."""
    for _ in range(steps):
        mid = (no + yes) / 2
        no, yes = (no, mid) if holds(mid) else (mid, yes)
    return yes


def _alpha(have: Counter, target_entropy: float, max_repeats: float, budget: float | None = None,
           steps: int = 60) -> float:
    """The smallest exponent within both limits, by bisection. Where the two exclude each other,
    the repetition limit binds: the largest exponent that it allows. A budget that repeats
    even the plain shares more often leaves 1, as do sources of one size."""
    if len(have) < 2:
        return 1.0

    def rare(alpha: float) -> bool:
        return _at(have, alpha, budget).repeats <= max_repeats + 1e-9

    def even(alpha: float) -> bool:
        return _at(have, alpha, budget).entropy <= target_entropy + 1e-12

    if not rare(1.0):
        return 1.0
    low = 0.0 if rare(0.0) else _edge(rare, 0.0, 1.0, steps)
    if even(low):
        return low
    high = max(1.0, 2 * low)
    while not even(high) and rare(high) and high < LARGEST_ALPHA:      # the bracket grows until a limit is met
        high *= 2
    if even(high):
        want = _edge(even, low, high, steps)
        if rare(want):
            return want
    return high if rare(high) else _edge(rare, high, max(1.0, low), steps)


def find_alpha(sizes: dict, target_entropy: float, max_repeats: float, budget: float | None = None) -> float:
    """The exponent for sources (name -> tokens)."""
    return _alpha(Counter(sizes.values()), target_entropy, max_repeats, budget)


def mixture(sizes: dict, target_entropy: float = 0.97, max_repeats: float = 2.0, budget: int | None = None) -> Mixture:
    """The mixture of sources (name -> tokens)."""
    return mixture_of(Counter(sizes.values()), target_entropy, max_repeats, budget)


def mixture_of(have: Counter, target_entropy: float = 0.97, max_repeats: float = 2.0, budget: int | None = None) -> Mixture:
    """The mixture of sources, counted by their tokens."""
    m = _at(have, _alpha(have, target_entropy, max_repeats, budget), budget)
    for n, (w, _, _) in m.plan.items():
        want = round(w * m.budget)
        m.plan[n] = (w, want // n, want % n)
    return m


def plan_mix(sizes: dict, target_entropy: float = 0.97, max_repeats: float = 2.0, budget: int | None = None) -> dict:
    """source -> (weight, whole epochs, tokens of the cut epoch)."""
    if not sizes:
        return {}
    m = mixture(sizes, target_entropy, max_repeats, budget)
    return {s: m.plan[n] for s, n in sizes.items()}


def _hash(*cols, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), *cols)


def mix(docs: DataFrame, source: str = "source", doc_id: str = "doc_id", text: str = "text",
        target_entropy: float = 0.97, max_repeats: float = 2.0, budget: int | None = None,
        seed: int = 17) -> DataFrame:
    """Rows of ``docs`` (struct ``_row``) once per epoch that draws them, with
    ``_tokens``, ``_epoch`` (from 0), ``_block`` and ``_key`` (place in the
    epoch's permutation: blocks by ``_key.b``, documents by ``_key.r``) and
    ``_source``.

    A null source is a source of its own. A null text counts one token.
    Rows with equal doc_id and text have equal hashes and are drawn together.
    A source's cut epoch takes documents in permutation order up to and including the one that
    reaches the budget. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    place = [F.col(q(doc_id)), F.col(q(text))]
    rows = docs.select(whole_row(docs).alias("_row"), F.col(q(source)).cast("string").alias("_source"),
                       tokens(F.col(q(text))).alias("_tokens"), _hash(*place, seed=seed).alias("_id"))
    slim = stored(rows.select("_source", "_tokens", "_id"), "mix")
    sums = stored(slim.groupBy("_source").agg(F.sum("_tokens").alias("t"), F.count(F.lit(1)).alias("n")), "mix-sources")
    have = Counter({r["t"]: r["c"] for r in sums.groupBy("t").agg(F.count(F.lit(1)).alias("c")).collect()})   # one row per different size
    plan = mixture_of(have, target_entropy, max_repeats, budget).plan if have else {}
    of_size = spark.createDataFrame([(t, *x) for t, x in plan.items()], "t bigint, _weight double, _whole bigint, _part bigint")
    info = stored(sums.join(of_size, "t").select(
        F.col("_source").alias("_s"), "_weight", "_whole", "_part", F.ceil(F.col("n") / ROWS_PER_BLOCK).alias("_blocks")), "mix-plan")

    def placed(df: DataFrame, epoch: Column) -> DataFrame:
        """With the block and its key and the row's key in an epoch's permutation."""
        return (df.withColumn("_block", F.pmod(_hash("_id", seed=seed + 1), F.col("_blocks")))
                .withColumn("_key", F.struct(_hash("_source", "_block", epoch, seed=seed + 2).alias("b"),
                                             F.col("_block").alias("k"),
                                             _hash("_id", epoch, seed=seed + 3).alias("r"))))

    def known(df: DataFrame) -> DataFrame:
        return df.join(info, F.col("_source").eqNullSafe(F.col("_s"))).drop("_s")

    # the cut epoch: first the block, then the row in it, where the budget is reached
    cut = placed(known(slim).filter("_part > 0"), F.col("_whole"))
    blocks = stored(cut.groupBy("_source", "_part", "_key.b", "_key.k").agg(F.sum("_tokens").alias("t"))
                    .withColumn("lead", F.shiftright("b", 56)), "mix-blocks")

    def reached(df: DataFrame, *by: str, start: Column, order: list[str]) -> DataFrame:
        """The row of each group whose running total reaches the part, with what is done before it."""
        before = F.sum("t").over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
        return df.withColumn("done", F.coalesce(before, F.lit(0)) + start).filter(
            (F.col("done") < F.col("_part")) & (F.col("done") + F.col("t") >= F.col("_part")))

    # 256 leading bytes a source at most, then the blocks of one of them
    leads = blocks.groupBy("_source", "_part", "lead").agg(F.sum("t").alias("t"))
    lead = reached(leads, "_source", start=F.lit(0), order=["lead"]).select(
        F.col("_source").alias("_s"), F.col("lead").alias("_l"), F.col("done").alias("_before"))
    near = blocks.join(lead, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("lead") == F.col("_l")))
    last = stored(reached(near, "_source", start=F.col("_before"), order=["b", "k"]).select("_s", "b", "k", "done"), "mix-cuts")
    inside = Window.partitionBy("_source").orderBy("_key.r").rowsBetween(Window.unboundedPreceding, -1)
    ends = (cut.join(last, F.col("_source").eqNullSafe(F.col("_s"))                     # one block per source
                     & (F.col("_key.b") == F.col("b")) & (F.col("_key.k") == F.col("k")))
            .withColumn("before", F.coalesce(F.sum("_tokens").over(inside), F.lit(0)) + F.col("done"))
            .filter(F.col("before") < F.col("_part"))
            .groupBy("_source").agg(F.max("_key").alias("_end")).select(F.col("_source").alias("_s"), "_end"))
    ends = stored(ends, "mix-ends")

    drawn = known(rows).join(ends, F.col("_source").eqNullSafe(F.col("_s")), "left").drop("_s")
    drawn = placed(drawn, F.col("_whole"))
    copies = F.col("_whole") + F.when(F.col("_end").isNotNull() & (F.col("_key") <= F.col("_end")), 1).otherwise(0)
    each = (drawn.withColumn("_copies", copies).filter("_copies > 0")
            .withColumn("_epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_copies") - 1))))
    return placed(each, F.col("_epoch")).select("_row", "_source", "_tokens", "_epoch", "_block", "_key", "_weight")


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The columns of ``docs``, every row as often as the mixture draws it."""
    return mix(docs, **options).select("_row.*")


def op8_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drawn documents with their source's weight and their place in the
    permutation of the epoch. Nulls, empty texts, ties, repeated rows, an empty table: see ``mix``."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text")
    return mix(docs).select(
        F.col("_row.doc_id").alias("doc_id"), F.col("_source").alias("source"), F.col("_tokens").alias("n_tokens"),
        F.col("_epoch").alias("epoch"), F.col("_block").alias("block"), F.col("_key.b").alias("block_key"),
        F.col("_key.r").alias("row_key"), F.round("_weight", 12).alias("weight"))
