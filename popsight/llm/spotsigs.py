"""Document fingerprints by SpotSigs.

A signature is a chain of ``chain`` content words that follow a common word
(the anchor), other common words in between skipped. A document's fingerprint
is the set of its signatures' 64-bit hashes, written as sorted hexadecimal; two
fingerprints are compared by Jaccard. Documents are joined inside
partitions of set length: sizes of pairs at a similarity t differ by the
factor t at most, so every set meets sets of its own length range and the next one
only, through the rarest signatures of each (prefix filter), and the exact
Jaccard is computed only for pairs that these bounds leave.

Common words are a parameter; the default is a short list for four languages.
Only DataFrame functions on the whole path.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import q, stored, table, text_or_empty

#: Very common words of English, German, French and Spanish; the anchors of signatures.
ANCHORS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the",
    "this", "to", "was", "with",
    "auf", "das", "dem", "den", "der", "des", "die", "ein", "eine", "für", "ist", "mit", "nicht", "sich", "und",
    "von", "zu",
    "au", "avec", "dans", "de", "du", "elle", "en", "est", "et", "la", "le", "les", "ou", "par", "pas", "pour", "que",
    "qui", "sur", "un", "une",
    "al", "con", "del", "el", "ie", "la", "las", "los", "no", "para", "por", "se", "su", "y",
)
CHAIN = 3
BUCKETS_PER_PARTITION = 2


def signatures(text: Column, anchors: tuple[str, ...] = ANCHORS, chain: int = CHAIN) -> Column:
    """Sorted distinct signature hashes of a text column. A text without a full
    chain (null, empty, no anchor) has one signature, the hash of its whole text,
    so that equal texts have equal and different texts different fingerprints."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    marked = F.transform(words, lambda x, i: F.struct(x.alias("w"), i.alias("i"), x.isin(*anchors).alias("a")))
    # one pass over the words; both halves are filters of it
    both = F.struct(
        F.transform(F.filter(marked, lambda x: ~x["a"]), lambda x: x["w"]).alias("c"),
        F.transform(F.filter(marked, lambda x: x["a"]), lambda x, k: F.struct(x["w"].alias("w"), (x["i"] - k).alias("s"))).alias("s"))
    sets = F.transform(F.array(both), lambda b: F.array_sort(F.array_distinct(F.transform(
        F.filter(b["s"], lambda x: x["s"] + chain <= F.size(b["c"])),
        lambda x: F.xxhash64(x["w"], *[F.get(b["c"], x["s"] + j) for j in range(chain)])))))[0]
    return F.transform(F.array(sets), lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(F.xxhash64(text))))[0]


def fingerprint(sigs: Column) -> Column:
    """The set as text: 16 hexadecimal digits each, sorted."""
    return F.array_join(F.transform(sigs, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard of two signature sets (0 to 1)."""
    both = F.size(F.array_intersect(a, b))
    return F.when(a == b, F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def similar(sets: DataFrame, doc_id: str, sigs: str, threshold: float = 0.8) -> DataFrame:
    """(a, b, likeness): all pairs a < b of representatives with a Jaccard of at
    least ``threshold``, where documents with equal sets are represented by
    their smallest id (see ``representatives``)."""
    reps = stored(representatives(sets, doc_id, sigs).groupBy("rep").agg(F.first("sigs").alias("sigs"))
                  .withColumn("n", F.size("sigs")), "spot-sets")
    width = -math.log(threshold) or 1.0
    level = F.floor(F.log(F.col("n").cast("double")) / F.lit(width) + 1e-9).cast("int")
    tokens = reps.select("rep", "n", level.alias("level"), F.explode("sigs").alias("x"))
    seen = tokens.groupBy("x").agg(F.count(F.lit(1)).alias("f")).filter("f > 1")
    rank = F.row_number().over(Window.partitionBy("rep").orderBy(F.coalesce("f", F.lit(1)), "x"))
    prefix = (tokens.join(seen, "x", "left").withColumn("k", rank)
              .filter(F.col("k") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1)
              .filter("f > 1").select("rep", "n", "level", "x"))
    # a set meets its own length partition and the next: the join key holds the partition
    left = prefix.select("rep", "n", "x", F.explode(F.array("level", F.col("level") + 1)).alias("level"))
    a, b = left.alias("a"), prefix.alias("b")
    near = (a.join(b, ["x", "level"])
            .filter("a.n < b.n or (a.n = b.n and a.rep < b.rep)").filter(F.col("a.n") >= F.col("b.n") * threshold - 1e-9)
            .select(F.col("a.rep").alias("p"), F.col("b.rep").alias("q")).distinct())
    l, r = reps.select(F.col("rep").alias("p"), F.col("sigs").alias("ps")), reps.select(F.col("rep").alias("q"), F.col("sigs").alias("qs"))
    return (near.join(l, "p").join(r, "q").withColumn("likeness", likeness(F.col("ps"), F.col("qs")))
            .filter(F.col("likeness") >= threshold - 1e-9)
            .select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "likeness"))


def representatives(sets: DataFrame, doc_id: str, sigs: str) -> DataFrame:
    """(doc_id, rep, sigs): the smallest id among documents with the same set."""
    one = sets.select(F.col(q(doc_id)).alias("doc_id"), F.col(q(sigs)).alias("sigs"))
    smallest = one.groupBy("sigs").agg(F.min("doc_id").alias("rep"))
    return one.join(smallest, "sigs")


def with_next(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, Window]:
    """Rows (doc_id, text) with ``_next``, the text that follows in descending
    doc_id (nulls last, ties by text), after the last the first; and a window
    in which rows stand in that order, to look at further columns of the next
    row without another shuffle. Rows with ``_own`` false stand only for
    the first row of the following range and are to be dropped at the end.

    Ids are dealt to ranges by quantiles (their number follows the shuffle
    partitions, not the data), so no task holds the whole order; the first row of
    each range is sent to the range before as well."""
    spark = docs.sparkSession
    one = docs.select(F.col(q(doc_id)).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    n = BUCKETS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = one.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 100 * n)).first()[0] or []
    cuts = sorted(set(cuts))
    # range 0 holds the largest ids; equal ids always share a range, nulls come last
    bucket = F.when(F.col("doc_id").isNull(), F.lit(len(cuts) + 1)).otherwise(
        F.lit(len(cuts)) - _below(F.col("doc_id"), cuts))
    rows = one.withColumn("_b", bucket.cast("int")).withColumn("_k", F.xxhash64("text"))
    # one row per range: the largest id (~x falls as x rises, also for the smallest long) and, for ties, the smallest text hash
    falling = F.bitwise_not(F.col("doc_id"))
    tops = rows.groupBy("_b").agg(F.min(F.struct(falling.alias("d"), F.col("_k"))).alias("top")).orderBy("_b").collect()
    after = {r[0]: tops[i - 1][0] for i, r in enumerate(tops)}       # range -> the range before it, round the end
    tip = F.create_map(*[F.lit(x) for r in tops for x in (r[0], r[1][1])]) if tops else None
    big = F.create_map(*[F.lit(x) for r in tops for x in (r[0], r[1][0])]) if tops else None
    if not tops:
        return rows.select("doc_id", "text", "_b", "_k", F.lit(True).alias("_own"), F.lit("").alias("_next")), Window.partitionBy("_b").orderBy("_k")
    before = F.create_map(*[F.lit(x) for k, v in after.items() for x in (k, v)])
    first = (F.col("_k") == tip[F.col("_b")]) & falling.eqNullSafe(big[F.col("_b")])
    to = F.when(first, F.array(F.struct(F.col("_b").alias("b"), F.lit(True).alias("own")),
                               F.struct(before[F.col("_b")].alias("b"), F.lit(False).alias("own")))).otherwise(
        F.array(F.struct(F.col("_b").alias("b"), F.lit(True).alias("own"))))
    dealt = rows.withColumn("_to", F.explode(to)).select(
        "doc_id", "text", "_k", F.col("_to.b").alias("_b"), F.col("_to.own").alias("_own"))
    w = Window.partitionBy("_b").orderBy(F.col("_own").desc(), F.col("doc_id").desc_nulls_last(), "_k")
    return dealt.withColumn("_next", F.lead("text").over(w)), w


def _below(x: Column, cuts: list[int]) -> Column:
    """How many cuts are at most x: a binary tree of comparisons."""
    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(x < F.lit(cuts[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))
    return tree(0, len(cuts))


def op5_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, with their likeness. Null texts
    count as empty; documents of equal id follow each other by the hash of their text, null ids come last; repeated rows
    each have a row, and follow each other; a single document is followed by itself; an empty table gives an empty result."""
    rows, w = with_next(table(spark, sf_dir, "documents"), "doc_id", "text")
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    both = (rows.withColumn("_edited", F.concat(F.substring("text", F.lit(1), n - third), F.substring("_next", F.lit(1), third)))
            .withColumn("_s", signatures(F.col("text"))).withColumn("_ns", F.lead("_s").over(w))
            .filter("_own").withColumn("_e", signatures(F.col("_edited"))))
    return both.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2("_edited", 256).alias("edited_sha256"),
        fingerprint(F.col("_s")).alias("fingerprint"), fingerprint(F.col("_e")).alias("edited_fingerprint"),
        likeness(F.col("_s"), F.col("_e")).alias("near_edited"),
        likeness(F.col("_s"), F.col("_ns")).alias("near_next"))
