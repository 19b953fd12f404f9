"""Toxicity: boosted trees over dense features, calibrated by isotonic regression.

Features of a text: densities of a fixed and of a learned lexicon (also after
undoing common letter substitutions), distinct hits, hits near a second-person
word, capitals, shouted words, punctuation, exclamation and obfuscation
rates, and length. The learned lexicon is every word that is significantly more frequent in
the toxic fitting rows. Features the trees see are made with words learned from other
rows, and the isotonic curve is fitted on scores of trees that saw other rows.

Fitting uses a bounded sample of labelled rows (``MAX_FIT``, a parameter; taken in
hash order). Features and scores cover every row: features are
an Arrow UDF over whole texts, written once; trees and curve are applied in the JVM.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ship, stored, table

MAX_FIT = 20_000            # labelled rows used to learn lexicon, trees and curve
#: A learned word: toxic texts it is in, and the G statistic against chance (10.83: p < 0.001).
MIN_TOXIC, MIN_G = 3, 10.83
FOLDS = 3                   # parts of the fitting rows, each scored by what the others teach
#: Plain insults and threats; the learned lexicon adds what the labels show.
LEXICON = ("idiot moron stupid dumb loser scum trash worthless pathetic clown filth vermin hate disgusting "
           "shut die kill fool imbecile dumbass bastard bitch asshole freak creep pig rat whiner threat").split()
SECOND_PERSON = frozenset(b"you your yours yourself u ur du dein deine dich dir sie ihr tu toi ton ta te vous votre "
                          b"usted ti tus".split())
_LEET = bytes.maketrans(b"0134578@$!ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"oieastbasiabcdefghijklmnopqrstuvwxyz")
_MARKS = b"\"#%&'()*+,-./:;<=>?[\\]^_`{|}~"
#: Substitutions between letters or at an edge of a word ("!" at its end is punctuation).
_OBFUSCATED = re.compile(rb"[A-Za-z][0-9@$*!]+[A-Za-z]|(?<![0-9A-Za-z@$*!])[0-9@$*!]+[A-Za-z]|[A-Za-z][0-9@$*]+(?![0-9A-Za-z@$*])")
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FEATURES = ("log_words", "fixed", "learned", "n_learned", "distinct", "weight", "undone", "second", "near", "capitals", "shouted",
            "marks", "exclaimed", "obfuscated")


def tokens_of(text: str) -> list[bytes]:
    """The words of a text, in lower case, without punctuation marks; ``@`` and ``$`` stay, as they stand
    for letters. Words are learned and looked up in this form."""
    return text.lower().encode("utf-8", "surrogatepass").translate(None, _MARKS + b"!").split()


def features(text: str, fixed: frozenset, learned: dict[bytes, float]) -> tuple[float, ...]:
    raw = text.encode("utf-8", "surrogatepass")
    low = text.lower().encode("utf-8", "surrogatepass")
    plain = tokens_of(text)
    n = len(plain)
    if not n:
        return (0.0,) * len(FEATURES)
    hits = [i for i, w in enumerate(plain) if w in learned]
    old = sum(1 for w in plain if w in fixed)
    odd = len(_OBFUSCATED.findall(raw))
    undone = 0
    for w, u in zip(low.translate(None, _MARKS).split(), low.translate(_LEET, _MARKS).split()):
        if w != u:
            p = w.replace(b"!", b"")
            if p not in fixed and p not in learned:
                v = w.rstrip(b"!").translate(_LEET)
                undone += u in fixed or u in learned or v in fixed or v in learned
    you = [i for i, w in enumerate(plain) if w in SECOND_PERSON]
    near = 0
    if hits and you:
        close = {j for i in you for j in range(i - 3, i + 4)}
        near = sum(1 for i in hits if i in close)
    upper = len(raw) - len(raw.translate(None, _UPPER))
    shouted = sum(1 for w in raw.split() if len(w) > 2 and w.isupper()) if upper else 0
    return (math.log1p(n), old / n, len(hits) / n, float(len(hits)), float(len({plain[i] for i in hits})),
            sum(learned[plain[i]] for i in hits), undone / n, len(you) / n, float(near),
            upper / len(raw), shouted / n, (len(raw) - len(raw.translate(None, _MARKS))) / len(raw),
            raw.count(b"!") / n, odd / n)


def feature_columns(text: Column, learned: dict[bytes, float]) -> Column:
    """Struct of FEATURES."""
    fixed = frozenset(x.encode() for x in LEXICON)

    @F.pandas_udf(", ".join(f"{c} double" for c in FEATURES))
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([features(t or "", fixed, learned) for t in texts], columns=list(FEATURES), dtype="float64")

    return udf(F.coalesce(text.cast("string"), F.lit("")))


def fold(doc_id: str) -> Column:
    """crc32 of the id as text, modulo 5; fold 0 is held out."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(5))


def learn_lexicons(fit: DataFrame) -> list[dict[bytes, float]]:
    """Word -> log odds, from (text, label, part) of the fitting rows: first learned from all
    of them, then for each of FOLDS parts from the rows outside it. A word enters when it occurs
    in MIN_TOXIC toxic texts, is at least four times as common there, and its G statistic
    passes MIN_G. None of these grows with the rows, so a word of a small language enters once its own few texts show it."""
    @F.pandas_udf("array<binary>")
    def distinct_tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([sorted(set(tokens_of(t))) for t in texts])

    words = fit.select("label", "part", F.explode(distinct_tokens(F.coalesce("text", F.lit("")))).alias("w"))
    rows = {(r["part"], r["label"]): r["count"] for r in fit.groupBy("part", "label").count().collect()}
    sums = [F.sum(F.when((F.col("part") == k) & (F.col("label") == y), 1).otherwise(0)).alias(f"n{y}_{k}")
            for k in range(FOLDS) for y in (0, 1)]
    counted = words.groupBy("w").agg(*sums)
    odds = []
    for left_out in (None, *range(FOLDS)):
        parts = [k for k in range(FOLDS) if k != left_out]
        good, bad = (sum(rows.get((k, y), 0) for k in parts) for y in (0, 1))
        b, a = (sum((F.col(f"n{y}_{k}") for k in parts), F.lit(0)) for y in (0, 1))
        log_odds = F.log((a + 0.5) / (bad + 1)) - F.log((b + 0.5) / (good + 1))
        g = F.lit(0.0)
        for seen, among in ((a, bad), (b, good)):       # texts with the word and without, against one rate for both labels
            for n, every in ((seen, a + b), (among - seen, bad + good - a - b)):
                g = g + F.when(n > 0, 2 * n * F.log(n * (bad + good) / (every * among))).otherwise(0.0)
        odds.append(F.when((a >= MIN_TOXIC) & (log_odds >= math.log(4)) & (g >= MIN_G), log_odds).alias(f"o{len(odds)}"))
    found = counted.select("w", *odds).filter(F.coalesce(*[F.col(f"o{i}") for i in range(len(odds))]).isNotNull()).collect()
    return [{bytes(r["w"]): float(r[i + 1]) for r in found if r[i + 1] is not None} for i in range(len(odds))]


def fit_rows(docs: DataFrame, labels: DataFrame, max_fit: int = MAX_FIT) -> DataFrame:
    """(doc_id, label) of labelled rows outside the held-out fold, one per document
    (toxic if any label says so), at most ``max_fit`` in hash order."""
    one = (labels.filter("toxic is not null and doc_id is not null").filter(fold("doc_id") != 0)
           .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label")))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_fit)


def score(docs: DataFrame, labels: DataFrame, max_fit: int = MAX_FIT) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``. Null and
    empty texts have all features 0 and are scored like any other. Where
    fewer than two fitting rows hold a label, the score is the rate of toxic rows; without any, 0."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ids = stored(fit_rows(docs, labels, max_fit), "toxic-fit")
    # at most max_fit rows: a bounded broadcast, so texts aren't shuffled
    sample = stored(docs.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(      # of rows of one id the smallest text
        F.min("text").alias("text"), F.first("label").alias("label")), "toxic-sample")
    held = (fold("doc_id") == 0).alias("held_out")
    counts = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if min(counts.get(0, 0), counts.get(1, 0)) < 2:
        p = F.lit(float(counts.get(1, 0) / max(1, sum(counts.values()))))
        return docs.select("doc_id", held, p.alias("score"), (p >= 0.5).cast("int").alias("predicted"))
    # dealt in turn within a label, so that the rows outside any part hold both
    turn = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id")) % FOLDS
    parts = stored(sample.select("doc_id", turn.alias("part"), "label"), "toxic-parts").drop("label")
    sample = sample.join(F.broadcast(parts), "doc_id")
    learned, *without = learn_lexicons(sample)
    assemble = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    train = stored(reduce(DataFrame.unionByName, [
        sample.filter(F.col("part") == k).select("label", "part", feature_columns(F.col("text"), x).alias("f"))
        for k, x in enumerate(without)]).select("label", "part", "f.*"), "toxic-train")
    vectors = assemble.transform(train).select("label", "part", "features").cache()
    trees = GBTClassifier(labelCol="label", maxIter=20, maxDepth=3, stepSize=0.3, seed=5, subsamplingRate=0.8)

    def raw(fitted: GBTClassificationModel, df: DataFrame) -> DataFrame:
        return fitted.transform(df).withColumn("raw", vector_to_array("probability")[1])

    apart = reduce(DataFrame.unionByName, [raw(trees.fit(vectors.filter(F.col("part") != k)), vectors.filter(F.col("part") == k))
                                           .select("label", "raw") for k in range(FOLDS)])
    curve = IsotonicRegression(labelCol="label", featuresCol="raw", predictionCol="score").fit(apart)
    fitted = trees.fit(vectors)
    vectors.unpersist()
    every = assemble.transform(docs.select("doc_id", feature_columns(F.col("text"), learned).alias("f")).select("doc_id", "f.*"))
    out = curve.transform(raw(fitted, every)).withColumn("score", F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)))
    return out.select("doc_id", held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_boosted_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document."""
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ship(__name__)
