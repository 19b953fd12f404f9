"""Model fitting with Spark ML.

Gradient-boosted trees, k-means and PCA are Spark ML estimators: every
iteration is a distributed pass over a cached vector table. Restarts and
search candidates are independent fits, submitted from a small thread pool
so the cluster runs them side by side (the same idea as CrossValidator's
``parallelism``). Nothing row-sized reaches the driver: only model
parameters (trees, centers, components) and metric scalars.
"""

from __future__ import annotations

import hashlib
import json
import math
import random
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import q
from . import kmeans as km
from . import segment as sg
from .encode import split_hash

# ------------------------------------------------------------- features


def _session() -> SparkSession:
    return SparkSession.getActiveSession()



def vectorize(df: DataFrame, cols: list[str], keep: list[str], out: str = "features"
              ) -> DataFrame:
    """``keep`` columns plus a dense vector of ``cols`` cast to double."""
    casted = df.select(*[F.col(q(c)) for c in keep],
                       *[F.col(q(c)).cast("double").alias(f"_f{i}") for i, c in enumerate(cols)])
    va = VectorAssembler(inputCols=[f"_f{i}" for i in range(len(cols))], outputCol=out,
                         handleInvalid="keep")
    return va.transform(casted).select(*keep, out)


# ------------------------------------------------------------- G1-G4

# Default boosted-tree parameters and the search space.
DEFAULT_GBT = dict(max_depth=6, learning_rate=0.1, n_estimators=200, subsample=0.8,
                   colsample_bytree=0.8, min_child_weight=3, gamma=0.1)
SEARCH_SPACE = dict(max_depth=(3, 10), learning_rate=(0.01, 0.3), n_estimators=(100, 500),
                    subsample=(0.6, 1.0), colsample_bytree=(0.6, 1.0), min_child_weight=(1, 10),
                    gamma=(0.0, 0.5))


def positive_weight(df: DataFrame, label: str = "label") -> float:
    """A12 as a number: negatives / positives (unweighted)."""
    r = df.agg(F.count_if(F.col(label) == 0).alias("neg"),
               F.count_if(F.col(label) == 1).alias("pos")).first()
    return r["neg"] / r["pos"] if r["pos"] else 1.0


def training_weights(df: DataFrame, label: str, weight: str | None, spw: float,
                     out: str = "_w") -> DataFrame:
    """Sample weight times ``spw`` for positives (the positive-class scale)."""
    base = F.col(q(weight)).cast("double") if weight else F.lit(1.0)
    return df.withColumn(out, base * F.when(F.col(label) == 1, F.lit(float(spw)))
                         .otherwise(F.lit(1.0)))


#: Rows that a task of a boosting pass reads, about.
TASK_ROWS = 250_000


def fit_tasks(rows: int) -> int:
    """Partitions of a training table: they follow its rows alone. Fewer cost a large
    table whole waves of idle cores, more cost a small one a task start per pass."""
    return max(1, math.ceil(rows / TASK_ROWS))


def gbt_estimator(params: dict, seed: int = 42, total_weight: float | None = None,
                  label: str = "label", features: str = "features", weight: str = "_w"
                  ) -> GBTClassifier:
    """Map boosted-tree parameters onto Spark's GBTClassifier. Mapping is
    approximate where the learners differ: column sampling is per node,
    min_child_weight becomes a fraction of the total weight, gamma the
    minimum gain. Node ids are not cached: a row finds its node in at most
    ``max_depth`` comparisons, a cached id is an object per row and level, and
    each pass would read the sampled rows twice. The trees are the same."""
    p = {**DEFAULT_GBT, **params}
    frac = min(0.49, p["min_child_weight"] / total_weight) if total_weight else 0.0
    return GBTClassifier(
        labelCol=label, featuresCol=features, weightCol=weight, seed=seed,
        maxDepth=int(min(p["max_depth"], 30)), stepSize=float(p["learning_rate"]),
        maxIter=int(p["n_estimators"]), subsamplingRate=float(p["subsample"]),
        featureSubsetStrategy=str(float(p["colsample_bytree"])),
        minWeightFractionPerNode=float(frac), minInfoGain=float(p["gamma"]),
        lossType="logistic", maxBins=64, cacheNodeIds=False, checkpointInterval=10)


@dataclass
class BoostedModel:
    model: GBTClassificationModel
    feature_names: list[str]
    scale_pos_weight: float
    params: dict = field(default_factory=dict)


def fit_boosted_trees(train: DataFrame, feature_cols: list[str], label: str = "label",
                      weight: str | None = "weight", params: dict | None = None,
                      seed: int = 42) -> BoostedModel:
    """G1: boosted trees on the training table with positive-class scaling. The
    table itself is not cached: the estimator reads it a few times and keeps binned
    rows, which need the memory through all trees."""
    spw = positive_weight(train, label)
    keep = [label] + ([weight] if weight else [])
    sums = training_weights(train.select(*[F.col(q(c)) for c in keep]), label, weight, spw).agg(
        F.sum("_w").alias("w"), F.count("*").alias("n")).first()
    tasks = fit_tasks(sums["n"])
    rows = train.repartition(tasks) if tasks > 1 else train
    data = training_weights(vectorize(rows, feature_cols, keep), label, weight, spw)
    est = gbt_estimator(params or {}, seed, sums["w"], label)
    model = est.fit(data)
    return BoostedModel(model, feature_cols, spw, {**DEFAULT_GBT, **(params or {})})


def score(bm: BoostedModel, df: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns + score = P(class 1)."""
    vec = vectorize(df, bm.feature_names, keep)
    out = bm.model.transform(vec)
    return out.select(*keep, vector_to_array("probability")[1].alias("score"))


def model_trees(bm: BoostedModel) -> DataFrame:
    """G1 summary as a table: one row per tree (index, weight, nodes, depth)."""
    m = bm.model
    rows = [(i, float(w), int(t.numNodes), int(t.depth))
            for i, (w, t) in enumerate(zip(m.treeWeights, m.trees))]
    return _session().createDataFrame(rows, "tree int, weight double, num_nodes int, depth int")


def feature_importance(bm: BoostedModel, top_n: int | None = 20) -> DataFrame:
    """Normalised importance (sums to 1) per feature, highest first,
    ties in column order; rank 1..n (``top_n`` keeps the first n)."""
    imp = bm.model.featureImportances
    vals = imp.toArray() if hasattr(imp, "toArray") else list(imp)
    rows = [(i, name, float(vals[i])) for i, name in enumerate(bm.feature_names)]
    df = _session().createDataFrame(rows, "position int, feature string, importance double")
    w = Window.orderBy(F.desc("importance"), F.asc("position"))   # one row per feature
    out = df.withColumn("rank", F.row_number().over(w)).drop("position")
    return out.where(F.col("rank") <= top_n) if top_n else out


#: Rows a hash bucket of the fold ranking holds on average, at most.
FOLD_BUCKET_ROWS = 100_000


def stratified_folds(df: DataFrame, label: str = "label", key: str = "person_id",
                     folds: int = 3, seed: int = 42) -> DataFrame:
    """Exact stratified fold ids: rank rows within their class by (hash, key)
    and deal them round-robin to ``folds`` folds. The rank is distributed:
    bucket counts per class give each hash bucket its offset and only rows of
    one (class, bucket) are ranked together. The number of buckets follows
    the number of rows; the folds do not depend on it."""
    n, digits = df.count(), 1
    while n > FOLD_BUCKET_ROWS * 16 ** digits:
        digits += 1
    h = split_hash(key, seed)
    tagged = df.withColumn("_h", h).withColumn("_b", F.substring("_h", 1, digits))
    counts = tagged.groupBy(label, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(label).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select(label, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    j = tagged.join(offs, [label, "_b"])
    rk = F.row_number().over(Window.partitionBy(label, "_b").orderBy("_h", key)) - 1 + F.col("_off")
    return j.withColumn("fold", (rk % folds).cast("int")).drop("_h", "_b", "_off")


def sample_candidates(n: int, seed: int = 42) -> list[dict]:
    """Seeded random draws from the search space (log-uniform learning rate)."""
    rng = random.Random(seed)
    sp = SEARCH_SPACE
    out = []
    for _ in range(n):
        lo, hi = sp["learning_rate"]
        out.append(dict(
            max_depth=rng.randint(*sp["max_depth"]),
            learning_rate=math.exp(rng.uniform(math.log(lo), math.log(hi))),
            n_estimators=rng.randint(*sp["n_estimators"]),
            subsample=rng.uniform(*sp["subsample"]),
            colsample_bytree=rng.uniform(*sp["colsample_bytree"]),
            min_child_weight=rng.randint(*sp["min_child_weight"]),
            gamma=rng.uniform(*sp["gamma"])))
    return out


LEDGER = "run string, candidate int, fold int, f1 double"


def search_run(data: DataFrame, label: str, key: str, feature_cols: list[str], cands: list[dict], folds: int, seed: int) -> str:
    """Name of a search: what its scores follow from (rows, candidates, folds, seed)."""
    r = data.agg(F.count("*").alias("n"), F.sum(F.xxhash64(F.col(q(key)), label, "features", "_w", "fold").cast("decimal(38,0)"))
                 .alias("h")).first()
    said = json.dumps([r["n"], str(r["h"]), feature_cols, cands, folds, seed])
    return hashlib.sha256(said.encode()).hexdigest()


def read_ledger(spark: SparkSession, path: str, run: str) -> dict[tuple[int, int], float]:
    """Scores of a search that the ledger has: (candidate, fold) -> F1. A folder that isn't there is an empty ledger."""
    try:
        rows = spark.read.schema(LEDGER).parquet(path).where(F.col("run") == run).collect()     # candidates x folds
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = []
    return {(r["candidate"], r["fold"]): r["f1"] for r in rows}


def search_params(train: DataFrame, feature_cols: list[str], label: str = "label",
                  weight: str | None = "weight", key: str = "person_id", n_iter: int = 20,
                  folds: int = 3, seed: int = 42, parallelism: int = 4, ledger: str | None = None
                  ) -> tuple[BoostedModel, DataFrame]:
    """Score ``n_iter`` seeded candidates by mean positive-class F1 over
    stratified folds, refit the best on the whole training table. Returns
    the refit model and the candidate table.

    ``ledger``: a folder (shared, Parquet) that gets a row per finished fit, so that a search whose driver is
    lost goes on where it was: fits that it holds for the same rows, candidates, folds and seed
    are read, not run. Other searches may share the folder."""
    spark = train.sparkSession
    spw = positive_weight(train, label)
    keep = [label, key] + ([weight] if weight else [])
    data = stratified_folds(training_weights(train, label, weight, spw), label, key, folds, seed)
    # the fits run side by side: few tasks each, not a wave of small ones per level and tree
    data = vectorize(data, feature_cols, keep + ["_w", "fold"]).coalesce(fit_tasks(train.count())).cache()
    total = data.agg(F.sum("_w")).first()[0]
    evaluator = MulticlassClassificationEvaluator(labelCol=label, predictionCol="prediction",
                                                  metricName="fMeasureByLabel", metricLabel=1.0)
    cands = sample_candidates(n_iter, seed)
    run = search_run(data, label, key, feature_cols, cands, folds, seed) if ledger else ""
    known = read_ledger(spark, ledger, run) if ledger else {}

    def fit(idx_fold):
        idx, f = idx_fold
        tr = data.where(F.col("fold") != f)
        te = data.where(F.col("fold") == f)
        m = gbt_estimator(cands[idx], seed, total * (folds - 1) / folds, label).fit(tr)
        f1 = float(evaluator.evaluate(m.transform(te)))
        if ledger:
            spark.createDataFrame([(run, idx, f, f1)], LEDGER).coalesce(1).write.mode("append").parquet(ledger)
        return (idx, f), f1

    jobs = [(i, f) for i in range(len(cands)) for f in range(folds) if (i, f) not in known]
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        known |= dict(pool.map(fit, jobs))
    data.unpersist()
    scores = {i: [known[i, f] for f in range(folds)] for i in range(len(cands))}
    rows = [(i, *[float(cands[i][k]) for k in SEARCH_SPACE], float(sum(v) / len(v)))
            for i, v in sorted(scores.items())]
    table = spark.createDataFrame(rows, "candidate int, " + ", ".join(
        f"{k} double" for k in SEARCH_SPACE) + ", mean_f1 double")
    best = max(scores, key=lambda i: (sum(scores[i]) / len(scores[i]), -i))
    bm = fit_boosted_trees(train, feature_cols, label, weight, cands[best], seed)
    return bm, table.withColumn("best", F.col("candidate") == F.lit(best))


# ------------------------------------------------------------- K1, K7, K11, K13


@dataclass
class Segmenter:
    model: KMeansModel
    k: int
    inertia: float
    iterations: int
    seed: int


#: Bytes of vectors that the k-means fits running side by side hold in memory, together.
FIT_BYTES = 8_000_000_000
#: Bytes of the objects around a vector's numbers in a fit's copy, about.
VECTOR_BYTES = 100


def fits_at_once(vectors: DataFrame, features: str, parallelism: int) -> int:
    """How many fits may run side by side: each keeps its own copy of all vectors in
    memory, and copies that do not fit are read from disk in every pass."""
    first = vectors.select(features).first()
    numbers = len(first[0]) if first and first[0] is not None else 1
    copy = max(1, vectors.count()) * (8 * numbers + VECTOR_BYTES)
    return max(1, min(parallelism, FIT_BYTES // copy))


def fit_kmeans(vectors: DataFrame, k: int = 3, restarts: int = 20, max_iter: int = 300,
               seed: int = 42, parallelism: int = 4, features: str = "features",
               tol: float = 1e-4) -> Segmenter:
    """K1: k-means (k-means|| init) from ``restarts`` seeds, keeping the
    lowest inertia. The vector table should be stored by the caller; up to
    ``parallelism`` fits run side by side, fewer on a table of which so many copies
    would not fit in memory. The fits do not depend on it."""
    def run(s):
        km = KMeans(k=k, seed=s, maxIter=max_iter, tol=tol, featuresCol=features,
                    predictionCol="segment", initMode="k-means||")
        m = km.fit(vectors)
        return m.summary.trainingCost, s, m

    seeds = [seed + i for i in range(restarts)]
    with ThreadPoolExecutor(max_workers=fits_at_once(vectors, features, parallelism)) as pool:
        fits = list(pool.map(run, seeds))
    cost, s, m = min(fits, key=lambda t: (t[0], t[1]))
    return Segmenter(m, k, float(cost), int(m.summary.numIter), s)


def segment_assignments(seg: Segmenter, vectors: DataFrame, keep: list[str]) -> DataFrame:
    """Row key(s) -> segment."""
    return seg.model.transform(vectors).select(*keep, F.col("segment").cast("int"))


def kmeans_summary(seg: Segmenter, vectors: DataFrame) -> DataFrame:
    """K1 report: one row per segment with its size and share, plus the
    run's inertia, iterations and the winning seed."""
    sizes = seg.model.transform(vectors).groupBy(F.col("segment").cast("int").alias("segment")) \
        .agg(F.count("*").alias("size"))
    total = F.sum("size").over(Window.partitionBy())    # k rows
    return sizes.select("segment", "size", (F.col("size") / total * F.lit(100.0)).alias("percentage"),
                        F.lit(seg.inertia).alias("inertia"),
                        F.lit(seg.iterations).alias("iterations"), F.lit(seg.seed).alias("seed"))


def k_sweep(vectors: DataFrame, ks=(3,), restarts: int = 10, seed: int = 42,
            features: str = "features") -> DataFrame:
    """K7: per k -- inertia, silhouette (squared Euclidean), Calinski-Harabasz,
    Davies-Bouldin; ``selected`` marks the highest silhouette. All fits of all k share their
    passes over the vectors."""
    ks = [int(k) for k in ks]
    points = km.packed(vectors, features)
    fits = km.fits(points, list(dict.fromkeys(ks)), [seed + i for i in range(restarts)])
    rows = []
    for k in ks:
        fit = min((f for f in fits if f.k == k), key=lambda f: (f.inertia, f.seed))
        labelled = km.labelled(points, fit)
        stats = sg.cluster_stats(labelled, "x", "segment")
        sil = sg.silhouette_sq(labelled, stats, "x", "segment").first()[0]
        ch = sg.calinski_harabasz(stats).first()[0]
        db = sg.davies_bouldin(labelled, stats, "x", "segment").first()[0]
        rows.append((k, fit.inertia, float(sil), float(ch), float(db)))
    points.blocks.unpersist()
    df = _session().createDataFrame(rows, "n_clusters int, inertia double, silhouette double, "
                                 "calinski_harabasz double, davies_bouldin double")
    best = max(rows, key=lambda r: (r[2], -r[0]))[0]
    return df.withColumn("selected", F.col("n_clusters") == F.lit(best))


def pca_project(vectors: DataFrame, keep: list[str], k: int = 2, features: str = "features"
                ) -> DataFrame:
    """The data centred, projected on its first ``k`` principal
    components (signs are arbitrary), with the explained-variance ratios."""
    arr = vectors.select(*keep, vector_to_array(features).alias("_x"))
    d = len(vectors.select(features).first()[0])
    means = arr.agg(*[F.avg(F.col("_x")[i]).alias(f"m{i}") for i in range(d)]).first()
    centred = arr.select(*keep, F.array(*[F.col("_x")[i] - F.lit(means[f"m{i}"] or 0.0)
                                          for i in range(d)]).alias("_c"))
    vec = centred.select(*keep, array_to_vector("_c").alias("_v"))
    model = PCA(k=k, inputCol="_v", outputCol="_pc").fit(vec)
    ratios = [float(v) for v in model.explainedVariance]
    out = model.transform(vec).select(*keep, vector_to_array("_pc").alias("_pc"))
    return out.select(*keep, *[F.col("_pc")[i].alias(f"pc{i + 1}") for i in range(k)],
                      *[F.lit(r).alias(f"explained_variance_pc{i + 1}")
                        for i, r in enumerate(ratios)])
