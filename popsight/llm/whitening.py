"""Whitening of embeddings.

Entries become integers, so that counts, sums and deviations are exact.
Spark adds up the vectors, then the products of centred entries: every task
multiplies blocks of its own rows, hands over one row per dimension, and these are
added up dimension by dimension. The driver gets the sums (one row per
dimension) and the covariance (d x d) and works out the leading eigenpairs:

* Householder reflections make the matrix tridiagonal;
* Sturm counts say how many eigenvalues lie below a point; bisection closes in on
  each of the leading ones, to the last bit;
* inverse iteration gives the vectors; those whose eigenvalues lie close together
  (a cluster) are made orthogonal to each other in every step;
* the reflections carry them back.

Components and means go back to the tasks with the code (d x k numbers), which
project their rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import q, ship, stored, table

SCALE, SHIFT = 1024, 100_000       # fixed by the contract: x = floor(1024 * c) + 100000
LARGEST = 2.0 ** 50                # of |1024 * c|: sums of a block of x fit into a long
BLOCK = 4_096                      # rows of a block
CLUSTER = 1e-3                     # eigenvalues closer than this share of the norm are a cluster
EPS = np.finfo(float).eps


# ---------------------------------------------------------------- eigenpairs


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and reflectors of a symmetric matrix (Householder)."""
    a = np.array(matrix, float)
    d, reflectors = len(a), []
    for k in range(d - 2):
        x = a[k + 1:, k]
        norm = np.sqrt((x * x).sum())
        v = x.copy()
        v[0] += norm if x[0] >= 0 else -norm
        length = np.sqrt((v * v).sum())
        if length == 0:
            reflectors.append(np.zeros_like(v))
            continue
        v /= length
        reflectors.append(v)
        block = a[k + 1:, k + 1:]
        p = block @ v
        w = p - (v @ p) * v
        block -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1, k] = a[k, k + 1] = -norm if x[0] >= 0 else norm
    return np.diag(a).copy(), np.diag(a, 1).copy(), reflectors


def below(diagonal: np.ndarray, off: np.ndarray, points: np.ndarray, floor: float) -> np.ndarray:
    """Number of eigenvalues below each point (Sturm count)."""
    q_ = diagonal[0] - points
    count = (q_ < 0).astype(int)
    for i in range(1, len(diagonal)):
        q_ = np.where(np.abs(q_) < floor, -floor, q_)
        q_ = diagonal[i] - points - off[i - 1] ** 2 / q_
        count += q_ < 0
    return count


def leading_values(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, by bisection until an interval has no inside."""
    d = len(diagonal)
    reach = np.concatenate([[0], np.abs(off)]) + np.concatenate([np.abs(off), [0]])
    lo, hi = np.full(k, (diagonal - reach).min()), np.full(k, (diagonal + reach).max())
    size = max(abs(lo[0]), abs(hi[0]), np.finfo(float).tiny)
    lo, hi, floor = lo - 2 * EPS * size, hi + 2 * EPS * size, np.finfo(float).tiny / EPS * max(1.0, size)
    rank = d - 1 - np.arange(k)                                # eigenvalues below the wanted one
    while True:
        mid = (lo + hi) / 2
        open_ = (mid > lo) & (mid < hi)
        if not open_.any():
            return mid
        under = below(diagonal, off, mid, floor) > rank
        lo, hi = np.where(open_ & ~under, mid, lo), np.where(open_ & under, mid, hi)


def solve(diagonal: np.ndarray, off: np.ndarray, shift: float, rhs: np.ndarray, floor: float) -> np.ndarray:
    """x with (T - shift) x = rhs, by elimination with exchange of neighbouring rows."""
    n = len(diagonal)
    u = np.zeros((n, 3))
    y = rhs.astype(float).copy()
    row = [diagonal[0] - shift, off[0] if n > 1 else 0.0, 0.0]
    for i in range(n - 1):
        nxt = [off[i], diagonal[i + 1] - shift, off[i + 1] if i + 2 < n else 0.0]
        if abs(nxt[0]) > abs(row[0]):
            row, nxt = nxt, row
            y[i], y[i + 1] = y[i + 1], y[i]
        if abs(row[0]) < floor:
            row[0] = floor
        f = nxt[0] / row[0]
        u[i] = row
        y[i + 1] -= f * y[i]
        row = [nxt[1] - f * row[1], nxt[2] - f * row[2], 0.0]
    u[n - 1] = [row[0] if abs(row[0]) >= floor else floor, 0.0, 0.0]
    x = np.zeros(n + 2)
    for i in range(n - 1, -1, -1):
        x[i] = (y[i] - u[i, 1] * x[i + 1] - u[i, 2] * x[i + 2]) / u[i, 0]
    return x[:n]


def leading_pairs(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors as columns) of the k largest eigenvalues of a symmetric matrix,
    falling; a vector's largest entry is positive."""
    d = len(matrix)
    k = min(k, d)
    diagonal, off, reflectors = tridiagonal(matrix)
    values = leading_values(diagonal, off, k)
    norm = max(np.abs(diagonal).max() + (2 * np.abs(off).max() if len(off) else 0.0), np.finfo(float).tiny)
    vectors = np.zeros((d, k))
    random = np.random.default_rng(7)
    cluster = 0                                                # first component of the current cluster
    shift = np.inf
    for j in range(k):
        if j and values[j - 1] - values[j] > CLUSTER * norm:
            cluster = j
        shift = min(values[j], shift - 10 * EPS * norm) if j > cluster else values[j]     # equal values get shifts of their own
        x = random.standard_normal(d)
        for _ in range(5):
            x = solve(diagonal, off, shift, x / np.sqrt((x * x).sum()), EPS * norm)
            x /= np.abs(x).max()
            for _ in range(2):
                for i in range(cluster, j):
                    x -= (vectors[:, i] @ x) * vectors[:, i]
        vectors[:, j] = x / np.sqrt((x * x).sum())
    for i in range(len(reflectors) - 1, -1, -1):
        v = reflectors[i]
        vectors[i + 1:] -= 2 * np.outer(v, v @ vectors[i + 1:])
    vectors /= np.sqrt((vectors * vectors).sum(0))
    vectors *= np.where(vectors[np.abs(vectors).argmax(0), np.arange(k)] < 0, -1.0, 1.0)
    values = np.array([v @ matrix @ v for v in vectors.T])
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


# ---------------------------------------------------------------- passes over the rows


def integers(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, int]:
    """Rows (vec_id, x) of the vectors that take part, and their dimension (0: none)."""
    c = F.transform(F.col(q(embedding)), lambda v: F.lit(float(SCALE)) * v.cast("double"))
    whole = F.forall("_c", lambda v: v.isNotNull() & (F.abs(v) < F.lit(LARGEST)))          # false for NaN and infinite entries
    used = (vectors.select(F.col(q(vec_id)).cast("long").alias("vec_id"), c.alias("_c"))
            .filter(F.col("_c").isNotNull() & whole & (F.size("_c") > 0)))
    sizes = used.groupBy(F.size("_c").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    d = sizes[0]["d"] if sizes else 0
    return used.filter(F.size("_c") == d).select(
        "vec_id", F.transform("_c", lambda v: F.floor(v).cast("long") + F.lit(SHIFT).cast("long")).alias("x")), d


def _blocks(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            if part.num_rows:
                yield part, part.column("x").flatten().to_numpy().reshape(-1, d)


def _sums(d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _blocks(batches, d):
            yield pa.RecordBatch.from_arrays([pa.array([part.num_rows]), pa.array([x.sum(0).tolist()], pa.list_(pa.int64()))], ["n", "s"])

    return run


def _centred(x: np.ndarray, base: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """x minus the mean (base + rest, whole and broken part): the difference of integers is exact."""
    return (x - base).astype(float) - rest


def _products(base: np.ndarray, rest: np.ndarray):
    """One row per dimension and task: the task's sums of products of centred entries."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(base)
        total = np.zeros((d, d))
        any_ = False
        for _, x in _blocks(batches, d):
            y = _centred(x, base, rest)
            total += y.T @ y
            any_ = True
        if any_:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), pa.array(total.tolist(), pa.list_(pa.float64()))], ["i", "row"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of equal i added up."""
    got: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, row in zip(batch.column("i").to_pylist(), batch.column("row")):
            row = row.values.to_numpy()
            got[i] = got[i] + row if i in got else row.copy()
    if got:
        yield pa.RecordBatch.from_arrays([pa.array(list(got)), pa.array([r.tolist() for r in got.values()], pa.list_(pa.float64()))], ["i", "row"])


def covariance(rows: DataFrame, d: int) -> tuple[int, list[int], np.ndarray]:
    """(n, exact sums per dimension, covariance with divisor n) of integer vectors x."""
    spark = rows.sparkSession
    parts = rows.mapInArrow(_sums(d), "n long, s array<long>")
    sums = (parts.select("n", F.posexplode("s").alias("i", "s")).groupBy("i")
            .agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect())     # d rows
    if not sums:
        return 0, [], np.zeros((0, 0))
    n, total = sums[0]["n"], [0] * d
    for r in sums:
        total[r["i"]] = int(r["s"])
    base, rest = np.array([s // n for s in total]), np.array([(s % n) / n for s in total])
    tasks = min(d, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    added = (rows.mapInArrow(_products(base, rest), "i long, row array<double>")
             .repartition(tasks, "i").mapInArrow(_added, "i long, row array<double>").collect())            # d rows of d numbers
    v = np.zeros((d, d))
    for r in added:
        v[r["i"]] = r["row"]
    return n, total, (v + v.T) / 2 / n


def _projected(n: int, sums: list[int], axes: np.ndarray):
    base, over = [s // n for s in sums], [s % n for s in sums]
    rest = np.array([r / n for r in over])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(base)
        for part, x in _blocks(batches, d):
            z = x - np.array(base)
            largest = max(abs(int(z.max())), abs(int(z.min()))) * n + n             # of |n * x - S|
            if largest * largest * d < 2 ** 63:
                y = z * n - np.array(over)
                deviation = (y * y).sum(1).tolist()
            else:                                              # Python's integers, which have no largest
                deviation = [sum((int(a) * n - r) ** 2 for a, r in zip(row, over)) for row in z]
                deviation = [v if v < 2 ** 63 else None for v in deviation]
            w = _centred(x, np.array(base), rest) @ axes
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(deviation, pa.int64()),
                                              pa.array(w.tolist(), pa.list_(pa.float64()))], ["vec_id", "deviation", "w"])

    return run


def whiten(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", components: int = 8) -> DataFrame:
    """Rows (vec_id, component, n, deviation, whitened, explained, identity_error), one per
    vector that takes part and component (from 1, falling eigenvalue).

    Vectors that are null or empty or hold null, NaN or infinite entries are left out;
    entries of 2**40 or more count as infinite, since their integers could not be added up
    in a long. Vectors of another length than the most frequent (ties: the longer) are left out. A
    null vec_id is kept. Repeated rows count each time. ``deviation`` is null where it exceeds a long. Components
    whose eigenvalue is nothing but rounding error (constant vectors, fewer vectors than
    components) are left out; no vector or no component gives an empty result. Other
    columns of the input are ignored.
    """
    spark = vectors.sparkSession
    rows, d = integers(vectors, vec_id, embedding)
    schema = ("vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    n, sums, v = covariance(rows, d) if d else (0, [], np.zeros((0, 0)))
    trace = float(np.trace(v))
    if not n or trace <= 0:
        return spark.createDataFrame([], schema)
    values, axes = leading_pairs(v, components)
    k = int((values > 4 * d * EPS * trace).sum())
    axes = axes[:, :k] / np.sqrt(values[:k])
    done = stored(rows.mapInArrow(_projected(n, sums, axes), "vec_id long, deviation long, w array<double>"), "whitened")

    w = [F.col("w")[i] for i in range(k)]
    mean = done.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(w)]).first()
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    cov = done.agg(*[F.avg((w[i] - F.lit(mean[i])) * (w[j] - F.lit(mean[j]))).alias(f"c{i}_{j}") for i, j in pairs]).first()
    error = max(abs(c - (i == j)) for c, (i, j) in zip(cov, pairs))
    share = F.array(*[F.lit(float(e) / trace) for e in values[:k]])
    return done.select("vec_id", "deviation", F.posexplode("w").alias("p", "whitened")).select(
        "vec_id", (F.col("p") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(share, F.col("p")).alias("explained"), F.lit(float(error)).alias("identity_error"))


def op12_covariance_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors of ``embeddings`` on up to 8 components. Which vectors take part, and
    the result for degenerate and empty tables: see ``whiten``."""
    return whiten(table(spark, sf_dir, "embeddings"))


ship(__name__)
