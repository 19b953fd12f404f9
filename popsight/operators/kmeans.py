"""Many k-means fits on one table in shared passes (K7).

A fit from (k, seed) here takes the steps of Spark's ``KMeans`` -- k-means|| with its random numbers, the local
k-means++ over the candidates, Lloyd steps until no center moves by more than ``tol`` -- and ends at the same centers, up
to rounding. But a pass over the points serves all fits at once: one product of the points with all
centers in place of one scan, and one cached copy of the table, per fit.

The points are kept as blocks of a few kilobytes (their rows' numbers side by side), which
Arrow batches hand over without a step per row. A block knows its partition and place, and so the random
numbers that Spark would have drawn for its rows: the generator's state at any row is a product of bit
matrices with its seed. Sums and candidates reach the driver, nothing row-sized.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a block of points, about; a point of more has a block of its own.
BLOCK_BYTES = 8192
#: Points that a task holds distances of at once, about.
CHUNK_ROWS = 1024
#: Steps of k-means|| and of the local k-means++ (Spark's).
INIT_STEPS, LOCAL_STEPS = 2, 30

_MASK = (1 << 64) - 1


# ------------------------------------------------------------- random numbers (Spark's and Java's)


def _int32(v: int) -> int:
    return (v & 0xFFFFFFFF) - ((v & 0x80000000) << 1)


def _hashed(seed: int) -> int:
    """State that Spark's XORShiftRandom starts from: two murmur hashes of the seed's bytes."""
    def murmur(data: bytes, h: int) -> int:
        for i in range(0, 8, 4):
            k = int.from_bytes(data[i:i + 4], "little") * 0xCC9E2D51 & 0xFFFFFFFF
            k = ((k << 15 | k >> 17) & 0xFFFFFFFF) * 0x1B873593 & 0xFFFFFFFF
            h ^= k
            h = ((h << 13 | h >> 19) & 0xFFFFFFFF) * 5 + 0xE6546B64 & 0xFFFFFFFF
        h ^= 8
        h = (h ^ h >> 16) * 0x85EBCA6B & 0xFFFFFFFF
        h = (h ^ h >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
        return h ^ h >> 16

    data = (seed & _MASK).to_bytes(8, "big")
    low = murmur(data, 0x3C074A61)
    return murmur(data, low) << 32 | low


def _next(s: int) -> int:
    s ^= s << 21 & _MASK
    s ^= s >> 35
    return s ^ s << 4 & _MASK


class _XorShift:
    def __init__(self, seed: int):
        self.state = _hashed(seed)

    def bits(self, n: int) -> int:
        self.state = _next(self.state)
        return self.state & (1 << n) - 1

    def double(self) -> float:
        return ((self.bits(26) << 27) + self.bits(27)) * 2.0 ** -53


class _JavaRandom:
    def __init__(self, seed: int):
        self.state = (seed ^ 0x5DEECE66D) & (1 << 48) - 1

    def bits(self, n: int) -> int:
        self.state = self.state * 0x5DEECE66D + 0xB & (1 << 48) - 1
        return _int32(self.state >> 48 - n)

    def long(self) -> int:
        return (self.bits(32) << 32) + self.bits(32)

    def double(self) -> float:
        return ((self.bits(26) << 27) + self.bits(27)) * 2.0 ** -53

    def below(self, n: int) -> int:
        if n & -n == n:
            return n * self.bits(31) >> 31
        while True:
            u = self.bits(31)
            if u - u % n + n - 1 < 1 << 31:
                return u % n


def _drawer(starts: dict[int, np.ndarray]) -> tuple[Callable, Callable]:
    """For workers: generators started at ``starts`` (partition -> a state per seed) give a number to each row of a partition.
    (partition, first row of each block) -> the blocks' states; (states, rows of each block) -> numbers, points x seeds."""
    one, low, high = np.uint64(1), np.uint64((1 << 27) - 1), np.uint64((1 << 26) - 1)

    def after(s: np.ndarray) -> np.ndarray:
        s = s ^ s << np.uint64(21)
        s = s ^ s >> np.uint64(35)
        return s ^ s << np.uint64(4)

    def applied(images: np.ndarray, s: np.ndarray) -> np.ndarray:
        out = np.zeros_like(s)
        for i in range(64):
            out ^= (s >> np.uint64(i) & one) * images[i]
        return out

    jumps = [after(after(one << np.arange(64, dtype=np.uint64)))]      # images of the 64 bits under 2 ** i rows' steps, two states a row
    for _ in range(39):
        jumps.append(applied(jumps[-1], jumps[-1]))

    def states(part: np.ndarray, at: np.ndarray) -> np.ndarray:
        s = np.array([starts[p] for p in part.tolist()])
        for i, images in enumerate(jumps):
            moved = (at >> i & 1).astype(bool)
            if moved.any():
                s[moved] = applied(images, s[moved])
        return s

    def drawn(s: np.ndarray, n: np.ndarray) -> np.ndarray:
        out = np.empty((len(n), int(n.max()), s.shape[1]))
        for r in range(out.shape[1]):
            t = after(s)
            s = after(t)
            out[:, r] = ((t & high) << np.uint64(27)) + (s & low)
        return out[np.arange(out.shape[1])[None] < n[:, None]] * 2.0 ** -53

    return states, drawn


def _first_row(counts: dict[int, int], seed: int) -> tuple[int, int]:
    """(partition, row) that ``RDD.takeSample(False, 1, seed)`` takes from partitions of so many rows."""
    total, rand = sum(counts.values()), _JavaRandom(seed)
    parts = range(max(counts) + 1)
    if total <= 1:
        return next((p, 0) for p in parts if counts.get(p))
    gamma = -math.log(1e-4) / total
    share = min(1.0, max(1e-10, 1 / total + gamma + math.sqrt(gamma * gamma + 2 * gamma / total)))

    def rows(n: int, rng: _XorShift) -> Iterator[int]:
        if share >= 1.0:
            yield from range(n)
        elif share > 0.4:
            yield from (i for i in range(n) if rng.double() <= share)
        else:
            at, lnq = 0, math.log1p(-share)
            while (at := at + int(math.log(max(rng.double(), 5e-11)) / lnq)) < n:
                yield at
                at += 1

    taken: list[tuple[int, int]] = []
    while not taken:
        each = _JavaRandom(rand.bits(32))
        seeds = [each.long() for _ in parts]
        taken = [(p, i) for p in parts for i in rows(counts.get(p, 0), _XorShift(seeds[p]))]
    for i in range(len(taken) - 1, 0, -1):
        j = rand.below(i + 1)
        taken[i], taken[j] = taken[j], taken[i]
    return taken[0]


# ------------------------------------------------------------- points as blocks


@dataclass
class Points:
    blocks: DataFrame           # _part, _at (first row), _n, _x (rows of doubles)
    counts: dict[int, int]      # rows per partition
    width: int


def packed(vectors: DataFrame, features: str) -> Points:
    """The vectors as blocks, in memory or beside it until ``blocks`` is unpersisted. As in Spark's fit, a missing vector, NaN and infinity are errors."""
    rows = vectors.select(vector_to_array(F.col(features)).alias("_x"))
    top = BLOCK_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            x = batch.column("_x")
            if x.null_count:
                raise ValueError("Vectors MUST NOT be Null")
            n = batch.num_rows
            if not n:
                continue
            x = x.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            if not np.isfinite(x).all():
                raise ValueError("Vector values MUST NOT be NaN or Infinity")
            step = max(1, top // max(1, 8 * x.shape[1]))
            cuts = range(0, n, step)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(cuts), pa.int32()), pa.array([at + i for i in cuts], pa.int64()),
                 pa.array([min(step, n - i) for i in cuts], pa.int32()), pa.array([x[i:i + step].tobytes() for i in cuts], pa.binary())],
                ["_part", "_at", "_n", "_x"])
            at += n

    blocks = rows.mapInArrow(run, "_part int, _at long, _n int, _x binary").persist()
    per = blocks.groupBy("_part").agg(F.sum("_n").alias("n"), F.max(F.length("_x") / F.col("_n")).alias("b")).collect()    # partitions
    return Points(blocks, {r["_part"]: r["n"] for r in per}, int(max((r["b"] for r in per), default=0)) // 8)


def _cutter(width: int) -> Callable:
    """For workers: batches of blocks -> (partition, first row and rows of each block, the blocks' points), a chunk at a time."""
    most = CHUNK_ROWS

    def chunks(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            part, at, n = (batch.column(c).to_numpy() for c in ("_part", "_at", "_n"))
            blobs, start = batch.column("_x"), 0
            while start < len(n):
                stop = start + max(1, int(np.searchsorted(np.cumsum(n[start:start + most]), most, "right")))
                x = np.frombuffer(b"".join(blobs.slice(start, stop - start).to_pylist()), float).reshape(-1, width)
                yield part[start:stop], at[start:stop], n[start:stop], x
                start = stop

    return chunks


def _nearer() -> Callable:
    """For workers: (sets of centers: sets x k x d, points with a column of ones) -> the squared distance to each set's nearest
    center without the point's own square, and which center it is (1 for it, 0 for others; of equals the first)."""

    def nearest(c: np.ndarray, one: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sets, k, d = c.shape
        to = (np.concatenate([-2.0 * c, (c ** 2).sum(2, keepdims=True)], 2).reshape(-1, d + 1) @ one.T).reshape(sets, k, -1)
        least = to.min(1)
        own = to == least[:, None]
        if np.count_nonzero(own) != least.size:
            for i in np.flatnonzero(own.sum((1, 2)) != len(one)):
                own[i] = np.arange(k)[:, None] == to[i].argmin(0)
        return least, own.astype(float)

    return nearest


def _totals(points: Points, size: int, add: Callable) -> np.ndarray:
    """One pass: ``add(x, out)`` adds what a chunk of points gives to ``out`` (``size`` numbers); the sum over all."""
    chunks = _cutter(points.width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(size)
        for _, _, _, x in chunks(batches):
            add(x, out)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([out.tobytes()], pa.binary())], ["p", "s"])

    got = sorted(points.blocks.mapInArrow(run, "p int, s binary").collect())           # one row per task
    return np.sum([np.frombuffer(r["s"], float) for r in got], axis=0) if got else np.zeros(size)


# ------------------------------------------------------------- k-means||


def _distinct(vectors: list[np.ndarray]) -> np.ndarray:
    seen: dict = {}
    for v in vectors:
        seen.setdefault(tuple(v + 0.0), v)
    return np.array(list(seen.values()))


def _candidates(points: Points, ks: list[int], seeds: list[int]) -> dict[tuple[int, int], np.ndarray]:
    """Candidates of k-means|| per (k, seed), in Spark's order. A seed draws the same numbers for every k."""
    width, chunks = points.width, _cutter(points.width)
    draws = [_int32(_XorShift(s).bits(32)) for s in seeds]
    first = [_first_row(points.counts, d) for d in draws]
    asked = F.lit(False)
    for p, i in set(first):
        asked |= (F.col("_part") == p) & (F.col("_at") <= i) & (F.col("_at") + F.col("_n") > i)
    found = {(r["_part"], r["_at"] + j): v for r in points.blocks.where(asked).collect()                   # a block per seed
             for j, v in enumerate(np.frombuffer(r["_x"], float).reshape(-1, width))}
    lists = {(k, i): [found[f]] for i, f in enumerate(first) for k in ks}

    for step in range(INIT_STEPS):
        have = {f: _distinct(v) for f, v in lists.items()}
        pools = [_distinct([v for k in ks for v in have[k, i]]) for i in range(len(seeds))]      # a seed's centers, each once
        places = [{tuple(v + 0.0): j for j, v in enumerate(pool)} for pool in pools]
        picks = []                                    # per seed and k: whether it has all that the k before has; what else it has
        for i in range(len(seeds)):
            own = [[places[i][tuple(v + 0.0)] for v in have[k, i]] for k in ks]
            picks.append([(on := j > 0 and set(own[j - 1]) <= set(own[j]), sorted(set(own[j]) - set(own[j - 1] if on else ()))) for j in range(len(ks))])

        def costs(x: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
            square, one = (x ** 2).sum(1), np.column_stack([x, np.ones(len(x))])
            for i, pool in enumerate(pools):
                to = np.column_stack([-2.0 * pool, (pool ** 2).sum(1)]) @ one.T
                for j, (on, new) in enumerate(picks[i]):
                    if not on:
                        least = np.full(len(x), np.inf)
                    if new or not on:
                        least = np.minimum(least, to[new].min(0))
                        cost = square + least
                        cost[cost < 1e-12 * square] = 0.0                   # nothing but rounding
                    yield i, j, cost

        def add(x: np.ndarray, out: np.ndarray) -> None:
            for i, j, cost in costs(x):
                out[i * len(ks) + j] += cost.sum()

        total = _totals(points, len(seeds) * len(ks), add).reshape(len(seeds), len(ks))
        states, drawn = _drawer({p: np.array([_hashed(_int32(d ^ step << 16 ^ p)) for d in draws], np.uint64) for p in points.counts})

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for some in (batch.slice(b, 256) for batch in batches for b in range(0, batch.num_rows, 256)):
                u, done = drawn(states(some.column("_part").to_numpy(), some.column("_at").to_numpy()), some.column("_n").to_numpy()), 0
                for part, at, n, x in chunks([some]):
                    mine = u[done:done + len(x)]
                    done += len(x)
                    rows = np.concatenate([np.arange(a, a + m) for a, m in zip(at, n)])
                    where = np.repeat(part, n)
                    for i, j, cost in costs(x):
                        hit = np.flatnonzero(mine[:, i] < 2.0 * cost * ks[j] / total[i, j]) if total[i, j] > 0 else ()
                        if not len(hit):
                            continue
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(hit), i), pa.int32()), pa.array(np.full(len(hit), ks[j]), pa.int32()), pa.array(where[hit], pa.int32()),
                             pa.array(rows[hit], pa.int64()), pa.array([v.tobytes() for v in x[hit]], pa.binary())], ["i", "k", "part", "at", "x"])

        got = points.blocks.mapInArrow(choose, "i int, k int, part int, at long, x binary").collect()     # about 2k per fit
        for r in sorted(got, key=lambda r: (r["part"], r["at"])):
            lists[r["k"], r["i"]].append(np.frombuffer(r["x"], float))
    return {(k, seeds[i]): _distinct(v) for (k, i), v in lists.items()}


def _local(points: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """Spark's weighted k-means++ over the candidates, and its Lloyd steps, with its random numbers (seed 0)."""
    rand = _JavaRandom(0)

    def reached(parts: np.ndarray, r: float) -> int:
        j, so_far = 0, 0.0
        while j < len(parts) and so_far < r:
            so_far += parts[j]
            j += 1
        return max(0, j - 1)

    def to(c: np.ndarray) -> np.ndarray:
        return ((points - c) ** 2).sum(1)

    centers = [points[reached(weights, rand.double() * sum(weights.tolist()))]]
    cost = to(centers[0])
    for _ in range(1, k):
        parts = cost * weights
        centers.append(points[reached(parts, rand.double() * sum(parts.tolist()))])
        cost = np.minimum(cost, to(centers[-1]))
    c, before = np.array(centers), np.full(len(points), -1)
    for _ in range(LOCAL_STEPS):
        own = np.array([to(m) for m in c]).argmin(0)
        for j in range(k):
            mine = own == j
            c[j] = (points[mine] * weights[mine, None]).sum(0) / weights[mine].sum() if weights[mine].any() else points[rand.below(len(points))]
        if (own == before).all():
            break
        before = own
    return c


# ------------------------------------------------------------- fits


@dataclass
class Fit:
    k: int
    seed: int
    centers: np.ndarray
    inertia: float = 0.0
    iterations: int = 0


def fits(points: Points, ks: list[int], seeds: list[int], max_iter: int = 300, tol: float = 1e-4) -> list[Fit]:
    """The fits of every k from every seed. ``inertia`` is, as in Spark, that of the centers before the last step."""
    if not points.counts:
        raise ValueError("No samples available")
    width, nearest = points.width, _nearer()
    found = _candidates(points, ks, seeds)
    many = {f: c for f, c in found.items() if len(c) > f[0]}
    sets = list(many.values())
    ends = np.cumsum([0] + [len(c) for c in sets])

    def count(x: np.ndarray, out: np.ndarray) -> None:
        one = np.column_stack([x, np.ones(len(x))])
        for c, a, b in zip(sets, ends, ends[1:]):
            out[a:b] += nearest(c[None], one)[1][0].sum(1)

    n = _totals(points, int(ends[-1]), count) if many else None
    starts = found | {f: _local(c, n[a:b], f[0]) for (f, c), a, b in zip(many.items(), ends, ends[1:])}
    out = [Fit(k, s, starts[k, s]) for k in ks for s in seeds]

    busy = out if max_iter else []
    while busy:
        groups: dict[int, list[Fit]] = {}
        for f in busy:
            groups.setdefault(len(f.centers), []).append(f)
        stacks = [np.array([f.centers for f in g]) for g in groups.values()]
        sizes = [len(c) * (c.shape[1] * (width + 1) + 1) for c in stacks]
        at = np.cumsum([0] + sizes)

        def add(x: np.ndarray, out: np.ndarray) -> None:
            square, one = (x ** 2).sum(1), np.column_stack([x, np.ones(len(x))])
            for c, a, b in zip(stacks, at, at[1:]):
                least, own = nearest(c, one)
                cost = square + least
                cost[cost < 1e-12 * square] = 0.0                 # nothing but rounding
                part = out[a:b].reshape(len(c), -1)
                part[:, 0] += cost.sum(1)
                part[:, 1:] += (own.reshape(-1, len(x)) @ one).reshape(len(c), -1)

        sums = _totals(points, int(at[-1]), add)
        still = []
        for g, a, b in zip(groups.values(), at, at[1:]):
            for f, part in zip(g, sums[a:b].reshape(len(g), -1)):
                s = part[1:].reshape(len(f.centers), width + 1)
                filled = s[:, -1] > 0
                new = np.where(filled[:, None], s[:, :-1] * (1.0 / np.where(filled, s[:, -1], 1.0))[:, None], f.centers)
                moved = (((new - f.centers) ** 2).sum(1) > tol * tol).any()
                f.centers, f.inertia, f.iterations = new, float(part[0]), f.iterations + 1
                if moved and f.iterations < max_iter:
                    still.append(f)
        busy = still
    return out


def labelled(points: Points, fit: Fit, out: str = "segment") -> DataFrame:
    """All points (x: array<double>) with their nearest center."""
    chunks, width, c, square = _cutter(points.width), points.width, fit.centers, (fit.centers ** 2).sum(1)[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, x in chunks(batches):
            rows = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * width, pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([rows, pa.array((square - 2 * (c @ x.T)).argmin(0), pa.int32())], ["x", out])

    return points.blocks.mapInArrow(run, f"x array<double>, {out} int")
