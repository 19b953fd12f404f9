"""Periodic runs of words by string synchronising sets.

At the scale t = 1, 2, 4, ... a position is selected if the hash of the t words
from it or of the t words from t further on is the smallest among the t + 1
windows that start in between. Whether a position is selected follows from the
next 2t words alone, so equal passages select alike; and each t positions in a
row hold a selected one, unless the text there is highly periodic (period t / 4 at
most): such windows are left out, or the selected positions would crowd.

Let a run have the smallest period p, t <= p < 2t, and at least 4p words. It is
not highly periodic at scale t, so a position s among its first t words is
selected; s + p is selected as well, has the same next 2t words, and none
between them has (else the run had a smaller period). So neighbours among the selected
positions of equal context propose p. The highly periodic regions of a
scale are the runs that smaller scales have found: these supply the
small periods that the scale leaves out. Every proposal is extended both ways word by
word; what comes out is exact whatever the hashes, and no run is missed unless
two different windows of a batch share a 64-bit hash.

Spark deals the texts as they are scanned, without a shuffle; a task works on
slices of about ``SLICE`` words. The words of the texts of a slice lie in one array, parted
by marks of their own, so that numpy works on many texts at once.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import q, ship, table

SLICE = 100_000
TIMES, LEAST = 4, 6
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hash of two hashes in order."""
    x = a * _A + (b ^ (b >> np.uint64(31))) * _B
    x ^= x >> np.uint64(29)
    x *= _C
    x ^= x >> np.uint64(32)
    return x


def _agree(words: np.ndarray, i: int, j: int, way: int) -> int:
    """Number of equal words from i and j on, forwards (1) or backwards (-1), i < j."""
    n, step, end = 0, 64, len(words)
    while True:
        m = min(step, end - j - n) if way > 0 else min(step, i + 1 - n)
        if m <= 0:
            return n
        a, b = ((words[i + n:i + n + m], words[j + n:j + n + m]) if way > 0 else
                (words[i - n - m + 1:i - n + 1][::-1], words[j - n - m + 1:j - n + 1][::-1]))
        differ = a != b
        if differ.any():
            return n + int(differ.argmax())
        n += m
        step *= 2


def _primitive(block: np.ndarray) -> bool:
    """Whether a block is no repetition of a shorter one."""
    n, rest, f = len(block), len(block), 2
    while rest > 1:
        if rest % f:
            f += 1 if f * f <= rest else rest - f
            continue
        while rest % f == 0:
            rest //= f
        if (block[n // f:] == block[:n - n // f]).all():
            return False
    return True


def _selected(hashes: np.ndarray, t: int) -> np.ndarray:
    """Positions of the synchronising set; windows left out have the hash _NONE."""
    low, width = hashes, 1
    while width < t:                                           # smallest of t windows in a row, by doubling
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    first, last = hashes[:-t], hashes[t:]
    low = np.minimum(low[:len(last)], last)
    return np.flatnonzero(((low == first) | (low == last)) & (low != _NONE))


def find_runs(words: np.ndarray, lengths: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of 4 periods or more. ``words``: word numbers from 0,
    texts one after the other, longest first, each followed by a negative number of its own;
    ``lengths``: words of each text."""
    found: list[tuple[int, int, int]] = []
    ends = np.cumsum(lengths + 1)
    hashes, t = _pair(words.astype(np.uint64), words.astype(np.uint64)), 1
    while True:
        texts = int(np.searchsorted(-lengths, -TIMES * t, side="right"))      # only those can hold a run of this scale
        if not texts:
            return found
        n = int(ends[texts - 1])
        words, hashes = words[:n], hashes[:n - t + 1]
        context = _pair(hashes[:-t], hashes[t:])
        used = hashes
        periodic = [(s, m) for s, m, p in found if TIMES * p <= t <= m and s + m <= n]
        if periodic:
            used = hashes.copy()
            for s, m in periodic:
                used[s:s + m - t + 1] = _NONE
        at = _selected(used, t)
        order = np.argsort(context[at], kind="stable")
        a, b = at[order[:-1]], at[order[1:]]
        gap = b - a
        ok = (gap >= t) & (gap < 2 * t) & (context[a] == context[b])
        a, gap = a[ok], gap[ok]
        order = np.lexsort((a, gap))
        a, gap = a[order], gap[order]
        k = 0
        while k < len(a):
            s, p = int(a[k]), int(gap[k])
            here = int(np.searchsorted(gap, p, side="right"))
            start = s - _agree(words, s - 1, s - 1 + p, -1) if s else 0
            end = s + p + _agree(words, s, s + p, 1)
            if end - start >= TIMES * p and _primitive(words[start:start + p]):
                found.append((start, end - start, p))
            # proposals that lie in the run just seen say nothing new
            k += 1 + int(np.searchsorted(a[k + 1:here], max(end - p, s + 1)))
        hashes, t = context, 2 * t


def _slices(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[list[tuple]]:
    got, n = [], 0
    for batch in batches:
        for key, text in zip(batch.column(0), batch.column(1)):
            got.append((key.as_py(), (text.as_py() or b"").split()))          # bytes.split(): [\x20\x09-\x0D]+
            n += len(got[-1][1]) + 1
            if n >= words:
                yield got
                got, n = [], 0
    if got:
        yield got


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in _slices(batches, SLICE):
        part.sort(key=lambda x: -len(x[1]))
        lengths = np.array([len(w) for _, w in part], np.int64)
        number = defaultdict(itertools.count().__next__)
        flat = np.empty(int(lengths.sum()) + len(part), np.int64)
        starts = np.cumsum(lengths + 1) - lengths - 1
        for k, (_, w) in enumerate(part):
            flat[starts[k]:starts[k] + len(w)] = np.fromiter(map(number.__getitem__, w), np.int64, len(w))
            flat[starts[k] + len(w)] = -1 - k
        runs: list[list[tuple]] = [[] for _ in part]
        for s, m, p in find_runs(flat, lengths):
            if m >= LEAST:
                k = int(np.searchsorted(starts, s, side="right")) - 1
                runs[k].append((s - int(starts[k]), m, p))
        texts = []
        for (_, w), own in zip(part, runs):
            own.sort(key=lambda r: (r[0], r[2]))
            if own:
                kept = np.ones(len(w), bool)
                for s, m, p in own:
                    kept[s + p:s + m] = False
                w = list(itertools.compress(w, kept))
            texts.append(b" ".join(w))
        each = np.array([r for own in runs for r in own], np.int64).reshape(-1, 3)
        structs = pa.StructArray.from_arrays([pa.array(each[:, i]) for i in range(3)], ["start", "length", "period"])
        offsets = np.cumsum([0] + [len(own) for own in runs])
        yield pa.RecordBatch.from_arrays(
            [pa.array([key for key, _ in part], pa.int64()), pa.array(lengths), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs),
             pa.array(texts, pa.binary())], ["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, n_words, runs, collapsed), one per row of ``docs``.

    ``runs``: (start, length, period) of every run of words, by start and period: a
    longest stretch of consecutive words with the smallest period ``period``, of at least
    4 periods and 6 words. ``collapsed``: the words joined by a space, without those
    that some run holds after its first period. Words are ``[^\\x20\\x09-\\x0D]+``.
    Null and empty texts have no words, no runs and an empty collapsed text;
    repeated rows are treated alike; an empty table gives an empty result; other columns
    are left out. A text is one task's work, in memory proportional to its own length.
    """
    slim = docs.select(F.col(q(doc_id)).cast("long").alias("doc_id"), F.col(q(text)).cast("string").cast("binary").alias("text"))
    out = slim.mapInArrow(_collapse, f"doc_id long, n_words long, runs {RUNS}, collapsed binary")
    return out.withColumn("collapsed", F.col("collapsed").cast("string"))


def with_planted_period(text: Column, doc_id: Column) -> Column:
    """The query's input: with h the CRC-32 of the decimal id and g = floor(h / 10), the text
    of every id with h % 10 = 0 repeats, from word a = g % n on, the p = 1 + floor((n - a) / (3 + g % 8)) words found there.
    A null id leaves its text alone."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), 0)
    g = F.floor(h / 10)

    def repeat(w: Column) -> Column:
        n = F.size(w)
        a = (g % n).cast("int")
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("int")
        return F.concat(F.slice(w, F.lit(1), a), F.transform(
            F.sequence(F.lit(0), n - a - 1), lambda i: F.get(w, (a + i % p).cast("int"))))

    # the lambda names the word list, so that it is made once a text
    planted = F.array_join(F.element_at(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeat(w)).otherwise(w)), 1), " ")
    return F.when(h % 10 == 0, planted).otherwise(text)


def op13_synchronised_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document after the planted change, and digests of the runs and of the
    collapsed text. Nulls, empty and long texts, repeats: see ``periodic_runs``. The longest
    run is the first by start, then period, among those of the greatest length."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", with_planted_period(F.col("text"), F.col("doc_id")).alias("text"))
    best = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct(
        (-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period")))), 1)
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    found = F.size("runs") > 0
    return periodic_runs(docs).withColumn("_b", F.when(found, best)).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("_b.start").alias("start"), (-F.col("_b.l")).alias("length"),
        F.col("_b.period").alias("period"), F.floor(-1000 * F.col("_b.l") / F.col("_b.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.when(found, F.concat(lines, F.lit("\n"))).otherwise(F.lit("")).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


ship(__name__)
