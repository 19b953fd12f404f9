"""Content sort, whitening and periodic runs against brute force; op11 to op13 as registered."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("popsight.llm")
from popsight import llm  # noqa: E402
from popsight.llm import exact, periods, whitening  # noqa: E402

SCHEMA = "doc_id bigint, text string, kept boolean, run int, _row string, norm string, `a b` int"
SPACE = re.compile(r"[\x20\x09-\x0D]+")


# ---------------------------------------------------------------- content sort

def brute_groups(rows):
    """[(doc_id, text)] -> sorted result rows without the choice among full ties."""
    by = collections.defaultdict(list)
    for d, t in rows:
        by[SPACE.sub("", t or "")].append((d, t or ""))
    out = []
    for norm, own in by.items():
        keep = min(own, key=lambda r: (-len(r[1]), r[0] is None, r[0] or 0))[0]
        out += [(d, keep, len(own), hashlib.sha256(norm.encode()).hexdigest()) for d, _ in own]
    return sorted(out, key=str)


def edge_rows():
    r = random.Random(5)
    head = "same beginning of more than sixty-four bytes, as boilerplate has it, and then "
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a b"), (5, "ab"), (6, "a  b"), (6, "a  b"), (7, "ümlaut ü"), (8, "ümlautü"),
            (None, "a b  "), (None, None), (9, "x" * 300_000), (10, " " + "x" * 300_000), (11, "A b"), (-(1 << 63), "a c")]
    rows += [(100 + i, head + str(r.randint(0, 20))) for i in range(120)]
    rows += [(500 + i, "one text that many rows hold") for i in range(400)] + [(77, "repeated row")] * 90
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("partitions", [1, 5, 60])
def test_content_groups(spark, partitions):
    rows = edge_rows()
    docs = spark.createDataFrame([(d, t, True, 1, "r", "n", 2) for d, t in rows], SCHEMA).repartition(4)
    got = exact.content_groups(docs, partitions=partitions).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute_groups(rows)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in got}) and all(r.doc_id == r.keep_id for r in kept)


def test_a_group_spreads_over_partitions(spark):
    docs = spark.createDataFrame([(i, "copy") for i in range(900)] + [(5000 + i, f"t{i}") for i in range(100)], "doc_id long, text string")
    exact.content_groups(docs.repartition(6), partitions=10)
    seen = exact.content_groups(docs.repartition(6), partitions=10)
    assert seen.filter("kept").count() == 101 and seen.agg(F.max("group_size")).first()[0] == 900


def test_drop_copies_keeps_columns(spark):
    docs = spark.createDataFrame([(1, "a", True, 1, "r", "n", 2), (2, "a ", False, 2, None, None, None), (3, None, None, None, "x", "y", 1)], SCHEMA)
    got = exact.drop_copies(docs)
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == [2, 3]
    assert exact.drop_copies(docs.limit(0)).count() == 0 and exact.content_groups(docs.limit(0)).count() == 0


def test_op11_as_registered(spark, tmp_path):
    rows = edge_rows()
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = llm.queries()["op11_content_sort_dedup"](spark, str(tmp_path))
    assert dict(got.dtypes) == {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"}
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got.collect()), key=str) == brute_groups(rows)


# ---------------------------------------------------------------- whitening

def brute_whiten(c, k=8):
    x = np.array([[math.floor(1024 * float(v)) + 100000 for v in row] for row in c], dtype=object)
    n, s = len(x), x.sum(0)
    deviation = [sum((n * a - b) ** 2 for a, b in zip(row, s)) for row in x]
    y = np.array([[(n * a - b) / n for a, b in zip(row, s)] for row in x], float)
    v = y.T @ y / n
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    return deviation, y @ axes / np.sqrt(values), values / np.trace(v)


def by_component(rows):
    out = collections.defaultdict(dict)
    for r in rows:
        out[r.component][r.vec_id] = r
    return out


@pytest.mark.parametrize("d, n", [(12, 300), (3, 50), (1, 9), (40, 400)])
def test_whitening_equals_numpy(spark, d, n):
    g = np.random.default_rng(d)
    c = (g.standard_normal((n, d)) @ np.diag(np.linspace(0.2, 3, d))).astype(np.float32)
    rows = [(i, [float(v) for v in r], 1) for i, r in enumerate(c)]
    bad = [(9001, None, 0), (9002, [None] * d, 0), (9003, [float("nan")] * d, 0), (9004, [float("inf")] * d, 0), (9005, [], 0),
           (9006, [1.0] * (d + 1), 0)]
    got = by_component(whitening.whiten(spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, component int").repartition(5)).collect())
    deviation, white, share = brute_whiten(c)
    assert sorted(got) == list(range(1, min(8, d) + 1))
    for k, own in got.items():
        assert sorted(own) == list(range(n))
        mine = np.array([own[i].whitened for i in range(n)])
        sign = np.sign(mine @ white[:, k - 1])
        assert np.abs(mine * sign - white[:, k - 1]).max() < 1e-9
        assert all(own[i].deviation == deviation[i] and own[i].n == n for i in range(n))
        assert abs(own[0].explained - share[k - 1]) < 1e-10 and own[0].identity_error < 1e-9


def test_eigenpairs_of_clusters():
    g = np.random.default_rng(3)
    for d, values in ((30, [5.0] * 6 + [5.0 - 1e-9] * 6 + [1.0] * 18), (20, [2.0] * 20), (16, [1e6, 1.0] + [0.0] * 14), (2, [3.0, 3.0]),
                      (64, list(np.linspace(1, 1.001, 64)))):
        q, _ = np.linalg.qr(g.standard_normal((d, d)))
        m = q @ np.diag(values) @ q.T
        m = (m + m.T) / 2
        e, v = whitening.leading_pairs(m, 8)
        assert np.abs(e - np.sort(values)[::-1][:len(e)]).max() < 1e-12 * max(values) * d
        assert np.abs(v.T @ v - np.eye(len(e))).max() < 1e-9
        assert np.abs(m @ v - v * e).max() < 1e-12 * max(values) * d
    e, v = whitening.leading_pairs(np.diag([1.0, 4.0, 2.0]), 8)          # nothing to reflect, parts not connected
    assert list(e) == [4.0, 2.0, 1.0] and np.abs(np.abs(v).sum(0) - 1).max() < 1e-12


def test_whitening_degenerate(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(i, [1.0, 2.0]) for i in range(9)], schema)).count() == 0
    flat = spark.createDataFrame([(i, [float(i), 1.0, 2.0 * i]) for i in range(9)] + [(None, [3.0, 1.0, 6.0])] * 2, schema)
    got = whitening.whiten(flat).collect()                               # one direction only
    assert len(got) == 11 and {r.component for r in got} == {1} and abs(got[0].explained - 1) < 1e-12
    huge = spark.createDataFrame([(i, [1e9 * (i % 3), 1.0 * i]) for i in range(2000)] + [(-1, [1e30, 0.0])], schema)
    rows = whitening.whiten(huge).collect()
    assert {r.n for r in rows} == {2000} and all(r.deviation is None or r.deviation >= 0 for r in rows) and any(r.deviation is None for r in rows)


def test_op12_as_registered(spark):
    got = llm.queries()["op12_covariance_whitening"](spark, "/root/testdata/sf0.001")
    assert dict(got.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double",
                                "explained": "double", "identity_error": "double"}
    src = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    deviation, white, share = brute_whiten([r.embedding for r in src])
    rows = by_component(got.collect())
    for k in range(1, 9):
        mine = np.array([rows[k][r.vec_id].whitened for r in src])
        assert np.abs(mine * np.sign(mine @ white[:, k - 1]) - white[:, k - 1]).max() < 1e-8
        assert rows[k][src[0].vec_id].identity_error < 1e-9
    assert [rows[1][r.vec_id].deviation for r in src] == deviation


# ---------------------------------------------------------------- periodic runs

def brute_runs(words):
    n, best = len(words), {}
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(6, 4 * p):
                best.setdefault((i, j + p), p)                  # the smallest period comes first
            i = j + 1
    # a stretch is a run of its smallest period only
    out = []
    for (i, j), p in best.items():
        w = words[i:j]
        small = next(x for x in range(1, p + 1) if all(w[k] == w[k + x] for k in range(len(w) - x)))
        if small == p:
            out.append((i, j - i, p))
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    return words


def expected(doc_id, text):
    words = planted(doc_id, text)
    runs = brute_runs(words)
    kept = [True] * len(words)
    for s, m, p in runs:
        kept[s + p:s + m] = [False] * (m - p)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            hashlib.sha256("".join(f"{s},{m},{p}\n" for s, m, p in runs).encode()).hexdigest(),
            hashlib.sha256(b" ".join(w for w, k in zip(words, kept) if k)).hexdigest())


def one_text(words):
    number = collections.defaultdict(lambda: len(number))
    ids = np.array([number[w] for w in words] + [-1], np.int64)
    return sorted(((s, m, p) for s, m, p in periods.find_runs(ids, np.array([len(words)])) if m >= 6), key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force():
    r = random.Random(1)
    for trial in range(400):
        n, letters = r.randint(0, 160), r.choice([1, 2, 2, 3, 5, 40])
        words = [r.randrange(letters) for _ in range(n)]
        for _ in range(r.randint(0, 3)):                        # stretches of every period, nested and touching
            p, at = r.randint(1, 40), r.randint(0, max(n - 1, 0))
            block = [r.randrange(letters) for _ in range(p)]
            m = r.randint(0, 6 * p)
            words[at:at + m] = (block * 7)[:m]
        assert one_text(words) == brute_runs(words), words


def test_runs_of_structured_words():
    fib = ["a", "ab"]
    while len(fib[-1]) < 400:
        fib.append(fib[-1] + fib[-2])
    for text in ("a" * 100, "ab" * 50, "aab" * 40 + "ab" * 30, ("a" * 9 + "b") * 12, (("ab" * 9 + "c") * 6 + "d") * 5, fib[-1][:400], fib[-1][:400] * 2,
                 "abcdefgh" * 4, "abcdefgh" * 4 + "a", "abcdefgh" * 3 + "abcdefg", "aaaaa", "aaaaaa", "abababab", "xabababa", ""):
        assert one_text(list(text)) == brute_runs(list(text)), text


def test_op13_as_registered(spark, tmp_path):
    r = random.Random(2)
    words = ["a", "b", "c", "über", "<x>"]
    rows = [(i, " ".join(r.choice(words[:1 + i % 5]) for _ in range(r.randint(0, 60))).replace(" ", r.choice([" ", "\n", " \t"]))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, " \n"), (203, "one"), (204, "la " * 30000), (205, "la " * 3), (205, "la " * 3), (None, "a b " * 9), (None, None)]
    rows += [(i, " ".join(f"w{k}" for k in range(i))) for i in range(300, 340)]
    spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, runs int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = llm.queries()["op13_synchronised_runs"](spark, str(tmp_path))
    kinds = ["bigint"] * 6 + ["string"] * 2
    assert got.dtypes == list(zip(["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"], kinds))
    # the long text is one run: brute force would take too long
    want = [expected(d, t) if t is None or len(t) < 9000 else None for d, t in rows]
    mine = {r: 0 for r in ()}
    mine = sorted((tuple(x) for x in got.collect()), key=str)
    long = [x for x in mine if x[0] == 204]
    assert [x[:6] for x in long] == [(204, 1, 0, 30000, 1, 30000000)]
    assert [x for x in mine if x[0] != 204] == sorted((w for w in want if w), key=str)
    assert periods.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0
