"""Radix selection: the order key, every level, hot values, many groups, plans."""

import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from popsight.plans import quantiles
from popsight.plans.quantiles import exact_percentile_columns, exact_percentiles, with_order_key

PROBS = [0.0, 0.25, 0.5, 0.77, 1.0]
EDGES = [0.0, -0.0, 1.0, -1.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, math.inf, -math.inf,
         2.0, math.nextafter(2.0, 0), math.nextafter(2.0, 3), 2.0 ** 1023, 2.0 ** -1021, 0.1, 1 / 3, 8.0, math.nextafter(8.0, 0), 1e-310]


def bits(x):
    b = struct.unpack("<q", struct.pack("<d", abs(x)))[0]
    return -b if x < 0 else b


def test_order_key_is_the_magnitude_with_its_sign(spark):
    r = random.Random(1)
    xs = EDGES + [struct.unpack("<d", r.randbytes(8))[0] for _ in range(3000)] + [2.0 ** e for e in range(-1074, 1024)]
    xs += [math.nextafter(2.0 ** e, 0) for e in range(-1060, 1024)] + [math.nextafter(2.0 ** e, math.inf) for e in range(-1060, 1023)]
    xs = [x for x in xs if not math.isnan(x)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for row in with_order_key(df.withColumn("k", F.lit(None).cast("bigint")), "x", "k").collect():
        assert row.k == bits(row.x), row.x


def reference(values, p):
    v = np.sort(np.array([x + 0.0 for x in values if x is not None and not math.isnan(x)]))
    pos = (len(v) - 1) * p
    lo, hi = math.floor(pos), math.ceil(pos)
    return v[lo] if lo == hi or v[lo] == v[hi] else (hi - pos) * v[lo] + (pos - lo) * v[hi]


def test_all_kinds_of_groups(spark):
    r = random.Random(2)
    groups = {
        "uniform": [r.random() for _ in range(5000)],
        "wide": [x for x in (struct.unpack("<d", r.randbytes(8))[0] for _ in range(5000)) if math.isfinite(x)],
        "close": [1.0 + k * 2.0 ** -52 for k in range(4000)],            # all four levels
        "hot": [7.0] * 3000 + [r.gauss(0, 1) for _ in range(1500)],
        "one": [3.5], "two": [1.0, 2.0], "same": [4.0] * 50, "none": [None, float("nan")],
        "signs": [-0.0, 0.0, -1.0, 1.0, None, float("nan")], "inf": [math.inf, -math.inf, 1.0],
        None: [float(k) for k in range(100)],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    got = {(x.g, x.p_index): x.value for x in exact_percentiles(df, ["g"], "v", PROBS).collect()}
    assert len(got) == (len(groups) - 1) * len(PROBS)
    for (g, i), v in got.items():
        assert v == reference(groups[g], PROBS[i]), (g, PROBS[i])


def test_integers_and_columns(spark):
    r = random.Random(3)
    rows = [(r.choice([r.randint(-10**12, 10**12), r.randint(-40000, 40000), -(1 << 63), (1 << 63) - 1]), r.randint(0, 90), None if i % 3 else r.random(), float("nan") if i % 7 else 2.5, None) for i in range(3000)]
    df = spark.createDataFrame(rows, "a bigint, `b c` int, d double, e float, f double").repartition(5)
    got = exact_percentile_columns(df, df.columns, PROBS)
    for j, c in enumerate(["a", "b c", "d", "e"]):
        assert got[c] == [reference([x[j] for x in rows], p) for p in PROBS], c
    assert got["f"] == [None] * len(PROBS)
    whole = exact_percentiles(df, [], "a", [0.5]).collect()
    assert [(x.p_index, x.value) for x in whole] == [(0, reference([x[0] for x in rows], 0.5))]


def test_many_groups_go_through_a_stored_table(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "MAX_LOCAL", 20)
    r = random.Random(4)
    rows = [(k % 300, r.gauss(k % 300, 1)) for k in range(6000)]
    got = {x.g: x.value for x in exact_percentiles(spark.createDataFrame(rows, "g int, v double"), ["g"], "v", [0.5]).collect()}
    assert got == {g: reference([v for k, v in rows if k == g], 0.5) for g in range(300)}


def test_nothing_of_the_size_of_the_data_is_exchanged(spark, monkeypatch):
    seen = []
    kept = quantiles._kept
    monkeypatch.setattr(quantiles, "_kept", lambda nodes: (seen.append(nodes), kept(nodes))[1])
    df = spark.range(200_000).select(F.randn(5).alias("v"))
    exact_percentiles(df, [], "v", [0.25, 0.5]).collect()
    plans = [n._jdf.queryExecution().executedPlan().toString() for n in seen]
    scans = [p for p in plans if "Range (0, 200000" in p]
    assert 1 < len(scans) <= 4 and all(p.count("Range (0, 200000") == 1 for p in scans)     # one scan a level
    for p in scans:
        # whatever is exchanged are partial counts; open buckets are broadcast
        assert "partial_count" in p and "rangepartitioning" not in p and "SortMergeJoin" not in p
        assert p.count("log2") + p.count("LOG2") <= 1                                       # the key is worked out once a row


def test_later_scans_read_open_columns_only(spark, monkeypatch):
    seen = []
    kept = quantiles._kept
    monkeypatch.setattr(quantiles, "_kept", lambda nodes: (seen.append(nodes._jdf.queryExecution().executedPlan().toString()), kept(nodes))[1])
    df = spark.range(20_000).select((F.col("id") % 90).cast("int").alias("age"), (F.col("id") % 7).alias("n"), F.randn(3).alias("x"))
    got = exact_percentile_columns(df, df.columns, [0.5])
    assert got["age"] == [44.0] and got["n"] == [3.0]
    assert "% 90" in seen[0] and len(seen) > 1 and all("% 90" not in p and "% 7" not in p for p in seen[1:])


@pytest.mark.parametrize("n", [0, 1])
def test_empty(spark, n):
    df = spark.createDataFrame([(None,)] * n, "v double")
    assert exact_percentiles(df, [], "v", [0.5]).count() == 0 and exact_percentile_columns(df, ["v"], [0.5]) == {"v": [None]}
