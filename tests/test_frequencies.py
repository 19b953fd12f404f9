"""One shared frequency table: five profiles from one unpivot, equal to the operators' own paths; duplicates by hash."""

import datetime
import decimal

import pytest
from pyspark.sql import functions as F

from popsight.operators import frequencies as fq
from popsight.operators import missing as mi
from popsight.operators import profile as pf
from popsight.operators import project as pr
from popsight.schema import Roles

NAN = float("nan")


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i % 3 - 1, [0.5, NAN, None, 99.0][i % 4], None if i % 5 == 0 else ["?", " Unknown ", "x", "y"][i % 4],
             decimal.Decimal(i % 2), i, bool(i % 2), datetime.date(2020, 1, 1 + i % 3), None, float(i % 2)) for i in range(120)]
    return spark.createDataFrame(rows, "`a b` int, f float, s string, d decimal(10,2), id bigint, t boolean, day date, none string, w double").cache()


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_all_five_from_one_unpivot(spark, table, monkeypatch):
    freq = fq.frequencies(table)
    roles = Roles(continuous=("f", "w"), label="s", weight="w", year="")
    own = [pf.infer_column_types(table), pf.low_cardinality_distributions(table), mi.missing_profile(table),
           mi.modes(table, ["a b", "f", "s", "d", "t", "day"]), pr.feature_groups(table, roles)]
    own = [rows(x) for x in own]

    def none(*a, **k):
        raise AssertionError("a second unpivot")

    for m in (pf, mi, fq):
        monkeypatch.setattr(m, "column_value_counts", none)
    got = [pf.infer_column_types(table, freq=freq), pf.low_cardinality_distributions(table, freq=freq), mi.missing_profile(table, freq=freq),
           mi.modes(table, ["a b", "f", "s", "d", "t", "day"], freq), pr.feature_groups(table, roles, freq)]
    for df in got:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "InMemoryTableScan" not in plan and "explode" not in plan and "Expand" not in plan       # the table itself isn't read again
    assert [rows(x) for x in got] == own


def test_lookup_reads_only_its_columns(table):
    freq = fq.frequencies(table)
    plan = freq.of(["s"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(column_name" in plan.replace("#", "").replace("  ", " ") or "column_name" in plan.split("PartitionFilters")[1][:80]
    with pytest.raises(ValueError, match="nothing"):
        freq.of(["nothing"])


def test_groups_have_no_expand(table):
    plan = pr.feature_groups(table)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan


# ---------------------------------------------------------------- duplicates


def brute(rows_):
    def norm(v):
        return "nan" if isinstance(v, float) and v != v else 0.0 if v == 0 and isinstance(v, float) else v
    return len(rows_) - len({tuple(norm(v) for v in r) for r in rows_})


DUPS = [(1, "a", 0.0), (1, "a", -0.0), (1, "a", NAN), (1, "a", NAN), (None, "a", 1.0), (1, None, 1.0), (None, None, None), (None, None, None), (2, "b", 5.0)]


@pytest.mark.parametrize("collide", [False, True])
def test_duplicates(spark, monkeypatch, collide):
    if collide:                                                # all rows share one hash: whole rows decide
        monkeypatch.setattr(mi, "_row_hashes", lambda df: [F.lit(1).alias("_h1"), F.lit(2).alias("_h2")])
    data = DUPS + [(9, "hot", 1.0)] * 300
    df = spark.createDataFrame(data, "x int, `y z` string, f double").repartition(4)
    r = mi.duplicate_report(df).first()
    assert (r.rows, r.duplicate_rows) == (len(data), brute(data)) and r.distinct_rows == r.rows - r.duplicate_rows
    assert mi.count_duplicates(df).first()[0] == brute(data)
    empty = mi.duplicate_report(df.limit(0)).first()
    assert (empty.rows, empty.duplicate_rows, empty.duplicate_percentage) == (0, 0, None)


def test_unique_rows_are_not_exchanged(spark, monkeypatch, tmp_path):
    spark.range(5000).select(F.col("id"), F.col("id").cast("string").alias("s")).union(spark.range(40).select("id", F.col("id").cast("string"))
        ).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    seen = []
    kept = mi.stored
    monkeypatch.setattr(mi, "stored", lambda d, n: (seen.append(d._jdf.queryExecution().executedPlan().toString()), kept(d, n))[1])
    out = mi.duplicate_report(df)
    assert out.first().duplicate_rows == 40
    (first,) = seen
    shuffled = [x for x in first.splitlines() if "Exchange" in x]
    assert len(shuffled) == 1 and "_h1" in shuffled[0] and "s#" not in shuffled[0]             # hashes only
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_clean_up(spark, monkeypatch):
    import os

    from popsight.plans import store
    monkeypatch.setattr(store, "_WRITTEN", {})
    df = store.stored(spark.range(5), "gone")
    (path,) = store._WRITTEN[spark.sparkContext.applicationId]
    local = path.removeprefix("file:")
    assert df.count() == 5 and os.path.isdir(local)
    assert store.clean_up(spark) == 1 and not os.path.exists(local) and store.clean_up(spark) == 0
