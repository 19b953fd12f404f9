"""The shared lookup of label codes: equal to the lookup column by column, one exchange of the rows."""

import random

import pytest
from pyspark.sql import functions as F

from popsight.operators import encode as en


@pytest.fixture(scope="module")
def wide(spark):
    r = random.Random(1)
    n, d = 600, 30
    rows = [(i, *[None if r.random() < 0.05 else "hot" if r.random() < 0.33 else f"v{r.randint(0, 400)}" for _ in range(d)], i * 0.5) for i in range(n)]
    names = ["id"] + [f"`c {k}`" for k in range(d)]
    return spark.createDataFrame(rows, ", ".join(f"{c} string" if k else "id bigint" for k, c in enumerate(names)) + ", row double").cache()


def test_shared_lookup_equals_the_direct_one(spark, wide, monkeypatch):
    cols = [c for c in wide.columns if c.startswith("c ")]
    codes = en.fit_label_codes(wide.where("id < 500"), cols)              # some values stay unseen
    direct = {r.id: tuple(r) for r in en.label_encode_transform(wide, codes).collect()}
    plan = en.label_encode_transform(wide, codes)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan                                 # few codes: nothing is exchanged
    monkeypatch.setattr(en, "MAX_BROADCAST_CODES", 10)
    out = en.label_encode_transform(wide, codes)
    assert out.columns == wide.columns and dict(out.dtypes)["c 0"] == "int"
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert {r.id: tuple(r) for r in out.collect()} == direct
    assert any(-1 in r for r in direct.values())
    # two joins for 30 columns; the rows are exchanged by number once
    assert sum(plan.count(j) for j in ("SortMergeJoin", "BroadcastHashJoin", "ShuffledHashJoin")) == 2
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning(id" in line]
    assert len(moved) == 2 and sum("row#" in x for x in plan.splitlines() if "FileScan" in x) <= 2


def test_hot_value_is_spread(spark, monkeypatch):
    monkeypatch.setattr(en, "MAX_BROADCAST_CODES", 0)
    df = spark.range(4000).select("id", F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("c"))
    codes = en.fit_label_codes(df, ["c"])
    out = en.label_encode_transform(df, codes)
    assert out.where("c = -1").count() == 0 and out.select("c").distinct().count() == df.select("c").distinct().count()
    assert out.groupBy("c").count().agg(F.max("count")).first()[0] == df.where("c = 'hot'").count()


def test_no_rows_no_columns(spark, monkeypatch):
    monkeypatch.setattr(en, "MAX_BROADCAST_CODES", 0)
    df = spark.createDataFrame([("a",), (None,)], "c string")
    codes = en.fit_label_codes(df, ["c"])
    assert en.label_encode_transform(df.limit(0), codes).count() == 0
    assert sorted(r.c for r in en.label_encode_transform(df, codes).collect()) == [-1, 0]
    assert en.label_encode_transform(df, en.LabelCodes([])).columns == ["c"]
