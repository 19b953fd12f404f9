"""Report documents: assembly, JSON round trip, flattened rows, edge cases."""

import json

import pytest

from popsight.operators import report as rp
from popsight.sources import io


def test_document_round_trip(spark, tmp_path):
    one = spark.createDataFrame([(3, 0.1, None, True)], "n long, share double, gap double, ok boolean")
    many = spark.createDataFrame([("b", 2, ["x", "y"]), ("a", 1, []), ("c", None, None)], "key string, n int, list array<string>")
    none = one.limit(0)
    doc = rp.document(spark, {"one": (one, []), "many": (many.repartition(3), ["key"]), "none": (none, []), "no_rows": (many.limit(0), ["key"])})
    io.write_report_json(doc, f"{tmp_path}/r")
    (line,) = [r.value for r in spark.read.text(f"{tmp_path}/r").collect()]
    assert [x["key"] for x in json.loads(line)["many"]] == ["a", "b", "c"] and json.loads(line)["one"]["share"] == 0.1
    rows = rp.flatten(spark.read.schema(doc.schema).json(f"{tmp_path}/r"), {"many": ["key"], "no_rows": ["key"]}).collect()
    got = {(r.section, r.item, r.field): r.number if r.text is None else r.text for r in rows}
    assert got == {("one", "", "n"): 3.0, ("one", "", "share"): 0.1, ("one", "", "gap"): None, ("one", "", "ok"): "true",
                   ("many", "a", "n"): 1.0, ("many", "a", "list"): "", ("many", "b", "n"): 2.0, ("many", "b", "list"): "x, y",
                   ("many", "c", "n"): None, ("many", "c", "list"): ""}


def test_a_section_without_keys_is_one_row(spark):
    two = spark.createDataFrame([(1,), (2,)], "n int")
    with pytest.raises(Exception, match="section two has more than 1 rows"):
        rp.document(spark, {"two": (two, [])}).collect()
