"""S1, S2, S4-S8, K13 round trips: each query writes what Spark derived from
the tables into a fresh folder under the shared checkpoint location and
returns what it reads back."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import functions as F

from ..operators import correlate as co
from ..operators import encode as en
from ..schema import PERSONS_ROLES
from ..sources import io
from ..sources.tables import PERSONS_COLUMNS
from . import persons_input, register, sql_with
from .correlate import NUM, corr_sql
from .encode import _E7_CTES, COLS, _e5_ctes, processed, raw

TYPES = dict(PERSONS_COLUMNS)
OUT_TYPES = {c: ("double" if c in PERSONS_ROLES.continuous else
                 "int" if c not in ("person_id", "weight", "year") else TYPES[c]) for c in COLS}


@register("s1_read_headerless_csv", sql_with(select=f"SELECT {', '.join(COLS)} FROM persons"))
def q_s1(spark, sf_dir):
    base = io.scratch_path(spark, "raw")
    df = raw(spark, sf_dir)
    io.write_headerless(df, f"{base}/data")
    io.write_names(df, f"{base}/columns")
    names = io.read_column_names(spark, f"{base}/columns")
    return io.read_headerless_csv(spark, f"{base}/data", names, TYPES)


@register("s2_read_column_names", sql_with(select=" UNION ALL ".join(
    f"SELECT {i + 1} AS position, '{c}' AS column_name, COUNT({c}) AS non_null FROM persons"
    for i, c in enumerate(COLS))))
def q_s2(spark, sf_dir):
    """The names read from the names file, each with the values that the
    headerless file holds at its position."""
    df = q_s1(spark, sf_dir)
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"_n{i}") for i, c in enumerate(df.columns)])
    body = ", ".join(f"{i + 1}, '{c}', _n{i}" for i, c in enumerate(df.columns))
    return counts.selectExpr(f"stack({len(df.columns)}, {body}) AS (position, column_name, non_null)")


_S5_ORDER = [c for c in COLS if c not in ("label", "weight")] + ["label", "weight"]


@register("s4_read_table", sql_with(*_e5_ctes(), select="SELECT * FROM e5"))
def q_s4(spark, sf_dir):
    path = io.scratch_path(spark, "processed")
    io.write_table(processed(spark, sf_dir), path, "csv")
    ddl = ", ".join(f"`{c}` {OUT_TYPES[c]}" for c in COLS)
    return io.read_table(spark, path, "csv", ddl)


@register("s5_write_csv", sql_with(*_E7_CTES, select=f"SELECT {', '.join(_S5_ORDER)} "
                                                         "FROM e7 WHERE split = 'train'"))
def q_s5(spark, sf_dir):
    sp = en.stratified_split(processed(spark, sf_dir), "label", "person_id")
    train, _ = en.train_test(sp)
    path = io.scratch_path(spark, "train")
    io.write_table(train, path, "csv", _S5_ORDER)
    ddl = ", ".join(f"`{c}` {OUT_TYPES[c]}" for c in _S5_ORDER)
    return io.read_table(spark, path, "csv", ddl)


@register("s6_write_matrix_csv", sql_with(
    ("corr", corr_sql("persons", NUM)),
    select="SELECT feature1 AS feature, " + ", ".join(
        f"MAX(CASE WHEN feature2 = '{c}' THEN r END) AS {c}" for c in NUM)
    + " FROM corr GROUP BY feature1"))
def q_s6(spark, sf_dir):
    corr = co.correlation_matrix(persons_input(spark, sf_dir), NUM)
    path = io.scratch_path(spark, "corr")
    io.write_matrix_csv(co.correlation_wide(corr, NUM), path)
    ddl = ", ".join(["feature string"] + [f"`{c}` double" for c in NUM])
    return io.read_table(spark, path, "csv", ddl)


@register("s7_write_report_json")
def q_s7(spark, sf_dir):
    from ..operators import profile as pf
    p = persons_input(spark, sf_dir)
    summary = pf.dataset_summary(p)
    dist = pf.target_distribution(p, "label").agg(
        F.collect_list(F.struct("value", "count", "percentage")).alias("target_distribution"))
    report = summary.select(F.struct("*").alias("dataset_info"),
                            dist.select("target_distribution").scalar().alias("target_distribution"))
    path = io.scratch_path(spark, "report")
    io.write_report_json(report, path)
    return spark.read.json(path)


@register("s8_save_load_pipeline", sql_with(*_e5_ctes(), select="SELECT * FROM e5"))
def q_s8(spark, sf_dir):
    fitted, _ = en.preprocess_fit(raw(spark, sf_dir), PERSONS_ROLES)
    path = io.scratch_path(spark, "pipeline")
    io.save_preprocessor(fitted, path, spark)
    loaded = io.load_preprocessor(spark, path)
    from ..operators.missing import drop_duplicates
    out = en.preprocess_transform(drop_duplicates(raw(spark, sf_dir)), loaded)
    return out.select(*[F.round(c, 9).alias(c) if c in PERSONS_ROLES.continuous else F.col(c)
                        for c in out.columns])


@register("s8_save_load_model")
def q_s8_model(spark, sf_dir):
    from .model import _split, default_model
    bm = default_model(spark, sf_dir)
    path = io.scratch_path(spark, "gbt")
    io.save_model(bm.model, path)
    loaded = GBTClassificationModel.load(path)
    from ..operators import model as mo
    _, test = en.train_test(_split(spark, sf_dir))
    bm2 = mo.BoostedModel(loaded, bm.feature_names, bm.scale_pos_weight, bm.params)
    return mo.score(bm2, test, ["person_id", "label"])


@register("k13_write_assignments")
def q_k13_write(spark, sf_dir):
    from .model import assignments
    path = io.scratch_path(spark, "segments")
    io.write_table(assignments(spark, sf_dir), path, "csv")
    return io.read_table(spark, path, "csv", "person_id bigint, segment int")
