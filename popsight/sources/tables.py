"""Driver tables and the census-shaped ``persons`` table derived from them.

``persons`` is defined once as SQL text with ``{table}`` placeholders: Spark
binds the placeholders to DataFrames (``spark.sql(text, orders=df, ...)``),
so no global view names are taken, and the oracle side fills them with the
plain view names. The same text runs unchanged on both engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# The derived-table definition shared with the SQL oracle.
PERSONS_SQL = """
WITH li AS (
  SELECT l_orderkey, CAST(SUM(l_quantity) AS BIGINT) AS q, COUNT(*) AS n_items
  FROM {lineitem} GROUP BY l_orderkey),
b AS (
  SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, o_totalprice, o_orderdate,
         c_acctbal, c_mktsegment, c_nationkey,
         COALESCE(q, 0) AS q, COALESCE(n_items, 0) AS n_items,
         (o_custkey * 13 + o_orderkey) % 91 AS age
  FROM {orders} JOIN {customer} ON o_custkey = c_custkey LEFT JOIN li ON l_orderkey = o_orderkey),
c AS (
  SELECT o_orderkey AS person_id, age,
    CASE WHEN age < 16 THEN 'Not in universe' WHEN o_orderstatus = 'F' THEN 'Private' WHEN o_orderstatus = 'O' THEN 'Federal government' ELSE 'Self-employed' END AS class_of_worker,
    CASE WHEN age < 16 OR age > 75 THEN 0 ELSE 1 + (o_custkey % 51) END AS industry_code,
    CASE WHEN age < 16 OR age > 75 THEN 0 ELSE 1 + (o_orderkey % 46) END AS occupation_code,
    CASE WHEN age < 15 THEN 'Children' WHEN c_acctbal > 8000 THEN 'Masters degree' WHEN c_acctbal > 4000 THEN 'Bachelors degree' ELSE 'High school graduate' END AS education,
    CASE WHEN o_orderkey % 997 = 0 THEN 9999 WHEN o_orderstatus = 'P' AND age >= 16 THEN CAST(FLOOR(o_totalprice / 250) AS BIGINT) ELSE 0 END AS wage_per_hour,
    CASE WHEN age < 18 THEN 'Never married' WHEN o_orderkey % 3 = 0 THEN 'Divorced' ELSE 'Married' END AS marital_stat,
    c_mktsegment AS race, CASE WHEN o_orderkey % 2 = 0 THEN 'Female' ELSE 'Male' END AS sex,
    CASE WHEN o_orderpriority = '1-URGENT' AND c_acctbal > 3000 THEN CAST(FLOOR(c_acctbal) AS BIGINT) ELSE 0 END AS capital_gains,
    CASE WHEN o_orderpriority = '5-LOW' AND c_acctbal < 0 THEN CAST(FLOOR(-c_acctbal) AS BIGINT) ELSE 0 END AS capital_losses,
    CASE WHEN o_orderkey % 10 = 0 THEN q ELSE 0 END AS dividends,
    CASE WHEN o_orderkey % 5 = 0 THEN 'Not in universe under 1 year old' WHEN o_orderkey % 7 = 0 THEN 'Not in universe' ELSE 'Nonmover' END AS migration,
    CASE WHEN c_nationkey = 0 THEN '?' ELSE CONCAT('Country-', CAST(c_nationkey AS VARCHAR(10))) END AS birth_country,
    n_items AS num_employer,
    CASE WHEN age < 16 OR age > 70 THEN 0 WHEN q >= 52 THEN 52 ELSE q END AS weeks_worked,
    94 + (o_custkey % 2) AS year,
    FLOOR(o_totalprice / 10) / 100 AS weight
  FROM b),
l AS (SELECT *, CASE WHEN (weeks_worked >= 40 AND age BETWEEN 30 AND 65
               AND (education = 'Masters degree' OR (education = 'Bachelors degree' AND (person_id * 31) % 6 = 0) OR capital_gains > 7000)
               AND (person_id * 7919) % 100 >= 25)
               OR (age >= 20 AND (person_id * 104729) % 1000 < 12)
          THEN '50000+.' ELSE '- 50000.' END AS label,
       (CAST(weeks_worked AS DOUBLE) / 2
        + CASE education WHEN 'Masters degree' THEN 25 WHEN 'Bachelors degree' THEN 10 ELSE 0 END
        + CASE WHEN age BETWEEN 30 AND 65 THEN 20 ELSE 0 END
        + CASE WHEN capital_gains > 7000 THEN 10 ELSE 0 END
        + CAST((person_id * 37) % 15 AS DOUBLE) + CAST(0.25 AS DOUBLE)) / CAST(100 AS DOUBLE) AS score
  FROM c)
SELECT * FROM l
UNION ALL
SELECT * FROM l WHERE person_id % 62 = 0
"""

# Column order and Spark types of ``persons``.
PERSONS_COLUMNS = (
    ("person_id", "bigint"), ("age", "bigint"), ("class_of_worker", "string"),
    ("industry_code", "bigint"), ("occupation_code", "bigint"), ("education", "string"),
    ("wage_per_hour", "bigint"), ("marital_stat", "string"), ("race", "string"),
    ("sex", "string"), ("capital_gains", "bigint"), ("capital_losses", "bigint"),
    ("dividends", "bigint"), ("migration", "string"), ("birth_country", "string"),
    ("num_employer", "bigint"), ("weeks_worked", "bigint"), ("year", "bigint"),
    ("weight", "double"), ("label", "string"), ("score", "double"),
)

POSITIVE_LABEL = "50000+."
NEGATIVE_LABEL = "- 50000."


# How the definition ends -- every row once, rows whose
# person_id is a multiple of 62 a second time.
_UNION_TAIL = """SELECT * FROM l
UNION ALL
SELECT * FROM l WHERE person_id % 62 = 0
"""
DUPLICATE_EVERY = 62


def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The census-shaped table, built lazily from orders/customer/lineitem.

    Same rows as :data:`PERSONS_SQL`, but the duplicated rows are emitted by
    an ``explode`` over the one base relation instead of a second UNION
    branch, so the inputs are scanned, aggregated and joined once."""
    assert PERSONS_SQL.rstrip().endswith(_UNION_TAIL.rstrip())
    base_sql = PERSONS_SQL.rstrip()[: -len(_UNION_TAIL.rstrip())] + "SELECT * FROM l"
    base = spark.sql(
        base_sql,
        lineitem=table(spark, sf_dir, "lineitem"),
        orders=table(spark, sf_dir, "orders"),
        customer=table(spark, sf_dir, "customer"),
    )
    copies = F.when(F.col("person_id") % DUPLICATE_EVERY == 0, F.lit(2)).otherwise(F.lit(1))
    return (base.withColumn("_copy", F.explode(F.sequence(F.lit(1), copies)))
            .drop("_copy"))


def persons_sql() -> str:
    """The same definition for the DuckDB oracle (plain view names)."""
    return PERSONS_SQL.format(lineitem="lineitem", orders="orders", customer="customer")


def with_persons(select_sql: str) -> str:
    """Oracle helper: ``WITH persons AS (<definition>) <select_sql>``."""
    return f"WITH persons AS ({persons_sql()}) {select_sql}"
