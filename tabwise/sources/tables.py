"""Parquet table access and the derived fixture views.

The fixture views are plain SQL over the driver tables. The same text runs
in Spark and in DuckDB, so a query built on a fixture has an independent
oracle. Nulls are injected with deterministic ``CASE`` expressions; every
row of the base table is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# Fixed fixture definitions (they must produce the same rows in both engines).
FIXTURE_SQL = {
    "fx_gap": """
SELECT o_orderkey AS id,
  CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_totalprice END AS price,
  CASE WHEN o_orderkey % 5 < 3 THEN NULL ELSE o_custkey END AS mostly_null,
  1 AS const_col,
  CASE WHEN o_orderkey % 100 = 0 THEN 1 ELSE 0 END AS near_const,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS priority,
  o_orderstatus AS status,
  o_totalprice * 1.1 + o_custkey AS price_copy,
  o_custkey AS cust
FROM orders""",
    # NaN stands for a missing value in a quarter of one column and three quarters of another
    "fx_nan": """
SELECT event_id,
  CASE WHEN event_id % 4 = 0 THEN CAST('NaN' AS DOUBLE) ELSE value END AS value,
  CASE WHEN event_id % 4 > 0 THEN CAST('NaN' AS DOUBLE) ELSE value END AS mostly_nan
FROM events""",
    "fx_out": "SELECT event_id, value, value * value AS v2 FROM events",
    # y is an integer in exact arithmetic; ROUND removes the 1e-15 noise of 200 * l_discount
    "fx_reg": """
SELECT CAST(ROUND(3*l_quantity - 200*l_discount
       + CASE WHEN l_returnflag = 'R' THEN 50 ELSE 0 END + (l_partkey % 11) - 5, 6) AS DOUBLE) AS y,
  l_quantity, l_discount, l_tax, l_returnflag, l_linestatus
FROM lineitem""",
    "fx_dup": """
SELECT o_orderstatus AS status,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS priority
FROM orders""",
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register_tables(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    """Temp views for the driver tables (lazy: nothing is read until used)."""
    for n in names:
        read_table(spark, sf_dir, n).createOrReplaceTempView(n)


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived fixture over the driver tables (the tables it reads get views)."""
    register_tables(spark, sf_dir, [t for t in TABLES if t in FIXTURE_SQL[name]])
    return spark.sql(FIXTURE_SQL[name])
