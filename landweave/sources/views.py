"""Views over the driver's tables: the same SQL text runs on Spark and on the checking engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PARCELS = """
SELECT 'revenue' AS source_id, concat('R-', CAST(c_custkey AS STRING)) AS record_id, c_custkey AS row_ix,
  CASE WHEN c_custkey % 3 = 0 THEN concat('UP-', lpad(CAST(c_custkey AS STRING), 6, '0')) END AS ulpin,
  r_name AS district, n_name AS village, c_mktsegment AS tehsil,
  CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE concat(CAST(c_custkey AS STRING), '/', CAST(c_custkey % 7 AS STRING)) END AS khasra,
  abs(c_acctbal) AS area,
  CAST(c_custkey % 100 AS DOUBLE) * 10 AS minx, CAST(floor(c_custkey / 100) AS DOUBLE) * 10 AS miny,
  CAST(c_custkey % 100 AS DOUBLE) * 10 + 9 AS maxx, CAST(floor(c_custkey / 100) AS DOUBLE) * 10 + 9 AS maxy
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
UNION ALL
SELECT 'municipal', concat('M-', CAST(c_custkey AS STRING)), 1000000000 + c_custkey,
  CASE WHEN c_custkey % 6 = 0 THEN concat(' up-', lpad(CAST(c_custkey AS STRING), 6, '0')) END,
  CASE WHEN c_custkey % 5 = 0 THEN concat(r_name, ' X') ELSE concat('  ', lower(r_name)) END, upper(n_name), c_mktsegment,
  CASE WHEN c_custkey % 13 = 0 THEN '' ELSE concat(CAST(c_custkey AS STRING), '/', CAST(c_custkey % 7 AS STRING)) END,
  CASE WHEN c_custkey % 4 = 0 THEN abs(c_acctbal) * 1.08 ELSE abs(c_acctbal) END,
  CAST(c_custkey % 100 AS DOUBLE) * 10 + CASE WHEN c_custkey % 8 = 0 THEN 5 ELSE 0 END, CAST(floor(c_custkey / 100) AS DOUBLE) * 10,
  CAST(c_custkey % 100 AS DOUBLE) * 10 + 9 + CASE WHEN c_custkey % 8 = 0 THEN 5 ELSE 0 END, CAST(floor(c_custkey / 100) AS DOUBLE) * 10 + 9
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_custkey % 2 = 0
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run_sql(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    for name in tables:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(sql)


def parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, PARCELS, "customer", "nation", "region")
