"""A deterministic table of facts with defects, made from orders: every rule has rows that fail it.

department is a nation's key (0 to 24) and job a region's (0 to 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import ISO_FORMAT


def dirtied(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k, customer, text = F.col("o_orderkey"), F.col("o_custkey"), F.date_format("o_orderdate", ISO_FORMAT)
    every = lambda n: k % n == 0
    null = F.lit(None)
    first = orders.select(
        F.when(every(101), null).otherwise(k).alias("id"),
        F.when(every(13), null).when(every(29), "  ").otherwise(F.col("o_orderpriority")).alias("name"),
        F.when(every(37), null).when(every(41), "bad_ts").otherwise(text).alias("datetime"),
        F.when(every(43), null).when(every(47), 999).otherwise(customer % 25).cast("long").alias("department_id"),
        F.when(every(53), null).when(every(59), 999).otherwise(customer % 5).cast("long").alias("job_id"),
        F.lit("orders_1998_01_01.csv").alias("source_file"),
    )
    again = orders.where(every(19)).select(
        k.alias("id"),
        F.concat("o_orderpriority", F.lit(" v2")).alias("name"),
        text.alias("datetime"),
        (customer % 25).alias("department_id"),
        (customer % 5).alias("job_id"),
        F.lit("orders_1998_01_02.csv").alias("source_file"),
    )
    return first.unionByName(again)


#: The same rows in DuckDB.
DIRTIED_SQL = """dirtied AS (
  SELECT CASE WHEN o_orderkey % 101 = 0 THEN NULL ELSE o_orderkey END AS id,
         CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 29 = 0 THEN '  ' ELSE o_orderpriority END AS name,
         CASE WHEN o_orderkey % 37 = 0 THEN NULL WHEN o_orderkey % 41 = 0 THEN 'bad_ts'
              ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') END AS datetime,
         CAST(CASE WHEN o_orderkey % 43 = 0 THEN NULL WHEN o_orderkey % 47 = 0 THEN 999 ELSE o_custkey % 25 END AS BIGINT) AS department_id,
         CAST(CASE WHEN o_orderkey % 53 = 0 THEN NULL WHEN o_orderkey % 59 = 0 THEN 999 ELSE o_custkey % 5 END AS BIGINT) AS job_id,
         'orders_1998_01_01.csv' AS source_file
  FROM orders
  UNION ALL
  SELECT o_orderkey, concat(o_orderpriority, ' v2'), strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ'), o_custkey % 25, o_custkey % 5,
         'orders_1998_01_02.csv'
  FROM orders WHERE o_orderkey % 19 = 0
), parsed AS (
  SELECT *, try_strptime(datetime, '%Y-%m-%dT%H:%M:%SZ') AS hire_datetime,
         CAST(try_strptime(regexp_extract(source_file, '([0-9]{4}_[0-9]{2}_[0-9]{2})', 1), '%Y_%m_%d') AS DATE) AS batch_date
  FROM dirtied
), reasoned AS (
  SELECT p.*, list_filter([
      CASE WHEN p.id IS NULL THEN 'id_is_null' END,
      CASE WHEN name IS NULL OR trim(name) = '' THEN 'name_is_null_or_empty' END,
      CASE WHEN datetime IS NULL THEN 'datetime_is_null' END,
      CASE WHEN datetime IS NOT NULL AND hire_datetime IS NULL THEN 'datetime_invalid_iso_format' END,
      CASE WHEN department_id IS NULL THEN 'department_id_is_null' END,
      CASE WHEN department_id IS NOT NULL AND n_nationkey IS NULL THEN 'department_id_not_found_in_departments' END,
      CASE WHEN job_id IS NULL THEN 'job_id_is_null' END,
      CASE WHEN job_id IS NOT NULL AND r_regionkey IS NULL THEN 'job_id_not_found_in_jobs' END
    ], lambda x: x IS NOT NULL) AS reasons
  FROM parsed p LEFT JOIN nation ON department_id = n_nationkey LEFT JOIN region ON job_id = r_regionkey
), tagged AS (
  SELECT *, CASE WHEN len(reasons) = 0 THEN row_number() OVER (
      PARTITION BY id, len(reasons) = 0 ORDER BY batch_date DESC, source_file, name, datetime, department_id, job_id) END AS rank
  FROM reasoned
), refused AS (
  SELECT *, CASE WHEN rank > 1 THEN 'duplicate_id_superseded_by_newer_record' ELSE array_to_string(reasons, '; ') END AS reason
  FROM tagged WHERE rank IS NULL OR rank > 1
)"""
