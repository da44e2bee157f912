"""DuckDB SQL for the engine's queries, by name."""

from __future__ import annotations

from .plans.dirtied import DIRTIED_SQL

_FACTS = f"WITH {DIRTIED_SQL}"
_LOCATED = """located AS (
  SELECT o_orderkey, o_orderdate, c_nationkey, c_mktsegment AS job, n_name AS department
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
)"""
_QUARTERS = ", ".join(f"CAST(SUM(CASE WHEN quarter(o_orderdate) = {q} THEN 1 ELSE 0 END) AS BIGINT) AS Q{q}" for q in (1, 2, 3, 4))
_PIVOT = f"SELECT department, job, {_QUARTERS} FROM located WHERE year(o_orderdate) = 1998 GROUP BY department, job"
_COUNTS = "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey"
_RANKED = """ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey, l_suppkey, l_extendedprice) AS INT) AS rn
  FROM lineitem
)"""
_NATIONS = """dirty AS (
  SELECT CASE WHEN n_nationkey % 7 = 0 THEN NULL ELSE n_nationkey END AS id,
         CASE WHEN n_nationkey % 5 = 0 THEN ' ' ELSE n_name END AS department, DATE '2021-01-01' AS day FROM nation
  UNION ALL SELECT n_nationkey, concat(n_name, ' II'), DATE '2021-01-02' FROM nation WHERE n_nationkey % 3 = 0
), why AS (
  SELECT *, array_to_string(list_filter([CASE WHEN id IS NULL THEN 'id_is_null' END,
    CASE WHEN department IS NULL OR trim(department) = '' THEN 'department_is_null_or_empty' END], lambda x: x IS NOT NULL), '; ') AS reason
  FROM dirty
), judged AS (
  SELECT id, department, CASE WHEN reason <> '' THEN reason
    WHEN row_number() OVER (PARTITION BY id, reason = '' ORDER BY day DESC) > 1 THEN 'duplicate_id_superseded_by_newer_record' ELSE '' END AS reason
  FROM why
)"""
_MERGED = """merged AS (
  SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN o_custkey + 1 ELSE o_custkey END AS o_custkey, o_totalprice FROM orders
)"""
_HIRED = f"""{_FACTS}, judged AS (
  SELECT list_filter([
      CASE WHEN id IS NULL THEN 'id_is_null' END,
      CASE WHEN name IS NULL OR trim(name) = '' THEN 'name_is_null_or_empty' END,
      CASE WHEN datetime IS NULL THEN 'datetime_is_null' END,
      CASE WHEN datetime IS NOT NULL AND hire_datetime IS NULL THEN 'datetime_invalid_iso_format' END,
      CASE WHEN department_id IS NULL THEN 'department_id_is_null' END,
      CASE WHEN department_id IS NOT NULL AND (n_nationkey IS NULL OR n_nationkey % 6 = 0) THEN 'department_id_not_found_in_departments' END,
      CASE WHEN job_id IS NULL THEN 'job_id_is_null' END,
      CASE WHEN job_id IS NOT NULL AND r_regionkey IS NULL THEN 'job_id_not_found_in_jobs' END
    ], lambda x: x IS NOT NULL) AS reasons, hire_datetime, department_id, n_name, r_name
  FROM parsed LEFT JOIN nation ON department_id = n_nationkey LEFT JOIN region ON job_id = r_regionkey WHERE source_file = 'orders_1998_01_01.csv'
)"""
_REFUSED = "'hired_employees' AS table_name, CAST(id AS VARCHAR) AS record_id, 'landing_csv' AS source_system, source_file, reason AS rejection_reason"

ORACLES: dict[str, str] = {
    "quarter_pivot": f"WITH {_LOCATED} {_PIVOT} ORDER BY department, job",
    "above_average": f"""WITH {_LOCATED}, hires AS (SELECT c_nationkey, COUNT(*) AS hired FROM located WHERE year(o_orderdate) = 1998 GROUP BY 1),
mean AS (SELECT AVG(hired) AS m FROM hires)
SELECT n_nationkey AS id, n_name AS department, hired FROM hires JOIN nation ON n_nationkey = c_nationkey CROSS JOIN mean WHERE hired > m""",
    "gold_sanity_rollup": f"WITH {_LOCATED} SELECT department, CAST(SUM(Q1 + Q2 + Q3 + Q4) AS BIGINT) AS total_hires FROM ({_PIVOT}) GROUP BY department",
    "count_by_key": _COUNTS,
    "avg_of_counts": f"SELECT AVG(n) AS avg_n FROM ({_COUNTS})",
    "cross_join_scalar": f"WITH c AS ({_COUNTS}), a AS (SELECT AVG(n) AS m FROM c) SELECT o_custkey, n FROM c CROSS JOIN a WHERE n > m",
    "year_filter": "SELECT o_orderkey, year(o_orderdate) AS y, quarter(o_orderdate) AS q FROM orders WHERE year(o_orderdate) = 1998",
    "filter_eq": f"{_FACTS} SELECT id, name FROM dirtied WHERE source_file = 'orders_1998_01_02.csv'",
    "null_predicates": f"""{_FACTS} SELECT id, department_id, job_id FROM dirtied
WHERE (id IS NOT NULL AND name IS NULL) OR (job_id IS NULL AND department_id IS NOT NULL)""",
    "null_or_blank": f"{_FACTS} SELECT id, name, source_file FROM dirtied WHERE name IS NULL OR trim(name) = ''",
    "star_inner_join": f"WITH {_LOCATED} SELECT o_orderkey, department, job FROM located",
    "fk_probe_left_join": """SELECT o_orderkey, o_custkey, c_custkey IS NOT NULL AS found
FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0) ON o_custkey = c_custkey""",
    "orphan_check": """SELECT o_orderkey, o_custkey FROM orders
WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal >= 0)
   OR NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""",
    "dedup_row_number": f"WITH {_RANKED} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, rn FROM ranked",
    "dedup_kept": f"WITH {_RANKED} SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM ranked WHERE rn = 1",
    "dedup_superseded": f"WITH {_RANKED} SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM ranked WHERE rn > 1",
    "duplicate_check": "SELECT l_orderkey, l_linenumber, COUNT(*) AS n FROM lineitem GROUP BY 1, 2 HAVING COUNT(*) > 1",
    "parse_iso_ts": f"{_FACTS} SELECT id, datetime, hire_datetime FROM parsed",
    "batch_date": f"{_FACTS} SELECT DISTINCT source_file, batch_date FROM parsed",
    "distinct_files": f"{_FACTS} SELECT DISTINCT source_file FROM dirtied",
    "reasons_array": f"{_FACTS} SELECT id, source_file, array_to_string(reasons, '; ') AS reasons, len(reasons) AS n_reasons FROM reasoned",
    "valid_split": f"{_FACTS} SELECT len(reasons) = 0 AS valid, COUNT(*) AS n FROM reasoned GROUP BY 1",
    "fact_validate_clean": f"{_FACTS} SELECT id, name, hire_datetime, department_id, job_id FROM tagged WHERE rank = 1",
    "fact_validate_rejected": f"{_FACTS} SELECT {_REFUSED} FROM refused",
    "rejected_projection": f"{_FACTS} SELECT {_REFUSED}, TIMESTAMP '1998-02-01 00:00:00' AS rejection_timestamp, 'batch' AS batch_id FROM refused",
    "raw_payload_json": f"""{_FACTS} SELECT id, source_file, CAST(json_merge_patch('{{}}', json_object('id', id, 'name', name, 'datetime', datetime,
  'department_id', department_id, 'job_id', job_id)) AS VARCHAR) AS raw_payload FROM dirtied""",
    "rejection_breakdown": f"{_FACTS} SELECT 'hired_employees' AS table_name, reason AS rejection_reason, COUNT(*) AS n FROM refused GROUP BY 1, 2",
    "dimension_validate": f"WITH {_NATIONS} SELECT id, department, reason FROM judged",
    "union_sources": f"{_FACTS} SELECT id, name, job_id, source_file FROM dirtied",
    "rejected_union": f"""{_FACTS}, {_NATIONS} SELECT 'departments' AS table_name, COUNT(*) AS n FROM judged WHERE reason <> ''
UNION ALL SELECT 'hired_employees', COUNT(*) FROM refused""",
    "layer_counts": f"""{_FACTS} SELECT 'bronze' AS table_name, COUNT(*) AS row_count FROM dirtied
UNION ALL SELECT 'silver', COUNT(*) FROM tagged WHERE rank = 1 UNION ALL SELECT 'rejected', COUNT(*) FROM refused""",
    "reconcile_fact": f"""{_FACTS}, c AS (SELECT (SELECT COUNT(*) FROM dirtied) AS b, (SELECT COUNT(*) FROM tagged WHERE rank = 1) AS s, (SELECT COUNT(*) FROM refused) AS r)
SELECT 'hired_employees' AS entity, b AS bronze_raw_count, s AS silver_valid_count, r AS rejected_count, s + r AS reconciled_total, b = s + r AS passed FROM c""",
    "reconcile_dims": f"""WITH {_NATIONS}, c AS (
  SELECT 'departments' AS entity, (SELECT COUNT(*) FROM dirty) AS b, (SELECT COUNT(*) FROM judged WHERE reason = '') AS s,
         (SELECT COUNT(*) FROM judged WHERE reason <> '') AS r
  UNION ALL SELECT 'jobs', (SELECT COUNT(*) FROM region), (SELECT COUNT(*) FROM region), 0)
SELECT entity, b AS bronze_raw_count, s AS silver_valid_count, CAST(r AS BIGINT) AS rejected_count, CAST(s + r AS BIGINT) AS reconciled_total, b = s + r AS passed FROM c""",
    "table_scan": "SELECT c_custkey, c_name FROM customer WHERE c_nationkey >= 3",
    "one_row_relation": "SELECT (SELECT COUNT(*) FROM orders) AS n, (SELECT COUNT(*) FROM orders) + 1 AS n_plus_one",
    "canonical_projection": "SELECT c_custkey AS id, c_name AS name, CAST(c_nationkey AS VARCHAR) AS nation FROM customer",
    "explode_struct": """SELECT vec_id, CAST(i - 1 AS INT) AS i, CAST(embedding[i] AS DOUBLE) AS x
FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)""",
    "bronze_csv_scan": "SELECT c_custkey, c_name, c_nationkey FROM customer",
    "source_file_basename": "SELECT true AS is_basename, COUNT(*) AS n FROM customer",
    "bronze_json_scan": "SELECT n_nationkey AS id, n_name AS name, 'api' AS source_system FROM nation",
    "page_rejects": "SELECT 'api' AS source_system, 'page_is_empty' AS rejection_reason, CAST(99 AS BIGINT) AS page",
    "bronze_metadata": """SELECT n_nationkey, s AS source_system, TIMESTAMP '1998-02-01 00:00:00' AS ingestion_timestamp, DATE '1998-02-01' AS ingestion_date,
  'batch' AS batch_id FROM (SELECT n_nationkey, 'landing_csv' AS s FROM nation UNION ALL SELECT r_regionkey, 'api' FROM region)""",
    "bronze_load": f"{_FACTS} SELECT source_file, COUNT(*) AS n, COUNT(id) AS n_ids FROM dirtied GROUP BY source_file",
    "merge_upsert": f"WITH {_MERGED} SELECT * FROM merged",
    "merge_idempotent": f"""WITH {_MERGED} SELECT COUNT(*) AS n, COUNT(DISTINCT o_orderkey) AS n_keys, CAST(SUM(o_custkey) AS BIGINT) AS s,
  CAST(1 AS BIGINT) AS version FROM merged""",
    "time_travel_count": "SELECT COUNT(*) AS row_count_at_version_0 FROM orders WHERE o_orderkey % 2 = 0",
    "change_feed": """SELECT o_orderkey, o_custkey, 'insert' AS _change_type, CAST(1 AS BIGINT) AS _commit_version FROM orders WHERE o_orderkey % 2 = 1
UNION ALL SELECT o_orderkey, o_custkey, 'update_preimage', 1 FROM orders WHERE o_orderkey % 6 = 0
UNION ALL SELECT o_orderkey, o_custkey + 1, 'update_postimage', 1 FROM orders WHERE o_orderkey % 6 = 0""",
    "table_history": "SELECT CAST(1 AS BIGINT) AS version, 'MERGE' AS operation UNION ALL SELECT 0, 'CREATE'",
    "replace_by_source_file": f"""{_FACTS} SELECT id, name, source_file FROM dirtied WHERE source_file = 'orders_1998_01_01.csv'
UNION ALL SELECT id, 'it''s new', source_file FROM dirtied WHERE source_file = 'orders_1998_01_02.csv' AND id % 2 = 0""",
    "silver_load": f"{_FACTS} SELECT id, name, hire_datetime, department_id, job_id, CAST(0 AS BIGINT) AS version FROM tagged WHERE rank = 1",
    "audit_load": f"{_FACTS} SELECT 'hired_employees' AS table_name, reason AS rejection_reason, COUNT(*) AS n FROM refused GROUP BY 1, 2",
    "audit_first_seen": f"""{_FACTS}, seen AS (SELECT source_file, reason, source_file = 'orders_1998_01_01.csv' AND reason <> 'id_is_null' AS known FROM refused)
SELECT source_file, CASE WHEN reason = 'id_is_null' THEN 'id_is_missing' ELSE reason END AS rejection_reason, CASE WHEN known THEN 'batch' ELSE 'batch 2' END AS batch_id,
  CASE WHEN known THEN TIMESTAMP '1998-02-01 00:00:00' ELSE TIMESTAMP '1998-02-02 00:00:00' END AS rejection_timestamp, COUNT(*) AS n, CAST(1 AS BIGINT) AS version
FROM seen GROUP BY ALL""",
    "table_exists": 'SELECT false AS "before", true AS "after"',
    "table_properties": "SELECT CAST(0 AS BIGINT) AS version, 'audit' AS owner, 'true' AS change_feed",
    "registered_view": f"WITH {_MERGED} SELECT * FROM merged",
    "sql_time_travel": "SELECT COUNT(*) AS n, CAST(SUM(o_custkey) AS BIGINT) AS s FROM orders WHERE o_orderkey % 2 = 0",
    "sql_changes": """SELECT 'insert' AS _change_type, COUNT(*) AS n FROM orders WHERE o_orderkey % 2 = 1
UNION ALL SELECT 'update_preimage', COUNT(*) FROM orders WHERE o_orderkey % 6 = 0
UNION ALL SELECT 'update_postimage', COUNT(*) FROM orders WHERE o_orderkey % 6 = 0""",
    "sql_history": "SELECT CAST(1 AS BIGINT) AS version, 'MERGE' AS operation UNION ALL SELECT 0, 'CREATE'",
    "sql_two_versions": "SELECT o_orderkey, o_custkey AS was, o_custkey + 1 AS is_now FROM orders WHERE o_orderkey % 6 = 0",
    "scattered_upserts": """WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber = 1 AND l_orderkey % 97 IN (1, 2, 3)),
g AS (SELECT CAST(l_orderkey % 97 AS BIGINT) AS v, COUNT(*) AS n, CAST(SUM(l_orderkey) AS BIGINT) AS s FROM l GROUP BY 1)
SELECT _change_type, v AS _commit_version, n AS "rows", s FROM g, (VALUES ('update_preimage'), ('update_postimage'), ('now')) AS t(_change_type)""",
    "compacted_table": f"""WITH {_MERGED} SELECT CAST(a AS BIGINT) AS after, COUNT(*) AS n, CAST(SUM(o_custkey) AS BIGINT) AS s
FROM merged, (VALUES (0), (1)) AS t(a) WHERE o_orderkey % 5 <> 0 GROUP BY a""",
    "constrained_merge": """SELECT o_orderkey, o_custkey, CAST(2 AS BIGINT) AS refused, CAST(1 AS BIGINT) AS version FROM orders
WHERE o_totalprice >= 1000 AND (o_orderkey % 2 = 0 OR o_orderkey % 3 <> 0)""",
    "new_columns": f"""WITH {_MERGED} SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 6 = 0 OR o_orderkey % 2 = 1 THEN concat('n', o_orderkey) END AS note,
  CAST(3 AS BIGINT) AS columns_before FROM merged""",
    "rescued_values": """SELECT CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderkey AS VARCHAR) END AS record_id,
  concat_ws('; ', CASE WHEN o_orderkey % 7 = 0 THEN 'id_is_null' END, CASE WHEN o_orderkey % 11 = 0 THEN 'department_id_is_null' END) AS rejection_reason,
  concat(CASE WHEN o_orderkey % 7 = 0 THEN 'x' ELSE '' END, o_orderkey, ',Ann,1998-02-03T00:00:00Z,',
         CASE WHEN o_orderkey % 11 = 0 THEN concat('d', o_orderkey) ELSE '1' END, ',1') AS rescued
FROM orders WHERE o_orderkey % 7 = 0 OR o_orderkey % 11 = 0""",
    "rescued_records": """SELECT CASE WHEN c_custkey % 5 <> 0 THEN CAST(c_custkey AS INT) END AS id, c_name AS name,
  CASE WHEN c_custkey % 5 = 0 THEN concat('{"id":"x', c_custkey, '","name":"', c_name, '"}') END AS rescued, 'api' AS source_system FROM customer""",
    "hiring_load": f"""{_HIRED}
SELECT 'hired_employees' AS table_name, array_to_string(reasons, '; ') AS what, COUNT(*) AS n FROM judged WHERE len(reasons) > 0 GROUP BY 2
UNION ALL SELECT 'departments', 'department_is_null_or_empty', COUNT(*) FROM nation WHERE n_nationkey % 6 = 0
UNION ALL SELECT 'departments', 'silver', COUNT(*) FROM nation WHERE n_nationkey % 6 <> 0
UNION ALL SELECT 'jobs', 'silver', COUNT(*) FROM region
UNION ALL SELECT 'hired_employees', 'silver', COUNT(*) FROM judged WHERE len(reasons) = 0
UNION ALL SELECT 'gold', 'hires', COUNT(*) FROM judged WHERE len(reasons) = 0 AND year(hire_datetime) = 1998""",
    "scripted_load": f"""{_HIRED}, good AS (SELECT * FROM judged WHERE len(reasons) = 0), hires AS (SELECT * FROM good WHERE year(hire_datetime) = 1998),
per AS (SELECT department_id, COUNT(*) AS n FROM hires GROUP BY 1), bad AS (SELECT 1 FROM judged WHERE len(reasons) > 0 UNION ALL SELECT 1 FROM nation WHERE n_nationkey % 6 = 0),
counts(name, n) AS (
  SELECT 'bronze.departments_raw', COUNT(*) FROM nation
  UNION ALL SELECT 'bronze.jobs_raw', COUNT(*) FROM region
  UNION ALL SELECT 'bronze.hired_employees_raw', COUNT(*) FROM judged
  UNION ALL SELECT 'silver.departments', COUNT(*) FROM nation WHERE n_nationkey % 6 <> 0
  UNION ALL SELECT 'silver.jobs', COUNT(*) FROM region
  UNION ALL SELECT 'silver.hired_employees', COUNT(*) FROM good
  UNION ALL SELECT 'silver.rejected_records', COUNT(*) FROM bad
  UNION ALL SELECT 'gold.hires_by_department_job_quarter_1998', COUNT(*) FROM (SELECT DISTINCT n_name, r_name FROM hires)
  UNION ALL SELECT 'gold.departments_above_average_hiring_1998', COUNT(*) FROM per WHERE n > (SELECT AVG(n) FROM per)
)
SELECT 'row_counts' AS "check", name, n, CAST(NULL AS BOOLEAN) AS passed FROM counts
UNION ALL SELECT 'reconciliation', name[8:-5], n, true FROM counts WHERE name LIKE 'bronze%'
UNION ALL SELECT unnest(['duplicates', 'orphans']), 'hired_employees', 0, true
UNION ALL SELECT 'gold_rollup', n_name, COUNT(*), NULL FROM hires GROUP BY n_name
UNION ALL SELECT 'audit', 'of this batch', COUNT(*), NULL FROM bad""",
    "saved_table": "SELECT * FROM nation",
    "gold_rebuild": f"WITH {_LOCATED} {_PIVOT}",
    "in_memory_source": "SELECT r_name, label FROM region JOIN (VALUES (0, 'none'), (1, 'one'), (2, NULL)) AS t(k, label) ON r_regionkey = k",
}
