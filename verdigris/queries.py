"""The engine's queries by name: every operator over the driver's tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .context import Paths, RunContext, own_schema, shared_path
from .functions.columns import batch_date, in_year, iso_timestamp, null_or_blank, payload
from .operators import checks, metrics
from .operators.validate import REJECTED_KEYS, SEEN, ForeignKey, clean, dimension_spec, event_spec, judge, newest, probe, ranked, rejected, stamp, tag, union_all
from .plans.dirtied import dirtied
from .plans.sqlrun import run_sql
from .sources.catalog import rebuild_table, save_as_table
from .sources.files import bad_pages, csv_source, json_pages, page_records
from .sources.versioned import VersionedTable

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
YEAR = 1998
#: Records of a landed JSON page at most: a larger table has more pages.
PAGE = 5_000


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__.rstrip("_")] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share."""
    return shared_path(spark, name)


# Metrics


def located_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders with their customer's market segment and nation."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.col("c_mktsegment").alias("job"))
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("department"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))


@query
def quarter_pivot(spark, sf_dir):
    return metrics.quarter_pivot(located_orders(spark, sf_dir), "o_orderdate", YEAR, ["department", "job"]).orderBy("department", "job")


@query
def above_average(spark, sf_dir):
    counts = metrics.counts_in_year(located_orders(spark, sf_dir), "o_orderdate", YEAR, "c_nationkey")
    nation = table(spark, sf_dir, "nation")
    found = metrics.above_average(counts).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return found.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("department"), "hired").orderBy(F.desc("hired"), "id")


@query
def gold_sanity_rollup(spark, sf_dir):
    return checks.gold_rollup(quarter_pivot(spark, sf_dir))


@query
def count_by_key(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))


@query
def avg_of_counts(spark, sf_dir):
    return count_by_key(spark, sf_dir).agg(F.avg("n").alias("avg_n"))


@query
def cross_join_scalar(spark, sf_dir):
    return metrics.above_average(count_by_key(spark, sf_dir), "n")


# Filters and predicates


@query
def year_filter(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").where(in_year(F.col("o_orderdate"), YEAR))
    return orders.select("o_orderkey", F.year("o_orderdate").cast("long").alias("y"), F.quarter("o_orderdate").cast("long").alias("q"))


@query
def filter_eq(spark, sf_dir):
    return dirtied(spark, sf_dir).where(F.col("source_file") == "orders_1998_01_02.csv").select("id", "name")


@query
def null_predicates(spark, sf_dir):
    known = F.col("id").isNotNull() & F.col("name").isNull() | F.col("job_id").isNull() & F.col("department_id").isNotNull()
    return dirtied(spark, sf_dir).where(known).select("id", "department_id", "job_id")


@query
def null_or_blank_(spark, sf_dir):
    return dirtied(spark, sf_dir).where(null_or_blank(F.col("name"))).select("id", "name", "source_file")


# Joins


def open_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("id"))


@query
def star_inner_join(spark, sf_dir):
    return located_orders(spark, sf_dir).select("o_orderkey", "department", "job")


@query
def fk_probe_left_join(spark, sf_dir):
    fk = ForeignKey("o_custkey", "customers")
    orders = probe(table(spark, sf_dir, "orders"), {"customers": open_customers(spark, sf_dir)}, [fk])
    return orders.select("o_orderkey", "o_custkey", F.col(fk.found).isNotNull().alias("found"))


@query
def orphan_check(spark, sf_dir):
    fks = [ForeignKey("o_custkey", "customers"), ForeignKey("o_orderkey", "lines", "l_orderkey")]
    dims = {"customers": open_customers(spark, sf_dir), "lines": table(spark, sf_dir, "lineitem")}
    return checks.orphans(table(spark, sf_dir, "orders"), dims, fks, ["o_orderkey", "o_custkey"])


# Windows


LINE_KEYS = ["l_orderkey", "l_linenumber"]
LINE_TIES = ["l_partkey", "l_suppkey", "l_extendedprice"]


def dated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(*LINE_KEYS, "l_shipdate", *LINE_TIES)


@query
def dedup_row_number(spark, sf_dir):
    rows = ranked(dated_lines(spark, sf_dir), LINE_KEYS, ["l_shipdate"], LINE_TIES, "rn")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("rn").cast("int").alias("rn"))


@query
def dedup_kept(spark, sf_dir):
    return newest(dated_lines(spark, sf_dir), LINE_KEYS, ["l_shipdate"], LINE_TIES).select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


@query
def dedup_superseded(spark, sf_dir):
    rows = ranked(dated_lines(spark, sf_dir), LINE_KEYS, ["l_shipdate"], LINE_TIES, "rn")
    return rows.where("rn > 1").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


@query
def duplicate_check(spark, sf_dir):
    return checks.duplicates(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


# Data quality on the dirtied facts

REFERENCES = (ForeignKey("department_id", "departments"), ForeignKey("job_id", "jobs"))
FACTS = event_spec("hired_employees", REFERENCES)
RUN = RunContext("batch", datetime(1998, 2, 1))


def dimensions(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {
        "departments": table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("department")),
        "jobs": table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("job")),
    }


def judged_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(FACTS, stamp(dirtied(spark, sf_dir), RUN, "landing_csv"), dimensions(spark, sf_dir))


def tagged_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts, judged once for all that a query reads of them."""
    return tag(FACTS, stamp(dirtied(spark, sf_dir), RUN, "landing_csv"), dimensions(spark, sf_dir))


@query
def parse_iso_ts(spark, sf_dir):
    return dirtied(spark, sf_dir).select("id", "datetime", iso_timestamp(F.col("datetime")).alias("hire_datetime"))


@query
def batch_date_(spark, sf_dir):
    files = dirtied(spark, sf_dir).select("source_file").distinct()
    return files.select("source_file", batch_date(F.col("source_file"), RUN.timestamp()).alias("batch_date"))


@query
def distinct_files(spark, sf_dir):
    return dirtied(spark, sf_dir).select("source_file").distinct()


@query
def reasons_array(spark, sf_dir):
    return judged_facts(spark, sf_dir).select("id", "source_file", F.array_join("_reasons", "; ").alias("reasons"), F.size("_reasons").cast("long").alias("n_reasons"))


@query
def valid_split(spark, sf_dir):
    valid = F.size("_reasons") == 0
    return judged_facts(spark, sf_dir).groupBy(valid.alias("valid")).agg(F.count("*").alias("n"))


@query
def fact_validate_clean(spark, sf_dir):
    return clean(FACTS, tagged_facts(spark, sf_dir))


@query
def fact_validate_rejected(spark, sf_dir):
    found = rejected(FACTS, tagged_facts(spark, sf_dir), RUN)
    return found.select("table_name", "record_id", "source_system", "source_file", "rejection_reason")


@query
def rejected_projection(spark, sf_dir):
    found = rejected(FACTS, tagged_facts(spark, sf_dir), RUN)
    return found.select("table_name", "record_id", "source_system", "source_file", "rejection_reason", "rejection_timestamp", "batch_id")


@query
def raw_payload_json(spark, sf_dir):
    return dirtied(spark, sf_dir).select("id", "source_file", payload(["id", "name", "datetime", "department_id", "job_id"]).alias("raw_payload"))


@query
def rejection_breakdown(spark, sf_dir):
    return checks.rejections(rejected(FACTS, tagged_facts(spark, sf_dir), RUN))


def dirty_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    first = n.select(F.when(k % 7 == 0, None).otherwise(k).alias("id"), F.when(k % 5 == 0, " ").otherwise(F.col("n_name")).alias("department"), F.lit("d_2021_01_01.csv").alias("source_file"))
    again = n.where(k % 3 == 0).select(k.alias("id"), F.concat("n_name", F.lit(" II")).alias("department"), F.lit("d_2021_01_02.csv").alias("source_file"))
    return stamp(first.unionByName(again), RUN, "landing_csv")


@query
def dimension_validate(spark, sf_dir):
    spec = dimension_spec("departments", "department")
    rows = tag(spec, dirty_nations(spark, sf_dir))
    kept = clean(spec, rows).select("id", "department", F.lit("").alias("reason"))
    lost = rejected(spec, rows, RUN).select(F.col("record_id").cast("int").alias("id"), F.get_json_object("raw_payload", "$.department").alias("department"), F.col("rejection_reason").alias("reason"))
    return kept.unionByName(lost)


@query
def union_sources(spark, sf_dir):
    rows = dirtied(spark, sf_dir)
    even = F.coalesce(F.col("id") % 2 == 0, F.lit(False))
    api = rows.where(even).select("source_file", "job_id", "id", "name")
    return rows.where(~even).select("id", "name", "job_id", "source_file").unionByName(api)


@query
def rejected_union(spark, sf_dir):
    spec = dimension_spec("departments", "department")
    lost = rejected(spec, tag(spec, dirty_nations(spark, sf_dir)), RUN)
    found = union_all(lost, rejected(FACTS, tagged_facts(spark, sf_dir), RUN))
    return found.groupBy("table_name").agg(F.count("*").alias("n"))


# Checks


@query
def layer_counts(spark, sf_dir):
    rows = tagged_facts(spark, sf_dir)
    return checks.row_counts({"bronze": dirtied(spark, sf_dir), "silver": clean(FACTS, rows), "rejected": rows.where("_rank is null or _rank = 2")})


@query
def reconcile_fact(spark, sf_dir):
    return checks.reconcile_tagged(FACTS.name, dirtied(spark, sf_dir), tagged_facts(spark, sf_dir))


@query
def reconcile_dims(spark, sf_dir):
    spec = dimension_spec("departments", "department")
    bronze = dirty_nations(spark, sf_dir)
    rows = tag(spec, bronze)
    none = dimension_spec("jobs", "job")
    jobs = dimensions(spark, sf_dir)["jobs"].withColumn("source_file", F.lit("jobs_2021_01_01.csv"))
    tagged_jobs = tag(none, stamp(jobs, RUN, "landing_csv"))
    lost = union_all(rejected(spec, rows, RUN), rejected(none, tagged_jobs, RUN))
    return checks.reconcile_all({"departments": (bronze, clean(spec, rows)), "jobs": (jobs, clean(none, tagged_jobs))}, lost)


# Sources


def temporary(df: DataFrame, name: str) -> str:
    """A view of df, under a name that no other run has."""
    view = f"verdigris_{name}_{uuid.uuid4().hex}"
    df.createOrReplaceTempView(view)
    return view


@query
def table_scan(spark, sf_dir):
    name = temporary(table(spark, sf_dir, "customer"), "customer")
    return run_sql(spark, f"-- one; comment\nSELECT c_custkey, c_name FROM {name} WHERE c_mktsegment <> ';' AND c_nationkey >= :least;", {"least": 3})


@query
def one_row_relation(spark, sf_dir):
    name = temporary(table(spark, sf_dir, "orders"), "orders")
    return run_sql(spark, f"SELECT (SELECT count(*) FROM {name}) AS n, (SELECT count(*) FROM {name}) + 1 AS n_plus_one")


@query
def canonical_projection(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").cast("string").alias("nation"))


@query
def explode_struct(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    parts = F.transform("embedding", lambda x, i: F.struct(i.alias("i"), x.cast("double").alias("x")))
    return vectors.select("vec_id", F.explode(parts).alias("rec")).select("vec_id", "rec.*")


def landed_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer written as CSV and read again."""
    from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

    path = work_dir(spark, "csv")
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    rows.write.option("header", True).csv(path)
    schema = StructType([StructField("c_custkey", LongType()), StructField("c_name", StringType()), StructField("c_nationkey", IntegerType())])
    return csv_source(spark, f"{path}/*.csv", schema)


@query
def bronze_csv_scan(spark, sf_dir):
    return landed_customers(spark, sf_dir).drop("source_file")


@query
def source_file_basename(spark, sf_dir):
    from .functions.columns import basename

    rows = landed_customers(spark, sf_dir)
    plain = F.col("source_file").rlike("^part-[^/]*[.]csv$") & (F.col("source_file") == basename(F.concat(F.lit("a/b/"), F.col("source_file"))))
    return rows.groupBy(plain.alias("is_basename")).agg(F.count("*").alias("n"))


def landed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation as JSON pages, one per region and one empty, spread over lines."""
    from pyspark.sql.types import IntegerType, StringType, StructField, StructType

    path = work_dir(spark, "pages")
    record = F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    pages = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(record)).alias("data"))
    empty = pages.limit(1).select(F.lit(99).alias("n_regionkey"), F.array().cast(pages.schema["data"].dataType).alias("data"))
    pages = pages.unionByName(empty).select(F.col("n_regionkey").alias("page"), F.lit(True).alias("has_next"), F.lit("api").alias("source_system"), "data")
    text = F.regexp_replace(F.to_json(F.struct("*")), "([,{])", "$1\n")
    pages.select(text.alias("value"), "page").repartition("page").write.partitionBy("page").text(path)
    schema = StructType([StructField("id", IntegerType()), StructField("name", StringType())])
    return json_pages(spark, f"{path}/page=*/*.txt", schema)


@query
def bronze_json_scan(spark, sf_dir):
    return page_records(landed_pages(spark, sf_dir)).select("id", "name", "source_system")


@query
def page_rejects(spark, sf_dir):
    return bad_pages(landed_pages(spark, sf_dir)).select("source_system", "rejection_reason", F.col("page").cast("long").alias("page"))


@query
def bronze_metadata(spark, sf_dir):
    rows = stamp(table(spark, sf_dir, "nation").select("n_nationkey"), RUN, "landing_csv")
    own = stamp(table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_nationkey"), F.lit("api").alias("source_system")), RUN, "landing_csv")
    return rows.unionByName(own)


# Versioned tables


def new_table(spark: SparkSession, name: str) -> VersionedTable:
    return VersionedTable(spark, work_dir(spark, name))


@query
def bronze_load(spark, sf_dir):
    made = new_table(spark, "bronze")
    made.replace_by_key(dirtied(spark, sf_dir))
    return made.read().groupBy("source_file").agg(F.count("*").alias("n"), F.count("id").alias("n_ids"))


def order_batches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The even orders; then a batch that changes every sixth of them and brings the odd ones."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    first = orders.where("o_orderkey % 2 = 0")
    changed = first.where("o_orderkey % 6 = 0").withColumn("o_custkey", F.col("o_custkey") + 1)
    return first, changed.unionByName(orders.where("o_orderkey % 2 = 1"))


def merged_orders(spark: SparkSession, sf_dir: str, times: int = 1) -> VersionedTable:
    made = new_table(spark, "orders")
    first, second = order_batches(spark, sf_dir)
    made.merge(first, ["o_orderkey"])
    for _ in range(times):
        made.merge(second, ["o_orderkey"], skip_unchanged=True)
    return made


@query
def merge_upsert(spark, sf_dir):
    return merged_orders(spark, sf_dir).read()


@query
def merge_idempotent(spark, sf_dir):
    made = merged_orders(spark, sf_dir, times=2)
    return made.read().agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("n_keys"), F.sum("o_custkey").alias("s"), F.lit(made.version()).cast("long").alias("version"))


@query
def time_travel_count(spark, sf_dir):
    return merged_orders(spark, sf_dir).as_of(0).agg(F.count("*").alias("row_count_at_version_0"))


@query
def change_feed(spark, sf_dir):
    return merged_orders(spark, sf_dir).changes(1).select("o_orderkey", "o_custkey", "_change_type", "_commit_version")


@query
def table_history(spark, sf_dir):
    return merged_orders(spark, sf_dir, times=2).history().select("version", "operation")


@query
def replace_by_source_file(spark, sf_dir):
    made = new_table(spark, "files")
    rows = dirtied(spark, sf_dir)
    made.replace_by_key(rows)
    fewer = rows.where("source_file = 'orders_1998_01_02.csv' AND id % 2 = 0").withColumn("name", F.lit("it's new"))
    made.replace_by_key(fewer)
    return made.read().select("id", "name", "source_file")


# Loads, catalog and SQL over versions


@query
def silver_load(spark, sf_dir):
    """Clean facts merged twice; the second time nothing changes."""
    made, rows = new_table(spark, "silver"), tagged_facts(spark, sf_dir)
    made.merge(clean(FACTS, rows), ["id"], {"change_feed": True}, skip_unchanged=True)
    made.merge(clean(FACTS, rows), ["id"], skip_unchanged=True)
    return made.read().withColumn("version", F.lit(made.version()).cast("long"))


@query
def audit_load(spark, sf_dir):
    """Rejections merged, then those of fewer rows: what was rejected once stays in the audit."""
    made, rows = new_table(spark, "audit"), tagged_facts(spark, sf_dir)
    found = rejected(FACTS, rows, RUN)
    made.merge(found, list(REJECTED_KEYS), skip_unchanged=True)
    made.merge(found.where("source_file = 'orders_1998_01_02.csv'"), list(REJECTED_KEYS), skip_unchanged=True)
    return checks.rejections(made.read())


@query
def audit_first_seen(spark, sf_dir):
    """Rejections of one file, then a later run that sees them again and those of the other file too: what is known keeps the batch that
    saw it first, unless its reason has become another."""
    made, rows = new_table(spark, "seen"), tagged_facts(spark, sf_dir)
    made.merge(rejected(FACTS, rows, RUN).where("source_file = 'orders_1998_01_01.csv'"), list(REJECTED_KEYS))
    reason = F.col("rejection_reason")
    later = rejected(FACTS, rows, RunContext("batch 2", datetime(1998, 2, 2))).withColumn("batch_id", F.lit("batch 2"))
    later = later.withColumn("rejection_reason", F.when(reason == "id_is_null", "id_is_missing").otherwise(reason))
    for _ in range(2):
        made.merge(later, list(REJECTED_KEYS), skip_unchanged=True, incidental=SEEN)
    counts = made.read().groupBy("source_file", "rejection_reason", "batch_id", "rejection_timestamp").agg(F.count("*").alias("n"))
    return counts.withColumn("version", F.lit(made.version()).cast("long"))


@query
def table_exists(spark, sf_dir):
    made = new_table(spark, "exists")
    before = made.exists()
    made.create(table(spark, sf_dir, "region"), ["r_regionkey"], {"owner": "audit"})
    return spark.range(1).select(F.lit(before).alias("before"), F.lit(made.exists()).alias("after"))


@query
def table_properties(spark, sf_dir):
    made = new_table(spark, "properties")
    made.create(table(spark, sf_dir, "region"), ["r_regionkey"], {"change_feed": True, "owner": "audit"})
    return made.history().select("version", F.get_json_object("properties", "$.owner").alias("owner"), F.get_json_object("properties", "$.change_feed").alias("change_feed"))


@query
def registered_view(spark, sf_dir):
    """A view registered at version 0 shows version 1."""
    first, second = order_batches(spark, sf_dir)
    made = new_table(spark, "viewed")
    made.merge(first, ["o_orderkey"])
    name = new_name(spark, "orders_view")
    made.register(*name.split("."))
    made.merge(second, ["o_orderkey"])
    return spark.table(name)


def new_name(spark: SparkSession, name: str) -> str:
    """A table name in a schema that no other run has."""
    return f"{own_schema(spark, 'queries')}.{name}"


def registered_orders(spark: SparkSession, sf_dir: str) -> str:
    name = new_name(spark, "orders")
    merged_orders(spark, sf_dir).register(*name.split("."))
    return name


@query
def sql_time_travel(spark, sf_dir):
    return run_sql(spark, f"SELECT count(*) AS n, sum(o_custkey) AS s FROM {registered_orders(spark, sf_dir)} VERSION AS OF 0")


@query
def sql_changes(spark, sf_dir):
    name = registered_orders(spark, sf_dir)
    return run_sql(spark, f"SELECT _change_type, count(*) AS n FROM table_changes('{name}', 1) GROUP BY _change_type")


@query
def sql_history(spark, sf_dir):
    return run_sql(spark, f"DESCRIBE HISTORY {registered_orders(spark, sf_dir)}").select("version", "operation")


@query
def saved_table(spark, sf_dir):
    """Saved twice: the second time in place of the first."""
    nation, name = table(spark, sf_dir, "nation"), new_name(spark, "saved")
    save_as_table(nation.limit(3), name, comment="three")
    return save_as_table(nation, name, comment="it's all")


@query
def gold_rebuild(spark, sf_dir):
    """The pivot as a managed table, rebuilt, and sorted again as it is read."""
    name = new_name(spark, "hires_by_quarter")
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {name.split('.')[0]}")
    for year in (YEAR - 1, YEAR):
        rows = metrics.quarter_pivot(located_orders(spark, sf_dir), "o_orderdate", year, ["department", "job"])
        rebuild_table(spark, name, rows, f"Rebuilt for {year}")
    return spark.table(name).orderBy("department", "job")


@query
def sql_two_versions(spark, sf_dir):
    """What an update changed, as a join of two versions by the table's own name."""
    name = registered_orders(spark, sf_dir)
    short = name.split(".")[1]
    return run_sql(spark, f"""SELECT {short}.o_orderkey, old.o_custkey AS was, {short}.o_custkey AS is_now FROM {name} VERSION AS OF 1
      JOIN {name} VERSION AS OF 0 old ON {short}.o_orderkey = old.o_orderkey WHERE {short}.o_custkey <> old.o_custkey""")


# Upserts of few rows, constraints, new columns


def line_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return lines.dropDuplicates(["l_orderkey", "l_linenumber"]).drop("l_partkey", "l_suppkey", "l_quantity").withColumn("n", F.lit(0).cast("long"))


@query
def scattered_upserts(spark, sf_dir):
    """A few rows from all over the table, upserted again and again; what the versions changed, by one scan of their deltas."""
    made, lines = new_table(spark, "lines"), line_table(spark, sf_dir)
    keys = ["l_orderkey", "l_linenumber"]
    made.merge(lines, keys)
    for k in (1, 2, 3):
        made.merge(lines.where((F.col("l_orderkey") % 97 == k) & (F.col("l_linenumber") == 1)).withColumn("n", F.lit(k).cast("long")), keys)
    told = made.changes(1).groupBy("_change_type", "_commit_version").agg(F.count("*").alias("rows"), F.sum("l_orderkey").alias("s"))
    now = made.read().where("n > 0").groupBy(F.lit("now").alias("_change_type"), F.col("n").alias("_commit_version")).agg(F.count("*").alias("rows"), F.sum("l_orderkey").alias("s"))
    return told.unionByName(now)


@query
def compacted_table(spark, sf_dir):
    """Deltas that insert, update and delete, and the table before and after they are made one segment."""
    made = merged_orders(spark, sf_dir)
    made.merge(made.read().where("o_orderkey % 5 <> 0"), ["o_orderkey"], delete_unmatched=True)
    before = made.version()
    made.compact()
    told = lambda v: made.as_of(v).agg(F.lit(v - before).cast("long").alias("after"), F.count("*").alias("n"), F.sum("o_custkey").alias("s"))
    return told(before).unionByName(told(before + 1))


@query
def constrained_merge(spark, sf_dir):
    """A batch that breaks a constraint leaves no version; the same rows without those that break it do."""
    from .sources.versioned import ConstraintViolation

    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    made = new_table(spark, "constrained")
    made.create(orders.where("o_totalprice >= 1000 and o_orderkey % 2 = 0"), ["o_orderkey"], unique=True, not_null=["o_custkey"], checks={"price": "o_totalprice >= 1000"})
    bad = orders.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 3 == 0, F.lit(1.0).cast(orders.schema["o_totalprice"].dataType)).otherwise(F.col("o_totalprice")))
    refused = 0
    for batch in (bad, orders.withColumn("o_custkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey")))):
        try:
            made.merge(batch, ["o_orderkey"])
        except ConstraintViolation:
            refused += 1
    made.merge(bad.where("o_totalprice >= 1000 and o_orderkey % 2 = 1"), ["o_orderkey"])
    return made.read().select("o_orderkey", "o_custkey", F.lit(refused).cast("long").alias("refused"), F.lit(made.version()).cast("long").alias("version"))


@query
def new_columns(spark, sf_dir):
    """A batch with a column more: older rows have nulls there, the older version is as it was."""
    first, second = order_batches(spark, sf_dir)
    made = new_table(spark, "evolved")
    made.merge(first, ["o_orderkey"])
    made.merge(second.withColumn("note", F.concat(F.lit("n"), F.col("o_orderkey"))), ["o_orderkey"], add_columns=True)
    return made.read().select("o_orderkey", "o_custkey", "note", F.lit(len(made.as_of(0).columns)).cast("long").alias("columns_before"))


# Landed text that does not parse, and the load of all layers


def landed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts as CSV files, in which some ids and references are no numbers."""
    from .plans.pipeline import SCHEMAS

    k, path = F.col("o_orderkey"), work_dir(spark, "lines")
    lines = table(spark, sf_dir, "orders").select(
        F.when(k % 7 == 0, F.concat(F.lit("x"), k)).otherwise(k.cast("string")).alias("id"),
        F.lit("Ann").alias("name"),
        F.lit("1998-02-03T00:00:00Z").alias("datetime"),
        F.when(k % 11 == 0, F.concat(F.lit("d"), k)).otherwise("1").alias("department_id"),
        F.lit(1).alias("job_id"),
    )
    lines.write.option("header", True).csv(path)
    return csv_source(spark, f"{path}/*.csv", SCHEMAS[FACTS.name], rescue=True).withColumn("source_system", F.lit("landing_csv"))


@query
def rescued_values(spark, sf_dir):
    """The audit holds the line of which a value did not parse."""
    tagged = tag(FACTS, stamp(landed_lines(spark, sf_dir), RUN), dimensions(spark, sf_dir))
    lost = rejected(FACTS, tagged, RUN)
    return lost.select("record_id", "rejection_reason", F.get_json_object("raw_payload", "$.rescued").alias("rescued"))


@query
def rescued_records(spark, sf_dir):
    """The same for records of JSON pages: their text is kept, and their pages' other records are as they are."""
    from pyspark.sql.types import IntegerType, StringType, StructField, StructType

    path, k = work_dir(spark, "records"), F.col("c_custkey")
    record = F.concat(F.lit('{"id":'), F.when(k % 5 == 0, F.concat(F.lit('"x'), k, F.lit('"'))).otherwise(k.cast("string")), F.lit(',"name":"'), "c_name", F.lit('"}'))
    pages = table(spark, sf_dir, "customer").groupBy(F.floor(k / PAGE).alias("page")).agg(F.array_join(F.sort_array(F.collect_list(record)), ",\n").alias("data"))
    text = F.concat(F.lit('{"page":'), "page", F.lit(',"has_next":true,"source_system":"api",\n"data":['), "data", F.lit("]}"))
    pages.select(text.alias("value"), "page").repartition("page").write.partitionBy("page").text(path)
    schema = StructType([StructField("id", IntegerType()), StructField("name", StringType())])
    return page_records(json_pages(spark, f"{path}/page=*/*.txt", schema, rescue=True)).select("id", "name", "rescued", "source_system")


def landed_hiring(spark: SparkSession, sf_dir: str) -> tuple[Paths, dict[str, DataFrame]]:
    """Landed files of dimensions and facts, one page of records without any, and the dimensions' rows."""
    root = work_dir(spark, "hiring")
    paths, dims = Paths(f"{root}/data", f"{root}/lake"), dimensions(spark, sf_dir)
    dims["departments"] = dims["departments"].withColumn("department", F.when(F.col("id") % 6 != 0, F.col("department")))
    facts = dirtied(spark, sf_dir).where("source_file = 'orders_1998_01_01.csv'").drop("source_file")
    for name, rows in {**dims, FACTS.name: facts}.items():
        rows.write.option("header", True).csv(paths.landing(name))
    spark.createDataFrame([('{"page": 1, "has_next": false, "source_system": "api", "data": []}',)], "value string").write.text(f"{root}/data/api/{FACTS.name}_page_1.json")
    return paths, dims


@query
def hiring_load(spark, sf_dir):
    """All layers from landed files: dimensions first, facts validated against what of them was loaded, twice. What silver and the
    audit hold, and gold's total."""
    from .plans.pipeline import Lakehouse

    paths, dims = landed_hiring(spark, sf_dir)
    lake = Lakehouse(spark, paths, prefix=f"{own_schema(spark, 'hiring')}_")
    for at in (1, 2):
        lake.run(RunContext(f"batch {at}", datetime(1998, 2, at)), YEAR)
    lost = checks.rejections(lake.table("silver", "rejected_records").read()).select("table_name", F.col("rejection_reason").alias("what"), "n")
    held = [lake.table("silver", n).read().agg(F.count("*").alias("n")).select(F.lit(n).alias("table_name"), F.lit("silver").alias("what"), "n") for n in (*dims, FACTS.name)]
    gold = lake.hires_by_quarter(YEAR).agg(F.coalesce(F.sum(F.expr("Q1 + Q2 + Q3 + Q4")), F.lit(0)).cast("long").alias("n")).select(F.lit("gold").alias("table_name"), F.lit("hires").alias("what"), "n")
    return union_all(lost, *held, gold)


@query
def scripted_load(spark, sf_dir):
    """The run script over landed files, then what the validation script shows of the lakehouse it leaves: rows of every table, the
    reconciliation, what the other checks find, and the audit's rows of the batch that the script names."""
    import contextlib
    import io

    from .plans.pipeline import Lakehouse, main

    (paths, _), prefix, said = landed_hiring(spark, sf_dir), f"{own_schema(spark, 'scripted')}_", io.StringIO()
    with contextlib.redirect_stdout(said):
        main(["run", "--data-root", paths.data_root, "--lakehouse-root", paths.lakehouse_root, "--year", str(YEAR), "--prefix", prefix], spark)
    batch = said.getvalue().split("batch ")[-1].strip()
    lake = Lakehouse(spark, paths, prefix=prefix)
    told, none = lake.validation(YEAR), F.lit(None).cast("boolean").alias("passed")
    row = lambda check, name, n, passed=none: (F.lit(check).alias("check"), name.alias("name"), n.alias("n"), passed)
    empty = lambda c: told[c].agg(F.count("*").alias("k")).select(*row(c, F.lit(FACTS.name), F.col("k"), (F.col("k") == 0).alias("passed")))
    mine = lake.table("silver", "rejected_records").read().where(F.col("batch_id") == batch).agg(F.count("*").alias("k"))
    return union_all(
        told["row_counts"].select(*row("row_counts", F.col("table_name"), F.col("row_count"))),
        told["reconciliation"].select(*row("reconciliation", F.col("entity"), F.col("reconciled_total"), F.col("passed"))),
        empty("duplicates"),
        empty("orphans"),
        told["gold_rollup"].select(*row("gold_rollup", F.col("department"), F.col("total_hires"))),
        mine.select(*row("audit", F.lit("of this batch"), F.col("k"))),
    )


@query
def in_memory_source(spark, sf_dir):
    rows = spark.createDataFrame([(0, "none"), (1, "one"), (2, None)], "k int, label string")
    return table(spark, sf_dir, "region").join(rows, F.col("r_regionkey") == F.col("k")).select("r_name", "label")
