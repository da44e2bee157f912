"""Rules, reasons, deduplication and rejected records on small invented rows."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from verdigris.context import RunContext, clear_shared, own_schema, shared_dir
from verdigris.functions.columns import batch_date, iso_timestamp, null_or_blank
from verdigris.operators import checks, metrics
from verdigris.operators.validate import REJECTED_KEYS, SEEN, SUPERSEDED, ForeignKey, clean, newest, probe, ranked, rejected, stamp, tag
from verdigris.plans.pipeline import DEPARTMENTS, EMPLOYEES
from verdigris.sources.versioned import VersionedTable

RUN = RunContext("b1", datetime(2021, 3, 1, 12))
FACT = "id long, name string, datetime string, department_id long, job_id long, source_file string"


def facts(spark, *rows):
    return stamp(spark.createDataFrame(rows, FACT), RUN, "landing_csv")


def dims(spark, departments=(1,), jobs=(1,)):
    return {
        "departments": spark.createDataFrame([(d, f"D{d}") for d in departments], "id long, department string"),
        "jobs": spark.createDataFrame([(j, f"J{j}") for j in jobs], "id long, job string"),
    }


def reasons(df):
    return sorted((r.record_id, r.rejection_reason) for r in df.collect())


def test_dimension_rules(spark):
    rows = spark.createDataFrame([(1, "Ops"), (None, "Nobody"), (2, ""), (3, "  "), (4, None), (None, None)], "id int, department string")
    rows = tag(DEPARTMENTS, stamp(rows.withColumn("source_file", F.lit("d_2021_01_01.csv")), RUN, "landing_csv"))
    assert [tuple(r) for r in clean(DEPARTMENTS, rows).collect()] == [(1, "Ops")]
    why = rejected(DEPARTMENTS, rows, RUN).select("record_id", "rejection_reason").collect()
    assert {tuple(r) for r in why} == {
        (None, "id_is_null"), ("2", "department_is_null_or_empty"), ("3", "department_is_null_or_empty"), ("4", "department_is_null_or_empty"),
        (None, "id_is_null; department_is_null_or_empty"),
    }


def test_newer_file_wins_and_the_loser_is_kept(spark):
    rows = spark.createDataFrame([(1, "Old", "d_2021_01_01.csv"), (1, "New", "d_2021_01_02.csv")], "id int, department string, source_file string")
    rows = tag(DEPARTMENTS, stamp(rows, RUN, "landing_csv"))
    assert clean(DEPARTMENTS, rows).first().department == "New"
    lost = rejected(DEPARTMENTS, rows, RUN).collect()
    assert [(r.rejection_reason, r.source_file) for r in lost] == [(SUPERSEDED, "d_2021_01_01.csv")]


def test_fact_rules_in_order(spark):
    rows = facts(
        spark,
        (1, "Ann", "2021-02-01T08:00:00Z", 1, 1, "f_2021_01_01.csv"),
        (2, None, "2021-02-01T08:00:00Z", 1, 1, "f_2021_01_01.csv"),
        (3, "Bo", "soon", 1, 1, "f_2021_01_01.csv"),
        (4, "Cy", "2021-02-01T08:00:00Z", 99, 1, "f_2021_01_01.csv"),
        (5, "Di", "2021-02-01T08:00:00Z", 1, None, "f_2021_01_01.csv"),
        (6, " ", None, None, 77, "f_2021_01_01.csv"),
    )
    tagged = tag(EMPLOYEES, rows, dims(spark))
    assert [r.id for r in clean(EMPLOYEES, tagged).collect()] == [1]
    assert reasons(rejected(EMPLOYEES, tagged, RUN)) == [
        ("2", "name_is_null_or_empty"),
        ("3", "datetime_invalid_iso_format"),
        ("4", "department_id_not_found_in_departments"),
        ("5", "job_id_is_null"),
        ("6", "name_is_null_or_empty; datetime_is_null; department_id_is_null; job_id_not_found_in_jobs"),
    ]


def test_invalid_newer_row_supersedes_nothing(spark):
    rows = facts(spark, (42, "Old", "2021-02-01T08:00:00Z", 1, 1, "f_2021_01_01.csv"), (42, "", "2021-02-01T08:00:00Z", 1, 1, "f_2021_01_02.csv"))
    tagged = tag(EMPLOYEES, rows, dims(spark))
    assert [r.name for r in clean(EMPLOYEES, tagged).collect()] == ["Old"]
    assert reasons(rejected(EMPLOYEES, tagged, RUN)) == [("42", "name_is_null_or_empty")]


def test_repeated_dimension_ids_multiply_nothing(spark):
    rows = facts(spark, (1, "Ann", "2021-02-01T08:00:00Z", 1, 1, "f_2021_01_01.csv"))
    assert tag(EMPLOYEES, rows, dims(spark, (1, 1, 1))).count() == 1


def test_order_of_ties_does_not_depend_on_the_input(spark):
    rows = [(7, n, "2021-02-01T08:00:00Z", 1, 1, "f_2021_01_01.csv") for n in ("c", "a", "b")]
    kept = {clean(EMPLOYEES, tag(EMPLOYEES, facts(spark, *order), dims(spark))).first().name for order in (rows, rows[::-1], rows[1:] + rows[:1])}
    assert kept == {"a"}


def test_equal_rejections_are_numbered(spark):
    same = (None, "Ann", "2021-02-01T08:00:00Z", 1, 1, "f_2021_01_01.csv")
    found = rejected(EMPLOYEES, tag(EMPLOYEES, facts(spark, same, same), dims(spark)), RUN).collect()
    assert sorted(r.occurrence for r in found) == [1, 2]
    assert '"id"' not in found[0].raw_payload


@pytest.mark.parametrize("text, good", [
    ("2021-02-01T08:00:00Z", True), ("2021-02-30T08:00:00Z", False), ("2021-02-01T08:00:00.5Z", False),
    ("2021-02-01T08:00:00+02:00", False), (" 2021-02-01T08:00:00Z", False), ("", False), (None, False),
])
def test_timestamps_are_strict(spark, text, good):
    found = spark.createDataFrame([(text,)], "t string").select(iso_timestamp(F.col("t"))).first()[0]
    assert found == (datetime(2021, 2, 1, 8) if good else None)


def test_batch_date_falls_back(spark):
    rows = spark.createDataFrame([("x_2021_05_06.csv",), ("page_1.json",), ("x_2021_13_40.csv",), (None,)], "f string")
    found = [str(r[0]) for r in rows.select(batch_date(F.col("f"), F.lit("2020-01-02 03:04:05").cast("timestamp_ntz"))).collect()]
    assert found == ["2021-05-06", "2020-01-02", "2020-01-02", "2020-01-02"]


def test_blank_means_spaces(spark):
    rows = spark.createDataFrame([("",), (" ",), ("\t",), (None,), ("x",)], "t string")
    assert [r[0] for r in rows.select(null_or_blank(F.col("t"))).collect()] == [True, True, False, True, False]


def test_metrics(spark):
    rows = [(1, 1, "2021-01-31"), (2, 1, "2021-04-01"), (3, 1, "2021-06-30"), (4, 2, "2021-12-31"), (5, 2, "2020-12-31"), (6, 3, None)]
    df = spark.createDataFrame(rows, "id int, d int, t string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    pivot = {r.d: tuple(r)[1:] for r in metrics.quarter_pivot(df, "t", 2021, ["d"]).collect()}
    assert pivot == {1: (1, 2, 0, 0), 2: (0, 0, 0, 1)}
    above = metrics.above_average(metrics.counts_in_year(df, "t", 2021, "d")).collect()
    assert [(r.d, r.hired) for r in above] == [(1, 3)]


def test_checks(spark):
    audit = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y")], "table_name string, rejection_reason string")
    assert [tuple(r) for r in checks.rejections(audit).collect()] == [("a", "x", 2), ("b", "y", 1)]
    found = checks.reconcile("a", spark.range(5), spark.range(3), audit).first()
    assert found.passed and found.reconciled_total == 5
    assert not checks.reconcile("b", spark.range(5), spark.range(3), audit).first().passed


def test_entities_reconcile_by_one_read_of_the_audit(spark, tmp_path):
    spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y"), ("other", "y"), (None, "y")], "table_name string, rejection_reason string").write.parquet(f"{tmp_path}/audit")
    found = checks.reconcile_all({"a": (spark.range(5), spark.range(3)), "b": (spark.range(5), spark.range(3)), "none": (spark.range(0), spark.range(0))}, spark.read.parquet(f"{tmp_path}/audit"))
    assert sorted(tuple(r) for r in found.collect()) == [("a", 5, 3, 2, 5, True), ("b", 5, 3, 1, 4, False), ("none", 0, 0, 0, 0, True)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 1


def test_rows_of_one_id_are_never_brought_together(spark):
    """A table of one id: the row that stays is found without a window, and every task keeps its rows."""
    n = 20_000
    rows = spark.range(0, n, 1, 8).select(
        F.lit(7).cast("long").alias("id"), F.concat(F.lit("n"), F.pmod(F.col("id") * 7919, F.lit(n))).alias("name"), F.lit("2021-02-01T08:00:00Z").alias("datetime"),
        F.lit(1).cast("long").alias("department_id"), F.lit(1).cast("long").alias("job_id"), F.lit("f_2021_01_01.csv").alias("source_file"),
    )
    tagged = tag(EMPLOYEES, stamp(rows, RUN, "landing_csv"), dims(spark))
    assert "Window" not in tagged._jdf.queryExecution().optimizedPlan().toString()
    assert [r.name for r in clean(EMPLOYEES, tagged).collect()] == ["n0"]
    assert tagged.where("_rank = 2").count() == n - 1


def test_equal_rejections_of_all_tasks_are_numbered_apart(spark, monkeypatch):
    monkeypatch.setattr("verdigris.operators.validate.CHUNK_BITS", 10)
    n = 40_000
    rows = spark.range(0, n, 1, 8).select(
        F.lit(None).cast("long").alias("id"), F.when(F.col("id") % 4 == 0, "Bob").otherwise("Ann").alias("name"), F.lit("2021-02-01T08:00:00Z").alias("datetime"),
        F.lit(1).cast("long").alias("department_id"), F.lit(1).cast("long").alias("job_id"), F.lit("f_2021_01_01.csv").alias("source_file"),
    )
    tagged = tag(EMPLOYEES, stamp(rows, RUN, "landing_csv"), dims(spark))
    found = rejected(EMPLOYEES, tagged, RUN).groupBy("record_hash").agg(F.min("occurrence"), F.max("occurrence"), F.count_distinct("occurrence"), F.count("*")).collect()
    assert sorted(tuple(r)[1:] for r in found) == [(1, n // 4, n // 4, n // 4), (1, 3 * n // 4, 3 * n // 4, 3 * n // 4)]
    assert tagged.groupBy("name", F.shiftright("_row", 10)).count().agg(F.max("count")).first()[0] <= 1024  # what one window counts


def test_rejections_that_differ_in_which_values_are_null(spark, tmp_path):
    at = ("2021-02-01T08:00:00Z", "f_2021_01_01.csv")
    lost = facts(spark, (None, "Ann", at[0], None, 1, at[1]), (None, "Ann", at[0], 1, None, at[1]), (None, None, "Ann", 1, 1, at[1]), (None, "Ann", None, 1, 1, at[1]))
    found = rejected(EMPLOYEES, tag(EMPLOYEES, lost, dims(spark)), RUN)
    assert {r.occurrence for r in found.collect()} == {1} and found.select("record_hash").distinct().count() == 4
    audit = VersionedTable(spark, f"file://{tmp_path}/audit")
    for first in (found.where("rejection_reason <> 'id_is_null; job_id_is_null'"), found, found):
        audit.merge(first, list(REJECTED_KEYS), skip_unchanged=True, incidental=SEEN)
    assert audit.version() == 1 and audit.read().count() == 4
    assert sorted(r.rejection_reason for r in audit.read().collect()) == sorted(r.rejection_reason for r in found.collect())


def test_rejections_of_one_hash_are_numbered_apart(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("verdigris.operators.validate.record_hash", lambda business: F.lit(1).cast("long"))
    lost = facts(spark, *[(i, n, "bad", 1, 1, "f_2021_01_01.csv") for i in (None, 1) for n in ("Ann", "Bob", "Cid")])
    found = rejected(EMPLOYEES, tag(EMPLOYEES, lost, dims(spark)), RUN)
    assert sorted((r.record_id or "", r.occurrence) for r in found.collect()) == [("", 1), ("", 2), ("", 3), ("1", 1), ("1", 2), ("1", 3)]
    audit = VersionedTable(spark, f"file://{tmp_path}/audit")
    for _ in range(2):
        audit.merge(found, list(REJECTED_KEYS), skip_unchanged=True)
    assert checks.rejections(audit.read()).agg(F.sum("n")).first()[0] == 6 and audit.version() == 0


def test_one_of_equal_valid_rows_stays(spark):
    same = (7, "Ann", "2021-02-01T08:00:00Z", 1, 1, "f_2021_01_01.csv")
    tagged = tag(EMPLOYEES, facts(spark, same, same, same), dims(spark))
    assert clean(EMPLOYEES, tagged).count() == 1
    assert sorted(r.occurrence for r in rejected(EMPLOYEES, tagged, RUN).collect()) == [1, 2]


def test_ranks_of_a_hot_key_are_counted_in_ranges(spark):
    """Half of the rows are of one key, many of them equal: no range holds the key, and the numbers are those of one window."""
    n = 20_000
    k = F.col("id")
    rows = spark.range(0, n, 1, 8).select(
        F.when(k % 2 == 0, 7).when(k % 97 != 0, k % 50).cast("long").alias("k"), F.when(k % 11 != 0, F.expr("date_add(date'2021-01-01', cast(id * 31 % 40 as int))")).alias("at"), (k % 3).alias("v")
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # or these few rows would be one range
    try:
        found = ranked(rows, ["k"], ["at"], ["v"], "rn", path=(where := f"{spark.conf.get('spark.checkpoint.dir')}/ranked-here"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found.columns == ["k", "at", "v", "rn"]
    spread = spark.read.parquet(where).where("k = 7").groupBy("_range").count().collect()
    assert len(spread) > 1 and max(r["count"] for r in spread) < n // 2
    got, want = {}, {}
    for r in found.collect():
        got.setdefault(r.k, []).append((r.rn, r.at, r.v))
    for r in rows.collect():
        want.setdefault(r.k, []).append((r.at is None, -r.at.toordinal() if r.at else 0, r.v, r.at))
    assert {key: sorted(v) for key, v in got.items()} == {key: [(i, x[3], x[2]) for i, x in enumerate(sorted(v, key=lambda x: x[:3]), 1)] for key, v in want.items()}


@pytest.mark.parametrize("kind, values", [
    ("long", [-(2**63), -1, 0, 5, 2**63 - 1, None]), ("string", ["", "a", "ab", "b", "é", "漢", None]), ("double", [float("-inf"), -0.5, 0.0, 2.5, float("inf"), float("nan"), None]),
    ("decimal(5,2)", [None, 1, -2, 3]), ("date", [datetime(1900, 1, 1).date(), datetime(2021, 3, 1).date(), None]), ("timestamp", [datetime(1960, 1, 1), datetime(2021, 3, 1, 1), None]),
])
def test_the_newest_row_of_any_type(spark, kind, values):
    """Of every two values the one that Spark sorts first in descending order stays; equals are decided by the tie."""
    rows = [(i * 100 + j, side, x) for i, a in enumerate(values) for j, b in enumerate(values) for side, x in ((0, a), (1, b))]
    df = spark.createDataFrame([(k, s) for k, s, _ in rows], "k long, side int")
    shown = spark.createDataFrame([(i, str(x) if kind.startswith("decimal") and x is not None else x) for i, x in enumerate(values)], f"i long, x {'string' if kind.startswith('decimal') else kind}")
    at = shown.select("i", F.col("x").cast(kind).alias("at"))
    df = df.join(at, F.when(F.col("side") == 0, F.floor(F.col("k") / 100)).otherwise(F.col("k") % 100) == F.col("i")).select("k", "side", "at")
    from pyspark.sql import Window

    first = df.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("at"), "side"))).where("rn = 1")
    assert sorted((r.k, r.side) for r in newest(df, ["k"], ["at"], ["side"]).collect()) == sorted((r.k, r.side) for r in first.collect())


def test_an_order_that_cannot_be_turned_is_refused(spark):
    with pytest.raises(TypeError):
        newest(spark.sql("SELECT 1 AS k, array(1) AS at, 2 AS v"), ["k"], ["at"], ["v"])


def test_rows_without_a_reference_are_spread(spark):
    """A shuffled probe of rows of which most have no reference: their partition is split."""
    fk = ForeignKey("d", "departments")
    rows = spark.range(0, 40_000, 1, 4).select(F.when(F.col("id") % 4 == 0, F.col("id") % 400).alias("d"), F.col("id").alias("v"))
    known = spark.range(0, 200, 8).union(spark.range(0, 16, 8))
    small = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
             "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB"}
    before = {c: spark.conf.get(c) for c in small}
    try:
        for c, v in small.items():
            spark.conf.set(c, v)
        found = probe(rows, {"departments": known}, [fk])
        got = found.collect()
        assert "skew=true" in found._jdf.queryExecution().executedPlan().toString()
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert len(got) == 40_000 and all((r[fk.found] is not None) == (r.d is not None and r.d % 8 == 0 and r.d < 200) for r in got)


def test_what_steps_have_written_is_cleared(spark):
    """Only what this application wrote for its own steps goes; a caller's own path stays."""
    import os

    clear_shared(spark)
    root = shared_dir(spark).removeprefix("file://")
    before, mine = set(os.listdir(root)), f"{shared_dir(spark)}/callers-own"
    row = (7, "Ann", "2021-02-01T08:00:00Z", 1, 1, "f_2021_01_01.csv")
    assert clean(EMPLOYEES, tag(EMPLOYEES, facts(spark, row), dims(spark))).count() == 1
    assert ranked(facts(spark, row), ["id"], ["datetime"], ["name"], "rn").count() == 1
    assert tag(EMPLOYEES, facts(spark, row), dims(spark), mine).count() == 1
    made = set(os.listdir(root)) - before
    assert len(made) == 3 and clear_shared(spark) == 2 and clear_shared(spark) == 0
    assert set(os.listdir(root)) - before == {"callers-own"}


def test_schemas_of_steps_are_dropped(spark):
    """With what is in them; a schema that only looks alike stays."""
    clear_shared(spark)
    mine, others = own_schema(spark, "step"), own_schema(spark, "step")[:-4] + "_not"
    for schema in (mine, f"{mine}_gold", others):
        spark.sql(f"CREATE SCHEMA {schema}")
        spark.range(3).write.saveAsTable(f"{schema}.t")
    clear_shared(spark)
    assert [s for s in (mine, f"{mine}_gold", others) if spark.catalog.databaseExists(s)] == [others]
    spark.sql(f"DROP SCHEMA {others} CASCADE")
