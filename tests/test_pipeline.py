"""The hiring pipeline end to end on invented files, run twice, with a correction in between."""

import json
from datetime import datetime

import pytest

from verdigris.context import Paths, RunContext
from verdigris.plans.pipeline import SCHEMAS, Lakehouse, run_bronze, run_gold, run_silver
from verdigris.plans.sqlrun import run_sql, run_sql_file, statements
from verdigris.sources.files import bad_pages, json_pages, page_records


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


@pytest.fixture
def lake(spark, tmp_path):
    landing, api = tmp_path / "data/landing", tmp_path / "data/api"
    write(landing / "departments/departments_2021_01_01.csv", "id,department\n1,Stores\n2,Yard\n,Ghost\n3,  \n")
    write(landing / "jobs/jobs_2021_01_01.csv", "id,job\n1,Clerk\n2,Driver\n")
    write(landing / "hired_employees/hired_employees_2021_01_01.csv", "id,name,datetime,department_id,job_id\n"
          "1,Ann,2021-01-05T00:00:00Z,1,1\n2,Bob,2021-04-05T00:00:00Z,1,2\n3,,2021-04-05T00:00:00Z,1,2\nx,Eve,2021-04-05T00:00:00Z,1,2\n4,Cid,2021-05-05T00:00:00Z,3,2\n5,Dan\n")  # fmt: skip
    write(landing / "hired_employees/hired_employees_2021_01_02.csv", "id,name,datetime,department_id,job_id\n2,Bobby,2021-04-05T00:00:00Z,1,2\n6,Fay,2020-04-05T00:00:00Z,2,1\n")
    page = {"page": 1, "has_next": False, "source_system": "api", "data": [{"id": 7, "name": "Gil", "datetime": "2021-12-05T00:00:00Z", "department_id": 2, "job_id": 1}, {"id": 8, "name": "Hal", "datetime": "5 Dec", "department_id": 2, "job_id": 1}]}
    write(api / "hired_employees_page_1.json", json.dumps(page, indent=1))
    write(api / "hired_employees_page_2.json", json.dumps(page | {"data": []}, indent=1))
    return Lakehouse(spark, Paths(f"file://{tmp_path}/data", f"file://{tmp_path}/lake"))


def test_pipeline(spark, lake, tmp_path):
    lake.run(RunContext("r1", datetime(2021, 1, 3)), 2021)
    audit = {(r.record_id, r.rejection_reason) for r in spark.table("silver.rejected_records").where("table_name = 'hired_employees'").collect()}
    assert audit == {
        ("3", "name_is_null_or_empty"), (None, "id_is_null"), ("4", "department_id_not_found_in_departments"),
        ("5", "datetime_is_null; department_id_is_null; job_id_is_null"), ("8", "datetime_invalid_iso_format"),
        ("2", "duplicate_id_superseded_by_newer_record"),
    }
    assert {r.id: r.name for r in spark.table("silver.hired_employees").collect()} == {1: "Ann", 2: "Bobby", 6: "Fay", 7: "Gil"}
    assert [tuple(r) for r in lake.hires_by_quarter(2021).collect()] == [("Stores", "Clerk", 1, 0, 0, 0), ("Stores", "Driver", 0, 1, 0, 0), ("Yard", "Clerk", 0, 0, 0, 1)]
    assert [tuple(r) for r in spark.table("gold.departments_above_average_hiring_2021").collect()] == [(1, "Stores", 2)]
    found = {k: v.collect() for k, v in lake.validation(2021).items()}
    assert all(r.passed for r in found["reconciliation"]) and not found["duplicates"] and not found["orphans"]
    assert {r.table_name: r.row_count for r in found["row_counts"]}["bronze.hired_employees_raw"] == 10

    # A rerun makes no new silver version; a corrected file changes what it must.
    lake.run(RunContext("r2", datetime(2021, 1, 4)), 2021)
    assert {n: lake.table("silver", n).version() for n in ("departments", "jobs", "hired_employees", "rejected_records")} == dict.fromkeys(("departments", "jobs", "hired_employees", "rejected_records"), 0)
    write(tmp_path / "data/landing/hired_employees/hired_employees_2021_01_02.csv", "id,name,datetime,department_id,job_id\n2,Robert,2021-04-05T00:00:00Z,1,2\n")
    lake.run(RunContext("r3", datetime(2021, 1, 5)), 2021)
    assert not (tmp_path / "lake/work").exists() or not list((tmp_path / "lake/work").iterdir())
    changed = [(r.id, r.name, r._change_type) for r in lake.table("silver", "hired_employees").changes(1).collect()]
    assert sorted(changed) == [(2, "Bobby", "update_preimage"), (2, "Robert", "update_postimage")]
    assert lake.table("silver", "hired_employees").as_of(0).where("name = 'Bobby'").count() == 1


def test_steps_and_sql_over_the_layers(spark, lake):
    assert run_bronze(spark, lake.paths, "mine") == "mine"
    run_silver(spark, lake.paths)
    run_gold(spark, lake.paths, 2021)
    text = """
    -- Every landed row is valid or rejected; nothing is doubled; every reference exists.
    SELECT (SELECT count(*) FROM bronze.hired_employees_raw) - (SELECT count(*) FROM silver.hired_employees)
         - (SELECT count(*) FROM silver.rejected_records WHERE table_name = 'hired_employees') AS missing,
           (SELECT count(*) FROM (SELECT id FROM silver.hired_employees GROUP BY id HAVING count(*) > 1)) AS doubled,
           (SELECT sum(Q1 + Q2 + Q3 + Q4) FROM gold.hires_by_department_job_quarter_2021) AS hired,
           (SELECT count(*) FROM silver.hired_employees WHERE year(hire_datetime) = :year) AS in_year;
    """
    assert tuple(run_sql(spark, text, {"year": 2021}).first()) == (0, 0, 3, 3)


#: Rows without an id that differ only in which reference is missing.
MISSING = "id,name,datetime,department_id,job_id\n,Ann,2021-01-05T00:00:00Z,,1\n,Ann,2021-01-05T00:00:00Z,1,\n"


def test_rejections_that_differ_in_the_missing_reference_are_loaded(spark, lake, tmp_path):
    write(tmp_path / "data/landing/hired_employees/hired_employees_2021_01_03.csv", MISSING)
    for at in (3, 4):
        lake.run(RunContext(f"r{at}", datetime(2021, 1, at)), 2021)
    audit = lake.table("silver", "rejected_records")
    found = audit.read().where("source_file = 'hired_employees_2021_01_03.csv'").select("rejection_reason", "batch_id").collect()
    assert sorted(tuple(r) for r in found) == [("id_is_null; department_id_is_null", "r3"), ("id_is_null; job_id_is_null", "r3")] and audit.version() == 0


def test_the_run_script_loads_rejections_that_differ_in_the_missing_reference(spark, lake, tmp_path, capsys):
    from verdigris.plans import pipeline

    write(tmp_path / "data/landing/hired_employees/hired_employees_2021_01_03.csv", MISSING)
    pipeline.main(["run", "--data-root", lake.paths.data_root, "--lakehouse-root", lake.paths.lakehouse_root, "--year", "2021"], spark)
    assert capsys.readouterr().out.startswith("batch ")
    assert all(r.passed for r in lake.validation(2021)["reconciliation"].collect())


def test_bad_pages_are_told(spark, lake, tmp_path):
    write(tmp_path / "data/api/hired_employees_page_3.json", "{broken")
    pages = json_pages(spark, lake.paths.api("hired_employees_page_*.json"), SCHEMAS["hired_employees"])
    assert {(r.source_file, r.rejection_reason) for r in bad_pages(pages).collect()} == {
        ("hired_employees_page_2.json", "page_is_empty"), ("hired_employees_page_3.json", "page_is_corrupt")
    }


def test_statements():
    text = "-- a; b\nSELECT ';' AS x, \"it''s;\" /* ; */ ; \n\n;SELECT `a;b` - 1 -- end;\n"
    assert list(statements(text)) == ["SELECT ';' AS x, \"it''s;\"", "SELECT `a;b` - 1"]
    assert list(statements(" ;; -- nothing\n")) == []


def test_run_sql(spark, tmp_path):
    (tmp_path / "q.sql").write_text("SELECT 1 AS a;\nSELECT :b + 1 AS b;")
    assert run_sql_file(spark, f"file://{tmp_path}/q.sql", {"b": 4}).first().b == 5
    assert run_sql(spark, "-- none") is None


def test_text_that_does_not_parse_is_in_the_audit(spark, lake):
    lake.run(RunContext("r1", datetime(2021, 1, 3)), 2021)
    audit = {r.rejection_reason: json.loads(r.raw_payload) for r in spark.table("silver.rejected_records").where("table_name = 'hired_employees'").collect()}
    assert audit["id_is_null"]["rescued"] == "x,Eve,2021-04-05T00:00:00Z,1,2" and "id" not in audit["id_is_null"]
    assert audit["datetime_is_null; department_id_is_null; job_id_is_null"]["rescued"] == "5,Dan"
    assert "rescued" not in audit["name_is_null_or_empty"]


def test_records_of_pages_keep_their_text(spark, tmp_path):
    data = [{"id": 1, "name": "a"}, {"id": "x2", "name": "b"}, {"id": 3, "name": "c", "more": [1, {"y": 2}]}]
    write(tmp_path / "p_1.json", json.dumps({"page": 1, "has_next": False, "source_system": "api", "data": data}, indent=2))
    write(tmp_path / "p_2.json", json.dumps({"page": 2, "data": []}))
    write(tmp_path / "p_3.json", "{broken")
    pages = json_pages(spark, f"file://{tmp_path}/p_*.json", spark.createDataFrame([], "id int, name string").schema, rescue=True)
    found = {r.name: (r.id, r.rescued and json.loads(r.rescued)) for r in page_records(pages).collect()}
    assert found == {"a": (1, None), "b": (None, data[1]), "c": (3, None)}
    assert {r.rejection_reason for r in bad_pages(pages).collect()} == {"page_is_empty", "page_is_corrupt"}


def bytes_read(spark, df):
    read = lambda: sum(s.getBytesRead() for s in spark._jvm.org.apache.hadoop.fs.FileSystem.getAllStatistics())
    before = read()
    df.write.format("noop").mode("overwrite").save()
    return read() - before


def test_pages_are_read_once(spark, tmp_path):
    n = 2000
    data = ",\n".join(f'{{"id" : {i}, "name":{i}.5}}' for i in range(n))
    write(tmp_path / "p_1.json", f'{{"page": 1,\n"data": [{data}]}}\n')
    size = (tmp_path / "p_1.json").stat().st_size
    for rescue in (True, False):
        records = page_records(json_pages(spark, f"file://{tmp_path}/p_*.json", spark.createDataFrame([], "id int, name string").schema, rescue=rescue))
        assert {(r.id, r.name) for r in records.collect()} == {(i, f"{i}.5") for i in range(n)}
        assert bytes_read(spark, records) < 4 * size


def test_text_of_records_is_kept_as_it_is(spark, tmp_path):
    odd = '{ "id" :"x1",\r\n\t"name": "d\\u00e9j\u00e0 \u65e5", "more":[1.50, {"y":1e2}] }'
    write(tmp_path / "p_1.json", f'\n{{"page": 1,\n"data": [{{"id":2,"name":"b"}},\n{odd}\n]}}\n\n')
    pages = json_pages(spark, f"file://{tmp_path}/p_*.json", spark.createDataFrame([], "id int, name string").schema, rescue=True)
    assert [(r.id, r.name, r.rescued) for r in page_records(pages).collect()] == [(2, "b", None), (None, "d\u00e9j\u00e0 \u65e5", odd)]


def test_scripts_and_paths(spark, lake, monkeypatch, capfd):
    from verdigris.plans import pipeline
    from verdigris.session import get_spark

    monkeypatch.setenv("VERDIGRIS_DATA_ROOT", lake.paths.data_root)
    monkeypatch.setenv("VERDIGRIS_LAKEHOUSE_ROOT", lake.paths.lakehouse_root + "2")
    assert Paths.from_environment() == Paths(lake.paths.data_root, lake.paths.lakehouse_root + "2")
    assert Paths("d", "l").landing("a", "*.csv") == "d/landing/a/*.csv" and Paths("d", "l").table("silver", "t") == "l/silver/t"
    pipeline.main(["run", "--year", "2021"])
    pipeline.main(["validate", "--lakehouse-root", lake.paths.lakehouse_root + "2"])
    said = capfd.readouterr().out
    assert "batch " in said and all(n in said for n in ("row_counts", "reconciliation", "gold_rollup", "history", "changes"))
    assert get_spark("another", spark__sql__shuffle__partitions=spark.conf.get("spark.sql.shuffle.partitions")) is spark  # the session that runs
    assert run_sql(spark, "SELECT 41 + 1 AS answer", verbose=True).first().answer == 42 and "42" in capfd.readouterr().out
