"""Bronze, silver and gold of the hiring model: landed files to metrics.

Bronze lands the files, replacing what came from the same file before. Silver validates dimensions, then facts
against the loaded dimensions, upserts what is clean and audits what isn't. Gold computes the metrics. Every
step can be run again: nothing is doubled and, where nothing changed, no version is made.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..context import Paths, RunContext
from ..operators import checks, metrics
from ..operators.validate import REJECTED_KEYS, SEEN, EntitySpec, ForeignKey, clean, dimension_spec, event_spec, rejected, stamp, tag, union_all
from ..sources.catalog import rebuild_table
from ..sources.files import csv_source, json_pages, page_records
from ..sources.versioned import VersionedTable

DEPARTMENTS = dimension_spec("departments", "department")
JOBS = dimension_spec("jobs", "job")
REFERENCES = (ForeignKey("department_id", "departments"), ForeignKey("job_id", "jobs"))
EMPLOYEES = event_spec("hired_employees", REFERENCES)
DIMENSIONS = (DEPARTMENTS, JOBS)

_NAMED = lambda name: StructType([StructField("id", IntegerType()), StructField(name, StringType())])
SCHEMAS = {
    "departments": _NAMED("department"),
    "jobs": _NAMED("job"),
    "hired_employees": StructType(
        [
            StructField("id", IntegerType()),
            StructField("name", StringType()),
            StructField("datetime", StringType()),
            StructField("department_id", IntegerType()),
            StructField("job_id", IntegerType()),
        ]
    ),
}


@dataclass(frozen=True)
class Lakehouse:
    """An audit keeps every rejection; with forget_resolved those that no longer hold go, so that counts reconcile
    after corrections too. Tables are shown in the schemas bronze, silver and gold, with `prefix` before their names."""

    spark: SparkSession
    paths: Paths
    forget_resolved: bool = False
    prefix: str = ""

    def table(self, layer: str, name: str) -> VersionedTable:
        return VersionedTable(self.spark, self.paths.table(layer, name))

    # Bronze

    def landed(self, name: str, run: RunContext) -> DataFrame:
        """The rows of an entity's CSV files, and for facts those of the API pages too."""
        rows = csv_source(self.spark, self.paths.landing(name, "*.csv"), SCHEMAS[name], rescue=True).withColumn("source_system", F.lit("landing_csv"))
        if name == EMPLOYEES.name:
            pages = json_pages(self.spark, self.paths.api(f"{name}_page_*.json"), SCHEMAS[name], rescue=True)
            rows = rows.unionByName(page_records(pages))
        return stamp(rows, run)

    def bronze(self, run: RunContext) -> str:
        for name in SCHEMAS:
            table = self.table("bronze", f"{name}_raw")
            table.replace_by_key(self.landed(name, run), add_columns=True)
            table.register(f"{self.prefix}bronze", f"{name}_raw")
        return run.batch_id

    # Silver

    def _load(self, spec: EntitySpec, run: RunContext, dimensions: dict[str, DataFrame]) -> DataFrame:
        """Upsert an entity's clean rows; returns its rejected records. The tagged rows are written once."""
        tagged = tag(spec, self.table("bronze", f"{spec.name}_raw").read(), dimensions, self._judged(spec, run))
        table = self.table("silver", spec.name)
        table.merge(clean(spec, tagged), [spec.id_column], {"change_feed": True}, skip_unchanged=True)
        table.register(f"{self.prefix}silver", spec.name)
        return rejected(spec, tagged, run)

    def _judged(self, spec: EntitySpec, run: RunContext) -> str:
        return self.paths.table("work", f"{spec.name}-{run.batch_id}-{run.at:%Y%m%d%H%M%S%f}")

    def silver(self, run: RunContext) -> None:
        found = [self._load(spec, run, {}) for spec in DIMENSIONS]
        dimensions = {spec.name: self.table("silver", spec.name).read() for spec in DIMENSIONS}
        found.append(self._load(EMPLOYEES, run, dimensions))
        # A rejection that stays keeps its first timestamp and batch, so a rerun changes nothing.
        audit = self.table("silver", "rejected_records")
        audit.merge(union_all(*found), list(REJECTED_KEYS), delete_unmatched=self.forget_resolved, skip_unchanged=True, incidental=SEEN)
        audit.register(f"{self.prefix}silver", "rejected_records")
        for spec in (*DIMENSIONS, EMPLOYEES):
            at = self.spark._jvm.org.apache.hadoop.fs.Path(self._judged(spec, run))
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    # Gold

    def facts(self) -> DataFrame:
        read = lambda n: self.table("silver", n).read()
        d = read("departments").select(F.col("id").alias("_d"), "department")
        j = read("jobs").select(F.col("id").alias("_j"), "job")
        return read(EMPLOYEES.name).join(d, F.col("department_id") == F.col("_d")).join(j, F.col("job_id") == F.col("_j"))

    def hires_by_quarter(self, year: int) -> DataFrame:
        return metrics.quarter_pivot(self.facts(), "hire_datetime", year, ["department", "job"]).orderBy("department", "job")

    def departments_above_average(self, year: int) -> DataFrame:
        counts = metrics.counts_in_year(self.table("silver", EMPLOYEES.name).read(), "hire_datetime", year, "department_id")
        found = metrics.above_average(counts).join(self.table("silver", "departments").read(), F.col("department_id") == F.col("id"))
        return found.select("id", "department", "hired").orderBy(F.desc("hired"), "id")

    def gold(self, year: int) -> None:
        """Rebuild the managed tables gold.<metric>_<year>."""
        self.spark.sql(f"CREATE SCHEMA IF NOT EXISTS {self.prefix}gold")
        for name, df in self.gold_frames(year).items():
            rebuild_table(self.spark, f"{self.prefix}gold.{name}", df, f"Rebuilt for {year}")

    def gold_frames(self, year: int) -> dict[str, DataFrame]:
        return {
            f"hires_by_department_job_quarter_{year}": self.hires_by_quarter(year),
            f"departments_above_average_hiring_{year}": self.departments_above_average(year),
        }

    # Validation

    def validation(self, year: int) -> dict[str, DataFrame]:
        silver = {n: self.table("silver", n).read() for n in (*SCHEMAS, "rejected_records")}
        bronze = {n: self.table("bronze", f"{n}_raw").read() for n in SCHEMAS}
        gold = self.gold_frames(year)
        tables = {f"bronze.{n}_raw": df for n, df in bronze.items()} | {f"silver.{n}": df for n, df in silver.items()}
        audit = silver["rejected_records"]
        pivot = next(iter(gold.values()))
        return {
            "row_counts": checks.row_counts(tables | {f"gold.{n}": df for n, df in gold.items()}),
            "reconciliation": checks.reconcile_all({n: (bronze[n], silver[n]) for n in SCHEMAS}, audit),
            "rejections": checks.rejections(audit),
            "duplicates": checks.duplicates(silver[EMPLOYEES.name], ["id"]),
            "orphans": checks.orphans(silver[EMPLOYEES.name], silver, REFERENCES, ["id", "department_id", "job_id"]),
            "gold_rollup": checks.gold_rollup(pivot),
            "history": self.table("silver", EMPLOYEES.name).history(),
            "changes": self.table("silver", EMPLOYEES.name).changes().orderBy("_commit_version", "id"),
        }

    def run(self, run: RunContext | None = None, year: int = 2021) -> str:
        run = run or RunContext()
        self.bronze(run)
        self.silver(run)
        self.gold(year)
        return run.batch_id


def run_bronze(spark: SparkSession, paths: Paths, batch_id: str | None = None) -> str:
    """Land all files; returns the batch's id."""
    return Lakehouse(spark, paths).bronze(RunContext(batch_id) if batch_id else RunContext())


def run_silver(spark: SparkSession, paths: Paths, batch_id: str | None = None) -> None:
    Lakehouse(spark, paths).silver(RunContext(batch_id) if batch_id else RunContext())


def run_gold(spark: SparkSession, paths: Paths, year: int = 2021) -> None:
    Lakehouse(spark, paths).gold(year)


def main(argv: Sequence[str] | None = None, session: SparkSession | None = None) -> None:
    import argparse

    from ..session import get_spark

    parser = argparse.ArgumentParser(description="Run the pipeline, or print the validation of what it loaded.")
    parser.add_argument("step", choices=["run", "validate"])
    parser.add_argument("--data-root")
    parser.add_argument("--lakehouse-root")
    parser.add_argument("--year", type=int, default=2021)
    parser.add_argument("--prefix", default="", help="of the schemas' names in the catalog")
    given = parser.parse_args(argv)
    known = Paths.from_environment()
    running = session or SparkSession.getActiveSession()
    spark = running or get_spark()
    lake = Lakehouse(spark, Paths(given.data_root or known.data_root, given.lakehouse_root or known.lakehouse_root), prefix=given.prefix)
    if given.step == "run":
        print("batch", lake.run(year=given.year))
    else:
        for name, df in lake.validation(given.year).items():
            print(name)
            df.show(truncate=False)
    if running is None:
        spark.stop()


if __name__ == "__main__":
    main()
