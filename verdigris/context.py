"""What stays the same during a run: its id, its one timestamp, and where data lies."""

from __future__ import annotations

import os
import tempfile
import uuid
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RunContext:
    """One batch run. Its timestamp is a literal, so all rows of a run agree whatever is evaluated when."""

    batch_id: str = field(default_factory=lambda: str(uuid.uuid4()))
    at: datetime = field(default_factory=lambda: datetime.now(timezone.utc).replace(tzinfo=None))

    def timestamp(self) -> Column:
        return F.lit(self.at.isoformat(sep=" ")).cast("timestamp_ntz")

    def date(self) -> Column:
        return F.lit(self.at.date().isoformat()).cast("date")


@dataclass(frozen=True)
class Paths:
    """Roots of the landed files and of the tables; any path Spark can reach."""

    data_root: str
    lakehouse_root: str

    @classmethod
    def from_environment(cls) -> Paths:
        here = os.getcwd()
        return cls(os.environ.get("VERDIGRIS_DATA_ROOT", f"{here}/data"), os.environ.get("VERDIGRIS_LAKEHOUSE_ROOT", f"{here}/_lakehouse"))

    def landing(self, *parts: str) -> str:
        return "/".join([self.data_root, "landing", *parts])

    def api(self, *parts: str) -> str:
        return "/".join([self.data_root, "api", *parts])

    def table(self, layer: str, name: str) -> str:
        return "/".join([self.lakehouse_root, layer, name])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where that is unset,
    as in tests on one machine, a temporary folder is made and set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="verdigris-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Folders made by shared_path, by the application that asked for them.
_MADE: dict[str, list[str]] = {}


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share, for what a later step reads."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


#: Schemas of the catalog made for a step's own tables and views, by the application that asked for them.
_SCHEMAS: dict[str, list[str]] = {}


def own_schema(spark: SparkSession, name: str) -> str:
    """The name of a schema that no other run has, for tables and views which only a step's own statements speak of."""
    schema = f"verdigris_{name}_{uuid.uuid4().hex}"
    _SCHEMAS.setdefault(spark.sparkContext.applicationId, []).append(schema)
    return schema


def clear_shared(spark: SparkSession) -> int:
    """Delete what this application has written under shared_path, and schemas that begin with own_schema's names, once the results
    made from them are read or written; returns how many folders there were."""
    found = 0
    mine = tuple(_SCHEMAS.pop(spark.sparkContext.applicationId, []))
    for database in spark.catalog.listDatabases() if mine else []:
        if database.name.startswith(mine):
            spark.sql(f"DROP SCHEMA IF EXISTS {database.name} CASCADE")
    for path in _MADE.pop(spark.sparkContext.applicationId, []):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        found += at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return found
