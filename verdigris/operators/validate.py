"""Validation: rules to reasons, deterministic deduplication, rejected records.

An entity is described by an EntitySpec. `tag` judges every row once and writes what it found, with a number for each row: `_reasons`
has all labels of failed rules in order. The row that stays of an id is found by an aggregate, which tasks begin before anything
is shuffled, and is told to the rows by their numbers; equal rejections are numbered inside short runs of rows as they were written, and the runs'
counts are added up. So no step brings the rows of one id, or equal rows, together, however many they are.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DateType, DecimalType, DoubleType, FloatType, IntegralType, StringType, TimestampNTZType, TimestampType

from ..context import RunContext, shared_path
from ..functions.columns import batch_date, failed, iso_timestamp, null_or_blank, payload
from ..sources.files import RESCUED

#: Equal rows that one window numbers: 2^16 at most.
CHUNK_BITS = 16
SUPERSEDED = "duplicate_id_superseded_by_newer_record"
TECHNICAL = ("source_system", "source_file", "ingestion_timestamp", "ingestion_date", "batch_id")
#: What tells one rejection from another, null-safe: also rows without an id, and equal rows of a file.
REJECTED_KEYS = ("table_name", "record_id", "source_file", "record_hash", "occurrence")
#: What tells when a rejection was seen; a rerun that sees it again changes nothing. The payload holds the run's time too.
SEEN = ("rejection_timestamp", "batch_id", "raw_payload")


@dataclass(frozen=True)
class Rule:
    """Fails where the predicate is true."""

    label: str
    predicate: Callable[[], Column]


@dataclass(frozen=True)
class ForeignKey:
    """column must be null or an id of the dimension."""

    column: str
    dimension: str
    key: str = "id"

    @property
    def found(self) -> str:
        return f"_{self.column}_found"

    def rules(self) -> tuple[Rule, Rule]:
        return (
            Rule(f"{self.column}_is_null", lambda: F.col(self.column).isNull()),
            Rule(f"{self.column}_not_found_in_{self.dimension}", lambda: F.col(self.column).isNotNull() & F.col(self.found).isNull()),
        )


@dataclass(frozen=True)
class EntitySpec:
    """output: the clean table's columns; derived: columns computed before the rules."""

    name: str
    id_column: str
    business: tuple[str, ...]
    output: tuple[str, ...]
    rules: tuple[Rule, ...]
    foreign_keys: tuple[ForeignKey, ...] = ()
    derived: dict[str, Callable[[], Column]] = field(default_factory=dict)

    def all_rules(self) -> list[tuple[Column, str]]:
        rules = [*self.rules, *(r for fk in self.foreign_keys for r in fk.rules())]
        return [(r.predicate(), r.label) for r in rules]


def dimension_spec(name: str, name_column: str) -> EntitySpec:
    """A small table of ids and names."""
    rules = (
        Rule("id_is_null", lambda: F.col("id").isNull()),
        Rule(f"{name_column}_is_null_or_empty", lambda: null_or_blank(F.col(name_column))),
    )
    return EntitySpec(name, "id", ("id", name_column), ("id", name_column), rules)


def event_spec(name: str, foreign_keys: Sequence[ForeignKey], timestamp: str = "datetime", parsed: str = "hire_datetime") -> EntitySpec:
    """Facts with an id, a name, a timestamp as text and references."""
    columns = [fk.column for fk in foreign_keys]
    rules = (
        Rule("id_is_null", lambda: F.col("id").isNull()),
        Rule("name_is_null_or_empty", lambda: null_or_blank(F.col("name"))),
        Rule(f"{timestamp}_is_null", lambda: F.col(timestamp).isNull()),
        Rule(f"{timestamp}_invalid_iso_format", lambda: F.col(timestamp).isNotNull() & F.col(parsed).isNull()),
    )
    derived = {parsed: lambda: iso_timestamp(F.col(timestamp))}
    return EntitySpec(name, "id", ("id", "name", timestamp, *columns), ("id", "name", parsed, *columns), rules, tuple(foreign_keys), derived)


def stamp(df: DataFrame, run: RunContext, source_system: str | None = None) -> DataFrame:
    """Technical columns of a landed row; a source system that the rows bring is kept."""
    known = {} if "source_system" in df.columns else {"source_system": F.lit(source_system).cast("string")}
    return df.withColumns(known | {"ingestion_timestamp": run.timestamp(), "ingestion_date": run.date(), "batch_id": F.lit(run.batch_id)})


def probe(df: DataFrame, dimensions: dict[str, DataFrame], foreign_keys: Sequence[ForeignKey]) -> DataFrame:
    """Left joins that mark which references exist. Ids are made distinct first, so no row multiplies; whether
    a dimension is broadcast is for its size to decide. Where it is too large, rows without a reference, or with a frequent one, meet in one
    partition of the shuffle, which adaptive execution splits. It does so only where the join reads both its shuffles itself, so ids are made
    distinct in another partitioning than the join's, that of a hash beside them."""
    for fk in foreign_keys:
        ids = dimensions[fk.dimension].select(F.col(fk.key).alias(fk.found), F.xxhash64(fk.key).alias("_hash")).distinct().drop("_hash")
        df = df.join(ids, F.col(fk.column) == F.col(fk.found), "left")
    return df


def descending(column: Column, kind: DataType) -> Column:
    """What sorts in ascending order as the column does in descending order, nulls last."""
    if isinstance(kind, DateType):
        turned = F.bitwise_not(F.unix_date(column))
    elif isinstance(kind, (TimestampType, TimestampNTZType)):
        turned = F.bitwise_not(F.unix_micros(column.cast("timestamp")))
    elif isinstance(kind, StringType):
        turned = F.concat(F.translate(F.hex(column), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("G"))
    elif isinstance(kind, IntegralType):
        turned = F.bitwise_not(column)
    elif isinstance(kind, (FloatType, DoubleType)):
        turned = F.struct((~F.isnan(column)).alias("number"), (-column).alias("x"))
    elif isinstance(kind, DecimalType):
        turned = -column
    else:
        raise TypeError(f"{kind.simpleString()} has no order that can be turned round")
    return F.struct(column.isNull().alias("none"), turned.alias("turned"))


def newest(df: DataFrame, keys: Sequence[str], newest_first: Sequence[str], tie: Sequence[str]) -> DataFrame:
    """One row of each key: the newest, and among equals the first by the tie columns. Found by an aggregate that tasks begin
    before anything is shuffled, so a key that most rows share costs no task more than others."""
    order = F.struct(*[descending(F.col(c), df.schema[c].dataType).alias(f"n{i}") for i, c in enumerate(newest_first)], *tie)
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_best"))
    return best.select(*[F.col(c) if c in keys else F.col("_best")[c].alias(c) for c in df.columns])


def ranked(df: DataFrame, keys: Sequence[str], newest_first: Sequence[str], tie: Sequence[str], name: str, path: str | None = None) -> DataFrame:
    """df with a number from 1 on inside each key, the newest row first, equals by the tie columns, so that the order is total over
    distinct rows. Rows are dealt into ranges of the whole order, which cut a key that has many rows, and written; they are numbered
    inside a range, and the rows of a key in the ranges before are added. Only keys at the ends of ranges are in more than one, so what is
    broadcast has at most two rows a range."""
    spark = df.sparkSession
    path = path or shared_path(spark, "ranked")
    order = [*[F.col(c).desc() for c in newest_first], *tie, "_row"]
    rows = df.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id())
    rows.write.parquet(path)
    rows = spark.read.schema(rows.schema).parquet(path)
    key = F.struct(*keys)
    ends = rows.groupBy("_range").agg(F.min(key).alias("a"), F.max(key).alias("b"))
    cut = ends.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("k")).groupBy("k").count().where("count > 1")
    cut = cut.select(*[F.col("k")[c].alias(f"_same{i}") for i, c in enumerate(keys)])
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_same{i}")) for i, c in enumerate(keys)])
    earlier = Window.partitionBy(*[f"_same{i}" for i in range(len(keys))]).orderBy("_in").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.join(F.broadcast(cut), same).groupBy(*cut.columns, F.col("_range").alias("_in")).agg(F.count("*").alias("_n"))
    counts = counts.withColumn("_before", F.sum("_n").over(earlier)).where("_before > 0").drop("_n")
    number = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order))
    found = rows.withColumn("_number", number).join(F.broadcast(counts), same & (F.col("_range") == F.col("_in")), "left")
    return found.select(*df.columns, (F.col("_number") + F.coalesce("_before", F.lit(0))).cast("long").alias(name))


def judge(spec: EntitySpec, rows: DataFrame, dimensions: dict[str, DataFrame] | None = None) -> DataFrame:
    """rows with the derived columns, `_batch_date` and `_reasons`."""
    rows = rows.withColumns({"_batch_date": batch_date(F.col("source_file"), F.col("ingestion_timestamp")), **{c: f() for c, f in spec.derived.items()}})
    rows = probe(rows, dimensions or {}, spec.foreign_keys)
    return rows.withColumn("_reasons", failed(spec.all_rules())).drop(*[fk.found for fk in spec.foreign_keys])


def tag(spec: EntitySpec, rows: DataFrame, dimensions: dict[str, DataFrame] | None = None, path: str | None = None) -> DataFrame:
    """rows with the derived columns, `_reasons`, a number `_row` that tells them apart, and `_rank`: 1 for the row that stays of
    its id, 2 for those it supersedes, null for invalid rows. Validation comes first: an invalid newer row supersedes nothing.
    The judged rows are written to `path`, or a new folder that driver and executors share."""
    spark = rows.sparkSession
    path = path or shared_path(spark, f"judged-{spec.name}")
    judged = judge(spec, rows, dimensions).withColumn("_row", F.monotonically_increasing_id())
    judged.write.mode("overwrite").parquet(path)
    judged = spark.read.schema(judged.schema).parquet(path)
    valid = F.size("_reasons") == 0
    last = F.lit((1 << 63) - 1)
    newest = [F.coalesce(-F.unix_date("_batch_date").cast("long"), last), F.coalesce(-F.unix_micros(F.col("ingestion_timestamp").cast("timestamp")), last)]
    order = F.struct(*[c.alias(f"n{i}") for i, c in enumerate(newest)], "source_file", *spec.business, "_row")
    best = judged.where(valid).groupBy(spec.id_column).agg(F.min_by("_row", order).alias("_best")).select("_best")
    rank = F.when(valid, F.when(F.col("_best").isNotNull(), 1).otherwise(2))
    return judged.join(best, F.col("_row") == F.col("_best"), "left").withColumn("_rank", rank).drop("_best")


def clean(spec: EntitySpec, tagged: DataFrame) -> DataFrame:
    return tagged.where("_rank = 1").select(*spec.output)


def numbered(rows: DataFrame, same: Sequence[str], name: str) -> DataFrame:
    """rows of `tag` with a number from 1 on among those that are equal in some columns: counted inside runs of 2^CHUNK_BITS rows that
    were written one after the other, the counts of earlier runs added."""
    rows = rows.withColumn("_chunk", F.shiftright("_row", CHUNK_BITS))
    inside = Window.partitionBy(*same, "_chunk").orderBy("_row")
    before = Window.partitionBy(*same).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*same, "_chunk").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(before)).where("_before > 0")
    counts = counts.select(*[F.col(c).alias(f"_same{i}") for i, c in enumerate((*same, "_chunk"))], "_before")
    on = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_same{i}")) for i, c in enumerate((*same, "_chunk"))])
    number = F.row_number().over(inside) + F.coalesce("_before", F.lit(0))
    return rows.join(counts, on, "left").withColumn(name, number.cast("long")).drop(*[f"_same{i}" for i in range(len(same) + 1)], "_before", "_chunk")


def record_hash(business: Sequence[str]) -> Column:
    """A hash of the values and of which of them are null: xxhash64 passes over nulls, so (null, 4) alone would be (4, null)."""
    return F.xxhash64(*business, *[F.col(c).isNull() for c in business])


def rejected(spec: EntitySpec, tagged: DataFrame, run: RunContext) -> DataFrame:
    """Rejected records of invalid and superseded rows: the eight columns of an audit table, `record_hash`
    of the business columns, and `occurrence`, which numbers rows of one file that have the same id and hash, so that REJECTED_KEYS tell
    all rows apart, whatever their hashes. Where rows bring the text that did not parse, it is in the payload."""
    reasons = F.when(F.col("_rank") == 2, F.lit(SUPERSEDED)).otherwise(F.array_join("_reasons", "; "))
    losing = tagged.where("_rank is null or _rank = 2").withColumns({"_id": F.col(spec.id_column).cast("string"), "_hash": record_hash(spec.business)})
    losing = numbered(losing, ["source_file", "_id", "_hash"], "_occurrence")
    rescued = [RESCUED] if RESCUED in tagged.columns else []
    return losing.select(
        F.lit(spec.name).alias("table_name"),
        F.col("_id").alias("record_id"),
        "source_system",
        "source_file",
        payload([*spec.business, *TECHNICAL, *rescued]).alias("raw_payload"),
        reasons.alias("rejection_reason"),
        run.timestamp().alias("rejection_timestamp"),
        "batch_id",
        F.col("_hash").alias("record_hash"),
        F.col("_occurrence").alias("occurrence"),
    )


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
