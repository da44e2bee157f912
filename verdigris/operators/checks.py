"""Checks of a loaded lakehouse. Each returns a DataFrame, with a verdict where there is one to give."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .validate import ForeignKey, probe, union_all


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    return union_all(*[df.agg(F.count("*").alias("row_count")).select(F.lit(n).alias("table_name"), "row_count") for n, df in tables.items()])


COUNTS = ("bronze_raw_count", "silver_valid_count", "rejected_count")


def _verdict(counts: DataFrame) -> DataFrame:
    total = F.col("silver_valid_count") + F.col("rejected_count")
    return counts.select("entity", *COUNTS, total.alias("reconciled_total"), (F.col("bronze_raw_count") == total).alias("passed"))


def reconcile(entity: str, bronze: DataFrame, silver: DataFrame, rejected: DataFrame) -> DataFrame:
    """Every landed row must be valid or rejected."""
    return reconcile_all({entity: (bronze, silver)}, rejected)


def reconcile_all(layers: dict[str, tuple[DataFrame, DataFrame]], rejected: DataFrame) -> DataFrame:
    """`reconcile` for each entity by its bronze and silver rows. The audit, which all share, is read once; an entity without rows
    has zeros."""
    one = lambda df, entity, name: df.agg(F.count("*").alias("n")).select(F.lit(entity).alias("entity"), F.lit(name).alias("name"), "n")
    landed = [one(df, entity, name) for entity, pair in layers.items() for df, name in zip(pair, COUNTS)]
    lost = rejected.where(F.col("table_name").isin(list(layers))).groupBy(F.col("table_name").alias("entity")).agg(F.count("*").alias("n"))
    counts = union_all(*landed, lost.select("entity", F.lit(COUNTS[2]).alias("name"), "n"))
    return _verdict(counts.groupBy("entity").agg(*[F.sum(F.when(F.col("name") == c, F.col("n")).otherwise(0)).alias(c) for c in COUNTS]))


def reconcile_tagged(entity: str, bronze: DataFrame, tagged: DataFrame) -> DataFrame:
    """`reconcile` for rows that are tagged but not loaded yet: one pass over them."""
    kinds = {COUNTS[1]: F.col("_rank") == 1, COUNTS[2]: F.col("_rank").isNull() | (F.col("_rank") == 2)}
    counts = bronze.agg(F.count("*").alias(COUNTS[0])).crossJoin(tagged.agg(*[F.count_if(c).alias(n) for n, c in kinds.items()]))
    return _verdict(counts.select(F.lit(entity).alias("entity"), "*"))


def rejections(rejected: DataFrame) -> DataFrame:
    return rejected.groupBy("table_name", "rejection_reason").agg(F.count("*").alias("n")).orderBy("table_name", "rejection_reason")


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def orphans(facts: DataFrame, dimensions: dict[str, DataFrame], foreign_keys: Sequence[ForeignKey], show: Sequence[str]) -> DataFrame:
    """Facts of which any reference is null or not found."""
    missing = F.lit(False)
    for fk in foreign_keys:
        missing = missing | F.col(fk.found).isNull()
    return probe(facts, dimensions, foreign_keys).where(missing).select(*show)


def gold_rollup(pivot: DataFrame, group: str = "department") -> DataFrame:
    return pivot.groupBy(group).agg(F.sum(F.expr("Q1 + Q2 + Q3 + Q4")).alias("total_hires")).orderBy(F.desc("total_hires"), group)
