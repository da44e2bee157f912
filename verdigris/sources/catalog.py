"""Tables of the session's catalog: saving a frame, rebuilding a table from a query."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def save_as_table(df: DataFrame, name: str, mode: str = "overwrite", comment: str | None = None) -> DataFrame:
    """df as the managed table `schema.name`; returns the table. The schema is made if there is none."""
    spark = df.sparkSession
    if "." in name:
        spark.sql(f"CREATE SCHEMA IF NOT EXISTS {name.rpartition('.')[0]}")
    df.write.format("parquet").mode(mode).saveAsTable(name)
    if comment is not None:
        spark.sql(f"COMMENT ON TABLE {name} IS {_literal(comment)}")
    return spark.table(name)


def rebuild_table(spark: SparkSession, name: str, df: DataFrame, comment: str) -> None:
    """Drop `schema.name` if it is there and create it from df, with a comment."""
    rows = f"_verdigris_{uuid.uuid4().hex}"
    df.createOrReplaceTempView(rows)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(f"CREATE TABLE {name} USING parquet COMMENT {_literal(comment)} AS SELECT * FROM {rows}")
    spark.catalog.dropTempView(rows)


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"
