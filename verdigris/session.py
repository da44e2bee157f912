"""A session for runs of our own; drivers that bring a session don't need it."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_spark(app_name: str = "verdigris", **conf: str) -> SparkSession:
    """UTC, since timestamps in files are literal UTC; adaptive execution on. Keyword arguments are
    settings with `__` for the dots."""
    builder = SparkSession.builder.appName(app_name).config("spark.sql.session.timeZone", "UTC")
    if "SPARK_MASTER" in os.environ:
        builder = builder.master(os.environ["SPARK_MASTER"])
    builder = builder.config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
