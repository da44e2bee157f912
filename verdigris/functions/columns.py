"""Column functions of the rule operators. All of them are built-in expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Strict: whole seconds and a literal Z. Fractions and offsets are not taken.
ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss'Z'"
FILE_DATE = r"([0-9]{4}_[0-9]{2}_[0-9]{2})"


def null_or_blank(c: Column) -> Column:
    """Null, empty, or spaces only (other white space counts as content)."""
    return c.isNull() | (F.trim(c) == "")


def iso_timestamp(c: Column, fmt: str = ISO_FORMAT) -> Column:
    """Null where the text is not a timestamp; never an error."""
    return F.try_to_timestamp(c, F.lit(fmt)).cast("timestamp_ntz")


def batch_date(file_name: Column, fallback: Column) -> Column:
    """The date in a file's name, else the fallback's date."""
    return F.coalesce(F.try_to_date(F.regexp_extract(file_name, FILE_DATE, 1), "yyyy_MM_dd"), F.to_date(fallback))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def in_year(ts: Column, year: int) -> Column:
    """As a range, which reaches the scan; year(ts) = y would not."""
    bound = lambda y: F.lit(f"{y:04d}-01-01 00:00:00").cast("timestamp_ntz")
    return (ts >= bound(year)) & (ts < bound(year + 1))


def failed(rules: Sequence[tuple[Column, str]]) -> Column:
    """Labels of all rules that fail, in order. A rule that is null doesn't fail."""
    return F.array_compact(F.array(*[F.when(c, F.lit(label)) for c, label in rules])) if rules else F.array().cast("array<string>")


def payload(columns: Sequence[str]) -> Column:
    """The columns as JSON text; null fields are left out."""
    return F.to_json(F.struct(*columns))
