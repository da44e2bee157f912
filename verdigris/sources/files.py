"""CSV batches and paged JSON documents as DataFrames with their file's name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

FILE = "source_file"
#: The text of a row or record of which something did not parse; null for the others.
RESCUED = "rescued"
#: Ends a JSON document: control characters that no JSON text holds, so a file is one document whatever its line breaks. A file read so is in memory
#: when it is parsed; with multiLine, Spark opens the file anew for each value whose text it takes (some 14 KB read a record).
END = "\x1e" * 4


def csv_source(spark: SparkSession, glob: str, schema: StructType, rescue: bool = False) -> DataFrame:
    """CSV files with a header. The schema is explicit: what doesn't fit its type is null, short rows
    are filled with nulls, and nothing is inferred. With `rescue` such rows keep their line in `rescued`."""
    columns = [f.name for f in schema.fields if f.name not in (FILE, RESCUED)]
    reader = spark.read.option("header", True)
    if rescue:
        schema = StructType([f for f in schema.fields if f.name != RESCUED]).add(RESCUED, StringType())
        reader, columns = reader.option("columnNameOfCorruptRecord", RESCUED), [*columns, RESCUED]
    return reader.schema(schema).csv(glob).select(*columns, F.col("_metadata.file_name").alias(FILE))


def page_schema(record: StructType) -> StructType:
    return StructType(
        [
            StructField("page", IntegerType()),
            StructField("has_next", BooleanType()),
            StructField("source_system", StringType()),
            StructField("data", ArrayType(record)),
        ]
    )


def json_pages(spark: SparkSession, glob: str, record: StructType, rescue: bool = False) -> DataFrame:
    """One row per page: every file is one document, whatever its line breaks. With `rescue` records of which something doesn't fit
    its type keep their text in a field `rescued`, in UTF-8 files; records of UTF-16 files come as nulls then."""
    if rescue:
        texts = StructType([StructField(f.name, ArrayType(StringType())) if f.name == "data" else f for f in page_schema(record).fields])
        pages = spark.read.option("lineSep", END).schema(texts).json(glob)
        parsed = F.transform("data", lambda x: F.from_json(x, StructType([*record.fields]).add(RESCUED, StringType()), {"columnNameOfCorruptRecord": RESCUED}))
        pages = pages.withColumn("data", parsed)
    else:
        pages = spark.read.option("lineSep", END).schema(page_schema(record)).json(glob)
    return pages.select("page", "has_next", "source_system", "data", F.col("_metadata.file_name").alias(FILE))


def page_records(pages: DataFrame) -> DataFrame:
    """The records of all pages, with their page's source system and file."""
    return pages.select(F.inline("data"), "source_system", FILE)


def bad_pages(pages: DataFrame) -> DataFrame:
    """Pages without a record: empty ones and those that don't parse. They'd vanish in page_records."""
    reason = F.when(F.col("data").isNull(), "page_is_corrupt").otherwise("page_is_empty")
    return pages.where(F.col("data").isNull() | (F.size("data") == 0)).select(FILE, "source_system", "page", reason.alias("rejection_reason"))
