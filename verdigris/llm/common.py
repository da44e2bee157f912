"""What the text operators share: table reading, staging in the shared folder, row keys, white space."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Hashable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..context import shared_dir

#: White space of the contracts, [\x20\x09-\x0D], as a Java class and as characters.
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\f\r"
SPACE_BYTES = SPACE_CHARS.encode()

MAX_LONG = (1 << 63) - 1


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders of staged tables, by the application that wrote them.
_STAGED: dict[str, list[str]] = {}


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: later steps read rows instead of
    computing them again, and a lost executor costs no more than its own running tasks."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _STAGED.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_staged(spark: SparkSession) -> int:
    """Delete the tables staged by this application, once the results made from them are written;
    returns their number."""
    paths = _STAGED.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return len(paths)


def unstage(*tables: DataFrame) -> None:
    """Delete staged tables that nothing needs any more, before their application ends, and the shuffle files of steps that are over."""
    for df in tables:
        spark = df.sparkSession
        mine = _STAGED.get(spark.sparkContext.applicationId, [])
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            for known in [p for p in mine if p.rstrip("/").endswith(path.rsplit("/", 1)[-1])]:
                at = spark._jvm.org.apache.hadoop.fs.Path(known)
                at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
                mine.remove(known)
    if tables:
        free_shuffles(tables[0].sparkSession)


def free_shuffles(spark: SparkSession) -> None:
    """Spark drops the shuffle files of steps that are over when the driver collects its garbage; it is asked to, so that
    steps don't add up on disk."""
    gc.collect()
    spark._jvm.System.gc()


#: What the tasks of one operator share in this Python worker.
_KEPT: dict[Hashable, Any] = {}


def kept(key: Hashable, make: Callable[[], Any]) -> Any:
    """What make() gives, made once in a Python worker and kept from task to task. A worker keeps one such thing."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def release(all_of_it: bool = False) -> None:
    """Give the memory that this Python worker has freed back to the system, with all_of_it also what it keeps for later tasks.
    Workers outlive their tasks, and what they hold counts beside the steps that follow, of other operators too."""
    if all_of_it:
        _KEPT.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
    if trim is not None:
        trim(0)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """These names, each lengthened until df has no such column; for columns of our own beside a caller's."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def with_row_key(docs: DataFrame, doc_id: str) -> tuple[DataFrame, str]:
    """The rows with a column that tells them apart: doc_id if it does, else a row number, under a name that docs
    hasn't, of a staged copy."""
    n, distinct = docs.agg(F.count("*"), F.count_distinct(doc_id)).first()
    if n == distinct:
        return docs, doc_id
    (name,) = fresh(docs, "_row")
    return stage(docs.withColumn(name, F.monotonically_increasing_id()), "rows"), name


def nulls_last(docs: DataFrame, doc_id: str) -> Column:
    """doc_id as a long in the same order with nulls as the largest. If the largest long is itself an id, the ids above
    one that is free move down by one."""
    none, top = docs.agg(F.count_if(F.col(doc_id).isNull()), F.max(F.col(doc_id).cast("long"))).first()
    at = F.col(doc_id).cast("long")
    if not none:
        return at
    if top != MAX_LONG:
        return F.coalesce(at, F.lit(MAX_LONG))
    some = [(k * 0x9E3779B97F4A7C15 & MAX_LONG) >> 1 for k in range(1, 65)]
    used = {r[0] for r in docs.select(at.alias("i")).where(F.col("i").isin(some)).distinct().collect()}
    free = next(x for x in some if x not in used)
    return F.when(at.isNull(), F.lit(MAX_LONG)).when(at > free, at - 1).otherwise(at)


def text_of(docs: DataFrame, column: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(docs[column], F.lit(""))


def without_space(text: Column) -> Column:
    for c in SPACE_CHARS:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def word_array(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE_CLASS + "+"), "")
