"""Exact deduplication with a heavy-hitter split.

Texts are equal when they agree after white space is deleted. A frequent-items sketch of the
Misra-Gries family (Spark's approx_top_k, merged from a summary per task) proposes the digests that may
be frequent. Their counts and winners are then computed exactly, and of these every digest that really has at
least n / HEAVY_SHARE rows is decided in place, by a broadcast table of at most HEAVY_SHARE rows. What remains is reduced
in every task before it is shuffled by digest as usual. No group is ever held in one task.

Defined cases: a null text is empty and equal to every blank text; a null doc_id comes after all others
among rows of equal length; rows that repeat a doc_id and a text are told apart by a row number, so that one row of
each group is kept however often its doc_id occurs; other columns do not matter; an empty table gives no rows; a very long text
is one value of its row's task, normalised and hashed whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, text_of, without_space

#: A proposed digest with more than one in so many of all rows is decided by broadcast. So many digests are proposed at
#: most, which bounds the broadcast.
HEAVY_SHARE = 1000
#: Counters of a sketch.
TRACKED = 8192


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, digest (SHA-256 of the text without white space), code points of the original and a row number."""
    body = text_of(docs, text)
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        F.monotonically_increasing_id().alias("row"),
        F.unhex(F.sha2(without_space(body).cast("binary"), 256)).alias("digest"),
        F.length(body).cast("long").alias("n_chars"),
    )


def frequent_digests(rows: DataFrame) -> DataFrame:
    """Digests that the sketch holds for the most frequent: at most HEAVY_SHARE rows. Which digests these are decides
    only where a group is reduced: here, or with the rest by shuffle, which is right for groups of any size."""
    top = rows.select(F.hex("digest").alias("d")).agg(F.expr(f"approx_top_k(d, {HEAVY_SHARE}, {TRACKED})").alias("t"))
    return top.select(F.explode("t").alias("t")).select(F.unhex("t.item").alias("digest"))


def winners(rows: DataFrame) -> DataFrame:
    """Per digest: the row that stays (most code points, then smallest doc_id) and the group's size."""
    order = F.struct((-F.col("n_chars")).alias("a"), F.col("doc_id").isNull().alias("b"), "doc_id", "row")
    best = rows.groupBy("digest").agg(F.min(order).alias("w"), F.count("*").alias("group_size"))
    return best.select("digest", F.col("w.doc_id").alias("keep_id"), F.col("w.row").alias("keep_row"), "group_size")


def dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = stage(fingerprints(docs, text, doc_id), "exact-digests")
    candidates = stage(frequent_digests(rows), "exact-frequent")
    least = rows.count() / HEAVY_SHARE
    heavy = winners(rows.join(F.broadcast(candidates), "digest", "left_semi")).where(F.col("group_size") > least)
    heavy = F.broadcast(stage(heavy, "exact-heavy"))
    light = rows.join(heavy.select("digest"), "digest", "left_anti")
    decided = rows.join(heavy, "digest").unionByName(light.join(winners(light), "digest"))
    return decided.select(
        "doc_id",
        "keep_id",
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
