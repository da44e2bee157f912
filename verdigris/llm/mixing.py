"""Mixing sources to target weights along a time-varying curriculum.

Every source gets a target number of words (its weight's share of the budget, at most MAX_EPOCHS passes
over it). Inside a source the documents stand in an order fixed by md5(doc_id); pass after pass they
form one stream of words. The source's weight schedule, integrated over training time, says how many
words have been demanded by time t; inverting that curve at a copy's middle word gives the copy's
training position, by which the copies are range-sorted. A source's last copy is cut where its target
is reached.

No source is held in one task: sizes are summed per (source, bucket of the order), the sums of earlier
buckets are added to a running sum inside a bucket, and buckets hold about BUCKET_ROWS rows.

Defined cases: a null text has size 0 and is never taken; a null source is a source of its own that comes
last; rows with a null doc_id stand where a hash of their text puts them, so that they too are dealt over all
buckets; rows that repeat a doc_id are documents of their own, in an order fixed by their size; an empty
table gives no rows; columns of the input other than the three that are used do not matter, whatever their names; a very long
text is counted whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, stage, text_of, with_row_key, word_array

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (3, 1, 2)
#: The mix is BUDGET_NUM / BUDGET_DEN times all words.
BUDGET_NUM, BUDGET_DEN = 3, 2
#: Passes over a source at most.
MAX_EPOCHS = 2
#: Relative weight of the three schedule kinds at the start and end of training, by the source's rank:
#: steady, fading and rising.
SCHEDULES = ((1.0, 1.0), (1.5, 0.5), (0.5, 1.5))
#: Hex digits of a bucket are chosen so that a bucket of the largest source has about this many rows.
BUCKET_ROWS = 4096


def sizes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).alias("source"),
        F.size(word_array(text_of(docs, text))).cast("long").alias("size"),
        F.md5(F.coalesce(F.col(doc_id).cast("string").cast("binary"), F.concat(F.lit(b"\0"), text_of(docs, text).cast("binary")))).alias("rank_key"),
    )


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """One row per source: source, source_size, n_docs, weight, target, schedule.

    Water filling: sources sorted by size per weight; the first j of them stop at their cap, the others
    share what is left by weight, with j the smallest number for which none of the others is above.
    All sums are whole numbers, so the target is one division of exact integers. One row per source
    meets in one task; documents never do.
    """
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("rank", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), F.col("rank") % len(weights) + 1)
    per = per.withColumn("weight", weight)
    order = Window.orderBy(F.col("source_size") / F.col("weight"), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    zero = F.lit(0).cast("long")
    # Money left for this source and those after it, times BUDGET_DEN, if all earlier ones are capped.
    left = BUDGET_NUM * F.sum("source_size").over(everything) - BUDGET_DEN * MAX_EPOCHS * F.coalesce(
        F.sum("source_size").over(before), zero
    )
    per = per.withColumn("left", left).withColumn("rest", F.sum("weight").over(rest))
    fits = F.col("left") * F.col("weight") <= BUDGET_DEN * MAX_EPOCHS * F.col("source_size") * F.col("rest")
    per = per.withColumn("k", F.row_number().over(order))
    per = per.withColumn("first", F.min(F.when(fits, F.col("k"))).over(everything))
    at = lambda c: F.max(F.when(F.col("k") == F.col("first"), F.col(c))).over(everything)
    per = per.withColumn("left", at("left")).withColumn("rest", at("rest"))
    open_ = F.col("k") >= F.col("first")
    shared = (F.col("left") * F.col("weight")).cast("double") / (BUDGET_DEN * F.col("rest")).cast("double")
    return per.select(
        "source",
        "source_size",
        "n_docs",
        "weight",
        F.when(open_, shared).otherwise((MAX_EPOCHS * F.col("source_size")).cast("double")).alias("target"),
        (F.col("rank") % len(SCHEDULES)).cast("int").alias("schedule"),
    )


def position(share: Column, schedule: Column, schedules: tuple = SCHEDULES) -> Column:
    """The time t in [0, 1] at which a source with a linear weight schedule a..b has been asked for
    `share` of its words: the root of (a*t + (b-a)*t^2/2) / ((a+b)/2) = share."""
    out = None
    for k, (a, b) in enumerate(schedules):
        demand = share * ((a + b) / 2)
        root = demand / a if a == b else (F.sqrt(F.lit(a * a) + 2 * (b - a) * demand) - a) / (b - a)
        out = F.when(schedule == k, root) if out is None else out.when(schedule == k, root)
    return out


def plan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, schedule, `words_before`
    (words of its source that stand before it in the order) and `taken`."""
    rows = stage(sizes(docs, text, doc_id, source), "mix-sizes")
    per = stage(targets(rows), "mix-targets")
    largest = per.agg(F.max("n_docs")).first()[0] or 0
    digits = 0
    while 16**digits * BUCKET_ROWS < largest:
        digits += 1
    rows = rows.withColumn("bucket", F.substring("rank_key", 1, digits) if digits else F.lit(""))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("offset", F.coalesce(F.sum("words").over(earlier), F.lit(0).cast("long"))).drop("words")
    inside = (
        Window.partitionBy("source", "bucket")
        .orderBy("rank_key", F.col("doc_id").asc_nulls_last(), "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0).cast("long")))
    same = rows["source"].eqNullSafe(sums["source"]) & (rows["bucket"] == sums["bucket"])
    rows = rows.join(sums, same).select(rows["*"], sums["offset"])
    rows = rows.withColumn("words_before", F.col("offset") + F.col("inside"))
    found = rows.join(per, rows["source"].eqNullSafe(per["source"])).select(
        rows["doc_id"], rows["source"], "size", "source_size", "target", "schedule", "words_before"
    )
    asked = F.round("target").cast("long")
    taken = sum(
        (
            F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), asked - F.col("words_before") - e * F.col("source_size")))
            for e in range(MAX_EPOCHS)
        ),
        F.lit(0).cast("long"),
    )
    return found.withColumn("taken", taken)


def _copies() -> Column:
    """The copies of a planned document that are taken, as structs of `epoch`, `copy_words` and `position`, in order."""
    asked = F.round("target").cast("long")
    found = []
    for e in range(MAX_EPOCHS):
        start = F.col("words_before") + e * F.col("source_size")
        words = F.least(F.col("size"), asked - start)
        at = position(F.least(F.lit(1.0), (start + words / 2) / asked), F.col("schedule"))
        found.append(F.when(words > 0, F.struct(F.lit(e).alias("epoch"), words.alias("copy_words"), at.alias("position"))))
    return F.array_compact(F.array(*found))


def copies(planned: DataFrame) -> DataFrame:
    """One row per copy that is taken: the plan's columns with `epoch`, `copy_words` and `position`."""
    return planned.withColumn("_copy", F.explode(_copies())).select(*planned.columns, "_copy.*")


def by_position(rows: DataFrame, at: str, *then: str) -> DataFrame:
    """The rows range-sorted by the column `at`; rows where it is null come last, in no order.

    Positions lie in [0, 1] and the demand is spread over all of it, so equal ranges of positions are the
    partitions and no sampling pass is needed. Rows without a position are dealt over as many partitions."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = F.least(F.floor(F.col(at) * parts), F.lit(parts - 1)).cast("int")
    last = parts + F.pmod(F.xxhash64(*[F.col(c) for c in then]), F.lit(parts)).cast("int")
    part = F.when(F.col(at).isNull(), last).otherwise(ranges)
    return rows.repartitionById(2 * parts, part).sortWithinPartitions(F.col(at).asc_nulls_last(), *then)


def curriculum(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """One row per document in training order: doc_id, source, size, source_size, target, `taken` (the words
    of all its copies), `positions` (of its copies, in order) and `position`, the first of them, by which the
    rows are range-sorted. A document that isn't taken has no position and comes last."""
    out = plan(docs, text, doc_id, source).withColumn("_copies", _copies())
    out = out.withColumn("taken", F.aggregate("_copies", F.lit(0).cast("long"), lambda n, c: n + c["copy_words"]))
    out = out.withColumn("positions", F.transform("_copies", lambda c: c["position"])).withColumn("position", F.get("positions", F.lit(0)))
    out = out.select("doc_id", "source", "size", "source_size", "target", "taken", "positions", "position")
    return by_position(out, "position", "doc_id", "size")


def mix(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """The documents as often as the mix takes them, range-sorted by training position, with their
    own columns only. Documents are never cut: a source's last copy is in if at least half of its
    words are taken. Rows that repeat a doc_id, or have none, are told apart by a row number."""
    columns = docs.columns
    docs, key = with_row_key(docs, doc_id)
    own = fresh(docs, "_id", "_position", "_epoch")
    taken = copies(plan(docs, text, key, source)).where(2 * F.col("copy_words") >= F.col("size"))
    taken = taken.select(*[F.col(c).alias(n) for c, n in zip(("doc_id", "position", "epoch"), own)])
    out = docs.join(stage(taken, "mix-copies"), F.col(key) == F.col(own[0]))
    return by_position(out, own[1], own[0], own[2]).select(*columns)
