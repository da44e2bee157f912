"""What the two classifiers share: the bounded sample of labelled rows they learn from, words by cache."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column, modulus: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def training_ids(labels: DataFrame, label: str, learn: Column, rows: int) -> DataFrame:
    """At most `rows` labelled documents (doc_id, y, turn), chosen and ordered by a hash of doc_id. Only they are
    ever brought together, so whatever is learnt from them has a fixed bound. A document that is labelled
    several times has the largest of its labels."""
    marked = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & learn)
    marked = marked.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    turn = F.xxhash64("doc_id", F.lit(label))
    return marked.withColumn("turn", turn).orderBy("turn", "doc_id").limit(rows)


def with_labels(docs: DataFrame, ids: DataFrame, text: str, doc_id: str) -> DataFrame:
    """turn, y and text of the chosen documents; one row of each, with the smallest text where rows repeat a doc_id."""
    chosen = F.broadcast(ids.withColumnRenamed("doc_id", "_id"))
    found = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    return found.join(chosen, "_id").groupBy("_id", "turn", "y").agg(F.min("text").alias("text")).select("turn", "y", "text")


class WordCache:
    """word -> a few bytes, by `make`; forgets the words of long ago beyond `most`."""

    def __init__(self, make: Callable[[bytes], bytes], most: int = 500_000) -> None:
        self.make, self.most, self.young, self.old = make, most, {}, {}

    def joined(self, words: list[bytes]) -> bytes:
        try:
            return b"".join(map(self.young.__getitem__, words))
        except KeyError:
            if len(self.young) > self.most:
                self.old, self.young = self.young, {}
            for w in set(words).difference(self.young):
                found = self.old.get(w)
                self.young[w] = self.make(w) if found is None else found
            return b"".join(map(self.young.__getitem__, words))
