"""The corpus pipeline: from raw documents to packed sequences, a table written after every stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.llm import line_dedup, mixing, near_dedup, packing, quality_rules
from verdigris.llm.common import read_table, stage
from verdigris.llm.queries import tokenizer_path


def _quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the strict policy rejects go."""
    return quality_rules.select_passing(docs, quality_rules.STRICT)


def _line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of several documents stay in the first of them; n_chars follows the text."""
    kept = line_dedup.dedup_lines(docs).select(*docs.columns)
    return kept.withColumn("n_chars", F.length("text").cast("long"))


def _near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays: SimHash links of 5-word shingles, verified by
    a similarity of at least 0.8 and completed by what no number of differing bits holds."""
    return near_dedup.keep_first(docs)


def _mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order."""
    return mixing.mix(docs)


def _packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents by sequence, in the order that the stage before has written; a document that the mix takes twice
    is packed twice."""
    return packing.pack(docs, tokenizer_path(), part=packing.written_order(docs))


STAGES = [
    ("quality rules", _quality_rules),
    ("line dedup", _line_dedup),
    ("SimHash near-dedup", _near_dedup),
    ("mixing", _mixing),
    ("packing", _packing),
]

#: Fingerprints by XXH64 and a tokenizer's ids have no counterpart in DuckDB: tests compare the stages
#: with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
