"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return the
columns of documents. Stages judge rows, not ids: rows with a null or a repeated doc_id are kept or dropped each by its own
text. A null text is an empty one; an empty table gives an empty result; columns besides those of documents are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointmill.llm import op3_bpe, op4_decontaminate, op7_lines, op8_simhash, op10_quality
from pointmill.llm.common import DOCUMENT_COLUMNS, table, vocabulary, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return op10_quality.assess(docs, DOCUMENT_COLUMNS).where("kept").select(*DOCUMENT_COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without their repeated lines; n_chars follows the text."""
    out = op7_lines.dedup(docs, ["doc_id", "lang", "source", "n_chars"])
    return out.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one of the smallest id; documents without words all stay."""
    return op8_simhash.first_of_groups(docs.select(*DOCUMENT_COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return op4_decontaminate.clean(docs.select(*DOCUMENT_COLUMNS), table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' ids and decoded texts as digests."""
    return op3_bpe.encode(docs, vocabulary(), digest=True)


STAGES = [("quality", quality), ("lines", lines), ("near", near), ("decontaminate", decontaminate), ("encode", encoded)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


ORACLE_SQL = None
