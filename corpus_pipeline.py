"""A training corpus from `documents`, in five stages, each on all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a frame.  run() writes each stage's
result to the shared folder and reads it for the next.  All stages but the last return
the columns of documents; the last adds what the mix takes of each document.

Defined cases, for every stage: nulls in any column are let through as they are, but a
document without words is rejected by the first stage; an empty table gives an empty one;
columns of any other name stay, and names that a stage adds give way to them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.llm import decontaminate, jaccard, linededup, mixture, qualityscore
from glossa.llm.shared import table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go, among them those without words; rows alike are judged alike."""
    return qualityscore.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go, but for their first place; so do documents that consist of nothing else.  Rows alike in id and text are one place."""
    cleaned = linededup.clean(docs, drop_emptied=True)
    return cleaned.select(*(F.when(F.col("text").isNull(), F.col(c)).otherwise(F.length("text").cast("long")).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least id stays, a null id last; of rows alike in id and words one."""
    return jaccard.keep_one(docs)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go; null and empty items find nothing."""
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix leaves out go; `taken` has the words taken of the others, repeats counted."""
    return mixture.mixed(docs)


STAGES = [
    ("quality", quality),
    ("lines", lines),
    ("near_copies", near_copies),
    ("contamination", contamination),
    ("mixing", mixing),
]

#: The first two stages have no SQL; the tests hold the others against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
