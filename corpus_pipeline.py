"""From raw documents to packed training sequences: rules, classifier, near duplicates, mix, packing.

Edge cases, of every stage: an empty table gives an empty one; columns beyond those of documents are carried along,
whatever their names, up to packing, which returns pieces; a document of any length is read whole; null ids,
sources and languages are values like others. Each stage says what it does with null and blank texts, repeated
rows and ties.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import jaccard, mixing, packing, quality_model, quality_rules
from textloom.llm.common import saved
from textloom.workers import reachable


@reachable
def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every rule of the production policy.

    A null or blank text has no words and is rejected; repeated rows are judged alike; a measurement equal to its
    limit is no failure.
    """
    # the row travels as one value, so no column of it can clash with a measurement
    rows = docs.select(F.struct(*docs.columns).alias("_row"), "text")
    return quality_rules.ledger(rows).where(quality_rules.kept()).select("_row.*")


@reachable
def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier keeps; it learns from the labelled rows of the raw table.

    A null text is scored as empty; repeated rows get one score; a score equal to the threshold is kept; without
    labels of both kinds every document is kept.
    """
    raw = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality_model.filtered(docs, quality_model.train(raw, spark.read.parquet(f"{sf_dir}/labels.parquet")))


@reachable
def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: that of the smallest id, ids before null.

    Documents without words all stay; of rows that repeat whole one stays.
    """
    return jaccard.firsts(docs)


@reachable
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight plays them, in the order of the schedule.

    Documents without words are not played; repeated rows are played each; equal places can't occur.
    """
    return mixing.mixed(docs)


@reachable
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences with their place.

    A null or blank text is its end mark alone; repeated rows are packed each; pieces of equal length take their
    places in the order of a hash.
    """
    return packing.pack(saved(packing.cut(docs), "pieces"))


STAGES = [
    ("quality rules", quality_rules_stage),
    ("quality classifier", quality_classifier_stage),
    ("near duplicates", near_duplicates_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]
#: Models and tokenizers can't be said in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
