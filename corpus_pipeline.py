"""A corpus pipeline: quality rules, near duplicates, repeated passages, mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet
and reads again as the next stage's ``docs``. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from volclock.llm import mixing, ngram_join, packing, quality_rules, substring
from volclock.llm.scratch import Temporary, stored
from volclock.llm.text import table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return ngram_join.one_of_each_group(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows that occur elsewhere are taken out."""
    return substring.without_repeats(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target of their source asks for."""
    return mixing.mix(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in training sequences."""
    return packing.pack_documents(docs, packing.public_vocabulary())


STAGES = [
    ("quality rules", good_quality),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("mixture", mixture),
    ("packing", sequences),
]

#: Tokenising and packing can't be told in SQL. tests/llm/test_pipeline.py holds the
#: chain against plain versions, stage by stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. A stage's table goes once the next one is written.

    What each stage makes of nulls, empty and long texts, ties, repeated rows and clashing names
    is its operator's to say; all of them return no rows for an empty table.
    """
    docs = table(spark, sf_dir, "documents")
    with Temporary(spark) as temporary:
        for name, stage in STAGES[:-1]:
            before, docs = docs, temporary.stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            temporary.drop(before)
        name, stage = STAGES[-1]
        return stored(stage(spark, docs, sf_dir), name)
