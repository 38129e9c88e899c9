"""A corpus pipeline of five stages over the documents table.

Each stage takes what its predecessor kept, is written as Parquet to the shared
folder and read again.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pixloom.llm.bpe import digested, encoded
from pixloom.llm.common import documents, written
from pixloom.llm.mixing import remix
from pixloom.llm.quality import keep_good
from pixloom.llm.simhash import keep_first
from pixloom.llm.suffix_dedup import without_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (SimHash candidates, five-word shingles of similarity 0.8 or more): the one with the smallest id."""
    return keep_first(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without byte strings that start earlier in the corpus; n_chars follows the text."""
    from pyspark.sql import functions as F

    out = without_repeats(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the fitted rates say."""
    return remix(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of what they decode to."""
    return digested(encoded(docs))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("suffix_dedup", suffix_dedup), ("mixing", mixing), ("encode", encode)]

#: SQL can't express the stages; tests hold near copies, repeated strings and encoding against brute force, quality against SQL and rates against numpy.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over all that its predecessor kept; nulls, repeats and odd texts as each stage's operator says."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
