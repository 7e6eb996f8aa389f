"""A corpus from raw documents to token ids: quality, exact dedup, near-dedup, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next one's docs. All but the last return the columns of documents.

In every stage a null text counts as empty, texts of any length are read whole, null and repeated ids and repeated rows
touch no other row, ties are broken as the operator's docstring says, an empty table gives an empty one, and other columns are carried
along, whatever they are called (but for the names in tidewater.llm.common.ROW).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidewater.llm import bpe, dedup, mixing, quality, simhash
from tidewater.llm.common import shared_dir, table


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; each row by its own text."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every text without its blanks: the longest, then that with the smallest id."""
    return dedup.keep_distinct(docs)


def apart(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates (five-word shingles, similarity 0.8 or more): that with the smallest id."""
    return simhash.keep_apart(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.take_mixed(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, their number, and whether they decode to the text."""
    return bpe.encode_rows(docs)


STAGES = [("quality", good), ("exact_dedup", distinct), ("near_dedup", apart), ("mix", mixed), ("bpe", encoded)]

#: Stages run Python (statistics, fingerprints, token ids) that SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
