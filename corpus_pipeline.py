"""A corpus pipeline: quality rules, near duplicates, decontamination, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and returns a frame, which is written as Parquet and read again as the next one's docs.
Every stage takes null and empty texts, null and repeated doc_ids, repeated rows, empty tables and any other columns, and
says what becomes of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quietline.llm import decontaminate, mix, ngram_join, quality, tokens
from quietline.llm.queries import table, tokenizer_path
from quietline.llm.shared import keep_until_clear, shared_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the policy keeps. Null and empty texts have too few words and go; repeated rows are judged alike."""
    whole = F.struct(*(F.col(c) for c in docs.columns)).alias("doc")
    judged = quality.judged(quality.ledger(docs.select(whole, F.col("text").alias("text"))))
    return judged.where("kept").select("doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of links: that with the smallest doc_id (null last), then the smallest hash of the row.

    Rows without words stay; of wholly equal rows with words one stays; different texts that share a doc_id, or have none, are
    documents of their own.
    """
    return ngram_join.representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark; null and empty texts have none and stay."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each time that a document, or a run of its words, is taken.

    Texts without words are never taken; a null source is a source; rows that share a doc_id are taken one by one.
    """
    return mix.mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the store has of each row of the mix, in order of doc_id (null first); a null text has the end id alone."""
    return tokens.encoded(docs.select("doc_id", "text"), tokenizer_path(), end_id=2)


STAGES = [("quality", quality_rules), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("token_ids", token_ids)]

#: Hash draws and token ids aren't expressible in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    root = keep_until_clear(shared_dir(spark))
    for k, (name, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{k}_{name}")
        docs = spark.read.parquet(f"{root}/{k}_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
