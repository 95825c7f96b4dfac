"""The corpus pipeline: toxic documents go, exact copies go, near copies go, repeated passages go, the rest is packed.

Each stage takes (spark, docs, sf_dir) and returns a table that the next one reads; all but the last keep the columns of
documents. A stage's verdict is on a row: doc_id and text together say which, so where a doc_id stands on two texts, or on
none, each text meets its own verdict.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeline.llm.common import Scratch, table, text_key
from lodeline.llm.exact_dedup import exact_dedup
from lodeline.llm.minhash import near_duplicates
from lodeline.llm.packing import pack
from lodeline.llm.repeats import remove_repeats
from lodeline.llm.toxicity import score_documents
from lodeline.llm.word_ids import WORD_BPE, tokenizer_file


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    gone = rejected.select(F.col("doc_id").alias("_gone_id"), F.col("text_key").alias("_gone_key")).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_gone_id")) & (text_key() == F.col("_gone_key"))
    return docs.join(gone, same, "left_anti")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go."""
    judged = score_documents(spark, docs, table(spark, sf_dir, "labels"))
    return _without(docs, judged.where("predicted = 1"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal up to white space the longest stays."""
    return _without(docs, exact_dedup(spark, docs).where("NOT kept"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by shingles of five words at 0.8 or more, the smallest doc_id stays."""
    return _without(docs, near_duplicates(spark, docs, words=5, num=80, den=100).where("NOT kept"))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes covered by strings of 100 bytes that start earlier go, and documents of which nothing is left."""
    return remove_repeats(spark, docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document in a sequence of 4096 ids."""
    return pack(docs, tokenizer_file(WORD_BPE))


STAGES = [("toxicity", toxicity), ("exact_dedup", exact), ("near_dedup", near), ("passages", passages), ("packing", packing)]
#: No SQL can express these stages; tests hold the rows against a brute-force pipeline.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs
