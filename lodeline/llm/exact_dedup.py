"""Exact deduplication against a persistent digest index, in DataFrame operations only.

The index is a table bucketed and sorted by digest. New rows are reduced to one winner per digest, the winners that
the index lacks are found by a sort-merge anti-join (the index side needs no shuffle) and appended. Texts are equal when
identical after deleting every character of `[\\x20\\x09-\\x0D]`. Only 32-byte digests and ids are shuffled, never texts.

Defined results: a null text is the empty text; all texts of white space are equal to it. Ties in length go to the
smallest doc_id; a null doc_id loses to any other. A row repeated with its doc_id is the same document and shares its
fate, each repetition counting in group_size. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeline.llm.common import SPACES, Scratch, salt, shuffle_width, table, text_key, with_group

MERGE = "merge"


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, digest (32 bytes) of the normalised text and chars, the original's code points."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.unhex(F.sha2(F.translate(text, SPACES, "").cast("binary"), 256)).alias("digest"),
        F.length(text).cast("long").alias("chars"),
        text_key().alias("text_key"),
    )


class DigestIndex:
    """A table (digest, keep_id, chars) in `buckets` buckets, each sorted by digest."""

    def __init__(self, spark: SparkSession, name: str, buckets: int | None = None):
        self.spark, self.name, self.buckets = spark, name, buckets or shuffle_width(spark)

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def _write(self, rows: DataFrame) -> None:
        rows.write.format("parquet").mode("append").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name)

    def append(self, winners: DataFrame) -> None:
        """Add winners whose digest the index lacks; repeating a batch adds nothing."""
        if not self.exists():
            # Not createDataFrame, which starts Python workers of another kind on the executors.
            self._write(winners.select("digest", "keep_id", "chars").where("false"))
        new = winners.select("digest", "keep_id", "chars").join(self.rows().hint(MERGE), "digest", "left_anti")
        self._write(new.repartition(self.buckets, "digest"))

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name} PURGE")

    def dedup(self, docs: DataFrame) -> DataFrame:
        """Per row: doc_id, keep_id (who holds the text in the index), group_size in this batch, kept, text_sha256, text_key.

        The batch's winners are sent twice, as by a writer that does not know whether it was heard: the second time the
        anti-join finds them all.
        """
        scratch = Scratch(self.spark, "exact")
        keyed = scratch.keep(digests(docs), "digests")
        # The largest (chars, ~doc_id) is the longest text, then the smallest id; a null id sorts below all.
        rank = F.struct("chars", F.bitwise_not("doc_id").alias("inv"))
        winners = keyed.groupBy("digest").agg(F.max(rank).alias("best")).select(
            "digest", F.bitwise_not("best.inv").alias("keep_id"), F.col("best.chars").alias("chars")
        )
        winners = scratch.keep(winners, "winners")
        self.append(winners)
        self.append(winners)
        sized = with_group(keyed, "digest", "doc_id", [(F.count("*"), F.sum, "group_size")])
        # One row per digest and salt meets the index, then the rows of that part: no task holds a whole hot group.
        salted = sized.withColumn("salt", salt("doc_id"))
        owners = salted.select("digest", "salt").distinct().join(self.rows().select("digest", "keep_id").hint(MERGE), "digest")
        out = salted.join(owners, ["digest", "salt"])
        return out.select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "text_key")


def fresh_index(spark: SparkSession) -> DigestIndex:
    return DigestIndex(spark, f"lodeline_digests_{uuid.uuid4().hex}")


def exact_dedup(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """All rows of `docs` against an index that starts empty and is dropped when the result is written."""
    index = fresh_index(spark)
    try:
        return Scratch(spark, "exact").keep(index.dedup(docs), "result")
    finally:
        index.drop()


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark, table(spark, sf_dir, "documents")).drop("text_key")


ORACLE = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS h
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, h AS text_sha256
FROM n WINDOW w AS (PARTITION BY h ORDER BY chars DESC, doc_id)
"""
