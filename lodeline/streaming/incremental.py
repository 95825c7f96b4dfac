"""Rule files as a stream: new files are lexed as they arrive and their rows appended once.

The file source remembers what it has seen, and a batch is written under its number, so a batch that runs again after a
failure replaces what it wrote before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodeline.sources import corpus

_FILE = "path string, modificationTime timestamp, length long, content binary"


def watch_eids(spark: SparkSession, root: str, folder: str) -> None:
    """Bring the index (eid, file) under folder up to date with the files that came since the last call."""
    new = spark.readStream.format("binaryFile").schema(_FILE).option("pathGlobFilter", corpus.SUFFIX).option("recursiveFileLookup", "true").load(root)

    def add(batch: DataFrame, number: int) -> None:
        rows = corpus.eid_index(batch.select(batch["path"].alias("file"), "content"))
        rows.write.mode("overwrite").parquet(f"{folder}/index/batch={number}")

    query = new.writeStream.foreachBatch(add).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    query.awaitTermination()


def eids(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("eid string, file string, batch long").parquet(f"{folder}/index").select("eid", "file").distinct()
