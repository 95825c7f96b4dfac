"""Tables published as a whole: Parquet under a folder, a version at a time, with an atomic pointer to the current one."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeline.operators.resolve import fingerprint_diff


class Store:
    """folder/versions/<id>/<table> and folder/current, which names the version that counts.

    A version is written first and counts from the rename of its pointer on, which replaces the old pointer in one step; a
    build that fails leaves the old one. The version before stays until the next one is published, so that readers who
    hold its tables can finish.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _current(self) -> dict:
        where = self._path(f"{self.folder}/current")
        if not self.fs.exists(where):
            return {"version": None, "tables": [], "metadata": {}}
        stream = self.fs.open(where)
        try:
            size = self.fs.getFileStatus(where).getLen()
            data = bytearray(stream.readNBytes(size))
        finally:
            stream.close()
        return json.loads(data.decode("utf-8"))

    def metadata(self) -> dict[str, str]:
        return self._current()["metadata"]

    def names(self) -> list[str]:
        return self._current()["tables"]

    def table(self, name: str, schema=None) -> DataFrame:
        """A table of the current version. With a schema: an empty one where there is none, and where an older version
        lacks columns these are null."""
        now = self._current()
        if name not in now["tables"]:
            if schema is None:
                raise KeyError(name)
            return self.spark.createDataFrame([], schema)
        have = self.spark.read.parquet(f"{self.folder}/versions/{now['version']}/{name}")
        if schema is None:
            return have
        wanted = self.spark.createDataFrame([], schema).schema
        return have.select(*(F.col(f.name) if f.name in have.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in wanted))

    def reset(self, *, keep: tuple[str, ...] = ()) -> None:
        """Forget everything but the tables to keep, which are published alone."""
        now = self._current()
        kept = {n: self.table(n) for n in keep if n in now["tables"]}
        if kept:
            self.publish(kept, now["metadata"])
        else:
            self.fs.delete(self._path(self.folder), True)

    def publish(self, tables: dict[str, DataFrame], metadata: dict[str, str] | None = None, checks: dict[str, DataFrame] | None = None, files: int | None = None) -> str:
        """Write a version and make it current. checks: tables that must be empty, for instance orphaned rows.

        files: at most so many files a table, for tables that are small and read often.
        """
        version = uuid.uuid4().hex
        root = f"{self.folder}/versions/{version}"
        for name, df in tables.items():
            (df.coalesce(files) if files else df).write.parquet(f"{root}/{name}")
        for name, bad in (checks or {}).items():
            if not bad.isEmpty():
                self.fs.delete(self._path(root), True)
                raise ValueError(f"{name} failed: {bad.limit(5).collect()}")
        body = json.dumps({"version": version, "tables": sorted(tables), "metadata": metadata or {}}).encode("utf-8")
        staged, current = self._path(f"{self.folder}/current-{version}"), self._path(f"{self.folder}/current")
        out = self.fs.create(staged, True)
        try:
            out.write(bytearray(body))
        finally:
            out.close()
        before = self._current()["version"]
        jvm = self.spark._jvm
        how = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(current.toUri(), self.spark._jsc.hadoopConfiguration()).rename(staged, current, how)
        for status in self.fs.listStatus(self._path(f"{self.folder}/versions")):
            if status.getPath().getName() not in (version, before):
                self.fs.delete(status.getPath(), True)
        return version


def orphans(rows: DataFrame, owners: DataFrame, *keys: str) -> DataFrame:
    return rows.join(owners.select(*keys).distinct(), list(keys), "left_anti")


def publish_contracts(store: Store, made, *, spark: SparkSession, listing: tuple[str, DataFrame] | None = None) -> dict:
    """Publish a build's tables; a build with files that failed is refused.

    listing: the root and the files as they were listed before the build; files that have changed since are refused too.
    """
    from lodeline.plans.contracts import summary
    from lodeline.sources.corpus import listing as listed

    counts = summary(made)
    if listing is not None:
        root, before = listing
        moved = fingerprint_diff(before, listed(spark, root), "file", "mark").where("status <> 'CACHED'")
        if not moved.isEmpty():
            raise ValueError(f"files changed while they were scanned; run again after writes stop: {moved.limit(5).collect()}")
    if counts["files_failed"]:
        raise ValueError("files could not be read; the tables that are published stay")
    who = made.caller_references.select(F.struct("caller_file", "tag_offset").alias("reference"))
    checks = {
        "caller_mappings without caller": orphans(made.caller_mappings, made.caller_references, "caller_file", "tag_offset"),
        "links without caller": orphans(made.caller_operation_links, who, "reference"),
    }
    store.publish(made.tables, made.metadata | {"scan_status": counts["status"]}, checks)
    return counts
