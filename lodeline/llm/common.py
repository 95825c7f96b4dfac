"""Shared pieces: table loading, the shared scratch folder, salted group lookups and connected components."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The separators of a word: space and the five ASCII controls 0x09 to 0x0D.
SPACES = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
_UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def ascii_lower(text: str) -> str:
    """Lower-case A-Z only."""
    return text.lower() if text.isascii() else text.translate(_UPPER)


def words(text: str) -> list[str]:
    """Lower-cased words `[^\\x20\\x09-\\x0D]+` of a text."""
    low = ascii_lower(text)
    # str.split() on ASCII text also splits at 0x1C-0x1F, which are word characters here.
    return WORD.findall(low)


def byte_words(text: str) -> list[bytes]:
    """The same words in UTF-8: bytes are lower-cased within ASCII and split at just these six separators."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, null texts as empty: other columns cannot clash with an operator's own."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def text_key(text: str = "text"):
    """64 bits of a text, null as empty. With doc_id it tells rows apart, should two texts have one doc_id."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


#: Rows of a batch that texts are sent to Python in: documents can be long, and a batch is held several times over.
TEXT_ROWS = 2000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def text_batches(spark: SparkSession) -> None:
    """Smaller batches for operators on whole texts, unless the session asks for even smaller ones."""
    if int(spark.conf.get(_ROWS)) > TEXT_ROWS:
        spark.conf.set(_ROWS, TEXT_ROWS)


def release_memory() -> None:
    """Give freed memory back to the system: workers live on between tasks, and the allocator keeps what it had."""
    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary folder, but only
    in local mode, where there are no other machines."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        have = spark.sparkContext._jsc.sc().getCheckpointDir()
        if have.isDefined():
            return have.get()
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        base = f"file://{tempfile.mkdtemp(prefix='lodeline-')}"
        spark.sparkContext.setCheckpointDir(base)
    return base


class Scratch:
    """Tables of one run in the shared folder. A written table cuts the lineage and outlives executors."""

    def __init__(self, spark: SparkSession, name: str):
        text_batches(spark)
        self.spark, self.root = spark, f"{shared_folder(spark).rstrip('/')}/lodeline-{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


SALTS = 32


def salt(spread: str):
    """The part of its key's rows that a row is dealt to."""
    return F.pmod(F.xxhash64(spread), F.lit(SALTS))


def group_totals(rows: DataFrame, key: str, spread: str, best) -> DataFrame:
    """(key, _salt, totals) for every part of a key that has rows, without gathering a group.

    A hot key is dealt over SALTS parts by a hash of `spread`: each part is aggregated alone, the parts' results are
    aggregated again, and the total comes back to the parts, so that no task holds more than a salt's share of a key.
    best: list of (partial aggregate, final aggregate over the partial's column, name).
    """
    part = rows.withColumn("_salt", salt(spread)).groupBy(key, "_salt").agg(*(p.alias(n) for p, _, n in best))
    total = part.groupBy(key).agg(*(f(n).alias(n) for _, f, n in best))
    return part.select(key, "_salt").join(total, key)


def with_group(rows: DataFrame, key: str, spread: str, best) -> DataFrame:
    """rows with the totals of their key's group; see group_totals. rows are read twice, so they should be a table."""
    return rows.withColumn("_salt", salt(spread)).join(group_totals(rows, key, spread, best), [key, "_salt"]).drop("_salt")


class Forest:
    """Union-find over integer node ids; each root is its tree's smallest id."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        top = x
        while (y := up.get(top, top)) != top:
            top = y
        while (y := up.get(x, x)) != top and y != x:
            up[x] = top
            x = y
        return top

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        lo, hi = (a, b) if a < b else (b, a)
        self.up[hi] = lo
        self.up.setdefault(lo, lo)
        return True


def _stars(batches):
    """Edges of a partition to one edge per node, towards the smallest id of its local tree."""
    f = Forest()
    for pdf in batches:
        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist()):
            f.join(a, b)
    out = [(x, f.root(x)) for x in f.up]
    out = [(x, r) for x, r in out if x != r]
    yield pd.DataFrame({"a": np.array([r for _, r in out], "int64"), "b": np.array([x for x, _ in out], "int64")})


#: Edges up to which one task may finish the union; 16 bytes each.
ONE_TASK_EDGES = 200_000


def components(edges: DataFrame, scratch: Scratch, name: str, *, one_task: int = ONE_TASK_EDGES) -> DataFrame:
    """(node, root) of every node that an edge (a, b) touches; root is the smallest node id reachable.

    Each round contracts the edges of a partition by union-find, which leaves one edge per node and partition. Below
    `one_task` edges (a checked bound) one task ends the work; above it, rounds of large-star and small-star
    (Kiveris et al. 2014) run over written tables until nothing changes.
    """
    kind = "a long, b long"
    now = scratch.keep(edges.select("a", "b").mapInPandas(_stars, kind), f"{name}-0")
    k = 0
    while now.count() > one_task:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.where("b > a").join(low, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        large = scratch.keep(large, f"{name}-l{k}")
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b")
        nxt = small.select(F.col("m").alias("a"), "b").union(small.where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))).distinct()
        nxt = scratch.keep(nxt, f"{name}-{k + 1}")
        same = nxt.exceptAll(now).isEmpty() and now.exceptAll(nxt).isEmpty()
        scratch.drop(f"{name}-{k}")
        scratch.drop(f"{name}-l{k}")
        now, k = nxt, k + 1
        if same:
            break
    else:
        now = now.coalesce(1).mapInPandas(_stars, kind)
    # Both ends of a row at once: a union would run the last union-find twice, by two workers of one task.
    return scratch.keep(now.select(F.explode(F.array("b", "a")).alias("node"), F.col("a").alias("root")).distinct(), f"{name}-out")
