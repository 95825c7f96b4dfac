"""A corpus of rule files as DataFrames: files, tags and structural nodes."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeline.config import Vocabulary
from lodeline.operators.closure import shared_folder
from lodeline.operators.resolve import TRUE_WORDS
from lodeline.sources import lexer

SUFFIX = "*.[iI][fF][pP]"
#: Tags that make the tree of a file.
STRUCTURAL = ("Project", "Product", "Phase", "Rule", "DataSource", "Question", "Button", "ItemGroup")

_ATTRIBUTE = T.StructType([T.StructField("name", T.StringType()), T.StructField("folded", T.StringType()), T.StructField("value", T.StringType())])
TAG = T.StructType([
    T.StructField("file", T.StringType()), T.StructField("ordinal", T.LongType()), T.StructField("name", T.StringType()),
    T.StructField("offset", T.LongType()), T.StructField("end", T.LongType()), T.StructField("line", T.LongType()),
    T.StructField("is_end", T.BooleanType()), T.StructField("self_closing", T.BooleanType()),
    T.StructField("attributes", T.ArrayType(_ATTRIBUTE)),
    T.StructField("truncated", T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("observed_bytes", T.LongType())]))),
    T.StructField("duplicates", T.ArrayType(T.StringType())), T.StructField("hits", T.ArrayType(T.StringType())),
    T.StructField("error", T.StringType()), T.StructField("parent", T.LongType()), T.StructField("depth", T.IntegerType()),
    T.StructField("product_name", T.StringType()), T.StructField("product_eid", T.StringType()), T.StructField("phase_name", T.StringType()),
    T.StructField("disabled", T.BooleanType()), T.StructField("note", T.StringType()),
])


class LookupIncomplete(OSError):
    pass


def files(spark: SparkSession, root: str | DataFrame, *, recursive: bool = True) -> DataFrame:
    """(file, length, modified, content) of every rule file below root; the suffix counts in any case.

    A corpus may be a table as well: rows of (file, content), with `modified` where they have it.
    """
    if isinstance(root, DataFrame):
        when = F.col("modified") if "modified" in root.columns else F.lit(0).cast("timestamp")
        rows = root.select("file", F.col("content").cast("binary").alias("content"), when.alias("modified"))
        return rows.where(F.lower("file").endswith(".ifp")).select("file", F.length("content").cast("long").alias("length"), "modified", "content")
    reader = spark.read.format("binaryFile").option("pathGlobFilter", SUFFIX).option("recursiveFileLookup", str(recursive).lower())
    return reader.load(root).select(F.col("path").alias("file"), "length", F.col("modificationTime").alias("modified"), "content")


def listed(root: str | Path) -> tuple[list[tuple[str, int, int]], list[tuple[str, str]]]:
    """(path, size, mtime in ns) of rule files on a local disk in order, links resolved once, and (path, error)s."""
    top, found, errors = Path(root).resolve(), {}, []
    if top.is_file():
        stat = top.stat()
        return ([(str(top), stat.st_size, stat.st_mtime_ns)] if top.suffix.lower() == ".ifp" else []), []
    for folder, names, inside in os.walk(top, onerror=lambda e: errors.append((str(e.filename), str(e)))):
        names[:] = sorted((n for n in names if n != ".git"), key=str.casefold)
        for name in sorted(inside, key=str.casefold):
            if not name.lower().endswith(".ifp"):
                continue
            try:
                path = (Path(folder) / name).resolve(strict=True)
                if path.is_relative_to(top) and path.is_file():
                    stat = path.stat()
                    found[str(path)] = (str(path), stat.st_size, stat.st_mtime_ns)
            except OSError as e:
                errors.append((name, str(e)))
    return list(found.values()), errors


class Enclosure:
    """What is open around the tag being read."""

    def __init__(self):
        self.tree: list[tuple[str, int]] = []
        self.open: dict[str, list] = {"Product": [], "Phase": [], "Rule": []}

    def enter(self, t: lexer.Tag) -> tuple:
        """(parent, depth, product, product eid, phase, disabled, note) of a tag; keeps what it opens or closes."""
        note = None
        if t.name in STRUCTURAL and t.is_end and t.error is None:
            if self.tree and self.tree[-1][0] == t.name:
                self.tree.pop()
            if t.name in self.open:
                if self.open[t.name]:
                    self.open[t.name].pop()
                else:
                    note = "UNBALANCED"
        low = {n.casefold(): v for n, v in t.attributes}
        rules = self.open["Rule"]
        disabled = (bool(rules) and rules[-1]) or low.get("ruledisabled", "").strip().lower() in TRUE_WORDS
        product = self.open["Product"][-1] if self.open["Product"] else (None, None)
        phase = self.open["Phase"][-1] if self.open["Phase"] else None
        out = (self.tree[-1][1] if self.tree else None, len(self.tree), *product, phase, disabled, note)
        if t.name in STRUCTURAL and not t.is_end and not t.self_closing and t.error is None:
            self.tree.append((t.name, t.start))
            if t.name == "Product":
                self.open["Product"].append((low.get("name") or None, low.get("eid") or None))
            elif t.name == "Phase":
                self.open["Phase"].append(low.get("name") or None)
            elif t.name == "Rule":
                rules.append(disabled)
        return out

    def left_open(self) -> str | None:
        n = [len(self.open[k]) for k in ("Product", "Phase")]
        return f"UNCLOSED {n[0]} {n[1]}" if any(n) else None


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(file, mark) of every rule file, read now: a mark is the file's length and time. No content is read, and the rows
    are written to the shared folder, so that later changes of the corpus do not show in them."""
    rows = files(spark, root).select("file", F.concat_ws(":", "length", F.col("modified").cast("double")).alias("mark"))
    where = f"{shared_folder(spark).rstrip('/')}/listing-{uuid.uuid4().hex}"
    rows.write.parquet(where)
    return spark.read.schema(rows.schema).parquet(where)


def cached_tags(spark: SparkSession, store, contents: DataFrame, **options) -> DataFrame:
    """Tags of (file, content) rows, lexing only contents that the store has not seen.

    The cache is keyed by the SHA-256 of a content and the options it is read with, so a file that moves, or comes back,
    is found again. Contents that are gone from the corpus leave the cache.
    """
    voc, how = options.get("vocabulary"), {k: v for k, v in sorted(options.items()) if k != "vocabulary"}
    key = F.sha2(F.concat(F.col("content"), F.encode(F.lit(f"{how} {voc.signature() if voc else ''}"), "utf-8")), 256)
    asked = contents.select("file", "content", key.alias("content_key"))
    schema = T.StructType([T.StructField("content_key", T.StringType()), *(f for f in TAG if f.name != "file"), T.StructField("lexed", T.BooleanType())])
    old = store.table("tags", schema)
    new = asked.dropDuplicates(["content_key"]).join(old.select("content_key").distinct(), "content_key", "left_anti")
    lexed = tags(new.select(F.col("content_key").alias("file"), "content"), **options).withColumnRenamed("file", "content_key").withColumn("lexed", F.lit(True))
    # A content without any tag leaves a row as well, so that it is not lexed again.
    blank = new.select("content_key", *(F.lit(None).cast(f.dataType).alias(f.name) for f in schema if f.name not in ("content_key", "lexed")), F.lit(False).alias("lexed"))
    kept = old.join(asked.select("content_key").distinct(), "content_key", "left_semi")
    store.publish({"tags": kept.select(*schema.names).unionByName(lexed.select(*schema.names)).unionByName(blank)})
    found = store.table("tags").where("lexed").drop("lexed")
    return asked.select("file", "content_key").join(found, "content_key").select(*TAG.names)


def tags(contents: DataFrame, *, names: tuple[str, ...] | None = None, vocabulary: Vocabulary | None = None, references: tuple[str, ...] = (), ignore_case: bool = False, only_hits: bool = False) -> DataFrame:
    """Tags of (file, content) rows. A file that cannot be read gives one row without a name and with the error.

    With a vocabulary only attributes that contracts keep are read. only_hits keeps start tags that hold a reference.
    Files are read in order anyway, so what encloses a tag is known as it is read: its parent among structural tags, the
    innermost Product and Phase, and whether it or a Rule around it is disabled. `note` tells of end tags that close
    nothing, of references that no tag can hold, and in a last row per file of Products and Phases left open.
    """
    wanted = vocabulary.keeps if vocabulary is not None else (lambda _: True)

    def rows(file: str, content: bytes, wanted: Callable[[str], bool]) -> Iterator[tuple]:
        inside = Enclosure()
        try:
            for k, t in enumerate(lexer.tags(content, names=names, wanted=wanted, references=references, ignore_case=ignore_case)):
                place = inside.enter(t)
                if only_hits and not t.hits:
                    continue
                bag_ = [{"name": n, "folded": n.casefold(), "value": v} for n, v in t.attributes]
                cut = [{"name": n, "observed_bytes": b} for n, b in t.truncated]
                yield file, k, t.name, t.start, t.end, t.line, t.is_end, t.self_closing, bag_, cut, sorted(set(t.duplicates)), t.hits, t.error, *place
            for at, reference in lexer.loose(content, references, ignore_case) if references else ():
                yield file, -3, None, at, at, 1, False, False, [], [], [], [reference], None, None, 0, None, None, None, False, "LOOSE"
            if note := inside.left_open():
                yield file, -2, None, 0, 0, 0, False, False, [], [], [], [], None, None, 0, None, None, None, False, note
        except (lexer.FileError, UnicodeError) as e:
            yield file, -1, None, 0, 0, 0, False, False, [], [], [], [], str(e), None, 0, None, None, None, False, None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Names come again with every tag; those seen last are remembered.
        asked = lru_cache(4096)(wanted)
        for pdf in batches:
            for file, content in zip(pdf["file"], pdf["content"]):
                part = []
                for row in rows(file, bytes(content), asked):
                    part.append(row)
                    if len(part) >= 5000:
                        yield pd.DataFrame(part, columns=TAG.names)
                        part = []
                if part:
                    yield pd.DataFrame(part, columns=TAG.names)

    return contents.select("file", "content").mapInPandas(run, TAG)


def bag(attributes: str = "attributes"):
    """Attributes as a map, the last value of a name."""
    return F.map_from_entries(F.transform(F.filter(attributes, lambda a: F.lit(True)), lambda a: F.struct(a["name"], a["value"])))


def value(names, attributes: str = "attributes"):
    """The first filled attribute among the names, each by its last occurrence; names compare folded."""

    def last(name: str):
        return F.get(F.reverse(F.filter(attributes, lambda a: a["folded"] == name.casefold())), 0)["value"]

    found = [last(n) for n in names]
    return F.coalesce(*(F.when(v != "", v) for v in found), F.lit(None).cast("string")) if found else F.lit(None).cast("string")


def ending(*ends: str, attributes: str = "attributes"):
    """The first filled attribute in document order whose name ends so."""
    hit = F.filter(attributes, lambda a: (a["value"] != "") & a["folded"].rlike("(" + "|".join(ends) + ")$"))
    return F.get(hit, 0)["value"]


def eid_index(contents: DataFrame) -> DataFrame:
    """(eid, file): an inverted index of candidate values; a reader of the file confirms them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pairs = [(e, f) for f, c in zip(pdf["file"], pdf["content"]) for e in sorted(lexer.eids(bytes(c)))]
            yield pd.DataFrame(pairs, columns=["eid", "file"])

    return contents.select("file", "content").mapInPandas(run, "eid string, file string")
