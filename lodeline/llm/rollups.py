"""Delta-maintained token totals by source, language and tokenizer version.

A batch of changes (insert, delete, revise) becomes signed rows: +1 document and +n tokens, or -1 and -n; a revision is
both. The signed rows of a batch are its ledger entry, their sums by (source, lang, tokenizer) its delta, and totals are
the sum of all committed deltas.

The log under commits/ has an entry per version. A committer reads the state at a version, writes its files under a name
of its own, writes its entry aside and renames it to the next version, which fails where that version exists: then another
committer was first, and the batch is worked out again on the new state. So entries are whole or not there, a batch whose
name the log has is not applied again, and what a lost executor, driver or race leaves behind is never read. `compact`
writes the live state as an entry that stands for all before it.

Defined results: a null text has no tokens; null source, lang and doc_id are values of their own. A doc_id repeated in
one batch counts once (the largest of its rows); rows with a null doc_id are inserted each for itself, and cannot be
deleted or revised again. Inserting a document that is live revises it; deleting one that is not does nothing. Totals of
no documents are left out. Other columns are ignored.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeline.llm.common import Scratch, byte_words, table
from lodeline.llm.word_ids import WORD_BPE, tokenizer_file, word_ids

KEYS = ["source", "lang", "tokenizer"]


def count_words(texts: list[str]) -> list[int]:
    return [len(byte_words(t)) for t in texts]


class CountWordBpe:
    def __init__(self, path: str):
        self.path = path

    def __call__(self, texts: list[str]) -> list[int]:
        return [len(x) // 4 for x in word_ids(self.path).ids(texts)]


def production_tokenizers() -> dict:
    return {"words-1": count_words, "word_bpe_49k-1": CountWordBpe(tokenizer_file(WORD_BPE))}


def counted(changes: DataFrame, tokenizers: dict) -> DataFrame:
    """(op, doc_id, source, lang, tokenizer, tokens), a row per change and tokenizer; deletes have null tokens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            whole = pdf["text"].fillna("").tolist()
            for name, count in tokenizers.items():
                out = pdf[["op", "doc_id", "source", "lang"]].copy()
                out["tokenizer"], out["tokens"] = name, count(whole)
                yield out

    cols = [F.col("op").cast("string"), F.col("doc_id").cast("string"), F.col("source").cast("string"), F.col("lang").cast("string")]
    text = F.when(F.col("op") != "delete", F.col("text")).alias("text")
    kind = "op string, doc_id string, source string, lang string, tokenizer string, tokens long"
    return changes.select(*cols, text).mapInPandas(run, kind).withColumn("doc_id", F.col("doc_id").cast("long"))


class TokenRollup:
    """Totals kept under `folder`: ledger/ and deltas/ by attempt, commits/ with an entry per version."""

    LEDGER = "doc_id long, source string, lang string, tokenizer string, docs long, tokens long"
    DELTA = "source string, lang string, tokenizer string, docs long, tokens long"

    def __init__(self, spark: SparkSession, folder: str, tokenizers: dict):
        self.spark, self.folder, self.tokenizers = spark, folder.rstrip("/"), tokenizers
        jvm = spark._jvm
        self._path, self._conf = jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
        self.fs = self._path(self.folder).getFileSystem(self._conf)

    def log(self) -> list[dict]:
        """Entries by version: batch, attempt and whether it stands for all before it."""
        where = self._path(f"{self.folder}/commits")
        if not self.fs.exists(where):
            return []
        out = {}
        for status in self.fs.listStatus(where):
            stream = self.fs.open(status.getPath())
            try:
                out[int(status.getPath().getName())] = json.loads(stream.readUTF())
            finally:
                stream.close()
        return [out[k] for k in sorted(out)]

    def _publish(self, version: int, entry: dict) -> bool:
        """Make the entry that version's; False where the version exists."""
        aside = self._path(f"{self.folder}/aside/{uuid.uuid4().hex}")
        out = self.fs.create(aside, False)
        out.writeUTF(json.dumps(entry))
        out.close()
        to = self._path(f"{self.folder}/commits/{version:012d}")
        self.fs.mkdirs(to.getParent())
        jvm = self.spark._jvm
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            # Unlike FileSystem.rename this never replaces what is there.
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), self._conf).rename(aside, to, none)
        except Exception:
            if self.fs.exists(to):
                self.fs.delete(aside, False)
                return False
            raise
        return True

    def committed(self, batch: str) -> bool:
        return any(e["batch"] == batch for e in self.log())

    @staticmethod
    def attempts(log: list[dict]) -> list[str]:
        """Attempts whose files make up the state."""
        base = max((k for k, e in enumerate(log) if e.get("base")), default=0)
        return [e["attempt"] for e in log[base:]]

    def _read(self, part: str, schema: str, log: list[dict]) -> DataFrame:
        paths = [f"{self.folder}/{part}/{a}" for a in self.attempts(log)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def ledger(self) -> DataFrame:
        return self._read("ledger", self.LEDGER, self.log())

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply changes (op, doc_id, source, lang, text) once; False if the batch was committed before."""
        new = None
        while True:
            log = self.log()
            if any(e["batch"] == batch for e in log):
                return False
            if new is None:
                new = Scratch(self.spark, "rollup").keep(self._latest(changes), "changes")
            attempt = uuid.uuid4().hex
            self._write(attempt, self._signed(new, log))
            if self._publish(len(log), {"batch": batch, "attempt": attempt}):
                return True

    def compact(self) -> bool:
        """Write the live documents as one entry; False where a committer was first, which does no harm."""
        log = self.log()
        state = self._read("ledger", self.LEDGER, log).groupBy("doc_id", *KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        attempt = uuid.uuid4().hex
        self._write(attempt, state.where("docs <> 0 OR tokens <> 0"))
        return self._publish(len(log), {"batch": None, "attempt": attempt, "base": True})

    def _latest(self, changes: DataFrame) -> DataFrame:
        """A row per document and tokenizer, and a row each of those without a doc_id."""
        # Rows without a doc_id are told apart by their place, so that texts are counted in one pass.
        rows = counted(changes, self.tokenizers).withColumn("own", F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()))
        rank = F.struct(F.when(F.col("op") == "delete", 0).otherwise(1).alias("live"), "source", "lang", "tokens")
        return rows.groupBy("doc_id", "own", "tokenizer").agg(F.max(rank).alias("r")).drop("own")

    def _signed(self, new: DataFrame, log: list[dict]) -> DataFrame:
        plus = new.where("r.live = 1").select("doc_id", "r.source", "r.lang", "tokenizer", F.lit(1).cast("long").alias("docs"), "r.tokens")
        if not log:
            return plus
        have = self._read("ledger", self.LEDGER, log)
        touched = new.where("doc_id IS NOT NULL").select("doc_id", "tokenizer")
        old = have.join(touched, ["doc_id", "tokenizer"], "left_semi").groupBy("doc_id", *KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return plus.unionByName(old.where("docs > 0").select("doc_id", *KEYS, (-F.col("docs")).alias("docs"), (-F.col("tokens")).alias("tokens")))

    def _write(self, attempt: str, signed: DataFrame) -> None:
        signed.write.parquet(f"{self.folder}/ledger/{attempt}")
        signed = self.spark.read.schema(self.LEDGER).parquet(f"{self.folder}/ledger/{attempt}")
        self._summed(signed).write.parquet(f"{self.folder}/deltas/{attempt}")

    @staticmethod
    def _summed(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))

    def totals(self) -> DataFrame:
        return self._summed(self._read("deltas", self.DELTA, self.log())).where("docs <> 0 OR tokens <> 0")


def _rolled_up(spark: SparkSession, sf_dir: str, tokenizers: dict) -> DataFrame:
    store = TokenRollup(spark, Scratch(spark, "totals").path("store"), tokenizers)
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    load = docs.withColumn("op", F.lit("insert"))
    store.commit("load", load)
    store.commit("load", load)  # a batch that is sent again counts once
    # Signed corrections: some documents are deleted and come back, which leaves the totals of the corpus.
    some = load.where("doc_id % 50 = 0")
    store.commit("withdrawn", some.withColumn("op", F.lit("delete")))
    store.commit("restored", some)
    return store.totals().withColumnRenamed("tokenizer", "tokenizer_version").withColumnRenamed("docs", "n_docs").withColumnRenamed("tokens", "n_tokens")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rolled_up(spark, sf_dir, production_tokenizers())


def token_rollup_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rollup with the one tokenizer that SQL can express."""
    return _rolled_up(spark, sf_dir, {"words-1": count_words})


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, lang, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n FROM documents),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, CASE WHEN doc_id IS NULL THEN r END ORDER BY source DESC NULLS LAST, lang DESC NULLS LAST, n DESC) AS place FROM d)
SELECT source, lang, 'words-1' AS tokenizer_version, count(*) AS n_docs, sum(n)::BIGINT AS n_tokens
FROM k WHERE place = 1 GROUP BY source, lang
"""
