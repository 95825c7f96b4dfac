"""Log-likelihood of whole documents under a unigram base and under a class-factored gated recurrent model.

Counts: one pass over the training rows counts every word; all counts, totals and class sums cover all of them. The
HEAD most frequent tokens are the model's head words, in classes by rank; every other word, unseen ones included, is in a
tail class by its letters, and its probability there is (c + 0.5) / (N_class + 0.5 * (V_class + 1)).

Training: a common start is fitted on at most START_DOCS rows (a documented bound), then every task trains on all of its
training rows, none left out, and the tasks' networks are averaged, weighted by tokens, block by block on the executors.
Only the averaged network comes to the driver.

Scoring: one pass. Words among the KNOWN most frequent (a bounded table that tasks hold) are scored at once; the rest
leave a row per document and word that meets its count by a join, so no vocabulary is ever held whole.

Defined results: null and empty texts are the end token alone. Training leaves out rows with a null doc_id (their
remainder is null, held_out is false). With no training rows N and V are 0 and every token costs log10(1). Repeated rows
count and score each time. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeline.llm.common import Scratch, byte_words, release_memory, table, texts
from lodeline.llm.recurrent import Net, Shape, Trainer, flatten, fresh, unflatten

#: The end of a document among words, which never hold a line feed.
END = b"\n"
FOLDS, HELD_OUT = 5, 1
KNOWN, START_DOCS = 150_000, 1500
PART = 4096
LN10 = float(np.log(10))


def tail_class(word: bytes) -> int:
    """One of 32: by the first letter outside ASCII, else by the last two letters."""
    if not word.isascii():
        return next(ord(c) for c in word.decode("utf-8", "replace") if c > "\x7f") % 16
    return 16 + zlib.crc32(word[-2:]) % 16


def remainder():
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS))


def word_counts(train: DataFrame, most: int = 300_000) -> DataFrame:
    """(word, c) over all rows, ends included, summed in tasks before the shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for pdf in batches:
            for t in pdf["text"]:
                seen.update(byte_words(t))
                seen[END] += 1
                if len(seen) > most:
                    yield pd.DataFrame({"word": list(seen), "n": list(seen.values())})
                    seen = Counter()
        yield pd.DataFrame({"word": list(seen), "n": list(seen.values())}, columns=["word", "n"]).astype({"n": "int64"})
        release_memory()

    return train.select("text").mapInPandas(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


def most_frequent(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """Up to `most` words with their counts, most frequent first.

    The least count to take is read off a histogram in sixteenths of a doubling, so no task sends words that are not
    wanted; of words in the step where the bound is met the first by name are taken.
    """
    step = F.floor(F.log2("c") * 16).cast("int")
    sizes = counts.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect()  # at most 16 * 63 rows
    taken, least = 0, None
    for r in sizes:
        if taken + r["count"] > most:
            break
        taken, least = taken + r["count"], r["step"]
    if least is None:
        rows = counts.orderBy(F.desc("c"), "word").limit(most).collect() if sizes else []
    else:
        rows = counts.where(step >= least).collect()
    return sorted(((bytes(r["word"]), int(r["c"])) for r in rows), key=lambda x: (-x[1], x[0]))


class Vocabulary:
    """What tasks know: the most frequent words with counts, head words, and class sums."""

    def __init__(self, shape: Shape, known: list[tuple[bytes, int]], n: int, v: int, sums: dict[int, tuple[int, int]]):
        self.shape, self.n, self.v = shape, n, v
        self.ids = {w: k for k, (w, _) in enumerate(known)}
        counts = np.array([c for _, c in known], np.float64)
        cls = np.array([tail_class(w) for w, _ in known], np.int64)
        self.tail = np.array([np.log10(sums.get(k, (0, 0))[0] + 0.5 * (sums.get(k, (0, 0))[1] + 1)) for k in range(shape.tail_classes)])
        self.total = float(np.log10(n + 0.5 * (v + 1)))
        rank = np.arange(len(known))
        head = rank < shape.head
        # One place more, for words that are not known (index -1).
        self.symbol = np.append(np.where(head, rank, shape.head + cls), 0).astype(np.int32)
        logs = np.log10(counts + 0.5)
        self.base = np.append(logs - self.total, 0.0)
        self.inner = np.append(np.where(head, 0.0, logs - self.tail[cls]), 0.0)

    def encode(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """(known index or -1, symbol, the words that are not known)."""
        ids = np.fromiter(map(self.ids.get, tokens, repeat(-1)), np.int64, len(tokens))
        symbol = self.symbol[ids]
        rare = np.flatnonzero(ids < 0)
        out = []
        if len(rare):
            of = [tokens[k] for k in rare.tolist()]
            symbol[rare] = [self.shape.head + tail_class(w) for w in of]
            out = of
        return ids, symbol, out


def _train(voc: Vocabulary, start: np.ndarray, texts_: Iterator[list[str]], rate: float, lanes: int) -> Trainer:
    trainer = Trainer(voc.shape, unflatten(voc.shape, start), rate)
    held: list[np.ndarray] = []
    size = 0
    for part in texts_:
        for t in part:
            held.append(voc.encode([*byte_words(t), END])[1])
            size += len(held[-1])
            if size > 1_500_000:
                trainer.learn(held, lanes)
                held, size = [], 0
    if held:
        trainer.learn(held, lanes)
    return trainer


def trained(spark: SparkSession, train: DataFrame, voc: Vocabulary, scratch: Scratch, *, start_docs: int = START_DOCS) -> np.ndarray:
    """The averaged network, flat."""
    shared = spark.sparkContext.broadcast(voc)
    size = len(flatten(fresh(voc.shape)))

    def blocks(trainer: Trainer) -> pd.DataFrame:
        flat = flatten(trainer.net.p)
        cut = [flat[a : a + PART] for a in range(0, size, PART)]
        return pd.DataFrame({"block": np.arange(len(cut)), "w": trainer.tokens, "values": cut})

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [t for b in batches for t in b["text"]]
        if rows:
            yield blocks(_train(shared.value, flatten(fresh(shared.value.shape)), iter([rows, rows]), 0.01, 256))

    kind = "block int, w long, values array<float>"
    # The rows are chosen by id; their number is bounded, so the ids are broadcast and only these texts travel.
    ids = train.select("doc_id", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(start_docs).select("doc_id")
    some = train.join(F.broadcast(ids), "doc_id").orderBy("doc_id").select("text")
    begun = some.coalesce(1).mapInPandas(first, kind).orderBy("block").collect()
    if not begun:
        return flatten(fresh(voc.shape))
    start = spark.sparkContext.broadcast(np.concatenate([np.array(r["values"], np.float32) for r in begun]))

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trainer = _train(shared.value, start.value, (b["text"].tolist() for b in batches), 0.004, 512)
        if trainer.tokens:
            yield blocks(trainer)

    def mean(pdf: pd.DataFrame) -> pd.DataFrame:
        w = pdf["w"].to_numpy(np.float64)
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "w": int(w.sum()), "values": [(np.stack(list(pdf["values"])) * w[:, None]).sum(axis=0) / w.sum()]})

    rows = scratch.keep(train.select("text").mapInPandas(local, kind).groupBy("block").applyInPandas(mean, kind), "network")
    # One network, of a fixed size.
    got = rows.orderBy("block").collect()
    return np.concatenate([np.array(r["values"], np.float32) for r in got]) if got else start.value


def _scored(voc, flat):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v: Vocabulary = voc.value
        net = Net(v.shape, unflatten(v.shape, flat.value))
        at = TaskContext.get().partitionId() << 40
        for pdf in batches:
            n_tokens, known, base, inner, symbols = [], [], [], [], []
            r_row, r_word, r_n, r_den = [], [], [], []
            for k, t in enumerate(pdf["text"]):
                tokens = [*byte_words(t), END]
                ids, sym, rare = v.encode(tokens)
                n_tokens.append(len(tokens))
                known.append(len(tokens) - len(rare))
                base.append(v.base[ids].sum())
                inner.append(v.inner[ids].sum())
                symbols.append(sym)
                if rare:
                    c = Counter(rare)
                    r_row += [at + k] * len(c)
                    r_word += c.keys()
                    r_n += c.values()
                    r_den += [v.tail[tail_class(w)] for w in c]
            score = np.zeros(len(pdf))
            a = 0
            sizes = np.cumsum(n_tokens)
            while a < len(pdf):  # a bounded number of tokens at a time
                b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + 1_500_000)))
                score[a:b] = net.score(symbols[a:b]) / LN10
                a = b
            yield pd.DataFrame({"row": at + np.arange(len(pdf)), "doc_id": pdf["doc_id"].astype("Int64"), "word": None, "n": n_tokens, "n_known": known, "base": base, "score": score + inner})
            yield pd.DataFrame({"row": np.array(r_row, "int64"), "doc_id": pd.array([None] * len(r_row), "Int64"), "word": r_word, "n": np.array(r_n, "int64"), "n_known": 0, "base": v.total, "score": r_den})
            at += len(pdf)
        release_memory()

    return run


def score_documents(spark: SparkSession, docs: DataFrame, *, shape: Shape | None = None, known: int = KNOWN, start_docs: int = START_DOCS) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    shape = shape or Shape()
    scratch = Scratch(spark, "lm")
    rows = texts(docs)
    train = rows.where(remainder() != HELD_OUT)
    counts = scratch.keep(word_counts(train), "counts")

    def by_class(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cls = np.fromiter(map(tail_class, map(bytes, pdf["word"])), np.int64, len(pdf))
            c = np.bincount(cls, weights=pdf["c"], minlength=shape.tail_classes)
            n = np.bincount(cls, minlength=shape.tail_classes)
            yield pd.DataFrame({"cls": np.arange(shape.tail_classes), "c": c.astype(np.int64), "n": n})

    sums = {int(r["cls"]): [int(r["c"]), int(r["n"])] for r in counts.mapInPandas(by_class, "cls long, c long, n long").groupBy("cls").agg(F.sum("c").alias("c"), F.sum("n").alias("n")).collect()}
    n, v = sum(x[0] for x in sums.values()), sum(x[1] for x in sums.values())
    top = most_frequent(counts, known)
    for w, c in top[: shape.head]:
        sums[tail_class(w)][0] -= c
        sums[tail_class(w)][1] -= 1
    voc = Vocabulary(shape, top, n, v, {k: tuple(x) for k, x in sums.items()})
    flat = spark.sparkContext.broadcast(trained(spark, train, voc, scratch, start_docs=start_docs))
    shared = spark.sparkContext.broadcast(voc)
    kind = "row long, doc_id long, word binary, n long, n_known long, base double, score double"
    found = scratch.keep(rows.mapInPandas(_scored(shared, flat), kind), "scored")
    rare = found.where("word IS NOT NULL").select("row", "word", "n", F.col("base").alias("total"), F.col("score").alias("inner"))
    log_c = F.log10(F.coalesce("c", F.lit(0)) + 0.5)
    rare = rare.join(counts, "word", "left").groupBy("row").agg(
        F.sum(F.col("n") * (log_c - F.col("total"))).alias("b"),
        F.sum(F.col("n") * (log_c - F.col("inner"))).alias("s"),
        F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("k"),
    )
    out = found.where("word IS NULL").join(rare, "row", "left")
    zero = F.lit(0.0)
    return out.select(
        "doc_id",
        F.coalesce(remainder() == HELD_OUT, F.lit(False)).alias("held_out"),
        F.col("n").alias("n_tokens"),
        (F.col("n_known") + F.coalesce("k", F.lit(0))).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("b", zero)).alias("base_score"),
        (F.col("score") + F.coalesce("s", zero)).alias("score"),
    )


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark, table(spark, sf_dir, "documents"))
