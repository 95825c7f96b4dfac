"""Toxicity by the nearest labelled examples under exact TF-IDF cosine, found in a block-max inverted index.

1. Examples are the labelled rows outside the held-out fifth, at most `EXAMPLES` a class (a documented bound; the rows of
   least hash, so the choice is stable). Population shares of the classes weigh their votes. Examples with the same text
   and label are one.
2. Every word of the examples is a term: a run of letters and digits, lower-cased. A word that no example has cannot meet
   one, so it is no term. A word's beginning of 4 to 6 bytes is a term of its own where it tells the classes apart: its
   share of examples differs by a factor of RATIO or more with chi-square of CHI2 or more. Document frequencies are
   counted over all documents in one pass that sums an array of the terms in each task.
3. A term's weight is its inverse document frequency; terms that tell the classes apart weigh LIFT times that. No word is
   left out.
4. Examples are put in the index in blocks of BLOCK, alike ones together. Postings of rare terms are added up in full,
   those of frequent terms are kept by block with each block's largest weight: a block is scored only where what rare
   terms have given plus the largest weights could still enter a text's nearest K, so the result is exact. Ties go to the
   example whose text has the smaller digest; doc_ids play no part.
5. Neighbours vote with weight 1 / (1.02 - cosine); a logistic curve fitted on leave-one-out votes of the examples, which
   are found by the tasks, makes the vote a probability. A text without any term gets the weighted share of toxic rows.

Defined results: null and empty texts have no term. With no labels the score is 0.25. Several labels of a document count
as their largest; null labels are left out. Rows with a null doc_id are scored, never learned from, and not held out.
Repeated rows get the same score. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeline.llm.common import Scratch, release_memory, shuffle_width, table, text_key, texts

EXAMPLES, RATIO, CHI2, LEAST_ROWS, LIFT = 1000, 3.0, 25.0, 5, 16.0
BEGINNINGS = (4, 5, 6)
BLOCK, K = 32, 16
#: Share of the examples from which on a term's postings are kept as rows of its blocks.
FREQUENT = 0.06
HELD_OUT = 5
#: Bytes that end a word: ASCII other than letters and digits.
_BREAKS = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
#: Cosines are compared in steps of 1e-12, so equal ones that were summed in another order tie.
STEP, RANKS = 1e-12, 1 << 16
#: Terms whose counts travel in one row.
PART = 8192


def term_counts(text: str) -> Counter:
    return Counter(text.lower().encode("utf-8", "surrogatepass").translate(_BREAKS).split())


class Beginnings:
    """Beginnings of words that are terms, written with a mark that no word has."""

    def __init__(self, chosen: list[bytes]):
        self.chosen, self.heads = set(chosen), {m[: BEGINNINGS[0]] for m in chosen}

    @staticmethod
    def of(word: bytes) -> list[bytes]:
        return [word[:n] + b"*" for n in BEGINNINGS if len(word) > n]

    def add(self, counts: Counter) -> Counter:
        """Counts of words with those of the chosen beginnings added."""
        if self.heads:
            n, heads = BEGINNINGS[0], self.heads
            for w in [w for w in counts if w[:n] in heads]:
                for m in self.of(w):
                    if m in self.chosen:
                        counts[m] += counts[w]
        return counts


def _remainder(doc_id: str):
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(HELD_OUT))


def examples(docs: DataFrame, labels: DataFrame, most: int = EXAMPLES) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, toxic, text, same) of the examples, and how many labelled rows there are of each class."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(_remainder("doc_id") != 0)
    sizes = {int(r["toxic"]): int(r["count"]) for r in known.groupBy("toxic").count().collect()}
    by_hash = known.withColumn("h", F.xxhash64("doc_id"))
    chosen = None
    for label in (0, 1):
        part = by_hash.where(F.col("toxic") == label).orderBy("h", "doc_id").limit(most).select("doc_id", "toxic")
        chosen = part if chosen is None else chosen.unionByName(part)
    # At most 2 * most ids: a bounded broadcast, so the texts are not shuffled.
    return texts(docs).join(F.broadcast(chosen), "doc_id").withColumn("same", F.sha2(F.col("text").cast("binary"), 256)), sizes


def _vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Examples' distinct words and how often they occur."""
    for pdf in batches:
        found = [term_counts(t) for t in pdf["text"]]
        yield pdf[["doc_id", "toxic", "same"]].assign(word=[list(c) for c in found], tf=[list(c.values()) for c in found])


def document_frequencies(docs: DataFrame, terms: list[bytes], beginnings: Beginnings, most: int = 300_000) -> tuple[np.ndarray, int]:
    """In how many rows each term occurs, and the number of rows. Tasks send sums, a few rows each."""
    spark = docs.sparkSession
    ids = spark.sparkContext.broadcast({w: k for k, w in enumerate(terms)})
    size = len(terms)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, seen, n = np.zeros(size, np.int64), Counter(), 0

        def fold() -> None:
            at = np.fromiter((ids.value.get(w, -1) for w in seen), np.int64, len(seen))
            c = np.fromiter(seen.values(), np.int64, len(seen))
            total[at[at >= 0]] += c[at >= 0]
            seen.clear()

        for pdf in batches:
            n += len(pdf)
            for t in pdf["text"]:
                words = set(t.lower().encode("utf-8", "surrogatepass").translate(_BREAKS).split())
                if beginnings.heads:
                    words |= {m for w in words if w[: BEGINNINGS[0]] in beginnings.heads for m in beginnings.of(w) if m in beginnings.chosen}
                seen.update(words)
                if len(seen) > most:
                    fold()
        fold()
        parts = [total[a : a + PART] for a in range(0, size, PART)]
        yield pd.DataFrame({"part": np.arange(-1, len(parts)), "n": [np.array([n]), *parts]})
        release_memory()

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got: dict[int, np.ndarray] = {}
        for pdf in batches:
            for k, n in zip(pdf["part"], pdf["n"]):
                got[k] = got[k] + n if k in got else np.array(n)
        if got:
            yield pd.DataFrame({"part": list(got), "n": list(got.values())})

    kind = "part int, n array<long>"
    sums = texts(docs).select("text").mapInPandas(count, kind).repartition(shuffle_width(spark), "part").mapInPandas(add, kind)
    out, rows = np.zeros(size), 0
    for r in sums.collect():  # a number for each word of the examples
        if r["part"] < 0:
            rows = r["n"][0]
        else:
            out[r["part"] * PART : r["part"] * PART + len(r["n"])] = r["n"]
    return out, rows


def tells_apart(a: np.ndarray, b: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Whether a term of `a` among n1 toxic and `b` among n0 clean examples differs between the classes."""
    if not n0 or not n1:
        return np.zeros(len(a), bool)
    ratio = (a + 0.5) / (n1 + 1) / ((b + 0.5) / (n0 + 1))
    off = a * (n0 - b) - b * (n1 - a)
    chi = off * off * (n1 + n0) / (np.maximum(a + b, 1) * np.maximum(n1 + n0 - a - b, 1) * float(n1 * n0))
    return (a + b >= LEAST_ROWS) & (chi >= CHI2) & ((ratio >= RATIO) | (ratio <= 1 / RATIO))


def choose_terms(words: list[set[bytes]], labels: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """All words of the examples and the beginnings that tell the classes apart, sorted; and which terms do so."""
    seen = (Counter(), Counter())
    for w, y in zip(words, labels.tolist()):
        seen[y].update(w)
        seen[y].update({m for x in w for m in Beginnings.of(x)})
    every = sorted(seen[0].keys() | seen[1].keys())
    b, a = (np.fromiter(map(c.__getitem__, every), float, len(every)) for c in seen)
    apart = tells_apart(a, b, int((labels == 1).sum()), int((labels == 0).sum()))
    keep = np.array([x or not w.endswith(b"*") for w, x in zip(every, apart)], bool)
    return [w for w, k in zip(every, keep) if k], apart[keep]


class BlockMaxIndex:
    """Unit TF-IDF vectors of examples: full postings of rare terms, postings of frequent terms by block.

    vectors: (term ids, counts) by example; weights: of each term. Examples are named by their place in the list.
    """

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray, *, block: int = BLOCK, frequent: float = FREQUENT):
        n, size = len(vectors), len(weights)
        if n >= RANKS:
            raise ValueError(f"more than {RANKS} examples")
        self.weights, self.block = weights, block
        units = [self.unit(t, f) for t, f in vectors]
        count = np.bincount(np.concatenate([np.zeros(0, np.int64), *(t for t, _ in units)]), minlength=size)
        # Alike ones together: by their most common term, then by their heaviest.
        common = [int(t[count[t].argmax()]) if len(t) else -1 for t, _ in units]
        heavy = [int(t[v.argmax()]) if len(t) else -1 for t, v in units]
        order = np.lexsort((np.array(heavy, np.int64), np.array(common, np.int64)))
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        self.blocks = max(1, -(-n // block))
        self.places = self.blocks * block
        self.example = np.append(order, np.zeros(self.places - n, np.int64))
        row = np.repeat(place, [len(t) for t, _ in units]).astype(np.int32)
        term = np.concatenate([np.zeros(0, np.int64), *(t for t, _ in units)])
        value = np.concatenate([np.zeros(0), *(v for _, v in units)])
        often = np.flatnonzero(count > frequent * n)
        self.column = np.full(size, -1, np.int64)
        self.column[often] = np.arange(len(often))
        dense = self.column[term] >= 0
        rows = np.zeros((self.places, len(often)))
        rows[row[dense], self.column[term[dense]]] = value[dense]
        #: By block: the rows of frequent terms, and each term's largest weight.
        self.rows = rows.reshape(self.blocks, block, len(often))
        self.most = np.ascontiguousarray(self.rows.max(axis=1).T)
        term, row, value = term[~dense], row[~dense], value[~dense]
        by = np.lexsort((row, term))
        self.row, self.value = row[by], value[by]
        self.start = np.searchsorted(term[by], np.arange(size + 1))

    def unit(self, term: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        v = (1 + np.log(np.maximum(tf, 1))) * self.weights[term]
        n = np.linalg.norm(v)
        return term, v / n if n else v

    def nearest(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int = K, skip: np.ndarray | None = None, most: int = 1 << 20) -> np.ndarray:
        """Of each vector the k nearest examples with a positive cosine, as cosine steps * RANKS + (RANKS - 1 - example),
        0 for none, in falling order. At most about `most` postings or places are worked at a time."""
        out = np.zeros((len(vectors), k), np.int64)
        cost = np.array([int((self.start[t + 1] - self.start[t]).sum()) + self.places for t, _ in vectors], np.int64)
        at = 0
        while at < len(vectors):
            end = max(at + 1, at + int(np.searchsorted(np.cumsum(cost[at:]), most, side="right")))
            out[at:end] = self._nearest(vectors[at:end], k, None if skip is None else skip[at:end])
            at = end
        return -np.sort(-out, axis=1)

    def _nearest(self, vectors, k: int, skip) -> np.ndarray:
        n = len(vectors)
        q = np.repeat(np.arange(n), [len(t) for t, _ in vectors])
        term = np.concatenate([np.zeros(0, np.int64), *(t for t, _ in vectors)])
        w = np.concatenate([np.zeros(0), *(self.unit(t, f)[1] for t, f in vectors)])
        col = self.column[term]
        often = col >= 0
        heads = np.zeros((n, self.most.shape[0]))
        heads[q[often], col[often]] = w[often]
        q, term, w = q[~often], term[~often], w[~often]
        first, size = self.start[term], self.start[term + 1] - self.start[term]
        post = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
        given = np.bincount(np.repeat(q, size) * self.places + self.row[post], weights=np.repeat(w, size) * self.value[post], minlength=n * self.places)
        given = given.reshape(n, self.blocks, self.block)
        bound = heads @ self.most + given.max(axis=2)
        best = np.zeros((n, k), np.int64)
        last = np.zeros(n)  # the k-th cosine so far
        todo = bound > 0
        # Each text's most promising block sets a bar, then blocks are swept, the most promising first.
        top = bound.argmax(axis=1)
        for sweep in (0, 1):
            for b in np.unique(top).tolist() if sweep == 0 else np.argsort(-bound.sum(axis=0), kind="stable").tolist():
                live = np.flatnonzero(todo[:, b] & (top == b if sweep == 0 else bound[:, b] >= last - 4 * STEP))
                if not len(live):
                    continue
                todo[live, b] = False
                cos = heads[live] @ self.rows[b].T + given[live, b]
                who = self.example[b * self.block : (b + 1) * self.block]
                key = np.rint(cos / STEP).astype(np.int64) * RANKS + (RANKS - 1 - who)
                key[cos < STEP] = 0
                if skip is not None:
                    key[skip[live][:, None] == who[None, :]] = 0
                both = np.concatenate([best[live], key], axis=1)
                best[live] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
                last[live] = (best[live].min(axis=1) // RANKS) * STEP
        return best


def fit_curve(x: np.ndarray, y: np.ndarray, w: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Weighted logistic regression of y on x by Newton's method with a small ridge."""
    a, b = 4.0, -2.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([(w * (y - p) * x).sum() - 0.1 * a, (w * (y - p)).sum() - 0.1 * b])
        s = w * p * (1 - p)
        h = np.array([[(s * x * x).sum() + 0.1, (s * x).sum()], [(s * x).sum(), s.sum() + 0.1]])
        step = np.linalg.solve(h, g)
        a, b = a + float(np.clip(step[0], -2, 2)), b + float(np.clip(step[1], -2, 2))
    return a, b


class Judge:
    """Terms, index, labels and curve: what a task needs to score texts.

    found: doc_id, same, toxic and counts of the examples' words; weights: of each term.
    """

    def __init__(self, terms: list[bytes], beginnings: Beginnings, weights: np.ndarray, found: pd.DataFrame, sizes: dict[int, int]):
        self.ids, self.beginnings = {w: k for k, w in enumerate(terms)}, beginnings
        vectors = [self.vector(c) for c in found["counts"]]
        self.labels = found["toxic"].to_numpy(np.int64)
        self.doc_ids = found["doc_id"].to_numpy(np.int64)
        self.places = {x: k for k, x in enumerate(zip(found["same"], found["toxic"]))}
        n = np.array([max(1, (self.labels == k).sum()) for k in (0, 1)], float)
        share = np.array([sizes.get(0, 0), sizes.get(1, 0)], float) / n
        self.votes = share[self.labels] if len(found) else np.zeros(0)
        self.blank = float((self.votes * self.labels).sum() + 0.5) / float(self.votes.sum() + 2)
        self.index = BlockMaxIndex(vectors, weights) if len(found) else None
        self.curve = (4.0, -2.0)

    def vector(self, words: Counter) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the terms in a text, rising, and how often they occur."""
        counts = self.beginnings.add(Counter(words))
        at = np.fromiter(map(self.ids.get, counts, repeat(-1)), np.int64, len(counts))
        tf = np.fromiter(counts.values(), np.int64, len(counts))
        keep = np.flatnonzero(at >= 0)
        keep = keep[np.argsort(at[keep])]
        return at[keep], tf[keep]

    def neighbours(self, counts: list[Counter], skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(vote, examples, cosines) of each text; nan where no example has a word of it, -1 and 0 for none."""
        vectors = [self.vector(c) for c in counts]
        best = self.index.nearest(vectors, skip=skip)
        cos = (best // RANKS) * STEP
        who = np.where(best > 0, RANKS - 1 - best % RANKS, -1)
        w = np.where(best > 0, self.votes[who] / (1.02 - np.minimum(cos, 1)), 0)
        total = w.sum(axis=1)
        vote = np.where(total > 0, (w * self.labels[who]).sum(axis=1) / np.where(total > 0, total, 1), np.nan)
        return vote, who, cos

    def score(self, texts_: list[str]) -> tuple[np.ndarray, list[list[int]], list[list[float]]]:
        """(probability, examples' doc_ids, cosines) of each text."""
        if self.index is None:
            return np.full(len(texts_), 0.25), [[] for _ in texts_], [[] for _ in texts_]
        same: dict[str, int] = {}
        at = [same.setdefault(t, len(same)) for t in texts_]
        vote, who, cos = self.neighbours([term_counts(t) for t in same])
        p = 1 / (1 + np.exp(-(self.curve[0] * vote + self.curve[1])))
        p = np.where(np.isnan(vote), self.blank, p)[at]
        size = (who >= 0).sum(axis=1)
        ids = [self.doc_ids[w[:n]].tolist() for w, n in zip(who, size)]
        near = [c[:n].tolist() for c, n in zip(cos, size)]
        return p, [ids[k] for k in at], [near[k] for k in at]


def _counter(words, tf) -> Counter:
    return Counter(dict(zip(map(bytes, words), np.asarray(tf).tolist())))


def indexed(docs: DataFrame, found: pd.DataFrame, sizes: dict[int, int]) -> Judge:
    """The index over examples (doc_id, same, toxic, counts of words), weights counted over docs."""
    terms, apart = choose_terms([set(c) for c in found["counts"]], found["toxic"].to_numpy(np.int64))
    beginnings = Beginnings([t for t in terms if t.endswith(b"*")])
    df, rows = document_frequencies(docs, terms, beginnings)
    weights = (np.log((rows + 1) / (df + 1)) + 1) * np.where(apart, LIFT, 1.0)
    return Judge(terms, beginnings, weights, found, sizes)


def trained(spark: SparkSession, docs: DataFrame, labels: DataFrame, scratch: Scratch) -> Judge:
    """The index over the examples, with its curve."""
    sample, sizes = examples(docs, labels)
    kind = "doc_id long, toxic int, same string, word array<binary>, tf array<int>"
    kept = scratch.keep(sample.mapInPandas(_vectors, kind), "examples")
    # At most 2 * EXAMPLES rows; of equal ones the smallest doc_id is named as evidence, and the digest gives the order.
    found = kept.toPandas().sort_values(["same", "toxic", "doc_id"]).drop_duplicates(["same", "toxic"], ignore_index=True)
    found["counts"] = [_counter(w, n) for w, n in zip(found["word"], found["tf"])]
    judge = indexed(docs, found.drop(columns=["word", "tf"]), sizes)
    if judge.index is None:
        return judge
    shared = spark.sparkContext.broadcast(judge)

    def votes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at = np.array([shared.value.places[x] for x in zip(pdf["same"], pdf["toxic"])], np.int64)
            vote, _, _ = shared.value.neighbours([_counter(w, n) for w, n in zip(pdf["word"], pdf["tf"])], skip=at)
            yield pd.DataFrame({"at": at, "vote": vote})

    spread = kept.repartition(max(1, min(shuffle_width(spark), len(found) // 64)))
    got = spread.mapInPandas(votes, "at long, vote double").where("NOT isnan(vote)").distinct().orderBy("at").toPandas()
    if len(got):
        at = got["at"].to_numpy()
        judge.curve = fit_curve(got["vote"].to_numpy(), judge.labels[at].astype(float), judge.votes[at])
    shared.unpersist()
    return judge


def score_documents(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted, evidence (nearest examples' doc_ids), their cosines, and text_key."""
    judge = trained(spark, docs, labels, Scratch(spark, "toxic"))
    shared = spark.sparkContext.broadcast(judge)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            score, ids, cos = shared.value.score(pdf["text"].tolist())
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "score": score, "predicted": (score >= 0.5).astype("int32"), "evidence": ids, "cosines": cos, "text_key": pdf["text_key"]})
        release_memory()

    out = texts(docs).withColumn("text_key", text_key()).mapInPandas(run, "doc_id long, score double, predicted int, evidence array<long>, cosines array<double>, text_key long")
    return out.select("doc_id", F.coalesce(_remainder("doc_id") == 0, F.lit(False)).alias("held_out"), "score", "predicted", "evidence", "cosines", "text_key")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("text_key")
