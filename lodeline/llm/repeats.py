"""Removal of repeated passages: every byte covered by a string of `size` bytes that also starts earlier in the corpus.

1. Anchors. Each window of `size` bytes is dealt to its anchor (see anchors.py); equal windows have equal anchors. A
   segment is the windows of one anchor. Segments whose anchor stands nowhere else hold no repeat. Of equal segments of
   one anchor the first stays and the windows of the others are repeats. Only hashes travel here.
2. What is left are anchors with different segments, whose windows may agree in part. Their bytes, a fifth of the text
   or less, are dealt by anchor to shards, and each shard is sorted by external induced sorting (see induced.py), which
   gives its suffixes in order with common prefixes up to `size`: of a run of windows that agree on `size` bytes all
   but the first in corpus order are repeats. A shard's segments come in corpus order from Spark's own external sort, so a
   window's place in the shard's text is its rank; tuples go to files in the shared folder beyond `memory` rows, and the
   text, marks, seeds and scan of a shard whose arrays exceed `arrays` bytes are kept in pages that go there too. No shard
   is ever held whole.
   An anchor whose segments hold more than a shard's bytes is not sorted: a 128-bit hash of each of its windows travels
   in place of bytes, and all windows of a hash but the first are repeats. No task gathers such an anchor.
3. Repeats become runs of bytes per document; a document's bytes less its runs is what is kept.

Segment hashes have 64 bits twice (anchor and segment), hashes of hot anchors' windows 128; the suffix order compares
bytes. The order of strings is that of
(doc_id, start), on the input. Matches never cross documents.

Defined results: a null text is empty; texts shorter than `size` lose nothing and are no source of repeats. A document is
known by doc_id and its text's 64-bit key, so of two texts under one doc_id each is judged by its own bytes, the one with
the smaller key first; a row repeated as a whole is kept as it is (and not its own repeat). Rows with a null doc_id are
left as they are. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeline.llm.anchors import segments
from lodeline.llm.common import Scratch, release_memory, shuffle_width, table, text_key, texts, with_group
from lodeline.llm.induced import ARRAYS, BASE, MEMORY, Arrays, Spill, repeated
from lodeline.llm.shingles import mix

SIZE, GRAM = 100, 32
#: Between segments in a shard's text; no byte of UTF-8.
FENCE = 255
#: Bytes of an anchor's segments up to which it is sorted, and half of them a shard's bytes on average: a sort holds some
#: 45 bytes a byte of text, and each core of an executor has one.
SHARD_BYTES = 2 << 20


def _anchored(size: int, gram: int):
    """Segments of each document; of equal segments of a batch only the first travels, the others are repeats at once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cols: list[list[np.ndarray]] = [[], [], [], [], [], []]
            for doc, key, text in zip(pdf["doc_id"], pdf["key"], pdf["text"]):
                first, count, h, g = segments(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), size, gram)
                for c, x in zip(cols, (h.view(np.int64), g.view(np.int64), np.full(len(first), doc, np.int64), np.full(len(first), key, np.int64), first, count)):
                    c.append(x)
            h, g, doc, key, start, n = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in cols)
            by = np.lexsort((start, key, doc, g, h))
            h, g, doc, key, start, n = (x[by] for x in (h, g, doc, key, start, n))
            again = np.zeros(len(h), bool)
            again[1:] = (h[1:] == h[:-1]) & (g[1:] == g[:-1])
            same = np.zeros(len(h), bool)  # the same row twice
            same[1:] = again[1:] & (doc[1:] == doc[:-1]) & (key[1:] == key[:-1]) & (start[1:] == start[:-1])
            # Rows that are repeats already (done) are spread by their place: an anchor may have very many.
            spread = mix(key.view(np.uint64) + doc.view(np.uint64) * np.uint64(1 << 20) + start.view(np.uint64)).view(np.int64)
            yield pd.DataFrame({"done": again, "h": np.where(again, spread, h), "g": g, "doc": doc, "key": key, "start": start, "n": n.astype(np.int32)})[~same]
        release_memory()

    return run


def _told_apart():
    """Rows sorted by (h, g, doc, key, start): runs of repeats (kind 0), and first segments of anchors with others (kind 1)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tail: pd.DataFrame | None = None
        last = None  # (h, g, doc, key, start) of the row before, and whether its anchor has had two segments
        several = False
        for pdf in batches:
            if pdf["done"].any():
                yield pdf.loc[pdf["done"], ["h", "doc", "key", "start", "n"]].assign(kind=0)[["kind", "h", "doc", "key", "start", "n"]]
                pdf = pdf[~pdf["done"]]
            if not len(pdf):
                continue
            h, g, doc, key, start, n = (pdf[c].to_numpy() for c in ("h", "g", "doc", "key", "start", "n"))
            m = len(h)
            new_h, new_g, same = np.ones(m, bool), np.ones(m, bool), np.zeros(m, bool)
            new_h[1:] = h[1:] != h[:-1]
            new_g[1:] = new_h[1:] | (g[1:] != g[:-1])
            same[1:] = ~new_g[1:] & (doc[1:] == doc[:-1]) & (key[1:] == key[:-1]) & (start[1:] == start[:-1])
            if last is not None:
                new_h[0] = h[0] != last[0]
                new_g[0] = new_h[0] or g[0] != last[1]
                same[0] = not new_g[0] and (doc[0], key[0], start[0]) == last[2:]
            part = np.cumsum(new_h)  # 0: the anchor that is open from the batch before
            firsts = np.bincount(part[new_g], minlength=part[-1] + 1)
            # An open anchor's first segment waits in `tail` until a second one is seen.
            had = 1 if last is not None else 0
            many = firsts > 1
            many[0] = several or (had and firsts[0] > 0)
            out = []
            if tail is not None and many[0]:
                out.append(tail)
                tail = None
            need = new_g & many[part]
            out.append(pd.DataFrame({"kind": 1, "h": h[need], "doc": doc[need], "key": key[need], "start": start[need], "n": n[need]}))
            dup = ~new_g & ~same
            out.append(pd.DataFrame({"kind": 0, "h": h[dup], "doc": doc[dup], "key": key[dup], "start": start[dup], "n": n[dup]}))
            yield pd.concat(out, ignore_index=True)
            if part[-1] > 0:
                tail = None
                several = bool(many[-1])
                if not several:
                    k = int(np.flatnonzero(new_h)[-1])
                    tail = pd.DataFrame({"kind": [1], "h": [h[k]], "doc": [doc[k]], "key": [key[k]], "start": [start[k]], "n": [n[k]]})
            else:
                several = bool(many[0])
            last = (h[-1], g[-1], doc[-1], key[-1], start[-1])
        release_memory()

    return run


def _cut(size: int):
    """Documents with their wanted segments to the segments' bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, key, text, want in zip(pdf["doc_id"], pdf["key"], pdf["text"], pdf["want"]):
                data = text.encode("utf-8", "surrogatepass")
                for w in want:
                    h, start, n = w["h"], w["start"], w["n"]
                    out.append((h, doc, key, start, n, data[start : start + n - 1 + size]))
            yield pd.DataFrame(out, columns=["h", "doc", "key", "start", "n", "bytes"])
        release_memory()

    return run


#: Windows of hot anchors that a batch has at most.
BATCH_WINDOWS = 100_000


def _window_hashes(size: int):
    """Segments of hot anchors, with their bytes, to a hash and the place of each window."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kinds = {"w": object, "doc": "int64", "key": "int64", "start": "int64"}
        for pdf in batches:
            out = []
            for doc, key, start, n, data in zip(pdf["doc"], pdf["key"], pdf["start"], pdf["n"], pdf["bytes"]):
                for k in range(n):
                    out.append((hashlib.blake2b(data[k : k + size], digest_size=16).digest(), doc, key, start + k))
                    if len(out) == BATCH_WINDOWS:
                        yield pd.DataFrame(out, columns=list(kinds)).astype(kinds)
                        out = []
            yield pd.DataFrame(out, columns=list(kinds)).astype(kinds)
        release_memory()

    return run


class _Shard:
    """A shard's text with a mark on each window's position, and its segments (doc, key, start, n), as they come."""

    def __init__(self, spill: Spill, arrays: int):
        self.spill, self.arrays, self.last = spill, arrays, None
        self._new(Arrays(spill, arrays, 0))

    def _new(self, room: Arrays) -> None:
        self.room, self.text, self.counts = room, room.new(np.uint8), room.new(np.uint8)
        self.segments = [room.new(np.int64) for _ in range(4)]

    def add(self, pdf: pd.DataFrame, size: int) -> None:
        cols = [pdf[c].to_numpy().astype(np.int64) for c in ("doc", "key", "start", "n")]
        place = np.stack(cols[:3])
        again = np.zeros(len(pdf), bool)
        again[1:] = (place[:, 1:] == place[:, :-1]).all(axis=0)
        again[0] = self.last is not None and (place[:, 0] == self.last).all()
        self.last = place[:, -1]
        keep = np.flatnonzero(~again)
        cols = [c[keep] for c in cols]
        fence = bytes([FENCE])
        text = np.frombuffer(b"".join(x + fence for x in pdf["bytes"].iloc[keep]), np.uint8)
        n = cols[3]
        marks = np.repeat(np.tile(np.array([1, 0], np.uint8), len(n)), np.stack([n, np.full(len(n), size)], axis=1).ravel())
        for to, x in zip((self.text, self.counts, *self.segments), (text, marks, *cols)):
            to.append(x)
        if self.room.pool is None and 12 * len(self.text) > self.arrays:
            self._to_pages()

    def _to_pages(self, step: int = 1 << 16) -> None:
        old = (self.text, self.counts, *self.segments)
        self._new(Arrays(self.spill, self.arrays // 2, 1 << 62))
        for a, b in zip(old, (self.text, self.counts, *self.segments)):
            for k in range(0, len(a), step):
                b.append(a.part(k, k + step))

    def runs(self, marks, size: int, step: int = 1 << 14) -> Iterator[pd.DataFrame]:
        """Marked windows as runs (doc, key, start, n), some segments at a time."""
        at = 0
        for k in range(0, len(self.segments[0]), step):
            doc, key, start, n = (c.part(k, k + step) for c in self.segments)
            length = n + size
            total = int(length.sum())
            hit = np.flatnonzero(marks.part(at, at + total))
            at += total
            seg = np.searchsorted(np.cumsum(length), hit, side="right")
            s = start[seg] + hit - (np.cumsum(length) - length)[seg]
            edge = np.append(True, (seg[1:] != seg[:-1]) | (s[1:] != s[:-1] + 1)) if len(s) else np.zeros(0, bool)
            first = np.flatnonzero(edge)
            count = np.diff(np.append(first, len(s)))
            yield pd.DataFrame({"doc": doc[seg[first]], "key": key[seg[first]], "start": s[first], "n": count.astype(np.int32)})


def _sorted_shard(size: int, folder: str, options: dict):
    """One shard, a partition in corpus order: the windows that repeat, as runs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        spill = Spill(folder)
        try:
            shard = _Shard(spill, options["arrays"])
            for pdf in batches:
                if len(pdf):
                    shard.add(pdf, size)
            if len(shard.text):
                yield from shard.runs(repeated(shard.text, shard.counts, size, spill, **options), size)
        finally:
            spill.clear()
        release_memory()

    return run


def _runs(size: int, spans) -> tuple[np.ndarray, np.ndarray]:
    """Windows (start, n) of a document to maximal runs of bytes."""
    if spans is None or not len(spans):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a = np.array([s["start"] for s in spans], np.int64)
    b = a + np.array([s["n"] for s in spans], np.int64) - 1 + size
    by = np.argsort(a, kind="stable")
    a, b = a[by], np.maximum.accumulate(b[by])
    new = np.append(True, a[1:] > b[:-1])
    first = np.flatnonzero(new)
    return a[first], b[np.append(first[1:], len(a)) - 1]


def repeat_spans(spark: SparkSession, docs: DataFrame, *, size: int = SIZE, gram: int = GRAM, memory: int = MEMORY, base: int = BASE, arrays: int = ARRAYS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, key, spans): the repeated windows of each document that has any, as (first window, windows).

    memory, base, arrays: what a sort holds in memory, see induced.py; shard_bytes: twice the bytes of a shard on average.
    """
    scratch = Scratch(spark, "repeats")
    width = shuffle_width(spark)
    rows = texts(docs).where("doc_id IS NOT NULL").withColumn("key", text_key())
    found = rows.mapInPandas(_anchored(size, gram), "done boolean, h long, g long, doc long, key long, start long, n int")
    found = found.repartition(width, "h").sortWithinPartitions("done", "h", "g", "doc", "key", "start")
    told = found.mapInPandas(_told_apart(), "kind int, h long, doc long, key long, start long, n int")
    told = scratch.keep(told, "told")
    need = told.where("kind = 1")
    total = need.agg(F.sum(F.col("n").cast("long") + size)).collect()[0][0] or 0
    # Fewer than total / shard_bytes anchors, a number each.
    hot = need.groupBy("h").agg(F.sum(F.col("n").cast("long") + size).alias("b")).where(F.col("b") > shard_bytes).select("h")
    hot = scratch.keep(hot, "hot")
    any_hot = not hot.isEmpty()

    # Texts are shuffled once for all wanted segments, hot ones too: where there are any, bytes go to a table that both
    # ways read.
    wanted = need.groupBy(F.col("doc").alias("doc_id"), "key").agg(F.collect_list(F.struct("h", "start", "n")).alias("want"))
    cut = rows.join(wanted, ["doc_id", "key"]).mapInPandas(_cut(size), "h long, doc long, key long, start long, n int, bytes binary")
    if any_hot:
        cut = scratch.keep(cut, "cut")
        hot_cut, cut = (cut.join(F.broadcast(hot), "h", how) for how in ("left_semi", "left_anti"))
    shards = max(width, -(-2 * total // shard_bytes))
    dealt = cut.repartition(int(shards), "h").sortWithinPartitions("doc", "key", "start")
    part = dealt.mapInPandas(_sorted_shard(size, scratch.path("spill"), {"memory": memory, "base": base, "arrays": arrays}), "doc long, key long, start long, n int")
    part = scratch.keep(part, "part")
    spans = told.where("kind = 0").select("doc", "key", "start", "n").unionByName(part)
    if any_hot:
        found = hot_cut.mapInPandas(_window_hashes(size), "w binary, doc long, key long, start long")
        found = scratch.keep(found, "windows").withColumn("at", F.struct("doc", "key", "start"))
        found = with_group(found, "w", "doc", [(F.min("at"), F.min, "first")])
        spans = spans.unionByName(found.where(F.col("at") != F.col("first")).select("doc", "key", "start", F.lit(1).alias("n")))
    return spans.groupBy(F.col("doc").alias("doc_id"), "key").agg(F.collect_list(F.struct("start", "n")).alias("spans"))


def _kept(size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text, spans in zip(pdf["text"], pdf["spans"]):
                data = text.encode("utf-8", "surrogatepass")
                a, b = _runs(size, spans)
                left = b"".join(data[x:y] for x, y in zip(np.append(0, b).tolist(), np.append(a, len(data)).tolist())) if len(a) else data
                out.append((len(data), len(data) - len(left), len(a), left))
            got = pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept"])
            got.insert(0, "doc_id", pdf["doc_id"].astype("Int64").values)
            yield got
        release_memory()

    return run


def without_repeats(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans and the bytes that are kept."""
    size = options.get("size", SIZE)
    spans = repeat_spans(spark, docs, **options)
    joined = texts(docs).withColumn("key", text_key()).join(spans, ["doc_id", "key"], "left")
    return joined.mapInPandas(_kept(size), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeats(spark, table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def remove_repeats(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """docs with their texts less the repeats, all columns kept and n_chars, if there, counted again.

    A character of which a byte goes goes whole. A document that loses all of its text is left out.
    """
    size = options.get("size", SIZE)
    spans = repeat_spans(spark, docs, **options).select(F.col("doc_id").alias("_repeats_id"), F.col("key").alias("_repeats_key"), F.col("spans").alias("_repeats_spans"))

    @F.pandas_udf("string")
    def rest(text: pd.Series, found: pd.Series) -> pd.Series:
        out = []
        for t, s in zip(text, found):
            if t is None or s is None:
                out.append(t)
                continue
            data = t.encode("utf-8", "surrogatepass")
            a, b = _runs(size, s)
            left = b"".join(data[x:y] for x, y in zip(np.append(0, b).tolist(), np.append(a, len(data)).tolist()))
            out.append(left.decode("utf-8", "ignore"))
        return pd.Series(out, dtype=object)

    # Else the condition below would have it run twice, by two workers side by side on each core.
    rest = rest.asNondeterministic()
    joined = docs.join(spans, (F.col("doc_id").cast("long") == F.col("_repeats_id")) & (text_key() == F.col("_repeats_key")), "left")
    joined = joined.withColumn("_repeats_text", F.when(F.col("_repeats_spans").isNotNull(), rest(F.col("text"), F.col("_repeats_spans"))).otherwise(F.col("text")))
    joined = joined.where("_repeats_spans IS NULL OR length(_repeats_text) > 0")
    new = {"text": F.col("_repeats_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("_repeats_spans").isNull(), F.col("n_chars")).otherwise(F.length("_repeats_text")).cast(docs.schema["n_chars"].dataType)
    return joined.select(*(new[c].alias(c) if c in new else F.col(c) for c in docs.columns))
