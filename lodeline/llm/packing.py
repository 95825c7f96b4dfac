"""Sum-of-squares online packing of documents into training windows.

Csirik, Johnson, Kenyon, Orlin, Shor and Weber, "On the sum-of-squares algorithm for bin packing": each item goes to the
fill level that minimises the sum over levels of the squared count of partially filled windows at that level. The counts
are one level array; a level's windows are a stack.

A document's whole windows are cut off first. Of the rest, what fills units of UNIT ids is an item of as many units; the
odd ids of successive documents are laid end to end and each unit they fill is an item of one. So all items are placed by
sum of squares on SIZE / UNIT levels, windows close on exact fills, and the number of open windows is bound to the levels,
not to the documents. Each task packs its own rows in order as they come, so nothing is shuffled. At a task's end what
open windows hold is placed once more, whole, largest first; what the few windows hold that are open then is cut into whole
windows and, for the last ids, windows of a power of two, which need no padding.

Defined results: a null text is the empty text, one piece with the closing id. Rows that repeat are packed each time.
A null doc_id is packed as null. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from lodeline.llm.common import release_memory, table, text_batches, texts
from lodeline.llm.word_ids import WORD_BPE, tokenizer_file, word_ids

WINDOW, UNIT = 4096, 128
CLOSE = 2
SHARD_BITS = 36


class SumOfSquares:
    """Windows of `size`, open ones by fill level. `place` gives the window an item goes to and where in it."""

    def __init__(self, size: int):
        self.size = size
        self.count = np.zeros(size + 1, np.int64)
        self.stacks: list[list] = [[] for _ in range(size + 1)]

    def level(self, need: int) -> int:
        """The fill level to place `need` ids at, 0 for a new window."""
        n, size = self.count, self.size
        # From h to h + need: N(h) falls by one, N(h + need) rises by one; level 0 and the full level do not count.
        rise = 2 * n[need : size + 1] + 1
        rise[size - need] = 0
        fall = 1 - 2 * n[: size + 1 - need]
        fall[0] = 0
        cost = rise + fall
        cost[1:][n[1 : size + 1 - need] == 0] = np.iinfo(np.int64).max
        # Ties go to the fullest level.
        return int(len(cost) - 1 - np.argmin(cost[::-1]))

    def place(self, need: int, new_window):
        h = self.level(need)
        if h:
            w = self.stacks[h].pop()
            self.count[h] -= 1
        else:
            w = new_window()
        if h + need < self.size:
            self.stacks[h + need].append(w)
            self.count[h + need] += 1
        return w, h

    def open_windows(self):
        """Open windows, fullest first."""
        for h in range(self.size - 1, 0, -1):
            for w in self.stacks[h]:
                yield w, h


def powers(n: int) -> list[int]:
    """n as powers of two, largest first."""
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


class Packer:
    """Pieces (key, start, length, ids) with the window and offset each is given.

    A piece is a tuple (key, start, length, ids); an item a list of pieces that stay together.
    """

    def __init__(self, size: int = WINDOW, first: int = 0, unit: int = UNIT):
        if size % unit:
            raise ValueError("a window is a whole number of units")
        self.size, self.unit, self.next = size, unit, first
        self.bins = SumOfSquares(size // unit)
        #: The odd ids that do not fill a unit yet.
        self.odd: list[tuple] = []
        self.n_odd = 0
        #: Ids that were cut anew at the end.
        self.recut = 0

    def window(self) -> int:
        self.next += 1
        return self.next - 1

    def _closed(self, pieces: list[tuple]) -> Iterator[tuple]:
        w, at = self.window(), 0
        for key, start, length, ids in pieces:
            yield key, start, length, ids, w, at
            at += length

    def _put(self, bins: SumOfSquares, item: list[tuple], units: int) -> Iterator[tuple]:
        held, level = bins.place(units, list)
        held += item
        if level + units == bins.size:
            yield from self._closed(held)

    def _unit(self) -> list[tuple]:
        """The first `unit` odd ids."""
        out, left = [], self.unit
        while left:
            key, start, length, ids = self.odd.pop(0)
            n = min(left, length)
            out.append((key, start, n, ids[: 4 * n]))
            if n < length:
                self.odd.insert(0, (key, start + n, length - n, ids[4 * n :]))
            left -= n
        self.n_odd -= self.unit
        return out

    def add(self, key, ids: bytes) -> Iterator[tuple]:
        """Pieces that are settled by this document: (key, start, length, ids, window, offset)."""
        total, size, unit = len(ids) // 4, self.size, self.unit
        cut = total - total % size
        for start in range(0, cut, size):
            yield key, start, size, ids[4 * start : 4 * (start + size)], self.window(), 0
        odd = total - total % unit
        if odd > cut:
            yield from self._put(self.bins, [(key, cut, odd - cut, ids[4 * cut : 4 * odd])], (odd - cut) // unit)
        if total > odd:
            self.odd.append((key, odd, total - odd, ids[4 * odd :]))
            self.n_odd += total - odd
            while self.n_odd >= unit:
                yield from self._put(self.bins, self._unit(), 1)

    def end(self) -> Iterator[tuple]:
        """What is still open."""
        again = SumOfSquares(self.bins.size)
        for held, level in list(self.bins.open_windows()):
            yield from self._put(again, held, level)
        left = [p for held, _ in again.open_windows() for p in held] + self.odd
        self.recut = total = sum(p[2] for p in left)
        sizes = [self.size] * (total // self.size) + powers(total % self.size)
        room = at = 0
        w = -1
        for key, start, length, ids in left:
            done = 0
            while done < length:
                if at == room:
                    room, at, w = sizes.pop(0), 0, self.window()
                n = min(room - at, length - done)
                yield key, start + done, n, ids[4 * done : 4 * (done + n)], w, at
                done, at = done + n, at + n


def pack(docs: DataFrame, tokenizer: str, *, size: int = WINDOW, unit: int = UNIT, close: int = CLOSE) -> DataFrame:
    """A row per piece: its document, place in it, ids' CRC-32, sequence and place there."""
    end = np.array([close], "<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table_ = word_ids(tokenizer)
        packer = Packer(size, TaskContext.get().partitionId() << SHARD_BITS, unit)

        def rows(pieces):
            return [(d, s, n, zlib.crc32(ids), total, w, at) for (d, total), s, n, ids, w, at in pieces]

        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        for pdf in batches:
            out = []
            keys = [None if pd.isna(x) else int(x) for x in pdf["doc_id"]]
            for key, ids in zip(keys, table_.ids(pdf["text"].tolist())):
                ids += end
                out += rows(packer.add((key, len(ids) // 4), ids))
            yield pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})
        yield pd.DataFrame(rows(packer.end()), columns=names).astype({"doc_id": "Int64"})
        release_memory()

    kind = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    text_batches(docs.sparkSession)
    return texts(docs).mapInPandas(run, kind)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_file(WORD_BPE))
