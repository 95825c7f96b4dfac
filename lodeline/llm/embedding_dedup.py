"""Embedding near-duplicates by spherical-cap filters from structured random product codes.

Filter directions are sums of one Gaussian codeword per block of a rotated vector (Becker, Ducas, Gama and Laarhoven
2016), so all directions that a vector exceeds the threshold on are found by list-decoding block after block with the
bound of what the remaining blocks can add. Vectors that share a filter are compared in double precision. A pair counts
in the smallest filter that both hold, so every link counts once without listing pairs. Equal vectors are one class with
a multiplicity before any of it.

The threshold follows the number of classes: a cap holds about `bucket` of them whatever their number, and the number of
filters is chosen for `common` expected common filters at the similarity asked for; the chance to miss a pair right at
the threshold is about exp(-common) (measured recall is in the README). Filters that hold more than `block` classes are
compared in pairs of blocks, so no task holds more than two blocks.

Defined results: a vector that is null, empty, zero, of another length than most, or holds null or non-finite components
links with nothing: n_links 0, its own id as component, kept. vec_ids are unique; a row repeated with its vec_id counts
as an equal vector. A null vec_id keeps a null component and links with nothing. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeline.llm.common import Forest, Scratch, components, shuffle_width, table

SEED = 20240229


def _tail(t: float) -> float:
    return 0.5 * math.erfc(t / math.sqrt(2))


def _both(t: float, cos: float, steps: int = 2000) -> float:
    """P(y > t | x > t) of two standard normals with correlation cos."""
    x = np.linspace(t, t + 8, steps)
    w = np.exp(-x * x / 2)
    rest = math.sqrt(max(1e-12, 1 - cos * cos))
    return float(np.sum(w * np.array([_tail((t - cos * v) / rest) for v in x])) / np.sum(w))


class CapFilters:
    """Directions over `blocks` blocks of a rotated vector, `size` codewords in each, for each of `turns` rotations.

    Filters of one rotation share codewords, so a vector that lies badly to it misses many at once; a second rotation
    makes that chance a square.
    """

    def __init__(self, dim: int, classes: int, cos: float, *, blocks: int = 2, turns: int = 2, bucket: int = 64, common: float = 16.0):
        share = min(0.25, bucket / max(classes, 1))
        lo, hi = 0.0, 12.0
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if _tail(mid) > share else (lo, mid)
        self.threshold = lo
        filters = common / turns / (_tail(lo) * _both(lo, cos))
        self.least = min(max(4, round(common / turns / 2)), 16)
        self.blocks = min(blocks, dim)
        self.size = max(2, math.ceil(filters ** (1 / self.blocks)))
        rng = np.random.default_rng(SEED)
        self.cuts = np.linspace(0, dim, self.blocks + 1).astype(int)
        self.turns = [
            (np.linalg.qr(rng.standard_normal((dim, dim)))[0], [rng.standard_normal((self.size, b - a)) for a, b in zip(self.cuts[:-1], self.cuts[1:])])
            for _ in range(turns)
        ]

    def decode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of every direction that a row of unit vectors exceeds the threshold on, sorted by both."""
        found = []
        for turn in self.turns:
            row, code = self._decode(unit, self.threshold, *turn)
            # A row that few directions reach lowers its own threshold, step by step; so do its neighbours.
            low, t = np.flatnonzero(np.bincount(row, minlength=len(unit)) < self.least), self.threshold
            while len(low) and t > -8:
                t -= 0.25
                r, c = self._decode(unit[low], t, *turn)
                keep = ~np.isin(row, low)
                row, code = np.concatenate([row[keep], low[r]]), np.concatenate([code[keep], c])
                low = low[np.bincount(r, minlength=len(low)) < self.least]
            found.append((row, code))
        row = np.concatenate([r for r, _ in found])
        code = np.concatenate([c + k * self.size**self.blocks for k, (_, c) in enumerate(found)])
        by = np.lexsort((code, row))
        return row[by], code[by]

    def _decode(self, unit: np.ndarray, threshold: float, rotation: np.ndarray, codes: list) -> tuple[np.ndarray, np.ndarray]:
        x = unit @ rotation
        scores = [x[:, a:b] @ c.T for (a, b), c in zip(zip(self.cuts[:-1], self.cuts[1:]), codes)]
        best = [s.max(axis=1) for s in scores]
        row, code, total = np.arange(len(unit)), np.zeros(len(unit), np.int64), np.zeros(len(unit))
        for k, s in enumerate(scores):
            rest = sum(best[k + 1 :], np.zeros(len(unit)))
            order = np.argsort(-s, axis=1)
            ranked = np.take_along_axis(s, order, axis=1)
            # How many of a row's codewords, best first, keep the bound: the partial sum plus the best of later blocks.
            need = threshold - total - rest[row]
            take = np.zeros(len(row), np.int64)
            for a in range(0, len(row), 20000):
                take[a : a + 20000] = (ranked[row[a : a + 20000]] > need[a : a + 20000, None]).sum(axis=1)
            again = np.repeat(np.arange(len(row)), take)
            nth = np.arange(len(again)) - np.repeat(np.cumsum(take) - take, take)
            r = row[again]
            total = total[again] + ranked[r, nth]
            code = code[again] * self.size + order[r, nth]
            row = r
        return row, code


def _classes(vectors: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id of the class's smallest, embedding, members) of usable vectors, and their length."""
    e = F.col("embedding")
    finite = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) != float("inf")))
    usable = F.col("vec_id").isNotNull() & e.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(e, lambda v: v != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding")).where(usable)
    lengths = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows, (lengths[0]["n"] if lengths else 0)


def unit_rows(vectors) -> np.ndarray:
    """Unit vectors in double precision."""
    x = np.stack([np.asarray(v, "float64") for v in vectors])
    # Scaled by the largest component first, so that no square under- or overflows.
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _filtered(caps: CapFilters, dim: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a in range(0, len(pdf), 512):
                part = pdf.iloc[a : a + 512]
                x = unit_rows(part["embedding"])
                row, code = caps.decode(x)
                held = np.split(code, np.cumsum(np.bincount(row, minlength=len(part)))[:-1])
                yield pd.DataFrame({"vec_id": part["vec_id"].values, "members": part["members"].values, "embedding": part["embedding"].values, "filters": held})

    return run


def _overlap(a: list[np.ndarray], b: list[np.ndarray], below: int) -> np.ndarray:
    """Boolean matrix: row i of a and row j of b share a filter smaller than `below`."""
    fa = [f[: np.searchsorted(f, below)] for f in a]
    fb = fa if b is a else [f[: np.searchsorted(f, below)] for f in b]
    names, inv = np.unique(np.concatenate([*fa, *([] if b is a else fb), np.zeros(0, np.int64)]), return_inverse=True)
    if not len(names):
        return np.zeros((len(a), len(b)), bool)

    def grid(fs, codes):
        m = np.zeros((len(fs), len(names)), np.float32)
        m[np.repeat(np.arange(len(fs)), [len(f) for f in fs]), codes] = 1
        return m

    cut = sum(map(len, fa))
    ga = grid(fa, inv[:cut])
    gb = ga if b is a else grid(fb, inv[cut:])
    return ga @ gb.T > 0


def _compare(cos: float):
    """One filter's pair of blocks: links per class and edges of a spanning forest."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        me = int(pdf["filter"].iloc[0])
        pdf = pdf.drop_duplicates(["side", "vec_id"]).sort_values("vec_id", kind="stable")
        same = pdf["same"].iloc[0]
        a = pdf[pdf["side"] == 0]
        b = a if same else pdf[pdf["side"] == 1]
        links: dict[int, int] = {}
        forest = Forest()
        if len(a) and len(b):
            fa, fb = list(a["filters"]), list(b["filters"])
            xa, xb = unit_rows(a["embedding"]), unit_rows(b["embedding"])
            ia, ib = a["vec_id"].to_numpy(), b["vec_id"].to_numpy()
            ma, mb = a["members"].to_numpy(), b["members"].to_numpy()
            got_a, got_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
            for s in range(0, len(a), 512):
                hit = xa[s : s + 512] @ xb.T >= cos
                if same:
                    hit &= np.arange(len(b))[None, :] > (s + np.arange(len(hit)))[:, None]
                rows, cols = np.flatnonzero(hit.any(axis=1)), np.flatnonzero(hit.any(axis=0))
                if not len(rows):
                    continue
                near = hit[np.ix_(rows, cols)]
                near &= ~_overlap([fa[s + r] for r in rows], [fb[c] for c in cols], me)
                got_a[s + rows] += near @ mb[cols]
                got_b[cols] += ma[s + rows] @ near
                for r, line in zip(rows, near):
                    x = int(ia[s + r])
                    for c in np.flatnonzero(line):
                        forest.join(x, int(ib[cols[c]]))
            for ids, got in ((ia, got_a), (ib, got_b)):
                for k in np.flatnonzero(got):
                    links[int(ids[k])] = links.get(int(ids[k]), 0) + int(got[k])
        out = [(x, n, forest.root(x)) for x, n in links.items()]
        return pd.DataFrame({"vec_id": np.array([o[0] for o in out], "int64"), "links": np.array([o[1] for o in out], "int64"), "root": np.array([o[2] for o in out], "int64")})

    return run


def near_vectors(spark: SparkSession, vectors: DataFrame, *, cos: float = 0.9, block: int = 2048, bucket: int = 64, common: float = 16.0) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept."""
    scratch = Scratch(spark, "caps")
    rows, dim = _classes(vectors)
    rows = rows.where(F.size("embedding") == dim)
    every = vectors.select(F.col("vec_id").cast("long").alias("vec_id"))
    keyed = scratch.keep(rows.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("members")), "classes")
    n = keyed.count()
    caps = CapFilters(max(dim, 1), n, cos, bucket=bucket, common=common)
    held = keyed.select(F.col("rep").alias("vec_id"), "members", "embedding").repartition(shuffle_width(spark), "vec_id")
    code = "int" if 2 * caps.size**caps.blocks < 2**31 else "long"
    kind = held.schema["embedding"].dataType.simpleString()
    held = held.mapInPandas(_filtered(caps, dim), f"vec_id long, members long, embedding {kind}, filters array<{code}>")
    held = scratch.keep(held, "held")
    pairs = held.select("vec_id", F.explode("filters").alias("filter"))
    counted = pairs.groupBy("filter").agg(F.count("*").alias("n")).where("n > 1")
    # A filter over the block size becomes pairs of blocks; a class goes to every pair that holds its block.
    counted = counted.withColumn("k", F.ceil(F.col("n") / F.lit(block)))
    mine = pairs.join(counted, "filter").withColumn("b", F.pmod(F.xxhash64("vec_id"), F.col("k")))
    mine = mine.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    mine = mine.select("vec_id", "filter", F.least("b", "o").alias("x"), F.greatest("b", "o").alias("y"), F.when(F.col("b") <= F.col("o"), 0).otherwise(1).alias("side"), (F.col("b") == F.col("o")).alias("same"))
    sent = mine.join(held, "vec_id")
    found = sent.groupBy("filter", "x", "y").applyInPandas(_compare(cos), "vec_id long, links long, root long")
    found = scratch.keep(found, "found")
    scratch.drop("held")
    edges = found.where("vec_id <> root").select(F.col("root").alias("a"), F.col("vec_id").alias("b"))
    joined = components(edges, scratch, "parts")
    links = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
    of = keyed.select("embedding", "rep", "members").join(links.withColumnRenamed("vec_id", "rep"), "rep", "left").join(joined.withColumnRenamed("node", "rep"), "rep", "left")
    of = of.select("embedding", "members", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "rep").alias("root"))
    mates = rows.join(of, "embedding").select("vec_id", (F.col("links") + F.col("members") - 1).alias("n_links"), "root").distinct()
    out = every.join(mates, "vec_id", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "vec_id").alias("component_id"), F.coalesce(F.col("vec_id") == F.coalesce("root", "vec_id"), F.lit(True)).alias("kept"))


def op10_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark, table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL),
u AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS z FROM v WHERE len(e) > 0 AND len([x for x in e if x IS NULL OR isnan(x) OR isinf(x)]) = 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE a.z > 0 AND b.z > 0 AND list_inner_product(a.e, b.e) / a.z / b.z >= 0.9),
r(node, far) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.far),
m AS (SELECT node, min(far) AS root FROM r GROUP BY node),
k AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, root AS component_id, vec_id = root AS kept FROM v JOIN m ON vec_id = node LEFT JOIN k ON k.a = vec_id
"""
