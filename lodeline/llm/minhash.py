"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

C-MinHash (Li and Li 2022): a first permutation (the mixed hash) spreads a set over a circle of 2**20 places; the second
permutation, shifted by one place per coordinate, gives every coordinate: coordinate k is the least value the second
permutation has at the set's places moved by k. A set's row of coordinates is one contiguous slice per element.

Sets that are equal are one class. Classes that agree on a band of four coordinates share a bucket; a bucket's classes
are compared on their signatures, and what agrees on far fewer coordinates than the threshold predicts (5 standard
deviations, in the last round also of a signature of 1024 coordinates) is no candidate. Candidates are confirmed on full
sets. To keep pairs few, rounds confirm each class's best
candidate among a few of each bucket and merge; the last round confirms every candidate that still joins two
components, so no candidate that could change the components is left out. Buckets over `block` classes are worked in
pairs of blocks. Chance to miss a link at the threshold: (1 - t**4)**24, 3e-6 at 0.8 and 2e-8 at 0.85.

Defined results: null and blank texts have the empty set and link with nothing. Fewer words than a shingle are one
shingle. Rows with a null doc_id link with nothing and have a null component. Classes are known by their set's 128-bit
digest, so rows that share a doc_id are judged each by its own text: every one gets the component of its own set, and all
those components' other members are kept apart or together by their own links alone. An empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeline.llm.common import Scratch, components, release_memory, salt, shuffle_width, table, text_key, texts
from lodeline.llm.shingles import mix, shingle_sets

PLACES = 1 << 20
ROWS, BANDS = 4, 24
COORDS = ROWS * BANDS
#: Coordinates of the long signature that the last round's candidates are told apart by.
LONG = 1024
#: Rounds of best candidates at most, each class against so many neighbours of a bucket; a round that joins less than
#: one in FEW classes is the last of them.
ROUNDS, NEIGHBOURS, FEW = 6, 16, 200
_SLICES = None


def _slices() -> np.ndarray:
    global _SLICES
    if _SLICES is None:
        p = np.random.default_rng(11).permutation(PLACES).astype(np.uint32)
        _SLICES = np.lib.stride_tricks.sliding_window_view(np.concatenate([p, p[:LONG]]), LONG)
    return _SLICES


def signature(shingles: np.ndarray, coords: int = COORDS) -> np.ndarray:
    """The circulant MinHash of a non-empty set of 64-bit hashes; a longer one goes on where a shorter one ends."""
    places = (mix(shingles) >> np.uint64(44)).astype(np.int64)
    table_, low = _slices()[:, :coords], np.full(coords, 2**32 - 1, np.uint32)
    step = max(64, (1 << 18) // coords)
    for a in range(0, len(places), step):
        np.minimum(low, table_[places[a : a + step]].min(axis=0), out=low)
    return low


def set_digest(shingles: np.ndarray) -> bytes:
    import hashlib

    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _signed(k: int):
    """Rows' sets: size, digest, bands and signature."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets = shingle_sets(pdf["text"].tolist(), k)
            sigs = [signature(s) if len(s) else None for s in sets]
            shorts = [None if s is None else (mix(s.astype(np.uint64)) >> np.uint64(48)).astype("<u2") for s in sigs]
            bands = [None if s is None else s.view("<i8") for s in shorts]
            short = [None if s is None else s.tobytes() for s in shorts]
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"].astype("Int64"), "text_key": pdf["text_key"], "n": [len(s) for s in sets],
                "same": [set_digest(s) if len(s) else None for s in sets], "bands": bands, "short": short,
            })
        release_memory()

    return run


def least_agreement(num: int, den: int, coords: int = COORDS) -> int:
    """Coordinates that must agree: 5 standard deviations below the mean at the threshold."""
    t = num / den
    return max(1, math.floor(t * coords - 5 * math.sqrt(coords * t * (1 - t))))


def _candidates(num: int, den: int, every: bool):
    """Rows sorted by bucket to candidates in two components: of each class the best of a few, or every one.

    Every candidate comes from the first band that both classes agree on, so it is listed once.
    """
    least, least_long = least_agreement(num, den), least_agreement(num, den, LONG)

    def fits(n, m):
        return np.minimum(n, m) * den >= np.maximum(n, m) * num

    def few(g: dict) -> tuple | None:
        """Each class against the bucket's first and the next few in signature order."""
        m = len(g["doc"])
        best, other = np.zeros(m, np.int64), np.zeros(m, np.int64)
        for s in (*range(1, min(m, NEIGHBOURS + 1)), 0):
            i = np.arange(m - s) if s else np.arange(1, m)
            j = i + s if s else np.zeros(m - 1, np.int64)
            eq = g["sig"][i] == g["sig"][j]
            w = eq.sum(axis=1)
            w[eq.reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1) != g["band"][0]] = 0
            w[(w < least) | (g["comp"][i] == g["comp"][j]) | ~fits(g["n"][i], g["n"][j])] = 0
            for p, q in ((i, j), (j, i)):
                if s or p is i:
                    up = w > best[p]
                    best[p[up]], other[p[up]] = w[up], q[up]
        i = np.flatnonzero(best)
        a, b = g["doc"][i], g["doc"][other[i]]
        return np.minimum(a, b), np.maximum(a, b), best[i]

    def rest(g: dict) -> Iterator[tuple]:
        """Classes outside the bucket's largest component against all classes, each pair once."""
        names, which = np.unique(g["comp"], return_inverse=True)
        sides = [np.flatnonzero(g["side"] == k) for k in (0, 1)]
        outside = which != np.bincount(which).argmax()
        band = g["band"][0]
        for rows, cols, once in ((sides[0], sides[0], True),) if g["same"][0] else ((sides[0][outside[sides[0]]], sides[1], False), (sides[0][~outside[sides[0]]], sides[1][outside[sides[1]]], False)):
            rows = rows[outside[rows]] if once else rows
            for k in range(0, len(rows), 64):
                r = rows[k : k + 64]
                ok = fits(g["n"][r][:, None], g["n"][cols][None, :]) & (which[r][:, None] != which[cols][None, :])
                if once:  # of two outside classes the later one brings the pair
                    ok &= ~outside[cols][None, :] | (cols[None, :] < r[:, None])
                i, j = np.nonzero(ok)
                for c in range(0, len(i), 1 << 14):
                    x, y = r[i[c : c + (1 << 14)]], cols[j[c : c + (1 << 14)]]
                    eq = g["sig"][x] == g["sig"][y]
                    keep = eq.sum(axis=1) >= least
                    keep &= eq.reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1) == band
                    x, y = x[keep], y[keep]
                    keep = (g["long"][x] == g["long"][y]).sum(axis=1) >= least_long
                    a, b = g["doc"][x[keep]], g["doc"][y[keep]]
                    yield np.minimum(a, b), np.maximum(a, b), np.zeros(len(a), np.int64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None

        def groups(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
            cols = {c: pdf[c].to_numpy() for c in ("band", "key", "x", "y", "side", "doc", "comp", "n")}
            cols["same"] = cols["x"] == cols["y"]
            cols["sig"] = np.frombuffer(b"".join(pdf["short"]), "<u2").reshape(-1, COORDS)
            if every:
                cols["long"] = np.frombuffer(b"".join(pdf["long"]), np.uint8).reshape(-1, LONG)
            edge = np.zeros(len(pdf), bool)
            edge[0] = True
            for c in ("band", "key", "x", "y"):
                edge[1:] |= np.diff(cols[c]) != 0
            at = np.flatnonzero(edge)
            found, n = [], 0
            # A group of one component has nothing to find.
            mixed = np.maximum.reduceat(cols["comp"], at) != np.minimum.reduceat(cols["comp"], at)
            for a, b in zip(at[mixed].tolist(), np.append(at[1:], len(pdf))[mixed].tolist()):
                g = {k: v[a:b] for k, v in cols.items()}
                for got in rest(g) if every else [few(g)] if g["same"][0] else []:
                    found.append(got)
                    n += len(got[0])
                    if n > 100_000:
                        yield frame(found)
                        found, n = [], 0
            if found:
                yield frame(found)

        def frame(found) -> pd.DataFrame:
            a, b, w = (np.concatenate(x) for x in zip(*found))
            return pd.DataFrame({"a": a, "b": b, "w": w.astype("int64")}).drop_duplicates(["a", "b"])

        names = ["band", "key", "x", "y"]
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            last = (pdf[names] == pdf[names].iloc[-1]).all(axis=1)
            cut = len(pdf) - int(last.sum())
            held = pdf.iloc[cut:].reset_index(drop=True)
            if cut:
                yield from groups(pdf.iloc[:cut])
        if held is not None and len(held):
            yield from groups(held)
        release_memory()

    return run


def _confirmed(num: int, den: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = []
            for p, q in zip(pdf["p"], pdf["q"]):
                x, y = np.frombuffer(p, "<u8"), np.frombuffer(q, "<u8")
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                n = int((both[1:] == both[:-1]).sum())
                keep.append(den * n >= num * (len(x) + len(y) - n))
            yield pdf.loc[np.array(keep, bool), ["a", "b"]]

    return run


def _bitmap(rows: DataFrame, bits: int) -> np.ndarray:
    """Bits set at the hashed ids; its size is fixed before, whatever the number of ids.

    A bitmap per task of a few, so the driver gets a few of the one fixed size, and a task has one worker.
    """

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = np.zeros(bits // 8, np.uint8)
        for pdf in batches:
            h = mix(pdf["doc"].to_numpy().astype(np.uint64)) % np.uint64(bits)
            np.bitwise_or.at(m, (h >> np.uint64(3)).astype(np.int64), np.left_shift(1, h & np.uint64(7)).astype(np.uint8))
        yield pd.DataFrame({"m": [m.tobytes()]})

    out = np.zeros(bits // 8, np.uint8)
    for r in rows.coalesce(4).mapInPandas(mark, "m binary").toLocalIterator():
        out |= np.frombuffer(bytes(r["m"]), np.uint8)
    return out


#: Most bits of the bitmap of documents whose sets are wanted (16 MB); beyond, it lets more rows pass and costs shuffle.
MOST_BITS = 1 << 27


def near_duplicates(spark: SparkSession, docs: DataFrame, *, words: int = 5, num: int = 80, den: int = 100, block: int = 2048) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept, text_key. Sets of `words` shingles link at Jaccard >= num/den."""
    scratch = Scratch(spark, "minhash")
    rows = texts(docs)
    kind = "doc_id long, text_key long, n long, same binary, bands array<long>, short binary"
    signed = scratch.keep(rows.withColumn("text_key", text_key()).mapInPandas(_signed(words), kind), "signed")
    usable = signed.where("same IS NOT NULL AND doc_id IS NOT NULL")
    # A row per class: distinct sets, each with a number of its own (`doc`) and its smallest doc_id. Numbers are written.
    one = usable.groupBy("same").agg(F.min("doc_id").alias("first")).withColumnRenamed("same", "s")
    reps = usable.join(one, (F.col("same") == F.col("s")) & (F.col("doc_id") == F.col("first"))).select("same", "first", "n", "short", "bands").dropDuplicates(["same"])
    reps = scratch.keep(reps.withColumn("doc", F.monotonically_increasing_id()), "reps")
    spread = reps.select("doc", F.posexplode("bands").alias("band", "key"))
    buckets = spread.groupBy("band", "key").agg(F.count("*").alias("m")).where("m > 1").withColumn("k", F.ceil(F.col("m") / F.lit(block)))
    inside = spread.join(buckets.select("band", "key", "k"), ["band", "key"]).withColumn("own", F.pmod(F.xxhash64("doc"), F.col("k")))
    inside = inside.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    inside = inside.select("band", "key", "doc", F.least("own", "o").alias("x"), F.greatest("own", "o").alias("y"), F.when(F.col("own") <= F.col("o"), 0).otherwise(1).alias("side"))
    members = scratch.keep(inside.join(reps.select("doc", "n", "short"), "doc"), "members")
    width = shuffle_width(spark)
    n_docs = reps.count()
    bits = min(MOST_BITS, max(1 << 16, 1 << (16 * n_docs).bit_length()))
    asked = scratch.keep(reps.select("doc", "same", "first").join(members.select("doc").distinct(), "doc", "left_semi"), "asked")
    wanted = spark.sparkContext.broadcast(_bitmap(asked.select(F.col("first").alias("doc")), bits))

    def full(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            h = mix(pdf["doc_id"].to_numpy().astype(np.uint64)) % np.uint64(bits)
            pdf = pdf[(wanted.value[(h >> np.uint64(3)).astype(np.int64)] >> (h & np.uint64(7)).astype(np.uint8) & 1).astype(bool)]
            sets = [s for s in shingle_sets(pdf["text"].tolist(), words) if len(s)]
            if sets:
                long = [(mix(signature(s, LONG).astype(np.uint64)) >> np.uint64(56)).astype(np.uint8).tobytes() for s in sets]
                yield pd.DataFrame({"s": [set_digest(s) for s in sets], "set": [s.astype("<u8").tobytes() for s in sets], "long": long})
        release_memory()

    # Equal digests are equal sets, so of several rows of a class any one gives its set.
    sets = rows.where("doc_id IS NOT NULL").mapInPandas(full, "s binary, set binary, long binary")
    sets = sets.join(asked.select("same", "doc"), F.col("s") == F.col("same")).select("doc", "set", "long")
    sets = scratch.keep(sets.dropDuplicates(["doc"]), "sets")
    n_sets = sets.count()
    edges = None
    roots = None
    step, every = 0, False
    while True:
        now = members.withColumn("comp", F.col("doc")) if roots is None else members.join(roots, F.col("doc") == F.col("node"), "left").withColumn("comp", F.coalesce("root", "doc")).drop("node", "root")
        if every:
            # Buckets that still hold two components, with the long signatures.
            open_ = now.groupBy("band", "key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("band", "key")
            now = now.join(open_, ["band", "key"]).join(sets.select("doc", "long"), "doc")
        now = now.repartition(width, "band", "key", "x", "y").sortWithinPartitions("band", "key", "x", "y", "short", "doc")
        pairs = now.mapInPandas(_candidates(num, den, every), "a long, b long, w long")
        if every:
            pairs = pairs.select("a", "b").distinct()
        else:
            # Each class keeps its best candidate over all buckets. A union of both ends would look for the pairs twice.
            ends = pairs.withColumn("me", F.explode(F.array("a", "b")))
            pairs = ends.groupBy("me").agg(F.max_by(F.struct("a", "b"), F.struct("w", -F.col("a"), -F.col("b"))).alias("p")).select("p.a", "p.b").distinct()
        p = sets.select(F.col("doc").alias("a"), F.col("set").alias("p"))
        q = sets.select(F.col("doc").alias("b"), F.col("set").alias("q"))
        pairs = scratch.keep(pairs, f"pairs{step}")
        new = scratch.keep(pairs.join(p, "a").join(q, "b").mapInPandas(_confirmed(num, den), "a long, b long"), f"links{step}")
        edges = new if edges is None else edges.unionByName(new)
        found = new.count()
        if every or found:
            roots = components(edges, scratch, f"roots{step}")
        if every:
            # What is left to do needs the signatures' table and the last roots alone.
            for name in ("members", "sets", "asked", *(f"{n}{k}" for n in ("pairs", "links") for k in range(step + 1)), *(f"roots{k}-out" for k in range(step))):
                scratch.drop(name)
            break
        step += 1
        every = step == ROUNDS or found * FEW < n_sets
    classes = reps.select("same", "first", "doc").join(roots, F.col("doc") == F.col("node"), "left").withColumn("root", F.coalesce("root", "doc"))
    smallest = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = classes.join(smallest, "root").select("same", "component_id")
    # A row per class and salt meets the classes, then the rows of that part: no task holds all rows of a large class.
    keyed = signed.withColumn("_same", F.when(F.col("doc_id").isNotNull(), F.col("same"))).withColumn("_salt", salt("doc_id")).drop("same", "bands", "short")
    parts = keyed.where("_same IS NOT NULL").select("_same", "_salt").distinct().join(classes, F.col("_same") == F.col("same")).drop("same")
    comp = F.coalesce("component_id", "doc_id")
    out = keyed.join(parts, ["_same", "_salt"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), comp.alias("component_id"), F.coalesce(comp == F.col("doc_id"), F.lit(True)).alias("kept"), "text_key")


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, table(spark, sf_dir, "documents"), words=3, num=85, den=100).drop("text_key")


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct([array_to_string(w[i:i + 2], ' ') for i in range(1, len(w) - 1)]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s),
x AS (SELECT doc_id, unnest(s) AS g FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT c.a, c.b FROM c JOIN n na ON na.doc_id = c.a JOIN n nb ON nb.doc_id = c.b WHERE 100 * k >= 85 * (na.n + nb.n - k)),
r(node, far) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.far),
m AS (SELECT node, min(far) AS root FROM r GROUP BY node)
SELECT doc_id, n AS n_shingles, root AS component_id, doc_id = root AS kept FROM n JOIN m ON doc_id = node
"""
