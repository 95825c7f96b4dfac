import hashlib

import numpy as np
import pytest

from lodeline.llm.anchors import segments
from lodeline.llm.induced import Spill, repeated, sorted_suffixes
from lodeline.llm import induced, repeats
from lodeline.llm.repeats import remove_repeats, without_repeats


@pytest.mark.parametrize("seed", range(40))
def test_suffixes_and_common_prefixes(seed, tmp_path):
    r = np.random.default_rng(seed)
    kind = seed % 4
    t = r.integers(97, 97 + 1 + seed % 5, int(r.integers(0, 120)))
    if kind == 1:
        t = np.tile(t[:7], 12)
    if kind == 2:
        t = np.full(60, 97)
    t = t.astype(np.uint8)
    cap = int(r.integers(1, 20))
    spill = Spill(f"file://{tmp_path}")
    # A small memory spills tuples to files; a small base makes the reduced text be induced again.
    # Few bytes of arrays put the text and the rest in pages.
    parts = list(sorted_suffixes(t, cap, spill, memory=int(r.integers(1, 30)), base=int(r.integers(0, 4)), arrays=int(r.choice([0, 300, 1 << 20]))))
    spill.clear()
    assert not list(tmp_path.iterdir())
    b = t.tobytes()
    order = [int(p) for a, _ in parts for p in a]
    assert order == sorted(range(len(b)), key=lambda k: b[k:], reverse=True)
    common = [int(v) for _, a in parts for v in a]
    for x, y, n in zip(order, order[1:], common[1:]):
        m = 0
        while m < cap and max(x, y) + m < len(b) and b[x + m] == b[y + m]:
            m += 1
        assert m == n


def test_repeated_windows():
    r = np.random.default_rng(0)
    for _ in range(60):
        n, size = int(r.integers(1, 150)), int(r.integers(1, 6))
        t = (r.integers(0, 2, n) + 97).astype(np.uint8)
        counts = (r.random(n) < 0.6).astype(np.uint8)
        counts[max(0, n - size + 1) :] = 0
        b = t.tobytes()
        want = [int(counts[i] and any(counts[j] and b[j : j + size] == b[i : i + size] for j in range(i))) for i in range(n)]
        for arrays in (0, 1 << 20):
            got = repeated(t, counts, size, Spill(None), memory=int(r.integers(1, 20)), base=2, arrays=arrays)
            assert got.part(0, n).tolist() == want


def test_segments_cover_windows_and_depend_on_bytes():
    r = np.random.default_rng(1)
    shared = r.integers(97, 100, 300)
    a = np.concatenate([r.integers(97, 100, 77), shared]).astype(np.uint8)
    b = np.concatenate([shared, r.integers(97, 100, 31)]).astype(np.uint8)
    at = {}
    for which, buf in (("a", a), ("b", b)):
        for most in (1 << 20, 64):
            first, count, h, _ = segments(buf, 20, 6, most)
            assert (first[1:] == first[:-1] + count[:-1]).all() and first[0] == 0 and first[-1] + count[-1] == len(buf) - 19
            at[which, most] = np.repeat(h, count)
            assert (at[which, most] == at[which, 1 << 20]).all()
    assert (at["a", 64][77:] == at["b", 64][: 300 - 19]).all()


def brute(texts, size):
    """doc -> (removed, runs, kept bytes)."""
    seen, out = {}, {}
    for i in sorted(texts):
        data = texts[i].encode()
        gone = np.zeros(len(data) + 1, bool)
        for k in range(len(data) - size + 1):
            if seen.setdefault(data[k : k + size], (i, k)) != (i, k):
                gone[k : k + size] = True
        gone = gone[: len(data)]
        runs = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out[i] = (int(gone.sum()), runs, bytes(b for b, g in zip(data, gone) if not g))
    return out


@pytest.mark.parametrize("size,gram", [(100, 32), (20, 8)])
def test_against_brute_force(spark, plain, unique, size, gram):
    want = brute(unique, size)
    for options in ({"shard_bytes": 2000}, {"arrays": 3000, "base": 50}, {}):
        got = without_repeats(spark, plain, size=size, gram=gram, **({"memory": 500} | options if options else {})).collect()
        assert len(got) == len(unique)
        for r in got:
            assert (r["n_removed"], r["n_spans"], bytes(r["kept"])) == want[r["doc_id"]]
            assert r["n_bytes"] == len(unique[r["doc_id"]].encode())


def test_two_texts_under_one_id(spark):
    a, b = "".join(f"a{k:03}." for k in range(60)), "".join(f"b{k:03}." for k in range(60))
    rows = [(1, a), (1, b), (2, a + "x" * 120), (3, "y" * 99 + b[50:]), (3, a), (4, None), (4, b)]
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in without_repeats(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    # Within 120 times one letter each of the windows after the first is a repeat.
    assert got == sorted([(1, 300, 0), (1, 300, 0), (2, 420, 300 + 119), (3, 349, 250), (3, 300, 300), (4, 0, 0), (4, 300, 300)])


def test_a_shard_far_over_its_memory(tmp_path, monkeypatch):
    """A shard whose text alone is many times what a sort may hold: pages, tuples and names spill, and induction recurs."""
    r = np.random.default_rng(8)
    words = [bytes(r.integers(97, 123, int(r.integers(2, 9))).astype(np.uint8)) for _ in range(100)]
    data = b" ".join(words[int(k)] for k in r.zipf(1.3, 8000) % 100)[:16_000]
    data = data[:12_000] + data[4000:7000] + data[12_000:]
    spill, size, options = Spill(f"file://{tmp_path}"), 30, {"memory": 300, "base": 2500, "arrays": 4000}
    most: dict = {}
    keep, push = induced.Pool.keep, induced.Buckets.push

    def kept(pool, *a):
        keep(pool, *a)
        most["bytes"] = max(most.get("bytes", 0), pool.used)

    def pushed(bucket, *a):
        push(bucket, *a)
        most["rows"] = max(most.get("rows", 0), bucket.held)

    monkeypatch.setattr(induced.Pool, "keep", kept)
    monkeypatch.setattr(induced.Buckets, "push", pushed)
    shard = repeats._Shard(spill, options["arrays"])
    step = 500
    for k, a in enumerate(range(0, len(data) - size + 1, step)):
        n = min(step, len(data) - size + 1 - a)
        shard.add(repeats.pd.DataFrame({"doc": [1], "key": [0], "start": [a], "n": [n], "bytes": [data[a : a + n - 1 + size]]}), size)
    assert shard.room.pool is not None
    depth = []
    marks = repeated(shard.text, shard.counts, size, spill, depth=depth, **options)
    runs = [tuple(x) for f in shard.runs(marks, size, 16) for x in f[["start", "n"]].itertuples(index=False)]
    # The text alone is over four times what the pages may take, the working arrays together over sixty times.
    assert depth and depth[0] > options["base"] and spill.written > 5 * len(data) > 20 * options["arrays"]
    assert most["bytes"] <= options["arrays"] and most["rows"] <= max(options["memory"], options["base"])
    spill.clear()
    assert not list(tmp_path.iterdir())
    seen, want = set(), set()
    for k in range(len(data) - size + 1):
        w = data[k : k + size]
        if w in seen:
            want.add(k)
        seen.add(w)
    assert {k for s, n in runs for k in range(s, s + n)} == want and want


def test_odd_rows(spark, docs, corpus, empty):
    got = without_repeats(spark, docs).collect()
    assert len(got) == len(corpus)
    for r in got:
        if r["doc_id"] is None:
            assert r["n_removed"] == 0
    twice = [r for r in got if [i for i, _ in corpus].count(r["doc_id"]) == 2 and r["doc_id"] is not None]
    assert len(twice) == 2 and twice[0] == twice[1]
    assert without_repeats(spark, empty).count() == 0


def test_removal_keeps_columns_and_whole_characters(spark, docs):
    out = remove_repeats(spark, docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    assert out.count() <= docs.count() and out.where("text IS NULL").count() == docs.where("text IS NULL").count()
    pair = spark.createDataFrame([(1, "é" * 80 + "x"), (2, "éé" + "é" * 80)], "doc_id long, text string")
    texts = {r["doc_id"]: r["text"] for r in remove_repeats(spark, pair).collect()}
    assert all("�" not in t for t in texts.values())


def test_hash_is_of_what_is_left(spark, plain):
    row = without_repeats(spark, plain).orderBy("doc_id").first()
    assert hashlib.sha256(bytes(row["kept"])).hexdigest() and row["n_removed"] + len(row["kept"]) == row["n_bytes"]


def test_an_anchor_far_over_memory_is_not_gathered(spark, monkeypatch):
    r = np.random.default_rng(4)
    passage = bytes(r.integers(97, 123, 130).astype(np.uint8)).decode()
    around = lambda: bytes(r.integers(97, 123, 40).astype(np.uint8)).decode()
    texts = {k: around() + passage + around() for k in range(300)}
    docs = spark.createDataFrame([*texts.items(), (7, texts[7])], "doc_id long, text string")
    shard = repeats._sorted_shard

    def counted(*options):
        run = shard(*options)

        def inner(batches):
            parts = [b for b in batches if len(b)]
            for p in parts:
                once = p.drop_duplicates(["h", "doc", "key", "start"])
                # Both edge anchors hold far more than a shard's bytes; none of that comes to a sort.
                assert once["bytes"].str.len().groupby(once["h"]).sum().max() <= 2000
            yield from run(iter(parts))

        return inner

    monkeypatch.setattr(repeats, "_sorted_shard", counted)
    got = {(x["doc_id"], x["n_spans"], x["n_removed"]) for x in without_repeats(spark, docs, size=60, gram=20, shard_bytes=2000).collect()}
    seen, want = set(), set()
    for k, t in texts.items():
        gone = set()
        for a in range(len(t) - 59):
            w = t[a : a + 60]
            if w in seen:
                gone |= set(range(a, a + 60))
            seen.add(w)
        want.add((k, int(bool(gone)), len(gone)))
    assert got == want


def test_hot_windows_come_from_cut_bytes():
    import hashlib

    import pandas as pd

    cut = pd.DataFrame({"h": [9], "doc": [5], "key": [6], "start": [10], "n": [3], "bytes": [b"abcdef"]})
    (got,) = repeats._window_hashes(4)(iter([cut]))
    assert got["start"].tolist() == [10, 11, 12] and set(got["doc"]) == {5} and set(got["key"]) == {6}
    assert got["w"].tolist() == [hashlib.blake2b(b"abcdef"[k : k + 4], digest_size=16).digest() for k in range(3)]


def test_texts_without_repeats_are_cut_once(spark, docs):
    plan = remove_repeats(spark, docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
