import hashlib

import numpy as np

from lodeline.llm import exact_dedup, minhash, shingles
from lodeline.llm.common import Forest, Scratch, components, words
from lodeline.llm.embedding_dedup import near_vectors


def test_exact_against_brute_force(spark, docs, corpus):
    got = exact_dedup.exact_dedup(spark, docs).collect()
    assert len(got) == len(corpus)
    groups = {}
    for i, t in corpus:
        key = (t or "").translate({ord(c): None for c in " \t\n\x0b\x0c\r"})
        groups.setdefault(key, []).append((-len(t or ""), i is None, i or 0, i))
    want = {}
    for key, rows in groups.items():
        best = min(rows)[3]
        for *_, i in rows:
            want.setdefault(i, []).append((best, len(rows), hashlib.sha256(key.encode()).hexdigest()))
    for r in got:
        assert (r["keep_id"], r["group_size"], r["text_sha256"]) in want[r["doc_id"]]
        assert r["kept"] == (r["doc_id"] == r["keep_id"])


def test_exact_index_persists_and_is_idempotent(spark, plain, empty):
    index = exact_dedup.fresh_index(spark)
    first = index.dedup(plain)
    n = first.where("kept").count()
    assert index.rows().count() == n
    again = index.dedup(plain.withColumn("doc_id", plain["doc_id"] + 1000))
    assert again.where("kept").count() == 0 and index.rows().count() == n
    assert again.where("keep_id >= 1000").count() == 0
    assert index.dedup(empty).count() == 0 and exact_dedup.exact_dedup(spark, empty).count() == 0


def test_exact_leaves_no_table_and_ignores_other_columns(spark, plain, unique):
    before = {t.name for t in spark.catalog.listTables()}
    clash = plain.selectExpr("doc_id", "text", "'x' AS digest", "1 AS keep_id", "2 AS salt", "3 AS _salt", "true AS kept", "4 AS chars", "5 AS group_size")
    got = {(r["doc_id"], r["keep_id"], r["group_size"]) for r in exact_dedup.exact_dedup(spark, clash).collect()}
    assert got == {(r["doc_id"], r["keep_id"], r["group_size"]) for r in exact_dedup.exact_dedup(spark, plain).collect()} and len(got) == len(unique)
    assert {t.name for t in spark.catalog.listTables()} == before


def test_exact_anti_join_runs_on_both_sendings(spark, plain, monkeypatch):
    index, sizes = exact_dedup.fresh_index(spark), []
    real = index._write

    def write(rows):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        real(rows)
        sizes.append(("LeftAnti" in plan, index.rows().count()))

    monkeypatch.setattr(index, "_write", write)
    kept = index.dedup(plain).where("kept").count()
    assert sizes == [(False, 0), (True, kept), (True, kept)]
    index.drop()


def test_two_texts_under_one_id(spark):
    a, b = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (4, b + " other"), (5, a), (6, "c d e f g h"), (6, "i j k l m n")]
    for parts in (1, 4):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        got = minhash.near_duplicates(spark, docs, words=3, num=85, den=100).collect()
        assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in got) == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 1, False), (5, 1, False), (6, 6, True), (6, 6, True)]
        found = sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(spark, docs).collect())
        assert found == [(1, 1, 1, True), (1, 1, 2, True), (2, 2, 1, True), (3, 3, 1, True), (4, 4, 1, True), (5, 1, 2, False), (6, 6, 1, True), (6, 6, 1, True)]


def test_exact_runs_no_python(spark, plain):
    plan = exact_dedup.exact_dedup(spark, plain)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_exact_starts_no_workers(spark, plain, unique, monkeypatch):
    from pyspark.sql import SparkSession

    plain.count()
    monkeypatch.setattr(SparkSession, "createDataFrame", lambda *_, **__: (_ for _ in ()).throw(AssertionError("a PythonRDD")))
    assert exact_dedup.exact_dedup(spark, plain).count() == len(unique)


def test_near_has_one_worker_a_task(spark, plain, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    plans = {}
    keep, local = Scratch.keep, DataFrame.toLocalIterator

    def note(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString().count("MapInPandas")

    monkeypatch.setattr(Scratch, "keep", lambda self, df, name: (note(df, name), keep(self, df, name))[1])
    monkeypatch.setattr(DataFrame, "toLocalIterator", lambda self, *a, **k: (note(self, "bitmap"), local(self, *a, **k))[1])
    minhash.near_duplicates(spark, plain).count()
    assert plans["bitmap"] == plans["pairs0"] == plans["links0"] == plans["roots0-out"] == 1 and max(plans.values()) == 1, plans


def test_shingles_are_words(corpus):
    texts = [t or "" for _, t in corpus]
    for k in (3, 5):
        for t, s in zip(texts, shingles.shingle_sets(texts, k, step=1000)):
            w = words(t)
            assert len(s) == (len(set(zip(*(w[j:] for j in range(k))))) if len(w) >= k else bool(w))
    a, b = shingles.shingle_sets(["a B c d", "A\tb\nC D"], 3)
    assert (a == b).all()


def test_near_against_brute_force(spark, docs, corpus):
    for k, num, den in ((3, 85, 100), (5, 80, 100)):
        got = minhash.near_duplicates(spark, docs, words=k, num=num, den=den, block=4).collect()
        assert len(got) == len(corpus)
        sets = {}
        for i, t in corpus:
            w = words(t or "")
            s = frozenset(zip(*(w[j:] for j in range(k)))) if len(w) >= k else frozenset([tuple(w)] if w else [])
            sets.setdefault(i, s)
        f = Forest()
        ids = [i for i in sets if i is not None]
        for x in ids:
            for y in ids:
                if x < y and sets[x] and den * len(sets[x] & sets[y]) >= num * len(sets[x] | sets[y]):
                    f.join(x, y)
        for r in got:
            i = r["doc_id"]
            if i is None:
                assert r["component_id"] is None and r["kept"]
                continue
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[i]), f.root(i), f.root(i) == i)


def test_near_empty(spark, empty):
    assert minhash.near_duplicates(spark, empty).count() == 0


def test_circulant_signature_estimates():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 2000, dtype=np.uint64)
    y = np.concatenate([x[:1800], rng.integers(0, 2**63, 200, dtype=np.uint64)])
    agree = (minhash.signature(x, 1024) == minhash.signature(y, 1024)).mean()
    assert abs(agree - 1800 / 2200) < 0.05
    assert (minhash.signature(x, 1024)[:96] == minhash.signature(x)).all()


def test_components_in_rounds(spark):
    rng = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(k, k + 1) for k in range(1000, 1100)]
    f = Forest()
    for a, b in pairs:
        f.join(a, b)
    edges = spark.createDataFrame(pairs, "a long, b long").repartition(4)
    for one_task in (10_000, 0):
        got = components(edges, Scratch(spark, "t"), "c", one_task=one_task).collect()
        want = {x: f.root(x) for p in pairs for x in p if p[0] != p[1]}
        assert {r["node"]: r["root"] for r in got} == want and len(got) == len(want)


def vectors(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((30, 16))
    rows = [(k, [float(v) for v in centres[k % 30] + rng.standard_normal(16) * (0.25 if k % 3 else 0.05)], 0) for k in range(300)]
    rows += [(300 + k, list(rows[k][1]), 1) for k in range(5)]
    rows += [(400, None, 0), (401, [0.0] * 16, 0), (402, [float("nan")] * 16, 0), (403, [1.0] * 15 + [float("inf")], 0), (404, [1.0, None] * 8, 0), (405, [1.0, 2.0], 0), (406, [], 0), (None, rows[0][1], 0)]
    rows += [(407, [1e-200] * 16, 0), (408, [1e200] * 16, 0)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


def test_embeddings_against_brute_force(spark):
    rows, df = vectors(spark)
    good = {i: np.array(v) / np.abs(v).max() for i, v, _ in rows if i is not None and i not in range(400, 407)}
    unit = {i: v / np.linalg.norm(v) for i, v in good.items()}
    f, n = Forest(), dict.fromkeys((i for i, *_ in rows if i is not None), 0)
    for a in unit:
        for b in unit:
            if a < b and unit[a] @ unit[b] >= 0.9:
                f.join(a, b)
                n[a] += 1
                n[b] += 1
    for block in (2048, 16):
        got = near_vectors(spark, df, block=block).collect()
        assert len(got) == len(rows)
        for r in got:
            i = r["vec_id"]
            if i is not None:
                assert (r["n_links"], r["component_id"], r["kept"]) == (n[i], f.root(i), f.root(i) == i), i
            else:
                assert (r["n_links"], r["component_id"]) == (0, None)
    assert near_vectors(spark, df.limit(0)).count() == 0


def test_embeddings_ignore_other_columns(spark):
    _, df = vectors(spark)
    show = lambda d: sorted((r["vec_id"] or -1, r["n_links"], r["component_id"] or -1, r["kept"]) for r in near_vectors(spark, d).collect())
    clash = df.selectExpr("vec_id", "embedding", "'a' AS rep", "1 AS members", "array(1) AS filters", "2 AS filter", "3 AS b", "4 AS o", "5 AS x", "6 AS k", "7 AS n", "true AS kept", "8 AS root", "9 AS component_id")
    assert show(clash) == show(df)
