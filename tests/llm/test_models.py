import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest

from lodeline.llm import lm_scoring, recurrent, toxicity
from lodeline.llm.common import byte_words, words


def test_bytes_and_text_words_agree(corpus):
    for _, t in corpus:
        assert [w.decode() for w in byte_words(t or "")] == words(t or "")


def test_gradients_and_carried_state(monkeypatch):
    monkeypatch.setattr(recurrent, "F32", np.float64)
    s = recurrent.Shape(2, 3, 2, 4)
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) + rng.standard_normal(v.shape) * 0.3 for k, v in recurrent.fresh(s).items()}
    docs = [rng.integers(0, 8, n).astype(np.int32) for n in (5, 3, 4, 0, 2)]
    trainer = recurrent.Trainer(s, p)
    trainer.net.p = p
    got = {}
    trainer._step = lambda g, scale: got.update(g)
    trainer.learn(docs, 2, 100)
    loss = lambda: -recurrent.Net(s, p).score(docs, 2, 100).sum()
    for k in p:
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in p[k].shape)
            old, e = p[k][at], 1e-5
            p[k][at] = old + e
            up = loss()
            p[k][at] = old - e
            down = loss()
            p[k][at] = old
            assert abs((up - down) / (2 * e) - got[k][at]) < 1e-7
    whole = recurrent.Net(s, p).score(docs, 5, 100)
    assert np.allclose(whole, recurrent.Net(s, p).score(docs, 2, 1)) and whole[3] == 0
    # The probabilities of all first symbols sum to one.
    total = np.exp(recurrent.Net(s, p).score([np.array([k], np.int32) for k in range(8)])).sum()
    assert abs(total - 1) < 1e-9


def test_lm_fields(spark, plain, unique, empty):
    shape = recurrent.Shape(4, 4, 32, 8)
    got = {r["doc_id"]: r for r in lm_scoring.score_documents(spark, plain, shape=shape, known=40).collect()}
    tokens = {i: [*words(t), "\n"] for i, t in unique.items()}
    c = Counter(w for i, x in tokens.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in x)
    n, v = sum(c.values()), len(c)
    assert got.keys() == tokens.keys()
    for i, x in tokens.items():
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(x), sum(w in c for w in x), n)
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 1)
        base = sum(np.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in x)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] < 0
    assert lm_scoring.score_documents(spark, empty).count() == 0


def test_lm_odd_rows(spark, docs, corpus):
    got = lm_scoring.score_documents(spark, docs, shape=recurrent.Shape(2, 2, 32, 4), known=10).collect()
    assert len(got) == len(corpus) and all(np.isfinite(r["score"]) for r in got)


def naive_score(net, voc, counts, text):
    """log10 of a text's probability, one token after the other, state and all."""
    s, p = net.s, {k: v.astype(np.float64) for k, v in net.p.items()}
    h, before, total = np.zeros(s.hidden), s.start, 0.0
    cls_of = lambda w: lm_scoring.tail_class(w)
    head = {w: k for w, k in voc.ids.items() if k < s.head}
    tails = {}
    for w, c in counts.items():
        if w not in head:
            n = tails.setdefault(cls_of(w), [0, 0])
            n[0] += c
            n[1] += 1
    for w in [*byte_words(text), b"\n"]:
        e = p["x"][before]
        f = 1 / (1 + np.exp(-(e[: s.hidden] + h @ p["uf"])))
        h = h + f * (np.tanh(e[s.hidden :] + (f * h) @ p["uc"]) - h)
        one = np.append(h, 1.0)
        z = one @ p["wc"]
        cls = head[w] // s.per if w in head else s.head_classes + cls_of(w)
        total += z[cls] - np.log(np.exp(z).sum())
        if w in head:
            z = one @ p["wo"][cls]
            total += z[head[w] % s.per] - np.log(np.exp(z).sum())
            before = head[w]
        else:
            c, n = tails.get(cls_of(w), (0, 0))
            total += np.log((counts.get(w, 0) + 0.5) / (c + 0.5 * (n + 1)))
            before = s.head + cls_of(w)
    return total / np.log(10)


def test_lm_score_equals_brute_force(spark, plain, unique, monkeypatch):
    shape = recurrent.Shape(4, 4, 32, 8)
    kept = {}

    def trained(spark, train, voc, scratch, **options):
        kept["flat"], kept["voc"] = real(spark, train, voc, scratch, **options), voc
        return kept["flat"]

    real = lm_scoring.trained
    monkeypatch.setattr(lm_scoring, "trained", trained)
    got = {r["doc_id"]: r["score"] for r in lm_scoring.score_documents(spark, plain, shape=shape, known=40, start_docs=5).collect()}
    counts = Counter(w for i, t in unique.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in [*byte_words(t), b"\n"])
    net = recurrent.Net(shape, recurrent.unflatten(shape, kept["flat"]))
    for i, t in unique.items():
        assert got[i] == pytest.approx(naive_score(net, kept["voc"], counts, t), rel=2e-4), i


def test_lm_every_training_row_trains_and_helps(spark, monkeypatch):
    """The tasks' trainers see each training token once, and the model tells held-out texts better than the base."""
    rng = np.random.default_rng(3)
    rows = [(k, " ".join(f"w{(int(rng.integers(0, 5)) + 7 * j) % 35}" for j in range(1500))) for k in range(70)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    tokens = sum(1501 for k, _ in rows if zlib.crc32(str(k).encode()) % 5 != 1)
    seen = {}

    class Kept(lm_scoring.Scratch):
        def keep(self, df, name):
            out = super().keep(df, name)
            seen[name] = out
            return out

    monkeypatch.setattr(lm_scoring, "Scratch", Kept)
    got = lm_scoring.score_documents(spark, docs, shape=recurrent.Shape(4, 8, 32, 16), known=100).collect()
    assert seen["network"].agg({"w": "max"}).first()[0] == tokens
    held = [r for r in got if r["held_out"]]
    assert len(held) > 10 and all(r["score"] > r["base_score"] for r in held)


def test_tail_probabilities_sum_to_one():
    s = recurrent.Shape(2, 2, 32, 4)
    known = [(f"w{k}".encode(), 20 - k) for k in range(12)]
    sums = {}
    for w, c in known[s.head :]:
        a = sums.setdefault(lm_scoring.tail_class(w), [0, 0])
        a[0] += c
        a[1] += 1
    voc = lm_scoring.Vocabulary(s, known, 200, 12, sums)
    for cls, (c, n) in sums.items():
        inside = [voc.inner[k] for k in range(s.head, 12) if voc.symbol[k] == s.head + cls]
        unseen = 0.5 / (c + 0.5 * (n + 1))
        assert sum(10**x for x in inside) + unseen == pytest.approx(1)


def test_block_max_is_exact():
    rng = np.random.default_rng(5)
    n, terms = 700, 40
    vectors = [(t := np.unique(rng.integers(0, terms, rng.integers(0, 6))), rng.integers(1, 4, len(t))) for _ in range(n)]
    idf = rng.random(terms) + 0.5
    for block, frequent in ((16, 0.06), (64, 0.0), (7, 1.0)):
        index = toxicity.BlockMaxIndex(vectors, idf, block=block, frequent=frequent)
        dense = np.zeros((n, terms))
        for k, (t, f) in enumerate(vectors):
            if len(t):
                dense[k, t] = index.unit(t, f)[1]
        asked = list(range(0, n, 23))
        for skip in (None, np.array(asked)):
            best = index.nearest([vectors[k] for k in asked], 16, skip, most=3000)
            for k, row in zip(asked, best):
                want = np.round(dense @ dense[k], 12)
                if skip is not None:
                    want[k] = 0
                order = sorted(np.flatnonzero(want > 0), key=lambda j: (-want[j], j))[:16]
                row = row[row > 0]
                assert (toxicity.RANKS - 1 - row % toxicity.RANKS).tolist() == [int(j) for j in order]
                assert np.allclose((row // toxicity.RANKS) * toxicity.STEP, want[order], atol=2e-12)


def test_blocks_are_skipped(monkeypatch):
    """Texts of one group of examples do not score the blocks of another group."""
    rng = np.random.default_rng(6)
    vectors = [(np.append(g := k % 4, 4 + g * 50 + np.unique(rng.integers(0, 50, 6))), np.ones(200, int)[: 200]) for k in range(400)]
    vectors = [(t, f[: len(t)]) for t, f in vectors]
    index = toxicity.BlockMaxIndex(vectors, np.ones(204), block=10, frequent=0.02)
    scored = []

    class Rows(np.ndarray):
        def __getitem__(self, k):
            scored.append(k)
            return np.asarray(self)[k]

    index.rows = index.rows.view(Rows)
    index.nearest([vectors[0]])
    assert 0 < len(scored) <= 10 + 1 < index.blocks


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(9)
    rows, labels = [], []
    for k in range(600):
        bad = k % 6 == 0
        w = [f"w{x}" for x in rng.integers(0, 150, 40)]
        if bad:
            w[int(rng.integers(0, 40))] = str(rng.choice(["vilest", "viler", "rotten", "gross"])) + "!"
        rows.append((k, " ".join(w)))
        labels.append((k, 1, int(bad)))
    docs = spark.createDataFrame(rows + [(900, None), (901, ""), (None, "rotten"), (902, "rotten"), (902, "rotten")], "doc_id long, text string")
    return docs, spark.createDataFrame(labels + [(1, 1, None), (None, 1, 1), (2, 1, 0)], "doc_id long, quality int, toxic int"), {k: t for k, _, t in labels}


def test_toxicity_on_held_out_rows(spark, labelled):
    docs, labels, truth = labelled
    got = toxicity.score_documents(spark, docs, labels).collect()
    assert len(got) == 605
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 60 and np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.97
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
        assert all(zlib.crc32(str(e).encode()) % 5 for e in r["evidence"])
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    by = {r["doc_id"]: r for r in got}
    assert by[900]["predicted"] == by[901]["predicted"] == 0 and by[902]["predicted"] == 1


def brute_scores(rows, labels):
    """Text -> score, by dense TF-IDF vectors of every word and of the beginnings that tell the classes apart."""
    known = {i: t or "" for i, t in rows if i is not None}
    label = {}
    for i, y in labels:
        if i is not None and y is not None:
            label[i] = max(label.get(i, 0), y)
    train = {i: y for i, y in label.items() if zlib.crc32(str(i).encode()) % 5}
    sizes = Counter(train.values())
    sample = sorted({(hashlib.sha256(known[i].encode()).hexdigest(), y, known[i]) for i, y in train.items() if i in known})
    split = lambda t: "".join(c if c.isalnum() or c > "\x7f" else " " for c in t.lower()).encode().split()
    begin = lambda ws: [w[:n] + b"*" for w in ws for n in (4, 5, 6) if len(w) > n]
    y = np.array([x[1] for x in sample])
    n1, n0 = int(y.sum()), int((1 - y).sum())
    sets = [set(split(t)) | set(begin(split(t))) for _, _, t in sample]
    terms, lift = [], {}
    for w in sorted(set().union(*sets)):
        a, b = (sum(w in s for s, v in zip(sets, y) if v == k) for k in (1, 0))
        ratio = (a + 0.5) / (n1 + 1) / ((b + 0.5) / (n0 + 1))
        chi = (a * (n0 - b) - b * (n1 - a)) ** 2 * (n0 + n1) / ((a + b) * max(n0 + n1 - a - b, 1) * n0 * n1)
        apart = a + b >= 5 and chi >= 25 and (ratio >= 3 or ratio <= 1 / 3)
        if apart or not w.endswith(b"*"):
            terms.append(w)
            lift[w] = toxicity.LIFT if apart else 1.0
    column = {w: k for k, w in enumerate(terms)}
    count = Counter(w for _, t in rows for w in (set(split(t or "")) | set(begin(split(t or "")))) & column.keys())
    weight = np.array([(np.log((len(rows) + 1) / (count[w] + 1)) + 1) * lift[w] for w in terms])

    def vector(t):
        v = np.zeros(len(terms))
        for w, c in Counter(split(t) + begin(split(t))).items():
            if w in column:
                v[column[w]] = (1 + np.log(c)) * weight[column[w]]
        return v / (np.linalg.norm(v) or 1)

    units = np.array([vector(t) for _, _, t in sample])
    share = np.array([sizes[0] / n0, sizes[1] / n1])[y]

    def vote(t, skip=-1):
        cos = np.round(units @ vector(t), 12)
        near = sorted((j for j in range(len(y)) if j != skip and cos[j] > 0), key=lambda j: (-cos[j], j))[:16]
        w = share[near] / (1.02 - np.minimum(cos[near], 1))
        return (w * y[near]).sum() / w.sum() if near else np.nan

    votes = np.array([vote(t, j) for j, (_, _, t) in enumerate(sample)])
    ok = ~np.isnan(votes)
    a, b = toxicity.fit_curve(votes[ok], y[ok].astype(float), share[ok])
    blank = ((share * y).sum() + 0.5) / (share.sum() + 2)
    return {t: blank if np.isnan(v := vote(t or "")) else 1 / (1 + np.exp(-(a * v + b))) for _, t in rows}


def test_toxicity_equals_brute_force(spark, labelled):
    docs, labels, _ = labelled
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + [(950, "w1 w2 ROTTEN, w3 " * 4000), (951, "nothing known é漢 _ -- "), (952, "w1 vilest")]
    clash = spark.createDataFrame([(i, t, 1.0, "x", 0, [1], 5) for i, t in rows], "doc_id long, text string, score double, same string, toxic int, word array<long>, vote long").repartition(5)
    want = brute_scores(rows, [(r["doc_id"], r["toxic"]) for r in labels.collect()])
    got = toxicity.score_documents(spark, clash, labels).collect()
    assert len(got) == len(rows)
    text = dict(rows)
    for r in got:
        if r["doc_id"] is not None:
            assert r["score"] == pytest.approx(want[text[r["doc_id"]]], abs=1e-9)
    # Other doc_ids for texts without a label change no score; nor does another order of the rows.
    moved = spark.createDataFrame([(i if i is None or i < 900 else i + 5000, t) for i, t in rows[::-1]], "doc_id long, text string").repartition(2)
    again = {(r["doc_id"] if r["doc_id"] is None or r["doc_id"] < 900 else r["doc_id"] - 5000): r["score"] for r in toxicity.score_documents(spark, moved, labels).collect()}
    assert all(again[r["doc_id"]] == pytest.approx(r["score"], abs=1e-12) for r in got)


def test_toxicity_without_labels_or_rows(spark, labelled):
    docs, labels, _ = labelled
    none = toxicity.score_documents(spark, docs, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.25}
    assert toxicity.score_documents(spark, docs.limit(0), labels).count() == 0
