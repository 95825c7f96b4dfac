import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

from lodeline.llm import packing, pieces, rollups, warc, word_ids

WORD, PIECE = word_ids.tokenizer_file(word_ids.WORD_BPE), word_ids.tokenizer_file(pieces.PIECES)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD)
    return lambda s: t.encode(s, add_special_tokens=False).ids


EDGES = ["", " ", "a.b, c. D.\n", "don't we'LL x.'s, y", "é, É. ß. µ, ª.", "<|endoftext|> <|ENDOFTEXT|>, x", "a\x1cb\x85c\xa0d　e", "..., ,. .,", "1,2. 3x,", "İ, ﬁ. Σς,", "漢字, かな.", "\x00 \x0b\x0c"]


def test_word_ids_equal_the_library(library, corpus):
    table = word_ids.WordIds(WORD, most=50)
    for t in [*EDGES, *(t or "" for _, t in corpus)]:
        assert np.frombuffer(table.ids([t])[0], "<u4").tolist() == library(t), t[:60]


def test_packing(spark, docs, corpus, library):
    got = packing.pack(docs, WORD, size=64, unit=4).collect()
    want = defaultdict(list)
    for i, t in corpus:
        want[i].append([*library(t or ""), 2])
    used = defaultdict(list)
    per_doc = defaultdict(list)
    for r in got:
        used[r["sequence_id"]].append((r["offset"], r["length"]))
        per_doc[r["doc_id"]].append(r)
    waste = 0
    for spans in used.values():
        at = 0
        for off, n in sorted(spans):
            assert off == at and n > 0
            at += n
        assert at <= 64
        waste += 64 - at if at & (at - 1) else 0
    assert waste == 0
    for i, rows in per_doc.items():
        todo = [(r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows]
        assert sum(n for _, n, _, _ in todo) == sum(map(len, want[i]))
        for start, n, crc, total in todo:
            ids = [w for w in want[i] if len(w) == total and zlib.crc32(np.array(w[start : start + n], "<u4").tobytes()) == crc]
            assert ids


def test_packing_empty(empty):
    assert packing.pack(empty, WORD).count() == 0


@pytest.mark.parametrize("tasks", [1, 4, 16])
def test_sum_of_squares_places_nearly_all_ids(tasks):
    rng = np.random.default_rng(tasks)
    sizes = (rng.pareto(1.5, 4000) * 300 + 1).astype(int).tolist() + [200_000]
    cut = total = 0
    for k in range(tasks):
        packer, used, pieces = packing.Packer(first=k << 36), defaultdict(int), 0
        for x in sizes[k::tasks]:
            for *_, length, ids, w, at in packer.add(x, bytes(4 * x)):
                assert used[w] == at and len(ids) == 4 * length
                used[w] += length
            # Open windows are bound to the levels, whatever the number of documents.
            assert sum(packer.bins.count) <= 2 * packer.size // packer.unit
        assert all(n == packer.size for n in used.values())
        for *_, length, ids, w, at in packer.end():
            assert used[w] == at and len(ids) == 4 * length
            used[w] += length
        assert sum(used.values()) == sum(sizes[k::tasks]) and sorted(used) == list(range(k << 36, packer.next))
        assert packer.recut <= 8 * packer.size
        cut, total = cut + packer.recut, total + sum(used.values())
    assert cut <= 0.02 * tasks * total / 4


def test_sum_of_squares_takes_the_best_level():
    bins = packing.SumOfSquares(10)
    rng = np.random.default_rng(0)
    made = []
    for need in rng.integers(1, 10, 300).tolist():
        before = bins.count.copy()
        costs = {}
        for h in range(0, 11 - need):
            if h == 0 or before[h]:
                n = before.copy()
                if h:
                    n[h] -= 1
                if h + need < 10:
                    n[h + need] += 1
                costs[h] = int((n**2).sum())
        h = bins.level(need)
        assert costs[h] == min(costs.values())
        bins.place(need, lambda: made.append(0) or len(made))
    assert packing.powers(13) == [8, 4, 1]


def test_pieces_equal_the_library(spark, docs, corpus, empty):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    table = pieces.ChunkTable(PIECE, most=20)
    assert table.splits
    texts = [*EDGES, "  two  spaces ", "▁a▁▁b", " ", "   ", "x ", "\n \t", *(t or "" for _, t in corpus)]
    for t, (n, ids, back) in zip(texts, table.lines(texts, step=3)):
        want = sp.encode(t)
        assert (n, ids, back) == (len(want), ",".join(map(str, want)), sp.decode(want)), t[:60]
    got = pieces.encode_decode(docs, PIECE, ids=True).collect()
    assert len(got) == len(corpus) and pieces.encode_decode(empty, PIECE).count() == 0
    for r in got:
        assert r["n_tokens"] == len(r["ids"])
        assert r["decoded_sha256"] == hashlib.sha256(sp.decode(list(r["ids"])).encode()).hexdigest()


def test_rollup_maintains_totals(spark, tmp_path, empty):
    kind = "op string, doc_id long, source string, lang string, text string"
    store = rollups.TokenRollup(spark, f"file://{tmp_path}/s", {"words-1": rollups.count_words})
    batch = lambda *rows: spark.createDataFrame(list(rows), kind)
    show = lambda: {(r["source"], r["lang"]): (r["docs"], r["tokens"]) for r in store.totals().collect()}
    assert show() == {}
    first = batch(("insert", 1, "a", "en", "x y"), ("insert", 2, "a", "en", None), ("insert", 3, None, "de", "z"), ("insert", 3, None, "de", "z"))
    assert store.commit("b1", first) and show() == {("a", "en"): (2, 2), (None, "de"): (1, 1)}
    assert not store.commit("b1", first) and show() == {("a", "en"): (2, 2), (None, "de"): (1, 1)}
    assert store.commit("b/2", batch(("revise", 1, "b", "en", "x y z"), ("delete", 3, None, None, None), ("delete", 9, None, None, None)))
    assert show() == {("a", "en"): (1, 0), ("b", "en"): (1, 3)}
    assert store.commit("b3", batch(("insert", 1, "b", "en", "x"), ("delete", 2, None, None, None))) and show() == {("b", "en"): (1, 1)}
    assert store.commit("b4", batch(("delete", 1, None, None, None))) and show() == {}
    # What an attempt without an entry leaves behind is not read.
    batch(("insert", 7, "q", "en", "x")).selectExpr("'q' AS source", "'en' AS lang", "'words-1' AS tokenizer", "1L AS docs", "5L AS tokens").write.parquet(f"file://{tmp_path}/s/deltas/lost")
    assert show() == {}


CHANGE = "op string, doc_id long, source string, lang string, text string"


def test_rollup_survives_lost_and_racing_committers(spark, tmp_path, monkeypatch):
    store = rollups.TokenRollup(spark, f"file://{tmp_path}/s", {"words-1": rollups.count_words})
    batch = lambda *rows: spark.createDataFrame(list(rows), CHANGE)
    show = lambda: {(r["source"], r["lang"]): (r["docs"], r["tokens"]) for r in store.totals().collect()}
    one = batch(("insert", 1, "a", "en", "x y"))

    class Lost(Exception):
        pass

    def lost(*a):
        raise Lost

    for step in ("_publish", "_write", "_signed"):  # the driver is lost before this step
        with monkeypatch.context() as m:
            m.setattr(store, step, lost)
            with pytest.raises(Lost):
                store.commit("b1", one)
        assert show() == {} and not store.committed("b1")
    # Lost after writing the entry aside, before its rename.
    (tmp_path / "s" / "aside").mkdir(exist_ok=True)
    (tmp_path / "s" / "aside" / "half").write_bytes(b"")
    assert store.commit("b1", one) and not store.commit("b1", one) and show() == {("a", "en"): (1, 2)}

    # Another committer gets in between reading the state and publishing: the batch is worked out again.
    real, once = store._publish, []

    def overtaken(version, entry):
        if not once:
            once.append(1)
            assert rollups.TokenRollup(spark, store.folder, store.tokenizers).commit("b2", batch(("revise", 1, "b", "en", "x y z")))
        return real(version, entry)

    monkeypatch.setattr(store, "_publish", overtaken)
    assert store.commit("b3", batch(("revise", 1, "c", "en", "x")))
    assert show() == {("c", "en"): (1, 1)} and [e["batch"] for e in store.log()] == ["b1", "b2", "b3"]
    assert not real(1, {"batch": "other", "attempt": "x"}) and [e["batch"] for e in store.log()] == ["b1", "b2", "b3"]
    assert store.compact() and show() == {("c", "en"): (1, 1)} and store.ledger().count() == 1
    assert not store.commit("b2", one) and store.commit("b4", batch(("delete", 1, None, None, None))) and show() == {}


def test_rollup_counts_rows_without_an_id_and_ignores_other_columns(spark, tmp_path):
    store = rollups.TokenRollup(spark, f"file://{tmp_path}/s", {"words-1": rollups.count_words})
    rows = [("insert", None, "a", "en", "x y"), ("insert", None, "a", "en", "x y"), ("insert", 5, "a", "en", "w " * 300_000), ("delete", None, "a", "en", "x y")]
    df = spark.createDataFrame([(*r, 1, "t", 9) for r in rows], CHANGE + ", docs long, tokenizer string, tokens long")
    assert store.commit("b", df)
    assert [(r["docs"], r["tokens"]) for r in store.totals().collect()] == [(3, 300_004)]
    # The rows without an id stay through later commits; the one with an id is revised.
    assert store.commit("c", spark.createDataFrame([("revise", 5, "a", "en", "x"), ("insert", None, "a", "en", "z")], CHANGE))
    assert [(r["docs"], r["tokens"]) for r in store.totals().collect()] == [(4, 6)]


def test_rollup_of_bpe_equals_the_library(spark, tmp_path, plain, unique, library):
    store = rollups.TokenRollup(spark, f"file://{tmp_path}/s", rollups.production_tokenizers())
    assert store.commit("load", plain.selectExpr("'insert' AS op", "doc_id", "source", "lang", "text"))
    got = {r["tokenizer"]: (r["docs"], r["tokens"]) for r in store.totals().collect()}
    assert got["word_bpe_49k-1"] == (len(unique), sum(len(library(t)) for t in unique.values()))


def pages(spark):
    html = ["<p>x</p>", "<p>x</p>", None, "", "é" * 3000, "<p>x</p>", "y"]
    rows = [(k, f"http://h.test/{k}\r\nX: 1", h) for k, h in enumerate(html)] + [(None, None, "y"), (None, None, "alone"), (6, "http://h.test/6", "y")]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string")


def test_warc_round_trip(spark, tmp_path):
    rows, df = pages(spark)
    for least in (0, 5):
        kept = warc.write_archives(df, f"file://{tmp_path}/{least}", least_revisit=least, file_bytes=500).collect()
        manifest = spark.createDataFrame(kept, "path string, records long, bytes long")
        got = warc.read_archives(manifest).collect()
        assert len(got) == len(rows) == sum(r["records"] for r in kept)
        by_text = defaultdict(list)
        for i, _, h in rows:
            if i is not None:
                by_text[h or ""].append(i)
        texts = {i: h or "" for i, _, h in rows if i is not None}
        for r in got:
            if r["page_id"] is None:
                assert r["refers_to"] in (None, 6)
                continue
            text = texts[r["page_id"]]
            owner = max(by_text[text])
            revisit = len(text.encode()) >= least and owner != r["page_id"]
            assert r["record_type"] == ("revisit" if revisit else "response") and r["refers_to"] == (owner if revisit else None)
            assert r["payload_bytes"] == len(text.encode()) and r["payload_digest"] == warc.base32_sha1(text.encode())
    assert warc.write_archives(df.limit(0), f"file://{tmp_path}/none").count() == 0


def test_warc_of_long_pages_and_clashing_columns(spark, tmp_path):
    long = "é0123456789" * 300_000
    rows = [(1, "u", long), (2, "u", long + "x"), (3, None, long)]
    df = spark.createDataFrame([(*r, "s", 5, b"m", 7, "o", "r") for r in rows], "page_id long, url string, html string, sha string, size int, member binary, _salt int, owner string, page string")
    kept = warc.write_archives(df, f"file://{tmp_path}/a", file_bytes=1000).collect()
    got = {r["page_id"]: r for r in warc.read_archives(spark.createDataFrame(kept, "path string, records long, bytes long")).collect()}
    assert {k: (r["record_type"], r["refers_to"], r["payload_bytes"]) for k, r in got.items()} == {1: ("revisit", 3, len(long.encode())), 2: ("response", None, len(long.encode()) + 1), 3: ("response", None, len(long.encode()))}
    assert got[1]["payload_digest"] == warc.base32_sha1(long.encode()) != got[2]["payload_digest"]


def test_warc_reader_checks():
    import io

    one = warc.record(7, "u", b"payload " * 500)
    file = warc.gzip_member(one) + warc.gzip_member(warc.revisit(8, "u", warc.base32_sha1(b"x"), 1, 7))
    for step in (1, 7, 1 << 16):
        got = list(warc.read_records(io.BytesIO(file), step, payloads=True))
        assert [r["payload"] for r in got] == [b"payload " * 500, b""]
    for bad in (file[:-9], warc.gzip_member(one.replace(b"payload ", b"Payload ", 1)), warc.gzip_member(one[:-4]), warc.gzip_member(b"HTTP/1.1 200\r\n\r\n"), warc.gzip_member(one.replace(b"Content-Length: 4", b"Content-Length: 9"))):
        with pytest.raises((warc.BadRecord, zlib.error)):
            list(warc.read_records(io.BytesIO(bad)))
