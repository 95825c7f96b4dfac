"""The pipeline against one made of brute-force stages, on its own stages' toxicity scores."""

import zlib

import numpy as np
from tests.llm.test_repeats import brute

import corpus_pipeline
from lodeline.llm import toxicity
from lodeline.llm.common import Forest, words
from lodeline.llm.packing import Packer
from lodeline.llm.word_ids import WORD_BPE, tokenizer_file


def test_pipeline_equals_brute_force(spark, unique, plain, tmp_path):
    texts = dict(unique)
    for k in range(40):
        texts[5000 + k] = f"tiny note {k} " + ("vilest stuff" if k % 2 else "fine stuff")
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], plain.schema)
    labels = spark.createDataFrame([(5000 + k, 1, k % 2) for k in range(40)], "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    bad = {r["doc_id"] for r in toxicity.score_documents(spark, docs, labels).where("predicted = 1").collect()}
    assert bad == {5000 + k for k in range(40) if k % 2}
    left = {i: t for i, t in texts.items() if i not in bad}
    best = {}
    for i, t in left.items():
        key = "".join(c for c in t if c not in " \t\n\x0b\x0c\r")
        best[key] = min(best.get(key, (1, 0)), (-len(t), i))
    left = {i: left[i] for _, i in best.values()}
    sets = {}
    for i, t in left.items():
        w = words(t)
        sets[i] = set(zip(*(w[j:] for j in range(5)))) if len(w) >= 5 else {tuple(w)} if w else set()
    f = Forest()
    for x in sets:
        for y in sets:
            if x < y and sets[x] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                f.join(x, y)
    left = {i: t for i, t in left.items() if f.root(i) == i}
    cut = brute(left, 100)
    left = {i: cut[i][2].decode("utf-8", "ignore") for i in left if cut[i][0] == 0 or cut[i][2].decode("utf-8", "ignore")}
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file(WORD_BPE))
    ids = {i: [*t.encode(x, add_special_tokens=False).ids, 2] for i, x in left.items()}
    assert {r["doc_id"] for r in got} == ids.keys()
    for r in got:
        mine = ids[r["doc_id"]]
        piece = np.array(mine[r["start"] : r["start"] + r["length"]], "<u4").tobytes()
        assert r["doc_tokens"] == len(mine) and zlib.crc32(piece) == r["ids_crc32"]
    for i, mine in ids.items():
        assert sum(r["length"] for r in got if r["doc_id"] == i) == len(mine)
    assert len(corpus_pipeline.STAGES) == 5 and Packer().size == 4096


def test_stages_keep_columns(spark, docs, empty, tmp_path):
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for frame in (docs, empty):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, frame, str(tmp_path))
            assert out.columns == frame.columns and out.dtypes == frame.dtypes
            assert out.count() <= frame.count()
        assert corpus_pipeline.STAGES[-1][1](spark, frame, str(tmp_path)).count() >= 0


def test_verdicts_are_on_rows(spark, tmp_path):
    """Where a doc_id stands on two texts, or on none, each text meets its own verdict."""
    long = lambda k: " ".join(f"{k}{j}" for j in range(80))
    marked = [(5000 + k, f"tiny note {k} " + ("vilest stuff" if k % 2 else "fine stuff")) for k in range(40)]
    rows = [(1, long("a")), (1, "such vilest stuff"), (2, long("a")), (2, long("b")), (None, "more vilest stuff"), (None, long("c")), (3, long("b") + " more")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows + marked], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    spark.createDataFrame([(5000 + k, 1, k % 2) for k in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    short = {t: f"{i} {t[:2]}" for i, t in rows}
    show = lambda df: sorted(short[r["text"]] if r["doc_id"] is None else f"{r['doc_id']} {r['text'][:2]}" for r in df.collect() if r["doc_id"] is None or r["doc_id"] < 5000)
    left = corpus_pipeline.toxicity(spark, docs, str(tmp_path))
    assert show(left) == ["1 a0", "2 a0", "2 b0", "3 b0", "None c0"] and left.count() == 25
    left = corpus_pipeline.exact(spark, left, str(tmp_path))
    assert show(left) == ["1 a0", "2 b0", "3 b0", "None c0"]
    assert show(corpus_pipeline.near(spark, left, str(tmp_path))) == ["1 a0", "2 b0", "None c0"]
