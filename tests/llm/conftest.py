import random

import pytest

from lodeline.llm import common

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use for their own.
CLASH = "keep_id long, digest string, node long, root long, spans string, kept boolean, h long, sequence_id long, score double, row long"


def make_words(seed: int, n: int, vocab: int = 400) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(1, 9))) if r.random() < 0.05 else f"w{r.randint(0, vocab)}" for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text): copies, near copies, shared passages, blanks, nulls, long and repeated rows, other scripts."""
    base = [make_words(k, 60 + 7 * k) for k in range(20)]
    passage = make_words(99, 45)
    rows = list(enumerate(base))
    n = len(rows)
    for k in range(6):  # near copies
        w = base[k].split(" ")
        w[len(w) // 2] = "changed"
        rows.append((n + k, " ".join(w)))
    n = len(rows)
    rows += [(n + k, f"{make_words(200 + k, 30)} {passage} {make_words(300 + k, 30)}") for k in range(6)]
    n = len(rows)
    rows += [(n, base[3]), (n + 1, base[3].replace(" ", "\n ")), (n + 2, base[3] + "  "), (n + 3, base[4].upper())]
    rows += [(n + 4, None), (n + 5, ""), (n + 6, " \t\n\x0b\x0c\r "), (n + 7, "a"), (n + 8, "A b"), (n + 9, "a B")]
    rows += [(n + 10, "é漢字 \x1c\x85 ﬁ ß İ 😀 <|endoftext|> <|ENDOFTEXT|> don't ..., a.b, ▁▁x  y "), (n + 11, "ab" * 400), (n + 12, "x" * 5000)]
    rows += [(n + 13, make_words(7, 30000)), (n + 14, "one two three " * 200), (None, base[5]), (None, None), (n + 15, base[0]), (n + 15, base[0])]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus with extra columns that clash, over several partitions."""
    full = [(i, t, "en", None, None, *(None,) * 10) for i, t in corpus]
    return spark.createDataFrame(full, f"{DOCS}, {CLASH}").repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], f"{DOCS}, {CLASH}")


@pytest.fixture(scope="session")
def unique(corpus):
    """The rows whose doc_id stands once, as a dict."""
    ids = [i for i, _ in corpus]
    return {i: t or "" for i, t in corpus if i is not None and ids.count(i) == 1}


@pytest.fixture(scope="session")
def plain(spark, unique):
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in unique.items()], DOCS).repartition(3)


def words(text):
    return common.words(text or "")
