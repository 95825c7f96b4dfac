"""SentencePiece encoding and decoding by a table of distinct chunks.

No piece of the model holds a white-space marker after another character, so no merge crosses the start of a marked
word. A text is cut there; each distinct marked word (its run of markers included) is segmented once by the
`sentencepiece` library, and the ids are joined back by position. The model is checked for this before use: normaliser
identity, dummy prefix, no removal of white space, no piece with an inner marker; any other model is encoded whole.

Defined results: a null text is the empty text with no ids. A chunk may be as long as the text. Repeated rows repeat.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from lodeline.llm.common import release_memory, table, text_batches, texts
from lodeline.llm.word_ids import tokenizer_file

PIECES = "piece_bpe_32k.model"
MARK = "▁"
_CHUNK = re.compile(" +[^ ]*")


class ChunkTable(dict):
    """Marked word (markers as spaces, the dummy one included) -> (number of ids, ids as text, decoded text)."""

    def __init__(self, path: str, most: int = 250_000):
        import sentencepiece

        super().__init__()
        self.sp, self.most = sentencepiece.SentencePieceProcessor(model_file=path), most
        names = [self.sp.id_to_piece(k) for k in range(self.sp.get_piece_size())]
        self.alone = next(k for k, p in enumerate(names) if p == MARK)
        self.lead = self.sp.encode("a")
        self.names = [p.replace(MARK, " ") for p in names]
        # Ids below are special or single bytes.
        self.first_name = 1 + max(k for k in range(len(names)) if self.sp.is_byte(k) or self.sp.is_control(k) or self.sp.is_unknown(k))
        keeps = self.sp.decode(self.sp.encode("  a  b ")) == "  a  b " and self.sp.encode("ﬁ 　") != self.sp.encode("fi ")
        user = any(self.sp.is_unused(k) for k in range(len(names)))
        self.splits = keeps and not user and not any(re.search(f"[^{MARK}]{MARK}", p) for p in names)

    def add(self, chunks: set[str]) -> None:
        new = list(chunks)
        # The library adds one marker in front, so a chunk goes in without its first.
        found = self.sp.encode([c[1:] for c in new], num_threads=1)
        names, least = self.names, self.first_name
        for chunk, ids in zip(new, found):
            if chunk == " ":
                ids = [self.alone]
            if min(ids) >= least:
                back = "".join([names[k] for k in ids])
            else:  # byte pieces make up characters between them
                back = self.sp.decode([*self.lead, *ids])[1:]
            self[chunk] = (len(ids), ",".join(map(str, ids)), back)

    def lines(self, texts: list[str], step: int = 512) -> Iterator[tuple[int, str, str]]:
        """(number of ids, ids joined by commas, decoded text) of each text."""
        if not self.splits:
            for t in texts:
                ids = self.sp.encode(t)
                yield len(ids), ",".join(map(str, ids)), self.sp.decode(ids)
            return
        for k in range(0, len(texts), step):
            part = [marked_words(t) for t in texts[k : k + step]]
            if len(self) > self.most:
                self.clear()
            if new := set().union(*part).difference(self):
                self.add(new)
            get = self.__getitem__
            for chunks in part:
                if not chunks:
                    yield 0, "", ""
                    continue
                n, ids, back = zip(*map(get, chunks))
                yield sum(n), ",".join(ids), "".join(back)[1:]


def marked_words(text: str) -> list[str]:
    """A text's chunks, each beginning with its markers written as spaces; none for an empty text."""
    if not text:
        return []
    # A marker that stands in the text itself is a space to the library.
    marked = " " + text.replace(MARK, " ")
    if "  " in marked or marked[-1] == " ":
        return _CHUNK.findall(marked)
    return marked.replace(" ", "\0 ").split("\0")[1:] if "\0" not in marked else _CHUNK.findall(marked)


_OPEN: dict[str, ChunkTable] = {}


def chunk_table(path: str) -> ChunkTable:
    if path not in _OPEN:
        _OPEN[path] = ChunkTable(path)
    return _OPEN[path]


def encode_decode(docs: DataFrame, model: str, *, ids: bool = False) -> DataFrame:
    """Per document: n_tokens, SHA-256 of the ids and of the text decoded from them; with `ids` the ids as well."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table_ = chunk_table(model)
        for pdf in batches:
            rows = []
            for n, joined, back in table_.lines(pdf["text"].tolist()):
                row = (n, hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
                rows.append((*row, [int(x) for x in joined.split(",")] if joined else []) if ids else row)
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * ids])
            out.insert(0, "doc_id", pdf["doc_id"].astype("Int64").values)
            yield out
        release_memory()

    text_batches(docs.sparkSession)
    kind = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    return texts(docs).mapInPandas(run, kind)


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), tokenizer_file(PIECES))
