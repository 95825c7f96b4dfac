"""Ids of the word-end BPE by a table of distinct words: a word of a text is encoded once and looked up after that.

The tokenizer never looks across white space, so a text may be cut at space, tab, line feed and carriage return and the
words' ids joined. Words are encoded by the `tokenizers` library itself.
"""

from __future__ import annotations

import sys
from array import array

import numpy as np

WORD_BPE = "word_bpe_49k.json"


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordIds(dict):
    """word -> little-endian uint32 ids as bytes. At `most` words the table starts anew, so memory stays bounded."""

    def __init__(self, path: str, most: int = 250_000):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self._batch = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        vocab = self.tokenizer.get_vocab()
        self.closing = np.zeros(1 + max(vocab.values()), bool)
        self.closing[[k for t, k in vocab.items() if t.endswith("</w>")]] = True
        self.fresh()
        if sys.byteorder != "little" or array("I").itemsize != 4:
            raise RuntimeError("ids are joined as little-endian 32-bit numbers")

    def fresh(self) -> None:
        self.clear()
        self[""] = b""
        self.encode_words([",", "."])

    def encode_words(self, words: list[str]) -> None:
        """Words one by one, whatever they hold."""
        for w, e in zip(words, self._batch(words, add_special_tokens=False)):
            self[w] = array("I", e.ids).tobytes()

    def encode_letters(self, words: list[str], step: int = 512) -> None:
        """Words of letters alone: each is one piece of the pre-tokenizer, so of many joined by spaces each ends at an
        id whose token has the word-end mark."""
        parts = [words[k : k + step] for k in range(0, len(words), step)]
        for part, e in zip(parts, self._batch([" ".join(p) for p in parts], add_special_tokens=False)):
            ids = array("I", e.ids)
            ends = np.flatnonzero(self.closing[np.frombuffer(ids, "<u4")]) + 1
            if len(ends) != len(part):
                self.encode_words(part)
                continue
            data, a = ids.tobytes(), 0
            for w, b in zip(part, (4 * ends).tolist()):
                self[w] = data[a:b]
                a = b

    def add(self, texts: list[list[str]]) -> None:
        if len(self) > self.most:
            self.fresh()
        have = self.keys()
        letters, others, tails = set(), [], []
        for w in set().union(*texts) - have:
            if w.isalpha() and w.isascii():
                low = w.lower()
                letters.add(low)
                if low != w:
                    tails.append((w, low, ""))
            elif w[-1] in ",." and (front := w[:-1]).isalpha() and max(w) <= "\xff":
                # Two pieces: the letters, lower-cased, and the mark.
                front = front.lower()
                letters.add(front)
                tails.append((w, front, w[-1]))
            elif w.isalpha() and max(w) <= "\xff":
                low = w.lower()
                letters.add(low)
                if low != w:
                    tails.append((w, low, ""))
            else:
                others.append(w)
        self.encode_letters(list(letters - have))
        self.encode_words(others)
        for w, front, mark in tails:
            self[w] = self[front] + self[mark]

    def ids(self, texts: list[str], step: int = 512) -> list[bytes]:
        """Each text's ids as bytes."""
        get = self.__getitem__
        out: list[bytes] = []
        for k in range(0, len(texts), step):
            part = [cut_words(t) for t in texts[k : k + step]]
            self.add(part)
            out += [b"".join(map(get, c)) for c in part]
        return out


def _kinds() -> bytes:
    """Latin-1 characters as letters or digits (a), white space, marks that close a word (,) and others (P)."""
    kind = lambda c: "," if c in ",." else " " if c in " \n\t\r" else "a" if c.isalpha() or c.isdigit() else "P"
    return "".join(kind(chr(k)) for k in range(256)).encode()


_KINDS = _kinds()


def cut_words(text: str) -> list[str]:
    """Words at white space; where every comma and full stop follows a letter or digit, these stand alone, and a text
    of Latin-1 is lower-cased first, so that fewer distinct words are left."""
    try:
        kinds = text.encode("latin-1").translate(_KINDS)
    except UnicodeEncodeError:
        pass
    else:
        if "<|" not in text:  # lower-casing could make a special token of such text
            text = text.lower()
        if b",," not in kinds and b"P," not in kinds:
            text = text.replace(", ", " , ").replace(". ", " . ").replace(".\n", " . ")
    return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")


_OPEN: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The worker's table for a tokenizer file; kept between tasks."""
    if path not in _OPEN:
        _OPEN[path] = WordIds(path)
    return _OPEN[path]
