"""Tags of markup-style bytes, with byte offsets, ordered attributes and errors as data.

Bytes become a string of code units (one per byte, or per two bytes of UTF-16), so one set of patterns serves every
encoding and an offset is an index times the unit. Comments, CDATA, instructions and declarations are skipped. A tag that
cannot be read is a row with an error, and reading goes on behind its name; a section that never ends is an error of the
file, as is an encoding whose delimiters are not ASCII.
"""

from __future__ import annotations

import codecs
import html
import re
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

MOST_VALUE = 1 << 20
MOST_NAME = 4096


class FileError(ValueError):
    pass


class UnsupportedEncoding(FileError):
    pass


@dataclass(frozen=True)
class Encoding:
    codec: str = "utf-8"
    unit: int = 1

    def units(self, content: bytes) -> str:
        if self.unit == 1:
            return content.decode("latin-1")
        # Each half of a surrogate pair is a unit of its own.
        flip = content if self.codec == "utf-16-le" else b"".join(content[k + 1 : k - 1 if k else None : -1] for k in range(0, len(content) - 1, 2))
        return "".join(map(chr, memoryview(flip[: len(flip) // 2 * 2]).cast("H")))

    def text(self, units: str) -> str:
        if self.unit == 1:
            return units if units.isascii() else units.encode("latin-1").decode(self.codec, "replace")
        return units.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")

    def code(self, text: str) -> str:
        """Text as it stands among the units."""
        return self.units(text.encode(self.codec))


def detect(content: bytes) -> Encoding:
    head = content[:512]
    if head[:4] in (b"\x00\x00\xfe\xff", b"\xff\xfe\x00\x00", b"<\x00\x00\x00", b"\x00\x00\x00<"):
        raise UnsupportedEncoding("UTF-32 is not supported")
    if head[:2] == b"\xff\xfe" or head[:2] == b"<\x00" and len(head) >= 4:
        return Encoding("utf-16-le", 2)
    if head[:2] == b"\xfe\xff" or head[:2] == b"\x00<" and len(head) >= 4:
        return Encoding("utf-16-be", 2)
    said = re.search(rb"encoding\s*=\s*['\"]([^'\"]+)", head[:256], re.I)
    if not said:
        return Encoding()
    name = said[1].decode("ascii", "replace")
    try:
        codec = codecs.lookup(name).name
    except LookupError as e:
        raise UnsupportedEncoding(f"Unsupported encoding {name!r}") from e
    if codec in ("utf-8", "utf-8-sig", "ascii"):
        return Encoding()
    if codec in ("utf-16", "utf-16-le", "utf-16-be"):
        return Encoding("utf-16-be" if codec.endswith("be") else "utf-16-le", 2)
    if "<Rule>".encode(codec) != b"<Rule>":
        raise UnsupportedEncoding(f"Encoding {name!r} has delimiters that are not ASCII")
    return Encoding(codec)


@dataclass
class Tag:
    name: str
    start: int
    end: int
    line: int
    is_end: bool = False
    self_closing: bool = False
    attributes: list[tuple[str, str]] = field(default_factory=list)
    truncated: list[tuple[str, int]] = field(default_factory=list)
    duplicates: list[str] = field(default_factory=list)
    hits: list[str] = field(default_factory=list)
    error: str | None = None

    def bag(self) -> dict[str, str]:
        """Attributes by name, in order of first sight with the last value."""
        return dict(self.attributes)


_OPEN = re.compile(r"<(?:(!--)|(!\[CDATA\[)|(\?)|(!)|(/?[^\s!?><][^ \t\r\n/>]*))")
_ENDS = {1: ("-->", "comment"), 2: ("]]>", "cdata"), 3: ("?>", "pi")}
_DECLARED = re.compile(r"\"[^\"]*\"|'[^']*'|[\[\]>]")
_ATTRIBUTE = re.compile(r"[ \t\r\n/]*([^ \t\r\n/>=<\"'][^ \t\r\n/>=]*)[ \t\r\n]*=[ \t\r\n]*(?:\"([^\"<]*)\"|'([^'<]*)')")
_CLOSE = re.compile(r"[ \t\r\n/]*>")
_SKIP = re.compile(r"(?:[^\"'<>]|\"[^\"<]*\"|'[^'<]*')*")


def _section_end(units: str, m: re.Match) -> int:
    """Behind a comment, CDATA section, instruction or declaration."""
    kind = m.lastindex
    if kind in _ENDS:
        mark, name = _ENDS[kind]
        at = units.find(mark, m.end())
        if at < 0:
            raise FileError(f"Unclosed {name} section")
        return at + len(mark)
    depth = 0
    for t in _DECLARED.finditer(units, m.end()):
        if t[0] == ">" and not depth:
            return t.end()
        depth = max(0, depth + (t[0] == "[") - (t[0] == "]"))
    raise FileError("Unclosed declaration section")


def tags(
    content: bytes,
    *,
    names: Iterable[str] | None = None,
    wanted: Callable[[str], bool] = lambda _: True,
    references: tuple[str, ...] = (),
    ignore_case: bool = False,
    most_value: int = MOST_VALUE,
) -> Iterator[Tag]:
    """Tags in order. names: read only these (exact); wanted: keep only these attributes.

    references: texts to look for in start tags; a tag that holds some lists them in `hits`, in the order they are found,
    and keeps the attributes that hold them though not wanted. Letters are folded within ASCII alone.
    """
    enc = detect(content)
    units = enc.units(content)
    only = {enc.code(n) for n in names} if names is not None else None
    low = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s) if ignore_case else s
    sought = [(low(enc.code(r)), r) for r in references]
    breaks = [m.start() for m in re.finditer("\n", units)]
    at = 0
    while m := _OPEN.search(units, at):
        if m.lastindex != 5:
            at = _section_end(units, m)
            continue
        raw = m[5]
        is_end, name = raw.startswith("/"), raw.removeprefix("/")[:MOST_NAME]
        at = m.end()
        if only is not None and name not in only:
            continue
        start = m.start()
        tag = Tag(enc.text(name), start * enc.unit, 0, 1 + bisect_left(breaks, start), is_end)
        stop = _SKIP.match(units, m.end()).end()
        closed = units[stop : stop + 1] == ">"
        end = stop + 1 if closed else stop
        tag.end = end * enc.unit
        if not closed:
            tag.error = "Tag reaches the end of the file" if stop >= len(units) else f"Unclosed tag or '<' in an attribute at byte {tag.start}"
        elif not is_end:
            tag.self_closing = units[start:stop].rstrip().endswith("/")
            body = low(units[start:end]) if sought else ""
            tag.hits = [r for p, r in sorted((body.find(u), r) for u, r in sought) if p >= 0]
            _read(units, m.end(), end, enc, tag, wanted, [u for u, _ in sought] if tag.hits else [], low, most_value)
        yield tag
        # Behind a tag that cannot be read its own text is searched on, so that tags in it are found.
        at = m.end() if tag.error and not closed else end


def loose(content: bytes, references: tuple[str, ...], ignore_case: bool = False) -> list[tuple[int, str]]:
    """(byte offset, reference) of references that stand before any tag, where none can hold them."""
    enc = detect(content)
    units = enc.units(content)
    head = units.partition("<")[0]
    low = (lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)) if ignore_case else (lambda s: s)
    head, out, at = low(head), [], 0
    sought = [(low(enc.code(r)), r) for r in references]
    while found := min(((p, -len(u), r) for u, r in sought if (p := head.find(u, at)) >= 0), default=None):
        out.append((found[0] * enc.unit, found[2]))
        at = found[0] - found[1]
    return out


def _read(units, at, end, enc, tag, wanted, sought, low, most_value) -> None:
    seen: set[str] = set()
    while not _CLOSE.fullmatch(units, at, end):
        m = _ATTRIBUTE.match(units, at, end)
        if m is None:
            tag.error = f"Malformed attribute at byte {at * enc.unit}"
            return
        at = m.end()
        name, value = enc.text(m[1][:MOST_NAME]), m[2] if m[2] is not None else m[3]
        keep = wanted(name)
        if not keep:
            places = [p for u in sought if (p := low(value).find(u)) >= 0]
            if not places:
                continue
            value = value[min(places) :]
        size = len(m[2] if m[2] is not None else m[3]) * enc.unit
        shown = html.unescape(enc.text(value[: most_value // enc.unit]))
        if not keep:
            shown = "…" + shown
        if size > most_value:
            tag.truncated.append((name, size))
            shown += f" … [TRUNCATED observed_bytes={size} tag_offset={tag.start} attribute={name}]"
        if name in seen:
            tag.duplicates.append(name)
        seen.add(name)
        tag.attributes.append((name, shown))


_EID = re.compile(r"(?i)\beid\s*=\s*([\"'])(.*?)\1", re.S)


def eids(content: bytes) -> set[str]:
    """Values of eid attributes, comments included: candidates that a reader must confirm."""
    text = content.decode(detect(content).codec, "replace")
    return {html.unescape(m[2]) for m in _EID.finditer(text)} - {""}
