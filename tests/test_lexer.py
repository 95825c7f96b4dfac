import pytest

from lodeline.sources import lexer
from lodeline.sources.lexer import FileError, UnsupportedEncoding, tags

TEXT = """<?xml version="1.0"?><!DOCTYPE a [<!ENTITY x "]>">]><!-- <Rule a="1"> --><R><![CDATA[<Rule/>]]>
<Rule Name="A &amp; ä" x='2' Name="B"/><Rule z="1<2"><Rule ok="😀" ></Rule></R>"""


@pytest.mark.parametrize("codec", ["utf-8", "utf-16-le", "utf-16-be"])
def test_offsets_are_bytes_in_any_encoding(codec):
    mark = {"utf-16-le": b"\xff\xfe", "utf-16-be": b"\xfe\xff"}.get(codec, b"")
    data = mark + TEXT.encode(codec)
    found = list(tags(data))
    assert [(t.name, t.is_end) for t in found if t.name in ("R", "Rule")] == [("R", False), ("Rule", False), ("Rule", False), ("Rule", False), ("Rule", True), ("R", True)]
    for t in found:
        if not t.error:
            text = data[t.start : t.end].decode(codec)
            assert text[0] == "<" and text[-1] == ">"
    rule = found[1]
    assert rule.self_closing and rule.line == 2
    assert rule.bag() == {"Name": "B", "x": "2"} and rule.duplicates == ["Name"]
    assert found[2].error and [t.bag() for t in found if t.name == "Rule" and not t.is_end][2] == {"ok": "😀"}


def test_declared_codec_and_rejected_ones():
    assert next(tags('<a b="é" encoding="latin-1"/>'.encode("latin-1"))).bag()["b"] == "é"
    for head in (b"\x00\x00\xfe\xff", b"\xff\xfe\x00\x00", b'<?xml encoding="cp037"?>', b'<?xml encoding="nope"?>'):
        with pytest.raises(UnsupportedEncoding):
            list(tags(head + b"<a/>"))


@pytest.mark.parametrize("text", ["<a><!-- x", "<a><![CDATA[ x", "<a><? x", "<!DOCTYPE a [ <b/>"])
def test_a_section_without_end_is_an_error_of_the_file(text):
    with pytest.raises(FileError):
        list(tags(text.encode()))


@pytest.mark.parametrize("bad", ["x=1", "x", "x = ", "x='1"])
def test_a_malformed_attribute_is_an_error_of_the_tag(bad):
    found = list(tags(f"<r><Rule {bad}><Rule y='1'/></r>".encode()))
    assert found[1].name == "Rule" and found[1].error
    assert any(t.bag() == {"y": "1"} for t in found)


def test_values_are_cut_and_references_found():
    t = next(tags(b'<Rule a="' + b"x" * 100 + b'" other="zz REF" />', wanted=lambda n: n == "a", references=("ref", "zz"), ignore_case=True, most_value=16))
    assert t.truncated == [("a", 100)] and t.bag()["a"].startswith("x" * 16 + " …")
    assert t.hits == ["zz", "ref"] and t.bag()["other"] == "…zz REF"


def test_eids_are_candidates():
    assert lexer.eids(b"<a eid='1'/><!-- EID = \"2&amp;\" --><b xeid='3' eid=''/>") == {"1", "2&"}
