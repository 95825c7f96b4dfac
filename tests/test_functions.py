import itertools

import pytest

from lodeline.functions import conditions as C
from lodeline.functions import references as R
from lodeline.functions.templates import template


@pytest.mark.parametrize("a,b", list(itertools.product([True, False, None], repeat=2)))
def test_three_values(a, b):
    look = {"a": {True: "1", False: "0", None: None}[a], "b": {True: "1", False: "0", None: None}[b]}.get
    run = lambda s: C.evaluate(C.parse(s), look)
    both = False if False in (a, b) else None if None in (a, b) else True
    some = True if True in (a, b) else None if None in (a, b) else False
    assert run("$$a$ == '1' AND $$b$ == \"1\"") is both
    assert run("$$a$ == '1' or '$$b$' == '1'") is some
    assert run("NOT ($$a$ != '1')") is a


@pytest.mark.parametrize("bad", ["", "'a'", "$$a$", "$$a$ == ", "$$a$ == '\\n'", "$$a$ == 'x$y'", "($$a$ == '1'", "$$a$ == '1' '2'", "$$a.f()$ == '1'", "x > 1", "NOT" * 3, "(" * 70 + "$$a$ == '1'" + ")" * 70])
def test_unsupported_conditions_do_not_parse(bad):
    with pytest.raises(ValueError):
        C.parse(bad)


def test_precedence():
    assert C.parse("NOT $$a$ == '1' AND $$b$ == '2' OR $$c$ == '3'")[0] == "or"


def test_references():
    assert R.field_references("x $$A.B.trim()$ $$C[$$D.E$].F$ $$A.B$") == ["A.B", "D.E", "C[$$D.E$].F"]
    assert R.condition_references("$$A$ == 'No.t' AND Data.X[1].Y != \"q.r\" AND G.H.isEmpty()") == ["A", "Data.X[1].Y", "G.H"]
    assert R.shape("Data Store Root.A[1].B[C].") == "A.B"


@pytest.mark.parametrize("text,fields", [("$$a$$b$", ["a"]), ("$$a$$b$$", ["b", "a$$b$"]), ("$$$a$", ["a"]), ("$$$$a$$", ["a", "$$a$"]), ("$$$", []), ("$$a\nb$ $$c$", ["c"]), ("$$ a.b.up() $", ["a.b"]), ("$$a(1).b$", ["a(1).b"]), ("$$a.1(x).c(y)$", ["a.1(x)"]), ("", [])])
def test_reference_ends(text, fields):
    assert R.field_references(text) == fields


@pytest.mark.parametrize("text,fields", [("a.b", ["a.b"]), ("a", []), ("!a.b[$x].c", ["!a.b[$x].c"]), ("9a.b", ["a.b"]), ("a.b[", ["a.b"]), ("a.b[]", ["a.b"]), ("a[1.2.b", []), ("x.y.z (1)", ["x.y"]), ("x.f(1)", ["x"]), ("'a.b' \"c.d\" e.f", ["e.f"]), ("it's a.b", ["a.b"]), ("a.b.1", ["a.b"])])
def test_bare_paths(text, fields):
    assert R.condition_references(text) == fields


def test_declared_attributes():
    from lodeline.functions.partial import declared

    got = declared("AddToListRule", {"ListType": " Static ", "StaticListToAddTo": "L", "KeyType": "data item", "KeyPropertyName": " A.k ", "ValueType": "Value", "Value": "$$A.v$ $$A.k$", "GroupValueType": "Other", "ErrorCodeDataItem": "E.c", "ErrorMsgDataItem": "E.c"})
    assert got["reads"] == ["A.k", "A.v"] and got["writes"] == ["E.c"]
    assert got["evidence"] == {
        "rule_class": "AddToListRule", "list_target_is_datastore_write": False, "list_target": {"type": "static", "name": "L"}, "key_source": {"mode": "Data Item", "path": "A.k"},
        "value_source": {"mode": "Value", "template": "$$A.v$ $$A.k$", "template_dependencies": ["A.v", "A.k"]}, "error_outputs": ["E.c"],
    }
    assert declared("AddToListRule", {"ListType": "x"})["evidence"]["list_target"] == {"type": "unknown", "name": None}
    got = declared("CompareMultiListValuesRule", {"CurrentListValue": " A.c ", "ProcessEmpty": "Y"})
    assert got["reads"] == ["A.c"] and not got["writes"] and got["evidence"]["process_empty"] == "Y" and got["evidence"]["new_list_values"] is None
    got = declared("SetQuestionStatus", {"Question": "a, ,b", "ReadOnly": "", "Other": "1"})
    assert got["evidence"]["ui_targets"] == ["a", "b"] and got["evidence"]["status_flags"] == {"ReadOnly": ""} and not got["reads"]
    assert declared("SetValueRule", {}) is None


@pytest.mark.parametrize("a,b,yes", [("A.B", "A.B", True), ("A[1].B", "A[2].B", False), ("A[1].B", "A[C].B", True), ("A", "A.B", False), ("A.B", "A.Bc", False)])
def test_overlap(a, b, yes):
    f = lambda p, g=False: R.field("s", p, g)
    assert R.overlaps(f(a), f(b)) is R.overlaps(f(b), f(a)) is yes
    assert R.overlaps(f("A", True), f("A.B")) and not R.overlaps(f("A"), R.field("t", "A"))


def test_projection_keeps_instances_apart():
    f = lambda p, g=False: R.field("s", p, g)
    assert R.project(f("Src[A].X"), f("Dst[A].X"), f("Dst[2].X"))["path"] == "Src[2].X"
    assert R.project(f("Src[A].X"), f("Dst[1].X"), f("Dst[2].X"))["path"] == "Src[A].X"
    assert R.project(f("Src[1]", True), f("Dst[1]", True), f("Dst[1].A.B"))["path"] == "Src[1].A.B"


def test_templates():
    t = template("/a/$%IF x.k == '1'$b$%IF c.d$2$%ENDIF$$%ELSE$$$y$$%ENDIF$/z", variants=True)
    assert [v["template"] for v in t["variants"]] == ["/a/b2/z", "/a/b/z", "/a/$$y$/z"]
    assert {d["field"]: len(d["guards"]) for d in t["dependencies"]} == {"x.k": 0, "c.d": 1, "y": 1}
    for bad in ("$%IF$x$%ENDIF$", "$%IF a$x", "$%ELSE$", "$%ENDIF$", "$%IF a$1$%ELSE$2$%ELSE$3$%ENDIF$", "$%FOR x$"):
        t = template(bad + " $$q$", variants=True)
        assert t["status"] == "unresolved" and not t["tree"] and not t["variants"]
        assert {"field": "q", "role": "unresolved", "guards": []} in t["dependencies"]
    many = template("$%IF a$1$%ELSE$2$%ENDIF$" * 6, variants=True)
    assert many["status"] == "limit" and not many["variants"]
