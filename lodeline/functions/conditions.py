"""Conditions over fields, as a tree, as three-valued evaluation and as Spark columns.

The language has string literals, fields written $$name$ (quoted or not), == and !=, NOT, AND, OR and parentheses; NOT
binds before AND, AND before OR. Anything else makes the whole condition unsupported. An unknown value is SQL's NULL.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_LENGTH, MOST_TOKENS, MOST_DEPTH = 16384, 1024, 64
_PART = r"[\w-]+(?:\[(?:[0-9]+|A|C)\])?"
FIELD = re.compile(rf"!?{_PART}(?:\.{_PART})*")
_LEXEME = re.compile(r"""\s*(?:(?P<ref>\$\$[^$\r\n]+\$)|(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<op>==|!=|[()])|\b(?P<word>AND|OR|NOT)\b)""", re.I)


class Unsupported(ValueError):
    pass


def _operand(ref: str | None, quoted: str | None) -> tuple:
    if ref:
        name = ref[2:-1]
    else:
        body = quoted[1:-1]
        if "\\" in body:
            raise Unsupported("String escape semantics unknown")
        if "$" not in body:
            return ("literal", body)
        if not (body.startswith("$$") and body.endswith("$") and body.count("$") == 3):
            raise Unsupported("Interpolation semantics unknown")
        name = body[2:-1]
    if not FIELD.fullmatch(name):
        raise Unsupported("Unsupported field or function syntax")
    return ("field", name)


def _lexemes(text: str) -> list[tuple]:
    if len(text) > MOST_LENGTH:
        raise Unsupported("Expression limit exceeded")
    out: list[tuple] = []
    at = 0
    while text[at:].strip():
        m = _LEXEME.match(text, at)
        if m is None or len(out) >= MOST_TOKENS:
            raise Unsupported("Unsupported expression syntax")
        if m["ref"] or m["str"]:
            out.append(_operand(m["ref"], m["str"]))
        else:
            out.append(("sign", m["op"] or m["word"].upper()))
        at = m.end()
    return out


def parse(text: str) -> tuple:
    """The condition as nested tuples: (and|or|eq|ne, left, right), (not, x), (field, name), (literal, text)."""
    # Precedence climbing over an explicit position; an operand must be compared, so 'a' alone is no condition.
    items, at = _lexemes(text), 0

    def sign(*names: str) -> str | None:
        nonlocal at
        if at < len(items) and items[at][0] == "sign" and items[at][1] in names:
            at += 1
            return items[at - 1][1]
        return None

    def value() -> tuple:
        nonlocal at
        if at == len(items) or items[at][0] == "sign":
            raise Unsupported("Expected string or field")
        at += 1
        return items[at - 1]

    def climb(level: int, depth: int) -> tuple:
        if depth > MOST_DEPTH:
            raise Unsupported("Expression depth limit exceeded")
        if level < 2:
            joint = ("OR", "AND")[level]
            tree = climb(level + 1, depth)
            while sign(joint):
                tree = (joint.lower(), tree, climb(level + 1, depth))
            return tree
        if sign("NOT"):
            return ("not", climb(2, depth + 1))
        if sign("("):
            tree = climb(0, depth + 1)
            if not sign(")"):
                raise Unsupported("Missing closing parenthesis")
            return tree
        left, how = value(), sign("==", "!=")
        if how is None:
            raise Unsupported("Expected equality comparison")
        return ("eq" if how == "==" else "ne", left, value())

    tree = climb(0, 0)
    if at != len(items):
        raise Unsupported("Trailing expression syntax")
    return tree


def evaluate(tree: tuple, lookup: Callable[[str], str | None]):
    """True, False or None (unknown); values are strings, None where unknown."""
    match tree:
        case ("literal", text):
            return text
        case ("field", name):
            return lookup(name)
        case ("not", x):
            got = evaluate(x, lookup)
            return None if got is None else not got
    a, b = evaluate(tree[1], lookup), evaluate(tree[2], lookup)
    if tree[0] in ("and", "or"):
        deciding = tree[0] == "or"
        if a is deciding or b is deciding:
            return deciding
        return None if a is None or b is None else not deciding
    if a is None or b is None:
        return None
    return (a == b) == (tree[0] == "eq")


def column(tree: tuple, field: Callable[[str], Column]) -> Column:
    """The condition as a nullable boolean column; SQL's logic is the three-valued one."""
    kind = tree[0]
    if kind == "literal":
        return F.lit(tree[1])
    if kind == "field":
        return field(tree[1])
    if kind == "not":
        return ~column(tree[1], field)
    a, b = column(tree[1], field), column(tree[2], field)
    return {"and": lambda: a & b, "or": lambda: a | b, "eq": lambda: a == b, "ne": lambda: a != b}[kind]()
