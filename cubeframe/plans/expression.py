"""The expression language: text to a Spark Column.

Operators from loosest to tightest: ``OR |`` (also ``||``), ``AND &``, ``NOT !``, comparisons (``= != <> < <= > >=``), ``+ -``, ``* / % MOD``, unary minus. Arithmetic is in
doubles, ``%`` and logic in whole numbers (0 or 1); any number but 0 is true. Null follows SQL. An unknown character is an error.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import registry

_TOKEN = re.compile(r"\s*(?:(?P<number>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)|(?P<string>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<arg>\?\d*)|(?P<name>[A-Za-z_@][\w.@]*)|(?P<op>\|\||&&|<=|>=|<>|!=|[-+*/%=<>!&|(),]))")
_LEVELS = {"or": 1, "|": 1, "||": 1, "and": 2, "&": 2, "&&": 2, "=": 4, "!=": 4, "<>": 4, "<": 4, "<=": 4, ">": 4, ">=": 4, "+": 5, "-": 5, "*": 6, "/": 6, "%": 6, "mod": 6}
_NOT, _MINUS = 3, 7

Node = tuple


class ExpressionError(ValueError):
    """The text is no expression, or a name in it is unknown."""


def tokens(text: str) -> Iterator[tuple[str, str]]:
    at, text = 0, text.rstrip()
    while at < len(text):
        found = _TOKEN.match(text, at)
        if not found:
            raise ExpressionError(f"unexpected character {text[at:].lstrip()[:1]!r} in {text!r}")
        yield found.lastgroup, found[found.lastgroup]
        at = found.end()
    yield "end", ""


def parse(text: str) -> Node:
    """The syntax tree: ('num', v), ('str', s), ('null',), ('arg', i), ('name', n), ('call', name, args), ('op', sign, a, b), ('not', a), ('neg', a)."""
    found = list(tokens(text))
    at = bound = 0

    def peek() -> str:
        kind, value = found[at]
        return value.lower() if kind in ("op", "name") else ""

    def take(expected: str = "") -> tuple[str, str]:
        nonlocal at
        if expected and peek() != expected:
            raise ExpressionError(f"{expected!r} expected in {text!r}")
        at += 1
        return found[at - 1]

    def term() -> Node:
        nonlocal bound
        kind, value = take()
        if kind == "number":
            return ("num", float(value) if re.search(r"[.eE]", value) else int(value))
        if kind == "string":
            return ("str", re.sub(r"\\(.)", r"\1", value[1:-1]))
        if kind == "arg":
            bound += 1
            return ("arg", int(value[1:] or bound))
        if kind == "op" and value == "(":
            inner = level(1)
            take(")")
            return inner
        if kind == "op" and value == "-":
            return ("neg", level(_MINUS))
        if kind == "op" and value == "!" or kind == "name" and value.lower() == "not":
            return ("not", level(_NOT))
        if kind == "name":
            if value.lower() == "null":
                return ("null",)
            if peek() == "(" and found[at][0] == "op":
                take()
                args = []
                while peek() != ")":
                    args.append(level(1))
                    if peek() != ")":
                        take(",")
                take(")")
                return ("call", value, args)
            return ("name", value)
        raise ExpressionError(f"unexpected {value or 'end'!r} in {text!r}")

    def level(least: int) -> Node:
        left = term()
        while (sign := peek()) in _LEVELS and _LEVELS[sign] >= least:
            take()
            left = ("op", sign, left, level(_LEVELS[sign] + 1))
        return left

    tree = level(1)
    if found[at][0] != "end":
        raise ExpressionError(f"unexpected {found[at][1]!r} in {text!r}")
    return tree


def walk(node: Node) -> Iterator[Node]:
    yield node
    for part in node[1:]:
        for inner in part if isinstance(part, list) else [part]:
            if isinstance(inner, tuple):
                yield from walk(inner)


def variables(text: str) -> set[str]:
    """The names and the bound arguments of an expression."""
    return {n[1] if n[0] == "name" else f"?{n[1]}" for n in walk(parse(text)) if n[0] in ("name", "arg")}


def aggregates(node: Node) -> list[Node]:
    """The calls of aggregate primitives."""
    return [n for n in walk(node) if n[0] == "call" and registry.resolve(n[1]).kind in ("aggregate", "rows")]


def _number(x: Any) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("double")


def _true(x: Any) -> Column:
    return _number(x) != 0


def _flag(x: Column) -> Column:
    return x.cast("long")


_TESTS: dict[str, Callable[[Column, Column], Column]] = {
    "=": lambda x, y: x == y, "!=": lambda x, y: x != y, "<>": lambda x, y: x != y, "<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y,
}
_LOGIC = frozenset(["or", "|", "||", "and", "&", "&&", *_TESTS])


def truth(node: Node, lookup: Callable[[str], Column], args: list[Any] | None = None) -> Column:
    """A tree as a boolean: comparisons stand bare, in the types of their sides, so that they reach the scan; other values are true but for 0."""
    if node[0] == "not":
        return ~truth(node[1], lookup, args)
    if node[0] == "op" and node[1] in _LOGIC:
        if node[1] in _TESTS:
            x, y = (v if isinstance(v, Column) else F.lit(v) for v in (build(n, lookup, args) for n in node[2:]))
            return _TESTS[node[1]](x, y)
        x, y = (truth(n, lookup, args) for n in node[2:])
        return x | y if node[1] in ("or", "|", "||") else x & y
    if node[0] == "call" and registry.resolve(node[1]).name == "is_in_subset" and len(node[2]) == 4:
        key, start, step, stop = (build(n, lookup, args) for n in node[2])
        if isinstance(key, Column):
            return (registry.call(registry.resolve(node[1]), [key, start, step, stop]) == 1) & (key >= start) & (key <= stop)
    return _true(build(node, lookup, args))


def build(node: Node, lookup: Callable[[str], Column], args: list[Any] | None = None) -> Any:
    """The Column of a tree; literals stay Python values, for primitives that need them."""
    kind = node[0]
    if kind in ("num", "str"):
        return node[1]
    if kind == "null":
        return F.lit(None)
    if kind == "arg":
        if not args or node[1] > len(args):
            raise ExpressionError(f"no value is bound to ?{node[1]}")
        value = args[node[1] - 1]
        return F.array(*[F.lit(v) for v in value]) if isinstance(value, (list, tuple)) else value
    if kind == "name":
        try:
            return lookup(node[1])
        except KeyError:
            raise ExpressionError(f"unknown name {node[1]!r}") from None
    if kind == "call":
        return registry.call(registry.resolve(node[1]), [build(a, lookup, args) for a in node[2]])
    if kind == "neg":
        value = build(node[1], lookup, args)
        return -value if isinstance(value, (int, float)) else -_number(value)
    if kind == "not" or node[1] in _LOGIC:
        return _flag(truth(node, lookup, args))
    sign, a, b = node[1], build(node[2], lookup, args), build(node[3], lookup, args)
    if sign in ("%", "mod"):
        return F.try_mod(_number(a).cast("int"), _number(b).cast("int")).cast("long")
    x, y = _number(a), _number(b)
    return {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: F.try_divide(x, y)}[sign]()


def compile_expression(text: str, lookup: Callable[[str], Column], args: list[Any] | None = None) -> Column:
    found = build(parse(text), lookup, args)
    return found if isinstance(found, Column) else F.lit(found)


def condition(text: str, lookup: Callable[[str], Column], args: list[Any] | None = None) -> Column:
    """A WHERE expression: true where it is a number but 0."""
    return truth(parse(text), lookup, args)
