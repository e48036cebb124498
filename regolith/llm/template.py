"""A small sandboxed template language, compiled to Python closures.

    {{ expression }}        output
    {% for x in xs %} ... {% endfor %}
    {% if e %} ... {% elif e %} ... {% else %} ... {% endif %}
    {% generation %} ... {% endgeneration %}   what stands inside is to be learned

Expressions know string and integer literals, true, false, none, names,
`a.b` and `a['b']` on mappings, ==, !=, in, not, and, or, `~` (joins texts),
filters (`x | upper`) and parentheses.  In a loop, loop.index0, loop.first and
loop.last are known.  Nothing else can be reached: no calls, no Python
attributes, only the filters that the compiler was given.

The source is parsed to a syntax tree, constant parts are folded (literals
through operators and filters, branches whose condition is constant, runs of
text), and each node becomes a closure.  Rendering is lazy: it yields
(text, to be learned) pieces, and a loop takes one item ahead of the one it
renders, so a conversation of any length streams through.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass


class TemplateError(ValueError):
    pass


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Item:
    of: object
    key: object


@dataclass(frozen=True)
class Op:
    kind: str
    parts: tuple


@dataclass(frozen=True)
class Filter:
    name: str
    of: object


@dataclass(frozen=True)
class Output:
    of: object


@dataclass(frozen=True)
class For:
    name: str
    over: object
    body: tuple


@dataclass(frozen=True)
class If:
    branches: tuple  # (condition, body); the condition of else is Const(True)


@dataclass(frozen=True)
class Generation:
    body: tuple


_PIECE = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)
_TOKEN = re.compile(r"""\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|[.\[\]()|~]))""")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


def _tokens(source: str) -> list[tuple[str, str]]:
    out, at = [], 0
    source = source.strip()
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"cannot read {source[at:]!r}")
        out.append((m.lastgroup, m.group(m.lastgroup)))
        at = m.end()
    return [*out, ("end", "")]


class _Expression:
    """Recursive descent over the tokens of one expression."""

    def __init__(self, source: str):
        self.tokens, self.at = _tokens(source), 0

    def whole(self):
        e = self.either()
        if self.tokens[self.at][0] != "end":
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return e

    def _take(self, *values: str) -> str | None:
        kind, value = self.tokens[self.at]
        if kind in ("op", "name") and value in values:
            self.at += 1
            return value
        return None

    def _need(self, value: str) -> None:
        if not self._take(value):
            raise TemplateError(f"{value!r} is missing")

    def either(self):
        e = self.both()
        while self._take("or"):
            e = Op("or", (e, self.both()))
        return e

    def both(self):
        e = self.negated()
        while self._take("and"):
            e = Op("and", (e, self.negated()))
        return e

    def negated(self):
        return Op("not", (self.negated(),)) if self._take("not") else self.compared()

    def compared(self):
        e = self.joined()
        while kind := self._take("==", "!=", "in"):
            e = Op(kind, (e, self.joined()))
        return e

    def joined(self):
        e = self.filtered()
        while self._take("~"):
            e = Op("~", (e, self.filtered()))
        return e

    def filtered(self):
        e = self.reached()
        while self._take("|"):
            e = Filter(self._name(), e)
        return e

    def reached(self):
        e = self.atom()
        while True:
            if self._take("."):
                e = Item(e, Const(self._name()))
            elif self._take("["):
                e = Item(e, self.either())
                self._need("]")
            else:
                return e

    def _name(self) -> str:
        kind, value = self.tokens[self.at]
        if kind != "name" or value.startswith("_"):
            raise TemplateError(f"no name: {value!r}")
        self.at += 1
        return value

    def atom(self):
        kind, value = self.tokens[self.at]
        if kind == "str":
            self.at += 1
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "int":
            self.at += 1
            return Const(int(value))
        if self._take("("):
            e = self.either()
            self._need(")")
            return e
        name = self._name()
        return Const({"true": True, "false": False, "none": None}[name]) if name in ("true", "false", "none") else Name(name)


def parse(source: str) -> tuple:
    """The syntax tree of a template."""
    stack: list[tuple[str, object, list]] = [("", None, [])]
    at = 0
    for m in _PIECE.finditer(source):
        if m.start() > at:
            stack[-1][2].append(Output(Const(source[at : m.start()])))
        at = m.end()
        if m[1] is not None:
            stack[-1][2].append(Output(_Expression(m[1]).whole()))
            continue
        word, _, rest = m[2].strip().partition(" ")
        if word == "for":
            head = re.fullmatch(r"\s*([A-Za-z]\w*)\s+in\s+(.*)", rest, re.S)
            if not head:
                raise TemplateError(f"cannot read for {rest}")
            stack.append(("for", (head[1], _Expression(head[2]).whole()), []))
        elif word == "if":
            stack.append(("if", [(_Expression(rest).whole(), body := [])], body))
        elif word in ("elif", "else"):
            if stack[-1][0] != "if":
                raise TemplateError(f"{word} without if")
            branches = stack[-1][1]
            branches.append((_Expression(rest).whole() if word == "elif" else Const(True), body := []))
            stack[-1] = ("if", branches, body)
        elif word == "generation":
            stack.append(("generation", None, []))
        elif word in ("endfor", "endif", "endgeneration"):
            kind, head, body = stack.pop()
            if kind != word[3:]:
                raise TemplateError(f"{word} without {word[3:]}")
            node = For(*head, tuple(body)) if kind == "for" else If(tuple((c, tuple(b)) for c, b in head)) if kind == "if" else Generation(tuple(body))
            stack[-1][2].append(node)
        else:
            raise TemplateError(f"unknown statement {word!r}")
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} is not ended")
    if at < len(source):
        stack[-1][2].append(Output(Const(source[at:])))
    return tuple(stack[0][2])


_OPS: dict[str, Callable] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "in": lambda a, b: a in b if b is not None else False,
    "~": lambda a, b: _text(a) + _text(b),
    "and": lambda a, b: a and b,
    "or": lambda a, b: a or b,
    "not": lambda a: not a,
}


def _text(value: object) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


def fold(node, filters: Mapping[str, Callable]):
    """The same tree with constant parts computed."""
    if isinstance(node, tuple):
        out: list = []
        for part in (fold(n, filters) for n in node):
            for one in part if isinstance(part, tuple) else (part,):
                if isinstance(one, Output) and isinstance(one.of, Const):
                    text = _text(one.of.value)
                    if not text:
                        continue
                    if out and isinstance(out[-1], Output) and isinstance(out[-1].of, Const):
                        out[-1] = Output(Const(out[-1].of.value + text))
                        continue
                    one = Output(Const(text))
                out.append(one)
        return tuple(out)
    if isinstance(node, Item):
        return Item(fold(node.of, filters), fold(node.key, filters))
    if isinstance(node, Op):
        parts = tuple(fold(p, filters) for p in node.parts)
        return Const(_OPS[node.kind](*(p.value for p in parts))) if all(isinstance(p, Const) for p in parts) else Op(node.kind, parts)
    if isinstance(node, Filter):
        if node.name not in filters:
            raise TemplateError(f"unknown filter {node.name!r}")
        of = fold(node.of, filters)
        return Const(filters[node.name](_text(of.value))) if isinstance(of, Const) else Filter(node.name, of)
    if isinstance(node, Output):
        return Output(fold(node.of, filters))
    if isinstance(node, For):
        return For(node.name, fold(node.over, filters), fold(node.body, filters))
    if isinstance(node, Generation):
        return Generation(fold(node.body, filters))
    if isinstance(node, If):
        branches = []
        for condition, body in node.branches:
            condition, body = fold(condition, filters), fold(body, filters)
            if isinstance(condition, Const):
                if condition.value:
                    branches.append((Const(True), body))
                    break
                continue
            branches.append((condition, body))
        if branches and isinstance(branches[0][0], Const):
            return branches[0][1]
        return If(tuple(branches)) if branches else ()
    return node


def _value(node, filters) -> Callable[[dict], object]:
    if isinstance(node, Const):
        value = node.value
        return lambda scope: value
    if isinstance(node, Name):
        name = node.name
        return lambda scope: scope.get(name)
    if isinstance(node, Item):
        of, key = _value(node.of, filters), _value(node.key, filters)

        def item(scope):
            value = of(scope)
            return value.get(key(scope)) if isinstance(value, Mapping) else None

        return item
    if isinstance(node, Filter):
        of, apply = _value(node.of, filters), filters[node.name]
        return lambda scope: apply(_text(of(scope)))
    parts, kind = [_value(p, filters) for p in node.parts], node.kind
    if kind == "and":
        return lambda scope: parts[0](scope) and parts[1](scope)
    if kind == "or":
        return lambda scope: parts[0](scope) or parts[1](scope)
    op = _OPS[kind]
    return lambda scope: op(*(p(scope) for p in parts))


Piece = tuple[str, bool]


def _render(node, filters, learned: bool) -> Callable[[dict], Iterator[Piece]]:
    if isinstance(node, tuple):
        parts = [_render(n, filters, learned) for n in node]

        def block(scope):
            for part in parts:
                yield from part(scope)

        return block
    if isinstance(node, Output):
        if isinstance(node.of, Const):
            piece = (node.of.value, learned)
            return lambda scope: iter((piece,))
        of = _value(node.of, filters)
        return lambda scope: iter(((_text(of(scope)), learned),))
    if isinstance(node, Generation):
        return _render(node.body, filters, True)
    if isinstance(node, If):
        branches = [(_value(c, filters), _render(b, filters, learned)) for c, b in node.branches]

        def choose(scope):
            for condition, body in branches:
                if condition(scope):
                    yield from body(scope)
                    return

        return choose
    over, body, name = _value(node.over, filters), _render(node.body, filters, learned), node.name

    def loop(scope):
        nothing = object()
        items = iter(over(scope) or ())
        ahead, k = next(items, nothing), 0
        while ahead is not nothing:
            now, ahead = ahead, next(items, nothing)
            yield from body({**scope, name: now, "loop": {"index0": k, "first": k == 0, "last": ahead is nothing}})
            k += 1

    return loop


def compile_template(source: str, filters: Mapping[str, Callable[[str], str]]) -> Callable[[Mapping[str, Iterable]], Iterator[Piece]]:
    """A function from variables to pieces of text, each with whether it is to be learned."""
    render = _render(fold(parse(source), filters), filters, False)
    return lambda variables: render(dict(variables))
