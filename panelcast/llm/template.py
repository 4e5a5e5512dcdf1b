"""A small sandboxed template language for chat formats, compiled to Python closures.

    {{ expr }}                                    output
    {% for m in messages %}..{% endfor %}         loop (loop.first, loop.last, loop.index)
    {% if expr %}..{% elif expr %}..{% else %}..{% endif %}
    {% set name = expr %}
    {% generation %}..{% endgeneration %}         marks output that the model should learn

Expressions: strings, integers, true/false/none, names, ``x.field`` and ``x['field']``, ``+``,
``~`` (join as text), ``== != < <= > >= in``, ``and or not``, and the filters ``|escape``, ``|trim``,
``|upper``, ``|lower``, ``|length``.  A template reaches nothing but its variables: fields are
dictionary keys, there are no calls, and names that start with an underscore are refused.

The source is parsed into a syntax tree, constants are folded (constant outputs become text,
neighbouring texts join, decided branches go), and each node becomes a closure.  A compiled
template yields (text, generated) pieces lazily and reads a loop's messages one ahead, so
a conversation of any length renders in the memory of two messages.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any


class TemplateError(ValueError):
    pass


# Syntax tree


@dataclass
class Const:
    value: Any


@dataclass
class Name:
    name: str


@dataclass
class Field:
    of: Any
    key: Any


@dataclass
class Binary:
    op: str
    left: Any
    right: Any


@dataclass
class Not:
    of: Any


@dataclass
class Filter:
    of: Any
    name: str


@dataclass
class Text:
    text: str


@dataclass
class Output:
    expr: Any


@dataclass
class For:
    name: str
    over: Any
    body: list


@dataclass
class If:
    branches: list  # (condition, body)
    other: list = field(default_factory=list)


@dataclass
class Set:
    name: str
    expr: Any


@dataclass
class Generation:
    body: list


def as_text(x: Any) -> str:
    return "" if x is None else str(x)


BINARY: dict[str, Callable] = {
    "==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge,
    "+": operator.add, "~": lambda a, b: as_text(a) + as_text(b), "in": lambda a, b: a in b,
    "and": lambda a, b: a and b, "or": lambda a, b: a or b,
}

_TAG = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)
_TOKEN = re.compile(r"\s*(?:(\d+)|([A-Za-z_]\w*)|('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(==|!=|<=|>=|[<>+~|.\[\]()]))")
_ESCAPES = {"n": "\n", "t": "\t", "\\": "\\", "'": "'", '"': '"'}
_FIXED = {"true": True, "false": False, "none": None}


class _Expressions:
    """Recursive descent over one expression's tokens."""

    def __init__(self, source: str) -> None:
        self.tokens, at, source = [], 0, source.rstrip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:]!r}")
            self.tokens.append(m)
            at = m.end()
        self.at = 0

    def peek(self) -> str:
        return self.tokens[self.at].group(0).strip() if self.at < len(self.tokens) else ""

    def take(self, want: str | None = None) -> re.Match:
        if self.at >= len(self.tokens) or want not in (None, self.peek()):
            raise TemplateError(f"expected {want or 'more'}, found {self.peek() or 'the end'!r}")
        self.at += 1
        return self.tokens[self.at - 1]

    def whole(self) -> Any:
        out = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.peek()!r}")
        return out

    def _chain(self, ops: tuple[str, ...], below: Callable) -> Any:
        out = below()
        while self.peek() in ops:
            op = self.take().group(0).strip()
            out = Binary(op, out, below())
        return out

    def either(self) -> Any:
        return self._chain(("or",), lambda: self._chain(("and",), self.negated))

    def negated(self) -> Any:
        if self.peek() == "not":
            self.take()
            return Not(self.negated())
        return self._chain(("==", "!=", "<", "<=", ">", ">=", "in"), lambda: self._chain(("+", "~"), self.filtered))

    def filtered(self) -> Any:
        out = self.reference()
        while self.peek() == "|":
            self.take()
            name = self.take().group(2)
            if not name:
                raise TemplateError("a filter needs a name")
            out = Filter(out, name)
        return out

    def reference(self) -> Any:
        out = self.atom()
        while self.peek() in (".", "["):
            if self.take().group(0).strip() == ".":
                name = self.take().group(2)
                out = Field(out, Const(safe_name(name or "")))
            else:
                out = Field(out, self.either())
                self.take("]")
        return out

    def atom(self) -> Any:
        m = self.take()
        number, name, text, sign = m.groups()
        if number:
            return Const(int(number))
        if text:
            return Const(re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], e[0]), text[1:-1], flags=re.S))
        if name:
            return Const(_FIXED[name]) if name in _FIXED else Name(safe_name(name))
        if sign == "(":
            out = self.either()
            self.take(")")
            return out
        raise TemplateError(f"unexpected {sign!r}")


def safe_name(name: str) -> str:
    if not re.fullmatch(r"[A-Za-z]\w*", name):
        raise TemplateError(f"name {name!r} is not allowed")
    return name


def parse(source: str) -> list:
    """The template's syntax tree."""
    root: list = []
    open_blocks: list[tuple[str, Any]] = []
    body, at = root, 0
    for m in _TAG.finditer(source):
        if m.start() > at:
            body.append(Text(source[at:m.start()]))
        at = m.end()
        if m[1] is not None:
            body.append(Output(_Expressions(m[1]).whole()))
            continue
        word, _, rest = m[2].strip().partition(" ")
        if word == "for":
            f = re.fullmatch(r"(\w+)\s+in\s+(.+)", rest.strip(), re.S)
            if not f:
                raise TemplateError(f"cannot read the loop {rest!r}")
            node = For(safe_name(f[1]), _Expressions(f[2]).whole(), [])
            body.append(node)
            open_blocks.append(("endfor", body))
            body = node.body
        elif word == "if":
            node = If([(_Expressions(rest).whole(), [])])
            body.append(node)
            open_blocks.append(("endif", body))
            body = node.branches[0][1]
        elif word in ("elif", "else"):
            if not open_blocks or open_blocks[-1][0] != "endif":
                raise TemplateError(f"{word} without if")
            node = open_blocks[-1][1][-1]
            if word == "elif":
                node.branches.append((_Expressions(rest).whole(), []))
                body = node.branches[-1][1]
            else:
                body = node.other
        elif word == "set":
            name, eq, expr = rest.partition("=")
            if not eq:
                raise TemplateError(f"cannot read set {rest!r}")
            body.append(Set(safe_name(name.strip()), _Expressions(expr).whole()))
        elif word == "generation":
            node = Generation([])
            body.append(node)
            open_blocks.append(("endgeneration", body))
            body = node.body
        elif open_blocks and word == open_blocks[-1][0]:
            body = open_blocks.pop()[1]
        else:
            raise TemplateError(f"unexpected tag {word!r}")
    if open_blocks:
        raise TemplateError(f"missing {open_blocks[-1][0]}")
    if at < len(source):
        body.append(Text(source[at:]))
    return root


def fold_expr(e: Any, filters: dict[str, Callable]) -> Any:
    if isinstance(e, Binary):
        left, right = fold_expr(e.left, filters), fold_expr(e.right, filters)
        if isinstance(left, Const) and isinstance(right, Const):
            return Const(BINARY[e.op](left.value, right.value))
        if e.op in ("and", "or") and isinstance(left, Const):
            return right if bool(left.value) == (e.op == "and") else left
        return Binary(e.op, left, right)
    if isinstance(e, Not):
        of = fold_expr(e.of, filters)
        return Const(not of.value) if isinstance(of, Const) else Not(of)
    if isinstance(e, Filter):
        of = fold_expr(e.of, filters)
        if e.name not in filters:
            raise TemplateError(f"no filter {e.name!r}")
        return Const(filters[e.name](of.value)) if isinstance(of, Const) else Filter(of, e.name)
    if isinstance(e, Field):
        return Field(fold_expr(e.of, filters), fold_expr(e.key, filters))
    return e


def fold(body: list, filters: dict[str, Callable]) -> list:
    """Constants folded, texts joined, branches that are decided taken."""
    out: list = []
    for node in body:
        if isinstance(node, Output):
            e = fold_expr(node.expr, filters)
            made = [Text(as_text(e.value))] if isinstance(e, Const) else [Output(e)]
        elif isinstance(node, For):
            made = [For(node.name, fold_expr(node.over, filters), fold(node.body, filters))]
        elif isinstance(node, Set):
            made = [Set(node.name, fold_expr(node.expr, filters))]
        elif isinstance(node, Generation):
            made = [Generation(fold(node.body, filters))]
        elif isinstance(node, If):
            left, other = [], fold(node.other, filters)
            for cond, part in node.branches:
                cond = fold_expr(cond, filters)
                if isinstance(cond, Const):
                    if cond.value:
                        other = fold(part, filters)
                        break
                    continue
                left.append((cond, fold(part, filters)))
            made = [If(left, other)] if left else other
        else:
            made = [node]
        for n in made:
            if isinstance(n, Text) and out and isinstance(out[-1], Text):
                out[-1] = Text(out[-1].text + n.text)
            elif not (isinstance(n, Text) and not n.text):
                out.append(n)
    return out


Env = dict[str, Any]
Piece = tuple[str, bool]


def _expr(e: Any, filters: dict[str, Callable]) -> Callable[[Env], Any]:
    if isinstance(e, Const):
        return lambda env: e.value
    if isinstance(e, Name):
        return lambda env: env.get(e.name)
    if isinstance(e, Field):
        of, key = _expr(e.of, filters), _expr(e.key, filters)

        def get(env: Env) -> Any:
            x = of(env)
            return x.get(key(env)) if isinstance(x, dict) else None
        return get
    if isinstance(e, Not):
        of = _expr(e.of, filters)
        return lambda env: not of(env)
    if isinstance(e, Filter):
        of, f = _expr(e.of, filters), filters[e.name]
        return lambda env: f(of(env))
    left, right, op = _expr(e.left, filters), _expr(e.right, filters), BINARY[e.op]
    if e.op == "and":
        return lambda env: left(env) and right(env)
    if e.op == "or":
        return lambda env: left(env) or right(env)
    return lambda env: op(left(env), right(env))


def _one_ahead(items: Iterable) -> Iterator[tuple[Any, bool]]:
    it = iter(items)
    for item in it:
        break
    else:
        return
    for following in it:
        yield item, False
        item = following
    yield item, True


def _body(body: list, filters: dict[str, Callable], generated: bool) -> Callable[[Env], Iterator[Piece]]:
    parts = [_node(n, filters, generated) for n in body]

    def run(env: Env) -> Iterator[Piece]:
        for part in parts:
            yield from part(env)
    return run


def _node(n: Any, filters: dict[str, Callable], generated: bool) -> Callable[[Env], Iterator[Piece]]:
    if isinstance(n, Text):
        piece = [(n.text, generated)]
        return lambda env: iter(piece)
    if isinstance(n, Output):
        value = _expr(n.expr, filters)
        return lambda env: iter([(as_text(value(env)), generated)])
    if isinstance(n, Generation):
        return _body(n.body, filters, True)
    if isinstance(n, Set):
        value = _expr(n.expr, filters)

        def assign(env: Env) -> Iterator[Piece]:
            env[n.name] = value(env)
            return iter(())
        return assign
    if isinstance(n, If):
        branches = [(_expr(c, filters), _body(b, filters, generated)) for c, b in n.branches]
        other = _body(n.other, filters, generated)

        def choose(env: Env) -> Iterator[Piece]:
            return next((b for c, b in branches if c(env)), other)(env)
        return choose
    over, inner = _expr(n.over, filters), _body(n.body, filters, generated)

    def loop(env: Env) -> Iterator[Piece]:
        outer = env.get("loop")
        for i, (item, last) in enumerate(_one_ahead(over(env) or ())):
            env[n.name] = item
            env["loop"] = {"first": i == 0, "last": last, "index": i + 1}
            yield from inner(env)
        env["loop"] = outer
    return loop


def compile_template(source: str, escape: Callable[[str], str] = lambda s: s) -> Callable[..., Iterator[Piece]]:
    """A function of the template's variables that yields (text, generated) pieces."""
    filters = {"escape": lambda x: escape(as_text(x)), "trim": lambda x: as_text(x).strip(),
               "upper": lambda x: as_text(x).upper(), "lower": lambda x: as_text(x).lower(), "length": len}
    run = _body(fold(parse(source), filters), filters, False)
    return lambda **variables: run(dict(variables))
