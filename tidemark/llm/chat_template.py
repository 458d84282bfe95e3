"""A small sandboxed template language, compiled to Python closures.

``{{ expression }}`` prints; ``{% for x in list %}``, ``{% if %}/{% elif %}/{% else %}`` and ``{% generation %}`` end
with ``{% end… %}``; what stands inside ``generation`` is text to be learned. Expressions have strings, whole numbers,
names, dotted fields of mappings, ``+`` or ``~`` (concatenation), ``==``, ``!=``, ``in``, ``not``, ``and``, ``or``,
brackets and filters (``x | name``) from a fixed table. There are no calls, no attributes of Python objects, no item
access and no imports, so a template reaches only what it is given.

``parse`` makes a tree of tuples, ``fold`` evaluates what holds no name, and ``compile_template`` turns the tree into
closures that yield ``(text, learned)`` pieces. Lists are walked lazily: a conversation of any length streams through.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from .chat_escape import escape

Piece = tuple[str, bool]

FILTERS: dict[str, Callable[[str], str]] = {
    "escape": escape,
    "lower": str.lower,
    "upper": str.upper,
    "capitalize": lambda s: s[:1].upper() + s[1:],
    "strip": str.strip,
}
_TAG = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)
_TOKEN = re.compile(r"\s*(?:(\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*')|(\d+)|([A-Za-z_]\w*)|(==|!=|[|.+~()]))")
_ESCAPES = {"n": "\n", "t": "\t"}


class TemplateError(ValueError):
    """The template isn't well formed, or asks for what the language doesn't have."""


def _tokens(source: str) -> list[tuple[str, object]]:
    out, at = [], 0
    source = source.rstrip()
    while at < len(source):
        if not (m := _TOKEN.match(source, at)):
            raise TemplateError(f"unexpected {source[at:at + 10]!r}")
        text, number, name, sign = m.groups()
        if text is not None:
            out.append(("text", re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], e[1]), text[1:-1], flags=re.S)))
        elif number is not None:
            out.append(("text", int(number)))
        elif name is not None:
            out.append(("word" if name in ("not", "and", "or", "in") else "name", name))
        else:
            out.append(("sign", sign))
        at = m.end()
    return out


class _Expression:
    """Recursive descent over or, and, not, comparison, concatenation, filters, atoms."""

    def __init__(self, source: str):
        self.tokens, self.at = _tokens(source), 0

    def whole(self):
        tree = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return tree

    def take(self, kind: str, *values) -> object | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == kind and (not values or self.tokens[self.at][1] in values):
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def either(self):
        tree = self.both()
        while self.take("word", "or"):
            tree = ("or", tree, self.both())
        return tree

    def both(self):
        tree = self.negated()
        while self.take("word", "and"):
            tree = ("and", tree, self.negated())
        return tree

    def negated(self):
        return ("not", self.negated()) if self.take("word", "not") else self.compared()

    def compared(self):
        tree = self.joined()
        while sign := self.take("sign", "==", "!=") or self.take("word", "in"):
            tree = (sign, tree, self.joined())
        return tree

    def joined(self):
        tree = self.filtered()
        while self.take("sign", "+", "~"):
            tree = ("+", tree, self.filtered())
        return tree

    def filtered(self):
        tree = self.atom()
        while self.take("sign", "|"):
            name = self.take("name")
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            tree = ("filter", name, tree)
        return tree

    def atom(self):
        if self.take("sign", "("):
            tree = self.either()
            if not self.take("sign", ")"):
                raise TemplateError("a bracket is open")
            return tree
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "text":
            self.at += 1
            return ("const", self.tokens[self.at - 1][1])
        if (name := self.take("name")) is None:
            raise TemplateError("an expression is missing")
        tree = ("name", name)
        while self.take("sign", "."):
            if (field := self.take("name")) is None or field.startswith("_"):
                raise TemplateError("a field's name is missing")
            tree = ("field", tree, field)
        return tree


def parse(source: str) -> tuple:
    """The syntax tree: ("block", parts)."""
    flat: list[tuple] = []
    at = 0
    for m in _TAG.finditer(source):
        flat += [("const", source[at : m.start()])] if m.start() > at else []
        flat.append(("print", m[1]) if m[1] is not None else ("tag", m[2].strip()))
        at = m.end()
    flat += [("const", source[at:])] if at < len(source) else []
    if re.search(r"\{[{%]", "".join(x[1] for x in flat if x[0] == "const")):
        raise TemplateError("a tag is open")
    position = 0

    def block(*ends: str) -> tuple[tuple, str]:
        nonlocal position
        parts = []
        while position < len(flat):
            kind, body = flat[position]
            position += 1
            if kind == "const":
                parts.append((kind, body))
            elif kind == "print":
                parts.append(("print", _Expression(body).whole()))
            elif body.split(" ")[0] in ends:
                return ("block", tuple(parts)), body
            elif m := re.fullmatch(r"for\s+([A-Za-z_]\w*)\s+in\s+(.+)", body, re.S):
                inside, _ = block("endfor")
                parts.append(("for", m[1], _Expression(m[2]).whole(), inside))
            elif body == "generation":
                parts.append(("generation", block("endgeneration")[0]))
            elif m := re.fullmatch(r"if\s+(.+)", body, re.S):
                cases, test = [], m[1]
                while True:
                    inside, end = block("elif", "else", "endif")
                    cases.append((_Expression(test).whole(), inside))
                    if end.startswith("elif"):
                        test = end[4:]
                        continue
                    other = block("endif")[0] if end == "else" else ("block", ())
                    break
                parts.append(("if", tuple(cases), other))
            else:
                raise TemplateError(f"no tag {body!r}")
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return ("block", tuple(parts)), ""

    return block()[0]


def _binary(sign: str, a, b):
    if sign == "+":
        return f"{a}{b}"
    if sign == "in":
        return a in b
    return (a == b) == (sign == "==")


def fold(tree: tuple) -> tuple:
    """The tree with constant parts evaluated, branches that can't be reached removed and neighbouring texts joined."""
    kind = tree[0]
    if kind in ("const", "name"):
        return tree
    if kind == "field":
        return ("field", fold(tree[1]), tree[2])
    if kind == "filter":
        inner = fold(tree[2])
        return ("const", FILTERS[tree[1]](str(inner[1]))) if inner[0] == "const" else ("filter", tree[1], inner)
    if kind == "not":
        inner = fold(tree[1])
        return ("const", not inner[1]) if inner[0] == "const" else ("not", inner)
    if kind in ("and", "or"):
        a, b = fold(tree[1]), fold(tree[2])
        return (b if bool(a[1]) == (kind == "and") else a) if a[0] == "const" else (kind, a, b)
    if kind in ("+", "==", "!=", "in"):
        a, b = fold(tree[1]), fold(tree[2])
        return ("const", _binary(kind, a[1], b[1])) if a[0] == b[0] == "const" else (kind, a, b)
    if kind == "print":
        inner = fold(tree[1])
        return ("const", str(inner[1])) if inner[0] == "const" else ("print", inner)
    if kind == "for":
        return ("for", tree[1], fold(tree[2]), fold(tree[3]))
    if kind == "generation":
        return ("generation", fold(tree[1]))
    if kind == "if":
        cases = []
        other = fold(tree[2])
        for test, inside in tree[1]:
            test = fold(test)
            if test[0] == "const" and not test[1]:
                continue
            if test[0] == "const":
                other = fold(inside)
                break
            cases.append((test, fold(inside)))
        return ("if", tuple(cases), other) if cases else other
    parts: list[tuple] = []
    for part in map(fold, tree[1]):
        for x in part[1] if part[0] == "block" else (part,):
            if x[0] == "const" and parts and parts[-1][0] == "const":
                parts[-1] = ("const", parts[-1][1] + x[1])
            elif x != ("const", ""):
                parts.append(x)
    return ("block", tuple(parts))


def _value(tree: tuple) -> Callable[[dict], object]:
    kind = tree[0]
    if kind == "const":
        held = tree[1]
        return lambda names: held
    if kind == "name":
        name = tree[1]
        return lambda names: names.get(name, "")
    if kind == "field":
        inner, field = _value(tree[1]), tree[2]

        def get(names):
            got = inner(names)
            return got.get(field, "") if isinstance(got, dict) else ""

        return get
    if kind == "filter":
        inner, f = _value(tree[2]), FILTERS[tree[1]]
        return lambda names: f(str(inner(names)))
    if kind == "not":
        inner = _value(tree[1])
        return lambda names: not inner(names)
    a, b = _value(tree[1]), _value(tree[2])
    if kind == "and":
        return lambda names: a(names) and b(names)
    if kind == "or":
        return lambda names: a(names) or b(names)
    return lambda names: _binary(kind, a(names), b(names))


def _render(tree: tuple) -> Callable[[dict, bool], Iterator[Piece]]:
    kind = tree[0]
    if kind == "const":
        held = str(tree[1])
        return lambda names, learned: iter(((held, learned),))
    if kind == "print":
        inner = _value(tree[1])
        return lambda names, learned: iter(((str(inner(names)), learned),))
    if kind == "generation":
        inside = _render(tree[1])
        return lambda names, learned: inside(names, True)
    if kind == "if":
        cases, other = [(_value(t), _render(x)) for t, x in tree[1]], _render(tree[2])
        return lambda names, learned: next((x for t, x in cases if t(names)), other)(names, learned)
    if kind == "for":
        name, over, inside = tree[1], _value(tree[2]), _render(tree[3])

        def walk(names, learned):
            items = iter(over(names))
            index, item = 0, next(items, walk)
            while item is not walk:
                after = next(items, walk)
                index += 1
                yield from inside({**names, name: item, "loop": {"index": index, "first": index == 1, "last": after is walk}}, learned)
                item = after

        return walk
    parts = [_render(x) for x in tree[1]]

    def every(names, learned):
        for part in parts:
            yield from part(names, learned)

    return every


def compile_template(source: str) -> Callable[..., Iterator[Piece]]:
    """A function of the template's names that yields its (text, learned) pieces."""
    run = _render(fold(parse(source)))
    return lambda **names: run(names, False)
