"""A sandboxed template language for conversations, compiled to Python closures.

``Template(source)`` parses to a syntax tree, folds constants, and generates closures that write pieces of text and
whether they stand under the loss mask. Templates reach nothing but the names that are passed in, keys of messages and
the filters below: no attribute of a Python object, no call, no import.

Statements: ``{% for x in xs %}`` (with loop.index, loop.first, loop.last), ``{% if %}/{% elif %}/{% else %}``,
``{% set name = expr %}``, ``{% generation %}`` for the loss mask, ``{# comment #}``; ``-`` trims white space at a tag.
Expressions: strings, integers, true/false/none, names, ``a.key``, ``a['key']``, ``+ == != in and or not``, filters.
A for loop takes any iterable and holds two items of it at a time, so a conversation is rendered as a stream.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any

Emit = Callable[[str, bool], None]

#: Strings that mark turns in common chat formats. Each begins with its only ``<`` or ``[``.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<|im_start|>", "<|im_sep|>", "<|im_end|>", "<|endoftext|>", "<|user|>", "<|assistant|>", "<|system|>", "<|end|>")

_REST = {first: "|".join(re.escape(c[1:]) for c in CONTROLS if c[0] == first) for first in "<["}
_RAW = re.compile("|".join(rf"{re.escape(first)}\\*(?:{rest})" for first, rest in _REST.items()))
_ESCAPED = re.compile("|".join(rf"{re.escape(first)}\\+(?:{rest})" for first, rest in _REST.items()))


def escape(text: str) -> str:
    """No control string is left in the result: each gets a backslash after its first character, and so do those that
    hold backslashes there already, so :func:`unescape` is an exact inverse."""
    return _RAW.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][0] + m[0][2:], text)


FILTERS: dict[str, Callable[[Any], Any]] = {
    "escape": lambda x: escape(_text(x)),
    "trim": lambda x: _text(x).strip(),
    "upper": lambda x: _text(x).upper(),
    "lower": lambda x: _text(x).lower(),
    "length": lambda x: len(x),
}


def _text(x: Any) -> str:
    return "" if x is None else x if isinstance(x, str) else str(x)


class TemplateError(ValueError):
    """The template can't be parsed, or asks for something outside the sandbox."""


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Item:
    of: Any
    key: str


@dataclass(frozen=True)
class Op:
    op: str
    args: tuple


@dataclass(frozen=True)
class Filter:
    of: Any
    name: str


@dataclass
class Out:
    of: Any


@dataclass
class For:
    name: str
    over: Any
    body: list = field(default_factory=list)


@dataclass
class If:
    arms: list = field(default_factory=list)  # (condition, body)


@dataclass
class Set:
    name: str
    of: Any


@dataclass
class Generation:
    body: list = field(default_factory=list)


_TOKEN = re.compile(r"\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|[.|+()\[\]=]))")
_TAG = re.compile(r"\{#.*?#\}|\{\{-?.*?-?\}\}|\{%-?.*?-?%\}", re.S)


class Expression:
    """Recursive descent over one expression, by rising precedence: or, and, not, comparison, +, filter, access."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.strip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"can't read {source[at:at + 20]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] != "str" else None

    def take(self, *wanted: str) -> str | None:
        if self.peek() in wanted:
            self.at += 1
            return wanted[wanted.index(self.tokens[self.at - 1][1])]
        return None

    def name(self) -> str:
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else (None, None)
        if kind != "name":
            raise TemplateError(f"a name is missing before {value!r}")
        self.at += 1
        return value

    def whole(self):
        out = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return out

    def either(self):
        out = self.both()
        while self.take("or"):
            out = fold(Op("or", (out, self.both())))
        return out

    def both(self):
        out = self.negated()
        while self.take("and"):
            out = fold(Op("and", (out, self.negated())))
        return out

    def negated(self):
        return fold(Op("not", (self.negated(),))) if self.take("not") else self.compared()

    def compared(self):
        out = self.added()
        while op := self.take("==", "!=", "in"):
            out = fold(Op(op, (out, self.added())))
        return out

    def added(self):
        out = self.filtered()
        while self.take("+"):
            out = fold(Op("+", (out, self.filtered())))
        return out

    def filtered(self):
        out = self.accessed()
        while self.take("|"):
            name = self.name()
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            out = fold(Filter(out, name))
        return out

    def accessed(self):
        out = self.atom()
        while op := self.take(".", "["):
            if op == ".":
                out = Item(out, self.name())
            else:
                kind, value = self.tokens[self.at] if self.at < len(self.tokens) else (None, None)
                if kind != "str":
                    raise TemplateError("a key must be a string")
                self.at += 1
                out = Item(out, _unquote(value))
                if not self.take("]"):
                    raise TemplateError("']' is missing")
        return out

    def atom(self):
        if self.at >= len(self.tokens):
            raise TemplateError("the expression ends early")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "str":
            return Const(_unquote(value))
        if kind == "int":
            return Const(int(value))
        if value == "(":
            out = self.either()
            if not self.take(")"):
                raise TemplateError("')' is missing")
            return out
        if kind == "name":
            return Const({"true": True, "false": False, "none": None}[value]) if value in ("true", "false", "none") else Name(value)
        raise TemplateError(f"unexpected {value!r}")


def _unquote(literal: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), literal[1:-1], flags=re.S)


_OPS: dict[str, Callable] = {
    "+": lambda a, b: a + b if isinstance(a, int) and isinstance(b, int) else _text(a) + _text(b),
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "in": lambda a, b: a in b,
    "not": lambda a: not a,
}


def fold(node):
    """A constant in place of an operator or filter whose operands are constants."""
    if isinstance(node, Filter) and isinstance(node.of, Const):
        return Const(FILTERS[node.name](node.of.value))
    if isinstance(node, Op):
        if node.op in ("and", "or") and isinstance(node.args[0], Const):
            return node.args[1] if bool(node.args[0].value) == (node.op == "and") else node.args[0]
        if node.op in _OPS and all(isinstance(a, Const) for a in node.args):
            return Const(_OPS[node.op](*(a.value for a in node.args)))
    return node


def parse(source: str) -> list:
    """The syntax tree: a list of statements, neighbouring constants joined."""
    root: list = []
    stack: list[tuple[str, Any, list]] = [("", None, root)]
    at, trim = 0, False

    def literal(text: str, before_trim: bool) -> None:
        text = text.lstrip() if trim else text
        text = text.rstrip() if before_trim else text
        if text:
            stack[-1][2].append(Out(Const(text)))

    for m in _TAG.finditer(source):
        tag = m[0]
        literal(source[at : m.start()], tag[2] == "-")
        at, trim = m.end(), tag[-3] == "-" and tag[1] != "#"
        inner = tag[2:-2].strip("-") if tag[1] != "#" else ""
        if tag.startswith("{{"):
            stack[-1][2].append(Out(Expression(inner).whole()))
        elif tag.startswith("{%"):
            word, _, rest = inner.strip().partition(" ")
            body = stack[-1][2]
            if word == "for":
                name, _, over = rest.strip().partition(" in ")
                if not name.isidentifier():
                    raise TemplateError(f"can't loop over {rest!r}")
                body.append(node := For(name, Expression(over).whole()))
                stack.append(("for", node, node.body))
            elif word == "if":
                body.append(node := If([(Expression(rest).whole(), [])]))
                stack.append(("if", node, node.arms[-1][1]))
            elif word in ("elif", "else") and stack[-1][0] == "if":
                node = stack.pop()[1]
                node.arms.append((Expression(rest).whole() if word == "elif" else Const(True), []))
                stack.append(("if", node, node.arms[-1][1]))
            elif word == "generation":
                body.append(node := Generation())
                stack.append(("generation", node, node.body))
            elif word == "set":
                name, _, value = rest.partition("=")
                if not name.strip().isidentifier():
                    raise TemplateError(f"can't set {name!r}")
                body.append(Set(name.strip(), Expression(value).whole()))
            elif word.startswith("end") and stack[-1][0] == word[3:] != "":
                stack.pop()
            else:
                raise TemplateError(f"unexpected {word!r}")
    literal(source[at:], False)
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]!r} has no end")
    return simplify(root)


def simplify(body: list) -> list:
    """Drops arms that can't be reached and joins neighbouring constant output."""
    out: list = []
    for node in body:
        if isinstance(node, If):
            arms = []
            for condition, arm in node.arms:
                if isinstance(condition, Const) and not condition.value:
                    continue
                arms.append((condition, simplify(arm)))
                if isinstance(condition, Const):
                    break
            if arms and isinstance(arms[0][0], Const):
                out.extend(arms[0][1])
            elif arms:
                out.append(If(arms))
            continue
        if isinstance(node, (For, Generation)):
            node.body = simplify(node.body)
        out.append(node)
    joined: list = []
    for node in out:
        if isinstance(node, Out) and isinstance(node.of, Const) and joined and isinstance(joined[-1], Out) and isinstance(joined[-1].of, Const):
            joined[-1] = Out(Const(_text(joined[-1].of.value) + _text(node.of.value)))
        else:
            joined.append(node)
    return joined


def value_of(node) -> Callable[[dict], Any]:
    """A closure that computes an expression from the names."""
    if isinstance(node, Const):
        return lambda names, v=node.value: v
    if isinstance(node, Name):
        return lambda names, k=node.name: names.get(k)
    if isinstance(node, Item):
        of = value_of(node.of)
        return lambda names, k=node.key: x.get(k) if isinstance(x := of(names), dict) else None
    if isinstance(node, Filter):
        of, use = value_of(node.of), FILTERS[node.name]
        return lambda names: use(of(names))
    args = [value_of(a) for a in node.args]
    if node.op == "and":
        return lambda names: args[0](names) and args[1](names)
    if node.op == "or":
        return lambda names: args[0](names) or args[1](names)
    use = _OPS[node.op]
    return lambda names: use(*(a(names) for a in args))


def writer(body: list, masked: bool = False) -> Callable[[dict, Emit], None]:
    """A closure that writes a list of statements."""
    steps = [_step(node, masked) for node in body]
    if len(steps) == 1:
        return steps[0]

    def run(names: dict, emit: Emit) -> None:
        for step in steps:
            step(names, emit)

    return run


def _step(node, masked: bool) -> Callable[[dict, Emit], None]:
    if isinstance(node, Out):
        if isinstance(node.of, Const):
            return lambda names, emit, t=_text(node.of.value): emit(t, masked)
        of = value_of(node.of)
        return lambda names, emit: emit(_text(of(names)), masked)
    if isinstance(node, Generation):
        return writer(node.body, True)
    if isinstance(node, Set):
        of = value_of(node.of)
        return lambda names, emit, k=node.name: names.__setitem__(k, of(names))
    if isinstance(node, If):
        arms = [(value_of(c), writer(b, masked)) for c, b in node.arms]

        def choose(names: dict, emit: Emit) -> None:
            for condition, body in arms:
                if condition(names):
                    body(names, emit)
                    return

        return choose
    over, body = value_of(node.over), writer(node.body, masked)

    def loop(names: dict, emit: Emit, name=node.name) -> None:
        rest, none = iter(over(names) or ()), object()
        item, index = next(rest, none), 0
        while item is not none:
            after = next(rest, none)
            index += 1
            body({**names, name: item, "loop": {"index": index, "first": index == 1, "last": after is none}}, emit)
            item = after

    return loop


class Template:
    """A compiled template; :meth:`render` streams, :meth:`text` gathers."""

    def __init__(self, source: str):
        self.tree = parse(source)
        self.run = writer(self.tree)

    def render(self, messages: Iterable[dict], emit: Emit, **names: Any) -> None:
        self.run({**names, "messages": messages}, emit)

    def text(self, messages: Iterable[dict], **names: Any) -> tuple[str, list[tuple[int, int]]]:
        """The formatted conversation and the spans of it under the loss mask."""
        parts: list[str] = []
        spans: list[tuple[int, int]] = []
        at = 0

        def emit(piece: str, masked: bool) -> None:
            nonlocal at
            if masked and piece:
                if spans and spans[-1][1] == at:
                    spans[-1] = (spans[-1][0], at + len(piece))
                else:
                    spans.append((at, at + len(piece)))
            parts.append(piece)
            at += len(piece)

        self.render(messages, emit, **names)
        return "".join(parts), spans
