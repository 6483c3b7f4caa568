"""Chat formatting: a small sandboxed template language, compiled to Python closures.

Templates have text, {{ expression }}, {% for x in list %}, {% if %} {% elif %} {% else %}, {% set x = e %}
and {% generation %} ... {% endgeneration %}, which marks what the assistant is trained on. Expressions have names,
strings, whole numbers, a.b and a['b'], filters, == != and or not, and ~ for joining. A name is looked up
in the given values only: there are no calls, no attributes of Python objects and no imports.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class TemplateError(ValueError):
    pass


# --- text escapes -------------------------------------------------------------------------------------------

CONTROL = ("%", "<", "[")  # characters that begin a control string, and the escape itself
ESCAPES = {c: f"%{ord(c):02X}" for c in CONTROL}


def escape(text: str) -> str:
    """No control string can begin in the result; unescape gives the text back."""
    for c in CONTROL:
        text = text.replace(c, ESCAPES[c])
    return text


def unescape(text: str) -> str:
    for c in reversed(CONTROL):
        text = text.replace(ESCAPES[c], c)
    return text


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "trim": str.strip, "lower": str.lower, "upper": str.upper}


# --- syntax tree --------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Literal:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Field:
    of: Any
    key: Any


@dataclass(frozen=True)
class Call:
    filter: str
    of: Any


@dataclass(frozen=True)
class Op:
    kind: str
    parts: tuple


@dataclass(frozen=True)
class Text:
    text: str


@dataclass(frozen=True)
class Print:
    of: Any


@dataclass(frozen=True)
class Block:
    parts: tuple


@dataclass(frozen=True)
class If:
    branches: tuple  # (condition, block)
    otherwise: Any


@dataclass(frozen=True)
class For:
    name: str
    over: Any
    body: Any


@dataclass(frozen=True)
class Set:
    name: str
    of: Any


@dataclass(frozen=True)
class Generation:
    body: Any


PIECE = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)
TOKEN = re.compile(r"\s*(?:(\d+)|([A-Za-z_]\w*)|'((?:[^'\\]|\\.)*)'|\"((?:[^\"\\]|\\.)*)\"|(==|!=|[.\[\]|()~]))")


class Expression:
    """Recursive descent: or, and, not, comparison, joining, filters, fields."""

    def __init__(self, source: str) -> None:
        self.tokens, at = [], 0
        source = source.rstrip()
        while at < len(source):
            m = TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:]!r}")
            number, name, one, two, sign = m.groups()
            text = one if one is not None else two
            if number:
                self.tokens.append(("value", int(number)))
            elif text is not None:
                self.tokens.append(("value", re.sub(r"\\(.)", lambda x: {"n": "\n", "t": "\t"}.get(x[1], x[1]), text)))
            else:
                self.tokens.append(("name", name) if name else ("sign", sign))
            at = m.end()
        self.at = 0

    def peek(self, *wanted: tuple) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at] in wanted

    def take(self, kind: str, value: Any = None) -> Any:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != kind or value not in (None, self.tokens[self.at][1]):
            raise TemplateError(f"expected {value or kind}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def whole(self) -> Any:
        found = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return found

    def _chain(self, below: Callable, *signs: tuple) -> Any:
        left = below()
        while self.peek(*signs):
            kind = self.tokens[self.at][1]
            self.at += 1
            left = Op(kind, (left, below()))
        return left

    def either(self) -> Any:
        return self._chain(self.both, ("name", "or"))

    def both(self) -> Any:
        return self._chain(self.negated, ("name", "and"))

    def negated(self) -> Any:
        if self.peek(("name", "not")):
            self.at += 1
            return Op("not", (self.negated(),))
        return self._chain(self.joined, ("sign", "=="), ("sign", "!="))

    def joined(self) -> Any:
        return self._chain(self.filtered, ("sign", "~"))

    def filtered(self) -> Any:
        found = self.fields()
        while self.peek(("sign", "|")):
            self.at += 1
            name = self.take("name")
            if name not in FILTERS:
                raise TemplateError(f"no filter {name}")
            found = Call(name, found)
        return found

    def fields(self) -> Any:
        if self.peek(("sign", "(")):
            self.at += 1
            found = self.either()
            self.take("sign", ")")
        elif self.at < len(self.tokens) and self.tokens[self.at][0] == "value":
            found = Literal(self.take("value"))
        else:
            name = self.take("name")
            found = Literal({"true": True, "false": False}[name]) if name in ("true", "false") else Name(name)
        while self.peek(("sign", "."), ("sign", "[")):
            self.at += 1
            if self.tokens[self.at - 1][1] == ".":
                found = Field(found, Literal(self.take("name")))
            else:
                found = Field(found, self.either())
                self.take("sign", "]")
        return found


def parse(source: str) -> Block:
    pieces: list[tuple[str, str]] = []
    at = 0
    for m in PIECE.finditer(source):
        if m.start() > at:
            pieces.append(("text", source[at : m.start()]))
        pieces.append(("print", m[1]) if m[1] is not None else ("tag", m[2].strip()))
        at = m.end()
    if at < len(source):
        pieces.append(("text", source[at:]))
    pieces.reverse()

    def block(*ends: str) -> tuple[Block, str]:
        parts = []
        while pieces:
            kind, text = pieces.pop()
            if kind == "text":
                parts.append(Text(text))
            elif kind == "print":
                parts.append(Print(Expression(text).whole()))
            else:
                word, rest = (text.split(None, 1) + ["", ""])[:2]
                if word in ends:
                    return Block(tuple(parts)), text
                parts.append(tag(word, rest))
        if ends:
            raise TemplateError(f"no {ends[-1]}")
        return Block(tuple(parts)), ""

    def tag(word: str, rest: str) -> Any:
        if word == "for" and (m := re.fullmatch(r"(\w+)\s+in\s+(.+)", rest, re.S)):
            return For(m[1], Expression(m[2]).whole(), block("endfor")[0])
        if word == "set" and (m := re.fullmatch(r"(\w+)\s*=\s*(.+)", rest, re.S)):
            return Set(m[1], Expression(m[2]).whole())
        if word == "generation":
            return Generation(block("endgeneration")[0])
        if word == "if":
            branches, otherwise, condition = [], Block(()), rest
            while True:
                body, end = block("elif", "else", "endif")
                branches.append((Expression(condition).whole(), body))
                if end.startswith("elif"):
                    condition = end[4:]
                    continue
                if end == "else":
                    otherwise = block("endif")[0]
                return If(tuple(branches), otherwise)
        raise TemplateError(f"unknown tag {word!r}")

    return block()[0]


# --- constant folding ---------------------------------------------------------------------------------------


def show(value: Any) -> str:
    return "" if value is None else str(value)


def apply(kind: str, *v: Any) -> Any:
    return show(v[0]) + show(v[1]) if kind == "~" else v[0] == v[1] if kind == "==" else v[0] != v[1] if kind == "!=" else not v[0]


def fold(node: Any) -> Any:
    """The same tree with constant expressions computed, dead branches gone and neighbouring text joined."""
    if isinstance(node, Call):
        of = fold(node.of)
        return Literal(FILTERS[node.filter](show(of.value))) if isinstance(of, Literal) else Call(node.filter, of)
    if isinstance(node, Field):
        return Field(fold(node.of), fold(node.key))
    if isinstance(node, Op):
        parts = tuple(map(fold, node.parts))
        first = parts[0]
        if node.kind in ("and", "or"):
            if isinstance(first, Literal):
                return parts[1] if bool(first.value) == (node.kind == "and") else first
        elif all(isinstance(p, Literal) for p in parts):
            return Literal(apply(node.kind, *(p.value for p in parts)))
        return Op(node.kind, parts)
    if isinstance(node, Print):
        of = fold(node.of)
        return Text(show(of.value)) if isinstance(of, Literal) else Print(of)
    if isinstance(node, (For, Set)):
        return For(node.name, fold(node.over), fold(node.body)) if isinstance(node, For) else Set(node.name, fold(node.of))
    if isinstance(node, Generation):
        return Generation(fold(node.body))
    if isinstance(node, If):
        branches, otherwise = [], fold(node.otherwise)
        for condition, body in node.branches:
            condition = fold(condition)
            if not isinstance(condition, Literal):
                branches.append((condition, fold(body)))
            elif condition.value:
                otherwise = fold(body)
                break
        return If(tuple(branches), otherwise) if branches else otherwise
    if isinstance(node, Block):
        parts: list = []
        for p in map(fold, node.parts):
            for x in p.parts if isinstance(p, Block) else (p,):
                if isinstance(x, Text) and parts and isinstance(parts[-1], Text):
                    parts[-1] = Text(parts[-1].text + x.text)
                elif x != Text(""):
                    parts.append(x)
        return Block(tuple(parts))
    return node


# --- closures -----------------------------------------------------------------------------------------------


@dataclass
class Out:
    parts: list[str] = field(default_factory=list)
    size: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.size += len(text)


def value_of(node: Any) -> Callable[[dict], Any]:
    if isinstance(node, Literal):
        return lambda names, v=node.value: v
    if isinstance(node, Name):
        return lambda names, n=node.name: names.get(n)
    if isinstance(node, Field):
        of, key = value_of(node.of), value_of(node.key)

        def get(names: dict) -> Any:
            whole, k = of(names), key(names)
            if isinstance(whole, dict):
                return whole.get(k)
            return whole[k] if isinstance(whole, list) and isinstance(k, int) and -len(whole) <= k < len(whole) else None

        return get
    if isinstance(node, Call):
        of, f = value_of(node.of), FILTERS[node.filter]
        return lambda names: f(show(of(names)))
    parts = [value_of(p) for p in node.parts]
    if node.kind == "and":
        return lambda names: parts[0](names) and parts[1](names)
    if node.kind == "or":
        return lambda names: parts[0](names) or parts[1](names)
    return lambda names, kind=node.kind: apply(kind, *(p(names) for p in parts))


def writer_of(node: Any) -> Callable[[dict, Out], None]:
    if isinstance(node, Text):
        return lambda names, out, t=node.text: out.write(t)
    if isinstance(node, Print):
        of = value_of(node.of)
        return lambda names, out: out.write(show(of(names)))
    if isinstance(node, Set):
        of = value_of(node.of)
        return lambda names, out, n=node.name: names.__setitem__(n, of(names))
    if isinstance(node, Block):
        parts = [writer_of(p) for p in node.parts]

        def run(names: dict, out: Out) -> None:
            for p in parts:
                p(names, out)

        return run
    if isinstance(node, If):
        branches, otherwise = [(value_of(c), writer_of(b)) for c, b in node.branches], writer_of(node.otherwise)
        return lambda names, out: next((b for c, b in branches if c(names)), otherwise)(names, out)
    if isinstance(node, For):
        over, body = value_of(node.over), writer_of(node.body)

        def loop(names: dict, out: Out) -> None:
            items = over(names) or []
            for k, x in enumerate(items):
                body({**names, node.name: x, "loop": {"index": k + 1, "first": k == 0, "last": k == len(items) - 1}}, out)

        return loop
    body = writer_of(node.body)

    def mark(names: dict, out: Out) -> None:
        start = out.size
        body(names, out)
        out.spans.append((start, out.size))

    return mark


class Template:
    """render(messages) gives the text and the spans, in code points, that generation marks."""

    def __init__(self, source: str) -> None:
        try:
            self.run = writer_of(fold(parse(source)))
        except RecursionError:
            raise TemplateError("nested too deeply") from None

    def render(self, **names: Any) -> tuple[str, list[tuple[int, int]]]:
        out = Out()
        self.run(dict(names), out)
        return "".join(out.parts), out.spans


# --- conversations ------------------------------------------------------------------------------------------

TEMPLATE = (
    "<|begin|>{% for m in messages %}<|turn|>{{ m.role | escape }}<|text|>"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}"
    "<|end|>{% endfor %}"
)
TURN = re.compile(r"<\|turn\|>([^<]*)<\|text\|>([^<]*)<\|end\|>")


def read_back(text: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    body = text.removeprefix("<|begin|>")
    turns = [(unescape(m[1]), unescape(m[2])) for m in TURN.finditer(body)]
    if sum(len(m[0]) for m in TURN.finditer(body)) != len(body):
        raise ValueError("not a formatted conversation")
    return turns


def format_conversations(rows: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """(conv_id, formatted, loss_spans): each conversation as one text, its rows by turn.

    A null text or role counts as empty. Rows of equal turn are ordered by role and text. Rows without
    conv_id are one conversation. A conversation is one row of the result, so its turns meet in one task. An
    empty table gives no conversations.
    """
    turns = rows.select(
        F.col("conv_id").cast("long"), F.struct(F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t")
    )
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("messages"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compiled = Template(template)
        for b in batches:
            out = [compiled.render(messages=[{"role": m["role"], "text": m["text"]} for m in messages]) for messages in b["messages"]]
            yield pd.DataFrame({"conv_id": b["conv_id"], "formatted": [t for t, _ in out], "loss_spans": [[{"start": s, "end": e} for s, e in spans] for _, spans in out]})

    return whole.mapInPandas(run, "conv_id long, formatted string, loss_spans array<struct<start: long, end: long>>")


def digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from formatted conversations: turns, and the text under the loss mask."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, text, spans in zip(b["conv_id"], b["formatted"], b["loss_spans"]):
                turns = read_back(text)
                whole = "".join(f"{r}\n{t}\n" for r, t in turns)
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                out.append((i, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            yield pd.DataFrame(out, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.mapInPandas(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
