"""Chat formatting with a small compiled template language.

`{{ expression }}` prints, `{% if %}` / `{% elif %}` / `{% else %}` / `{% endif %}`, `{% for x in list %}` / `{% endfor %}`,
`{% set x = expression %}` and `{% generation %}` / `{% endgeneration %}` (what a model is to learn) are the statements.
Expressions have strings, numbers, true, false, none, names, `.field` and `[index]` of plain data, `not`, `and`, `or`,
comparisons, `in`, `+`, `-`, `*`, `%`, `~` (joins as text), `a if c else b`, and filters from a fixed list. There are no
calls, no attributes of Python objects and no loops but those over given lists, so a template can neither reach the
interpreter nor run on for ever.

`Template` parses text into a syntax tree, folds constant expressions, branches and neighbouring texts, and generates one
Python closure per node. Rendering is lazy: messages are taken one at a time (with one read ahead, for `loop.last`), and
segments (text, whether under a generation marker) are handed on, so one conversation may be larger than memory.

Control strings inside a message are broken by `escape`, and `unescape` gives back the text exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONTROLS = ("<|im_start|>", "<|im_sep|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
TEMPLATE = (
    "{% for m in messages %}<|im_start|>{{ m.role | escape }}<|im_sep|>"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}"
    "<|im_end|>{{ '\\n' }}{% endfor %}"
)

_CONTROL = re.compile("(?=" + "|".join(map(re.escape, CONTROLS)) + ")")
_ESCAPED = re.compile(r"\\([\\-])")


def escape(text: str) -> str:
    r"""Doubles backslashes, and puts `\-` after the first character of each control string."""
    text = text.replace("\\", "\\\\")
    cuts = [m.start() + 1 for m in _CONTROL.finditer(text)]
    return "\\-".join(text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)) if cuts else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\\" if m[1] == "\\" else "", text) if "\\" in text else text


class TemplateError(ValueError):
    pass


# --- syntax -----------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Node:
    kind: str
    value: object = None
    parts: tuple = field(default=())


_TAG = re.compile(r"\{\{-?(.*?)-?\}\}|\{%-?(.*?)-?%\}|\{#.*?#\}", re.S)
_TOKEN = re.compile(r"\s*(?:(?P<num>\d+(?:\.\d+)?)|(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-+*%~<>|.\[\]()=,]))", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_WORDS = {"true": True, "True": True, "false": False, "False": False, "none": None, "None": None}

FILTERS: dict[str, Callable] = {
    "escape": lambda x: escape(_text(x)),
    "trim": lambda x: _text(x).strip(),
    "upper": lambda x: _text(x).upper(),
    "lower": lambda x: _text(x).lower(),
    "string": lambda x: _text(x),
    "length": lambda x: _length(x),
}


def _text(x: object) -> str:
    return "" if x is None else x if isinstance(x, str) else str(x)


def _length(x: object) -> int:
    if isinstance(x, str | list | tuple | dict):
        return len(x)
    raise TemplateError("length of something that is neither text nor a whole list")


def _tokens(source: str) -> list[tuple[str, object]]:
    out, at = [], 0
    source = source.rstrip()
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"unexpected character in {source!r} at {at}")
        at = m.end()
        if m["num"]:
            out.append(("value", float(m["num"]) if "." in m["num"] else int(m["num"])))
        elif m["str"]:
            out.append(("value", re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], e[1]), m["str"][1:-1], flags=re.S)))
        elif m["name"]:
            out.append(("value", _WORDS[m["name"]]) if m["name"] in _WORDS else ("name", m["name"]))
        else:
            out.append(("op", m["op"]))
    return out


class _Expressions:
    """Precedence climbing over one tag's tokens."""

    LEVELS = (("or",), ("and",), ("==", "!=", "<", ">", "<=", ">=", "in"), ("~",), ("+", "-"), ("*", "%"))

    def __init__(self, source: str):
        self.tokens, self.at = _tokens(source), 0

    def peek(self) -> object:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] != "value" else None

    def accept(self, *what: str) -> str | None:
        if self.peek() in what:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def expect(self, what: str) -> None:
        if not self.accept(what):
            raise TemplateError(f"{what!r} expected")

    def name(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name":
            raise TemplateError("a name expected")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def end(self, out: Node) -> Node:
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return out

    def choice(self) -> Node:
        out = self.binary(0)
        if self.accept("if"):
            test = self.binary(0)
            self.expect("else")
            out = Node("choice", None, (test, out, self.choice()))
        return out

    def binary(self, level: int) -> Node:
        if level == len(self.LEVELS):
            return self.unary()
        if level == 2 and self.accept("not"):
            return Node("not", None, (self.binary(2),))
        out = self.binary(level + 1)
        while op := self.accept(*self.LEVELS[level]):
            out = Node("binary", op, (out, self.binary(level + 1)))
        return out

    def unary(self) -> Node:
        if self.accept("-"):
            return Node("binary", "-", (Node("value", 0), self.unary()))
        if self.accept("("):
            out = self.choice()
            self.expect(")")
        elif self.at < len(self.tokens) and self.tokens[self.at][0] == "value":
            self.at += 1
            out = Node("value", self.tokens[self.at - 1][1])
        else:
            out = Node("name", self.name())
        while op := self.accept(".", "[", "|"):
            if op == ".":
                out = Node("item", None, (out, Node("value", self.name())))
            elif op == "[":
                out = Node("item", None, (out, self.choice()))
                self.expect("]")
            else:
                name = self.name()
                if name not in FILTERS:
                    raise TemplateError(f"no filter {name!r}")
                out = Node("filter", name, (out,))
        return out


def parse(source: str) -> Node:
    """The syntax tree of a template."""
    pieces, at = [], 0
    for m in _TAG.finditer(source):
        if m.start() > at:
            pieces.append(("text", source[at : m.start()]))
        if m[1] is not None:
            pieces.append(("print", m[1]))
        elif m[2] is not None:
            pieces.append(("tag", m[2].strip()))
        at = m.end()
    pieces.append(("text", source[at:]))
    pieces.reverse()

    def block(*ends: str) -> tuple[Node, str]:
        out = []
        while pieces:
            kind, body = pieces.pop()
            if kind == "text":
                out.append(Node("text", body))
            elif kind == "print":
                e = _Expressions(body)
                out.append(Node("print", None, (e.end(e.choice()),)))
            else:
                word, _, rest = body.partition(" ")
                if word in ends:
                    return Node("block", None, tuple(out)), body
                out.append(statement(word, rest))
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return Node("block", None, tuple(out)), ""

    def statement(word: str, rest: str) -> Node:
        if word == "if":
            e = _Expressions(rest)
            test = e.end(e.choice())
            then, end = block("elif", "else", "endif")
            if end.startswith("elif"):
                other = statement("if", end[4:])
            elif end == "else":
                other, _ = block("endif")
            else:
                other = Node("block")
            return Node("if", None, (test, then, other))
        if word == "for":
            e = _Expressions(rest)
            name = e.name()
            e.expect("in")
            items = e.end(e.choice())
            body, _ = block("endfor")
            return Node("for", name, (items, body))
        if word == "set":
            e = _Expressions(rest)
            name = e.name()
            e.expect("=")
            return Node("set", name, (e.end(e.choice()),))
        if word == "generation":
            return Node("generation", None, (block("endgeneration")[0],))
        raise TemplateError(f"unknown statement {word!r}")

    return block()[0]


# --- folding ----------------------------------------------------------------------------------------------------------

_OPERATIONS: dict[str, Callable] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b,
    ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b,
    "~": lambda a, b: _text(a) + _text(b),
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "*": lambda a, b: _times(a, b),
    "%": lambda a, b: _modulo(a, b),
}


def _times(a: object, b: object) -> object:
    if isinstance(a, int | float) and isinstance(b, int | float):
        return a * b
    raise TemplateError("only numbers are multiplied")


def _modulo(a: object, b: object) -> object:
    if isinstance(a, int | float) and isinstance(b, int | float):
        return a % b
    raise TemplateError("only numbers have remainders")


def fold(node: Node) -> Node:
    """The same tree with constant parts computed and neighbouring texts joined."""
    parts = tuple(fold(p) for p in node.parts)
    fixed = bool(parts) and all(p.kind == "value" for p in parts)
    kind = node.kind
    if kind == "binary" and node.value in ("and", "or") and parts[0].kind == "value":
        return parts[1] if bool(parts[0].value) == (node.value == "and") else parts[0]
    if kind == "binary" and node.value not in ("and", "or") and fixed:
        return Node("value", _OPERATIONS[node.value](parts[0].value, parts[1].value))
    if kind == "not" and fixed:
        return Node("value", not parts[0].value)
    if kind == "filter" and fixed:
        return Node("value", FILTERS[node.value](parts[0].value))
    if kind == "choice" and parts[0].kind == "value":
        return parts[1] if parts[0].value else parts[2]
    if kind == "if" and parts[0].kind == "value":
        return parts[1] if parts[0].value else parts[2]
    if kind == "print" and fixed:
        return Node("text", _text(parts[0].value))
    if kind == "block":
        out: list[Node] = []
        for p in (x for p in parts for x in (p.parts if p.kind == "block" else (p,))):
            if p.kind == "text" and out and out[-1].kind == "text":
                out[-1] = Node("text", out[-1].value + p.value)
            elif p.kind != "text" or p.value:
                out.append(p)
        return Node("block", None, tuple(out))
    return Node(kind, node.value, parts)


# --- closures ---------------------------------------------------------------------------------------------------------

Segment = tuple[str, bool]


def _value(node: Node) -> Callable[[dict], object]:
    parts = tuple(_value(p) for p in node.parts)
    v = node.value
    if node.kind == "value":
        return lambda env: v
    if node.kind == "name":
        return lambda env: env.get(v)
    if node.kind == "not":
        return lambda env, a=parts[0]: not a(env)
    if node.kind == "choice":
        return lambda env, p=parts: p[1](env) if p[0](env) else p[2](env)
    if node.kind == "filter":
        return lambda env, f=FILTERS[v], a=parts[0]: f(a(env))
    if node.kind == "item":

        def item(env: dict, a=parts[0], b=parts[1]) -> object:
            of, key = a(env), b(env)
            if isinstance(of, dict):
                return of.get(key)
            if isinstance(of, list | tuple | str) and isinstance(key, int):
                return of[key] if -len(of) <= key < len(of) else None
            return None

        return item
    if v == "and":
        return lambda env, p=parts: p[0](env) and p[1](env)
    if v == "or":
        return lambda env, p=parts: p[0](env) or p[1](env)
    return lambda env, f=_OPERATIONS[v], p=parts: f(p[0](env), p[1](env))


def _loop(items: Iterable) -> Iterator[tuple[object, dict]]:
    """Items with their loop record, one read ahead."""
    it, i = iter(items), 0
    none = object()
    now = next(it, none)
    while now is not none:
        after = next(it, none)
        yield now, {"index0": i, "index": i + 1, "first": i == 0, "last": after is none}
        now, i = after, i + 1


def _render(node: Node) -> Callable[[dict, bool], Iterator[Segment]]:
    v = node.value
    if node.kind == "text":
        return lambda env, learn: iter(((v, learn),))
    if node.kind == "print":
        return lambda env, learn, a=_value(node.parts[0]): iter(((_text(a(env)), learn),))
    if node.kind == "generation":
        return lambda env, learn, a=_render(node.parts[0]): a(env, True)
    if node.kind == "if":
        return lambda env, learn, t=_value(node.parts[0]), a=_render(node.parts[1]), b=_render(node.parts[2]): (a if t(env) else b)(env, learn)
    if node.kind == "set":

        def put(env: dict, learn: bool, a=_value(node.parts[0])) -> Iterator[Segment]:
            env[v] = a(env)
            return iter(())

        return put
    if node.kind == "for":

        def loop(env: dict, learn: bool, items=_value(node.parts[0]), body=_render(node.parts[1])) -> Iterator[Segment]:
            over = items(env)
            if over is not None and (isinstance(over, str | dict) or not isinstance(over, Iterable)):
                raise TemplateError("a loop needs a list")
            for x, record in _loop(over or ()):
                yield from body({**env, v: x, "loop": record}, learn)

        return loop
    parts = tuple(_render(p) for p in node.parts)

    def block(env: dict, learn: bool) -> Iterator[Segment]:
        for p in parts:
            yield from p(env, learn)

    return block


class Template:
    def __init__(self, source: str = TEMPLATE):
        if any("\\" in c for c in CONTROLS):
            raise TemplateError("control strings may not hold the escape character")
        self.tree = fold(parse(source))
        self._run = _render(self.tree)

    def segments(self, messages: Iterable[dict], **more: object) -> Iterator[Segment]:
        return self._run({"messages": messages, **more}, False)

    def render(self, messages: Iterable[dict], **more: object) -> tuple[str, list[tuple[int, int]]]:
        """The text and the code-point ranges under generation markers."""
        out, spans, at = [], [], 0
        for text, learn in self.segments(messages, **more):
            if learn and text:
                if spans and spans[-1][1] == at:
                    spans[-1] = (spans[-1][0], at + len(text))
                else:
                    spans.append((at, at + len(text)))
            out.append(text)
            at += len(text)
        return "".join(out), spans


class Reader:
    """Reads formatted text back, piece by piece: (role, text) of each turn."""

    def __init__(self) -> None:
        self.rest = ""

    def turns(self, text: str) -> Iterator[tuple[str, str]]:
        self.rest += text
        at = 0
        while (end := self.rest.find("<|im_end|>\n", at)) >= 0:
            head = self.rest[at:end]
            if not head.startswith("<|im_start|>"):
                raise ValueError("formatted text doesn't begin with a turn")
            role, sep, body = head[12:].partition("<|im_sep|>")
            if not sep:
                raise ValueError("a turn has no separator")
            yield unescape(role), unescape(body)
            at = end + 11
        self.rest = self.rest[at:]


# --- tables -----------------------------------------------------------------------------------------------------------


def _ordered(rows: DataFrame) -> DataFrame:
    """Turns of a conversation stand together and in order, whatever the size of one conversation."""
    picked = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return picked.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _conversations(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[dict]]]:
    """Lazy groups of neighbouring rows; each must be used up before the next."""
    from itertools import groupby

    rows = (row for b in batches for row in zip(*(b.column(i).to_pylist() for i in (0, 2, 3)), strict=True))
    for conv, own in groupby(rows, key=lambda r: r[0]):
        yield conv, ({"role": r[1], "text": r[2]} for r in own)


def format_conversations(rows: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """(conv_id, formatted string, spans array<struct<start,stop>>): the text and the ranges that a model learns.

    Rows of a null conv_id form one conversation; null roles and texts are empty; rows of equal turn stand by role and
    text; null turns stand first; other columns are dropped; an empty table gives no rows.
    """
    kind = dict(rows.dtypes)["conv_id"]
    compiled = Template(template).tree  # errors show on the driver

    def run(batches):
        t = Template(template)
        for conv, messages in _conversations(batches):
            text, spans = t.render(messages)
            yield pa.RecordBatch.from_pylist([{"conv_id": conv, "formatted": text, "spans": [{"start": a, "stop": b} for a, b in spans]}], pa.schema([("conv_id", pa.int64() if kind == "bigint" else pa.string()), ("formatted", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))]))

    assert compiled
    ordered = _ordered(rows if kind == "bigint" else rows.withColumn("conv_id", F.col("conv_id").cast("string")))
    return ordered.mapInArrow(run, f"conv_id {kind if kind == 'bigint' else 'string'}, formatted string, spans array<struct<start:long,stop:long>>")


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digest_conversations(rows: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """What is read back from the formatted text of each conversation, in bounded memory (see `format_conversations`)."""

    def run(batches):
        t, out = Template(template), []
        names = [x.split()[0] for x in DIGEST.split(", ")]
        schema = pa.schema(list(zip(names, [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()], strict=True)))
        for conv, messages in _conversations(batches):
            reader, turns, loss = Reader(), hashlib.sha256(), hashlib.sha256()
            n = n_loss = n_chars = 0
            for text, learn in t.segments(messages):
                n_chars += len(text)
                if learn:
                    plain = unescape(text)
                    n_loss += len(plain)
                    loss.update(plain.encode("utf-8", "surrogatepass"))
                for role, body in reader.turns(text) if "\n" in text else _kept(reader, text):
                    n += 1
                    turns.update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
            if reader.rest:
                raise ValueError("formatted text ends inside a turn")
            out.append((conv, n, turns.hexdigest(), n_loss, loss.hexdigest(), n_chars))
            if len(out) == 1000:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return _ordered(rows.withColumn("conv_id", F.col("conv_id").cast("long"))).mapInArrow(run, DIGEST)


def _kept(reader: Reader, text: str) -> tuple:
    reader.rest += text
    return ()
