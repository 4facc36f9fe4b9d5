"""Chat formatting by a template compiler.

A template language is parsed into a syntax tree, constants are folded, and
Python closures are generated that render conversations and mark the generated
spans.  The language is the part of the usual chat template syntax that templates
of published models are written in, sandboxed: it knows the names it is given,
their fields and items, literals, operators and a fixed set of filters and tests;
no attribute of a Python object and no call can be reached.

    {% for m in messages %} ... {% endfor %}     {% if a == 'x' %} {% elif b %} {% else %} {% endif %}
    {% set name = e %}   {% set ns.name = e %}   {% generation %} ... {% endgeneration %}   {# comment #}
    {{ m.role }} {{ m['content'] }} {{ messages[0] }} {{ messages[1:] }} {{ loop.index0 % 2 }} {{ not loop.last }}
    {{ a ~ b + 'x' | trim }}   {{ x if y else z }}   {{ 'a' in m }}   {{ m.name is defined }}   {%- and -%} strip white space

``messages``, ``add_generation_prompt``, ``bos_token`` and ``eos_token`` are given; a message's text goes by
``text`` and ``content``.  Loops see all messages, any number of times; a template that only loops once over
them streams a conversation through.

Defined results: rows of a conversation go by turn, then role, then text (nulls
first); null text or role is empty; null conv_id is a conversation of its own;
an id of any type is kept; an empty table gives no rows; a name that is not known is empty.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Control strings of the production template, and the template.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")
TEMPLATE = "{% for m in messages %}{{ bos ~ '[INST] ' }}{{ m.role | escape }}{{ ' [/INST' ~ '] ' }}{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}</s>{% endfor %}"

# An occurrence of a control string, with any number of backslashes after its first character.
_ESCAPE = re.compile("|".join(rf"{re.escape(c[0])}\\*(?={re.escape(c[1:])})" for c in CONTROL))
_UNESCAPE = re.compile("|".join(rf"{re.escape(c[0])}\\+(?={re.escape(c[1:])})" for c in CONTROL))


def escape(text: str) -> str:
    r"""One backslash more after the first character of each control string: `</s>` -> `<\/s>`, `<\/s>` -> `<\\/s>`."""
    return _ESCAPE.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m[0][:-1], text)


def _length(x: object) -> int:
    return len(x) if isinstance(x, (str, list, dict)) else 0


FILTERS: dict[str, Callable] = {
    "escape": lambda x: escape(_text(x)), "trim": lambda x: _text(x).strip(), "upper": lambda x: _text(x).upper(), "lower": lambda x: _text(x).lower(),
    "capitalize": lambda x: _text(x).capitalize(), "title": lambda x: _text(x).title(), "length": _length, "string": lambda x: _text(x), "int": lambda x: int(x) if re.fullmatch(r"-?\d{1,18}", _text(x)) else 0,
    "first": lambda x: x[0] if isinstance(x, (str, list)) and x else "", "last": lambda x: x[-1] if isinstance(x, (str, list)) and x else "", "tojson": lambda x: json.dumps(x, ensure_ascii=False),
}
#: Tests of a value that stands there; `defined` and `none` of one that does not.
TESTS: dict[str, Callable[[object], bool]] = {
    "string": lambda x: isinstance(x, str), "mapping": lambda x: isinstance(x, dict), "iterable": lambda x: isinstance(x, (str, list, dict)), "number": lambda x: isinstance(x, int) and not isinstance(x, bool),
    "defined": lambda x: True, "none": lambda x: x is None, "true": lambda x: x is True, "false": lambda x: x is False, "odd": lambda x: isinstance(x, int) and x % 2 == 1, "even": lambda x: isinstance(x, int) and x % 2 == 0,
}


class _Missing:
    """What an unknown name, field or item gives: empty, false, equal to nothing else."""

    def __bool__(self) -> bool:
        return False


MISSING = _Missing()


def _text(x: object) -> str:
    return "" if x is MISSING else "None" if x is None else str(x)


_LEX = re.compile(r"(\{\{.*?\}\}|\{%.*?%\}|\{#.*?#\})", re.DOTALL)
_EXPR = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+)|([A-Za-z_]\w*)|(==|!=|<=|>=|[-~|.()+%<>,:=\[\]]))")
_CONSTANTS = {"true": True, "True": True, "false": False, "False": False, "none": None, "None": None}


class TemplateError(ValueError):
    pass


class _Expression:
    """Recursive descent: if-else < or < and < not < comparison < ~ < + - < % < tests, filters < fields < atoms. Nodes are tuples (kind, ...)."""

    def __init__(self, source: str):
        self.items, at = [], 0
        source = source.strip()
        while at < len(source):
            m = _EXPR.match(source, at)
            if not m:
                raise TemplateError(f"unexpected {source[at:]!r}")
            self.items.append((m.lastindex, m[m.lastindex]))
            at = m.end()
        self.at = 0

    def take(self, *wanted: str) -> str | None:
        if self.at < len(self.items) and self.items[self.at][0] in (3, 4) and self.items[self.at][1] in wanted:
            self.at += 1
            return self.items[self.at - 1][1]
        return None

    def name(self, what: str) -> str:
        if self.at >= len(self.items) or self.items[self.at][0] != 3 or self.items[self.at][1].startswith("_"):
            raise TemplateError(f"{what} expected")
        self.at += 1
        return self.items[self.at - 1][1]

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            raise TemplateError(f"missing {wanted}")

    def parse(self) -> tuple:
        node = self.chosen()
        if self.at < len(self.items):
            raise TemplateError(f"unexpected {self.items[self.at][1]!r}")
        return node

    def chosen(self) -> tuple:
        node = self.either()
        if self.take("if"):
            test = self.either()
            node = ("choose", test, node, self.chosen() if self.take("else") else ("const", ""))
        return node

    def _chain(self, below: Callable[[], tuple], *operators: str) -> tuple:
        node = below()
        while op := self.take(*operators):
            node = (op, node, below())
        return node

    def either(self) -> tuple:
        return self._chain(self.both, "or")

    def both(self) -> tuple:
        return self._chain(self.negated, "and")

    def negated(self) -> tuple:
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self) -> tuple:
        node = self.joined()
        if op := self.take("==", "!=", "<", ">", "<=", ">=", "in"):
            return (op, node, self.joined())
        if self.take("not"):
            self.need("in")
            return ("not", ("in", node, self.joined()))
        return node

    def joined(self) -> tuple:
        return self._chain(lambda: self._chain(lambda: self._chain(self.tested, "%"), "+", "-"), "~")

    def tested(self) -> tuple:
        node = self.filtered()
        if self.take("is"):
            negate = self.take("not")
            name = self.name("test")
            if name not in TESTS:
                raise TemplateError(f"no test {name!r}")
            node = ("is", name, node)
            node = ("not", node) if negate else node
        return node

    def filtered(self) -> tuple:
        node = self.reached()
        while self.take("|"):
            name = self.name("filter")
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            node = ("filter", name, node)
        return node

    def reached(self) -> tuple:
        node = self.atom()
        while op := self.take(".", "["):
            if op == ".":
                node = ("item", node, ("const", self.name("field name")))
                continue
            start = ("const", None) if self.take(":") else self.chosen()
            if self.items[self.at - 1][1] == ":" or self.take(":"):
                stop = ("const", None) if self.take("]") else self.chosen()
                if self.items[self.at - 1][1] != "]" or stop != ("const", None):
                    self.need("]")
                node = ("slice", node, start, stop)
            else:
                self.need("]")
                node = ("item", node, start)
        return node

    def atom(self) -> tuple:
        if self.at >= len(self.items):
            raise TemplateError("expression ends early")
        kind, value = self.items[self.at]
        self.at += 1
        if kind == 1:
            return ("const", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), value[1:-1]))
        if kind == 2:
            return ("const", int(value))
        if value == "-":
            inner = self.atom()
            if inner[0] != "const" or not isinstance(inner[1], int):
                raise TemplateError("number expected after -")
            return ("const", -inner[1])
        if value == "(":
            node = self.chosen()
            self.need(")")
            return node
        if kind != 3 or value.startswith("_"):
            raise TemplateError(f"unexpected {value!r}")
        if value == "namespace" and self.take("("):
            fields = []
            while not self.take(")"):
                name = self.name("field name")
                self.need("=")
                fields.append((name, self.chosen()))
                self.take(",")
            return ("namespace", tuple(fields))
        return ("const", _CONSTANTS[value]) if value in _CONSTANTS else ("name", value)


def _parts(template: str) -> Iterator[str]:
    """Tags and text between them, white space next to `-` marks taken off."""
    strip = False
    pieces = _LEX.split(template)
    for i, part in enumerate(pieces):
        if i % 2:
            strip = part.endswith(("-}}", "-%}", "-#}"))
            yield part[:2] + part[2:-2].removeprefix("-").removesuffix("-") + part[-2:]
        else:
            part = part.lstrip() if strip else part
            if i + 1 < len(pieces) and pieces[i + 1][2:3] == "-":
                part = part.rstrip()
            if part:
                yield part


def parse(template: str) -> list[tuple]:
    """Syntax tree: ('text', s), ('out', e), ('if', [(e, body)...], otherwise), ('for', name, e, body), ('set', name, field or None, e), ('generation', body)."""
    parts = _parts(template)

    def block(until: tuple[str, ...]) -> tuple[list[tuple], str, str]:
        nodes: list[tuple] = []
        for part in parts:
            if part.startswith("{#"):
                continue
            if part.startswith("{{"):
                nodes.append(("out", _Expression(part[2:-2]).parse()))
            elif part.startswith("{%"):
                word, _, rest = part[2:-2].strip().partition(" ")
                if word in until:
                    return nodes, word, rest
                if word == "for":
                    m = re.fullmatch(r"\s*([A-Za-z]\w*)\s+in\s+(.+)", rest, re.DOTALL)
                    if not m:
                        raise TemplateError("for NAME in LIST expected")
                    nodes.append(("for", m[1], _Expression(m[2]).parse(), block(("endfor",))[0]))
                elif word == "set":
                    m = re.fullmatch(r"\s*([A-Za-z]\w*)(?:\.([A-Za-z]\w*))?\s*=(?!=)(.+)", rest, re.DOTALL)
                    if not m:
                        raise TemplateError("set NAME = VALUE expected")
                    nodes.append(("set", m[1], m[2], _Expression(m[3]).parse()))
                elif word == "generation":
                    nodes.append(("generation", block(("endgeneration",))[0]))
                elif word == "if":
                    arms, otherwise, test = [], [], rest
                    while True:
                        body, word, rest = block(("elif", "else", "endif"))
                        arms.append((_Expression(test).parse(), body))
                        if word == "else":
                            otherwise, word, _ = block(("endif",))
                        if word == "endif":
                            break
                        test = rest
                    nodes.append(("if", arms, otherwise))
                else:
                    raise TemplateError(f"unknown tag {word!r}")
            else:
                nodes.append(("text", part))
        if until:
            raise TemplateError(f"missing {until[0]}")
        return nodes, "", ""

    return block(())[0]


def _item(x: object, key: object) -> object:
    if isinstance(x, dict):
        return x.get(key, MISSING)
    if isinstance(x, (str, list)) and isinstance(key, int):
        return x[key] if -len(x) <= key < len(x) else MISSING
    return MISSING


def _slice(x: object, a: object, b: object) -> object:
    bound = lambda v: v if isinstance(v, int) else None
    return x[bound(a) : bound(b)] if isinstance(x, (str, list)) else MISSING


def _add(a: object, b: object) -> object:
    if isinstance(a, list) and isinstance(b, list):
        return a + b
    return a + b if isinstance(a, int) and isinstance(b, int) else _text(a) + _text(b)


def _less(a: object, b: object) -> bool:
    return a < b if isinstance(a, int) and isinstance(b, int) or isinstance(a, str) and isinstance(b, str) else False


_BINARY: dict[str, Callable[[object, object], object]] = {
    "~": lambda a, b: _text(a) + _text(b), "+": _add, "-": lambda a, b: a - b if isinstance(a, int) and isinstance(b, int) else 0, "%": lambda a, b: a % b if isinstance(a, int) and isinstance(b, int) and b else 0,
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": _less, ">": lambda a, b: _less(b, a), "<=": lambda a, b: a == b or _less(a, b), ">=": lambda a, b: a == b or _less(b, a),
    "in": lambda a, b: (isinstance(a, str) or not isinstance(b, str)) and a in b if isinstance(b, (str, list, dict)) else False, "item": _item,
}


def _fold_expression(e: tuple, constants: dict[str, object]) -> tuple:
    kind = e[0]
    if kind == "name" and e[1] in constants:
        return ("const", constants[e[1]])
    if kind in ("const", "name"):
        return e
    if kind == "namespace":
        return (kind, tuple((name, _fold_expression(x, constants)) for name, x in e[1]))
    head = e[:2] if kind in ("filter", "is") else e[:1]
    args = [_fold_expression(x, constants) for x in e[len(head) :]]
    if kind == "choose" and args[0][0] == "const":
        return args[1] if args[0][1] else args[2]
    return ("const", _value((*head, *args))({})) if all(a[0] == "const" for a in args) else (*head, *args)


def _assigned(nodes: list[tuple]) -> set[str]:
    """Names that a template sets or loops with, at any depth: no constants."""
    out: set[str] = set()
    for node in nodes:
        if node[0] in ("set", "for"):
            out.add(node[1])
        for part in ([node[3]] if node[0] == "for" else [node[1]] if node[0] == "generation" else [*(b for _, b in node[1]), node[2]] if node[0] == "if" else []):
            out |= _assigned(part)
    return out


def fold(nodes: list[tuple], constants: dict[str, object]) -> list[tuple]:
    """Evaluate constant expressions, drop dead branches and merge neighbouring text."""
    return _fold(nodes, {k: v for k, v in constants.items() if k not in _assigned(nodes)})


def _fold(nodes: list[tuple], constants: dict[str, object]) -> list[tuple]:
    out: list[tuple] = []

    def add(node: tuple) -> None:
        if node[0] == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + node[1])
        elif node != ("text", ""):
            out.append(node)

    for node in nodes:
        kind = node[0]
        if kind == "out":
            e = _fold_expression(node[1], constants)
            add(("text", _text(e[1])) if e[0] == "const" else ("out", e))
        elif kind == "if":
            arms, otherwise = [], _fold(node[2], constants)
            for test, body in node[1]:
                e = _fold_expression(test, constants)
                if e[0] != "const":
                    arms.append((e, _fold(body, constants)))
                elif e[1]:
                    otherwise = _fold(body, constants)
                    break
            if arms:
                add(("if", arms, otherwise))
            else:
                for x in otherwise:
                    add(x)
        elif kind == "for":
            add(("for", node[1], _fold_expression(node[2], constants), _fold(node[3], constants)))
        elif kind == "set":
            add(("set", node[1], node[2], _fold_expression(node[3], constants)))
        elif kind == "generation":
            add(("generation", _fold(node[1], constants)))
        else:
            add(node)
    return out


def _value(e: tuple) -> Callable[[dict], object]:
    kind = e[0]
    if kind == "const":
        return lambda env: e[1]
    if kind == "name":
        return lambda env: env.get(e[1], MISSING)
    if kind == "namespace":
        fields = [(name, _value(x)) for name, x in e[1]]
        return lambda env: {name: f(env) for name, f in fields}
    if kind == "filter":
        f, inner = FILTERS[e[1]], _value(e[2])
        return lambda env: f(inner(env))
    if kind == "is":
        test, inner = TESTS[e[1]], _value(e[2])
        return lambda env: (x := inner(env)) is not MISSING and test(x)
    if kind in ("choose", "slice"):
        a, b, c = map(_value, e[1:])
        return (lambda env: b(env) if a(env) else c(env)) if kind == "choose" else lambda env: _slice(a(env), b(env), c(env))
    a, b = _value(e[1]), _value(e[-1])
    if kind in ("and", "or", "not"):
        return {"and": lambda env: a(env) and b(env), "or": lambda env: a(env) or b(env), "not": lambda env: not a(env)}[kind]
    f = _BINARY[kind]
    return lambda env: f(a(env), b(env))


#: Of the names in force: pieces of text and whether they are generated.
_Pieces = Callable[[dict], Iterator[tuple[str, bool]]]


def _loop(name: str, value: Callable[[dict], object], body: _Pieces) -> _Pieces:
    def run(env: dict) -> Iterator[tuple[str, bool]]:
        source = value(env)
        items = iter(source) if isinstance(source, (list, str, dict)) or hasattr(source, "__next__") else iter(())
        item, i = next(items, MISSING), 0
        inner = dict(env)  # what a body sets ends with the loop; a namespace's fields stay
        while item is not MISSING:
            after = next(items, MISSING)
            inner |= {name: item, "loop": {"index": i + 1, "index0": i, "first": i == 0, "last": after is MISSING}}
            yield from body(inner)
            item, i = after, i + 1

    return run


def _assign(name: str, field: str | None, value: Callable[[dict], object]) -> _Pieces:
    def run(env: dict) -> Iterator[tuple[str, bool]]:
        if field is None:
            env[name] = value(env)
        elif isinstance(env.get(name), dict):
            env[name][field] = value(env)
        return iter(())

    return run


def _closure(nodes: list[tuple], masked: bool) -> _Pieces:
    """A generator function over (piece, is generated)."""
    steps: list[_Pieces] = []
    for node in nodes:
        kind = node[0]
        if kind == "text":
            steps.append(lambda env, s=node[1]: iter(((s, masked),)))
        elif kind == "out":
            steps.append(lambda env, f=_value(node[1]): iter(((_text(f(env)), masked),)))
        elif kind == "generation":
            steps.append(_closure(node[1], True))
        elif kind == "for":
            steps.append(_loop(node[1], _value(node[2]), _closure(node[3], masked)))
        elif kind == "set":
            steps.append(_assign(node[1], node[2], _value(node[3])))
        else:
            arms = [(_value(test), _closure(body, masked)) for test, body in node[1]]

            def choose(env: dict, arms=arms, otherwise=_closure(node[2], masked)) -> Iterator[tuple[str, bool]]:
                return next((body for test, body in arms if test(env)), otherwise)(env)

            steps.append(choose)

    def run(env: dict) -> Iterator[tuple[str, bool]]:
        for step in steps:
            yield from step(env)

    return run


def _uses(nodes: list[tuple] | tuple, name: str) -> int:
    """How often a tree names a variable."""
    if isinstance(nodes, tuple) and nodes[:1] == ("name",):
        return int(nodes[1] == name)
    return sum(_uses(x, name) for x in nodes if isinstance(x, (tuple, list)))


@lru_cache(maxsize=8)
def compile_template(template: str, constants: tuple[tuple[str, object], ...] = (("bos", "<s>"), ("eos", "</s>"), ("bos_token", "<s>"), ("eos_token", "</s>"), ("add_generation_prompt", False))) -> Callable[[Iterator[dict]], Iterator[tuple[str, bool]]]:
    """A function of a conversation's messages that yields (piece, is generated)."""
    tree = fold(parse(template), dict(constants))
    body = _closure(tree, False)
    once = _uses(tree, "messages") == 1 and any(node[0] == "for" and node[2] == ("name", "messages") for node in tree)
    return lambda messages: body({"messages": messages if once else list(messages)})


def render(template: str, messages: Iterator[dict]) -> tuple[str, list[tuple[int, int]]]:
    """(formatted text, [start, end) spans of generated code points)."""
    parts, spans, at = [], [], 0
    for piece, generated in compile_template(template)(messages):
        if generated:
            spans.append((at, at + len(piece)))
        parts.append(piece)
        at += len(piece)
    return "".join(parts), spans


def format_chats(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """(conv_id, formatted, spans): one shuffle by conversation, rows sorted within; a task streams one conversation after another."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    kind = rows.schema["conv_id"].dataType.simpleString()
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_type = None

        def messages() -> Iterator[tuple]:
            nonlocal id_type
            for batch in batches:
                id_type = batch.schema.field("conv_id").type
                yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True)

        for conv_id, group in groupby(messages(), key=lambda r: r[0]):
            formatted, spans = render(template, ({"role": r, "text": t, "content": t} for _, r, t in group))
            yield pa.RecordBatch.from_arrays([pa.array([conv_id], id_type), pa.array([formatted]), pa.array([[{"start": a, "end": b} for a, b in spans]], spans_type)], names=["conv_id", "formatted", "spans"])

    return ordered.mapInArrow(run, f"conv_id {kind}, formatted string, spans array<struct<start: long, end: long>>")


_TURN = re.compile(r"<s>\[INST\] (.*?) \[/INST\] (.*?)</s>", re.DOTALL)


def read_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of a conversation in the production template."""
    for m in _TURN.finditer(formatted):
        yield unescape(m[1]), unescape(m[2])


def digest_chats(formatted: DataFrame) -> DataFrame:
    """Turn and loss digests, read back from formatted text and spans alone."""
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column("formatted").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                turns, loss, n, chars = hashlib.sha256(), hashlib.sha256(), 0, 0
                for role, body in read_turns(text):
                    turns.update(f"{role}\n{body}\n".encode())
                    n += 1
                for s in spans:
                    body = unescape(text[s["start"] : s["end"]])
                    loss.update(body.encode())
                    chars += len(body)
                rows.append((n, turns.hexdigest(), chars, loss.hexdigest(), len(text)))
            cols = [*zip(*rows, strict=True)] or [()] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
