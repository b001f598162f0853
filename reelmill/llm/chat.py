"""Chat formatting: a compiler for a sandboxed template language.

A template is parsed into a syntax tree, constants are folded, and the tree becomes Python closures that yield the
output piece by piece. `{% generation %}` blocks mark what a model is trained on. Templates see only the variables
they are given, entries of these, and the filters, tests, functions and text methods listed below: no other calls, no
attributes of Python objects, no imports. What the language lacks is an error when the template is compiled.

    text    := anything else; {# comments #} give nothing
    output  := {{ expr }}
    if      := {% if expr %} .. {% elif expr %} .. {% else %} .. {% endif %}
    for     := {% for name[, name] in expr [if expr] %} .. [{% else %} ..] {% endfor %}     (loop: see LOOP)
    set     := {% set name = expr %}, {% set name.entry = expr %} for a namespace
    mark    := {% generation %} .. {% endgeneration %}
    expr    := expr if expr else expr; or, and, not; == != < <= > >=, in, not in, is [not] test; + -; ~ (joins texts);
               * // / %; -x; x.entry, x[expr], x[from:to:step], x | filter(args), x.method(args), function(args);
               names, 'text', numbers, true, false, none, [list], {'key': value}, (expr)

A `-` inside a delimiter strips white space on that side. A name set in a loop is forgotten after the turn of the loop.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelmill.llm._shared import shuffle_partitions

#: The strings that mark turns here, and those of other common chat formats. None may stand in a text.
TURN, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
CONTROLS = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
TEMPLATE = (
    "{% for m in messages %}<|im_start|>{{ m.role | escape }}<|im_sep|>"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}<|im_end|>\n{% endfor %}"
)

_CONTROL = re.compile(r"\\|" + "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROLS))


def escape(text: str) -> str:
    """Breaks every control string by a backslash after its first character, and doubles backslashes."""
    return _CONTROL.sub(lambda m: m.group() + "\\", text)


def unescape(text: str) -> str:
    """Undoes escape(): a doubled backslash becomes one, any other goes."""
    if "\\" not in text:
        return text
    return re.sub(r"\\\\|\\", lambda m: "\\" if len(m.group()) == 2 else "", text)


class TemplateError(ValueError):
    """A template that doesn't follow the grammar, or that raises while it renders."""


class _Missing:
    """The value of a name or entry that isn't there: false, shown as nothing."""

    def __bool__(self) -> bool:
        return False


MISSING = _Missing()


class Namespace(dict):
    """What namespace(..) makes: entries that {% set name.entry = .. %} may change, also from within loops."""


def _show(value: Any) -> str:
    if value is None or value is MISSING:
        return ""
    return ("true" if value else "false") if isinstance(value, bool) else str(value)


def _raise(message: Any = "") -> None:
    raise TemplateError(_show(message))


def _range(*ends: int) -> list[int]:
    found = range(*ends)
    return list(found) if len(found) <= 1_000_000 else _raise("a range is too long")


def _default(value: Any, other: Any = "", also_false: bool = False) -> Any:
    return other if value is MISSING or also_false and not value else value


def _replace(value: Any, old: str, new: str) -> str:
    return _show(value).replace(_show(old), _show(new))


def _json(value: Any, indent: int | None = None) -> str:
    return json.dumps(None if value is MISSING else value, ensure_ascii=False, indent=indent)


FILTERS: dict[str, Callable[..., Any]] = {
    "escape": lambda v: escape(_show(v)),
    "trim": lambda v: _show(v).strip(),
    "upper": lambda v: _show(v).upper(),
    "lower": lambda v: _show(v).lower(),
    "capitalize": lambda v: _show(v).capitalize(),
    "title": lambda v: _show(v).title(),
    "string": _show,
    "int": lambda v, other=0: int(v) if re.fullmatch(r"\s*-?\d+\s*", _show(v)) else other,
    "length": lambda v: len(v) if isinstance(v, (str, list, dict)) else 0,
    "first": lambda v: v[0] if isinstance(v, (str, list)) and v else MISSING,
    "last": lambda v: v[-1] if isinstance(v, (str, list)) and v else MISSING,
    "list": lambda v: list(v or ()),
    "items": lambda v: [[k, x] for k, x in v.items()] if isinstance(v, dict) else [],
    "join": lambda v, between="": _show(between).join(map(_show, v or ())),
    "replace": _replace,
    "default": _default,
    "tojson": _json,
}
TESTS: dict[str, Callable[[Any], bool]] = {
    "defined": lambda v: v is not MISSING,
    "undefined": lambda v: v is MISSING,
    "none": lambda v: v is None,
    "string": lambda v: isinstance(v, str),
    "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
    "boolean": lambda v: isinstance(v, bool),
    "mapping": lambda v: isinstance(v, dict),
    "sequence": lambda v: isinstance(v, (str, list, dict)),
    "iterable": lambda v: isinstance(v, (str, list, dict)),
    "true": lambda v: v is True,
    "false": lambda v: v is False,
    "odd": lambda v: isinstance(v, int) and v % 2 == 1,
    "even": lambda v: isinstance(v, int) and v % 2 == 0,
}
FUNCTIONS: dict[str, Callable[..., Any]] = {"namespace": Namespace, "raise_exception": _raise, "range": _range}
METHODS: dict[str, Callable[..., Any]] = {
    "strip": lambda v, chars=None: _show(v).strip(chars),
    "lstrip": lambda v, chars=None: _show(v).lstrip(chars),
    "rstrip": lambda v, chars=None: _show(v).rstrip(chars),
    "upper": FILTERS["upper"],
    "lower": FILTERS["lower"],
    "title": FILTERS["title"],
    "startswith": lambda v, start: _show(v).startswith(_show(start)),
    "endswith": lambda v, end: _show(v).endswith(_show(end)),
    "replace": _replace,
    "split": lambda v, between=None: _show(v).split(between),
    "items": FILTERS["items"],
    "keys": lambda v: list(v) if isinstance(v, dict) else [],
    "values": lambda v: list(v.values()) if isinstance(v, dict) else [],
    "get": lambda v, key, other=None: v.get(key, other) if isinstance(v, dict) else other,
}
#: What a loop tells of its turn. Its length is unknown while its input still arrives.
LOOP = ("index", "index0", "first", "last", "previtem", "nextitem")


@dataclass(frozen=True)
class Node:
    """An expression (const, name, entry, slice, filter, test, call, method, list, dict, cond, not, neg or an operator) or a
    statement (out, if, for, set, put, mark, seq)."""

    kind: str
    parts: tuple


_EXPR = re.compile(r"\s*(?:(?P<text>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<number>\d+(?:\.\d+)?)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|//|[<>~|.,:()\[\]{}=+*/%-]))", re.DOTALL)
_TAG = re.compile(r"\{\{(-?)(.*?)(-?)\}\}|\{%(-?)(.*?)(-?)%\}|\{#(-?)(.*?)(-?)#\}", re.DOTALL)


def _add(a: Any, b: Any) -> Any:
    for kind in (str, list, (int, float)):
        if isinstance(a, kind) and isinstance(b, kind):
            return a + b
    raise TemplateError(f"{_show(a)!r} and {_show(b)!r} can't be added")


def _number(apply: Callable[[Any, Any], Any]) -> Callable[[Any, Any], Any]:
    def run(a: Any, b: Any) -> Any:
        if isinstance(a, (int, float)) and isinstance(b, (int, float)):
            return apply(a, b)
        raise TemplateError("only numbers can be reckoned with")

    return run


def _compared(apply: Callable[[Any, Any], bool]) -> Callable[[Any, Any], bool]:
    def run(a: Any, b: Any) -> bool:
        if isinstance(a, str) and isinstance(b, str) or isinstance(a, (int, float)) and isinstance(b, (int, float)):
            return apply(a, b)
        raise TemplateError("only two numbers or two texts can be compared")

    return run


OPERATORS: dict[str, Callable[[Any, Any], Any]] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": _compared(lambda a, b: a < b),
    "<=": _compared(lambda a, b: a <= b),
    ">": _compared(lambda a, b: a > b),
    ">=": _compared(lambda a, b: a >= b),
    "in": lambda a, b: a in b if isinstance(b, (list, dict)) or isinstance(b, str) and isinstance(a, str) else False,
    "+": _add,
    "-": _number(lambda a, b: a - b),
    "*": _number(lambda a, b: a * b),
    "/": _number(lambda a, b: a / b if b else _raise("division by zero")),
    "//": _number(lambda a, b: a // b if b else _raise("division by zero")),
    "%": _number(lambda a, b: a % b if b else _raise("division by zero")),
    "~": lambda a, b: _show(a) + _show(b),
}
_RESERVED = {"if", "else", "in", "is", "and", "or", "not"}


class _Expression:
    """Recursive descent over one expression."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.strip()
        while at < len(source):
            found = _EXPR.match(source, at)
            if not found:
                raise TemplateError(f"unexpected {source[at:]!r}")
            self.tokens.append((found.lastgroup, found.group(found.lastgroup)))
            at = found.end()
        self.at = 0

    def _is(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] in ("op", "name") and self.tokens[self.at][1] in values

    def _take(self) -> tuple[str, str]:
        if self.at == len(self.tokens):
            raise TemplateError("an expression ends too early")
        self.at += 1
        return self.tokens[self.at - 1]

    def _want(self, value: str) -> None:
        if not self._is(value):
            raise TemplateError(f"{value!r} is missing")
        self.at += 1

    def _named(self, known: dict, what: str) -> str:
        kind, value = self._take()
        if kind != "name" or value not in known:
            raise TemplateError(f"no {what} {value!r}")
        return value

    def whole(self) -> Node:
        node = self.choice()
        if self.at != len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def choice(self) -> Node:
        node = self.any()
        while self._is("if"):
            self._take()
            test, other = self.any(), Node("const", (MISSING,))
            if self._is("else"):
                self._take()
                other = self.choice()
            node = Node("cond", (test, node, other))
        return node

    def any(self) -> Node:
        node = self.all()
        while self._is("or"):
            self._take()
            node = Node("or", (node, self.all()))
        return node

    def all(self) -> Node:
        node = self.negated()
        while self._is("and"):
            self._take()
            node = Node("and", (node, self.negated()))
        return node

    def negated(self) -> Node:
        if self._is("not"):
            self._take()
            return Node("not", (self.negated(),))
        return self.compared()

    def compared(self) -> Node:
        node = self.summed()
        while self._is("==", "!=", "<", "<=", ">", ">=", "in", "not", "is"):
            op = self._take()[1]
            if op == "is":
                negative = self._is("not") and bool(self._take())
                node = Node("test", (node, self._named(TESTS, "test")))
                node = Node("not", (node,)) if negative else node
            elif op == "not":
                self._want("in")
                node = Node("not", (Node("in", (node, self.summed())),))
            else:
                node = Node(op, (node, self.summed()))
        return node

    def _chain(self, ops: tuple[str, ...], inner: Callable[[], Node]) -> Node:
        node = inner()
        while self._is(*ops):
            node = Node(self._take()[1], (node, inner()))
        return node

    def summed(self) -> Node:
        return self._chain(("+", "-"), self.joined)

    def joined(self) -> Node:
        return self._chain(("~",), self.multiplied)

    def multiplied(self) -> Node:
        return self._chain(("*", "/", "//", "%"), self.signed)

    def signed(self) -> Node:
        if self._is("-"):
            self._take()
            return Node("neg", (self.signed(),))
        return self.filtered()

    def _arguments(self) -> tuple[tuple[str, Node], ...]:
        """(name or '', value) of each argument, behind an opening bracket."""
        found: list[tuple[str, Node]] = []
        while not self._is(")"):
            name = ""
            if self.at + 1 < len(self.tokens) and self.tokens[self.at][0] == "name" and self.tokens[self.at + 1] == ("op", "="):
                name = self._take()[1]
                self._take()
            found.append((name, self.choice()))
            if not self._is(")"):
                self._want(",")
        self._want(")")
        return tuple(found)

    def filtered(self) -> Node:
        node = self.atom()
        while self._is("|", ".", "["):
            op = self._take()[1]
            if op == "[":
                node = self._bracket(node)
            elif op == "|":
                name = self._named(FILTERS, "filter")
                arguments = self._arguments() if self._is("(") and self._take() else ()
                node = Node("filter", (node, name, arguments))
            else:
                kind, name = self._take()
                if kind != "name":
                    raise TemplateError("a name is missing after '.'")
                if self._is("("):
                    self._take()
                    if name not in METHODS:
                        raise TemplateError(f"no method {name!r}")
                    node = Node("method", (node, name, self._arguments()))
                else:
                    if node == Node("name", ("loop",)) and name not in LOOP:
                        raise TemplateError(f"a loop has no {name!r}")
                    node = Node("entry", (node, Node("const", (name,))))
        return node

    def _bracket(self, node: Node) -> Node:
        ends: list[Node | None] = [None]
        while not self._is("]"):
            if self._is(":"):
                self._take()
                ends.append(None)
            elif ends[-1] is None:
                ends[-1] = self.choice()
            else:
                break
        self._want("]")
        if len(ends) > 3 or ends == [None]:
            raise TemplateError("not an entry or a slice")
        if len(ends) == 1:
            return Node("entry", (node, ends[0]))
        return Node("slice", (node, *(e or Node("const", (None,)) for e in (*ends, None)[:3])))

    def atom(self) -> Node:
        kind, value = self._take()
        if kind == "text":
            return Node("const", (_literal(value),))
        if kind == "number":
            return Node("const", (float(value) if "." in value else int(value),))
        if value == "(":
            node = self.choice()
            self._want(")")
            return node
        if value == "[":
            items = []
            while not self._is("]"):
                items.append(self.choice())
                if not self._is("]"):
                    self._want(",")
            self._want("]")
            return Node("list", tuple(items))
        if value == "{":
            pairs: list[Node] = []
            while not self._is("}"):
                pairs.append(self.choice())
                self._want(":")
                pairs.append(self.choice())
                if not self._is("}"):
                    self._want(",")
            self._want("}")
            return Node("dict", tuple(pairs))
        if kind == "name" and value not in _RESERVED:
            fixed = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}
            if value in fixed:
                return Node("const", (fixed[value],))
            if self._is("("):
                self._take()
                if value not in FUNCTIONS:
                    raise TemplateError(f"no function {value!r}")
                return Node("call", (value, self._arguments()))
            return Node("name", (value,))
        raise TemplateError(f"unexpected {value!r}")


def _literal(quoted: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), quoted[1:-1], flags=re.DOTALL)


def parse(template: str, trim_blocks: bool = False, lstrip_blocks: bool = False) -> Node:
    """The syntax tree of a template. trim_blocks: the line end behind a {% tag %} goes; lstrip_blocks: white space that alone
    stands before one on its line goes."""
    pieces: list[tuple[str, str]] = []
    at, strip, block = 0, False, False
    for tag in (*_TAG.finditer(template), None):
        text = template[at : tag.start()] if tag else template[at:]
        text = text.lstrip() if strip else text.removeprefix("\n") if block and trim_blocks else text
        if tag:
            kind = next(k for k, n in (("out", 2), ("tag", 5), ("note", 8)) if tag[n] is not None)
            if tag[1] or tag[4] or tag[7]:
                text = text.rstrip()
            elif lstrip_blocks and kind != "out":
                text = re.sub(r"(^|\n)[ \t]+$" if at == 0 or "\n" in text else r"(?!)", r"\1", text)
        if "{%" in text or "{{" in text or "{#" in text:
            raise TemplateError("a tag isn't closed")
        pieces.append(("text", text))
        if tag:
            if kind != "note":
                pieces.append((kind, tag[2] if kind == "out" else tag[5].strip()))
            at, strip, block = tag.end(), bool(tag[3] or tag[6] or tag[9]), kind != "out"
    node, rest, closer = _sequence(pieces, 0, ())
    if closer:
        raise TemplateError(f"unexpected {closer!r}")
    return node


def _sequence(pieces: list[tuple[str, str]], at: int, closers: tuple[str, ...]) -> tuple[Node, int, str]:
    found: list[Node] = []
    while at < len(pieces):
        kind, body = pieces[at]
        at += 1
        if kind == "text":
            found.append(Node("out", (Node("const", (body,)),)))
        elif kind == "out":
            found.append(Node("out", (_Expression(body).whole(),)))
        else:
            word, rest = (re.match(r"(\w*)(.*)", body, re.DOTALL) or _raise("an empty tag")).groups()
            if word in closers:
                return Node("seq", tuple(found)), at, body
            if word == "for":
                loop = re.fullmatch(r"\s*([A-Za-z_]\w*(?:\s*,\s*[A-Za-z_]\w*)*)\s+in\s+(.*)", rest, re.DOTALL)
                if not loop:
                    raise TemplateError(f"not a loop: {body!r}")
                items = _Expression(loop[2])
                source, test = items.any(), Node("const", (True,))
                if items._is("if"):
                    items._take()
                    test = items.any()
                if items.at != len(items.tokens):
                    raise TemplateError(f"not a loop: {body!r}")
                inner, at, closer = _closed(pieces, at, ("else", "endfor"))
                empty = Node("seq", ())
                if closer == "else":
                    empty, at, _ = _closed(pieces, at, ("endfor",))
                found.append(Node("for", (tuple(re.split(r"\s*,\s*", loop[1])), source, test, inner, empty)))
            elif word == "set":
                put = re.fullmatch(r"\s*([A-Za-z_]\w*)(?:\.([A-Za-z_]\w*))?\s*=(?!=)(.*)", rest, re.DOTALL)
                if not put:
                    raise TemplateError(f"not a setting: {body!r}")
                found.append(Node("set", (put[1], put[2] or "", _Expression(put[3]).whole())))
            elif word == "generation":
                inner, at, _ = _closed(pieces, at, ("endgeneration",))
                found.append(Node("mark", (inner,)))
            elif word == "if":
                branches, other = [], Node("seq", ())
                test = _Expression(rest).whole()
                while True:
                    inner, at, closer = _closed(pieces, at, ("elif", "else", "endif"))
                    branches.append((test, inner))
                    if closer.startswith("elif"):
                        test = _Expression(closer[4:]).whole()
                        continue
                    if closer == "else":
                        other, at, _ = _closed(pieces, at, ("endif",))
                    break
                for test, inner in reversed(branches):
                    other = Node("if", (test, inner, other))
                found.append(other)
            else:
                raise TemplateError(f"unknown tag {body!r}")
    return Node("seq", tuple(found)), at, ""


def _closed(pieces: list, at: int, closers: tuple[str, ...]) -> tuple[Node, int, str]:
    node, at, closer = _sequence(pieces, at, closers)
    if not closer:
        raise TemplateError(f"{closers[-1]!r} is missing")
    return node, at, closer


#: Expressions that give the same value whenever their parts are constants.
_PURE = {"not", "neg", "and", "or", "cond", "entry", "slice", "filter", "test", "method", *OPERATORS}


def _inner(part: Any) -> list[Node]:
    return [part] if isinstance(part, Node) else [n for p in part for n in _inner(p)] if isinstance(part, tuple) else []


def _folded(part: Any) -> Any:
    return fold(part) if isinstance(part, Node) else tuple(map(_folded, part)) if isinstance(part, tuple) else part


def fold(node: Node) -> Node:
    """Constant folding: operations on constants are done, decided branches are chosen, neighbouring texts are joined."""
    kind, parts = node.kind, node.parts
    if kind in ("const", "name"):
        return node
    if kind == "seq":
        flat: list[Node] = []
        for part in map(fold, parts):
            flat += part.parts if part.kind == "seq" else [part]
        out: list[Node] = []
        for part in flat:
            if part.kind == "out" and part.parts[0].kind == "const":
                text = _show(part.parts[0].parts[0])
                if not text:
                    continue
                if out and out[-1].kind == "out" and out[-1].parts[0].kind == "const":
                    text = out.pop().parts[0].parts[0] + text
                part = Node("out", (Node("const", (text,)),))
            out.append(part)
        return Node("seq", tuple(out))
    folded = _folded(parts)
    done = Node(kind, folded)
    if kind in ("if", "cond") and folded[0].kind == "const":
        return folded[1] if folded[0].parts[0] else folded[2]
    if kind in _PURE and all(p.kind == "const" for part in folded for p in _inner(part)):
        try:
            return Node("const", (_value(done)({}),))
        except TemplateError:
            return done  # an error only if it is reached
    return done


def _entry(held: Any, key: Any) -> Any:
    if isinstance(held, dict):
        return held.get(key, MISSING)
    if isinstance(held, (list, str)) and isinstance(key, int) and -len(held) <= key < len(held):
        return held[key]
    return MISSING


def _slice(held: Any, *ends: Any) -> Any:
    if not all(e is None or isinstance(e, int) for e in ends) or ends[2] == 0:
        raise TemplateError("a slice needs whole numbers and a step")
    return held[slice(*ends)] if isinstance(held, (list, str)) else MISSING


def _called(apply: Callable[..., Any], given: tuple[tuple[str, Node], ...], what: str) -> Callable[..., Any]:
    """A closure for a call with given arguments behind those that it gets itself."""
    plain = [_value(v) for name, v in given if not name]
    named = {name: _value(v) for name, v in given if name}

    def run(scope: dict, *first: Any) -> Any:
        try:
            return apply(*first, *(v(scope) for v in plain), **{k: v(scope) for k, v in named.items()})
        except TypeError:
            raise TemplateError(f"wrong arguments for {what!r}") from None

    return run


def _value(node: Node) -> Callable[[dict], Any]:
    """A closure for an expression."""
    kind, parts = node.kind, node.parts
    if kind == "const":
        fixed = parts[0]
        return lambda scope: fixed
    if kind == "name":
        name = parts[0]
        return lambda scope: scope.get(name, MISSING)
    if kind == "call":
        return _called(FUNCTIONS[parts[0]], parts[1], parts[0])
    if kind == "list":
        items = list(map(_value, parts))
        return lambda scope: [v(scope) for v in items]
    if kind == "dict":
        pairs = list(zip(map(_value, parts[::2]), map(_value, parts[1::2]), strict=True))
        return lambda scope: {k(scope): v(scope) for k, v in pairs}
    first = _value(parts[0])
    if kind == "test":
        holds = TESTS[parts[1]]
        return lambda scope: holds(first(scope))
    if kind in ("filter", "method"):
        apply = (FILTERS if kind == "filter" else METHODS)[parts[1]]
        if not parts[2]:
            return lambda scope: apply(first(scope))
        run = _called(apply, parts[2], parts[1])
        return lambda scope: run(scope, first(scope))
    if kind == "not":
        return lambda scope: not first(scope)
    if kind == "neg":
        return lambda scope: OPERATORS["-"](0, first(scope))
    second = _value(parts[1])
    if kind == "entry":
        return lambda scope: _entry(first(scope), second(scope))
    if kind == "cond":
        third = _value(parts[2])
        return lambda scope: second(scope) if first(scope) else third(scope)
    if kind == "slice":
        third, fourth = _value(parts[2]), _value(parts[3])
        return lambda scope: _slice(first(scope), second(scope), third(scope), fourth(scope))
    if kind == "and":
        return lambda scope: first(scope) and second(scope)
    if kind == "or":
        return lambda scope: first(scope) or second(scope)
    apply = OPERATORS[kind]
    return lambda scope: apply(first(scope), second(scope))


Piece = tuple[str, bool]
Renderer = Callable[[dict], Iterator[Piece]]


def _turns(items: Iterator[Any]) -> Iterator[tuple[Any, dict]]:
    """Items with what the loop tells of each; one item is read ahead."""
    before, held, i = MISSING, next(items, MISSING), 0
    while held is not MISSING:
        after = next(items, MISSING)
        yield held, {"index": i + 1, "index0": i, "first": i == 0, "last": after is MISSING, "previtem": before, "nextitem": after}
        before, held, i = held, after, i + 1


def _statement(node: Node, marked: bool) -> Renderer:
    """A closure that yields (text, is it under a generation mark)."""
    kind, parts = node.kind, node.parts
    if kind == "out":
        value = _value(parts[0])
        return lambda scope: iter(((_show(value(scope)), marked),))
    if kind == "mark":
        return _statement(parts[0], True)
    if kind == "if":
        test, yes, no = _value(parts[0]), _statement(parts[1], marked), _statement(parts[2], marked)
        return lambda scope: yes(scope) if test(scope) else no(scope)
    if kind == "set":
        name, entry, value = parts[0], parts[1], _value(parts[2])

        def put(scope: dict) -> Iterator[Piece]:
            if not entry:
                scope[name] = value(scope)
            elif isinstance(held := scope.get(name), Namespace):
                held[entry] = value(scope)
            else:
                raise TemplateError(f"{name!r} is no namespace")
            return iter(())

        return put
    if kind == "for":
        names, items, test, body, empty = parts[0], _value(parts[1]), _value(parts[2]), _statement(parts[3], marked), _statement(parts[4], marked)

        def bound(item: Any) -> dict:
            if len(names) == 1:
                return {names[0]: item}
            if not isinstance(item, list) or len(item) != len(names):
                raise TemplateError("an item has another number of parts than the loop has names")
            return dict(zip(names, item, strict=True))

        def loop(scope: dict) -> Iterator[Piece]:
            ran = False
            for item, told in _turns(i for i in iter(items(scope) or ()) if test(scope | bound(i))):
                ran = True
                yield from body(scope | bound(item) | {"loop": told})
            if not ran:
                yield from empty(scope)

        return loop
    each = [_statement(part, marked) for part in parts]

    def sequence(scope: dict) -> Iterator[Piece]:
        for part in each:
            yield from part(scope)

    return sequence


def _uses(node: Node, name: str, looped: bool = False) -> list[bool]:
    """For each place where a name stands whether it is only run through, once, by a loop of its own."""
    if node == Node("name", (name,)):
        return [False]
    if node.kind == "for":
        own = node.parts[1] == Node("name", (name,))
        rest = [x for part in node.parts[2:] for x in _uses(part, name, True)]
        return [not looped, *rest] if own else _uses(node.parts[1], name, looped) + rest
    return [x for part in node.parts for n in _inner(part) for x in _uses(n, name, looped)]


class Template:
    """A compiled template: a function from variables to pieces of output."""

    def __init__(self, tree: Node):
        self._render = _statement(tree, False)
        #: May messages arrive while the output is made? Else the template needs all of them as a list.
        self.streams = _uses(tree, "messages") in ([], [True])

    def __call__(self, scope: dict) -> Iterator[Piece]:
        return self._render(dict(scope))


@lru_cache(maxsize=16)
def compile_template(template: str, trim_blocks: bool = False, lstrip_blocks: bool = False) -> Template:
    """template -> a function from variables to pieces of output. Loops may run over iterators, so output can be
    streamed while its input arrives."""
    return Template(fold(parse(template, trim_blocks, lstrip_blocks)))


class _Reader:
    """Reads turns back from a stream of output pieces, and keeps only the turn in hand."""

    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.chars = self.loss_chars = 0
        self.text: list[str] = []
        self.kept: list[str] = []

    def feed(self, piece: str, marked: bool) -> None:
        self.chars += len(piece)
        if marked:
            self.kept.append(piece)
        self.text.append(piece)
        if END in piece:
            *whole, rest = "".join(self.text).split(END)
            for turn in whole:
                role, _, text = turn.removeprefix(TURN).partition(SEP)
                self.turns.update(f"{unescape(role)}\n{unescape(text)}\n".encode("utf-8", "surrogatepass"))
                self.n_turns += 1
            self.text = [rest]
            loss = unescape("".join(self.kept))
            self.loss.update(loss.encode("utf-8", "surrogatepass"))
            self.loss_chars += len(loss)
            self.kept = []

    def row(self) -> tuple:
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def render(turns: list[dict], template: str = TEMPLATE) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text of a conversation of {role, text}, and the spans (start, end) under the loss mask."""
    out, spans, at = [], [], 0
    for piece, marked in compile_template(template)({"messages": turns}):
        if marked and piece:
            spans.append((at, at + len(piece)))
        out.append(piece)
        at += len(piece)
    return "".join(out), spans


def ordered(conversations: DataFrame) -> DataFrame:
    """Turns of a conversation together and in order: by turn, then role, then text, nulls first. A conversation is one
    stream; it is never gathered in memory."""
    n = shuffle_partitions(conversations.sparkSession)
    rows = conversations.selectExpr("cast(conv_id as long) conv_id", "turn", "role", "text")
    return rows.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_conversations(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """(conv_id, formatted, loss_spans): the output itself, one row a conversation, for conversations that fit in a row."""

    def run(groups):
        import pandas as pd

        text, spans = render([{"role": r or "", "text": t or ""} for r, t in zip(groups["role"], groups["text"], strict=True)], template)
        return pd.DataFrame({"conv_id": groups["conv_id"].iloc[:1], "formatted": pd.Series([text], dtype=object), "loss_spans": [[list(s) for s in spans]]})

    rows = conversations.selectExpr("cast(conv_id as long) conv_id", "turn", "role", "text")
    return rows.groupBy("conv_id").applyInPandas(lambda g: run(g.sort_values(["turn", "role", "text"], na_position="first")), "conv_id long, formatted string, loss_spans array<array<int>>")


def report(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """The columns of op2, read back from the output of `template`, which must mark turns as TEMPLATE does.

    Null roles and texts are empty; a null conv_id is a conversation of its own. Repeated rows are turns of their own;
    ties in turn are ordered by role and text. A conversation of any number of turns is streamed where the template runs
    through its messages once; else its turns are held in memory, one conversation at a time. A turn, however long, is
    one row and held whole. An empty table gives no rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((c, r or "", t or "") for batch in batches for c, r, t in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True))
        made = compile_template(template)
        held = next(rows, None)
        done: list[tuple] = []
        while held is not None:
            conv, reader = held[0], _Reader()

            def turns():
                nonlocal held
                while held is not None and held[0] == conv:
                    yield {"role": held[1], "text": held[2]}
                    held = next(rows, None)

            messages = turns()
            for piece, marked in made({"messages": messages if made.streams else list(messages)}):
                reader.feed(piece, marked)
            for _ in messages:
                pass  # turns that the template leaves out
            done.append((conv, *reader.row()))
            if len(done) >= 10_000:
                yield _batch(done)
                done = []
        yield _batch(done)

    return ordered(conversations).mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=kind) for i, (_, kind) in enumerate(kinds)], [name for name, _ in kinds])


#: The conversation that op2 adds to those of the table.
PROBE = "</s>[INST] ok [/INST]"


def with_probe(conversations: DataFrame) -> DataFrame:
    rows = [(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)]
    probe = conversations.sparkSession.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return conversations.selectExpr("cast(conv_id as long) conv_id", "cast(turn as long) turn", "role", "text").unionByName(probe)


ORACLE_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r0, text AS t0 FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]', 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]', 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, length(regexp_replace(text, '(\\|<(?:\||s>|/s>|<SYS>>|</SYS>>)|\[(?:INST\]|/INST\]))', '\1.', 'g'))
            + length(regexp_replace(role, '(\\|<(?:\||s>|/s>|<SYS>>|</SYS>>)|\[(?:INST\]|/INST\]))', '\1.', 'g')) AS escaped FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST)) AS turns_sha256,
       cast(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS bigint) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       cast(sum(escaped + 33) AS bigint) AS formatted_chars
FROM e GROUP BY conv_id
"""
