"""A small sandboxed template language for conversations, compiled to closures.

Templates hold text, ``{{ expression }}``, ``{% if %}``/``{% elif %}``/``{% else %}``/``{% endif %}``,
``{% for x in messages %}``/``{% endfor %}`` and ``{% generation %}``/``{% endgeneration %}`` around what a model should
learn to write. Expressions have strings, integers, ``true``, ``false``, ``none``, names, ``a.b``, ``not``, ``and``, ``or``, ``==``,
``!=``, ``~`` (concatenation), parentheses and ``| filter``. There are no calls, no subscripts and no attributes of
Python objects: a name is looked up in the given scope, ``a.b`` in a mapping, and anything unknown is an error when
compiling (names, filters) or nothing (missing fields).

A template is parsed to a tree, constants are folded (expressions, conditions, neighbouring texts), and the tree
becomes nested closures ``(scope, out) -> None``. ``out`` takes pieces of text and remembers which were written under a
generation marker. A template with one loop at its top level can be rendered message by message, so a
conversation of any length needs one message in memory.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field


class TemplateError(ValueError):
    """The template is not in the language."""


class Out:
    """Written pieces and the spans of them that are under a generation marker."""

    def __init__(self):
        self.pieces: list[str] = []
        self.length = 0
        self.spans: list[tuple[int, int]] = []

    def write(self, text: str) -> None:
        self.pieces.append(text)
        self.length += len(text)

    def text(self) -> str:
        return "".join(self.pieces)


# --- tree -----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    path: tuple[str, ...]


@dataclass(frozen=True)
class Op:
    kind: str
    args: tuple


@dataclass(frozen=True)
class Write:
    value: object


@dataclass(frozen=True)
class If:
    test: object
    then: tuple
    other: tuple


@dataclass(frozen=True)
class For:
    name: str
    body: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


_TAG = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)
_TOKEN = re.compile(r"""\s*(?:(?P<str>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<int>\d+)|(?P<name>[A-Za-z]\w*)|(?P<op>==|!=|[.|~()]))""")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_WORDS = {"true": True, "false": False, "none": None}


class _Expression:
    """Recursive descent over one expression."""

    def __init__(self, source: str, filters: dict[str, Callable]):
        self.filters, self.tokens, at = filters, [], 0
        source = source.rstrip()
        while at < len(source):
            found = _TOKEN.match(source, at)
            if not found:
                raise TemplateError(f"unexpected {source[at:at + 12]!r}")
            self.tokens.append((found.lastgroup, found[found.lastgroup]))
            at = found.end()
        self.at = 0

    def _take(self, *wanted: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][1] in wanted and self.tokens[self.at][0] != "str":
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def parse(self):
        tree = self._either()
        if self.at != len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return tree

    def _either(self):
        tree = self._both()
        while self._take("or"):
            tree = fold(Op("or", (tree, self._both())))
        return tree

    def _both(self):
        tree = self._negated()
        while self._take("and"):
            tree = fold(Op("and", (tree, self._negated())))
        return tree

    def _negated(self):
        return fold(Op("not", (self._negated(),))) if self._take("not") else self._compared()

    def _compared(self):
        tree = self._joined()
        while kind := self._take("==", "!="):
            tree = fold(Op(kind, (tree, self._joined())))
        return tree

    def _joined(self):
        tree = self._filtered()
        while self._take("~"):
            tree = fold(Op("~", (tree, self._filtered())))
        return tree

    def _filtered(self):
        tree = self._atom()
        while self._take("|"):
            kind, name = self._next()
            if kind != "name" or name not in self.filters:
                raise TemplateError(f"no filter {name!r}")
            tree = fold(Op("filter", (tree, self.filters[name])))
        return tree

    def _next(self) -> tuple[str, str]:
        if self.at >= len(self.tokens):
            raise TemplateError("the expression ends early")
        self.at += 1
        return self.tokens[self.at - 1]

    def _atom(self):
        kind, value = self._next()
        if kind == "str":
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "int":
            return Const(int(value))
        if kind == "name" and value not in ("and", "or", "not"):
            if value in _WORDS:
                return Const(_WORDS[value])
            path = [value]
            while self._take("."):
                kind, part = self._next()
                if kind != "name":
                    raise TemplateError(f"{part!r} is no field")
                path.append(part)
            return Name(tuple(path))
        if value == "(":
            tree = self._either()
            if not self._take(")"):
                raise TemplateError("missing )")
            return tree
        raise TemplateError(f"unexpected {value!r}")


_APPLY: dict[str, Callable] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "~": lambda a, b: _shown(a) + _shown(b),
    "not": lambda a: not a,
    "or": lambda a, b: a or b,
    "and": lambda a, b: a and b,
}


def _shown(value: object) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value).lower() if isinstance(value, bool) else str(value)


def fold(tree):
    """An operation on constants is a constant."""
    if tree.kind == "filter":
        value, function = tree.args
        return Const(function(_shown(value.value))) if isinstance(value, Const) else tree
    if all(isinstance(a, Const) for a in tree.args):
        return Const(_APPLY[tree.kind](*(a.value for a in tree.args)))
    return tree


def _folded(nodes: Iterable) -> tuple:
    """Constant conditions are decided and neighbouring texts joined."""
    out: list = []

    def add(node) -> None:
        if isinstance(node, If) and isinstance(node.test, Const):
            for inner in node.then if node.test.value else node.other:
                add(inner)
        elif isinstance(node, Write) and isinstance(node.value, Const):
            text = _shown(node.value.value)
            if out and isinstance(out[-1], Write) and isinstance(out[-1].value, Const):
                text = out.pop().value.value + text
            if text:
                out.append(Write(Const(text)))
        else:
            out.append(node)

    for node in nodes:
        add(node)
    return tuple(out)


class _Parser:
    def __init__(self, source: str, names: set[str], filters: dict[str, Callable]):
        self.names, self.filters, self.items, at = set(names), filters, [], 0
        for tag in _TAG.finditer(source):
            self.items.append(("text", source[at : tag.start()]))
            self.items.append(("write", tag[1]) if tag[1] is not None else ("tag", tag[2].strip()))
            at = tag.end()
        self.items.append(("text", source[at:]))
        if re.search(r"\{[{%]", "".join(v for k, v in self.items if k == "text")):
            raise TemplateError("a tag is not closed")
        self.at = 0

    def expression(self, source: str):
        tree = _Expression(source, self.filters).parse()
        self._check(tree)
        return tree

    def _check(self, tree) -> None:
        if isinstance(tree, Name) and tree.path[0] not in self.names:
            raise TemplateError(f"no name {tree.path[0]!r}")
        if isinstance(tree, Op):
            for arg in tree.args[:1] if tree.kind == "filter" else tree.args:
                self._check(arg)

    def body(self, *ends: str) -> tuple[tuple, str]:
        """Nodes up to one of the closing tags, and that tag."""
        nodes: list = []
        while self.at < len(self.items):
            kind, value = self.items[self.at]
            self.at += 1
            if kind == "text":
                nodes.append(Write(Const(value)))
            elif kind == "write":
                nodes.append(Write(self.expression(value)))
            else:
                word = value.split(None, 1)[0] if value else ""
                if word in ends:
                    return _folded(nodes), value
                nodes.append(self._block(word, value[len(word) :].strip()))
        if ends:
            raise TemplateError(f"missing {ends[-1]}")
        return _folded(nodes), ""

    def _block(self, word: str, rest: str):
        if word == "if":
            return self._if(rest)
        if word == "generation" and not rest:
            return Generation(self.body("endgeneration")[0])
        if word == "for" and (found := re.fullmatch(r"([A-Za-z]\w*)\s+in\s+messages", rest)):
            outer = set(self.names)
            self.names |= {found[1], "loop"}
            nodes, _ = self.body("endfor")
            self.names = outer
            return For(found[1], nodes)
        raise TemplateError(f"unknown tag {word!r} {rest!r}".rstrip())

    def _if(self, test: str):
        tree = self.expression(test)
        then, end = self.body("elif", "else", "endif")
        other: tuple = ()
        if end.startswith("elif"):
            other = _folded([self._if(end[4:])])
        elif end == "else":
            other, _ = self.body("endif")
        return If(tree, then, other)


# --- closures -------------------------------------------------------------------------------------


def _value(tree) -> Callable:
    if isinstance(tree, Const):
        return lambda scope, value=tree.value: value
    if isinstance(tree, Name):
        first, *rest = tree.path
        if not rest:
            return lambda scope: scope.get(first)

        def field_of(scope):
            value = scope.get(first)
            for part in rest:
                value = value.get(part) if isinstance(value, dict) else None
            return value

        return field_of
    if tree.kind == "filter":
        inner, function = _value(tree.args[0]), tree.args[1]
        return lambda scope: function(_shown(inner(scope)))
    if tree.kind == "not":
        inner = _value(tree.args[0])
        return lambda scope: not inner(scope)
    left, right = map(_value, tree.args)
    if tree.kind == "and":
        return lambda scope: left(scope) and right(scope)
    if tree.kind == "or":
        return lambda scope: left(scope) or right(scope)
    apply = _APPLY[tree.kind]
    return lambda scope: apply(left(scope), right(scope))


def _program(nodes: tuple) -> Callable[[dict, Out], None]:
    steps = [_step(n) for n in nodes]
    if len(steps) == 1:
        return steps[0]

    def run(scope: dict, out: Out) -> None:
        for step in steps:
            step(scope, out)

    return run


def _step(node) -> Callable[[dict, Out], None]:
    if isinstance(node, Write):
        if isinstance(node.value, Const):
            return lambda scope, out, text=node.value.value: out.write(text)
        value = _value(node.value)
        return lambda scope, out: out.write(_shown(value(scope)))
    if isinstance(node, If):
        test, then, other = _value(node.test), _program(node.then), _program(node.other)
        return lambda scope, out: (then if test(scope) else other)(scope, out)
    if isinstance(node, Generation):
        inner = _program(node.body)

        def marked(scope: dict, out: Out) -> None:
            start = out.length
            inner(scope, out)
            out.spans.append((start, out.length))

        return marked
    body, name = _program(node.body), node.name

    def loop(scope: dict, out: Out) -> None:
        messages = scope.get("messages") or ()
        for i, message in enumerate(messages):
            at = {"index0": i, "index": i + 1, "first": i == 0, "last": i == len(messages) - 1}
            body(scope | {name: message, "loop": at}, out)

    return loop


@dataclass
class Template:
    """A compiled template. ``constants`` are folded in, ``filters`` are functions of text."""

    source: str
    constants: dict[str, object] = field(default_factory=dict)
    filters: dict[str, Callable[[str], str]] = field(default_factory=dict)

    def __post_init__(self):
        source = self.source
        parser = _Parser(source, {"messages", *self.constants}, self.filters)
        self.tree, _ = parser.body()
        self.tree = _folded(_with_constants(self.tree, self.constants))
        self._run = _program(self.tree)
        loops = [i for i, n in enumerate(self.tree) if isinstance(n, For)]
        self._parts = None
        if len(loops) == 1:
            loop = self.tree[loops[0]]
            head, tail = self.tree[: loops[0]], self.tree[loops[0] + 1 :]
            self._parts = (_program(head), loop.name, _program(loop.body), _program(tail))

    def render(self, messages: list[dict]) -> Out:
        out = Out()
        self._run({"messages": messages}, out)
        return out

    def pieces(self, messages: Iterator[dict]) -> Iterator[Out]:
        """The rendered text piece by piece: what stands before the loop, one piece per message, the rest."""
        if self._parts is None:
            raise TemplateError("only a template with one loop at its top can be rendered in pieces")
        head, name, body, tail = self._parts
        out = Out()
        head({}, out)
        yield out
        messages = iter(messages)
        message, i = next(messages, None), 0
        while message is not None:
            following = next(messages, None)
            out = Out()
            at = {"index0": i, "index": i + 1, "first": i == 0, "last": following is None}
            body({name: message, "loop": at}, out)
            yield out
            message, i = following, i + 1
        out = Out()
        tail({}, out)
        yield out


def _with_constants(nodes, constants: dict):
    """The tree with constants in place of their names, folded again."""

    def value(tree):
        if isinstance(tree, Name) and tree.path[0] in constants and len(tree.path) == 1:
            return Const(constants[tree.path[0]])
        if isinstance(tree, Op):
            args = tree.args
            if tree.kind == "filter":
                return fold(Op("filter", (value(args[0]), args[1])))
            return fold(Op(tree.kind, tuple(value(a) for a in args)))
        return tree

    out = []
    for node in nodes:
        if isinstance(node, Write):
            out.append(Write(value(node.value)))
        elif isinstance(node, If):
            out.append(If(value(node.test), _folded(_with_constants(node.then, constants)), _folded(_with_constants(node.other, constants))))
        elif isinstance(node, For):
            out.append(For(node.name, _folded(_with_constants(node.body, constants))))
        else:
            out.append(Generation(_folded(_with_constants(node.body, constants))))
    return out
