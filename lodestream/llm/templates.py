"""A sandboxed chat-template language: parsed to a syntax tree, folded, and compiled to Python closures.

Texts hold {{ expressions }}, {% statements %} and {# comments #}; a dash inside a delimiter trims the white
space beside it. Statements: for / else / endfor, if / elif / else / endif, set, generation / endgeneration.
What is rendered within a generation block is marked; marks are what a model is trained on.

Expressions: strings, numbers, true, false, none; names; a.b and a[b]; not, and, or, in, comparisons,
+ - * / // %, ~ (joins as text), x if c else y, `is defined` and `is none`, and filters after |.
Values are text, numbers, booleans, none, lists and dicts, and a.b reads a dict's key, never an attribute of a
Python object; nothing can be called, and only numbers can be multiplied, so a template can neither leave
the sandbox nor blow up a constant. Missing names and keys are none, and none renders as empty text.

A loop over an iterator takes one item at a time (with one ahead, for loop.last), so that a conversation is
rendered turn by turn, whatever its length.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass
from typing import Any

Env = dict[str, Any]
#: Rendered text and whether it stands within a generation block.
Segment = tuple[str, bool]


class TemplateError(ValueError):
    """The template is not in the language, or was given values it cannot use."""


# ---------------------------------------------------------------- syntax tree


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Key:
    of: Any
    key: Any


@dataclass(frozen=True)
class Apply:
    """A pure function of values: an operator, a filter or a test; `op` names it in PURE."""

    op: str
    args: tuple


@dataclass(frozen=True)
class Choice:
    """Evaluates one of two branches: `and`, `or` and the conditional expression."""

    test: Any
    yes: Any
    no: Any


@dataclass(frozen=True)
class Defined:
    name: str


@dataclass(frozen=True)
class Text:
    value: str


@dataclass(frozen=True)
class Show:
    value: Any


@dataclass(frozen=True)
class Assign:
    name: str
    value: Any


@dataclass(frozen=True)
class Loop:
    name: str
    over: Any
    body: tuple
    empty: tuple


@dataclass(frozen=True)
class Branch:
    test: Any
    yes: tuple
    no: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


# ---------------------------------------------------------------- functions of values


def as_text(value: Any) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (str, int, float)):
        return str(value)
    raise TemplateError(f"cannot render a value of type {type(value).__name__}")


def _plus(a: Any, b: Any) -> Any:
    if isinstance(a, str) and isinstance(b, str) or _numbers(a, b):
        return a + b
    raise TemplateError("+ takes two texts or two numbers")


def _numbers(*values: Any) -> bool:
    return all(isinstance(v, (int, float)) for v in values)


def _numeric(f: Callable[[Any, Any], Any]) -> Callable[[Any, Any], Any]:
    def checked(a: Any, b: Any) -> Any:
        if not _numbers(a, b):
            raise TemplateError("arithmetic takes numbers")
        try:
            return f(a, b)
        except (ZeroDivisionError, OverflowError) as error:
            raise TemplateError(str(error)) from error

    return checked


def _ordered(f: Callable[[Any, Any], bool]) -> Callable[[Any, Any], bool]:
    def checked(a: Any, b: Any) -> bool:
        if _numbers(a, b) or isinstance(a, str) and isinstance(b, str):
            return f(a, b)
        raise TemplateError("order comparison takes two texts or two numbers")

    return checked


def _key(of: Any, key: Any) -> Any:
    if isinstance(of, Mapping):
        return of.get(key)
    if isinstance(of, (list, str)) and isinstance(key, int):
        return of[key] if -len(of) <= key < len(of) else None
    return None


PURE: dict[str, Callable[..., Any]] = {
    "not": operator.not_,
    "==": operator.eq,
    "!=": operator.ne,
    "<": _ordered(operator.lt),
    "<=": _ordered(operator.le),
    ">": _ordered(operator.gt),
    ">=": _ordered(operator.ge),
    "in": lambda a, b: b is not None and a in b,
    "+": _plus,
    "-": _numeric(operator.sub),
    "*": _numeric(operator.mul),
    "/": _numeric(operator.truediv),
    "//": _numeric(operator.floordiv),
    "%": _numeric(operator.mod),
    "~": lambda a, b: as_text(a) + as_text(b),
    "is none": lambda a: a is None,
    "|trim": lambda a: as_text(a).strip(),
    "|lower": lambda a: as_text(a).lower(),
    "|upper": lambda a: as_text(a).upper(),
    "|string": as_text,
    "|length": lambda a: 0 if a is None else len(a),
    "|default": lambda a, b="": b if a is None else a,
    "|replace": lambda a, b, c: as_text(a).replace(as_text(b), as_text(c)),
    "|join": lambda a, b="": as_text(b).join(map(as_text, a or ())),
    "|first": lambda a: _key(a, 0),
    "|last": lambda a: _key(a, -1),
}

# ---------------------------------------------------------------- reading

OPENING = re.compile(r"\{([{%#])(-?)")
TOKEN = re.compile(
    r"""\s*(?:(?P<close>-?(?:\}\}|%\}))|(?P<text>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<number>\d+(?:\.\d+)?)"""
    r"""|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|//|[-+*/%~<>()\[\].,|=]))""",
    re.S,
)
ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
COMPARISONS = {"==", "!=", "<", "<=", ">", ">="}


class Reader:
    """Recursive descent over the template's source."""

    def __init__(self, source: str, filters: Iterable[str] = ()) -> None:
        self.source, self.at, self.trim_next = source, 0, False
        self.filters = {f for f in PURE if f[0] == "|"} | {f"|{f}" for f in filters}
        self.token: tuple[str, str] = ("", "")

    def fail(self, what: str) -> TemplateError:
        return TemplateError(f"{what} near position {self.at}")

    def next(self) -> None:
        m = TOKEN.match(self.source, self.at)
        if not m:
            raise self.fail("unreadable expression")
        self.at, self.token = m.end(), (m.lastgroup or "", m[m.lastgroup])

    def take(self, *values: str) -> bool:
        if self.token[0] in ("name", "op") and self.token[1] in values:
            self.next()
            return True
        return False

    def expect(self, value: str) -> None:
        if not self.take(value):
            raise self.fail(f"expected {value}")

    def close(self, delimiter: str) -> None:
        kind, value = self.token
        if kind != "close" or not value.endswith(delimiter):
            raise self.fail(f"expected {delimiter}")
        self.trim_next = value[0] == "-"

    def name(self) -> str:
        kind, value = self.token
        if kind != "name":
            raise self.fail("expected a name")
        self.next()
        return value

    def body(self, *ends: str) -> tuple[tuple, str]:
        """Nodes up to one of the statements `ends`, and which one it was ('' at the end of the source)."""
        nodes: list[Any] = []
        while True:
            m = OPENING.search(self.source, self.at)
            text = self.source[self.at : m.start() if m else len(self.source)]
            if self.trim_next:
                text = text.lstrip()
            self.trim_next = False
            if m and m[2]:
                text = text.rstrip()
            if text:
                nodes.append(Text(text))
            if not m:
                if ends:
                    raise TemplateError(f"expected {' or '.join(ends)} before the end")
                return tuple(nodes), ""
            self.at = m.end()
            if m[1] == "#":
                end = self.source.find("#}", self.at)
                if end < 0:
                    raise self.fail("unclosed comment")
                self.trim_next, self.at = self.source[end - 1] == "-", end + 2
                continue
            self.next()
            if m[1] == "{":
                nodes.append(Show(self.expression()))
                self.close("}}")
                continue
            word = self.name()
            if word in ends:
                return tuple(nodes), word
            nodes.append(self.statement(word))

    def statement(self, word: str) -> Any:
        if word == "if":
            return self.branch()
        if word == "for":
            name = self.name()
            self.expect("in")
            over = self.expression()
            self.close("%}")
            body, end = self.body("else", "endfor")
            empty: tuple = ()
            if end == "else":
                self.close("%}")
                empty, _ = self.body("endfor")
            self.close("%}")
            return Loop(name, over, body, empty)
        if word == "set":
            name = self.name()
            self.expect("=")
            value = self.expression()
            self.close("%}")
            return Assign(name, value)
        if word == "generation":
            self.close("%}")
            body, _ = self.body("endgeneration")
            self.close("%}")
            return Generation(body)
        raise self.fail(f"unknown statement {word}")

    def branch(self) -> Branch:
        test = self.expression()
        self.close("%}")
        yes, end = self.body("elif", "else", "endif")
        if end == "elif":
            return Branch(test, yes, (self.branch(),))
        no: tuple = ()
        if end == "else":
            self.close("%}")
            no, _ = self.body("endif")
        self.close("%}")
        return Branch(test, yes, no)

    def expression(self) -> Any:
        value = self.either()
        if self.take("if"):
            test = self.either()
            no = self.expression() if self.take("else") else Const(None)
            return Choice(test, value, no)
        return value

    def either(self) -> Any:
        value = self.both()
        while self.take("or"):
            value = Choice(value, value, self.both())
        return value

    def both(self) -> Any:
        value = self.negation()
        while self.take("and"):
            value = Choice(value, self.negation(), value)
        return value

    def negation(self) -> Any:
        return Apply("not", (self.negation(),)) if self.take("not") else self.comparison()

    def comparison(self) -> Any:
        left = self.sum()
        kind, value = self.token
        if kind == "op" and value in COMPARISONS:
            self.next()
            return Apply(value, (left, self.sum()))
        if self.take("in"):
            return Apply("in", (left, self.sum()))
        if self.take("not"):
            self.expect("in")
            return Apply("not", (Apply("in", (left, self.sum())),))
        if self.take("is"):
            negated, test = self.take("not"), self.name()
            if test == "defined" and isinstance(left, Name):
                found: Any = Defined(left.name)
            elif test in ("defined", "none"):
                found = Apply("is none", (left,))
                found = Apply("not", (found,)) if test == "defined" else found
            else:
                raise self.fail(f"unknown test {test}")
            return Apply("not", (found,)) if negated else found
        return left

    def binary(self, ops: tuple[str, ...], below: Callable[[], Any]) -> Any:
        left = below()
        while self.token[0] == "op" and self.token[1] in ops:
            op = self.token[1]
            self.next()
            left = Apply(op, (left, below()))
        return left

    def sum(self) -> Any:
        return self.binary(("+", "-", "~"), self.product)

    def product(self) -> Any:
        return self.binary(("*", "/", "//", "%"), self.unary)

    def unary(self) -> Any:
        if self.take("-"):
            return Apply("-", (Const(0), self.unary()))
        value = self.atom()
        while True:
            if self.take("."):
                value = Key(value, Const(self.name()))
            elif self.take("["):
                value = Key(value, self.expression())
                self.expect("]")
            elif self.take("|"):
                value = self.filter(value)
            else:
                return value

    def filter(self, value: Any) -> Any:
        name, args = f"|{self.name()}", [value]
        if name not in self.filters:
            raise self.fail(f"unknown filter {name}")
        if self.take("(") and not self.take(")"):
            args.append(self.expression())
            while self.take(","):
                args.append(self.expression())
            self.expect(")")
        return Apply(name, tuple(args))

    def atom(self) -> Any:
        kind, value = self.token
        self.next() if kind != "close" else None
        if kind == "text":
            return Const(re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "number":
            return Const(float(value) if "." in value else int(value))
        if kind == "name":
            constants = {"true": True, "false": False, "none": None}
            return Const(constants[value.lower()]) if value.lower() in constants else Name(value)
        if (kind, value) == ("op", "("):
            inner = self.expression()
            self.expect(")")
            return inner
        raise self.fail("expected a value")


# ---------------------------------------------------------------- folding


def folded(node: Any) -> Any:
    """An expression with its constant parts evaluated. Filters that are not in PURE stay."""
    if isinstance(node, Key):
        of, key = folded(node.of), folded(node.key)
        return Const(_key(of.value, key.value)) if isinstance(of, Const) and isinstance(key, Const) else Key(of, key)
    if isinstance(node, Apply):
        args = tuple(map(folded, node.args))
        if node.op in PURE and all(isinstance(a, Const) for a in args):
            return Const(PURE[node.op](*(a.value for a in args)))
        return Apply(node.op, args)
    if isinstance(node, Choice):
        test = folded(node.test)
        if isinstance(test, Const):
            return folded(node.yes if test.value else node.no)
        return Choice(test, folded(node.yes), folded(node.no))
    return node


def folded_body(nodes: Iterable[Any]) -> tuple:
    """Statements folded: constant branches chosen, constant output made text, neighbouring texts joined."""
    out: list[Any] = []
    for node in nodes:
        if isinstance(node, Show):
            value = folded(node.value)
            new: tuple = (Text(as_text(value.value)),) if isinstance(value, Const) else (Show(value),)
        elif isinstance(node, Assign):
            new = (Assign(node.name, folded(node.value)),)
        elif isinstance(node, Loop):
            new = (Loop(node.name, folded(node.over), folded_body(node.body), folded_body(node.empty)),)
        elif isinstance(node, Branch):
            test, yes, no = folded(node.test), folded_body(node.yes), folded_body(node.no)
            new = (yes if test.value else no) if isinstance(test, Const) else (Branch(test, yes, no),)
        elif isinstance(node, Generation):
            new = (Generation(folded_body(node.body)),)
        else:
            new = (node,)
        for x in new:
            if isinstance(x, Text) and out and isinstance(out[-1], Text):
                out[-1] = Text(out[-1].value + x.value)
            elif not (isinstance(x, Text) and not x.value):
                out.append(x)
    return tuple(out)


# ---------------------------------------------------------------- closures

Value = Callable[[Env], Any]
Body = Callable[[Env, bool], Iterator[Segment]]


def value_of(node: Any, filters: Mapping[str, Callable[..., Any]]) -> Value:
    """The expression as a function of the names' values."""
    if isinstance(node, Const):
        constant = node.value
        return lambda env: constant
    if isinstance(node, Name):
        name = node.name
        return lambda env: env.get(name)
    if isinstance(node, Defined):
        name = node.name
        return lambda env: name in env
    if isinstance(node, Key):
        of, key = value_of(node.of, filters), value_of(node.key, filters)
        return lambda env: _key(of(env), key(env))
    if isinstance(node, Choice):
        test, yes, no = (value_of(x, filters) for x in (node.test, node.yes, node.no))
        return lambda env: yes(env) if test(env) else no(env)
    f = filters.get(node.op[1:]) if node.op[0] == "|" and node.op not in PURE else PURE[node.op]
    args = [value_of(a, filters) for a in node.args]
    if len(args) == 1:
        (one,) = args
        return lambda env: f(one(env))
    return lambda env: f(*[a(env) for a in args])


def body_of(nodes: tuple, filters: Mapping[str, Callable[..., Any]]) -> Body:
    steps = [_step(node, filters) for node in nodes]

    def run(env: Env, marked: bool) -> Iterator[Segment]:
        for step in steps:
            yield from step(env, marked)

    return run


def _step(node: Any, filters: Mapping[str, Callable[..., Any]]) -> Body:
    if isinstance(node, Text):
        text = node.value
        return lambda env, marked: iter(((text, marked),))
    if isinstance(node, Generation):
        inner = body_of(node.body, filters)
        return lambda env, marked: inner(env, True)
    if isinstance(node, Branch):
        test, yes, no = value_of(node.test, filters), body_of(node.yes, filters), body_of(node.no, filters)
        return lambda env, marked: yes(env, marked) if test(env) else no(env, marked)
    value = value_of(node.over if isinstance(node, Loop) else node.value, filters)
    if isinstance(node, Show):
        return lambda env, marked: iter(((as_text(value(env)), marked),))
    if isinstance(node, Assign):
        name = node.name

        def assign(env: Env, marked: bool) -> Iterator[Segment]:
            env[name] = value(env)
            return iter(())

        return assign
    item_name, inner, empty = node.name, body_of(node.body, filters), body_of(node.empty, filters)

    def loop(env: Env, marked: bool) -> Iterator[Segment]:
        items = iter(value(env) or ())
        item, end = next(items, items), items
        if item is end:
            yield from empty(env, marked)
        index, before = 0, None
        own = dict(env)
        while item is not end:
            ahead = next(items, end)
            last = ahead is end
            own[item_name] = item
            own["loop"] = {"index": index + 1, "index0": index, "first": index == 0, "last": last, "previtem": before, "nextitem": None if last else ahead}
            yield from inner(own, marked)
            before, item, index = item, ahead, index + 1

    return loop


def compiled(source: str, filters: Mapping[str, Callable[..., Any]] | None = None) -> Callable[[Env], Iterator[Segment]]:
    """The template as a function from names' values to rendered segments, in order."""
    filters = filters or {}
    nodes, _ = Reader(source, filters).body()
    run = body_of(folded_body(nodes), filters)
    return lambda env: run(dict(env), False)
