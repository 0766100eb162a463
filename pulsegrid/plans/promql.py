"""PromQL: lexer, syntax tree and a precedence parser. Runs on the driver only."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone

from ..schema import BadQuery, UnsupportedPromQL

AGGREGATES = {"sum", "avg", "min", "max", "count", "group", "stddev", "stdvar"}
RANKED = {"topk", "bottomk"}
RANGE_FUNCTIONS = {"rate", "irate", "increase", "delta"}
UNIT_US = {"ms": 1_000, "s": 1_000_000, "m": 60_000_000, "h": 3_600_000_000, "d": 86_400_000_000, "w": 604_800_000_000, "y": 31_536_000_000_000}
PRECEDENCE = [("or",), ("and", "unless"), ("==", "!=", "<", "<=", ">", ">="), ("+", "-"), ("*", "/", "%", "atan2"), ("^",)]
_TOKEN = re.compile(
    r"""(?P<space>\s+|\#[^\n]*)|(?P<duration>(?:\d+(?:ms|[smhdwy]))+(?![\w.]))|(?P<number>0x[0-9a-fA-F]+|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"""
    r"""|(?P<word>[A-Za-z_][\w:]*)|(?P<string>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|`[^`]*`)|(?P<op>=~|!~|==|!=|<=|>=|[-+*/%^<>=(){}\[\],:@])""",
)


@dataclass(frozen=True)
class Number:
    value: float


@dataclass(frozen=True)
class Matcher:
    label: str
    op: str
    value: str


@dataclass(frozen=True)
class Selector:
    name: str | None
    matchers: tuple[Matcher, ...] = ()
    range_us: int | None = None
    offset_us: int = 0
    at_us: int | None = None


@dataclass(frozen=True)
class RangeCall:
    function: str
    selector: Selector


@dataclass(frozen=True)
class Aggregate:
    function: str
    inner: object
    labels: tuple[str, ...] = ()
    without: bool = False
    count: float | None = None  # of topk and bottomk


@dataclass(frozen=True)
class Quantile:
    q: float
    inner: object


@dataclass(frozen=True)
class Negate:
    inner: object


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object
    bool: bool = False
    match: str | None = None  # on or ignoring
    labels: tuple[str, ...] = field(default=())
    group: str | None = None  # left or right: the side with many
    include: tuple[str, ...] = ()


def duration_us(text: str | float) -> int:
    """Seconds as a number, or durations such as 5m and 1h30m."""
    try:
        return round(float(text) * 1e6)
    except (TypeError, ValueError):
        parts = re.findall(r"(\d+\.?\d*|\.\d+)(ms|[smhdwy])", str(text).strip())
        if not parts or "".join(a + b for a, b in parts) != str(text).strip() or (len(parts) > 1 and "." in str(text)):
            raise BadQuery(f"bad duration {text!r}") from None
        return sum(int(float(a) * UNIT_US[b]) if "." in a else int(a) * UNIT_US[b] for a, b in parts)


_ESCAPES = {"a": "\a", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v", "\\": "\\", '"': '"', "'": "'"}


def unquoted(raw: str) -> str:
    """The value of a string literal: escapes as in Go, where octal and x name bytes; none between back quotes."""
    if raw[0] == "`":
        return raw[1:-1]
    out = bytearray()
    for m in re.finditer(r"(?s)\\([0-7]{3}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|.)|[^\\]+", raw[1:-1]):
        own = m[1]
        try:
            if own is None:
                out += m[0].encode()
            elif own in _ESCAPES:
                out += _ESCAPES[own].encode()
            elif len(own) == 1:
                raise ValueError
            elif own[0] in "uU":
                out += chr(int(own[1:], 16)).encode()
            else:
                out.append(int(own[1:], 16) if own[0] == "x" else int(own, 8))
        except (ValueError, OverflowError):
            raise BadQuery(f"bad escape in {raw}") from None
    try:
        return out.decode()
    except UnicodeDecodeError:
        raise BadQuery(f"{raw} is not UTF-8") from None


def time_us(value: str | float | datetime) -> int:
    """Seconds since 1970, RFC 3339 text or a datetime; without zone it is UTC."""
    if isinstance(value, str):
        try:
            return round(float(value) * 1e6)
        except ValueError:
            try:
                value = datetime.fromisoformat(value.replace("Z", "+00:00"))
            except ValueError:
                raise BadQuery(f"bad time {value!r}") from None
    if isinstance(value, datetime):
        value = value if value.tzinfo else value.replace(tzinfo=timezone.utc)
        d = value - datetime(1970, 1, 1, tzinfo=timezone.utc)
        return (d.days * 86_400 + d.seconds) * 1_000_000 + d.microseconds
    return round(value * 1e6)


class Parser:
    def __init__(self, text: str) -> None:
        self.tokens, at = [], 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise BadQuery(f"unexpected {text[at]!r} at {at}")
            if m.lastgroup != "space":
                self.tokens.append((m.lastgroup, m.group()))
            at = m.end()
        self.tokens.append(("end", ""))
        self.at = 0

    def peek(self) -> str:
        return self.tokens[self.at][1]

    def kind(self) -> str:
        return self.tokens[self.at][0]

    def next(self) -> str:
        self.at += 1
        return self.tokens[self.at - 1][1]

    def take(self, text: str) -> bool:
        if self.peek().lower() == text and self.kind() != "string":
            self.at += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not self.take(text):
            raise BadQuery(f"expected {text!r}, found {self.peek()!r}")

    def whole(self):
        node = self.binary(0)
        if self.kind() != "end":
            raise BadQuery(f"unexpected {self.peek()!r}")
        return node

    def binary(self, level: int):
        if level == len(PRECEDENCE):
            return self.unary()
        left = self.binary(level + 1)
        while self.kind() in ("op", "word") and self.peek().lower() in PRECEDENCE[level]:
            op, own = self.next().lower(), {}
            if self.take("bool"):
                if level != 2:
                    raise BadQuery("bool needs a comparison")
                own["bool"] = True
            for match in ("on", "ignoring"):
                if self.take(match):
                    own |= {"match": match, "labels": self.names()}
            for side in ("left", "right"):
                if self.take(f"group_{side}"):
                    own |= {"group": side, "include": self.names() if self.peek() == "(" else ()}
            # ^ binds to the right.
            left = Binary(op, left, self.binary(level if op == "^" else level + 1), **own)
        return left

    def unary(self):
        if self.take("-"):
            inner = self.binary(5)
            return Number(-inner.value) if isinstance(inner, Number) else Negate(inner)
        if self.take("+"):
            return self.binary(5)
        return self.modified(self.primary())

    def primary(self):
        if self.take("("):
            node = self.binary(0)
            self.need(")")
            return node
        kind, text = self.kind(), self.peek()
        if kind == "number":
            self.next()
            return Number(float(int(text, 16)) if text.startswith("0x") else float(text))
        if text == "{":
            return self.selector(None)
        if kind != "word":
            raise BadQuery(f"unexpected {text!r}")
        self.next()
        low = text.lower()
        if low in ("inf", "nan") and self.peek() != "{":
            return Number(float(low))
        if (low in AGGREGATES or low in RANKED or low in ("quantile", "count_values")) and self.peek().lower() in ("(", "by", "without"):
            return self.aggregate(low)
        if self.peek() == "(":
            return self.call(low)
        return self.selector(text)

    def names(self) -> tuple[str, ...]:
        self.need("(")
        got = []
        while not self.take(")"):
            if self.kind() != "word":
                raise BadQuery(f"expected a label, found {self.peek()!r}")
            got.append(self.next())
            if self.peek() != ")":
                self.need(",")
        return tuple(got)

    def grouping(self) -> dict:
        for word in ("by", "without"):
            if self.take(word):
                return {"labels": self.names(), "without": word == "without"}
        return {}

    def arguments(self) -> list:
        self.need("(")
        got = []
        while not self.take(")"):
            got.append(self.binary(0))
            if self.peek() != ")":
                self.need(",")
        return got

    def aggregate(self, function: str):
        own = self.grouping()
        args = self.arguments()
        own = own or self.grouping()
        if function in ("quantile", "count_values"):
            raise UnsupportedPromQL(f"aggregate {function}")
        if function in RANKED:
            if len(args) != 2 or not isinstance(args[0], Number):
                raise BadQuery(f"{function} takes a number and a vector")
            return Aggregate(function, args[1], count=args[0].value, **own)
        if len(args) != 1:
            raise BadQuery(f"{function} takes one vector")
        return Aggregate(function, args[0], **own)

    def call(self, function: str):
        args = self.arguments()
        if function in RANGE_FUNCTIONS:
            if len(args) != 1 or not isinstance(args[0], Selector) or args[0].range_us is None:
                raise BadQuery(f"{function} takes a range selector")
            return RangeCall(function, args[0])
        if function == "histogram_quantile":
            if len(args) != 2 or not isinstance(args[0], Number):
                raise BadQuery("histogram_quantile takes a number and a vector")
            return Quantile(args[0].value, args[1])
        raise UnsupportedPromQL(f"function {function}")

    def selector(self, name: str | None) -> Selector:
        matchers = []
        if self.take("{"):
            while not self.take("}"):
                label = self.next()
                op = self.next()
                if op not in ("=", "!=", "=~", "!~") or self.kind() != "string":
                    raise BadQuery(f"bad matcher on {label!r}")
                raw = self.next()
                value = unquoted(raw)
                if label == "__name__" and op == "=" and name is None:
                    name = value
                else:
                    matchers.append(Matcher(label, op, value))
                if self.peek() != "}":
                    self.need(",")
        if name is None and not matchers:
            raise BadQuery("a selector needs a name or a matcher")
        return Selector(name, tuple(matchers))

    def modified(self, node):
        while True:
            if self.peek() == "[" and self.kind() == "op":
                self.next()
                if not isinstance(node, Selector) or node.range_us is not None:
                    raise UnsupportedPromQL("subqueries")
                if self.kind() != "duration":
                    raise BadQuery(f"bad range {self.peek()!r}")
                node = replace(node, range_us=duration_us(self.next()))
                if self.take(":"):
                    raise UnsupportedPromQL("subqueries")
                self.need("]")
            elif self.kind() == "word" and self.peek().lower() == "offset" and isinstance(node, Selector):
                self.next()
                sign = -1 if self.take("-") else 1
                node = replace(node, offset_us=sign * duration_us(self.next()))
            elif self.peek() == "@" and isinstance(node, Selector):
                self.next()
                node = replace(node, at_us=time_us(self.next()))
            else:
                return node


def parse(text: str):
    return Parser(text).whole()
