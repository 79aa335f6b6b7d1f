"""The query language: ``seek``, ``fetch``, ``scan``, ``place`` and ``erase`` statements.

Integer literals are exact 64-bit values. Text after a statement, and negative ``top``,
``limit`` and ``offset``, are errors.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..errors import NotFound, ParseError
from ..operators import search
from ..operators.filters import Filter
from ..types import MetaValue

DEFAULT_TOP = 10

_TOKEN = re.compile(r"""(?P<space>\s+|\#[^\n]*)|(?P<string>"[^"]*")|(?P<number>-?\d+(?:\.\d+)?)|(?P<word>[A-Za-z_][A-Za-z0-9_.]*)|(?P<punct>!=|<=|>=|[=<>\[\](){},:*$])""")


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    at: int


def tokenize(source: str) -> list[Token]:
    out, at = [], 0
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise ParseError(f"unexpected {source[at]!r} at {at}")
        if m.lastgroup != "space":
            text = m.group()
            out.append(Token(m.lastgroup, text[1:-1] if m.lastgroup == "string" else text, at))
        at = m.end()
    return [*out, Token("end", "", at)]


@dataclass
class Seek:
    vault: str
    query: list[float] | str
    top: int | None = None
    threshold: float | None = None
    where: Filter = field(default_factory=Filter)
    rank_by: str | None = None
    fields: list[str] = field(default_factory=list)


@dataclass
class Fetch:
    vault: str
    id: str


@dataclass
class Scan:
    vault: str
    where: Filter = field(default_factory=Filter)
    offset: int = 0
    limit: int | None = None


@dataclass
class Place:
    vault: str
    vector: list[float]
    data: dict[str, MetaValue] = field(default_factory=dict)


@dataclass
class Erase:
    vault: str
    id: str


Statement = Seek | Fetch | Scan | Place | Erase


class _Parser:
    def __init__(self, source: str):
        self.tokens, self.i = tokenize(source), 0

    @property
    def now(self) -> Token:
        return self.tokens[self.i]

    def take(self, kind: str, text: str | None = None) -> str:
        t = self.now
        if t.kind != kind or text is not None and t.text != text:
            raise ParseError(f"expected {text or kind} at {t.at}, got {t.text or t.kind!r}")
        self.i += 1
        return t.text

    def word(self, text: str) -> bool:
        return self._skip("word", text)

    def punct(self, text: str) -> bool:
        return self._skip("punct", text)

    def _skip(self, kind: str, text: str) -> bool:
        hit = self.now.kind == kind and self.now.text == text
        self.i += hit
        return hit

    def listed(self, item, close: str) -> list:
        out = []
        if not self.punct(close):
            out.append(item())
            while self.punct(","):
                out.append(item())
            self.take("punct", close)
        return out

    def count(self) -> int:
        text = self.take("number")
        if not text.isdigit():
            raise ParseError(f"{text} is no count")
        return int(text)

    def number(self) -> float:
        return float(self.take("number"))

    def vector(self) -> list[float]:
        self.take("punct", "[")
        return self.listed(self.number, "]")

    def value(self) -> MetaValue:
        t = self.now
        self.i += 1
        if t.kind == "string":
            return t.text
        if t.kind == "number":
            if "." in t.text:
                return float(t.text)
            if not -(1 << 63) <= int(t.text) < 1 << 63:
                raise ParseError(f"{t.text} does not fit 64 bits")
            return int(t.text)
        if t.kind == "word" and t.text in ("true", "false"):
            return t.text == "true"
        raise ParseError(f"expected a value at {t.at}")

    def filter(self) -> Filter:
        left = self._and()
        while self.word("or"):
            left = left.or_(self._and())
        return left

    def _and(self) -> Filter:
        left = self._not()
        while self.word("and"):
            left = left.and_(self._not())
        return left

    def _not(self) -> Filter:
        if self.word("not"):
            return Filter.not_(self._not())
        if self.punct("("):
            inner = self.filter()
            self.take("punct", ")")
            return inner
        name = self.take("word")
        if self.word("in"):
            self.take("punct", "[")
            return Filter.in_set(name, self.listed(self.value, "]"))
        if self.word("contains"):
            return Filter.has_substring(name, self.take("string"))
        op = self.take("punct")
        if op not in ("=", "!=", "<", "<=", ">", ">="):
            raise ParseError(f"unknown comparison {op}")
        return Filter.compare(name, op, self.value())

    def clauses(self, out, known: dict) -> None:
        while not self.word("yield"):
            clause = self.take("word")
            if clause not in known:
                raise ParseError(f"unexpected {clause}")
            known[clause](out)

    def statement(self) -> Statement:
        kind = self.take("word")
        if kind not in ("seek", "fetch", "scan", "place", "erase"):
            raise ParseError(f"unknown statement {kind}")
        out = getattr(self, "_" + kind)()
        self.take("end")
        return out

    def _seek(self) -> Seek:
        self.take("word", "in")
        vault = self.take("word")
        self.take("word", "nearest")
        out = Seek(vault, self.take("word") if self.punct("$") else self.vector())

        def fields(s: Seek) -> None:
            if not self.punct("*"):
                s.fields = [self.take("word")]
                while self.punct(","):
                    s.fields.append(self.take("word"))

        def by(s: Seek) -> None:
            name = self.take("word")
            s.rank_by = None if name == "distance" else name

        self.clauses(out, {
            "top": lambda s: setattr(s, "top", self.count()),
            "threshold": lambda s: setattr(s, "threshold", self.number()),
            "where": lambda s: setattr(s, "where", self.filter()),
            "rank_by": by,
            "project": fields,
        })
        return out

    def _fetch(self) -> Fetch:
        self.take("word", "from")
        vault = self.take("word")
        self.take("word", "id")
        out = Fetch(vault, self.take("string"))
        self.take("word", "yield")
        return out

    def _scan(self) -> Scan:
        self.take("word", "in")
        out = Scan(self.take("word"))
        self.clauses(out, {
            "where": lambda s: setattr(s, "where", self.filter()),
            "offset": lambda s: setattr(s, "offset", self.count()),
            "limit": lambda s: setattr(s, "limit", self.count()),
        })
        return out

    def _place(self) -> Place:
        self.take("word", "in")
        vault = self.take("word")
        self.take("word", "vector")
        out = Place(vault, self.vector())
        if self.word("data"):
            self.take("punct", "{")

            def pair() -> tuple[str, MetaValue]:
                key = self.take("string")
                self.take("punct", ":")
                return key, self.value()

            for key, v in self.listed(pair, "}"):
                out.data.setdefault(key, v)
        return out

    def _erase(self) -> Erase:
        self.take("word", "from")
        vault = self.take("word")
        self.take("word", "id")
        return Erase(vault, self.take("string"))


def parse(source: str) -> Statement:
    return _Parser(source).statement()


def validate(source: str) -> str | None:
    """What is wrong with a query text, or None."""
    try:
        parse(source)
    except ParseError as e:
        return str(e)
    return None


def resolve(query: list[float] | str, bindings: dict | None) -> list[float]:
    if isinstance(query, str):
        if not bindings or query not in bindings:
            raise NotFound(f"no binding ${query}")
        return list(bindings[query])
    return query


def top_of(s: Seek) -> int | None:
    """How many hits a search gives: what it says, else all within its threshold, else the default."""
    return s.top if s.top is not None else None if s.threshold is not None else DEFAULT_TOP
