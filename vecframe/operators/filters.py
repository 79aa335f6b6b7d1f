"""Metadata filters: a tree of predicates, evaluated in Python or compiled to a column.

Logic is two-valued. A leaf is false if the key is missing or the values aren't comparable,
even for ``!=``; ints and doubles compare by value, bools only with bools and strings only
with strings.
"""

from __future__ import annotations

import operator
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ConfigError
from ..types import MetaValue, kind_of

_OPS = {"=": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
_NAMES = {"eq": "=", "equals": "=", "==": "=", "ne": "!=", "not_equals": "!=", "lt": "<", "le": "<=", "lte": "<=", "gt": ">", "ge": ">=", "gte": ">="}


@dataclass(frozen=True)
class _All:
    pass


@dataclass(frozen=True)
class _Leaf:
    field: str
    op: str
    value: object


@dataclass(frozen=True)
class _And:
    parts: tuple


@dataclass(frozen=True)
class _Or:
    parts: tuple


@dataclass(frozen=True)
class _Not:
    part: object


class MetaBinding:
    """Fields are keys of a map column of tagged values."""

    def __init__(self, column: str = "meta"):
        self.column = column

    def leaf(self, leaf: _Leaf) -> Column:
        v = F.try_element_at(F.col(self.column), F.lit(leaf.field))
        if leaf.op == "in":
            return reduce(operator.or_, [F.coalesce(self._compare(v, "=", x), F.lit(False)) for x in leaf.value], F.lit(False))
        if leaf.op == "contains":
            return (v["k"] == 3) & v["s"].contains(leaf.value)
        return self._compare(v, leaf.op, leaf.value)

    @staticmethod
    def _compare(v: Column, op: str, x: MetaValue) -> Column:
        f, kind = _OPS[op], kind_of(x)
        if kind == 2:
            return (v["k"] == 2) & f(v["b"], F.lit(x))
        if kind == 3:
            return (v["k"] == 3) & f(v["s"], F.lit(x))
        as_int = f(v["i"], F.lit(x)) if kind == 0 else f(v["i"].cast("double"), F.lit(x))
        return F.when(v["k"] == 0, as_int).when(v["k"] == 1, f(v["d"], F.lit(float(x))))


class ColumnBinding:
    """Fields are top-level columns of a DataFrame, so that predicates reach the scan."""

    def __init__(self, schema: T.StructType, columns: Mapping[str, str] | None = None):
        self.columns = dict(columns) if columns is not None else {f.name: f.name for f in schema.fields}
        self.types = {f.name: f.dataType for f in schema.fields}

    def _kind(self, field: str) -> int | None:
        t = self.types.get(self.columns.get(field))
        if isinstance(t, T.BooleanType):
            return 2
        if isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
            return 1
        if isinstance(t, T.IntegralType):
            return 0
        return 3 if isinstance(t, T.StringType) else None

    def leaf(self, leaf: _Leaf) -> Column:
        kind = self._kind(leaf.field)
        if kind is None:
            return F.lit(False)
        c = F.col("`" + self.columns[leaf.field].replace("`", "``") + "`")
        fits = lambda x: kind_of(x) == kind or {kind_of(x), kind} == {0, 1}
        if leaf.op == "in":
            values = [x for x in leaf.value if fits(x)]
            return c.isin(values) if values else F.lit(False)
        if leaf.op == "contains":
            return c.contains(leaf.value) if kind == 3 else F.lit(False)
        return _OPS[leaf.op](c, F.lit(leaf.value)) if fits(leaf.value) else F.lit(False)


class Filter:
    """A filter; without a predicate it matches all. ``field`` names the field of the predicates after it."""

    def __init__(self, node: object = _All(), field: str | None = None):
        self.node, self._field = node, field

    def __repr__(self) -> str:
        return f"Filter({self.node})"

    def __eq__(self, other) -> bool:
        return isinstance(other, Filter) and self.node == other.node

    __hash__ = None

    def field(self, name: str) -> Filter:
        return Filter(self.node, name)

    def _with(self, op: str, value: object) -> Filter:
        if self._field is None:
            raise ConfigError("name a field first")
        return Filter(self.and_(_leaf(self._field, op, value)).node, self._field)

    def equals(self, v: MetaValue) -> Filter:
        return self._with("=", v)

    def not_equals(self, v: MetaValue) -> Filter:
        return self._with("!=", v)

    def lt(self, v: MetaValue) -> Filter:
        return self._with("<", v)

    def le(self, v: MetaValue) -> Filter:
        return self._with("<=", v)

    def gt(self, v: MetaValue) -> Filter:
        return self._with(">", v)

    def ge(self, v: MetaValue) -> Filter:
        return self._with(">=", v)

    def one_of(self, values: Sequence[MetaValue]) -> Filter:
        return self._with("in", values)

    def contains(self, part: str) -> Filter:
        return self._with("contains", part)

    eq, ne, gte, lte, in_ = equals, not_equals, ge, le, one_of

    @staticmethod
    def compare(field: str, op: str, value: MetaValue) -> Filter:
        op = _NAMES.get(op, op)
        if op not in _OPS:
            raise ConfigError(f"unknown comparison {op!r}")
        return _leaf(field, op, value)

    @staticmethod
    def in_set(field: str, values: Sequence[MetaValue]) -> Filter:
        return _leaf(field, "in", values)

    @staticmethod
    def has_substring(field: str, part: str) -> Filter:
        return _leaf(field, "contains", part)

    def and_(self, other: Filter) -> Filter:
        if self.matches_all():
            return Filter(other.node)
        return self if other.matches_all() else Filter(_And((self.node, other.node)))

    def or_(self, other: Filter) -> Filter:
        return Filter() if self.matches_all() or other.matches_all() else Filter(_Or((self.node, other.node)))

    @staticmethod
    def not_(other: Filter) -> Filter:
        return Filter(_Not(other.node))

    def __and__(self, other: Filter) -> Filter:
        return self.and_(other)

    def __or__(self, other: Filter) -> Filter:
        return self.or_(other)

    def __invert__(self) -> Filter:
        return Filter.not_(self)

    def matches_all(self) -> bool:
        return isinstance(self.node, _All)

    def matches(self, meta: Mapping[str, MetaValue]) -> bool:
        """Whether a record's metadata pass."""
        return _matches(self.node, meta)

    def column(self, binding: MetaBinding | ColumnBinding) -> Column:
        """The filter as a column for ``DataFrame.filter``."""
        return _column(self.node, binding, True)

    def exact_constraints(self) -> list[tuple[str, list[MetaValue]]] | None:
        """Fields and the values they may have, if the filter is a pure AND of ``=`` and ``in``."""
        return None if self.matches_all() else _exact(self.node)


def _leaf(field: str, op: str, value: object) -> Filter:
    if op == "in":
        value = tuple(value)
    if op == "contains" and not isinstance(value, str):
        raise ConfigError("contains takes a string")
    for v in value if op == "in" else (value,):
        kind_of(v)
    return Filter(_Leaf(field, op, value))


def _comparable(a: MetaValue, b: MetaValue) -> bool:
    x, y = kind_of(a), kind_of(b)
    return x == y or x < 2 and y < 2


def _matches(n: object, meta: Mapping[str, MetaValue]) -> bool:
    if isinstance(n, _All):
        return True
    if isinstance(n, _And):
        return all(_matches(p, meta) for p in n.parts)
    if isinstance(n, _Or):
        return any(_matches(p, meta) for p in n.parts)
    if isinstance(n, _Not):
        return not _matches(n.part, meta)
    if n.field not in meta:
        return False
    v = meta[n.field]
    if n.op == "contains":
        return isinstance(v, str) and n.value in v
    if n.op == "in":
        return any(_comparable(v, x) and _value(v, x) == _value(x, v) for x in n.value)
    return _comparable(v, n.value) and _OPS[n.op](*_pair(v, n.value))


def _pair(a: MetaValue, b: MetaValue) -> tuple:
    if isinstance(a, str):
        return a.encode(), b.encode()
    return _value(a, b), _value(b, a)


def _value(a: MetaValue, other: MetaValue) -> MetaValue:
    return float(a) if isinstance(other, float) and not isinstance(a, bool) else a


def _column(n: object, binding, top: bool) -> Column:
    if isinstance(n, _All):
        return F.lit(True)
    if isinstance(n, _And):
        return reduce(operator.and_, [_column(p, binding, top) for p in n.parts])
    if isinstance(n, _Or):
        return reduce(operator.or_, [_column(p, binding, False) for p in n.parts])
    if isinstance(n, _Not):
        return ~_column(n.part, binding, False)
    leaf = binding.leaf(n)
    # a bare comparison on the top AND spine is pushed to the scan; WHERE drops its nulls
    return leaf if top else F.coalesce(leaf, F.lit(False))


def _exact(n: object) -> list | None:
    if isinstance(n, _And):
        parts = [_exact(p) for p in n.parts]
        return None if None in parts else [x for p in parts for x in p]
    if isinstance(n, _Leaf) and n.op in ("=", "in"):
        return [(n.field, list(n.value) if n.op == "in" else [n.value])]
    return None
