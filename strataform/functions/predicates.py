"""Two-valued predicates: comparisons never give NULL, and NaN is below and above nothing.

A predicate is a small tree, so a query can check its fields before a plan is made. ``compile_predicate`` turns it into
a Column over a DataFrame's types.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.errors import invalid_query

FLOATS = (T.DoubleType, T.FloatType)


@dataclass(frozen=True)
class Field:
    name: str


@dataclass(frozen=True)
class Param:
    name: str


@dataclass(frozen=True)
class Compare:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class Both:
    op: str
    parts: tuple


@dataclass(frozen=True)
class Not:
    part: Any


@dataclass(frozen=True)
class Const:
    value: Any


class Conditions:
    """What a filter's function gets: ``lambda p: p.and_(p.gt("age", 18), p.neq("role", "blocked"))``.

    The left side of a comparison names a field; the right side is a value, ``p.field(...)`` or ``p.param(...)``.
    """

    field = staticmethod(Field)
    param = staticmethod(Param)
    const = staticmethod(Const)

    @staticmethod
    def compare(op: str) -> Callable[[Any, Any], Compare]:
        return lambda left, right: Compare(op, Field(left) if isinstance(left, str) else left, right)

    eq, neq, gt, gte, lt, lte = (staticmethod(lambda k, v, op=op: Compare(op, Field(k) if isinstance(k, str) else k, v)) for op in ("eq", "neq", "gt", "gte", "lt", "lte"))

    @staticmethod
    def and_(*parts: Any) -> Both:
        return Both("and", parts)

    @staticmethod
    def or_(*parts: Any) -> Both:
        return Both("or", parts)

    @staticmethod
    def not_(part: Any) -> Not:
        return Not(part)


def fields_of(p: Any) -> Iterator[str]:
    if isinstance(p, Field):
        yield p.name
    elif isinstance(p, Compare):
        yield from fields_of(p.left)
        yield from fields_of(p.right)
    elif isinstance(p, Both):
        for x in p.parts:
            yield from fields_of(x)
    elif isinstance(p, Not):
        yield from fields_of(p.part)


def params_of(p: Any) -> Iterator[str]:
    if isinstance(p, Param):
        yield p.name
    elif isinstance(p, Compare):
        yield from params_of(p.left)
        yield from params_of(p.right)
    elif isinstance(p, Both):
        for x in p.parts:
            yield from params_of(x)
    elif isinstance(p, Not):
        yield from params_of(p.part)


def two_valued(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def compile_predicate(p: Any, types: dict[str, T.DataType], params: dict[str, Any] | None = None) -> Column:
    params = params or {}

    def side(x: Any) -> tuple[Column, bool]:
        """The column, and whether it can be NaN."""
        if isinstance(x, Field):
            if x.name not in types:
                raise invalid_query(f"unknown field {x.name!r}")
            return F.col(x.name), isinstance(types[x.name], FLOATS)
        if isinstance(x, Param):
            if x.name not in params:
                raise invalid_query(f"parameter {x.name!r} has no value")
            x = params[x.name]
        if isinstance(x, Const):
            x = x.value
        return F.lit(x), isinstance(x, float)

    def whole(p: Any) -> Column:
        if isinstance(p, bool):
            return F.lit(p)
        if isinstance(p, Const):
            return F.lit(bool(p.value))
        if isinstance(p, Field):
            return two_valued(F.col(p.name).cast("boolean"))
        if isinstance(p, Not):
            return ~whole(p.part)
        if isinstance(p, Both):
            out = F.lit(p.op == "and")
            for k, x in enumerate(p.parts):
                out = whole(x) if k == 0 else out & whole(x) if p.op == "and" else out | whole(x)
            return out
        if not isinstance(p, Compare):
            raise invalid_query(f"not a predicate: {p!r}")
        (a, nan_a), (b, nan_b) = side(p.left), side(p.right)
        number = F.lit(True)
        for c, can in ((a, nan_a), (b, nan_b)):
            number = number & ~two_valued(F.isnan(c)) if can else number
        if p.op in ("eq", "neq"):
            same = a.eqNullSafe(b) & number if nan_a or nan_b else a.eqNullSafe(b)
            return same if p.op == "eq" else ~same
        ordered = {"gt": a > b, "gte": a >= b, "lt": a < b, "lte": a <= b}[p.op]
        return two_valued(ordered) & number if nan_a or nan_b else two_valued(ordered)

    return whole(p)
