"""Schemas: declared shapes from which every operation on a value is derived.

A node is immutable; each builder call gives a new one. ``s`` holds the factories.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import types as T

from .errors import EngineError, unsupported

HOST_ONLY = {"symbol", "regex", "file", "instanceof", "function", "promise"}
TEMPORAL = {
    "instant": T.TimestampType(), "plain_date_time": T.TimestampNTZType(), "plain_date": T.DateType(), "plain_time": T.StringType(), "plain_year_month": T.StringType(), "plain_month_day": T.StringType(), "duration": T.StringType(),
    "zoned_date_time": T.StructType([T.StructField("ts", T.TimestampType()), T.StructField("tz", T.StringType())]),
}


@dataclass(frozen=True)
class Schema:
    kind: str
    items: Any = None
    checks: tuple[tuple[str, Any], ...] = ()
    optional_: bool = False
    nullable_: bool = False
    default_: Any = None
    has_default: bool = False
    readonly_: bool = False
    brand_: str | None = None
    coerce_: Any = None
    steps: tuple[tuple[str, Any], ...] = ()
    hints: tuple[tuple[str, Any], ...] = ()
    unknown_keys: Any = None

    def check(self, name: str, value: Any = None) -> Schema:
        return replace(self, checks=(*self.checks, (name, value)))

    # Wrappers

    def optional(self) -> Schema:
        return replace(self, optional_=True)

    def nullable(self) -> Schema:
        return replace(self, nullable_=True)

    def nullish(self) -> Schema:
        return replace(self, optional_=True, nullable_=True)

    def default(self, value: Any) -> Schema:
        return replace(self, default_=value, has_default=True)

    def readonly(self) -> Schema:
        return replace(self, readonly_=True)

    def brand(self, name: str) -> Schema:
        return replace(self, brand_=name)

    def coerce(self, how: Any = True) -> Schema:
        """True: the kind's own coercion; or a function of a Column."""
        return replace(self, coerce_=how)

    def refine(self, holds: Callable, message: str = "refinement failed", path: str = "", when: Callable | None = None) -> Schema:
        return replace(self, steps=(*self.steps, ("refine", (holds, message, path, when))))

    def pipe(self, fn: Callable) -> Schema:
        return replace(self, steps=(*self.steps, ("pipe", fn)))

    def hint(self, name: str, value: Any = True) -> Schema:
        """entity, keyed, index_by, group_by, sort_by, unique_by, ordered, hash."""
        return replace(self, hints=(*self.hints, (name, value)))

    def hinted(self, *names: str) -> Any:
        return next((v for n in names for k, v in self.hints if k == n), None)

    # Checks of strings, numbers, dates and arrays

    def min(self, n: Any) -> Schema:
        return self.check("min", n)

    def max(self, n: Any) -> Schema:
        return self.check("max", n)

    gte, lte = min, max

    def length(self, n: int) -> Schema:
        return self.check("length", n)

    def gt(self, n: Any) -> Schema:
        return self.check("gt", n)

    def lt(self, n: Any) -> Schema:
        return self.check("lt", n)

    def positive(self) -> Schema:
        return self.check("gt", 0)

    def negative(self) -> Schema:
        return self.check("lt", 0)

    def nonnegative(self) -> Schema:
        return self.check("min", 0)

    def nonpositive(self) -> Schema:
        return self.check("max", 0)

    def between(self, a: Any, b: Any) -> Schema:
        return self.check("min", a).check("max", b)

    def one_of(self, *values: Any) -> Schema:
        return self.check("one_of", values)

    def non_empty(self) -> Schema:
        return self.check("min", 1)

    def multiple_of(self, n: float) -> Schema:
        return self.check("multiple_of", n)

    def __getattr__(self, name: str) -> Callable[..., Schema]:
        """The other checks by name: finite, safe, int32, email, uuid, starts_with, trim, sanitize, pii, days_of_week ..."""
        if name.startswith("_"):
            raise AttributeError(name)
        from ..functions.formats import CHECKS

        if name not in CHECKS:
            raise AttributeError(name)
        return lambda *a, **k: self.check(name, (a, k))

    # Objects

    def _object(self) -> dict[str, Schema]:
        if self.kind != "object":
            raise EngineError("INVALID_OPERATION", "only an object schema has fields")
        return dict(self.items)

    @property
    def fields(self) -> dict[str, Schema]:
        return self._object()

    def pick(self, *keys: str) -> Schema:
        return replace(self, items=tuple((k, v) for k, v in self._object().items() if k in keys))

    def omit(self, *keys: str) -> Schema:
        return replace(self, items=tuple((k, v) for k, v in self._object().items() if k not in keys))

    def extend(self, **more: Schema) -> Schema:
        return replace(self, items=tuple((self._object() | more).items()))

    def merge(self, other: Schema) -> Schema:
        return replace(self, items=tuple((self._object() | other._object()).items()), unknown_keys=other.unknown_keys)

    def partial(self, *keys: str) -> Schema:
        return replace(self, items=tuple((k, v.optional() if not keys or k in keys else v) for k, v in self._object().items()))

    def required(self, *keys: str) -> Schema:
        return replace(self, items=tuple((k, replace(v, optional_=False) if not keys or k in keys else v) for k, v in self._object().items()))

    def strict(self) -> Schema:
        return replace(self, unknown_keys="strict")

    def loose(self) -> Schema:
        return replace(self, unknown_keys="passthrough")

    def catchall(self, of: Schema) -> Schema:
        return replace(self, unknown_keys=of)

    def keyof(self) -> Schema:
        return s.enum(*self._object())

    def transform(self, fns: dict[str, Callable]) -> Schema:
        """Per field a function of (value, source struct), both Columns."""
        return replace(self, steps=(*self.steps, ("transform", tuple(fns.items()))))

    def or_(self, other: Schema) -> Schema:
        return s.union(self, other)

    def and_(self, other: Schema) -> Schema:
        return s.intersection(self, other)

    # Types

    def spark(self) -> T.DataType:
        k = self.kind
        if k in HOST_ONLY:
            raise unsupported(f"{k} has no column type")
        plain = {"string": T.StringType(), "template_literal": T.StringType(), "number": T.DoubleType(), "nan": T.DoubleType(), "int": T.LongType(), "bigint": T.DecimalType(38, 0), "boolean": T.BooleanType(), "date": T.TimestampType(), "null": T.NullType(), "undefined": T.NullType(), "void": T.NullType(), "never": T.NullType()}
        if k in plain:
            return T.IntegerType() if k == "int" and any(c == "int32" for c, _ in self.checks) else T.FloatType() if k == "number" and any(c == "float32" for c, _ in self.checks) else plain[k]
        if k in TEMPORAL:
            return TEMPORAL[k]
        if k in ("any", "unknown", "json", "lazy", "not"):
            return T.VariantType()
        if k in ("literal", "enum"):
            value = self.items[0]
            return T.BooleanType() if isinstance(value, bool) else T.LongType() if isinstance(value, int) else T.DoubleType() if isinstance(value, float) else T.StringType()
        if k in ("array", "set"):
            return T.ArrayType(self.items.spark())
        if k == "map":
            return T.MapType(self.items[0].spark(), self.items[1].spark())
        if k == "record":
            return T.MapType(T.StringType(), self.items.spark())
        if k == "tuple":
            slots, rest = self.items
            return T.StructType([T.StructField(f"_{i}", x.spark()) for i, x in enumerate(slots)] + ([T.StructField("rest", T.ArrayType(rest.spark()))] if rest else []))
        if k == "object":
            return T.StructType([T.StructField(n, x.spark(), x.optional_ or x.nullable_) for n, x in self.items])
        if k == "intersection":
            out: dict[str, T.StructField] = {}
            for x in self.items:
                out |= {f.name: f for f in x.spark().fields}
            return T.StructType(list(out.values()))
        if k in ("union", "xor", "discriminated_union"):
            options = self.items[1] if k == "discriminated_union" else self.items
            kinds = [x.spark() for x in options]
            if all(isinstance(x, T.StructType) for x in kinds):
                fields: dict[str, T.StructField] = {}
                for x in kinds:
                    for f in x.fields:
                        fields.setdefault(f.name, T.StructField(f.name, f.dataType))
                return T.StructType(list(fields.values()))
            return kinds[0] if all(x == kinds[0] for x in kinds) else T.VariantType()
        if k in ("codec", "custom"):
            return self.items[0].spark()
        raise unsupported(k)


@dataclass(frozen=True)
class Factories:
    """``s.string()``, ``s.object(id=s.int(), ...)``, ``s.array(s.number())`` ..."""

    def string(self) -> Schema:
        return Schema("string")

    def number(self) -> Schema:
        return Schema("number")

    def int(self) -> Schema:
        return Schema("int")

    def bigint(self) -> Schema:
        return Schema("bigint")

    def boolean(self) -> Schema:
        return Schema("boolean")

    def date(self) -> Schema:
        return Schema("date")

    def nan(self) -> Schema:
        return Schema("nan")

    def null(self) -> Schema:
        return Schema("null", nullable_=True)

    def undefined(self) -> Schema:
        return Schema("undefined", optional_=True)

    void = undefined

    def any(self) -> Schema:
        return Schema("any", optional_=True, nullable_=True)

    unknown = any

    def never(self) -> Schema:
        return Schema("never")

    def json(self) -> Schema:
        return Schema("json")

    def literal(self, value: Any) -> Schema:
        return Schema("literal", (value,))

    def enum(self, *values: Any) -> Schema:
        return Schema("enum", tuple(values))

    def array(self, of: Schema) -> Schema:
        return Schema("array", of)

    def set(self, of: Schema) -> Schema:
        return Schema("set", of)

    def map(self, key: Schema, value: Schema) -> Schema:
        return Schema("map", (key, value))

    def record(self, value: Schema) -> Schema:
        return Schema("record", value)

    def tuple(self, *slots: Schema, rest: Schema | None = None) -> Schema:
        return Schema("tuple", (slots, rest))

    def object(self, **fields: Schema) -> Schema:
        return Schema("object", tuple(fields.items()))

    def union(self, *options: Schema) -> Schema:
        return Schema("union", options)

    def xor(self, *options: Schema) -> Schema:
        return Schema("xor", options)

    def not_(self, of: Schema) -> Schema:
        return Schema("not", of)

    def intersection(self, *options: Schema) -> Schema:
        return Schema("intersection", options)

    def discriminated_union(self, tag: str, *options: Schema) -> Schema:
        return Schema("discriminated_union", (tag, options))

    def template_literal(self, *parts: str | Schema) -> Schema:
        return Schema("template_literal", parts)

    def codec(self, source: Schema, target: Schema, decode: Callable, encode: Callable) -> Schema:
        return Schema("codec", (source, target, decode, encode))

    def custom(self, base: Schema, holds: Callable) -> Schema:
        return Schema("custom", (base, holds))

    def lazy(self, of: Callable[[], Schema]) -> Schema:
        return Schema("lazy", of)

    def when(self, sibling: str, holds: Callable, then: Schema, otherwise: Schema) -> Schema:
        """The field's schema depends on a sibling's value."""
        return Schema("when", (sibling, holds, then, otherwise))

    def temporal(self, kind: str) -> Schema:
        if kind not in TEMPORAL:
            raise unsupported(kind)
        return Schema(kind)


s = Factories()
