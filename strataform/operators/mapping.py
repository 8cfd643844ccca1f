"""Whitelist mapping between shapes: a target's fields are taken by name, renamed, computed or given a default."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import validate
from ..plans.errors import EngineError
from ..plans.schema import Schema

WIDENS = {("int", "number")}


@dataclass(frozen=True)
class From:
    """Another source field, by path; ``via`` changes its value."""

    path: str
    via: Any = None


@dataclass(frozen=True)
class Default:
    value: Any


def fits(a: Schema, b: Schema) -> bool:
    return a.kind == b.kind or (a.kind, b.kind) in WIDENS


def mapped(source: Schema, target: Schema, c: Column, overrides: dict[str, Any] | None = None) -> Column:
    """A struct of the target's fields."""
    overrides = overrides or {}
    out = []
    for n, want in target.items:
        rule = overrides.get(n)
        if callable(rule) and not isinstance(rule, (From, Default)):
            out.append(rule(c).alias(n))
            continue
        if isinstance(rule, From):
            value = c
            for part in rule.path.split("."):
                value = value[part]
            out.append((rule.via(value) if rule.via else value).alias(n))
            continue
        have = source.fields.get(n)
        if have is None or not fits(have, want):
            if isinstance(rule, Default):
                out.append(F.lit(rule.value).cast(want.spark()).alias(n))
            elif not want.optional_:
                raise EngineError("INVALID_MAPPING", f"required field {n!r} has no source")
            continue
        if have.optional_ and not want.optional_ and not isinstance(rule, Default) and not want.has_default:
            raise EngineError("INVALID_MAPPING", f"field {n!r} may be absent in the source")
        value = c[n]
        if want.kind == "object":
            value = F.when(value.isNotNull(), mapped(have, want, value, rule if isinstance(rule, dict) else None))
        elif want.kind == "array" and want.items.kind == "object":
            value = F.transform(value, element(have.items, want.items, rule if isinstance(rule, dict) else None))
        elif have.kind != want.kind:
            value = value.cast(want.spark())
        if isinstance(rule, Default):
            value = F.coalesce(value, F.lit(rule.value))
        out.append(value.alias(n))
    return F.struct(*out)


def element(source: Schema, target: Schema, overrides: dict[str, Any] | None) -> Callable[[Column], Column]:
    return lambda x: mapped(source, target, x, overrides)


def map_rows(df: DataFrame, source: Schema, target: Schema, overrides: dict[str, Any] | None = None) -> DataFrame:
    return df.select(mapped(source, target, F.struct(*df.columns), overrides).alias("m")).select("m.*")


@dataclass(frozen=True)
class Dto:
    """The usual operations of a schema, or of a pair of source and target, in one place. Each builds only what is asked for."""

    source: Schema
    target: Schema | None = None
    overrides: dict[str, Any] | None = None

    @property
    def schema(self) -> Schema:
        return self.target or self.source

    def is_(self, df: DataFrame) -> DataFrame:
        return validate.is_valid(df, self.schema)

    def safe_parse(self, df: DataFrame) -> DataFrame:
        return validate.safe_parse(df, self.schema)

    def parse(self, df: DataFrame) -> DataFrame:
        return validate.parse(df, self.schema)

    def from_(self, df: DataFrame) -> DataFrame:
        return map_rows(df, self.source, self.schema, self.overrides)

    many = from_

    def from_json(self, df: DataFrame, column: str = "json") -> DataFrame:
        from ..sources.jsonio import parse_json

        return parse_json(df, self.schema, column)

    def stringify(self, df: DataFrame) -> DataFrame:
        from ..sources.jsonio import stringified

        return df.select(stringified(self.schema, F.struct(*df.columns)).alias("json"))

    def codec(self, version: int = 1):
        from ..sources.codec import Codec

        return Codec(self.schema, version)


def dto(source: Schema, target: Schema | None = None, **overrides: Any) -> Dto:
    return Dto(source, target, overrides)
