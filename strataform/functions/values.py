"""Operations on whole values: equality, diff, hash, merge, patch. Each is a Column made by walking a schema."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.errors import EngineError, unsupported
from ..plans.schema import TEMPORAL, Schema

NO_EQUALITY = {"set", "map", "record", "tuple", "json", "codec", *TEMPORAL}
CHANGE = "array<struct<type:string,path:string,value:string>>"


def with_default(schema: Schema, c: Column) -> Column:
    return F.coalesce(c, F.lit(schema.default_)) if schema.has_default else c


def equal(schema: Schema, a: Column, b: Column) -> Column:
    """NULL equals NULL and NaN equals NaN. Arrays are compared by place, or by key if a hint (keyed, index_by, ordered) names one."""
    if schema.kind in NO_EQUALITY:
        raise unsupported(f"{schema.kind} has no equality")
    a, b = with_default(schema, a), with_default(schema, b)
    both = a.isNotNull() & b.isNotNull()
    if schema.kind == "object":
        own = F.lit(True)
        for n, x in schema.items:
            own = own & equal(x, a[n], b[n])
        return F.when(both, own).otherwise(a.isNull() & b.isNull())
    if schema.kind == "array":
        key = schema.hinted("keyed", "index_by", "ordered")
        if isinstance(key, str):
            return F.when(both, (F.size(a) == F.size(b)) & equal_by_key(schema.items, a, b, key)).otherwise(a.isNull() & b.isNull())
        pairs = F.zip_with(a, b, lambda x, y: equal(schema.items, x, y))
        return F.when(both, (F.size(a) == F.size(b)) & F.forall(pairs, lambda x: x)).otherwise(a.isNull() & b.isNull())
    return a.eqNullSafe(b)


def equal_by_key(item: Schema, a: Column, b: Column, key: str) -> Column:
    """Whether each item of ``a`` has an equal one of the same key in ``b``; both have the same size.

    Sorted by key, items meet in pairs. Only where a key repeats, each is held against all.
    """
    places = lambda x: F.array_sort(F.transform(x, lambda e, i: F.struct(e[key].alias("k"), i.alias("i"))))
    pairs = F.zip_with(places(a), places(b), lambda p, q: p["k"].eqNullSafe(q["k"]) & equal(item, F.get(a, p["i"]), F.get(b, q["i"])))
    repeats = F.size(F.array_distinct(F.transform(a, lambda e: e[key]))) < F.size(a)
    there = lambda x: F.exists(b, lambda y: x[key].eqNullSafe(y[key]) & equal(item, x, y))
    return F.when(repeats, F.forall(a, there)).otherwise(F.forall(pairs, lambda x: x))


def as_text(c: Column) -> Column:
    """A value's JSON text, as changes carry it."""
    return F.when(c.isNotNull(), F.get_json_object(F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"}), "$.v"))


def change(kind: str, path: Column, value: Column | None) -> Column:
    return F.struct(F.lit(kind).alias("type"), path.alias("path"), (F.lit(None).cast("string") if value is None else as_text(value)).alias("value"))


def diff(schema: Schema, a: Column, b: Column, path: Column | None = None) -> Column:
    """[{type: add, remove or update, path, value}]; arrays by place, sets and maps whole, records by key."""
    root = path is None
    path = F.lit("") if root else path
    none = F.array().cast(CHANGE)
    updated = F.array(change("update", path, b)).cast(CHANGE)
    one_null = a.isNull() != b.isNull()
    if schema.kind == "object":
        parts = [diff(x, a[n], b[n], F.lit(n) if root else F.concat(path, F.lit(f".{n}"))) for n, x in schema.items]
        return F.when(one_null, updated).when(a.isNull(), none).otherwise(F.concat(*parts))
    if schema.kind == "array":
        at = lambda i: F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))
        common = F.least(F.size(a), F.size(b))
        pairs = F.slice(F.arrays_zip(a.alias("a"), b.alias("b")), F.lit(1), common)
        inside = F.flatten(F.transform(pairs, lambda x, i: diff(schema.items, x["a"], x["b"], at(i))))
        added = F.transform(F.slice(b, common + 1, F.size(b)), lambda x, i: change("add", at(i + common), x)).cast(CHANGE)
        gone = F.transform(F.slice(a, common + 1, F.size(a)), lambda x, i: change("remove", at(i + common), None)).cast(CHANGE)
        return F.when(one_null, updated).when(a.isNull(), none).otherwise(F.concat(inside, added, gone))
    if schema.kind == "record":
        at = lambda k: F.concat(path, F.lit("."), k) if not root else k
        keys = F.array_sort(F.array_union(F.map_keys(a), F.map_keys(b)))
        found = F.transform(keys, lambda k: F.when(~F.map_contains_key(b, k), F.array(change("remove", at(k), None)).cast(CHANGE)).when(~F.map_contains_key(a, k), F.array(change("add", at(k), F.try_element_at(b, k))).cast(CHANGE)).otherwise(diff(schema.items, F.try_element_at(a, k), F.try_element_at(b, k), at(k))))
        return F.when(one_null, updated).when(a.isNull(), none).otherwise(F.flatten(found))
    if schema.kind == "map":
        same = F.array_sort(F.map_entries(a)).eqNullSafe(F.array_sort(F.map_entries(b)))
        return F.when(same, none).otherwise(updated)
    if schema.kind == "set":
        return F.when(F.array_sort(a).eqNullSafe(F.array_sort(b)), none).otherwise(updated)
    return F.when(a.eqNullSafe(b), none).otherwise(updated)


def int32(c: Column) -> Column:
    low = c.bitwiseAND(0xFFFFFFFF)
    return F.when(low >= 1 << 31, low - (1 << 32)).otherwise(low).cast("int")


def mix(h: Column, x: Column) -> Column:
    return (h * 31 + x).bitwiseAND(0xFFFFFFFF)


def text_hash(c: Column) -> Column:
    """h = 31 h + unit over UTF-16 units, in 32 bits without sign."""
    units = F.transform(F.regexp_extract_all(F.hex(F.encode(c, "UTF-16BE")), F.lit("(.{4})"), F.lit(1)), lambda x: F.conv(x, 16, 10).cast("long"))
    return F.aggregate(units, F.lit(0).cast("long"), mix)


def raw_hash(schema: Schema, c: Column) -> Column:
    k = schema.kind
    if k == "object":
        h = F.lit(23).cast("long")
        for n, x in schema.items:
            h = mix(h, raw_hash(x, c[n]))
    elif k == "array":
        h = F.aggregate(c, F.lit(17).cast("long"), lambda h, x: mix(h, raw_hash(schema.items, x)))
    elif k in ("string", "template_literal", "enum", "literal") and schema.spark().simpleString() == "string":
        h = text_hash(c)
    elif k == "boolean":
        h = c.cast("long")
    elif k == "date":
        h = F.unix_millis(c)
    elif k in ("set", "map", "record", "tuple", "union"):
        h = text_hash(F.lit(k))
    else:
        number = c.cast("double")
        finite = ~F.isnan(number) & (F.abs(number) < 2.0**62)
        h = F.when(c.isNull(), F.lit(None)).when(finite, F.when(number < 0, F.ceil(number)).otherwise(F.floor(number)).cast("long")).otherwise(F.lit(0))
    return F.coalesce(h.bitwiseAND(0xFFFFFFFF), F.lit(0 if schema.optional_ else 1).cast("long"))


def hash31(schema: Schema, c: Column) -> Column:
    """A 32-bit hash that doesn't depend on the platform. For shuffles use xxhash64."""
    return int32(raw_hash(schema, c))


def merge(schema: Schema, left: Column, right: Column, present: Any = None) -> Column:
    """Deep for objects; elsewhere the right side replaces. ``present(path)`` says whether the right side has a field; by
    default a NULL counts as absent."""

    def walk(x: Schema, a: Column, b: Column, path: tuple[str, ...]) -> Column:
        if x.kind != "object":
            there = present(path) if present else b.isNotNull()
            return F.when(there, b).otherwise(a)
        both = F.struct(*[walk(f, a[n], b[n], (*path, n)).alias(n) for n, f in x.items])
        return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(both) if path else both

    return walk(schema, left, right, ())


def patch(schema: Schema, c: Column, change_to: dict[str, Any]) -> Column:
    """A nested patch: keys that it doesn't name stay. Arrays take {place: value}; records become the patch's keys."""
    if schema.readonly_:
        raise EngineError("READONLY_FIELD", "a readonly value can't be changed")
    if schema.kind != "object":
        raise EngineError("INVALID_OPERATION", "a patch is for an object")
    if odd := set(change_to) - set(schema.fields):
        raise EngineError("INVALID_OPERATION", f"unknown field {sorted(odd)[0]!r}")

    def value(x: Schema, old: Column, new: Any) -> Column:
        if x.readonly_:
            raise EngineError("READONLY_FIELD", "a readonly field can't be changed")
        if isinstance(new, Column):
            return new
        if x.kind == "object" and isinstance(new, dict):
            return patch(x, old, new)
        if x.kind == "array" and isinstance(new, dict):
            out = lambda e, i: [e := F.when(i == k, value(x.items, e, v)).otherwise(e) for k, v in new.items()][-1]
            return F.transform(old, out)
        if x.kind == "record" and isinstance(new, dict):
            return F.create_map(*[y for k, v in new.items() for y in (F.lit(k), value(x.items, F.try_element_at(old, F.lit(k)), v))])
        if isinstance(new, (list, tuple)):
            return F.array(*[F.lit(v) for v in new]).cast(x.spark())
        return F.lit(new).cast(x.spark())

    return F.struct(*[(value(x, c[n], change_to[n]) if n in change_to else c[n]).alias(n) for n, x in schema.items])


class Draft:
    """Records what a recipe writes: ``d.profile.age = 3``."""

    def __init__(self) -> None:
        object.__setattr__(self, "writes", {})

    def __setattr__(self, name: str, new: Any) -> None:
        self.writes[name] = new

    def __getattr__(self, name: str) -> Draft:
        if name.startswith("__"):
            raise AttributeError(name)
        made = self.writes.setdefault(name, Draft())
        return made

    def taken(self) -> dict[str, Any]:
        return {k: v.taken() if isinstance(v, Draft) else v for k, v in self.writes.items()}


def param(name: str) -> Param:
    """A place in a patch that is filled when the patch is applied."""
    return Param(name)


@dataclass(frozen=True)
class Param:
    name: str


def patcher(schema: Schema, template: dict[str, Any]) -> Any:
    """A patch with ``param`` places, checked now: a function of the value and what fills the places."""

    def names(x: Any) -> set[str]:
        return {x.name} if isinstance(x, Param) else {n for v in x.values() for n in names(v)} if isinstance(x, dict) else set()

    def filled(x: Any, given: dict[str, Any]) -> Any:
        return given[x.name] if isinstance(x, Param) else {k: filled(v, given) for k, v in x.items()} if isinstance(x, dict) else x

    wanted = names(template)
    patch(schema, F.lit(None).cast(schema.spark()), filled(template, dict.fromkeys(wanted)))

    def run(c: Column, **given: Any) -> Column:
        if set(given) != wanted:
            raise EngineError("INVALID_OPERATION", f"the patch needs {sorted(wanted)}")
        return patch(schema, c, filled(template, given))

    return run


def drafted(schema: Schema, c: Column, recipe: Any) -> Column:
    d = Draft()
    recipe(d)
    return patch(schema, c, d.taken())


def pick(schema: Schema, c: Column, *keys: str) -> Column:
    return F.struct(*[c[n].alias(n) for n, _ in schema.items if n in keys])


def omit(schema: Schema, c: Column, *keys: str) -> Column:
    return F.struct(*[c[n].alias(n) for n, _ in schema.items if n not in keys])


def transformed(schema: Schema, c: Column, fns: dict[str, Any], select: tuple[str, ...] | None = None) -> Column:
    """Per field lowercase, uppercase, trim, identity, or a function of (value, source).

    With ``select`` the result has those fields alone; what ``fns`` says of others isn't used.
    """
    from .text import trimmed

    named = {"lowercase": F.lower, "uppercase": F.upper, "trim": trimmed, "identity": lambda x: x}
    kept = [n for n, _ in schema.items if select is None or n in select]
    return F.struct(*[(named[f](c[n]) if isinstance(f := fns.get(n, "identity"), str) else f(c[n], c)).alias(n) for n in kept])


def encoded(schema: Schema, c: Column) -> Column:
    """The value that a codec's schema reads, from the value that it gives: the other way round than parsing."""
    if schema.kind == "codec":
        _, target, _, encode = schema.items
        return encode(encoded(target, c))
    if schema.kind == "object":
        return F.when(c.isNotNull(), F.struct(*[encoded(x, c[n]).alias(n) for n, x in schema.items]))
    if schema.kind in ("array", "set"):
        return F.transform(c, lambda x: encoded(schema.items, x))
    if schema.kind == "record":
        return F.transform_values(c, lambda _, x: encoded(schema.items, x))
    return c


def scrubbed(schema: Schema, c: Column, what: str) -> Column:
    """A copy with personal data replaced (``mask``) or strings cleaned (``sanitize``), as the schema's checks say."""
    from . import text

    if schema.kind == "object":
        return F.when(c.isNotNull(), F.struct(*[scrubbed(x, c[n], what).alias(n) for n, x in schema.items]))
    if schema.kind in ("array", "set"):
        return F.transform(c, lambda x: scrubbed(schema.items, x, what))
    if schema.kind == "record":
        return F.transform_values(c, lambda _, x: scrubbed(schema.items, x, what))
    for name, v in schema.checks:
        if what == "mask" and name == "pii":
            c = text.masked(c, schema.spark().simpleString(), *v[0])
        elif what == "sanitize" and name == "sanitize":
            c = text.sanitized(c, *v[0], **v[1])
    return c
