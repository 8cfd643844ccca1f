"""Schemas compiled to three columns: valid, issues and data.

Order: empty text, coercion, type gate, changes (trim, case, sanitise), checks, masks, refinements, pipes. All failing checks of
a value are reported; a failed type gate hides what lies below it. NULL stands for absent and for null alike: it passes
where the schema is optional or nullable, and takes the default where it has one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.errors import unsupported
from ..plans.schema import Schema
from . import text
from .formats import from_javascript, source_of
from .predicates import two_valued

ISSUE = "struct<path:string,code:string,expected:string,message:string,received:string>"
ISSUES = f"array<{ISSUE}>"


@dataclass(frozen=True)
class Compiled:
    valid: Column
    issues: Column
    data: Column


def issue(path: Column, code: str, expected: str, message: str | None = None, received: Column | None = None) -> Column:
    return F.struct(path.alias("path"), F.lit(code).alias("code"), F.lit(expected).alias("expected"), F.lit(message or f"expected {expected}").alias("message"), (received if received is not None else F.lit(None).cast("string")).alias("received"))


def none() -> Column:
    return F.array().cast(ISSUES)


def when_bad(ok: Column, found: Column) -> Column:
    return F.when(ok, F.lit(None).cast(ISSUE)).otherwise(found.cast(ISSUE))


def child(path: Column, name: str) -> Column:
    return F.when(path == "", F.lit(name)).otherwise(F.concat(path, F.lit(f".{name}")))


def literal_template(parts: tuple) -> str:
    import re

    inner = {"string": ".*", "number": r"-?\d+(?:\.\d+)?", "int": r"-?\d+", "bigint": r"-?\d+", "boolean": "(?:true|false)"}
    return r"\A" + "".join(re.escape(p) if isinstance(p, str) else inner[p.kind] if p.kind in inner else "(?:" + "|".join(re.escape(str(x)) for x in p.items) + ")" for p in parts) + r"\z"


def scalar_checks(schema: Schema, c: Column) -> list[tuple[Column, str, str]]:
    """(holds, code, expected) of each check."""
    out: list[tuple[Column, str, str]] = []
    kind = schema.kind
    nan = F.isnan(c) if kind in ("number", "nan") else F.lit(False)
    size = text.utf16_length(c) if kind in ("string", "template_literal") else F.size(c) if kind in ("array", "set") else None
    for name, v in schema.checks:
        args, kwargs = v if isinstance(v, tuple) and len(v) == 2 and isinstance(v[1], dict) else ((v,), {})
        of, what = (size, "length") if size is not None else (c, "value")
        if name == "min":
            out.append((nan | (of >= F.lit(v)), "too_small", f"{what} >= {v}"))
        elif name == "max":
            out.append((nan | (of <= F.lit(v)), "too_big", f"{what} <= {v}"))
        elif name == "length":
            out.append((of == F.lit(v), "invalid_length", f"length = {v}"))
        elif name == "gt":
            out.append((nan | (c > F.lit(v)), "too_small", f"value > {v}"))
        elif name == "lt":
            out.append((nan | (c < F.lit(v)), "too_big", f"value < {v}"))
        elif name == "one_of":
            out.append((c.isin(*v), "invalid_value", "one of " + ", ".join(map(str, v))))
        elif name in ("multiple_of", "step"):
            by = args[0] if name == "step" else v
            out.append((two_valued(c.cast("double") % F.lit(float(by)) == 0), "not_multiple_of", f"a multiple of {by}"))
        elif name == "finite":
            out.append((~nan & (F.abs(c.cast("double")) != float("inf")), "not_finite", "a finite number"))
        elif name == "safe":
            out.append((~nan & (F.abs(c.cast("double")) <= 2**53 - 1) & (c.cast("double") % 1 == 0), "not_safe", "a safe integer"))
        elif name == "int32":
            out.append((~nan & c.between(-(2**31), 2**31 - 1) & (c.cast("double") % 1 == 0), "invalid_int32", "a 32-bit integer"))
        elif name == "float32":
            out.append((nan | (c.cast("float").cast("double") == c.cast("double")), "invalid_float32", "a 32-bit float"))
        elif name == "float64":
            out.append((~nan & (F.abs(c.cast("double")) != float("inf")), "not_finite", "a finite number"))
        elif name == "starts_with":
            out.append((c.startswith(args[0]), "invalid_string", f"starts with {args[0]}"))
        elif name == "ends_with":
            out.append((c.endswith(args[0]), "invalid_string", f"ends with {args[0]}"))
        elif name == "includes":
            out.append((c.contains(args[0]), "invalid_string", f"includes {args[0]}"))
        elif name == "regex":
            out.append((c.rlike(from_javascript(args[0])), "invalid_string", f"matches {args[0]}"))
        elif name == "string_format":
            out.append((c.rlike(from_javascript(args[1])), "invalid_format", args[0]))
        elif name == "digits_length":
            out.append((F.length(text.digits(c)).isin(*args), "invalid_length", "a number of digits of " + ", ".join(map(str, args))))
        elif name == "format" and kwargs.get("mode") == "strict":
            out.append((c.rlike(text.mask_source(args[0])), "invalid_format", args[0]))
        elif name in ("cpf", "cnpj", "format"):
            mask = {"cpf": text.CPF, "cnpj": text.CNPJ}.get(name) or args[0]
            plain = text.digits(c) if kwargs.get("strip", True) else c
            out.append((plain.rlike(rf"\A[0-9]{{{mask.count('#')}}}\z"), "invalid_format", mask))
        elif name == "phone_br":
            out.append((F.length(text.digits(c)).isin(10, 11), "invalid_format", "a phone number of 10 or 11 digits"))
        elif name == "days_of_week":
            out.append(((F.weekday(c) + 1).isin(*args), "invalid_day", "a day of week of " + ", ".join(map(str, args))))
        elif name == "months_of_year":
            out.append((F.month(c).isin(*args), "invalid_month", "a month of " + ", ".join(map(str, args))))
        elif name == "truncate_to":
            out.append((F.date_trunc(args[0], c) == c, "not_truncated", f"whole {args[0]}s"))
        elif source := source_of(name, args, kwargs):
            out.append((c.rlike(source), f"invalid_{name}", name))
    return out


def changed(schema: Schema, c: Column) -> Column:
    """Trim, case, normal form and sanitising, as listed."""
    for name, v in schema.checks:
        if name == "trim":
            c = text.trimmed(c)
        elif name == "normalize":
            c = text.unicode_normal(c, *v[0])
        elif name == "lowercase":
            c = F.lower(c)
        elif name == "uppercase":
            c = F.upper(c)
        elif name == "sanitize":
            c = text.sanitized(c, *v[0], **v[1])
    return c


def formatted(schema: Schema, c: Column) -> Column:
    for name, v in schema.checks:
        if name in ("cpf", "cnpj"):
            c = text.masked_format(c, text.CPF if name == "cpf" else text.CNPJ)
        elif name == "format" and v[1].get("mode") != "strict":
            c = text.masked_format(c, v[0][0], v[1].get("strip", True))
        elif name == "phone_br":
            c = text.phone_br(c)
    return c


def coerced(schema: Schema, c: Column) -> Column:
    if callable(schema.coerce_):
        return schema.coerce_(c)
    if not schema.coerce_:
        return c
    if schema.kind == "boolean":
        t = c.cast("string")
        return (t != "") & ~t.isin("0", "0.0", "NaN", "false")
    return c.try_cast({"string": "string", "number": "double", "int": "double", "bigint": "decimal(38,0)", "date": "timestamp"}[schema.kind])


def compile_schema(schema: Schema, c: Column, kind: T.DataType, path: Column | None = None, sibling: Callable[[str], Column] | None = None) -> Compiled:
    """``kind`` is the column's type; where it isn't what the schema needs, every value fails the type gate."""
    path = F.lit("") if path is None else path
    if schema.kind == "when":
        key, holds, then, otherwise = schema.items
        a, b = (compile_schema(x, c, kind, path, sibling) for x in (then, otherwise))
        test = two_valued(holds(sibling(key)))
        return Compiled(F.when(test, a.valid).otherwise(b.valid), F.when(test, a.issues).otherwise(b.issues), F.when(test, a.data).otherwise(b.data))
    if any(n == "no_empty" for n, _ in schema.checks):
        c = F.nullif(c, F.lit(""))
    c = coerced(schema, c)
    if schema.coerce_:
        kind = schema.spark() if schema.kind != "int" else T.DoubleType()
    valid, issues, data = inner(schema, c, kind, path)
    for step, what in schema.steps:
        if step == "refine":
            holds, message, at, when = what
            test = two_valued(holds(data))
            ok = test | ~two_valued(when(data)) if when else test
            found = F.array(issue(child(path, at) if at else path, "custom", message, message)).cast(ISSUES)
            issues = F.when(valid & ~ok, F.concat(issues, found)).otherwise(issues)
            valid = valid & ok
        elif step == "pipe":
            data = what(data)
        else:
            fns = dict(what)
            data = F.struct(*[(fns[n](data[n], data) if n in fns else data[n]).alias(n) for n, _ in schema.items])
    absent = c.isNull()
    if schema.has_default:
        return Compiled(absent | valid, F.when(absent, none()).otherwise(issues), F.coalesce(data, F.lit(schema.default_)))
    if schema.optional_ or schema.nullable_:
        return Compiled(absent | valid, F.when(absent, none()).otherwise(issues), F.when(~absent, data))
    missing = F.array(issue(path, f"expected_{schema.kind}", schema.kind, received=F.lit("null"))).cast(ISSUES)
    return Compiled(~absent & two_valued(valid), F.when(absent, missing).otherwise(issues), data)


def gate(schema: Schema, kind: T.DataType) -> bool:
    """Whether a column of this type can hold what the schema describes."""
    k, number = schema.kind, (T.NumericType,)
    fits = {"string": T.StringType, "template_literal": T.StringType, "number": number, "int": number, "nan": number, "bigint": number, "boolean": T.BooleanType, "date": (T.TimestampType, T.TimestampNTZType, T.DateType), "array": T.ArrayType, "set": T.ArrayType, "map": T.MapType, "record": T.MapType, "object": T.StructType, "tuple": T.StructType, "json": (T.VariantType, T.StringType)}
    return isinstance(kind, fits[k]) if k in fits else True


def inner(schema: Schema, c: Column, kind: T.DataType, path: Column) -> tuple[Column, Column, Column]:
    k = schema.kind
    wrong = F.array(issue(path, f"expected_{k}", k, received=F.lit(kind.simpleString()))).cast(ISSUES)
    if not gate(schema, kind):
        return F.lit(False), wrong, F.lit(None).cast(schema.spark())
    if k in ("any", "unknown"):
        return F.lit(True), none(), c
    if k == "never":
        return F.lit(False), wrong, c
    if k in ("null", "undefined", "void"):
        return c.isNull(), F.when(c.isNull(), none()).otherwise(wrong), c
    if k in ("union", "xor"):
        made = [compile_schema(x, c, kind, path) for x in schema.items]
        hits = sum((m.valid.cast("int") for m in made[1:]), made[0].valid.cast("int"))
        ok = hits > 0 if k == "union" else hits == 1
        bad = F.array(issue(path, f"invalid_{k}", "one of the options" if k == "union" else "exactly one of the options")).cast(ISSUES)
        same = len({str(x.spark()) for x in schema.items}) == 1
        return ok, F.when(ok, none()).otherwise(bad), F.coalesce(*[F.when(m.valid, m.data) for m in made]) if same else c
    if k == "not":
        ok = ~compile_schema(schema.items, c, kind, path).valid
        return ok, F.when(ok, none()).otherwise(F.array(issue(path, "invalid_not", "another value")).cast(ISSUES)), c
    if k == "intersection":
        made = [compile_schema(x, c, kind, path) for x in schema.items]
        ok = made[0].valid
        for m in made[1:]:
            ok = ok & m.valid
        fields = {n: m.data[n] for x, m in zip(schema.items, made, strict=True) for n in x.fields}
        return ok, F.concat(*[m.issues for m in made]), F.struct(*[x.alias(n) for n, x in fields.items()])
    if k == "discriminated_union":
        tag, options = schema.items
        valid, issues = F.lit(False), F.array(issue(path, "invalid_discriminator", f"a known {tag}")).cast(ISSUES)
        for x in options:
            m, own = compile_schema(x, c, kind, path), c[tag] == F.lit(x.fields[tag].items[0])
            valid, issues = F.when(own, m.valid).otherwise(valid), F.when(own, m.issues).otherwise(issues)
        return valid, issues, c
    if k == "custom":
        base = compile_schema(schema.items[0], c, kind, path)
        ok = base.valid & two_valued(schema.items[1](c))
        return ok, F.when(base.valid & ~ok, F.array(issue(path, "custom", "a value that fits")).cast(ISSUES)).otherwise(base.issues), base.data
    if k == "codec":
        source, target, decode, _ = schema.items
        a = compile_schema(source, c, kind, path)
        b = compile_schema(target, decode(a.data), target.spark(), path)
        return a.valid & b.valid, F.when(a.valid, b.issues).otherwise(a.issues), b.data
    if k == "lazy":
        return compile_variant(schema, c, path)
    if k == "json":
        ok = F.try_parse_json(c).isNotNull() if isinstance(kind, T.StringType) else c.isNotNull()
        return ok, F.when(ok, none()).otherwise(wrong), F.try_parse_json(c) if isinstance(kind, T.StringType) else c
    if k in ("literal", "enum"):
        ok = two_valued(c.isin(*schema.items))
        return ok, F.when(ok, none()).otherwise(F.array(issue(path, f"invalid_{k}", " | ".join(map(str, schema.items)))).cast(ISSUES)), c
    if k in ("array", "set"):
        own = checked(schema, c, path)
        each = lambda x, i: compile_schema(schema.items, x, kind.elementType, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")))
        ok = own[0] & F.forall(c, lambda x: each(x, F.lit(0)).valid)
        below = F.flatten(F.transform(c, lambda x, i: each(x, i).issues))
        data = F.transform(c, lambda x: each(x, F.lit(0)).data)
        if k == "set":
            twice = F.size(F.array_distinct(c)) == F.size(c)
            return ok & twice, F.concat(own[1], below, F.when(twice, none()).otherwise(F.array(issue(path, "not_unique", "different items")).cast(ISSUES))), data
        return ok, F.concat(own[1], below), data
    if k in ("map", "record"):
        value = schema.items[1] if k == "map" else schema.items
        each = lambda x, key: compile_schema(value, x, kind.valueType, F.concat(path, F.lit("["), key.cast("string"), F.lit("]")))
        ok = F.forall(F.map_values(c), lambda x: each(x, F.lit("")).valid)
        below = F.flatten(F.transform(F.map_entries(c), lambda e: each(e["value"], e["key"]).issues))
        return ok, below, F.transform_values(c, lambda key, x: each(x, key).data)
    if k in ("object", "tuple"):
        parts = dict(schema.items) if k == "object" else {f"_{i}": x for i, x in enumerate(schema.items[0])} | ({"rest": Schema("array", schema.items[1])} if schema.items[1] else {})
        types = {f.name: f.dataType for f in kind.fields}
        made: dict[str, Compiled] = {}
        sibling = lambda n: c[n]
        for n, x in parts.items():
            at = child(path, n) if k == "object" else F.concat(path, F.lit(f"[{n[1:]}]"))
            value, own = (c[n], types[n]) if n in types else (F.lit(None).cast(x.spark()), x.spark())
            made[n] = compile_schema(x, value, own, at, sibling)
        odd = [n for n in types if n not in parts]
        issues = [m.issues for m in made.values()]
        ok = F.lit(True)
        for m in made.values():
            ok = ok & m.valid
        extra: dict[str, Column] = {}
        for n in odd:
            if schema.unknown_keys == "strict":
                gone = c[n].isNull()
                ok, issues = ok & gone, [*issues, F.when(gone, none()).otherwise(F.array(issue(child(path, n), "unrecognized_key", "no such key")).cast(ISSUES))]
            elif isinstance(schema.unknown_keys, Schema):
                m = compile_schema(schema.unknown_keys, c[n], types[n], child(path, n))
                ok, issues, extra[n] = ok & m.valid, [*issues, m.issues], m.data
            elif schema.unknown_keys == "passthrough":
                extra[n] = c[n]
        data = F.struct(*[m.data.alias(n) for n, m in made.items()], *[x.alias(n) for n, x in extra.items()])
        return ok, F.concat(none(), *issues), data
    if k in ("nan",):
        ok = F.isnan(c)
        return ok, F.when(ok, none()).otherwise(wrong), c
    if k in ("string", "template_literal", "number", "int", "bigint", "boolean", "date") or gate(schema, kind):
        c = changed(schema, c)
        typed = F.lit(True)
        if k == "int" and isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
            typed = two_valued(~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")) & (c.cast("double") % 1 == 0))
        if k == "template_literal":
            typed = c.rlike(literal_template(schema.items))
        ok, issues = checked(schema, c, path)
        data = formatted(schema, c)
        if k == "int" and schema.coerce_:
            data = data.cast("long")
        return typed & ok, F.when(typed, issues).otherwise(wrong), data
    raise unsupported(k)


def checked(schema: Schema, c: Column, path: Column) -> tuple[Column, Column]:
    checks = scalar_checks(schema, c)
    if not checks:
        return F.lit(True), none()
    ok = F.lit(True)
    for holds, _, _ in checks:
        ok = ok & two_valued(holds)
    return ok, F.array_compact(F.array(*[when_bad(two_valued(holds), issue(path, code, expected)) for holds, code, expected in checks])).cast(ISSUES)


#: Levels of a recursive schema, where it doesn't say (``hint("depth", n)``).
DEPTH = 6


def compile_variant(schema: Schema, c: Column, path: Column) -> tuple[Column, Column, Column]:
    """A recursive schema, unrolled over a variant; a value that goes deeper than its levels is invalid."""
    depth = schema.hinted("depth") or DEPTH

    def fits(x: Schema, v: Column, left: int) -> Column:
        if x.optional_ or x.nullable_:
            return v.isNull() | two_valued(F.is_variant_null(v)) | fits(replace(x, optional_=False, nullable_=False), v, left)
        if x.kind == "lazy":
            return F.lit(False) if not left else fits(x.items(), v, left - 1)
        if x.kind == "object":
            ok = two_valued(F.schema_of_variant(v).startswith("OBJECT"))
            for n, f in x.items:
                ok = ok & fits(f, F.try_variant_get(v, f"$.{n}", "variant"), left)
            return ok
        if x.kind == "array":
            items = F.try_variant_get(v, "$", "array<variant>")
            return items.isNotNull() & F.forall(items, lambda e: fits(x.items, e, left))
        plain = F.try_variant_get(v, "$", x.spark().simpleString())
        m = compile_schema(x, plain, x.spark())
        return m.valid

    ok = two_valued(fits(schema, c, depth))
    return ok, F.when(ok, none()).otherwise(F.array(issue(path, "invalid_value", "the recursive shape")).cast(ISSUES)), c


def whole_row(df: DataFrame, schema: Schema) -> Compiled:
    return compile_schema(schema, F.struct(*df.columns), df.schema)


def safe_parse(df: DataFrame, schema: Schema) -> DataFrame:
    """``df`` with valid, issues and data (NULL where invalid)."""
    m = whole_row(df, schema)
    return df.select("*", m.valid.alias("valid"), m.issues.alias("issues"), F.when(m.valid, m.data).alias("data"))


def is_valid(df: DataFrame, schema: Schema) -> DataFrame:
    """Only the answer; issues and data are never built."""
    return df.select("*", whole_row(df, schema).valid.alias("valid"))


def parse(df: DataFrame, schema: Schema) -> DataFrame:
    """The parsed rows; an invalid row fails the job with its issues."""
    m = whole_row(df, schema)
    checked_data = F.when(m.valid, m.data).otherwise(F.raise_error(F.concat(F.lit("VALIDATION_FAILED: "), F.to_json(m.issues))).cast(m_type(df, m)))
    return df.select(checked_data.alias("data")).select("data.*")


def m_type(df: DataFrame, m: Compiled) -> T.DataType:
    return df.select(m.data.alias("data")).schema["data"].dataType


def quarantine(df: DataFrame, schema: Schema) -> tuple[DataFrame, DataFrame]:
    """(parsed rows, rejected rows with their issues)."""
    made = safe_parse(df, schema)
    return made.where("valid").select("data.*"), made.where(~F.col("valid")).select(*df.columns, "issues")
