r"""String functions: UTF-16 lengths, Unicode trimming, digit masks, sanitising, masking of personal data."""

from __future__ import annotations

import re
import unicodedata
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.errors import EngineError

#: What trimming takes off, besides the line ends.
SPACE = r"[\t\n\x0b\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
#: Tags that no allow-list may hold.
UNSAFE_TAGS = ("base", "embed", "form", "iframe", "input", "link", "meta", "object", "script", "style")
CPF, CNPJ = "###.###.###-##", "##.###.###/####-##"


def utf16_length(c: Column) -> Column:
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("long")


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A{SPACE}+|{SPACE}+\z", "")


def unicode_normal(c: Column, form: str = "NFC") -> Column:
    """Spark has no such function; Arrow batches go through Python."""

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda t: None if t is None else unicodedata.normalize(form, t))

    return run(c)


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]+", "")


def masked_format(c: Column, mask: str, strip: bool = True) -> Column:
    """``#`` takes a digit. NULL where the number of digits is another."""
    plain = digits(c) if strip else c
    parts, at = [], 1
    for run in re.findall(r"#+|[^#]+", mask):
        if run[0] == "#":
            parts.append(F.substring(plain, at, len(run)))
            at += len(run)
        else:
            parts.append(F.lit(run))
    return F.when(F.length(plain) == at - 1, F.concat(*parts))


def mask_source(mask: str) -> str:
    """An expression for texts that have the mask's form already."""
    return r"\A" + "".join("[0-9]" if c == "#" else re.escape(c) for c in mask) + r"\z"


def format_or_raise(c: Column, mask: str) -> Column:
    made = masked_format(c, mask)
    return F.when(c.isNull(), F.lit(None)).when(made.isNull(), F.raise_error(F.lit(f"INVALID_FORMAT: {mask}")).cast("string")).otherwise(made)


def phone_br(c: Column) -> Column:
    """10 or 11 digits."""
    plain = digits(c)
    return F.coalesce(masked_format(plain, "(##) ####-####"), masked_format(plain, "(##) #####-####"))


def fnv1a(c: Column) -> Column:
    """FNV-1a of the UTF-16 units in 32 bits, as lower-case hexadecimal digits without zeros in front."""
    units = F.transform(F.regexp_extract_all(F.hex(F.encode(c, "UTF-16BE")), F.lit("(.{4})"), F.lit(1)), lambda x: F.conv(x, 16, 10).cast("long"))
    return F.lower(F.hex(F.aggregate(units, F.lit(2166136261).cast("long"), lambda h, x: (h.bitwiseXOR(x) * 16777619).bitwiseAND(0xFFFFFFFF))))


def int32_bits(c: Column, kind: str) -> Column:
    """The last 32 bits of a number's whole part, without sign; 0 for what isn't finite."""
    if kind in ("double", "float"):
        d = c.cast("double")
        whole = F.when(d < 0, F.ceil(d)).otherwise(F.floor(d)).cast("double") if kind == "float" else d - d % 1
        low = F.when(F.isnan(d) | (F.abs(d) == float("inf")), F.lit(0.0)).otherwise(whole % 4294967296.0).cast("long")
    else:
        low = (c % F.lit(4294967296).cast("decimal(38,0)")).cast("long") if kind.startswith("decimal") else c.cast("long")
    return low.bitwiseAND(0xFFFFFFFF)


def masked(c: Column, kind: str, strategy: str) -> Column:
    """redact, mask or hash. Numbers become 0, or one step of FNV-1a over their 32 bits: a long, or a double for fractions."""
    text = c.cast("string")
    if strategy == "redact":
        return F.when(c.isNotNull(), F.lit("***") if kind == "string" else F.lit(0).cast(kind))
    if strategy == "mask":
        tail = F.when(utf16_length(text) > 4, F.concat(F.lit("***"), F.right(text, F.lit(4)))).otherwise("***")
        return F.when(c.isNotNull(), tail if kind == "string" else F.lit(0).cast(kind))
    if strategy == "hash":
        if kind == "string":
            return fnv1a(text)
        step = (int32_bits(c, kind).bitwiseXOR(2166136261) * 16777619).bitwiseAND(0xFFFFFFFF)
        return step.cast("double" if kind in ("double", "float") else "long")
    raise EngineError("INVALID_OPERATION", f"no strategy {strategy!r}")


def sanitized(c: Column, preset: str | list[str] | None = None, html: Any = None, controls: str | None = None, normalize: str | None = None, patterns: tuple = (), trim: bool = False, max_length: int | None = None) -> Column:
    """Order: normal form, HTML, controls, SQL identifier, path segment, own patterns, trim, length.

    html: strip, escape, or a list of tags that stay (their attributes go). Presets: text, htmlEscape, sqlIdentifier,
    pathSegment, none.
    """
    if max_length is not None and (not isinstance(max_length, int) or max_length < 0):
        raise EngineError("INVALID_OPERATION", "max_length is a whole number of 0 or more")
    presets = [preset or "text"] if not isinstance(preset, list) else preset
    if html is None:
        html = "strip" if "text" in presets else "escape" if "htmlEscape" in presets else None
    if controls is None and {"sqlIdentifier", "pathSegment"} & set(presets):
        controls = "remove"
    #: Fixed value: elements that go with all they hold.
    blocks = r"(?is)<(script|style|iframe|object|embed)[^>]*>.*?</\1\s*>"
    each = lambda c, *pairs: [c := F.regexp_replace(c, a, b) for a, b in pairs][-1]
    if normalize:
        c = unicode_normal(c, normalize)
    if html == "strip":
        c = each(c, (blocks, ""), ("<[^>]*>", ""), ("<", "&lt;"), (">", "&gt;"))
    elif html == "escape":
        c = each(c, ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"))
    elif html is not None:
        tags = list(dict.fromkeys(t.lower() for t in html))
        for t in tags:
            if not re.fullmatch("[a-z][a-z0-9-]*", t) or t in UNSAFE_TAGS:
                raise EngineError("INVALID_OPERATION", f"tag {t!r} can't be allowed")
        c = F.regexp_replace(c, blocks, "")
        #: Tags that stay are written anew in a form that the last step can't match, then given back their brackets.
        for t in tags:
            c = F.regexp_replace(c, rf"(?i)<\s*(/?)\s*{t}(?:\s[^>]*)?>", "\ue000$1" + t + "\ue001")
        c = each(c, (r"<\s*/?\s*[A-Za-z][A-Za-z0-9-]*(?:\s[^>]*)?>", ""), ("\ue000", "<"), ("\ue001", ">"))
    if controls in ("remove", "space"):
        c = F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", " " if controls == "space" else "")
    if "sqlIdentifier" in presets:
        c = F.regexp_replace(c, r"\A[^A-Za-z_$]+|[^A-Za-z0-9_$]+", "_")
    if "pathSegment" in presets:
        c = each(c, (r"\.\.+", "_"), (r'[\\/:*?"<>|]', "_"))
    for pattern, replacement in patterns:
        c = F.regexp_replace(c, pattern, replacement)
    if trim:
        c = trimmed(c)
    return c if max_length is None else F.substring(c, 1, max_length)
