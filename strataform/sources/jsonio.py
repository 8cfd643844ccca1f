"""JSON: documents, streams of arrays and lines, and text that a JavaScript reader would have written itself."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import utf16_length
from ..functions.validate import ISSUES, compile_schema, issue
from ..plans.errors import EngineError, unsupported
from ..plans.ordinal import numbered, ordered
from ..plans.schema import Schema
from ..plans.shipping import ship

BAD = "_bad_json"


def parse_json(df: DataFrame, schema: Schema, column: str = "json") -> DataFrame:
    """valid, issues and data for each text; a text that isn't JSON has the issue invalid_json."""
    body = F.from_json(column, schema.spark(), {"mode": "PERMISSIVE"})
    well_formed = F.try_parse_json(F.col(column)).isNotNull()
    rows = df.select(*[F.col(c).alias(f"_in_{c}") for c in df.columns], well_formed.alias(BAD), body.alias("_v"))
    made = safe_parse_struct(rows, schema)
    broken = F.array(F.struct(F.lit("").alias("path"), F.lit("invalid_json").alias("code"), F.lit("JSON").alias("expected"), F.lit("not a JSON text").alias("message"), F.lit(None).cast("string").alias("received")))
    return made.select(
        *[F.col(f"_in_{c}").alias(c) for c in df.columns], (F.col(BAD) & F.col("valid")).alias("valid"), F.when(F.col(BAD), F.col("issues")).otherwise(broken).alias("issues"), F.when(F.col(BAD) & F.col("valid"), F.col("data")).alias("data")
    )


def safe_parse_struct(rows: DataFrame, schema: Schema) -> DataFrame:
    m = compile_schema(schema, F.col("_v"), rows.schema["_v"].dataType)
    return rows.select("*", m.valid.alias("valid"), m.issues.alias("issues"), m.data.alias("data"))


def read_lines(spark: SparkSession, path: str, schema: Schema, fail_fast: bool = False) -> DataFrame:
    """Newline-delimited JSON: line (from 0, blank lines count), valid, issues with paths ``line N``, data.

    Lines are numbered file by file without a single-partition window.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value").withColumn("at", F.monotonically_increasing_id())
    counted = numbered(ordered(raw, "file", "block", "at"))
    first = counted.groupBy("file").agg(F.min("_n").alias("_first"))
    lines = counted.join(first, "file").select("file", (F.col("_n") - F.col("_first")).alias("line"), F.col("value").alias("json")).where(F.trim("json") != "")
    made = parse_json(lines, schema)
    at = F.concat(F.lit("line "), F.col("line").cast("string"))
    issues = F.transform("issues", lambda x: x.withField("path", F.when(x["path"] == "", at).otherwise(F.concat(at, F.lit("."), x["path"]))))
    made = made.select("file", "line", "valid", issues.alias("issues"), "data")
    return raised(made) if fail_fast else made


def at_item(index: Column) -> Column:
    at = F.concat(F.lit("["), index.cast("string"), F.lit("]"))
    return F.transform("issues", lambda x: x.withField("path", F.when(x["path"] == "", at).otherwise(F.concat(at, F.lit("."), x["path"]))))


def raised(made: DataFrame) -> DataFrame:
    """The first invalid row ends the query."""
    return made.withColumn("valid", F.when(F.col("valid"), True).otherwise(F.raise_error(F.to_json("issues")).cast("boolean")))


def read_array(spark: SparkSession, path: str, schema: Schema, fail_fast: bool = False) -> DataFrame:
    """Files that hold one JSON array each: file, index, valid, issues with paths ``[i]``, data.

    ``schema`` is an item's, or an array's; then its checks of the count hold as well: an item beyond ``max`` is invalid,
    and what only the end shows (too few, or not the length, or no array at all) is a row of its own, without an index.
    A file is one value, so it is read whole.
    """
    whole = schema if schema.kind == "array" else None
    item = whole.items if whole else schema
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    rows = text.select("file", F.try_parse_json("value").alias("v"))
    rows = rows.select("file", F.coalesce(F.schema_of_variant("v").startswith("ARRAY"), F.lit(False)).alias("is_array"), F.try_variant_get("v", "$", "array<variant>").alias("items"))
    made = parse_json(rows.where("is_array").select("file", F.posexplode("items").alias("index", "item")).select("file", "index", F.to_json("item").alias("json")), item)
    made = made.select("file", "index", "valid", at_item(F.col("index")).alias("issues"), "data")
    counts = {name: v for name, v in whole.checks if name in ("min", "max", "length")} if whole else {}
    most = min((v for name, v in counts.items() if name in ("max", "length")), default=None)
    if most is not None:
        over = F.array(issue(F.lit(""), "too_big", f"length <= {most}")).cast(ISSUES)
        made = made.withColumns({"issues": F.when(F.col("index") >= most, F.concat("issues", over)).otherwise(F.col("issues")), "valid": F.col("valid") & (F.col("index") < most)})
    size, found = F.size("items"), [F.when(~F.col("is_array"), issue(F.lit(""), "expected_array", "array"))]
    for name, v in counts.items():
        bad = {"min": size < v, "length": size < v}.get(name)
        if bad is not None:
            found.append(F.when(F.col("is_array") & bad, issue(F.lit(""), "too_small" if name == "min" else "invalid_length", f"length {'>=' if name == 'min' else '='} {v}")))
    ends = rows.select("file", F.array_compact(F.array(*found)).cast(ISSUES).alias("issues")).where(F.size("issues") > 0)
    data = F.lit(None).cast(made.schema["data"].dataType).alias("data")
    made = made.unionByName(ends.select("file", F.lit(None).cast("int").alias("index"), F.lit(False).alias("valid"), "issues", data))
    return raised(made) if fail_fast else made


ROOTS = {"object": "{", "array": "[", "tuple": "[", "string": '"', "boolean": "tf", "number": "-0123456789", "int": "-0123456789"}


def read_document(spark: SparkSession, path: str, schema: Schema, fail_fast: bool = False) -> DataFrame:
    """Files that hold one JSON value each, an object or a scalar: file, valid, issues, data.

    The first character that isn't a blank tells whether the root can be what the schema says; where it can't, the text
    isn't parsed. A byte order mark isn't part of the text.
    """
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", r"\A\x{feff}", "").alias("json"))
    first = F.substring(F.regexp_replace("json", r"\A[ \t\r\n]+", ""), 1, 1)
    starts = ROOTS.get(schema.kind)
    fits = F.lit(True) if starts is None else first.isin(*starts) | (F.lit(schema.optional_ or schema.nullable_) & (first == "n"))
    made = parse_json(text.select("file", fits.alias("fits"), F.when(fits, F.col("json")).alias("json")), schema, "json")
    wrong = F.array(issue(F.lit(""), f"expected_{schema.kind}", schema.kind)).cast(ISSUES)
    made = made.select("file", (F.col("fits") & F.col("valid")).alias("valid"), F.when(F.col("fits"), F.col("issues")).otherwise(wrong).alias("issues"), "data")
    return raised(made) if fail_fast else made


#: Control characters that have a letter of their own; the others are written in four lower-case digits.
SHORT_ESCAPES = {8: "b", 9: "t", 10: "n", 12: "f", 13: "r"}


def quoted(c: Column) -> Column:
    """A JSON string as JavaScript writes it. Only texts with other control characters pay for their replacement."""
    plain = F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'(?s)\A\{"v":(.*)\}\z', 1)
    own = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for k in range(32):
        own = F.replace(own, F.lit(chr(k)), F.lit("\\" + SHORT_ESCAPES.get(k, f"u{k:04x}")))
    rare = c.rlike(r"[\x00-\x07\x0b\x0e-\x1f\x7f]")
    return F.when(c.isNotNull(), F.when(rare, F.concat(F.lit('"'), own, F.lit('"'))).otherwise(plain))


def bound(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)``, with the value worked out once however often ``of`` uses it."""
    return F.transform(F.array(value), of)[0]


def shortest(size: Column) -> Column:
    """A finite double above 0: the fewest digits that give it back, an exponent below 1e-6 and from 1e21 on.

    What Java writes gives the double back. Of numbers of 15 digits or fewer only one does, so where Java needs no more (and
    an exponent), its digits are these; others are formatted in several lengths, which takes some ten times as long.
    """

    def written(x: Column) -> Column:
        digits, point = x["digits"], x["point"]  # the value is 0.digits times ten to this
        n, e = F.length(digits), x["point"] - 1
        rest = lambda start: digits.substr(start, n)
        power = F.concat(digits.substr(F.lit(1), F.lit(1)), F.when(n > 1, F.concat(F.lit("."), rest(F.lit(2)))).otherwise(F.lit("")), F.lit("e"), F.when(e < 0, F.lit("-")).otherwise(F.lit("+")), F.abs(e).cast("string"))
        return (
            F.when((point > 21) | (point <= -6), power)
            .when(n <= point, F.rpad(digits, point, F.lit("0")))
            .when(point > 0, F.concat(digits.substr(F.lit(1), point), F.lit("."), rest(point + 1)))
            .otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
        )

    def parted(form: Column) -> Column:
        digits = F.regexp_replace(F.concat(F.substring(form, 1, 1), F.regexp_extract(form, r"\.(\d+)e", 1)), "0+\\z", "")
        return bound(F.struct(digits.alias("digits"), (F.regexp_extract(form, r"e([+-]\d+)", 1).cast("int") + 1).alias("point")), written)

    #: 15 digits tell doubles apart, but for the very small, which have fewer.
    forms = lambda *counts: F.array(*[F.format_string(f"%.{n}e", size) for n in counts])
    given = F.when(size < 1e-300, forms(*range(17))).otherwise(forms(14, 15, 16))
    tried = bound(F.get(F.filter(given, lambda x: x.cast("double") == size), F.lit(0)), parted)

    def known(java: Column) -> Column:
        first, power = F.substring_index(java, "E", 1), F.substring_index(java, "E", -1)
        digits = F.rtrim(F.replace(first, F.lit("."), F.lit("")), F.lit("0"))
        short = (size >= 1e-300) & java.contains("E") & (F.length(first) <= 16)
        return F.when(short, bound(F.struct(digits.alias("digits"), (power.cast("int") + 1).alias("point")), written)).otherwise(tried)

    return bound(size.cast("string"), known)


def number_text(c: Column) -> Column:
    """A double as JavaScript writes it. What isn't finite is null, and there is no minus zero.

    Whole numbers, and fractions that Java writes without an exponent in 15 digits or fewer, have that form already.
    """
    d = c.cast("double")
    size, plain = F.abs(d), d.cast("string")
    usual = (size >= 1e-3) & (size < 1e7) & (F.length(plain) <= 16)
    slow = F.concat(F.when(d < 0, F.lit("-")).otherwise(F.lit("")), shortest(size))
    return (
        F.when(F.isnan(d) | (size == float("inf")), F.lit("null"))
        .when((size < 1e15) & (d == F.rint(d)), F.when(size < 1e15, d).cast("long").cast("string"))
        .when(usual, plain)
        .when(d.isNotNull(), slow)
    )


def stringified(schema: Schema, c: Column) -> Column:
    """JSON text in the schema's order of keys; an absent optional field is left out, a null one written."""
    k = schema.kind
    if k == "object":
        parts = []
        for n, x in schema.items:
            one = F.concat(quoted(F.lit(n)), F.lit(":"), stringified(x, c[n]))
            parts.append(F.when(c[n].isNotNull(), one) if x.optional_ and not x.nullable_ else one)
        made = F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*parts)), ","), F.lit("}"))
    elif k == "array":
        made = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: stringified(schema.items, x)), ","), F.lit("]"))
    elif k in ("set", "map", "record", "tuple"):
        raise unsupported(f"{k} has no JSON text")
    elif k in ("number", "int", "bigint"):
        made = c.cast("string") if k != "number" else number_text(c)
    elif k == "boolean":
        made = c.cast("string")
    elif k == "date":
        made = F.concat(F.lit('"'), F.date_format(F.to_utc_timestamp(c, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit('"'))
    elif k in ("any", "unknown", "json", "union", "lazy"):
        made = F.to_json(c)
    elif schema.spark().simpleString() == "string":
        made = quoted(c)
    else:
        made = number_text(c) if schema.spark().simpleString() == "double" else c.cast("string")
    return F.coalesce(made, F.lit("null"))


def packings(sizes: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What a block of elements does to the piece it finds: (room, fill, closed).

    A piece with room for the first k elements, but not for k + 1, is closed before element k, which begins the next one;
    ``room[k]`` is what the first k take. From there on all is fixed: ``closed[k]`` pieces in all, ``fill[k]`` in the last.
    The last entry is for pieces that take the whole block.
    """
    ends = np.cumsum(sizes)
    leading = int(np.searchsorted(ends, budget, side="right"))
    fill, closed = np.zeros(leading + 1, np.int64), np.zeros(leading + 1, np.int64)
    known: dict[int, tuple[int, int]] = {}
    for k in range(min(leading, len(sizes) - 1) + 1):
        at, way = k, []
        while at < len(sizes) and at not in known:
            way.append(at)
            begun = ends[at] - sizes[at]
            at = max(int(np.searchsorted(ends, begun + budget, side="right")), at + 1)
        own = known.get(at) if at < len(sizes) else None
        for x in reversed(way):
            own = (own[0], own[1] + 1) if own else (int(ends[-1] - ends[x] + sizes[x]), 1)
            known[x] = own
        fill[k], closed[k] = known[k]
    return np.concatenate([[0], ends[:leading]]), fill, closed


def chunks(df: DataFrame, schema: Schema, by: str, chunk_units: int = 16 * 1024, block: int = 1 << 18) -> DataFrame:
    """(chunk, text): the array's text in pieces cut between elements, each as full as ``chunk_units`` UTF-16 units allow.

    An element that doesn't fit the piece begins the next, so a piece is longer only with a single element that is; the
    first may be ``[`` alone. Laid end to end, ordered by chunk, they are the whole text; without rows that is ``[]``.

    Where a piece ends depends on all before it, but a block of elements forgets soon: what it does depends on how many of
    its first elements the open piece takes. Blocks are worked out for each such number in parallel, one task runs through
    the blocks (a row each), and the blocks then place their elements in parallel.
    """
    if not isinstance(chunk_units, int) or chunk_units <= 0:
        raise EngineError("INVALID_OPERATION", "a piece's size is a whole number of 1 or more")
    spark = df.sparkSession
    ship(spark)
    rows = numbered(ordered(df.select(by, stringified(schema, F.struct(*df.columns)).alias("_t")), by))
    rows = rows.select("_n", "_t", F.floor(F.col("_n") / block).cast("long").alias("_b"))
    sizes = rows.select("_b", "_n", (utf16_length(F.col("_t")) + F.when(F.col("_n") > 0, 1).otherwise(0)).alias("size"))

    def summary(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_n")
        room, fill, closed = packings(part["size"].to_numpy(), chunk_units)
        return pd.DataFrame({"_b": [part["_b"].iloc[0]], "whole": [int(part["size"].sum())], "count": [len(part)], "room": [room], "fill": [fill], "closed": [closed]})

    def run_through(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fill, chunk = 1, 0
        for part in parts:
            out = []
            for b, whole, count, room, fills, closed in part.itertuples(index=False):
                out.append((b, fill, chunk))
                k = int(np.searchsorted(room, chunk_units - fill, side="right")) - 1 if fill < chunk_units else 0
                if k >= count:
                    fill += whole
                else:
                    fill, chunk = int(fills[k]), chunk + int(closed[k])
            yield pd.DataFrame(out, columns=["_b", "fill", "chunk"])

    def place(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_n")
        ends = np.cumsum(part["size"].to_numpy())
        chunk = np.empty(len(part), np.int64)
        at, own, free = 0, int(part["chunk"].iloc[0]), chunk_units - int(part["fill"].iloc[0])
        while at < len(part):
            begun = int(ends[at - 1]) if at else 0
            to = int(np.searchsorted(ends, begun + free, side="right")) if free >= 0 else at
            to = max(to, at + 1) if free == chunk_units else to
            chunk[at:to], at, own, free = own, to, own + 1, chunk_units
        return pd.DataFrame({"_n": part["_n"], "chunk": chunk})

    blocks = sizes.groupBy("_b").applyInPandas(summary, "_b long, whole long, count long, room array<long>, fill array<long>, closed array<long>")
    #: One row for each block.
    starts = blocks.orderBy("_b").coalesce(1).mapInPandas(run_through, "_b long, fill long, chunk long")
    placed = sizes.join(starts, "_b").groupBy("_b").applyInPandas(place, "_n long, chunk long")
    joined = rows.select("_n", "_t").join(placed, "_n").groupBy("chunk").agg(F.min("_n").alias("_first"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_t"))), lambda x: x["_t"]), ",").alias("_text"))
    one = spark.range(1)
    #: One row: the last piece's number, and whether the first piece is the opening bracket alone.
    edges = one.join(joined.agg(F.max("chunk").alias("_last"), F.min("chunk").alias("_least")))
    made = joined.join(F.broadcast(edges.select("_last"))).select("chunk", F.when(F.col("_first") == 0, F.when(F.col("chunk") == 0, F.lit("[")).otherwise(F.lit(""))).otherwise(F.lit(",")).alias("_lead"), "_text", (F.col("chunk") == F.col("_last")).alias("_ends"))
    made = made.select("chunk", F.concat("_lead", "_text", F.when(F.col("_ends"), F.lit("]")).otherwise(F.lit(""))).alias("text"))
    alone = edges.where("_last is null or _least > 0").select(F.lit(0).cast("long").alias("chunk"), F.when(F.col("_last").isNull(), F.lit("[]")).otherwise(F.lit("[")).alias("text"))
    return made.unionByName(alone)
