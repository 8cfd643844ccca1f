"""A compact binary form: little-endian, no field names, a version in front. Rows are packed in Arrow batches: column by
column where all of an object's fields are of fixed width or strings, else value by value.

Layout: version byte; numbers and dates 8-byte floats, int 4 bytes, bigint 8, boolean and enum 1; strings and collections
a 4-byte count in front; an object's optional fields 2 bits each in a block in front (0 absent, 1 null, 2 present); a union
1 byte for its option; literals nothing.
"""

from __future__ import annotations

import datetime as dt
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.errors import EngineError, unsupported
from ..plans.schema import Schema
from ..plans.shipping import ship

EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)


def bad(message: str) -> EngineError:
    return EngineError("CODEC", message)


def optional_fields(x: Schema) -> list[str]:
    return [n for n, f in x.items if f.optional_ or f.nullable_]


def encode_value(x: Schema, v: Any, out: bytearray) -> None:
    k = x.kind
    if k == "number":
        out += struct.pack("<d", v)
    elif k == "int":
        if not -(2**31) <= v < 2**31:
            raise bad(f"{v} is no 32-bit integer")
        out += struct.pack("<i", v)
    elif k == "bigint":
        out += struct.pack("<q", int(v))
    elif k == "boolean":
        out.append(1 if v else 0)
    elif k == "enum":
        out.append(x.items.index(v))
    elif k == "literal":
        pass
    elif k == "date":
        v = v.replace(tzinfo=dt.timezone.utc) if v.tzinfo is None else v
        out += struct.pack("<d", (v - EPOCH) / dt.timedelta(milliseconds=1))
    elif k in ("string", "template_literal"):
        raw = v.encode()
        out += struct.pack("<I", len(raw)) + raw
    elif k in ("array", "set"):
        out += struct.pack("<I", len(v))
        for e in v:
            encode_value(x.items, e, out)
    elif k in ("map", "record"):
        pairs = list(v.items() if isinstance(v, dict) else v)
        out += struct.pack("<I", len(pairs))
        for key, e in pairs:
            encode_value(x.items[0] if k == "map" else Schema("string"), key, out)
            encode_value(x.items[1] if k == "map" else x.items, e, out)
    elif k == "tuple":
        for i, slot in enumerate(x.items[0]):
            encode_value(slot, v[f"_{i}"], out)
        if x.items[1]:
            encode_value(Schema("array", x.items[1]), v["rest"], out)
    elif k == "object":
        names, bits = optional_fields(x), 0
        for i, n in enumerate(names):
            bits |= (2 if v.get(n) is not None else 1 if x.fields[n].nullable_ and not x.fields[n].optional_ else 0) << 2 * i
        out += bits.to_bytes((2 * len(names) + 7) // 8, "little")
        for n, f in x.items:
            if n not in names or v.get(n) is not None:
                encode_value(f, v[n], out)
    elif k == "union":
        at = next((i for i, o in enumerate(x.items) if fits(o, v)), None)
        if at is None:
            raise bad("no option of the union fits")
        out.append(at)
        encode_value(x.items[at], v, out)
    elif k == "discriminated_union":
        tag, options = x.items
        at = next(i for i, o in enumerate(options) if o.fields[tag].items[0] == v[tag])
        out.append(at)
        encode_value(options[at], v, out)
    elif k == "intersection":
        for o in x.items:
            encode_value(o, v, out)
    else:
        raise unsupported(f"{k} has no binary form")


def fits(x: Schema, v: Any) -> bool:
    """Whether a value has the shape that an option of a union describes."""
    k = x.kind
    if v is None:
        return x.optional_ or x.nullable_
    if k == "object":
        return isinstance(v, dict) and all(fits(f, v.get(n)) for n, f in x.items) and not any(w is not None and n not in x.fields for n, w in v.items())
    if k in ("array", "set"):
        return isinstance(v, list) and all(fits(x.items, e) for e in v)
    if k in ("literal", "enum"):
        return v in x.items
    kinds = {"string": str, "template_literal": str, "boolean": bool, "date": dt.datetime, "bigint": (int, Decimal), "int": int, "number": (int, float)}
    return isinstance(v, kinds.get(k, object)) and (k == "boolean" or not isinstance(v, bool))


def decode_value(x: Schema, b: memoryview, at: int) -> tuple[Any, int]:
    k = x.kind
    fixed = {"number": "<d", "int": "<i"}
    if k == "bigint":
        return Decimal(struct.unpack_from("<q", b, at)[0]), at + 8
    if k in fixed:
        return struct.unpack_from(fixed[k], b, at)[0], at + struct.calcsize(fixed[k])
    if k == "boolean":
        return b[at] == 1, at + 1
    if k == "enum":
        return x.items[b[at]], at + 1
    if k == "literal":
        return x.items[0], at
    if k == "date":
        return EPOCH + dt.timedelta(milliseconds=struct.unpack_from("<d", b, at)[0]), at + 8
    if k in ("string", "template_literal"):
        n = struct.unpack_from("<I", b, at)[0]
        return bytes(b[at + 4 : at + 4 + n]).decode(), at + 4 + n
    if k in ("array", "set"):
        n, at, out = struct.unpack_from("<I", b, at)[0], at + 4, []
        for _ in range(n):
            v, at = decode_value(x.items, b, at)
            out.append(v)
        return out, at
    if k in ("map", "record"):
        n, at, pairs = struct.unpack_from("<I", b, at)[0], at + 4, []
        for _ in range(n):
            key, at = decode_value(x.items[0] if k == "map" else Schema("string"), b, at)
            v, at = decode_value(x.items[1] if k == "map" else x.items, b, at)
            pairs.append((key, v))
        return pairs, at
    if k == "tuple":
        out = {}
        for i, slot in enumerate(x.items[0]):
            out[f"_{i}"], at = decode_value(slot, b, at)
        if x.items[1]:
            out["rest"], at = decode_value(Schema("array", x.items[1]), b, at)
        return out, at
    if k == "object":
        names = optional_fields(x)
        size = (2 * len(names) + 7) // 8
        bits, at, out = int.from_bytes(b[at : at + size], "little"), at + size, {}
        for n, f in x.items:
            if n in names and (bits >> 2 * names.index(n)) & 3 != 2:
                out[n] = None
            else:
                out[n], at = decode_value(f, b, at)
        return out, at
    if k == "union":
        v, at = decode_value(x.items[b[at]], b, at + 1)
        names = [f.name for f in x.spark().fields] if isinstance(v, dict) else []
        return {n: v.get(n) for n in names} if isinstance(v, dict) else v, at
    if k == "discriminated_union":
        v, at = decode_value(x.items[1][b[at]], b, at + 1)
        return {f.name: v.get(f.name) for f in x.spark().fields}, at
    if k == "intersection":
        out = {}
        for o in x.items:
            v, at = decode_value(o, b, at)
            out |= v
        return out, at
    raise unsupported(f"{k} has no binary form")


#: Kinds whose columns are packed as arrays: the type in the bytes, and its width.
FIXED = {"number": ("<f8", 8), "int": ("<i4", 4), "boolean": ("u1", 1), "enum": ("u1", 1), "date": ("<f8", 8)}


def columnar(x: Schema) -> bool:
    """Whether all fields of an object are of fixed width or strings, so that rows are packed column by column."""
    return x.kind == "object" and bool(x.items) and all(f.kind in FIXED or f.kind == "string" for _, f in x.items)


def placed(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of pieces of these sizes that begin at ``starts``, laid end to end."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def fixed_values(f: Schema, column: pa.Array) -> np.ndarray:
    """A column without nulls in the type that the bytes have."""
    if f.kind == "enum":
        at = pc.index_in(column, pa.array(f.items, column.type))
        if at.null_count:
            raise bad("a value isn't one of the enum's")
        return at.to_numpy(zero_copy_only=False).astype("u1")
    if f.kind == "date":
        return column.cast(pa.timestamp("us", "UTC")).cast(pa.int64()).to_numpy(zero_copy_only=False) / 1000
    values = column.to_numpy(zero_copy_only=False)
    if f.kind == "int" and len(values) and (values.min() < -(2**31) or values.max() >= 2**31):
        raise bad("a value is no 32-bit integer")
    return values.astype(FIXED[f.kind][0])


def encode_columns(x: Schema, version: int, batch: pa.RecordBatch) -> pa.Array:
    """The rows of a batch, packed field by field."""
    n, names = batch.num_rows, optional_fields(x)
    mask = np.zeros((n, (2 * len(names) + 7) // 8), np.uint8)
    fields, sizes = [], np.full(n, 1 + mask.shape[1], np.int64)
    for name, f in x.items:
        column = batch.column(name)
        there = pc.is_valid(column).to_numpy(zero_copy_only=False)
        if name in names:
            k = names.index(name)
            bits = np.where(there, 2, 1 if f.nullable_ and not f.optional_ else 0).astype(np.uint8)
            mask[:, k // 4] |= bits << (2 * (k % 4))
        elif not there.all():
            raise bad(f"{name} must have a value")
        column = column.drop_null()
        if f.kind == "string":
            raw = column.cast(pa.large_binary())
            ends = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
            data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]] if len(raw) else np.empty(0, np.uint8)
            own = (np.diff(ends), data)
            sizes[there] += 4 + own[0]
        else:
            own = fixed_values(f, column)
            sizes[there] += FIXED[f.kind][1]
        fields.append((f, there, own))
    ends = np.concatenate([[0], np.cumsum(sizes)])
    out, at = np.zeros(int(ends[-1]), np.uint8), ends[:-1] + 1
    out[ends[:-1]] = version
    out[at[:, None] + np.arange(mask.shape[1])] = mask
    at = at + mask.shape[1]
    for f, there, own in fields:
        here = at[there]
        if f.kind == "string":
            lengths, data = own
            out[here[:, None] + np.arange(4)] = lengths.astype("<u4").view(np.uint8).reshape(-1, 4)
            out[placed(here + 4, lengths)] = data
            at[there] += 4 + lengths
        else:
            width = FIXED[f.kind][1]
            out[here[:, None] + np.arange(width)] = own.view(np.uint8).reshape(-1, width)
            at[there] += width
    return pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(out.tobytes())]).cast(pa.binary())


def decode_columns(x: Schema, version: int, column: pa.Array, kind: pa.Schema) -> pa.RecordBatch:
    """The batch that rows of bytes stand for, field by field."""
    raw, names = column.cast(pa.large_binary()), optional_fields(x)
    n = len(raw)
    starts = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + n] if n else np.empty(0, np.int64)
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)
    if raw.null_count or n and (data[starts] != version).any():
        raise bad(f"another version than {version}")
    at = starts + 1
    width = (2 * len(names) + 7) // 8
    mask = data[at[:, None] + np.arange(width)]
    at, made = at + width, []
    for name, f in x.items:
        there = np.ones(n, bool)
        if name in names:
            k = names.index(name)
            there = (mask[:, k // 4] >> (2 * (k % 4))) & 3 == 2
        here = at[there]
        if f.kind == "string":
            lengths = data[here[:, None] + np.arange(4)].copy().view("<u4").reshape(-1).astype(np.int64)
            body = data[placed(here + 4, lengths)]
            ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
            own = pa.Array.from_buffers(pa.large_binary(), len(here), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(body.tobytes())]).cast(pa.large_string())
            at[there] += 4 + lengths
        else:
            form, size = FIXED[f.kind]
            values = data[here[:, None] + np.arange(size)].copy().view(form).reshape(-1)
            at[there] += size
            own = pa.array(f.items).take(pa.array(values)) if f.kind == "enum" else pa.array(np.rint(values * 1000).astype(np.int64)).cast(pa.timestamp("us", "UTC")) if f.kind == "date" else pa.array(values == 1 if f.kind == "boolean" else values)
        place = np.where(there, np.cumsum(there) - 1, 0)
        spread = own.take(pa.array(place, mask=~there)) if len(own) else pa.nulls(n, own.type)
        made.append(spread.cast(kind.field(name).type))
    return pa.RecordBatch.from_arrays(made, schema=kind)


@dataclass(frozen=True)
class Codec:
    schema: Schema
    version: int = 1

    def __post_init__(self) -> None:
        if not 0 <= self.version <= 255:
            raise bad("a version is a byte")
        if self.schema.kind in ("any", "unknown"):
            raise unsupported(f"{self.schema.kind} has no binary form")

    def encode_one(self, v: Any) -> bytes:
        out = bytearray([self.version])
        encode_value(self.schema, v, out)
        return bytes(out)

    def encode_into(self, v: Any, target: bytearray, at: int = 0) -> int:
        """Writes into ``target`` from ``at`` on; how many bytes. A target that is too small isn't touched."""
        made = self.encode_one(v)
        if at + len(made) > len(target):
            raise bad(f"{len(made)} bytes don't fit into {len(target) - at}")
        target[at : at + len(made)] = made
        return len(made)

    def decode_one(self, b: bytes) -> Any:
        if not b or b[0] != self.version:
            raise bad(f"version {b[0] if b else None} instead of {self.version}")
        return decode_value(self.schema, memoryview(b), 1)[0]

    def encode(self, df: DataFrame) -> DataFrame:
        """(bytes) of each row."""
        ship(df.sparkSession)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                made = encode_columns(self.schema, self.version, b) if columnar(self.schema) else pa.array([self.encode_one(r) for r in b.to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([made], ["bytes"])

        return df.mapInArrow(run, "bytes binary")

    def decode(self, df: DataFrame, column: str = "bytes") -> DataFrame:
        """The rows that the bytes stand for."""
        from pyspark.sql.pandas.types import to_arrow_schema

        ship(df.sparkSession)
        kind = self.schema.spark()
        arrow = to_arrow_schema(kind)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if columnar(self.schema):
                    yield decode_columns(self.schema, self.version, b.column(0), arrow)
                else:
                    yield pa.RecordBatch.from_pylist([self.decode_one(x) for x in b.column(0).to_pylist()], schema=arrow)

        return df.select(F.col(column)).mapInArrow(run, kind)
