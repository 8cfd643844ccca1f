"""A schema's operations in one place. An operation is built when it is asked for, and only those that were chosen are there.

Keys that a call leaves out come from the schema's hints.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial
from typing import Any

from ..functions import validate, values
from ..plans.errors import EngineError
from ..plans.ordinal import Ordered
from ..plans.query import query
from ..plans.schema import Schema
from ..sources.codec import Codec
from ..sources.jsonio import parse_json, stringified
from . import collection

KEY_HINTS = ("unique_by", "index_by", "keyed", "entity")


def key_of(schema: Schema, key: str | None, *hints: str) -> str:
    """``key``, or the first hint that names a field."""
    found = key or next((k for h in hints if isinstance(k := schema.hinted(h), str)), None)
    if found is None:
        raise EngineError("INVALID_OPERATION", f"no key, and the schema has none of the hints {', '.join(hints)}")
    if found not in schema.fields:
        raise EngineError("INVALID_OPERATION", f"unknown field {found!r}")
    return found


def unique_by(schema: Schema, o: Ordered, key: str | None = None) -> Ordered:
    return collection.first_by(o, key_of(schema, key, *KEY_HINTS))


def group_by(schema: Schema, o: Ordered, key: str | None = None):
    return collection.grouped(o, key_of(schema, key, "group_by"))


def sort_by(schema: Schema, o: Ordered, key: str | None = None, direction: str | None = None) -> Ordered:
    return collection.order_by(o, key_of(schema, key, "sort_by", "ordered"), direction or schema.hinted("direction") or "asc")


def normalize(schema: Schema, o: Ordered, key: str | None = None):
    return collection.normalized(o, key_of(schema, key, "index_by", "keyed", "entity", "unique_by"))


#: On frames: is_, parse, safe_parse, quarantine, from_json; on ordered rows: unique_by to normalize; on Columns: the rest.
OPERATIONS: dict[str, Callable[..., Any]] = {
    "is_": lambda schema, df: validate.is_valid(df, schema),
    "parse": lambda schema, df: validate.parse(df, schema),
    "safe_parse": lambda schema, df: validate.safe_parse(df, schema),
    "quarantine": lambda schema, df: validate.quarantine(df, schema),
    "from_json": lambda schema, df, column="json": parse_json(df, schema, column),
    "unique_by": unique_by,
    "group_by": group_by,
    "sort_by": sort_by,
    "normalize": normalize,
    "equal": values.equal,
    "clone": lambda schema, c: c,  # columns don't change
    "diff": values.diff,
    "hash": values.hash31,
    "update": lambda schema, c, change: values.drafted(schema, c, change) if callable(change) else values.patch(schema, c, change),
    "merge": values.merge,
    "pick": values.pick,
    "omit": values.omit,
    "transform": values.transformed,
    "mask": lambda schema, c: values.scrubbed(schema, c, "mask"),
    "sanitize": lambda schema, c: values.scrubbed(schema, c, "sanitize"),
    "stringify": stringified,
    "codec": lambda schema, version=1: Codec(schema, version),
    "query": lambda schema: query(list(schema.fields)),
}


class Model:
    def __init__(self, schema: Schema, *operations: str) -> None:
        if odd := set(operations) - set(OPERATIONS):
            raise EngineError("INVALID_OPERATION", f"unknown operation {sorted(odd)[0]!r}")
        self.schema = schema
        self.operations = operations or tuple(OPERATIONS)

    def __getattr__(self, name: str) -> Callable[..., Any]:
        if name.startswith("__") or name not in OPERATIONS:
            raise AttributeError(name)
        if name not in self.operations:
            raise EngineError("INVALID_OPERATION", f"{name} was not chosen")
        made = self.__dict__[name] = partial(OPERATIONS[name], self.schema)
        return made


def model(schema: Schema, *operations: str) -> Model:
    """``model(shape)`` has all operations, ``model(shape, "is_", "hash")`` those two."""
    return Model(schema, *operations)
