"""Rowsets: typed rows loaded once and queried many times. Spark's columnar cache and Parquet take the place of buffers."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from ..operators.collection import aggregate
from ..plans.ordinal import Ordered, ordered
from ..plans.query import Query
from ..plans.schema import Schema


@dataclass
class Rowset:
    """Columns of the schema only. Memory spills to disk; a lost executor's part is read again from the source."""

    df: DataFrame

    @classmethod
    def load(cls, spark: SparkSession, schema: Schema, values: Any) -> Rowset:
        kind = schema.spark()
        df = values.select(*[values[f.name].cast(f.dataType) for f in kind.fields]) if isinstance(values, DataFrame) else spark.createDataFrame(list(values), kind)
        return cls(df.persist(StorageLevel.MEMORY_AND_DISK))

    def query(self, q: Query, *by: str, **params: Any) -> DataFrame:
        return q.run(ordered(self.df, *by) if by else Ordered(self.df, 0), **params)

    def hydrate(self, limit: int | None = None) -> list[dict[str, Any]]:
        """Rows as Python values; for a bounded number unless the caller knows better."""
        return [r.asDict(recursive=True) for r in (self.df.limit(limit) if limit is not None else self.df).toLocalIterator()]

    def release(self) -> None:
        self.df.unpersist()

    clear = release


def pruned(q: Query, df: DataFrame) -> list[str]:
    """The columns that a query touches, so that a scan reads no others."""
    from ..functions.predicates import fields_of

    used: set[str] = set()
    narrows = False
    for kind, args in q.nodes:
        if kind in ("filter", "take_while", "drop_while"):
            used |= set(fields_of(args[0]))
        elif kind == "select":
            used, narrows = used | set(args), True
        elif kind == "aggregate":
            used, narrows = used | ({args[1]} - {None}), True
        elif kind in ("unique", "keyed", "group_by", "order_by", "flat_map", "group_adjacent"):
            used.add(args[0])
        elif kind == "scan" and args[1]:
            used.add(args[1])
    return [c for c in df.columns if c in used] if narrows else df.columns


def process(spark: SparkSession, path: str, q: Query, *by: str, **params: Any) -> DataFrame:
    """Load and query in one plan: columns pruned, filters pushed to the Parquet scan."""
    df = spark.read.parquet(path)
    df = df.select(*dict.fromkeys([*pruned(q, df), *by]))
    return q.run(ordered(df, *by) if by else Ordered(df, 0), **params)


__all__ = ["Rowset", "aggregate", "process", "pruned"]
