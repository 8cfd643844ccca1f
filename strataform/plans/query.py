"""The query builder and its two planners.

Without an order-sensitive node a query is planned eagerly, in one fixed order (filter, unique, collect or sort, project;
the last of repeated nodes wins). With one, nodes run one after the other as written.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..functions.predicates import Both, Conditions, compile_predicate, fields_of, params_of
from ..operators import collection as C
from ..operators import sequence as S
from .errors import invalid_query
from .ordinal import Ordered

INCREMENTAL = {"flat_map", "take", "drop", "take_while", "drop_while", "chunk", "window", "pairwise", "scan", "group_adjacent"}
EAGER_ONLY = {"keyed", "group_by", "aggregate", "delete", "update"}
#: What a node keeps while rows stream through it, and whether it needs all rows first.
STATE = {"unique": "Set(key)", "chunk": "chunk(n)", "window": "window(n)", "pairwise": "previous item", "scan": "accumulator", "group_adjacent": "adjacent group"}


@dataclass(frozen=True)
class Query:
    """A query over rows with the given fields (a DataFrame's columns, or a schema's keys)."""

    fields: tuple[str, ...]
    nodes: tuple[tuple[str, tuple], ...] = ()
    known_params: tuple[str, ...] | None = None

    def _add(self, kind: str, *args: Any) -> Query:
        return replace(self, nodes=(*self.nodes, (kind, args)))

    def _predicate(self, p: Any) -> Any:
        p = p(Conditions) if callable(p) else p
        if self.known_params is not None and (odd := set(params_of(p)) - set(self.known_params)):
            raise invalid_query(f"unknown parameter {sorted(odd)[0]!r}")
        return p

    def params(self, *names: str) -> Query:
        return replace(self, known_params=names)

    def filter(self, p: Any) -> Query:
        return self._add("filter", self._predicate(p))

    def select(self, *names: str) -> Query:
        return self._add("select", *names)

    def unique(self, key: str) -> Query:
        return self._add("unique", key)

    def keyed(self, key: str) -> Query:
        return self._add("keyed", key)

    def group_by(self, key: str) -> Query:
        return self._add("group_by", key)

    def order_by(self, key: str, direction: str = "asc") -> Query:
        if direction not in ("asc", "desc"):
            raise invalid_query(f"no direction {direction!r}")
        return self._add("order_by", key, direction)

    def sum(self, key: str) -> Query:
        return self._add("aggregate", "sum", key)

    def count(self) -> Query:
        return self._add("aggregate", "count", None)

    def avg(self, key: str) -> Query:
        return self._add("aggregate", "avg", key)

    def min(self, key: str) -> Query:
        return self._add("aggregate", "min", key)

    def max(self, key: str) -> Query:
        return self._add("aggregate", "max", key)

    def delete(self) -> Query:
        return self._add("delete")

    def update(self, **patch: Any) -> Query:
        return self._add("update", patch)

    def flat_map(self, key: str) -> Query:
        return self._add("flat_map", key)

    def take(self, n: int) -> Query:
        return self._add("take", S.count_of(n, 1))

    def drop(self, n: int) -> Query:
        return self._add("drop", S.count_of(n, 0))

    def take_while(self, p: Any) -> Query:
        return self._add("take_while", self._predicate(p))

    def drop_while(self, p: Any) -> Query:
        return self._add("drop_while", self._predicate(p))

    def chunk(self, n: int) -> Query:
        return self._add("chunk", S.count_of(n, 1))

    def window(self, n: int) -> Query:
        return self._add("window", S.count_of(n, 1))

    def pairwise(self) -> Query:
        return self._add("pairwise")

    def scan(self, fold: str | Callable, key: str | None = None, initial: Any = None, kind: str = "double") -> Query:
        """``scan("sum", "value")``, or ``scan(lambda state, row: ..., initial=0.0)``."""
        return self._add("scan", fold, key, initial, kind)

    def group_adjacent_by(self, key: str) -> Query:
        return self._add("group_adjacent", key)

    # Planning

    @property
    def incremental(self) -> bool:
        return any(k in INCREMENTAL for k, _ in self.nodes)

    def compile(self) -> Callable[..., Ordered | DataFrame]:
        """A function of an ``Ordered`` and parameters; keyed and sorted results are ``Ordered``, others DataFrames where order is lost."""
        self._check()
        return self._sequential if self.incremental else self._eager

    @property
    def in_order(self) -> bool:
        """Whether the result's order is asked for: by a sort, or by a node that works in order."""
        return self.incremental or self._last("order_by") is not None

    def run(self, o: Ordered, **params: Any) -> DataFrame:
        """The result without its ordinal, sorted by it where an order is asked for. (Filters alone don't pay for a sort.)"""
        out = self.compile()(o, **params)
        if not isinstance(out, Ordered):
            return out
        return (out.df.orderBy(*out.ord) if self.in_order else out.df).select(*out.fields)

    def visit(self, o: Ordered, consume: Callable[[Any], None], **params: Any) -> int:
        """Calls ``consume`` with each row on the executors; how many rows there were.

        The tasks' results count, not what they did: a task that runs twice counts once, though it consumes twice.
        """
        out = self.compile()(o, **params)
        rows = out.frame if isinstance(out, Ordered) else out
        names = rows.columns

        def part(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in parts:
                for r in b.to_pylist():
                    consume(Row(**{n: r[n] for n in names}))
                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

        return rows.mapInArrow(part, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def iterate(self, o: Ordered, **params: Any):
        """Pulls rows in order, partition by partition."""
        out = self.compile()(o, **params)
        return (out.df.orderBy(*out.ord).select(*out.fields) if isinstance(out, Ordered) else out).toLocalIterator()

    def _last(self, kind: str) -> tuple | None:
        return next((a for k, a in reversed(self.nodes) if k == kind), None)

    def _check(self) -> None:
        known, kinds = set(self.fields), {k for k, _ in self.nodes}
        if self.incremental and (odd := kinds & EAGER_ONLY):
            raise invalid_query(f"{sorted(odd)[0]} can't stand beside an order-sensitive node")
        for kind, args in self.nodes:
            names = set(args) if kind == "select" else {args[0]} if kind in ("unique", "keyed", "group_by", "order_by", "flat_map", "group_adjacent") else {args[1]} if kind in ("aggregate", "scan") and args[1] else set(args[0]) if kind == "update" else set(fields_of(args[0])) if kind in ("filter", "take_while", "drop_while") else set()
            if odd := names - known:
                raise invalid_query(f"unknown field {sorted(odd)[0]!r}")
            if kind in ("flat_map",):
                known = {"value"}
            elif kind in ("chunk", "window", "group_adjacent"):
                known = {"items"}
            elif kind == "pairwise":
                known = {"prev", "cur"}
            elif kind == "scan":
                known = {"value"}
        if self.incremental:
            return
        if kinds & {"keyed", "group_by"} and "order_by" in kinds:
            raise invalid_query("keyed and group_by results can't be sorted")
        if "aggregate" in kinds and kinds & {"select", "keyed", "group_by", "order_by", "delete", "update"}:
            raise invalid_query("an aggregate stands beside filter and unique only")
        if kinds & {"delete", "update"}:
            if "filter" not in kinds:
                raise invalid_query("delete and update need a filter")
            if kinds & {"select", "keyed", "group_by", "order_by"} or kinds >= {"delete", "update"}:
                raise invalid_query("delete and update stand beside filter only")

    def _condition(self, o: Ordered, params: dict[str, Any]):
        parts = tuple(a[0] for k, a in self.nodes if k == "filter")
        return compile_predicate(Both("and", parts), {f.name: f.dataType for f in o.df.schema}, params) if parts else None

    def _eager(self, o: Ordered, **params: Any) -> Ordered | DataFrame:
        where = self._condition(o, params)
        if self._last("delete") is not None:
            return o.put(C.delete(o.df, where))
        if patch := self._last("update"):
            return o.put(C.update(o.df, where, patch[0]))
        if where is not None:
            o = o.put(o.df.where(where))
        if key := self._last("unique"):
            o = C.first_by(o, key[0])
        if agg := self._last("aggregate"):
            return C.aggregate(o.df, *agg)
        wanted = list(self._last("select") or o.fields)
        if key := self._last("group_by"):
            return C.grouped(o, key[0], F.struct(*wanted))
        if key := self._last("keyed"):
            out = C.keyed(o, key[0])
            return out.put(out.df.select(F.col(key[0]).alias("key"), F.struct(*wanted).alias("value"), *out.ord))
        if sort := self._last("order_by"):
            o = C.order_by(o, *sort)
        return o.put(o.df.select(*wanted, *o.ord))

    def _sequential(self, o: Ordered, **params: Any) -> Ordered:
        for kind, args in self.nodes:
            types = {f.name: f.dataType for f in o.df.schema}
            if kind == "filter":
                o = o.put(o.df.where(compile_predicate(args[0], types, params)))
            elif kind == "select":
                o = o.put(o.df.select(*args, *o.ord))
            elif kind == "unique":
                o = C.first_by(o, args[0])
            elif kind == "order_by":
                o = C.order_by(o, *args)
            elif kind in ("take_while", "drop_while"):
                o = getattr(S, kind)(o, compile_predicate(args[0], types, params))
            elif kind == "scan":
                fold, key, initial, out = args
                o = S.fold_in_order(o, initial, fold, out) if callable(fold) else S.scan(o, fold, key, initial)
            else:
                o = getattr(S, kind)(o, *args)
        return o

    def explain(self, o: Ordered | None = None, **params: Any) -> dict[str, Any]:
        """What the plan holds back: whether it makes all rows, its barriers, its state, whether it can end early, and new
        objects for each result. With rows to run on, Spark's plan as well."""
        kinds = [k for k, _ in self.nodes]
        barriers = [k for k in kinds if k in ("order_by", "keyed", "group_by", "aggregate")]
        return {
            "mode": "sequential" if self.incremental else "eager",
            "materializes": not self.incremental or bool(barriers),
            "barriers": barriers,
            "retained_state": [STATE[k] for k in kinds if k in STATE],
            "early_termination": any(k in ("take", "take_while") for k in kinds),
            "allocations_per_result": int(any(k in ("select", "chunk", "window", "pairwise") for k in kinds)),
            **({} if o is None else {"plan": self.run(o, **params)._jdf.queryExecution().explainString(_formatted(o.df))}),
        }


def _formatted(df: DataFrame) -> Any:
    return df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")


def query(of: DataFrame | Ordered | tuple[str, ...] | list[str]) -> Query:
    if isinstance(of, Ordered):
        return Query(tuple(of.fields))
    return Query(tuple(of.columns) if isinstance(of, DataFrame) else tuple(of))
