"""Comparing snapshots: keyed changes between two frames, a log of additions and removals, and a small observable value."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import two_valued
from ..plans.errors import EngineError
from ..plans.ordinal import Ordered
from .collection import keyed


@dataclass(frozen=True)
class Watched:
    new: DataFrame
    removed: DataFrame
    updated: DataFrame

    @property
    def is_changed(self) -> bool:
        return not (self.new.isEmpty() and self.removed.isEmpty() and self.updated.isEmpty())


def watch(previous: Ordered, current: Ordered, key: str) -> Watched:
    """What came, went and changed. Of equal keys in the previous snapshot the last counts; a change is one of value."""
    prev, cur = keyed(previous, key).frame, current.frame
    both = cur.select(F.col(key).alias("_k"), F.struct(*cur.columns).alias("current")).join(prev.select(F.col(key).alias("_k"), F.struct(*prev.columns).alias("previous")), "_k")
    return Watched(
        cur.join(prev.select(key), key, "left_anti").select(*cur.columns),
        prev.join(cur.select(key), key, "left_anti").select(*prev.columns),
        both.where(~F.col("current").eqNullSafe(F.col("previous"))).select("previous", "current"),
    )


def tell(w: Watched, on_add=None, on_remove=None, on_update=None) -> int:
    """Calls back, on the driver and one row at a time, for what came, went and changed; how many calls there were."""
    calls = 0
    for rows, call in ((w.new, on_add), (w.removed, on_remove), (w.updated, on_update)):
        for r in rows.toLocalIterator() if call else ():
            call(r) if rows is not w.updated else call(r["previous"], r["current"])
            calls += 1
    return calls


class WatchedList:
    """A keyed list and what has become of it: additions and removals one after the other, and updates with a whole list.

    Nothing runs until a result is asked for. Each change is a frame of rows of its own, however many rows it has.
    """

    def __init__(self, items: Ordered, key: str, compare: Callable[[Column, Column], Column] | None = None) -> None:
        self.key, self.fields, self.compare = key, items.fields, compare
        self.initial = keyed(items, key).frame
        self.current, self.new, self.removed = self.initial, self.initial.where("false"), self.initial.where("false")
        self.changed = self.initial.select(F.struct(*self.fields).alias("previous"), F.struct(*self.fields).alias("current")).where("false")

    def _without(self, rows: DataFrame, those: DataFrame) -> DataFrame:
        return rows.join(those.select(self.key), self.key, "left_anti").select(*self.fields)

    def _among(self, rows: DataFrame, those: DataFrame) -> DataFrame:
        return rows.join(those.select(self.key), self.key, "left_semi").select(*self.fields)

    def add(self, rows: DataFrame) -> WatchedList:
        """What is there already stays as it is; what was removed comes back, and is no removal any more."""
        fresh = self._without(rows.select(*self.fields), self.current)
        back, self.removed = self._among(fresh, self.removed), self._without(self.removed, fresh)
        self.new = self.new.unionByName(self._without(fresh, back))
        self.current = self.current.unionByName(fresh)
        return self

    def remove(self, rows: DataFrame) -> WatchedList:
        """What was new was never there; what is from the start is a removal."""
        gone = self._among(self.current, rows)
        self.removed = self.removed.unionByName(self._without(gone, self.new))
        self.new, self.current = self._without(self.new, gone), self._without(self.current, gone)
        return self

    def update(self, rows: Ordered) -> WatchedList:
        """The list becomes ``rows``: compared with what it is now, keys come, go, or change their values."""
        cur = keyed(rows, self.key).frame
        both = cur.select(F.col(self.key).alias("_k"), F.struct(*self.fields).alias("current")).join(self.current.select(F.col(self.key).alias("_k"), F.struct(*self.fields).alias("previous")), "_k")
        same = self.compare_items(F.col("previous"), F.col("current"))
        self.changed = both.where(~same).select("previous", "current")
        #: As ``add`` of what came and ``remove`` of what went (a null key never goes), without their joins of joins.
        came, gone = self._without(cur, self.current), self._without(self.current, cur).where(F.col(self.key).isNotNull())
        new, removed = self._without(came, self.removed), self._without(gone, self.new)
        self.new, self.removed = self._without(self.new, gone).unionByName(new), self._without(self.removed, cur).unionByName(removed)
        self.current = cur.select(*self.fields)
        return self

    def compare_items(self, a: Column, b: Column) -> Column:
        """Whether two items are the same: by the list's own comparison, else by value."""
        return two_valued(self.compare(a, b)) if self.compare else a.eqNullSafe(b)

    def exists(self, key: Any) -> bool:
        return not self.current.where(F.col(self.key).eqNullSafe(F.lit(key))).isEmpty()

    def snapshot(self) -> dict[str, DataFrame]:
        return {"initial": self.initial, "current": self.current, "new": self.new, "removed": self.removed, "updated": self.changed}

    @property
    def is_changed(self) -> bool:
        return not (self.new.isEmpty() and self.removed.isEmpty() and self.changed.isEmpty())


def replay(initial: Ordered, log: Ordered, key: str, op: str = "op") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(current, new, removed) after a log of ``add`` and ``remove`` rows with the same fields: the last word on a key holds.

    What is added again after its removal is no removal; what is removed after its addition was never there.
    """
    fields = initial.fields
    last = log.df.groupBy(key).agg(F.max_by(F.struct(op, *fields), F.struct(*log.ord)).alias("_l")).select(F.col(f"_l.{op}").alias("_op"), *[F.col(f"_l.{c}").alias(c) for c in fields])
    added, gone = last.where("_op = 'add'").drop("_op"), last.where("_op = 'remove'").select(key)
    start = keyed(initial, key).frame
    new = added.join(start.select(key), key, "left_anti").select(*fields)
    removed = start.join(gone, key, "left_semi").select(*fields)
    current = start.join(last.select(key), key, "left_anti").select(*fields).unionByName(added.select(*fields))
    return current, new, removed


@dataclass
class Store:
    """One value on the driver, with subscribers: an event for each change that has an effect, one for a whole batch."""

    value: dict[str, Any]
    on_error: Callable[[Exception], None] | None = None
    #: Takes what is to be run later, e.g. an event loop's ``call_soon``; without one, listeners are told at once.
    schedule: Callable[[Callable[[], None]], Any] | None = None
    version: int = 0
    _listeners: list[tuple[str | None, Callable]] = field(default_factory=list)
    _batch: int = 0
    _before: Any = None
    _waiting: bool = False
    _disposed: bool = False

    def subscribe(self, listener: Callable[[dict], None], path: str | None = None) -> Callable[[], None]:
        entry = (path, listener)
        self._listeners.append(entry)
        return lambda: self._listeners.remove(entry) if entry in self._listeners else None

    def watch(self, path: str, listener: Callable[[dict], None]) -> Callable[[], None]:
        return self.subscribe(listener, path)

    def select(self, fn: Callable[[dict], Any]) -> Any:
        return fn(self.value)

    def update(self, **changes: Any) -> None:
        self.set(deep_merge(self.value, changes))

    def set(self, value: dict[str, Any]) -> None:
        if self._disposed:
            raise EngineError("DISPOSED", "the store has been disposed of")
        if value == self.value:
            return
        before, self.value, self.version = self.value, value, self.version + 1
        if self._batch or self.schedule:
            self._before = before if self._before is None else self._before
        else:
            self._tell(before)
        if self.schedule and not self._batch and not self._waiting:
            self._waiting = True
            self.schedule(self._scheduled)

    def _scheduled(self) -> None:
        """All changes since the last time are one event."""
        self._waiting = False
        if not self._disposed:
            self.flush()

    def batch(self, run: Callable[[], None]) -> None:
        self._batch += 1
        try:
            run()
        finally:
            self._batch -= 1
            if not self._batch:
                self.flush()

    def flush(self) -> None:
        before, self._before = self._before, None
        if before is not None and before != self.value:
            self._tell(before)

    def dispose(self) -> None:
        self._disposed = True
        self._listeners.clear()

    def _tell(self, before: dict) -> None:
        changes = value_changes(before, self.value)
        for path, listener in list(self._listeners):
            if path is None or any(c["path"] == path or c["path"].startswith(f"{path}.") or path.startswith(f"{c['path']}.") for c in changes):
                try:
                    listener({"previous": before, "value": self.value, "version": self.version, "changes": changes})
                except Exception as e:
                    if self.on_error is None:
                        raise
                    self.on_error(e)


def deep_merge(a: Any, b: Any) -> Any:
    return {**a, **{k: deep_merge(a.get(k), v) for k, v in b.items()}} if isinstance(a, dict) and isinstance(b, dict) else b


def value_changes(a: Any, b: Any, path: str = "") -> list[dict[str, Any]]:
    if isinstance(a, dict) and isinstance(b, dict):
        at = lambda k: f"{path}.{k}" if path else k
        out = [{"type": "remove", "path": at(k)} for k in a if k not in b]
        for k, v in b.items():
            out += value_changes(a[k], v, at(k)) if k in a else [{"type": "add", "path": at(k), "value": v}]
        return out
    return [] if a == b else [{"type": "update", "path": path, "value": b}]
