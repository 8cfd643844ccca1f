"""Structured Streaming: validation of what comes in, and order-sensitive operators for each key.

Filters, projections, updates, masks and validation are the same Columns on a stream as on a table. A global order isn't
there on a stream; the stateful operators here work in each key's order of arrival.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.validate import safe_parse, whole_row
from ..operators.sequence import count_of
from ..plans.schema import Schema


def validated(stream: DataFrame, schema: Schema, mode: str = "quarantine") -> DataFrame:
    """valid, issues and data for each row; in ``failfast`` mode the first bad row ends the query."""
    if mode != "failfast":
        return safe_parse(stream, schema)
    m = whole_row(stream, schema)
    ok = F.when(m.valid, True).otherwise(F.raise_error(F.concat(F.lit("VALIDATION_FAILED: "), F.to_json(m.issues))).cast("boolean"))
    return stream.select("*", ok.alias("valid"), m.issues.alias("issues"), m.data.alias("data"))


def unique(stream: DataFrame, key: str, event_time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """The first row of each key. With a watermark the state is bounded, and a key may come again after the delay."""
    if event_time:
        return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])
    return stream.dropDuplicates([key])


def scan_by_key(stream: DataFrame, key: str, order: str, field: str, initial: float, update: Callable[[float, Any], float]) -> DataFrame:
    """(key, order, value): a running fold for each key; within a micro-batch rows are taken in ``order``."""
    kinds = dict(stream.dtypes)

    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values(order)
        value, out = state.get[0] if state.exists else initial, []
        for x in rows[field]:
            value = update(value, x)
            out.append(value)
        state.update((value,))
        yield pd.DataFrame({key: [k[0]] * len(rows), order: rows[order].to_numpy(), "value": out})

    return stream.groupBy(key).applyInPandasWithState(run, f"{key} {kinds[key]}, {order} {kinds[order]}, value double", "value double", "append", GroupStateTimeout.NoTimeout)


def pairwise_by_key(stream: DataFrame, key: str, order: str, field: str) -> DataFrame:
    """(key, order, prev, cur) of the field's values that follow each other in a key."""
    kinds = dict(stream.dtypes)

    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values(order)
        before = [state.get[0]] if state.exists else []
        values = before + rows[field].tolist()
        state.update((values[-1],))
        orders = rows[order].to_numpy()[len(rows) - (len(values) - 1) :]
        yield pd.DataFrame({key: [k[0]] * (len(values) - 1), order: orders, "prev": values[:-1], "cur": values[1:]})

    ddl = f"{key} {kinds[key]}, {order} {kinds[order]}, prev {kinds[field]}, cur {kinds[field]}"
    return stream.groupBy(key).applyInPandasWithState(run, ddl, f"prev {kinds[field]}", "append", GroupStateTimeout.NoTimeout)


def _groups(stream: DataFrame, key: str, order: str, field: str, n: int, step: int) -> DataFrame:
    kinds = dict(stream.dtypes)

    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values(order)
        held = list(state.get[0]) if state.exists else []
        at, out = [], []
        for place, x in zip(rows[order], rows[field].tolist(), strict=True):
            held.append(x)
            if len(held) == n:
                at.append(place)
                out.append(list(held))
                del held[:step]
        state.update((held,))
        yield pd.DataFrame({key: [k[0]] * len(out), order: at, "items": out})

    ddl = f"{key} {kinds[key]}, {order} {kinds[order]}, items array<{kinds[field]}>"
    return stream.groupBy(key).applyInPandasWithState(run, ddl, f"held array<{kinds[field]}>", "append", GroupStateTimeout.NoTimeout)


def chunk_by_key(stream: DataFrame, key: str, order: str, field: str, n: int) -> DataFrame:
    """(key, order of the last, items): every ``n`` values of a key; what is over waits in the state for more."""
    return _groups(stream, key, order, field, count_of(n, 1), n)


def window_by_key(stream: DataFrame, key: str, order: str, field: str, n: int) -> DataFrame:
    """(key, order of the last, items): every ``n`` values that follow each other in a key; the state has ``n - 1`` at most."""
    return _groups(stream, key, order, field, count_of(n, 1), 1)


def _each(stream: DataFrame, key: str, order: str, field: str, start: Any, state_type: str, step: Callable[[Any, Any], tuple[Any, bool]]) -> DataFrame:
    """(key, order, value): of each key's values in order those that ``step(state, value)`` lets through."""
    kinds = dict(stream.dtypes)

    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values(order)
        held, keep = state.get[0] if state.exists else start, []
        for x in rows[field].tolist():
            held, ok = step(held, x)
            keep.append(bool(ok))
        state.update((held,))
        kept = rows[keep]
        yield pd.DataFrame({key: [k[0]] * len(kept), order: kept[order].to_numpy(), "value": kept[field].to_numpy()})

    ddl = f"{key} {kinds[key]}, {order} {kinds[order]}, value {kinds[field]}"
    return stream.groupBy(key).applyInPandasWithState(run, ddl, f"held {state_type}", "append", GroupStateTimeout.NoTimeout)


def take_by_key(stream: DataFrame, key: str, order: str, field: str, n: int) -> DataFrame:
    """(key, order, value): each key's first ``n``; the state is their number."""
    count_of(n, 1)
    return _each(stream, key, order, field, 0, "long", lambda seen, _: (min(seen + 1, n + 1), seen < n))


def drop_by_key(stream: DataFrame, key: str, order: str, field: str, n: int) -> DataFrame:
    """(key, order, value): what follows each key's first ``n``."""
    count_of(n, 0)
    return _each(stream, key, order, field, 0, "long", lambda seen, _: (min(seen + 1, n), seen >= n))


def take_while_by_key(stream: DataFrame, key: str, order: str, field: str, holds: Callable[[Any], bool]) -> DataFrame:
    """(key, order, value): each key's values up to the first that doesn't hold."""

    def step(over: bool, x: Any) -> tuple[bool, bool]:
        over = over or not holds(x)
        return over, not over

    return _each(stream, key, order, field, False, "boolean", step)


def drop_while_by_key(stream: DataFrame, key: str, order: str, field: str, holds: Callable[[Any], bool]) -> DataFrame:
    """(key, order, value): each key's values from the first that doesn't hold."""

    def step(begun: bool, x: Any) -> tuple[bool, bool]:
        begun = begun or not holds(x)
        return begun, begun

    return _each(stream, key, order, field, False, "boolean", step)


def group_adjacent_by_key(stream: DataFrame, key: str, order: str, by: str, field: str) -> DataFrame:
    """(key, order of the last, items): each key's runs of equal ``by``; the last run waits for what ends it.

    NULL equals NULL; pandas doesn't tell NaN from NULL, so it does here as well.
    """
    kinds = dict(stream.dtypes)

    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values(order)
        last, begun, last_at, items = (*state.get[:3], list(state.get[3])) if state.exists else (None, False, None, [])
        at, out = [], []
        for place, x, value in zip(rows[order].tolist(), rows[by].astype(object).where(rows[by].notna(), None).tolist(), rows[field].tolist(), strict=True):
            if begun and x != last:
                at.append(last_at)
                out.append(items)
                items = []
            last, begun, last_at = x, True, place
            items.append(value)
        state.update((last, begun, last_at, items))
        yield pd.DataFrame({key: [k[0]] * len(out), order: pd.Series(at, dtype=rows[order].dtype), "items": out})

    ddl = f"{key} {kinds[key]}, {order} {kinds[order]}, items array<{kinds[field]}>"
    held = f"last {kinds[by]}, begun boolean, at {kinds[order]}, items array<{kinds[field]}>"
    return stream.groupBy(key).applyInPandasWithState(run, ddl, held, "append", GroupStateTimeout.NoTimeout)


def keyed(stream: DataFrame, key: str, order: str) -> DataFrame:
    """(key, position, the last row): kept up to date, the last row of each key, and where its first one stood."""
    return stream.groupBy(key).agg(F.min(order).alias("position"), F.max_by(F.struct(*stream.columns), F.col(order)).alias("value"))


def aggregated(stream: DataFrame, key: str, field: str) -> DataFrame:
    """sum, count, avg, min and max of each key, kept up to date."""
    return stream.groupBy(key).agg(F.coalesce(F.sum(field), F.lit(0)).alias("sum"), F.count(F.lit(1)).alias("count"), F.avg(field).alias("avg"), F.min(field).alias("min"), F.max(field).alias("max"))


def consume(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str):
    """Hands over micro-batches one at a time, so the source waits for the consumer."""
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
