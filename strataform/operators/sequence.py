"""Order-sensitive operators. None puts the whole collection into one partition; only ``fold`` runs in order, by nature."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..functions.predicates import two_valued
from ..plans.errors import invalid_query
from ..plans.ordinal import BLOCK, Ordered, blocked, checkpointed, numbered


def count_of(n: int, least: int) -> int:
    if not isinstance(n, int) or isinstance(n, bool) or n < least:
        raise invalid_query(f"{n!r} is no whole number of {least} or more")
    return n


def take(o: Ordered, n: int) -> Ordered:
    o.need()
    return o.put(o.df.orderBy(*o.ord).limit(count_of(n, 1)))


def drop(o: Ordered, n: int) -> Ordered:
    """All rows behind the n-th, whose ordinal is found by a top-n; the rest is a filter."""
    o.need()
    if not count_of(n, 0):
        return o
    last = o.df.select(F.struct(*o.ord).alias("_x")).orderBy("_x").limit(n).agg(F.max("_x").alias("_last"))
    return o.put(o.df.join(F.broadcast(last), F.struct(*o.ord) > F.col("_last")).drop("_last"))


def _stop(o: Ordered, holds: Column):
    o.need()
    return F.broadcast(o.df.where(~two_valued(holds)).agg(F.min(F.struct(*o.ord)).alias("_stop")))


def take_while(o: Ordered, holds: Column) -> Ordered:
    kept = F.col("_stop").isNull() | (F.struct(*o.ord) < F.col("_stop"))
    return o.put(o.df.join(_stop(o, holds)).where(kept).drop("_stop"))


def drop_while(o: Ordered, holds: Column) -> Ordered:
    return o.put(o.df.join(_stop(o, holds)).where(F.struct(*o.ord) >= F.col("_stop")).drop("_stop"))


def chunk(o: Ordered, n: int) -> Ordered:
    """(items): n rows each, the last may have fewer."""
    count_of(n, 1)
    rows = F.array_sort(F.collect_list(F.struct("_n", o.item().alias("_i"))))
    made = numbered(o).groupBy(F.floor(F.col("_n") / n).cast("long").alias("_o0")).agg(F.transform(rows, lambda x: x["_i"]).alias("items"))
    return Ordered(made.select("items", "_o0"), 1)


def window(o: Ordered, n: int, block: int = BLOCK) -> Ordered:
    """(items): every n rows that follow each other."""
    count_of(n, 1)
    df, w = blocked(o, ahead=n - 1, block=block)
    made = df.withColumn("items", F.collect_list(o.item()).over(w.rowsBetween(0, n - 1))).where(F.col("_own") & (F.size("items") == n))
    return Ordered(made.select("items", F.col("_n").alias("_o0")), 1)


def pairwise(o: Ordered, block: int = BLOCK) -> Ordered:
    """(prev, cur)."""
    df, w = blocked(o, behind=1, block=block)
    made = df.withColumn("prev", F.lag(o.item()).over(w)).where(F.col("_own") & F.col("prev").isNotNull())
    return Ordered(made.select("prev", o.item().alias("cur"), F.col("_n").alias("_o0")), 1)


def pairwise_by_key(o: Ordered, key: str) -> Ordered:
    """(prev, cur) within each key."""
    o.need()
    w = Window.partitionBy(key).orderBy(*o.ord)
    made = o.df.withColumn("prev", F.lag(o.item()).over(w)).where("prev is not null")
    return o.put(made.select("prev", o.item().alias("cur"), *o.ord))


FOLDS = {"sum": (F.sum, F.sum), "min": (F.min, F.min), "max": (F.max, F.max), "count": (F.count, F.sum)}


def scan(o: Ordered, fold: str, field: str, initial: Any = None, block: int = BLOCK, carry: tuple[str, ...] = ()) -> Ordered:
    """(value): the running sum, min, max or count, after each row; with it the fields in ``carry``.

    Blocks are folded, their results run up, and rows within them, all in the type that Spark's own fold of the field has.
    """
    if fold not in FOLDS:
        raise invalid_query(f"no fold {fold!r}; use fold_in_order for others")
    one, more = FOLDS[fold]
    df, w = blocked(o, block=block)
    df = df.withColumn("_v", F.col(field))
    blocks = df.groupBy("_b").agg(one("_v").alias("_whole"))
    before = blocks.select("_b", more("_whole").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    run = one("_v").over(w.rowsBetween(Window.unboundedPreceding, 0))
    kind = before.schema["_before"].dataType
    parts = F.array_compact(F.array(*[c.cast(kind) for c in (F.lit(initial), F.col("_before"), F.col("_run"))]))
    added = F.aggregate(parts, F.lit(0).cast(kind), lambda a, x: (a + x).cast(kind)) if fold in ("sum", "count") else None
    joined = {"sum": added, "count": added, "min": F.array_min(parts), "max": F.array_max(parts)}[fold]
    made = df.withColumn("_run", run).join(before, "_b", "left").select(*carry, joined.alias("value"), F.col("_n").alias("_o0"))
    return Ordered(made, 1)


def fold_in_order(o: Ordered, initial: Any, update: Callable[[Any, dict], Any], kind: str) -> Ordered:
    """(value): any running fold. It needs each row's predecessor, so all rows go through one task in order.

    They are sorted in parallel and written in the shared folder before, so that this task only reads part after part.
    """
    o.need()
    fields = o.fields

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, n, at = initial, 0, 0
        for part in parts:
            if len(part) and (part["_p"].iloc[0] < at or not part["_p"].is_monotonic_increasing):
                raise RuntimeError("sorted parts came out of their order")
            at = part["_p"].iloc[-1] if len(part) else at
            values = []
            for row in part[fields].to_dict("records"):
                state = update(state, row)
                values.append(state)
            yield pd.DataFrame({"value": values, "_o0": range(n, n + len(values))})
            n += len(values)

    rows = checkpointed(o.df.orderBy(*o.ord).select(*fields, F.spark_partition_id().alias("_p")))
    return Ordered(rows.coalesce(1).mapInPandas(run, f"value {kind}, _o0 long"), 1)


def group_adjacent(o: Ordered, key: str, block: int = BLOCK) -> Ordered:
    """(items): runs of rows with the same key. NULL equals NULL; NaN never equals NaN."""
    df, w = blocked(o, behind=1, block=block)
    k = F.col(key)
    same = F.lag(F.struct(k.alias("k"))).over(w)
    begins = same.isNull() | ~same["k"].eqNullSafe(k)
    if dict(o.df.dtypes)[key] in ("double", "float"):
        begins = begins | two_valued(F.isnan(k))
    df = df.withColumn("_new", begins.cast("long")).where("_own")
    blocks = df.groupBy("_b").agg(F.sum("_new").alias("_news"))
    before = blocks.select("_b", F.coalesce(F.sum("_news").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    run = F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = F.array_sort(F.collect_list(F.struct("_n", o.item().alias("_i"))))
    made = df.withColumn("_run", run).join(before, "_b").groupBy((F.col("_before") + F.col("_run")).alias("_o0")).agg(F.transform(rows, lambda x: x["_i"]).alias("items"))
    return Ordered(made.select("items", "_o0"), 1)


def flat_map(o: Ordered, field: str) -> Ordered:
    """(value): the elements of an array field, in order; rows without one give nothing."""
    made = o.df.select(*o.ord, F.posexplode(field).alias("_pos", "value"))
    return Ordered(made.select("value", *o.ord, F.col("_pos").alias(f"_o{o.depth}")), o.depth + 1)
