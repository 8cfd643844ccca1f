"""Eager operators on whole collections: grouping, keys, aggregates, mutation."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import two_valued
from ..plans.ordinal import Ordered


def first_by(o: Ordered, key: str) -> Ordered:
    """``unique``: the first row of each key. NaN equals NaN; an aggregate combines before the shuffle, so a hot key is no window."""
    o.need()
    return o.put(o.df.groupBy(F.col(key).alias("_k")).agg(F.min_by(F.struct(*o.df.columns), F.struct(*o.ord)).alias("_r")).select("_r.*"))


def keyed(o: Ordered, key: str) -> Ordered:
    """The last row of each key, in the place of the key's first."""
    o.need()
    both = o.df.groupBy(F.col(key).alias("_k")).agg(F.max_by(F.struct(*o.fields), F.struct(*o.ord)).alias("_r"), F.min(F.struct(*o.ord)).alias("_p"))
    #: The key itself, where grouping leaves it as it is, so that what is joined by it next is neither shuffled nor sorted again.
    own = F.col("_k") if dict(o.df.dtypes)[key] in ("tinyint", "smallint", "int", "bigint", "date", "boolean") else F.col(f"_r.{key}")
    fields = [own.alias(c) if c == key else F.col(f"_r.{c}").alias(c) for c in o.fields]
    return Ordered(both.select(*fields, *[F.col(f"_p.{c}").alias(c) for c in o.ord]), o.depth)


def index(o: Ordered, key: str) -> DataFrame:
    """(key, value): the last row of each key, for look-ups by join."""
    return keyed(o, key).df.select(F.col(key).alias("key"), F.struct(*o.fields).alias("value"))


def looked_up(df: DataFrame, of: DataFrame, column: str, to: str = "found") -> DataFrame:
    """``df`` with what an ``index`` has for its column; NULL where it has nothing. NULL finds NULL."""
    return df.join(of.select(F.col("key").alias("_k"), F.col("value").alias(to)), F.col(column).eqNullSafe(F.col("_k")), "left").drop("_k")


def grouped(o: Ordered, key: str, item: Column | None = None) -> DataFrame:
    """(key, items): each group's rows in order. A group is one value of the result, so it lies whole in one row."""
    o.need()
    rows = F.array_sort(F.collect_list(F.struct(*o.ord, (o.item() if item is None else item).alias("_i"))))
    return o.df.groupBy(key).agg(F.transform(rows, lambda x: x["_i"]).alias("items"))


def normalized(o: Ordered, key: str) -> tuple[DataFrame, DataFrame]:
    """(by_id: the last row of each key; ids: the keys in order, repeats included)."""
    return keyed(o, key).frame, o.df.select(*o.ord, key).orderBy(*o.ord).select(key)


def aggregate(df: DataFrame, op: str, field: str | None = None) -> DataFrame:
    """One of sum (0 when empty), count (0), avg, min, max (NULL when empty); NaN doesn't take part in min and max."""
    if op == "count":
        return df.agg(F.count(F.lit(1)).alias("count"))
    c = F.col(field)
    if dict(df.dtypes)[field] in ("double", "float") and op in ("min", "max"):
        c = F.when(~F.isnan(c), c)
    made = {"sum": F.coalesce(F.sum(c), F.lit(0)), "avg": F.avg(c), "min": F.min(c), "max": F.max(c)}[op]
    return df.agg(made.alias(op))


def order_by(o: Ordered, key: str, direction: str = "asc") -> Ordered:
    """A stable sort. A descending key is kept by its row number, as not every type has a negative."""
    if direction == "asc":
        return Ordered(o.df.select(*o.fields, F.col(key).alias("_o0"), *[F.col(c).alias(f"_o{k + 1}") for k, c in enumerate(o.ord)]), o.depth + 1)
    kind = dict(o.df.dtypes)[key]
    if kind in ("double", "float"):
        flipped = -F.col(key)
    elif kind in ("tinyint", "smallint", "int", "bigint") or kind.startswith("decimal"):
        flipped = -F.col(key).cast("decimal(38,0)" if not kind.startswith("decimal") else kind)
    elif kind in ("timestamp", "timestamp_ntz", "date"):
        flipped = -F.unix_micros(F.col(key).cast("timestamp"))
    elif kind == "boolean":
        flipped = ~F.col(key)
    else:
        #: Code points turned round, with an end that is greater than all: longer strings come before their prefixes.
        flipped = F.concat(F.transform(F.split(F.col(key).cast("string"), ""), lambda x: -F.ascii(x)), F.array(F.lit(1)))
    last = F.col(key).isNull()  # as Spark's descending order has it
    return Ordered(o.df.select(*o.fields, last.alias("_o0"), flipped.alias("_o1"), *[F.col(c).alias(f"_o{k + 2}") for k, c in enumerate(o.ord)]), o.depth + 2)


def delete(df: DataFrame, condition: Column) -> DataFrame:
    return df.where(~two_valued(condition))


def update(df: DataFrame, condition: Column, patch: dict[str, Any]) -> DataFrame:
    return df.select(*[F.when(two_valued(condition), F.lit(patch[c]).cast(t)).otherwise(F.col(c)).alias(c) if c in patch else F.col(c) for c, t in df.dtypes])
