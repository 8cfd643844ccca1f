"""Collections with an explicit order.

A DataFrame has no order, so an order-sensitive operator works on ``Ordered``: a DataFrame with hidden ordinal columns
``_o0, _o1, ...``. Rows are numbered without a single-partition window and without writing them: a bounded sample of the
ordinals gives the bounds of the parts, the parts' sizes are counted over the ordinals alone and summed up (a row for each
part), and the rows are shuffled once, by part, in which a window numbers them. Bounds are constants of the plan, so each
use of it, and a lost executor's tasks, see the same parts.
"""

from __future__ import annotations

import tempfile
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .errors import invalid_query

#: Ordinals that are looked at for each part, to find its bounds.
SAMPLE_EACH = 50
#: Rows in a block of the order; blocks are what windows are partitioned by.
BLOCK = 1_000_000


@dataclass(frozen=True)
class Ordered:
    df: DataFrame
    depth: int

    @property
    def ord(self) -> list[str]:
        return [f"_o{k}" for k in range(self.depth)]

    @property
    def fields(self) -> list[str]:
        return [c for c in self.df.columns if c not in self.ord]

    @property
    def frame(self) -> DataFrame:
        """Without the ordinal."""
        return self.df.select(*self.fields)

    def need(self) -> None:
        if not self.depth:
            raise invalid_query("this operator needs an ordinal")

    def item(self) -> Column:
        return F.struct(*self.fields)

    def put(self, df: DataFrame) -> Ordered:
        return Ordered(df, self.depth)


def ordered(df: DataFrame, *by: str) -> Ordered:
    """``df`` in the order of ``by``, which should tell all rows apart."""
    return Ordered(df.select(*df.columns, *[F.col(c).alias(f"_o{k}") for k, c in enumerate(by)]), len(by))


def reordered(df: DataFrame, *by: Column) -> Ordered:
    fields = [c for c in df.columns if not c.startswith("_o")]
    return Ordered(df.select(*fields, *[c.alias(f"_o{k}") for k, c in enumerate(by)]), len(by))


def checkpointed(df: DataFrame) -> DataFrame:
    """In the folder that the cluster names in spark.checkpoint.dir; a temporary one only where that is unset, on one machine."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        at = df.sparkSession.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not at and not sc.master.startswith("local"):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all machines of {sc.master} share")
        sc.setCheckpointDir(at or "file://" + tempfile.mkdtemp(prefix="strataform-"))
    return df.checkpoint()


def numbered(o: Ordered, to: str = "_n") -> DataFrame:
    """``o.df`` with the row's number, from 0, as a long."""
    o.need()
    part = part_of(o)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = o.df.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size")).withColumn("_base", F.coalesce(F.sum("_size").over(before), F.lit(0)))
    #: One row for each part.
    out = o.df.withColumn("_part", part).join(F.broadcast(sizes.select("_part", "_base")), "_part")
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*o.ord))
    return out.withColumn(to, (F.col("_base") + place - 1).cast("long")).drop("_part", "_base")


def part_of(o: Ordered) -> Column:
    """The number of a row's part of the order; parts have about the same size."""
    spark = o.df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.struct(*o.ord)
    some = o.df.select(key.alias("k")).orderBy(F.xxhash64("k")).limit(SAMPLE_EACH * parts).orderBy("k")
    seen = [r["k"] for r in some.collect()]
    kinds = [o.df.schema[c].dataType for c in o.ord]
    at = [seen[k * len(seen) // parts] for k in range(1, parts)] if len(seen) >= parts else []
    bounds = [[F.lit(v).cast(t).alias(c) for v, t, c in zip(x, kinds, o.ord, strict=True)] for x in at]
    bounds = [F.struct(*x) if o.depth > 1 else x[0] for x in bounds]

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        before = key < bounds[middle] if o.depth > 1 else F.coalesce(F.col(o.ord[0]) < bounds[middle], F.lit(True))  # NULL comes first
        return F.when(before, search(low, middle)).otherwise(search(middle + 1, high))

    return search(0, len(bounds))


def blocked(o: Ordered, behind: int = 0, ahead: int = 0, block: int = BLOCK) -> tuple[DataFrame, object]:
    """Numbered rows dealt to blocks ``_b``, with ``behind`` rows before and ``ahead`` rows after each (``_own`` is false).

    Also the window over a block in order.
    """
    block = max(block, behind, ahead, 1)
    n, own = F.col("_n"), F.floor(F.col("_n") / block).cast("long")
    at = n - own * block
    copies = F.array_compact(F.array(own, F.when((at < ahead) & (own > 0), own - 1), F.when(at >= block - behind, own + 1) if behind else F.lit(None).cast("long")))
    df = numbered(o).select("*", own.alias("_home"), F.explode(copies).alias("_b")).withColumn("_own", F.col("_home") == F.col("_b")).drop("_home")
    return df, Window.partitionBy("_b").orderBy("_n")
