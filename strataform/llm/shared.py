"""What the operators share: the cluster's shared folder, written tables, row stores and small helpers.

The shared folder is the one that the cluster names in ``spark.checkpoint.dir``. Only where that is unset and the master
is local (tests, a laptop) a temporary folder takes its place; elsewhere that is an error.
"""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shipping import ship  # noqa: F401  (the operators take it from here)

#: In Python, texts are worked on in parts of so many bytes, whatever the size of an Arrow batch.
PART_BYTES = 4 << 20
#: A key with more than one in so many rows is hot, if it has more than ``HOT_LEAST``.
HOT_SHARE = 10_000
HOT_LEAST = 1000
#: So many short rows are sent to all tasks at most.
SENT = 200_000
_open: list[list[str]] = []


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors see."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all machines of {sc.master} share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="strataform-"))
    return sc.getCheckpointDir().rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses; see ``tidied``."""
    at = f"{shared_root(spark)}/strataform-{name}-{uuid.uuid4().hex}"
    if _open:
        _open[-1].append(at)
    return at


@contextlib.contextmanager
def tidied(spark: SparkSession) -> Iterator[None]:
    """Deletes, at the end, the scratch folders that were named inside; what outlives it is named before."""
    _open.append([])
    try:
        yield
    finally:
        drop(spark, *_open.pop())


def drop(spark: SparkSession, *paths: str) -> None:
    """Deletes scratch folders whose contents are no longer needed."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


def written(df: DataFrame, name: str, at: str | None = None) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    at = at or scratch(spark, name)
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names built from ``names`` that ``df`` doesn't have, so that extra columns never clash."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``; 0 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % F.lit(by), F.lit(0)).cast("int")


def hot_from(total: int) -> int:
    """Keys with more rows than this are hot; there are fewer than ``HOT_SHARE`` of them."""
    return max(total // HOT_SHARE, HOT_LEAST)


def join_hot(rows: DataFrame, keyed: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """``rows`` joined with ``keyed``, which has a row for each key and in ``n`` how many of the ``total`` rows have it.

    Hot keys' rows stay where they are, and what belongs to them is sent; the others are shuffled by key.
    """
    hot = F.broadcast(keyed.where(F.col(n) > hot_from(total)))
    rest = rows.join(hot.select(key), key, "left_anti").join(keyed.where(F.col(n) <= hot_from(total)), key)
    return rows.join(hot, key).unionByName(rest)


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def values(column: pa.Array) -> Iterator:
    """The column's values, made into Python's a few at a time."""
    for k in range(0, len(column), 128):
        yield from column.slice(k, 128).to_pylist()


def in_parts(texts: Iterable[bytes | None], most: int = PART_BYTES) -> Iterator[list[bytes | None]]:
    """The texts in order, in parts of ``most`` bytes at most (or one text)."""
    part, size = [], 0
    for text in texts:
        if part and size + len(text or b"") > most:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text or b"")
    if part:
        yield part


@lru_cache(maxsize=1)
def _libc() -> ctypes.CDLL:
    libc = ctypes.CDLL(None)
    libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD: larger blocks go back to the system when they are freed
    return libc


def thrifty(run: Callable) -> Callable:
    """For what runs in Python workers: memory that it no longer needs goes back to the system.

    Workers are used again by later tasks; without this, each keeps the memory of the largest it has had. (Where the C
    library isn't glibc, nothing is done.)
    """

    def held(batches: Iterator) -> Iterator:
        with contextlib.suppress(OSError, AttributeError):
            _libc()
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                _libc().malloc_trim(0)

    return held


def shuffle_width(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))
