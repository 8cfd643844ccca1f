"""Operator 1, exact deduplication: keyed streaming state on disk, full bytes checked on hits. DataFrame functions only.

Every row is stored once with a locator (``row``), its length and the SHA-256 of its normalised text. A streaming
query with a RocksDB state store folds the arrivals into one state row for each digest: the stable identifier and the
locator of the row that stays, and how many rows have come. The state has no expiry and lies, checkpointed, in the
shared folder; later arrivals fold into the same state (``arrive``).

A digest that has come more than once is a hit. Only the texts of hits are read again and held against each other: the
least and the greatest text of a group must be the same. Where they aren't (the digest collided), that group is dealt out
anew by its whole texts. Hits of up to ``SENT`` digests are sent to the rows; beyond that both sides are shuffled.

A digest with more than one in ``HOT_SHARE`` rows is hot. There are fewer than ``HOT_SHARE`` of those, so they are sent to
the rows at every size, and never meet in one task: their texts are combined on the map side, a row from each task. The
other groups are shuffled by digest.

Defined results: a null text counts as empty and all empty texts are one group; a null doc_id is larger than any other;
of rows that tie in length and doc_id, the one stored first stays, so exactly one row of each group is kept even when
rows repeat; texts of any length are hashed and compared whole; an empty table gives an empty result; other columns are
carried along untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import SENT, fresh, hot_from, join_hot, scratch, table, tidied, written

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def normalised(text: Column) -> Column:
    """The text without any character of ``[\\x20\\x09-\\x0D]``; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def fold(spark: SparkSession, store: str, names: dict[str, str], id_type: str, state: str) -> DataFrame:
    """Streams the rows of ``store`` that the state in ``state`` hasn't seen into it; gives the state: digest, best, n.

    best: (minus length, id is null, id, row) of the row that stays. Can be called again when rows have been added.
    """
    session = spark.newSession()
    for key, value in {
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
        "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
        "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "192",
        #: There are many stores, most of them small: no disk is set aside for their logs in advance.
        "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
        "spark.sql.shuffle.partitions": spark.conf.get("spark.sql.shuffle.partitions"),
    }.items():
        session.conf.set(key, value)
    row, size, digest, doc = names["row"], names["size"], names["digest"], names["id"]
    arrivals = session.readStream.schema(session.read.parquet(store).schema).option("maxBytesPerTrigger", str(256 << 30)).parquet(store)
    seen = arrivals.groupBy(F.col(digest).alias("digest")).agg(
        F.min(F.struct((-F.col(size)).alias("size"), F.col(doc).isNull().alias("none"), F.col(doc).alias("id"), F.col(row).alias("row"))).alias("best"),
        F.count(F.lit(1)).alias("n"),
    )
    query = seen.writeStream.format("noop").outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    held = spark.read.format("statestore").load(state)
    key, value = (held.schema[part].dataType.names for part in ("key", "value"))
    return held.select(F.col("key")[key[0]].alias("digest"), F.col("value")[value[0]].alias("best"), F.col("value")[value[1]].alias("n"))


def spans_of(texts: DataFrame) -> DataFrame:
    """digest, and the least and the greatest text (``norm``) that has it."""
    return texts.groupBy("digest").agg(F.min("norm").alias("least"), F.max("norm").alias("most"))


def arrive(docs: DataFrame, home: str, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256) -> tuple[DataFrame, DataFrame, dict[str, str]]:
    """Takes ``docs`` into the store and the state kept in ``home``, beside what came before with the same columns.

    Gives the stored rows; for each row stored so far its group: row, id, keep_id, group_size, kept, digest; and the names
    of the columns that were added to the store. ``digest`` is there for tests of collisions.
    """
    spark = docs.sparkSession
    added = dict(zip(("row", "size", "digest"), fresh(docs, "sf_row", "sf_size", "sf_digest"), strict=True)) | {"id": id_col}
    row, size, dig = added["row"], added["size"], added["digest"]
    norm = normalised(F.col(text_col))
    rows, state = f"{home}/rows", f"{home}/state"
    folder = spark._jvm.org.apache.hadoop.fs.Path(rows)
    begun = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
    first = spark.read.parquet(rows).agg(F.coalesce(F.max(row), F.lit(-1))).first()[0] + 1 if begun else 0
    stored = docs.withColumn(row, F.monotonically_increasing_id() + first).withColumn(size, F.coalesce(F.length(text_col), F.lit(0))).withColumn(dig, digest(norm))
    stored.write.mode("append").parquet(rows)
    store = spark.read.schema(stored.schema).parquet(rows)
    held = written(fold(spark, rows, added, dict(docs.dtypes)[id_col], state), "held")

    total, several = held.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("n") > 1, 1))).first()
    hot = F.broadcast(held.where(F.col("n") > hot_from(total)).select("digest"))
    small = store.select(F.col(row).alias("row"), F.col(id_col).alias("id"), F.col(size).alias("size"), F.col(dig).alias("digest"))
    of_group = ["row", "id", F.col("best.id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("row") == F.col("best.row")).alias("kept"), "digest"]
    dealt = join_hot(small, held, "digest", "n", total).select(*of_group)

    texts = store.select(F.col(dig).alias("digest"), F.col(text_col).alias("text"))
    hits = held.where((F.col("n") > 1) & (F.col("n") <= hot_from(total))).select("digest")
    hits = F.broadcast(hits) if several <= SENT else hits.hint("merge")
    found = [spans_of(texts.join(some, "digest", "left_semi").select("digest", normalised(F.col("text")).alias("norm"))) for some in (hot, hits)]
    collided = written(found[0].unionByName(found[1]).where("least <> most").select("digest"), "collided")
    if not collided.isEmpty():
        again = store.join(collided, F.col(dig) == F.col("digest"), "left_semi").select(
            F.col(row).alias("row"), F.col(id_col).alias("id"), F.col(size).alias("size"), F.col(dig).alias("digest"), norm.alias("norm")
        )
        best = again.groupBy("digest", "norm").agg(F.min(F.struct((-F.col("size")).alias("size"), F.col("id").isNull().alias("none"), "id", "row")).alias("best"), F.count(F.lit(1)).alias("n"))
        redone = again.join(best, ["digest", "norm"]).select(*of_group)
        dealt = dealt.join(collided, "digest", "left_anti").select(redone.columns).unionByName(redone)
    return store, dealt, added


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256) -> tuple[DataFrame, DataFrame, dict[str, str], list[str]]:
    """``arrive`` into a state of its own; also the scratch folders."""
    home = scratch(docs.sparkSession, "exact")
    return *arrive(docs, home, id_col, text_col, digest), [home]


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all columns of ``docs``."""
    store, dealt, added, _ = groups(docs, id_col, text_col)
    kept = written(dealt.where("kept").select(F.col("row").alias(added["row"])), "kept")
    #: Most rows stay, so this side grows with the table: a merge join at every size, never a broadcast.
    return store.join(kept.hint("merge"), added["row"], "left_semi").select(*docs.columns)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: doc_id, keep_id, group_size, kept, text_sha256."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    at = scratch(spark, "op1")
    with tidied(spark):
        dealt = groups(docs)[1]
        return written(dealt.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")), "op1", at)


OP1_SQL = r"""
with t as (select doc_id, length(coalesce(text,'')) n, sha256(regexp_replace(coalesce(text,''), '[\x20\x09-\x0D]', '', 'g')) h from documents),
r as (select *, row_number() over (partition by h order by n desc, doc_id) k,
  first_value(doc_id) over (partition by h order by n desc, doc_id) keep_id, count(*) over (partition by h) c from t)
select doc_id, keep_id, cast(c as bigint) group_size, k = 1 as kept, h as text_sha256 from r
"""
