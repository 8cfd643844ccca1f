"""Operator 9, token counts: a separator scan over flat token files that have no index.

Writing. Each task encodes its documents and writes their ids, an end-of-document id after each, as flat little-endian
integers to files of its own (a new one after ``FILE_TOKENS``). The end-of-document id is the one after the vocabulary's
last, and the integers are as wide as that id needs; a separator that the vocabulary has, or a width that is too small, is
refused. A table keeps which document is the how-manieth of which
file; only files of tasks that ended well are in it.

Counting. The files are cut into blocks of ``BLOCK_TOKENS`` ids, whatever documents they hold. A task searches its block
for separators with one vectorised comparison, and gives what stands before the first, between any two, and after the
last. A prefix scan over the blocks of a file adds up the separators before a block, for the documents' numbers, and what
stands after the last separator of the blocks before, for the document that goes across the border. A document may span
any number of blocks. Memory is bounded by a block.

Defined results: the separator isn't counted; a null or empty text has 0 tokens; ids after the last separator of a file
are one more document; a file without ids has no documents; a null doc_id is kept; repeated rows give repeated results;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe
from .shared import drop, scratch, ship, shuffle_width, table, thrifty, tidied, values, written

FILE_TOKENS = 64 << 20
BLOCK_TOKENS = 4 << 20


def layout(ranks: bytes) -> tuple[int, int]:
    """The separator (the first id after the vocabulary's last) and the bytes of an integer, for a ranks file."""
    separator = max(map(int, ranks.split()[1::2]), default=-1) + 1
    return separator, next(w for w in (1, 2, 4, 8) if separator < 1 << (8 * w))


def write_tokens(docs: DataFrame, folder: str, path: str, pattern: str, separator: int | None = None, width: int | None = None, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Writes the token files; gives (file, ordinal, id), written. ``docs``: id and text, in that order."""
    spark = docs.sparkSession
    ship(spark)
    vocabulary = bpe.vocabulary(path)
    free, least = layout(vocabulary)
    separator = free if separator is None else separator
    width = width or max(least, next(w for w in (1, 2, 4, 8) if separator < 1 << (8 * w)))
    if separator < free or separator >= 1 << (8 * width):
        raise ValueError(f"separator {separator} in {width} bytes: the vocabulary's ids go up to {free - 1}")
    ranks = spark.sparkContext.broadcast(vocabulary)
    kind = docs.dtypes[0][1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = bpe.codec(ranks.value, pattern)
        where, name = fs.FileSystem.from_uri(folder)
        where.create_dir(name, recursive=True)
        out, file, size, n = None, "", 0, 0
        end = np.array([separator], f"<u{width}").tobytes()
        for b in batches:
            files, ordinals = [], []
            for text in values(b.column(1)):
                if out is None or size >= file_tokens:
                    if out is not None:
                        out.close()
                    file, size, n = f"{uuid.uuid4().hex}.tokens", 0, 0
                    out = where.open_output_stream(f"{name}/{file}", compression=None)
                ids = own.encode(text or "")
                out.write(ids.astype(f"<u{width}").tobytes() + end)
                files.append(f"{folder}/{file}")
                ordinals.append(n)
                n, size = n + 1, size + len(ids) + 1
            yield pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(ordinals, pa.int64()), b.column(0)], ["file", "ordinal", "id"])
        if out is not None:
            out.close()

    return written(docs.mapInArrow(thrifty(run), f"file string, ordinal long, id {kind}"), "ordinals")


def block_counts(ids: np.ndarray, separator: int) -> tuple[list[int], int]:
    """Counts up to each separator, the first from the block's start; and what stands after the last."""
    at = np.flatnonzero(ids == separator)
    if not len(at):
        return [], len(ids)
    return (np.diff(at, prepend=-1) - 1).tolist(), len(ids) - int(at[-1]) - 1


def count_tokens(files: DataFrame, separator: int | None = None, width: int | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, ordinal, n_tokens) of every document in the flat files that ``files`` names in its first column.

    Where no separator or width is given, those of the default vocabulary's files.
    """
    spark = files.sparkSession
    if separator is None or width is None:
        own = layout(bpe.vocabulary(bpe.default_files()[0]))
        separator, width = own[0] if separator is None else separator, width or own[1]
    ship(spark)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                where, name = fs.FileSystem.from_uri(path)
                n = where.get_file_info(name).size // width
                k = np.arange(-(-n // block_tokens))
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(k), pa.string()), pa.array(k, pa.int64())], ["file", "block"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                where, name = fs.FileSystem.from_uri(path)
                with where.open_input_file(name) as f:
                    f.seek(k * block_tokens * width)
                    raw = f.read(block_tokens * width)
                counts, tail = block_counts(np.frombuffer(raw, f"<u{width}", len(raw) // width), separator)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([k]), pa.array([counts], pa.list_(pa.int64())), pa.array([tail])], ["file", "block", "counts", "tail"])

    n = shuffle_width(spark)
    named = files.repartition(n, files.columns[0]).mapInArrow(thrifty(blocks), "file string, block long")
    seen = named.repartition(n, "file", "block").mapInArrow(thrifty(scan), "file string, block long, counts array<long>, tail long")
    by_file = Window.partitionBy("file").orderBy("block")
    before = by_file.rowsBetween(Window.unboundedPreceding, -1)
    summary = seen.withColumn("base", F.coalesce(F.sum(F.size("counts").cast("long")).over(before), F.lit(0)))
    #: Blocks since the last one with a separator, that one included, share a run; their tails add up.
    summary = summary.withColumn("run", F.sum((F.size("counts") > 0).cast("long")).over(by_file))
    summary = summary.withColumn("open", F.sum("tail").over(Window.partitionBy("file", "run").orderBy("block")))
    summary = summary.withColumn("carry", F.coalesce(F.lag("open").over(by_file), F.lit(0))).withColumn("last", F.lead("block").over(by_file).isNull())
    ended = summary.select("file", "base", "carry", F.posexplode("counts").alias("k", "n")).select(
        "file", (F.col("base") + F.col("k")).alias("ordinal"), (F.col("n") + F.when(F.col("k") == 0, F.col("carry")).otherwise(0)).alias("n_tokens")
    )
    rest = summary.where("last and open > 0").select("file", (F.col("base") + F.size("counts")).alias("ordinal"), F.col("open").alias("n_tokens"))
    return ended.unionByName(rest)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: doc_id, n_tokens."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("string").alias("text"))
    at = scratch(spark, "op9")
    path, pattern = bpe.default_files()
    with tidied(spark):
        folder = scratch(spark, "tokens")
        ordinals = write_tokens(docs, folder, path, pattern)
        counts = written(count_tokens(ordinals.select("file").distinct(), *layout(bpe.vocabulary(path))), "counts")
        drop(spark, folder)
        return written(ordinals.join(counts, ["file", "ordinal"]).select(F.col("id").alias("doc_id"), "n_tokens"), "op9", at)
