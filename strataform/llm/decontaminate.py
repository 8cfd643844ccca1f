"""Operator 8, benchmark decontamination: BM25 over test items with block-max WAND, then question and answer overlap.

Index. The test items' terms (letters and digits, A-Z lower-cased) get BM25 weights, divided by what the item scores
against itself, so one threshold between 0 and 1 serves all items. Postings are in item order, in blocks with their
greatest weight. Items are indexed in shards of ``SHARD_BYTES`` of text at most, one after the other; only a shard's
index is broadcast. Document frequencies and lengths are counted over all items, whatever the shards.

Query. A document is cut into passages that overlap by half and are at least twice as long as the longest item, so that
an item lies whole in one. Every passage is a query. Its rare terms' block maxima are added up for each block of items in
one vectorised pass over the batch; with what the block's items can get from frequent terms at most, that bounds any
item's score. Passages with a block over the threshold are searched by block-max WAND, which gives every item that
scores the threshold or more.

Verification. What is retrieved counts as a leak if ``OVERLAP`` or more of the five-word shingles of the item's question
and of its answer are in the passage, or of the whole item: a word changed in a short answer takes most of the answer's
shingles with it, and the item is still there. A question alone is none. The answer is the last third of an item's words
(or ``split`` says).

Documents aren't shuffled. Memory is bounded by an Arrow batch, what is made of ``PART_BYTES`` of its texts,
and a shard's index.

Defined results: a null or empty text or item matches nothing; an item of fewer than five words in question or answer is
compared as one shingle of that length; items with equal texts are reported each for itself, rows that repeat an item's id and text once; null ids
are kept; no items or no documents give an empty result; other columns are ignored (``clean`` keeps them).
"""

from __future__ import annotations

import math
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import repeat
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .shared import fresh, in_parts, ship, table, thrifty, values, written

K1, B = 1.2, 0.75
THRESHOLD = 0.6
OVERLAP = 0.8
SHINGLE = 5
LEAST_PASSAGE = 128
BLOCK_ITEMS = 8
SHARD_BYTES = 32 << 20

#: A-Z lower-cased; ASCII that is no letter or digit separates words; other bytes belong to words.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


def last_third(words: list[bytes]) -> int:
    """Where the answer begins."""
    return len(words) - -(-len(words) // 3)


def grams(words: list[bytes], n: int) -> set[tuple[bytes, ...]]:
    return set(zip(*(words[k:] for k in range(n)), strict=False)) if n else set()


def overlap(part: list[bytes], passage: list[bytes]) -> float:
    n = min(SHINGLE, len(part))
    own = grams(part, n)
    return len(own & grams(passage, n)) / len(own) if own else 1.0


class Postings:
    """Lists of (item, weight) by term, in flat arrays: a list is the places from ``ends[t]`` to ``ends[t + 1]``."""

    def __init__(self, ends: np.ndarray, items: np.ndarray, weights: np.ndarray) -> None:
        self.ends = ends.tolist()
        self.items, self.weights = array("i", items.astype("i4").tobytes()), array("d", weights.astype("f8").tobytes())

    def __len__(self) -> int:
        return len(self.ends) - 1

    def __getitem__(self, t: int) -> list[tuple[int, float]]:
        if not 0 <= t < len(self):
            raise IndexError(t)
        part = slice(self.ends[t], self.ends[t + 1])
        return list(zip(self.items[part], self.weights[part], strict=True))


class Index:
    """BM25 postings of a shard's items, with weights relative to each item's own score: flat arrays, and the items' texts."""

    def __init__(self, items: Iterable[tuple[object, list[bytes]]], df: dict[bytes, int], n: int, mean: float, split: Callable[[list[bytes]], int], threshold: float) -> None:
        self.threshold = threshold
        self.ids, self.texts, self.splits, self.term = [], [], [], {}
        terms, places, weights = array("q"), array("q"), array("d")
        for i, words in items:
            if not words:
                continue
            own = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c * (K1 + 1) / (c + K1 * (1 - B + B * len(words) / mean)) for t, c in Counter(words).items()}
            whole = sum(own.values())
            terms.extend(self.term.setdefault(t, len(self.term)) for t in own)
            places.extend([len(self.ids)] * len(own))
            weights.extend(x / whole for x in own.values())
            self.ids.append(i)
            self.texts.append(b" ".join(words))
            self.splits.append(split(words))
        of, place, weight = np.frombuffer(terms, np.int64), np.frombuffer(places, np.int64), np.frombuffer(weights, np.float64)
        order = np.argsort(of, kind="stable")  # items come in order
        ends = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(self.term)))])
        items, weight = place[order].astype(np.int32), weight[order]
        self.postings = Postings(ends, items, weight)
        self.most = np.maximum.reduceat(weight, ends[:-1]).tolist() if len(self.term) else []
        #: Each term's blocks of items, with their greatest weights.
        blocks = -(-len(self.ids) // BLOCK_ITEMS)
        cell = of[order] * max(blocks, 1) + items // BLOCK_ITEMS
        first = np.flatnonzero(np.diff(cell, prepend=-1))
        block_ends = np.concatenate([[0], np.cumsum(np.bincount(of[order][first], minlength=len(self.term)))])
        self.blocks = Postings(block_ends, cell[first] % max(blocks, 1), np.maximum.reduceat(weight, first) if len(first) else np.empty(0))
        #: The most frequent terms are left out of the first pass as long as no item gets more than half the threshold from them.
        rest, self.frequent = np.zeros(len(self.ids)), np.zeros(len(self.term), bool)
        for t in np.argsort(-np.diff(ends), kind="stable").tolist():
            at = slice(ends[t], ends[t + 1])
            more = rest.copy()
            more[items[at]] += weight[at]
            if ends[t + 1] - ends[t] < 2 or more.max() > threshold / 2:
                break
            rest, self.frequent[t] = more, True
        self.rest = np.maximum.reduceat(rest, np.arange(0, len(rest), BLOCK_ITEMS)) if len(rest) else rest
        self.sizes = np.where(self.frequent, 0, np.diff(block_ends))
        self.begins = block_ends[:-1]

    def search(self, terms: list[int]) -> list[tuple[int, float]]:
        """Block-max WAND: all items that score the threshold or more for these distinct terms."""
        low = self.threshold - 1e-9
        items, weights, ends = self.postings.items, self.postings.weights, self.postings.ends
        blocks, tops, block_ends = self.blocks.items, self.blocks.weights, self.blocks.ends
        #: The item at hand, its place, the list's end, its greatest weight, its blocks' place and end.
        lists = [[items[ends[t]], ends[t], ends[t + 1], self.most[t], block_ends[t], block_ends[t + 1]] for t in terms]
        found, at_hand = [], itemgetter(0)
        while lists:
            lists.sort(key=at_hand)
            bound, pivot = 0.0, None
            for k, x in enumerate(lists):
                bound += x[3]
                if bound >= low:
                    pivot = k
                    break
            if pivot is None:
                break
            item = lists[pivot][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0] == item:
                pivot += 1
            block, bound = item // BLOCK_ITEMS, 0.0
            for x in lists[: pivot + 1]:
                x[4] = k = bisect_left(blocks, block, x[4], x[5])
                if k < x[5] and blocks[k] == block:
                    bound += tops[k]
            if bound < low:
                #: No item up to the next block, or to the next list's item, can reach the threshold.
                to = (block + 1) * BLOCK_ITEMS
                if pivot + 1 < len(lists):
                    to = min(to, lists[pivot + 1][0])
                to = max(to, item + 1)
                moving = lists[: pivot + 1]
            elif lists[0][0] == item:
                score = sum(weights[x[1]] for x in lists[: pivot + 1])
                if score >= low:
                    found.append((item, score))
                to, moving = item + 1, lists[: pivot + 1]
            else:
                to, moving = item, [x for x in lists[:pivot] if x[0] < item]
            ended = False
            for x in moving:
                x[1] = k = bisect_left(items, to, x[1], x[2])
                if k < x[2]:
                    x[0] = items[k]
                else:
                    ended = True
            if ended:
                lists = [x for x in lists if x[1] < x[2]]
        return found

    def passages(self, ids: list[np.ndarray], stride: int) -> list[tuple[int, int]]:
        """(text, passage) whose bound reaches the threshold for some block. ids: each text's terms by place, -1 for none."""
        texts, windows, terms = [], [], []
        for k, x in enumerate(ids):
            at = np.flatnonzero(x >= 0)
            at = at[~self.frequent[x[at]]]
            if not len(at):
                continue
            half, last = at // stride, max(-(-len(x) // stride) - 2, 0)
            for w in (half, half - 1):
                ok = (w >= 0) & (w <= last)
                texts.append(np.full(int(ok.sum()), k, np.int64))
                windows.append(w[ok])
                terms.append(x[at][ok].astype(np.int64))
        if not texts:
            return []
        text, window, term = np.concatenate(texts), np.concatenate(windows), np.concatenate(terms)
        span, blocks = int(window.max()) + 1, len(self.rest)
        key = np.unique((text * span + window) * len(self.term) + term)
        passage, term = key // len(self.term), key % len(self.term)
        n = self.sizes[term]
        place = np.repeat(self.begins[term] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        cell = np.repeat(passage, n) * blocks + np.frombuffer(self.blocks.items, np.int32)[place]
        order = np.argsort(cell, kind="stable")
        cell, most = cell[order], np.frombuffer(self.blocks.weights)[place][order]
        first = np.flatnonzero(np.diff(cell, prepend=-1))
        bound = np.add.reduceat(most, first) + self.rest[cell[first] % blocks]
        hit = np.unique(cell[first][bound >= self.threshold - 1e-9] // blocks)
        return [(int(p) // span, int(p) % span) for p in hit]

    def leaks(self, texts: list[bytes | None], stride: int) -> Iterator[tuple[int, object, float, float, float]]:
        """(text, item id, score, question overlap, answer overlap), the best passage for each pair."""
        words = [words_of(x) for x in texts]
        ids = [np.fromiter(map(self.term.get, w, repeat(-1)), np.int32, len(w)) for w in words]
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        for k, w in self.passages(ids, stride):
            at = slice(w * stride, (w + 2) * stride)
            terms = np.unique(ids[k][at])
            for item, score in self.search(terms[terms >= 0].tolist()):
                own, cut = self.texts[item].split(b" "), self.splits[item]
                q, a = overlap(own[:cut], words[k][at]), overlap(own[cut:], words[k][at])
                if min(q, a) >= OVERLAP or overlap(own, words[k][at]) >= OVERLAP:
                    best[k, item] = max(best.get((k, item), (0.0, 0.0, 0.0)), (score, q, a))
        for (k, item), x in sorted(best.items()):
            yield k, self.ids[item], *x


def shards(benchmark: DataFrame, most: int) -> Iterator[list[tuple[object, bytes]]]:
    """The items, in parts of about ``most`` bytes of text (or one item)."""
    total = benchmark.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    n = -(-total * 2 // most) if total > most else 1
    for k in range(n):
        part = benchmark.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k) if n > 1 else benchmark
        yield [(r["id"], bytes(r["text"])) for r in part.collect()]


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, split: Callable[[list[bytes]], int] = last_third, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(id, item_id, bm25, question_overlap, answer_overlap) for each document and leaked item. Both inputs: id and text, in that order."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.toDF("id", "text").withColumn("text", F.col("text").cast("string").cast("binary"))
    kind, item_kind = docs.dtypes[0][1], benchmark.dtypes[0][1]
    item_type = to_arrow_type(benchmark.schema[0].dataType)
    ddl = f"id {kind}, item_id {item_kind}, bm25 double, question_overlap double, answer_overlap double"
    items = benchmark.toDF("id", "text").withColumn("text", F.col("text").cast("string").cast("binary")).where("text is not null").distinct()

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [words_of(x) for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([list(set(w)) for w in lists], pa.list_(pa.binary())), pa.array([len(w) for w in lists], pa.int64())], ["terms", "n"])

    counted = items.select("text").mapInArrow(thrifty(terms), "terms array<binary>, n long").where("n > 0")
    n, mean, longest = counted.agg(F.count(F.lit(1)), F.avg("n"), F.max("n")).first()
    out = spark.createDataFrame([], ddl)
    if not n:
        return out
    stride = max(LEAST_PASSAGE // 2, int(longest))
    frequency = counted.select(F.explode("terms").alias("term")).groupBy("term").count()
    for part in shards(items, shard_bytes):
        wanted = spark.createDataFrame([(bytearray(t),) for t in {t for _, x in part for t in words_of(x)}], "term binary")
        df = {bytes(r["term"]): r["count"] for r in frequency.join(wanted, "term", "left_semi").collect()}
        sent = spark.sparkContext.broadcast(Index(((i, words_of(x)) for i, x in part), df, n, mean, split, threshold))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows, start = [], 0
                for part in in_parts(values(b.column(1))):
                    rows += [(start + k, *x) for k, *x in sent.value.leaks(part, stride)]
                    start += len(part)
                own = b.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
                yield pa.RecordBatch.from_arrays([own, pa.array([r[1] for r in rows], item_type), *(pa.array([r[k] for r in rows], pa.float64()) for k in (2, 3, 4))], ["id", "item_id", "bm25", "question_overlap", "answer_overlap"])

        out = out.unionByName(docs.mapInArrow(thrifty(run), ddl))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents without a leaked item, with all columns. Rows are told apart by place, so ids may be null or repeat."""
    row = fresh(docs, "sf_row")[0]
    store = written(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    found = written(leaks(store.select(row, text_col), benchmark, threshold).select(F.col("id").alias(row)).distinct(), "leaks")
    return store.join(found, row, "left_anti").select(*docs.columns)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and leaked item: doc_id, item_id, bm25, question_overlap, answer_overlap."""
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text")
    return leaks(docs, items).withColumnRenamed("id", "doc_id")
