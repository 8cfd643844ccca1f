"""Operator 7, byte-level BPE: encoding and decoding as reductions over a tree.

Every text is cut into leaves, each of them one library call. The tokens of a node come from its two halves: only a window
at the joint is encoded anew. Two things have to stand on both sides of the window.

Matches of the pattern. A match depends on the text from its own start on alone (the pattern has no look-behind), and on
at most ``AHEAD`` characters beyond its end. So all matches of the left half that end ``AHEAD`` before its own end are final, and
the window begins at the first that isn't. It grows to the right, match by match, until one begins where the right half's
own matching has one begin: from there on both go the same way, and the right half's tokens hold.

Tokens in a match. Merges are by rank, so tokens are the encoding of their bytes exactly if every two neighbours are the
encoding of the two's bytes: a merge across a border would have to happen among the two on their own as well. A long match
across the joint is therefore put together from the tokens of its parts: the last few of one and the first few of the other
are encoded anew, more of them on the side whose outer pair doesn't hold yet, until both do.

Joining is associative, so any bracketing gives the same tokens. Decoding joins the tokens' bytes up the same kind of tree.

Each row is worked on whole, within one Arrow batch, so memory is bounded by the batch and the longest text. The
vocabulary file is read on the driver and broadcast: a fixed file of under 2 MB.

Defined results: a null text counts as empty and has no tokens; texts of any length are encoded whole; a null doc_id is
kept; repeated rows give repeated results; an empty table gives an empty result; other columns are ignored
(``encode_documents`` returns them all).
"""

from __future__ import annotations

import base64
import hashlib
import string
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fresh, ship, table, thrifty, values

LEAF = 512
LETTERS = frozenset(string.ascii_letters)
#: The longest contraction has three characters; the longest look-ahead is one.
AHEAD = 3
#: Matches of up to so many characters are encoded anew where a joint changes them, longer ones joined by tokens.
SHORT = 64
VOCABULARY_MOST = 16 << 20


def vocabulary(path: str) -> bytes:
    """A ranks file; read by the driver."""
    with open(path, "rb") as f:
        data = f.read(VOCABULARY_MOST + 1)
    if len(data) > VOCABULARY_MOST:
        raise ValueError(f"{path} has more than {VOCABULARY_MOST} bytes")
    return data


@lru_cache(maxsize=2)
def codec(ranks: bytes, pattern: str) -> Codec:
    return Codec(ranks, pattern)


class Node:
    """Tokens of text[start:end], and a place ``known`` at which a match begins, no later than the first that may change."""

    __slots__ = ("start", "end", "known", "ids")

    def __init__(self, start: int, end: int, known: int, ids: list[int]) -> None:
        self.start, self.end, self.known, self.ids = start, end, known, ids


class Codec:
    def __init__(self, ranks: bytes, pattern: str) -> None:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.bytes_of = {i: b for b, i in table.items()}
        self.size_of = {i: len(b) for b, i in table.items()}
        #: In the default pattern, no match holds an ASCII letter with a space behind it.
        self.spaced = pattern == default_files()[1]
        #: Whether two tokens stand beside each other; at most so many pairs are remembered.
        self.fits = lru_cache(maxsize=100_000)(lambda x, y: self.piece(self.bytes_of[x] + self.bytes_of[y]) == [x, y])

    def begins(self, text: str, start: int, end: int) -> Iterator[int]:
        """Where the matches of text[start:end] begin; ``start`` must be where one does."""
        return (m.start() for m in self.pattern.finditer(text, start, end))

    # Tokens in one match

    def piece(self, data: bytes) -> list[int]:
        return self.library._core_bpe.encode_single_piece(data)

    def spliced(self, x: list[int], y: list[int]) -> list[int]:
        """The tokens of a match from those of its two parts, each encoded as a match of its own."""
        if not x or not y:
            return x or y
        i = j = 1
        while True:
            made = self.piece(b"".join(map(self.bytes_of.__getitem__, x[len(x) - i :] + y[:j])))
            left = i == len(x) or self.fits(x[len(x) - i - 1], made[0])
            right = j == len(y) or self.fits(made[-1], y[j])
            if left and right:
                return x[: len(x) - i] + made + y[j:]
            i, j = i if left else min(2 * i, len(x)), j if right else min(2 * j, len(y))

    def count(self, ids: Iterable[int], size: int) -> tuple[int, int]:
        """How many of the first tokens lie within ``size`` bytes, and how many bytes are left."""
        n, size_of = 0, self.size_of
        for t in ids:
            if size_of[t] > size:
                break
            size -= size_of[t]
            n += 1
        return n, size

    def part(self, ids: list[int], skip: int, size: int) -> list[int]:
        """The tokens of a part of a match: ``size`` bytes after the first ``skip``; ``ids``: those of the whole match."""
        n, cut = self.count(ids, skip)
        head: list[int] = []
        if cut and size:
            data = self.bytes_of[ids[n]][cut : cut + size]
            head, n, size = self.piece(data), n + 1, size - len(data)
        m, left = self.count(ids[n:], size)
        tail = self.piece(self.bytes_of[ids[n + m]][:left]) if left else []
        return self.spliced(self.spliced(head, ids[n : n + m]), tail)

    def own(self, text: str, start: int, end: int, ids: list[int], x: int, y: int) -> list[int]:
        """The tokens of text[x:y] as (part of) one match, from ``ids``: those of text[start:end] with its own matches."""
        out: list[int] = []
        size = lambda a, b: len(text[a:b].encode())
        at, ends = 0, self.begins(text, start, end)
        p = next(ends)
        while p < min(y, end):
            q = next(ends, end)
            n = len(ids) - at if q == end else self.count(islice(ids, at, None), size(p, q))[0]
            if q > x:
                seen = ids[at : at + n]
                out = self.spliced(out, seen if p >= x and q <= y else self.part(seen, size(p, max(x, p)), size(max(x, p), min(y, q))))
            p, at = q, at + n
        return out

    # The tree

    def leaf(self, text: str, start: int, end: int) -> Node:
        return Node(start, end, self.word_end(text, start, end), self.library.encode_ordinary(text[start:end]))

    def word_end(self, text: str, start: int, end: int) -> int:
        """Near the end, a place at which a match begins whatever stands around it; ``start`` if none is seen."""
        at = max(end - AHEAD, 0)
        while self.spaced and (at := text.rfind(" ", start + 1, at)) > 0:
            if text[at - 1] in LETTERS:
                return at
        return start

    def loose(self, text: str, node: Node) -> int:
        """Where the first match begins that ends within AHEAD of the node's end."""
        at = node.end
        for match in reversed(self.pattern.findall(text, node.known, node.end)):  # matches leave nothing out
            at -= len(match)
            if at <= node.end - AHEAD:
                break
        return at

    def join(self, text: str, a: Node, b: Node) -> Node:
        loose = self.loose(text, a)
        ours, theirs = self.begins(text, loose, b.end), self.begins(text, b.start, b.end)
        edges, k, other = [], next(ours), next(theirs)
        while k is not None and k != other:
            if other is not None and other < k:
                other = next(theirs, None)
            else:
                edges.append(k)
                k = next(ours, None)
        same = b.end if k is None else k
        n = len(a.ids) if loose == a.start else self.count(reversed(a.ids), len(text[loose : a.end].encode()))[0]
        made, head = a.ids[: len(a.ids) - n], a.ids[len(a.ids) - n :]
        for x, y in zip(edges, [*edges[1:], same], strict=True):
            if y - x <= SHORT:
                made += self.piece(text[x:y].encode())
            else:
                left = self.own(text, loose, a.end, head, x, y) if x < a.end else []
                right = self.own(text, b.start, b.end, b.ids, x, y) if y > b.start else []
                made += self.spliced(left, right)
        if same < b.end:
            made += b.ids[self.count(b.ids, len(text[b.start : same].encode()))[0] :]
        known = b.known if same <= b.known <= b.end - AHEAD else same if same <= b.end - AHEAD else loose
        return Node(a.start, b.end, known, made)

    def tree(self, text: str, start: int, end: int, leaf: int) -> Node:
        if end - start <= leaf:
            return self.leaf(text, start, end)
        middle = (start + end) // 2
        return self.join(text, self.tree(text, start, middle, leaf), self.tree(text, middle, end, leaf))

    def encode(self, text: str, leaf: int = LEAF) -> np.ndarray:
        return np.array(self.tree(text, 0, len(text), leaf).ids if text else [], np.uint32)

    def decode(self, ids: np.ndarray, leaf: int = LEAF) -> bytes:
        if len(ids) <= leaf:
            return self.library.decode_bytes(ids.tolist())
        middle = len(ids) // 2
        return self.decode(ids[:middle], leaf) + self.decode(ids[middle:], leaf)


def encoded(ranks, pattern: str, digests: bool):
    """Batches of (..., text last) to (..., n_tokens, and either both digests or the ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks.value, pattern)
        for b in batches:
            n, first, second = [], [], []
            for text in values(b.column(b.num_columns - 1)):
                ids = own.encode(text or "")
                n.append(len(ids))
                raw = ids.astype("<u4").tobytes()
                if digests:
                    first.append(hashlib.sha256(raw).hexdigest())
                    second.append(hashlib.sha256(own.decode(ids)).hexdigest())
                else:
                    first.append(raw)
            rest = [b.column(k) for k in range(b.num_columns - 1)]
            made = [pa.array(n, pa.int64()), pa.array(first, pa.string() if digests else pa.binary())] + ([pa.array(second, pa.string())] if digests else [])
            yield pa.RecordBatch.from_arrays([*rest, *made], [f"c{k}" for k in range(len(rest) + len(made))])

    return run


def default_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def encode_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: id, n_tokens, ids_sha256, decoded_sha256."""
    spark = docs.sparkSession
    ship(spark)
    ranks = spark.sparkContext.broadcast(vocabulary(path))
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(thrifty(encoded(ranks, pattern, True)), f"c0 {kind}, c1 long, c2 string, c3 string").toDF("id", "n_tokens", "ids_sha256", "decoded_sha256")


def encode_documents(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, and n_tokens and token_ids (little-endian unsigned 32-bit integers)."""
    spark = docs.sparkSession
    ship(spark)
    ranks = spark.sparkContext.broadcast(vocabulary(path))
    n = len(docs.columns)
    rows = docs.select(*docs.columns, docs[text_col].cast("string").alias(fresh(docs, "sf_text")[0]))
    kinds = [f"c{k} {t}" for k, (_, t) in enumerate(docs.dtypes)] + [f"c{n} long", f"c{n + 1} binary"]
    return rows.mapInArrow(thrifty(encoded(ranks, pattern, False)), ", ".join(kinds)).toDF(*docs.columns, *fresh(docs, "n_tokens", "token_ids"))


def decode_documents(encoded_docs: DataFrame, path: str, pattern: str, ids_col: str = "token_ids", to: str = "decoded") -> DataFrame:
    """``encoded_docs`` with the bytes that the ids stand for."""
    spark = encoded_docs.sparkSession
    ship(spark)
    ranks = spark.sparkContext.broadcast(vocabulary(path))
    name = fresh(encoded_docs, to)[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks.value, pattern)
        for b in batches:
            made = [own.decode(np.frombuffer(x or b"", "<u4")) for x in values(b.column(b.num_columns - 1))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(made, pa.binary())], [f"c{k}" for k in range(b.num_columns)])

    n = len(encoded_docs.columns)
    kinds = [f"c{k} {t}" for k, (_, t) in enumerate(encoded_docs.dtypes)] + [f"c{n} binary"]
    return encoded_docs.select(*encoded_docs.columns, F.col(ids_col).alias(name)).mapInArrow(thrifty(run), ", ".join(kinds)).toDF(*encoded_docs.columns, name)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return encode_digests(table(spark, sf_dir, "documents").select("doc_id", "text"), *default_files()).withColumnRenamed("id", "doc_id")
