r"""Operator 6, language-model scoring: Katz back-off of any order, Good-Turing discounts, exactly normalised weights.

The model. P1(w) = (c(w) + 1) / (N + V + 1), over the words seen in training and one class for all others. For k tokens h w,
P_k(w | h) = d_k(c) c / c(h) for the c = c(h, w) > 0 that training has, with Good-Turing's discount of level k for c up to
``KEEP``; else a(h) P_{k-1}(w | h without its first token), where a(h) = (1 - sum of the first kind) / (1 - sum of P_{k-1}
over the words seen after h), so that each context of each level sums to 1. A context whose counts all exceed ``KEEP`` gives
up half a count for each word instead; one that training doesn't have leaves it all to the level below. The end token closes
each text, and so many of them as a context needs stand before its first word. ``op6`` scores with ``ORDER`` levels.

How it is counted. Texts are cut into chunks of whole documents. A chunk's distinct words ask the slice of the vocabulary
that their hash names for their counts and numbers. Its distinct n-grams go to the slice of the table that the token before
the last names: all levels' counts of all n-grams with that token are there, so a slice works out its discounts' counts,
its contexts' sums and the whole recursion by itself. Each chunk asks once, however often it has an n-gram. Requests and
answers are packed arrays. The table of n-grams is written to the shared folder, a row for each slice, with which chunk
asked for which of them; the chunks' answers are made from it: two counts where training has the n-gram, a probability
where it hasn't.

A token with more than ``HOT`` occurrences would make its slice too large. The n-grams after such tokens are dealt out by
all of their tokens; the lower levels' counts, the contexts' sums and the recursion are then sums and joins of DataFrames,
combined before they are shuffled. Only sums over slices come to the driver: N, V, and for each level how many n-grams
occur once, twice, ...

Words are told apart by 64 bits of their hash: with a hundred million different words, the chance that any two share
theirs is about 3 in 10,000.

Defined results: a null or empty text is the end token alone; texts of any length are scored whole; a null doc_id is a
training row; repeated rows count and are scored each; without training tokens P1 is 1 for the class of other words; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from itertools import groupby, pairwise

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import IntegerType, StructField, StructType

from .shared import drop, remainder, scratch, ship, shuffle_width, table, thrifty, tidied, written

CHUNK_BYTES = 8 << 20
KEEP = 5
ORDER = 3
HOT = 2_000_000
SLICE_GRAMS = 1 << 20
#: Packed rows in an Arrow batch.
AT_ONCE = 64
#: No word holds a space.
END = b" "
CHUNK, COUNT, GRAM, MODEL, WORDS = range(5)


# Packed arrays


def pack(x: np.ndarray) -> bytes:
    """Whole numbers (0 or more) or doubles, byte plane by byte plane."""
    if x.dtype.kind == "f":
        width, raw = 8, x.astype("<f8").view(np.uint8)
    else:
        x = x.astype("<u8")
        width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
        raw = x.view(np.uint8)
    planes = np.ascontiguousarray(raw.reshape(-1, 8)[:, :width].T)
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(b: bytes, kind: str = "<u8") -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b[1:]), np.uint8).reshape(b[0], -1)
    out = raw[0].astype("<u8")
    for k in range(1, b[0]):
        out |= raw[k].astype("<u8") << np.uint64(8 * k)
    return out.view(kind)


def figures(x: list) -> bytes:
    """A few whole numbers that SQL can read."""
    return ",".join(str(int(k)) for k in x).encode()


def mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53) >> np.uint64(11)


DDL = "kind int, m long, p int, a binary, b binary, c binary"
SCHEMA = pa.schema([("kind", pa.int32()), ("m", pa.int64()), ("p", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])


def packed_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), SCHEMA.types, strict=True)], schema=SCHEMA)


def by_key(batches: Iterator[pa.RecordBatch], place: int) -> Iterator[tuple[int, list[tuple]]]:
    """The rows of each key, which come sorted by it."""
    rows = (tuple(c[k].as_py() for c in b.columns) for b in batches for k in range(b.num_rows))
    return ((k, list(g)) for k, g in groupby(rows, key=lambda r: r[place]))


def dealt(df: DataFrame, key: str, n: int, run: Callable, ddl: str) -> DataFrame:
    other = "p" if key == "m" else "m"
    return df.repartition(n, key).sortWithinPartitions(key, "kind", other).mapInArrow(thrifty(run), ddl)


# A chunk of documents


def numbered(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct words, the end token first; the number of each text's words in them, its end last; texts' lengths in tokens."""
    lowered = [x.lower() for x in texts]  # of bytes: A-Z alone
    raw = np.frombuffer(b" ".join([*lowered, b""]), np.uint8)
    inside = (raw != 32) & ((raw < 9) | (raw > 13))
    turns = np.flatnonzero(np.diff(inside, prepend=False))
    starts, stops = turns[::2], turns[1::2]
    #: Without what separates them, the words are an Arrow array as they lie.
    offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(stops - starts)])
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside])]).dictionary_encode()
    after = np.searchsorted(starts, np.cumsum([len(x) + 1 for x in lowered]))
    ids = np.insert(words.indices.to_numpy().astype(np.int64) + 1, after, 0)
    seen = words.dictionary
    _, bounds, data = seen.buffers()
    blob, bounds = (data.to_pybytes(), np.frombuffer(bounds, np.int64, len(seen) + 1).tolist()) if len(seen) else (b"", [])
    return [END, *(blob[i:j] for i, j in pairwise(bounds))], ids, np.diff(after, prepend=0) + 1


def read_chunk(texts: list[bytes], trained: list[bool], slices: int) -> tuple[list[tuple], tuple]:
    """The requests (slice, hashes, training counts, all counts), and the chunk (places, lengths, training flags).

    Words are numbered by slice, then by hash, so that answers laid end to end fit the numbers.
    """
    seen, ids, lengths = numbered(texts)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(map(digest, seen), np.uint64, len(seen))
    of = (hashes % np.uint64(slices)).astype(np.int64)
    order = np.lexsort((hashes, of))
    number = np.empty(len(seen), np.int64)
    number[order] = np.arange(len(seen))
    ids = number[ids]
    flags = np.array(trained, bool)
    every, known = np.bincount(ids, minlength=len(seen)), np.bincount(ids[np.repeat(flags, lengths)], minlength=len(seen))
    hashes, of = hashes[order], of[order]
    bounds = np.searchsorted(of, np.arange(slices + 1))
    requests = [(p, hashes[i:j], known[i:j], every[i:j]) for p, i, j in zip(range(slices), bounds[:-1], bounds[1:], strict=True) if i < j]
    return requests, (ids, lengths, flags)


def tokenised(slices: int, id_kind: str):
    """(id, trained, text) to chunks and word requests; a chunk's row has its ids as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, seq = TaskContext.get().partitionId() << 32, 0
        ids, trained, texts, size = [], [], [], 0

        def flush() -> pa.RecordBatch:
            m = base + seq
            requests, chunk = read_chunk(texts, trained, slices)
            rows = [(CHUNK, m, 0, *map(pack, chunk))] + [(WORDS, m, p, *map(pack, x)) for p, *x in requests]
            own = pa.concat_arrays(ids)
            offsets = pa.array([0, len(own)] + [len(own)] * (len(rows) - 1), pa.int32())
            plain = packed_rows(rows)
            return pa.RecordBatch.from_arrays([*plain.columns, pa.ListArray.from_arrays(offsets, own)], [*SCHEMA.names, "ids"])

        for b in batches:
            start = 0
            for k in range(b.num_rows):
                texts.append(b.column(2)[k].as_py() or b"")
                trained.append(b.column(1)[k].as_py())
                size += len(texts[-1])
                if size >= CHUNK_BYTES:
                    ids.append(b.column(0).slice(start, k + 1 - start))
                    yield flush()
                    ids, trained, texts, size, start, seq = [], [], [], 0, k + 1, seq + 1
            if start < b.num_rows:
                ids.append(b.column(0).slice(start))
        if texts:
            yield flush()

    return run


# The vocabulary


def word_counts(most: int):
    """Word requests to answers (training count, rank in the slice, whether it is hot) and the slice's table (hashes, counts, sums)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, rows in by_key(batches, 2):
            hashes = [unpack(r[3]) for r in rows]
            own, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
            known, every = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
            np.add.at(known, inverse, np.concatenate([unpack(r[4]) for r in rows]).astype(np.int64))
            np.add.at(every, inverse, np.concatenate([unpack(r[5]) for r in rows]).astype(np.int64))
            rank = np.empty(len(own), np.int64)
            rank[np.argsort(-every, kind="stable")] = np.arange(len(own))
            hot, start = every > most, 0
            for r, h in zip(rows, hashes, strict=True):
                at = inverse[start : start + len(h)]
                start += len(h)
                yield packed_rows([(COUNT, r[1], p, pack(known[at]), pack(rank[at]), pack(hot[at].astype(np.int64)))])
            yield packed_rows([(MODEL, 0, p, pack(own[known > 0]), pack(known[known > 0]), figures([known.sum(), (known > 0).sum(), every[~hot].sum(), every[hot].sum()]))])

    return run


# N-grams


def scattered(columns: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(len(columns[0]), np.uint64)
    for x in columns:
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + x.astype(np.uint64))
    return out


class Chunk:
    """A chunk with the answers about its words: its distinct n-grams, in the order in which they are asked for.

    ``grams``: numbers of the context's tokens, from the last to the first, and of the word.
    """

    def __init__(self, rows: list[tuple], slices: int, order: int, cold: int, hot: int) -> None:
        chunk = next(r for r in rows if r[0] == CHUNK)
        self.ids, self.lengths, self.flags = unpack(chunk[3]).astype(np.int64), unpack(chunk[4]).astype(np.int64), unpack(chunk[5]).astype(bool)
        answers = [r for r in rows if r[0] == COUNT]
        self.known = np.concatenate([unpack(r[3]) for r in answers]).astype(np.int64)
        #: A word's number: small for frequent words.
        number = np.concatenate([unpack(r[4]).astype(np.int64) * slices + r[2] for r in answers])
        is_hot = np.concatenate([unpack(r[5]) for r in answers]).astype(bool)
        self.ends = np.cumsum(self.lengths)
        n, end = len(number), self.ids[-1]
        home = (mixed(number) % np.uint64(cold)).astype(np.int64)
        by_number, by_home = np.argsort(number), np.argsort(one_key([np.where(is_hot, cold, home), number]))
        place, spot = np.empty(n, np.int64), np.empty(n, np.int64)
        place[by_number] = spot[by_home] = np.arange(n)
        #: N-grams are numbered by the token before the last (cold ones first, by slice), the tokens before it, and the last.
        at = np.arange(len(self.ids)) - np.repeat(self.ends - self.lengths, self.lengths)
        before = lambda k: np.where(at >= k, np.roll(self.ids, k), end)
        key, bits = spot[before(1)], n.bit_length()
        dense: list[np.ndarray] = []
        for column in [*(place[before(k)] for k in range(2, order)), place[self.ids]]:
            if int(key.max()).bit_length() + bits > 61:
                kinds, key = np.unique(key, return_inverse=True)
                dense.append(kinds)
            else:
                dense.append(None)
            key = key * n + column
        self.key = key
        both = key * 2 + np.repeat(self.flags, self.lengths)
        both.sort()
        first = np.flatnonzero(np.diff(both >> 1, prepend=-1))
        self.keys = both[first] >> 1
        self.times = np.add.reduceat(both & 1, first)
        del both, first, at
        rest, columns = self.keys, []
        for kinds in reversed(dense):
            rest, column = np.divmod(rest, n)
            columns.append(number[by_number[column]])
            if kinds is not None:
                rest = kinds[rest]
        columns.append(number[by_home[rest]])
        self.grams = [*columns[:0:-1], columns[0]]
        self.word = by_number[self.keys % n]
        self.slice = home[by_home[rest]]
        far = is_hot[by_home[rest]]
        if far.any():
            self.slice[far] = cold + (scattered([x[far] for x in self.grams]) % np.uint64(max(hot, 1))).astype(np.int64)
        self.order = np.argsort(self.slice, kind="stable")

    def places(self) -> np.ndarray:
        """Each token's place in ``keys``."""
        return grouped([self.key])[0]


def gram_requests(slices: int, order: int, cold: int, hot: int):
    """Chunks and word answers to requests: n-grams, training times, and training counts of the distinct last words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for m, rows in by_key(batches, 1):
            c = Chunk(rows, slices, order, cold, hot)
            of, rows = c.slice[c.order], []
            first = np.flatnonzero(np.diff(of, prepend=-1))
            for i, j in zip(first, [*first[1:], len(of)], strict=True):
                at = c.order[i:j]
                _, one = grouped([c.grams[-1][at]])
                rows.append((GRAM, m, int(of[i]), packed_grams([x[at] for x in c.grams]), pack(c.times[at]), pack(c.known[c.word[at[one]]])))
                if len(rows) == AT_ONCE or j == len(of):
                    yield packed_rows(rows)
                    rows = []

    return run


def packed_grams(columns: list[np.ndarray]) -> bytes:
    parts = [pack(np.diff(columns[0], prepend=0)) if (np.diff(columns[0]) >= 0).all() else b"\0" + pack(columns[0]), *map(pack, columns[1:])]
    return b"".join(len(x).to_bytes(4, "little") + x for x in parts)


def unpacked_grams(b: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(b):
        n = int.from_bytes(b[at : at + 4], "little")
        part = b[at + 4 : at + 4 + n]
        out.append(unpack(part[1:]).astype(np.int64) if part[0] == 0 else unpack(part).astype(np.int64) if out else np.cumsum(unpack(part).astype(np.int64)))
        at += 4 + n
    return out


def one_key(columns: list[np.ndarray]) -> np.ndarray:
    """A whole number for each row, in the columns' order; columns too wide for 63 bits go by their values' ranks."""
    width = lambda x: int(x.max(initial=0)).bit_length()
    ranks = lambda x: np.unique(x, return_inverse=True)[1]
    key, rest = columns[0], columns[1:]
    for k, x in enumerate(rest):
        if width(key) + sum(map(width, rest[k:])) > 63:
            key = ranks(key)
        if width(key) + width(x) > 63:
            x = ranks(x)
        key = (key << width(x)) | x
    return key


def grouped(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The number of each row's group of equal rows, in their order, and a row of each group."""
    key = one_key(columns)
    order = None if (key[1:] >= key[:-1]).all() else np.argsort(key)
    if order is not None:
        key = key[order]
    new = np.ones(len(key), bool)
    np.not_equal(key[1:], key[:-1], out=new[1:])
    of = np.cumsum(new) - 1
    if order is None:
        return of, np.flatnonzero(new)
    ids = np.empty(len(order), np.int64)
    ids[order] = of
    return ids, order[new]


def distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.diff(x, prepend=-1) != 0]


GRAMS_DDL = "q int, hot boolean, grams binary, counts binary, known binary, askers array<long>, places array<binary>, of string"
GRAMS = pa.schema([("q", pa.int32()), ("hot", pa.bool_()), ("grams", pa.binary()), ("counts", pa.binary()), ("known", pa.binary()), ("askers", pa.list_(pa.int64())), ("places", pa.list_(pa.binary())), ("of", pa.string())])


def occurring(count: np.ndarray) -> list[int]:
    return [int((count == r).sum()) for r in range(1, KEEP + 2)]


def gram_counts(order: int, cold: int):
    """Requests to the slice's row: its n-grams and their training counts, who asked for which, and counts of counts.

    The counts of counts are for levels 2 to ``order``; a hot slice has only the last level's.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for q, rows in by_key(batches, 2):
            parts = [unpacked_grams(r[3]) for r in rows]
            sizes = [len(x[0]) for x in parts]
            words = [distinct(x[-1]) for x in parts]
            columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
            del parts
            _, one = grouped([np.concatenate(words)])
            known = np.concatenate([unpack(r[5]) for r in rows])[one]
            ids, first = grouped(columns)
            count = np.bincount(ids, weights=np.concatenate([unpack(r[4]) for r in rows])).astype(np.int64)
            columns = [x[first] for x in columns]
            of = []
            for k in range(2, order + 1):
                if k == order:
                    of += occurring(count)
                elif q < cold:
                    own, _ = grouped([*columns[: k - 1], columns[-1]])
                    of += occurring(np.bincount(own, weights=count).astype(np.int64))
                else:
                    of += [0] * (KEEP + 1)
            places = [pack(np.diff(x, prepend=0)) for x in np.split(ids, np.cumsum(sizes)[:-1])]
            row = [[q], [q >= cold], [packed_grams(columns)], [pack(count)], [pack(known)], [[r[1] for r in rows]], [places], [",".join(map(str, of))]]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, GRAMS.types, strict=True)], schema=GRAMS)

    return run


# Discounts and weights


def discounts(of: list[int]) -> np.ndarray:
    """Good-Turing's discount of each count up to KEEP, 1 beyond; index 0 isn't used. of[r - 1]: pairs that occur r times.

    Where the counts of counts give no discount strictly between 0 and 1, half a count is given up.
    """
    out = np.ones(KEEP + 2)
    cut = (KEEP + 1) * of[KEEP] / of[0] if of[0] else 0.0
    for r in range(1, KEEP + 1):
        d = ((r + 1) * of[r] / (of[r - 1] * r) - cut) / (1 - cut) if of[r - 1] and cut < 1 else 0.0
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return out


def levels(columns: list[np.ndarray], count: np.ndarray, p: np.ndarray, discount: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The recursion over a slice: each n-gram's probability, its context's training count (0: not to be used) and count.

    ``p``: P1 of the last words. Level by level, ``p`` becomes the probability under a context of one token more.
    """
    for k in sorted(discount):
        own, first = grouped([*columns[: k - 1], columns[-1]])
        of, _ = grouped([x[first] for x in columns[: k - 1]])
        c = np.bincount(own, weights=count)
        whole = np.bincount(of, weights=c)
        low = p[first]
        kept, half = discount[k][np.minimum(c, KEEP + 1).astype(np.int64)] * c, np.maximum(c - 0.5, 0)
        seen = c > 0
        with np.errstate(divide="ignore", invalid="ignore"):
            left, halved = 1 - np.bincount(of, weights=kept) / whole, 1 - np.bincount(of, weights=half) / whole
            halves = ~(left > 1e-9)
            back = np.where(halves, halved, left) / (1 - np.bincount(of, weights=low * seen))
            made = np.where(seen, np.where(halves[of], half, kept) / whole[of], back[of] * low)
        p = np.where(whole[of] > 0, made, low)[own]
        usual = np.where(halves, 0, whole)[of][own].astype(np.int64)
    return p, usual, count


def cold_answers(discount: dict[int, np.ndarray], n: int, v: int):
    """Slices' rows to the chunks' answers: counts, contexts' counts, and log10 of the probability where either is 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                q, _, grams, counts, known, askers, places, _ = (c[k].as_py() for c in b.columns)
                columns, count = unpacked_grams(grams), unpack(counts).astype(np.int64)
                words, of = np.unique(columns[-1], return_inverse=True)
                p, whole, count = levels(columns, count, (unpack(known).astype(np.float64)[of] + 1) / (n + v + 1), discount)
                p, rows = np.log10(p), []
                for m, raw in zip(askers, places, strict=True):
                    at = np.cumsum(unpack(raw).astype(np.int64))
                    c, w = count[at], whole[at]
                    rows.append((GRAM, m, q, pack(c), pack(w), pack(p[at][(c == 0) | (w == 0)])))
                    if len(rows) == AT_ONCE:
                        yield packed_rows(rows)
                        rows = []
                if rows:
                    yield packed_rows(rows)

    return run


# Hot tokens


def hot_rows(order: int, n: int, v: int):
    """Hot slices' rows, unpacked: slice, place in it, tokens, count, P1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                columns, count = unpacked_grams(b.column(2)[k].as_py()), unpack(b.column(3)[k].as_py()).astype(np.int64)
                _, of = np.unique(columns[-1], return_inverse=True)
                p = (unpack(b.column(4)[k].as_py()).astype(np.float64)[of] + 1) / (n + v + 1)
                out = [np.full(len(p), b.column(0)[k].as_py(), np.int32), np.arange(len(p)), *columns, count, p]
                for i in range(0, len(p), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(x[i : i + (1 << 16)]) for x in out], ["q", "place", *[f"g{j}" for j in range(order - 1)], "w", "c", "p"])

    return run


def hot_grams(grams: DataFrame, order: int, n: int, v: int) -> DataFrame:
    ddl = ", ".join(["q int", "place long", *[f"g{j} long" for j in range(order - 1)], "w long", "c long", "p double"])
    return grams.where("hot").mapInArrow(thrifty(hot_rows(order, n, v)), ddl)


def hot_occurring(rows: DataFrame, order: int) -> list[int]:
    """Counts of counts of levels 2 to ``order - 1``."""
    out = []
    for k in range(2, order):
        counts = rows.groupBy(*[f"g{j}" for j in range(k - 1)], "w").agg(F.sum("c").alias("c"))
        out += list(counts.select(*[F.count(F.when(F.col("c") == r, 1)) for r in range(1, KEEP + 2)]).first())
    return out


def hot_levels(rows: DataFrame, discount: dict[int, np.ndarray]) -> DataFrame | None:
    """(q, place, p): the recursion over all n-grams after hot tokens, by sums and joins."""
    for k in sorted(discount):
        context = [f"g{j}" for j in range(k - 1)]
        last = k == max(discount)
        #: At the last level each row is an n-gram of its own.
        own = rows.withColumnsRenamed({"c": "n", "p": "low"}) if last else rows.groupBy(*context, "w").agg(F.sum("c").alias("n"), F.max("p").alias("low"))
        by_count = F.array(*[F.lit(float(d)) for d in discount[k]])
        kept = by_count[F.least("n", F.lit(KEEP + 1)).cast("int")] * F.col("n")
        half = F.greatest(F.col("n") - F.lit(0.5), F.lit(0.0))
        sums = own.groupBy(*context).agg(F.sum("n").alias("whole"), F.sum(kept).alias("s_kept"), F.sum(half).alias("s_half"), F.sum(F.when(F.col("n") > 0, F.col("low")).otherwise(0.0)).alias("under"))
        left = 1 - F.try_divide("s_kept", "whole")
        halves = ~(left > 1e-9)
        back = F.try_divide(F.when(halves, 1 - F.try_divide("s_half", "whole")).otherwise(left), 1 - F.col("under"))
        made = F.when(F.col("whole") == 0, F.col("low")).when(F.col("n") > 0, F.try_divide(F.when(halves, half).otherwise(kept), F.col("whole"))).otherwise(back * F.col("low"))
        found = own.join(sums, context)
        if last:
            return found.select("q", "place", made.alias("p"))
        rows = written(rows.drop("p").join(found.select(*context, "w", made.alias("p")), [*context, "w"]), "hot")


def hot_answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(q, place, p, askers, places), sorted by slice and place, the slice's own row first, to the chunks' answers."""
    q, own, p = None, None, []

    def answers() -> Iterator[pa.RecordBatch]:
        values = np.log10(np.concatenate([*p, np.empty(0)]))
        for m, raw in zip(*own, strict=True):
            at = np.cumsum(unpack(raw).astype(np.int64))
            zero = pack(np.zeros(len(at), np.int64))
            yield packed_rows([(GRAM, m, q, zero, zero, pack(values[at]))])

    for b in batches:
        slices, place = b.column(0).to_numpy(), b.column(1).to_numpy()
        edges = np.flatnonzero(np.diff(slices)) + 1
        for i, j in zip([0, *edges], [*edges, len(slices)], strict=True):
            if i == j:
                continue
            if place[i] < 0:
                if own is not None:
                    yield from answers()
                q, own, p = int(slices[i]), (b.column(3)[int(i)].as_py(), b.column(4)[int(i)].as_py()), []
                i += 1
            p.append(b.column(2).to_numpy(zero_copy_only=False)[i:j])
    if own is not None:
        yield from answers()


# Scores


def chunk_scores(slices: int, order: int, cold: int, hot: int, discount: np.ndarray, n: int, v: int, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_key(batches, 1):
            c = Chunk(rows, slices, order, cold, hot)
            answers = [r for r in rows if r[0] == GRAM]
            count, whole = (np.concatenate([unpack(r[k]) for r in answers]).astype(np.int64) for k in (3, 4))
            value = np.empty(len(count))
            counted = (count > 0) & (whole > 0)
            value[~counted] = np.concatenate([unpack(r[5], "<f8") for r in answers])
            value[counted] = np.log10(discount[np.minimum(count[counted], KEEP + 1)] * count[counted] / whole[counted])
            own = np.empty_like(value)
            own[c.order] = value
            token = own[c.places()]
            single = np.log10((c.known + 1) / (n + v + 1))
            begins = c.ends - c.lengths
            made = [np.add.reduceat(x, begins) for x in ((c.known[c.ids] > 0).astype(np.int64), single[c.ids], token)]
            ids = next(r[6] for r in rows if r[0] == CHUNK)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, id_type), pa.array(~c.flags), pa.array(c.lengths), pa.array(made[0]), pa.array(np.full(len(ids), n)), pa.array(made[1]), pa.array(made[2])],
                ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return run


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of what is no longer referred to."""
    gc.collect()
    spark._jvm.System.gc()


def scored(docs: DataFrame, order: int = 2) -> tuple[DataFrame, dict[str, str]]:
    """``docs``: id, trained, text. A row for each with its scores, and the folders of the model's tables."""
    if order < 2:
        raise ValueError("a back-off model has two levels at least")
    spark = docs.sparkSession
    ship(spark)
    docs = docs.toDF("id", "trained", "text").withColumn("text", F.col("text").cast("string").cast("binary"))
    kind = docs.dtypes[0][1]
    id_type = to_arrow_type(docs.schema["id"].dataType)
    at = {k: scratch(spark, k) for k in ("chunks", "words", "grams")}
    slices = shuffle_width(spark)
    keep = ["kind", "m", "p", "a", "b", "c"]
    plain = lambda df, k: df.where(F.col("kind") == k).select(keep)

    ddl = f"{DDL}, ids array<{kind}>"
    docs.mapInArrow(thrifty(tokenised(slices, kind)), ddl).write.partitionBy("kind").parquet(at["chunks"])
    schema = StructType([StructField("kind", IntegerType()), *StructType.fromDDL(f"{DDL}, ids array<{kind}>").fields[1:]])
    read = spark.read.schema(schema).parquet(at["chunks"])
    words = written(dealt(plain(read, WORDS), "p", slices, word_counts(HOT), DDL), "words", at["words"])
    whole = lambda c, k: F.coalesce(F.sum(F.split(F.col(c).cast("string"), ",")[k].cast("long")), F.lit(0))
    n, v, usual, often = plain(words, MODEL).select(*[whole("c", k) for k in range(4)]).first()
    release(spark)
    drop(spark, f"{at['chunks']}/kind={WORDS}")
    read = spark.read.schema(schema).parquet(at["chunks"])

    cold, hot = max(slices, -(-usual // SLICE_GRAMS)), -(-often // SLICE_GRAMS)
    none = F.lit(None).cast(f"array<{kind}>").alias("ids")
    chunks = read.where(F.col("kind") == CHUNK).select(*keep, "ids")
    asked = dealt(chunks.select(keep).unionByName(plain(words, COUNT)), "m", slices, gram_requests(slices, order, cold, hot), DDL)
    grams = written(dealt(asked, "p", cold + hot, gram_counts(order, cold), GRAMS_DDL), "grams", at["grams"])
    of = np.array(grams.select(*[whole("of", k) for k in range((order - 1) * (KEEP + 1))]).first(), np.int64)
    release(spark)

    answers = None
    if hot:
        rows = written(hot_grams(grams, order, n, v), "hot")
        of[: (order - 2) * (KEEP + 1)] += np.array(hot_occurring(rows, order), np.int64)
    discount = {k: discounts(x.tolist()) for k, x in enumerate(of.reshape(order - 1, KEEP + 1), 2)}
    answers = grams.where("not hot").mapInArrow(thrifty(cold_answers(discount, n, v)), DDL)
    if hot:
        made = hot_levels(rows, discount).select("q", "place", "p", F.lit(None).cast("array<long>").alias("askers"), F.lit(None).cast("array<binary>").alias("places"))
        owners = grams.where("hot").select("q", F.lit(-1).cast("long").alias("place"), F.lit(0.0).alias("p"), "askers", "places")
        dealt_hot = owners.unionByName(made).repartition(hot, "q").sortWithinPartitions("q", "place")
        answers = answers.unionByName(dealt_hot.mapInArrow(thrifty(hot_answers), DDL))

    rows = chunks
    for a in (plain(words, COUNT), answers):
        rows = rows.unionByName(a.select(*keep, none))
    ddl = f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return dealt(rows, "m", slices, chunk_scores(slices, order, cold, hot, discount[order], n, v, id_type), ddl), at


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    docs = table(spark, sf_dir, "documents")
    at = scratch(spark, "op6")
    with tidied(spark):
        out, _ = scored(docs.select("doc_id", remainder(F.col("doc_id"), 7) != 2, "text"), ORDER)
        return written(out.withColumnRenamed("id", "doc_id"), "op6", at)
