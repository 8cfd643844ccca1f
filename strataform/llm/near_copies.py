r"""The pipeline's near-copy stage: one document of each group whose five-word shingles have a Jaccard similarity of 0.8.

Shingles. A text's words (A-Z lower-cased) give five-word shingles, told apart by XXH64; with fewer words the whole
sequence is the shingle. Texts with equal sets of shingles become one node.

Candidates are operator 10's: SimHash fingerprints, the generalised pigeonhole over parts of correlated bits, thresholds by
its dynamic programme, probes. The fingerprint is of the set of five-word shingles, so that its distance follows the
similarity: 64 bits of XXH64, and 128 further bits of mixes of it. Two nodes whose 64 bits differ in at most ``MOST`` meet in
some part, by the pigeonhole; those further apart often do. At a similarity of exactly 0.8 two fingerprints differ in 9.7 of
64 bits on average: more than ``MOST`` with a probability of 0.006, and they meet in none of six parts of threshold 2 with
one of 9e-5; both are less above 0.8. (For sets of 4 and 5 shingles, where ties weigh most: 0.04 and 0.001.) All are
calculated. Nodes that meet are linked if the 64 bits differ in at most ``FIRST`` and all 192 in at most ``APART``, which
random fingerprints do with a probability below 6e-10, so that groups of candidates stay small.

Who takes part. A node with a near copy shares 0.8 of its shingles with it, so of its ``front`` (its least hashes) some lie in
the copy's front as well. How many these are at least follows from its size alone; nodes with fewer hashes that any other
node's front has are alone, and aren't filed. Nothing is lost by that (hashes are cut to ``FRONT_BYTES``, which can only let
more nodes through), and most texts have no near copy, so what is filed and compared is a small part of the table.

Filing. A node is filed under the values within half a part's threshold, where any two within the threshold meet: 70 rows for
six parts of threshold 2, at every size. A bucket of more than ``CUT`` members is cut into blocks, and every pair of blocks
is a task's group.

Verification. The texts of each group of candidates come together, and similarities are exact: of a group all pairs are
compared, but for those that a verified link has joined already. A group of more than ``BLOCK`` nodes or ``BLOCK_BYTES``
is cut into blocks, and every pair of blocks is a task's group. The verified links' components are the groups of copies.

Defined results: a null text counts as empty; texts without words are copies of each other; of a group, the row with the
smallest doc_id stays (a null one only if all are null), of equal doc_ids the one stored first; an empty table gives an
empty result; other columns are carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fresh, ship, thrifty, values, written
from .simhash import components, plan, signed, variants

LEAST = (4, 5)  # of whole numbers, so that 0.8 is exact
SHINGLE = 5
SEED = 42
MOST = 17
PARTS = (4, 5, 6, 7)
WORDS = 3
FIRST, APART = 24, 54
#: A front has one in so many shingles more than it needs for one to be shared.
SHARED = 10
FRONT_BYTES = 5
CUT = 1 << 16
TILE = (128, 1 << 14)
BLOCK = 512
BLOCK_BYTES = 4 << 20
_random = np.random.default_rng(SEED)
FACTORS, MIX = (_random.integers(0, 1 << 64, n, np.uint64) | np.uint64(1) for n in ((WORDS - 1) * 2, WORDS))
LINKS = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def shingles(text: bytes) -> np.ndarray:
    """The set, sorted."""
    words = text.lower().split()  # of bytes: A-Z alone, and [\x20\x09-\x0D] alone
    if not words:
        return np.empty(0, np.uint64)
    whole = b" ".join(words)
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(whole, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest, n = xxhash.xxh64_intdigest, len(words) - SHINGLE + 1
    return np.unique(np.fromiter((digest(whole[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)), np.uint64, n))


def fingerprint(own: np.ndarray) -> np.ndarray:
    """``WORDS`` numbers of 64 bits: a bit is set if over half of the shingles' hashes (the first word) or mixes of them have it."""
    votes = np.zeros((WORDS, 64), np.int64)
    for k in range(0, len(own), 4096):
        part = own[k : k + 4096]
        for w in range(WORDS):
            mixed = part
            for factor in FACTORS[2 * w - 2 : 2 * w] if w else ():
                mixed = (mixed ^ (mixed >> np.uint64(31))) * factor
            mixed = mixed ^ (mixed >> np.uint64(29)) if w else mixed
            votes[w] += np.unpackbits(mixed.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(votes * 2 > len(own), axis=1, bitorder="little").view("<u8").ravel()


def sketch_of(words: np.ndarray) -> np.ndarray:
    """One signed number for each row of fingerprints' words; fingerprints that share one become one node of the candidates."""
    return (words * MIX).sum(axis=1, dtype=np.uint64).view(np.int64)


def front(own: np.ndarray) -> tuple[bytes, int]:
    """The least hashes of a set, each as the top ``FRONT_BYTES``, and how many of them any near copy has in its own front.

    Of sorted sets with ``both`` hashes in common, the k-th of these is among the first len(own) - both + k of each.
    """
    both = lambda n: -(-LEAST[0] * n // LEAST[1])
    more = lambda n: min(max(-(-n // SHARED), 1), both(n))
    least = own[: len(own) - both(len(own)) + more(len(own))]
    return least.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :FRONT_BYTES].tobytes(), more(both(len(own)))


def marks(text: bytes) -> tuple[int, np.ndarray, bytes, int]:
    """Node, as a signed number, the fingerprint's words, and the front with what has to be shared of it."""
    own = shingles(text)
    if not len(own):
        return 0, np.zeros(WORDS, np.uint64), b"", 0
    return signed(xxhash.xxh64_intdigest(own.tobytes(), SEED)), fingerprint(own), *front(own)


def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(..., text as bytes last) to (..., node, sketch, words, front, need)."""
    for b in batches:
        made = [marks(text or b"") for text in values(b.column(b.num_columns - 1))]
        words = np.array([x[1] for x in made], np.uint64).reshape(-1, WORDS)
        listed = pa.ListArray.from_arrays(pa.array(np.arange(len(made) + 1, dtype=np.int32) * WORDS), pa.array(words.ravel().view(np.int64)))
        columns = [*b.columns[:-1], pa.array([x[0] for x in made], pa.int64()), pa.array(sketch_of(words)), listed, pa.array([x[2] for x in made], pa.binary()), pa.array([x[3] for x in made], pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, [f"c{k}" for k in range(len(columns))])


def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, front) to a row (hash, node) for each hash of a front."""
    for b in batches:
        for k in range(0, b.num_rows, 1024):
            fronts = b.column(1).slice(k, 1024).to_pylist()
            flat = np.frombuffer(b"".join(fronts), np.uint8).reshape(-1, FRONT_BYTES)
            wide = np.zeros((len(flat), 8), np.uint8)
            wide[:, 8 - FRONT_BYTES :] = flat
            nodes = np.repeat(b.column(0).slice(k, 1024).to_numpy(), [len(x) // FRONT_BYTES for x in fronts])
            yield pa.RecordBatch.from_arrays([pa.array(wide.view(">i8").ravel().astype(np.int64)), pa.array(nodes, pa.int64())], ["hash", "node"])


def met_elsewhere(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (hash, node), sorted by both, to the node of each whose hash another node has too."""
    held, shared = (np.empty(0, np.int64), np.empty(0, np.int64)), None  # rows of one node that may be alone; the hash known not to be
    for b in batches:
        keys, nodes = (np.concatenate([x, c.to_numpy()]) for x, c in zip(held, b.columns, strict=True))
        if not len(keys):
            continue
        begins = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])
        ends = np.append(begins[1:], len(keys))
        several = nodes[begins] != nodes[ends - 1]
        several[0] |= shared is not None and keys[0] == shared
        shared = keys[-1] if several[-1] else None
        held = (np.empty(0, np.int64), np.empty(0, np.int64)) if several[-1] else (keys[begins[-1] :], nodes[begins[-1] :])
        yield pa.RecordBatch.from_arrays([pa.array(nodes[np.repeat(several, ends - begins)])], ["node"])


def perhaps_copied(marked: DataFrame) -> DataFrame:
    """(words) of all nodes but those that, by their fronts, have no near copy; ``marked`` has node, words, front and need."""
    rows = marked.select("node", "front").mapInArrow(thrifty(opened), "hash long, node long")
    met = rows.repartition("hash").sortWithinPartitions("hash", "node").mapInArrow(thrifty(met_elsewhere), "node long").groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    #: Both sides grow with the table: a merge join at every size.
    return marked.select("node", "need", "words").join(met.hint("merge"), "node").where("n >= need").select("words")


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``label`` (of each member a member of its group, never a greater one) with the groups of a[k] and b[k] joined."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while ((further := label[label]) != label).any():
            label = further


def met(words: np.ndarray) -> np.ndarray:
    """Labels of what is linked; ``words`` has a row for each word and a column for each member of a bucket."""
    size, loose = words.shape[1], True
    label = np.arange(size)
    for k in range(0, size - 1, TILE[0]):
        for c in range(k, size, TILE[1]):
            i, j = np.nonzero(np.bitwise_count(words[0, k : k + TILE[0], None] ^ words[0, None, c : c + TILE[1]]) <= FIRST)
            some = c + j > k + i
            i, j = k + i[some], c + j[some]
            if not loose:
                some = label[i] != label[j]
                i, j = i[some], j[some]
            apart = np.zeros(len(i), np.uint8)
            for word in words:
                apart += np.bitwise_count(word[i] ^ word[j])
            near = apart <= APART
            if near.any():
                label, loose = unite(label, i[near], j[near]), False
    return label


def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, words), sorted by bucket, to links between sketches."""
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def close(columns: list[list[np.ndarray]]) -> None:
        if sum(len(x) for x in columns[0]) > 1:
            words = np.stack([np.concatenate(x) for x in columns]).view(np.uint64)
            label = met(words)
            own = np.flatnonzero(label != np.arange(len(label)))
            u, v = sketch_of(words[:, own].T), sketch_of(words[:, label[own]].T)
            found.append((np.maximum(u, v), np.minimum(u, v)))

    def made() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.int64), *x])) for x in (zip(*found, strict=True) if found else ((), ()))], schema=LINKS)
        found.clear()
        return out

    bucket, held = None, [[] for _ in range(WORDS)]
    for b in batches:
        keys, *words = (c.to_numpy(zero_copy_only=False) for c in b.columns)
        bounds = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for begin, end in zip(bounds[:-1], bounds[1:], strict=True):
            if begin == end:
                continue
            if keys[begin] != bucket:
                close(held)
                bucket, held = keys[begin], [[] for _ in range(WORDS)]
            for x, word in zip(held, words, strict=True):
                x.append(word[begin:end])
        yield made()
    close(held)
    yield made()


def candidates(rows: DataFrame) -> DataFrame:
    """Links (u, v) between sketches, those that connect what met and is near; ``rows`` has ``words``."""
    names = [f"w{k}" for k in range(WORDS)]
    nodes = written(rows.select(*[F.col("words")[k].alias(x) for k, x in enumerate(names)]).distinct(), "fingerprints")
    parts = plan(nodes.withColumnRenamed("w0", "fp"), MOST, PARTS, halfway=True)
    filed = [F.struct(F.lit(k).alias("part"), F.col("w0").bitwiseAND(F.lit(mask)).bitwiseXOR(F.lit(x)).alias("value")) for k, (mask, bits, t) in enumerate(parts) for x in variants(bits, (t + 1) // 2)]
    dealt = nodes.select(*names, F.explode(F.array(*filed)).alias("x")).select(F.xxhash64("x.part", "x.value").alias("bucket"), *names)
    large = dealt.groupBy("bucket").count().where(F.col("count") > CUT)
    cut = dealt.join(F.broadcast(large), "bucket", "left").withColumn("blocks", F.coalesce(F.ceil(F.col("count") / CUT).cast("int"), F.lit(1)))
    dealt = cut.select(F.explode(spread("bucket", F.struct(*names))).alias("bucket"), *names).repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(thrifty(linked), "u long, v long").distinct()


def spread(group: str, member: str):
    """The keys of the pairs of blocks, of ``blocks``, in which ``member`` takes part."""
    own = F.pmod(F.xxhash64(member), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.xxhash64(group, F.least(own, j), F.greatest(own, j)))
    return F.when(F.col("blocks") == 1, F.array(group)).otherwise(pairs)


def group_links(nodes: list[int], sets: list[np.ndarray], least: tuple[int, int] = LEAST) -> list[tuple[int, int]]:
    """A spanning forest of the pairs whose similarity is ``least`` (a fraction) or more: (the greater, the lesser)."""
    links, left = [], list(range(len(nodes)))
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and left:
            one = front.pop()
            sizes = np.array([len(sets[k]) for k in left])
            able = np.minimum(sizes, len(sets[one])) * least[1] >= np.maximum(sizes, len(sets[one])) * least[0]
            some = [k for k, ok in zip(left, able.tolist(), strict=True) if ok and len(sets[k])]
            if not some or not len(sets[one]):
                continue
            sizes, flat = sizes[able & (sizes > 0)], np.concatenate([sets[k] for k in some])
            at = np.minimum(np.searchsorted(sets[one], flat), len(sets[one]) - 1)
            both = np.add.reduceat((sets[one][at] == flat).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
            hit = {k for k, ok in zip(some, (both * least[1] >= (sizes + len(sets[one]) - both) * least[0]).tolist(), strict=True) if ok}
            links += [(max(nodes[k], nodes[one]), min(nodes[k], nodes[one])) for k in hit]
            left = [k for k in left if k not in hit]
            front += sorted(hit)
    return links


def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (group, node, text), sorted by group, to links."""
    group, nodes, sets = None, [], []
    made = lambda found: pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*found, strict=True) if found else ((), ()))], schema=LINKS)
    for b in batches:
        for key, node, text in zip(*(values(c) for c in b.columns), strict=True):
            if key != group:
                if len(nodes) > 1:
                    yield made(group_links(nodes, sets))
                group, nodes, sets = key, [], []
            nodes.append(node)
            sets.append(shingles(text or b""))
    if len(nodes) > 1:
        yield made(group_links(nodes, sets))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", links=candidates) -> DataFrame:
    """One row of each group of near copies, with all columns of ``docs``."""
    ship(docs.sparkSession)
    row, node, sketch, words, least, need = fresh(docs, "sf_row", "sf_node", "sf_sketch", "sf_words", "sf_front", "sf_need")
    rows = docs.withColumn(row, F.monotonically_increasing_id())
    kinds = [f"c{k} {t}" for k, (_, t) in enumerate(rows.dtypes)] + [f"c{len(rows.columns) + k} {t}" for k, t in enumerate(("long", "long", "array<long>", "binary", "int"))]
    rows = rows.select("*", F.col(text_col).cast("string").cast("binary").alias(words)).mapInArrow(thrifty(marked), ", ".join(kinds)).toDF(*rows.columns, node, sketch, words, least, need)
    store = written(rows, "rows")
    small = store.select(F.col(row).alias("row"), F.col(id_col).alias("id"), F.col(node).alias("node"), F.col(sketch).alias("sketch"), F.octet_length(F.col(text_col).cast("string")).alias("size"))
    best = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    nodes = written(small.groupBy("node", "sketch").agg(F.min(best).alias("best"), F.min(F.struct("row", "size")).alias("first")), "nodes")
    some = perhaps_copied(store.select(F.col(node).alias("node"), F.col(words).alias("words"), F.col(least).alias("front"), F.col(need).alias("need")))
    loose = components(links(some)).withColumnsRenamed({"node": "sketch", "root": "group"})
    grouped = written(nodes.join(loose, "sketch", "left").select("node", "first.*", F.coalesce("group", "sketch").alias("group")), "grouped")
    several = grouped.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).where("n > 1")
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES), F.lit(1)).cast("int")
    members = written(grouped.join(several, "group").withColumn("blocks", blocks).select("row", "node", "group", "blocks"), "members")
    #: Members grow with the table: a merge join at every size, as below.
    texts = store.select(F.col(row).alias("row"), F.col(text_col).cast("string").cast("binary").alias("text")).join(members.hint("merge"), "row")
    dealt = texts.select(F.explode(spread("group", "node")).alias("key"), "node", "text").repartition("key").sortWithinPartitions("key")
    edges = dealt.mapInArrow(thrifty(verified), "u long, v long").distinct()
    label = components(edges).withColumnRenamed("root", "class")
    kept = nodes.join(label, "node", "left").groupBy(F.coalesce("class", "node").alias("class")).agg(F.min("best").alias("best"))
    kept = written(kept.select(F.col("best.row").alias(row)), "kept")
    #: Most rows stay, so this side grows with the table: a merge join at every size, never a broadcast.
    return store.join(kept.hint("merge"), row, "left_semi").select(*docs.columns)
