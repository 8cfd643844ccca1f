r"""Operator 10, SimHash near-dedup: generalised pigeonhole over parts of correlated bits, probe, verify, components.

Fingerprints. A text's words (A-Z lower-cased) give 3-word shingles; the bits of their XXH64 (seed 42) vote. Equal
fingerprints become one node at once, so copies cost nothing further.

Candidates. Two fingerprints that differ in at most ``MOST`` bits must, for any parts and thresholds t_i with
sum(t_i + 1) = MOST + 1, agree to within t_i bits in some part i. Over all nodes the bits' correlations are summed; bits
that go together are put into the same part; for 2, 3 and 4 parts the pairs that agree in each part are counted over all
nodes, and a dynamic programme spends the MOST + 1 units on the parts so that estimated candidates and probes are least.
A node is filed under its value in each part that has a threshold of 0 or more, and under every value within it.

Verification. A bucket is compared in numpy, and gives only the links of a spanning forest: a member found is not
compared again, so a dense group of near copies costs about its size. A bucket of more than ``BLOCK`` members is cut
into blocks by hash, and every pair of blocks is a task's group: whole results, bounded memory, no all-pairs output.

Components come from contracting the links: each round every node points to its least neighbour, pointers are doubled
until they stand, and links are drawn anew between roots. All tables lie in the shared folder; nothing of the size of the
corpus comes to the driver (only the 64 x 64 sums of bits and one count for each part).

Defined results: a null text counts as empty; a text without words has the fingerprint zero and is linked like any
other; with fewer than three words the whole sequence is the shingle; a null doc_id gets a component but never names
one, unless all its component's ids are null; repeated rows give repeated results; an empty table gives an empty result;
other columns are carried by ``deduplicate`` and ignored by ``op10``. Of a group, the row with the smallest doc_id stays,
of equal doc_ids the one stored first.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fresh, join_hot, scratch, ship, table, thrifty, tidied, values, written

MOST = 3
SHINGLE = 3
SEED = 42
BLOCK = 4096
#: The estimated cost of one more bucket row, in compared pairs.
PROBE_COST = 20.0
MATRIX = 512
#: Texts of up to so many bytes are remembered, 256 at a time.
KNOWN_BYTES = 1 << 16


# Fingerprints


def fingerprint(text: bytes) -> int:
    """Unsigned 64 bits."""
    words = text.lower().split()  # of bytes: A-Z alone, and [\x20\x09-\x0D] alone
    if not words:
        return 0
    if len(words) < SHINGLE:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    else:
        whole = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        digest, n = xxhash.xxh64_intdigest, len(words) - SHINGLE + 1
        hashes = np.fromiter((digest(whole[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)), np.uint64, n)
    votes = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = hashes[k : k + (1 << 16)]
        votes += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view("<u8")[0])


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprinted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(..., text as bytes last) to (..., fingerprint as a signed number)."""
    for b in batches:
        known: dict[bytes, int] = {}
        made = []
        for text in values(b.column(b.num_columns - 1)):
            text = text or b""
            if len(known) > 256:
                known.clear()
            made.append(known[text] if text in known else signed(fingerprint(text)))
            if len(text) <= KNOWN_BYTES:
                known[text] = made[-1]
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(made, pa.int64())], [f"c{k}" for k in range(b.num_columns)])


def with_fingerprint(docs: DataFrame, text_col: str, to: str) -> DataFrame:
    ship(docs.sparkSession)
    rows = docs.select(*docs.columns, F.col(text_col).cast("string").cast("binary").alias(to))
    kinds = [f"c{k} {t}" for k, (_, t) in enumerate(docs.dtypes)] + [f"c{len(docs.columns)} long"]
    return rows.mapInArrow(thrifty(fingerprinted), ", ".join(kinds)).toDF(*docs.columns, to)


# Parts and thresholds


def bit_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each pair of bits: how often both are set. The cell 4096 holds the number of nodes."""
    total, n = np.zeros((64, 64), np.int64), 0
    for b in batches:
        fp = b.column(0).to_numpy(zero_copy_only=False).astype("<i8")
        for k in range(0, len(fp), 1 << 16):
            bits = np.unpackbits(fp[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += (bits.T @ bits).astype(np.int64)
        n += len(fp)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(4097)), pa.array(np.append(total.ravel(), n))], ["cell", "n"])


def parts_of(both: np.ndarray, n: int, m: int) -> list[list[int]]:
    """64 bits in m parts of nearly equal size; a bit goes to the open part with whose bits it correlates most."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    near = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(near, 0)
    room = [64 // m + (k < 64 % m) for k in range(m)]
    parts: list[list[int]] = [[] for _ in range(m)]
    left = set(range(64))
    for k in range(m):
        parts[k].append(best := min(left, key=lambda x: (-near[x, sorted(left)].sum(), x)))
        left.remove(best)
        while len(parts[k]) < room[k]:
            parts[k].append(best := min(left, key=lambda x: (-near[x, parts[k]].sum(), x)))
            left.remove(best)
    return [sorted(x) for x in parts]


def mask_of(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def balls(size: int, radius: int) -> int:
    """Values within ``radius`` of a value of ``size`` bits."""
    out, ways = 0, 1
    for k in range(radius + 1):
        out += ways
        ways = ways * (size - k) // (k + 1)
    return out


def meetings(size: int, apart: int, radius: int) -> int:
    """Values of ``size`` bits that are within ``radius`` of both of two values that differ in ``apart`` bits."""
    return sum(comb(apart, i) * comb(size - apart, j) for i in range(min(apart, radius) + 1) for j in range(radius - i + 1) if apart - i + j <= radius and apart <= size)


def allocate(costs: list[list[float]], units: int) -> tuple[float, list[int]]:
    """costs[i][u]: of giving u units (threshold u - 1) to part i. The least total for exactly ``units``, and thresholds."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        now: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, taken) in best.items():
            for u, more in enumerate(row):
                if used + u <= units and (used + u not in now or cost + more < now[used + u][0]):
                    now[used + u] = (cost + more, [*taken, u - 1])
        best = now
    return best[units]


def plan(nodes: DataFrame, most: int = MOST, counts: tuple[int, ...] = (2, 3, 4), halfway: bool = False) -> list[tuple[int, list[int], int]]:
    """(mask, bits, threshold) of each part that is probed. ``nodes`` has the distinct fingerprints in ``fp``.

    ``counts``: how many parts are tried (7 at most). ``halfway``: nodes are filed under the values within half the threshold
    (rounded up), where any two within the threshold meet, most of them several times.
    """
    sums = {r["cell"]: r["n"] for r in nodes.select("fp").mapInArrow(thrifty(bit_sums), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()}
    n = sums.get(4096, 0)
    both = np.array([sums.get(k, 0) for k in range(4096)], np.float64).reshape(64, 64)
    p = np.diag(both) / max(n, 1)
    odds = 2 * p * (1 - p) / np.maximum(p**2 + (1 - p) ** 2, 1e-12)  # of one bit: that two nodes differ in it, to that they agree
    choices = {m: parts_of(both, n, m) for m in counts}
    masks = {(m, k): signed(mask_of(bits)) for m, parts in choices.items() for k, bits in enumerate(parts)}
    filed = nodes.select(F.explode(F.array(*[F.struct(F.lit(m * 8 + k).alias("part"), F.col("fp").bitwiseAND(F.lit(mask)).alias("value")) for (m, k), mask in masks.items()])).alias("x")).select("x.*")
    agree = {r["part"]: r["pairs"] for r in filed.groupBy("part", "value").count().groupBy("part").agg(F.sum(F.col("count").cast("double") * (F.col("count") - 1) / 2).alias("pairs")).collect()}
    found = []
    for m, parts in choices.items():
        costs = []
        for k, bits in enumerate(parts):
            pairs, row, ways = agree.get(m * 8 + k, 0.0) + 1e-9 * n, [0.0], [1.0] + [0.0] * most
            for b in bits:  # elementary symmetric sums of the odds: exactly j bits differ
                ways = [ways[j] + (odds[b] * ways[j - 1] if j else 0) for j in range(most + 1)]
            for t in range(most + 1):
                radius = (t + 1) // 2 if halfway else t
                met = [meetings(len(bits), j, radius) if halfway else 1 for j in range(min(2 * radius if halfway else t, most) + 1)]
                row.append(pairs * sum(x * y for x, y in zip(ways, met, strict=False)) + PROBE_COST * n * balls(len(bits), radius))
            costs.append(row)
        found.append((*allocate(costs, most + 1), m))
    _, thresholds, m = min(found)
    return [(signed(mask_of(bits)), bits, t) for bits, t in zip(choices[m], thresholds, strict=True) if t >= 0]


def variants(bits: list[int], t: int) -> list[int]:
    out = [0]
    for _ in range(t):
        out = sorted({x ^ (1 << b) for x in out for b in bits} | set(out))
    return [signed(x) for x in out]


# Probing and verifying


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which signed fingerprints differ. (numpy counts the bits of a signed number's absolute value.)"""
    return np.bitwise_count((a ^ b).view(np.uint64))


def bucket_links(members: np.ndarray, most: int = MOST) -> list[tuple[int, int]]:
    """A spanning forest of the links within ``members``: (member, least member of its component)."""
    left = np.unique(members)
    if len(left) <= MATRIX:
        near = differing(left[:, None], left[None, :]) <= most
        if int(near.sum()) == len(left):
            return []
    links = []
    while len(left) > 1:
        root, front = left[0], [left[0]]
        left = left[1:]
        while front and len(left):
            hit = differing(left, front.pop()) <= most
            if hit.any():
                found = left[hit]
                left = left[~hit]
                front.extend(found)
                links.extend((int(x), int(root)) for x in found)
    return links


def linked(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, fp), sorted by bucket, to links."""
    rest_k, rest_f = np.empty(0, np.int64), np.empty(0, np.int64)
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def made(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        edges = np.flatnonzero(np.diff(keys)) + 1
        bounds = np.concatenate([[0], edges, [len(keys)]])
        sizes = np.diff(bounds)
        pair = bounds[:-1][sizes == 2]
        a, b = fps[pair], fps[pair + 1]
        ok = (differing(a, b) <= most) & (a != b)
        u, v = np.maximum(a, b)[ok].tolist(), np.minimum(a, b)[ok].tolist()
        for k in np.flatnonzero(sizes > 2):
            for x, y in bucket_links(fps[bounds[k] : bounds[k + 1]], most):
                u.append(x)
                v.append(y)
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], schema=schema)

    for b in batches:
        keys = np.concatenate([rest_k, b.column(0).to_numpy()])
        fps = np.concatenate([rest_f, b.column(1).to_numpy()])
        if not len(keys):
            continue
        last = int(np.searchsorted(keys, keys[-1]))  # the last bucket may go on in the next batch
        rest_k, rest_f = keys[last:], fps[last:]
        if last:
            yield made(keys[:last], fps[:last])
    if len(rest_k):
        yield made(rest_k, rest_f)


def links(nodes: DataFrame, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """Links (u, v), u > v, that connect what is within ``most`` bits; ``nodes`` has the distinct fingerprints in ``fp``."""
    probes = [F.struct(F.lit(k).alias("part"), F.col("fp").bitwiseAND(F.lit(mask)).bitwiseXOR(F.lit(x)).alias("value")) for k, (mask, bits, t) in enumerate(plan(nodes, most)) for x in variants(bits, t)]
    filed = nodes.select("fp", F.explode(F.array(*probes)).alias("x")).select("fp", F.xxhash64("x.part", "x.value").alias("bucket"))
    large = filed.groupBy("bucket").count().where(F.col("count") > block)
    cut = filed.join(large, "bucket", "left").withColumn("blocks", F.coalesce(F.ceil(F.col("count") / block).cast("int"), F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    tasks = cut.select(
        "fp", F.when(F.col("blocks") == 1, F.array("bucket")).otherwise(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.xxhash64("bucket", F.least(own, j), F.greatest(own, j)))).alias("keys")
    ).select(F.explode("keys").alias("bucket"), "fp")
    dealt = tasks.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(thrifty(lambda batches: linked(batches, most)), "u long, v long").distinct()


# Components


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (u, v); the same root for what is connected."""
    spark = edges.sparkSession
    edges = written(edges.select("u", "v"), "links")
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        up = written(both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("p")), "up")
        while True:
            further = written(up.join(up.select(F.col("u").alias("p"), F.col("p").alias("q")), "p").select("u", F.col("q").alias("p"), (F.col("q") != F.col("p")).alias("moved")), "up")
            moved = not further.where("moved").isEmpty()
            up = further.select("u", "p")
            if not moved:
                break
        rounds.append(up)
        to = lambda c: up.select(F.col("u").alias(c), F.col("p").alias(f"{c}_"))  # noqa: B023, E731
        edges = written(edges.join(to("u"), "u").join(to("v"), "v").where("u_ <> v_").select(F.greatest("u_", "v_").alias("u"), F.least("u_", "v_").alias("v")).distinct(), "links")
    if not rounds:
        return spark.createDataFrame([], "node long, root long")
    label = rounds[0].select(F.col("u").alias("node"), F.col("p").alias("root"))
    for up in rounds[1:]:
        label = label.join(up.select(F.col("u").alias("root"), F.col("p").alias("next")), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return label


def classes(rows: DataFrame, most: int = MOST) -> DataFrame:
    """(fp, root) for every distinct ``fp`` of ``rows``."""
    nodes = written(rows.select("fp").distinct(), "nodes")
    label = written(components(links(nodes, most)), "label")
    return nodes.join(label, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: doc_id, fingerprint, component_id."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    at = scratch(spark, "op10")
    with tidied(spark):
        marked = written(with_fingerprint(docs, "text", "fp").select("doc_id", "fp"), "fingerprints")
        least = marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
        label = written(classes(marked).join(least, "fp"), "classes")
        named = label.join(label.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id", "n")
        out = join_hot(marked, named, "fp", "n", marked.count())
        return written(out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"), "op10", at)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST) -> DataFrame:
    """One row of each group of near duplicates, with all columns of ``docs``."""
    row, fp = fresh(docs, "sf_row", "sf_fp")
    store = written(with_fingerprint(docs.withColumn(row, F.monotonically_increasing_id()), text_col, fp), "rows")
    small = store.select(F.col(row).alias("row"), F.col(id_col).alias("id"), F.col(fp).alias("fp"))
    label = written(classes(small, most), "classes")
    best = small.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("best"))
    kept = written(label.join(best, "fp").groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.row").alias(row)), "kept")
    #: Most rows stay, so this side grows with the table: a merge join at every size, never a broadcast.
    return store.join(kept.hint("merge"), row, "left_semi").select(*docs.columns)
