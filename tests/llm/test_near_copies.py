"""The pipeline's near-copy stage against brute-force Jaccard similarity."""

import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

import corpus_pipeline
from strataform.llm import near_copies, simhash

from .conftest import ROWS

AT = "/root/testdata/sf0.01"


def brute_shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(len(words) - 4, 1))}


def brute_groups(texts):
    """For each text the least position of its group."""
    sets, up = [brute_shingles(t) for t in texts], list(range(len(texts)))

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for a in range(len(sets)):
        for b in range(a):
            if 5 * min(len(sets[a]), len(sets[b])) >= 4 * max(len(sets[a]), len(sets[b])) and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return [find(a) for a in range(len(sets))]


def survivors(rows):
    by_id = sorted(rows)
    groups = brute_groups([t for _, t in by_id])
    return {by_id[k][0] for k, g in enumerate(groups) if g == k}


def test_stage_on_whole_table(spark):
    docs = spark.read.parquet(f"{AT}/documents.parquet")
    got = corpus_pipeline.drop_near(spark, docs, AT)
    assert got.columns == docs.columns
    assert {r[0] for r in got.select("doc_id").collect()} == survivors([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])


@pytest.mark.parametrize("block", [3, near_copies.BLOCK])
def test_changed_words(spark, monkeypatch, block):
    """A dense group, chains, pairs on both sides of 0.8, and short texts; groups cut into blocks or whole."""
    monkeypatch.setattr(near_copies, "BLOCK", block)
    rng = random.Random(5)
    text = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows, base = [], text(300)
    for _ in range(40):
        one = list(base)
        for k in rng.sample(range(300), rng.randrange(4)):
            one[k] = "changed"
        rows.append(one)
    chain = text(200)
    for _ in range(25):
        chain = chain[8:] + text(8)
        rows.append(chain)
    for n in (3, 6, 30, 100, 1000):
        one = text(n)
        for changes in range(0, n // 8 + 2):
            other = list(one)
            for k in rng.sample(range(n), min(changes, n)):
                other[k] = "other"
            rows.append(other)
    made = [(k, " ".join(x)) for k, x in enumerate(rows)]
    got = near_copies.deduplicate(spark.createDataFrame(made, "doc_id long, text string"))
    assert {r["doc_id"] for r in got.collect()} == survivors(made)


def test_odd_rows(docs, empty):
    out = near_copies.deduplicate(docs)
    assert out.columns == docs.columns and out.count() == len(set(brute_groups([t for _, t in ROWS])))
    assert near_copies.deduplicate(empty).count() == 0


def test_group_links():
    """At exactly 0.8 a pair is linked; just below it isn't."""
    a, b, c = (np.array(x, np.uint64) for x in (range(10), range(8), range(7)))
    assert near_copies.group_links([1, 2], [a, b]) == [(2, 1)]
    assert near_copies.group_links([1, 3], [a, c]) == []


def test_fingerprint_of_the_set_of_shingles():
    """The first word is SimHash over the XXH64 of different five-word shingles; repeats don't weigh."""
    text = "a b c d e f g h " * 3 + "B c x y z"
    hashes = [xxhash.xxh64_intdigest(b" ".join(x), 42) for x in brute_shingles(text)]
    want = sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))
    assert int(near_copies.marks(text.encode())[1][0]) == want
    assert near_copies.marks(b" \t")[1].tolist() == [0] * near_copies.WORDS


def test_stage_goes_through_the_pigeonhole(spark, monkeypatch):
    """Candidates come from operator 10's parts and thresholds, over the fingerprints of all texts."""
    seen = []
    monkeypatch.setattr(near_copies, "plan", lambda nodes, *a, **k: seen.append((nodes.count(), simhash.plan(nodes, *a, **k))) or seen[-1][1])
    texts = [" ".join(f"w{k}-{j}" for j in range(30)) for k in range(20)]
    rows = [(k, t) for k, t in enumerate(texts + [t + " more" for t in texts])]
    got = near_copies.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in got.collect()) == list(range(20))
    assert seen[0][0] == 40 and sum(t + 1 for _, _, t in seen[0][1]) >= near_copies.MOST + 1


@pytest.mark.parametrize("cut", [3, near_copies.CUT])
def test_candidates(spark, monkeypatch, cut):
    """Whatever is within ``MOST`` bits is joined, and nothing that isn't joined by pairs within the looser bounds."""
    monkeypatch.setattr(near_copies, "CUT", cut)
    rng = np.random.default_rng(8)
    words = [rng.integers(0, 1 << 64, near_copies.WORDS, np.uint64) for _ in range(150)]
    for start in range(30):
        for bits in (1, 9, 17) if start else range(18):
            for first, most in ((True, bits), (False, bits)):
                other = words[start].copy()
                for k in rng.choice(64, most, False).tolist():
                    other[0 if first else 1] ^= np.uint64(1 << k)
                words.append(other)
    for k in range(0, 48, 16):  # a chain whose ends are 48 bits apart
        words.append(words[-1 if k else 149] ^ np.array([0xFFFF << k, 0, 0], np.uint64))
    fps = np.unique(np.array(words), axis=0)
    edges = near_copies.candidates(spark.createDataFrame([(x.view(np.int64).tolist(),) for x in fps], "words array<long>"))
    label = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    ids = near_copies.sketch_of(fps).tolist()
    got = np.array([label.get(x, x) for x in ids])
    apart = np.bitwise_count(fps[:, None] ^ fps[None]).astype(int)
    sure = (apart[:, :, 0] <= near_copies.MOST) & (apart.sum(axis=2) <= near_copies.APART)
    assert (got[:, None] == got[None])[sure].all()
    loose = np.arange(len(fps))
    loose = near_copies.unite(loose, *np.nonzero((apart[:, :, 0] <= near_copies.FIRST) & (apart.sum(axis=2) <= near_copies.APART)))
    assert (loose[:, None] == loose[None])[got[:, None] == got[None]].all()


def test_meetings():
    for size, radius in ((5, 1), (7, 2), (4, 3)):
        near = [x for x in range(1 << size) if x.bit_count() <= radius]
        for apart in range(size + 1):
            assert simhash.meetings(size, apart, radius) == sum((x ^ (1 << apart) - 1).bit_count() <= radius for x in near)


def test_texts_alone_are_not_filed(spark, monkeypatch):
    """Texts that share too little for a near copy never come to the pigeonhole; all that have one do."""
    seen = []
    monkeypatch.setattr(near_copies, "plan", lambda nodes, *a, **k: seen.append(nodes.count()) or simhash.plan(nodes, *a, **k))
    line = " ".join(f"common{j}" for j in range(10))
    texts = [f"{line} " + " ".join(f"w{k}-{j}" for j in range(60)) for k in range(40)]
    rows = [(k, t) for k, t in enumerate(texts + [t + " more" for t in texts[:5]])]
    got = near_copies.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in got.collect()) == list(range(40))
    assert seen == [10]


def test_fronts():
    """Of any two sets at 0.8 or more, each has what it needs of its front in the other's."""
    rng = np.random.default_rng(3)
    for n in [*range(1, 40), 99, 100, 101, 1000]:
        for _ in range(5):
            whole = np.unique(rng.integers(0, 1 << 64, n, np.uint64))
            apart = rng.permutation(n)[: n // 5]
            cut = int(rng.integers(0, len(apart) + 1))
            a, b = np.delete(whole, apart[:cut]), np.delete(whole, apart[cut:])
            (x, x_need), (y, y_need) = near_copies.front(a), near_copies.front(b)
            parts = lambda f: {f[k : k + near_copies.FRONT_BYTES] for k in range(0, len(f), near_copies.FRONT_BYTES)}
            assert len(parts(x) & parts(y)) >= max(x_need, y_need) >= 1


@pytest.mark.parametrize("size", [1, 2, 3, 100])
def test_met_elsewhere(size):
    """Whatever the batches, a row counts if its hash has another node."""
    rng = np.random.default_rng(4)
    rows = sorted((int(h), int(n)) for h, n in zip(rng.integers(0, 25, 80), rng.integers(0, 3, 80), strict=True))
    batch = lambda part: pa.RecordBatch.from_arrays([pa.array([x[k] for x in part], pa.int64()) for k in (0, 1)], ["hash", "node"])
    got = [n for b in near_copies.met_elsewhere(batch(rows[k : k + size]) for k in range(0, len(rows), size)) for n in b.column(0).to_pylist()]
    assert sorted(got) == sorted(n for h, n in rows if len({m for g, m in rows if g == h}) > 1)
    pair = near_copies.front(np.arange(1, 6, dtype=np.uint64) << np.uint64(40))[0], b""
    made = pa.RecordBatch.from_arrays([pa.array([7, 8], pa.int64()), pa.array(pair, pa.binary())], ["node", "front"])
    assert pa.Table.from_batches(near_copies.opened([made])).to_pydict() == {"hash": [1 << 16, 2 << 16], "node": [7, 7]}
