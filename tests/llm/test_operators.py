"""Each operator against brute force on small tables, with the awkward rows of conftest."""

import hashlib
import io
import math
import os
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from strataform.llm import bpe, decontaminate, exact_dedup, katz, quality, registry, secrets, simhash, token_counts, url_filter, warc

from .conftest import ROWS

SMALL = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


# Those that SQL can express, on a whole small table


@pytest.mark.parametrize("name", list(registry.ORACLES))
def test_same_as_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    got = registry.QUERIES[name](spark, SMALL)
    cols = sorted(got.columns)
    assert sorted(map(repr, (list(r) for r in got.select(*cols).collect()))) == sorted(map(repr, (list(r) for r in c.sql(f"select {', '.join(cols)} from ({registry.ORACLES[name]})").fetchall())))


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_every_document_or_page_has_its_row(spark, name):
    got = registry.QUERIES[name](spark, SMALL)
    n = spark.read.parquet(f"{SMALL}/{'pages' if name.startswith(('op2_', 'op4_')) else 'documents'}.parquet").count()
    assert name.startswith("op8_") and got.count() > 0 or got.count() == n


# 1


def brute_groups(rows, key):
    by = defaultdict(list)
    for i, t in rows:
        by[key(t or "")].append((-len(t or ""), i is None, i or 0, i))
    return {k: (min(v)[3], len(v)) for k, v in by.items()}


def norm(t):
    return re.sub("[\x20\x09-\x0d]", "", t)


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda c: F.unhex(F.sha2(F.substring(c, 1, 1), 256))])
def test_exact_groups(docs, digest):
    """Also with a digest that collides: full bytes decide."""
    store, dealt, _, _ = exact_dedup.groups(docs, digest=digest)
    want = brute_groups(ROWS, norm)
    texts = {r["sf_row_"]: r["text"] for r in store.collect()}
    got = dealt.collect()
    assert len(got) == len(ROWS)
    for r in got:
        assert (r["keep_id"], r["group_size"]) == want[norm(texts[r["row"]] or "")]
    assert sum(r["kept"] for r in got) == len(want)


def test_exact_dedup_keeps_columns_and_takes_more_rows(spark, docs, empty, tmp_path):
    out = exact_dedup.deduplicate(docs)
    assert out.columns == docs.columns and out.count() == len(brute_groups(ROWS, norm))
    assert exact_dedup.deduplicate(empty).count() == 0
    store, state = str(tmp_path / "rows"), str(tmp_path / "state")
    names = {"row": "r", "size": "n", "digest": "d", "id": "i"}
    for first in (0, 10):
        spark.range(first, first + 10).select(F.col("id").alias("i"), F.col("id").alias("r"), F.lit(1).alias("n"), (F.col("id") % 4).cast("string").cast("binary").alias("d")).write.mode("append").parquet(store)
        held = exact_dedup.fold(spark, store, names, "bigint", state)
    assert sorted((r["best"]["id"], r["n"]) for r in held.collect()) == [(0, 5), (1, 5), (2, 5), (3, 5)]


def test_exact_dedup_runs_no_python(docs):
    assert not re.search("Python|Pandas|Arrow", exact_dedup.groups(docs)[1]._jdf.queryExecution().executedPlan().toString())


# 2


def test_urls(spark):
    rows = [(1, "http://A.example.com/en/x?q#f"), (2, "https://www.example.com/en/"), (3, "x://a.net/es/1"), (4, "x://net/fr/"), (5, None), (6, "no scheme"), (7, "http://b.org/login"), (None, "http://a.com"), (9, "http://xnet/es/"), (9, "http://xnet/es/"), (10, "http://com?x/"), (11, "a://b://c.com/"), (12, "http://x.org/feed")]
    df = spark.createDataFrame(rows, "page_id long, url string").select("*", F.lit(1).alias("row"), F.lit(2).alias("rank"))
    got = sorted(((r["id"] or 0, r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judged(df).collect()), key=repr)
    assert got == sorted([(1, "a.example.com", "/en/x", "example.com/en/", "block"), (2, "www.example.com", "/en/", "www.example.com/en/", "allow"), (3, "a.net", "/es/1", "net/es/", "block"), (4, "net", "/fr/", "net/fr/", "block"), (5, "", "", None, "allow"), (6, "", "", None, "allow"), (7, "b.org", "/login", None, "block"), (0, "a.com", "", None, "allow"), (9, "xnet", "/es/", None, "allow"), (9, "xnet", "/es/", None, "allow"), (10, "com", "", None, "allow"), (11, "b:", "//c.com/", None, "allow"), (12, "x.org", "/feed", None, "block")], key=repr)
    assert url_filter.judged(df.where("false")).count() == 0


def test_rules_without_tokens_and_many_rules(spark):
    df = spark.createDataFrame([(1, "http://a.org/?"), (2, "http://site77.org/x")], "page_id long, url string")
    rules = tuple(url_filter.host_rule(f"site{k}.org/", "block") for k in range(300)) + (url_filter.pattern_rule("odd", r"^[^/]*/$", ()),)
    assert sorted((r["id"], r["rule"], r["verdict"]) for r in url_filter.judged(df, rules=rules).collect()) == [(1, None, "block"), (2, "site77.org/", "block")]


# 3


def test_secret_spans(docs, empty):
    base = {"assign": re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), "access": re.compile("AKIA[A-Z0-9]+"), "hex": re.compile("[0-9a-f]+")}
    random.seed(5)
    bits = ["token", "PASSWORD", "api_key", "apikey", "=", ":", " ", '"', "AKIA", "A1B2C3D4E5F6G7H8", "0123456789abcdef", "deadbeef", "x", "ſecret", "toKen", "secret: ", "é", "\n"]
    for _ in range(400):
        t = "".join(random.choice(bits) for _ in range(30))
        want = sorted((m.start(), k, m.end()) for k, (name, p) in enumerate(base.items()) for m in p.finditer(t) if (len(m[2]) >= 6 if name == "assign" else len(m[0]) >= (20 if name == "access" else 24)))
        assert secrets.base_spans(t) == want
    rows = {(r["id"], r["spans"]) for r in secrets.scan(docs).collect()}
    assert (4, "") in rows and any(i == 10 and "assign:" in x for i, x in rows) and len(secrets.scan(docs).collect()) == len(ROWS)
    assert secrets.scan(empty).count() == 0


def brute_cost(value):
    """The least over all segmentations, by plain recursion."""
    memo = {0: 0.0}

    def best(end):
        if end not in memo:
            ways = [best(end - 1) + secrets.char_cost(value[end - 1])]
            ways += [best(a) + c + math.log10(2) * (a > 0) for a, c in secrets.segments(value, end)]
            memo[end] = min(ways)
        return memo[end]

    return best(len(value))


def test_guess_costs():
    order = [secrets.guess_cost(x) for x in ("password", "password1999", "qwertyuiop12", "aaaaaaaaaaaa", "xK9#vQ2!mZ7p")]
    assert order[0] < 2 and max(order[:4]) < secrets.LEAST_COST < order[4]
    for x in ("P@ssw0rd20240101zz", "abcabcabc", "", "19900101"):
        assert secrets.guess_cost(x) == pytest.approx(brute_cost(x))
    text = "passphrase is xK9#vQ2!mZ7p and pwd: dragon1999"
    assert secrets.joined(secrets.guess_spans(text, [])) == "guess:14:26"


# 4


def parts(k, n=200):
    random.seed(k)
    return [warc.member(warc.record(i, f"http://a/b c\n{i}", os.urandom(random.randint(0, 3000)), i % 5 == 1, 7)) for i in range(n)]


def read(data):
    return list(warc.Reader(io.BytesIO(data), len(data)))


def test_salvage():
    recs = parts(3)
    assert [warc.page_of(r.headers["warc-record-id"]) for r in read(b"".join(recs))] == list(range(200))
    at = np.cumsum([0] + [len(r) for r in recs])
    data = bytearray(b"".join(recs))
    data[at[10] + 30] ^= 0xFF
    data[at[50] : at[50]] = b"junk\x1f\x8b\x08junk"
    got = read(bytes(data[:-5]))
    gaps = [(a, b) for a, b, _ in (x for x in got if isinstance(x, tuple))]
    assert gaps == [(at[10], at[11]), (at[50], at[50] + 11), (at[199] + 11, len(data) - 5)] and len(got) == 198 + 3
    plain = [warc.record(i, None, b"x" * 500, False, None) for i in range(9)]
    broken = bytearray(b"".join(plain))
    broken[len(plain[0]) + 400] ^= 1
    assert [isinstance(x, tuple) for x in read(bytes(broken))] == [False, True] + [False] * 7
    assert read(b"") == [] and isinstance(read(b"nothing")[0], tuple)
    mixed = recs[0] + plain[1] + recs[2]
    assert len(read(mixed)) == 3


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "u", "a" * 2000), (2, "u", "a" * 2000), (2, "u", "a" * 2000), (3, None, "b" * 10), (4, "u", "b" * 10), (5, "u", None), (None, "u", "a" * 2000)]
    pages = spark.createDataFrame(rows, "id long, url string, html string")
    manifest = warc.write_archives(warc.decided(pages), f"file://{tmp_path}/w")
    got = warc.read_archives(manifest.select("file")).where("gap is null").collect()
    seen = sorted((str(warc.page_of(r["record_id"])), r["record_type"], r["payload_bytes"], warc.page_of(r["refers_to"])) for r in got)
    assert seen == sorted([("1", "revisit", 2000, 2), ("2", "response", 2000, None), ("2", "response", 2000, None), ("3", "response", 10, None), ("4", "response", 10, None), ("5", "response", 0, None), ("None", "revisit", 2000, 2)])
    assert all(r["payload_digest"] == hashlib.sha1(r["payload"]).hexdigest() for r in got if r["record_type"] == "response")
    assert warc.write_archives(warc.decided(pages.where("false")), f"file://{tmp_path}/none").count() == 0


# 5


def test_quality_on_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    got = quality.op5(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (got["predicted"] == got["quality"]).mean() > 0.97 and got["score"].between(0, 1).all()


def test_quality_of_awkward_rows(spark, docs, empty):
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 11)] + [(3, None), (None, 1)], "doc_id long, quality int")
    kept = quality.keep(docs, labels)
    assert kept.columns == docs.columns and kept.count() <= len(ROWS)
    scores = quality.scored(docs, quality.fit(docs.select("doc_id", "text"), labels.where("false")), "text", "s").collect()
    assert [r["s"] for r in scores] == [0.5] * len(ROWS)
    assert quality.keep(empty, labels).count() == 0


def plain_index(word, seed=0):
    """One place of each eight is 1 or -1, by four bits of the hash each."""
    h, out = xxhash.xxh64_intdigest(word, seed), [0] * quality.DIM
    for j in range(quality.DIM // 8):
        bits = h >> 4 * j & 15
        out[8 * j + bits % 8] = -1 if bits >= 8 else 1
    return out


def plain_slot(word):
    return (xxhash.xxh64_intdigest(word) * 0x9E3779B97F4A7C15 % 2**64) * quality.SLOTS >> 64


def plain_vectors(texts):
    """slot: sum of the index vectors of the words beside its words."""
    out = defaultdict(lambda: [0] * quality.DIM)
    for t in texts:
        w = (t or b"").split()
        for x, y in zip(w, w[1:], strict=False):
            for own, other in ((x, y), (y, x)):
                out[plain_slot(own)] = [p + q for p, q in zip(out[plain_slot(own)], plain_index(other), strict=True)]
    return out


QUALITY_TEXTS = [b"a b a", None, b"c", b"", b"b a", "Zoë's 12 dogs, ran ran".encode(), b"x " * 5000]


def test_neighbours_against_plain_sums():
    slots, sums = quality.neighbours(QUALITY_TEXTS)
    want = plain_vectors(QUALITY_TEXTS)
    assert {int(k): x.tolist() for k, x in zip(slots, sums, strict=True) if x.any()} == {k: x for k, x in want.items() if any(x)}
    assert quality.neighbours([None, b""])[1].shape == (0, quality.DIM)


def test_word_vectors_over_tasks(spark):
    rows = [(bytearray(t) if t is not None else None,) for t in QUALITY_TEXTS * 3]
    got = quality.word_vectors(spark.createDataFrame(rows, "text binary").repartition(4))
    want = np.zeros((quality.SLOTS, quality.DIM), np.int8)
    for k, x in plain_vectors(QUALITY_TEXTS * 3).items():
        want[k] = np.round(np.array(x) / max(1, math.sqrt(sum(v * v for v in x))) * 127)
    assert (got == want).all()


def test_pooling_network_and_temperature_in_plain_python():
    vectors = np.random.default_rng(1).integers(-127, 128, (quality.SLOTS, quality.DIM)).astype(np.int8)
    shape = lambda w: re.sub(rb"(?s)(.)\1+", rb"\1", re.sub(rb"[0-9]", b"0", re.sub(rb"[a-z\x80-\xff]", b"a", re.sub(rb"[A-Z]", b"A", w))))
    want = []
    for t in QUALITY_TEXTS:
        w = (t or b"").split()
        mean = lambda rows: [sum(x) / len(w) for x in zip(*rows, strict=True)]  # noqa: B023, E731
        same = sum(x == y for x, y in zip(w, w[1:], strict=False))
        want.append([*mean([[v / 127 for v in vectors[plain_slot(x)].tolist()] for x in w]), *mean([plain_index(shape(x), 1) for x in w]), len(set(w)) / len(w), same / (len(w) - 1) if len(w) > 1 else 0, math.log(1 + len(w))] if w else [0.0] * quality.FEATURES)
    x = quality.pooled(QUALITY_TEXTS, vectors)
    assert np.allclose(x, want, atol=1e-4)
    rng = np.random.default_rng(2)
    many = rng.normal(size=(200, quality.FEATURES))
    y = (many[:, 0] + 0.8 * rng.normal(size=200) > 0).astype(float)
    left = np.arange(200) % 5 == 0
    m = quality.train(vectors, many, y, left)

    def plain_logit(row):
        a = [(v - p) / q for v, p, q in zip(row, m.mean, m.spread, strict=True)]
        h = [max(0.0, sum(v * c for v, c in zip(a, col, strict=True)) + b) for col, b in zip(m.w1.T.tolist(), m.b1, strict=True)]
        return sum(v * c for v, c in zip(h, m.w2, strict=True)) + m.b2

    assert np.allclose([plain_logit(r) for r in many[:20]], m.logits(many[:20]))
    loss = lambda c: sum(math.log(1 + math.exp(-z / c if t else z / c)) for z, t in zip(m.logits(many[left]), y[left], strict=True))
    assert m.temperature == pytest.approx(min(np.geomspace(0.25, 8, 61), key=loss))
    assert np.allclose(m.scores(QUALITY_TEXTS), [1 / (1 + math.exp(-plain_logit(r) / m.temperature)) for r in x.astype(float)], atol=1e-6)


# 6


def brute_katz(rows):
    toks = [WORD.findall(lower(t)) + [" "] for _, _, t in rows]
    c, b = Counter(), Counter()
    for w, (_, train, _) in zip(toks, rows, strict=True):
        if train:
            c.update(w)
            b.update(zip([" ", *w], w, strict=False))
    n, v = sum(c.values()), len(c)
    p1 = lambda w: (c[w] + 1) / (n + v + 1)
    d = katz.discounts([sum(x == r for x in b.values()) for r in range(1, katz.KEEP + 2)])
    after = defaultdict(dict)
    for (h, w), x in b.items():
        after[h][w] = x

    def p(h, w):
        if not c[h]:
            return p1(w)
        kept = {y: d[min(x, katz.KEEP + 1)] * x / c[h] for y, x in after[h].items()}
        if 1 - sum(kept.values()) <= 1e-9:
            kept = {y: (x - 0.5) / c[h] for y, x in after[h].items()}
        return kept[w] if w in kept else (1 - sum(kept.values())) / (1 - sum(map(p1, kept))) * p1(w)

    return toks, c, n, p1, p


@pytest.mark.parametrize("chunk", [50, 1 << 23])
def test_katz_against_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(katz, "CHUNK_BYTES", chunk)
    random.seed(2)
    rows = [(k, k % 5 != 0, " ".join(random.choice(["the", "The", "cat", "sat", "on", "é", f"w{random.randint(0, 60)}"]) for _ in range(random.randint(0, 40)))) for k in range(80)] + [(100, False, None), (None, True, "the cat"), (7, True, "the the")]
    df = spark.createDataFrame(rows, "id long, trained boolean, text string").repartition(3)
    toks, c, n, p1, p = brute_katz(rows)
    want = Counter((i, not t, len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10(p1(x)) for x in w), 6), round(sum(math.log10(p(h, x)) for h, x in zip([" ", *w], w, strict=False)), 6)) for (i, t, _), w in zip(rows, toks, strict=True))
    got = Counter((r["id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in katz.scored(df)[0].collect())
    assert got == want
    for h in ["the", " ", "w1", "é"]:
        assert sum(p(h, w) for w in c) + p(h, "unseen") == pytest.approx(1)
    assert katz.scored(df.where("false"))[0].count() == 0


def test_packed_arrays():
    for x in (np.array([], np.int64), np.array([0, 255, 256, 2**40]), np.array([1])):
        assert (katz.unpack(katz.pack(x)) == x).all()
    x = np.array([0.5, -1e300, np.inf])
    assert (katz.unpack(katz.pack(x), "<f8") == x).all()
    big = [np.array([2**40, 2**40, 5, 5]), np.array([2**50, 1, 1, 1])]
    ids, first = katz.grouped(big)
    assert ids.tolist() == [2, 1, 0, 0] and [x[first].tolist() for x in big] == [[5, 2**40, 2**40], [1, 1, 2**50]]
    for columns in (big, [np.array([3, 1, 2]), np.array([2**40, 0, 1])]):
        assert [x.tolist() for x in katz.unpacked_grams(katz.packed_grams(columns))] == [x.tolist() for x in columns]


# 7


@pytest.fixture(scope="module")
def own():
    path, pattern = bpe.default_files()
    return bpe.Codec(bpe.vocabulary(path), pattern)


def test_tree_is_the_library(own):
    random.seed(1)
    letters = "ab 1  \n\t'srelvm!?é ü 中😀ſ'"
    for _ in range(800):
        t = "".join(random.choice(letters) for _ in range(random.randint(0, 60)))
        for leaf in (1, 2, 3, 7):
            assert own.encode(t, leaf).tolist() == own.library.encode_ordinary(t), (t, leaf)
    t = " " * 20_000 + "x" + "'re" * 9000 + "a" * 3000 + "<|endoftext|>"
    assert own.encode(t, 1000).tolist() == own.library.encode_ordinary(t)
    assert own.decode(own.encode(t), 100).decode() == t


def test_encoding_tables(docs, empty, own):
    path, pattern = bpe.default_files()
    got = {(r["id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.encode_digests(docs, path, pattern).collect()}
    want = set()
    for i, t in ROWS:
        ids = own.library.encode_ordinary(t or "")
        want.add((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == want
    back = bpe.decode_documents(bpe.encode_documents(docs, path, pattern), path, pattern).collect()
    assert all(bytes(r["decoded"]).decode() == (r["text"] or "") for r in back)
    assert bpe.encode_documents(empty, path, pattern).columns[-2:] == ["n_tokens_", "token_ids"]


# 8


def test_leaks(spark, docs, empty):
    random.seed(4)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(random.randint(2, 7)))
    items = [(k, " ".join(word() for _ in range(random.randint(12, 40)))) for k in range(30)] + [(90, None), (91, ""), (92, "one two")]
    rows = []
    for k in range(60):
        noise = [word() for _ in range(random.randint(0, 500))]
        if k % 3 == 0:
            at = random.randint(0, len(noise))
            noise[at:at] = items[k % 30][1].upper().replace(" ", ",  ").split(" ")
        rows.append((k, " ".join(noise)))
    df, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for most in (decontaminate.SHARD_BYTES, 400):
        got = {(r["id"], r["item_id"]) for r in decontaminate.leaks(df, bench, shard_bytes=most).collect()}
        assert got == {(k, k % 30) for k in range(0, 60, 3)}
    assert decontaminate.clean(df, bench).count() == 40
    assert decontaminate.clean(docs, bench).columns == docs.columns and decontaminate.clean(docs, bench).count() == len(ROWS)
    assert decontaminate.leaks(empty.select("doc_id", "text"), bench).count() == 0 == decontaminate.leaks(df, bench.where("false")).count()


def test_leaks_with_a_changed_word(spark):
    words = [f"w{k}" for k in range(40)]
    bench = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(f"v{k}" for k in range(40)))], "item_id long, text string")
    around = lambda part: " ".join(["before"] * 200 + part + ["after"] * 200)
    changed = {k: [*words[:at], "other", *words[at + 1 :]] for k, at in enumerate((0, 5, 20, 33, 39))}
    rows = [(k, around(w)) for k, w in changed.items()] + [(10, around(words[:27])), (11, around(words[27:])), (12, around(words[:27] + [f"v{k}" for k in range(27, 40)])), (13, around([w for w in words for _ in (0, 1)]))]
    got = {(r["id"], r["item_id"]) for r in decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == {(k, 1) for k in changed}


def test_block_max_wand_finds_all():
    random.seed(8)
    items = [(k, [f"w{random.randint(0, 80)}".encode() for _ in range(random.randint(3, 30))]) for k in range(100)]
    df = Counter(t for _, w in items for t in set(w))
    index = decontaminate.Index(items, df, len(items), sum(len(w) for _, w in items) / len(items), decontaminate.last_third, 0.3)
    for _ in range(300):
        terms = sorted(random.sample(range(len(index.term)), 25))
        scores = defaultdict(float)
        for t in terms:
            for k, x in index.postings[t]:
                scores[k] += x
        assert sorted(k for k, _ in index.search(terms)) == sorted(k for k, x in scores.items() if x >= 0.3 - 1e-9)
    texts = [b" ".join(random.choice(items)[1] + [b"q"] * 50) for _ in range(20)]
    ids = [np.array([index.term.get(w, -1) for w in decontaminate.words_of(t)], np.int32) for t in texts]
    hit = set(index.passages(ids, 16))
    for k, x in enumerate(ids):
        for w in range(max(-(-len(x) // 16) - 1, 1)):
            part = np.unique(x[w * 16 : (w + 2) * 16])
            if index.search(part[part >= 0].tolist()):
                assert (k, w) in hit


# 9


def test_token_files(spark, docs, empty, own, tmp_path):
    path, pattern = bpe.default_files()
    want = Counter((i, len(own.library.encode_ordinary(t or ""))) for i, t in ROWS)
    for n, (files, block) in enumerate([(1 << 20, 1 << 20), (300, 7), (1, 1)]):
        rows = docs if n < 2 else docs.where("length(text) < 100")
        ordinals = token_counts.write_tokens(rows.select("doc_id", "text"), f"file://{tmp_path}/{n}", path, pattern, file_tokens=files)
        counts = token_counts.count_tokens(ordinals.select("file").distinct(), block_tokens=block)
        got = Counter((r["id"], r["n_tokens"]) for r in ordinals.join(counts, ["file", "ordinal"]).collect())
        assert got == want if n < 2 else all(want[k] for k in got)
    assert token_counts.write_tokens(empty.select("doc_id", "text"), f"file://{tmp_path}/e", path, pattern).count() == 0


@pytest.mark.parametrize("block", [1, 2, 3, 5, 100])
def test_separators_across_blocks(spark, tmp_path, block):
    files = {"a": [9, 1, 1, 9, 9, 1, 1, 1, 1, 1, 9, 2], "b": [1, 2, 3], "c": [], "d": [9], "e": [1, 9]}
    want = set()
    for name, ids in files.items():
        (tmp_path / name).write_bytes(np.array(ids, "<u2").tobytes())
        pieces = "".join("|" if x == 9 else "x" for x in ids).split("|")
        pieces = pieces if pieces[-1] else pieces[:-1]
        want |= {(f"file://{tmp_path}/{name}", k, len(p)) for k, p in enumerate(pieces)}
    names = spark.createDataFrame([(f"file://{tmp_path}/{n}",) for n in files], "file string")
    assert {tuple(r) for r in token_counts.count_tokens(names, separator=9, block_tokens=block).collect()} == want


# 10


def brute_fingerprint(t):
    w = WORD.findall(lower(t))
    if not w:
        return 0
    grams = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    up = list(range(len(fps)))

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                up[find(a)] = find(b)
    return [find(a) for a in range(len(fps))]


def test_fingerprints(docs):
    got = sorted((r["doc_id"] or -1, r["fp"]) for r in simhash.with_fingerprint(docs, "text", "fp").collect())
    assert got == sorted((i or -1, simhash.signed(brute_fingerprint(t))) for i, t in ROWS)


@pytest.mark.parametrize("block", [3, simhash.BLOCK])
def test_components(spark, block):
    """Random fingerprints, a dense group of near copies, chains, and the ends of the range."""
    rng = random.Random(6)
    centre = rng.getrandbits(64)
    fps = {rng.getrandbits(64) for _ in range(300)} | {0, (1 << 64) - 1, 1 << 63}
    for _ in range(150):
        x = centre
        for _ in range(rng.randint(0, 4)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    x = rng.getrandbits(64)
    for k in range(0, 60, 3):
        x ^= 7 << k
        fps.add(x)
    fps = sorted(fps)
    root = brute_components(fps)
    nodes = spark.createDataFrame([(simhash.signed(x),) for x in fps], "fp long")
    edges = simhash.links(nodes, block=block)
    label = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    got = [label.get(simhash.signed(x), simhash.signed(x)) for x in fps]
    assert {frozenset(k for k, r in enumerate(root) if r == a) for a in set(root)} == {frozenset(k for k, r in enumerate(got) if r == a) for a in set(got)}
    assert edges.count() < 4 * len(fps) * (1 if block > 3 else 40)


def test_thresholds_are_allocated_by_cost():
    costs = [[0, 10, 100], [0, 1, 2], [0, 50, 60]]
    best = min(sum(c[u] for c, u in zip(costs, us, strict=True)) for us in np.ndindex(3, 3, 3) if sum(us) == 4)
    cost, t = simhash.allocate(costs, 4)
    assert cost == best and sum(x + 1 for x in t) == 4


def test_near_dedup(docs, empty):
    out = simhash.deduplicate(docs)
    fps = [brute_fingerprint(t) for _, t in ROWS]
    assert out.columns == docs.columns and out.count() == len(set(brute_components(fps)))
    assert simhash.deduplicate(empty).count() == 0
