"""What the operators' methods promise, held to plain versions that share no code with them."""

import datetime as dt
import hashlib
import itertools
import math
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataform.llm import bpe, exact_dedup, katz, secrets, shared, token_counts, url_filter, warc
from strataform.llm.shared import scratch

from .conftest import ROWS

WORD = re.compile("[^\x20\x09-\x0d]+")

# 1


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda c: F.unhex(F.sha2(F.substring(c, 1, 1), 256))])
@pytest.mark.parametrize("hot", [1000, 0])
def test_two_arrivals_in_one_state(spark, docs, digest, hot, monkeypatch):
    """The second arrival meets the first in the same state; digests that collide across arrivals are told apart."""
    monkeypatch.setattr(shared, "HOT_LEAST", hot)
    home = scratch(spark, "arrivals")
    first = docs.where("doc_id is null or doc_id <= 4")
    exact_dedup.arrive(first, home, digest=digest)
    store, dealt, added = exact_dedup.arrive(docs.where("doc_id > 4"), home, digest=digest)
    by = defaultdict(list)
    for i, t in ROWS:
        by[re.sub("[\x20\x09-\x0d]", "", t or "")].append((-len(t or ""), i is None, i or 0, i))
    texts = {r[added["row"]]: r["text"] for r in store.collect()}
    got = dealt.collect()
    assert len(texts) == len(got) == len(ROWS) and sum(r["kept"] for r in got) == len(by)
    for r in got:
        group = by[re.sub("[\x20\x09-\x0d]", "", texts[r["row"]] or "")]
        assert (r["keep_id"], r["group_size"]) == (min(group)[3], len(group))


def test_bytes_are_read_for_hits_alone(spark):
    """Without a hit no text is compared; with many, both sides are shuffled."""
    rows = [(k, f"text {k // 3 if k % 2 else k}") for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = Counter(t.replace(" ", "") for _, t in rows)
    got = {r["id"]: r["group_size"] for r in exact_dedup.groups(df)[1].collect()}
    assert got == {k: want[t.replace(" ", "")] for k, t in rows}


def test_scratch_is_dropped(spark):
    fs = spark._jvm.org.apache.hadoop.fs.Path(shared.shared_root(spark)).getFileSystem(spark._jsc.hadoopConfiguration())
    there = lambda: {str(x.getPath().getName()) for x in fs.listStatus(spark._jvm.org.apache.hadoop.fs.Path(shared.shared_root(spark)))}
    spark.range(1).write.parquet(scratch(spark, "any"))
    before = there()
    exact_dedup.op1(spark, "/root/testdata/sf0.001").count()
    assert {x.split("-")[1] for x in there() - before} == {"op1"}


# 2


def test_any_number_of_rules_without_tokens(spark):
    """They are tried on every url, in several projections; host rules are told by ends and beginnings."""
    df = spark.createDataFrame([(k, f"http://h{k}.example/{'~' * (k % 7)}") for k in range(30)] + [(99, "http://evilexample/"), (98, "http://EXAMPLE"), (97, "http://x.example.com/")], "page_id long, url string")
    rules = (url_filter.host_rule("example/", "allow"), *(url_filter.pattern_rule(f"odd{k:03}", "/" + "~" * (k % 7) + "$" if k == 6 else "^never$", ()) for k in range(230)))
    got = {r["id"]: (r["rule"], r["verdict"]) for r in url_filter.judged(df, rules=rules[1:]).collect()}
    assert {i for i, (_, v) in got.items() if v == "block"} == {k for k in range(30) if k % 7 == 6}
    hosts = {r["id"]: r["rule"] for r in url_filter.judged(df, rules=rules).collect()}
    assert {i for i, x in hosts.items() if x} == set(range(30))


def test_long_urls_are_judged_whole(spark):
    long = "http://www.example.com/en/" + "a" * 2_000_000
    df = spark.createDataFrame([(1, long), (2, long.replace("www.", "") + "/login"), (3, "x://" + "b." * 500_000 + "net/fr/")], "page_id long, url string")
    assert {(r["id"], r["rule"], r["verdict"], len(r["path"])) for r in url_filter.judged(df).collect()} == {(1, "www.example.com/en/", "allow", 2_000_004), (2, "example.com/en/", "block", 2_000_010), (3, "net/fr/", "block", 4)}


# 3


def plain_segment(part, words):
    """The least cost of one segment that isn't brute force, by the rules of the docstring."""
    size = {"d": 10, "a": 26, "o": 33}
    kind = lambda c: "d" if c.isdigit() else "a" if c.isalpha() else "o"
    low, two = part.lower(), math.log10(2)
    case = 0 if part == low else two if part == part.upper() or part[1:] == low[1:] else two * sum(c.isupper() for c in part)
    costs = []
    if low in words:
        costs.append(math.log10(words.index(low) + 2) + case)
    plain = "".join(dict(zip("01345@$!", "oieasasi", strict=True)).get(c, c) for c in low)
    if low not in words and plain in words:
        costs.append(math.log10(words.index(plain) + 2) + case + math.log10(4))
    digits = re.sub("[-/.]", "", part)
    if len(part) == 4 and part.isdigit() and 1900 <= int(part) <= 2099:
        costs.append(math.log10(120))
    if len(digits) == 8 and digits.isdigit():
        for form in ("%Y%m%d", "%d%m%Y"):
            for seps in itertools.product(["", "-", "/", "."], repeat=2):
                y = digits[:4] if form == "%Y%m%d" else digits[4:]
                m, d = (digits[4:6], digits[6:]) if form == "%Y%m%d" else (digits[2:4], digits[:2])
                made = y + seps[0] + m + seps[1] + d if form == "%Y%m%d" else d + seps[0] + m + seps[1] + y
                if made == part and y[:2] in ("19", "20") and 1 <= int(m) <= 12 and 1 <= int(d) <= 31:
                    costs.append(math.log10(365 * 120) + (0 if part.isdigit() else math.log10(4)))
    for unit in (1, 2, 3, 4):
        times = len(part) // unit
        if len(part) == unit * times and times >= (3 if unit == 1 else 2) and part == part[:unit] * times:
            costs.append(sum(math.log10(size[kind(c)]) for c in part[:unit]) + math.log10(times))
            break
    board = ["1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./"]
    up = dict(zip('!@#$%^&*()_+{}:"<>?', "1234567890-=[];',./", strict=True))
    keys = [up.get(c, c) for c in low]
    at = {c: (y, x) for y, row in enumerate(board) for x, c in enumerate(row)}

    def touch(a, b):
        (y, x), (v, u) = sorted([at[a], at[b]])
        return (v == y and u == x + 1) or (v == y + 1 and u in (x - 1, x))

    if len(part) >= 3 and all(k in at for k in keys) and all(touch(a, b) for a, b in zip(keys, keys[1:], strict=False)):
        straight = lambda a, b, c: at[a][0] == at[b][0] == at[c][0] and at[a][1] + at[c][1] == 2 * at[b][1] and at[a] != at[c]
        turns = sum(keys[k] != keys[k - 2] and not straight(*keys[k - 2 : k + 1]) for k in range(2, len(keys)))
        costs.append(math.log10(40) + math.log10(4) * turns + math.log10(len(part)) + case)
    return min(costs, default=math.inf)


def plain_cost(value, words):
    """Over every way to cut the value up."""
    best = math.inf
    for cuts in itertools.product([False, True], repeat=max(len(value) - 1, 0)):
        edges = [0, *(k + 1 for k, c in enumerate(cuts) if c), len(value)]
        cost = 0.0
        for a, b in zip(edges, edges[1:], strict=False):
            brute = math.log10(10 if value[a].isdigit() else 26 if value[a].isalpha() else 33) if b - a == 1 else math.inf
            cost += min(brute, plain_segment(value[a:b], words) + math.log10(2) * (a > 0))
        best = min(best, cost)
    return best if value else 0.0


def test_guess_costs_against_every_segmentation():
    words = [*secrets.COMMON, "tree", "house", "incorrect"]
    guesses = secrets.Guesses({w: k for k, w in enumerate(words, 1)})
    random.seed(11)
    bits = ["tree", "TREE", "Tree", "h0use", "1999", "20240131", "01-02-2003", "aaa", "abab", "qwe", "Zaq", "!@#", "x", "7", "#", "é", "tre"]
    for _ in range(60):
        value = "".join(random.choice(bits) for _ in range(3))[:11]
        assert guesses.cost(value) == pytest.approx(plain_cost(value, words)), value


def test_long_values_stop_where_the_cost_is_enough():
    guesses = secrets.Guesses(secrets.ranks(["tree"]))
    random.seed(3)
    hard = "".join(random.choice("abcdefghij0123456789") for _ in range(1_000_000))
    began = time.perf_counter()
    assert guesses.cost(hard, secrets.LEAST_COST) >= secrets.LEAST_COST and time.perf_counter() - began < 5
    for value in ("a" * 3000, "ab" * 700, "xK9#vQ2!" + "a" * 200, "tree" * 3 + "q7#Zx9", "a" * 40 + "b" * 40):
        assert (guesses.cost(value) >= 10) == (guesses.cost(value, 10) >= 10), value
    assert guesses.cost("a" * 3000, 10) < 10


def test_planted_passwords(spark):
    """The corpus's own words make a value easy; what a base span covers is judged as well, and base spans stay."""
    rows = [(k, "correcthorse battery staple incorrect " * 5) for k in range(30)] + [(100, "passphrase is correcthorsebattery"), (101, "the password was Incorrect"), (102, "passphrase is qzvxkwjpmgtrbndh"), (103, "passcode is 83920174651029"), (104, "token: x9Kq2LpW8vZr"), (105, "secret = aaaaaaaaaaaa"), (106, None), (107, "")]
    got = {r["id"]: r for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i for i, r in got.items() if "guess" in r["spans"]} == {102, 103, 104}
    assert got[104]["spans"] == "assign:0:19,guess:7:19" and got[104]["n_assign"] == 1
    assert got[104]["base_sha256"] == hashlib.sha256(b"assign:0:19").hexdigest() and got[105]["spans"] == "assign:0:21"
    words = secrets.dictionary(spark.createDataFrame([("The the CAT at",), ("cat dog the",), (None,)], "text string"), "text")
    assert words == ["the", "cat", "dog"]


# 4


def test_gaps_go_to_the_quarantine_table(spark, tmp_path):
    pages = spark.createDataFrame([(k, f"http://a/{k}" + ("x" * 2_000_000 if k == 3 else ""), "<p>" + str(k) * 2000, k) for k in range(8)], "id long, url string, html string, most long")
    manifest = warc.write_archives(warc.decided(pages.repartition(1)), f"file://{tmp_path}/w")
    path = manifest.collect()[0]["file"]
    data = bytearray(open(path[len("file://") :], "rb").read())
    at = [m.start() for m in re.finditer(b"\x1f\x8b\x08", data)]
    data[at[2] + 40] ^= 0xFF
    open(path[len("file://") :], "wb").write(data)
    records = warc.salvaged(manifest.select("file"), f"file://{tmp_path}/gaps")
    gaps = spark.read.parquet(f"file://{tmp_path}/gaps").collect()
    assert records.count() == 7 and [(g["start"], g["end"]) for g in gaps] == [(at[2], at[3])] and gaps[0]["gap"]
    assert max(len(r["uri"]) for r in records.collect()) == 2_000_010


@pytest.mark.parametrize("sent", [200_000, 0])
@pytest.mark.parametrize("hot", [1000, 1])
def test_repeated_payloads_sent_or_shuffled(spark, monkeypatch, sent, hot):
    monkeypatch.setattr(warc, "SENT", sent)
    monkeypatch.setattr(shared, "HOT_LEAST", hot)
    rows = [(1, "u", "a" * 2000), (2, "u", "a" * 2000), (2, "u", "a" * 2000), (3, None, "b" * 10), (4, "u", "b" * 10), (5, "u", None), (None, "u", "a" * 2000), (7, "u", "c" * 1000), (8, "u", "d" * 1500), (9, "u", "d" * 1500)]
    got = Counter((r["id"], r["revisits"], r["refers_to"]) for r in warc.decided(spark.createDataFrame(rows, "id long, url string, html string")).collect())
    assert got == Counter([(1, True, 2), (2, False, None), (2, False, None), (3, False, None), (4, False, None), (5, False, None), (None, True, 2), (7, False, None), (8, True, 9), (9, False, None)])


# 6


def plain_discounts(counts, keep=5):
    of = Counter(counts)
    cut = (keep + 1) * of[keep + 1] / of[1] if of[1] else 0
    out = {}
    for r in range(1, keep + 1):
        d = ((r + 1) * of[r + 1] / of[r] / r - cut) / (1 - cut) if of[r] and cut < 1 else 0
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return lambda c: out.get(c, 1.0)


class PlainKatz:
    """Katz's model over dictionaries."""

    def __init__(self, texts, order):
        self.order, self.count = order, [Counter() for _ in range(order + 1)]
        for w in texts:
            padded = [" "] * (order - 1) + w
            for k in range(1, order + 1):
                self.count[k].update(tuple(padded[i - k + 1 : i + 1]) for i in range(order - 1, len(padded)))
        self.n, self.v = sum(self.count[1].values()), len(self.count[1])
        self.discount = {k: plain_discounts(self.count[k].values()) for k in range(2, order + 1)}
        self.after = [defaultdict(dict) for _ in range(order + 1)]
        for k in range(2, order + 1):
            for g, c in self.count[k].items():
                self.after[k][g[:-1]][g[-1]] = c

    def p(self, context, w):
        k = len(context) + 1
        if k == 1:
            return (self.count[1][w,] + 1) / (self.n + self.v + 1)
        seen = self.after[k][context] if context in self.after[k] else {}
        if not seen:
            return self.p(context[1:], w)
        whole = sum(seen.values())
        kept = {x: self.discount[k](c) * c / whole for x, c in seen.items()}
        if 1 - sum(kept.values()) <= 1e-9:
            kept = {x: (c - 0.5) / whole for x, c in seen.items()}
        if w in kept:
            return kept[w]
        return (1 - sum(kept.values())) / (1 - sum(self.p(context[1:], x) for x in seen)) * self.p(context[1:], w)


@pytest.mark.parametrize(("order", "hot", "slice_grams", "chunk"), [(3, 10**9, 1 << 20, 1 << 23), (3, 40, 60, 200), (4, 60, 100, 500), (2, 40, 60, 200)])
def test_katz_of_any_order(spark, monkeypatch, order, hot, slice_grams, chunk):
    """Also with hot tokens, many slices and many chunks."""
    monkeypatch.setattr(katz, "HOT", hot)
    monkeypatch.setattr(katz, "SLICE_GRAMS", slice_grams)
    monkeypatch.setattr(katz, "CHUNK_BYTES", chunk)
    random.seed(2)
    rows = [(k, k % 5 != 0, " ".join(random.choice(["the", "The", "cat", "sat", "on", "é", f"w{random.randint(0, 30)}"]) for _ in range(random.randint(0, 40)))) for k in range(80)] + [(100, False, None), (None, True, "the cat"), (7, True, "the the"), (101, True, "rare words once " * 30)]
    toks = [WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [" "] for _, _, t in rows]
    model = PlainKatz([w for w, (_, train, _) in zip(toks, rows, strict=True) if train], order)
    score = lambda w: sum(math.log10(model.p(tuple(([" "] * (order - 1) + w)[i : i + order - 1]), x)) for i, x in enumerate(w))
    want = Counter((i, not t, len(w), round(score(w), 6)) for (i, t, _), w in zip(rows, toks, strict=True))
    got = katz.scored(spark.createDataFrame(rows, "id long, trained boolean, text string").repartition(3), order)[0].collect()
    assert Counter((r["id"], r["held_out"], r["n_tokens"], round(r["score"], 6)) for r in got) == want
    for context in [("the",), (" ",), ("w1",), ("the", "cat"), ("é", "nothing"), ("sat", "on", "the")]:
        if len(context) < order:
            assert sum(model.p(context, w) for (w,) in model.count[1]) + model.p(context, "unseen") == pytest.approx(1)


def test_katz_ids_of_other_types_and_long_texts(spark):
    day = dt.date(2024, 2, 29)
    rows = [(day, True, "a b c " * 200_000), (None, False, "a b d"), (day, True, "a")]
    got = katz.scored(spark.createDataFrame(rows, "id date, trained boolean, text string"), 3)[0].collect()
    assert sorted((str(r["id"]), r["n_tokens"]) for r in got) == [("2024-02-29", 2), ("2024-02-29", 600_001), ("None", 4)]


def least_seconds(run):
    def once():
        began = time.process_time()
        run()
        return time.process_time() - began

    return min(once() for _ in range(5))


def test_katz_groups_by_one_sort():
    """Grouping n-grams takes less than half of sorting them by column after column, and wide columns group like others."""
    rng = np.random.default_rng(1)
    columns = [rng.integers(0, 1 << 20, 500_000) for _ in range(3)]
    assert 2 * least_seconds(lambda: katz.grouped(columns)) < least_seconds(lambda: np.lexsort(columns[::-1]))
    for most in (3, 1 << 21, 1 << 40, 1 << 62):
        values = rng.integers(0, most, 7)
        rows = list(zip(*(rng.choice(values, 300).tolist() for _ in range(4)), strict=True))
        for given in (rows, sorted(rows), rows[:1], []):
            ids, first = katz.grouped([np.array([x[k] for x in given], np.int64) for k in range(4)])
            own = sorted(set(given))
            assert [own[k] for k in ids] == given and [given[k] for k in first] == own


def test_katz_numbers_words_without_an_object_for_each():
    """Reading a chunk takes less than four fifths of looking up each of its words in a dictionary, and finds the same."""
    random.seed(3)
    words = [f"Word{int(random.paretovariate(0.5)) % 100_000}" for _ in range(400_000)]
    texts = [" ".join(words[k : k + 1000]).encode() for k in range(0, len(words), 1000)]
    trained = [k % 7 != 2 for k in range(len(texts))]

    def looked_up():
        seen = {}
        return [[seen.setdefault(w, len(seen)) for w in t.lower().split()] for t in texts]

    assert 1.25 * least_seconds(lambda: katz.read_chunk(texts, trained, 8)) < least_seconds(looked_up)
    for texts in (texts[:5], [b""], [b" \t"], [b" A b\x1ca\xc2\xa0 \x0bB\x0c", b"", b"\xc3\x89 \xc3\xa9\r\n", b"b", b""], [b"", b"the THE"]):
        seen, ids, lengths = katz.numbered(texts)
        want = [[w.lower() for w in re.split(rb"[\x20\x09-\x0D]+", t) if w] + [katz.END] for t in texts]
        assert len(set(seen)) == len(seen) and [seen[k] for k in ids] == [w for t in want for w in t] and lengths.tolist() == [len(t) for t in want]


# 7


@pytest.fixture(scope="module")
def own():
    path, pattern = bpe.default_files()
    return bpe.Codec(bpe.vocabulary(path), pattern)


def test_joints_inside_long_matches(own, monkeypatch):
    """Tokens are joined where matches are long; all leaves from one character on give the library's tokens."""
    monkeypatch.setattr(bpe, "SHORT", 2)
    random.seed(4)
    for _ in range(250):
        letters = random.choice(["ab", "abcdefghijklmnopqrstuvwxyz", "12", "!?-", " ", "the ", "é中a", "aA"])
        t = "".join("".join(random.choice(letters) for _ in range(random.randint(1, 80))) + random.choice(["", " ", "\n", "x"]) for _ in range(3))
        for leaf in (1, 2, 3, 8, 16):
            assert own.encode(t, leaf).tolist() == own.library.encode_ordinary(t), (t, leaf)


def test_the_default_pattern_ends_words_before_spaces(own):
    """What ``word_end`` relies on: a match never holds a letter with a space behind it."""
    assert own.spaced
    random.seed(9)
    for _ in range(300):
        t = "".join(random.choice("aZ 's\n1!é") for _ in range(40))
        begins = {m.start() for m in own.pattern.finditer(t)}
        assert all(k in begins for k in range(1, len(t)) if t[k] == " " and t[k - 1] in bpe.LETTERS)


def test_one_long_word(own):
    random.seed(5)
    t = "".join(random.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1 << 19))
    assert own.encode(t).tolist() == own.library.encode_ordinary(t)
    assert own.decode(own.encode(t, 100), 7).decode() == t


# 9


def test_separators_that_the_vocabulary_has_are_refused(spark, docs, tmp_path):
    path, pattern = bpe.default_files()
    last = max(int(x.split()[1]) for x in open(path, "rb").read().splitlines())
    assert token_counts.layout(bpe.vocabulary(path)) == (last + 1, 2)
    assert token_counts.layout(b"\n".join(b"YQ== %d" % k for k in (0, 65535))) == (65536, 4)
    for wrong in ({"separator": last}, {"separator": 70_000, "width": 2}):
        with pytest.raises(ValueError, match="separator"):
            token_counts.write_tokens(docs.select("doc_id", "text"), f"file://{tmp_path}/x", path, pattern, **wrong)
    wide = token_counts.write_tokens(docs.select("doc_id", "text"), f"file://{tmp_path}/wide", path, pattern, separator=1 << 20)
    counts = token_counts.count_tokens(wide.select("file").distinct(), 1 << 20, 4, block_tokens=50)
    own = bpe.Codec(bpe.vocabulary(path), pattern).library
    got = Counter((r["id"], r["n_tokens"]) for r in wide.join(counts, ["file", "ordinal"]).collect())
    assert got == Counter((i, len(own.encode_ordinary(t or ""))) for i, t in ROWS)


def test_no_checkpoint_folder_on_a_cluster():
    class Context:
        master = "spark://elsewhere:7077"

        def getConf(self):  # noqa: N802
            return {}

        def getCheckpointDir(self):  # noqa: N802
            return None

    class Session:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})()
        sparkContext = Context()  # noqa: N815

    with pytest.raises(RuntimeError, match="checkpoint"):
        shared.shared_root(Session())


# Pipeline


def test_every_stage_takes_awkward_rows(spark, docs, empty):
    """Nulls, empty and long texts, ties, repeated rows and clashing columns; and no rows at all."""
    import corpus_pipeline

    at = "/root/testdata/sf0.001"
    for name, stage in corpus_pipeline.STAGES:
        out, none = stage(spark, docs, at), stage(spark, empty, at)
        kept = out.collect()
        assert none.count() == 0 and len(kept) <= len(ROWS), name
        if name != "encode":
            assert out.columns == docs.columns, name
            assert all((r["doc_id"], r["text"]) in ROWS for r in kept), name
    assert len(kept) == len(ROWS)


def test_the_run_leaves_its_result_alone(spark):
    import corpus_pipeline

    fs = spark._jvm.org.apache.hadoop.fs.Path(shared.shared_root(spark)).getFileSystem(spark._jsc.hadoopConfiguration())
    there = lambda: {str(x.getPath().getName()) for x in fs.listStatus(spark._jvm.org.apache.hadoop.fs.Path(shared.shared_root(spark)))}
    spark.range(1).write.parquet(scratch(spark, "any"))
    before = there()
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
    assert {x.rsplit("-", 1)[0] for x in there() - before} == {"strataform-stage-encode"}
