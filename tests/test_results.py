"""Order of results, JSON text, pieces, folds, expressions, bytes, lists: each against plain Python."""

import asyncio
import datetime as dt
import json
import random
import re
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from strataform.functions import text, values
from strataform.functions.formats import from_javascript
from strataform.operators import collection, sequence, snapshots
from strataform.plans.errors import EngineError
from strataform.plans.ordinal import ordered
from strataform.plans.query import query
from strataform.plans.schema import s
from strataform.sources import codec, jsonio
from strataform.sources.rowset import Rowset


@pytest.fixture
def numbers(spark):
    rows = [(k, (k * 7) % 23, [k, k + 100]) for k in range(60)]
    return ordered(spark.createDataFrame(rows, "id long, v long, xs array<long>").repartition(4, "v"), "id")


def test_results_come_in_order(numbers):
    by_value = sorted(range(60), key=lambda k: ((k * 7) % 23, k))
    o = numbers
    assert [r["id"] for r in query(o).order_by("v").select("id").run(o).collect()] == by_value
    assert [r["id"] for r in query(o).order_by("v", "desc").select("id").run(o).collect()] == sorted(range(60), key=lambda k: (-((k * 7) % 23), k))
    assert [[x["id"] for x in r["items"]] for r in query(o).chunk(7).run(o).collect()] == [list(range(k, min(k + 7, 60))) for k in range(0, 60, 7)]
    assert [[x["id"] for x in r["items"]] for r in query(o).window(3).run(o).collect()] == [[k, k + 1, k + 2] for k in range(58)]
    assert [r["value"] for r in query(o).flat_map("xs").run(o).collect()] == [x for k in range(60) for x in (k, k + 100)]
    assert [r["cur"]["id"] for r in query(o).pairwise().run(o).collect()] == list(range(1, 60))
    assert [r["value"] for r in query(o).scan("sum", "v").run(o).collect()] == np.cumsum([(k * 7) % 23 for k in range(60)]).tolist()
    assert [r["id"] for r in query(o).order_by("v").select("id").take(5).run(o).collect()] == by_value[:5]
    assert [r["id"] for r in query(o).order_by("v").select("id").iterate(o)] == by_value


def test_visits_are_counted_by_results(numbers, tmp_path):
    at = tmp_path / "seen"
    at.mkdir()

    def consume(row):
        (at / str(row["id"])).touch()

    assert query(numbers).filter(lambda p: p.lt("id", 10)).visit(numbers, consume) == 10
    assert sorted(int(x.name) for x in at.iterdir()) == list(range(10))
    assert query(numbers).filter(lambda p: p.lt("id", 0)).visit(numbers, consume) == 0


def test_explain_has_allocations_and_the_plan(numbers):
    q = query(numbers).order_by("v").chunk(2).take(1)
    made = q.explain(numbers)
    assert made["allocations_per_result"] == 1 and made["barriers"] == ["order_by"] and "Physical Plan" in made["plan"]
    assert "plan" not in q.explain() and query(numbers).filter(lambda p: p.lt("id", 1)).explain()["allocations_per_result"] == 0


def test_a_loop_takes_results_one_by_one(numbers):
    async def run():
        out = []
        for row in query(numbers).take(3).iterate(numbers):
            await asyncio.sleep(0)
            out.append(row["id"])
        return out

    assert asyncio.run(run()) == [0, 1, 2]


def test_rowsets_are_released(spark):
    rows = Rowset.load(spark, s.object(id=s.int()), spark.range(5))
    assert rows.query(query(rows.df).count()).first()["count"] == 5 and rows.df.is_cached
    rows.release()
    assert not rows.df.is_cached


# JSON


NUMBERS = {
    0.0005: "0.0005", 12345678.9: "12345678.9", 1e20: "100000000000000000000", 1e21: "1e+21", 1.5e21: "1.5e+21", 123456789012345680000.0: "123456789012345680000", 1e-6: "0.000001", 1e-7: "1e-7", 1.25e-7: "1.25e-7", -0.0: "0", 0.1: "0.1", 0.1 + 0.2: "0.30000000000000004", -1.0: "-1",
    5e-324: "5e-324", 1.7976931348623157e308: "1.7976931348623157e+308", 2.0**53: "9007199254740992", 100.0: "100", 4.35: "4.35", 2e-3: "0.002", 1 / 3: "0.3333333333333333", float("nan"): "null", float("-inf"): "null",
}


def test_numbers_as_javascript_writes_them(spark):
    random.seed(7)
    more = [random.uniform(-1, 1) * 10 ** random.randint(-12, 25) for _ in range(400)]
    df = spark.createDataFrame([(x,) for x in [*NUMBERS, *more]], "x double")
    got = [r[0] for r in df.select(jsonio.number_text(F.col("x"))).collect()]
    assert got[: len(NUMBERS)] == list(NUMBERS.values())
    for x, t in zip(more, got[len(NUMBERS) :], strict=True):
        assert float(t) == x and ("e" in t) == (not 1e-6 <= abs(x) < 1e21)
        assert re.sub(r"e.*|[-.]", "", t).strip("0") == re.sub(r"e.*|[-.]", "", repr(x)).strip("0")


def test_texts_as_javascript_writes_them(spark):
    cases = ["", "plain é 中 😀", 'q"\\/', "\n\r\t\b\f", "\x00\x0b\x1f", "\\u001F", "\\\x1f", "\x7f", " ", None]
    df = spark.createDataFrame([(x,) for x in cases], "x string")
    got = [r[0] for r in df.select(jsonio.quoted(F.col("x"))).collect()]
    assert got == [None if x is None else json.dumps(x, ensure_ascii=False) for x in cases]


def plain_pieces(elements, units):
    size = lambda t: len(t.encode("utf-16-le")) // 2
    piece, out = "[", []
    for k, e in enumerate(elements):
        part = ("," if k else "") + e
        if size(piece) + size(part) > units:
            out.append(piece)
            piece = part
        else:
            piece += part
    return [*out, piece + "]"]


@pytest.mark.parametrize("block", [1, 3, 1 << 18])
@pytest.mark.parametrize("units", [1, 12, 40, 10_000])
def test_pieces_are_packed_greedily(spark, block, units):
    random.seed(units)
    rows = [(k, random.choice(["", "a", "😀😀", "x" * 30, "é"]) * random.randint(0, 3)) for k in range(70)]
    shape = s.object(k=s.int(), t=s.string())
    df = spark.createDataFrame(rows, "k long, t string").repartition(3)
    got = jsonio.chunks(df, shape, "k", units, block).orderBy("chunk").collect()
    want = plain_pieces([json.dumps({"k": k, "t": t}, ensure_ascii=False, separators=(",", ":")) for k, t in rows], units)
    assert [r["text"] for r in got] == want and [r["chunk"] for r in got] == list(range(len(want)))


def test_pieces_of_nothing(spark):
    shape = s.object(k=s.int())
    assert [tuple(r) for r in jsonio.chunks(spark.range(0).toDF("k"), shape, "k").collect()] == [(0, "[]")]
    with pytest.raises(EngineError):
        jsonio.chunks(spark.range(1).toDF("k"), shape, "k", 0)


def test_documents_and_arrays(spark, tmp_path):
    for name, body in {"a": ' \n{"k": 1}', "b": "[1]", "c": '{"k": "x"}', "d": "{", "e": "﻿{\"k\": 2}", "f": ""}.items():
        (tmp_path / f"{name}.json").write_text(body)
    shape = s.object(k=s.int())
    got = {r["file"][-6]: (r["valid"], [x["code"] for x in r["issues"]]) for r in jsonio.read_document(spark, f"{tmp_path}/[a-e].json", shape).collect()}
    assert got == {"a": (True, []), "b": (False, ["expected_object"]), "c": (False, got["c"][1]), "d": (False, ["invalid_json"]), "e": (True, [])} and got["c"][1]
    number = jsonio.read_document(spark, f"{tmp_path}/b.json", s.array(s.number())).collect()
    assert [r["valid"] for r in number] == [True]
    (tmp_path / "many.json").write_text('[{"k": 1}, {"k": null}, {"k": 3}]')
    rows = jsonio.read_array(spark, f"{tmp_path}/many.json", s.array(shape).max(2).min(5)).collect()
    assert sorted((-1 if r["index"] is None else r["index"], [x["path"] + ":" + x["code"] for x in r["issues"]]) for r in rows) == [(-1, [":too_small"]), (0, []), (1, ["[1].k:expected_int"]), (2, [":too_big"])]
    assert [x["code"] for r in jsonio.read_array(spark, f"{tmp_path}/a.json", s.array(shape)).collect() for x in r["issues"]] == ["expected_array"]
    (tmp_path / "more.json").write_text('[{"k": 1}, {"k": 2}, {"k": 3}]')
    with pytest.raises(Exception, match="too_big"):
        jsonio.read_array(spark, f"{tmp_path}/more.json", s.array(shape).max(2), fail_fast=True).collect()


# Folds, masks, expressions


def test_folds_keep_their_types(spark):
    rows = [(0, 2**53, "b", 1.5), (1, 1, "a", 2.5), (2, 1, "c", float("nan"))]
    o = ordered(spark.createDataFrame(rows, "id long, n long, t string, d double"), "id")
    run = lambda fold, field, **k: [r["value"] for r in sequence.scan(o, fold, field, **k).df.orderBy("_o0").collect()]
    assert run("sum", "n") == [2**53, 2**53 + 1, 2**53 + 2] and run("max", "t") == ["b", "b", "c"] and run("min", "t", initial="aa") == ["aa", "a", "a"]
    assert run("count", "n", initial=5) == [6, 7, 8] and run("sum", "d")[:2] == [1.5, 4.0]
    assert sequence.scan(o, "max", "t", carry=("id", "t")).df.columns == ["id", "t", "value", "_o0"]


def test_masked_numbers(spark):
    plain = lambda x: ((2166136261 ^ (int(x) & 0xFFFFFFFF)) * 16777619) & 0xFFFFFFFF
    wholes = [0, 20, -1, 2**31, 2**40 + 3, None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in wholes], "x long").select(text.masked(F.col("x"), "bigint", "hash")).collect()]
    assert got == [None if x is None else plain(x) for x in wholes]
    fractions = [0.5, -1.5, 20.75, 1e10, -1e20, float("nan"), float("inf")]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in fractions], "x double").select(text.masked(F.col("x"), "double", "hash")).collect()]
    assert got == [float(plain(0 if x != x or abs(x) == float("inf") else x)) for x in fractions]
    assert spark.createDataFrame([(20,)], "x int").select(text.masked(F.col("x"), "int", "hash")).first()[0] == plain(20)


@pytest.mark.parametrize(
    ("source", "yes", "no"),
    [
        ("^a$|^b$", ["a", "b"], ["a\n", "xa", "ab"]), (r"^\s+$", [" ", "  ﻿"], ["​", ""]), (r"^[\s,]+$", [", 　"], ["a"]), (r"^[^\s]$", ["a"], [" "]), (r"^\S$", ["a"], [" "]), ("^a.c$", ["abc", "a\u0085c"], ["a\nc", "a c"]),
        (r"^\$[$^]\^$", ["$^^", "$$^"], ["$a^"]), ("^[[&]$", ["[", "&"], ["a"]), ("^[a&&b]$", ["a", "&", "b"], ["c"]), ("^[^]$", ["a", "\n"], [""]), (r"^(?:a|[]|b)$", ["a", "b"], ["", "]"]), ("(^|,)x($|,)", ["x", "a,x", "x,b"], ["xx"]),
    ],
)
def test_expressions_mean_the_same(spark, source, yes, no):
    df = spark.createDataFrame([(x,) for x in [*yes, *no]], "x string")
    assert [r[0] for r in df.select(F.col("x").rlike(from_javascript(source))).collect()] == [True] * len(yes) + [False] * len(no)


# Values, bytes, lists


def test_patches_with_places(spark):
    shape = s.object(a=s.int(), b=s.object(c=s.string(), d=s.string().readonly()))
    run = values.patcher(shape, {"a": values.param("n"), "b": {"c": values.param("t")}})
    row = spark.range(1).select(run(F.struct(F.lit(1).alias("a"), F.struct(F.lit("x").alias("c"), F.lit("y").alias("d")).alias("b")), n=5, t="z").alias("v")).first()["v"]
    assert row["a"] == 5 and row["b"].asDict() == {"c": "z", "d": "y"}
    for wrong in ({"q": 1}, {"b": {"d": values.param("t")}}):
        with pytest.raises(EngineError):
            values.patcher(shape, wrong)
    with pytest.raises(EngineError):
        run(F.col("v"), n=5)


def test_index(spark):
    o = ordered(spark.createDataFrame([(0, "a", 1), (1, "b", 2), (2, "a", 3), (3, None, 4)], "n long, k string, v int"), "n")
    found = collection.looked_up(spark.createDataFrame([("a",), ("c",), (None,)], "k string"), collection.index(o, "k"), "k").collect()
    assert {r["k"]: r["found"] and r["found"]["v"] for r in found} == {"a": 3, "c": None, None: 4}


def test_bytes_by_hand():
    own = codec.Codec(s.object(a=s.int(), b=s.string().optional(), c=s.number().nullable(), d=s.array(s.boolean()), e=s.union(s.object(x=s.int()), s.object(y=s.string()))), 7)
    value = {"a": -2, "b": "é", "c": None, "d": [True, False], "e": {"y": "z"}}
    want = bytes([7, 0b0110]) + struct.pack("<i", -2) + struct.pack("<I", 2) + "é".encode() + struct.pack("<I", 2) + b"\x01\x00" + b"\x01" + struct.pack("<I", 1) + b"z"
    assert own.encode_one(value) == want and own.decode_one(want) == value | {"e": {"x": None, "y": "z"}}
    target = bytearray(len(want) + 3)
    assert own.encode_into(value, target, 2) == len(want) and bytes(target[2 : 2 + len(want)]) == want
    with pytest.raises(EngineError):
        own.encode_into(value, bytearray(3))
    with pytest.raises(EngineError):
        own.encode_one(value | {"e": {"x": "no"}})


def test_columns_are_packed_as_values_are():
    """Batches go field by field, with the bytes and the values that rows have one by one; also slices and no rows."""
    shape = s.object(a=s.int(), b=s.string().optional(), c=s.number().nullable(), d=s.boolean(), e=s.enum("x", "yy"), f=s.date().optional(), g=s.string(), h=s.int().nullish())
    random.seed(1)
    day, kind = dt.datetime(2024, 1, 1, 3, 4, 5, 678000, tzinfo=dt.timezone.utc), to_arrow_schema(shape.spark())
    pick = random.choice
    rows = [{"a": random.randint(-(2**31), 2**31 - 1), "b": pick([None, "", "é中"]), "c": pick([None, 1.5, float("inf")]), "d": pick([True, False]), "e": pick(["x", "yy"]), "f": pick([None, day]), "g": pick(["", "q", "😀"]), "h": pick([None, 7])} for _ in range(300)]
    own = codec.Codec(shape, 9)
    assert codec.columnar(shape) and not codec.columnar(s.object(a=s.array(s.int())))
    for some in (rows, rows[:1], []):
        batch = pa.RecordBatch.from_pylist(some, schema=kind)
        made = codec.encode_columns(shape, 9, batch)
        assert made.to_pylist() == [own.encode_one(r) for r in batch.to_pylist()]
        for part in (slice(0, None), slice(3, 100)):
            at, n = part.start, len(some[part])
            assert codec.decode_columns(shape, 9, made.slice(at, n), kind).to_pylist() == batch.slice(at, n).to_pylist()
            assert codec.encode_columns(shape, 9, batch.slice(at, n)).to_pylist() == made.to_pylist()[part]
    for wrong in ({"a": 2**31}, {"e": "z"}, {"g": None}):
        with pytest.raises(EngineError):
            codec.encode_columns(shape, 9, pa.RecordBatch.from_pylist([rows[0] | wrong], schema=pa.schema([f.with_nullable(True) for f in kind])))
    with pytest.raises(EngineError):
        codec.decode_columns(shape, 8, codec.encode_columns(shape, 9, pa.RecordBatch.from_pylist(rows, schema=kind)), kind)


def test_watched_list_and_callbacks(spark):
    row = lambda *ks: spark.createDataFrame([(k, f"v{k}") for k in ks] or [(0, "")], "k long, v string").where("true" if ks else "false")
    listed = snapshots.WatchedList(ordered(row(1, 2, 3), "k"), "k").add(row(4, 1)).remove(row(2, 4)).add(row(2))
    ids = lambda df: sorted(r["k"] for r in df.collect())
    assert (ids(listed.current), ids(listed.new), ids(listed.removed)) == ([1, 2, 3], [], []) and not listed.is_changed and listed.exists(2) and not listed.exists(4)
    later = row(1, 5).unionByName(spark.createDataFrame([(3, "other")], "k long, v string"))
    listed.update(ordered(later, "k"))
    shot = listed.snapshot()
    assert (ids(shot["current"]), ids(shot["new"]), ids(shot["removed"])) == ([1, 3, 5], [5], [2]) and [r["current"]["v"] for r in shot["updated"].collect()] == ["other"]
    same = snapshots.WatchedList(ordered(row(1, 2, 3), "k"), "k", lambda a, b: a["k"] == b["k"]).update(ordered(later, "k"))
    assert same.changed.isEmpty() and same.is_changed
    calls = []
    w = snapshots.watch(ordered(row(1, 2), "k"), ordered(spark.createDataFrame([(2, "new"), (3, "v3")], "k long, v string"), "k"), "k")
    assert snapshots.tell(w, lambda r: calls.append(("add", r["k"])), lambda r: calls.append(("remove", r["k"])), lambda a, b: calls.append(("update", a["v"], b["v"]))) == 3
    assert calls == [("add", 3), ("remove", 1), ("update", "v2", "new")]


def test_a_store_that_tells_later():
    later, events = [], []
    store = snapshots.Store({"a": 1}, schedule=later.append)
    store.subscribe(events.append)
    store.update(a=2)
    store.update(a=3)
    assert not events and len(later) == 1
    later.pop()()
    assert [(e["previous"], e["value"]) for e in events] == [({"a": 1}, {"a": 3})]
    store.update(a=4)
    store.dispose()
    later.pop()()
    assert len(events) == 1


def test_update_of_a_watched_list(spark):
    """As adding and removing one after the other, null keys too; and each result of a fresh list is one join."""
    row = lambda *ks: spark.createDataFrame([(k, f"v{k}") for k in ks], "k int, v string").coalesce(1)
    listed = snapshots.WatchedList(ordered(row(1, 2, 3, 4, None), "k"), "k").add(row(5, 6, None)).remove(row(1, 2)).update(ordered(row(2, 3, 6, 7, None), "k"))
    assert sorted(r["v"] for r in listed.new.collect()) == ["v6", "v7", "vNone", "vNone"]
    assert sorted(r["v"] for r in listed.removed.collect()) == ["v1", "v4"]
    fresh = snapshots.WatchedList(ordered(row(1, 2, 3), "k"), "k").update(ordered(row(2, 3, 4), "k"))
    for df in (fresh.new, fresh.removed, fresh.changed):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    assert [r["k"] for r in fresh.new.collect()] == [4] and [r["k"] for r in fresh.removed.collect()] == [1] and fresh.changed.isEmpty()


def test_own_fold_sorts_before_its_task(spark):
    """The one task that folds reads parts that lie sorted; it doesn't sort them itself."""
    n = 5000
    rows = spark.range(n).select(F.col("id").alias("k"), F.xxhash64("id").alias("h")).repartition(7, "h")
    made = sequence.fold_in_order(ordered(rows, "k"), 1, lambda state, row: (state * 31 + row["k"]) % 1009, "long")
    assert "Sort" not in made.df._jdf.queryExecution().executedPlan().toString()
    state, want = 1, []
    for k in range(n):
        state = (state * 31 + k) % 1009
        want.append((k, state))
    assert [(r["_o0"], r["value"]) for r in made.df.orderBy("_o0").collect()] == want


def test_short_numbers_need_no_formatting(spark, monkeypatch):
    """Up to 15 digits with an exponent come from Java's own text; the slow way isn't taken for them."""
    monkeypatch.setattr(jsonio.F, "format_string", lambda *_: F.lit("9e+99"))
    random.seed(9)
    cases = [float(f"{random.randrange(1, 10 ** random.randint(1, 15))}e{random.choice([*range(-60, -18), *range(7, 60)])}") for _ in range(300)]
    cases += [1e-7, 0.000171, 1.5e22, 2e23, 1e15, 1e21, 123456789012345e7, 1e300, 9.5e-299]
    rows = spark.createDataFrame([(x,) for x in cases], "x double").select("x", jsonio.number_text(F.col("x")), F.col("x").cast("string")).collect()
    short = [(x, t) for x, t, java in rows if len(java.split("E")[0]) <= 16]  # before 19, Java writes a few (2e23) in more digits
    assert len(short) > len(cases) - 10
    for x, t in short:
        assert float(t) == x and ("e" in t) == (not 1e-6 <= x < 1e21)
        assert re.sub(r"e.*|[-.]", "", t).strip("0") == re.sub(r"e.*|[-.]", "", repr(x)).strip("0")
