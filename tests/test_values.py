import datetime as dt
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from strataform.functions import text, validate, values
from strataform.functions.formats import FORMATS, anchored, source_of
from strataform.operators import mapping, snapshots
from strataform.operators.model import model
from strataform.plans.errors import EngineError
from strataform.plans.ordinal import ordered
from strataform.plans.schema import s
from strataform.sources import jsonio
from strataform.sources.codec import Codec
from strataform.sources.rowset import Rowset
from strataform.plans.query import query

USER = s.object(id=s.int().positive(), name=s.string().trim().min(2).max(64), email=s.string().email(), tags=s.array(s.string().min(1)).max(3), profile=s.object(age=s.number().min(0).max(150)).optional())
DDL = "id long, name string, email string, tags array<string>, profile struct<age: double>"


def issues(df, schema):
    return [[(i["path"], i["code"]) for i in r["issues"]] for r in validate.safe_parse(df, schema).collect()]


def test_every_issue_with_its_path(spark):
    df = spark.createDataFrame([(1, " Ada ", "ada@x.org", ["a", "b"], (3.0,)), (0, "x", "bad", ["", "b", "c", "d"], (200.0,)), (2, None, "a@b.co", [], None)], DDL)
    good, bad, absent = validate.safe_parse(df, USER).collect()
    assert good["valid"] and good["data"]["name"] == "Ada"
    assert [(i["path"], i["code"]) for i in bad["issues"]] == [("id", "too_small"), ("name", "too_small"), ("email", "invalid_email"), ("tags", "too_big"), ("tags[0]", "too_small"), ("profile.age", "too_big")]
    assert [(i["path"], i["code"]) for i in absent["issues"]] == [("name", "expected_string")]
    ok, rejected = validate.quarantine(df, USER)
    assert ok.count() == 1 and rejected.count() == 2
    with pytest.raises(Exception, match="VALIDATION_FAILED"):
        validate.parse(df, USER).collect()


def test_formats(spark):
    cases = {
        "email": (["a@b.co", "a.b+c@d-e.org"], ["a@b", ".a@b.co", "a..b@c.org", "a@b.co\n"]), "ipv4": (["1.2.3.4", "255.255.255.255"], ["256.1.1.1", "1.2.3"]), "ipv6": (["::", "::1", "1:2:3:4:5:6:7:8", "fe80::1"], ["1::2::3", "12345::", ":1"]),
        "iso_date": (["2024-02-29", "2023-12-31"], ["2023-02-29", "2023-13-01"]), "duration": (["P1D", "PT1H", "P2W"], ["P", "PT", "P1W1D"]), "base64": (["", "YQ==", "YWJj"], ["YQ=", "Y"]), "hostname": (["a.b", "localhost"], ["-a", "a..b"]),
        "e164": (["+12345678"], ["12345678", "+0123456789"]), "jwt": (["a.b.c"], ["a.b"]), "ulid": (["01ARZ3NDEKTSV4RRFFQ69G5FAV"], ["01ARZ3NDEKTSV4RRFFQ69G5FAI"]), "cidrv4": (["1.2.3.4/8"], ["1.2.3.4/33"]), "url": (["https://a.b/c", "mailto:x@y"], ["a.b", "https://"]), "emoji": (["😀", "👍🏽"], ["a", ""]),
    }
    for name, (good, bad) in cases.items():
        df = spark.createDataFrame([(x, True) for x in good] + [(x, False) for x in bad], "x string, want boolean")
        assert df.where(F.col("x").rlike(anchored(FORMATS[name])) != F.col("want")).collect() == [], name
    one = spark.createDataFrame([("123e4567-e89b-42d3-a456-426614174000", "12:30:59.123", "2024-01-01T10:00:00Z", "aa:bb:cc:dd:ee:ff", "d" * 64)], "u string, t string, d string, m string, h string")
    row = one.select(F.col("u").rlike(source_of("uuid", (4,), {})), F.col("u").rlike(source_of("uuid", (7,), {})), F.col("t").rlike(source_of("time", (), {"precision": 3})), F.col("d").rlike(source_of("datetime", (), {})), F.col("m").rlike(source_of("mac", (), {})), F.col("h").rlike(source_of("digest", ("sha256",), {}))).first()
    assert list(row) == [True, False, True, True, True, True]


def test_numbers_unions_and_refinements(spark):
    nan = float("nan")
    df = spark.createDataFrame([(nan,), (1.5,), (float("inf"),), (-1.0,)], "x double")
    assert [len(i) for i in issues(df, s.object(x=s.number().min(0)))] == [0, 0, 0, 1]
    assert [len(i) for i in issues(df, s.object(x=s.number().finite()))] == [1, 0, 1, 0]
    assert [len(i) for i in issues(df, s.object(x=s.int()))] == [1, 1, 1, 0]
    u = spark.createDataFrame([("a", 1, 5), ("b", 9, 3)], "kind string, low int, high int")
    either = s.discriminated_union("kind", s.object(kind=s.literal("a"), low=s.int().max(3)), s.object(kind=s.literal("b"), low=s.int().max(3)))
    assert [r["valid"] for r in validate.safe_parse(u, either).collect()] == [True, False]
    ordered_pair = s.object(low=s.int(), high=s.int()).refine(lambda c: c["low"] <= c["high"], "low above high", "high")
    assert issues(u.drop("kind"), ordered_pair) == [[], [("high", "custom")]]
    assert issues(u.select("low"), s.object(low=s.union(s.literal(1), s.int().min(10)))) == [[], [("low", "invalid_union")]]
    assert issues(u.select("low"), s.object(low=s.not_(s.literal(1)))) == [[("low", "invalid_not")], []]
    assert issues(u, s.object(low=s.int()).strict()) == [[("kind", "unrecognized_key"), ("high", "unrecognized_key")]] * 2
    d = spark.createDataFrame([(None,), ("x",)], "v string")
    assert [r["data"]["v"] for r in validate.safe_parse(d, s.object(v=s.string().default("none"))).collect()] == ["none", "x"]


def test_utf16_lengths_trim_and_masks(spark):
    df = spark.createDataFrame([("😀a", " \t x  ", "12345678901", "abc")], "a string, b string, c string, d string")
    row = df.select(text.utf16_length(F.col("a")), text.trimmed(F.col("b")), text.masked_format(F.col("c"), text.CPF), text.masked_format(F.col("c"), text.CNPJ), text.phone_br(F.col("c")), text.masked(F.col("d"), "string", "hash"), text.unicode_normal(F.lit("é"))).first()
    assert list(row) == [3, "x", "123.456.789-01", None, "(12) 34567-8901", "1a47e90b", "é"]


def test_sanitising(spark):
    df = spark.createDataFrame([("<script>bad()</script><b>Hello</b>", '<b onclick="bad()">Hello</b><img src=x>', "users.name; DROP", "../a:b")], "a string, b string, c string, d string")
    row = df.select(text.sanitized(F.col("a")), text.sanitized(F.col("b"), html=["b"]), text.sanitized(F.col("c"), "sqlIdentifier"), text.sanitized(F.col("d"), "pathSegment"), text.sanitized(F.lit(" <a> "), "htmlEscape", trim=True, max_length=4)).first()
    assert list(row) == ["Hello", "<b>Hello</b>", "users_name_DROP", "__a_b", "&lt;"]
    with pytest.raises(EngineError):
        text.sanitized(F.col("a"), html=["script"])


def test_equal_diff_hash_merge_patch(spark):
    shape = s.object(id=s.int(), x=s.number(), tags=s.array(s.string()), note=s.string().optional())
    nan = float("nan")
    rows = [((1, nan, ["a", "b"], None), (1, nan, ["a", "b"], None)), ((1, 1.0, ["a", "b"], "n"), (1, 2.0, ["a", "c", "d"], None))]
    df = spark.createDataFrame(rows, "a struct<id: long, x: double, tags: array<string>, note: string>, b struct<id: long, x: double, tags: array<string>, note: string>")
    a, b = F.col("a"), F.col("b")
    assert [r[0] for r in df.select(values.equal(shape, a, b)).collect()] == [True, False]
    found = [[(c["type"], c["path"], c["value"]) for c in r[0]] for r in df.select(values.diff(shape, a, b)).collect()]
    assert found == [[], [("update", "x", "2.0"), ("update", "tags[1]", "c"), ("add", "tags[2]", "d"), ("update", "note", None)]]
    assert df.select(values.hash31(s.string(), F.lit("hello"))).first()[0] == 99162322
    merged = df.select(values.merge(shape, a, b).alias("m")).collect()[1]["m"]
    assert (merged["x"], merged["note"]) == (2.0, "n")
    assert df.select(values.patch(shape, a, {"x": 7.0, "tags": {0: "z"}}).alias("p")).first()["p"]["tags"] == ["z", "b"]
    with pytest.raises(EngineError):
        values.patch(shape.readonly(), a, {})
    with pytest.raises(EngineError):
        values.equal(s.set(s.int()), a, b)


def test_mapping(spark):
    source = s.object(id=s.int(), name=s.string(), extra=s.string().optional())
    df = spark.createDataFrame([(1, "Ada", None)], "id long, name string, extra string")
    target = s.object(key=s.int(), name=s.string(), loud=s.string(), kind=s.string())
    out = mapping.map_rows(df, source, target, {"key": mapping.From("id"), "loud": lambda c: F.upper(c["name"]), "kind": mapping.Default("person")})
    assert [tuple(r) for r in out.collect()] == [(1, "Ada", "ADA", "person")]
    for wrong in (s.object(nothing=s.int()), s.object(extra=s.string())):
        with pytest.raises(EngineError):
            mapping.map_rows(df, source, wrong)


def test_json(spark, tmp_path):
    shape = s.object(id=s.int(), x=s.number(), note=s.string().optional(), gone=s.string().nullable(), at=s.date())
    when = dt.datetime(2024, 1, 2, 3, 4, 5, 678000)
    df = spark.createDataFrame([(1, 1.0, None, None, when), (2, 0.1, 'a"\n', "g", when), (3, float("nan"), "é", None, when), (4, 1e300, "", "", when)], "id long, x double, note string, gone string, at timestamp")
    got = [r[0] for r in df.select(jsonio.stringified(shape, F.struct(*df.columns))).collect()]
    assert got[0] == '{"id":1,"x":1,"gone":null,"at":"2024-01-02T03:04:05.678Z"}'
    assert json.loads(got[1]) == {"id": 2, "x": 0.1, "note": 'a"\n', "gone": "g", "at": "2024-01-02T03:04:05.678Z"}
    assert json.loads(got[2])["x"] is None and json.loads(got[3])["x"] == 1e300
    short = s.object(id=s.int(), note=s.string())
    many = spark.range(500).select("id", F.concat(F.lit("n"), F.col("id").cast("string")).alias("note"))
    parts = jsonio.chunks(many, short, "id", 1000).orderBy("chunk").collect()
    assert len(parts) > 5 and [x["id"] for x in json.loads("".join(r["text"] for r in parts))] == list(range(500))
    (tmp_path / "a.ndjson").write_text('{"id": 1, "note": "a"}\n\nnot json\n{"id": 2}\n')
    lines = {r["line"]: (r["valid"], [(i["path"], i["code"]) for i in r["issues"]]) for r in jsonio.read_lines(spark, str(tmp_path / "a.ndjson"), short).collect()}
    assert lines == {0: (True, []), 2: (False, [("line 2", "invalid_json")]), 3: (False, [("line 3.note", "expected_string")])}
    (tmp_path / "b.json").write_text('[{"id": 1, "note": "a"}, {"id": "x"}]')
    assert [(r["index"], r["valid"]) for r in jsonio.read_array(spark, str(tmp_path / "b.json"), short).orderBy("index").collect()] == [(0, True), (1, False)]


def test_codec_round_trip(spark):
    shape = s.object(id=s.int(), big=s.bigint(), name=s.string().optional(), role=s.enum("a", "b"), ok=s.boolean(), at=s.date(), tags=s.array(s.string()), more=s.record(s.number()), at_home=s.object(x=s.number().nullable()))
    when = dt.datetime(2024, 1, 2, 3, 4, 5, 678000)
    df = spark.createDataFrame([(1, Decimal(2**40), None, "b", True, when, ["x", "é"], {"k": 1.5}, (None,)), (-5, Decimal(-1), "n", "a", False, when, [], {}, (2.0,))], "id long, big decimal(38,0), name string, role string, ok boolean, at timestamp, tags array<string>, more map<string,double>, at_home struct<x: double>")
    c = Codec(shape, version=3)
    assert sorted(map(str, c.decode(c.encode(df)).collect())) == sorted(map(str, df.collect()))
    with pytest.raises(EngineError):
        Codec(c.schema, 4).decode_one(c.encode(df).first()[0])


def test_snapshots(spark):
    make = lambda rows: ordered(spark.createDataFrame(rows, "id int, x string"), "id")
    w = snapshots.watch(make([(1, "a"), (2, "b"), (3, "c")]), make([(2, "b"), (3, "C"), (4, "d")]), "id")
    assert ([r["id"] for r in w.new.collect()], [r["id"] for r in w.removed.collect()], [r["current"]["x"] for r in w.updated.collect()], w.is_changed) == ([4], [1], ["C"], True)
    log = ordered(spark.createDataFrame([(1, "remove", 1, "a"), (2, "add", 1, "a"), (3, "add", 9, "z"), (4, "remove", 9, "z"), (5, "remove", 2, "b")], "n int, op string, id int, x string"), "n")
    current, new, removed = snapshots.replay(make([(1, "a"), (2, "b")]), log.put(log.df.drop("n")), "id")
    assert ([r["id"] for r in current.collect()], new.count(), [r["id"] for r in removed.collect()]) == ([1], 0, [2])
    told = []
    store = snapshots.Store({"score": 1, "active": True})
    store.subscribe(told.append)
    store.batch(lambda: (store.update(score=2), store.update(active=False)))
    assert len(told) == 1 and told[0]["version"] == 2 and len(told[0]["changes"]) == 2


def test_rowset(spark):
    shape = s.object(id=s.int(), x=s.number().nullable())
    rows = Rowset.load(spark, shape, [{"id": 1, "x": 1.0}, {"id": 2, "x": None}])
    assert rows.query(query(rows.df).sum("x")).first()[0] == 1.0 and rows.hydrate(1)[0]["id"] == 1
    rows.release()


def test_model(spark):
    shape = s.object(id=s.int(), name=s.string().pii("mask")).hint("index_by", "id")
    m = model(shape)
    o = ordered(spark.createDataFrame([(1, 1, "Ada"), (2, 2, "Grace Hopper"), (3, 1, "Ada v2")], "at int, id long, name string"), "at")
    assert sorted(r["name"] for r in m.unique_by(o).frame.collect()) == ["Ada", "Grace Hopper"]
    assert sorted(r["name"] for r in m.normalize(o)[0].collect()) == ["Ada v2", "Grace Hopper"]
    assert [r["at"] for r in m.sort_by(o, "name", "desc").df.orderBy("_o0", "_o1").collect()] == [2, 3, 1]
    row = F.struct("id", "name")
    got = o.df.orderBy("at").select(m.mask(row).alias("m"), m.update(row, {"name": "x"}).alias("u"), m.update(row, lambda d: setattr(d, "id", 9)).alias("d"), m.equal(row, m.clone(row)).alias("e")).collect()
    assert [(r["m"]["name"], r["u"]["name"], r["d"]["id"], r["e"]) for r in got][1] == ("***pper", "x", 9, True)
    assert m.query().filter(lambda p: p.gt("id", 1)).count().run(o).first()[0] == 1
    assert m.hash is m.hash
    for wrong in (lambda: m.sort_by(o), lambda: m.group_by(o, "none"), lambda: model(shape, "hash").equal(row, row), lambda: model(shape, "fly")):
        with pytest.raises(EngineError):
            wrong()
    with pytest.raises(AttributeError):
        m.fly  # noqa: B018


def test_lines_of_a_split_file(spark, tmp_path):
    (tmp_path / "many.ndjson").write_text("".join(f'{{"id": {k}}}\n' for k in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "64")
    try:
        got = jsonio.read_lines(spark, str(tmp_path / "many.ndjson"), s.object(id=s.int())).select("line", "data.id").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(map(tuple, got)) == [(k, k) for k in range(3000)]
