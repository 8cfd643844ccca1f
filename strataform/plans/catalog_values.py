"""Named queries for values, JSON, codecs, order, snapshots and streams, each with the same in DuckDB's SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, values
from ..operators import collection, mapping, sequence, snapshots
from ..operators.model import model
from ..sources import codec, jsonio
from ..sources.rowset import Rowset
from ..streaming import stream
from .catalog import load, named
from .ordinal import checkpointed, numbered, ordered
from .query import query
from .schema import s

ORDER = s.object(o_orderkey=s.int(), o_orderstatus=s.string(), o_totalprice=s.number())


def orders(spark, d) -> DataFrame:
    return load(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")


# Whole values


@named("equal_keyed", "select o_orderkey, o_orderkey % 3 <> 0 as same from orders")
def equal_keyed(spark, d):
    """Arrays by key, whatever their order; every third has another value."""
    item = s.object(k=s.int(), v=s.number())
    pair = lambda k, v: F.struct(F.lit(k).cast("long").alias("k"), v.alias("v"))
    a = F.array(pair(1, F.col("o_totalprice")), pair(2, F.lit(0.5)))
    b = F.array(pair(2, F.lit(0.5)), pair(1, F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))))
    return orders(spark, d).select("o_orderkey", values.equal(s.array(item).hint("keyed", "k"), a, b).alias("same"))


@named("equal_sorted", "select o_orderkey, o_orderkey % 3 <> 0 as same from orders")
def equal_sorted(spark, d):
    """Arrays that a hint says are sorted by a key."""
    item = s.object(k=s.int(), v=s.number())
    pair = lambda k, v: F.struct(F.lit(k).cast("long").alias("k"), v.alias("v"))
    a = F.array(pair(1, F.col("o_totalprice")), pair(2, F.lit(0.5)))
    b = F.array(pair(1, F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))), pair(2, F.lit(0.5)))
    return orders(spark, d).select("o_orderkey", values.equal(s.array(item).hint("ordered", "k"), a, b).alias("same"))


@named("clone_values", "select o_orderkey, o_orderstatus, o_totalprice from orders")
def clone_values(spark, d):
    return orders(spark, d).select(model(ORDER, "clone").clone(F.struct("o_orderkey", "o_orderstatus", "o_totalprice")).alias("c")).select("c.*")


@named("diff_arrays", """select o_orderkey, case o_orderkey % 3 when 0 then ['update:xs[1]=9', 'add:xs[2]=7'] when 1 then ['remove:xs[1]'] else [] end as changes from orders""")
def diff_arrays(spark, d):
    """By place: a changed and an added element, a removed one, or none."""
    key = F.col("o_orderkey")
    of = lambda *x: F.array(*[F.lit(v).cast("long") for v in x])
    a, b = F.struct(of(1, 2).alias("xs")), F.struct(F.when(key % 3 == 0, of(1, 9, 7)).when(key % 3 == 1, of(1)).otherwise(of(1, 2)).alias("xs"))
    found = values.diff(s.object(xs=s.array(s.int())), a, b)
    return orders(spark, d).select("o_orderkey", F.transform(found, lambda x: F.concat(x["type"], F.lit(":"), x["path"], F.coalesce(F.concat(F.lit("="), x["value"]), F.lit("")))).alias("changes"))


@named("diff_records", """select o_orderkey, case o_orderkey % 2 when 0 then ['update:r.a', 'remove:r.b', 'add:r.c', 'update:in.x'] else [] end as changes from orders""")
def diff_records(spark, d):
    even = F.col("o_orderkey") % 2 == 0
    was = F.create_map(F.lit("a"), F.lit(1.0), F.lit("b"), F.lit(2.0))
    now = F.when(even, F.create_map(F.lit("a"), F.lit(5.0), F.lit("c"), F.lit(3.0))).otherwise(was)
    shape = s.object(r=s.record(s.number()), **{"in": s.object(x=s.string().optional())})
    a, b = F.struct(was.alias("r"), F.struct(F.lit("x").alias("x")).alias("in")), F.struct(now.alias("r"), F.struct(F.when(~even, "x").alias("x")).alias("in"))
    return orders(spark, d).select("o_orderkey", F.transform(values.diff(shape, a, b), lambda x: F.concat(x["type"], F.lit(":"), x["path"])).alias("changes"))


HASH_SQL = "cast(case when h >= 2147483648 then h - 4294967296 else h end as integer)"


@named("hash_texts", f"select c_custkey, {HASH_SQL} as h from (select c_custkey, list_reduce(list_prepend(0::bigint, list_transform(string_split(c_name || 'é中', ''), lambda c: unicode(c)::bigint)), lambda h, c: (h * 31 + c) & 4294967295) as h from customer)")
def hash_texts(spark, d):
    return load(spark, d, "customer").select("c_custkey", values.hash31(s.string(), F.concat("c_name", F.lit("é中"))).alias("h"))


@named("hash_numbers", f"select c_custkey, {HASH_SQL} as h from (select c_custkey, ((23 * 31 + (cast(trunc(c_acctbal) as bigint) & 4294967295)) * 31 + (case when c_custkey % 2 = 0 then 1 else c_nationkey end)) & 4294967295 as h from customer)")
def hash_numbers(spark, d):
    """Fractions lose what stands behind the point; a null that must be there counts as 1."""
    shape = s.object(c_acctbal=s.number(), n=s.int())
    n = F.when(F.col("c_custkey") % 2 == 1, F.col("c_nationkey").cast("long"))
    return load(spark, d, "customer").select("c_custkey", values.hash31(shape, F.struct(F.col("c_acctbal"), n.alias("n"))).alias("h"))


@named("mask_numbers", "select c_custkey, cast((xor(2166136261::bigint, c_custkey) * 16777619) & 4294967295 as bigint) as whole, cast((xor(2166136261::bigint, cast(trunc(c_acctbal) as bigint) & 4294967295) * 16777619) & 4294967295 as double) as fraction from customer")
def mask_numbers(spark, d):
    return load(spark, d, "customer").select("c_custkey", text.masked(F.col("c_custkey"), "bigint", "hash").alias("whole"), text.masked(F.col("c_acctbal"), "double", "hash").alias("fraction"))


@named("mask_texts", "select c_custkey, lower(printf('%x', list_reduce(list_prepend(2166136261::bigint, list_transform(string_split(c_name || 'é中', ''), lambda c: unicode(c)::bigint)), lambda h, c: (xor(h, c) * 16777619) & 4294967295))) as h from customer")
def mask_texts(spark, d):
    return load(spark, d, "customer").select("c_custkey", text.masked(F.concat("c_name", F.lit("é中")), "string", "hash").alias("h"))


@named("patch_params", "select o_orderkey, case when o_orderkey % 2 = 0 then 'even' else 'odd' end as o_orderstatus, o_totalprice * 2 as o_totalprice from orders")
def patch_params(spark, d):
    """A patch made once, with two places that each row fills."""
    run = values.patcher(ORDER, {"o_orderstatus": values.param("status"), "o_totalprice": values.param("price")})
    made = run(F.struct("o_orderkey", "o_orderstatus", "o_totalprice"), status=F.when(F.col("o_orderkey") % 2 == 0, "even").otherwise("odd"), price=F.col("o_totalprice") * 2)
    return orders(spark, d).select(made.alias("p")).select("p.*")


@named("patch_nested", "select o_orderkey, [1, o_orderkey, 3] as xs, 'new' as x, o_orderstatus as y from orders")
def patch_nested(spark, d):
    """An element by its place, and one field of an inner object; the others stay."""
    shape = s.object(o_orderkey=s.int(), xs=s.array(s.int()), inner=s.object(x=s.string(), y=s.string()))
    value = F.struct("o_orderkey", F.array(*[F.lit(k).cast("long") for k in (1, 2, 3)]).alias("xs"), F.struct(F.lit("old").alias("x"), F.col("o_orderstatus").alias("y")).alias("inner"))
    made = values.patch(shape, value, {"xs": {1: F.col("o_orderkey")}, "inner": {"x": "new"}})
    return orders(spark, d).select(made.alias("p")).select("p.o_orderkey", "p.xs", "p.inner.x", "p.inner.y")


@named("index_lookup", "select o.o_orderkey, c.v from (select o_orderkey, o_custkey from orders) o left join (select user_id, arg_max(value, event_id) as v from events group by 1) c on o.o_custkey = c.user_id")
def index_lookup(spark, d):
    """The last event of each user, found by another table's key."""
    index = collection.index(ordered(load(spark, d, "events"), "event_id"), "user_id")
    found = collection.looked_up(load(spark, d, "orders").select("o_orderkey", "o_custkey"), index, "o_custkey")
    return found.select("o_orderkey", F.col("found.value").alias("v"))


@named("mapper_many", "select o_orderkey as id, [o_totalprice, o_totalprice + 1] as prices, o_orderstatus as status, cast(0 as double) as rate from orders")
def mapper_many(spark, d):
    """Objects in an array, a renamed inner field, and a default."""
    source = s.object(o_orderkey=s.int(), o_orderstatus=s.string(), lines=s.array(s.object(price=s.number(), note=s.string())))
    target = s.object(id=s.int(), status=s.string(), lines=s.array(s.object(price=s.number())), rate=s.number())
    line = lambda more: F.struct((F.col("o_totalprice") + more).alias("price"), F.lit("-").alias("note"))
    rows = orders(spark, d).select("o_orderkey", "o_orderstatus", F.array(line(0), line(1)).alias("lines"))
    made = mapping.map_rows(rows, source, target, {"id": mapping.From("o_orderkey"), "status": mapping.From("o_orderstatus"), "rate": mapping.Default(0.0)})
    return made.select("id", F.transform("lines", lambda x: x["price"]).alias("prices"), "status", "rate")


# JSON and bytes


@named("json_numbers", r"select l_orderkey, l_linenumber, regexp_replace(cast(l_extendedprice as varchar), '\.0$', '') as price, '0.000' || cast(cast(l_quantity as integer) as varchar) || '1' as small, cast(cast(l_quantity as integer) as varchar) || '00000000000000000000' as large, case when l_linenumber = 1 then 'null' else '1e-7' end as tiny from lineitem")
def json_numbers(spark, d):
    n = s.number()
    q = F.col("l_quantity").cast("int").cast("string")
    rows = load(spark, d, "lineitem")
    as_text = lambda c: jsonio.stringified(n, c.cast("double"))
    return rows.select("l_orderkey", "l_linenumber", as_text(F.col("l_extendedprice")).alias("price"), as_text(F.concat(F.lit("0.000"), q, F.lit("1"))).alias("small"), as_text(F.concat(q, F.lit("e19"))).alias("large_"), as_text(F.when(F.col("l_linenumber") == 1, float("nan")).otherwise(1e-7)).alias("tiny")).select(
        "l_orderkey", "l_linenumber", "price", "small", F.concat("large_", F.lit("0")).alias("large"), "tiny"
    )


@named("json_objects", r"""select c_custkey, '{"c_custkey":' || c_custkey || ',"name":"' || c_name || '\"\\\u001f\u000b\n é","open":' || case when c_acctbal >= 0 then 'true' else 'false' end || case when c_custkey % 2 = 0 then ',"note":"x"' else '' end || ',"none":null,"tags":["' || c_mktsegment || '",null],"day":"2024-02-29T12:30:00.250Z"}' as json from customer""")
def json_objects(spark, d):
    """Escapes, an absent optional field, a null one, an array and a date."""
    shape = s.object(c_custkey=s.int(), name=s.string(), open=s.boolean(), note=s.string().optional(), none=s.string().nullable(), tags=s.array(s.string().nullable()), day=s.date())
    c = load(spark, d, "customer")
    value = F.struct(
        "c_custkey", F.concat("c_name", F.lit('"\\\x1f\x0b\n é')).alias("name"), (F.col("c_acctbal") >= 0).alias("open"), F.when(F.col("c_custkey") % 2 == 0, "x").alias("note"), F.lit(None).cast("string").alias("none"),
        F.array(F.col("c_mktsegment"), F.lit(None)).alias("tags"), F.timestamp_millis(F.lit(1709209800250)).alias("day"),
    )
    return c.select("c_custkey", jsonio.stringified(shape, value).alias("json"))


CHUNKS_SQL = """with recursive e as (select c_custkey as k, row_number() over (order by c_custkey) as n, case when c_custkey > (select min(c_custkey) from customer) then ',' else '' end || '{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '"}' as t from customer),
walk as (select 0::bigint as n, 0::bigint as chunk, 1::bigint as size union all
  select e.n, case when w.size + length(e.t) > 200 then w.chunk + 1 else w.chunk end, case when w.size + length(e.t) > 200 then length(e.t) else w.size + length(e.t) end from walk w join e on e.n = w.n + 1)
select w.chunk, case when w.chunk = 0 then '[' else '' end || string_agg(e.t, '' order by e.n) || case when w.chunk = (select max(chunk) from walk) then ']' else '' end as text from walk w join e on e.n = w.n group by w.chunk"""


@named("json_pieces", CHUNKS_SQL)
def json_pieces(spark, d):
    """The pieces themselves, of 200 units each."""
    shape = s.object(c_custkey=s.int(), c_name=s.string())
    return jsonio.chunks(load(spark, d, "customer").select("c_custkey", "c_name"), shape, "c_custkey", 200)


def kept(spark: SparkSession, made, of: DataFrame) -> DataFrame:
    """What ``made`` reads from a folder of text lines, checkpointed; the folder is gone afterwards."""
    sc = spark.sparkContext
    checkpointed(spark.range(0))
    at = f"{sc.getCheckpointDir()}/strataform-text-{uuid.uuid4().hex}"
    of.write.text(at)
    try:
        return checkpointed(made(at))
    finally:
        path = sc._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


@named("json_array", "select index, case when index >= 100 then [':too_big'] when c_acctbal < 0 then ['[' || index || '].c_acctbal:too_small'] else [] end as found, case when c_acctbal >= 0 and index < 100 then c_custkey end as id from (select cast(row_number() over (order by c_custkey) - 1 as integer) as index, c_custkey, c_acctbal from customer)")
def json_array(spark, d):
    """A file with one array: items' paths, and those beyond the array's ``max``."""
    item = s.object(c_custkey=s.int(), c_acctbal=s.number().min(0))
    pieces = jsonio.chunks(load(spark, d, "customer").select("c_custkey", "c_acctbal"), s.object(c_custkey=s.int(), c_acctbal=s.number()), "c_custkey")
    whole = pieces.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "text"))), lambda x: x["text"]), "").alias("value"))
    made = kept(spark, lambda at: jsonio.read_array(spark, at, s.array(item).max(100)), whole)
    found = F.transform("issues", lambda x: F.concat(x["path"], F.lit(":"), x["code"]))
    return made.select("index", F.when(F.col("index") >= 100, F.array(F.lit(":too_big"))).otherwise(found).alias("found"), F.when(F.col("valid"), F.col("data.c_custkey")).alias("id"))


@named("json_lines", "select line, case when c_acctbal < 0 then ['line ' || line || '.c_acctbal:too_small'] else [] end as found from (select row_number() over (order by c_custkey) * 2 - 2 as line, c_acctbal from customer)")
def json_lines(spark, d):
    """A file of lines, every other blank: blank lines count, but aren't items."""
    lines = load(spark, d, "customer").orderBy("c_custkey").coalesce(1).select(F.concat(F.to_json(F.struct("c_custkey", "c_acctbal")), F.lit("\n")).alias("value"))
    made = kept(spark, lambda at: jsonio.read_lines(spark, at, s.object(c_custkey=s.int(), c_acctbal=s.number().min(0))), lines)
    return made.select("line", F.transform("issues", lambda x: F.concat(x["path"], F.lit(":"), x["code"])).alias("found"))


@named("json_documents", "select count(*) as n, sum(case when n_nationkey % 3 <> 0 then 1 else 0 end) as valid, sum(case when n_nationkey % 3 = 0 then 1 else 0 end) as wrong_root from nation")
def json_documents(spark, d):
    """Files of one value each; every third is an array where an object is wanted."""
    value = F.when(F.col("n_nationkey") % 3 == 0, F.lit("[1]")).otherwise(F.concat(F.lit(" \n"), F.to_json(F.struct("n_nationkey", "n_name"))))
    return _documents(spark, load(spark, d, "nation").select(value.alias("value"), F.col("n_nationkey").alias("file")), s.object(n_nationkey=s.int(), n_name=s.string()))


def _documents(spark: SparkSession, rows: DataFrame, shape) -> DataFrame:
    """Each row in a file of its own, read again as documents: how many there are, are valid, and have the wrong root."""
    sc = spark.sparkContext
    checkpointed(spark.range(0))
    at = f"{sc.getCheckpointDir()}/strataform-text-{uuid.uuid4().hex}"
    rows.write.partitionBy("file").text(at)
    try:
        found = checkpointed(jsonio.read_document(spark, f"{at}/*", shape).select("valid", "issues"))
    finally:
        path = sc._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
    return found.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("valid").cast("long")).alias("valid"), F.sum(F.exists("issues", lambda x: x["code"] == "expected_object").cast("long")).alias("wrong_root"))


LE4 = "printf('%02x%02x%02x%02x', {0} & 255, ({0} >> 8) & 255, ({0} >> 16) & 255, ({0} >> 24) & 255)"


@named("codec_bytes", f"""select c_custkey, '03' || case when c_custkey % 2 = 0 then '02' else '00' end || {LE4.format('c_custkey')} || {LE4.format('strlen(c_name)')} || lower(hex(c_name)) || case when c_acctbal < 0 then '00' else '01' end
  || (case c_mktsegment when 'BUILDING' then '00' else '01' end) || case when c_custkey % 2 = 0 then {LE4.format('c_nationkey')} else '' end || '02000000' || {LE4.format('c_custkey')} || {LE4.format('c_nationkey')} as bytes from customer""")
def codec_bytes(spark, d):
    """The bytes themselves: version, mask of optional fields, then the fields in order."""
    shape = s.object(c_custkey=s.int(), c_name=s.string(), open=s.boolean(), segment=s.enum("BUILDING", "OTHER"), nation=s.int().optional(), xs=s.array(s.int()))
    c = load(spark, d, "customer")
    segment = F.when(F.col("c_mktsegment") == "BUILDING", "BUILDING").otherwise("OTHER")
    rows = c.select("c_custkey", "c_name", (F.col("c_acctbal") >= 0).alias("open"), segment.alias("segment"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey").cast("long")).alias("nation"), F.array("c_custkey", F.col("c_nationkey").cast("long")).alias("xs"))
    own = codec.Codec(shape, 3)
    made = own.encode(rows)
    return made.select(F.lower(F.hex("bytes")).alias("bytes"), F.conv(F.concat(*[F.substring(F.hex("bytes"), 5 + 2 * k, 2) for k in (3, 2, 1, 0)]), 16, 10).cast("long").alias("c_custkey"))


@named("codec_unions", "select c_custkey, case when c_custkey % 2 = 0 then c_name end as name, case when c_custkey % 2 = 1 then c_acctbal end as amount from customer")
def codec_unions(spark, d):
    shape = s.object(c_custkey=s.int(), what=s.union(s.object(name=s.string()), s.object(amount=s.number())))
    even = F.col("c_custkey") % 2 == 0
    rows = load(spark, d, "customer").select("c_custkey", F.struct(F.when(even, F.col("c_name")).alias("name"), F.when(~even, F.col("c_acctbal")).alias("amount")).alias("what"))
    own = codec.Codec(shape)
    return own.decode(own.encode(rows)).select("c_custkey", "what.name", "what.amount")


@named("rowset_hydrate", "select l_orderkey, l_returnflag from lineitem")
def rowset_hydrate(spark, d):
    """Loaded, read back as rows, and released."""
    rows = Rowset.load(spark, s.object(l_orderkey=s.int(), l_returnflag=s.string()), load(spark, d, "lineitem").select("l_orderkey", "l_returnflag"))
    found = checkpointed(rows.df.select("l_orderkey", "l_returnflag"))
    rows.release()
    return found


# Order


def placed(df: DataFrame) -> DataFrame:
    """The rows with their places in the result as it came."""
    at = "_at"
    return numbered(ordered(checkpointed(df.withColumn(at, F.monotonically_increasing_id())), at)).withColumnRenamed("_n", "place").drop("_o0", at)


@named("order_by_places", "select o_orderkey, row_number() over (order by o_totalprice desc, o_orderkey) - 1 as place from orders")
def order_by_places(spark, d):
    o = ordered(orders(spark, d), "o_orderkey")
    return placed(query(o).order_by("o_totalprice", "desc").select("o_orderkey").run(o))


@named("sequence_places", "select ids, row_number() over (order by ids[1]) - 1 as place from (select list(event_id order by event_id) as ids from (select event_id, floor((row_number() over (order by event_id) - 1) / 5) as g from events) group by g)")
def sequence_places(spark, d):
    o = ordered(load(spark, d, "events").select("event_id"), "event_id")
    return placed(query(o).chunk(5).run(o).select(F.transform("items", lambda x: x["event_id"]).alias("ids")))


@named("scan_long", "select event_id, cast(9007199254740992 + sum(event_id) over (order by event_id rows unbounded preceding) as bigint) as total from events")
def scan_long(spark, d):
    """Whole numbers stay whole, beyond what a double tells apart."""
    o = ordered(load(spark, d, "events"), "event_id")
    return sequence.scan(o, "sum", "event_id", 2**53, carry=("event_id",)).df.select("event_id", F.col("value").alias("total"))


@named("scan_text", "select event_id, max(event_type) over (order by event_id rows unbounded preceding) as last, min(ts) over (order by event_id rows unbounded preceding) as first from events")
def scan_text(spark, d):
    o = ordered(load(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz")), "event_id")
    last = sequence.scan(o, "max", "event_type", carry=("event_id",)).df.select("event_id", F.col("value").alias("last"))
    return last.join(sequence.scan(o, "min", "ts", carry=("event_id",)).df.select("event_id", F.col("value").alias("first")), "event_id")


@named("fold_own", "select event_id, cast(sum(event_id % 7) over (order by event_id rows unbounded preceding) % 1000 as bigint) as state from events")
def fold_own(spark, d):
    """A fold that only its function knows: one task, in order."""
    o = ordered(load(spark, d, "events").select("event_id"), "event_id")
    made = query(o).scan(lambda state, row: (state + row["event_id"] % 7) % 1000, initial=0, kind="long").run(o).select(F.col("value").alias("state"))
    return placed(made).join(numbered(o).select("event_id", F.col("_n").alias("place")), "place").select("event_id", "state")


# Snapshots


@named("watched_updates", """select 'new' as what, count(*) as n from orders where o_orderkey + 100 not in (select o_orderkey from orders) union all select 'removed', count(*) from orders where o_orderkey not in (select o_orderkey + 100 from orders)
  union all select 'updated', count(*) from orders p join orders c on p.o_orderkey = c.o_orderkey + 100 where p.o_totalprice is distinct from c.o_totalprice or p.o_orderstatus is distinct from c.o_orderstatus""")
def watched_updates(spark, d):
    """A list that becomes another, its keys moved on by a hundred."""
    o = orders(spark, d)
    listed = snapshots.WatchedList(ordered(o, "o_orderkey"), "o_orderkey").update(ordered(o.withColumn("o_orderkey", F.col("o_orderkey") + 100), "o_orderkey"))
    counted = [df.agg(F.lit(n).alias("what"), F.count(F.lit(1)).alias("n")) for n, df in (("new", listed.new), ("removed", listed.removed), ("updated", listed.changed))]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


@named("watched_back", "select 'current' as what, c_custkey from customer where c_acctbal >= 0 or c_custkey % 2 = 0 union all select 'removed', c_custkey from customer where c_acctbal < 0 and c_custkey % 2 = 1")
def watched_back(spark, d):
    """Customers in debt go, the even ones come back, and some that were never there come and go."""
    c = load(spark, d, "customer").select("c_custkey", "c_acctbal")
    listed = snapshots.WatchedList(ordered(c, "c_custkey"), "c_custkey").remove(c.where("c_acctbal < 0")).add(c.where("c_custkey % 2 = 0"))
    odd = c.select((-F.col("c_custkey") - 1).alias("c_custkey"), "c_acctbal")
    listed = listed.add(odd).remove(odd)
    return listed.current.select(F.lit("current").alias("what"), "c_custkey").unionByName(listed.removed.select(F.lit("removed").alias("what"), "c_custkey")).unionByName(listed.new.select(F.lit("new").alias("what"), "c_custkey"))


# Streams


def streamed(spark: SparkSession, d: str, made, mode: str = "append") -> DataFrame:
    """What a query over the stream of events gives once all of them have come, checkpointed."""
    sc = spark.sparkContext
    checkpointed(spark.range(0))
    at = f"{sc.getCheckpointDir()}/strataform-stream-{uuid.uuid4().hex}"
    events = load(spark, d, "events")
    session = spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    session.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    source = session.readStream.schema(events.schema).parquet(f"{d}/event[s].parquet")
    out = made(source)
    run = out.writeStream.foreachBatch(lambda batch, _: batch.write.mode("append" if mode == "append" else "overwrite").parquet(f"{at}/rows")).outputMode(mode)
    try:
        run.option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
        return checkpointed(spark.read.schema(out.schema).parquet(f"{at}/rows"))
    finally:
        path = sc._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


@named("stream_unique", "select distinct user_id from events")
def stream_unique(spark, d):
    return streamed(spark, d, lambda e: stream.unique(e, "user_id").select("user_id"))


@named("stream_checks", "select event_id, value >= 100 as valid from events")
def stream_checks(spark, d):
    """Validation of what comes in; bad rows are told, not lost."""
    shape = s.object(event_id=s.int(), value=s.number().min(100))
    return streamed(spark, d, lambda e: stream.validated(e.select("event_id", "value"), shape).select("event_id", "valid"))


@named("stream_scan", "select user_id, event_id, round(sum(value) over (partition by user_id order by event_id rows unbounded preceding), 2) as total from events")
def stream_scan(spark, d):
    return streamed(spark, d, lambda e: stream.scan_by_key(e, "user_id", "event_id", "value", 0.0, lambda a, x: a + x)).select("user_id", "event_id", F.round("value", 2).alias("total"))


@named("stream_pairs", "select user_id, event_id, prev, value as cur from (select user_id, event_id, value, lag(value) over w as prev, lag(event_id) over w as before from events window w as (partition by user_id order by event_id)) where before is not null")
def stream_pairs(spark, d):
    return streamed(spark, d, lambda e: stream.pairwise_by_key(e, "user_id", "event_id", "value"))


NTH = "(select user_id, event_id, value, row_number() over (partition by user_id order by event_id) as n from events)"


@named("stream_chunks", f"select user_id, max(event_id) as event_id, list(value order by n) as items from {NTH} group by user_id, (n - 1) // 4 having count(*) = 4")
def stream_chunks(spark, d):
    return streamed(spark, d, lambda e: stream.chunk_by_key(e, "user_id", "event_id", "value", 4))


@named("stream_windows", "select user_id, event_id, items from (select user_id, event_id, list(value) over (partition by user_id order by event_id rows between 2 preceding and current row) as items from events) where len(items) = 3")
def stream_windows(spark, d):
    return streamed(spark, d, lambda e: stream.window_by_key(e, "user_id", "event_id", "value", 3))


@named("stream_take", f"select user_id, event_id, value from {NTH} where n <= 3")
def stream_take(spark, d):
    return streamed(spark, d, lambda e: stream.take_by_key(e, "user_id", "event_id", "value", 3))


@named("stream_drop", f"select user_id, event_id, value from {NTH} where n > 3")
def stream_drop(spark, d):
    return streamed(spark, d, lambda e: stream.drop_by_key(e, "user_id", "event_id", "value", 3))


STOP = "(select user_id, event_id, value, max(case when value < 200 then 0 else 1 end) over (partition by user_id order by event_id rows unbounded preceding) as over from events)"


@named("stream_take_while", f"select user_id, event_id, value from {STOP} where over = 0")
def stream_take_while(spark, d):
    return streamed(spark, d, lambda e: stream.take_while_by_key(e, "user_id", "event_id", "value", lambda x: x < 200))


@named("stream_drop_while", f"select user_id, event_id, value from {STOP} where over = 1")
def stream_drop_while(spark, d):
    return streamed(spark, d, lambda e: stream.drop_while_by_key(e, "user_id", "event_id", "value", lambda x: x < 200))


@named("stream_adjacent", """select user_id, max(event_id) as event_id, list(value order by event_id) as items from (select *, sum(new) over (partition by user_id order by event_id rows unbounded preceding) as g
  from (select user_id, event_id, value, event_type, case when lag(event_type) over (partition by user_id order by event_id) is not distinct from event_type then 0 else 1 end as new from events)) t
  group by user_id, g having max(event_id) < (select max(event_id) from events e where e.user_id = t.user_id)""")
def stream_adjacent(spark, d):
    """All runs but each user's last, which may go on."""
    return streamed(spark, d, lambda e: stream.group_adjacent_by_key(e, "user_id", "event_id", "event_type", "value"))


@named("stream_aggregates", "select user_id, round(sum(value), 2) as sum, count(*) as count, round(avg(value), 4) as avg, min(value) as min, max(value) as max from events group by 1")
def stream_aggregates(spark, d):
    made = streamed(spark, d, lambda e: stream.aggregated(e, "user_id", "value"), "complete")
    return made.select("user_id", F.round("sum", 2).alias("sum"), "count", F.round("avg", 4).alias("avg"), "min", "max")


@named("stream_keyed", "select user_id, min(event_id) as position, arg_max(value, event_id) as value from events group by 1")
def stream_keyed(spark, d):
    return streamed(spark, d, lambda e: stream.keyed(e, "user_id", "event_id"), "complete").select("user_id", "position", F.col("value.value").alias("value"))
