"""Named queries over the tables of a folder, with the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, validate, values
from ..functions.predicates import Conditions as P
from ..functions.predicates import compile_predicate
from ..operators import collection, mapping, sequence, snapshots
from ..operators.model import model
from ..sources import codec, jsonio
from ..sources.rowset import Rowset, process
from .ordinal import checkpointed, numbered, ordered
from .query import query
from .schema import s

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def named(name: str, sql: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return put


def load(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def events(spark: SparkSession, d: str):
    return ordered(load(spark, d, "events"), "event_id")


ORDERS = s.object(o_orderkey=s.int(), o_custkey=s.int(), o_orderstatus=s.string(), o_totalprice=s.number(), o_orderpriority=s.string())
CUSTOMER = s.object(c_custkey=s.int(), c_name=s.string().pii("mask"), c_nationkey=s.int(), c_acctbal=s.number(), c_mktsegment=s.string())


@named("flagship", "select event_id, user_id, value from events where coalesce(event_type = 'purchase', false) and coalesce(value > 50, false) order by event_id limit 10")
def flagship(spark, d):
    """Filter, project, first ten in order."""
    q = query(["event_id", "user_id", "value", "event_type", "ts", "props"]).filter(lambda p: p.and_(p.eq("event_type", "purchase"), p.gt("value", 50.0))).select("event_id", "user_id", "value").take(10)
    return process(spark, f"{d}/events.parquet", q, "event_id")


@named("filter_select", "select o_orderkey, o_orderstatus from orders where coalesce(o_totalprice > 200000, false) and o_orderstatus is distinct from 'F'")
def filter_select(spark, d):
    q = query(load(spark, d, "orders")).filter(P.and_(P.gt("o_totalprice", 200000.0), P.neq("o_orderstatus", "F"))).select("o_orderkey", "o_orderstatus")
    return q.run(ordered(load(spark, d, "orders"), "o_orderkey"))


@named("filter_not_or", "select o_orderkey from orders where not (coalesce(o_totalprice > 100000, false) or coalesce(o_orderpriority = '1-URGENT', false))")
def filter_not_or(spark, d):
    return query(load(spark, d, "orders")).filter(lambda p: p.not_(p.or_(p.gt("o_totalprice", 100000.0), p.eq("o_orderpriority", "1-URGENT")))).select("o_orderkey").run(ordered(load(spark, d, "orders"), "o_orderkey"))


@named("filter_params", "select c_custkey from customer where coalesce(c_acctbal >= 1000, false) and coalesce(c_mktsegment = 'BUILDING', false)")
def filter_params(spark, d):
    q = query(load(spark, d, "customer")).params("least", "segment").filter(lambda p: p.and_(p.gte("c_acctbal", p.param("least")), p.eq("c_mktsegment", p.param("segment")))).select("c_custkey")
    return q.run(ordered(load(spark, d, "customer"), "c_custkey"), least=1000.0, segment="BUILDING")


@named("filter_field_to_field", "select o_orderkey from orders where coalesce(o_orderkey < o_custkey, false)")
def filter_field_to_field(spark, d):
    return query(load(spark, d, "orders")).filter(lambda p: p.lt("o_orderkey", p.field("o_custkey"))).select("o_orderkey").run(ordered(load(spark, d, "orders"), "o_orderkey"))


@named("filter_lte_const", "select c_custkey from customer where coalesce(c_acctbal <= 0, false)")
def filter_lte_const(spark, d):
    return query(load(spark, d, "customer")).filter(lambda p: p.and_(p.lte("c_acctbal", 0.0), p.const(True))).select("c_custkey").run(ordered(load(spark, d, "customer"), "c_custkey"))


@named("filter_eq_null", "select o_orderkey from orders where o_orderstatus is null")
def filter_eq_null(spark, d):
    return query(load(spark, d, "orders")).filter(lambda p: p.eq("o_orderstatus", None)).select("o_orderkey").run(ordered(load(spark, d, "orders"), "o_orderkey"))


def aggregate(op: str, field: str | None = None):
    def run(spark, d):
        q = query(load(spark, d, "orders")).filter(lambda p: p.eq("o_orderstatus", "O"))
        out = (getattr(q, op)(field) if field else q.count()).run(ordered(load(spark, d, "orders"), "o_orderkey"))
        return out.select(F.round(op, 2).alias("v")) if op in ("sum", "avg") else out.select(F.col(op).alias("v"))

    return run


for _op, _sql in {"sum": "round(coalesce(sum(o_totalprice), 0), 2)", "avg": "round(avg(o_totalprice), 2)", "min": "min(o_totalprice)", "max": "max(o_totalprice)"}.items():
    named(f"agg_{_op}", f"select {_sql} as v from orders where coalesce(o_orderstatus = 'O', false)")(aggregate(_op, "o_totalprice"))
named("agg_count", "select count(*) as v from orders where coalesce(o_orderstatus = 'O', false)")(aggregate("count"))


@named("agg_empty", "select coalesce(sum(o_totalprice), 0.0) as s, count(*) as n, avg(o_totalprice) as a from orders where o_totalprice < -1")
def agg_empty(spark, d):
    o = ordered(load(spark, d, "orders"), "o_orderkey")
    q = query(o).filter(lambda p: p.lt("o_totalprice", -1.0))
    return q.sum("o_totalprice").run(o).select(F.col("sum").alias("s")).crossJoin(q.count().run(o).select(F.col("count").alias("n"))).crossJoin(q.avg("o_totalprice").run(o).select(F.col("avg").alias("a")))


@named("unique_first", "select event_id, user_id, event_type from events qualify row_number() over (partition by user_id order by event_id) = 1")
def unique_first(spark, d):
    o = events(spark, d)
    return query(o).unique("user_id").select("event_id", "user_id", "event_type").run(o)


@named("unique_count", "select count(distinct user_id) as n from events where coalesce(value > 20, false)")
def unique_count(spark, d):
    o = events(spark, d)
    return query(o).filter(lambda p: p.gt("value", 20.0)).unique("user_id").count().run(o).select(F.col("count").alias("n"))


@named("keyed_last", "select user_id, arg_max(value, event_id) as value, min(event_id) as pos from events group by 1")
def keyed_last(spark, d):
    return collection.keyed(events(spark, d), "user_id").df.select("user_id", "value", F.col("_o0").alias("pos"))


@named("group_by", "select event_type, list(event_id order by event_id) as ids from events group by 1")
def group_by(spark, d):
    o = events(spark, d)
    return query(o).group_by("event_type").select("event_id").run(o).select("event_type", F.transform("items", lambda x: x["event_id"]).alias("ids"))


@named("normalize_by_id", "select user_id, arg_max(event_id, event_id) as event_id from events group by 1")
def normalize_by_id(spark, d):
    return collection.normalized(events(spark, d), "user_id")[0].select("user_id", "event_id")


@named("normalize_ids", "select user_id from events")
def normalize_ids(spark, d):
    return collection.normalized(events(spark, d), "user_id")[1]


@named("order_by_top", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20")
def order_by_top(spark, d):
    o = ordered(load(spark, d, "orders"), "o_orderkey")
    return query(o).order_by("o_totalprice", "desc").select("o_orderkey", "o_totalprice").take(20).run(o)


@named("order_by_asc_drop", "select c_custkey from customer order by c_mktsegment, c_custkey offset 50")
def order_by_asc_drop(spark, d):
    o = ordered(load(spark, d, "customer"), "c_custkey")
    return query(o).order_by("c_mktsegment").select("c_custkey").drop(50).run(o)


@named("drop_take", "select event_id from events order by event_id limit 5 offset 10")
def drop_take(spark, d):
    o = events(spark, d)
    return query(o).select("event_id").drop(10).take(5).run(o)


@named("take_while", "select event_id from events where event_id < coalesce((select min(event_id) from events where not coalesce(value < 250, false)), 9223372036854775807)")
def take_while(spark, d):
    o = events(spark, d)
    return query(o).take_while(lambda p: p.lt("value", 250.0)).select("event_id").run(o)


@named("drop_while", "select event_id from events where event_id >= (select min(event_id) from events where not coalesce(value < 250, false))")
def drop_while(spark, d):
    o = events(spark, d)
    return query(o).drop_while(lambda p: p.lt("value", 250.0)).select("event_id").run(o)


@named("chunk", "select g, list(event_id order by event_id) as ids from (select cast(floor((row_number() over (order by event_id) - 1) / 7) as bigint) g, event_id from events) group by g")
def chunk(spark, d):
    o = events(spark, d)
    return sequence.chunk(o.put(o.df.select("event_id", "_o0")), 7).df.select(F.col("_o0").alias("g"), F.transform("items", lambda x: x["event_id"]).alias("ids"))


@named("window3", "select w from (select list(event_id) over (order by event_id rows between current row and 2 following) as w from events) where len(w) = 3")
def window3(spark, d):
    o = events(spark, d)
    return query(o).select("event_id").window(3).run(o).select(F.transform("items", lambda x: x["event_id"]).alias("w"))


@named("pairwise", "select prev, event_id as cur from (select lag(event_id) over (order by event_id) as prev, event_id from events) where prev is not null")
def pairwise(spark, d):
    o = events(spark, d)
    return query(o).select("event_id").pairwise().run(o).select(F.col("prev.event_id").alias("prev"), F.col("cur.event_id").alias("cur"))


@named("pairwise_by_key", "select conv_id, prev, turn as cur from (select conv_id, turn, lag(turn) over (partition by conv_id order by turn) as prev from conversations) where prev is not null")
def pairwise_by_key(spark, d):
    o = ordered(load(spark, d, "conversations").select("conv_id", "turn"), "conv_id", "turn")
    return sequence.pairwise_by_key(o, "conv_id").df.select(F.col("cur.conv_id").alias("conv_id"), F.col("prev.turn").alias("prev"), F.col("cur.turn").alias("cur"))


@named("scan_sum", "select event_id, round(sum(value) over (order by event_id rows unbounded preceding), 2) as total from events")
def scan_sum(spark, d):
    return sequence.scan(events(spark, d), "sum", "value", carry=("event_id",)).df.select("event_id", F.round("value", 2).alias("total"))


@named("scan_max", "select max(value) over (order by event_id rows unbounded preceding) as best from events")
def scan_max(spark, d):
    o = events(spark, d)
    return query(o).scan("max", "value").run(o).select(F.col("value").alias("best"))


@named("scan_count", "select cast(row_number() over (order by event_id) as bigint) as n from events")
def scan_count(spark, d):
    o = events(spark, d)
    return query(o).scan("count", "event_id").run(o).select(F.col("value").alias("n"))


@named("adjacent", "select list(event_id order by event_id) as ids from (select event_id, sum(new) over (order by event_id) g from (select event_id, case when lag(event_type) over (order by event_id) is not distinct from event_type and event_id > (select min(event_id) from events) then 0 else 1 end new from events)) group by g")
def adjacent(spark, d):
    o = events(spark, d)
    return query(o).group_adjacent_by("event_type").run(o).select(F.transform("items", lambda x: x["event_id"]).alias("ids"))


@named("flat_map", "select unnest(embedding) as value from embeddings")
def flat_map(spark, d):
    o = ordered(load(spark, d, "embeddings"), "vec_id")
    return query(o).flat_map("embedding").run(o)


@named("delete", "select event_id from events where not coalesce(event_type = 'view', false)")
def delete(spark, d):
    o = events(spark, d)
    return query(o).filter(lambda p: p.eq("event_type", "view")).delete().run(o).select("event_id")


@named("update", "select o_orderkey, case when coalesce(o_totalprice > 150000, false) then 'X' else o_orderstatus end as o_orderstatus from orders")
def update(spark, d):
    o = ordered(load(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), "o_orderkey")
    return query(o).filter(lambda p: p.gt("o_totalprice", 150000.0)).update(o_orderstatus="X").run(o).select("o_orderkey", "o_orderstatus")


@named("mask", "select c_custkey, case when length(c_name) > 4 then '***' || right(c_name, 4) else '***' end as c_name from customer")
def mask(spark, d):
    return load(spark, d, "customer").select(values.scrubbed(CUSTOMER, F.struct(*CUSTOMER.fields), "mask").alias("m")).select("m.c_custkey", "m.c_name")


@named("mask_redact", "select c_custkey, '***' as c_name, cast(0 as double) as c_acctbal from customer")
def mask_redact(spark, d):
    return load(spark, d, "customer").select("c_custkey", text.masked(F.col("c_name"), "string", "redact").alias("c_name"), text.masked(F.col("c_acctbal"), "double", "redact").alias("c_acctbal"))


@named("mask_hash", "select n_nationkey, lower(printf('%x', list_reduce(list_prepend(2166136261::bigint, list_transform(string_split(n_name, ''), lambda c: ascii(c)::bigint)), lambda h, c: (xor(h, c) * 16777619) & 4294967295))) as h from nation")
def mask_hash(spark, d):
    return load(spark, d, "nation").select("n_nationkey", text.masked(F.col("n_name"), "string", "hash").alias("h"))


@named("hash31", "select n_nationkey, cast(case when h >= 2147483648 then h - 4294967296 else h end as integer) as h from (select n_nationkey, list_reduce(list_prepend(0::bigint, list_transform(string_split(n_name, ''), lambda c: ascii(c)::bigint)), lambda h, c: (h * 31 + c) & 4294967295) as h from nation)")
def hash31(spark, d):
    return load(spark, d, "nation").select("n_nationkey", values.hash31(s.string(), F.col("n_name")).alias("h"))


@named("hash_object", "select n_nationkey, cast(case when h >= 2147483648 then h - 4294967296 else h end as integer) as h from (select n_nationkey, (((23 * 31 + n_nationkey) & 4294967295) * 31 + n_regionkey) & 4294967295 as h from nation)")
def hash_object(spark, d):
    shape = s.object(n_nationkey=s.int(), n_regionkey=s.int())
    return load(spark, d, "nation").select("n_nationkey", values.hash31(shape, F.struct("n_nationkey", "n_regionkey")).alias("h"))


def moved(spark, d):
    """All orders, and all orders with each key moved on by a hundred: keys come and go, the others change their values."""
    o = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return ordered(o, "o_orderkey"), ordered(o.withColumn("o_orderkey", F.col("o_orderkey") + 100), "o_orderkey")


@named("watch_new", "select o_orderkey + 100 as o_orderkey from orders where o_orderkey + 100 not in (select o_orderkey from orders)")
def watch_new(spark, d):
    return snapshots.watch(*moved(spark, d), "o_orderkey").new.select("o_orderkey")


@named("watch_removed", "select o_orderkey from orders where o_orderkey not in (select o_orderkey + 100 from orders)")
def watch_removed(spark, d):
    return snapshots.watch(*moved(spark, d), "o_orderkey").removed.select("o_orderkey")


@named("watch_updated", "select p.o_orderkey, p.o_totalprice as was, c.o_totalprice as now from orders p join orders c on p.o_orderkey = c.o_orderkey + 100 where p.o_custkey is distinct from c.o_custkey or p.o_totalprice is distinct from c.o_totalprice")
def watch_updated(spark, d):
    return snapshots.watch(*moved(spark, d), "o_orderkey").updated.select("current.o_orderkey", F.col("previous.o_totalprice").alias("was"), F.col("current.o_totalprice").alias("now"))


@named("watched_list", "select c_custkey from (select c_custkey from customer union select c_custkey + 100 from customer) where c_custkey not in (select c_custkey from customer where c_acctbal < 0)")
def watched_list(spark, d):
    """All customers; a log adds all of them again with keys moved on by a hundred, then removes those in debt."""
    c = load(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    log = c.withColumn("c_custkey", F.col("c_custkey") + 100).withColumn("op", F.lit("add")).unionByName(c.where("c_acctbal < 0").withColumn("op", F.lit("remove")))
    return snapshots.replay(ordered(c, "c_custkey"), ordered(log, "op", "c_custkey"), "c_custkey")[0].select("c_custkey")


@named("validate_issues", "select c_custkey, list_filter([case when not (c_custkey > 0) then 'c_custkey:too_small' end, case when not (c_acctbal >= 0) then 'c_acctbal:too_small' end, case when c_mktsegment not in ('BUILDING', 'MACHINERY') then 'c_mktsegment:invalid_value' end], lambda x: x is not null) as issues from customer")
def validate_issues(spark, d):
    shape = s.object(c_custkey=s.int().positive(), c_name=s.string().min(1), c_acctbal=s.number().min(0), c_mktsegment=s.string().one_of("BUILDING", "MACHINERY"))
    made = validate.safe_parse(load(spark, d, "customer").select(*shape.fields), shape)
    return made.select("c_custkey", F.transform("issues", lambda x: F.concat(x["path"], F.lit(":"), x["code"])).alias("issues"))


@named("validate_is", "select o_orderkey, o_totalprice > 1000 and o_orderstatus in ('F', 'O') and regexp_full_match(o_orderpriority, '[1-5]-[A-Z ]+') as valid from orders")
def validate_is(spark, d):
    shape = s.object(o_orderkey=s.int(), o_totalprice=s.number().gt(1000), o_orderstatus=s.enum("F", "O"), o_orderpriority=s.string().regex("^[1-5]-[A-Z ]+$"))
    return validate.is_valid(load(spark, d, "orders").select(*shape.fields), shape).select("o_orderkey", "valid")


@named("validate_arrays", "select vec_id, list_filter(list_transform(range(len(embedding)), lambda i: case when embedding[i + 1] > 1.5 then 'embedding[' || i || ']' end), lambda x: x is not null) as paths from embeddings")
def validate_arrays(spark, d):
    shape = s.object(vec_id=s.int(), embedding=s.array(s.number().max(1.5)).min(1))
    made = validate.safe_parse(load(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")), shape)
    return made.select("vec_id", F.transform("issues", lambda x: x["path"]).alias("paths"))


@named("quarantine", "select c_custkey from customer where c_acctbal < 0")
def quarantine(spark, d):
    shape = s.object(c_custkey=s.int(), c_acctbal=s.number().min(0))
    return validate.quarantine(load(spark, d, "customer").select("c_custkey", "c_acctbal"), shape)[1].select("c_custkey")


@named("sanitize_html", r"select page_id, replace(replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script\s*>|<style[^>]*>.*?</style\s*>|<iframe[^>]*>.*?</iframe\s*>|<object[^>]*>.*?</object\s*>|<embed[^>]*>.*?</embed\s*>', '', 'g'), '<[^>]*>', '', 'g'), '<', '&lt;'), '>', '&gt;') as body from pages")
def sanitize_html(spark, d):
    return load(spark, d, "pages").select("page_id", text.sanitized(F.col("html")).alias("body"))


@named("sanitize_identifier", "select p_partkey, regexp_replace(regexp_replace(p_name, '[^A-Za-z0-9_$]+', '_', 'g'), '^[0-9]+', '_') as p_name from part")
def sanitize_identifier(spark, d):
    return load(spark, d, "part").select("p_partkey", text.sanitized(F.col("p_name"), "sqlIdentifier").alias("p_name"))


@named("format_mask", "select c_custkey, substr(t, 1, 3) || '.' || substr(t, 4, 3) || '.' || substr(t, 7, 3) || '-' || substr(t, 10, 2) as cpf from (select c_custkey, lpad(cast(c_custkey as varchar), 11, '0') t from customer)")
def format_mask(spark, d):
    return load(spark, d, "customer").select("c_custkey", text.format_or_raise(F.lpad(F.col("c_custkey").cast("string"), 11, "0"), text.CPF).alias("cpf"))


@named("transform_ops", "select c_custkey, lower(c_name) as c_name, upper(c_mktsegment) as c_mktsegment from customer")
def transform_ops(spark, d):
    return load(spark, d, "customer").select(values.transformed(CUSTOMER, F.struct(*CUSTOMER.fields), {"c_name": "lowercase", "c_mktsegment": "uppercase"}).alias("t")).select("t.c_custkey", "t.c_name", "t.c_mktsegment")


@named("pick", "select c_custkey, c_name from customer")
def pick(spark, d):
    return load(spark, d, "customer").select(values.pick(CUSTOMER, F.struct(*CUSTOMER.fields), "c_custkey", "c_name").alias("p")).select("p.*")


@named("omit", "select c_custkey, c_name, c_nationkey from customer")
def omit(spark, d):
    return load(spark, d, "customer").select(values.omit(CUSTOMER, F.struct(*CUSTOMER.fields), "c_acctbal", "c_mktsegment").alias("p")).select("p.*")


@named("mapper", "select c_custkey as id, c_name as name, cast(c_nationkey as double) as nation, 'none' as note, upper(c_mktsegment) as segment from customer")
def mapper(spark, d):
    target = s.object(id=s.int(), name=s.string(), nation=s.number(), note=s.string(), segment=s.string())
    return mapping.map_rows(load(spark, d, "customer"), CUSTOMER, target, {"id": mapping.From("c_custkey"), "name": mapping.From("c_name"), "nation": lambda c: c["c_nationkey"].cast("double"), "note": mapping.Default("none"), "segment": mapping.From("c_mktsegment", F.upper)})


@named("merge_values", "select o.o_orderkey, case when o.o_orderkey % 2 = 0 then 'new' else o.o_orderstatus end as o_orderstatus, o.o_totalprice from orders o")
def merge_values(spark, d):
    shape = s.object(o_orderkey=s.int(), o_orderstatus=s.string(), o_totalprice=s.number())
    o = load(spark, d, "orders").select(*shape.fields)
    right = F.struct(F.col("o_orderkey"), F.when(F.col("o_orderkey") % 2 == 0, "new").alias("o_orderstatus"), F.lit(None).cast("double").alias("o_totalprice"))
    return o.select(values.merge(shape, F.struct(*o.columns), right).alias("m")).select("m.*")


@named("patch_values", "select c_custkey, 'GONE' as c_mktsegment, c_acctbal from customer")
def patch_values(spark, d):
    return load(spark, d, "customer").select(values.drafted(CUSTOMER, F.struct(*CUSTOMER.fields), lambda x: setattr(x, "c_mktsegment", "GONE")).alias("p")).select("p.c_custkey", "p.c_mktsegment", "p.c_acctbal")


@named("equal_values", "select o_orderkey, o_orderkey % 2 = 1 as same from orders")
def equal_values(spark, d):
    shape = s.object(o_orderkey=s.int(), o_totalprice=s.number())
    o = load(spark, d, "orders")
    other = F.struct("o_orderkey", F.when(F.col("o_orderkey") % 2 == 1, F.col("o_totalprice")).otherwise(F.lit(float("nan"))).alias("o_totalprice"))
    return o.select("o_orderkey", values.equal(shape, F.struct("o_orderkey", "o_totalprice"), other).alias("same"))


@named("diff_values", "select o_orderkey, case when o_orderkey % 2 = 0 then ['update:o_orderstatus'] else [] end as changes from orders")
def diff_values(spark, d):
    shape = s.object(o_orderkey=s.int(), o_orderstatus=s.string())
    other = F.struct("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, "?").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"))
    found = values.diff(shape, F.struct("o_orderkey", "o_orderstatus"), other)
    return load(spark, d, "orders").select("o_orderkey", F.transform(found, lambda x: F.concat(x["type"], F.lit(":"), x["path"])).alias("changes"))


@named("json_parse", "select event_id, cast(json_extract(props, '$.k') as bigint) as k from events")
def json_parse(spark, d):
    return jsonio.parse_json(load(spark, d, "events").select("event_id", "props"), s.object(k=s.int()), "props").select("event_id", "data.k")


@named("json_stringify", """select '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}' as json from nation""")
def json_stringify(spark, d):
    shape = s.object(n_nationkey=s.int(), n_name=s.string())
    return load(spark, d, "nation").select(jsonio.stringified(shape, F.struct("n_nationkey", "n_name")).alias("json"))


@named("json_chunks", """select length('[' || string_agg('{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '"}', ',' order by c_custkey) || ']') as chars from customer""")
def json_chunks(spark, d):
    shape = s.object(c_custkey=s.int(), c_name=s.string())
    return jsonio.chunks(load(spark, d, "customer").select("c_custkey", "c_name"), shape, "c_custkey").agg(F.sum(F.length("text")).alias("chars"))


@named("codec_round_trip", "select c_custkey, c_name, c_acctbal from customer")
def codec_round_trip(spark, d):
    c = codec.Codec(s.object(c_custkey=s.int(), c_name=s.string().optional(), c_acctbal=s.number()))
    return c.decode(c.encode(load(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")))


@named("rowset_sum", "select round(sum(l_extendedprice), 2) as v from lineitem where coalesce(l_returnflag = 'R', false) and coalesce(l_quantity > 20, false)")
def rowset_sum(spark, d):
    q = query(load(spark, d, "lineitem")).filter(lambda p: p.and_(p.eq("l_returnflag", "R"), p.gt("l_quantity", 20.0))).sum("l_extendedprice")
    return process(spark, f"{d}/lineitem.parquet", q).select(F.round("sum", 2).alias("v"))


@named("rowset_count", "select count(*) as n from lineitem where coalesce(l_returnflag = 'A', false)")
def rowset_count(spark, d):
    shape = s.object(l_orderkey=s.int(), l_returnflag=s.string())
    rows = Rowset.load(spark, shape, load(spark, d, "lineitem"))
    found = checkpointed(rows.query(query(rows.df).filter(lambda p: p.eq("l_returnflag", "A")).count()).select(F.col("count").alias("n")))
    rows.release()
    return found


@named("rowset_project", "select l_orderkey, l_partkey from lineitem where coalesce(l_discount >= 0.05, false)")
def rowset_project(spark, d):
    q = query(load(spark, d, "lineitem")).filter(lambda p: p.gte("l_discount", 0.05)).select("l_orderkey", "l_partkey")
    return process(spark, f"{d}/lineitem.parquet", q)


@named("dto_from", "select c_custkey, c_name from customer")
def dto_from(spark, d):
    return mapping.dto(CUSTOMER, CUSTOMER.pick("c_custkey", "c_name")).from_(load(spark, d, "customer"))


SHOP = model(s.object(o_orderkey=s.int(), o_custkey=s.int(), o_totalprice=s.number()).hint("unique_by", "o_custkey").hint("group_by", "o_custkey").hint("sort_by", "o_totalprice"))


@named("model_unique_by", "select o_orderkey, o_custkey from orders qualify row_number() over (partition by o_custkey order by o_orderkey) = 1")
def model_unique_by(spark, d):
    """The key comes from the schema's hint."""
    return SHOP.unique_by(ordered(load(spark, d, "orders"), "o_orderkey")).frame.select("o_orderkey", "o_custkey")


@named("model_group_by", "select o_custkey, list(o_orderkey order by o_orderkey) as keys from orders group by 1")
def model_group_by(spark, d):
    grouped = SHOP.group_by(ordered(load(spark, d, "orders"), "o_orderkey"))
    return grouped.select("o_custkey", F.transform("items", lambda x: x["o_orderkey"]).alias("keys"))


@named("model_sort_by", "select o_orderkey, row_number() over (order by o_totalprice, o_orderkey) - 1 as place from orders")
def model_sort_by(spark, d):
    """Sorted by the hint's key; the row numbers show the order."""
    return numbered(SHOP.sort_by(ordered(load(spark, d, "orders"), "o_orderkey"))).select("o_orderkey", F.col("_n").alias("place"))


@named("model_hash", "select n_nationkey, cast(case when h >= 2147483648 then h - 4294967296 else h end as integer) as h from (select n_nationkey, ((23 * 31 + n_nationkey) * 31 + n_regionkey) & 4294967295 as h from nation)")
def model_hash(spark, d):
    shape = model(s.object(n_nationkey=s.int(), n_regionkey=s.int()), "hash")
    n = load(spark, d, "nation")
    return n.select("n_nationkey", shape.hash(F.struct("n_nationkey", "n_regionkey")).alias("h"))


@named("pipe_coerce", "select o_orderkey, cast(o_orderkey as double) * 2 as v from orders")
def pipe_coerce(spark, d):
    shape = s.object(o_orderkey=s.int(), v=s.number().coerce().pipe(lambda c: c * 2))
    made = validate.safe_parse(load(spark, d, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("v")), shape)
    return made.select("data.o_orderkey", "data.v")


def compiled(df: DataFrame, p) -> DataFrame:
    """For use without a query: the rows for which a predicate holds."""
    return df.where(compile_predicate(p(P), {f.name: f.dataType for f in df.schema}))
