"""Named queries for checks, formats, changes and compositions of schemas, each with the same in DuckDB's SQL.

Texts are made from keys, so that the SQL can tell by arithmetic which of them are right.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import validate, values
from .catalog import load, named
from .schema import Schema, s


def verdicts(df: DataFrame, key: str, **tests: tuple[Column, Schema]) -> DataFrame:
    """The key, and for each test whether its value is valid."""
    rows = df.select(key, *[c.alias(n) for n, (c, _) in tests.items()])
    return rows.select(key, *[validate.compile_schema(shape, F.col(n), rows.schema[n].dataType).valid.alias(n) for n, (_, shape) in tests.items()])


def codes(df: DataFrame, key: str, shape: Schema) -> DataFrame:
    """The key, and what is wrong with the row: path:code."""
    made = validate.safe_parse(df, shape)
    return made.select(key, F.transform("issues", lambda x: F.concat(x["path"], F.lit(":"), x["code"])).alias("found"))


@named("check_strings", r"""select p_partkey, length(p_name) >= 12 as least, length(p_name) <= 12 as most, length(p_name) = 11 as exact, starts_with(p_name, 's') as starts, ends_with(p_name, 't') as ends, contains(p_name, 'wid') as has,
  p_type in ('ECONOMY', 'SMALL') as one, regexp_full_match(p_brand, 'Brand#[1-3]\d|Brand#5') as fits, regexp_full_match(p_brand, 'Brand#\d') as own, p_size % 2 = 1 as filled, length(regexp_replace(p_brand, '[^0-9]', '', 'g')) = 2 as digits from part""")
def check_strings(spark, d):
    name, brand = F.col("p_name"), F.col("p_brand")
    text = s.string()
    return verdicts(
        load(spark, d, "part"), "p_partkey", least=(name, text.min(12)), most=(name, text.max(12)), exact=(name, text.length(11)), starts=(name, text.starts_with("s")), ends=(name, text.ends_with("t")), has=(name, text.includes("wid")),
        one=(F.col("p_type"), text.one_of("ECONOMY", "SMALL")), fits=(brand, text.regex(r"^Brand#[1-3]\d$|^Brand#5$")), own=(brand, text.string_format("brand", r"^Brand#\d$")),
        filled=(F.when(F.col("p_size") % 2 == 1, name).otherwise(""), text.no_empty()), digits=(brand, text.digits_length(2)),
    )


@named("check_utf16", "select p_partkey, p_size % 2 = 0 as four from part")
def check_utf16(spark, d):
    """Lengths count UTF-16 units: one character beyond the first plane is two."""
    return verdicts(load(spark, d, "part"), "p_partkey", four=(F.when(F.col("p_size") % 2 == 0, "ab\U0001f600").otherwise("abé"), s.string().length(4)))


@named("check_anchors", "select p_partkey, p_size % 4 = 0 as plain, p_size % 4 <> 1 as white from part")
def check_anchors(spark, d):
    """An anchor inside an alternative doesn't match before a final line end; white space is Unicode's."""
    text = F.when(F.col("p_size") % 4 == 0, "a").when(F.col("p_size") % 4 == 1, "b").when(F.col("p_size") % 4 == 2, "a\n").otherwise(" ")
    return verdicts(load(spark, d, "part"), "p_partkey", plain=(text, s.string().regex("^a$|^c$")), white=(text, s.string().regex(r"^a|\s")))


@named("check_numbers", """select p_partkey, p_retailprice > 1000 as gt, p_retailprice >= 1000 as gte, p_retailprice < 1000 as lt, p_retailprice <= 1000 as lte, p_size > 25 as positive, p_size < 25 as negative, p_size >= 25 as nonnegative, p_size <= 25 as nonpositive,
  p_size % 5 = 0 as fives, fmod(p_retailprice, 0.5) = 0 as halves, p_size in (1, 2, 3) as one, p_size % 4 <> 0 and p_size % 4 <> 1 as finite, p_partkey % 3 <> 0 as safe, p_partkey % 3 <> 0 as int32, p_retailprice::float::double = p_retailprice as float32,
  p_size % 4 <> 0 and p_size % 4 <> 1 as float64, floor(p_retailprice) = p_retailprice as whole, p_size % 4 = 0 or p_size % 4 = 2 as nan_passes from part""")
def check_numbers(spark, d):
    price, size, key = F.col("p_retailprice"), F.col("p_size"), F.col("p_partkey")
    odd = F.when(size % 4 == 0, float("nan")).when(size % 4 == 1, float("-inf")).when(size % 4 == 2, 1.5).otherwise(-2.5)
    n = s.number()
    return verdicts(
        load(spark, d, "part"), "p_partkey", gt=(price, n.gt(1000)), gte=(price, n.gte(1000)), lt=(price, n.lt(1000)), lte=(price, n.lte(1000)), positive=(size - 25, s.int().positive()), negative=(size - 25, s.int().negative()),
        nonnegative=(size - 25, s.int().nonnegative()), nonpositive=(size - 25, s.int().nonpositive()), fives=(size, s.int().multiple_of(5)), halves=(price, n.step(0.5)), one=(size, s.int().one_of(1, 2, 3)), finite=(odd, n.finite()),
        safe=(F.when(key % 3 == 0, 2.0**53).otherwise(2.0**53 - 1), n.safe()), int32=(F.when(key % 3 == 0, 2.0**31).otherwise(-(2.0**31)), n.int32()), float32=(price, n.float32()), float64=(odd, n.float64()), whole=(price, s.int()), nan_passes=(odd, n.min(0)),
    )


@named("check_dates", """select event_id, ts >= timestamp '2024-01-02' as least, ts <= timestamp '2024-01-05' as most, ts between timestamp '2024-01-02' and timestamp '2024-01-05' as inside, isodow(ts) in (6, 7) as weekend, month(ts) in (1, 3) as months,
  date_trunc('minute', ts) = ts as minute, date_trunc('millisecond', ts) = ts as milli from events""")
def check_dates(spark, d):
    import datetime as dt

    a, b, ts = dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 5), F.col("ts").cast("timestamp_ntz")
    return verdicts(load(spark, d, "events"), "event_id", least=(ts, s.date().min(a)), most=(ts, s.date().max(b)), inside=(ts, s.date().between(a, b)), weekend=(ts, s.date().days_of_week(6, 7)), months=(ts, s.date().months_of_year(1, 3)), minute=(ts, s.date().truncate_to("minute")), milli=(ts, s.date().truncate_to("millisecond")))


def customers(spark, d) -> DataFrame:
    return load(spark, d, "customer")


def text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def third(bad: str, good: Column) -> Column:
    """Every third text is a bad one."""
    return F.when(F.col("c_custkey") % 3 == 0, F.lit(bad)).otherwise(good)


@named("formats_network", """select c_custkey, c_custkey % 300 < 256 as ipv4, c_custkey % 3 <> 0 as ipv6, c_custkey % 40 <= 32 as cidrv4, c_custkey % 200 <= 128 as cidrv6, c_custkey % 3 <> 0 as mac, c_custkey % 3 <> 0 as hostname, c_custkey % 3 <> 0 as domain,
  c_custkey % 3 <> 0 as e164, c_custkey % 3 <> 0 as http_url, c_custkey % 3 <> 0 as url from customer""")
def formats_network(spark, d):
    key = F.col("c_custkey")
    t = s.string()
    return verdicts(
        customers(spark, d), "c_custkey", ipv4=(text(key % 300, ".", key % 256, ".0.255"), t.ipv4()), ipv6=(third("1::2::3", text("2001:db8::", F.hex(key % 65536))), t.ipv6()), cidrv4=(text("10.0.0.0/", key % 40), t.cidrv4()), cidrv6=(text("::1/", key % 200), t.cidrv6()),
        mac=(third("aa:bb:cc:dd:ee:F0", F.lit("aa:bb:cc:dd:ee:f0")), t.mac()), hostname=(third("-bad.example", text("host-", key, ".example")), t.hostname()), domain=(third("example", text("example", key, ".com")), t.domain()), e164=(third("+012345678", text("+", key + 1000000)), t.e164()),
        http_url=(third("ftp://example.com", text("https://example.com/", key)), t.http_url()), url=(third("example.com", text("mailto:", key)), t.url()),
    )


@named("formats_email", "select c_custkey, c_custkey % 4 = 0 as email, c_custkey % 4 <> 2 as html5, c_custkey % 4 = 0 or c_custkey % 4 = 3 as rfc5322, c_custkey % 4 <> 2 as loose from customer")
def formats_email(spark, d):
    key = F.col("c_custkey")
    at = F.when(key % 4 == 0, text("a.b+", key, "@example.org")).when(key % 4 == 1, text("a", key, "@localhost")).when(key % 4 == 2, F.lit("a b@example.org")).otherwise(text("a!", key, "@example.org"))
    t = s.string()
    return verdicts(customers(spark, d), "c_custkey", email=(at, t.email()), html5=(at, t.html5_email()), rfc5322=(at, t.rfc5322_email()), loose=(at, t.unicode_email()))


@named("formats_ids", """select c_custkey, c_custkey % 10 between 1 and 8 as uuid, c_custkey % 10 = 4 as uuid4, c_custkey % 3 <> 0 as guid, c_custkey % 3 <> 0 as ulid, c_custkey % 3 <> 0 as xid, c_custkey % 3 <> 0 as ksuid, c_custkey % 3 <> 0 as nanoid,
  c_custkey % 3 <> 0 as cuid, c_custkey % 3 <> 0 as cuid2, c_custkey % 3 <> 0 as jwt from customer""")
def formats_ids(spark, d):
    key = F.col("c_custkey")
    h, t = F.md5("c_name"), s.string()
    cut = lambda n: F.substring(F.upper(F.concat(h, h)), 1, n)
    uuid = text(F.substring(h, 1, 8), "-", F.substring(h, 9, 4), "-", key % 10, F.substring(h, 14, 3), "-a", F.substring(h, 18, 3), "-", F.substring(h, 21, 12))
    return verdicts(
        customers(spark, d), "c_custkey", uuid=(uuid, t.uuid()), uuid4=(uuid, t.uuid(4)), guid=(third("123", uuid), t.guid()), ulid=(third("U" * 26, cut(26)), t.ulid()), xid=(third("w" * 20, cut(20)), t.xid()), ksuid=(third("-" * 27, cut(27)), t.ksuid()), nanoid=(third("a" * 20, cut(21)), t.nanoid()),
        cuid=(third("x123456", text("c", h)), t.cuid()), cuid2=(third("A", h), t.cuid2()), jwt=(third("a.b", text(h, ".", h, ".x_-")), t.jwt()),
    )


@named("formats_bytes", """select c_custkey, c_custkey % 3 <> 0 as hex, c_custkey % 3 <> 0 as base64, c_custkey % 3 <> 0 as base64url, c_custkey % 2 = 0 as sha256, c_custkey % 2 = 1 as md5, c_custkey % 3 <> 0 as sha1_base64, c_custkey % 3 <> 0 as integers,
  c_custkey % 3 <> 0 as numbers, c_custkey % 3 <> 0 as bigints, c_custkey % 3 <> 0 as booleans, c_custkey % 3 <> 0 as lower, c_custkey % 3 <> 0 as upper, c_custkey % 3 <> 0 as emoji, c_custkey % 3 <> 0 as protocol from customer""")
def formats_bytes(spark, d):
    key = F.col("c_custkey")
    h, t = F.md5("c_name"), s.string()
    digest = F.when(key % 2 == 0, F.sha2("c_name", 256)).otherwise(h)
    return verdicts(
        customers(spark, d), "c_custkey", hex=(third("0g", h), t.hex()), base64=(third("a", F.base64(F.col("c_name").cast("binary"))), t.base64()), base64url=(third("a+b", text("-_", h)), t.base64url()), sha256=(digest, t.digest("sha256")), md5=(digest, t.digest("md5")),
        sha1_base64=(third("x", F.base64(F.unhex(F.sha1("c_name")))), t.digest("sha1", "base64")), integers=(third("1.5", text("-", key)), t.integer_text()), numbers=(third("1.", text(key, ".25")), t.number_text()), bigints=(third("n", text(key, "n")), t.bigint_text()),
        booleans=(third("yes", F.lit("TRUE")), t.boolean_text()), lower=(third("aB", h), t.lowercase_text()), upper=(third("Ab", F.upper(h)), t.uppercase_text()), emoji=(third("ab", F.lit("\U0001f600❤")), t.emoji()), protocol=(third("ftp", F.lit("https")), t.http_protocol()),
    )


@named("formats_time", """select c_custkey, (y % 4 = 0 and y % 100 <> 0) or y % 400 = 0 as day, h < 24 and m < 60 as clock, h < 24 and m < 60 as seconds, h < 24 as whole, h < 24 and m < 60 as shifted, c_custkey % 3 <> 0 as duration, c_custkey % 4 <> 2 as extended
  from (select c_custkey, 1890 + c_custkey % 130 as y, c_custkey % 30 as h, c_custkey % 70 as m from customer)""")
def formats_time(spark, d):
    key = F.col("c_custkey")
    t, h, m = s.string(), F.lpad((key % 30).cast("string"), 2, "0"), F.lpad((key % 70).cast("string"), 2, "0")
    return verdicts(
        customers(spark, d), "c_custkey", day=(text(key % 130 + 1890, "-02-29"), t.iso_date()), clock=(text(h, ":", m), t.time()), seconds=(text(h, ":", m, ":59.123"), t.time(3)), whole=(text("2024-02-29T", h, ":00:00Z"), t.datetime()), shifted=(text("2024-02-29T12:00+", h, ":", m), t.datetime(offset=True)),
        duration=(third("P", text("P", key, "DT1H")), t.duration()), extended=(F.when(key % 4 == 0, "-P1.5Y").when(key % 4 == 1, "P1Y2W").when(key % 4 == 2, "P1.5Y2M").otherwise("P-1DT+2.5S"), t.extended_duration()),
    )


@named("change_strings", """select c_custkey, c_name as trimmed, lower(c_name) as lowered, upper(c_name) as raised, 'café' as composed, case when c_custkey % 2 = 0 then c_name end as filled,
  '(' || substr(t, 1, 2) || ') ' || substr(t, 3, length(t) - 6) || '-' || right(t, 4) as phone, substr(n, 1, 2) || '.' || substr(n, 3, 3) || '.' || substr(n, 6, 3) || '/' || substr(n, 9, 4) || '-' || substr(n, 13, 2) as cnpj
  from (select *, lpad(cast(c_custkey as varchar), case when c_custkey % 2 = 0 then 10 else 11 end, '1') as t, lpad(cast(c_custkey as varchar), 14, '2') as n from customer)""")
def change_strings(spark, d):
    key = F.col("c_custkey")
    name, t = F.col("c_name"), s.string()
    shape = s.object(c_custkey=s.int(), trimmed=t.trim(), lowered=t.lowercase(), raised=t.uppercase(), composed=t.normalize("NFC"), filled=t.no_empty().optional(), phone=t.phone_br(), cnpj=t.cnpj())
    rows = customers(spark, d).select(
        "c_custkey", text("  \t", name, "﻿\n").alias("trimmed"), name.alias("lowered"), name.alias("raised"), F.lit("café").alias("composed"), F.when(key % 2 == 0, name).otherwise("").alias("filled"),
        F.lpad(key.cast("string"), F.when(key % 2 == 0, 10).otherwise(11), F.lit("1")).alias("phone"), F.lpad(key.cast("string"), 14, "2").alias("cnpj"),
    )
    return validate.safe_parse(rows, shape).select("data.*")


@named("object_rewrites", """select c_custkey, ['c_name:unrecognized_key'] as strict, [] as partial, case when c_nationkey >= 20 then ['c_nationkey:too_big'] else [] end as extended, ['c_name:expected_number'] as caught, case when c_acctbal < 0 then ['c_acctbal:too_small'] else [] end as merged,
  case when c_mktsegment in ('c_custkey', 'c_name') then [] else [':invalid_enum'] end as key from customer""")
def object_rewrites(spark, d):
    c = customers(spark, d)
    base = s.object(c_custkey=s.int(), c_acctbal=s.number())
    found = lambda shape, *cols: F.transform(validate.compile_schema(shape, F.struct(*cols), c.select(*cols).schema).issues, lambda x: F.concat(x["path"], F.lit(":"), x["code"]))
    wide = s.object(c_custkey=s.int(), c_name=s.string(), c_acctbal=s.number()).omit("c_name").pick("c_custkey", "c_acctbal").required()
    none = c.select("c_custkey").schema
    keys = s.object(c_custkey=s.int(), c_name=s.string()).keyof()
    key = validate.compile_schema(keys, F.col("c_mktsegment"), c.schema["c_mktsegment"].dataType).issues
    return c.select(
        "c_custkey", found(wide.strict(), "c_custkey", "c_acctbal", "c_name").alias("strict"), F.transform(validate.compile_schema(base.partial("c_acctbal"), F.struct("c_custkey"), none).issues, lambda x: x["code"]).alias("partial"),
        found(base.extend(c_nationkey=s.int().lt(20)), "c_custkey", "c_acctbal", "c_nationkey").alias("extended"), found(base.catchall(s.number()), "c_custkey", "c_acctbal", "c_name").alias("caught"), found(base.merge(s.object(c_acctbal=s.number().min(0))).loose(), "c_custkey", "c_acctbal", "c_name").alias("merged"),
        F.transform(key, lambda x: F.concat(x["path"], F.lit(":"), x["code"])).alias("key"),
    )


@named("composition", """select o_orderkey, p < 50000 or p > 200000 as either, (p < 100000) <> (p > 50000) as exactly_one, not p < 100000 as neither, p > 50000 and p < 200000 as all_of, case when o_orderstatus = 'F' then p > 100000 else p > 200000 end as depends,
  p > 150000 as refined, p > 150000 and p < 160000 as custom from (select *, o_totalprice as p from orders)""")
def composition(spark, d):
    n = s.number()
    c = load(spark, d, "orders")
    shape = s.object(o_orderstatus=s.string(), o_totalprice=s.when("o_orderstatus", lambda v: v == "F", n.gt(100000), n.gt(200000)))
    p = F.col("o_totalprice")
    rows = verdicts(
        c, "o_orderkey", either=(p, n.lt(50000).or_(n.gt(200000))), exactly_one=(p, s.xor(n.lt(100000), n.gt(50000))), neither=(p, s.not_(n.lt(100000))), refined=(p, n.refine(lambda v: v > 150000)), custom=(p, s.custom(n.gt(150000), lambda v: v < 160000)),
        all_of=(F.struct("o_totalprice"), s.object(o_totalprice=n.gt(50000)).and_(s.object(o_totalprice=n.lt(200000)))), depends=(F.struct("o_orderstatus", "o_totalprice"), shape),
    )
    return rows


@named("refine_paths", "select o_orderkey, case when o_totalprice > 200000 then ['o_totalprice:custom'] else [] end as found from orders")
def refine_paths(spark, d):
    shape = s.object(o_orderkey=s.int(), o_totalprice=s.number()).refine(lambda v: v["o_totalprice"] <= 200000, "too dear", "o_totalprice")
    return codes(load(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", shape)


@named("unions_by_tag", "select o_orderkey, case when o_orderstatus = 'F' then o_totalprice > 100000 when o_orderstatus = 'O' then o_totalprice < 100000 else false end as valid from orders")
def unions_by_tag(spark, d):
    shape = s.discriminated_union("o_orderstatus", s.object(o_orderstatus=s.literal("F"), o_totalprice=s.number().gt(100000)), s.object(o_orderstatus=s.literal("O"), o_totalprice=s.number().lt(100000)))
    return verdicts(load(spark, d, "orders"), "o_orderkey", valid=(F.struct("o_orderstatus", "o_totalprice"), shape))


@named("collection_checks", """select o_orderkey, k >= 2 as least, k <= 2 as most, k = 3 as exact, k > 0 as filled, k < 2 as different, k = 0 or p > 100000 as amounts from (select o_orderkey, cast(o_orderkey % 4 as integer) as k, o_totalprice as p from orders)""")
def collection_checks(spark, d):
    o = load(spark, d, "orders")
    items = F.array_repeat(F.col("o_totalprice"), (F.col("o_orderkey") % 4).cast("int"))
    amounts = F.map_from_arrays(F.when(F.col("o_orderkey") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("p"))), F.when(F.col("o_orderkey") % 4 == 0, F.array().cast("array<double>")).otherwise(F.array("o_totalprice")))
    n = s.number()
    return verdicts(o, "o_orderkey", least=(items, s.array(n).min(2)), most=(items, s.array(n).max(2)), exact=(items, s.array(n).length(3)), filled=(items, s.array(n).non_empty()), different=(items, s.set(n)), amounts=(amounts, s.record(n.gt(100000))))


@named("coerce_values", "select o_orderkey, o_orderkey as whole, o_totalprice as number, cast(o_orderkey as varchar) as text, o_orderkey % 2 = 1 as flag, o_orderdate as day, o_orderkey * 2 as twice from orders")
def coerce_values(spark, d):
    o = load(spark, d, "orders")
    rows = o.select("o_orderkey", F.col("o_orderkey").cast("string").alias("whole"), F.col("o_totalprice").cast("string").alias("number"), F.col("o_orderkey").alias("text"), (F.col("o_orderkey") % 2).cast("string").alias("flag"), F.col("o_orderdate").cast("string").alias("day"), F.col("o_orderkey").alias("twice"))
    shape = s.object(o_orderkey=s.int(), whole=s.int().coerce(), number=s.number().coerce(), text=s.string().coerce(), flag=s.boolean().coerce(), day=s.date().coerce(), twice=s.int().coerce(lambda c: c * 2))
    return validate.safe_parse(rows, shape).select("data.*").withColumn("day", F.col("day").cast("timestamp_ntz"))


@named("recursive_depth", "select p_partkey, cast(p_size % 10 as integer) < 6 as valid from part")
def recursive_depth(spark, d):
    """Nested nodes; what goes deeper than the schema's six levels is invalid."""
    node: dict[str, Schema] = {}
    node["of"] = s.object(v=s.int(), next=s.lazy(lambda: node["of"]).optional())
    shape = s.lazy(lambda: node["of"])
    depth = (F.col("p_size") % 10).cast("int")
    made = F.concat(F.repeat(F.lit('{"v":1,"next":'), depth), F.lit('{"v":2}'), F.repeat(F.lit("}"), depth))
    return verdicts(load(spark, d, "part"), "p_partkey", valid=(F.parse_json(made), shape))


@named("format_modes", """select c_custkey, c_custkey % 2 = 0 as strict, c_custkey % 2 = 1 as bare, '(' || substr(n, 1, 2) || ') ' || substr(n, 3, 4) as made from (select c_custkey, lpad(cast(c_custkey as varchar), 6, '0') as n from customer)""")
def format_modes(spark, d):
    """In strict mode the text must have the mask's form; without stripping it must be digits alone."""
    key = F.col("c_custkey")
    plain = F.lpad(key.cast("string"), 6, "0")
    formed = text("(", F.substring(plain, 1, 2), ") ", F.substring(plain, 3, 4))
    either = F.when(key % 2 == 0, formed).otherwise(plain)
    rows = customers(spark, d).select("c_custkey", either.alias("strict"), either.alias("bare"), plain.alias("made"))
    mask, t = "(##) ####", s.string()
    made = validate.compile_schema(t.format(mask), F.col("made"), rows.schema["made"].dataType).data
    valid = [validate.compile_schema(x, F.col(n), rows.schema[n].dataType).valid.alias(n) for n, x in (("strict", t.format(mask, mode="strict")), ("bare", t.format(mask, strip=False)))]
    return rows.select("c_custkey", *valid, made.alias("made"))


@named("codec_values", "select o_orderkey, cast(o_orderkey as varchar) as text, o_orderkey as back from orders")
def codec_values(spark, d):
    """A codec of values: decoded in parsing, encoded the other way."""
    shape = s.object(o_orderkey=s.int(), v=s.codec(s.string(), s.int(), lambda c: c.cast("long"), lambda c: c.cast("string")))
    rows = load(spark, d, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("v"))
    parsed = validate.safe_parse(rows, shape)
    return parsed.select("o_orderkey", values.encoded(shape, F.col("data"))["v"].alias("text"), F.col("data.v").alias("back"))


@named("transform_select", "select c_custkey, upper(c_name) as c_name from customer")
def transform_select(spark, d):
    """A key that isn't selected is dropped, whatever is said of it."""
    shape = s.object(c_custkey=s.int(), c_name=s.string(), c_mktsegment=s.string())
    made = values.transformed(shape, F.struct(*shape.fields), {"c_name": "uppercase", "c_mktsegment": "lowercase"}, ("c_custkey", "c_name"))
    return customers(spark, d).select(made.alias("t")).select("t.*")
