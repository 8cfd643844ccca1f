r"""Operator 2, URL filters: pattern rules indexed by their rarest literal token. DataFrame functions only.

A rule is a regular expression over ``host + path`` with the literal tokens that any fitting url must hold (maximal runs
of ASCII letters and digits). Over all urls the tokens' counts are taken, and each rule is filed under its rarest token.
A url's tokens fetch the rules filed under them by an equi-join; only those run their expression. A rule without a
literal token is tried on every url, as a literal expression that a task compiles once; there may be any number of those.

Host and path rules are patterns of a fixed form (a host's end, a path's beginning), so the fetched ones are tested by
comparing ends and beginnings, and no expression is compiled for them. Of those that fit, the longest wins (then the
first in alphabetical order). Where none fits, the pattern rules decide: block if any fits, else allow.

The rules are a parameter of the job, held as a local table. It is sent whole to all tasks only while it has at most
``BROADCAST_RULES`` rows; beyond that the join shuffles by token. The rows of one url meet again in a sum by row, which
is combined before the shuffle.

Defined results: a null url, or one without ``://``, has an empty host and path, so no host rule fits it, and it is
judged by the pattern rules on an empty text; a null page_id is kept; repeated rows are judged each for itself; an
empty table gives an empty result; urls of any length are judged whole; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import ascii_lower, table

BROADCAST_RULES = 200_000
#: So many rules without a literal token are tried in one projection.
AT_ONCE = 50


@dataclass(frozen=True)
class Rule:
    name: str
    pattern: str
    tokens: tuple[str, ...]
    verdict: str
    by_host: bool
    host: str | None = None
    path: str | None = None


def host_rule(rule: str, verdict: str) -> Rule:
    """``example.com/en/``: that host and its subdomains, paths that start with ``/en/``."""
    host, slash, path = rule.partition("/")
    path = slash + path
    #: The last run of the path may go on in the url, so it is no whole token unless something ends it.
    whole = re.findall(r"[A-Za-z0-9]+(?=[^A-Za-z0-9])", path)
    return Rule(rule, rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", tuple(dict.fromkeys(re.findall(r"[A-Za-z0-9]+", host) + whole)), verdict, True, host, path)


def pattern_rule(name: str, pattern: str, tokens: tuple[str, ...], verdict: str = "block") -> Rule:
    return Rule(name, pattern, tokens, verdict, False)


#: The rules of the contract.
HOST_RULES = (host_rule("com/", "allow"), host_rule("example.com/en/", "block"), host_rule("www.example.com/en/", "allow"), host_rule("net/es/", "block"), host_rule("net/fr/", "block"))
#: What decides where no host rule fits.
PATTERN_RULES = (
    pattern_rule("login", r"/login(?:[./]|$)", ("login",)),
    pattern_rule("signup", r"/signup(?:[./]|$)", ("signup",)),
    pattern_rule("cart", r"/cart(?:[./]|$)", ("cart",)),
    pattern_rule("ads", r"^(?:[^/]*\.)?ads\.", ("ads",)),
    pattern_rule("pills", r"^(?:[^/]*\.)?cheap-pills\.", ("cheap", "pills")),
    pattern_rule("bets", r"^(?:[^/]*\.)?free-bets\.", ("free", "bets")),
    pattern_rule("feed", r"/feed/?$", ("feed",)),
)


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty if it is null or has no ``://``."""
    whole = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    of = lambda k: F.coalesce(F.regexp_extract(url, whole, k), F.lit(""))
    return ascii_lower(of(1)), of(2)


def tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, "[^A-Za-z0-9]+"), lambda x: x != ""))


def judged(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[Rule, ...] = HOST_RULES + PATTERN_RULES) -> DataFrame:
    """For each row: the id, host, path, rule (of the host rule that won, else null) and verdict."""
    spark = pages.sparkSession
    host, path = parts(F.col(url_col))
    urls = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    #: A smaller rank wins: host rules before pattern rules, longer before shorter, then by name.
    ranked = sorted(rules, key=lambda r: (not r.by_host, -len(r.name) if r.by_host else r.verdict != "block", r.name))
    anywhere = [k for k, r in enumerate(ranked) if not r.tokens]
    local = lambda f: f if len(ranked) > BROADCAST_RULES else F.broadcast(f)
    literal = spark.createDataFrame([(k, t) for k, r in enumerate(ranked) for t in r.tokens] or [(-1, "")], "rank int, token string")
    columns = "rank int, rule string, pattern string, ends string, begins string, verdict string"
    rule_table = spark.createDataFrame([(k, r.name if r.by_host else None, None if r.by_host else r.pattern, r.host, r.path, r.verdict) for k, r in enumerate(ranked)] or [(-1, None, "", None, None, "")], columns)
    every = urls.select("row", "id", "host", "path", F.explode_outer(tokens(F.concat("host", "path"))).alias("token"))
    counts = every.select("token").join(local(literal.select("token").distinct()), "token", "left_semi").groupBy("token").count()
    #: A token that no url holds is the rarest of all, and its rule is fetched by none.
    index = literal.join(counts, "token", "left").groupBy("rank").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "token")).alias("least")).select("rank", F.col("least.token").alias("token"))
    index = index.join(rule_table.select("rank", "pattern", "ends", "begins"), "rank").select("token", "rank", "pattern", "ends", "begins")
    fetched = every.join(local(index), "token", "left")
    by_host = F.endswith(F.concat(F.lit("."), F.col("host")), F.concat(F.lit("."), F.col("ends"))) & F.startswith(F.col("path"), F.col("begins"))
    #: Only where a pattern rule was fetched is its expression looked at.
    fits = F.when(F.when(F.col("pattern").isNull(), by_host).otherwise(F.rlike(F.concat("host", "path"), F.col("pattern"))), F.col("rank"))
    best = fetched.groupBy("row", "id", "host", "path").agg(F.min(fits).alias("rank"))
    for start in range(0, len(anywhere), AT_ONCE):
        tried = [F.when(F.concat("host", "path").rlike(ranked[k].pattern), F.lit(k)) for k in anywhere[start : start + AT_ONCE]]
        best = best.withColumn("rank", F.least("rank", *tried))
    return best.join(local(rule_table.select("rank", "rule", "verdict")), "rank", "left").select("id", "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each page: page_id, host, path, rule, verdict."""
    return judged(table(spark, sf_dir, "pages").select("page_id", "url")).withColumnRenamed("id", "page_id")


OP2_SQL = r"""
with u as (select page_id, case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end rest from pages),
p as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path from u),
r as (select *, case
  when (host = 'www.example.com' or ends_with(host, '.www.example.com')) and starts_with(path, '/en/') then 'www.example.com/en/'
  when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/en/') then 'example.com/en/'
  when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/es/') then 'net/es/'
  when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/fr/') then 'net/fr/'
  when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/') then 'com/' end as rule from p)
select page_id, host, path, rule, case when rule in ('com/', 'www.example.com/en/') then 'allow' when rule is not null then 'block'
  when regexp_matches(host || path, '/(login|signup|cart)([./]|$)|/feed/?$') or regexp_matches(host || path, '^([^/]*\.)?(ads|cheap-pills|free-bets)\.') then 'block' else 'allow' end as verdict
from r
"""
