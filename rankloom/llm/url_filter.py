"""URL filter: a Bloom filter cascade gives exact membership of listed keys over the corpus's keys.

A rule is a host and a path; it fits that host with all its subdomains where the url's path starts
with the rule's. Hence a url fits a rule exactly if the rule's key (host || path) is among the url's
*candidate keys*: each suffix of its host at a label, with each prefix of its path that has the
length of some rule's path. The candidates of all urls are the complete universe, so a cascade over
them answers exactly: level 1 encodes the listed keys, level 2 those other candidates that level 1
lets through, level 3 the listed keys that level 2 lets through, and so on until none is left.

The urls are judged without a join, inside the scan, by one path for lists of every length. Only what
passes level 1 is ever shuffled when a cascade is built (the listed keys seen and a few false positives).
Levels go to the executors as literals, one for each level. A list whose levels would be longer than
`max_bytes` is dealt to parts by a hash of the key, each with a cascade of its own over its part of the
universe; the urls then pass one part after the other, with the best rule so far written in between. So
what is sent at once is bounded, and the verdicts are the same for any number of parts (tests).

The longest rule wins; of two rules of one length (the same key listed with two verdicts, or a host and a
path that are cut elsewhere) the verdict that comes first in the alphabet, then the rule that does.

Defined results: a null url, or one without "://", has an empty host and path and fits nothing; an
empty list or table is fine; repeated urls are judged alike; a url of any length is judged whole. The
result has the columns of the urls and host, path, rule, verdict; a url column of one of these four names
is replaced, any other one stays, whatever it is called.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, fewer, keep

BITMAP = 32768  # bits of one bitmap_construct_agg
ADDED = ("host", "path", "rule", "verdict")
MARK = "\x1f"  # between a verdict and a key; hosts, paths and verdicts of rules have none


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def candidate_keys(host: Column, path: Column, labels: int, lengths: list[int]) -> Column:
    """The keys of all rules that could fit, the longest host first and then the longest path."""
    parts = F.split(host, r"\.")
    most = F.least(F.size(parts), F.lit(max(labels, 1)))
    suffixes = F.transform(F.sequence(most, F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(parts, -k, k), "."))
    sized = F.filter(F.array(*[F.lit(n) for n in sorted(set(lengths), reverse=True)] or [F.lit(-1)]), lambda n: (n >= 0) & (n <= F.length(path)))
    return F.flatten(F.transform(suffixes, lambda s: F.transform(sized, lambda n: F.concat(s, F.substring(path, F.lit(1), n)))))


class Cascade:
    """Levels of (bits, number of bits, number of hashes). `contains` is exact on the universe it was built from."""

    def __init__(self) -> None:
        self.levels: list[tuple[bytes, int, int]] = []

    @property
    def n_bytes(self) -> int:
        return sum(len(b) for b, _, _ in self.levels)

    def add(self, keys: DataFrame, n: int, rate: float) -> None:
        hashes = max(1, round(math.log2(1 / rate)))
        bits = max(8, math.ceil(n * hashes / math.log(2)))
        places = F.explode(F.array(*[_place(F.col("key"), len(self.levels), i, bits) for i in range(hashes)]))
        maps = keys.select(places.alias("p")).groupBy(F.expr(f"p div {BITMAP}").alias("b")).agg(F.bitmap_construct_agg(F.expr(f"p % {BITMAP}")).alias("m"))
        data = bytearray(math.ceil(bits / BITMAP) * BITMAP // 8)
        for r in maps.collect():  # in one job; at most bits / 32768 rows, within max_bytes of judge_urls
            data[r.b * BITMAP // 8 : r.b * BITMAP // 8 + len(r.m)] = r.m
        self.levels.append((bytes(data[: math.ceil(bits / 8)]), bits, hashes))

    def level_has(self, key: Column, level: int) -> Column:
        data, bits, hashes = self.levels[level]
        places = F.array(*[_place(key, level, i, bits) for i in range(hashes)])
        byte = lambda p: F.conv(F.hex(F.substring(F.lit(bytearray(data)), F.floor(p / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return F.forall(places, lambda p: F.call_function("shiftright", byte(p), (p % 8).cast("int")).bitwiseAND(F.lit(1)) == 1)

    def contains(self, key: Column) -> Column:
        result = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(range(len(self.levels))):
            result = F.when(self.level_has(key, level), result).otherwise(F.lit(level % 2 == 1))
        return result


def _place(key: Column, level: int, i: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(level), F.lit(i)), F.lit(bits).cast("long"))


def build_cascade(listed: DataFrame, universe: DataFrame, size: int, universe_size: int) -> Cascade:
    """listed(key): distinct. universe(key): may repeat keys; it is scanned once. Both sizes only set the rates.

    Each level draws other hashes and lets some half of the keys through, so levels follow until none is left.
    """
    cascade = Cascade()
    rate = min(0.5, max(1e-9, math.sqrt(0.5) * max(size, 1) / max(universe_size, 1)))
    cascade.add(listed, size, rate)
    outside = keep(universe.where(cascade.level_has(F.col("key"), 0)).distinct().join(listed, "key", "left_anti"))
    inside, outside = fewer(listed, size), fewer(outside, outside.count())
    while n := outside.count():
        cascade.add(outside, n, 0.5)
        inside, outside = outside, keep(inside.where(cascade.level_has(F.col("key"), len(cascade.levels) - 1)))
    return cascade


def judge_urls(urls: DataFrame, rules: DataFrame, default: str = "allow", max_bytes: int = 32 << 20) -> DataFrame:
    """Adds host, path, rule and verdict to urls(url, ...). rules(host, path, verdict).

    Where no rule fits, rule is null and the verdict is `default`: the key is listed nowhere.
    """
    rules = keep(rules.select(F.concat("host", "path").alias("key"), F.length("path").alias("n"), F.size(F.split("host", r"\.")).alias("labels"), "verdict").distinct())
    facts = rules.agg(F.count("*").alias("rules"), F.max("labels").alias("labels"), F.collect_set("n").alias("lengths"), F.sort_array(F.collect_set("verdict")).alias("kinds")).first()
    parts = max(1, -(-4 * facts.rules // max_bytes))  # ten hashes on level 1 and what follows take some 3 bytes a rule
    tagged = lambda k: F.array(*[F.concat(F.lit(f"{kind}{MARK}"), k) for kind in facts.kinds]) if facts.kinds else F.array().cast("array<string>")
    part = lambda k: F.pmod(F.xxhash64(k, F.lit("part")), F.lit(parts))

    host, path = host_and_path(F.col("url"))
    judged = urls.select(F.struct("*").alias("row"), host.alias("host"), path.alias("path")).withColumn("best", F.lit(None).cast("struct<n:int,verdict:string,rule:string>"))
    keys = F.flatten(F.transform(candidate_keys(F.col("host"), F.col("path"), facts.labels or 1, facts.lengths), tagged))
    size = judged.count() * max(1, len(facts.lengths) * (facts.labels or 1) * len(facts.kinds))
    listed = rules.select(F.concat_ws(MARK, "verdict", "key").alias("key"))
    for i in range(parts):
        own = listed.where(part(F.col("key")) == i)
        universe = judged.select(F.explode(keys).alias("key")).where(part(F.col("key")) == i)
        cascade = build_cascade(own, universe, own.count() if parts > 1 else facts.rules, max(1, size // parts))
        hits = F.filter(keys, lambda k: (part(k) == i) & cascade.contains(k))  # noqa: B023
        named = F.transform(hits, _named)
        judged = judged.withColumn("best", F.reduce(named, F.col("best"), _better))
        judged = keep(judged) if i + 1 < parts else judged
    kept = [F.col("row").getField(c).alias(c) for c in urls.columns if c not in ADDED]
    return judged.select(*kept, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def _named(hit: Column) -> Column:
    """A verdict and a key, with MARK between, as (length of the key, verdict, key)."""
    at = F.instr(hit, MARK)
    return F.struct((F.length(hit) - at).alias("n"), F.substring(hit, F.lit(1), at - 1).alias("verdict"), F.substring(hit, at + 1, F.length(hit)).alias("rule"))


def _better(a: Column, b: Column) -> Column:
    first = (b["verdict"] < a["verdict"]) | ((b["verdict"] == a["verdict"]) & (b["rule"] < a["rule"]))
    return F.when(a.isNull() | (b["n"] > a["n"]) | ((b["n"] == a["n"]) & first), b).otherwise(a)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql("select * from values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow') as t(host, path, verdict)")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


ORACLE = r"""
with p as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end rest from pages),
q as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path from p),
r(rule_host, rule_path, kind) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m as (select page_id, host, path, max_by(rule_host || rule_path, length(rule_host || rule_path)) rule, max_by(kind, length(rule_host || rule_path)) kind
      from q left join r on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path) group by page_id, host, path)
select page_id, host, path, rule, coalesce(kind, 'allow') verdict from m
"""
