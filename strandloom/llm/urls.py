"""URL filters: rules first, then exact membership of hosts by a cascade of Bloom filters.

Only DataFrame functions run here, and no join: a filter is an array of longs, read as a scalar subquery.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import staged, table

#: Verdict, host, path of the rules.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Hosts with such a label are listed: advertising and tracking services.
LISTED = r"(^|[.-])(ads?|adserver|banners?|clicks?|track(er|ing)?)([.-]|$)"
#: All blocked families: advertising and tracking, adult, gambling, pills, spam farms.
FAMILIES = r"(^|[.-])(ads?|adserver|banners?|clicks?|track(er|ing)?|adult|porn|xxx|sex|bets?|betting|casinos?|gambling|poker|slots|pills?|pharma|viagra|spam)([.-]|$)"
BITS_A_KEY, HASHES = 10, 7
#: No filter is larger (bits; 64 MB): a bound of what is sent to the executors. Hosts beyond it are split by hash.
MOST_BITS = 1 << 29


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ://, A-Z lower-cased, and the path after it; both empty for null or without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.lit(2**31 - 1)))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (host and all subdomains, path by its start) and its verdict; nulls without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


@dataclass(frozen=True)
class Level:
    bits: DataFrame  # one row: words array<bigint>
    size: int
    number: int

    def positions(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(self.number * 64 + i)), F.lit(self.size)) for i in range(HASHES)]

    def has(self, key: Column) -> Column:
        held, words = F.lit(True), self.bits.scalar()
        for at in self.positions(key):
            held = held & (F.getbit(F.get(words, F.floor(at / 64).cast("int")), F.pmod(at, F.lit(64)).cast("int")) == 1)
        return held


def _level(keys: DataFrame, count: int, number: int) -> Level:
    """The Bloom filter of `keys` (column key): bits meet in words by bit_or before and after the shuffle."""
    size = 64 * max(1, math.ceil(count * BITS_A_KEY / 64))
    level = Level(None, size, number)
    at = keys.select(F.explode(F.array(*level.positions(F.col("key")))).alias("at"))
    words = at.groupBy(F.floor(F.col("at") / 64).alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(at, 64) as int))")).alias("w"))
    zeros = keys.sparkSession.range(size // 64).select(F.col("id").alias("i"), F.lit(0).cast("long").alias("w"))
    words = words.union(zeros).groupBy("i").agg(F.bit_or("w").alias("w"))
    words = words.agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "w"))), lambda x: x["w"]).alias("words"))
    return Level(staged(words, "bloom"), size, number)


class Cascade:
    """Exact membership for a known universe of keys.

    The first filter holds the listed keys; the second the keys outside the list that the first one lets through; the
    third the listed keys that the second one lets through; and so on until a filter lets nothing through. The first
    filter that refuses a key tells: an odd one that it is not listed, an even one that it is.
    """

    def __init__(self, universe: DataFrame):
        """universe: key (distinct), listed (boolean)."""
        self.levels: list[Level] = []
        left = universe
        while True:
            wanted = len(self.levels) % 2 == 0  # odd levels hold listed keys
            held = left.where(F.col("listed") == wanted)
            count = held.count()
            if not count:
                return
            level = _level(held, count, len(self.levels))
            self.levels.append(level)
            left = staged(left.where((F.col("listed") == wanted) | level.has(F.col("key"))), "passing")

    def listed(self, key: Column) -> Column:
        """Whether a key of the universe is listed. A key that every level lets through belongs to the last one."""
        told = F.lit(len(self.levels) % 2 == 1)
        for i, level in reversed(list(enumerate(self.levels))):
            told = F.when(level.has(key), told).otherwise(F.lit(i % 2 == 1))
        return told


def verdicts(spark, sf_dir: str, listed: str) -> DataFrame:
    """Verdict for every page: the longest rule's, else block for hosts that `listed` (a pattern) names and allow for all others.

    So many hosts that filters could pass MOST_BITS (27 million) are split by a hash: each part has a cascade of its
    own, and its pages are judged and saved before the next part's filters are made, so one cascade is sent at a time.
    """
    host, path = host_and_path(F.col("url"))
    pages = table(spark, sf_dir, "pages").select("page_id", host.alias("host"), path.alias("path"))
    universe = staged(pages.select(F.col("host").alias("key")).distinct().withColumn("listed", F.col("key").rlike(listed)), "hosts")
    rule, verdict = ruled(F.col("host"), F.col("path"))

    def judged(pages: DataFrame, filters: Cascade) -> DataFrame:
        method = F.when(filters.listed(F.col("host")), F.lit("block")).otherwise(F.lit("allow"))
        return pages.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"))

    parts = math.ceil(universe.count() * 2 * BITS_A_KEY / MOST_BITS)  # twice the room: hashes deal keys out nearly evenly
    if parts <= 1:
        return judged(pages, Cascade(universe))
    part = lambda key, p: F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(parts)) == p
    done = [staged(judged(pages.where(part("host", p)), Cascade(universe.where(part("key", p)))), "judged") for p in range(parts)]
    return reduce(DataFrame.unionByName, done)


def op7_bloom_cascade(spark, sf_dir: str) -> DataFrame:
    """Verdict for every page: the longest rule's, else block for listed hosts and allow for all others.

    Null urls and urls without :// have empty host and path, fit no rule and are allowed. Equal rows get equal answers.
    An empty table gives no rows.
    """
    return verdicts(spark, sf_dir, LISTED)


def op7_blocked_families(spark, sf_dir: str) -> DataFrame:
    """As op7_bloom_cascade, with the list of all blocked families: that query's SQL fixes its own list, the first family."""
    return verdicts(spark, sf_dir, FAMILIES)


OP7_SQL = """
WITH a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
b AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
             coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM a),
c AS (SELECT *, CASE
        WHEN (host = 'www.example.com' OR suffix(host, '.www.example.com')) AND prefix(path, '/en/') THEN 'www.example.com/en/'
        WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND prefix(path, '/en/') THEN 'example.com/en/'
        WHEN (host = 'net' OR suffix(host, '.net')) AND prefix(path, '/es/') THEN 'net/es/'
        WHEN (host = 'net' OR suffix(host, '.net')) AND prefix(path, '/fr/') THEN 'net/fr/'
        WHEN (host = 'com' OR suffix(host, '.com')) AND prefix(path, '/') THEN 'com/' END AS rule FROM b)
SELECT page_id, host, path, rule, CASE
        WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
        WHEN regexp_matches(host, '(^|[.-])(ads?|adserver|banners?|clicks?|track(er|ing)?)([.-]|$)') THEN 'block' ELSE 'allow' END AS verdict
FROM c
"""
OP7_FAMILIES_SQL = OP7_SQL.replace(LISTED, FAMILIES)
