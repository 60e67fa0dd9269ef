"""URL filters: longest-match rules and a Bloom filter cascade with exact answers, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from .common import ascii_lower, materialize

#: Rules as "host/path", each with its verdict.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "allow"), ("com/fr/", "allow"), ("com/de/", "block"))

#: Domains that the query lists; subdomains belong to them.
BLOCKLIST = ("ads-track.example.org", "casino-win.example.org", "cheap-pills.example.com", "free-bets.example.com", "spam-farm.example.org")


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty for a null or a url without ://."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def domains_of(host: Column) -> Column:
    """The host and every domain above it: a.b.c, b.c, c."""
    parts = F.split(host, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def rule_column(host: Column, path: Column, rules: Sequence[tuple[str, str]], value: int) -> Column:
    """The rule (value 0) or verdict (value 1) of the longest rule that fits, else null. Of equally long rules the first in the list wins."""
    out = F.lit(None).cast("string")
    for rule in sorted(reversed(rules), key=lambda r: len(r[0])):
        name, _, rest = rule[0].partition("/")
        out = F.when(((host == name) | host.endswith("." + name)) & path.startswith("/" + rest), F.lit(rule[value])).otherwise(out)
    return out


#: Bytes of a filter that one row of the table of its words holds as hex digits; a power of two.
_PAGE = 1 << 16


@dataclass
class Cascade:
    """Alternate Bloom filters: even levels hold listed keys, odd ones the others that the level before let through."""

    levels: list[tuple[Column, int]] = field(default_factory=list)
    hashes: int = 7

    def bits(self, key: Column, level: int, size: int) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(level), F.lit(j)), F.lit(size).cast("long")) for j in range(self.hashes)]

    def passes(self, key: Column, level: int) -> Column:
        # one literal serves all probes of a level
        filter_, size = self.levels[level]
        out = F.lit(True)
        for bit in self.bits(key, level, size):
            byte = F.conv(F.hex(filter_.substr((F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
            out = out & (F.call_function("bit_get", byte, F.pmod(bit, F.lit(8)).cast("int")) == 1)
        return out

    def contains(self, key: Column) -> Column:
        """Exact for every key of the universe: the first level that refuses a key decides."""
        out = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(range(len(self.levels))):
            out = F.when(self.passes(key, level), out).otherwise(F.lit(level % 2 == 1))
        return out


def _packed(keys: DataFrame, bits: list[Column], size: int) -> bytes:
    """The filter's bytes, put together by aggregation: a row for each 64 bits, then one for each page, which is all that the driver reads."""
    words = (size + 63) // 64
    spots = keys.select(F.explode(F.array(*bits)).alias("bit")).select(F.shiftright("bit", 6).alias("word"), F.expr("shiftleft(1L, cast(bit & 63 as int))").alias("value"))
    none = keys.sparkSession.range(words).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("value"))
    dense = spots.unionAll(none).groupBy("word").agg(F.bit_or("value").alias("value"))
    pages = dense.groupBy(F.floor(F.col("word") / (_PAGE // 8)).alias("page")).agg(F.sort_array(F.collect_list(F.struct("word", "value"))).alias("rows"))
    # bit i of a filter is bit i % 8 of its byte i / 8, so the bytes of a word are put in reverse
    text = F.array_join(F.transform("rows", lambda x: F.lpad(F.hex(x["value"]), 16, "0")), "")
    ordered = pages.select("page", F.unhex(text).alias("bytes")).orderBy("page")
    return b"".join(int.from_bytes(r["bytes"][i : i + 8], "big").to_bytes(8, "little") for r in ordered.toLocalIterator() for i in range(0, len(r["bytes"]), 8))


def build_cascade(universe: DataFrame, listed: DataFrame, bits_per_key: int = 10) -> Cascade:
    """A cascade over the distinct keys of both (column key), which answers exactly for each of them."""
    said = universe.select("key", F.lit(0).alias("said")).unionAll(listed.select("key", F.lit(1).alias("said"))).where(F.col("key").isNotNull())
    return _cascade(materialize(said.groupBy("key").agg(F.max("said").alias("said")), "keys"), bits_per_key)


def _cascade(keys: DataFrame, bits_per_key: int) -> Cascade:
    """keys: key, said (1: listed)."""
    cascade, inside, outside = Cascade(), keys.where("said = 1").select("key"), keys.where("said = 0").select("key")
    while (n := inside.count()) > 0:
        level, size = len(cascade.levels), max(64, n * bits_per_key)
        cascade.levels.append((F.lit(_packed(inside, cascade.bits(F.col("key"), level, size), size)), size))
        inside, outside = materialize(outside.where(cascade.passes(F.col("key"), level)), "passed-keys"), inside
    return cascade


def _holder(cascade: Cascade, part_of: Callable[[Column], Column], part: int, n_parts: int) -> Callable[[Column], Column]:
    """A test of a key: whether it belongs to this part and is listed."""
    if n_parts == 1:
        return cascade.contains
    return lambda key: (part_of(key) == part) & cascade.contains(key)


def filter_urls(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str]] = RULES, most_bytes: int = 16 << 20, bits_per_key: int = 10) -> DataFrame:
    """page_id, host, path, rule, verdict, listed for every row of pages (page_id, url). listed: domains, in column key.

    The longest rule that fits decides; without one, a host is blocked if it or a domain above it is listed. The
    key universe is every host of the table with the domains above it, so the cascade answers exactly and the pages are not
    joined or shuffled; only the distinct domains are. Keys are dealt into as many parts as it takes for a part's first filter to have about most_bytes
    (13 million listed keys); each part has a cascade of its own and is one pass over the pages, whose answers are written in between.
    Null urls and urls without :// have an empty host and path; null keys are ignored and repeated ones count once. No rows give no rows; repeated rows
    stay; other columns are ignored.
    """
    url = F.col("url")
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    known = rows.select("host").distinct().select(F.explode(domains_of(F.col("host"))).alias("key"), F.lit(0).alias("said"))
    said = known.unionAll(listed.select("key", F.lit(1).alias("said")).where(F.col("key").isNotNull()))
    keys = materialize(said.groupBy("key").agg(F.max("said").alias("said")), "keys")
    n_parts = max(1, -(-keys.where("said = 1").count() * bits_per_key // (most_bytes * 8)))
    part_of = lambda key: F.pmod(F.xxhash64(key, F.lit("part")), F.lit(n_parts))
    rows = rows.withColumn("listed", F.lit(False))
    for part in range(n_parts):
        cascade = _cascade(keys.where(part_of(F.col("key")) == part), bits_per_key)
        if not cascade.levels:
            continue
        rows = rows.withColumn("listed", F.col("listed") | F.exists(domains_of(F.col("host")), _holder(cascade, part_of, part, n_parts)))
        if part + 1 < n_parts:
            rows = materialize(rows, "judged")
    host, path = F.col("host"), F.col("path")
    verdict = F.coalesce(rule_column(host, path, rules, 1), F.when(F.col("listed"), "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", rule_column(host, path, rules, 0).alias("rule"), verdict.alias("verdict"), "listed")


def _sql() -> str:
    fits = []
    for rule, verdict in sorted(RULES, key=lambda r: -len(r[0])):
        name, _, rest = rule.partition("/")
        fits.append((f"(host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{rest}')", rule, verdict))
    rule = " ".join(f"WHEN {fit} THEN '{name}'" for fit, name, _ in fits)
    verdict = " ".join(f"WHEN {fit} THEN '{said}'" for fit, _, said in fits)
    listed = " OR ".join(f"host = '{d}' OR ends_with(host, '.{d}')" for d in BLOCKLIST)
    return f"""
WITH p AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages)
SELECT page_id, host, path, CASE {rule} END AS rule,
       CASE {verdict} WHEN {listed} THEN 'block' ELSE 'allow' END AS verdict, ({listed}) AS listed
FROM p
"""


URL_SQL = _sql()
