"""URL filters: rules and lists of hosts, tested with cascades of Bloom filters.

A cascade tells exactly, for every key of a known universe, whether it is listed.
Its first filter holds the listed keys; the second holds the other keys of the
universe that pass the first by mistake; the third holds the listed keys that
pass the second, and so on until no mistake is left. The answer is the parity of
the first filter that a key fails. Filters are literals of the plan, so testing a
key takes no join. A cascade is built by aggregations over the keys; only its
bits, whose number is checked, reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from molspark.staging import stage

MAX_BITS = 1 << 25  # 4 MB in a plan; longer lists are joined instead
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Level:
    """One Bloom filter: its bits in 64-bit numbers, the number of hashes, and a salt of its own."""

    bits: Column
    words: int
    hashes: int
    salt: int

    def passes(self, key: Column) -> Column:
        out = F.lit(True)
        for at in _places(key, self):
            cell = F.get(self.bits, F.floor(at / 64).cast("int"))
            out = out & (F.call_function("getbit", cell, (at % 64).cast("int")) == 1)
        return out


def _places(key: Column, level: Level) -> list[Column]:
    """Bit numbers of a key, as whole numbers."""
    return [F.pmod(F.xxhash64(key, F.lit(level.salt), F.lit(i)), F.lit(level.words * 64)) for i in range(level.hashes)]


def _shape(listed: int, others: int, first: bool) -> tuple[int, int]:
    """Words and hashes of a level; the first lets through about as many others as there are listed keys."""
    miss = min(0.5, max(1e-9, listed * math.sqrt(0.5) / max(1, others))) if first else 0.5
    return max(1, math.ceil(listed * -math.log(miss) / math.log(2) ** 2 / 64)), max(1, round(-math.log2(miss)))


def build_cascade(listed: DataFrame, universe: DataFrame) -> list[Level] | None:
    """Levels that tell the keys of ``listed`` from the others of ``universe``; None beyond ``MAX_BITS``.

    Both have one string column, ``key``; nulls are ignored, repeats count once, and
    ``universe`` need not hold the listed keys. An empty list gives no level.
    """
    inside = stage(listed.where("key is not null").distinct(), "listed")
    outside = stage(universe.where("key is not null").distinct().join(inside, "key", "left_anti"), "unlisted")
    levels: list[Level] = []
    size, others = inside.count(), outside.count()
    while size:
        words, hashes = _shape(size, others, not levels)
        if words * 64 > MAX_BITS:
            return None
        empty = Level(F.lit(None), words, hashes, len(levels))
        places = inside.select(F.explode(F.array(*_places(F.col("key"), empty))).alias("at"))
        cells = places.groupBy(F.expr("CAST(at DIV 64 AS INT)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, CAST(at % 64 AS INT)))").alias("bits"))
        bits = [0] * words
        for word, value in cells.collect():  # at most MAX_BITS / 64 rows
            bits[word] = value
        level = Level(F.from_json(F.lit("[" + ",".join(map(str, bits)) + "]"), "array<bigint>"), words, hashes, len(levels))
        levels.append(level)
        inside, outside = stage(outside.where(level.passes(F.col("key"))), "mistaken"), inside
        size, others = inside.count(), size
    return levels


def contains(levels: list[Level], key: Column) -> Column:
    """Whether a key of the cascade's universe is listed."""
    out = F.lit(len(levels) % 2 == 1)
    for depth in range(len(levels) - 1, -1, -1):
        out = F.when(levels[depth].passes(key), out).otherwise(F.lit(depth % 2 == 1))
    return out


def host(url: Column) -> Column:
    """What stands between the first ``://`` and the next slash, question mark or hash, A-Z lowered; else empty."""
    return F.translate(F.regexp_extract(_after(url), "^([^/?#]*)", 1), _UPPER, _LOWER)


def path(url: Column) -> Column:
    """What follows the host, up to a question mark or hash."""
    return F.regexp_extract(_after(url), "^[^/?#]*([^?#]*)", 1)


def _after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise("")


def host_suffixes(name: Column) -> Column:
    """The host and the domains above it, longest first; none for an empty host."""
    labels = F.split(name, "[.]", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.when(name != "", suffixes).otherwise(F.array().cast("array<string>"))


def _tester(listed: DataFrame, universe: DataFrame) -> Callable[[DataFrame, str], DataFrame]:
    """A function that replaces an array column of keys by those that are listed."""
    levels = build_cascade(listed, universe)
    if levels is not None:
        return lambda rows, column: rows.withColumn(column, F.filter(column, lambda k: contains(levels, k)))

    def by_join(rows: DataFrame, column: str) -> DataFrame:
        rows = stage(rows.withColumn("_row", F.monotonically_increasing_id()), "rows")
        hits = rows.select("_row", F.explode(column).alias("key")).join(listed.select("key").distinct(), "key", "left_semi")
        hits = hits.groupBy("_row").agg(F.collect_set("key").alias("_hits"))  # as many as a url has suffixes and prefixes
        return rows.join(hits, "_row", "left").withColumn(column, F.coalesce("_hits", F.array().cast("array<string>"))).drop("_row", "_hits")

    return by_join


def judge(pages: DataFrame, rules: DataFrame, listed_hosts: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``id_col, host, path, rule, verdict`` for every row of ``pages``.

    ``rules`` has ``host, path, verdict`` (allow or block). A rule fits its host and all
    subdomains, if the path starts with the rule's. The longest fitting rule decides,
    of equally long ones that of the longer host; of rules that differ in verdict
    alone, block. Where no rule fits, a url is blocked if its host, or a domain above
    it, is in ``listed_hosts`` (column ``key``), else allowed. A null url, or one
    without ``://``, has an empty host and path and is allowed. Repeated rows repeat;
    other columns are not read; an empty table gives an empty one.
    """
    lengths = sorted(r[0] for r in rules.select(F.char_length("path")).distinct().collect())
    rule_keys = rules.select(F.concat("host", "path").alias("key"), "verdict")
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("id"), host(url).alias("host"), path(url).alias("path"))
    rows = rows.withColumn("suffixes", host_suffixes(F.col("host")))
    prefixes = F.filter(F.array(*(F.when(F.char_length("path") >= n, F.substring("path", 1, n)) for n in lengths)).cast("array<string>"), lambda p: p.isNotNull())
    rows = stage(rows.withColumn("keys", F.flatten(F.transform("suffixes", lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))), "urls")

    fits = _tester(rule_keys.select("key"), rows.select(F.explode("keys").alias("key")))
    blocks = _tester(rule_keys.where("verdict = 'block'").select("key"), rule_keys.select("key"))
    listed = _tester(listed_hosts.select("key"), rows.select(F.explode("suffixes").alias("key")))
    rows = fits(rows, "keys")
    longest = F.array_max(F.transform("keys", lambda k: F.struct(
        F.char_length(k).alias("size"), F.char_length(F.regexp_extract(k, "^[^/]*", 0)).alias("host_size"), k.alias("key")
    )))
    rows = rows.withColumn("rule", longest.key)
    rows = rows.withColumn("blocking", F.when(F.col("rule").isNotNull(), F.array("rule")).otherwise(F.array().cast("array<string>")))
    rows = listed(blocks(rows, "blocking"), "suffixes")
    blocked = F.when(F.col("rule").isNotNull(), F.size("blocking") > 0).otherwise(F.size("suffixes") > 0)
    return rows.select(F.col("id").alias(id_col), "host", "path", "rule", F.when(blocked, "block").otherwise("allow").alias("verdict"))


def hosts_named(pages: DataFrame, terms: list[str], url_col: str = "url") -> DataFrame:
    """``key``: the hosts of ``pages`` that have one of the terms as a label or a hyphenated part of one."""
    name = host(F.col(url_col))
    hosts = pages.select(name.alias("key")).distinct()
    return hosts.where(F.arrays_overlap(F.split("key", "[.-]"), F.array(*map(F.lit, terms))))
