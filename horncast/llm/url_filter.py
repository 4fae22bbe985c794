"""URL filter by a cascade of Bloom filters.

A rule is (host, path, action).  It fits a url whose host is the rule's host or a subdomain of it and
whose path starts with the rule's path; the longest fitting rule wins.  A url therefore has a few *keys*:
each host suffix at a label boundary, combined with each path prefix that has the length of some rule's
path.  The keys of the whole corpus are the universe.  Level 0 encodes the listed keys; level 1 the keys
of the universe that level 0 accepts wrongly; level 2 the listed keys that level 1 accepts wrongly; and so
on, until a level accepts nothing wrongly.  Over that universe the cascade answers membership exactly, with
bit tests only: judging needs no join and no shuffle.  Each action has its own cascade; one pass over the
corpus finds what the first levels of all of them accept wrongly, and later levels see only that.

A filter is a row of 64-bit words held as literals in the plan, in parts of ``PART_WORDS`` (2 MiB), so that a
level may have any number of them.  Its size depends on the rules and the logarithm of the universe, never on
the number of urls.

Defined results: a null url, or one without ``://``, has an empty host and an empty path and no key; a path
that is empty starts with no rule's path; "longest" is the length of host and path together, and of rules of
equal length the one with the longer host wins; repeated rows are judged alike; an empty table or an empty rule
list gives no rule and verdict ``allow``.  Columns of the input are kept, whatever their names, but for those
that are called as the new ones.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Shielded, drop_scratch, settle

#: Rules are (host, path, action).
Rule = tuple[str, str, str]
#: Words of a part of a level; 2 MiB, which holds about 700,000 rules.
PART_WORDS = 1 << 18
#: Keys a url is taken to have for each length of a rule's path; more only make the first level less selective.
KEYS_A_URL = 4
#: False-positive rate of the levels after the first.
LATER_RATE = 0.5
NEW = ("host", "path", "rule", "verdict")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def url_keys(host: Column, path: Column, path_lengths: list[int]) -> Column:
    """Keys of a url, longest host first and for each host the longest path first."""
    labels = F.split(host, r"\.", -1)
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    prefixes = F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in sorted(path_lengths, reverse=True)])
    prefixes = F.filter(prefixes, lambda p: p.isNotNull())
    return F.when(host == "", F.array().cast("array<string>")).otherwise(
        F.flatten(F.transform(hosts, lambda h: F.transform(prefixes, lambda p: F.concat(h, p))))
    )


@dataclass(frozen=True)
class Level:
    bits: int
    hashes: int
    seed: int
    words: tuple[int, ...]

    def positions(self, key: Column) -> Column:
        """Bit positions of a key, by repeated hashing."""
        return F.array(*[F.pmod(F.xxhash64(key, F.lit(self.seed * 64 + i)), F.lit(self.bits)) for i in range(self.hashes)])

    def accepts(self, key: Column) -> Column:
        parts = [self.words[i : i + PART_WORDS] for i in range(0, len(self.words), PART_WORDS)]
        arrays = [F.split(F.lit(",".join(map(str, p))), ",").cast("array<bigint>") for p in parts]  # each folded to one literal

        def bit(p: Column) -> Column:
            word = F.shiftright(p, 6)
            within = F.pmod(word, F.lit(PART_WORDS)).cast("int")
            found = F.get(arrays[-1], within)
            for i in range(len(arrays) - 1):
                found = F.when(F.shiftright(word, PART_WORDS.bit_length() - 1) == i, F.get(arrays[i], within)).otherwise(found)
            return F.getbit(found, F.pmod(p, F.lit(64)).cast("int")) == 1

        return F.forall(self.positions(key), bit)


def shape(n: int, rate: float) -> tuple[int, int]:
    """Bits and hash functions of a filter for ``n`` keys."""
    bits = max(64, math.ceil(max(1, n) * -math.log(rate) / math.log(2) ** 2))
    return -(-bits // 64) * 64, max(1, round(-math.log2(rate)))


def encode(keys: DataFrame, column: str, n: int, rate: float, seed: int) -> Level:
    """The filter of all keys; only its words come to the driver."""
    bits, hashes = shape(n, rate)
    empty = Level(bits, hashes, seed, ())
    at = keys.select(F.explode(empty.positions(F.col(column))).alias("p"))
    found = at.groupBy(F.shiftright("p", 6).cast("int").alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(pmod(p, 64) as int))")).alias("bits")
    )
    words = [0] * (bits // 64)
    for w, b in found.collect():
        words[w] = b
    return Level(bits, hashes, seed, tuple(words))


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def contains(self, key: Column) -> Column:
        """Exact for keys of the universe the cascade was built over."""
        said = F.lit(len(self.levels) % 2 == 1)  # accepted by every level: what the last level encodes
        for i, level in reversed(list(enumerate(self.levels))):
            said = F.when(~level.accepts(key), F.lit(i % 2 == 1)).otherwise(said)
        return said if self.levels else F.lit(False)


def build_cascades(listed: dict[str, list[str]], universe: DataFrame, column: str, n_universe: int) -> dict[str, Cascade]:
    """A cascade for each name; ``universe`` has the keys in ``column``, and is read once.  ``n_universe`` may be an estimate."""
    spark, names = universe.sparkSession, [a for a in listed if listed[a]]
    keys = lambda a: F.from_json(F.lit(json.dumps(sorted(set(listed[a])))), "array<string>")
    tables = {a: spark.range(1).select(F.explode(keys(a)).alias(column)) for a in names}
    first = {}
    for a in names:
        n = len(set(listed[a]))
        first[a] = encode(tables[a], column, n, min(0.5, max(1e-9, n * math.sqrt(0.5) / max(1, n_universe))), 0)
    if not names:
        return {a: Cascade(()) for a in listed}
    by = F.array_compact(F.array(*[F.when(first[a].accepts(F.col(column)), F.lit(a)) for a in names]))
    passed = settle(universe.select(column, by.alias("by")).where(F.size("by") > 0).distinct(), "bloom")
    out = {}
    for a in listed:
        if a not in first:
            out[a] = Cascade(())
            continue
        levels, other = [first[a]], tables[a]
        mine = passed.where(F.array_contains("by", F.lit(a))).select(column)
        wrong = settle(mine.join(tables[a], column, "left_anti"), "bloom")
        # Each side shrinks with every level: what is wrongly accepted at one level is encoded at the next.
        while n := wrong.count():
            levels.append(encode(wrong, column, n, LATER_RATE, len(levels)))
            wrong, other = settle(other.where(levels[-1].accepts(F.col(column))), "bloom"), wrong
        drop_scratch(wrong, other)
        out[a] = Cascade(tuple(levels))
    drop_scratch(passed)
    return out


def judge_urls(pages: DataFrame, rules: list[Rule], url: str = "url", default: str = "allow") -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` (host + path of the longest fitting rule, or null) and ``verdict``."""
    if len({h + p for h, p, _ in rules}) < len(rules):
        raise ValueError("two rules have the same host and path")
    held = Shielded(pages, NEW)
    host, path = url_parts(F.col(held.of(url)))
    lengths = sorted({len(p) for _, p, _ in rules}) or [1]
    keyed = held.rows.withColumns({"host": host, "path": path}).withColumn("keys", url_keys(F.col("host"), F.col("path"), lengths))
    listed = {a: [h + p for h, p, x in rules if x == a] for a in sorted({x for _, _, x in rules})}
    # Counting rows is cheap (Parquet footers have it); the keys of each are estimated.
    total = pages.count() * KEYS_A_URL * len(lengths) if rules else 0
    cascades = build_cascades(listed, keyed.select(F.explode("keys").alias("key")), "key", total)
    # The longest key first; a key says which action lists it, if any does.
    action = F.lit(None).cast("string")
    said = lambda k: F.coalesce(*[F.when(c.contains(k), F.lit(a)) for a, c in cascades.items()], action) if cascades else action
    hits = F.filter(F.transform(F.col("keys"), lambda k: F.struct(k.alias("key"), said(k).alias("action"))), lambda x: x["action"].isNotNull())
    best = F.reduce(
        hits,
        F.lit(None).cast("struct<key:string,action:string>"),
        lambda acc, x: F.when(acc.isNull() | (F.length(x["key"]) > F.length(acc["key"])), x).otherwise(acc),
    )
    out = keyed.withColumn("best", best)
    return held.restore(out.withColumns({"rule": F.col("best.key"), "verdict": F.coalesce(F.col("best.action"), F.lit(default))}), NEW)
