"""URL filters by a Bloom filter cascade.

A rule is a host and the beginning of a path, with a verdict.  The keys of a page
are the ends of its host followed by the beginnings of its path, for as many
labels and characters as some rule has; a page's rule is its longest listed key.

Membership is decided without a join.  The universe is every distinct key of the
corpus.  Level 0 of a cascade is a Bloom filter of the listed keys; level 1
encodes the universe's other keys that pass level 0 (its false positives), level
2 the listed keys that pass level 1, and so on until a level lets nothing wrong
pass.  A key is listed if the first level that stops it is odd.  For the
universe this is exact.  One cascade holds all listed keys and a second, over
the listed keys, those that block.

Level 0 is sized so that the expected number of false positives is a fraction of
the number of listed keys, so each level is bounded by the rules, not by the
corpus, and the corpus' part of the work is one pass over its distinct keys.
Lists may be of any size: keys are dealt by their hash into parts of at most
``PART`` rules, so that what a plan carries is bounded, and the urls are judged
once a part.  Everything stays in DataFrame functions.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm.runtime import written

#: (host, path, verdict)
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: Rules of a part, about: some megabytes of filters.
PART = 1_000_000
#: Hash functions of a level at most.
MOST_HASHES = 24


def _hash(key: Column, salt: int) -> Column:
    """56 bits, so that sums of a few multiples stay within a bigint."""
    return F.shiftrightunsigned(F.xxhash64(key, F.lit(salt)), 8)


@dataclass
class Level:
    words: np.ndarray  # of 64 bits, signed
    bits: int
    hashes: int
    salt: int

    def places(self, key: Column) -> list[Column]:
        a, b = _hash(key, 2 * self.salt), _hash(key, 2 * self.salt + 1)
        return [F.pmod(a + b * i, F.lit(self.bits)) for i in range(self.hashes)]

    def passes(self, key: Column) -> Column:
        """Are all bits of the key set?  The words are one literal of the plan."""
        words = F.from_json(F.lit(json.dumps(self.words.tolist())), "array<bigint>")
        out = F.lit(True)
        for at in self.places(key):
            word = F.element_at(words, (F.shiftright(at, 6) + 1).cast("int"))
            out = out & (F.call_function("getbit", word, F.pmod(at, F.lit(64)).cast("int")) == 1)
        return out


def filter_of(keys: DataFrame, n: int, rate: float, salt: int) -> Level:
    """A Bloom filter of the ``n`` distinct keys in column ``key``, built by the tasks."""
    bits = max(64, math.ceil(-n * math.log(rate) / math.log(2) ** 2 / 64) * 64)
    hashes = min(MOST_HASHES, max(1, round(bits / max(1, n) * math.log(2))))
    level = Level(np.zeros(bits // 64, np.int64), bits, hashes, salt)
    each = keys.select(F.explode(F.array(*level.places(F.col("key")))).alias("at"))
    found = each.groupBy(F.shiftright("at", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 as int)))").alias("v")).toArrow()  # a row a word of the filter
    level.words[found.column("w").to_numpy()] = found.column("v").to_numpy()
    return level


@dataclass
class Cascade:
    levels: list[Level]

    def holds(self, key: Column) -> Column:
        """Exact membership for keys of the universe."""
        out = F.lit(len(self.levels) % 2 == 1)
        for i in reversed(range(len(self.levels))):
            out = F.when(~self.levels[i].passes(key), F.lit(i % 2 == 1)).otherwise(out)
        return out


def cascade(listed: DataFrame, universe: DataFrame, salt: int = 0, most_levels: int = 64) -> Cascade:
    """Build over tables of distinct keys (column ``key``); ``listed`` may reach beyond the universe."""
    levels: list[Level] = []
    n = listed.count()
    if not n:
        return Cascade(levels)
    rate = min(0.5, max(1e-9, math.sqrt(0.5) * n / max(1, universe.count())))
    inside, outside = listed.select("key"), universe.select("key")
    while len(levels) < most_levels:
        level = filter_of(inside, n, rate, salt + len(levels))
        passed = outside.where(level.passes(F.col("key")))
        if not levels:  # of the universe the listed keys are no false positives
            passed = passed.join(inside, "key", "left_anti")
        levels.append(level)
        wrong = written(passed, "passed")
        n = wrong.count()
        if not n:
            return Cascade(levels)
        inside, outside, rate = wrong, inside, 0.5
    raise RuntimeError("the cascade did not close")


def parsed(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without ``://``."""
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(has, lower).otherwise(""), F.when(has, path).otherwise("")


def rule_table(spark: SparkSession, rules: DataFrame | Iterable[tuple[str, str, str]]) -> DataFrame:
    """``(key, labels, length, blocks)``, a row a key: how many labels its host and characters its path have.

    Of repeated keys in a sequence the last counts; in a table one that blocks does.
    Rules with a null host or path are none.
    """
    if not isinstance(rules, DataFrame):
        last = {(h, p): v for h, p, v in rules if h is not None and p is not None}
        rules = spark.createDataFrame([(h, p, v) for (h, p), v in last.items()], "host string, path string, verdict string")
    given = rules.where("host is not null and path is not null")
    labels = F.length("host") - F.length(F.replace("host", F.lit("."), F.lit(""))) + 1
    return given.groupBy(F.concat("host", "path").alias("key"), labels.alias("labels"), F.length("path").alias("length")).agg(F.coalesce(F.bool_or(F.col("verdict") == "block"), F.lit(False)).alias("blocks"))


def keyed(pages: DataFrame, shapes: list[tuple[int, int]]) -> DataFrame:
    """``pages`` (with ``host`` and ``path``) with ``keys``: all keys of the shapes (labels, characters), each with its lengths.

    No more labels are looked at than a rule has, however many the host has.
    """
    given = F.from_json(F.lit(json.dumps([{"labels": a, "length": b} for a, b in shapes])), "array<struct<labels:int,length:int>>")
    of = pages.withColumn("shapes_", given).withColumn("labels_", F.length("host") - F.length(F.replace("host", F.lit("."), F.lit(""))) + 1)
    fit = F.filter("shapes_", lambda s: (s["labels"] <= F.col("labels_")) & (s["length"] <= F.length("path")))
    ends = F.expr("transform(fit_, s -> named_struct('end', substring_index(host, '.', -s.labels), 'start', substring(path, 1, s.length)))")
    keys = F.transform("ends_", lambda e: F.struct((F.length(e["end"]) + F.length(e["start"])).alias("n"), F.length(e["end"]).alias("host"), F.concat(e["end"], e["start"]).alias("key")))
    return of.withColumn("fit_", fit).withColumn("ends_", ends).withColumn("keys", keys).drop("shapes_", "labels_", "fit_", "ends_")


def judged(pages: DataFrame, rules: DataFrame | Iterable[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", default: str = "allow", part: int | None = None) -> DataFrame:
    """``(id, host, path, rule, verdict)`` of every row.

    ``rules`` are (host, path, verdict) tuples or a table with these columns, of any
    size.  A page's rule is the fitting one with the longest host and path together;
    of two equally long ones that with the longer host.  Pages whose keys are not
    listed get ``default``: they are no members.  Null urls and urls without
    ``://`` have an empty host and path and no rule.  Urls may be of any length;
    repeated rows give repeated rows, an empty table none, and other columns play
    no part.
    """
    spark = pages.sparkSession
    listed = written(rule_table(spark, rules), "rules")
    sizes = listed.groupBy("labels", "length").agg(F.count("*").alias("n")).collect()  # a row a shape
    url = pages.select(F.col(id_col).alias("id_"), F.col(url_col).alias("url_"))
    host, path = parsed(F.col("url_"))
    slim = written(keyed(url.select("id_", host.alias("host"), path.alias("path")), sorted((r.labels, r.length) for r in sizes)).withColumn("row_", F.monotonically_increasing_id()), "urls")
    universe = written(slim.select(F.explode("keys.key").alias("key")).distinct(), "keys")
    parts = max(1, -(-sum(r.n for r in sizes) // (part or PART)))
    best = lambda holds, blocks: F.array_max(F.transform(F.filter("keys", lambda k: holds(k["key"])), lambda k: F.struct(k["n"], k["host"], k["key"], blocks(k["key"]).alias("blocks"))))
    found = []
    for i in range(parts):
        mine = lambda df: df.where(F.pmod(F.xxhash64("key"), F.lit(parts)) == i) if parts > 1 else df  # noqa: B023, E731
        members = cascade(mine(listed), mine(universe), salt=128 * i)
        blocking = cascade(mine(listed).where("blocks"), mine(listed), salt=128 * i + 64)
        here = (lambda k, i=i: F.pmod(F.xxhash64(k), F.lit(parts)) == i) if parts > 1 else (lambda k: F.lit(True))
        one = best(lambda k, m=members, here=here: here(k) & m.holds(k), blocking.holds)
        if parts == 1:
            return _verdicts(slim.withColumn("best", one), id_col, default)
        found.append(written(slim.select("row_", one.alias("best")).where("best is not null"), "found"))
    every = found[0]
    for f in found[1:]:
        every = every.union(f)
    longest = every.groupBy("row_").agg(F.max("best").alias("best"))
    return _verdicts(slim.join(longest, "row_", "left"), id_col, default)


def _verdicts(rows: DataFrame, id_col: str, default: str) -> DataFrame:
    verdict = F.when(F.col("best").isNull(), F.lit(default)).when(F.col("best.blocks"), F.lit("block")).otherwise(F.lit("allow"))
    return rows.select(F.col("id_").alias(id_col), "host", "path", F.col("best.key").alias("rule"), verdict.alias("verdict"))


def digest(rows: DataFrame) -> DataFrame:
    return rows.select("page_id", "host", "path", "rule", "verdict")


ORACLE = """
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages
), parts AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*'), '') AS path
  FROM cut
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/'
  END AS rule FROM parts
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""
