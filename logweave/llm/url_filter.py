"""URL allow and block lists held as Bloom filter cascades.

A cascade answers membership of a fixed list exactly for every key of a known
universe.  Level 0 encodes the listed keys.  Level 1 encodes the keys of the
universe that level 0 accepts by mistake, level 2 the listed keys that level 1
accepts, and so on until a level makes no mistake.  Here the universe is every
key any url of the corpus can ask for, so each answer is exact and no join is
needed: workers only get the filter bits.

Size: level 0 is tuned so that about as many false positives remain as there
are listed keys.  All levels together stay within a few bytes per listed key
times the logarithm of universe / list; `max_list_keys` bounds the list, and
thereby what is broadcast and what the driver ever holds.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .cluster import free_names
from .textnum import mix64

HOST_PATTERN = r"(?s)^.*?://([^/?#]*)"
PATH_PATTERN = r"(?s)^.*?://[^/?#]*([^?#]*)"


@dataclass
class BloomFilter:
    """Plain Bloom filter over pairs of 64-bit hashes."""

    bits: np.ndarray
    size: int
    probes: int
    seed: int

    @classmethod
    def build(cls, one: np.ndarray, two: np.ndarray, rate: float, seed: int) -> BloomFilter:
        n = max(1, len(one))
        size = max(64, math.ceil(-n * math.log(rate) / math.log(2) ** 2))
        probes = max(1, round(size / n * math.log(2)))
        made = cls(np.zeros(size // 8 + 1, dtype=np.uint8), size, probes, seed)
        for at in made._places(one, two):
            np.bitwise_or.at(made.bits, at >> np.uint64(3), np.left_shift(1, at & np.uint64(7)).astype(np.uint8))
        return made

    def _places(self, one: np.ndarray, two: np.ndarray):
        salt = mix64(np.array([self.seed + 1], dtype=np.uint64))[0]
        a, b = mix64(one ^ salt), mix64(two + salt) | np.uint64(1)
        for i in range(self.probes):
            yield (a + np.uint64(i) * b) % np.uint64(self.size)

    def has(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        found = np.ones(len(one), dtype=bool)
        for at in self._places(one, two):
            found &= (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return found


@dataclass
class Cascade:
    levels: list[BloomFilter]

    def has(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The answer is the parity of the first level that rejects the key."""
        listed = np.zeros(len(one), dtype=bool)
        alive = np.arange(len(one))
        for k, level in enumerate(self.levels):
            accepted = level.has(one[alive], two[alive])
            listed[alive[~accepted]] = k % 2 == 1
            alive = alive[accepted]
        listed[alive] = len(self.levels) % 2 == 1
        return listed


def _refine(listed: tuple, mistaken: tuple, first: BloomFilter, max_levels: int = 200) -> Cascade:
    """Add levels until no key of either set is on the wrong side."""
    levels, inside, outside = [first], listed, mistaken
    while len(outside[0]):
        if len(levels) > max_levels:
            raise ValueError("two different keys of the universe share both hashes")
        level = BloomFilter.build(*outside, rate=0.5, seed=len(levels))
        wrong = level.has(*inside)
        levels.append(level)
        inside, outside = outside, tuple(x[wrong] for x in inside)
    return Cascade(levels)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without '://'."""
    url = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(url, HOST_PATTERN, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(url, PATH_PATTERN, 1)


def _keys(host: Column, path: Column, labels: Sequence[int], lengths: Sequence[int]) -> Column:
    """Every rule text that could fit: host endings of as many labels as rules have, times path beginnings of their lengths."""
    whole = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1
    suffixes = F.array_compact(F.array(*(F.when(whole >= k, F.substring_index(host, ".", -k)) for k in labels)))
    prefixes = F.array_compact(F.array(*(F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths)))
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))


def _hash_pair(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("one"), F.xxhash64(F.lit(1), key).alias("two"))


def build_cascades(spark: SparkSession, universe: DataFrame, lists: dict[str, Sequence[str]], max_list_keys: int = 4_000_000) -> dict[str, Cascade]:
    """One cascade for each named list of keys, over the universe's column `key`.

    One pass sizes the universe, one finds the keys that a first level accepts;
    both send only list-sized results to the driver, 24 bytes a key.  Only the
    first levels' bits are broadcast.
    """
    if sum(map(len, lists.values())) > max_list_keys:
        raise ValueError(f"lists hold more than {max_list_keys} keys; split them by host")
    hashed = {}
    for name, keys in lists.items():
        rows = spark.createDataFrame([(k,) for k in sorted(set(keys))], "key string").select(_hash_pair(F.col("key")).alias("h")).select("h.*").toPandas() if keys else pd.DataFrame({"one": [], "two": []})
        hashed[name] = tuple(rows[c].to_numpy(dtype=np.int64).view(np.uint64) for c in ("one", "two"))
    pairs = universe.select(_hash_pair(F.col("key")).alias("h")).select("h.*")
    total = max(1, pairs.agg(F.approx_count_distinct("one")).first()[0])
    first = {}
    for name, keys in hashed.items():
        rate = max(1e-9, min(0.5, len(keys[0]) / total * math.sqrt(0.5)))
        first[name] = BloomFilter.build(*keys, rate=rate, seed=0)
    shared = spark.sparkContext.broadcast(first)
    names = list(lists)

    def accepted(batches):
        filters = shared.value
        for pdf in batches:
            one, two = (pdf[c].to_numpy(dtype=np.int64).view(np.uint64) for c in ("one", "two"))
            for k, name in enumerate(names):
                at = np.flatnonzero(filters[name].has(one, two))
                if len(at):
                    yield pd.DataFrame({"list": k, "one": one[at].view(np.int64), "two": two[at].view(np.int64)}).drop_duplicates()

    most = 2 * max_list_keys
    found = pairs.mapInPandas(accepted, "list int, one bigint, two bigint").distinct().limit(most + 1).toPandas()
    if len(found) > most:
        raise ValueError("the first levels leave too many false positives for the driver")
    out = {}
    for k, name in enumerate(names):
        part = found[found["list"] == k].sort_values(["one", "two"])
        one, two = (part[c].to_numpy(dtype=np.int64).view(np.uint64) for c in ("one", "two"))
        listed = set(zip(*(x.tolist() for x in hashed[name]), strict=True))
        wrong = np.array([x not in listed for x in zip(one.tolist(), two.tolist(), strict=True)], dtype=bool)
        out[name] = _refine(hashed[name], (one[wrong], two[wrong]), first[name])
    return out


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], url: str = "url", default: str = "allow", max_list_keys: int = 4_000_000) -> DataFrame:
    """Judge each row's url by the longest fitting rule.

    `rules` are (verdict, text) pairs, text being host + path such as
    ``example.org/es/``.  A rule fits its host and every subdomain if the url's
    path starts with the rule's path.  Among fitting rules the longest text
    wins, then the longer host.  A url that no cascade lists gets `default` and
    a null rule.  Adds host, path, rule and verdict, replacing columns of those
    names; all other columns pass through.  Null urls and urls without ``://``
    have empty host and path.  Repeated rows are judged one by one; an empty
    table gives an empty result; a text of any length is used whole.
    """
    spark = pages.sparkSession
    verdicts = list(dict.fromkeys(v for v, _ in rules))
    if len({t for _, t in rules}) != len({*rules}):
        raise ValueError("a rule text has two verdicts")
    cut = [t.find("/") if "/" in t else len(t) for _, t in rules]
    labels = sorted({t[:k].count(".") + 1 for (_, t), k in zip(rules, cut, strict=True)})
    lengths = sorted({len(t) - k for (_, t), k in zip(rules, cut, strict=True)})
    rest = [F.col(f"`{c}`") for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    # helper columns stand in one struct, whose name no column of the rows has
    (me,) = free_names(pages, "url_helper")
    x = lambda name: F.col(f"{me}.{name}")
    host, path = split_url(F.col(f"`{url}`"))
    plain = pages.select(*rest, F.struct(host.alias("host"), path.alias("path")).alias(me))
    if not rules:
        return plain.select(*rest, x("host").alias("host"), x("path").alias("path"), F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    keys = _keys(x("host"), x("path"), labels, lengths)
    cascades = build_cascades(spark, plain.select(F.explode(keys).alias("key")), {v: [t for w, t in rules if w == v] for v in verdicts}, max_list_keys)
    shared = spark.sparkContext.broadcast(cascades)

    def judged(one: pd.Series, two: pd.Series) -> pd.Series:
        """For each key the number of the list that has it, else -1."""
        sizes = one.map(len).to_numpy()
        flat = [np.concatenate([np.asarray(v, dtype=np.int64) for v in s]).view(np.uint64) if sizes.sum() else np.empty(0, dtype=np.uint64) for s in (one, two)]
        found = np.full(sizes.sum(), -1, dtype=np.int32)
        for k, name in enumerate(verdicts):
            found[shared.value[name].has(*flat)] = k
        return pd.Series(np.split(found, np.cumsum(sizes)[:-1]) if len(sizes) else [])

    lists = F.pandas_udf(judged, T.ArrayType(T.IntegerType()))
    asked = plain.select(*rest, F.col(me), keys.alias(me + "_keys"))
    hashed = [F.transform(me + "_keys", lambda k: F.xxhash64(k)), F.transform(me + "_keys", lambda k: F.xxhash64(F.lit(1), k))]
    asked = asked.select("*", lists(*hashed).alias(me + "_lists"))
    hits = F.filter(F.arrays_zip(F.col(me + "_keys").alias("rule"), F.col(me + "_lists").alias("list")), lambda h: h["list"] >= 0)
    ranked = F.transform(hits, lambda h: F.struct(F.length(h["rule"]).alias("n"), F.locate("/", F.concat(h["rule"], F.lit("/"))).alias("h"), h["rule"].alias("rule"), F.get(F.array(*(F.lit(v) for v in verdicts)), h["list"]).alias("verdict")))
    best = asked.select(*rest, F.col(me), F.array_max(ranked).alias(me + "_best"))
    verdict = F.coalesce(f"{me}_best.verdict", F.lit(default))
    return best.select(*rest, x("host").alias("host"), x("path").alias("path"), F.col(f"{me}_best.rule").alias("rule"), verdict.alias("verdict"))
