"""URL filtering by Bloom filter cascades.

A cascade gives exact membership for every key of a known universe: its first level encodes the listed keys; the second
the unlisted keys of the universe that pass the first; the third the listed keys that pass the second, and so on until
a level lets nothing pass by accident. A key's answer follows from the first level that it fails. URLs are judged
against the levels alone, without a join; the universe is all keys that the corpus's URLs give.

A rule is a host and a path prefix. It fits its host, all subdomains, and paths that start with its path. A URL's keys
are its host's suffixes, each with its path's prefixes of the lengths that rules have. One cascade holds the blocking
rules, one the allowing ones (a rule in both allows); the longest rule that fits decides. URLs that no rule fits are
blocked if a label of their host is a listed one, by a third cascade over all labels, and allowed otherwise.

Keys are dealt to shards by a hash of 128 bits; each shard's cascade is built in one task, from the shard's part of the
universe, and has a bounded size. Shards are broadcast in groups of at most ``MOST_BYTES`` (or one shard), one pass over
the rows for each group, which asks the levels for the keys of its shards and keeps what was found so far. Keys are joined
to nothing, neither the listed ones nor the rows'.

Rules' hosts are lower-cased in A-Z, as URLs' hosts are. A null URL or one without :// has an empty host and path, fits
no rule and is allowed. Extra columns are kept, those named host, path, rule or verdict under that name with a line
behind; repeated rows stay. Empty tables give empty results.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ._arrays import mix
from ._spark import discard, fresh, materialize

#: Levels broadcast for one pass over the rows.
MOST_BYTES = 64 << 20
#: Keys of the universe in a shard, about.
SHARD_KEYS = 1 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def digests(key: Column | str) -> list[Column]:
    """128 bits that name a key."""
    return [F.xxhash64(F.lit(1), key), F.xxhash64(F.lit(2), key)]


@dataclass
class Level:
    """A Bloom filter."""

    bits: int
    hashes: int
    table: np.ndarray

    @staticmethod
    def of(number: int, a: np.ndarray, b: np.ndarray, hashes: int) -> Level:
        bits = max(64, int(np.ceil(len(a) * hashes * 1.4427)))
        level = Level(bits, hashes, np.zeros(bits // 8 + 1, dtype=np.uint8))
        for h in range(hashes):
            slot = level.slots(number, h, a, b)
            np.bitwise_or.at(level.table, slot >> 3, np.uint8(1) << (slot & 7).astype(np.uint8))
        return level

    def slots(self, number: int, h: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (mix(a + b * np.uint64(2 * h + 1) + np.uint64(number * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) % np.uint64(self.bits)).astype(np.int64)

    def passes(self, number: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.ones(len(a), dtype=bool)
        for h in range(self.hashes):
            slot = self.slots(number, h, a, b)
            out &= (self.table[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
        return out


def build_levels(a: np.ndarray, b: np.ndarray, listed: np.ndarray) -> list[Level]:
    """The levels that tell the listed ones of these keys (digests a, b) from the others."""
    inner, outer, levels = (a[listed], b[listed]), (a[~listed], b[~listed]), []
    # The first level passes about as many unlisted keys as there are listed ones.
    hashes = max(1, min(16, round(np.log2(max(2.0, len(outer[0]) / max(1, len(inner[0])))))))
    while len(inner[0]):
        levels.append(Level.of(len(levels), *inner, hashes if not levels else 2))
        passed = levels[-1].passes(len(levels) - 1, *outer)
        inner, outer = (outer[0][passed], outer[1][passed]), inner
    return levels


def listed_by(levels: list[Level], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The levels' answer: failing the first, third, ... level means not listed, the second, fourth, ... listed."""
    answer, open_ = np.full(len(a), len(levels) % 2 == 1), np.arange(len(a))
    for k, level in enumerate(levels):
        passed = level.passes(k, a[open_], b[open_])
        answer[open_[~passed]] = k % 2 == 1
        open_ = open_[passed]
    return answer


def _shard(a: np.ndarray, shards: int) -> np.ndarray:
    return ((a >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)


def _shard_of(a: Column, shards: int) -> Column:
    return F.shiftrightunsigned(a, 32) % shards


def _levels(bits, hashes, tables) -> list[Level]:
    return [Level(int(n), int(h), np.frombuffer(t, dtype=np.uint8)) for n, h, t in zip(bits, hashes, tables)]


def _unsigned(values) -> np.ndarray:
    return np.asarray(values, dtype=np.int64).view(np.uint64)


@dataclass
class Cascade:
    """levels: one row for each shard that lists a key (shard, size, and by level bits, hashes and tables); groups: the shards of each pass; held: all levels here, where one pass does."""

    shards: int
    levels: DataFrame | None
    held: dict[int, list[Level]] | None
    groups: list[tuple[int, int]]

    def holds(self, rows: DataFrame, keys: str, out: str) -> DataFrame:
        """rows with ``out``: those of the strings in the array column ``keys`` that are listed, each as often as it stands there."""
        result, before = rows.withColumn(out, F.array().cast("array<string>")), None
        for k, (first, last) in enumerate(self.groups):
            result = result.withColumn(out, F.concat(out, self._of(rows.sparkSession, first, last, keys)))
            if k + 1 < len(self.groups):  # the next pass's executors needn't hold this one's levels
                result = materialize(result, "pass")
                if before is not None:
                    discard(before)
                before = result
        return result

    def _of(self, spark, first: int, last: int, keys: str) -> Column:
        """The keys that the levels of the shards from first to last list."""
        own = self.held or _read(self.levels.where(F.col("shard").between(first, last)))
        shared, shards = spark.sparkContext.broadcast(own), self.shards

        @F.pandas_udf("array<boolean>")
        def test(pairs: pd.Series) -> pd.Series:
            sizes = np.array([len(p) // 2 for p in pairs], dtype=np.int64)
            flat = _unsigned(np.concatenate([np.zeros(0, dtype=np.int64), *pairs])).reshape(-1, 2)
            a, b = np.ascontiguousarray(flat[:, 0]), np.ascontiguousarray(flat[:, 1])
            shard, answer = _shard(a, shards), np.zeros(len(a), dtype=bool)
            for s in np.unique(shard):
                if s in shared.value:
                    mine = np.flatnonzero(shard == s)
                    answer[mine] = listed_by(shared.value[s], a[mine], b[mine])
            return pd.Series([x.tolist() for x in np.split(answer, np.cumsum(sizes)[:-1])] if len(sizes) else [], dtype=object)

        flags = test(F.flatten(F.transform(keys, lambda k: F.array(*digests(k)))))
        kept = F.filter(F.arrays_zip(F.col(keys).alias("k"), flags.alias("f")), lambda z: z["f"])
        return F.transform(kept, lambda z: z["k"])


def _read(levels: DataFrame) -> dict[int, list[Level]]:
    return {r["shard"]: _levels(r["bits"], r["hashes"], r["tables"]) for r in levels.toLocalIterator()}


def _groups(sizes: list[tuple[int, int]], most_bytes: int) -> list[tuple[int, int]]:
    """First and last shard of each group of neighbours that together have at most ``most_bytes``, or of one shard."""
    groups, total = [], 0
    for shard, size in sizes:
        if groups and total + size <= most_bytes:
            groups[-1], total = (groups[-1][0], shard), total + size
        else:
            groups.append((shard, shard))
            total = size
    return groups


def build_cascade(listed: DataFrame, universe: DataFrame, most_bytes: int = MOST_BYTES, shard_keys: int = SHARD_KEYS) -> Cascade:
    """A cascade of the column ``key`` of listed, exact for all keys of universe."""
    of = lambda df, own: df.select("key").where("key is not null").select(*(d.alias(n) for d, n in zip(digests("key"), "ab")), F.lit(own).alias("listed"), F.lit(not own).alias("there"))
    every = of(listed, True).union(of(universe, False)).groupBy("a", "b").agg(F.max("listed").alias("listed"), F.max("there").alias("there"))
    every = materialize(every.where("there").drop("there"), "universe")
    counts = every.agg(F.count("*").alias("n"), F.count_if("listed").alias("inside")).first()
    if not counts["inside"]:
        return Cascade(1, None, None, [])
    shards = -(-counts["n"] // shard_keys)

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        levels = build_levels(*(_unsigned(pdf[c]) for c in "ab"), pdf["listed"].to_numpy(dtype=bool))
        tables = [x.table.tobytes() for x in levels]
        return pd.DataFrame({"shard": [key[0]], "size": [sum(map(len, tables))], "bits": [[x.bits for x in levels]], "hashes": [[x.hashes for x in levels]], "tables": [tables]})

    levels = every.groupBy(_shard_of(F.col("a"), shards).alias("shard")).applyInPandas(build, "shard long, size long, bits array<long>, hashes array<int>, tables array<binary>")
    levels = materialize(levels.where("size > 0"), "levels")
    sizes = levels.select("shard", "size").orderBy("shard").toLocalIterator()  # one small row for each SHARD_KEYS keys
    groups = _groups([(r["shard"], r["size"]) for r in sizes], most_bytes)
    return Cascade(shards, levels, _read(levels) if len(groups) == 1 else None, groups)


def judge_urls(pages: DataFrame, rules: DataFrame, labels: DataFrame, url: str = "url") -> DataFrame:
    """pages with host, path, rule (the longest that fits) and verdict.

    rules: host, path, verdict (allow or block); labels: key, the host labels that block."""
    taken = [c for c in pages.columns if c.lower() in ("host", "path", "rule", "verdict")]
    for c in taken:
        free = fresh(pages, c)
        pages, url = pages.withColumnRenamed(c, free), free if url == c else url
    host, path = split_url(F.col(url))
    hosts, keys, parts = (fresh(pages, c) for c in ("suffixes", "url_keys", "host_labels"))
    rules = rules.select(F.concat(F.translate("host", UPPER, LOWER), F.coalesce("path", F.lit(""))).alias("key"), F.length(F.coalesce("path", F.lit(""))).alias("n"), "verdict").where("key is not null")
    rules = materialize(rules, "rules")
    lengths = [r["n"] for r in rules.select("n").distinct().orderBy("n").collect()]  # as many as a path has characters at most
    rows = pages.withColumn("host", host).withColumn("path", path)
    split = F.when(F.col("host") != "", F.split("host", r"\.")).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn(parts, split).withColumn(hosts, F.transform(F.sequence(F.lit(1), F.size(split)), lambda i: F.array_join(F.slice(F.col(parts), i, F.size(parts)), ".")))
    rows = rows.withColumn(hosts, F.when(F.size(parts) > 0, F.col(hosts)).otherwise(F.array().cast("array<string>")))
    of_length = F.filter(F.array(*(F.lit(n) for n in lengths)) if lengths else F.array().cast("array<int>"), lambda n: n <= F.length("path"))
    rows = rows.withColumn(keys, F.array_distinct(F.flatten(F.transform(hosts, lambda h: F.transform(of_length, lambda n: F.concat(h, F.left(F.col("path"), n)))))))
    universe = materialize(rows.select(F.explode(keys).alias("key")).distinct(), "keys")
    allow = rules.where("verdict = 'allow'").select("key")
    block = rules.where("verdict = 'block'").select("key").join(allow, "key", "left_anti")
    allowed, blocked, listed = fresh(pages, "allow_keys"), fresh(pages, "block_keys"), fresh(pages, "listed_labels")
    rows = build_cascade(allow, universe).holds(rows, keys, allowed)
    rows = build_cascade(block, universe).holds(rows, keys, blocked)
    every = rows.select(F.explode(parts).alias("key")).distinct()
    rows = build_cascade(labels, every).holds(rows, parts, listed)
    longest = lambda c: F.element_at(F.array_sort(F.transform(c, lambda k: F.struct(F.length(k).alias("n"), k.alias("k")))), -1)
    best = lambda c: F.when(F.size(c) > 0, longest(c)["k"])
    a, b = best(allowed), best(blocked)
    by_allow = a.isNotNull() & (b.isNull() | (F.length(a) > F.length(b)))
    verdict = F.when(by_allow, "allow").when(b.isNotNull(), "block").when(F.size(listed) > 0, "block").otherwise("allow")
    rows = rows.withColumn("rule", F.when(by_allow, a).otherwise(b)).withColumn("verdict", verdict)
    return rows.drop(parts, hosts, keys, allowed, blocked, listed)
