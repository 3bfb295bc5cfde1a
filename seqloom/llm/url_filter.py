"""URL filters: exact list membership by a cascade of Bloom filters over the corpus's own keys.

Level 0 holds the listed keys. Of all other keys of the corpus, those that level 0 takes for listed make level 1; of the
keys of level 0 those that level 1 takes for its own make level 2; and so on until no key is wrong. Every key of the
corpus is then answered exactly by the first level that does not know it, without a join. With level 0's rate of false
positives set to the share of listed keys, the cascade's size follows the list, not the corpus. A list too long for one
cascade is cut by a hash of the keys into parts with a cascade of their own, which the pages pass one after the other.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.shared import BROADCAST_BYTES, written

#: Domains that the default list blocks, with all their subdomains: six site names under three registries.
BLOCKED_SITES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
BLOCKED = tuple(f"{s}.example.{t}" for s in BLOCKED_SITES for t in ("com", "net", "org"))

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://` or for null."""
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end; empty without `://` or for null."""
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(the longest rule that fits, its verdict), null if none does. A rule is a host and a path, like `example.org/es/`."""
    rule = verdict = F.lit(None).cast("string")
    for text, word in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        domain, slash, rest = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, word).otherwise(verdict)
    return rule, verdict


def suffixes(host: str) -> list[str]:
    """A host and the domains above it."""
    parts = host.split(".")
    return [".".join(parts[i:]) for i in range(len(parts))] if host else []


def _bits(keys: Iterable[str], level: int, hashes: int, size: int) -> np.ndarray:
    """keys x hashes: bit positions by double hashing."""
    a = np.fromiter((xxhash.xxh64_intdigest(k, level) for k in keys), np.uint64)
    b = (a >> np.uint64(17) | a << np.uint64(47)) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
    return (a[:, None] + np.arange(hashes, dtype=np.uint64) * b[:, None]) % np.uint64(size)


class Cascade:
    """Levels of (hashes, bits as packed bytes)."""

    def __init__(self):
        self.levels: list[tuple[int, int, np.ndarray]] = []

    def size(self) -> int:
        return sum(len(x) for _, _, x in self.levels)

    def knows(self, keys: Sequence[str], level: int) -> np.ndarray:
        hashes, size, packed = self.levels[level]
        at = _bits(keys, level, hashes, size)
        return ((packed[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)

    def listed(self, keys: Sequence[str]) -> np.ndarray:
        """Whether each key is listed: exact for all keys that the cascade was built over."""
        answer, left = np.zeros(len(keys), bool), np.arange(len(keys))
        for level in range(len(self.levels)):
            if not len(left):
                break
            left = left[self.knows([keys[i] for i in left], level)]
            if level % 2 == 0:
                answer[left] = True  # known here; a later level may take it back
            else:
                answer[left] = False
        return answer


def _level(keys: DataFrame, n: int, rate: float, level: int) -> tuple[int, int, np.ndarray]:
    """(hashes, bits, packed) of the Bloom filter of the n keys in the first column: tasks make words, a grouped aggregation
    joins them by or, the driver gets the words alone."""
    hashes = max(1, round(math.log2(1 / rate)))
    size = _size(n, hashes)

    def words(batches):
        for b in batches:
            at = np.unique(_bits(b.column(0).to_pylist(), level, hashes, size))
            word, start = np.unique(at >> np.uint64(6), return_index=True)
            bits = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), start) if len(at) else at
            yield pa.record_batch([pa.array(word.astype(np.int64)), pa.array(bits.view(np.int64))], ["word", "bits"])

    packed = np.zeros(size // 64, np.uint64)
    for r in keys.mapInArrow(words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toLocalIterator():
        packed[r.word] = r.bits & 0xFFFFFFFFFFFFFFFF
    return hashes, size, packed.view(np.uint8)


def _size(n: int, hashes: int) -> int:
    return 64 * math.ceil(max(64, n * hashes / math.log(2)) / 64)


def _rate(listed: int, others: int) -> float:
    """Level 0's rate of false positives: those that pass are about as many as the listed keys."""
    return min(0.5, listed / (math.sqrt(2) * others)) if others else 0.5


def build_cascade(universe: DataFrame, listed: DataFrame | Sequence[str]) -> Cascade:
    """The cascade for distinct keys (a table of the one column `key`).

    listed: a table with `key`, or a sequence; nulls and repeated keys count for nothing. Level 0 holds the list. Of the
    universe only what passes it, the listed keys and as many others, meets the list itself, in a join that tells them apart;
    the further levels are built over these alone.
    """
    spark = universe.sparkSession
    names = (listed if isinstance(listed, DataFrame) else spark.createDataFrame([(k,) for k in listed], "key string")).where("key is not null").select("key").distinct()
    universe, inside = universe.where("key is not null").select("key").distinct(), names.count()
    cascade = Cascade()
    if not inside:
        return cascade

    def passing(keys: DataFrame, level: int, schema: str) -> DataFrame:
        shared = spark.sparkContext.broadcast(cascade)

        def run(batches):
            for b in batches:
                yield b.filter(pa.array(shared.value.knows(b.column(0).to_pylist(), level)))

        return keys.mapInArrow(run, schema)

    cascade.levels.append(_level(names, inside, _rate(inside, universe.count()), 0))
    known = passing(universe, 0, "key string").join(names.withColumn("listed", F.lit(True)), "key", "left")
    keys = written(known.select("key", F.coalesce("listed", F.lit(False)).alias("listed")), "keys")
    while n := keys.where(F.col("listed") == (len(cascade.levels) % 2 == 0)).count():
        level = len(cascade.levels)
        mine = keys.where(F.col("listed") == (level % 2 == 0))
        cascade.levels.append(_level(mine.select("key"), n, 0.5, level))
        others = passing(keys.where(F.col("listed") == (level % 2 == 1)), level, "key string, listed boolean")
        keys = written(mine.union(others), "keys")
    return cascade


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = (), listed: DataFrame | Sequence[str] = BLOCKED, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """page_id, url, host, path, rule and verdict of every row of pages.

    A rule's verdict wins; else a url is blocked if its host, or a domain above it, is listed, by the cascade over all
    hosts and domains of the table. A list whose cascade would take over most_bytes is cut by a hash of the key into parts
    that don't; each is broadcast alone and judges all rows in a pass without a shuffle. A null url, or one without `://`, has an
    empty host and path and is allowed. Other columns are ignored; repeated rows are judged each.
    """
    rows = pages.select("page_id", F.col("url").cast("string")).withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("_ruled", verdict)
    hosts = rows.where("host <> ''").select("host").distinct()
    parts = F.split("host", r"\.", -1)
    domains = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    universe = written(hosts.select(F.explode(domains).alias("key")).distinct(), "universe")
    names = listed if isinstance(listed, DataFrame) else pages.sparkSession.createDataFrame([(k,) for k in listed], "key string")
    names = names.select("key").where("key is not null").distinct()
    inside = names.count()
    parts = 1
    if inside * 2 > most_bytes // 8:  # else two bytes a key are room enough, whatever the universe is
        # level 0, and as much again for the levels above it
        parts = min(inside, math.ceil(2 * _size(inside, max(1, round(math.log2(1 / _rate(inside, universe.count()))))) / 8 / most_bytes))
    rows = rows.withColumn("_listed", F.lit(False))
    for part in range(parts):
        own = F.pmod(F.xxhash64("key"), F.lit(parts)) == part
        cascade = build_cascade(universe.where(own), names.where(own)) if parts > 1 else build_cascade(universe, names)
        rows = rows.withColumn("_listed", F.col("_listed") | _probe(pages, cascade, part, parts)(F.col("host")))
        if part + 1 < parts:
            rows = written(rows, "judged")
    return rows.withColumn("verdict", F.coalesce("_ruled", F.when(F.col("_listed"), "block").otherwise("allow"))).select("page_id", "url", "host", "path", "rule", "verdict")


def _probe(df: DataFrame, cascade: Cascade, part: int, parts: int) -> Callable[[Column], Column]:
    """A function of a host column: whether the cascade lists the host or a domain above it; a part knows its own keys alone."""
    shared = df.sparkSession.sparkContext.broadcast((cascade, part, parts))

    @F.pandas_udf("boolean")
    def listed(host: pd.Series) -> pd.Series:
        cascade, part, parts = shared.value
        names = host.unique().tolist()
        keys = sorted({k for h in names for k in suffixes(h)})
        if parts > 1:
            keys = [k for k in keys if _signed(k) % parts == part]
        bad = {k for k, x in zip(keys, cascade.listed(keys)) if x}
        known = {h: any(k in bad for k in suffixes(h)) for h in names}
        return host.map(known).astype(bool)

    return listed


def _signed(key: str) -> int:
    """What F.xxhash64 gives for a string."""
    h = xxhash.xxh64_intdigest(key, 42)
    return h - (1 << 64) if h >> 63 else h
