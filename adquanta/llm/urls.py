"""URL filters: rules, and a Bloom filter cascade for exact membership in a list of hosts.

The first filter holds the listed keys. Keys of the universe that it takes for
listed are held by a second filter, listed keys that the second takes for those
by a third, and so on until a level makes no mistake. For every key of the
universe the first level that denies it decides, without a join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .words import mix

SHARD_KEYS = 200_000
# Filters of more bytes are broadcast in several rounds of at most this size.
ROUND_BYTES = 32 << 20
MOST_LEVELS = 64

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty if null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _UPPER.lower())
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def longest_rule(host: Column, path: Column, rules: dict[str, str]) -> tuple[Column, Column]:
    """The longest rule (host and path prefix) that fits, and its verdict; null if none does.

    A rule holds for its host and all subdomains. Of equally long rules the
    first in alphabetical order counts. Rules stand in the plan, so they are few.
    """
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (-len(r), r))[::-1]:
        rule_host, slash, rule_path = rule.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rule_path)
        name = F.when(fits, rule).otherwise(name)
        verdict = F.when(fits, rules[rule]).otherwise(verdict)
    return name, verdict


class Bloom:
    """Bits of one level over two 64-bit digests of a key."""

    def __init__(self, size: int, hashes: int, level: int, bits: np.ndarray | None = None):
        self.size, self.hashes, self.level = size, hashes, level
        self.bits = np.zeros(size // 8 + 1, np.uint8) if bits is None else bits

    def _places(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        salt = mix(np.full(1, self.level + 1, np.uint64))
        start, step = mix(one ^ salt), mix(two + salt) | np.uint64(1)
        turns = np.arange(self.hashes, dtype=np.uint64)[:, None]
        return ((start + turns * step) >> np.uint64(16)) % np.uint64(self.size)

    def add(self, one: np.ndarray, two: np.ndarray) -> Bloom:
        places = self._places(one, two).ravel()
        np.bitwise_or.at(self.bits, (places >> np.uint64(3)).astype(np.int64),
                         (1 << (places & np.uint64(7))).astype(np.uint8))
        return self

    def has(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        places = self._places(one, two)
        bit = self.bits[(places >> np.uint64(3)).astype(np.int64)] >> (places & np.uint64(7)).astype(np.uint8)
        return (bit & 1).all(0)


def build_levels(one: np.ndarray, two: np.ndarray, listed: np.ndarray) -> list[Bloom]:
    """Levels for distinct keys; raises if two keys of different kind cannot be told apart."""
    held, other = np.flatnonzero(listed), np.flatnonzero(~listed)
    levels: list[Bloom] = []
    while len(held):
        if len(levels) == MOST_LEVELS:
            raise ValueError("keys with equal digests are on both sides")
        # Mistakes of the first level should be about as many as the keys it holds.
        rate = 0.5 if levels else min(0.5, max(0.001, len(held) / max(1, len(other))))
        size = max(8, math.ceil(-len(held) * math.log(rate) / math.log(2) ** 2))
        level = Bloom(size, max(1, round(-math.log2(rate))), len(levels)).add(one[held], two[held])
        wrong = other[level.has(one[other], two[other])]
        levels.append(level)
        held, other = wrong, held
    return levels


def build_cascade(universe: DataFrame, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """Staged levels of all shards from the complete universe (key, listed).

    Keys are made distinct first, so a key that fills the table counts once; a
    shard is about ``shard_keys`` keys by hash, whatever the number of keys.
    """
    keys = universe.groupBy("key").agg(F.max("listed").alias("listed"))
    n_shards = max(1, -(-keys.count() // shard_keys))
    digests = keys.select(
        F.pmod(F.xxhash64(F.lit("shard"), "key"), F.lit(n_shards)).alias("shard"),
        F.xxhash64("key").alias("one"), F.xxhash64(F.lit("two"), F.reverse("key")).alias("two"), "listed")

    def run(table: pa.Table) -> pa.Table:
        one, two = (np.asarray(table[c]).view(np.uint64) for c in ("one", "two"))
        levels = build_levels(one, two, np.asarray(table["listed"]))
        shard = table["shard"][0].as_py()
        return pa.table({
            "shard": pa.array([shard] * len(levels), pa.int64()),
            "n_shards": pa.array([n_shards] * len(levels), pa.int64()),
            "level": pa.array(range(len(levels)), pa.int32()),
            "size": pa.array([b.size for b in levels], pa.int64()),
            "hashes": pa.array([b.hashes for b in levels], pa.int32()),
            "bits": pa.array([b.bits.tobytes() for b in levels], pa.binary())})

    return stage(digests.groupBy("shard").applyInArrow(
        run, "shard bigint, n_shards bigint, level int, size bigint, hashes int, bits binary"), "cascade")


def _member(shared):
    """A function of (shard, first digest, second digest): whether the broadcast levels list the key."""
    @F.pandas_udf("boolean")
    def member(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        levels = {s: [Bloom(n, k, i, np.frombuffer(b, np.uint8)) for n, k, i, b in rows]
                  for s, rows in shared.value.items()}
        for shards, ones, twos in parts:
            got = np.zeros(len(shards), bool)
            for s in np.intersect1d(shards.unique(), list(levels)):
                at = np.flatnonzero(shards.to_numpy() == s)
                one = ones.to_numpy()[at].view(np.uint64)
                two = twos.to_numpy()[at].view(np.uint64)
                for i, level in enumerate(levels[s]):
                    has = level.has(one, two)
                    at, one, two = at[has], one[has], two[has]
                    # Members of level i are listed if i is even, until a later level says more.
                    got[at] = i % 2 == 0
            yield pd.Series(got)

    return member


def in_cascade(df: DataFrame, key: str, cascade: DataFrame, out: str,
               round_bytes: int = ROUND_BYTES) -> DataFrame:
    """Add ``out``: whether ``key``, a member of the universe, is listed; null is not.

    The cascade is broadcast after its size is known: in one piece up to
    ``round_bytes``, else shard by shard in as many rounds as that takes, each
    with a broadcast of its own. Rows never move.
    """
    sizes = cascade.groupBy("shard", "n_shards").agg(F.sum(F.length("bits")).alias("b"))
    total = sizes.agg(F.max("n_shards"), F.max("b")).first()
    if total[0] is None:  # nothing is listed
        return df.withColumn(out, F.lit(False))
    n_shards, per_round = total[0], max(1, round_bytes // max(1, total[1]))
    shard = F.pmod(F.xxhash64(F.lit("shard"), F.col(key)), F.lit(n_shards))
    found = F.lit(False)
    for lo in range(0, n_shards, per_round):
        part = cascade.where((F.col("shard") >= lo) & (F.col("shard") < lo + per_round)).toPandas()
        shared = df.sparkSession.sparkContext.broadcast({
            s: list(g.sort_values("level")[["size", "hashes", "level", "bits"]].itertuples(index=False, name=None))
            for s, g in part.groupby("shard")})

        found = found | _member(shared)(shard, F.xxhash64(key), F.xxhash64(F.lit("two"), F.reverse(key)))
    return df.withColumn(out, F.col(key).isNotNull() & found)


# The rules of the named query.
RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block",
         "com/fr/": "allow", "com/de/": "block"}
# Hosts are listed if a part of their name (between dots or hyphens) is one of these.
TERMS = ("spam", "casino", "pills", "bets", "adult", "ads")


def listed_host(host: Column, terms: tuple[str, ...] = TERMS) -> Column:
    return host.rlike(rf"(^|[.-])({'|'.join(terms)})([.-]|$)")


def filter_urls(pages: DataFrame, rules: dict[str, str] = RULES, terms: tuple[str, ...] = TERMS,
                id_col: str = "page_id", url_col: str = "url", shard_keys: int = SHARD_KEYS,
                round_bytes: int = ROUND_BYTES) -> DataFrame:
    """Per row: the id, host, path, rule, verdict, listed.

    A fitting rule decides; otherwise pages of listed hosts are blocked, all
    others allowed. The universe are all hosts of ``pages``. Null URLs and those
    without ``://`` have an empty host and path. Rows that repeat get equal
    answers; other columns are not looked at; an empty table gives no rows.
    """
    host, path = host_and_path(F.col(url_col))
    split = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    universe = split.select(F.col("host").alias("key")).distinct() \
        .withColumn("listed", listed_host(F.col("key"), terms))
    marked = in_cascade(split, "host", build_cascade(universe, shard_keys), "listed", round_bytes)
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    by_list = F.when(F.col("listed"), "block").otherwise("allow")
    return marked.select(id_col, "host", "path", rule.alias("rule"),
                         F.coalesce(verdict, by_list).alias("verdict"), "listed")
