"""URL filtering by cascades of Bloom filters.

A cascade holds a set of listed keys exactly over a known universe of keys. Level 1 encodes the listed
keys; level 2 those other keys of the universe that level 1 wrongly reports; level 3 the listed keys that
level 2 wrongly reports; and so on until nothing is wrong. A key's answer is the parity of the first level
that doesn't report it, so membership needs no join with the list.

The universe is every key that the corpus's own urls can ask for, so no url can meet an untested key. Levels
are built by distributed jobs: a level's set bits are gathered as 64-bit words, never as keys.

A cascade is broadcast, so its size is checked: over max_bytes, the same question is answered by a
left semi join on the key (see `judge`).

Defined cases: a null url, or one without ://, has empty host and path and gets the default verdict;
a url of any length is judged whole; repeated rows are judged each; an empty table gives an empty result; other
columns pass through untouched in `judge`, whatever their names, but for those named as one of its output columns,
which are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise

#: Seeds of the two 64-bit hashes that stand for a key.
SEEDS = ("a", "b")

#: Most levels a cascade may need before two keys are taken to share all their hashes.
MAX_LEVELS = 60


@dataclass(frozen=True)
class Rule:
    """A rule for a host and its subdomains and for paths that start with path."""

    host: str
    path: str
    verdict: str

    @property
    def key(self) -> str:
        return self.host + self.path


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without ://."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    host = F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(F.substr(rest, F.length(raw) + 1), r"(?s)^([^?#]*)", 1)
    return host, path


def suffixes(host: Column) -> Column:
    """The host and its parent domains, longest first; none for an empty host."""
    parts = F.split(host, r"\.", -1)
    return F.when(
        host != "",
        F.transform(
            F.sequence(F.lit(1), F.size(parts)),
            lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."),
        ),
    ).otherwise(F.array().cast("array<string>"))


def candidate_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """Every host suffix with every path prefix of a length that some rule has, longest first."""
    per_host = lambda h: F.filter(
        F.array(*[F.when(F.length(path) >= n, F.concat(h, F.substring(path, 1, n))) for n in lengths]),
        lambda k: k.isNotNull(),
    )
    keys = F.flatten(F.transform(suffixes(host), per_host))
    return F.array_sort(
        F.array_distinct(keys),
        lambda a, b: F.when(F.length(a) > F.length(b), -1)
        .when(F.length(a) < F.length(b), 1)
        .when(a < b, -1)
        .when(a > b, 1)
        .otherwise(0),
    )


def hashed(key: Column) -> Column:
    return F.struct(*[F.xxhash64(F.lit(s), key).alias(s) for s in SEEDS])


@dataclass
class Level:
    bits: int
    probes: int
    words: np.ndarray = field(repr=False)


def positions(a: np.ndarray, b: np.ndarray, level: int, bits: int, probes: int) -> np.ndarray:
    """Bit positions of keys given by two hashes, one row per probe; each level hashes anew."""
    a, b = a.astype(np.uint64), b.astype(np.uint64)
    salt = np.uint64((level * 0x9E3779B97F4A7C15) % 2**64)
    x = (a ^ salt) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    y = ((b + salt) * np.uint64(0x94D049BB133111EB)) | np.uint64(1)
    y ^= (y >> np.uint64(32)) << np.uint64(1)
    return np.stack([((x + np.uint64(i) * y) >> np.uint64(11)) % np.uint64(bits) for i in range(probes)])


def reported(level: Level, number: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether a level reports each key."""
    if not len(a):
        return np.zeros(0, bool)
    at = positions(a, b, number, level.bits, level.probes)
    return ((level.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool).all(0)


def contains(levels: list[Level], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Membership of keys of the universe: the parity of the first level that doesn't report them."""
    depth = np.full(len(a), len(levels))
    open_ = np.arange(len(a))
    for i, level in enumerate(levels):
        hit = reported(level, i, a[open_], b[open_])
        depth[open_[~hit]] = i
        open_ = open_[hit]
    return depth % 2 == 1


def size_of_level(n: int, others: int, first: bool) -> tuple[int, int]:
    """Bits and probes for n keys: level 1 lets about n of the others through, the next let half."""
    rate = 0.5
    if first and others > n:
        rate = max(1e-6, min(0.5, n / (math.sqrt(2) * others)))
    bits = max(64, math.ceil(n * 1.44 * math.log2(1 / rate) / 64) * 64)
    return bits, max(1, round(math.log2(1 / rate)))


class TooLarge(ValueError):
    """The cascade would be larger than may be broadcast."""


def build_cascade(keys: DataFrame, max_bytes: int = 16 << 20) -> list[Level]:
    """A cascade for a table of distinct keys (a long, b long, listed boolean).

    Only counts and set bits come to the driver, at most max_bytes of them over all levels.
    """
    counts = {r["listed"]: r["n"] for r in keys.groupBy("listed").agg(F.count(F.lit(1)).alias("n")).collect()}
    levels: list[Level] = []
    spent = 0
    n, other = counts.get(True, 0), counts.get(False, 0)
    while n:
        bits, probes = size_of_level(n, other, not levels)
        spent += bits // 8
        if spent > max_bytes:
            raise TooLarge(f"a cascade over {max_bytes} bytes")
        number, wanted, before = len(levels), len(levels) % 2 == 0, list(levels)

        def set_bits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            words = np.zeros(bits // 64, np.uint64)
            for pdf in batches:
                a, b = pdf["a"].to_numpy(), pdf["b"].to_numpy()
                for i, level in enumerate(before):
                    hit = reported(level, i, a, b)
                    a, b = a[hit], b[hit]
                if len(a):
                    at = positions(a, b, number, bits, probes).ravel()
                    np.bitwise_or.at(words, at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63)))
            there = np.flatnonzero(words)
            yield pd.DataFrame({"w": there.astype(np.int64), "v": words[there].view(np.int64)})

        got = (
            keys.filter(F.col("listed") == wanted)
            .select("a", "b")
            .mapInPandas(set_bits, "w long, v long")
            .groupBy("w")
            .agg(F.bit_or("v").alias("v"))
            .collect()
        )
        words = np.zeros(bits // 64, np.uint64)
        for r in got:
            words[r["w"]] = np.int64(r["v"]).astype(np.uint64)
        levels.append(Level(bits, probes, words))
        if len(levels) > MAX_LEVELS:
            raise ValueError("two keys of the universe share their hashes")
        after = list(levels)

        def wrong(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            n = 0
            for pdf in batches:
                a, b = pdf["a"].to_numpy(), pdf["b"].to_numpy()
                for i, level in enumerate(after):
                    hit = reported(level, i, a, b)
                    a, b = a[hit], b[hit]
                n += len(a)
            yield pd.DataFrame({"n": [n]})

        found = keys.filter(F.col("listed") != wanted).select("a", "b").mapInPandas(wrong, "n long").agg(F.sum("n")).first()[0]
        n, other = found or 0, n
    return levels


def key_table(urls: DataFrame, listed: list[str] | DataFrame, lengths: list[int]) -> DataFrame:
    """The complete key universe of the corpus with the mark `listed`: distinct (key, a, b, listed)."""
    host, path = host_path(F.col("url"))
    keys = urls.select(F.explode(candidate_keys(host, path, lengths)).alias("key")).distinct()
    if isinstance(listed, DataFrame):
        mark = listed.select(F.col(listed.columns[0]).alias("key")).distinct().withColumn("listed", F.lit(True))
        marked = keys.join(mark, "key", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    else:
        marked = keys.withColumn("listed", F.col("key").isin(*listed) if listed else F.lit(False))
    return marked.select("key", "listed", hashed(F.col("key")).alias("h")).select("key", "h.*", "listed")


def membership(spark: SparkSession, hashes: Column, cascades: list[list[Level]]) -> Column:
    """For an array of key hashes, per key the number of the first cascade that holds it, from 1, else 0."""
    shared = spark.sparkContext.broadcast(cascades)

    @F.pandas_udf("array<int>")
    def test(col: pd.Series) -> pd.Series:
        sizes = np.array([0 if x is None else len(x) for x in col])
        flat = [h for x in col if x is not None for h in x]
        a = np.array([h["a"] for h in flat], np.int64)
        b = np.array([h["b"] for h in flat], np.int64)
        found = np.zeros(len(flat), np.int32)
        for i, levels in reversed(list(enumerate(shared.value, 1))):
            found[contains(levels, a, b)] = i
        ends = np.cumsum(sizes)
        return pd.Series([found[e - n : e] for e, n in zip(ends, sizes)])

    return test(hashes)


def other_columns(urls: DataFrame) -> Column:
    """What `judge` passes through, as one struct, so that no name clashes with the columns it works with."""
    return F.struct(*[F.col(f"`{c}`") for c in urls.columns if c not in ("host", "path", "rule", "verdict")]).alias("_row")


def judge(urls: DataFrame, rules: list[Rule], listed_hosts: list[str] | DataFrame, max_bytes: int = 16 << 20) -> DataFrame:
    """urls with host, path, rule (`host` + `path` of the longest fitting rule, else null) and verdict.

    Where no rule fits, a url is blocked if its host or a parent domain is in listed_hosts.
    """
    spark = urls.sparkSession
    rule_lengths = sorted({len(r.path) for r in rules})
    lengths = sorted({0, *rule_lengths})
    sets: list[list[str] | DataFrame] = [
        [r.key for r in rules if r.verdict == "block"],
        [r.key for r in rules if r.verdict == "allow"],
        listed_hosts,
    ]
    cascades: list[list[Level]] = []
    for i, listed in enumerate(sets):
        keys = materialise(key_table(urls, listed, [0] if i == 2 else lengths), f"url-keys-{i}")
        try:
            cascades.append(build_cascade(keys, max_bytes))
        except TooLarge:
            return judge_by_join(urls, rules, listed_hosts)
    host, path = host_path(F.col("url"))
    keyed = urls.select(other_columns(urls), host.alias("host"), path.alias("path")).withColumn(
        "_keys", candidate_keys(F.col("host"), F.col("path"), lengths)
    )
    hashes = F.transform("_keys", hashed)
    tested = keyed.withColumn("_rules", membership(spark, hashes, cascades[:2]))
    tested = tested.withColumn("_hosts", membership(spark, F.transform(suffixes(F.col("host")), hashed), cascades[2:]))
    first = F.try_element_at(F.filter(F.arrays_zip("_keys", "_rules"), lambda x: x["_rules"] > 0), F.lit(1))
    own = F.when(F.exists("_hosts", lambda x: x > 0), F.lit("block")).otherwise(F.lit("allow"))
    return tested.withColumn("_first", first).select(
        "_row.*",
        "host",
        "path",
        F.col("_first._keys").alias("rule"),
        F.when(F.col("_first._rules") == 1, "block").when(F.col("_first._rules") == 2, "allow").otherwise(own).alias("verdict"),
    )


def judge_by_join(urls: DataFrame, rules: list[Rule], listed_hosts: list[str] | DataFrame) -> DataFrame:
    """The same answers by a join with the listed hosts, for lists whose cascade is too large to broadcast."""
    spark = urls.sparkSession
    if not isinstance(listed_hosts, DataFrame):
        listed_hosts = spark.createDataFrame([(h,) for h in listed_hosts], "key string")
    host, path = host_path(F.col("url"))
    keyed = urls.select(other_columns(urls), host.alias("host"), path.alias("path"))
    asked = keyed.select("host").distinct().select("host", F.explode(suffixes(F.col("host"))).alias("_key"))
    listed = listed_hosts.select(F.col(listed_hosts.columns[0]).alias("_key")).distinct()
    bad = asked.join(listed, "_key", "left_semi").select("host").distinct().withColumn("_bad", F.lit(True))
    best = F.lit(None).cast("struct<n:int,key:string,verdict:string>")
    fits = [
        F.when(
            ((F.col("host") == r.host) | F.endswith(F.col("host"), F.lit("." + r.host))) & F.startswith(F.col("path"), F.lit(r.path)),
            F.struct(F.lit(len(r.key)).alias("n"), F.lit(r.key).alias("key"), F.lit(r.verdict).alias("verdict")),
        )
        for r in rules
    ]
    best = F.greatest(best, *fits) if fits else best
    return (
        keyed.withColumn("_best", best)
        .join(bad, "host", "left")
        .select(
            "_row.*",
            "host",
            "path",
            F.col("_best.key").alias("rule"),
            F.coalesce(F.col("_best.verdict"), F.when(F.col("_bad"), "block").otherwise("allow")).alias("verdict"),
        )
    )
