"""URL rules by Bloom filter cascades.

A cascade answers membership in a list exactly for every key of a known universe: its first Bloom filter holds the listed
keys, the second those other keys of the universe that the first takes by mistake, the third the listed keys that the second takes, and
so on until a level makes no mistake. The universe is every key that any url of the corpus can ask for, so no url needs a
join. Keys are host suffixes of as many labels as some listed host or rule has, with path prefixes of the lengths that rules
have: a url of many labels makes no more keys than others.

Filters are built in Spark from key hashes; what is sent to the tasks is bounded by ``MOST_BYTES``: a longer list is split
by hash into slices. Each has a cascade of its own, built when the answers of the slice before are written, so the driver and the
tasks hold one at a time.

Defined cases: a null url or one without ``://`` has empty host and path; null and repeated list keys count once or not
at all; urls and hosts of any length are judged whole; of rules of equal length the one with the longer host wins; repeated rows get a row each; an empty list takes
nothing, an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Bytes of the filters of one slice, levels before giving up (only equal 128-bit hashes get there), words of a bitmap that come to the driver as one row.
MOST_BYTES, MOST_LEVELS, CHUNK = 32_000_000, 64, 1 << 13
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HASHES = ("h1", "h2")


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.coalesce(F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)), F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def with_hashes(keys: DataFrame) -> DataFrame:
    return keys.select(F.xxhash64("key").alias("h1"), F.xxhash64("key", F.lit("second")).alias("h2"))


class Level:
    """A Bloom filter over pairs of 64-bit hashes."""

    def __init__(self, number: int, n: int, rate: float):
        self.number, self.hashes = number, max(1, math.ceil(-math.log2(rate)))
        self.words = max(1, math.ceil(n * self.hashes / math.log(2) / 64))
        self.bits = np.zeros(self.words, dtype=np.uint64)

    def places(self, h1: np.ndarray, h2: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(word, bit) of each hash function."""
        out = []
        for k in range(self.hashes):
            x = (h1 ^ np.uint64((self.number * 64 + k + 1) * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
            x ^= (x >> np.uint64(29)) ^ h2
            x *= np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(32)
            place = x % np.uint64(self.words * 64)
            out.append((place >> np.uint64(6), place & np.uint64(63)))
        return out

    def takes(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        found = np.ones(len(h1), dtype=bool)
        for word, bit in self.places(h1, h2):
            found &= (self.bits[word.astype(np.int64)] >> bit & np.uint64(1)).astype(bool)
        return found


class Cascade:
    def __init__(self, levels: list[Level]):
        self.levels = levels

    def has(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Whether keys of the universe are listed."""
        h1, h2 = h1.view(np.uint64), h2.view(np.uint64)
        found, open_ = np.zeros(len(h1), dtype=bool), np.arange(len(h1))
        for k, level in enumerate(self.levels):
            open_ = open_[level.takes(h1[open_], h2[open_])]
            # taken by a level of listed keys: listed, unless the next level says that this was a mistake
            found[open_] = k % 2 == 0
        return found


def _taken(keys: DataFrame, level: Level) -> DataFrame:
    """The hash pairs that a level takes."""

    def run(batches):
        for batch in batches:
            h1, h2 = (np.asarray(batch.column(c).to_numpy(zero_copy_only=False)) for c in HASHES)
            own = level.takes(h1.view(np.uint64), h2.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(h1[own]), pa.array(h2[own])], names=list(HASHES))

    return keys.mapInArrow(run, "h1 long, h2 long")


def _filled(keys: DataFrame, level: Level) -> Level:
    """The level with the keys' bits: partial bitmaps per task, or-ed by word in Spark, sent as packed chunks."""

    def run(batches):
        bits = np.zeros(level.words, dtype=np.uint64)
        for batch in batches:
            h1, h2 = (np.asarray(batch.column(c).to_numpy(zero_copy_only=False)).view(np.uint64) for c in HASHES)
            for word, bit in level.places(h1, h2):
                np.bitwise_or.at(bits, word.astype(np.int64), np.uint64(1) << bit)
        used = np.flatnonzero(bits)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(bits[used].view(np.int64))], names=["word", "bits"])

    def packed(chunk: pa.Table) -> pa.Table:
        own, word = np.zeros(CHUNK, dtype=np.int64), np.asarray(chunk.column("word").to_numpy())
        own[word % CHUNK] = np.asarray(chunk.column("bits").to_numpy())
        return pa.table({"chunk": pa.array([int(word[0]) // CHUNK], type=pa.int64()), "packed": pa.array([own.tobytes()], type=pa.binary())})

    words = keys.mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    chunks = words.groupBy((F.col("word") / CHUNK).cast("long").alias("chunk")).applyInArrow(packed, "chunk long, packed binary")
    for r in chunks.toLocalIterator():  # MOST_BYTES in all
        own = level.bits[r.chunk * CHUNK : (r.chunk + 1) * CHUNK]
        own[:] = np.frombuffer(r.packed, dtype=np.uint64)[: len(own)]
    return level


def build(listed: DataFrame, universe: DataFrame, most_bytes: int = MOST_BYTES) -> list[Callable[[], Cascade]]:
    """Makers of the cascades (one per slice of the hash space) for the listed keys among the universe's. Both: (key)."""
    universe = common.written(with_hashes(universe.where("key IS NOT NULL")).distinct(), "universe")
    wanted = common.written(with_hashes(listed.where("key IS NOT NULL")).distinct(), "listed")
    n, m = wanted.count(), universe.count()
    rate = min(0.5, max(1e-9, n / (math.sqrt(2) * m))) if m else 0.5
    slices = max(1, math.ceil(2 * n * (2 - math.log2(rate)) / 8 / most_bytes))
    return [partial(_cascade, *(x.where(F.pmod("h1", F.lit(slices)) == k) for x in (wanted, universe)), rate) if n else partial(Cascade, []) for k in range(slices)]


def _cascade(wanted: DataFrame, universe: DataFrame, rate: float) -> Cascade:
    """The first level is asked for the whole universe; only what it takes is told from the listed keys, and later levels only see that."""
    levels, keys, rest = [], wanted, None
    while len(levels) < MOST_LEVELS:
        n = keys.count()
        if not n:
            return Cascade(levels)
        level = _filled(keys, Level(len(levels), n, rate))
        levels.append(level)
        # what the level takes by mistake is the next level's content
        mistakes = _taken(universe, level).join(wanted, list(HASHES), "left_anti") if rest is None else _taken(rest, level)
        keys, rest, rate = common.written(mistakes, "mistakes"), keys, 0.5
    raise RuntimeError("a listed key and another one have equal hashes")


def first_member(df: DataFrame, keys: str, cascades: list[Callable[[], Cascade]], out: str) -> DataFrame:
    """Adds ``out``: the place (from 1) of the first listed key in the array column ``keys``; 0 if none is.

    Of several slices, each one's answers are written before the next one's cascade is made."""
    spark, slices = df.sparkSession, len(cascades)
    pairs = df.withColumn("__h1", F.transform(keys, lambda x: F.xxhash64(x))).withColumn("__h2", F.transform(keys, lambda x: F.xxhash64(x, F.lit("second")))).withColumn(out, F.lit(0))
    schema = pairs.schema
    for k, cascade in enumerate(cascades):
        sent = spark.sparkContext.broadcast(cascade())  # at most MOST_BYTES

        def run(batches, sent=sent, k=k):
            for batch in batches:
                h1, h2 = (np.asarray(batch.column(c).flatten().to_numpy(zero_copy_only=False)) for c in ("__h1", "__h2"))
                sizes = np.array([len(x) if x is not None else 0 for x in batch.column("__h1").to_pylist()], dtype=np.int64)
                at = np.flatnonzero(sent.value.has(h1, h2) & (h1 % slices == k)) if len(h1) else np.zeros(0, dtype=np.int64)
                row = np.repeat(np.arange(len(sizes)), sizes)[at]
                best = np.asarray(batch.column(out).to_numpy(zero_copy_only=False)).astype(np.int64)
                best[best == 0] = 1 << 30
                np.minimum.at(best, row, at - (np.cumsum(sizes) - sizes)[row] + 1)
                best[best == 1 << 30] = 0
                yield pa.RecordBatch.from_arrays([pa.array(best.astype(np.int32)) if c == out else batch.column(c) for c in batch.schema.names], names=batch.schema.names)

        pairs = pairs.mapInArrow(run, schema)
        if slices > 1:
            pairs = common.written(pairs, "answers")
            sent.unpersist()
    return pairs.drop("__h1", "__h2")


def judged(pages: DataFrame, rules: DataFrame, listed_hosts: DataFrame) -> DataFrame:
    """(page_id, host, path, rule, verdict). rules: (host, path, action allow or block); listed_hosts: (host), blocked with their subdomains where no rule fits."""
    # as many numbers as rules have lengths of paths: at most the longest one's
    lengths = sorted((r.n for r in rules.where("path IS NOT NULL").select(F.length("path").alias("n")).distinct().collect()), reverse=True)
    host, path = host_and_path(F.col("url"))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    # as many numbers as listed hosts and rules have numbers of labels
    labels = lambda c: F.size(F.split(c, r"\."))
    counts = rules.select("host").union(listed_hosts.select("host")).where("host IS NOT NULL").select(labels("host").alias("n")).distinct()
    counts = sorted((r.n for r in counts.collect()), reverse=True)
    fitting = F.filter(F.split(F.lit(",".join(map(str, counts))), ",").cast("array<int>"), lambda n: n <= F.size("__parts")) if counts else F.expr("cast(array() as array<int>)")
    own = own.withColumn("__parts", F.split("host", r"\."))
    own = own.withColumn("hosts", F.transform(fitting, lambda n: F.array_join(F.slice("__parts", F.size("__parts") - n + 1, n), "."))).drop("__parts")
    prefixes = F.transform(F.filter(F.split(F.lit(",".join(map(str, lengths))), ",").cast("array<int>"), lambda n: n <= F.length("path")), lambda n: F.substring("path", 1, n)) if lengths else F.expr("cast(array() as array<string>)")
    keyed = own.withColumn("prefixes", prefixes)
    every = F.flatten(F.transform("hosts", lambda h: F.transform("prefixes", lambda p: F.struct((-F.length(F.concat(h, p))).alias("n"), (-F.length(h)).alias("m"), F.concat(h, p).alias("key")))))
    keyed = keyed.withColumn("keys", F.transform(F.array_sort(every), lambda x: x["key"])).drop("prefixes")
    universe = keyed.select(F.explode(F.array_union("keys", "hosts")).alias("key")).distinct()
    all_rules = rules.select(F.concat("host", "path").alias("key"), "action")
    blocked = all_rules.where("action = 'block'").select("key").unionByName(listed_hosts.select(F.col("host").alias("key")))
    universe = common.written(universe, "keys")
    is_rule, is_blocked = build(all_rules.select("key"), universe), build(blocked, universe)
    found = first_member(keyed, "keys", is_rule, "rule_at")
    found = found.withColumn("rule", F.when(F.col("rule_at") > 0, F.element_at("keys", F.greatest("rule_at", F.lit(1)))))
    found = first_member(found.withColumn("asked", F.when(F.col("rule").isNull(), F.col("hosts")).otherwise(F.array("rule"))), "asked", is_blocked, "blocked_at")
    return found.select("page_id", "host", "path", "rule", F.when(F.col("blocked_at") > 0, "block").otherwise("allow").alias("verdict"))


def stand_in_list(pages: DataFrame) -> DataFrame:
    """A host list taken from the corpus itself, in place of a published one: a sixteenth of the hosts, by their MD5."""
    host, _ = host_and_path(F.col("url"))
    return pages.select("url").select(host.alias("host")).where("host != ''").distinct().where(F.md5("host").startswith("0"))


ORACLE = """
WITH u AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(rh, rp, action) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
h AS (SELECT DISTINCT host FROM p),
listed AS (SELECT host FROM h WHERE host <> '' AND md5(host) LIKE '0%'),
b AS (SELECT DISTINCT h.host FROM h JOIN listed l ON h.host = l.host OR h.host LIKE '%.' || l.host),
f AS (SELECT p.page_id, p.host, p.path, arg_max(r.rh || r.rp, length(r.rh || r.rp)) AS rule, arg_max(r.action, length(r.rh || r.rp)) AS action
      FROM p LEFT JOIN r ON (p.host = r.rh OR p.host LIKE '%.' || r.rh) AND starts_with(p.path, r.rp) GROUP BY ALL)
SELECT f.page_id, f.host, f.path, f.rule, CASE WHEN f.rule IS NOT NULL THEN f.action WHEN b.host IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM f LEFT JOIN b USING (host)
"""
