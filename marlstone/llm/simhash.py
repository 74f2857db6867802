"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked through a vantage-point tree.

Only distinct fingerprints enter the tree. Its top levels are cut from a bounded sample and deal the fingerprints out
into shards, in further rounds where there are more shards than one tree should have: at a node, those within the median distance of the vantage point go to the inner side, the others to the
outer one. By the triangle inequality a pair within ``radius`` on two sides has its inner member in the last ``radius``
distances before the boundary; those members go to the outer side as well, so each pair meets in a shard. Within a shard
the same rule prunes branches down to small leaves that are compared in full. A shard returns a spanning forest, not its
pairs, and connected components join the forests.

Defined cases: null or blank text has fingerprint zero, which is linked like any other; texts with fewer words than a
shingle count as one shingle; a very long text's shingle hashes are held in memory once; repeated rows get a row each; a
null ``doc_id`` is never a component's name (null where the whole component has none); an empty table gives no row; other
columns are not read. ``deduplicated`` judges rows by their own text, whatever their ``doc_id``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

SHINGLE, SEED, RADIUS = 3, 42, 2
#: Fingerprints meant for one shard, levels that one tree has (a deeper tree comes in rounds), sampled fingerprints per shard for placing the vantage points.
SHARD, TREE_LEVELS, SAMPLED = 8192, 14, 16
#: Fingerprints compared in full, bytes of text hashed at a time.
LEAF, TEXT_BYTES = 512, 4_000_000
LANES = np.uint64(0x0101010101010101)


def fingerprints(texts: list[bytes], shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """A bit is 1 if set in over half the hashes of a text's shingles, repeats included."""
    import xxhash

    digest, join, hashes, counts = xxhash.xxh64_intdigest, b" ".join, [], np.zeros(len(texts), dtype=np.int64)
    for k, text in enumerate(texts):
        words = text.lower().split()
        own = map(join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [join(words)] if words else []
        at = len(hashes)
        hashes += [digest(x, seed) for x in own]
        counts[k] = len(hashes) - at
    out = np.zeros(len(texts), dtype=np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    values, n = np.array(hashes, dtype=np.uint64), counts[full]
    # sums of up to 255 hashes fit into bytes, eight bit positions at a time
    blocks = -(-n // 255)
    first = np.cumsum(blocks) - blocks
    starts = np.repeat(np.cumsum(n) - n, blocks) + 255 * (np.arange(blocks.sum()) - np.repeat(first, blocks))
    result = np.zeros(len(full), dtype=np.uint64)
    for bit in range(8):
        sums = np.add.reduceat(values >> np.uint64(bit) & LANES, starts).view(np.uint8).reshape(-1, 8).astype(np.int64)
        ones = np.add.reduceat(sums, first, axis=0)
        for byte in range(8):
            result |= (2 * ones[:, byte] > n).astype(np.uint64) << np.uint64(8 * byte + bit)
    out[full] = result
    return out


def with_fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """Rows (doc_id, digest of the text, fp); fp is the fingerprint as a signed long."""

    def made(batches):
        for batch in common.slices(batches, "text", TEXT_BYTES):
            own = fingerprints(common.as_bytes(batch.column("text")), shingle, seed).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), pa.array(own)], names=["doc_id", "digest", "fp"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text")).withColumn("digest", F.xxhash64("text"))
    return own.mapInArrow(made, "doc_id long, digest long, fp long")


def _vantage(points: np.ndarray) -> tuple[np.uint64, int, np.ndarray]:
    """The candidate whose distances spread most, their median, the distances."""
    tried = [(points[k], np.bitwise_count(points ^ points[k]).astype(np.int64)) for k in sorted({0, len(points) // 3, len(points) // 2, len(points) - 1})]
    point, distances = max(tried, key=lambda x: x[1].std())
    return point, int(np.median(distances)), distances


def _sides(distances: np.ndarray, median: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    return distances <= median, distances > median - radius


def build_tree(sample: np.ndarray, levels: int, radius: int):
    """Nested (vantage, median, inner, outer); None is a shard."""
    if not levels or len(sample) < 4:
        return None
    point, median, distances = _vantage(sample)
    inner = distances <= median
    if inner.all() or not inner.any():
        return None
    return point, median, build_tree(sample[inner], levels - 1, radius), build_tree(sample[~inner], levels - 1, radius)


def deal(points: np.ndarray, tree, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``points`` and their shards; a position comes once for each shard that it may have a partner in."""
    out_at, out_shard, todo = [], [], [(tree, np.arange(len(points)), 1)]
    while todo:
        node, at, name = todo.pop()
        if node is None:
            out_at.append(at)
            out_shard.append(np.full(len(at), name, dtype=np.int64))
        elif len(at):
            inner, outer = _sides(np.bitwise_count(points[at] ^ node[0]).astype(np.int64), node[1], radius)
            todo += [(node[2], at[inner], 2 * name), (node[3], at[outer], 2 * name + 1)]
    return np.concatenate(out_at or [np.zeros(0, dtype=np.int64)]), np.concatenate(out_shard or [np.zeros(0, dtype=np.int64)])


def close_pairs(points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs of distinct points within ``radius``; a pair may come more than once."""
    left, right, todo = [], [], [np.arange(len(points))]
    while todo:
        at = todo.pop()
        own = points[at]
        if len(at) > LEAF:
            _, median, distances = _vantage(own)
            inner, outer = _sides(distances, median, radius)
            if not inner.all() and not outer.all():
                todo += [at[inner], at[outer]]
                continue
        for k in range(0, len(at), LEAF):
            i, j = np.nonzero(np.bitwise_count(own[k : k + LEAF, None] ^ own[None, k:]) <= radius)
            keep = j > i
            left.append(at[k + i[keep]])
            right.append(at[k + j[keep]])
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, dtype=np.int64),) * 2


def _forest(points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, root) for each point of a component but its root."""
    i, j = close_pairs(points, radius)
    root = np.arange(len(points))
    while True:
        least = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        np.minimum.at(new, root[i], least)
        np.minimum.at(new, root[j], least)
        new = new[new]
        if (new == root).all():
            break
        root = new
    at = np.flatnonzero(root != np.arange(len(points)))
    return at, root[at]


def _deeper(dealt: DataFrame, n: int, done: int, more: int, radius: int) -> DataFrame:
    """(shard, fp) after ``done`` levels -> the same after ``more`` others: each shard gets a tree of its own, from a bounded sample of it."""
    dealt = common.written(dealt, "dealt")
    share = min(1.0, (SAMPLED << more) * float(1 << done) / n)
    sample = dealt.where(F.shiftrightunsigned(F.xxhash64("fp"), 11) / F.lit(2.0**53) < share)

    def parted(points: pa.Table, sampled: pa.Table) -> pa.Table:
        own, few = (np.unique(np.asarray(t.column("fp").to_numpy(), dtype=np.int64)).view(np.uint64) for t in (points, sampled))
        at, names = deal(own, build_tree(few, more, radius), radius)
        shard = points.column("shard")[0].as_py() if points.num_rows else 0
        return pa.table({"shard": names + (shard << more + 1), "fp": own[at].view(np.int64)})

    parts = max(1 << min(done, TREE_LEVELS), int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    both = (x.repartition(parts, "shard").groupBy("shard") for x in (dealt, sample))
    return next(both).cogroup(next(both)).applyInArrow(parted, "shard long, fp long")


def links(distinct: DataFrame, radius: int = RADIUS, shard: int = SHARD, tree_levels: int = TREE_LEVELS) -> DataFrame:
    """Distinct fingerprints ``fp`` -> links (a, b) that connect the same fingerprints as all pairs within ``radius``."""
    spark = distinct.sparkSession
    n = distinct.count()
    levels = max(0, int(np.ceil(np.log2(max(1, n / shard)))))
    done = min(levels, tree_levels)
    sample = [r.fp for r in distinct.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLED << done).collect()] if levels else []
    tree = build_tree(np.array(sample, dtype=np.int64).view(np.uint64), done, radius)

    def top(batches):
        for batch in batches:
            points = np.asarray(batch.column("fp").to_numpy(zero_copy_only=False), dtype=np.int64)
            at, shards = deal(points.view(np.uint64), tree, radius)
            yield pa.RecordBatch.from_arrays([pa.array(shards), pa.array(points[at])], names=["shard", "fp"])

    def linked(table: pa.Table) -> pa.Table:
        points = np.unique(np.asarray(table.column("fp").to_numpy(), dtype=np.int64))
        at, root = _forest(points.view(np.uint64), radius)
        return pa.table({"a": points[at], "b": points[root]})

    dealt = distinct.select("fp").mapInArrow(top, "shard long, fp long")
    while done < levels:
        more = min(tree_levels, levels - done)
        dealt, done = _deeper(dealt, n, done, more, radius), done + more
    parts = max(1 << min(levels, TREE_LEVELS), int(spark.conf.get("spark.sql.shuffle.partitions"))) if levels else 1
    return dealt.repartition(parts, "shard").groupBy("shard").applyInArrow(linked, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """A row per document: doc_id, digest (of its text), fp, component_id (the smallest doc_id that links reach), first_digest (of that document's text)."""
    marked = common.written(with_fingerprints(docs, shingle, seed), "fingerprints")
    rep = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    distinct = common.written(marked.groupBy("fp").agg(F.min(rep).alias("first")), "distinct")
    roots = components(links(distinct, radius))
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    # the smallest member of a component comes over its root; both joins are on distinct fingerprints
    least = named.groupBy("root").agg(F.min("first").alias("least"))
    found = named.join(least, "root").select("fp", F.col("least.doc_id").alias("component_id"), F.col("least.digest").alias("first_digest"))
    return marked.join(found, "fp").select("doc_id", "digest", "fp", "component_id", "first_digest")


def deduplicated(docs: DataFrame, **settings) -> DataFrame:
    """The first text of each component, with all its columns."""
    return common.without_rows(docs, near_duplicates(docs, **settings).where("NOT (doc_id <=> component_id AND digest = first_digest)").select("doc_id", "digest"))
