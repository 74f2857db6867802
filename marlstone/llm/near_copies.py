"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of at least 4/5, and all that such pairs link.

Texts are compared where they share a band: ``ROWS`` MinHash values of their shingle sets. A pair of similarity 4/5 shares one
of ``BANDS`` bands but for a chance of 7 in 100,000, a pair of 9/10 but for 1 in 10^9, and texts that merely share a passage
almost never do, so candidates don't grow with the square of those. Every candidate counts by its exact similarity. Equal
sets are one text from the start. Where up to ``SMALL`` texts share a band all their pairs are candidates; where more do, each
is first compared with the one of them that shares most such bands. Those that the links so far haven't joined meet in tiles
over many tasks, which compare sketches of the sets (the least hash of each of ``BINS`` ranges of hashes) and name the pairs whose
sketches agree in ``AGREED`` of the ranges that either set is in: a pair of similarity 4/5 agrees in fewer with a chance of
3 in 10^8. A pair is judged in the first band that both are in. So texts that are close to many but similar to none make no candidates. Pairs whose sizes differ too much are left out.

This is the near-duplicate stage of the pipeline. Its first candidates are those of ``simhash``: fingerprints of all texts linked
through the vantage-point tree, each set with the first of its component, judged by their exact similarity like all others. But a similarity of
4/5 is about ten differing bits of 64, a radius at which a vantage-point tree prunes nothing and which far less similar texts are
within, so what fingerprints within its radius can't link comes from the bands.

Defined cases: null or blank texts have no shingle and are copies of each other; a text with fewer words than a shingle
is one shingle; a very long text's shingles are held in memory once per text. Rows are judged by their own text, whatever
their ``doc_id``: a null one comes after all others, so it names a component (null) only where all of it are null; of equal
``doc_id`` with other texts in one component the one with the smaller hash of its text stays; rows equal in both go or stay
together. Other columns, of any name, stay as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, simhash
from .components import components

SHINGLE, SEED, BANDS, ROWS = 5, 42, 24, 5
#: Most texts of a band that are all compared at once; texts on a side of a tile.
SMALL, TILE = 2, 1024
#: Ranges of a sketch, a power of two; the share of them in which two sketches must agree.
BINS, AGREED = 512, 0.7
#: Multipliers and offsets of the MinHash functions, by a fixed rule.
_MIX = np.random.default_rng(SEED).integers(1, 2**63, (2, BANDS * ROWS, 1), dtype=np.uint64)
#: Bytes of text hashed at a time.
TEXT_BYTES = 4_000_000


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    import xxhash

    digest, join, words = xxhash.xxh64_intdigest, b" ".join, text.lower().split()
    own = map(join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [join(words)] if words else []
    return np.unique(np.array([digest(x, SEED) for x in own], dtype=np.uint64))


def key_of(hashes: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes())).astype(np.int64))


def bands(hashes: np.ndarray) -> np.ndarray:
    """A hash of each band of a set's MinHash values and the band's number; an empty set has one band of its own."""
    import xxhash

    if not len(hashes):
        return np.zeros(1, dtype=np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(hashes), 1024):
        mixed = hashes[k : k + 1024] * (_MIX[0] | np.uint64(1)) + _MIX[1]
        mixed ^= mixed >> np.uint64(31)
        least = np.minimum(least, (mixed * np.uint64(0x9E3779B97F4A7C15)).min(1))
    return np.array([xxhash.xxh3_64_intdigest(own.tobytes(), k + 1) for k, own in enumerate(least.reshape(BANDS, ROWS))], dtype=np.uint64).view(np.int64)


def sketch(hashes: np.ndarray) -> bytes:
    """For each of ``BINS`` equal ranges of hashes a byte (1 to 255) of the set's least one in it, 0 where it has none. hashes: sorted."""
    least, values = np.zeros(BINS, dtype=np.uint8), np.asarray(hashes, dtype=np.uint64)
    if len(values):
        bins = (values >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]])
        least[bins[first]] = values[first] % np.uint64(255) + np.uint64(1)
    return least.tobytes()


def agreeing(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Whether a sketch agrees with each of others in enough of the ranges that either has hashes in."""
    either = np.count_nonzero(one | others, axis=1)
    return np.count_nonzero((one == others) & (one != 0), axis=1) >= AGREED * either


def possible(n1, n2):
    """Whether sets of these sizes can be similar enough."""
    return 5 * np.minimum(n1, n2) >= 4 * np.maximum(n1, n2)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    return 9 * len(np.intersect1d(a, b, assume_unique=True)) >= 4 * (len(a) + len(b))


def _marked(texts: DataFrame) -> DataFrame:
    """(doc_id, digest of the text, key of the shingle set, n, bands, sketch, fp: SimHash fingerprint) of every text."""

    def made(batches):
        for batch in common.slices(batches, "text", TEXT_BYTES):
            texts = common.as_bytes(batch.column("text"))
            sets = [shingles(x) for x in texts]
            columns = [pa.array([key_of(x) for x in sets], type=pa.int64()), pa.array([len(x) for x in sets], type=pa.int64()), pa.array([bands(x).tobytes() for x in sets], type=pa.binary())]
            columns += [pa.array([sketch(x) for x in sets], type=pa.binary()), pa.array(simhash.fingerprints(texts).view(np.int64))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), *columns], names=["doc_id", "digest", "key", "n", "bands", "sketch", "fp"])

    return common.written(texts.mapInArrow(made, "doc_id long, digest long, key long, n long, bands binary, sketch binary, fp long"), "marked")


def _close_fingerprints(distinct: DataFrame) -> DataFrame:
    """Candidate pairs (a, b): each set with the first of those that the vantage-point tree of ``simhash`` links with it, if sizes allow."""
    roots = components(simhash.links(distinct.select("fp").distinct()))
    named = common.written(distinct.select("key", "n", "fp").join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("key", "n", F.coalesce("root", "fp").alias("fp")), "close")
    first = named.groupBy("fp").agg(F.min(F.struct("key", "n")).alias("c"))
    near = (F.col("key") != F.col("c.key")) & (5 * F.least("n", "c.n") >= 4 * F.greatest("n", "c.n"))
    return named.join(first, "fp").where(near).select(F.least("key", "c.key").alias("a"), F.greatest("key", "c.key").alias("b"))


def _whole(batches, names) -> list[np.ndarray] | None:
    parts = [[np.asarray(b.column(c).to_numpy(zero_copy_only=False)) for c in names] for b in batches if b.num_rows]
    return [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else None


def _meetings(distinct: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) of small bands, and rows with null b: texts a that share a band with many others (band, n, held)."""
    spark, names = distinct.sparkSession, ["a", "b", "band", "n", "held"]

    def dealt(batches):
        for batch in batches:
            own = [np.frombuffer(x, dtype=np.int64) for x in batch.column("bands").to_pylist()]
            rows = pa.array(np.repeat(np.arange(len(own)), [len(x) for x in own]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*own, np.zeros(0, dtype=np.int64)])), batch.column("key").take(rows), batch.column("n").take(rows)], names=["band", "key", "n"])

    def met(batches):
        whole = _whole(batches, ["band", "key", "n"])
        if whole is None:
            return
        order = np.lexsort((whole[1], whole[0]))
        band, key, n = (x[order] for x in whole)
        starts = np.flatnonzero(np.r_[True, band[1:] != band[:-1]])
        sizes = np.diff(np.r_[starts, len(band)])
        left, right = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for size in range(2, SMALL + 1):
            i, j = np.triu_indices(size, 1)
            left.append((starts[sizes == size][:, None] + i).ravel())
            right.append((starts[sizes == size][:, None] + j).ravel())
        i, j = np.concatenate(left), np.concatenate(right)
        keep = (key[i] != key[j]) & possible(n[i], n[j])
        pairs = np.unique(np.stack([key[i[keep]], key[j[keep]]]), axis=1)  # a band's keys are sorted
        none = [pa.nulls(pairs.shape[1], pa.int64())] * 3
        yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1]), *none], names=names)
        rows, held = np.flatnonzero(np.repeat(sizes > SMALL, sizes)), np.repeat(sizes[sizes > SMALL], sizes[sizes > SMALL])
        yield pa.RecordBatch.from_arrays([pa.array(key[rows]), pa.nulls(len(rows), pa.int64()), pa.array(band[rows]), pa.array(n[rows]), pa.array(held)], names=names)

    # about half a million rows to a task, whatever the input
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), distinct.count() * BANDS // 500_000 + 1)
    return common.written(distinct.mapInArrow(dealt, "band long, key long, n long").repartition(parts, "band").mapInArrow(met, "a long, b long, band long, n long, held long"), "meetings")


def _with_centres(large: DataFrame) -> DataFrame:
    """Pairs (a, b) of each text of a large band with the one of them that is in most large bands: it is the likeliest to be similar to all."""
    counted = common.written(large.join(large.groupBy("a").agg(F.count("*").alias("bands")), "a"), "counted")
    centre = common.written(counted.groupBy("band").agg(F.max(F.struct("bands", "a", "n")).alias("c")), "centres")
    near = (F.col("a") != F.col("c.a")) & (5 * F.least("n", "c.n") >= 4 * F.greatest("n", "c.n"))
    return counted.join(centre, "band").where(near).select(F.least("a", "c.a").alias("a"), F.greatest("a", "c.a").alias("b"))


def _verified(pairs: DataFrame, distinct: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough; only texts in a pair are read for their words."""
    pairs = common.written(pairs.distinct(), "pairs")
    wanted = common.written(pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct().join(distinct.select("key", F.col("rep.digest").alias("digest")), "key"), "wanted")

    def cut(batches):
        for batch in common.slices(batches, "text", TEXT_BYTES):
            sets = [shingles(x) for x in common.as_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([pa.array([key_of(x) for x in sets], type=pa.int64()), pa.array([x.tobytes() for x in sets], type=pa.binary())], names=["key", "hashes"])

    def compared(batches):
        for batch in common.slices(batches, "x", TEXT_BYTES):
            keep = [similar(np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, type=pa.bool_()))

    read = texts.join(wanted.select("digest"), "digest", "left_semi").mapInArrow(cut, "key long, hashes binary")
    sets = common.written(read.join(wanted.select("key"), "key", "left_semi").groupBy("key").agg(F.first("hashes").alias("hashes")), "sets")
    # both joins are of written tables, so that adaptive execution can split a text that is in very many pairs
    half = common.written(pairs.join(sets.select(F.col("key").alias("a"), F.col("hashes").alias("x")), "a"), "half")
    both = half.join(sets.select(F.col("key").alias("b"), F.col("hashes").alias("y")), "b").select("a", "b", "x", "y")
    return common.written(both.mapInArrow(compared, "a long, b long"), "links")


def _unjoined(large: DataFrame, roots: DataFrame, distinct: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) of texts that share a band with many others and have different roots: those whose sketches agree."""
    own = large.join(roots.withColumnRenamed("node", "a"), "a", "left").withColumn("root", F.coalesce("root", "a"))
    own = common.written(own, "rooted")
    mixed = common.written(own.groupBy("band").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x != y").select("band"), "mixed")
    blocks = F.ceil(F.col("held") / TILE).cast("long")
    block = F.pmod(F.xxhash64("a"), blocks)
    meeting = common.written(own.join(mixed, "band", "left_semi"), "meeting")
    # a text's meeting bands, at most BANDS of them: a pair is judged in the first that both are in
    lists = meeting.groupBy("a").agg(F.array_sort(F.collect_list("band")).alias("shared"))
    met = common.written(meeting.join(lists.join(distinct.select(F.col("key").alias("a"), "sketch"), "a"), "a"), "sketched")
    tiled = met.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    tiled = tiled.select("band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "a", "root", "n", "shared", "sketch")
    names = ["band", "i", "j", "block", "a", "root", "n", "shared", "sketch"]

    def paired(batches):
        whole = _whole(batches, names)
        if whole is None:
            return
        order = np.lexsort(tuple(whole[k] for k in (2, 1, 0)))
        band, i, j, block, a, root, n = (x[order] for x in whole[:-2])
        earlier = np.full((len(a), BANDS), np.iinfo(np.int64).max)
        for row, own in zip(earlier, whole[-2][order], strict=True):
            row[: len(own)] = own
        sketches = np.frombuffer(b"".join(whole[-1].tolist()), dtype=np.uint8).reshape(-1, BINS)
        edges = np.r_[np.flatnonzero(np.r_[True, (band[1:] != band[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]), len(a)]
        for start, end in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            rows = np.arange(start, end)
            left, right = rows[block[rows] == i[start]], rows[block[rows] == j[start]]
            for k in left.tolist():
                near = right[right > k] if i[start] == j[start] else right
                near = near[(root[near] != root[k]) & possible(n[k], n[near])]
                before = earlier[k][earlier[k] < band[k]]
                near = near[~np.isin(earlier[near], before).any(axis=1)]
                near = near[agreeing(sketches[order[k]], sketches[order[near]])]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a[k], a[near])), pa.array(np.maximum(a[k], a[near]))], names=["a", "b"])

    # about 64 MB of sketches to a task, whatever the input
    rows = met.agg(F.sum(blocks)).first()[0] or 0
    parts = max(int(large.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows * BINS // 64_000_000 + 1)
    return tiled.repartition(parts, "band", "i", "j").mapInArrow(paired, "a long, b long")


def near_copies(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, component_id (the smallest doc_id that links reach), and the ``digest`` of its text with that of the component's first text, ``first_digest``."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text")).withColumn("digest", F.xxhash64("text"))
    marked = _marked(texts)
    rep = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    distinct = common.written(marked.groupBy("key").agg(F.min(rep).alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.min("fp").alias("fp")), "distinct")
    met = _meetings(distinct)
    large = met.where("b IS NULL").select("a", "band", "n", "held")
    pairs, many = met.where("b IS NOT NULL").select("a", "b").unionByName(_close_fingerprints(distinct)), not large.isEmpty()
    links = _verified(pairs.unionByName(_with_centres(large)) if many else pairs, distinct, texts)
    roots = components(links)
    if many:
        roots = components(links.unionByName(_verified(_unjoined(large, roots, distinct), distinct, texts)))
    named = distinct.select("key", "rep").join(roots.withColumnRenamed("node", "key"), "key", "left").select("key", "rep", F.coalesce("root", "key").alias("root"))
    least = named.groupBy("root").agg(F.min("rep").alias("rep")).select("root", F.col("rep.doc_id").alias("component_id"), F.col("rep.digest").alias("first_digest"))
    return marked.select("doc_id", "digest", "key").join(named.drop("rep").join(least, "root").drop("root"), "key").drop("key")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The first text of each component, with all its columns."""
    return common.without_rows(docs, near_copies(docs).where("NOT (doc_id <=> component_id AND digest = first_digest)").select("doc_id", "digest"))
