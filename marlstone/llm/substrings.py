"""Substring dedup through a log-structured index of window fingerprints.

Documents come in batches of rising ``doc_id``; by a hash of it each belongs to a chunk. A batch's windows are hashed and
dealt out by the hash's top bits into buckets. Bucket by bucket their keys (the next 32 bits) are merge-joined with the
sorted immutable runs of all earlier batches and with each other; the batch's own keys, each with its chunk, then become a
new run, and ``compact`` merges a bucket's runs when there are more than ``FAN_IN``. Runs are files; a manifest names them.

Equal keys are candidates only. They are verified by the words: each chunk that came with such a key is asked for digests of
the words of its windows with that key, and a window is a repeat if a smaller document has the same key and digest. So a
collision of keys never removes a word, and none hides a repeat: a run keeps every chunk that came with a key. What is found
is the place of a window in its document; a last pass over the texts removes the words there.

Equal windows of one slice of documents are verified there and go to the bucket once; the slice reports the places in its
other documents by itself, and so does a chunk. So a passage in a third of all documents adds one entry per slice and one
digest per chunk. Both passes over the chunks' texts, for digests and for removal, use one exchange.

Defined cases: null text has no words; texts shorter than a window keep all words; a very long text is held with its words
and hashes once; a null ``doc_id`` takes no part in matching; rows of equal ``doc_id`` are one document for matching and
get a row each; empty tables give no row; other columns are not read.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blobs, common

WINDOW = 13
#: Bits of a key in its bucket, windows meant for a bucket, characters of a chunk and of a batch, bytes of text hashed at a time.
KEY_BITS, BUCKET_WINDOWS, CHUNK_CHARS, BATCH_CHARS, TEXT_BYTES = 32, 1 << 20, 8_000_000, 64_000_000_000, 8_000_000
#: Buckets and batches at least, runs of a bucket before they are merged, words whose hashes a worker remembers.
LEAST_BUCKETS, BATCHES, FAN_IN, REMEMBERED_WORDS = 128, 2, 8, 1_000_000
#: Partitions of one shuffle at most (each then has several buckets or chunks); batches from which on texts are written by batch.
MOST_PARTS, MANY_BATCHES = 50_000, 4
#: Multipliers of the window hash: golden ratio and a mixing constant.
STEP, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
MANIFEST = "bucket int, path string, n long"
#: Rows between the steps: many values of one kind, packed. An owner (a chunk, a document, or a text by its hash) and, with a
#: document, its text's hash, has ``counts`` keys, digests and places.
STEPS = "kind int, bucket int, chunk int, owners binary, texts binary, counts binary, keys binary, digests binary, places binary, path string, n long"
ENTRY, ASKED, PLACES, RUN, KNOWN = range(5)
KEY_MASK = np.uint64((1 << KEY_BITS) - 1)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


@lru_cache(maxsize=1)
def _hashes() -> _Hashes:
    return _Hashes()


def windows(texts: list[bytes], window: int = WINDOW) -> tuple[list[list[bytes]], np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text; for each window its hash, its text and its first word's place there."""
    known = _hashes()
    if len(known) > REMEMBERED_WORDS:
        known.clear()
    split = [text.split() for text in texts]
    counts = np.array([len(x) for x in split], dtype=np.int64)
    total = int(counts.sum())
    values = np.fromiter(map(known.__getitem__, chain.from_iterable(split)), dtype=np.uint64, count=total)
    n = max(0, total - window + 1)
    hashes = np.zeros(n, dtype=np.uint64)
    for k in range(window):
        hashes *= STEP
        hashes += values[k : n + k]
    hashes ^= hashes >> np.uint64(32)
    hashes *= MIX
    hashes ^= hashes >> np.uint64(29)
    doc = np.repeat(np.arange(len(texts)), counts)[:n]
    place = np.arange(n) - np.repeat(np.cumsum(counts) - counts, counts)[:n]
    inside = place <= counts[doc] - window
    return split, hashes[inside], doc[inside], place[inside]


def digests(split: list[list[bytes]], doc: np.ndarray, place: np.ndarray, window: int) -> np.ndarray:
    """Of the words of windows: a hash of their text, unlike that of the index."""
    import xxhash

    digest, join = xxhash.xxh3_64_intdigest, b" ".join
    return np.fromiter((digest(join(split[d][p : p + window])) for d, p in zip(doc.tolist(), place.tolist(), strict=True)), dtype=np.uint64, count=len(doc))


def _shift(buckets: int) -> int:
    """Bits of a hash below those of its mark, which are its bucket's and its key's."""
    if buckets & (buckets - 1) or buckets > 1 << 64 - KEY_BITS:
        raise ValueError(f"{buckets} buckets: a power of two up to {1 << 64 - KEY_BITS} is needed")
    return 64 - KEY_BITS - (buckets.bit_length() - 1)


def _marks(hashes: np.ndarray, buckets: int, key_bits: int) -> np.ndarray:
    """Bucket and key of hashes; ``key_bits`` below KEY_BITS leave more to the verification."""
    return hashes >> np.uint64(_shift(buckets)) & np.uint64((1 << 64) - (1 << KEY_BITS) + (1 << key_bits) - 1)


def _planes(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.dtype.itemsize).T).tobytes()


def _of_planes(data: bytes, kind: str) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


def write_run(folder: str, bucket: int, entries: np.ndarray) -> str:
    """entries: sorted, key and chunk. Keys are stored as differences, both as compressed planes of bytes."""
    import zstandard

    path, packer = blobs.attempt_name(folder, bucket, ".run"), zstandard.ZstdCompressor(level=1)
    keys, chunks = (entries >> np.uint64(KEY_BITS)).astype("<u4"), (entries & KEY_MASK).astype("<u4")
    parts = [packer.compress(_planes(x)) for x in (np.diff(keys, prepend=np.uint32(0)).astype("<u4"), chunks)]
    with blobs.create(path) as out:
        out.write(len(parts[0]).to_bytes(8, "little") + b"".join(parts))
    return path


def read_run(path: str) -> np.ndarray:
    import zstandard

    with blobs.read_at(path) as file:
        data, unpacker = file.read(), zstandard.ZstdDecompressor()
    end = 8 + int.from_bytes(data[:8], "little")
    keys, chunks = (_of_planes(unpacker.decompress(x), "<u4") for x in (data[8:end], data[end:]))
    return np.cumsum(keys, dtype=np.uint32).astype(np.uint64) << np.uint64(KEY_BITS) | chunks.astype(np.uint64)


def is_in(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Merge join: which of the ``values`` stand in the sorted array."""
    at = np.searchsorted(ordered, values)
    at[at == len(ordered)] = 0
    return ordered[at] == values if len(ordered) else np.zeros(len(values), dtype=bool)


def _fresh(*columns: np.ndarray) -> np.ndarray:
    """Where rows of sorted columns differ from the row before."""
    out = np.ones(len(columns[0]), dtype=bool)
    out[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in columns])
    return out


def _first(values: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """For each row the value of its group's first row."""
    return values[np.flatnonzero(fresh)][np.cumsum(fresh) - 1] if len(values) else values


def _runs_of(parts: np.ndarray, n: int) -> list[slice]:
    """Slices of the sorted ``parts`` for 0 .. n-1."""
    bounds = np.searchsorted(parts, np.arange(n + 1))
    return [slice(bounds[k], bounds[k + 1]) for k in range(n)]


def _chunk_of(doc_ids: np.ndarray, chunks: int) -> np.ndarray:
    """A document's chunk, by the same rule as ``_chunk``: folded bits of the id, by a prime number of chunks."""
    x = doc_ids.astype(np.int64).view(np.uint64)
    x = x ^ x >> np.uint64(17) ^ x >> np.uint64(31)
    return ((x & np.uint64((1 << 63) - 1)) % np.uint64(chunks)).astype(np.int32)


def _text_keys(texts: list[bytes], doc_ids: list) -> np.ndarray:
    """A hash of each text and its ``doc_id``, so that rows of one id and other texts keep their own places."""
    import xxhash

    return np.array([xxhash.xxh64_intdigest(x, (i or 0) % 2**64) for x, i in zip(texts, doc_ids, strict=True)], dtype=np.uint64).view(np.int64)


class _Out:
    """Step rows on their way out."""

    names = [x.split()[0] for x in STEPS.split(", ")]
    kinds = [pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 6, pa.string(), pa.int64()]

    def __init__(self):
        self.rows = []

    def spread(self, kind: int, over: np.ndarray, to: str, fixed: int | None, owners: np.ndarray, texts=None, keys=None, digests=None, places=None) -> None:
        """A row for each value of ``over``, which are the rows' buckets or chunks (``to``); ``fixed`` is the other one of the two."""
        if not len(over):
            return
        columns = {"owners": (owners, "<i8"), "texts": (texts, "<i8"), "keys": (keys, "<u4"), "digests": (digests, "<u8"), "places": (places, "<u4")}
        order = np.lexsort((owners, over) if texts is None else (texts, owners, over))
        over, columns = over[order], {c: (None if x is None else x[order], t) for c, (x, t) in columns.items()}
        names = [c for c in ("owners", "texts") if columns[c][0] is not None]
        edges = np.append(np.flatnonzero(_fresh(over)), len(over)).tolist()
        fresh = _fresh(over, *(columns[c][0] for c in names))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            own = a + np.flatnonzero(fresh[a:b])
            row = dict.fromkeys(self.names) | {"kind": kind, "bucket": fixed, "chunk": fixed, to: int(over[a]), "counts": np.diff(np.append(own, b)).astype("<u4").tobytes(), "n": b - a}
            for c, (x, t) in columns.items():
                if x is not None:
                    row[c] = (x[own] if c in names else x[a:b]).astype(t).tobytes()
            self.rows.append(row)

    def batch(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], type=k) for c, k in zip(self.names, self.kinds, strict=True)], names=self.names)

    def table(self) -> pa.Table:
        return pa.Table.from_batches([self.batch()])


def _values(table: pa.Table, kind: int, *names: str) -> list[np.ndarray]:
    """Values of the step rows of a kind; keys come as marks where the rows have a bucket."""
    own = table.filter(pa.array(np.asarray(table.column("kind").to_numpy()) == kind))
    kinds = {"owners": "<i8", "texts": "<i8", "keys": "<u4", "digests": "<u8", "places": "<u4"}
    counts = [np.frombuffer(x, "<u4") for x in own.column("counts").to_pylist()]
    out = []
    for name in names:
        parts = [np.frombuffer(x, kinds[name]) for x in own.column(name).to_pylist()]
        if name in ("owners", "texts"):
            parts = [np.repeat(x, n) for x, n in zip(parts, counts, strict=True)]
        elif name == "keys":
            parts = [x.astype(np.uint64) | np.uint64(b << KEY_BITS) for x, b in zip(parts, own.column("bucket").to_pylist(), strict=True)]
        out.append(np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64 if name == "keys" else kinds[name]))
    return out


def _bucket(marks: np.ndarray) -> np.ndarray:
    return (marks >> np.uint64(KEY_BITS)).astype(np.int64)


def _hashed(docs: DataFrame, buckets: int, chunks: int, window: int, key_bits: int) -> DataFrame:
    """Step rows of a batch: entries for the buckets, and the places of repeats that a slice of documents has within itself."""

    def hashed(batches):
        for batch in common.slices(batches, "text", TEXT_BYTES):
            ids, texts, out = np.asarray(batch.column("doc_id").to_numpy(zero_copy_only=False), dtype=np.int64), common.as_bytes(batch.column("text")), _Out()
            split, full, doc, place = windows(texts, window)
            marks, chunk = _marks(full, buckets, key_bits), _chunk_of(ids, chunks)
            order = np.argsort(marks)
            starts = np.flatnonzero(_fresh(marks[order]))
            sizes = np.diff(np.append(starts, len(order)))
            alone, rows = order[starts[sizes == 1]], order[np.repeat(sizes > 1, sizes)]
            digest = digests(split, doc[rows], place[rows], window)
            by = np.lexsort((ids[doc[rows]], digest, marks[rows]))
            rows, digest = rows[by], digest[by]
            owner, first = ids[doc[rows]], _fresh(marks[rows], digest)
            later = owner > _first(owner, first)
            at = rows[later]
            out.spread(PLACES, chunk[doc[at]], "chunk", None, _text_keys(texts, ids.tolist())[doc[at]], places=place[at])
            entries = np.concatenate([alone, rows[first]])
            out.spread(ENTRY, _bucket(marks[entries]), "bucket", None, chunk[doc[entries]], keys=marks[entries])
            yield out.batch()

    return docs.mapInArrow(hashed, STEPS)


def _parts(spark, buckets: int) -> int:
    """Partitions of an exchange by bucket: one for every few buckets."""
    return min(buckets, max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(buckets // 4, MOST_PARTS)))


def _by_bucket(steps: DataFrame, parts: int, run) -> DataFrame:
    """``run`` on the rows of each bucket; rows without one go past it, spread by their chunk."""
    to = F.struct(F.coalesce("bucket", F.lit(-1)).alias("bucket"), F.when(F.col("bucket").isNull(), F.col("chunk")).alias("chunk"))

    def each(table: pa.Table) -> pa.Table:
        table = table.drop_columns(["to"])
        return table if table.column("bucket")[0].as_py() is None else run(table)

    return steps.withColumn("to", to).repartition(parts, "to").groupBy("to").applyInArrow(each, STEPS)


def ingest(docs: DataFrame, runs: DataFrame | None, buckets: int, chunks: int, folder: str, window: int = WINDOW, key_bits: int = KEY_BITS) -> tuple[DataFrame, DataFrame]:
    """Merges a batch (doc_id, text; every ``doc_id`` above all in ``runs``) into the index.

    Returns step rows by chunk (places of the slices' own repeats, and the keys to verify) and the manifest with the batch's runs."""
    steps = _hashed(docs, buckets, chunks, window, key_bits)
    if runs is not None:
        empty = [F.lit(None).cast("binary").alias(c) for c in ("owners", "texts", "counts", "keys", "digests", "places")]
        steps = steps.unionByName(runs.select(F.lit(KNOWN).alias("kind"), "bucket", F.lit(None).cast("int").alias("chunk"), *empty, "path", "n"))

    def merged(table: pa.Table) -> pa.Table:
        out, bucket = _Out(), table.column("bucket")[0].as_py()
        chunk, marks = _values(table, ENTRY, "owners", "keys")
        new = np.sort((marks & KEY_MASK) << np.uint64(KEY_BITS) | chunk.astype(np.uint64))
        keys, every = np.unique(new >> np.uint64(KEY_BITS)), [new]
        for path in table.filter(pa.array(np.asarray(table.column("kind").to_numpy()) == KNOWN)).column("path").to_pylist():
            old = read_run(path)
            every.append(old[is_in(old >> np.uint64(KEY_BITS), keys)])
        every = np.sort(np.concatenate(every))
        if len(new):
            # a key that came once needs no digest
            key = every >> np.uint64(KEY_BITS)
            starts = np.flatnonzero(_fresh(key))
            sizes = np.diff(np.append(starts, len(key)))
            asked = every[np.repeat(sizes > 1, sizes) & _fresh(every)]
            owner = (asked & KEY_MASK).astype(np.int64)
            out.spread(ASKED, owner, "chunk", bucket, owner, keys=asked >> np.uint64(KEY_BITS))
            new = new[_fresh(new)]
            out.rows.append(dict.fromkeys(out.names) | {"kind": RUN, "bucket": bucket, "path": write_run(folder, bucket, new), "n": len(new)})
        return out.table()

    done = common.written(_by_bucket(steps, _parts(docs.sparkSession, buckets), merged), "steps")
    added = done.where(F.col("kind") == RUN).select("bucket", "path", "n")
    return done.where(F.col("kind").isin(ASKED, PLACES)), added if runs is None else runs.unionByName(added)


def compact(runs: DataFrame, folder: str, fan_in: int = FAN_IN) -> DataFrame:
    """The manifest with one run for every bucket that had more than ``fan_in``; the merged runs' files are removed."""

    def merged(table: pa.Table) -> pa.Table:
        if table.num_rows <= fan_in:
            return table.select(["bucket", "path", "n"])
        bucket, parts = table.column("bucket")[0].as_py(), [read_run(path) for path in table.column("path").to_pylist()]
        entries = np.unique(np.concatenate(parts))
        return pa.table({"bucket": pa.array([bucket], pa.int32()), "path": [write_run(folder, bucket, entries)], "n": pa.array([len(entries)], pa.int64())})

    def removed(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                blobs.remove(path)
            yield batch

    # a repeated attempt would read files that are removed later only: the new manifest is a table before
    done = common.written(runs.groupBy("bucket").applyInArrow(merged, MANIFEST), "runs")
    runs.select("path").join(done.select("path"), "path", "left_anti").mapInArrow(removed, "path string").count()
    return done


def without_matches(docs: DataFrame, steps: DataFrame, buckets: int, chunks: int, window: int = WINDOW, key_bits: int = KEY_BITS) -> DataFrame:
    """Rows (doc_id, n_words, n_removed, kept): each document without the words under its verified repeats."""
    spark = docs.sparkSession

    def digested(table: pa.Table, right: pa.Table) -> pa.Table:
        """The digests of a chunk's windows that are asked for: those of the smallest document go to the window's bucket, the others' places are repeats."""
        out, found = _Out(), []
        asked = np.unique(_values(right, ASKED, "keys")[0])
        for batch in common.slices(table.to_batches() if len(asked) else [], "text", TEXT_BYTES):
            texts, doc_ids = common.as_bytes(batch.column("text")), batch.column("doc_id").to_pylist()
            split, full, doc, place = windows(texts, window)
            own, named = _marks(full, buckets, key_bits), np.array([i is not None for i in doc_ids])
            rows = np.flatnonzero(is_in(own, asked) & named[doc])
            ids, texts = np.array([i or 0 for i in doc_ids], dtype=np.int64), _text_keys(texts, doc_ids)
            found.append((ids[doc[rows]], texts[doc[rows]], own[rows], digests(split, doc[rows], place[rows], window), place[rows]))
        if found:
            owner, texts, own, digest, place = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((owner, digest, own))
            owner, texts, own, digest, place = (x[order] for x in (owner, texts, own, digest, place))
            later = owner > _first(owner, _fresh(own, digest))
            out.spread(PLACES, np.full(int(later.sum()), right.column("chunk")[0].as_py()), "chunk", None, texts[later], places=place[later])
            out.spread(ENTRY, _bucket(own[~later]), "bucket", None, owner[~later], texts[~later], own[~later], digest[~later], place[~later])
        return out.table()

    def verified(table: pa.Table) -> pa.Table:
        out, (owner, texts, own, digest, place) = _Out(), _values(table, ENTRY, "owners", "texts", "keys", "digests", "places")
        order = np.lexsort((owner, digest, own))
        own_sorted, digest = own[order], digest[order]
        later = order[owner[order] > _first(owner[order], _fresh(own_sorted, digest))]
        out.spread(PLACES, _chunk_of(owner[later], chunks), "chunk", None, texts[later], places=place[later])
        return out.table()

    def kept(table: pa.Table, right: pa.Table) -> pa.Table:
        owner, place = _values(right, PLACES, "owners", "places")
        order = np.argsort(owner, kind="stable")
        owner, place = owner[order], place[order].astype(np.int64)
        columns = [[], [], [], []]
        for batch in common.slices(table.to_batches(), "text", TEXT_BYTES):
            texts, doc_ids = common.as_bytes(batch.column("text")), batch.column("doc_id").to_pylist()
            keys = _text_keys(texts, doc_ids)
            first, last = np.searchsorted(owner, keys), np.searchsorted(owner, keys, side="right")
            own = [[], [], []]
            for text, doc_id, a, b in zip(texts, doc_ids, first.tolist(), last.tolist(), strict=True):
                words, n = text.split(), 0
                stays = words
                if a < b and doc_id is not None:
                    edges = np.zeros(len(words) + 1, dtype=np.int64)
                    np.add.at(edges, place[a:b], 1)
                    np.add.at(edges, place[a:b] + window, -1)
                    free = np.cumsum(edges[:-1]) == 0
                    n, stays = len(words) - int(free.sum()), compress(words, free.tolist())
                for column, value in zip(own, (len(words), n, b" ".join(stays).decode()), strict=True):
                    column.append(value)
            columns[0].append(batch.column("doc_id"))
            for column, values, kind in zip(columns[1:], own, (pa.int64(), pa.int64(), pa.string()), strict=True):
                column.append(pa.array(values, type=kind))
        kinds = zip(("doc_id", "n_words", "n_removed", "kept"), columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)
        return pa.table({name: pa.chunked_array(own, type=kind) for name, own, kind in kinds})

    # a number of partitions that grows with the chunks, on both sides of each cogroup; beyond MOST_PARTS several chunks share one
    parts = max(min(chunks, MOST_PARTS), int(spark.conf.get("spark.sql.shuffle.partitions")))
    texts = docs.withColumn("chunk", _chunk(chunks)).repartition(parts, "chunk").groupBy("chunk")
    asked = steps.where(F.col("kind") == ASKED).repartition(parts, "chunk").groupBy("chunk")
    entries = texts.cogroup(asked).applyInArrow(digested, STEPS)
    sure = _by_bucket(entries, _parts(spark, buckets), verified)
    places = steps.where(F.col("kind") == PLACES).unionByName(sure).repartition(parts, "chunk").groupBy("chunk")
    return texts.cogroup(places).applyInArrow(kept, "doc_id long, n_words long, n_removed long, kept string")


def _chunk(chunks: int):
    """``_chunk_of`` as a column; documents without an id are spread by their text."""
    key = F.coalesce("doc_id", F.xxhash64("text"))
    folded = key.bitwiseXOR(F.shiftrightunsigned(key, 17)).bitwiseXOR(F.shiftrightunsigned(key, 31))
    return (folded.bitwiseAND(F.lit((1 << 63) - 1)) % F.lit(chunks)).cast("int")


def _prime(n: int) -> int:
    """The first prime from ``n`` on."""
    while any(n % k == 0 for k in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def sizes(docs: DataFrame, bucket_windows: int = BUCKET_WINDOWS, chunk_chars: int = CHUNK_CHARS, batch_chars: int = BATCH_CHARS) -> tuple[int, int, int]:
    """Numbers of buckets (a power of two), chunks and batches for documents (doc_id, text)."""
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, 1 << (max(1, chars // 6 // bucket_windows) - 1).bit_length())
    return buckets, _prime(max(17, -(-chars // chunk_chars))), max(BATCHES, -(-chars // batch_chars))


def substring_deduplicated(docs: DataFrame, window: int = WINDOW, batches: int | None = None, fan_in: int = FAN_IN, folder: str | None = None, key_bits: int = KEY_BITS) -> DataFrame:
    """All documents without the words whose windows start in a smaller document, by ingesting them into an empty index in batches.

    The index with all documents is left in ``folder``."""
    folder = folder or f"{common.shared_folder(docs.sparkSession)}/runs"
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text"))
    buckets, chunks, grown = sizes(own)
    batches = batches or grown
    cuts = own.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)] or [0.5], 10_000)).first()[0] or []
    cuts = sorted(set(cuts)) if batches > 1 else []
    runs, found, since, written = None, None, 0, None
    if len(cuts) + 1 >= MANY_BATCHES:
        # the texts are read once and written by batches, in ranges of ids, so that no batch scans those of others
        written = f"{common.shared_folder(docs.sparkSession)}/batches"
        at = F.size(F.filter(F.array(*(F.lit(c) for c in cuts)), lambda c: c < F.col("doc_id")))
        dealt = own.where("doc_id IS NOT NULL").repartitionByRange(min(4 * len(cuts), MOST_PARTS), "doc_id")
        dealt.withColumn("batch", at).write.partitionBy("batch").parquet(written)
    for k in range(len(cuts) + 1):
        batch = docs.sparkSession.read.schema("doc_id long, text string, batch int").parquet(written).where(F.col("batch") == k).drop("batch") if written else own.where(F.col("doc_id").isNotNull() & (F.col("doc_id") > cuts[k - 1] if k else F.lit(True)) & (F.col("doc_id") <= cuts[k] if k < len(cuts) else F.lit(True)))
        steps, runs = ingest(batch, runs, buckets, chunks, folder, window, key_bits)
        found, since = steps if found is None else found.unionByName(steps), since + 1
        if since > fan_in:
            runs, since = compact(runs, folder, fan_in), 1
    return without_matches(own, found, buckets, chunks, window, key_bits)


ORACLE = """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS l FROM documents),
win AS (SELECT doc_id, k, array_to_string(l[k:k + 12], ' ') AS c FROM (SELECT doc_id, l, unnest(range(1, len(l) - 11)) AS k FROM w WHERE len(l) >= 13)),
f AS (SELECT c, min(doc_id) AS least FROM win GROUP BY c),
hit AS (SELECT DISTINCT doc_id, k + o AS p FROM win JOIN f USING (c) CROSS JOIN range(13) r(o) WHERE least < doc_id),
each AS (SELECT doc_id, unnest(l) AS word, generate_subscripts(l, 1) AS p FROM w),
kept AS (SELECT e.doc_id, count(hit.p) AS gone, string_agg(word, ' ' ORDER BY e.p) FILTER (WHERE hit.p IS NULL) AS rest FROM each e LEFT JOIN hit ON hit.doc_id = e.doc_id AND hit.p = e.p GROUP BY e.doc_id)
SELECT w.doc_id, CAST(len(l) AS BIGINT) AS n_words, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""
