"""Token ids of whole documents in Huffman-coded files, in ascending ``doc_id`` order.

Tokens are made once, counted on the way, and kept as a table; their global counts (one row per vocabulary id) give one canonical
length-limited code for all files. Documents are then dealt out by ranges of ``doc_id``; each task writes one file of
independent blocks, which hold whole documents, a bit offset for every ``EVERY`` ids, and their CRC-32. Reading needs no
other file: a file begins with the code's lengths.

A file: ``MAGIC``, then zlib-packed code lengths, then blocks; numbers are little-endian. A block: header (documents,
ids, checkpoints, bytes of bits, CRC-32 of the rest), document ids, ids per document, whether a document's id is null, checkpoints, bits.

Defined cases: null text is empty (one end id); a null ``doc_id`` sorts first; rows of equal ``doc_id`` sort by number of
ids, then ids; an empty table gives no file and no row; other columns are not read.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blobs, common, huffman
from .tokens import END_ID, encoder_of, with_ends

MAGIC, HEADER = b"MTOK\x01", "<IIIII"
#: Ids between two checkpoints, ids of a block (one document may be longer), bytes of text encoded at a time.
EVERY, BLOCK_IDS, TEXT_BYTES = 64, 1_000_000, 4_000_000
TOKENS = ["doc_id", "n_tokens", "blob", "counts"]
MANIFEST = "part long, path string, bytes long, documents long, tokens long"


def _squeezed(ids: np.ndarray, packer) -> bytes:
    """Ids as planes of bytes, compressed: for the way between two stages."""
    return packer.compress(np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _spread(blob: bytes, unpacker) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(unpacker.decompress(blob), dtype=np.uint8).reshape(4, -1).T).view("<u4").reshape(-1).astype(np.int64)


def tokenized(docs: DataFrame, vocabulary: str, end_id: int = END_ID) -> DataFrame:
    """Rows (doc_id, n_tokens, blob), and at a task's end one with ``counts`` alone: how often each id occurs in the task."""

    def made(batches):
        import zstandard

        encoder, packer, total = encoder_of(vocabulary), zstandard.ZstdCompressor(level=1), np.zeros(0, dtype=np.int64)
        for batch in common.slices(batches, "text", TEXT_BYTES):
            ids, counts = with_ends(*encoder.encode(common.as_bytes(batch.column("text"))), end_id)
            own = np.bincount(ids, minlength=len(total))
            own[: len(total)] += total
            total, ends = own, np.cumsum(counts)
            rows = [_squeezed(ids[b - n : b], packer) for b, n in zip(ends, counts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, type=pa.int64()), pa.array(rows, type=pa.binary()), pa.nulls(len(rows), pa.binary())],
                names=TOKENS,
            )
        if len(total):
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([total.astype("<i8").tobytes()])], names=TOKENS)

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text"))
    return own.mapInArrow(made, "doc_id long, n_tokens long, blob binary, counts binary")


def id_counts(tokens: DataFrame) -> np.ndarray:
    """How often each id occurs. What comes to the driver has one row per vocabulary id, whatever the input's size."""

    def spread(batches):
        for batch in batches:
            for blob in batch.column("counts").to_pylist():
                total = np.frombuffer(blob, dtype="<i8")
                seen = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(seen, type=pa.int64()), pa.array(total[seen], type=pa.int64())], names=["id", "n"])

    # of the written tokens only the column of counts is read
    rows = tokens.where("counts IS NOT NULL").select("counts").mapInArrow(spread, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(max((r.id for r in rows), default=-1) + 1, dtype=np.int64)
    for r in rows:
        out[r.id] = r.n
    return out


def _block(doc_ids: list, runs: list[np.ndarray], lengths: np.ndarray, codes: np.ndarray) -> bytes:
    ids = np.concatenate(runs)
    bits, checkpoints, _ = huffman.encode(ids, lengths, codes, EVERY)
    body = b"".join([np.array([x or 0 for x in doc_ids], dtype="<i8").tobytes(), np.array([len(x) for x in runs], dtype="<u4").tobytes(), np.array([x is None for x in doc_ids], dtype="u1").tobytes(), checkpoints.tobytes(), bits])
    return struct.pack(HEADER, len(doc_ids), len(ids), len(checkpoints), len(bits), zlib.crc32(body)) + body


def write_token_files(docs: DataFrame, vocabulary: str, folder: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Writes the files and returns their manifest (one row per file), in order of ``part``."""
    spark = docs.sparkSession
    folder = folder or f"{common.shared_folder(spark)}/tokens"
    tokens = common.written(tokenized(docs, vocabulary, end_id), "tokens", "none")
    lengths = huffman.code_lengths(id_counts(tokens))
    packed_lengths = zlib.compress(lengths.tobytes())

    def write(batches):
        import zstandard

        codes, unpacker = huffman.canonical_codes(lengths), zstandard.ZstdDecompressor()
        part, path, out = TaskContext.get().partitionId(), None, None
        doc_ids, runs, held, documents, total = [], [], 0, 0, 0
        for batch in batches:
            for doc_id, blob in zip(batch.column("doc_id").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                if out is None:
                    path = blobs.attempt_name(folder, part, ".mtok")
                    out = blobs.create(path)
                    out.write(MAGIC + struct.pack("<I", len(packed_lengths)) + packed_lengths)
                doc_ids.append(doc_id)
                runs.append(_spread(blob, unpacker))
                held += len(runs[-1])
                if held >= BLOCK_IDS:
                    out.write(_block(doc_ids, runs, lengths, codes))
                    documents, total = documents + len(runs), total + held
                    doc_ids, runs, held = [], [], 0
        if out is not None:
            if runs:
                out.write(_block(doc_ids, runs, lengths, codes))
                documents, total = documents + len(runs), total + held
            size = out.tell()
            out.close()
            yield pa.RecordBatch.from_pylist([{"part": part, "path": path, "bytes": size, "documents": documents, "tokens": total}])

    kept = tokens.where("counts IS NULL").select("doc_id", "n_tokens", "blob")
    ordered = kept.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "n_tokens", "blob")
    return common.written(ordered.mapInArrow(write, MANIFEST), "manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids) of the files of a manifest; ids are little-endian unsigned 32-bit.

    ``start`` follows from the tokens of the files before, one number per file."""
    spark = manifest.sparkSession
    rows = sorted(manifest.select("part", "path", "tokens").collect(), key=lambda r: r.part)
    bases = np.cumsum([0, *(r.tokens for r in rows)]).tolist()
    files = spark.createDataFrame([(r.path, b) for r, b in zip(rows, bases, strict=False)], "path string, base long")

    def read(batches):
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                with blobs.read_at(path) as file:
                    if file.read(len(MAGIC)) != MAGIC:
                        raise ValueError(f"not a token file: {path}")
                    (n,) = struct.unpack("<I", file.read(4))
                    table = huffman.decoding_table(np.frombuffer(zlib.decompress(file.read(n)), dtype=np.uint8))
                    while header := file.read(struct.calcsize(HEADER)):
                        n_docs, n_ids, n_checkpoints, n_bits, crc = struct.unpack(HEADER, header)
                        body = file.read(n_docs * 13 + n_checkpoints * 8 + n_bits)
                        if zlib.crc32(body) != crc:
                            raise ValueError(f"damaged block in {path}")
                        doc_ids = np.frombuffer(body, "<i8", n_docs)
                        counts = np.frombuffer(body, "<u4", n_docs, n_docs * 8).astype(np.int64)
                        nulls = np.frombuffer(body, "u1", n_docs, n_docs * 12).astype(bool)
                        checkpoints = np.frombuffer(body, "<u8", n_checkpoints, n_docs * 13)
                        ids = huffman.decode(body[n_docs * 13 + n_checkpoints * 8 :], checkpoints, n_ids, table, EVERY).astype("<u4")
                        ends = np.cumsum(counts)
                        for at in range(0, n_docs, 2000):
                            own = range(at, min(at + 2000, n_docs))
                            yield pa.RecordBatch.from_arrays([
                                pa.array(doc_ids[own.start : own.stop], mask=nulls[own.start : own.stop]), pa.array(base + ends[own.start : own.stop] - counts[own.start : own.stop]),
                                pa.array(counts[own.start : own.stop]), pa.array([ids[ends[k] - counts[k] : ends[k]].tobytes() for k in own], type=pa.binary()),
                            ], names=["doc_id", "start", "n_tokens", "ids"])
                        base += n_ids

    return files.repartition(max(1, len(rows)), "path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")
