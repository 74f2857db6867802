"""Line dedup by winnowing over line hashes.

A document is its sequence of non-blank lines (without white space at both ends). Of each window of ``WINDOW`` lines the
smallest hash, the rightmost on a tie, is a fingerprint; a document of fewer lines has one window. Two documents that share
a run of ``WINDOW`` lines share a fingerprint of it, wherever it stands. A line of at least ``LONG_LINE`` words is a window
by itself, so it is always one.

Only fingerprints' places are joined: each with the first place, by ``doc_id`` and then line, of the same fingerprint. A
match is extended both ways along the lines around the two places, by ``REACH`` lines at most on each side, which also
verifies it. Where the lines around differ from those of the first place, the windows that chose the fingerprint are joined
once more, by all their lines, with their own first place. A later run is deleted if it has at least ``WINDOW`` lines or its
fingerprint is a long line. So a line goes if it lies in a window that also starts at an earlier place, or around a long
line as around its first place. Blank lines stay.

No document's lines travel to another: what is joined is a fingerprint's place and the hashes within its reach, and those
only for fingerprints that stand in more than one place.

Defined cases: null text is empty; a document may lose all its lines and then has the text that its blank lines make; rows
are judged by their own text, whatever their ``doc_id``: a null one comes after all others, rows of equal ``doc_id`` and
other texts come in order of a hash of the text, rows equal in both are one document and lose the same lines; a very long
text is cut into lines in memory once; empty tables give no row; other columns may have any name.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import common

WINDOW, LONG_LINE, REACH = 4, 8, 8
#: Bytes of text cut into lines at a time.
TEXT_BYTES = 4_000_000
STEP = np.uint64(0x9E3779B97F4A7C15)
#: A document, in the order in which places are compared.
DOC = ["none", "doc_id", "digest"]
DOC_SCHEMA = "none boolean, doc_id long, digest long"


def line_hashes(text: bytes, long_line: int = LONG_LINE) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each non-blank line (the first 64 bits of its MD5, never 0), and whether it is long."""
    lines = [x for x in (line.strip() for line in text.split(b"\n")) if x]
    hashes = np.frombuffer(b"".join(hashlib.md5(x, usedforsecurity=False).digest()[:8] for x in lines), dtype=">u8").astype(np.uint64)
    return np.maximum(hashes, np.uint64(1)), np.array([len(x.split()) >= long_line for x in lines], dtype=bool)


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """For each window of ``window`` hashes: the place of its smallest, the rightmost on a tie."""
    window = min(window, len(hashes))
    n = len(hashes) - window + 1 if len(hashes) else 0
    best, at = hashes[:n].copy(), np.arange(n)
    for k in range(1, window):
        own = hashes[k : n + k]
        better = own <= best
        best[better], at[better] = own[better], np.arange(n)[better] + k
    return at


def _lines(docs: DataFrame, long_line: int) -> DataFrame:
    """(none, doc_id, digest, hashes, long) of each distinct document (doc_id, text)."""

    def cut(batches):
        for batch in common.slices(batches, "text", TEXT_BYTES):
            found = [line_hashes(x, long_line) for x in common.as_bytes(batch.column("text"))]
            columns = [pa.array([x.tobytes() for x in own], type=pa.binary()) for own in zip(*found, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), *columns], names=["doc_id", "digest", "hashes", "long"])

    made = docs.withColumn("digest", F.xxhash64("text")).mapInArrow(cut, "doc_id long, digest long, hashes binary, long binary")
    own = made.groupBy("doc_id", "digest").agg(F.first("hashes").alias("hashes"), F.first("long").alias("long"))
    return common.written(own.select(F.col("doc_id").isNull().alias("none"), "doc_id", "digest", "hashes", "long"), "lines")


def _documents(batch: pa.RecordBatch, counts: np.ndarray) -> list[pa.Array]:
    """The columns of ``DOC``, each document as often as ``counts`` says."""
    rows = pa.array(np.repeat(np.arange(len(counts)), counts))
    return [batch.column(c).take(rows) for c in DOC]


def _fingerprints(lines: DataFrame, window: int) -> DataFrame:
    """(fp, none, doc_id, digest, at): the places of each document's fingerprints."""

    def chosen(batches):
        for batch in batches:
            places, prints = [], []
            for raw, long in zip(batch.column("hashes").to_pylist(), batch.column("long").to_pylist(), strict=True):
                hashes = np.frombuffer(raw, dtype=np.uint64)
                own = np.zeros(len(hashes), dtype=bool)
                own[winnow(hashes, window)] = True
                places.append(np.flatnonzero(own | np.frombuffer(long, dtype=bool)))
                prints.append(hashes[places[-1]])
            if places:
                counts = np.array([len(x) for x in places])
                columns = [pa.array(np.concatenate(prints).view(np.int64)), *_documents(batch, counts), pa.array(np.concatenate(places).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["fp", *DOC, "at"])

    return lines.mapInArrow(chosen, f"fp long, {DOC_SCHEMA}, at int")


def _content(parts: list[np.ndarray]) -> np.ndarray:
    """One hash of several rows of line hashes."""
    out = np.zeros(len(parts[0]), dtype=np.uint64)
    for own in parts:
        out = (out ^ own) * STEP
        out ^= out >> np.uint64(29)
    return out


def _around(lines: DataFrame, places: DataFrame, reach: int) -> DataFrame:
    """(fp, is_first, none, doc_id, digest, at, long, left, right) of ``places`` (DOC, at, is_first): the hashes of the lines on both sides, nearest first, 0 where there is none."""

    def cut(batches):
        for batch in batches:
            counts, parts = [], []
            for raw, long, own in zip(*(batch.column(c).to_pylist() for c in ("hashes", "long", "places")), strict=True):
                hashes = np.frombuffer(raw, dtype=np.uint64)
                at, firsts = np.array([x["at"] for x in own], dtype=np.int64), np.array([x["is_first"] for x in own], dtype=bool)
                padded = np.concatenate([np.zeros(reach, dtype=np.uint64), hashes, np.zeros(reach, dtype=np.uint64)])
                steps = np.arange(1, reach + 1)
                sides = [padded[(at + reach)[:, None] + sign * steps] for sign in (-1, 1)]
                counts.append(len(at))
                parts.append((hashes[at], firsts, at, np.frombuffer(long, dtype=bool)[at], *sides))
            if parts:
                fp, firsts, at, long, left, right = (np.concatenate(x) for x in zip(*parts, strict=True))
                sides = [pa.array([x.tobytes() for x in side], type=pa.binary()) for side in (left, right)]
                columns = [pa.array(fp.view(np.int64)), pa.array(firsts), *_documents(batch, np.array(counts)), pa.array(at.astype(np.int32)), pa.array(long), *sides]
                yield pa.RecordBatch.from_arrays(columns, names=["fp", "is_first", *DOC, "at", "long", "left", "right"])

    own = places.groupBy(*DOC).agg(F.collect_list(F.struct("at", "is_first")).alias("places"))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"p.{c}")) for c in ("doc_id", "digest")]
    both = lines.alias("l").join(own.alias("p"), same).select("l.*", "p.places")
    return both.mapInArrow(cut, f"fp long, is_first boolean, {DOC_SCHEMA}, at int, long boolean, left binary, right binary")


def _unlike(fp, left, right, back, ahead, window: int):
    """Windows that chose a fingerprint and aren't within its match: (row, lines before the fingerprint, hash of the window's lines)."""
    for before in range(window):
        after = window - 1 - before
        open_ = (before > back) | (after > ahead)
        chose = (left[:, :before] >= np.maximum(fp, np.uint64(1))[:, None]).all(1) & (right[:, :after] > fp[:, None]).all(1)
        row = np.flatnonzero(open_ & chose)
        if len(row):
            yield row, before, _content([left[row, k] for k in reversed(range(before))] + [fp[row]] + [right[row, k] for k in range(after)])


def repeated_runs(lines: DataFrame, window: int = WINDOW, reach: int = REACH) -> DataFrame:
    """(none, doc_id, digest, start, n, first_doc, first_start): runs of lines that stand at an earlier place too."""
    prints = _fingerprints(lines, window)
    place = F.struct(*DOC, "at")
    first = prints.groupBy("fp").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("fp", "first")
    # the two joins on fingerprints are of written tables, so that adaptive execution can split a line that is very common
    known = common.written(first, "first")
    places = prints.join(known, "fp").select(*DOC, "at", (place == F.col("first")).alias("is_first"))
    around = common.written(_around(lines, places, reach), "around")
    there = around.where("is_first").select("fp", F.col("doc_id").alias("first_doc"), F.col("at").alias("first_at"), F.col("left").alias("first_left"), F.col("right").alias("first_right"))
    met = around.where("NOT is_first").join(there, "fp")

    def extended(batches):
        for batch in batches:
            fp, at, other = (np.asarray(batch.column(c).to_numpy(zero_copy_only=False)) for c in ("fp", "at", "first_at"))
            own, there = ([np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint64).reshape(-1, reach) for c in names] for names in (("left", "right"), ("first_left", "first_right")))
            back, ahead = (np.cumprod((x == y) & (x != 0), axis=1).sum(1) for x, y in zip(own, there, strict=True))
            n = back + 1 + ahead
            keep = np.flatnonzero((n >= window) | np.asarray(batch.column("long").to_numpy(zero_copy_only=False), dtype=bool))
            found = [(keep, (at - back)[keep], n[keep], batch.column("first_doc").take(pa.array(keep)), (other - back)[keep], pa.nulls(len(keep), pa.int64()))]
            for row, before, content in _unlike(fp.view(np.uint64), *own, back, ahead, window):
                found.append((row, at[row] - before, np.full(len(row), window), pa.nulls(len(row), pa.int64()), pa.nulls(len(row), pa.int32()), pa.array(content.view(np.int64))))
            for row, start, size, first_doc, first_start, content in found:
                columns = [*(batch.column(c).take(pa.array(row)) for c in DOC), pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32)), first_doc, first_start, content]
                columns[6] = first_start if isinstance(first_start, pa.Array) else pa.array(first_start.astype(np.int32))
                yield pa.RecordBatch.from_arrays(columns, names=[*DOC, "start", "n", "first_doc", "first_start", "content"])

    runs = [*DOC, "start", "n", "first_doc", "first_start"]
    found = common.written(met.mapInArrow(extended, f"{DOC_SCHEMA}, start int, n int, first_doc long, first_start int, content long"), "matches")
    unlike = found.where("content IS NOT NULL")
    start = F.struct(*DOC, "start")
    earlier = unlike.groupBy("content").agg(F.min(start).alias("first"), F.count("*").alias("n")).where("n > 1").select("content", "first")
    again = unlike.drop("first_doc", "first_start").join(common.written(earlier, "earlier"), "content").where(start > F.col("first"))
    again = again.select(*DOC, "start", "n", F.col("first.doc_id").alias("first_doc"), F.col("first.start").alias("first_start"))
    return found.where("content IS NULL").select(*runs).unionByName(again)


def deduplicated(docs: DataFrame, window: int = WINDOW, long_line: int = LONG_LINE, counts: bool = False) -> DataFrame:
    """The documents, with all their columns, without the lines of later repeated runs; ``counts`` adds n_lines and n_removed, in place of columns of these names."""
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if not (counts and c in ("n_lines", "n_removed"))))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text"))
    runs = repeated_runs(_lines(own, long_line), window).groupBy("doc_id", "digest").agg(F.collect_set(F.struct("start", "n")).alias("runs"))
    seen = [c if c in ("doc_id", "text") else f"c{k}" for k, c in enumerate(docs.columns)]
    plain, found = docs.toDF(*seen), runs.withColumnRenamed("doc_id", "run_doc")
    joined = plain.join(found, plain["doc_id"].cast("long").eqNullSafe(found["run_doc"]) & (F.xxhash64(common.text_of()) == found["digest"]), "left").select(*seen, "runs")
    fields = StructType([*docs.schema.fields, *(StructField(c, LongType()) for c in ("n_lines", "n_removed") if counts)])

    def cleaned(batches):
        for batch in common.slices(batches, "text", TEXT_BYTES):
            texts, n_lines, n_removed = [], [], []
            for text, own in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist(), strict=True):
                lines = (text or "").encode().split(b"\n") if own or counts else []
                full = [k for k, line in enumerate(lines) if line.strip()]
                gone: set[int] = set()
                if own:
                    edges = np.zeros(len(full) + 1, dtype=np.int64)
                    np.add.at(edges, [r["start"] for r in own], 1)
                    np.add.at(edges, [r["start"] + r["n"] for r in own], -1)
                    gone = {full[k] for k in np.flatnonzero(np.cumsum(edges)).tolist()}
                texts.append(b"\n".join(x for k, x in enumerate(lines) if k not in gone).decode() if gone else text)
                n_lines.append(len(full))
                n_removed.append(len(gone))
            columns = [pa.array(texts, type=batch.column(c).type) if c == "text" else batch.column(c) for c in seen]
            if counts:
                columns += [pa.array(n_lines, type=pa.int64()), pa.array(n_removed, type=pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=fields.names)

    return joined.mapInArrow(cleaned, fields)


ORACLE = """
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
b AS (SELECT doc_id, pos, line, trim(line, chr(32) || chr(9) || chr(13) || chr(11) || chr(12)) AS body FROM l),
n AS (SELECT doc_id, pos, md5(body) AS h, len(regexp_extract_all(body, '[^\\x20\\x09-\\x0D]+')) >= 8 AS long, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k
      FROM b WHERE body <> ''),
wide AS (SELECT doc_id, k, h || lead(h, 1) OVER d || lead(h, 2) OVER d || lead(h, 3) OVER d AS content FROM n WINDOW d AS (PARTITION BY doc_id ORDER BY k)),
again AS (SELECT doc_id, k FROM (SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id, k) AS r FROM wide WHERE content IS NOT NULL) WHERE r > 1),
longs AS (SELECT doc_id, k, h, row_number() OVER (PARTITION BY h ORDER BY doc_id, k) AS r FROM n WHERE long),
met AS (SELECT p.doc_id, p.k, f.doc_id AS f, f.k AS fk FROM longs p JOIN longs f ON f.h = p.h AND f.r = 1 WHERE p.r > 1),
sides AS (SELECT m.doc_id, m.k, s.sign, min(o.o) AS stop FROM met m CROSS JOIN (VALUES (-1), (1)) s(sign) CROSS JOIN (SELECT unnest(range(1, 10)) AS o) o
          LEFT JOIN n x ON x.doc_id = m.doc_id AND x.k = m.k + s.sign * o.o LEFT JOIN n y ON y.doc_id = m.f AND y.k = m.fk + s.sign * o.o
          WHERE o.o = 9 OR x.h IS NULL OR y.h IS NULL OR x.h <> y.h GROUP BY ALL),
runs AS (SELECT doc_id, k - max(stop) FILTER (WHERE sign = -1) + 1 AS a, k + max(stop) FILTER (WHERE sign = 1) - 1 AS b FROM sides GROUP BY doc_id, k
         UNION ALL SELECT doc_id, k, k + 3 FROM again),
gone AS (SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS k FROM runs),
marked AS (SELECT b.doc_id, b.pos, b.line, n.k IS NOT NULL AS counts, gone.k IS NOT NULL AS removed FROM b LEFT JOIN n USING (doc_id, pos) LEFT JOIN gone ON gone.doc_id = n.doc_id AND gone.k = n.k)
SELECT doc_id, CAST(count(*) FILTER (WHERE counts) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE removed) AS BIGINT) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT removed), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
