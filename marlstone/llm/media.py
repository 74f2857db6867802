"""Media columns: bytes as AVI motion JPEG, and what can be told from the frames.

A text's bytes, filled up with zeros to a positive multiple of ``WIDTH``, are the 8-bit samples of frames of ``WIDTH`` by
up to ``WIDTH`` pixels; the last frame may be lower, as its own header says. Each frame is a lossless JPEG (process 14,
predictor 1) within an AVI file with headers, a movie list and an index. The Huffman table gives the difference category
s a code of 9 - s bits, so every sample takes nine bits and whole batches of frames are coded and decoded as arrays.

The reader walks the RIFF chunks, goes through the index, decodes every frame by the Huffman table that it holds, and cuts the
film where the histogram difference of two frames stands out from those before it. It yields timed clips. Frames other than
lossless ones of one component, ``WIDTH`` samples a line, predictor 1, are refused with an error.

Defined cases: null text is empty and has one frame of one line; equal texts have equal files; repeated and equal rows, null
ids among them, get a row each; a very long text is one file, for which a task holds tens of times its bytes at once (differences,
codes and histogram cells of all samples); a file without the private comment has a null ``n_bytes``, one without header, movie or index is refused; clips
take their times from the rate that the file names; an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WIDTH, RATE = 64, 25
#: The difference that stands for bits that are no code.
NO_CODE = 1000
#: Bytes of text or media coded at a time.
TEXT_BYTES = 4_000_000
#: Histogram cells, frames before a cut that it is held against, deviations and least difference that make a cut.
CELLS, BEFORE, DEVIATIONS, LEAST = 16, 8, 3.0, 0.15
CLIP = "struct<clip: int, first_frame: int, end_frame: int, start_s: double, end_s: double>"
DECODED = f"doc_id long, n_bytes long, frames int, payload binary, clips array<{CLIP}>"


def _code_table() -> np.ndarray:
    """The nine bits of each difference -255 .. 255: code of its category, then its low bits (of the difference less one if negative)."""
    out = np.zeros(511, dtype=np.uint16)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        code = (1 << 9 - s) - 2 if s < 8 else 0
        out[d + 255] = code << s | ((d if d >= 0 else d - 1) & ((1 << s) - 1))
    return out


CODES = _code_table()


def jpeg_head(height: int) -> bytes:
    """Start of image, Huffman table, lossless frame and scan headers."""
    table = bytes([0]) + bytes([1] * 9 + [0] * 7) + bytes(range(8, -1, -1))
    frame = struct.pack(">BHHB", 8, height, WIDTH, 1) + bytes([1, 0x11, 0])
    scan = bytes([1, 1, 0x00, 1, 0, 0])
    segment = lambda mark, body: bytes([0xFF, mark]) + struct.pack(">H", len(body) + 2) + body
    return b"\xff\xd8" + segment(0xC4, table) + segment(0xC3, frame) + segment(0xDA, scan)



def encode_frames(lines: np.ndarray, heights: np.ndarray) -> list[bytes]:
    """JPEG files of the frames; lines: [line, WIDTH] samples of all frames in a row."""
    samples = lines.astype(np.int16)
    diff = np.empty_like(samples)
    diff[:, 1:] = samples[:, 1:] - samples[:, :-1]
    diff[1:, 0] = samples[1:, 0] - samples[:-1, 0]
    starts = np.cumsum(heights) - heights
    diff[starts, 0] = samples[starts, 0] - 128
    a = CODES[diff + 255].reshape(-1, 8)
    bits = np.empty((len(a), 9), dtype=np.uint8)
    bits[:, 0] = a[:, 0] >> 1
    for k in range(1, 8):
        bits[:, k] = (a[:, k - 1] << (8 - k) | a[:, k] >> (k + 1)) & 255
    bits[:, 8] = a[:, 7] & 255
    flat = bits.reshape(-1)
    full = flat == 255
    at = np.flatnonzero(full)
    stuffed = np.zeros(len(flat) + len(at), dtype=np.uint8)
    stuffed[np.arange(len(flat)) + np.cumsum(full) - full] = flat
    ends = np.cumsum(heights) * (WIDTH * 9 // 8)
    ends = ends + np.searchsorted(at, ends)
    data, out, begin = stuffed.tobytes(), [], 0
    heads = {h: jpeg_head(h) for h in set(heights.tolist())}
    for height, end in zip(heights.tolist(), ends.tolist(), strict=True):
        out.append(heads[height] + data[begin:end] + b"\xff\xd9")
        begin = end
    return out


class Table:
    """A Huffman table of a lossless scan: for every next 16 bits the bits that a sample takes and its difference."""

    def __init__(self, body: bytes):
        if len(body) < 17 or body[0] or len(body) != 17 + sum(body[1:17]):
            raise ValueError("a Huffman table that isn't the scan's only one")
        self.widths, self.differences = np.zeros(1 << 16, dtype=np.int64), np.full(1 << 16, NO_CODE, dtype=np.int16)
        code, at, every = 0, 17, set()
        for length, count in enumerate(body[1:17], 1):
            for s in body[at : at + count]:
                end = code + 1 << 16 - length
                if s > 8 or length + s > 16 or end > 1 << 16:
                    raise ValueError(f"a code of {length} bits for differences of {s} bits")
                ahead = np.arange(code << 16 - length, end)
                low = ahead >> 16 - length - s & (1 << s) - 1
                self.widths[ahead], self.differences[ahead] = length + s, np.where(low >> max(s - 1, 0), low, low + 1 - (1 << s)) if s else 0
                every.add(length + s)
                code += 1
            at += count
            code <<= 1
        #: Bits of a sample where all take equally many, else None.
        self.width = every.pop() if len(every) == 1 else None


def _parsed(frame: bytes) -> tuple[int, bytes, bytes]:
    """Lines, Huffman table and entropy-coded bytes of a frame; frames of other kinds are refused."""
    if frame[:2] != b"\xff\xd8" or frame[-2:] != b"\xff\xd9":
        raise ValueError("not a JPEG frame")
    at, lines, table = 2, 0, b""
    while True:
        mark, n = struct.unpack_from(">HH", frame, at)
        body = frame[at + 4 : at + 2 + n]
        at += 2 + n
        if mark == 0xFFC4:
            table = body
        elif mark == 0xFFC3:
            bits, lines, width, parts = struct.unpack_from(">BHHB", body)
            if (bits, width, parts) != (8, WIDTH, 1):
                raise ValueError(f"a frame of {parts} components, {width} samples a line, {bits} bits a sample")
        elif mark == 0xFFDA:
            # one component, its table 0, predictor 1, no point transform
            if len(body) != 6 or (body[0], body[2] >> 4, body[3], body[5]) != (1, 0, 1, 0) or not lines or not table:
                raise ValueError("a scan that isn't lossless with predictor 1")
            return lines, table, frame[at:-2]
        elif not 0xFFE0 <= mark <= 0xFFFE:
            raise ValueError(f"a segment {mark:x} that isn't known")


def _equally_wide(raw: bytes, table: Table, n: int) -> np.ndarray:
    """Differences of n samples that all take ``table.width`` bits, of frames without bits between them."""
    b, w = np.frombuffer(raw, dtype=np.uint8).reshape(-1, table.width).astype(np.uint32), table.width
    b = np.concatenate([b, np.zeros((len(b), 2), dtype=np.uint32)], axis=1)
    out = np.empty((len(b), 8), dtype=np.int16)
    for k in range(8):
        at, off = divmod(k * w, 8)
        out[:, k] = table.differences[(b[:, at] << 16 | b[:, at + 1] << 8 | b[:, at + 2]) >> 8 - off & 0xFFFF]
    return out.reshape(-1)[:n]


def _side_by_side(raws: list[bytes], table: Table, counts: np.ndarray) -> np.ndarray:
    """Differences of frames whose samples take unequal numbers of bits: a sample of every frame at a time."""
    data = np.frombuffer(b"".join(x + bytes(4) for x in raws), dtype=np.uint8).astype(np.uint32)
    sizes = np.array([len(x) + 4 for x in raws], dtype=np.int64)
    bit = (np.cumsum(sizes) - sizes) * 8
    ends = np.cumsum(sizes) * 8 - 32
    out, begin = np.empty(int(counts.sum()), dtype=np.int16), np.cumsum(counts) - counts
    for k in range(int(counts.max())):
        own = np.flatnonzero(counts > k)
        at, off = bit[own] >> 3, (bit[own] & 7).astype(np.uint32)
        ahead = (data[at] << 16 | data[at + 1] << 8 | data[at + 2]) >> 8 - off & 0xFFFF
        out[begin[own] + k] = table.differences[ahead]
        bit[own] += table.widths[ahead]
        if (bit[own] > ends[own]).any():
            raise ValueError("a frame that ends before its last sample")
    return out


def decode_frames(frames: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Samples [line, WIDTH] and heights of the frames, each decoded by the Huffman table it holds."""
    parsed = [_parsed(x) for x in frames]
    heights = np.array([x[0] for x in parsed], dtype=np.int64)
    starts = np.cumsum(heights) - heights
    diff = np.empty((int(heights.sum()), WIDTH), dtype=np.uint8)  # samples are sums modulo 256
    for body in sorted({x[1] for x in parsed}):
        table, own = Table(body), np.array([k for k, x in enumerate(parsed) if x[1] == body], dtype=np.int64)
        raws = [parsed[k][2].replace(b"\xff\x00", b"\xff") for k in own]
        counts = heights[own] * WIDTH
        if table.width and [len(x) for x in raws] == (counts * table.width // 8).tolist():
            found = _equally_wide(b"".join(raws), table, int(counts.sum()))
        else:
            found = _side_by_side(raws, table, counts)
        if (found == NO_CODE).any():
            raise ValueError("bits that are no code of the frame's table")
        lines = found.reshape(-1, WIDTH).astype(np.uint8)
        if len(own) == len(parsed):
            diff = lines
        else:
            diff[np.repeat(starts[own] - (np.cumsum(heights[own]) - heights[own]), heights[own]) + np.arange(len(lines))] = lines
    # first samples add up down a frame, the others along a line
    first = np.cumsum(diff[:, 0], dtype=np.uint8)
    diff[:, 0] = 128 + first - np.repeat(first[starts] - diff[starts, 0], heights)
    return np.cumsum(diff, axis=1, dtype=np.uint8), heights


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def write_avi(frames: list[bytes], height: int, n_bytes: int) -> bytes:
    """An AVI file of JPEG frames; ``n_bytes`` is kept as a comment."""
    largest = max(map(len, frames))
    main = struct.pack("<14I", 1_000_000 // RATE, largest * RATE, 0, 0x10, len(frames), 0, 1, largest, WIDTH, height, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, RATE, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, WIDTH, height)
    form = struct.pack("<IiiHH4sIiiII", 40, WIDTH, height, 1, 8, b"MJPG", WIDTH * height, 0, 0, 0, 0)
    header = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", form)))
    info = _chunk(b"LIST", b"INFO" + _chunk(b"ICMT", b"%d" % n_bytes))
    index, at, parts = [], 4, [b"movi"]
    for frame in frames:
        parts.append(_chunk(b"00dc", frame))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(frame)))
        at += len(parts[-1])
    return _chunk(b"RIFF", b"AVI " + header + info + _chunk(b"LIST", b"".join(parts)) + _chunk(b"idx1", b"".join(index)))


def read_avi(data: bytes) -> tuple[list[bytes], int | None, float]:
    """The frames that the index names, the comment's number (null without one), and the seconds of a frame by the stream's header."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    at, lists, index = 12, {}, None
    while at + 8 <= len(data):
        name, size = struct.unpack_from("<4sI", data, at)
        if name == b"LIST":
            lists[data[at + 8 : at + 12]] = at + 8
        elif name == b"idx1":
            index = (at + 8, size)
        at += 8 + size + size % 2
    if b"movi" not in lists or b"hdrl" not in lists or index is None:
        raise ValueError("an AVI file without header, movie or index")
    movie, stream = lists[b"movi"], data.find(b"strh", lists[b"hdrl"], lists[b"movi"])
    if stream < 0:
        raise ValueError("an AVI file without a stream header")
    scale, rate = struct.unpack_from("<II", data, stream + 28)
    frames = []
    for _, _, offset, size in struct.iter_unpack("<4sIII", data[index[0] : index[0] + index[1]]):
        frames.append(data[movie + offset + 8 : movie + offset + 8 + size])
    info = lists.get(b"INFO")
    if info is None or data[info + 4 : info + 8] != b"ICMT":
        return frames, None, scale / rate
    (n,) = struct.unpack_from("<I", data, info + 8)
    return frames, int(data[info + 12 : info + 12 + n]), scale / rate


def cuts(histograms: np.ndarray) -> list[int]:
    """Frames that begin a shot: the difference to the frame before stands out from the differences before it."""
    if len(histograms) < 2:
        return [0]
    share = histograms / histograms.sum(1, keepdims=True)
    change, found = np.abs(np.diff(share, axis=0)).sum(1) / 2, [0]
    total, squares = np.concatenate([[0], np.cumsum(change)]), np.concatenate([[0], np.cumsum(change**2)])
    at = np.arange(len(change))
    n = np.minimum(at, BEFORE)
    mean = (total[at] - total[at - n]) / np.maximum(n, 1)
    spread = np.sqrt(np.maximum((squares[at] - squares[at - n]) / np.maximum(n, 1) - mean**2, 0))
    return found + (np.flatnonzero(change > np.maximum(LEAST, mean + DEVIATIONS * spread)) + 1).tolist()


def stored(docs: DataFrame) -> DataFrame:
    """(doc_id, media): each text's bytes as an AVI file."""

    def made(batches):
        for batch in common.slices(batches, "text", TEXT_BYTES):
            texts = common.as_bytes(batch.column("text"))
            counts = np.array([max(1, -(-len(x) // WIDTH)) for x in texts], dtype=np.int64)
            lines = np.frombuffer(b"".join(x.ljust(n * WIDTH, b"\0") for x, n in zip(texts, counts.tolist(), strict=True)), dtype=np.uint8).reshape(-1, WIDTH)
            n_frames = -(-counts // WIDTH)
            heights = np.full(int(n_frames.sum()), WIDTH, dtype=np.int64)
            last = np.cumsum(n_frames) - 1
            heights[last] = counts - (n_frames - 1) * WIDTH
            frames, end, rows = encode_frames(lines, heights), 0, []
            for text, n, count in zip(texts, n_frames.tolist(), counts.tolist(), strict=True):
                rows.append(write_avi(frames[end : end + n], min(count, WIDTH), len(text)))
                end += n
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, type=pa.binary())], names=["doc_id", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text")).mapInArrow(made, "doc_id long, media binary")


def decoded(media: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, frames, payload, clips) and the ``media`` itself, of AVI files (doc_id, media)."""

    def run(batches):
        for batch in common.slices(batches, "media", TEXT_BYTES):
            files = [read_avi(x) for x in batch.column("media").to_pylist()]
            lines, heights = decode_frames([frame for frames, *_ in files for frame in frames])
            frame_of = np.repeat(np.arange(len(heights)), heights)
            cells = np.bincount((frame_of[:, None] * CELLS + (lines >> 4)).reshape(-1), minlength=len(heights) * CELLS).reshape(-1, CELLS)
            ends = np.cumsum(heights) * WIDTH
            data, k, rows = lines.tobytes(), 0, []
            for frames, n_bytes, seconds in files:
                n = len(frames)
                begins = [*cuts(cells[k : k + n]), n]
                clips = [{"clip": c, "first_frame": a, "end_frame": b, "start_s": a * seconds, "end_s": b * seconds} for c, (a, b) in enumerate(zip(begins, begins[1:], strict=False))]
                rows.append((n_bytes, n, data[ends[k] - heights[k] * WIDTH : ends[k + n - 1]], clips))
                k += n
            kinds = [pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.struct([("clip", pa.int32()), ("first_frame", pa.int32()), ("end_frame", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64())]))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[c] for r in rows], type=t) for c, t in enumerate(kinds)), batch.column("media")], names=["doc_id", "n_bytes", "frames", "payload", "clips", "media"])

    return media.select("doc_id", "media").mapInArrow(run, DECODED + ", media binary")


def clips(media: DataFrame) -> DataFrame:
    """A row per clip: doc_id, clip, first_frame, end_frame, start_s, end_s."""
    return decoded(media).select("doc_id", F.explode("clips").alias("c")).select("doc_id", "c.*")
