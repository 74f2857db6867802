"""Uncompressed bitmap files from bytes, in plain columns, a writer of one file a row and a reader of such rows.

A bitmap is a 54-byte header and rows from the top, each filled up to a multiple of four bytes; a pixel is blue, green, red.
The reader takes a table of names, so files of any number are listed by no driver; Spark's image source gives the same rows.
"""

from __future__ import annotations

import struct
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Files and bytes of files that a task reads about; bytes of pixels that a batch of images has about.
TASK_FILES, TASK_BYTES, BATCH_BYTES = 2048, 16 << 20, 4 << 20
IMAGE = "name string, width int, height int, channels int, data binary"


def little(value: Column, size: int) -> Column:
    """A whole number as little-endian bytes; negative ones as their complement."""
    digits = F.substring(F.lpad(F.hex(value.cast("long")), 16, "0"), 17 - 2 * size, 2 * size)
    return F.unhex(F.concat(*(F.substring(digits, 2 * k + 1, 2) for k in reversed(range(size)))))


def bitmap(payload: Column, width: Column, height: Column) -> Column:
    """A file of ``height`` rows of ``width`` pixels; the payload is filled up with zero bytes to three bytes a pixel."""
    line = width * 3
    padding = F.pmod(-line, F.lit(4))
    filled = F.rpad(payload, (line * height).cast("int"), F.lit(b"\x00"))

    # bytes that are made once and cut by position: substrings of digits would be counted from the first one, row by row
    def digits(data: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), height - 1), lambda k: F.concat(F.hex(F.substring(data, k * line + 1, line)), F.repeat(F.lit("00"), padding.cast("int"))))

    rows = F.element_at(F.transform(F.array(filled), digits), 1)
    size = (line + padding) * height
    zero = F.lit(0)
    header = [F.lit(b"BM"), little(size + 54, 4), little(zero, 4), little(F.lit(54), 4), little(F.lit(40), 4), little(width, 4), little(-height, 4), little(F.lit(1), 2), little(F.lit(24), 2), *(little(zero, 4) for _ in range(6))]
    return F.concat(*header, F.unhex(F.array_join(rows, "")))


def write_files(df: DataFrame, folder: str) -> DataFrame:
    """Writes rows (name, content) below a folder that all executors share and returns (name, path, bytes).

    A file gets its name when it is whole, so an attempt that is lost or repeated leaves no part of a file."""

    def run(batches):
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder.rstrip("/"))
        made = set()
        for batch in batches:
            paths, sizes = [], []
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True):
                path, place = f"{folder.rstrip('/')}/{name}", f"{root}/{name}"
                parent = place.rsplit("/", 1)[0]
                if parent not in made:
                    system.create_dir(parent, recursive=True)
                    made.add(parent)
                attempt = f"{place}.{uuid.uuid4().hex}"
                with system.open_output_stream(attempt) as out:
                    out.write(content)
                system.move(attempt, place)
                paths.append(path)
                sizes.append(len(content))
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(paths, type=pa.string()), pa.array(sizes, type=pa.int64())], names=["name", "path", "bytes"])

    return df.select("name", "content").mapInArrow(run, "name string, path string, bytes long")


def dealt(files: DataFrame) -> DataFrame:
    """A written table (name, bytes) in partitions of at most about ``TASK_FILES`` files and ``TASK_BYTES`` bytes."""
    n, size = files.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    return files.repartition(max(1, -(-n // TASK_FILES), -(-size // TASK_BYTES)))


def decoded(content: bytes) -> tuple[int, int, bytes]:
    """Width, height and the pixels of a bitmap of 24 bits a pixel, rows from the top. Other kinds are refused."""
    kind, start, width, height, _, bits, packed = struct.unpack_from("<2s8xI4xiiHHI", content)
    if (kind, bits, packed) != (b"BM", 24, 0):
        raise ValueError(f"no uncompressed bitmap of 24 bits: {kind!r}, {bits} bits, compression {packed}")
    line, lines = 3 * width, abs(height)
    size = line + -line % 4
    rows = np.frombuffer(content, dtype=np.uint8, count=size * lines, offset=start).reshape(lines, size)[:, :line]
    return width, lines, (rows if height < 0 else rows[::-1]).tobytes()


def read_files(files: DataFrame, folder: str) -> DataFrame:
    """Rows (name) of bitmaps below a folder -> name, width, height, channels and the decoded bytes, as Spark's image source gives them.

    Files are opened by the tasks that hold their names, so the driver's memory doesn't depend on their number."""

    def batched(rows):
        return pa.RecordBatch.from_arrays([pa.array(x, type=kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=["name", "width", "height", "channels", "data"])

    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]

    def run(batches):
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder.rstrip("/"))
        found, size = [], 0
        for batch in batches:
            for name in batch.column("name").to_pylist():
                with system.open_input_file(f"{root}/{name}") as own:
                    width, height, data = decoded(own.read())
                found.append((name, width, height, 3, data))
                size += len(data)
                if size >= BATCH_BYTES:
                    yield batched(found)
                    found, size = [], 0
        if found:
            yield batched(found)

    return files.select("name").mapInArrow(run, IMAGE)
