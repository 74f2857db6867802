"""Pictures as many files: read by name, not listed by the driver."""

import os
import struct

import numpy as np
import pytest
from pyspark.sql import DataFrameReader
from pyspark.sql import functions as F

from marlstone.plans import registry
from marlstone.sources import bitmaps, pixels
from marlstone.sources.tables import written

DATA = "/root/testdata/sf0.001"


def bmp(image, upwards=False, bits=24):
    """A bitmap of an array (rows, columns, blue green red), rows from the bottom if ``upwards``."""
    height, width, _ = image.shape
    rows = [r.tobytes() + bytes(-3 * width % 4) for r in (image[::-1] if upwards else image)]
    body = b"".join(rows)
    return struct.pack("<2sIIIIiiHHIIIIII", b"BM", 54 + len(body), 0, 54, 40, width, height if upwards else -height, 1, bits, 0, 0, 0, 0, 0, 0) + body


def test_bitmaps_read_by_name_are_those_of_the_image_source(spark, tmp_path):
    rng = np.random.default_rng(3)
    folder, names = f"file://{tmp_path}/p", [f"{k % 2}/{k}.bmp" for k in range(9)]
    rows = [(n, bmp(rng.integers(0, 256, (3 + k, 1 + k, 3), dtype=np.uint8), k % 3 == 0)) for k, n in enumerate(names)]
    own = spark.createDataFrame(rows, "name string, content binary").repartition(3)
    files = written(bitmaps.write_files(own, folder), "files")
    # what a lost attempt left isn't a picture
    (tmp_path / "p" / "0" / "0.bmp.4f").write_bytes(rows[0][1][:60])
    got = {r.name: (r.width, r.height, r.channels, bytes(r.data)) for r in bitmaps.read_files(bitmaps.dealt(files), folder).collect()}
    (tmp_path / "p" / "0" / "0.bmp.4f").unlink()
    listed = pixels.read_images(spark, f"{folder}/*").collect()
    assert got == {"/".join(r.path.split("/")[-2:]): (r.width, r.height, r.channels, bytes(r.data)) for r in listed} and len(got) == 9
    assert bitmaps.dealt(files.limit(0)).rdd.getNumPartitions() == 1
    with pytest.raises(ValueError):
        bitmaps.decoded(bmp(np.zeros((2, 2, 3), dtype=np.uint8), bits=8))


def test_files_are_dealt_out_by_number_and_bytes(spark):
    parts = lambda n, size: bitmaps.dealt(spark.range(n).select(F.col("id").cast("string").alias("name"), F.lit(size).cast("long").alias("bytes"))).rdd.getNumPartitions()
    assert (parts(10, 100), parts(3 * bitmaps.TASK_FILES, 100), parts(8, bitmaps.TASK_BYTES // 2)) == (1, 3, 4)


def test_strip_statistics_are_those_of_all_pixels_of_long_strips(spark, tmp_path):
    rng = np.random.default_rng(4)
    # lighter to the right and downwards, so that spaced pixels have other means; strips of more and of fewer pixels than a block
    boxes, sizes = {"1.bmp": (40, 30, 60, 500), "2.bmp": (0, 0, 200, 1), "3.bmp": (1, 2, 7, 9)}, {"1.bmp": (700, 900), "2.bmp": (150, 200), "3.bmp": (12, 8)}
    images = {n: ((np.add.outer(np.arange(h), np.arange(w))[:, :, None] * 150 // (h + w)) + rng.integers(0, 100, (h, w, 3))).astype(np.uint8) for n, (h, w) in sizes.items()}
    folder = f"file://{tmp_path}/p"
    files = written(bitmaps.write_files(spark.createDataFrame([(n, bmp(x)) for n, x in images.items()], "name string, content binary"), folder), "files")
    side = lambda k: F.element_at(F.create_map(*(F.lit(x) for n, b in boxes.items() for x in (n, b[k]))), F.col("name"))
    own = bitmaps.read_files(files.coalesce(1), folder).select("*", F.col("name").alias("path"), *(side(k).alias(n) for k, n in enumerate(("left", "top", "right", "bottom"))))
    rows = pixels.strip_statistics(own).collect()
    assert len(rows) == 3
    for r in rows:
        image, (left, top, right, bottom) = images[r.path], boxes[r.path]
        inside = lambda t, le, b, rt: np.pad(np.ones((max(0, b - t), max(0, rt - le)), dtype=bool), ((t, image.shape[0] - max(t, b)), (le, image.shape[1] - max(le, rt))))  # noqa: B023, E731
        wide, box = max(1, round(min(image.shape[:2]) * 0.03)), max(1, round(min(right - left, bottom - top) * 0.03))
        whole, roi = inside(0, 0, *image.shape[:2]), inside(top, left, bottom, right)
        masks = [whole & ~inside(wide, wide, image.shape[0] - wide, image.shape[1] - wide), whole & ~roi, roi & ~inside(top + box, left + box, bottom - box, right - box)]
        for part, mask in zip(pixels.GROUPS, masks, strict=True):
            v = image[mask][:, ::-1].astype(float)
            light, high, low = v @ [0.2126, 0.7152, 0.0722], v.max(1), v.min(1)
            shares = [(high < 16).mean(), (low > 240).mean(), (high - low < 3).mean(), ((high - low > 64) & (high > 128)).mean()]
            want = [*v.mean(0) / 255, light.mean() / 255, *v.std(0) / 255, light.std() / 255, *shares]
            # a box of one row has the same pixels above and below its inner box
            if part != "roi_border" or min(right - left, bottom - top) > 1:
                assert np.allclose([r[f"{part}_{n}"] for n in pixels.STATISTICS], want, atol=1e-9)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", ["f1_pixel_statistics", "a19_image_source", "e7_border_fill"])
def test_the_driver_lists_no_pictures(spark, monkeypatch, name):
    sources, form = [], DataFrameReader.format
    monkeypatch.setattr(DataFrameReader, "format", lambda self, source: sources.append(source) or form(self, source))
    assert registry.QUERIES[name](spark, DATA).count()
    assert not {"image", "binaryFile"} & set(sources)
