"""Overlap of objects: boxes, masks as spans of scan lines, and one-to-one matches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.functions import rings
from marlstone.functions.geometry import clipped_at, common_area
from marlstone.sources.tables import written

#: Side of a grid cell, in pixels.
CELL = 256


def clipped(df: DataFrame, polygon: str, x1: str, y1: str, x2: str, y2: str) -> DataFrame:
    """Replaces a polygon column by its part in a rectangle; a projection for each of the four edges, so none is computed twice."""
    for axis, bound, above in ((1, x1, True), (1, x2, False), (2, y1, True), (2, y2, False)):
        df = df.withColumn(polygon, clipped_at(F.col(polygon), axis, F.col(bound).cast("double"), above))
    return df


def _renamed(df: DataFrame, side: str) -> DataFrame:
    return df.select("image_id", *(F.col(c).alias(f"{side}_{c}") for c in df.columns if c != "image_id"))


def _overlap(a: str, b: str):
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(f"{a}_{hi}", f"{b}_{hi}") - F.greatest(f"{a}_{lo}", f"{b}_{lo}"))
    return side("bx1", "bx2") * side("by1", "by2")


def overlapping_boxes(objects: DataFrame) -> DataFrame:
    """Pairs of an image's objects whose boxes share an area: left before right, overlap. Only overlapping pairs leave the join."""
    return _meeting(objects.select("image_id", "object_id", "category", "bx1", "by1", "bx2", "by2"))


def overlapping_polygons(objects: DataFrame) -> DataFrame:
    """Pairs of an image's objects whose polygons share an area of over 1e-6, the exact ``area``; computed only where the boxes do."""
    pairs = _meeting(objects.select("image_id", "object_id", "category", "polygon", "bx1", "by1", "bx2", "by2"))
    return pairs.withColumn("area", common_area(F.col("left_polygon"), F.col("right_polygon"))).where("area > 1e-6").drop("left_polygon", "right_polygon", "overlap")


def _meeting(objects: DataFrame) -> DataFrame:
    a, b = _renamed(objects, "left"), _renamed(objects, "right")
    meet = (F.col("left_object_id") < F.col("right_object_id")) & (F.col("left_bx1") < F.col("right_bx2")) & (F.col("right_bx1") < F.col("left_bx2")) & (F.col("left_by1") < F.col("right_by2")) & (F.col("right_by1") < F.col("left_by2"))
    return _in_cells(a, b, "left", "right").where(meet).withColumn("overlap", _overlap("left", "right")).where("overlap > 1e-6")


def _in_cells(a: DataFrame, b: DataFrame, left: str, right: str) -> DataFrame:
    """Pairs of boxes of an image, each pair once: where both cover the cell that their overlap begins in. So an image of many objects isn't one key of all its pairs."""

    def dealt(df: DataFrame, side: str) -> DataFrame:
        cell = lambda c: F.floor(F.col(f"{side}_{c}") / CELL)
        own = df.where((F.col(f"{side}_bx1") < F.col(f"{side}_bx2")) & (F.col(f"{side}_by1") < F.col(f"{side}_by2")))
        return own.withColumn("__cx", F.explode(F.sequence(cell("bx1"), cell("bx2")))).withColumn("__cy", F.explode(F.sequence(cell("by1"), cell("by2"))))

    begins = lambda c: F.floor(F.greatest(f"{left}_{c}", f"{right}_{c}") / CELL)
    own = dealt(a, left).join(dealt(b, right), ["image_id", "__cx", "__cy"])
    return own.where((F.col("__cx") == begins("bx1")) & (F.col("__cy") == begins("by1"))).drop("__cx", "__cy")


def box_iou(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """image_id, pred_id, gt_id, iou of boxes that overlap."""
    columns = ["image_id", "object_id", "bx1", "by1", "bx2", "by2"]
    own = _in_cells(_renamed(predicted.select(columns), "a"), _renamed(truth.select(columns), "b"), "a", "b").withColumn("o", _overlap("a", "b")).where("o > 0")
    size = lambda s: (F.col(f"{s}_bx2") - F.col(f"{s}_bx1")) * (F.col(f"{s}_by2") - F.col(f"{s}_by1"))
    return own.select("image_id", F.col("a_object_id").alias("pred_id"), F.col("b_object_id").alias("gt_id"), (F.col("o") / (size("a") + size("b") - F.col("o"))).alias("iou"))


def box_spans(objects: DataFrame, keep: list[str] = []) -> DataFrame:  # noqa: B006
    """Boxes of whole numbers as spans: image_id, object_id, ``keep``, y, x0, x1 (half open)."""
    rows = F.explode(F.sequence(F.col("by1").cast("int"), F.col("by2").cast("int") - 1))
    return objects.select("image_id", "object_id", *keep, rows.alias("y"), F.col("bx1").cast("long").alias("x0"), F.col("bx2").cast("long").alias("x1"))


def polygon_spans(objects: DataFrame) -> DataFrame:
    """Even-odd filling at pixel centres: the crossings of each scan line, sorted and paired; empty spans go."""

    def run(batches):
        for batch in batches:
            for rows, points in rings.rings(batch.column("polygon")):
                for ring, y, x0, x1 in rings.spans(points):
                    at = pa.array(rows[ring])
                    yield pa.RecordBatch.from_arrays([batch.column("image_id").take(at), batch.column("object_id").take(at), pa.array(y.astype(np.int32)), pa.array(x0), pa.array(x1)], names=names)

    names = ["image_id", "object_id", "y", "x0", "x1"]
    own = objects.where(F.size("polygon") >= 3).select("image_id", "object_id", F.col("polygon").cast("array<array<double>>").alias("polygon"))
    keys = [own.schema[c] for c in names[:2]]
    return own.mapInArrow(run, T.StructType([*keys, T.StructField("y", T.IntegerType()), T.StructField("x0", T.LongType()), T.StructField("x1", T.LongType())]))


def mask_scores(spans: DataFrame, keys: list[str], smooth: float = 1e-5) -> DataFrame:
    """Dice and IoU per key of the two masks of spans (keys, y, x0, x1, predicted); spans of a mask may overlap.

    A scan line is swept once along the ends of its spans, counting how many of each mask are open; so rows that are already together
    by image aren't moved again."""
    side = F.when(F.col("predicted"), 1).otherwise(0)
    ends = F.explode(F.array(F.struct(F.col("x0").alias("x"), side.alias("p"), (1 - side).alias("g")), F.struct(F.col("x1").alias("x"), (-side).alias("p"), (side - 1).alias("g")))).alias("e")
    w = W.partitionBy(*keys, "y").orderBy("x")
    so_far = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    swept = spans.select(*keys, "y", ends).select(*keys, "y", "e.*").select(*keys, F.coalesce(F.lead("x").over(w) - F.col("x"), F.lit(0)).alias("dx"), (F.sum("p").over(so_far) > 0).alias("p"), (F.sum("g").over(so_far) > 0).alias("g"))
    length = lambda open_: F.sum(F.when(open_, F.col("dx")).otherwise(0))
    own = swept.groupBy(*keys).agg(length(F.col("p") & F.col("g")).alias("i"), length(F.col("p")).alias("p"), length(F.col("g")).alias("g"))
    i, p, g = F.col("i"), F.col("p"), F.col("g")
    return own.select(*keys, ((2 * i + smooth) / (p + g + smooth)).alias("dice"), ((i + smooth) / (p + g - i + smooth)).alias("iou"))


def dice(predicted: DataFrame, truth: DataFrame, keys: list[str], smooth: float = 1e-5) -> DataFrame:
    """Dice and IoU of two masks per key."""
    one = lambda df, side: df.select(*keys, "y", "x0", "x1", F.lit(side).alias("predicted"))
    return mask_scores(one(predicted, True).unionByName(one(truth, False)), keys, smooth)


#: Pairs that one pass in order is enough for.
FEW_PAIRS = 1_000_000


def greedy_matches(pairs: DataFrame) -> DataFrame:
    """One-to-one matches by falling ``iou``, ties by (pred_id, gt_id).

    Very many pairs are first thinned in rounds that take the pairs which are best for both sides (what the greedy order takes,
    too), as long as a round settles a quarter of what is left. The rest, such as chains of ever better pairs, is walked in order,
    image by image, in one sorted pass that holds the ids taken in one image."""
    order = lambda key: W.partitionBy("image_id", key).orderBy(F.desc("iou"), "pred_id", "gt_id")
    found, left = [], written(pairs, "pairs")
    n = left.count()
    while n > FEW_PAIRS:
        best = written(left.withColumn("__p", F.row_number().over(order("pred_id"))).withColumn("__g", F.row_number().over(order("gt_id"))).where("__p = 1 AND __g = 1").drop("__p", "__g"), "best")
        found.append(best)
        left = written(left.join(best.select("image_id", "pred_id"), ["image_id", "pred_id"], "left_anti").join(best.select("image_id", "gt_id"), ["image_id", "gt_id"], "left_anti").select(pairs.columns), "left")
        before, n = n, left.count()
        if 4 * n > 3 * before:
            break

    def walked(batches):
        image, taken, own = None, set(), set()
        for batch in batches:
            keep = []
            for i, p, g in zip(batch["image_id"], batch["pred_id"], batch["gt_id"], strict=True):
                if i != image:
                    image, taken, own = i, set(), set()
                keep.append(p not in taken and g not in own)
                if keep[-1]:
                    taken.add(p)
                    own.add(g)
            yield batch[keep]

    rest = left.repartition("image_id").sortWithinPartitions("image_id", F.desc("iou"), "pred_id", "gt_id").mapInPandas(walked, left.schema)
    for best in found:
        rest = rest.unionByName(best)
    return rest


def match_summary(matches: DataFrame, predicted: DataFrame, truth: DataFrame, by: str = "category") -> DataFrame:
    """Per class: gt, pred, matched, precision, recall, mean IoU, false positives and negatives. matches carry the class."""
    n = lambda df, name: df.groupBy(by).agg(F.count("*").alias(name))
    own = n(truth, "gt").join(n(predicted, "pred"), by, "full").join(matches.groupBy(by).agg(F.count("*").alias("matched"), F.avg("iou").alias("mean_iou")), by, "left").na.fill(0, ["gt", "pred", "matched"])
    return own.select(by, "gt", "pred", "matched", F.coalesce(F.try_divide(F.col("matched"), F.col("pred")), F.lit(0.0)).alias("precision"), F.coalesce(F.try_divide(F.col("matched"), F.col("gt")), F.lit(0.0)).alias("recall"), F.coalesce("mean_iou", F.lit(0.0)).alias("mean_iou"), (F.col("pred") - F.col("matched")).alias("false_positives"), (F.col("gt") - F.col("matched")).alias("false_negatives"))


def mean_over_images(scores: DataFrame, by: str = "category") -> DataFrame:
    """scores (image_id, class, dice, iou) of images where the class is in either mask: mean per class and number of images."""
    return scores.groupBy(by).agg(F.avg("dice").alias("dice"), F.avg("iou").alias("iou"), F.count("*").alias("images"))
