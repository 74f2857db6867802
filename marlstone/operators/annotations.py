"""Nested annotation documents: cleaning, audits, work lists and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlstone.functions import geometry as G
from marlstone.functions import labels as L
from marlstone.functions.draws import running_sums
from marlstone.sources.tables import written

DOCUMENT = "struct<objects: array<struct<object_id: int, category: string, segmentation: array<array<double>>, bbox: array<double>, area: double>>>"


def numbered(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """Numbers rows from 1 in each group; a group is one image's objects."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(group).orderBy(*order)))


def nested(objects: DataFrame) -> DataFrame:
    """Rows per object -> one document per image, objects in order."""
    item = F.struct("object_id", F.col("raw").alias("category"), F.col("polygon").alias("segmentation"), "bbox", "area")
    return objects.groupBy("image_id").agg(F.array_sort(F.collect_list(item)).alias("objects"))


def parsed(documents: DataFrame, column: str) -> DataFrame:
    """JSON text -> ``parsed``, by a fixed schema; null if it isn't JSON."""
    return documents.withColumn("parsed", F.from_json(column, DOCUMENT))


def normalised(documents: DataFrame) -> DataFrame:
    """Categories fixed inside the array, and the map of changed labels."""
    pairs = F.array_distinct(F.filter(F.transform("objects", lambda o: F.struct(o["category"].alias("key"), L.fixed(o["category"]).alias("value"))), lambda p: p["key"] != p["value"]))
    return documents.withColumn("changes", F.map_from_entries(pairs)).withColumn("objects", F.transform("objects", lambda o: o.withField("category", L.fixed(o["category"]))))


def geometry_signature(objects: str) -> Column:
    """A digest of all but the categories."""
    return F.sha2(F.to_json(F.transform(objects, lambda o: o.dropFields("category"))), 256)


def cleaning_audit(objects: DataFrame) -> DataFrame:
    """Changed labels: objects, files, whether the raw label is suspicious."""
    return objects.where("raw != category").groupBy("raw", "category").agg(F.count("*").alias("objects"), F.countDistinct("image_id").alias("files"), F.max(F.col("raw").isin(L.SUSPICIOUS)).alias("suspicious"))


def normalisation_gate(objects: DataFrame, categories: int) -> DataFrame:
    counts = objects.groupBy("category").agg(F.count("*").alias("n"), F.max(L.disease(F.col("category")).isNotNull()).alias("prefixed"))
    own = counts.agg(F.count("*").cast("double").alias("c"), F.sum(F.when(F.col("prefixed"), F.col("n")).otherwise(0)).cast("double").alias("r"))
    rows = F.array(F.struct(F.lit("categories").alias("gate"), F.col("c").alias("value"), (F.col("c") == categories).alias("passed")), F.struct(F.lit("residual_prefix").alias("gate"), F.col("r").alias("value"), (F.col("r") == 0).alias("passed")))
    return own.select(F.explode(rows).alias("x")).select("x.*")


def marked_reviewed(documents: DataFrame) -> DataFrame:
    """Sets the flag where a rect is there and the flag is not; ``outcome`` tells."""
    todo = F.col("ultrasound_rect").isNotNull() & ~F.coalesce("ultrasound_rect_reviewed", F.lit(False))
    return documents.withColumn("outcome", F.when(todo, "updated").otherwise("skipped")).withColumn("ultrasound_rect_reviewed", F.when(todo, True).otherwise(F.col("ultrasound_rect_reviewed")))


def work_lists(documents: DataFrame) -> DataFrame:
    """(list, image_id) of the lists that each document is on."""
    rect, reviewed = F.col("ultrasound_rect").isNotNull(), F.coalesce("ultrasound_rect_reviewed", F.lit(False))
    lists = F.array_compact(F.array(F.lit("all"), F.when(~rect, "no_rect"), F.when(rect & ~reviewed, "rect_not_reviewed")))
    return documents.select(F.explode(lists).alias("list"), "image_id")


def with_rect(documents: DataFrame, x1: str, y1: str, x2: str, y2: str) -> DataFrame:
    """Writes a rounded rect with its size, marks it reviewed, drops ``cropped``."""
    a, b, c, d = (F.bround(v).cast("int") for v in (x1, y1, x2, y2))
    rect = F.struct(a.alias("x1"), b.alias("y1"), c.alias("x2"), d.alias("y2"), (c - a).alias("width"), (d - b).alias("height"))
    return documents.withColumn("ultrasound_rect", rect).withColumn("ultrasound_rect_reviewed", F.lit(True)).drop("cropped")


def majority_class(objects: DataFrame) -> DataFrame:
    """The class most objects' prefixes name; ties go to the smaller name, none is ``unknown``."""
    own = objects.select("image_id", L.disease(F.col("raw")).alias("disease")).groupBy("image_id", "disease").agg(F.count("*").alias("n"))
    best = own.groupBy("image_id").agg(F.min(F.when(F.col("disease").isNotNull(), F.struct((-F.col("n")).alias("n"), "disease"))).alias("b"))
    return best.select("image_id", F.coalesce("b.disease", F.lit("unknown")).alias("disease"))


def with_box(objects: DataFrame) -> DataFrame:
    box = G.box_xyxy(F.col("polygon"))
    return objects.withColumn("__b", box).select("*", *(F.element_at("__b", k + 1).alias(n) for k, n in enumerate(("bx1", "by1", "bx2", "by2")))).drop("__b")


def object_flags(joined: DataFrame) -> DataFrame:
    """joined: objects with their image's width, height and ROI."""
    own = with_box(joined).withColumn("__area", G.area(F.col("polygon")))
    apart = F.greatest(*(F.abs(F.element_at("bbox", k + 1) - F.col(n)) for k, n in enumerate(("bx1", "by1", "bx2", "by2"))))
    missing = F.col("area").isNull() | (F.col("area") <= 0)
    flags = {
        "outside_image": (F.col("bx1") < 0) | (F.col("by1") < 0) | (F.col("bx2") > F.col("width")) | (F.col("by2") > F.col("height")),
        "not_inside_roi": (F.col("bx1") < F.col("x1")) | (F.col("by1") < F.col("y1")) | (F.col("bx2") > F.col("x2")) | (F.col("by2") > F.col("y2")),
        "bbox_mismatch": apart > 2.0,
        "area_missing": missing,
        "area_mismatch": ~missing & (F.abs(F.col("area") - F.col("__area")) / F.greatest("__area", F.lit(1.0)) > 0.05),
    }
    return own.select("image_id", "object_id", *(F.coalesce(c, F.lit(False)).alias(n) for n, c in flags.items()))


def flag_counts(flags: DataFrame) -> DataFrame:
    names = [c for c in flags.columns if c not in ("image_id", "object_id")]
    return flags.agg(F.count("*").alias("objects"), *(F.sum(F.col(n).cast("long")).alias(n) for n in names))


def category_pairs(objects: DataFrame) -> DataFrame:
    """Images in which two categories stand together; pairs are made inside an image from its few categories."""
    own = objects.groupBy("image_id").agg(F.array_sort(F.collect_set("category")).alias("c"))
    pairs = F.flatten(F.transform("c", lambda a, i: F.transform(F.slice(F.col("c"), i + 2, F.size("c")), lambda b: F.struct(a.alias("left"), b.alias("right")))))
    return own.select(F.explode(pairs).alias("p")).groupBy("p.left", "p.right").agg(F.count("*").alias("images"))


def presence_matrix(joined: DataFrame, columns: dict[str, str]) -> DataFrame:
    return joined.groupBy("person_key").agg(*(F.max((F.col("category") == c).cast("int")).alias(n) for n, c in columns.items()))


def category_support(joined: DataFrame, folds: int, robust: tuple[int, int], limited: tuple[int, int]) -> DataFrame:
    """Per category: objects, images, people, least people of a fold, top class and share, tier. Thresholds: (people, people of a fold).

    Distinct people and images are made first, so each count is a plain sum."""
    objects = joined.groupBy("category").agg(F.count("*").alias("objects"))
    images = joined.select("category", "image_id").distinct().groupBy("category").agg(F.count("*").alias("images"))
    people = joined.select("category", "person_key", "diagnosis", "outer_fold").distinct()
    counts = people.groupBy("category").agg(F.count("*").alias("people"), F.least(*(F.sum((F.col("outer_fold") == k).cast("long")) for k in range(folds))).alias("least_fold"))
    top = people.groupBy("category", "diagnosis").agg(F.count("*").alias("n")).groupBy("category").agg(F.max(F.struct("n", "diagnosis")).alias("t"))
    own = objects.join(images, "category").join(counts, "category").join(top, "category")
    fits = lambda t: (F.col("people") >= t[0]) & (F.col("least_fold") >= t[1])
    tier = F.when(fits(robust), "robust_multifold").when(fits(limited), "limited_multifold").otherwise("insufficient_multifold")
    return own.select("category", "objects", "images", "people", "least_fold", F.col("t.diagnosis").alias("top_diagnosis"), (F.col("t.n") / F.col("people")).alias("top_share"), tier.alias("tier"))


def coverage(images: DataFrame, objects: DataFrame) -> DataFrame:
    """Images, those with objects, annotated keys without an image, share covered."""
    own = images.select("image_id", F.lit(1).alias("i")).join(objects.select("image_id", F.lit(1).alias("o")).distinct(), "image_id", "full")
    both = F.col("i").isNotNull() & F.col("o").isNotNull()
    return own.agg(F.count("i").alias("images"), F.sum(both.cast("long")).alias("with_objects"), F.sum(F.col("i").isNull().cast("long")).alias("unlinked"), (F.sum(both.cast("long")) / F.count("i")).alias("coverage"))


def dictionary(df: DataFrame, column: str) -> DataFrame:
    """Distinct values in order with dense ids from 0; one row per value from the aggregation on."""
    return df.select(column).distinct().select(column, (F.row_number().over(W.partitionBy(F.lit(0)).orderBy(column)) - 1).cast("int").alias(f"{column}_id"))


def _positions(df: DataFrame, key: str, name: str, width: int = 10_000) -> DataFrame:
    """Positions from 1 by a whole-number key: sums inside ranges of the key and over the ranges, not one window over all rows."""
    own = running_sums(df.select(key).withColumn("__one", F.lit(1)), [], key, F.floor(F.col(key) / width), ["__one"])
    return own.select(key, (F.col("before___one") + 1).alias(name))


def detection_rows(images: DataFrame, objects: DataFrame, categories: DataFrame) -> DataFrame:
    """One row per object with running ids over the split; image numbers are places among all images.

    An image's place and the number of objects before it are summed together, so objects meet one small table."""
    # written, so that Spark knows how few categories are and leaves the objects where they are
    kept = objects.where(F.size("polygon") >= 3).join(written(categories, "categories"), "category")
    counts = kept.groupBy("image_id").agg(F.count("*").alias("__n"))
    own = images.select("image_id").join(counts, "image_id", "left").select("image_id", F.coalesce("__n", F.lit(0)).alias("__n"), F.lit(1).alias("__one"))
    places = running_sums(own, [], "image_id", F.floor(F.col("image_id") / 10_000), ["__one", "__n"]).where("__n > 0")
    own = with_box(kept).join(places.select("image_id", "before___one", "before___n"), "image_id")
    order = F.row_number().over(W.partitionBy("image_id").orderBy("object_id"))
    return own.select((F.col("before___n") + order).alias("annotation_id"), (F.col("before___one") + 1).alias("image_no"), "category_id", G.area(F.col("polygon")).alias("area"), F.col("bx1").alias("x"), F.col("by1").alias("y"), (F.col("bx2") - F.col("bx1")).alias("w"), (F.col("by2") - F.col("by1")).alias("h"), F.lit(0).alias("iscrowd"))


def polygon_text(images: DataFrame, objects: DataFrame, categories: DataFrame) -> DataFrame:
    """One text per image: a line of class id and normalised points per object, empty where there is none."""
    own = objects.join(written(categories, "categories"), "category").join(images.select("image_id", "width", "height"), "image_id")
    share = lambda v, n: F.format_string("%.6f", F.least(F.greatest(v / F.col(n), F.lit(0.0)), F.lit(1.0)))
    points = F.flatten(F.transform("polygon", lambda p: F.array(share(F.element_at(p, 1), "width"), share(F.element_at(p, 2), "height"))))
    lines = own.select("image_id", "object_id", F.concat_ws(" ", F.col("category_id").cast("string"), F.array_join(points, " ")).alias("line"))
    body = lines.groupBy("image_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("object_id", "line"))), lambda x: x["line"]), "\n").alias("body"))
    return images.select("image_id").join(body, "image_id", "left").select("image_id", F.coalesce("body", F.lit("")).alias("body"))


def case_rows(images: DataFrame) -> DataFrame:
    """Numbered cases; train and val are one part."""
    places = _positions(images, "image_id", "__no")
    return images.join(places, "image_id").select("image_id", F.concat(F.lit("case_"), F.lpad((F.col("__no") - 1).cast("string"), 5, "0")).alias("case_name"), F.when(F.col("split") == "test", "test").otherwise("train").alias("part"))


def prompt_rows(objects: DataFrame) -> DataFrame:
    """One mask name and box per object."""
    own = with_box(objects)
    return own.select("image_id", "object_id", F.col("bx1").alias("x1"), F.col("by1").alias("y1"), F.col("bx2").alias("x2"), F.col("by2").alias("y2"), F.concat_ws("_", F.lit("mask"), F.col("image_id").cast("string"), F.col("object_id").cast("string")).alias("mask_name"))
