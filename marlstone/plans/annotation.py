"""Nested annotations: labels (C), geometry (D), overlap and support (D, F), exports (A13-A17)."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions import geometry as G
from marlstone.functions import labels as L
from marlstone.operators import annotations as A
from marlstone.operators import overlap as O
from marlstone.plans import bindings as B
from marlstone.plans.book import Book

book = Book()
# Label words as annotators write them, right and wrong.
PREFIXES = ["N", "RA", "OA", "GA", "SPA-", "损伤-", "滑膜囊肿-", ""]
NAMES = ["骨皮质", "积液", "腘窝囊肿", "髌骨前浅筋膜", "髌前浅筋膜", "股二头肌腱", "内侧半月板", "内测半月板", "髌下深囊炎", "股二头肌建", "内测副韧带", "滑膜那种"]


def objects(spark, d):
    """One row per line item: an object of its order's image."""
    # numbered first: what moves is a few numbers of a line item, and the polygon is made where they are
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    li = A.numbered(B.table(spark, d, "lineitem").select("l_orderkey", *order), "l_orderkey", order, "object_id")
    pick = lambda values, n: F.element_at(F.array(*(F.lit(v) for v in values)), (n % len(values) + 1).cast("int"))
    x0, y0 = (F.col("l_linenumber") * 10).cast("double"), F.floor("l_quantity").cast("double")
    w, h = (1 + F.col("l_partkey") % 20).cast("double"), (1 + F.col("l_suppkey") % 15).cast("double")
    points = F.array(F.array(x0, y0), F.array(x0 + w, y0), F.array(x0 + w, y0 + h), F.array(x0, y0 + h))
    polygon = F.when(F.col("l_partkey") % 5 == 0, F.slice(points, 1, 3)).otherwise(points)
    raw = F.concat(pick(PREFIXES, F.col("l_partkey")), pick(NAMES, F.col("l_suppkey")))
    return li.select(
        F.col("l_orderkey").alias("image_id"), "object_id", raw.alias("raw"), polygon.alias("polygon"), F.array(x0, y0, x0 + w + (F.col("l_partkey") % 4).cast("double"), y0 + h).alias("bbox"),
        F.when(F.col("l_partkey") % 7 > 0, w * h).alias("area"), L.fixed(raw).alias("category"),
    )


def images(spark, d):
    o = B.table(spark, d, "orders")
    k = F.col("o_orderkey")
    return o.select(
        k.alias("image_id"), F.concat(F.lit("P"), F.col("o_custkey").cast("string")).alias("person_key"), (60 + k % 41).cast("int").alias("width"), (40 + k % 31).cast("int").alias("height"),
        (k % 9).cast("double").alias("x1"), (k % 7).cast("double").alias("y1"), (45 + k % 50).cast("double").alias("x2"), (30 + k % 45).cast("double").alias("y2"), (k % 3 > 0).alias("reviewed"),
    )


OBJ = f"""raws AS (SELECT l_orderkey AS image_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS INTEGER) AS object_id,
 {PREFIXES}[l_partkey % 8 + 1] || {NAMES}[l_suppkey % 12 + 1] AS raw, CAST(l_linenumber * 10 AS DOUBLE) AS x0, floor(l_quantity) AS y0, CAST(1 + l_partkey % 20 AS DOUBLE) AS w, CAST(1 + l_suppkey % 15 AS DOUBLE) AS h, l_partkey % 5 = 0 AS tri, l_partkey % 4 AS extra, l_partkey % 7 AS m7 FROM lineitem),
fixes(a, b) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in L.FIXES.items())}),
bare AS (SELECT r.*, trim(regexp_replace(coalesce(f.b, trim(r.raw)), '^(滑膜囊肿-|损伤-|SPA-|RA|OA|GA|N)', '')) AS name FROM raws r LEFT JOIN fixes f ON f.a = trim(r.raw)),
obj AS (SELECT *, CASE WHEN name = '髌骨前浅筋膜' THEN '髌前浅筋膜' ELSE name END AS category, CASE WHEN tri THEN [[x0, y0], [x0 + w, y0], [x0 + w, y0 + h]] ELSE [[x0, y0], [x0 + w, y0], [x0 + w, y0 + h], [x0, y0 + h]] END AS polygon, [x0, y0, x0 + w + extra, y0 + h] AS bbox, CASE WHEN m7 > 0 THEN w * h END AS area,
 CASE WHEN tri THEN w * h / 2 ELSE w * h END AS true_area FROM bare)"""
IMG = "img AS (SELECT o_orderkey AS image_id, 'P' || o_custkey AS person_key, CAST(60 + o_orderkey % 41 AS INTEGER) AS width, CAST(40 + o_orderkey % 31 AS INTEGER) AS height, CAST(o_orderkey % 9 AS DOUBLE) AS x1, CAST(o_orderkey % 7 AS DOUBLE) AS y1, CAST(45 + o_orderkey % 50 AS DOUBLE) AS x2, CAST(30 + o_orderkey % 45 AS DOUBLE) AS y2, o_orderkey % 3 > 0 AS reviewed FROM orders)"
W_OBJ, W_ALL = f"WITH {OBJ}", f"WITH {OBJ}, {IMG}"


@book("c1_fix_labels", f"{W_OBJ} SELECT raw, category, count(*) AS n FROM obj GROUP BY ALL")
def fix_labels(spark, d):
    return objects(spark, d).groupBy("raw", "category").agg(F.count("*").alias("n"))


PREFIX_CASE = "CASE " + " ".join(f"WHEN starts_with(raw, '{p}') THEN '{c}'" for p, c in L.PREFIXES.items()) + " END"


@book("c2_disease_of_label", f"{W_OBJ} SELECT {PREFIX_CASE} AS disease, count(*) AS n FROM obj GROUP BY ALL")
def disease(spark, d):
    return objects(spark, d).groupBy(L.disease(F.col("raw")).alias("disease")).agg(F.count("*").alias("n"))


@book("c3_anatomy_of_label", f"{W_OBJ} SELECT regexp_replace(raw, '^(滑膜囊肿-|损伤-|SPA-|RA|OA|GA|N)', '') AS anatomy, count(*) AS n FROM obj GROUP BY ALL")
def anatomy(spark, d):
    return objects(spark, d).groupBy(L.anatomy(F.col("raw")).alias("anatomy")).agg(F.count("*").alias("n"))


@book("c4_normalise_documents", f"{W_OBJ} SELECT image_id, CAST(count(*) AS INTEGER) AS n_objects, string_agg(category, ',' ORDER BY object_id) AS categories, CAST(count(DISTINCT raw) FILTER (WHERE raw <> category) AS INTEGER) AS n_changes FROM obj GROUP BY image_id")
def normalise(spark, d):
    own = A.normalised(A.nested(objects(spark, d)))
    return own.select("image_id", F.size("objects").alias("n_objects"), F.array_join(F.transform("objects", lambda o: o["category"]), ",").alias("categories"), F.size(F.map_keys("changes")).alias("n_changes"))


@book("c5_geometry_invariant", f"{W_OBJ} SELECT count(DISTINCT image_id) AS documents, CAST(0 AS BIGINT) AS changed FROM obj")
def geometry_invariant(spark, d):
    own = A.nested(objects(spark, d))
    pairs = own.select("image_id", A.geometry_signature("objects").alias("a")).join(A.normalised(own).select("image_id", A.geometry_signature("objects").alias("b")), "image_id")
    return pairs.agg(F.count("*").alias("documents"), F.sum((F.col("a") != F.col("b")).cast("long")).alias("changed"))


@book("c6_cleaning_audit", f"""{W_OBJ} SELECT raw, category, count(*) AS objects, count(DISTINCT image_id) AS files, bool_or(raw = '滑膜那种') AS suspicious FROM obj WHERE raw <> category GROUP BY ALL""")
def cleaning_audit(spark, d):
    return A.cleaning_audit(objects(spark, d))


@book("c7_normalisation_gate", f"{W_OBJ} SELECT 'categories' AS gate, CAST(count(DISTINCT category) AS DOUBLE) AS value, count(DISTINCT category) = 11 AS passed FROM obj UNION ALL SELECT 'residual_prefix', CAST(count(*) FILTER (WHERE regexp_matches(category, '^(滑膜囊肿-|损伤-|SPA-|RA|OA|GA|N)')) AS DOUBLE), count(*) FILTER (WHERE regexp_matches(category, '^(滑膜囊肿-|损伤-|SPA-|RA|OA|GA|N)')) = 0 FROM obj")
def normalisation_gate(spark, d):
    return A.normalisation_gate(objects(spark, d), 11)


@book("c8_mark_reviewed", f"WITH {IMG} SELECT CASE WHEN image_id % 4 = 0 THEN 'skipped' WHEN reviewed THEN 'skipped' ELSE 'updated' END AS outcome, count(*) AS n FROM img GROUP BY 1")
def mark_reviewed(spark, d):
    own = images(spark, d).select("image_id", F.when(F.col("image_id") % 4 > 0, F.struct("x1", "y1", "x2", "y2")).alias("ultrasound_rect"), F.col("reviewed").alias("ultrasound_rect_reviewed"))
    return A.marked_reviewed(own).groupBy("outcome").agg(F.count("*").alias("n"))


@book("c9_work_lists", f"WITH {IMG} SELECT 'all' AS list, count(*) AS n FROM img UNION ALL SELECT 'no_rect', count(*) FILTER (WHERE image_id % 4 = 0) FROM img UNION ALL SELECT 'rect_not_reviewed', count(*) FILTER (WHERE image_id % 4 > 0 AND NOT reviewed) FROM img")
def work_lists(spark, d):
    own = images(spark, d).select("image_id", F.when(F.col("image_id") % 4 > 0, F.struct("x1", "y1", "x2", "y2")).alias("ultrasound_rect"), F.col("reviewed").alias("ultrasound_rect_reviewed"))
    return A.work_lists(own).groupBy("list").agg(F.count("*").alias("n"))


@book("c10_write_rect", f"WITH {IMG} SELECT image_id, CAST(round_even(x1 + 0.5, 0) AS INTEGER) AS x1, CAST(round_even(y1 / 2, 0) AS INTEGER) AS y1, CAST(round_even(x2 + 0.5, 0) AS INTEGER) - CAST(round_even(x1 + 0.5, 0) AS INTEGER) AS width, CAST(round_even(y2 / 2, 0) AS INTEGER) - CAST(round_even(y1 / 2, 0) AS INTEGER) AS height, true AS reviewed FROM img")
def write_rect(spark, d):
    own = images(spark, d).select("image_id", F.lit(1).alias("cropped"), (F.col("x1") + 0.5).alias("a"), (F.col("y1") / 2).alias("b"), (F.col("x2") + 0.5).alias("c"), (F.col("y2") / 2).alias("e"))
    done = A.with_rect(own, "a", "b", "c", "e")
    return done.select("image_id", "ultrasound_rect.x1", "ultrasound_rect.y1", "ultrasound_rect.width", "ultrasound_rect.height", F.col("ultrasound_rect_reviewed").alias("reviewed"))


@book("c11_majority_class", f"{W_OBJ}, t AS (SELECT image_id, {PREFIX_CASE} AS disease, count(*) AS n FROM obj GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, disease) AS k FROM t WHERE disease IS NOT NULL) SELECT i.image_id, coalesce(r.disease, 'unknown') AS disease FROM (SELECT DISTINCT image_id FROM obj) i LEFT JOIN r ON r.image_id = i.image_id AND r.k = 1")
def majority(spark, d):
    return A.majority_class(objects(spark, d))


@book("d1_polygon_area", f"{W_OBJ} SELECT image_id, object_id, true_area AS polygon_area FROM obj")
def polygon_area(spark, d):
    return objects(spark, d).select("image_id", "object_id", G.area(F.col("polygon")).alias("polygon_area"))


@book("d2_polygon_boxes", f"{W_OBJ} SELECT image_id, object_id, x0 AS x, y0 AS y, w, h, x0 + w AS x2, y0 + h AS y2 FROM obj")
def boxes(spark, d):
    own = objects(spark, d).select("image_id", "object_id", G.box_xywh(F.col("polygon")).alias("a"), G.box_xyxy(F.col("polygon")).alias("b"))
    at = lambda c, k: F.element_at(c, k)
    return own.select("image_id", "object_id", at("a", 1).alias("x"), at("a", 2).alias("y"), at("a", 3).alias("w"), at("a", 4).alias("h"), at("b", 3).alias("x2"), at("b", 4).alias("y2"))


@book("d3_flat_points", f"{W_OBJ} SELECT image_id, object_id, CAST(2 * len(polygon) AS INTEGER) AS n, list_sum(flatten(polygon)) AS total FROM obj")
def flat(spark, d):
    from marlstone.functions.vectors import total

    return objects(spark, d).select("image_id", "object_id", F.size(G.flat(F.col("polygon"))).alias("n"), total(G.flat(F.col("polygon"))).alias("total"))


@book("d4_roi_valid", f"WITH {IMG} SELECT image_id, x1 < x2 AND x2 <= width AND y1 < y2 AND y2 <= height AS roi_valid FROM img")
def roi_valid(spark, d):
    return images(spark, d).select("image_id", G.roi_valid(*(F.col(c) for c in ("x1", "y1", "x2", "y2", "width", "height"))).alias("roi_valid"))


@book("d5_roi_boxes", f"""WITH {IMG}, a AS (SELECT image_id, width, height, least(greatest(CAST(round_even(x1 / 2, 0) AS INTEGER), 0), width - 1) AS l, least(greatest(CAST(round_even(y1 / 2, 0) AS INTEGER), 0), height - 1) AS t, x1 / 2 AS u1, y1 / 2 AS v1, x2 / 2 AS u2, y2 / 2 AS v2 FROM img)
SELECT image_id, l AS "left", t AS top, least(greatest(CAST(round_even(u2, 0) AS INTEGER), l + 1), width) AS "right", least(greatest(CAST(round_even(v2, 0) AS INTEGER), t + 1), height) AS bottom, CAST(floor(u1) AS INTEGER) AS outer_left, CAST(floor(v1) AS INTEGER) AS outer_top, CAST(least(ceil(u2), width) AS INTEGER) AS outer_right, CAST(least(ceil(v2), height) AS INTEGER) AS outer_bottom FROM a""")
def roi_boxes(spark, d):
    half = [F.col(c) / 2 for c in ("x1", "y1", "x2", "y2")]
    size = [F.col("width"), F.col("height")]
    names = ["left", "top", "right", "bottom"]
    return images(spark, d).select("image_id", *(c.alias(n) for c, n in zip(G.clamped_box(*half, *size), names, strict=True)), *(c.alias("outer_" + n) for c, n in zip(G.outer_box(*half, *size), names, strict=True)))


@book("d6_shift_into_roi", f"{W_ALL} SELECT o.image_id, object_id, list_sum(list_transform(polygon, lambda p: least(greatest(p[1] - x1, 0.0), x2 - x1 - 1) * 1000 + least(greatest(p[2] - y1, 0.0), y2 - y1 - 1))) AS total FROM obj o JOIN img USING (image_id)")
def shift(spark, d):
    own = objects(spark, d).join(images(spark, d), "image_id")
    p = G.shifted(F.col("polygon"), F.col("x1"), F.col("y1"), F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    return own.select("image_id", "object_id", F.aggregate(p, F.lit(0.0), lambda s, q: s + F.element_at(q, 1) * 1000 + F.element_at(q, 2)).alias("total"))


@book("d8_clip_to_rectangle", f"{W_ALL} SELECT o.image_id, object_id, round(greatest(0, least(x0 + w, x2) - greatest(x0, x1)) * greatest(0, least(y0 + h, y2) - greatest(y0, y1)), 6) AS clipped_area FROM obj o JOIN img USING (image_id) WHERE NOT tri")
def clip(spark, d):
    own = objects(spark, d).where(F.size("polygon") == 4).join(images(spark, d), "image_id")
    return O.clipped(own, "polygon", "x1", "y1", "x2", "y2").select("image_id", "object_id", F.round(G.area(F.col("polygon")), 6).alias("clipped_area"))


@book("d10_object_flags", f"""{W_ALL} SELECT count(*) AS objects, count(*) FILTER (WHERE x0 + w > width OR y0 + h > height) AS outside_image, count(*) FILTER (WHERE x0 < x1 OR y0 < y1 OR x0 + w > x2 OR y0 + h > y2) AS not_inside_roi,
 count(*) FILTER (WHERE extra > 2) AS bbox_mismatch, count(*) FILTER (WHERE area IS NULL OR area <= 0) AS area_missing, count(*) FILTER (WHERE area > 0 AND abs(area - true_area) / greatest(true_area, 1) > 0.05) AS area_mismatch FROM obj JOIN img USING (image_id)""")
def object_flags(spark, d):
    return A.flag_counts(A.object_flags(objects(spark, d).join(images(spark, d), "image_id")))


@book("d11_category_pairs", f'{W_OBJ}, c AS (SELECT DISTINCT image_id, category FROM obj) SELECT a.category AS "left", b.category AS "right", count(*) AS images FROM c a JOIN c b ON a.image_id = b.image_id AND a.category < b.category GROUP BY ALL')
def category_pairs(spark, d):
    return A.category_pairs(objects(spark, d))


RECT = f"{W_OBJ}, r AS (SELECT * FROM obj WHERE NOT tri), p AS (SELECT a.image_id, a.category AS ca, b.category AS cb, (least(a.x0 + a.w, b.x0 + b.w) - greatest(a.x0, b.x0)) * (least(a.y0 + a.h, b.y0 + b.h) - greatest(a.y0, b.y0)) AS overlap FROM r a JOIN r b ON a.image_id = b.image_id AND a.object_id < b.object_id AND a.x0 < b.x0 + b.w AND b.x0 < a.x0 + a.w AND a.y0 < b.y0 + b.h AND b.y0 < a.y0 + a.h)"


@book("d12_overlapping_pairs", f"{RECT} SELECT CASE WHEN ca = cb THEN 'same' ELSE 'cross' END AS kind, count(*) AS pairs, count(DISTINCT image_id) AS images, round(sum(overlap), 6) AS area FROM p GROUP BY 1")
def overlapping(spark, d):
    pairs = O.overlapping_boxes(A.with_box(objects(spark, d).where(F.size("polygon") == 4)))
    return pairs.groupBy(F.when(F.col("left_category") == F.col("right_category"), "same").otherwise("cross").alias("kind")).agg(F.count("*").alias("pairs"), F.countDistinct("image_id").alias("images"), F.round(F.sum("overlap"), 6).alias("area"))


SPAN_PAIRS = f"""{W_OBJ}, r AS (SELECT *, CASE WHEN tri THEN w / h ELSE 0 END AS s FROM obj),
 p AS (SELECT a, b, greatest(a.y0, b.y0) AS lo, least(a.y0 + a.h, b.y0 + b.h) AS hi, least(a.x0 + a.w, b.x0 + b.w) AS e FROM r a JOIN r b ON a.image_id = b.image_id AND a.object_id < b.object_id AND a.x0 < b.x0 + b.w AND b.x0 < a.x0 + a.w AND a.y0 < b.y0 + b.h AND b.y0 < a.y0 + a.h),
 q AS (SELECT *, list_sort(list_transform([lo, hi, coalesce(a.y0 + (e - a.x0) / nullif(a.s, 0), lo), coalesce(b.y0 + (e - b.x0) / nullif(b.s, 0), lo), coalesce((b.x0 - b.s * b.y0 - a.x0 + a.s * a.y0) / nullif(a.s - b.s, 0), lo)], lambda y: least(greatest(y, lo), hi))) AS ys FROM p),
 m AS (SELECT a, b, e, ys[k + 1] - ys[k] AS dy, (ys[k] + ys[k + 1]) / 2 AS y, lo FROM q, range(1, 5) t(k)),
 o AS (SELECT a.image_id AS image_id, a.object_id AS oa, b.object_id AS ob, any_value(a.category) AS ca, any_value(b.category) AS cb, sum(dy * greatest(0, e - greatest(a.x0 + a.s * (y - a.y0), b.x0 + b.s * (y - b.y0)))) AS area FROM m GROUP BY 1, 2, 3)"""


@book("d12_overlapping_polygons", f"{SPAN_PAIRS} SELECT CASE WHEN ca = cb THEN 'same' ELSE 'cross' END AS kind, count(*) AS pairs, count(DISTINCT image_id) AS images, round(sum(area), 3) AS area FROM o WHERE area > 1e-6 GROUP BY 1")
def overlapping_polygons(spark, d):
    pairs = O.overlapping_polygons(A.with_box(objects(spark, d)))
    return pairs.groupBy(F.when(F.col("left_category") == F.col("right_category"), "same").otherwise("cross").alias("kind")).agg(F.count("*").alias("pairs"), F.countDistinct("image_id").alias("images"), F.round(F.sum("area"), 3).alias("area"))


@book("d13_area_share", f"{W_ALL} SELECT category, round(quantile_cont(true_area / ((x2 - x1) * (y2 - y1)), 0.5), 6) AS median_share FROM obj JOIN img USING (image_id) GROUP BY category")
def area_share(spark, d):
    own = objects(spark, d).join(images(spark, d), "image_id")
    return own.groupBy("category").agg(F.round(F.percentile(G.area(F.col("polygon")) / ((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))), F.lit(0.5)), 6).alias("median_share"))


SPANS = f"{W_OBJ}, r AS (SELECT * FROM obj WHERE NOT tri), a AS (SELECT * FROM r WHERE object_id % 2 = 1), b AS (SELECT * FROM r WHERE object_id % 2 = 0)"


@book("d14_mask_dice", f"""{SPANS}, px AS (SELECT image_id, unnest(range(CAST(x0 AS BIGINT), CAST(x0 + w AS BIGINT))) AS x, y0, h, object_id FROM r), cells AS (SELECT DISTINCT image_id, object_id % 2 AS side, x, unnest(range(CAST(y0 AS BIGINT), CAST(y0 + h AS BIGINT))) AS y FROM px),
 n AS (SELECT image_id, x, y, count(*) FILTER (WHERE side = 1) AS p, count(*) FILTER (WHERE side = 0) AS g FROM cells GROUP BY ALL)
 SELECT image_id, round((2 * sum(p * g) + 1e-5) / (sum(p) + sum(g) + 1e-5), 6) AS dice, round((sum(p * g) + 1e-5) / (sum(p) + sum(g) - sum(p * g) + 1e-5), 6) AS iou FROM n GROUP BY image_id""")
def mask_dice(spark, d):
    own = A.with_box(objects(spark, d).where(F.size("polygon") == 4))
    spans = O.box_spans(own).withColumn("predicted", F.col("object_id") % 2 == 1)
    return B.rounded(O.mask_scores(spans, ["image_id"]))


@book("d15_greedy_matches", f"""WITH RECURSIVE {SPANS.removeprefix("WITH ")}, pairs AS (SELECT a.image_id, a.object_id AS pred_id, b.object_id AS gt_id, ov / (a.w * a.h + b.w * b.h - ov) AS iou FROM (SELECT a, b, greatest(0, least(a.x0 + a.w, b.x0 + b.w) - greatest(a.x0, b.x0)) * greatest(0, least(a.y0 + a.h, b.y0 + b.h) - greatest(a.y0, b.y0)) AS ov FROM a JOIN b ON a.image_id = b.image_id)),
 c AS (SELECT image_id, list_sort(list({{'o': -iou, 'p': pred_id, 'g': gt_id}})) AS l FROM pairs WHERE iou >= 0.1 GROUP BY image_id),
 s AS (SELECT image_id, l, 1 AS k, CAST([] AS INTEGER[]) AS ps, CAST([] AS INTEGER[]) AS gs FROM c UNION ALL SELECT image_id, l, k + 1, CASE WHEN list_contains(ps, l[k].p) OR list_contains(gs, l[k].g) THEN ps ELSE list_append(ps, l[k].p) END, CASE WHEN list_contains(ps, l[k].p) OR list_contains(gs, l[k].g) THEN gs ELSE list_append(gs, l[k].g) END FROM s WHERE k <= len(l))
 SELECT image_id, unnest(ps) AS pred_id, unnest(gs) AS gt_id FROM s WHERE k = len(l) + 1""")
def greedy(spark, d):
    own = A.with_box(objects(spark, d).where(F.size("polygon") == 4))
    pairs = O.box_iou(own.where("object_id % 2 = 1"), own.where("object_id % 2 = 0"))
    return O.greedy_matches(pairs.where("iou >= 0.1")).select("image_id", "pred_id", "gt_id")


@book("d18_letterbox", f"WITH {IMG}, s AS (SELECT *, least(96 / width, 96 / height) AS scale FROM img), n AS (SELECT *, CAST(greatest(1, round_even(width * scale, 0)) AS INTEGER) AS nw, CAST(greatest(1, round_even(height * scale, 0)) AS INTEGER) AS nh FROM s) SELECT image_id, round(scale, 6) AS scale, nw AS new_width, nh AS new_height, CAST((96 - nw) // 2 AS INTEGER) AS \"left\", CAST((96 - nh) // 2 AS INTEGER) AS top FROM n")
def letterbox(spark, d):
    return B.rounded(images(spark, d).select("image_id", *(c.alias(n) for n, c in G.letterbox(F.col("width"), F.col("height"), 96).items())))


@book("f4_presence_matrix", f"{W_ALL} SELECT person_key, " + ", ".join(f"CAST(bool_or(category = '{c}') AS INTEGER) AS c{k}" for k, c in enumerate(["骨皮质", "积液", "腘窝囊肿"])) + " FROM obj JOIN img USING (image_id) GROUP BY person_key")
def presence(spark, d):
    return A.presence_matrix(objects(spark, d).join(images(spark, d), "image_id"), {"c0": "骨皮质", "c1": "积液", "c2": "腘窝囊肿"})


@book("f5_category_support", f"""{W_ALL}, {B.PEOPLE}, {B.folds_sql("people")}, j AS (SELECT o.category, o.image_id, i.person_key, f.diagnosis, f.outer_fold FROM obj o JOIN img i USING (image_id) JOIN folds f USING (person_key)),
 g AS (SELECT category, count(*) AS objects, count(DISTINCT image_id) AS images, count(DISTINCT person_key) AS people, least({", ".join(f"count(DISTINCT person_key) FILTER (WHERE outer_fold = {k})" for k in range(5))}) AS least_fold FROM j GROUP BY category),
 t AS (SELECT category, diagnosis, count(DISTINCT person_key) AS n FROM j GROUP BY ALL), m AS (SELECT category, diagnosis, n, row_number() OVER (PARTITION BY category ORDER BY n DESC, diagnosis DESC) AS k FROM t)
 SELECT g.category, objects, images, people, least_fold, m.diagnosis AS top_diagnosis, round(m.n / people, 6) AS top_share, CASE WHEN people >= 900 AND least_fold >= 150 THEN 'robust_multifold' WHEN people >= 300 AND least_fold >= 30 THEN 'limited_multifold' ELSE 'insufficient_multifold' END AS tier FROM g JOIN m ON m.category = g.category AND m.k = 1""")
def support(spark, d):
    from marlstone.operators.splits import outer_folds

    own = objects(spark, d).join(images(spark, d), "image_id").join(outer_folds(B.people(spark, d), 5, B.SEED), "person_key")
    return B.rounded(A.category_support(own, 5, (900, 150), (300, 30)))


@book("f6_coverage", f"{W_ALL} SELECT (SELECT count(*) FROM img) AS images, (SELECT count(DISTINCT image_id) FROM obj JOIN img USING (image_id)) AS with_objects, (SELECT count(DISTINCT image_id) FROM obj WHERE image_id NOT IN (SELECT image_id FROM img)) AS unlinked, round((SELECT count(DISTINCT image_id) FROM obj JOIN img USING (image_id)) / (SELECT count(*) FROM img), 6) AS coverage")
def coverage(spark, d):
    return B.rounded(A.coverage(images(spark, d), objects(spark, d)))


@book("f7_top_pairs", f'{W_OBJ}, c AS (SELECT DISTINCT image_id, category FROM obj) SELECT a.category AS "left", b.category AS "right", count(*) AS images FROM c a JOIN c b ON a.image_id = b.image_id AND a.category < b.category GROUP BY ALL ORDER BY images DESC, 1, 2 LIMIT 30')
def top_pairs(spark, d):
    return A.category_pairs(objects(spark, d)).orderBy(F.desc("images"), "left", "right").limit(30)


@book("a6_nested_read", f"{W_OBJ} SELECT image_id, CAST(count(*) AS INTEGER) AS n_objects, round(sum(true_area), 6) AS area FROM obj GROUP BY image_id")
def nested_read(spark, d):
    text = A.nested(objects(spark, d)).select("image_id", F.to_json(F.struct("objects")).alias("document"))
    own = A.parsed(text, "document")
    area = F.aggregate(F.transform("parsed.objects", lambda o: G.area(o["segmentation"])), F.lit(0.0), lambda a, x: a + x)
    return own.select("image_id", F.size("parsed.objects").alias("n_objects"), F.round(area, 6).alias("area"))


@book("a8_category_ids", f"{W_OBJ} SELECT category, CAST(row_number() OVER (ORDER BY category) - 1 AS INTEGER) AS category_id FROM (SELECT DISTINCT category FROM obj)")
def category_ids(spark, d):
    return A.dictionary(objects(spark, d), "category")


@book("a13_detection_export", f"""{W_ALL}, ids AS (SELECT category, row_number() OVER (ORDER BY category) - 1 AS category_id FROM (SELECT DISTINCT category FROM obj)), pos AS (SELECT image_id, row_number() OVER (ORDER BY image_id) AS image_no FROM img)
SELECT CAST(row_number() OVER (ORDER BY o.image_id, o.object_id) AS BIGINT) AS annotation_id, image_no, CAST(category_id AS INTEGER) AS category_id, true_area AS area, x0 AS x, y0 AS y, w, h, 0 AS iscrowd FROM obj o JOIN pos USING (image_id) JOIN ids USING (category)""")
def detection_export(spark, d):
    own = objects(spark, d)
    return A.detection_rows(images(spark, d), own, A.dictionary(own, "category"))


@book("a14_polygon_text", f"""{W_ALL}, ids AS (SELECT category, row_number() OVER (ORDER BY category) - 1 AS category_id FROM (SELECT DISTINCT category FROM obj)),
 lines AS (SELECT o.image_id, string_agg(category_id || ' ' || array_to_string(flatten(list_transform(polygon, lambda p: [printf('%.6f', least(greatest(p[1] / width, 0), 1)), printf('%.6f', least(greatest(p[2] / height, 0), 1))])), ' '), chr(10) ORDER BY object_id) AS body FROM obj o JOIN img USING (image_id) JOIN ids USING (category) GROUP BY 1)
 SELECT i.image_id, coalesce(body, '') AS body FROM img i LEFT JOIN lines USING (image_id)""")
def polygon_text(spark, d):
    own = objects(spark, d)
    return A.polygon_text(images(spark, d), own, A.dictionary(own, "category"))


@book("a15_case_export", f"WITH {IMG} SELECT image_id, 'case_' || lpad(CAST(row_number() OVER (ORDER BY image_id) - 1 AS VARCHAR), 5, '0') AS case_name, CASE WHEN image_id % 10 = 0 THEN 'test' ELSE 'train' END AS part FROM img")
def case_export(spark, d):
    own = images(spark, d).withColumn("split", F.when(F.col("image_id") % 10 == 0, "test").when(F.col("image_id") % 10 == 1, "val").otherwise("train"))
    return A.case_rows(own)


@book("a16_prompt_export", f"{W_OBJ} SELECT image_id, object_id, x0 AS x1, y0 AS y1, x0 + w AS x2, y0 + h AS y2, 'mask_' || image_id || '_' || object_id AS mask_name FROM obj")
def prompts(spark, d):
    return A.prompt_rows(objects(spark, d))


@book("a17_label_inventory", f"{W_OBJ} SELECT DISTINCT trim(raw) AS label FROM obj")
def inventory(spark, d):
    return objects(spark, d).select(F.trim("raw").alias("label")).distinct()


def _sides(spark, d):
    own = A.with_box(objects(spark, d).where(F.size("polygon") == 4))
    return own.where("object_id % 2 = 1"), own.where("object_id % 2 = 0")


@book("d16_match_summary", f"""WITH RECURSIVE {SPANS.removeprefix("WITH ")}, pairs AS (SELECT image_id, category, pred_id, gt_id, ov / (sa + sb - ov) AS iou FROM (SELECT a.image_id, a.category, a.object_id AS pred_id, b.object_id AS gt_id, a.w * a.h AS sa, b.w * b.h AS sb, greatest(0, least(a.x0 + a.w, b.x0 + b.w) - greatest(a.x0, b.x0)) * greatest(0, least(a.y0 + a.h, b.y0 + b.h) - greatest(a.y0, b.y0)) AS ov FROM a JOIN b ON a.image_id = b.image_id AND a.category = b.category)),
 c AS (SELECT image_id, category, list_sort(list({{'o': -iou, 'p': pred_id, 'g': gt_id}})) AS l FROM pairs WHERE iou >= 0.1 GROUP BY ALL),
 s AS (SELECT image_id, category, l, 1 AS k, CAST([] AS INTEGER[]) AS ps, CAST([] AS INTEGER[]) AS gs, CAST([] AS DOUBLE[]) AS os FROM c UNION ALL SELECT image_id, category, l, k + 1, CASE WHEN list_contains(ps, l[k].p) OR list_contains(gs, l[k].g) THEN ps ELSE list_append(ps, l[k].p) END, CASE WHEN list_contains(ps, l[k].p) OR list_contains(gs, l[k].g) THEN gs ELSE list_append(gs, l[k].g) END, CASE WHEN list_contains(ps, l[k].p) OR list_contains(gs, l[k].g) THEN os ELSE list_append(os, -l[k].o) END FROM s WHERE k <= len(l)),
 m AS (SELECT category, count(*) AS matched, avg(iou) AS mean_iou FROM (SELECT category, unnest(os) AS iou FROM s WHERE k = len(l) + 1) GROUP BY 1), na AS (SELECT category, count(*) AS pred FROM a GROUP BY 1), nb AS (SELECT category, count(*) AS gt FROM b GROUP BY 1),
 f AS (SELECT category, coalesce(gt, 0) AS gt, coalesce(pred, 0) AS pred, coalesce(matched, 0) AS matched, coalesce(mean_iou, 0) AS mean_iou FROM na FULL JOIN nb USING (category) LEFT JOIN m USING (category))
 SELECT category, gt, pred, matched, round(coalesce(matched / nullif(pred, 0), 0), 6) AS "precision", round(coalesce(matched / nullif(gt, 0), 0), 6) AS recall, round(mean_iou, 6) AS mean_iou, pred - matched AS false_positives, gt - matched AS false_negatives FROM f""")
def match_summary(spark, d):
    predicted, truth = _sides(spark, d)
    labels = predicted.select("image_id", F.col("object_id").alias("pred_id"), "category")
    pairs = O.box_iou(predicted, truth).join(labels, ["image_id", "pred_id"]).join(truth.select("image_id", F.col("object_id").alias("gt_id"), F.col("category").alias("gt_category")), ["image_id", "gt_id"])
    found = O.greedy_matches(pairs.where("iou >= 0.1 AND category = gt_category").drop("gt_category"))
    return B.rounded(O.match_summary(found, predicted, truth))


@book("d17_mean_dice", f"""{SPANS}, px AS (SELECT image_id, category, unnest(range(CAST(x0 AS BIGINT), CAST(x0 + w AS BIGINT))) AS x, y0, h, object_id FROM r), cells AS (SELECT DISTINCT image_id, category, object_id % 2 AS side, x, unnest(range(CAST(y0 AS BIGINT), CAST(y0 + h AS BIGINT))) AS y FROM px),
 n AS (SELECT image_id, category, x, y, count(*) FILTER (WHERE side = 1) AS p, count(*) FILTER (WHERE side = 0) AS g FROM cells GROUP BY ALL),
 i AS (SELECT image_id, category, (2 * sum(p * g) + 1e-5) / (sum(p) + sum(g) + 1e-5) AS dice, (sum(p * g) + 1e-5) / (sum(p) + sum(g) - sum(p * g) + 1e-5) AS iou FROM n GROUP BY ALL) SELECT category, round(avg(dice), 6) AS dice, round(avg(iou), 6) AS iou, count(*) AS images FROM i GROUP BY category""")
def mean_dice(spark, d):
    own = A.with_box(objects(spark, d).where(F.size("polygon") == 4))
    spans = O.box_spans(own, ["category"]).withColumn("predicted", F.col("object_id") % 2 == 1)
    scores = O.mask_scores(spans, ["image_id", "category"])
    return B.rounded(O.mean_over_images(scores))


@book("d7_polygon_masks", f"{W_OBJ} SELECT image_id, object_id, CAST(w * h AS BIGINT) AS pixels FROM obj WHERE NOT tri")
def polygon_masks(spark, d):
    spans = O.polygon_spans(objects(spark, d).where(F.size("polygon") == 4))
    return spans.groupBy("image_id", "object_id").agg(F.sum(F.col("x1") - F.col("x0")).alias("pixels"))


GEO = """WITH {IMG}, b AS (SELECT image_id, width, height, least(greatest(CAST(x1 AS INTEGER), 0), width - 1) AS l, least(greatest(CAST(y1 AS INTEGER), 0), height - 1) AS t, x2, y2 FROM img), c AS (SELECT *, least(greatest(CAST(x2 AS INTEGER), l + 1), width) AS r, least(greatest(CAST(y2 AS INTEGER), t + 1), height) AS o FROM b)
SELECT image_id, round(ln(1 + width * height), 6) AS log_pixel_count, round(width / height, 6) AS image_aspect_ratio, CAST(r - l AS DOUBLE) AS roi_width_pixels, CAST(o - t AS DOUBLE) AS roi_height_pixels, round((r - l) / (o - t), 6) AS roi_aspect_ratio FROM c""".replace("{IMG}", IMG)


@book("f1_geometry_features", GEO)
def geometry_features(spark, d):
    from marlstone.sources import pixels

    box = G.clamped_box(*(F.col(c) for c in ("x1", "y1", "x2", "y2", "width", "height")))
    own = images(spark, d).select(F.col("image_id").alias("path"), "width", "height", *(c.alias(n) for c, n in zip(box, ("left", "top", "right", "bottom"), strict=True)))
    return B.rounded(pixels.geometry_features(own).select(F.col("path").alias("image_id"), "log_pixel_count", "image_aspect_ratio", "roi_width_pixels", "roi_height_pixels", "roi_aspect_ratio"))


def _with_bow_ties(spark, d):
    """Every third rectangle with two points exchanged is a bow tie."""
    p = F.col("polygon")
    tie = F.array(F.element_at(p, 1), F.element_at(p, 3), F.element_at(p, 2), F.try_element_at(p, F.lit(4)))
    return objects(spark, d).withColumn("polygon", F.when((F.col("object_id") % 3 == 0) & (F.size(p) == 4), tie).otherwise(p))


@book("d9_polygon_validity", f"{W_OBJ} SELECT image_id, object_id, object_id % 3 <> 0 OR tri AS valid, NOT tri AND object_id % 3 = 0 AS crossing FROM obj")
def polygon_validity(spark, d):
    return _with_bow_ties(spark, d).select("image_id", "object_id", G.originally_valid(F.col("polygon")).alias("valid"), G.self_crossing(F.col("polygon")).alias("crossing"))


@book("d9_repaired_areas", f"{W_OBJ} SELECT image_id, object_id, round(CASE WHEN NOT tri AND object_id % 3 = 0 THEN w * h / 2 ELSE true_area END, 6) AS area FROM obj")
def repaired_areas(spark, d):
    return _with_bow_ties(spark, d).select("image_id", "object_id", F.round(G.repaired_area(F.col("polygon")), 6).alias("area"))


def _with_touching(spark, d):
    """By the number of the object: as it is, a bow tie, two triangles that touch in the middle (twice, one turned the other way), a rectangle with a spike."""
    p, k = F.col("polygon"), F.col("object_id") % 5
    box = objects(spark, d).where(F.size(p) == 4)
    at = lambda c, v: F.element_at(F.element_at(p, c), v).cast("double")
    x0, y0, x1, y1 = F.least(at(1, 1), at(3, 1)), F.least(at(1, 2), at(3, 2)), F.greatest(at(1, 1), at(3, 1)), F.greatest(at(1, 2), at(3, 2))
    a, b, c, d_, m, spike = F.array(x0, y0), F.array(x1, y0), F.array(x1, y1), F.array(x0, y1), F.array((x0 + x1) / 2, (y0 + y1) / 2), F.array(x1 + 7, y0 - 2)
    ring = F.when(k == 0, F.array(a, b, c, d_)).when(k == 1, F.array(a, c, b, d_)).when(k == 2, F.array(a, b, m, c, d_, m)).when(k == 3, F.array(a, b, m, d_, c, m)).otherwise(F.array(a, b, spike, b, c, d_, d_))
    return box.select("image_id", "object_id", ring.alias("polygon"))


@book("d9_ring_kinds", f"""{W_OBJ} SELECT image_id, object_id, CASE object_id % 5 WHEN 0 THEN 'simple' WHEN 1 THEN 'crossing' ELSE 'touching' END AS kind, object_id % 5 = 0 AS valid,
 round(CASE WHEN object_id % 5 IN (0, 4) THEN w * h ELSE w * h / 2 END, 6) AS area FROM obj WHERE NOT tri AND w > 0 AND h > 0""")
def ring_kinds(spark, d):
    own, p = _with_touching(spark, d), F.col("polygon")
    return own.select("image_id", "object_id", G.ring_kind(p).alias("kind"), G.originally_valid(p).alias("valid"), F.round(G.repaired_area(p).cast("double"), 6).alias("area"))
