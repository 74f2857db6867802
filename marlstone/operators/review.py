"""Blinded double review: queue, responses, merge, adjudication, agreement."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlstone.functions.draws import draw
from marlstone.operators.contracts import counted
from marlstone.sources.tables import written

BUCKETS = ["existing_positive", "legacy_unlabeled_candidate"]


class ShortageError(ValueError):
    pass


def build_queue(images: DataFrame, positives: DataFrame, targets: list[str], seed: int, per_cell: int) -> DataFrame:
    """images (image_key, person_key, diagnosis, outer_fold), positives (image_key, target) -> chosen images per target, bucket and fold.

    In a cell each person offers the image of the smallest draw; people of a class take turns, so classes stay balanced.
    Targets come one after the other, as an image is used once; the loop is over targets alone. A cell's candidates are cut
    to the first ``per_cell`` of each class before they meet."""
    chosen = None
    for target in targets:
        own = positives.where(F.col("target") == target).select("image_key", F.lit(True).alias("__p")).distinct()
        pool = images.join(own, "image_key", "left").withColumn("bucket", F.when(F.col("__p"), BUCKETS[0]).otherwise(BUCKETS[1])).drop("__p")
        if chosen is not None:
            pool = pool.join(chosen.select("image_key"), "image_key", "left_anti")
        pool = pool.withColumn("score", draw(seed, F.lit(target), "bucket", "image_key"))
        person = pool.groupBy("bucket", "outer_fold", "diagnosis", "person_key").agg(F.min(F.struct("score", "image_key")).alias("b")).select("bucket", "outer_fold", "diagnosis", "person_key", "b.*")
        turn = person.withColumn("turn", F.row_number().over(W.partitionBy("bucket", "outer_fold", "diagnosis").orderBy("score"))).where(F.col("turn") <= per_cell)
        picked = turn.withColumn("k", F.row_number().over(W.partitionBy("bucket", "outer_fold").orderBy("turn", "score"))).where(F.col("k") <= per_cell)
        rows = written(picked.select(F.lit(target).alias("target"), "bucket", "outer_fold", "image_key", "person_key", "diagnosis"), "queue")
        chosen = rows if chosen is None else chosen.unionByName(rows)
    return chosen


def shortages(queue: DataFrame, targets: list[str], folds: int, per_cell: int) -> DataFrame:
    """Cells with fewer images than asked for: target, bucket, outer_fold, n."""
    spark = queue.sparkSession
    cells = spark.createDataFrame([(t, b, f) for t in targets for b in BUCKETS for f in range(folds)], "target string, bucket string, outer_fold int")
    counts = queue.groupBy("target", "bucket", "outer_fold").agg(F.count("*").alias("n"))
    return cells.join(counts, ["target", "bucket", "outer_fold"], "left").na.fill(0, ["n"]).where(F.col("n") < per_cell)


def case_keys(queue: DataFrame, seed: int) -> DataFrame:
    """Public columns only."""
    key = F.concat(F.lit("REVIEW_"), F.upper(F.substring(draw(seed, "target", "image_key"), 1, 16)))
    return queue.select(key.alias("review_case_key"), "image_key", F.col("target").alias("target_category"))


def queue_violations(rows: DataFrame, targets: list[str], least_reviews: int = 2) -> DataFrame:
    """Path-like values, repeated cases, uncovered targets, too few reviews asked for."""
    values = [c for c, t in rows.dtypes if t == "string"]
    path = reduce(lambda a, b: a | b, (F.col(c).rlike(r"[\\/]") for c in values))
    once = rows.groupBy("review_case_key").agg(F.count("*").alias("n"))
    wanted = rows.sparkSession.createDataFrame([(t,) for t in targets], "target_category string").join(rows.select("target_category", F.lit(1).alias("x")).distinct(), "target_category", "left")
    return counted(rows, {"path_like": path, "reviews": F.col("required_independent_reviews") < least_reviews}).unionByName(counted(once, {"unique": F.col("n") > 1})).unionByName(counted(wanted, {"target_coverage": F.col("x").isNull()}))


FIELDS = ["presence", "subtype", "notes"]


def blank_responses(queue: DataFrame, slots: int = 2) -> DataFrame:
    return queue.select("review_case_key", "image_key", "target_category", *(F.lit("").alias(f"reviewer_{s}_{f}") for s in range(1, slots + 1) for f in FIELDS))


def response_state(rows: DataFrame, slot: int, presence: list[str], subtypes: list[str]) -> DataFrame:
    """Adds ``state`` (complete, partial, remaining) and ``problem`` (null if none) of one reviewer's rows."""
    p, s = F.col(f"reviewer_{slot}_presence"), F.col(f"reviewer_{slot}_subtype")
    other = reduce(lambda a, b: a | b, (F.col(f"reviewer_{3 - slot}_{f}") != "" for f in FIELDS))
    problem = F.when(other, "other_slot").when((p != "") & ~p.isin(presence), "presence_code").when((s != "") & ~s.isin(subtypes), "subtype_code").when((p == "present") & (s == ""), "subtype_missing").when((p != "present") & (s != ""), "subtype_without_presence")
    state = F.when(p == "", F.when(s == "", "remaining").otherwise("partial")).when((p == "present") & (s == ""), "partial").otherwise("complete")
    return rows.withColumn("state", state).withColumn("problem", problem)


def merged_responses(first: DataFrame, second: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two isolated responses as one table, and violations: cases on one side only, differing base fields."""
    base = ["review_case_key", "image_key", "target_category"]
    b = second.select(F.col("review_case_key"), F.col("image_key").alias("__i"), F.col("target_category").alias("__t"), *(f"reviewer_2_{f}" for f in FIELDS))
    own = first.select(*base, *(f"reviewer_1_{f}" for f in FIELDS)).join(b, "review_case_key", "full")
    bad = counted(own, {"coverage": F.col("image_key").isNull() | F.col("__i").isNull(), "base_fields": (F.col("image_key") != F.col("__i")) | (F.col("target_category") != F.col("__t"))})
    return own.drop("__i", "__t"), bad


def adjudication_violations(rows: DataFrame, presence: list[str]) -> DataFrame:
    """Only disagreed fields may be set, notes exactly on disagreement, and the final presence and subtype must fit."""
    differs = {f: F.col(f"reviewer_1_{f}") != F.col(f"reviewer_2_{f}") for f in ("presence", "subtype")}
    disagreed = differs["presence"] | differs["subtype"]
    final_p = F.when(differs["presence"], F.col("adjudicated_presence")).otherwise(F.col("reviewer_1_presence"))
    final_s = F.when(differs["subtype"], F.col("adjudicated_subtype")).otherwise(F.col("reviewer_1_subtype"))
    return counted(rows, {
        "set_without_disagreement": (~differs["presence"] & (F.col("adjudicated_presence") != "")) | (~differs["subtype"] & (F.col("adjudicated_subtype") != "")),
        "missing_decision": differs["presence"] & ~F.col("adjudicated_presence").isin(presence), "notes": disagreed != (F.col("adjudication_notes") != ""),
        "final_subtype": (final_p == "present") != (final_s != ""),
    })


def agreement(pairs: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """(reviewer_1, reviewer_2) -> rows, raw agreement, kappa (null if it isn't finite), agreement on the two decided states."""
    cells = pairs.groupBy(*by, "reviewer_1", "reviewer_2").agg(F.count("*").alias("n"))
    return agreement_of_cells(cells, by)


def agreement_of_cells(cells: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    n, a, b = F.col("n"), F.col("reviewer_1"), F.col("reviewer_2")
    margins = cells.select(*by, F.explode(F.array(F.struct(F.lit(1).alias("s"), a.alias("v")), F.struct(F.lit(2).alias("s"), b.alias("v")))).alias("m"), "n").select(*by, "m.*", "n")
    margins = margins.groupBy(*by, "v").agg(F.sum(F.when(F.col("s") == 1, n).otherwise(0)).alias("l"), F.sum(F.when(F.col("s") == 2, n).otherwise(0)).alias("r"))
    chance = margins.groupBy(*by).agg(F.sum(F.col("l") * F.col("r")).alias("chance"))
    decided = a.isin("present", "absent_visible") & b.isin("present", "absent_visible")
    part = lambda c: F.sum(F.when(c, n).otherwise(0))
    own = cells.groupBy(*by).agg(F.sum(n).alias("rows"), part(a == b).alias("same"), part(decided).alias("comparable"), part((a == "present") & (b == "present")).alias("pp"), part((a == "absent_visible") & (b == "absent_visible")).alias("nn"), part(decided & (a != b)).alias("dd"))
    own = own.join(chance, by) if by else own.crossJoin(F.broadcast(chance))  # one row
    expected = F.col("chance") / (F.col("rows") * F.col("rows"))
    raw = F.col("same") / F.col("rows")
    return own.select(
        *by, "rows", raw.alias("raw_agreement"), F.try_divide(raw - expected, 1 - expected).alias("kappa"), "comparable",
        F.try_divide(2 * F.col("pp"), 2 * F.col("pp") + F.col("dd")).alias("positive_agreement"), F.try_divide(2 * F.col("nn"), 2 * F.col("nn") + F.col("dd")).alias("negative_agreement"),
    )


def agreement_intervals(pairs: DataFrame, replicates: int, seed: int) -> DataFrame:
    """Row bootstrap of raw agreement, kappa, positive and negative agreement, by resampling cells."""
    from marlstone.operators.resampling import resampled_cells

    cells = pairs.groupBy("reviewer_1", "reviewer_2").agg(F.count("*").alias("n")).withColumn("stratum", F.lit("all"))
    drawn = resampled_cells(cells.withColumn("cell", F.struct("reviewer_1", "reviewer_2")), "stratum", replicates, seed).select("replicate", "cell.*", "n")
    own = agreement_of_cells(drawn, ["replicate"])
    names = {"raw_agreement": "raw", "kappa": "kappa", "positive_agreement": "positive", "negative_agreement": "negative"}
    limits = [F.percentile(c, F.lit(p)).alias(f"{n}_{side}") for c, n in names.items() for side, p in (("low", 0.025), ("high", 0.975))]
    return own.agg(*limits, F.count("*").alias("replicates"))


def final_states(rows: DataFrame) -> DataFrame:
    """Final presence per target: the agreed one, else the adjudicated one."""
    final = F.when(F.col("reviewer_1") == F.col("reviewer_2"), F.col("reviewer_1")).otherwise(F.col("adjudicated"))
    return rows.groupBy("target", final.alias("state")).agg(F.count("*").alias("n"))


def source_audit(queue: DataFrame, sources: DataFrame) -> DataFrame:
    """Found and missing sources of queued images and the range of their sizes."""
    own = queue.join(sources.select("image_key", "width", "height"), "image_key", "left")
    return own.agg(F.count("width").alias("found"), F.sum(F.col("width").isNull().cast("long")).alias("failed"), *(f(c).alias(f"{n}_{c}") for c in ("width", "height") for n, f in (("least", F.min), ("most", F.max))))


def reconciled(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both (id, field, type, value) -> per id the differing fields. Whole and real numbers of equal value are equal, booleans only to booleans."""
    norm = lambda df, s: df.select("id", "field", F.when(F.col("type").isin("int", "float"), "number").otherwise(F.col("type")).alias(f"{s}_type"), F.when(F.col("type").isin("int", "float"), F.col("value").try_cast("double").cast("string")).otherwise(F.col("value")).alias(f"{s}_value"))
    both = norm(a, "a").join(norm(b, "b"), ["id", "field"], "full")
    differs = ~(F.col("a_type").eqNullSafe(F.col("b_type")) & F.col("a_value").eqNullSafe(F.col("b_value")))
    return both.where(differs).groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("field")), ";").alias("fields"))
