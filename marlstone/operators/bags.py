"""Members of a person: aggregation of features, pooling, attention and its audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def aggregated_features(members: DataFrame, features: list[str]) -> DataFrame:
    """Per person: member count, and mean, population deviation, least and largest of each feature."""
    stats = [(f, n, fn) for f in features for n, fn in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))]
    return members.groupBy("person_key").agg(F.count("*").alias("image_count"), *(fn(f).cast("double").alias(f"{f}_{n}") for f, n, fn in stats))


def mixed_people(members: DataFrame) -> DataFrame:
    """People whose members have several classes or folds."""
    return members.groupBy("person_key").agg(F.countDistinct("diagnosis_id").alias("classes"), F.countDistinct("outer_fold").alias("folds")).where("classes > 1 OR folds > 1")


def mean_probabilities(members: DataFrame, k: int) -> DataFrame:
    """Mean of the members' probability vectors, and its logarithm clamped at 1e-8: person_key, class_id, prob, log_prob."""
    each = members.select("person_key", F.posexplode("probs").alias("class_id", "p"))
    return each.groupBy("person_key", "class_id").agg(F.avg("p").alias("prob")).withColumn("log_prob", F.log(F.greatest("prob", F.lit(1e-8))))


def mean_vectors(members: DataFrame, vector: str) -> DataFrame:
    """Mean vector per person, in long form: person_key, place, value."""
    return members.select("person_key", F.posexplode(vector).alias("place", "v")).groupBy("person_key", "place").agg(F.avg("v").alias("value"))


def attention(members: DataFrame, logit: str = "logit") -> DataFrame:
    """Softmax of the logits within a person, as ``attention_weight``; from two aggregates, so a large bag isn't one task."""
    top = members.groupBy("person_key").agg(F.max(logit).alias("__top"))
    own = members.join(top, "person_key").withColumn("__e", F.exp(F.col(logit) - F.col("__top")))
    total = own.groupBy("person_key").agg(F.sum("__e").alias("__sum"))
    return own.join(total, "person_key").withColumn("attention_weight", F.col("__e") / F.col("__sum")).drop("__top", "__e", "__sum")


def pooled_vectors(members: DataFrame, vector: str) -> DataFrame:
    """Weighted vector sums: person_key, place, value."""
    return members.select("person_key", "attention_weight", F.posexplode(vector).alias("place", "v")).groupBy("person_key", "place").agg(F.sum(F.col("attention_weight") * F.col("v")).alias("value"))


def concentration(members: DataFrame) -> DataFrame:
    """Per person: divergence from uniform weights over ln(n), 0 for a single member."""
    tiny = F.lit(1.1754943508222875e-38)
    own = members.groupBy("person_key").agg(F.count("*").alias("n"), F.sum(F.col("attention_weight") * F.log(F.greatest("attention_weight", tiny))).alias("h"), F.sum("attention_weight").alias("w"))
    return own.select("person_key", F.when(F.col("n") > 1, (F.col("h") + F.col("w") * F.log("n")) / F.log("n")).otherwise(0.0).alias("penalty"))


def attention_violations(members: DataFrame) -> DataFrame:
    """Weights must sum to one within 1e-5, members be as many as declared, and a person be in one fold."""
    own = members.groupBy("person_key").agg(F.sum("attention_weight").alias("w"), F.count("*").alias("n"), F.max("image_count").alias("c"), F.countDistinct("outer_fold").alias("f"))
    n = lambda c: F.sum(c.cast("long"))
    bad = own.agg(n(F.abs(F.col("w") - 1) > 1e-5).alias("a"), n(F.col("n") != F.col("c")).alias("b"), n(F.col("f") > 1).alias("d"))
    return bad.selectExpr("stack(3, 'weight_sum', a, 'count', b, 'one_fold', d) AS (rule, n_violations)")


def attention_audit(members: DataFrame, threshold: float = 0.95, most: float = 0.5, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Concentration of people with several members: mean and nearest-rank p95 of the largest weight, collapse rate, gate."""
    own = members.groupBy(*by, "person_key").agg(F.max("attention_weight").alias("m"), F.count("*").alias("n"))
    multi = F.when(F.col("n") > 1, F.col("m"))
    made = own.groupBy(*by).agg(
        F.count("*").alias("people"), F.count(multi).alias("multi"), F.coalesce(F.avg(multi), F.lit(1.0)).alias("mean_max"), F.coalesce(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY CASE WHEN n > 1 THEN m END)"), F.lit(1.0)).alias("p95_max"),
        F.coalesce(F.avg((multi >= threshold).cast("double")), F.lit(0.0)).alias("collapse_rate"),
    )
    return made.withColumn("passed", F.col("collapse_rate") <= most)


def ranked_members(members: DataFrame) -> DataFrame:
    """Rank by falling weight, then key."""
    return members.withColumn("attention_rank", F.row_number().over(W.partitionBy("person_key").orderBy(F.desc("attention_weight"), "image_key")))
