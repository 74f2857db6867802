"""Fold-local logistic models (H1, H3-H6, J7): no SQL oracle; tested against plain refits and with planted signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.operators import metrics as M
from marlstone.operators import models
from marlstone.operators import resampling as R
from marlstone.operators.splits import outer_folds
from marlstone.plans import bindings as B
from marlstone.plans.book import Book
from marlstone.sources.tables import written

book = Book()
K = len(B.LANGUAGES)
PERMUTATIONS, REPLICATES, OPERATING = 100, 2000, 0.3
LADDER = {"C0": ["o"], "C1": ["a", "e"], "C2": ["a", "e", "i"], "C3": ["a", "e", "i", "o"]}
PAIRS = [("C0", "C1"), ("C1", "C2"), ("C2", "C3"), ("C0", "C3")]


def people(spark, d):
    return written(outer_folds(B.letters(spark, d), 5, B.SEED), "folds")


def _as_predictions(df):
    return df.withColumnRenamed("diagnosis_id", "reference_id")


@book("h1_logistic_oof")
def logistic(spark, d):
    own = models.logistic_oof(people(spark, d), ["a", "e", "i"], K)
    return own.select("person_key", "outer_fold", F.col("diagnosis_id").alias("reference_id"), "probs")


def _ladder(spark, d):
    return _as_predictions(models.ladder(people(spark, d).select("person_key", "outer_fold", "diagnosis_id", *"aeio"), LADDER, K))


@book("h3_feature_ladder")
def ladder(spark, d):
    return B.rounded(M.summary(M.per_class(M.confusion(_ladder(spark, d), K, ["model_id"]), K, ["model_id"]), ["model_id"]))


@book("h3_ladder_comparisons")
def comparisons(spark, d):
    return B.rounded(models.paired_ladder(_ladder(spark, d), PAIRS, K, REPLICATES, 29))


def presence(spark, d):
    """Customers, and which brands (anatomy) and types (finding) the parts of their orders have."""
    own = outer_folds(B.people(spark, d), 5, B.SEED).select("person_key", "outer_fold", "diagnosis_id")
    part = B.table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.explode(F.array(F.struct(F.lit("anatomy").alias("role"), F.col("p_brand").alias("category")), F.struct(F.lit("finding").alias("role"), F.col("p_type").alias("category")))).alias("c"))
    orders = B.table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    had = B.table(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(orders, "l_orderkey").join(part, "l_partkey").select("o_custkey", "c.*").distinct()
    had = written(had.select(F.concat(F.lit("P"), F.col("o_custkey").cast("string")).alias("person_key"), "role", "category"), "had")
    names = {r.role: sorted(r.c) for r in had.groupBy("role").agg(F.collect_set("category").alias("c")).collect()}  # the categories' dictionary
    sets = {"all": sorted([*names["anatomy"], *names["finding"]]), "anatomy": names["anatomy"], "finding": names["finding"]}
    predictions, table = models.presence_models(written(own, "people"), had.select("person_key", "category"), sets, len(B.SEGMENTS))
    return _as_predictions(predictions), table, sets


@book("h4_presence_classifier")
def presence_classifier(spark, d):
    found, _, sets = presence(spark, d)
    found = written(found, "predictions")
    k, by = len(B.SEGMENTS), ["feature_set"]
    rows = [M.evaluate(found, k, by).select("feature_set", "metric", "value")]
    folds = R.macro_f1(M.confusion(found, k, [*by, "outer_fold"]), k, [*by, "outer_fold"])
    rows.append(folds.select("feature_set", F.concat(F.lit("fold_macro_f1_"), F.col("outer_fold").cast("string")).alias("metric"), "value"))
    limits = [("macro_auc", R.bootstrap_macro_auc(found, k, REPLICATES, 24, by))]
    limits += [("macro_f1", R.bootstrap_macro_f1(found.where(F.col("feature_set") == name), k, REPLICATES, 24).withColumn("feature_set", F.lit(name))) for name in sets]
    for metric, own in limits:
        side = F.explode(F.array(*(F.struct(F.lit(f"{metric}_{s}").alias("metric"), F.col(s).alias("value")) for s in ("low", "high")))).alias("m")
        rows.append(own.select("feature_set", side).select("feature_set", "m.*"))
    return B.rounded(M.union_all(rows))


@book("h4_presence_coefficients")
def presence_coefficients(spark, d):
    return B.rounded(presence(spark, d)[1])


@book("h5_fold_identification")
def fold_identification(spark, d):
    return B.rounded(models.fold_identification(people(spark, d), ["a", "e", "i", "o"], 5, PERMUTATIONS, 23))


@book("h6_error_prediction")
def error_prediction(spark, d):
    return B.rounded(models.error_predictability(people(spark, d), B.gate(spark, d, "B").withColumn("predicted", F.col("score") >= OPERATING), ["a", "e", "i", "o"], PERMUTATIONS, REPLICATES, 37))


@book("j7_permutation_test")
def permutation(spark, d):
    return B.rounded(models.permutation_test(people(spark, d), ["o"], K, PERMUTATIONS, 31))
