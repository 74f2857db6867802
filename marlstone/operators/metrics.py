"""Classification metrics of prediction tables, as aggregations.

A prediction table has ``reference_id`` (0 .. k-1), ``probs`` (array of k) and any columns to evaluate by. Results are long:
the grouping columns, ``metric`` and ``value``. Anything that needs an order of scores works on counts per distinct score.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import vectors as V
from marlstone.functions.draws import running_sums

SCORE_BUCKETS = 1000


def _long(df: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    pairs = F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names)))
    return df.select(*by, pairs.alias("m")).select(*by, "m.metric", "m.value")


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def with_predicted(df: DataFrame) -> DataFrame:
    return df.withColumn("predicted_id", V.argmax(F.col("probs")))


def confusion(df: DataFrame, k: int, by: list[str] = []) -> DataFrame:  # noqa: B006
    """The full k x k table, zeros kept: by, reference_id, predicted_id, n."""
    seen = with_predicted(df).groupBy(*by, "reference_id", "predicted_id").agg(F.count("*").alias("n"))
    groups = seen.select(*by).distinct() if by else seen.sparkSession.range(1).select()
    cells = F.explode(F.flatten(F.array(*(F.array(*(F.struct(F.lit(r).alias("reference_id"), F.lit(p).alias("predicted_id")) for p in range(k))) for r in range(k)))))
    full = groups.select(*by, cells.alias("c")).select(*by, "c.*")
    return full.join(seen, [*by, "reference_id", "predicted_id"], "left").select(*by, "reference_id", "predicted_id", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def per_class(matrix: DataFrame, k: int, by: list[str] = []) -> DataFrame:  # noqa: B006
    """One row per class: support, sensitivity, specificity, precision, npv (null on a zero denominator), f1 (0 then)."""
    classes = F.explode(F.array(*(F.lit(c) for c in range(k)))).alias("class_id")
    cells = matrix.select(*by, "reference_id", "predicted_id", "n", classes)
    is_ref, is_pred, n = F.col("reference_id") == F.col("class_id"), F.col("predicted_id") == F.col("class_id"), F.col("n")
    part = lambda cond: F.sum(F.when(cond, n).otherwise(0))
    sums = cells.groupBy(*by, "class_id").agg(part(is_ref & is_pred).alias("tp"), part(is_ref & ~is_pred).alias("fn"), part(~is_ref & is_pred).alias("fp"), part(~is_ref & ~is_pred).alias("tn"))
    ratio = lambda a, b: F.try_divide(F.col(a), F.col(a) + F.col(b))
    return sums.select(
        *by, "class_id", (F.col("tp") + F.col("fn")).alias("support"), ratio("tp", "fn").alias("sensitivity"), ratio("tn", "fp").alias("specificity"), ratio("tp", "fp").alias("precision"), ratio("tn", "fn").alias("npv"),
        F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0)).alias("f1"), "tp",
    )


def summary(classes: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Accuracy, balanced accuracy over classes that occur, macro and weighted F1."""
    n = F.sum("support")
    own = classes.groupBy(*by).agg((F.sum("tp") / n).alias("accuracy"), F.avg("sensitivity").alias("balanced_accuracy"), F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("support")) / n).alias("weighted_f1"), n.alias("patients"))
    return _long(own, by, ["accuracy", "balanced_accuracy", "macro_f1", "weighted_f1", "patients"])


def row_means(df: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Top-2 accuracy and multiclass Brier score."""
    probs, ref = F.col("probs"), F.col("reference_id")
    own = df.groupBy(*by).agg(F.avg((V.rank_of(probs, ref) <= 2).cast("double")).alias("top2_accuracy"), F.avg(V.brier(probs, ref)).alias("multiclass_brier"))
    return _long(own, by, ["top2_accuracy", "multiclass_brier"])


def calibration_bins(df: DataFrame, score: Column, correct: Column, by: list[str] = [], bins: int = 10) -> DataFrame:  # noqa: B006
    """Per bin of equal width: n, share correct, mean score. The last bin is closed."""
    edges = [F.when(score >= F.lit(k / bins), 1).otherwise(0) for k in range(1, bins)]
    own = df.select(*by, score.alias("s"), correct.cast("double").alias("c"), reduce(lambda a, b: a + b, edges).alias("bin"))
    return own.groupBy(*by, "bin").agg(F.count("*").alias("n"), F.avg("c").alias("share"), F.avg("s").alias("mean_score"))


def ece(bins: DataFrame, by: list[str] = [], name: str = "ece") -> DataFrame:  # noqa: B006
    own = bins.groupBy(*by).agg((F.sum(F.col("n") * F.abs(F.col("share") - F.col("mean_score"))) / F.sum("n")).alias(name))
    return _long(own, by, [name])


def top_label_ece(df: DataFrame, by: list[str] = [], bins: int = 10) -> DataFrame:  # noqa: B006
    own = with_predicted(df)
    return ece(calibration_bins(own, F.array_max("probs"), F.col("predicted_id") == F.col("reference_id"), by, bins), by)


def score_counts(df: DataFrame, score: Column, positive: Column, by: list[str] = [], weight: Column | None = None) -> DataFrame:  # noqa: B006
    """Positives and negatives per distinct score, and those below it."""
    w = F.lit(1).cast("long") if weight is None else weight
    counts = df.select(*by, score.alias("score"), positive.alias("pos"), w.alias("w")).groupBy(*by, "score").agg(F.sum(F.when(F.col("pos"), F.col("w")).otherwise(0)).alias("n_pos"), F.sum(F.when(F.col("pos"), 0).otherwise(F.col("w"))).alias("n_neg"))
    return running_sums(counts, by, "score", F.floor(F.col("score") * SCORE_BUCKETS), ["n_pos", "n_neg"])


def auc_of(counts: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Mid-rank Mann-Whitney; null where one kind is missing."""
    won = F.sum(F.col("n_pos") * (F.col("before_n_neg") + F.col("n_neg") / 2))
    return counts.groupBy(*by).agg(F.try_divide(won, F.sum("n_pos") * F.sum("n_neg")).alias("auc"))


def one_vs_rest(df: DataFrame, k: int, by: list[str] = []) -> DataFrame:  # noqa: B006
    """by, class_id, auc."""
    each = df.select(*by, "reference_id", F.posexplode("probs").alias("class_id", "score"))
    return auc_of(score_counts(each, F.col("score"), F.col("reference_id") == F.col("class_id"), [*by, "class_id"]), [*by, "class_id"])


def macro_auc(df: DataFrame, k: int, by: list[str] = []) -> DataFrame:  # noqa: B006
    own = one_vs_rest(df, k, by)
    return _long(own.groupBy(*by).agg(F.avg("auc").alias("macro_auc")), by, ["macro_auc"])


def evaluate(df: DataFrame, k: int, by: list[str] = []) -> DataFrame:  # noqa: B006
    """All multiclass metrics."""
    return union_all([summary(per_class(confusion(df, k, by), k, by), by), row_means(df, by), top_label_ece(df, by), macro_auc(df, k, by)])


def over_folds(metrics: DataFrame) -> DataFrame:
    """Mean and population deviation of each metric over folds."""
    return metrics.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def gate_metrics(df: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Binary metrics of (positive boolean, score, predicted boolean)."""
    pos, score, pred = F.col("positive"), F.col("score"), F.col("predicted")
    part = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    cells = df.groupBy(*by).agg(part(pos & pred).alias("tp"), part(pos & ~pred).alias("fn"), part(~pos & pred).alias("fp"), part(~pos & ~pred).alias("tn"), F.avg(F.pow(score - pos.cast("double"), F.lit(2.0))).alias("binary_brier"), F.avg(-F.log(F.greatest(F.when(pos, score).otherwise(1 - score), F.lit(1e-12)))).alias("nll"))
    f1 = lambda a, b, c: F.coalesce(F.try_divide(2 * F.col(a), 2 * F.col(a) + F.col(b) + F.col(c)), F.lit(0.0))
    sens, spec = F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), F.try_divide(F.col("tn"), F.col("tn") + F.col("fp"))
    own = cells.select(*by, sens.alias("abnormal_sensitivity"), spec.alias("normal_specificity"), ((sens + spec) / 2).alias("balanced_accuracy"), ((f1("tp", "fp", "fn") + f1("tn", "fn", "fp")) / 2).alias("macro_f1"), "binary_brier", "nll")
    counts = score_counts(df, score, pos, by)
    curve = counts.groupBy(*by).agg(F.sum("n_pos").alias("all_pos"), F.sum("n_neg").alias("all_neg")) if by else counts.agg(F.sum("n_pos").alias("all_pos"), F.sum("n_neg").alias("all_neg"))
    joined = counts.join(curve, by) if by else counts.crossJoin(F.broadcast(curve))  # one row
    kept_pos, kept = F.col("all_pos") - F.col("before_n_pos"), F.col("all_pos") - F.col("before_n_pos") + F.col("all_neg") - F.col("before_n_neg")
    precision = joined.groupBy(*by).agg(F.try_divide(F.sum(F.col("n_pos") * kept_pos / kept), F.max("all_pos")).alias("pr_auc"))
    return union_all([
        _long(own, by, ["abnormal_sensitivity", "normal_specificity", "balanced_accuracy", "macro_f1", "binary_brier", "nll"]),
        _long(auc_of(counts, by).withColumnRenamed("auc", "roc_auc"), by, ["roc_auc"]), _long(precision, by, ["pr_auc"]), binary_ece(df, by),
    ])


def binary_ece(df: DataFrame, by: list[str] = [], bins: int = 10) -> DataFrame:  # noqa: B006
    """On the positive probability, not the top label."""
    return ece(calibration_bins(df, F.col("score"), F.col("positive"), by, bins), by, "binary_ece")


def compare(metrics: DataFrame, methods: list[str]) -> DataFrame:
    """metrics (method, metric, value) -> one column per method, for the metrics that all have."""
    common = metrics.where(F.col("value").isNotNull()).groupBy("metric").agg(F.countDistinct("method").alias("n")).where(F.col("n") == len(methods)).select("metric")
    return metrics.join(common, "metric", "left_semi").groupBy("metric").pivot("method", methods).agg(F.first("value"))
