"""Fold-local models on tables: every statistic comes from the other folds only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions import vectors as V
from marlstone.operators import logistic as L
from marlstone.operators import metrics as M
from marlstone.operators import resampling as R
from marlstone.operators.dealing import with_draws, with_permutations
from marlstone.operators.splits import outer_folds
from marlstone.sources.tables import written


def _rest_counts(df: DataFrame, features: list[str]) -> DataFrame:
    """Per fold and class: n and feature sums of the other folds."""
    cells = df.groupBy("outer_fold", "diagnosis_id").agg(F.count("*").alias("n"), *(F.sum(f).alias(f) for f in features))
    totals = df.groupBy("diagnosis_id").agg(F.count("*").alias("t_n"), *(F.sum(f).alias(f"t_{f}") for f in features))
    folds = df.select("outer_fold").distinct()
    full = folds.crossJoin(totals).join(cells, ["outer_fold", "diagnosis_id"], "left")  # folds x classes rows
    return full.select("outer_fold", "diagnosis_id", *((F.col(f"t_{c}") - F.coalesce(F.col(c), F.lit(0))).alias(c) for c in ["n", *features]))


def centroid_oof(df: DataFrame, features: list[str], k: int, scale: float) -> DataFrame:
    """Nearest-centroid probabilities: softmax of minus the squared distance over ``scale`` to the other folds' class means.

    Adds ``probs``, rounded to nine places. The centroid table has folds x classes rows."""
    rest = _rest_counts(df, features)
    centres = rest.groupBy("outer_fold").agg(F.array_sort(F.collect_list(F.struct("diagnosis_id", *((F.col(f).cast("double") / F.col("n")).alias(f) for f in features)))).alias("__centres"))
    joined = df.join(F.broadcast(centres), "outer_fold")  # one row per fold

    def distance(c):
        total = None
        for f in features:
            d = (F.col(f) - c[f]) * (F.col(f) - c[f])
            total = d if total is None else total + d
        return total

    d = joined.withColumn("__d", F.transform("__centres", distance))
    e = d.withColumn("__e", F.transform("__d", lambda x: F.exp((F.array_min("__d") - x) / F.lit(scale))))
    return e.withColumn("probs", F.transform("__e", lambda x: F.round(x / V.total(F.col("__e")), 9))).drop("__centres", "__d", "__e")


def prior_oof(df: DataFrame) -> DataFrame:
    """Class shares of the other folds: outer_fold, diagnosis_id, prior."""
    rest = _rest_counts(df, [])
    totals = rest.groupBy("outer_fold").agg(F.sum("n").alias("total"))
    return rest.join(totals, "outer_fold").select("outer_fold", "diagnosis_id", (F.col("n") / F.col("total")).alias("prior"))


def logistic_oof(df: DataFrame, features: list[str], k: int, target: str = "diagnosis_id", c: float = 1.0) -> DataFrame:
    """Adds ``probs``: each row is predicted once, by a model of the other folds; all folds are fitted together."""
    rows = written(L.packed(df, features, L.byte(F.col(target)), L.byte(F.col("outer_fold")), df.columns), "packed")
    return L.predicted(rows, L.fitted(rows, k, [0], c), df.columns).drop("column", "target")


def ladder(df: DataFrame, sets: dict[str, list[str]], k: int) -> DataFrame:
    """Predictions of several feature sets with ``model_id``; a set is one fit of all its folds."""
    return M.union_all([logistic_oof(df, features, k).withColumn("model_id", F.lit(name)) for name, features in sets.items()])


def paired_ladder(predictions: DataFrame, pairs: list[tuple[str, str]], k: int, replicates: int, seed: int) -> DataFrame:
    """(baseline, candidate, observed, low, high, share_above, replicates): differences of macro-F1 on the same people.

    ``predictions`` has (person_key, reference_id, probs, model_id). One draw of the joint cells of all models serves all
    pairs, so they are compared on the same resampled people."""
    names = sorted({m for pair in pairs for m in pair})
    own = M.with_predicted(predictions.where(F.col("model_id").isin(names)))
    each = F.map_from_entries(F.collect_list(F.struct("model_id", "predicted_id")))  # a person has one row per model
    joint = own.groupBy("person_key", "reference_id").agg(each.alias("m")).select("reference_id", F.array(*(F.col("m")[n] for n in names)).alias("each"))
    cells = written(joint.groupBy("reference_id", "each").agg(F.count("*").alias("n")), "cells")
    drawn = R.resampled_cells(cells.withColumn("cell", F.struct("reference_id", "each")), "reference_id", replicates, seed).select("replicate", "cell.*", "n")

    def deltas(df: DataFrame) -> DataFrame:
        by_model = df.select("replicate", "reference_id", F.posexplode("each").alias("model", "predicted_id"), "n").groupBy("replicate", "model", "reference_id", "predicted_id").agg(F.sum("n").alias("n"))
        f1 = R.macro_f1(by_model, k, ["replicate", "model"]).groupBy("replicate").agg(F.map_from_entries(F.collect_list(F.struct("model", "value"))).alias("f"))
        compared = F.explode(F.array(*(F.struct(F.lit(a).alias("baseline"), F.lit(b).alias("candidate"), (F.col("f")[names.index(b)] - F.col("f")[names.index(a)]).alias("value")) for a, b in pairs)))
        return f1.select("replicate", compared.alias("d")).select("replicate", "d.*")

    keys = ["baseline", "candidate"]
    limits = deltas(drawn).groupBy(keys).agg(F.percentile("value", F.lit(0.025)).alias("low"), F.percentile("value", F.lit(0.975)).alias("high"), F.avg((F.col("value") > 0).cast("double")).alias("share_above"), F.count("value").alias("replicates"))
    observed = deltas(cells.withColumn("replicate", F.lit(0))).select(*keys, F.col("value").alias("observed"))
    return observed.join(limits, keys)


def presence_design(people: DataFrame, presence: DataFrame, categories: list[str]) -> DataFrame:
    """``people`` with ``__x``, a 0 or 1 for each category; ``presence`` has (person_key, category), repeats allowed.

    People carry the list of what they have; no column per category is made before the fit."""
    place = F.array_position(F.array(*(F.lit(c) for c in categories)), F.col("category"))
    had = presence.where(F.col("category").isin(categories)).select("person_key", place.alias("p")).groupBy("person_key").agg(F.collect_set("p").alias("had"))
    x = F.transform(F.sequence(F.lit(1), F.lit(len(categories))), lambda k: F.coalesce(F.array_contains("had", k.cast("long")), F.lit(False)).cast("double"))
    return people.join(had, "person_key", "left").select(*people.columns, x.alias("__x"), L.byte(F.col("diagnosis_id")).alias("__y"), L.byte(F.col("outer_fold")).alias("__f"))


def presence_models(people: DataFrame, presence: DataFrame, sets: dict[str, list[str]], k: int) -> tuple[DataFrame, DataFrame]:
    """Predictions (with ``feature_set``) and coefficients (feature_set, outer_fold, class_id, feature, coef) of classifiers that
    see nothing but which categories a person has; features aren't scaled. People are brought together with what they have once for
    all sets."""
    predictions, tables, every = [], [], sorted({c for own in sets.values() for c in own})
    whole = written(presence_design(people, presence, every), "presence")
    for name, categories in sets.items():
        rows = whole.withColumn("__x", F.array(*(F.col("__x")[every.index(c)] for c in categories)))
        models = L.fitted(rows, k, [0], scaled=False)
        predictions.append(L.predicted(rows, models, people.columns).drop("column", "target").withColumn("feature_set", F.lit(name)))
        tables.append(L.coefficients(people.sparkSession, models, categories).drop("column").withColumn("feature_set", F.lit(name)))
    return M.union_all(predictions), M.union_all(tables)


def _against_null(values: DataFrame, by: list[str], observed: int = 0) -> DataFrame:
    """(by, observed, null_mean, null_p95, permutations, p) from (by, replicate, value): p = (exceed + 1) / (n + 1)."""
    first = values.where(F.col("replicate") == observed).select(*by, F.col("value").alias("observed"))
    null = values.where(F.col("replicate") != observed)
    joined = null.join(first, by) if by else null.crossJoin(F.broadcast(first))  # one row
    n, exceed = F.count("value"), F.sum((F.col("value") >= F.col("observed")).cast("long"))
    return joined.groupBy(*by).agg(F.first("observed").alias("observed"), F.avg("value").alias("null_mean"), F.percentile("value", F.lit(0.95)).alias("null_p95"), n.alias("permutations"), ((exceed + 1) / (n + 1)).alias("p"))


def permutation_test(df: DataFrame, features: list[str], k: int, permutations: int = 100, seed: int = 31) -> DataFrame:
    """Macro-F1 of the out-of-fold model against full refits on targets permuted inside folds: one row.

    A row carries its target in all replicates as bytes; all replicates and folds are fitted together."""
    dealt = with_permutations(df.select("person_key", "outer_fold", "diagnosis_id", *features), ["outer_fold"], "person_key", "diagnosis_id", k, permutations, seed)
    rows = written(L.packed(dealt, features, F.concat(L.byte(F.col("diagnosis_id")), "permuted"), L.byte(F.col("outer_fold")), []), "packed")
    cells = L.confusions(rows, L.fitted(rows, k, [0] * (permutations + 1))).withColumnRenamed("column", "replicate")
    return _against_null(R.macro_f1(cells, k, ["replicate"]), [])


def _replicate_aucs(scored: DataFrame, by: list[str]) -> DataFrame:
    """(by, value): AUCs of (by, score, positive)."""
    return M.auc_of(M.score_counts(scored, F.col("score"), F.col("positive"), by), by).withColumnRenamed("auc", "value")


def fold_identification(df: DataFrame, features: list[str], folds: int, permutations: int, seed: int, least_auc: float = 0.6, alpha: float = 0.05) -> DataFrame:
    """Can features tell the fold? Macro one-vs-rest AUC, its permutation p inside diagnoses, and the verdict: one row.

    Rows are dealt into new parts inside their fold; label and part are permuted together, so every replicate's parts are even
    in its labels."""
    own = df.select("person_key", F.col("outer_fold").alias("label"), F.col("outer_fold").cast("string").alias("diagnosis"), F.col("diagnosis_id").alias("stratum"), *features).withColumn("diagnosis_id", F.col("label"))
    both = outer_folds(own, folds, seed).withColumn("code", F.col("label") * folds + F.col("outer_fold"))
    dealt = with_permutations(both.select("person_key", "stratum", "code", *features), ["stratum"], "person_key", "code", folds * folds, permutations, seed)

    def parted(batches):
        for batch in batches:
            codes = [bytes([c]) + bytes(p) for c, p in zip(batch["code"], batch["permuted"], strict=True)]
            yield batch[["__x"]].assign(__y=[bytes(b // folds for b in c) for c in codes], __f=[bytes(b % folds for b in c) for c in codes])

    dealt = dealt.select(F.array(*(F.col(c).cast("double") for c in features)).alias("__x"), "code", "permuted")
    rows = written(dealt.mapInPandas(parted, "__x array<double>, __y binary, __f binary"), "packed")
    aucs = L.aucs(rows, L.fitted(rows, folds, list(range(permutations + 1))), list(range(folds))).withColumnRenamed("column", "replicate")
    found = _against_null(aucs.groupBy("replicate").agg(F.avg("value").alias("value")), [])
    return found.select(F.col("observed").alias("macro_auc"), "p", "permutations", F.col("null_mean").alias("null_auc_mean"), ((F.col("observed") >= least_auc) & (F.col("p") <= alpha)).alias("passed"))


ERROR_TARGETS = ["total_error", "normal_false_positive", "abnormal_false_negative"]


def error_predictability(df: DataFrame, gate: DataFrame, features: list[str], permutations: int, replicates: int, seed: int, least_auc: float = 0.6, least_low: float = 0.5, least_fold_auc: float = 0.55, least_folds: int = 3, alpha: float = 0.05) -> DataFrame:
    """Can features tell another model's errors? A row per target: all errors, false positives among the negative, false negatives
    among the positive people.

    ``gate`` has (person_key, positive, predicted). Errors are permuted inside fold and reference, which is right for all three
    targets, as the latter two are the strata of one reference. All targets, replicates and folds are fitted at once; intervals
    resample people inside fold and reference."""
    wrong = gate.select("person_key", F.col("positive").cast("int").alias("reference"), (F.col("positive") != F.col("predicted")).cast("int").alias("error"))
    own = df.select("person_key", "outer_fold", *features).join(wrong, "person_key")
    dealt = with_permutations(own, ["outer_fold", "reference"], "person_key", "error", 2, permutations, seed)
    whole, none = F.concat(L.byte(F.col("error")), "permuted"), F.lit(bytes([L.ABSENT]) * (permutations + 1))
    only = lambda reference, a, b: F.when(F.col("reference") == reference, a).otherwise(b)
    fold, out = L.byte(F.col("outer_fold")), F.lit(bytes([L.ABSENT]))
    y = F.concat(whole, only(0, whole, none), only(1, whole, none))
    rows = written(L.packed(dealt, features, y, F.concat(fold, only(0, fold, out), only(1, fold, out)), ["person_key", "outer_fold", "reference"]), "packed")
    width = permutations + 1
    models = L.fitted(rows, 2, [k for k in range(3) for _ in range(width)])
    target = F.element_at(F.array(*(F.lit(t) for t in ERROR_TARGETS)), F.floor(F.col("column") / width).cast("int") + 1)
    scored = L.predicted(rows, models, ["person_key", "outer_fold", "reference"], [k * width for k in range(3)]).select(
        "person_key", "outer_fold", "reference", target.alias("error_target"), (F.col("target") == 1).alias("positive"), F.element_at("probs", 2).alias("score")
    )
    scored = written(scored, "scored")
    values = L.aucs(rows, models, [1]).select(target.alias("error_target"), (F.col("column") % width).alias("replicate"), "value")
    null = _against_null(values, ["error_target"])
    observed = scored.withColumn("predicted", F.col("score") >= 0.5)
    metrics = M.gate_metrics(observed, ["error_target"]).where(F.col("metric").isin("pr_auc", "balanced_accuracy", "macro_f1")).groupBy("error_target").pivot("metric", ["pr_auc", "balanced_accuracy", "macro_f1"]).agg(F.first("value"))
    by_fold = _replicate_aucs(observed, ["error_target", "outer_fold"])
    folds = by_fold.groupBy("error_target").agg(F.array_sort(F.collect_list(F.struct("outer_fold", "value"))).alias("f"), F.every(F.col("value").isNotNull()).alias("all_folds_estimable"), F.sum(F.coalesce(F.col("value") >= least_fold_auc, F.lit(False)).cast("long")).alias("folds_passing"))
    folds = folds.withColumn("fold_auc", F.transform("f", lambda x: x["value"])).drop("f")
    # a person's scores go with it while it is drawn: rows with draws aren't joined
    people = scored.groupBy("person_key", "outer_fold", "reference").agg(F.collect_list(F.struct("error_target", "score", "positive")).alias("each"))
    drawn = with_draws(people, ["outer_fold", "reference"], "person_key", replicates, seed)
    values = R.weighted_auc(drawn.select("draws", F.explode("each").alias("x")).select("x.*", "draws"), ["error_target"])
    limits = values.groupBy("error_target").agg(*(F.percentile("value", F.lit(q)).alias(n) for n, q in (("auc_low", 0.025), ("auc_median", 0.5), ("auc_high", 0.975))))
    counts = observed.groupBy("error_target").agg(F.count("*").alias("patients"), F.sum(F.col("positive").cast("long")).alias("errors"))
    found = null.drop("null_p95").withColumnsRenamed({"observed": "roc_auc", "null_mean": "null_auc_mean"})
    for other in (metrics, folds, limits, counts):
        found = found.join(other, "error_target")
    passed = (F.col("roc_auc") >= least_auc) & (F.col("auc_low") > least_low) & (F.col("p") <= alpha) & F.col("all_folds_estimable") & (F.col("folds_passing") >= least_folds)
    return found.withColumn("passed", passed)
