"""Batched fits against plain ones, one model at a time, and the tests that are built on them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.operators import logistic, metrics, models
from marlstone.plans import fitted


def plain_fit(x, y, k, scaled=True, median=True):
    """Gradient descent with momentum on the usual objective: balanced weights, an L2 penalty of 1/2, free intercepts."""
    fill = np.nanmedian(x, 0)
    ready = lambda v: np.hstack([((np.where(np.isnan(v), fill, v) - m) / s), np.ones((len(v), 1))])
    m, s = 0.0, 1.0
    if scaled:
        own = np.where(np.isnan(x), fill, x)
        m, s = own.mean(0), own.std(0)
        s = np.where(s == 0, 1, s)
    z, w, free = ready(x), (len(y) / (k * np.bincount(y, minlength=k)))[y], k if k > 2 else 1
    theta, speed, hot = np.zeros((free, z.shape[1])), 0.0, np.eye(k)[y]

    def chance(z):
        e = z @ theta.T if free > 1 else np.hstack([np.zeros((len(z), 1)), z @ theta.T])
        e = np.exp(e - e.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    for _ in range(40_000):
        penalty = theta.copy()
        penalty[:, -1] = 0
        slope = ((chance(z) - hot) * w[:, None])[:, k - free :].T @ z + penalty
        if np.abs(slope).max() < 1e-8:
            break
        speed = 0.9 * speed - slope / w.sum()
        theta = theta + speed
    return lambda v: chance(ready(v))


@pytest.fixture(scope="module")
def table(spark):
    rng, n = np.random.default_rng(3), 240
    x = rng.normal(size=(n, 3)) * [1, 10, 0.1] + [0, 5, 3]
    y = np.argmax((x - x.mean(0)) / x.std(0) @ rng.normal(size=(3, 3)) + rng.gumbel(size=(n, 3)), 1)
    x[rng.random((n, 3)) < 0.1] = np.nan
    folds = np.arange(n) % 5
    rows = [(f"p{i}", int(folds[i]), f"d{y[i]}", int(y[i]), int(y[i] == 1), *(None if np.isnan(v) else float(v) for v in x[i]), 4.0) for i in range(n)]
    df = spark.createDataFrame(rows, "person_key string, outer_fold int, diagnosis string, diagnosis_id int, one int, a double, b double, c double, same double")
    return df.repartition(3), x, y, folds


@pytest.mark.parametrize("target,k", [("diagnosis_id", 3), ("one", 2)])
def test_folds_are_fitted_as_one_by_one(table, target, k):
    df, x, y, folds = table
    y = y if k == 3 else (y == 1).astype(int)
    got = {r.person_key: r.probs for r in models.logistic_oof(df, ["a", "b", "c", "same"], k, target).collect()}
    x = np.hstack([x, np.full((len(x), 1), 4.0)])
    for fold in range(5):
        fit = plain_fit(x[folds != fold], y[folds != fold], k)
        for i, p in zip(np.flatnonzero(folds == fold), fit(x[folds == fold]), strict=True):
            assert np.abs(np.array(got[f"p{i}"]) - p).max() < 1e-6


def test_columns_with_targets_and_folds_of_their_own(spark, table):
    df, x, y, folds = table
    rng, n = np.random.default_rng(8), len(y)
    targets = np.stack([y, rng.permutation(y), np.where(np.arange(n) % 3 == 0, logistic.ABSENT, y)], 1).astype(np.uint8)
    splits = np.stack([folds, rng.permutation(folds) % 4, np.where(np.arange(n) % 3 == 0, logistic.ABSENT, folds)], 1).astype(np.uint8)
    rows = spark.createDataFrame([(i, [None if np.isnan(v) else float(v) for v in x[i]], bytearray(targets[i].tobytes()), bytearray(splits[i].tobytes())) for i in range(n)], "i int, __x array<double>, __y binary, __f binary")
    fits = logistic.fitted(rows.repartition(3), 3, [0, 1, 2])
    found = {(r.i, r.column): (r.target, r.probs) for r in logistic.predicted(rows, fits, ["i"]).collect()}
    assert len(found) == 2 * n + (targets[:, 2] != logistic.ABSENT).sum()
    for j in range(3):
        there = targets[:, j] != logistic.ABSENT
        for fold in np.unique(splits[there, j]):
            own, test = there & (splits[:, j] != fold), there & (splits[:, j] == fold)
            fit = plain_fit(x[own], targets[own, j].astype(int), 3)
            for i, p in zip(np.flatnonzero(test), fit(x[test]), strict=True):
                assert found[i, j][0] == targets[i, j] and np.abs(np.array(found[i, j][1]) - p).max() < 1e-6
    cells = {(r.column, r.reference_id, r.predicted_id): r.n for r in logistic.confusions(rows, fits).collect()}
    want = {}
    for (_, j), (t, p) in found.items():
        want[j, t, int(np.argmax(p))] = want.get((j, t, int(np.argmax(p))), 0) + 1
    assert cells == want


def test_a_class_that_is_missing_in_training_is_refused(spark):
    rows = spark.createDataFrame([("a", 0, 0, 1.0), ("b", 1, 1, 2.0), ("c", 1, 0, 3.0)], "person_key string, outer_fold int, diagnosis_id int, a double")
    with pytest.raises(ValueError):
        models.logistic_oof(rows, ["a"], 2)


def test_separable_classes_settle(spark):
    rows = spark.createDataFrame([(f"p{i}", i % 5, int(i >= 50), float(i) * 1e6) for i in range(100)], "person_key string, outer_fold int, diagnosis_id int, a double")
    got = {r.person_key: r.probs for r in models.logistic_oof(rows, ["a"], 2).collect()}
    assert all(np.argmax(got[f"p{i}"]) == int(i >= 50) for i in [*range(45), *range(55, 100)])


def test_permutation_test_tells_a_signal_from_none(spark, table):
    df, *_ = table
    found = models.permutation_test(df, ["a", "b", "c"], 3, 40, 5).first()
    assert found.permutations == 40 and found.p == 1 / 41 and found.observed > found.null_p95 > found.null_mean
    none = df.withColumn("a", F.crc32("person_key") / 2.0**32).drop("b", "c")
    found = models.permutation_test(none, ["a"], 3, 40, 5).first()
    assert found.p > 0.05 and abs(found.observed - found.null_mean) < 0.15
    oof = models.logistic_oof(none, ["a"], 3).withColumnRenamed("diagnosis_id", "reference_id")
    assert abs(metrics.summary(metrics.per_class(metrics.confusion(oof, 3), 3)).where("metric = 'macro_f1'").first().value - found.observed) < 1e-12


def test_fold_identification(spark, table):
    df, *_ = table
    told = models.fold_identification(df.withColumn("a", F.col("outer_fold") + F.crc32("person_key") / 2.0**32), ["a"], 5, 20, 3).first()
    assert told.passed and told.p == 1 / 21 and told.macro_auc > 0.9 and abs(told.null_auc_mean - 0.5) < 0.05
    none = models.fold_identification(df, ["a", "b"], 5, 20, 3).first()
    assert not none.passed and none.permutations == 20


def test_errors_are_told_for_three_targets(spark, table):
    df, x, y, folds = table
    # the gate errs on negatives where b is large, on positives at random
    gate = df.select("person_key", (F.col("one") == 1).alias("positive"), F.when(F.col("one") == 1, F.crc32("person_key") % 3 > 0).otherwise(F.coalesce(F.col("b"), F.lit(0.0)) > 12).alias("predicted"))
    found = {r.error_target: r for r in models.error_predictability(df, gate, ["b"], 20, 200, 5).collect()}
    assert sorted(found) == sorted(models.ERROR_TARGETS)
    total, false, missed = (found[t] for t in models.ERROR_TARGETS)
    assert total.patients == len(y) == false.patients + missed.patients and total.errors == false.errors + missed.errors
    assert false.passed and false.roc_auc > 0.95 and false.p == 1 / 21 and false.auc_low <= false.auc_median <= false.auc_high and false.folds_passing == 5 and len(false.fold_auc) == 5
    assert not missed.passed and abs(missed.null_auc_mean - 0.5) < 0.15


def test_presence_models_are_dense_fits(spark, table):
    df, _, y, folds = table
    people, rng = df.select("person_key", "outer_fold", "diagnosis_id"), np.random.default_rng(1)
    names = [f"c{k}" for k in range(6)]
    had = rng.random((len(y), 6)) < 0.2 + 0.2 * (y[:, None] == np.arange(6) % 3)
    had[:7] = False
    rows = [(f"p{i}", names[k]) for i, k in zip(*np.nonzero(had), strict=True)]
    presence = spark.createDataFrame(rows + rows[:9] + [("p1", "other"), ("nobody", "c1")], "person_key string, category string")
    predictions, table_ = models.presence_models(people, presence, {"all": names, "finding": names[3:]}, 3)
    got = {(r.feature_set, r.person_key): r.probs for r in predictions.collect()}
    for name, own in (("all", had), ("finding", had[:, 3:])):
        for fold in range(5):
            fit = plain_fit(own[folds != fold].astype(float), y[folds != fold], 3, scaled=False)
            for i, p in zip(np.flatnonzero(folds == fold), fit(own[folds == fold].astype(float)), strict=True):
                assert np.abs(np.array(got[name, f"p{i}"]) - p).max() < 1e-6
    assert table_.where("feature_set = 'all'").count() == 5 * 3 * 7 and table_.where("feature_set = 'finding' AND feature = 'intercept'").count() == 15


def test_paired_ladder(spark, table):
    df, *_ = table
    sets = {"C0": ["a"], "C1": ["a", "b"], "C2": ["a", "b", "c"]}
    own = models.ladder(df.select("person_key", "outer_fold", "diagnosis_id", "a", "b", "c"), sets, 3).withColumnRenamed("diagnosis_id", "reference_id")
    found = {(r.baseline, r.candidate): r for r in models.paired_ladder(own, [("C0", "C1"), ("C1", "C2"), ("C0", "C2"), ("C1", "C1")], 3, 300, 5).collect()}
    f1 = {r.model_id: r.value for r in metrics.summary(metrics.per_class(metrics.confusion(own, 3, ["model_id"]), 3, ["model_id"]), ["model_id"]).where("metric = 'macro_f1'").collect()}
    assert len(found) == 4
    for (a, b), r in found.items():
        assert abs(r.observed - (f1[b] - f1[a])) < 1e-12 and r.low <= r.high and r.replicates == 300 and 0 <= r.share_above <= 1
    same = found["C1", "C1"]
    assert same.low == same.high == same.observed == same.share_above == 0
    # two models on the same draws are those of the paired bootstrap
    from marlstone.operators import resampling

    pick = lambda m: own.where(F.col("model_id") == m)
    low, high, n, observed, share = resampling.paired_macro_f1(pick("C0"), pick("C2"), 3, 300, 5).first()
    assert abs(observed - found["C0", "C2"].observed) < 1e-12 and abs(low - found["C0", "C2"].low) < 0.03 and abs(high - found["C0", "C2"].high) < 0.03


@pytest.mark.parametrize("bucket", [1 << 17, 40])
def test_aucs_of_all_columns_come_from_packed_scores(spark, table, monkeypatch, bucket):
    df, x, y, folds = table
    monkeypatch.setattr(logistic, "BUCKET", bucket)
    monkeypatch.setattr(logistic, "SORTED", 500)
    rng, n = np.random.default_rng(9), len(y)
    targets = np.stack([y, rng.permutation(y), np.where(np.arange(n) % 3 == 0, logistic.ABSENT, y)], 1).astype(np.uint8)
    splits = np.stack([folds, rng.permutation(folds), np.where(np.arange(n) % 3 == 0, logistic.ABSENT, folds)], 1).astype(np.uint8)
    # values of one digit: many people have equal scores
    rows = spark.createDataFrame([(i, [None if np.isnan(v) else float(v) for v in np.round(x[i] / [1, 10, 0.1])], bytearray(targets[i].tobytes()), bytearray(splits[i].tobytes())) for i in range(n)], "i int, __x array<double>, __y binary, __f binary").repartition(3)
    fits = logistic.fitted(rows, 3, [0, 1, 2])
    found = {(r.column, r.class_id): r.value for r in logistic.aucs(rows, fits, [0, 2]).collect()}
    each = logistic.predicted(rows, fits, []).select("column", "target", F.posexplode("probs").alias("class_id", "score")).where("class_id != 1")
    want = metrics.auc_of(metrics.score_counts(each, F.col("score"), F.col("target") == F.col("class_id"), ["column", "class_id"]), ["column", "class_id"]).collect()
    assert len(found) == len(want) == 6 and all(abs(found[r.column, r.class_id] - r.auc) < 1e-9 for r in want)


def test_fold_identification_makes_no_row_per_person_and_replicate(table, monkeypatch):
    df, *_ = table
    monkeypatch.setattr(logistic, "predicted", None)
    assert models.fold_identification(df, ["a"], 5, 3, 3).first().permutations == 3


def test_error_scores_are_written_of_the_observed_targets_only(table, monkeypatch):
    df, _, y, _ = table
    rows, write = {}, models.written
    monkeypatch.setattr(models, "written", lambda d, name: rows.setdefault(name, write(d, name)))
    gate = df.select("person_key", (F.col("one") == 1).alias("positive"), (F.crc32("person_key") % 3 > 0).alias("predicted"))
    assert models.error_predictability(df, gate, ["a"], 5, 20, 5).count() == 3
    assert rows["scored"].count() == 2 * len(y)


def test_presence_of_all_sets_is_gathered_once_and_coefficients_need_no_predictions(spark, table, monkeypatch):
    df, *_ = table
    people, made, write = df.select("person_key", "outer_fold", "diagnosis_id"), [], models.written
    presence = df.select("person_key", F.explode(F.array(F.concat(F.lit("a"), F.crc32("person_key") % 3), F.concat(F.lit("b"), F.crc32("person_key") % 4))).alias("category"))
    monkeypatch.setattr(models, "written", lambda d, name: made.append(name) or write(d, name))
    monkeypatch.setattr(fitted, "written", lambda d, name: made.append(name) or write(d, name))
    sets = {"all": ["a0", "a1", "a2", "b0", "b1", "b2", "b3"], "few": ["b2", "a1"]}
    _, coefs = models.presence_models(people, presence, sets, 3)
    assert made == ["presence"] and {(r.feature_set, r.feature) for r in coefs.collect()} == {(k, c) for k, v in sets.items() for c in [*v, "intercept"]}
    made.clear()
    assert fitted.presence_coefficients(spark, "/root/testdata/sf0.001").count() and "predictions" not in made
