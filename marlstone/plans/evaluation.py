"""Metrics of prediction tables (inventory I, H2, F3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions import vectors as V
from marlstone.operators import metrics as M
from marlstone.operators import models
from marlstone.operators.splits import outer_folds
from marlstone.plans import bindings as B
from marlstone.plans.book import Book

book = Book()
K = len(B.LANGUAGES)
PRED = "WITH " + B.predictions_sql("A")
TOP = "list_position(probs, list_max(probs)) - 1"
MATRIX = f"""matrix AS (SELECT r.k AS reference_id, p.k AS predicted_id, count(x.person_key) AS n FROM range(4) r(k) CROSS JOIN range(4) p(k)
 LEFT JOIN (SELECT *, {TOP} AS top FROM pred_a) x ON x.reference_id = r.k AND x.top = p.k GROUP BY ALL)"""
CLASSES = """classes AS (SELECT c.k AS class_id, sum(n) FILTER (WHERE reference_id = c.k AND predicted_id = c.k) AS tp, sum(n) FILTER (WHERE reference_id = c.k AND predicted_id <> c.k) AS fn,
 sum(n) FILTER (WHERE reference_id <> c.k AND predicted_id = c.k) AS fp, sum(n) FILTER (WHERE reference_id <> c.k AND predicted_id <> c.k) AS tn FROM matrix CROSS JOIN range(4) c(k) GROUP BY c.k),
scores AS (SELECT class_id, tp, tp + fn AS support, tp / nullif(tp + fn, 0) AS sensitivity, tn / nullif(tn + fp, 0) AS specificity, tp / nullif(tp + fp, 0) AS "precision", tn / nullif(tn + fn, 0) AS npv, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM classes)"""
AUC = """each AS (SELECT person_key, outer_fold, reference_id, unnest(range(4)) AS class_id, unnest(probs) AS score FROM pred_a),
ranks AS (SELECT class_id, reference_id = class_id AS pos, rank() OVER (PARTITION BY class_id ORDER BY score) + (count(*) OVER (PARTITION BY class_id, score) - 1) / 2.0 AS r FROM each),
aucs AS (SELECT class_id, (sum(r) FILTER (WHERE pos) - count(*) FILTER (WHERE pos) * (count(*) FILTER (WHERE pos) + 1) / 2.0) / nullif(count(*) FILTER (WHERE pos) * count(*) FILTER (WHERE NOT pos), 0) AS auc FROM ranks GROUP BY class_id)"""
ECE = f"""tops AS (SELECT list_max(probs) AS s, CAST({TOP} = reference_id AS DOUBLE) AS c FROM pred_a),
bins AS (SELECT least(9, len(list_filter([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9], lambda e: s >= CAST(e AS DOUBLE)))) AS bin, count(*) AS n, avg(c) AS share, avg(s) AS mean_score FROM tops GROUP BY 1)"""


def _metric(name, expr, source):
    return f"SELECT '{name}' AS metric, round(CAST({expr} AS DOUBLE), 6) AS value FROM {source}"


@book("i1_confusion", f"{PRED}, {MATRIX} SELECT CAST(reference_id AS INTEGER) AS reference_id, CAST(predicted_id AS INTEGER) AS predicted_id, n FROM matrix")
def confusion(spark, d):
    return M.confusion(B.predictions(spark, d), K)


@book("i2_per_class", f'{PRED}, {MATRIX}, {CLASSES} SELECT CAST(class_id AS INTEGER) AS class_id, CAST(support AS BIGINT) AS support, round(sensitivity, 6) AS sensitivity, round(specificity, 6) AS specificity, round("precision", 6) AS "precision", round(npv, 6) AS npv, round(f1, 6) AS f1 FROM scores')
def per_class(spark, d):
    return B.rounded(M.per_class(M.confusion(B.predictions(spark, d), K), K).drop("tp"))


SUMMARY = " UNION ALL ".join(_metric(n, e, "scores") for n, e in [("accuracy", "sum(tp) / sum(support)"), ("balanced_accuracy", "avg(sensitivity)"), ("macro_f1", "avg(f1)"), ("weighted_f1", "sum(f1 * support) / sum(support)"), ("patients", "sum(support)")])


@book("i3_summary_metrics", f"{PRED}, {MATRIX}, {CLASSES} {SUMMARY}")
def summary(spark, d):
    return B.rounded(M.summary(M.per_class(M.confusion(B.predictions(spark, d), K), K)))


RANK = "1 + len(list_filter(range(4), lambda j: probs[j + 1] > probs[reference_id + 1] OR (probs[j + 1] = probs[reference_id + 1] AND j < reference_id)))"


@book("i4_top2_accuracy", f"{PRED} {_metric('top2_accuracy', f'avg(CAST({RANK} <= 2 AS DOUBLE))', 'pred_a')}")
def top2(spark, d):
    return B.rounded(M.row_means(B.predictions(spark, d)).where("metric = 'top2_accuracy'"))


@book("i5_one_vs_rest_auc", f"{PRED}, {AUC} SELECT CAST(class_id AS INTEGER) AS class_id, round(auc, 6) AS auc FROM aucs")
def auc(spark, d):
    return B.rounded(M.one_vs_rest(B.predictions(spark, d), K))


@book("i5_macro_auc", f"{PRED}, {AUC} {_metric('macro_auc', 'avg(auc)', 'aucs')}")
def macro_auc(spark, d):
    return B.rounded(M.macro_auc(B.predictions(spark, d), K))


@book("i6_multiclass_brier", f"{PRED} {_metric('multiclass_brier', 'avg(list_sum(list_transform(range(4), lambda j: (probs[j + 1] - CAST(j = reference_id AS INTEGER)) ** 2)))', 'pred_a')}")
def brier(spark, d):
    return B.rounded(M.row_means(B.predictions(spark, d)).where("metric = 'multiclass_brier'"))


@book("i7_top_label_ece", f"{PRED}, {ECE} {_metric('ece', 'sum(n * abs(share - mean_score)) / sum(n)', 'bins')}")
def ece(spark, d):
    return B.rounded(M.top_label_ece(B.predictions(spark, d)))


FOLDED = f"""WITH {B.predictions_sql("A")}, tops AS (SELECT outer_fold, reference_id, {TOP} AS top, {RANK} AS rk, probs FROM pred_a),
fc AS (SELECT outer_fold, c.k, count(*) FILTER (WHERE reference_id = c.k AND top = c.k) AS tp, count(*) FILTER (WHERE reference_id = c.k AND top <> c.k) AS fn, count(*) FILTER (WHERE reference_id <> c.k AND top = c.k) AS fp FROM tops CROSS JOIN range(4) c(k) GROUP BY ALL),
fm AS (SELECT outer_fold, 'accuracy' AS metric, sum(tp) / sum(tp + fn) AS value FROM fc GROUP BY 1 UNION ALL SELECT outer_fold, 'balanced_accuracy', avg(tp / nullif(tp + fn, 0)) FROM fc GROUP BY 1
 UNION ALL SELECT outer_fold, 'macro_f1', avg(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)) FROM fc GROUP BY 1)"""
NAMES = ["accuracy", "balanced_accuracy", "macro_f1"]


@book("i8_fold_metrics", f"{FOLDED} SELECT outer_fold, metric, round(value, 6) AS value FROM fm")
def fold_metrics(spark, d):
    own = M.summary(M.per_class(M.confusion(B.predictions(spark, d), K, ["outer_fold"]), K, ["outer_fold"]), ["outer_fold"])
    return B.rounded(own.where(F.col("metric").isin(NAMES)))


@book("i8_over_folds", f"{FOLDED} SELECT metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM fm GROUP BY metric")
def over_folds(spark, d):
    own = M.summary(M.per_class(M.confusion(B.predictions(spark, d), K, ["outer_fold"]), K, ["outer_fold"]), ["outer_fold"])
    return B.rounded(M.over_folds(own.where(F.col("metric").isin(NAMES))))


@book("i9_report", f"""{PRED}, {MATRIX}, {CLASSES}, {AUC} SELECT CAST(s.class_id AS INTEGER) AS class_id, CAST(support AS BIGINT) AS support, round(coalesce("precision", 0), 6) AS "precision", round(coalesce(sensitivity, 0), 6) AS recall, round(f1, 6) AS f1, round(auc, 6) AS auc FROM scores s JOIN aucs USING (class_id)""")
def report(spark, d):
    pred = B.predictions(spark, d)
    classes = M.per_class(M.confusion(pred, K), K)
    own = classes.join(M.one_vs_rest(pred, K), "class_id")
    return B.rounded(own.select("class_id", "support", F.coalesce("precision", F.lit(0.0)).alias("precision"), F.coalesce("sensitivity", F.lit(0.0)).alias("recall"), "f1", "auc"))


GATE = "WITH " + B.gate_sql("A")
GATE_ALL = f"""{GATE}, g AS (SELECT count(*) FILTER (WHERE positive AND predicted) AS tp, count(*) FILTER (WHERE positive AND NOT predicted) AS fn, count(*) FILTER (WHERE NOT positive AND predicted) AS fp, count(*) FILTER (WHERE NOT positive AND NOT predicted) AS tn,
 avg((score - CAST(positive AS DOUBLE)) ** 2) AS brier, avg(-ln(greatest(CASE WHEN positive THEN score ELSE 1 - score END, 1e-12))) AS nll FROM gate_a),
gr AS (SELECT positive, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM gate_a),
ga AS (SELECT (sum(r) FILTER (WHERE positive) - count(*) FILTER (WHERE positive) * (count(*) FILTER (WHERE positive) + 1) / 2.0) / (count(*) FILTER (WHERE positive) * count(*) FILTER (WHERE NOT positive)) AS auc FROM gr),
gs AS (SELECT score, count(*) FILTER (WHERE positive) AS p, count(*) AS n FROM gate_a GROUP BY score),
gp AS (SELECT sum(p * cp / cn) / max(tp) AS ap FROM (SELECT p, sum(p) OVER w AS cp, sum(n) OVER w AS cn, sum(p) OVER () AS tp FROM gs WINDOW w AS (ORDER BY score DESC))),
gb AS (SELECT len(list_filter([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9], lambda e: score >= CAST(e AS DOUBLE))) AS bin, count(*) AS n, avg(CAST(positive AS DOUBLE)) AS share, avg(score) AS m FROM gate_a GROUP BY 1),
sp AS (SELECT *, tp / (tp + fn) AS sens, tn / (tn + fp) AS spec FROM g)"""
GATE_ROWS = [
    ("abnormal_sensitivity", "sens", "sp"), ("normal_specificity", "spec", "sp"), ("balanced_accuracy", "(sens + spec) / 2", "sp"), ("macro_f1", "(2 * tp / (2 * tp + fp + fn) + 2 * tn / (2 * tn + fp + fn)) / 2", "sp"),
    ("binary_brier", "brier", "sp"), ("nll", "nll", "sp"), ("roc_auc", "auc", "ga"), ("pr_auc", "ap", "gp"), ("binary_ece", "sum(n * abs(share - m)) / sum(n)", "gb"),
]


@book("i10_gate_metrics", GATE_ALL + " " + " UNION ALL ".join(_metric(*x) for x in GATE_ROWS))
def gate(spark, d):
    return B.rounded(M.gate_metrics(B.gate(spark, d)))


@book("i11_binary_ece", GATE_ALL + " " + _metric(*GATE_ROWS[8]))
def binary_ece(spark, d):
    return B.rounded(M.binary_ece(B.gate(spark, d)))


@book("i12_log_likelihood", GATE_ALL + " " + _metric(*GATE_ROWS[5]))
def nll(spark, d):
    return B.rounded(M.gate_metrics(B.gate(spark, d)).where("metric = 'nll'"))





#: The CTEs of model B without those that it shares with A.
PRED_B = "cells_b AS" + B.predictions_sql("B").split("cells_b AS", 1)[1]


@book("i13_compare_methods", f"{PRED}, {PRED_B} SELECT 'accuracy' AS metric, round((SELECT avg(CAST({TOP} = reference_id AS DOUBLE)) FROM pred_a), 6) AS a, round((SELECT avg(CAST({TOP} = reference_id AS DOUBLE)) FROM pred_b), 6) AS b "
      f"UNION ALL SELECT 'top2_accuracy', round((SELECT avg(CAST({RANK} <= 2 AS DOUBLE)) FROM pred_a), 6), round((SELECT avg(CAST({RANK} <= 2 AS DOUBLE)) FROM pred_b), 6)")
def compare(spark, d):
    parts = []
    for m in "ab":
        pred = B.predictions(spark, d, m.upper())
        own = M.summary(M.per_class(M.confusion(pred, K), K)).where("metric = 'accuracy'").unionByName(M.row_means(pred).where("metric = 'top2_accuracy'"))
        if m == "a":  # one that only the first method has
            own = own.unionByName(M.row_means(pred).where("metric = 'multiclass_brier'"))
        parts.append(own.withColumn("method", F.lit(m)))
    return B.rounded(M.compare(M.union_all(parts), ["a", "b"]))


@book("h2_prior_baseline", f"WITH {B.LETTERS}, {B.folds_sql('letters', 'lf')}, f AS (SELECT DISTINCT outer_fold FROM lf), n AS (SELECT f.outer_fold, lf.diagnosis_id, count(*) AS n FROM f JOIN lf ON lf.outer_fold <> f.outer_fold GROUP BY ALL) SELECT outer_fold, diagnosis_id, round(n / sum(n) OVER (PARTITION BY outer_fold), 6) AS prior FROM n")
def prior(spark, d):
    return B.rounded(models.prior_oof(outer_folds(B.letters(spark, d), 5, B.SEED)))


@book("h_centroid_oof", f"{PRED} SELECT person_key, outer_fold, reference_id, round(probs[1], 6) AS prob_de, round(probs[2], 6) AS prob_en, round(probs[3], 6) AS prob_es, round(probs[4], 6) AS prob_fr FROM pred_a")
def centroid(spark, d):
    return B.rounded(B.predictions(spark, d).select("person_key", "outer_fold", "reference_id", *V.wide(F.col("probs"), B.LANGUAGES)))


@book("f3_top_predictions", f"{PRED}, o AS (SELECT person_key, list_sort(list_transform(range(4), lambda j: {{'p': -probs[j + 1], 'j': j}})) AS s FROM pred_a) SELECT person_key, {B.LANGUAGES}[s[1].j + 1] AS top1, round(-s[1].p, 6) AS top1_prob, {B.LANGUAGES}[s[2].j + 1] AS top2, round(-s[2].p, 6) AS top2_prob FROM o")
def top(spark, d):
    ordered = F.array_sort(F.transform("probs", lambda x, i: F.struct((-x).alias("p"), i.alias("j"))))
    names = F.array(*(F.lit(x) for x in B.LANGUAGES))
    own = B.predictions(spark, d).select("person_key", ordered.alias("s"))
    at = lambda k: F.element_at("s", k)
    return B.rounded(own.select("person_key", F.element_at(names, at(1)["j"] + 1).alias("top1"), (-at(1)["p"]).alias("top1_prob"), F.element_at(names, at(2)["j"] + 1).alias("top2"), (-at(2)["p"]).alias("top2_prob")))
