"""Thresholds, calibration, fusion and gates (K, M2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions import vectors as V
from marlstone.operators import contracts as C
from marlstone.operators import gates as G
from marlstone.operators import metrics as M
from marlstone.plans import bindings as B
from marlstone.plans.book import Book
from marlstone.plans.evaluation import GATE, GATE_ALL, PRED, PRED_B

book = Book()
GRID = [0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0]


def best_threshold(source, by):
    keys = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    fixed = f"SELECT DISTINCT {keys}unnest([0.0::DOUBLE, 0.5, 1.0]) AS score, 0 AS p, 0 AS q FROM {source}"
    group = f"GROUP BY {by}" if by else ""
    return f"""cand AS (SELECT {keys}score, sum(p) AS p, sum(q) AS q FROM (SELECT {keys}score, CAST(positive AS INTEGER) AS p, 1 - CAST(positive AS INTEGER) AS q FROM {source} UNION ALL {fixed}) GROUP BY ALL),
ss AS (SELECT {keys}score, (sum(p) OVER ({part}) - (sum(p) OVER ({part} ORDER BY score) - p)) / nullif(sum(p) OVER ({part}), 0) AS sens, (sum(q) OVER ({part} ORDER BY score) - q) / nullif(sum(q) OVER ({part}), 0) AS spec FROM cand),
thr AS (SELECT {keys}max({{'a': spec, 'b': sens, 't': score}}) FILTER (WHERE sens >= 0.9) AS m FROM ss {group})"""


@book("k1_operating_threshold", f"{GATE}, {best_threshold('gate_a', '')} SELECT round(coalesce(m.t, 0.5), 6) AS threshold, round(coalesce(m.b, 0), 6) AS sensitivity, round(coalesce(m.a, 0), 6) AS specificity, m IS NOT NULL AS met FROM thr")
def threshold(spark, d):
    return B.rounded(G.thresholds(B.gate(spark, d), 0.9))


SCALED = "1 / (1 + exp((ln(least(greatest(1 - {s}, 1e-12), 1)) - ln(least(greatest({s}, 1e-12), 1))) / {t}))"


@book("k2_temperature", f"{GATE} SELECT person_key, round({SCALED.format(s='score', t='2.5')}, 6) AS score FROM gate_a")
def temperature(spark, d):
    return B.rounded(B.gate(spark, d).select("person_key", G.tempered_score(F.col("score"), F.lit(2.5)).alias("score")))


def loss(score):
    return f"avg(-ln(greatest(CASE WHEN positive THEN {score} ELSE 1 - {score} END, 1e-12)))"


FIT = f"fit AS (SELECT t.t, round({loss(SCALED.format(s='score', t='t.t'))}, 9) AS nll FROM gate_a CROSS JOIN (SELECT unnest({GRID}) AS t) t GROUP BY t.t), bf AS (SELECT {loss('score')} AS b FROM gate_a), bt AS (SELECT min({{'n': nll, 't': CAST(t AS DOUBLE)}}) AS m FROM fit)"


@book("k3_fit_temperature", f"{GATE}, {FIT} SELECT CASE WHEN m.n <= b + 1e-12 THEN m.t ELSE 1 END AS temperature, round(b, 6) AS before, round(CASE WHEN m.n <= b + 1e-12 THEN m.n ELSE b END, 6) AS after FROM bt, bf")
def fit_temperature(spark, d):
    return B.rounded(G.fit_temperature(B.gate(spark, d), GRID))


@book("k4_calibrated_predictions", f"""{GATE}, val AS (SELECT (outer_fold + 4) % 5 AS outer_fold, positive, score FROM gate_a), fit AS (SELECT outer_fold, t.t, round({loss(SCALED.format(s='score', t='t.t'))}, 9) AS nll FROM val CROSS JOIN (SELECT unnest({GRID}) AS t) t GROUP BY ALL), bf AS (SELECT outer_fold, {loss('score')} AS b FROM val GROUP BY 1),
 tp AS (SELECT outer_fold, CASE WHEN m.n <= b + 1e-12 THEN m.t ELSE 1 END AS t FROM (SELECT outer_fold, min({{'n': nll, 't': CAST(t AS DOUBLE)}}) AS m FROM fit GROUP BY 1) JOIN bf USING (outer_fold)),
 vs AS (SELECT v.outer_fold, positive, round({SCALED.format(s='score', t='t')}, 9) AS score FROM val v JOIN tp USING (outer_fold)), {best_threshold('vs', 'outer_fold')},
 ts AS (SELECT person_key, g.outer_fold, positive, round({SCALED.format(s='score', t='t')}, 9) AS score FROM gate_a g JOIN tp USING (outer_fold))
 SELECT outer_fold, count(*) AS n, count(*) FILTER (WHERE (score >= coalesce(m.t, 0.5)) = positive) AS correct FROM ts JOIN thr USING (outer_fold) GROUP BY 1""")
def calibrated(spark, d):
    test = B.gate(spark, d)
    validation = test.withColumn("outer_fold", (F.col("outer_fold") + 4) % 5)
    own = G.calibrated_predictions(test, validation, 0.9, GRID)
    return own.groupBy("outer_fold").agg(F.count("*").alias("n"), F.sum((F.col("predicted") == F.col("positive")).cast("long")).alias("correct"))


BOUNDS = [("roc_auc", ">=", 0.8), ("pr_auc", ">=", 0.9), ("abnormal_sensitivity", ">=", 0.9), ("normal_specificity", ">=", 0.5), ("macro_f1", ">=", 0.7), ("balanced_accuracy", ">=", 0.7), ("binary_brier", "<=", 0.15), ("binary_ece", "<=", 0.1)]
VALUES = {"roc_auc": "(SELECT auc FROM ga)", "pr_auc": "(SELECT ap FROM gp)", "abnormal_sensitivity": "(SELECT sens FROM sp)", "normal_specificity": "(SELECT spec FROM sp)", "macro_f1": "(SELECT (2 * tp / (2 * tp + fp + fn) + 2 * tn / (2 * tn + fp + fn)) / 2 FROM sp)", "balanced_accuracy": "(SELECT (sens + spec) / 2 FROM sp)", "binary_brier": "(SELECT brier FROM sp)", "binary_ece": "(SELECT sum(n * abs(share - m)) / sum(n) FROM gb)"}


@book("k5_gate_evaluation", GATE_ALL + " " + " UNION ALL ".join(f"SELECT '{n}' AS gate, round({VALUES[n]}, 6) AS value, {b}::DOUBLE AS bound, {VALUES[n]} {s} {b} AS passed" for n, s, b in BOUNDS))
def gate_evaluation(spark, d):
    return B.rounded(G.gate_table(M.gate_metrics(B.gate(spark, d)), BOUNDS))


@book("k6_shortcut_risk", "SELECT p_partkey, CASE WHEN p_size / 100 <= 0.05 AND p_retailprice / 2000 >= 0.6 THEN 'high' WHEN p_size / 100 <= 0.05 AND p_retailprice / 2000 >= 0.4 THEN 'moderate' ELSE 'low' END AS risk FROM part")
def shortcut_risk(spark, d):
    return B.table(spark, d, "part").select("p_partkey", G.shortcut_risk(F.col("p_retailprice") / 2000, F.col("p_size") / 100).alias("risk"))


FUSED = f"""{PRED}, {PRED_B}, fu AS (SELECT a.person_key, a.outer_fold, CASE WHEN a.reference_id > 2 THEN a.reference_id - 1 ELSE a.reference_id END AS ref, [a.probs[1], a.probs[2], a.probs[4]] AS x, [b.probs[1], b.probs[2], b.probs[4]] AS y FROM pred_a a JOIN pred_b b USING (person_key) WHERE a.reference_id <> 2),
fv AS (SELECT *, list_transform(x, lambda v: v / nullif(x[1] + x[2] + x[3], 0)) AS ap, list_transform(y, lambda v: v / nullif(y[1] + y[2] + y[3], 0)) AS bp FROM fu),
fp AS (SELECT *, list_transform([1, 2, 3], lambda i: 0.75::DOUBLE * ap[i] + 0.25::DOUBLE * bp[i]) AS probs, CASE WHEN list_max(ap) IS NOT NULL THEN list_position(ap, list_max(ap)) - 1 <> ref END AS aw, CASE WHEN list_max(bp) IS NOT NULL THEN list_position(bp, list_max(bp)) - 1 <> ref END AS bw FROM fv)"""


def fused(spark, d):
    return G.fused(B.predictions(spark, d, "A"), B.predictions(spark, d, "B"), 2, 0.75)


@book("k7_fused_probabilities", f"{FUSED} SELECT person_key, CAST(ref AS INTEGER) AS reference_id, round(probs[1], 6) AS p0, round(probs[2], 6) AS p1, round(probs[3], 6) AS p2 FROM fp")
def fused_probabilities(spark, d):
    return B.rounded(fused(spark, d).select("person_key", "reference_id", *(F.element_at("probs", k + 1).alias(f"p{k}") for k in range(3))))


COMPLEMENT = "SELECT count(*) FILTER (WHERE aw) AS a_errors, count(*) FILTER (WHERE aw AND NOT bw) AS rescued_by_b, count(*) FILTER (WHERE bw) AS b_errors, count(*) FILTER (WHERE bw AND NOT aw) AS rescued_by_a, count(*) FILTER (WHERE aw AND bw) AS both_wrong, count(*) FILTER (WHERE NOT aw AND NOT bw) AS both_right, count(DISTINCT outer_fold) FILTER (WHERE aw AND NOT bw) AS n_folds, count(DISTINCT ref) FILTER (WHERE aw AND NOT bw) AS n_classes, coalesce(count(*) FILTER (WHERE aw AND NOT bw) / nullif(count(*) FILTER (WHERE aw), 0), 0) AS rescue_fraction FROM fp"


@book("k8_error_complementarity", f"{FUSED} SELECT * REPLACE (round(rescue_fraction, 6) AS rescue_fraction) FROM ({COMPLEMENT})")
def complementarity(spark, d):
    own = G.complementarity(fused(spark, d))
    return B.rounded(own.select("a_errors", "rescued_by_b", "b_errors", "rescued_by_a", "both_wrong", "both_right", F.size("folds").cast("long").alias("n_folds"), F.size("classes").cast("long").alias("n_classes"), "rescue_fraction"))


KINDS = {"fused_accuracy": "blend", "rescue_fraction": "rescue", "n_folds": "rescue", "n_classes": "rescue"}


@book("k9_fusion_decision", f"{FUSED}, c AS ({COMPLEMENT}), b AS (SELECT avg(CAST(CASE WHEN list_max(probs) IS NOT NULL THEN list_position(probs, list_max(probs)) - 1 = ref END AS DOUBLE)) >= 0.99 AS ok FROM fp), r AS (SELECT rescue_fraction >= 0.1 AND n_folds >= 3 AND n_classes >= 2 AS ok FROM c) SELECT b.ok AS blend_passed, r.ok AS rescue_passed, CASE WHEN b.ok OR r.ok THEN 'advance' ELSE 'stop' END AS decision FROM b, r")
def fusion_decision(spark, d):
    own = fused(spark, d)
    c = G.complementarity(own).select(F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), v.cast("double").alias("value")) for n, v in (("rescue_fraction", F.col("rescue_fraction")), ("n_folds", F.size("folds")), ("n_classes", F.size("classes")))))).alias("m")).select("m.*")
    accuracy = own.agg(F.lit("fused_accuracy").alias("metric"), F.avg((V.argmax(F.col("probs")) == F.col("reference_id")).cast("double")).alias("value"))
    bounds = [("fused_accuracy", ">=", 0.99), ("rescue_fraction", ">=", 0.1), ("n_folds", ">=", 3), ("n_classes", ">=", 2)]
    return G.decision(G.gate_table(accuracy.unionByName(c), bounds), KINDS)


@book("k10_interpretations", "WITH v AS (SELECT p_brand AS g, avg(p_size) > 25 AS s, avg(p_retailprice) > 1100 AS e, count(*) % 2 = 0 AS a FROM part GROUP BY 1), n AS (SELECT g, list_filter([CASE WHEN s AND e THEN 'shift_with_errors' END, CASE WHEN s AND NOT e THEN 'shift_only' END, CASE WHEN NOT s AND e THEN 'errors_only' END, CASE WHEN a THEN 'associated' END], lambda x: x IS NOT NULL) AS l FROM v) SELECT g AS \"group\", CASE WHEN len(l) > 0 THEN array_to_string(l, ';') ELSE 'none' END AS interpretation FROM n")
def interpretations(spark, d):
    v = B.table(spark, d, "part").groupBy(F.col("p_brand").alias("group")).agg((F.avg("p_size") > 25).alias("shift"), (F.avg("p_retailprice") > 1100).alias("error"), (F.count("*") % 2 == 0).alias("association"))
    return G.interpretations(v)


@book("k11_wide_output", f"{FUSED} SELECT person_key, outer_fold, round(ap[1], 6) AS a_p0, round(bp[1], 6) AS b_p0, round(probs[1], 6) AS f_p0, CASE WHEN list_max(probs) IS NOT NULL THEN CAST(list_position(probs, list_max(probs)) - 1 AS INTEGER) END AS top1, CASE WHEN list_max(probs) IS NOT NULL THEN list_position(probs, list_max(probs)) - 1 = ref END AS correct FROM fp")
def wide_output(spark, d):
    top = V.argmax(F.col("probs"))
    first = lambda c: F.element_at(c, 1)
    return B.rounded(fused(spark, d).select("person_key", "outer_fold", first("a_probs").alias("a_p0"), first("b_probs").alias("b_p0"), first("probs").alias("f_p0"), top.alias("top1"), (top == F.col("reference_id")).alias("correct")))


@book("m2_gate_contract", f"{GATE} SELECT 'prediction' AS rule, count(*) FILTER (WHERE predicted <> (score >= 0.5)) AS n_violations FROM gate_a UNION ALL SELECT 'one_setting', CAST(0 AS BIGINT) UNION ALL SELECT 'both_classes', count(*) FROM (SELECT outer_fold FROM gate_a GROUP BY 1 HAVING count(DISTINCT positive) < 2)")
def gate_contract(spark, d):
    return C.gate_violations(B.gate(spark, d).withColumn("threshold", F.lit(0.5)).withColumn("temperature", F.lit(1.0)))
