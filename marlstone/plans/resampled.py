"""Resampling and shift tests (J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.operators import resampling as R
from marlstone.operators.dealing import PIECE, bits_sql, cells_sql, weights_sql
from marlstone.operators.splits import outer_folds
from marlstone.plans import bindings as B
from marlstone.plans.book import Book
from marlstone.plans.evaluation import K, PRED_B, TOP
from marlstone.sources.tables import written

book = Book()
REPLICATES, DRAWS = 2000, 5


def macro_sql(source, predicted, by):
    """Mean F1 over four classes from rows (by, reference_id, predicted, n)."""
    keys, own = ", ".join([*by, "c.k"]), ", ".join(by)
    return f"""SELECT {own + ', ' if by else ''}avg(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)) AS value FROM (
  SELECT {keys}, coalesce(sum(n) FILTER (WHERE reference_id = c.k AND {predicted} = c.k), 0) AS tp, coalesce(sum(n) FILTER (WHERE reference_id = c.k AND {predicted} <> c.k), 0) AS fn,
         coalesce(sum(n) FILTER (WHERE reference_id <> c.k AND {predicted} = c.k), 0) AS fp FROM {source} CROSS JOIN range(4) c(k) GROUP BY {keys}){' GROUP BY ' + own if by else ''}"""


def limits_sql(values, observed, more=""):
    return f"SELECT round(quantile_cont(value, 0.025), 6) AS low, round(quantile_cont(value, 0.975), 6) AS high, count(value) AS replicates, round(({observed}), 6) AS observed{more} FROM {values}"


def auc_sql(name, source, by, weight="w"):
    """CTEs up to ``name`` (by, value): mid-rank AUC of (by, score, positive, weight)."""
    keys = ", ".join(by)
    return f"""{name}_s AS (SELECT {keys}{', ' if by else ''}score, coalesce(sum({weight}) FILTER (WHERE positive), 0) AS p, coalesce(sum({weight}) FILTER (WHERE NOT positive), 0) AS q FROM {source} GROUP BY ALL),
{name} AS (SELECT {keys}{', ' if by else ''}sum(p * (below + q / 2)) / nullif(sum(p)::DOUBLE * sum(q), 0) AS value FROM (SELECT *, sum(q) OVER ({'PARTITION BY ' + keys if by else ''} ORDER BY score) - q AS below FROM {name}_s){' GROUP BY ' + keys if by else ''})"""


J1 = f"""WITH RECURSIVE {B.predictions_sql('A')}, cell AS (SELECT reference_id, CAST({TOP} AS INTEGER) AS predicted_id, count(*) AS n FROM pred_a GROUP BY ALL),
{cells_sql('drawn', 'cell', 'reference_id', ['reference_id', 'predicted_id'], REPLICATES, DRAWS)}, v AS ({macro_sql('drawn', 'predicted_id', ['replicate'])}), o AS ({macro_sql('cell', 'predicted_id', [])}) {limits_sql('v', 'SELECT value FROM o')}"""


@book("j1_bootstrap_macro_f1", J1)
def bootstrap_macro_f1(spark, d):
    return B.rounded(R.bootstrap_macro_f1(B.predictions(spark, d), K, REPLICATES, DRAWS))


J3 = f"""WITH RECURSIVE {B.predictions_sql('A')}, {PRED_B},
cell AS (SELECT a.reference_id, CAST({TOP.replace('probs', 'a.probs')} AS INTEGER) AS pa, CAST({TOP.replace('probs', 'b.probs')} AS INTEGER) AS pb, count(*) AS n FROM pred_a a JOIN pred_b b USING (person_key) GROUP BY ALL),
{cells_sql('drawn', 'cell', 'reference_id', ['reference_id', 'pa', 'pb'], REPLICATES, DRAWS)},
va AS ({macro_sql('drawn', 'pa', ['replicate'])}), vb AS ({macro_sql('drawn', 'pb', ['replicate'])}), oa AS ({macro_sql('cell', 'pa', [])}), ob AS ({macro_sql('cell', 'pb', [])}),
v AS (SELECT vb.value - va.value AS value FROM va JOIN vb USING (replicate)) {limits_sql('v', '(SELECT value FROM ob) - (SELECT value FROM oa)', ', round(avg(CAST(value > 0 AS DOUBLE)), 6) AS share_above')}"""


@book("j3_paired_macro_f1", J3)
def paired(spark, d):
    return B.rounded(R.paired_macro_f1(B.predictions(spark, d, "A"), B.predictions(spark, d, "B"), K, REPLICATES, DRAWS))


def auc_limits_sql(source, before, strata):
    return f"""WITH RECURSIVE {before}, {weights_sql('drawn', source, strata, 'person_key', REPLICATES, DRAWS)},
{auc_sql('v', 'drawn', ['replicate'])}, {auc_sql('o', source, [], '1')} {limits_sql('v', 'SELECT value FROM o')}"""


@book("j4_bootstrap_auc", auc_limits_sql("gate_a", B.gate_sql("A"), ["positive"]))
def bootstrap_auc(spark, d):
    return B.rounded(R.bootstrap_auc(B.gate(spark, d), REPLICATES, DRAWS))


@book("j5_stratified_bootstrap", auc_limits_sql("gate_a", B.gate_sql("A"), ["outer_fold", "positive"]))
def stratified(spark, d):
    return B.rounded(R.bootstrap_auc(B.gate(spark, d), REPLICATES, DRAWS, ["outer_fold", "positive"]))


J5 = f"""WITH RECURSIVE {B.gate_sql('A')}, {weights_sql('drawn', 'gate_a', ['outer_fold', 'positive'], 'person_key', REPLICATES, DRAWS)},
v AS (SELECT replicate, sum(CASE WHEN predicted = positive THEN w ELSE 0 END) / sum(w)::DOUBLE AS value FROM drawn GROUP BY replicate) {limits_sql('v', 'SELECT avg(CAST(predicted = positive AS DOUBLE)) FROM gate_a')}"""


@book("j5_stratified_accuracy", J5)
def stratified_accuracy(spark, d):
    own = B.gate(spark, d).withColumn("right", (F.col("predicted") == F.col("positive")).cast("double"))
    observed = own.agg(F.avg("right").alias("observed"))
    return B.rounded(R.bootstrap(own, ["outer_fold", "positive"], "person_key", REPLICATES, DRAWS, lambda df: R.weighted_mean(df, "right"), observed))


@book("j2_bootstrap_class_auc", auc_limits_sql("one", B.predictions_sql("A") + ", one AS (SELECT person_key, reference_id = 1 AS positive, probs[2] AS score FROM pred_a)", ["positive"]))
def class_auc(spark, d):
    own = B.predictions(spark, d).select("person_key", (F.col("reference_id") == 1).alias("positive"), F.element_at("probs", 2).alias("score"))
    return B.rounded(R.bootstrap_auc(own, REPLICATES, DRAWS))


J2 = f"""WITH RECURSIVE {B.predictions_sql('A')}, {weights_sql('drawn', 'pred_a', ['reference_id'], 'person_key', REPLICATES, DRAWS)},
each AS (SELECT replicate, w, class_id, probs[class_id + 1] AS score, reference_id = class_id AS positive FROM drawn CROSS JOIN range(4) c(class_id)), {auc_sql('a', 'each', ['replicate', 'class_id'])},
every AS (SELECT class_id, probs[class_id + 1] AS score, reference_id = class_id AS positive FROM pred_a CROSS JOIN range(4) c(class_id)), {auc_sql('o', 'every', ['class_id'], '1')},
v AS (SELECT replicate, avg(value) AS value FROM a GROUP BY replicate) {limits_sql('v', 'SELECT avg(value) FROM o')}"""


@book("j2_bootstrap_macro_auc", J2)
def macro_auc(spark, d):
    return B.rounded(R.bootstrap_macro_auc(B.predictions(spark, d), K, REPLICATES, DRAWS))


@book("j6_permuted_targets", f"WITH {B.LETTERS}, {B.folds_sql('letters', 'lf')}, a AS (SELECT *, row_number() OVER (PARTITION BY outer_fold ORDER BY sha256(person_key)) AS k FROM lf), b AS (SELECT outer_fold, diagnosis_id AS permuted, row_number() OVER (PARTITION BY outer_fold ORDER BY sha256('9|permute|' || person_key)) AS k FROM lf) SELECT person_key, a.outer_fold, b.permuted FROM a JOIN b ON a.outer_fold = b.outer_fold AND a.k = b.k")
def permuted(spark, d):
    own = outer_folds(B.letters(spark, d), 5, B.SEED)
    return R.permuted(own, "outer_fold", "person_key", "diagnosis_id", 9).select("person_key", "outer_fold", "permuted")


@book("j8_adjusted_p_values", "WITH t AS (SELECT p_brand, p_type, (count(*) * 7919 % 10007) / 10007 AS p FROM part GROUP BY ALL), r AS (SELECT *, row_number() OVER (ORDER BY p) AS k, count(*) OVER () AS n FROM t) SELECT p_brand, p_type, round(p, 6) AS p, round(least(min(p * n / k) OVER (ORDER BY k DESC), 1), 6) AS q FROM r")
def adjusted(spark, d):
    own = B.table(spark, d, "part").groupBy("p_brand", "p_type").agg((F.count("*") * 7919 % 10007 / 10007).alias("p"))
    return B.rounded(R.benjamini_hochberg(own))


FEATURES = ["l_quantity", "l_partkey", "l_suppkey"]
LONG = f"""WITH {B.PEOPLE}, {B.folds_sql("people")}, li AS (SELECT f.outer_fold, l.* FROM lineitem l JOIN orders ON l_orderkey = o_orderkey JOIN folds f ON f.person_key = 'P' || o_custkey),
lg AS ({" UNION ALL ".join(f"SELECT '{f}' AS feature, outer_fold, CAST(CAST({f} AS BIGINT) + CASE WHEN outer_fold = 2 AND '{f}' = 'l_quantity' THEN 20 ELSE 0 END AS DOUBLE) AS value FROM li" for f in FEATURES)}),
ea AS (SELECT feature, f.k AS fold, outer_fold = f.k AS inside, value FROM lg CROSS JOIN range(5) f(k)),
st AS (SELECT feature, fold, count(*) FILTER (WHERE inside) AS fn, count(*) FILTER (WHERE NOT inside) AS rn, avg(value) FILTER (WHERE inside) AS fold_mean, avg(value) FILTER (WHERE NOT inside) AS rest_mean, var_pop(value) FILTER (WHERE inside) AS fv, var_pop(value) FILTER (WHERE NOT inside) AS rv,
 quantile_cont(value, 0.5) FILTER (WHERE inside) AS fold_median, quantile_cont(value, 0.25) FILTER (WHERE inside) AS fold_q25, quantile_cont(value, 0.75) FILTER (WHERE inside) AS fold_q75, quantile_cont(value, 0.5) FILTER (WHERE NOT inside) AS rest_median, quantile_cont(value, 0.25) FILTER (WHERE NOT inside) AS rest_q25, quantile_cont(value, 0.75) FILTER (WHERE NOT inside) AS rest_q75 FROM ea GROUP BY ALL),
vc AS (SELECT feature, fold, value, count(*) FILTER (WHERE inside) AS a, count(*) FILTER (WHERE NOT inside) AS b FROM ea GROUP BY ALL),
ks AS (SELECT feature, fold, max(abs(ca / fn - cb / rn)) AS ks FROM (SELECT feature, fold, sum(a) OVER w AS ca, sum(b) OVER w AS cb FROM vc WINDOW w AS (PARTITION BY feature, fold ORDER BY value)) JOIN st USING (feature, fold) GROUP BY ALL)"""


#: The asymptotic two-sided p-value of each distance, and one Benjamini-Hochberg family.
KS_P = f"""x AS (SELECT *, ks * sqrt(fn::DOUBLE * rn / (fn + rn)) AS z, abs(fold_mean - rest_mean) / sqrt((fv + rv) / 2) AS abs_smd FROM st JOIN ks USING (feature, fold)),
pv AS (SELECT *, CASE WHEN z < 0.2 THEN 1.0 ELSE least(greatest({" + ".join(f"({2.0 * (-1) ** (k - 1)} * exp({-2.0 * k * k} * z * z))" for k in range(1, 21))}, 0.0), 1.0) END AS p FROM x),
qv AS (SELECT *, least(1.0, min(a) OVER (ORDER BY r DESC)) AS q FROM (SELECT *, p * count(*) OVER () / r AS a FROM (SELECT *, row_number() OVER (ORDER BY p) AS r FROM pv)))"""
ALPHA, BROAD, LARGE = 0.05, 0.2, 0.5


def features(spark, d):
    folds = outer_folds(B.people(spark, d), 5, B.SEED).select("person_key", "outer_fold")
    li = B.table(spark, d, "lineitem").join(B.table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.concat(F.lit("P"), F.col("o_custkey").cast("string")).alias("person_key")), "l_orderkey").join(folds, "person_key")
    moved = F.when((F.col("outer_fold") == 2) & (F.col("f.n") == "l_quantity"), 20).otherwise(0)
    each = li.select("outer_fold", F.explode(F.array(*(F.struct(F.lit(f).alias("n"), F.col(f).cast("long").alias("v")) for f in FEATURES))).alias("f"))
    return each.select(F.col("f.n").alias("feature"), "outer_fold", (F.col("f.v") + moved).cast("double").alias("value"))


def shifts(spark, d):
    return R.fold_shifts(features(spark, d), list(range(5)))


@book("j9_mean_differences", f"{LONG} SELECT feature, CAST(fold AS INTEGER) AS fold, round(abs(fold_mean - rest_mean) / sqrt((fv + rv) / 2), 6) AS abs_smd FROM st")
def mean_differences(spark, d):
    return B.rounded(R.mean_differences(features(spark, d), list(range(5))).select("feature", "fold", "abs_smd"))


@book("j10_fold_shifts", f"{LONG}, {KS_P} SELECT feature, CAST(fold AS INTEGER) AS fold, round(fold_mean, 6) AS fold_mean, fold_median, fold_q25, fold_q75, round(rest_mean, 6) AS rest_mean, rest_median, rest_q25, rest_q75, round(abs_smd, 6) AS abs_smd, round(ks, 6) AS ks, round(p, 6) AS p, round(q, 6) AS q FROM qv")
def fold_shifts(spark, d):
    return B.rounded(R.benjamini_hochberg(shifts(spark, d)))


@book("j10_shift_verdict", f"{LONG}, {KS_P} SELECT count(*) AS tests, count(*) FILTER (WHERE abs_smd >= {LARGE} AND q <= {ALPHA}) AS large_shifts, count(*) FILTER (WHERE abs_smd >= {BROAD} AND q <= {ALPHA}) AS moderate_shifts, avg(CAST(abs_smd >= {BROAD} AND q <= {ALPHA} AS DOUBLE)) >= 0.2 AS broad_shift FROM qv")
def shift_verdict(spark, d):
    return R.shift_summary(shifts(spark, d), LARGE, BROAD, 0.2, ALPHA)


@book("j11_rank_correlation", f"WITH {B.LETTERS}, {B.folds_sql('letters', 'lf')}, r AS (SELECT outer_fold, rank() OVER (PARTITION BY outer_fold ORDER BY a) + (count(*) OVER (PARTITION BY outer_fold, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY outer_fold ORDER BY e) + (count(*) OVER (PARTITION BY outer_fold, e) - 1) / 2.0 AS re FROM lf) SELECT outer_fold, round(corr(ra, re), 6) AS rho, count(*) AS n FROM r GROUP BY outer_fold")
def rank_correlation(spark, d):
    return B.rounded(R.spearman(outer_folds(B.letters(spark, d), 5, B.SEED), "a", "e", ["outer_fold"]))


PERMUTATIONS, J11_SEED = 200, 41
RANK = lambda c, part: f"rank() OVER ({'PARTITION BY ' + part if part else ''} ORDER BY {c}) + (count(*) OVER (PARTITION BY {part + ', ' if part else ''}{c}) - 1) / 2.0"
ORDER = bits_sql(f"'{J11_SEED}|' || s || '|' || piece || '|order'", "(r::UBIGINT << 32) + k + 1")
J11 = f"""WITH RECURSIVE {B.predictions_sql('A')}, {PRED_B}, own AS (SELECT person_key, x.outer_fold, x.reference_id = 1 AS positive, x.probs[2] AS a, y.probs[2] AS b FROM pred_a x JOIN pred_b y USING (person_key)),
rk AS (SELECT *, {RANK('a', '')} AS ra, {RANK('b', '')} AS rb, {RANK('a', 'outer_fold')} AS fa, {RANK('b', 'outer_fold')} AS fb FROM own),
whole AS (SELECT corr(ra, rb) AS rho, count(*) AS n, avg(ra) AS ma, avg(rb) AS mb, stddev_pop(ra) * stddev_pop(rb) * count(*) AS scale FROM rk),
pc AS (SELECT s, k // {PIECE} AS piece, k % {PIECE} AS k, ra, rb FROM (SELECT *, outer_fold || '|' || positive AS s, row_number() OVER (PARTITION BY outer_fold, positive ORDER BY sha256('{J11_SEED}|rank|' || person_key)) - 1 AS k FROM rk)),
od AS (SELECT s, piece, r, rb, row_number() OVER (PARTITION BY s, piece, r ORDER BY {ORDER}) - 1 AS place FROM pc CROSS JOIN range({PERMUTATIONS}) x(r)),
nu AS (SELECT r, sum((pc.ra - ma) * (od.rb - mb)) / any_value(scale) AS value FROM od JOIN pc ON pc.s = od.s AND pc.piece = od.piece AND pc.k = od.place CROSS JOIN whole GROUP BY r),
pe AS (SELECT (count(*) FILTER (WHERE abs(value) >= abs(rho) ) + 1) / (count(*) + 1) AS p, count(*) AS permutations FROM nu CROSS JOIN whole),
{weights_sql('drawn', 'own', ['outer_fold', 'positive'], 'person_key', REPLICATES, J11_SEED)},
wr AS (SELECT replicate, w, {", ".join(f"sum(w) OVER (PARTITION BY replicate ORDER BY {c}) - sum(w) OVER (PARTITION BY replicate, {c}) + (sum(w) OVER (PARTITION BY replicate, {c}) + 1) / 2 AS r{c}" for c in "ab")} FROM drawn),
ws AS (SELECT replicate, sum(w)::DOUBLE AS n, sum(w * ra) AS x, sum(w * rb) AS y, sum(w * ra * rb) AS xy, sum(w * ra * ra) AS xx, sum(w * rb * rb) AS yy FROM wr GROUP BY replicate),
li AS (SELECT {", ".join(f"quantile_cont((xy * n - x * y) / nullif(sqrt((xx * n - x * x) * (yy * n - y * y)), 0), {q}) AS rho_{name}" for name, q in (("low", 0.025), ("median", 0.5), ("high", 0.975)))} FROM ws),
fo AS (SELECT outer_fold, corr(fa, fb) AS rho FROM rk GROUP BY outer_fold),
ff AS (SELECT {", ".join(f"max(fo.rho) FILTER (WHERE outer_fold = {k}) AS rho_{k}" for k in range(5))}, count(*) FILTER (WHERE sign(fo.rho) = sign(whole.rho)) AS same FROM fo CROSS JOIN whole)
SELECT round(rho, 6) AS rho, n, round(rho_low, 6) AS rho_low, round(rho_median, 6) AS rho_median, round(rho_high, 6) AS rho_high, {", ".join(f"round(rho_{k}, 6) AS rho_{k}" for k in range(5))}, round(p, 6) AS p, permutations, CAST(same AS INTEGER) AS same_direction_folds,
abs(rho) >= 0.2 AND (rho_low > 0 OR rho_high < 0) AND p <= 0.05 AND same >= 3 AS passed FROM whole CROSS JOIN pe CROSS JOIN li CROSS JOIN ff"""


@book("j11_rank_association", J11)
def rank_association(spark, d):
    own = B.gate(spark, d, "A").select("person_key", "outer_fold", "positive", F.col("score").alias("a")).join(B.gate(spark, d, "B").select("person_key", F.col("score").alias("b")), "person_key")
    found = R.rank_association(written(own, "scores"), "a", "b", ["outer_fold", "positive"], "person_key", PERMUTATIONS, REPLICATES, J11_SEED)
    return B.rounded(found.select("*", *(F.col("fold_rho")[k].alias(f"rho_{k}") for k in range(5))).drop("fold_rho"))
