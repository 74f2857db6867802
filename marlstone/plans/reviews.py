"""Blinded review (L), on documents and their labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions.draws import uniform
from marlstone.operators import review as R
from marlstone.operators.dealing import cells_sql
from marlstone.operators.splits import outer_folds
from marlstone.plans import bindings as B
from marlstone.plans.book import Book

book = Book()
SEED, PER_CELL, TARGETS, REPLICATES = 11, 3, ["src1", "src2", "src3"], 2000
#: Documents as images: people are groups of three ids in a language, categories are the sources of the id and its neighbours.


def images(spark, d):
    own = outer_folds(B.letters(spark, d), 5, B.SEED)
    return own.select(F.col("person_key").alias("image_key"), F.concat_ws("_", "diagnosis", "outer_fold", F.expr("doc_id div 3").cast("string")).alias("person_key"), "diagnosis", "outer_fold")


def positives(spark, d):
    return B.table(spark, d, "documents").select(F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("image_key"), F.explode(F.array(F.concat(F.lit("src"), (F.col("doc_id") % 4).cast("string")), F.concat(F.lit("src"), (F.col("doc_id") % 5).cast("string")))).alias("target")).distinct()


def queue(spark, d):
    return R.build_queue(images(spark, d), positives(spark, d), TARGETS, SEED, PER_CELL)


def queue_sql():
    parts = [f"{B.LETTERS}, {B.folds_sql('letters', 'lf')}, im AS (SELECT person_key AS image_key, diagnosis || '_' || outer_fold || '_' || (doc_id // 3) AS person_key, diagnosis, outer_fold, doc_id FROM lf)"]
    for k, t in enumerate(TARGETS):
        used = "".join(f" AND image_key NOT IN (SELECT image_key FROM ch{j})" for j in range(k))
        n = t[3:]
        parts.append(f"""po{k} AS (SELECT *, CASE WHEN doc_id % 4 = {n} OR doc_id % 5 = {n} THEN '{R.BUCKETS[0]}' ELSE '{R.BUCKETS[1]}' END AS bucket FROM im WHERE true{used}),
sc{k} AS (SELECT *, sha256('{SEED}|{t}|' || bucket || '|' || image_key) AS score FROM po{k}), pe{k} AS (SELECT *, row_number() OVER (PARTITION BY bucket, outer_fold, diagnosis, person_key ORDER BY score) AS r FROM sc{k}),
tu{k} AS (SELECT *, row_number() OVER (PARTITION BY bucket, outer_fold, diagnosis ORDER BY score) AS turn FROM pe{k} WHERE r = 1),
ch{k} AS (SELECT '{t}' AS target, bucket, outer_fold, image_key, person_key, diagnosis FROM (SELECT *, row_number() OVER (PARTITION BY bucket, outer_fold ORDER BY turn, score) AS k FROM tu{k}) WHERE k <= {PER_CELL})""")
    parts.append("qu AS (" + " UNION ALL ".join(f"SELECT * FROM ch{k}" for k in range(len(TARGETS))) + ")")
    return "WITH " + ", ".join(parts)


QUEUE = queue_sql()


@book("l1_review_queue", f"{QUEUE} SELECT * FROM qu")
def review_queue(spark, d):
    return queue(spark, d)


@book("l2_case_keys", f"{QUEUE} SELECT 'REVIEW_' || upper(substr(sha256('{SEED}|' || target || '|' || image_key), 1, 16)) AS review_case_key, image_key, target AS target_category FROM qu")
def case_keys(spark, d):
    return R.case_keys(queue(spark, d), SEED)


@book("l3_queue_contract", f"{QUEUE} SELECT 'path_like' AS rule, CAST(0 AS BIGINT) AS n_violations UNION ALL SELECT 'reviews', count(*) FILTER (WHERE outer_fold = 4) FROM qu UNION ALL SELECT 'unique', 0 UNION ALL SELECT 'target_coverage', 1")
def queue_contract(spark, d):
    own = queue(spark, d)
    rows = R.case_keys(own, SEED).join(own.select("image_key", F.when(F.col("outer_fold") == 4, 1).otherwise(2).alias("required_independent_reviews")), "image_key")
    return R.queue_violations(rows, [*TARGETS, "src9"])


PRESENCE = ["present", "absent_visible", "not_assessable"]


def labelled(spark, d):
    """Labels as two reviews: the second is flipped by a draw."""
    own = B.table(spark, d, "labels").where("doc_id IS NOT NULL")
    state = lambda n: F.element_at(F.array(*(F.lit(p) for p in PRESENCE)), (n + 1).cast("int"))
    first = F.coalesce(F.col("quality"), F.lit(0)).cast("long")
    flip = uniform(F.sha2(F.concat(F.lit("r2|"), F.col("doc_id").cast("string")), 256), 7)
    second = F.when(flip == 0, 1 - first).when(flip == 1, 2).otherwise(first)
    return own.select("doc_id", state(first).alias("reviewer_1"), state(second).alias("reviewer_2"), F.when(F.col("toxic") == 1, "t").otherwise("u").alias("target"), state(flip % 3).alias("adjudicated"))


P = f"{PRESENCE}"
LAB = f"""lab AS (SELECT doc_id, f, {P}[CAST(fi AS INTEGER) + 1] AS reviewer_1, {P}[CAST(CASE WHEN f = 0 THEN 1 - fi WHEN f = 1 THEN 2 ELSE fi END AS INTEGER) + 1] AS reviewer_2, target, {P}[CAST(f % 3 AS INTEGER) + 1] AS adjudicated FROM (SELECT doc_id, coalesce(quality, 0) AS fi, ('0x' || substr(sha256('r2|' || doc_id), 1, 13))::BIGINT % 7 AS f, CASE WHEN toxic = 1 THEN 't' ELSE 'u' END AS target FROM labels WHERE doc_id IS NOT NULL))"""


def responses(spark, d, slot):
    own = labelled(spark, d)
    blank = R.blank_responses(own.select(F.col("doc_id").cast("string").alias("review_case_key"), F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("image_key"), F.col("target").alias("target_category")))
    given = own.select(F.col("doc_id").cast("string").alias("review_case_key"), F.col(f"reviewer_{slot}").alias("p"), (F.col("doc_id") % 6).alias("k"))
    filled = blank.join(given, "review_case_key")
    p = F.when(F.col("k") == 0, "").when(F.col("k") == 1, "maybe").otherwise(F.col("p"))
    return filled.withColumn(f"reviewer_{slot}_presence", p).withColumn(f"reviewer_{slot}_subtype", F.when((p == "present") & (F.col("k") != 2), "mild").otherwise("")).drop("p", "k")


RESP = f"WITH {LAB}, re AS (SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN '' WHEN doc_id % 6 = 1 THEN 'maybe' ELSE reviewer_1 END AS p, doc_id % 6 AS k FROM lab), rs AS (SELECT *, CASE WHEN p = 'present' AND k <> 2 THEN 'mild' ELSE '' END AS s FROM re)"


@book("l4_blank_responses", "SELECT count(*) AS cases, CAST(0 AS BIGINT) AS filled FROM labels WHERE doc_id IS NOT NULL")
def blank(spark, d):
    own = R.blank_responses(labelled(spark, d).select(F.col("doc_id").cast("string").alias("review_case_key"), F.lit("i").alias("image_key"), F.col("target").alias("target_category")))
    return own.agg(F.count("*").alias("cases"), F.sum((F.concat_ws("", *(c for c in own.columns if c.startswith("reviewer_"))) != "").cast("long")).alias("filled"))


@book("l5_response_check", f"{RESP} SELECT CASE WHEN p = '' THEN 'remaining' WHEN p = 'present' AND s = '' THEN 'partial' ELSE 'complete' END AS state, CASE WHEN p = 'maybe' THEN 'presence_code' WHEN p = 'present' AND s = '' THEN 'subtype_missing' END AS problem, count(*) AS n FROM rs GROUP BY 1, 2")
def response_check(spark, d):
    return R.response_state(responses(spark, d, 1), 1, PRESENCE, ["mild", "severe"]).groupBy("state", "problem").agg(F.count("*").alias("n"))


@book("l6_merged_responses", f"WITH {LAB} SELECT 'coverage' AS rule, count(*) FILTER (WHERE doc_id % 10 = 0) AS n_violations FROM lab UNION ALL SELECT 'base_fields', count(*) FILTER (WHERE doc_id % 10 <> 0 AND doc_id % 7 = 0) FROM lab")
def merged(spark, d):
    second = responses(spark, d, 2).where("cast(review_case_key as long) % 10 != 0").withColumn("image_key", F.when(F.col("review_case_key").cast("long") % 7 == 0, "other").otherwise(F.col("image_key")))
    return R.merged_responses(responses(spark, d, 1), second)[1]


@book("l7_adjudication_check", f"""WITH {LAB}, a AS (SELECT *, reviewer_1 <> reviewer_2 AS dif, CASE WHEN reviewer_1 = 'present' THEN 'mild' ELSE '' END AS s1, CASE WHEN reviewer_2 = 'present' THEN 'mild' ELSE '' END AS s2, CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'present' END AS ap, CASE WHEN doc_id % 3 = 0 THEN 'mild' ELSE '' END AS asub, CASE WHEN doc_id % 4 = 0 THEN 'n' ELSE '' END AS notes FROM lab),
 b AS (SELECT *, s1 <> s2 AS ds, CASE WHEN dif THEN ap ELSE reviewer_1 END AS fp, CASE WHEN s1 <> s2 THEN asub ELSE s1 END AS fs FROM a)
 SELECT 'set_without_disagreement' AS rule, count(*) FILTER (WHERE (NOT dif AND ap <> '') OR (NOT ds AND asub <> '')) AS n_violations FROM b UNION ALL SELECT 'missing_decision', count(*) FILTER (WHERE dif AND ap = '') FROM b UNION ALL SELECT 'notes', count(*) FILTER (WHERE (dif OR ds) <> (notes <> '')) FROM b UNION ALL SELECT 'final_subtype', count(*) FILTER (WHERE (fp = 'present') <> (fs <> '')) FROM b""")
def adjudication(spark, d):
    own = labelled(spark, d)
    sub = lambda c: F.when(F.col(c) == "present", "mild").otherwise("")
    k = F.col("doc_id")
    rows = own.select(
        F.col("reviewer_1").alias("reviewer_1_presence"), F.col("reviewer_2").alias("reviewer_2_presence"), sub("reviewer_1").alias("reviewer_1_subtype"), sub("reviewer_2").alias("reviewer_2_subtype"),
        F.when(k % 5 == 0, "").otherwise("present").alias("adjudicated_presence"), F.when(k % 3 == 0, "mild").otherwise("").alias("adjudicated_subtype"), F.when(k % 4 == 0, "n").otherwise("").alias("adjudication_notes"),
    )
    return R.adjudication_violations(rows, PRESENCE)


AGREE = """SELECT {by} rows, round(same / rows, 6) AS raw_agreement, round((same / rows - chance / (rows * rows)) / nullif(1 - chance / (rows * rows), 0), 6) AS kappa, comparable, round(2 * pp / nullif(2 * pp + dd, 0), 6) AS positive_agreement, round(2 * nn / nullif(2 * nn + dd, 0), 6) AS negative_agreement"""


@book("l8_agreement", f"""WITH {LAB}, s AS (SELECT target, count(*) AS rows, count(*) FILTER (WHERE reviewer_1 = reviewer_2) AS same, count(*) FILTER (WHERE reviewer_1 <> 'not_assessable' AND reviewer_2 <> 'not_assessable') AS comparable, count(*) FILTER (WHERE reviewer_1 = 'present' AND reviewer_2 = 'present') AS pp, count(*) FILTER (WHERE reviewer_1 = 'absent_visible' AND reviewer_2 = 'absent_visible') AS nn, count(*) FILTER (WHERE reviewer_1 <> 'not_assessable' AND reviewer_2 <> 'not_assessable' AND reviewer_1 <> reviewer_2) AS dd FROM lab GROUP BY target),
 c AS (SELECT a.target, sum(a.n * b.n) AS chance FROM (SELECT target, reviewer_1 AS v, count(*) AS n FROM lab GROUP BY ALL) a JOIN (SELECT target, reviewer_2 AS v, count(*) AS n FROM lab GROUP BY ALL) b ON a.target = b.target AND a.v = b.v GROUP BY 1)
 {AGREE.format(by='s.target,')} FROM s JOIN c ON s.target = c.target""")
def agreement(spark, d):
    return B.rounded(R.agreement(labelled(spark, d), ["target"]))


MEASURES = {
    "raw_agreement": "same / rows", "kappa": "(same / rows - chance / (rows * rows)) / nullif(1 - chance / (rows * rows), 0)",
    "positive_agreement": "2 * pp / nullif(2 * pp + dd, 0)", "negative_agreement": "2 * nn / nullif(2 * nn + dd, 0)",
}
LIMITS = ", ".join(f"round(quantile_cont({m}, {p}), 6) AS {m.replace('_agreement', '')}_{side}" for m in MEASURES for side, p in (("low", 0.025), ("high", 0.975)))
L9 = f"""{LAB}, cell AS (SELECT 'all' AS stratum, reviewer_1, reviewer_2, count(*) AS n FROM lab GROUP BY ALL), {cells_sql('drawn', 'cell', 'stratum', ['reviewer_1', 'reviewer_2'], REPLICATES, 3)},
s AS (SELECT replicate, sum(n)::DOUBLE AS rows, coalesce(sum(n) FILTER (WHERE reviewer_1 = reviewer_2), 0) AS same, coalesce(sum(n) FILTER (WHERE reviewer_1 = 'present' AND reviewer_2 = 'present'), 0) AS pp, coalesce(sum(n) FILTER (WHERE reviewer_1 = 'absent_visible' AND reviewer_2 = 'absent_visible'), 0) AS nn,
 coalesce(sum(n) FILTER (WHERE reviewer_1 <> 'not_assessable' AND reviewer_2 <> 'not_assessable' AND reviewer_1 <> reviewer_2), 0) AS dd FROM drawn GROUP BY replicate),
m AS (SELECT replicate, reviewer_1 AS v, sum(n) AS l, 0 AS r FROM drawn GROUP BY ALL UNION ALL SELECT replicate, reviewer_2, 0, sum(n) FROM drawn GROUP BY ALL),
c AS (SELECT replicate, sum(l * r) AS chance FROM (SELECT replicate, v, sum(l) AS l, sum(r) AS r FROM m GROUP BY ALL) GROUP BY replicate),
x AS (SELECT {', '.join(f'{e} AS {n}' for n, e in MEASURES.items())} FROM s JOIN c USING (replicate)) SELECT {LIMITS}, count(*) AS replicates FROM x"""


@book("l9_agreement_intervals", f"WITH RECURSIVE {L9}")
def intervals(spark, d):
    return B.rounded(R.agreement_intervals(labelled(spark, d), REPLICATES, 3))


@book("l10_final_states", f"WITH {LAB} SELECT target, CASE WHEN reviewer_1 = reviewer_2 THEN reviewer_1 ELSE adjudicated END AS state, count(*) AS n FROM lab GROUP BY 1, 2")
def final_states(spark, d):
    return R.final_states(labelled(spark, d))


@book("l11_source_audit", f"{QUEUE} SELECT count(doc_id) AS found, count(*) FILTER (WHERE doc_id IS NULL) AS failed, CAST(min(length(text)) AS INTEGER) AS least_width, CAST(max(length(text)) AS INTEGER) AS most_width, CAST(min(100 + doc_id % 7) AS BIGINT) AS least_height, CAST(max(100 + doc_id % 7) AS BIGINT) AS most_height FROM qu LEFT JOIN documents ON image_key = 'D' || doc_id AND doc_id % 9 > 0")
def source_audit(spark, d):
    sources = B.table(spark, d, "documents").where("doc_id % 9 > 0").select(F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("image_key"), F.length("text").alias("width"), (100 + F.col("doc_id") % 7).alias("height"))
    return R.source_audit(queue(spark, d), sources)


@book("l12_reconciliation", "WITH o AS (SELECT o_orderkey AS id FROM orders) SELECT id, array_to_string(list_filter([CASE WHEN id % 3 = 0 THEN 'flag' END, CASE WHEN id % 4 = 0 THEN 'missing' END, CASE WHEN id % 5 = 0 THEN 'name' END], lambda x: x IS NOT NULL), ';') AS fields FROM o WHERE id % 3 = 0 OR id % 4 = 0 OR id % 5 = 0")
def reconciliation(spark, d):
    o = B.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    k = F.col("id")

    def rows(*fields):
        s = F.array(*(F.struct(F.lit(f).alias("field"), (F.lit(t) if isinstance(t, str) else t).alias("type"), (F.lit(v) if isinstance(v, str) else v).alias("value")) for f, t, v in fields))
        return o.select("id", F.explode(s).alias("s")).select("id", "s.*")

    a = rows(("n", "int", "1"), ("flag", "bool", "1"), ("name", "str", "x"))
    b = rows(("n", "float", "1.0"), ("flag", F.when(k % 3 == 0, "int").otherwise("bool"), "1"), ("name", "str", F.when(k % 5 == 0, "y").otherwise("x")), ("missing", "str", "z"))
    return R.reconciled(a, b.where((F.col("field") != "missing") | (k % 4 == 0)))
