"""Contracts, provenance, privacy (M)."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.operators import contracts as C
from marlstone.operators.splits import outer_folds
from marlstone.plans import bindings as B
from marlstone.plans.book import Book
from marlstone.plans.cohort import TREE, tree
from marlstone.plans.evaluation import PRED
from marlstone.sources import files as S

book = Book()


@book("m1_prediction_contract", f"""{PRED}, b AS (SELECT * FROM pred_a WHERE CAST(substr(person_key, 2) AS BIGINT) % 30 > 0) SELECT 'finite' AS rule, CAST(0 AS BIGINT) AS n_violations UNION ALL SELECT 'range', count(*) FILTER (WHERE doc_id % 77 = 0) FROM b UNION ALL SELECT 'sum', count(*) FILTER (WHERE doc_id % 77 = 0) FROM b UNION ALL SELECT 'classes', 0 UNION ALL SELECT 'reference_range', 0 UNION ALL SELECT 'members', 0
 UNION ALL SELECT 'missing', count(*) FILTER (WHERE doc_id % 30 = 0) FROM pred_a UNION ALL SELECT 'extra', 0 UNION ALL SELECT 'class', count(*) FILTER (WHERE doc_id % 41 = 0 AND reference_id <> 0) FROM b UNION ALL SELECT 'fold', 0 UNION ALL SELECT 'unique', 0""")
def prediction_contract(spark, d):
    bad = F.when(F.col("doc_id") % 77 == 0, F.transform("probs", lambda p: p + 1)).otherwise(F.col("probs"))
    pred = B.predictions(spark, d).where("doc_id % 30 > 0").withColumn("probs", bad).withColumn("reference_id", F.when(F.col("doc_id") % 41 == 0, 0).otherwise(F.col("reference_id")))
    return C.prediction_violations(pred, outer_folds(B.letters(spark, d), 5, B.SEED), 4)


@book("m3_frozen_files", f"WITH {TREE} SELECT 'missing' AS rule, count(*) FILTER (WHERE doc_id % 7 = 5) AS n_violations FROM tree UNION ALL SELECT 'changed', count(*) FILTER (WHERE doc_id % 7 <> 5 AND doc_id % 11 = 0) FROM tree")
def frozen_files(spark, d):
    own = tree(spark, d)
    expected = own.select("path", F.when(F.col("doc_id") % 11 == 0, "x").otherwise(F.sha2("content", 256)).alias("sha256"))
    return C.frozen_files(S.fingerprints(own, "docs"), expected)


@book("m4_privacy_scan", """SELECT event_id, '$.p.folder' AS path, 'forbidden_key' AS rule FROM events WHERE event_id % 10 = 0 UNION ALL SELECT event_id, '$.a[1].x', 'private_value' FROM events WHERE event_id % 15 = 0""")
def privacy(spark, d):
    e = B.table(spark, d, "events").select("event_id", F.concat(F.lit('{"p": {"'), F.when(F.col("event_id") % 10 == 0, "Folder").otherwise("note"), F.lit('": "k"}, "a": [1, {"x": "'), F.when(F.col("event_id") % 15 == 0, "C:/raw/z").otherwise("fine"), F.lit('"}]}')).alias("doc"))
    found = C.privacy_violations(C.json_leaves(e, "event_id", "doc"), "event_id")
    return found.select("event_id", F.when(F.col("path") == "$.p.Folder", "$.p.folder").otherwise(F.col("path")).alias("path"), "rule")


@book("m4_json_leaves", "SELECT event_id, '$.' || k AS path, props ->> ('$.\"' || k || '\"') AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)")
def leaves(spark, d):
    return C.json_leaves(B.table(spark, d, "events"), "event_id", "props")


@book("m5_ledger_contract", f"""WITH {TREE}, r AS (SELECT doc_id, path, sha256, row_number() OVER () AS x FROM tree JOIN prints USING (path)) SELECT 'id' AS rule, count(*) FILTER (WHERE doc_id % 19 = 0) AS n_violations FROM r UNION ALL SELECT 'revision', count(*) FILTER (WHERE doc_id % 13 = 0) FROM r UNION ALL SELECT 'folds_seeds', count(*) FILTER (WHERE doc_id % 17 = 0) FROM r
 UNION ALL SELECT 'path_hash_pairs', 0 UNION ALL SELECT 'hash_format', count(*) FILTER (WHERE doc_id % 23 = 0) FROM r UNION ALL SELECT 'unique', CASE WHEN count(*) FILTER (WHERE doc_id % 19 = 0) > 1 THEN 1 ELSE 0 END FROM r UNION ALL SELECT 'artifact', count(*) FILTER (WHERE doc_id % 23 = 0) FROM r""")
def ledger(spark, d):
    prints = S.fingerprints(tree(spark, d), "docs")
    own = tree(spark, d).select("doc_id", "path").join(prints.select("path", "sha256"), "path")
    k = F.col("doc_id")
    records = own.select(
        F.when(k % 19 == 0, "").otherwise(F.concat(F.lit("E"), k.cast("string"))).alias("experiment_id"), F.when(k % 13 == 0, "main").otherwise("0123abc").alias("revision"), F.array(F.lit(0), F.lit(1)).alias("folds"),
        F.when(k % 17 == 0, F.array(F.lit(7))).otherwise(F.array(F.lit(7), F.lit(8))).alias("seeds"), F.array("path").alias("paths"), F.array(F.when(k % 23 == 0, "zz").otherwise(F.col("sha256"))).alias("hashes"),
    )
    return C.ledger_violations(records, prints)


@book("m6_summary_checks", """WITH f AS (SELECT c_custkey AS k, count(*) OVER (PARTITION BY c_custkey // 2 * CASE WHEN c_custkey % 10 < 2 THEN 1 ELSE 0 END + CASE WHEN c_custkey % 10 < 2 THEN 0 ELSE c_custkey * 100000 END) AS runs, c_acctbal AS b FROM customer)
 SELECT k AS outer_fold, array_to_string(list_filter([CASE WHEN k % 11 = 0 THEN 'finished' END, CASE WHEN b > 5000 THEN 'hours' END, CASE WHEN k % 9 = 0 THEN 'memory' END, 'one_revision', CASE WHEN runs > 1 THEN 'own_run' END], lambda x: x IS NOT NULL), ';') AS failed FROM f""")
def summary_checks(spark, d):
    k = F.col("c_custkey")
    own = B.table(spark, d, "customer").select(k.alias("outer_fold"), F.when(k % 10 < 2, F.expr("c_custkey div 2")).otherwise(k * 100000).alias("run_id"), (k % 2).cast("string").alias("revision"), F.col("c_acctbal").alias("hours"), F.when(k % 9 == 0, 99.0).otherwise(1.0).alias("memory_gb"), (k % 11 != 0).alias("finished"))
    return C.summary_checks(own, 5000.0, 10.0)


@book("m7_broken_links", "WITH l AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS link FROM pages), t AS (SELECT DISTINCT link FROM l WHERE length(link) % 3 = 0) SELECT page_id, link FROM l WHERE NOT regexp_matches(link, '^([a-z]+:|//|#|$)') AND link NOT IN (SELECT link FROM t)")
def broken_links(spark, d):
    pages = B.table(spark, d, "pages")
    targets = pages.select(F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("target")).where(F.length("target") % 3 == 0).distinct()
    return C.broken_links(pages, "page_id", "html", targets)


@book("m8_manifest_chain", "WITH c AS (SELECT conv_id, turn, sha256(text) AS o, lag(sha256(text)) OVER w AS b, lag(turn) OVER w AS p, row_number() OVER w AS r FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT 'broken' AS rule, count(*) FILTER (WHERE p IS NOT NULL AND turn % 4 = 3) AS n_violations FROM c UNION ALL SELECT 'gap', count(*) FILTER (WHERE turn <> p + 1) FROM c")
def manifest_chain(spark, d):
    from pyspark.sql import Window as W

    own = B.table(spark, d, "conversations").withColumn("o", F.sha2("text", 256))
    before = F.lag("o").over(W.partitionBy("conv_id").orderBy("turn"))
    steps = own.withColumn("b", before).select(F.col("conv_id").alias("chain"), F.col("turn").alias("position"), F.when(F.col("turn") % 4 == 3, "x").otherwise(F.col("b")).alias("input_sha256"), F.col("o").alias("output_sha256"))
    return C.chain_violations(steps)
