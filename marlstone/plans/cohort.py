"""Sources (A), identity, manifests and sync (B), splits (E), member features (F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions import identity as I
from marlstone.operators import bags, manifest, splits
from marlstone.plans import bindings as B
from marlstone.plans.book import Book
from marlstone.sources import files as S
from marlstone.sources.tables import shared_folder

book = Book()
SECRET = bytes(range(32))

# files: documents as a tree


def tree(spark, d):
    docs = B.table(spark, d, "documents")
    k, name = F.col("doc_id") % 7, F.col("doc_id").cast("string")
    file = F.when(k == 0, F.concat(name, F.lit(".png"))).when(k == 1, F.concat(name, F.lit(".JSON"))).when(k == 2, F.concat(name, F.lit(".xlsx"))).when(k == 3, F.concat(name, F.lit(".yml"))).when(k == 4, F.concat(F.lit("Mask/"), name, F.lit(".jpg"))).when(k == 5, F.concat(F.lit("~$"), name, F.lit(".xlsx"))).otherwise(F.concat(name, F.lit(".txt")))
    return docs.select("doc_id", F.concat_ws("/", "source", "lang", file).alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))


TREE = """tree AS (SELECT doc_id, source || '/' || lang || '/' || CASE doc_id % 7 WHEN 0 THEN doc_id || '.png' WHEN 1 THEN doc_id || '.JSON' WHEN 2 THEN doc_id || '.xlsx' WHEN 3 THEN doc_id || '.yml' WHEN 4 THEN 'Mask/' || doc_id || '.jpg' WHEN 5 THEN '~$' || doc_id || '.xlsx' ELSE doc_id || '.txt' END AS path, coalesce(text, '') AS text FROM documents),
prints AS (SELECT 'docs' AS cohort, path, CASE doc_id % 7 WHEN 0 THEN 'image' WHEN 1 THEN 'annotation' WHEN 2 THEN 'clinical_workbook' WHEN 3 THEN 'annotation_config' WHEN 4 THEN 'annotation_mask' ELSE 'other' END AS kind, strlen(text) AS size_bytes, sha256(text) AS sha256 FROM tree WHERE doc_id % 7 <> 5)"""


@book("a1_fingerprints", f"WITH {TREE} SELECT * FROM prints")
def fingerprints(spark, d):
    return S.fingerprints(tree(spark, d), "docs")


@book("a2_file_kinds", f"WITH {TREE} SELECT kind, count(*) AS n FROM prints GROUP BY kind")
def kinds(spark, d):
    return S.fingerprints(tree(spark, d), "docs").groupBy("kind").agg(F.count("*").alias("n"))


@book("a3_dataset_version", f"WITH {TREE} SELECT sha256(string_agg(path || chr(0) || sha256 || chr(10), '' ORDER BY path)) AS version FROM prints")
def version(spark, d):
    return S.dataset_version(S.fingerprints(tree(spark, d), "docs"))


@book("a3_tree_version", f"WITH {TREE}, v AS (SELECT split_part(path, '/', 1) AS folder, sha256(string_agg(path || chr(0) || sha256 || chr(10), '' ORDER BY path)) AS version FROM prints GROUP BY 1) SELECT sha256(string_agg(folder || chr(0) || version || chr(10), '' ORDER BY folder)) AS version FROM v")
def tree_version(spark, d):
    return S.tree_version(S.fingerprints(tree(spark, d), "docs"))


BUCKETED = """b4 AS (SELECT substr(sha256(path), 1, 4) AS p, sha256(string_agg(path || chr(0) || sha256 || chr(10), '' ORDER BY path)) AS d FROM prints GROUP BY 1),
b2 AS (SELECT substr(p, 1, 2) AS q, sha256(string_agg(p || chr(0) || d || chr(10), '' ORDER BY p)) AS d FROM b4 GROUP BY 1)"""


@book("a3_bucketed_version", f"WITH {TREE}, {BUCKETED} SELECT sha256(string_agg(q || chr(0) || d || chr(10), '' ORDER BY q)) AS version FROM b2")
def bucketed_version(spark, d):
    return S.bucketed_version(S.fingerprints(tree(spark, d), "docs"))


@book("a4_version_summary", f"WITH {TREE} SELECT cohort, kind, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM prints GROUP BY ALL")
def version_summary(spark, d):
    return S.summary(S.fingerprints(tree(spark, d), "docs"))


@book("a5_csv_round_trip", "SELECT c_custkey, c_name, c_mktsegment, c_nationkey FROM customer")
def csv_round_trip(spark, d):
    own, path = B.table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey"), shared_folder(spark)
    S.write_csv(own, path, own.columns)
    return S.read_csv(spark, path, own.schema)


@book("a12_published", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def published(spark, d):
    path = shared_folder(spark)
    S.publish(B.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), path)
    return S.read_published(spark, path)


@book("a7_split_list", "SELECT item, count(*) AS n FROM (SELECT trim(unnest(string_split(text, chr(10)))) AS item FROM documents) WHERE item <> '' GROUP BY item")
def split_list(spark, d):
    lines = B.table(spark, d, "documents").select(F.explode(F.split("text", "\n")).alias("value"))
    return S.split_list(lines).groupBy("item").agg(F.count("*").alias("n"))


PAIRS = """im AS (SELECT lang AS class, source AS person, CAST(doc_id // 2 AS VARCHAR) AS stem, max(source || '/' || (doc_id // 2) || CASE WHEN doc_id % 4 = 0 THEN '.png' ELSE '.jpg' END) AS path FROM documents WHERE doc_id % 3 <> 0 GROUP BY 1, 2, 3),
an AS (SELECT DISTINCT lang AS class, source AS person, CAST(doc_id // 2 AS VARCHAR) AS stem FROM documents WHERE doc_id % 5 <> 0)"""


@book("a9_paired_samples", f"WITH {PAIRS} SELECT CASE WHEN im.stem IS NULL THEN 'annotation_only' WHEN an.stem IS NULL THEN 'image_only' ELSE 'pair' END AS status, count(*) AS n, count(DISTINCT im.path) AS images FROM im FULL JOIN an ON im.class = an.class AND im.person = an.person AND im.stem = an.stem GROUP BY 1")
def pairs(spark, d):
    docs = B.table(spark, d, "documents").select(F.col("lang").alias("class"), F.col("source").alias("person"), "doc_id")
    stem = F.concat(F.col("person"), F.lit("/"), F.expr("doc_id div 2").cast("string"))
    own = S.paired(docs.where("doc_id % 3 != 0").withColumn("path", F.concat(stem, F.when(F.col("doc_id") % 4 == 0, ".png").otherwise(".jpg"))), docs.where("doc_id % 5 != 0").withColumn("path", F.concat(stem, F.lit(".json"))))
    return own.groupBy("status").agg(F.count("*").alias("n"), F.countDistinct("image_path").alias("images"))


@book("a10_row_index", "SELECT upper(regexp_replace(c_mktsegment || ' ' || c_nationkey, '\\s+', '', 'g')) AS join_key, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) > 1")
def row_index(spark, d):
    return S.row_index(B.table(spark, d, "customer"), I.join_key(F.concat_ws(" ", "c_mktsegment", F.col("c_nationkey").cast("string"))))[1]


@book("a11_missing_only", "SELECT o_orderkey AS key FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def missing(spark, d):
    return S.missing_only(B.table(spark, d, "orders").select(F.col("o_orderkey").alias("key")), B.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key")), ["key"])


@book("a18_registry_digest", f"WITH {TREE}, t AS (SELECT kind AS name, row_number() OVER (ORDER BY kind) AS position, sha256(string_agg(sha256, '' ORDER BY path)) AS s FROM prints GROUP BY kind) SELECT sha256(string_agg(name || chr(0) || s || chr(10), '' ORDER BY position)) AS digest FROM t")
def digest(spark, d):
    own = S.fingerprints(tree(spark, d), "docs").groupBy(F.col("kind").alias("name")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "sha256"))), lambda x: x["sha256"]), ""), 256).alias("sha256"))
    names = ["annotation", "annotation_config", "annotation_mask", "clinical_workbook", "image", "other"]
    return S.registry_digest(own.withColumn("position", F.array_position(F.array(*(F.lit(n) for n in names)), F.col("name"))))


# identity


@book("b1_identity_token", "SELECT doc_id, 'u' || doc_id AS token FROM documents")
def token(spark, d):
    folder = F.concat(F.lit(" C:\\data\\"), "source", F.when(F.col("doc_id") % 2 == 0, "\\").otherwise("/"), F.lit("u"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, "//").otherwise(" "))
    return B.table(spark, d, "documents").select("doc_id", I.identity_token(folder).alias("token"))


INNER, OUTER = (bytes(b ^ x for b in SECRET.ljust(64, b"\0")).hex() for x in (0x36, 0x5C))
HMAC = f"sha256(unhex('{OUTER}') || unhex(sha256(unhex('{INNER}') || encode(lower(trim(c_name))))))"


@book("b2_pseudonyms", f"SELECT c_custkey, 'P_' || upper(substr({HMAC}, 1, 16)) AS person_key FROM customer")
def pseudonyms(spark, d):
    return B.table(spark, d, "customer").select("c_custkey", I.pseudonym(F.concat(F.lit(" "), F.upper("c_name")), SECRET, "P").alias("person_key"))


@book("b3_resolved_identity", "WITH t AS (SELECT o_custkey AS k, o_orderstatus AS s FROM orders GROUP BY ALL), g AS (SELECT k, list_sort(list(s)) AS l FROM t GROUP BY k), f AS (SELECT k, list_filter(l, lambda x: x <> 'O') AS o, l FROM g) SELECT k AS c, CASE WHEN len(CASE WHEN len(o) > 0 THEN o ELSE l END) = 1 THEN (CASE WHEN len(o) > 0 THEN o ELSE l END)[1] END AS identity FROM f")
def resolved(spark, d):
    own = B.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c")).agg(F.collect_set("o_orderstatus").alias("tokens"))
    return own.select("c", I.resolve_identity(F.col("tokens"), F.lit(" o ")).alias("identity"))


@book("b4_join_keys", "SELECT upper(regexp_replace(coalesce(p_name, ''), '\\s+', '', 'g')) AS join_key, count(*) AS n FROM part GROUP BY 1")
def join_keys(spark, d):
    return B.table(spark, d, "part").groupBy(I.join_key(F.col("p_name")).alias("join_key")).agg(F.count("*").alias("n"))


@book("b5_workbook_lookup", "SELECT count(*) AS rows, count(*) FILTER (WHERE c_custkey IS NULL) AS unmatched, count(*) FILTER (WHERE (o_orderkey % 5 = 0 AND c_mktsegment <> 'BUILDING')) AS class_mismatch FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_custkey % 4 > 0")
def lookup(spark, d):
    book_ = B.people(spark, d).where("cast(substring(person_key, 2, 20) as long) % 4 > 0")
    own = B.members(spark, d).join(book_, "person_key", "left")
    wrong = (F.substring("image_key", 2, 20).cast("long") % 5 == 0) & (F.col("diagnosis") != "BUILDING")
    return own.agg(F.count("*").alias("rows"), F.sum(F.col("diagnosis").isNull().cast("long")).alias("unmatched"), F.sum(F.coalesce(wrong, F.lit(False)).cast("long")).alias("class_mismatch"))


def member_table(spark, d):
    k = F.substring("image_key", 2, 20).cast("long")
    return B.members(spark, d).select("image_key", "person_key", (k % 17 > 0).alias("roi_valid"), (k % 23 > 0).alias("roi_reviewed"))


def patients(spark, d):
    own = B.people(spark, d)
    return manifest.patient_manifest(own, member_table(spark, d), own.where("cast(substring(person_key, 2, 20) as long) % 4 > 0").select("person_key"), "BUILDING", ["MACHINERY"])


MANIFEST = f"""{B.PEOPLE}, mem AS (SELECT 'I' || o_orderkey AS image_key, 'P' || o_custkey AS person_key, o_orderkey % 17 > 0 AS v, o_orderkey % 23 > 0 AS r FROM orders),
agg AS (SELECT p.person_key, p.diagnosis, count(m.image_key) AS images, count(*) FILTER (WHERE NOT v) AS bv, count(*) FILTER (WHERE NOT r) AS br, CAST(substr(p.person_key, 2) AS BIGINT) % 4 > 0 AS matched FROM people p LEFT JOIN mem m USING (person_key) GROUP BY ALL),
man AS (SELECT person_key, diagnosis, images, matched, array_to_string(list_filter([CASE WHEN diagnosis = 'MACHINERY' THEN 'excluded_class' END, CASE WHEN bv > 0 THEN 'invalid_roi' END, CASE WHEN images = 0 THEN 'no_image_pairs' END, CASE WHEN br > 0 THEN 'roi_not_reviewed' END, CASE WHEN NOT matched AND diagnosis <> 'BUILDING' THEN 'unmatched_workbook' END], lambda x: x IS NOT NULL), ';') AS exclusion_reason,
 diagnosis <> 'MACHINERY' AND images > 0 AND (matched OR diagnosis = 'BUILDING') AS include_before_roi FROM agg)"""


@book("b6_patient_manifest", f"WITH {MANIFEST} SELECT person_key, diagnosis, images, matched, exclusion_reason, exclusion_reason = '' AS include, include_before_roi FROM man")
def patient_manifest(spark, d):
    return patients(spark, d)


@book("b7_image_manifest", f"WITH {MANIFEST} SELECT image_key, person_key, include_before_roi AND v AND r AND exclusion_reason = '' AS include FROM mem JOIN man USING (person_key)")
def image_manifest(spark, d):
    return manifest.image_manifest(member_table(spark, d), patients(spark, d))


@book("b8_cross_class", "SELECT 'P' || o_custkey AS person_key, count(DISTINCT o_orderpriority) AS classes FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) > 1")
def cross_class(spark, d):
    return manifest.cross_class_conflicts(B.table(spark, d, "orders").select(F.concat(F.lit("P"), F.col("o_custkey").cast("string")).alias("person_key"), F.col("o_orderpriority").alias("diagnosis")))


@book("b9_manifest_audit", f"WITH {MANIFEST} SELECT 'included' AS measure, count(*) FILTER (WHERE exclusion_reason = '') AS n FROM man UNION ALL SELECT 'people', count(*) FROM man UNION ALL SELECT 'matched_abnormal', count(*) FILTER (WHERE matched AND diagnosis <> 'BUILDING') FROM man UNION ALL SELECT 'excluded_' || r, count(*) FROM (SELECT unnest(string_split(exclusion_reason, ';')) AS r FROM man WHERE exclusion_reason <> '') GROUP BY r")
def audit(spark, d):
    return manifest.manifest_audit(patients(spark, d), "BUILDING")


INNER_SQL = f"""WITH {B.PEOPLE}, {B.folds_sql("people")}, each AS (SELECT f.*, o.k AS out FROM folds f CROSS JOIN range(5) o(k)),
rk AS (SELECT CAST(out AS INTEGER) AS outer_fold, person_key, diagnosis, CASE WHEN (row_number() OVER (PARTITION BY out, diagnosis ORDER BY sha256('{B.SEED}|inner|' || out || '|' || person_key)) - 1 + diagnosis_id) % 5 = 0 THEN 'validation' ELSE 'train' END AS split FROM each WHERE outer_fold <> out),
inn AS (SELECT * FROM rk UNION ALL SELECT CAST(out AS INTEGER), person_key, diagnosis, 'test' FROM each WHERE outer_fold = out)"""


def folds(spark, d):
    return splits.outer_folds(B.people(spark, d), 5, B.SEED)


@book("b10_fold_records", f"{INNER_SQL} SELECT image_key, m.person_key FROM (SELECT 'I' || o_orderkey AS image_key, 'P' || o_custkey AS person_key FROM orders WHERE o_orderkey % 17 > 0) m WHERE person_key IN (SELECT person_key FROM inn WHERE outer_fold = 2 AND split = 'validation')")
def fold_records(spark, d):
    images = member_table(spark, d).select("image_key", "person_key", F.col("roi_valid").alias("include"))
    paths = images.select("image_key", F.concat(F.lit("/private/"), "image_key").alias("path"))
    return manifest.fold_records(splits.inner_splits(folds(spark, d), 5, 5, B.SEED), images, paths, 2, "validation")[0].select("image_key", "person_key")


@book("b11_remapped_classes", f"WITH {B.PEOPLE} SELECT person_key, CAST(CASE WHEN diagnosis_id > 1 THEN diagnosis_id - 1 ELSE diagnosis_id END AS INTEGER) AS target_id FROM people WHERE diagnosis <> 'BUILDING'")
def remapped(spark, d):
    mapping = spark.createDataFrame([(s, k, k - (k > 1)) for k, s in enumerate(B.SEGMENTS) if s != "BUILDING"], "diagnosis string, source_id int, target_id int")
    return manifest.remapped(B.people(spark, d), mapping).select("person_key", "target_id")


ITEMS = """items AS (SELECT DISTINCT CASE WHEN doc_id % 2 = 0 THEN 'source' ELSE 'target' END AS side, 'd' || doc_id AS folder, sha256(line) AS item FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE line <> ''),
sz AS (SELECT side, folder, count(*) AS n FROM items GROUP BY ALL),
com AS (SELECT t.folder AS target, s.folder AS source, count(*) AS overlap FROM items t JOIN items s ON t.item = s.item AND t.side = 'target' AND s.side = 'source' GROUP BY ALL),
jac AS (SELECT c.*, overlap / (a.n + b.n - overlap) AS jaccard FROM com c JOIN sz a ON a.folder = target JOIN sz b ON b.folder = source),
bst AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY overlap DESC, jaccard DESC, source DESC) AS k, count(*) OVER (PARTITION BY target, overlap, jaccard) AS ties FROM jac),
fm AS (SELECT target, source, overlap, jaccard, ties > 1 AS ambiguous FROM bst WHERE k = 1)"""


def items(spark, d):
    docs = B.table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where("line != ''")
    return docs.select(F.when(F.col("doc_id") % 2 == 0, "source").otherwise("target").alias("side"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("folder"), F.sha2("line", 256).alias("item"))


@book("b12_folder_matches", f"WITH {ITEMS} SELECT target, source, overlap, round(jaccard, 6) AS jaccard, ambiguous FROM fm")
def folder_matches(spark, d):
    return B.rounded(manifest.folder_matches(items(spark, d)))


@book("b13_sync_plan", f"""WITH {ITEMS}, fo AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'source' ELSE 'target' END AS side, lang AS class, 'd' || doc_id AS folder, coalesce(n, 0) AS items FROM documents LEFT JOIN sz ON sz.folder = 'd' || doc_id),
 tg AS (SELECT folder AS target, class AS tc, items FROM fo WHERE side = 'target'), so AS (SELECT folder AS source, class AS sc, items AS si FROM fo WHERE side = 'source'),
 st AS (SELECT tg.*, fm.source, CASE WHEN items = 0 OR fm.source IS NULL THEN 'unmatched' WHEN ambiguous THEN 'ambiguous' END AS s FROM tg LEFT JOIN fm USING (target)),
 ac AS (SELECT st.*, so.sc, coalesce(s, CASE WHEN row_number() OVER (PARTITION BY s IS NULL, coalesce(st.source, target) ORDER BY tc, target) > 1 THEN 'source_taken' ELSE 'matched' END) AS action FROM st LEFT JOIN so USING (source)),
 plan AS (SELECT action, target, CASE WHEN action <> 'unmatched' THEN source END AS source FROM ac UNION ALL SELECT 'rename', target, source FROM ac WHERE action = 'matched' AND (source <> target OR sc <> tc)
  UNION ALL SELECT 'empty_source', NULL, source FROM so WHERE si = 0 UNION ALL SELECT 'new', NULL, source FROM so WHERE si > 0 AND source NOT IN (SELECT source FROM ac WHERE action = 'matched'))
 SELECT * FROM plan""")
def sync_plan(spark, d):
    own = items(spark, d)
    sizes = own.distinct().groupBy("folder").agg(F.count("*").alias("items"))
    docs = B.table(spark, d, "documents").select(F.when(F.col("doc_id") % 2 == 0, "source").otherwise("target").alias("side"), F.col("lang").alias("class"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("folder"))
    return manifest.sync_plan(docs.join(sizes, "folder", "left").na.fill(0, ["items"]), manifest.folder_matches(own))


@book("b14_merged_documents", "SELECT o_orderkey AS key, o_orderstatus AS a, CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE 'old' END ELSE 'new' END AS crop FROM orders")
def merged_documents(spark, d):
    o = B.table(spark, d, "orders")
    source = o.select(F.col("o_orderkey").alias("key"), F.to_json(F.struct(F.col("o_orderstatus").alias("a"), F.lit("new").alias("crop"))).alias("document"))
    old = F.when(F.col("o_orderkey") % 2 == 0, '{"a": "x", "crop": null}').otherwise('{"a": "x", "crop": "old"}')
    target = o.select(F.col("o_orderkey").alias("key"), F.when(F.col("o_orderkey") % 3 == 0, old).otherwise('{"a": "x"}').alias("document"))
    return manifest.merged_documents(source, target, ["crop"]).select("key", F.try_element_at("document", F.lit("a")).alias("a"), F.try_element_at("document", F.lit("crop")).alias("crop"))


@book("b15_file_changes", f"""WITH {TREE}, s AS (SELECT path, size_bytes AS size, sha256, kind FROM prints WHERE hash_mod(path, 5) > 0), t AS (SELECT path, size_bytes AS size, CASE WHEN hash_mod(path, 3) = 0 THEN 'x' ELSE sha256 END AS sha256 FROM prints WHERE hash_mod(path, 7) > 0)
 SELECT CASE WHEN s.path IS NULL THEN 'target_only' WHEN t.path IS NULL THEN 'copied' WHEN s.size = t.size AND s.sha256 = t.sha256 THEN 'unchanged' WHEN kind = 'annotation' THEN 'json_merged' WHEN kind = 'image' THEN 'image_conflict' ELSE 'replaced' END AS change, count(*) AS n FROM s FULL JOIN t ON s.path = t.path GROUP BY 1""".replace("hash_mod(path, ", "(('0x' || substr(sha256(path), 1, 13))::BIGINT % "))
def file_changes(spark, d):
    from marlstone.functions.draws import uniform

    own = S.fingerprints(tree(spark, d), "docs").withColumnRenamed("size_bytes", "size")
    part = lambda n: uniform(F.sha2("path", 256), n)
    target = own.where(part(7) > 0).withColumn("sha256", F.when(part(3) == 0, "x").otherwise(F.col("sha256")))
    return manifest.file_changes(own.where(part(5) > 0), target).groupBy("change").agg(F.count("*").alias("n"))


@book("b16_merged_folds", "SELECT 'fold_once' AS rule, CAST(0 AS BIGINT) AS n_violations UNION ALL SELECT 'one_fold_each', 0 UNION ALL SELECT 'person_once', count(*) - (SELECT count(DISTINCT doc_id) FROM documents) FROM documents")
def merged_folds(spark, d):
    pred = B.predictions(spark, d)
    return manifest.merged_folds([pred.where(F.col("outer_fold") == k) for k in range(5)])[1]


@book("b17_aligned_predictions", "WITH d AS (SELECT doc_id FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL) SELECT 'coverage' AS rule, count(*) FILTER (WHERE doc_id % 50 = 0) AS n_violations FROM d UNION ALL SELECT 'fold', count(*) FILTER (WHERE doc_id % 50 <> 0 AND doc_id % 40 = 0) FROM d UNION ALL SELECT 'reference', 0")
def aligned(spark, d):
    b = B.predictions(spark, d, "B").where("doc_id % 50 != 0").withColumn("outer_fold", F.when(F.col("doc_id") % 40 == 0, (F.col("outer_fold") + 1) % 5).otherwise(F.col("outer_fold")))
    return manifest.aligned(B.predictions(spark, d, "A"), b)[1]


# bags: documents in bags by language and number


def bag_members(spark, d):
    """Members of a bag with an attention logit."""
    own = B.letters(spark, d)
    bag = F.concat_ws("_", "diagnosis", (F.col("doc_id") % 50).cast("string"))
    return own.select(bag.alias("person_key"), F.col("person_key").alias("image_key"), "diagnosis_id", "a", "e", "i", "o", ((F.col("doc_id") % 13).cast("double") / 4).alias("logit"), (F.col("doc_id") % 50 % 5).cast("int").alias("outer_fold"))


BAG = f"""WITH {B.LETTERS}, bag AS (SELECT diagnosis || '_' || (doc_id % 50) AS person_key, person_key AS image_key, a, e, i, o, (doc_id % 13) / 4 AS logit, CAST(doc_id % 50 % 5 AS INTEGER) AS outer_fold FROM letters),
att AS (SELECT *, exp(logit - max(logit) OVER w) / sum(exp(logit)) OVER w * exp(max(logit) OVER w) AS aw, count(*) OVER w AS n FROM bag WINDOW w AS (PARTITION BY person_key))"""


def attended(spark, d):
    own = bags.attention(bag_members(spark, d))
    counts = own.groupBy("person_key").agg(F.count("*").alias("image_count"))
    return own.join(counts, "person_key").withColumn("model_id", F.lit("m"))


@book("b18_member_alignment", f"{BAG} SELECT 'coverage' AS rule, CAST(0 AS BIGINT) AS n_violations UNION ALL SELECT 'count', count(DISTINCT person_key) FILTER (WHERE n % 4 = 0) FROM att UNION ALL SELECT 'fold', 0 UNION ALL SELECT 'model', 0")
def member_alignment(spark, d):
    own = attended(spark, d)
    n = F.col("image_count")
    pred = own.select("person_key", F.when(n % 4 == 0, n + 1).otherwise(n).alias("image_count"), "outer_fold", "model_id").distinct()
    return manifest.member_alignment(own, pred)


# splits


@book("e1_three_way_split", f"""WITH {B.PEOPLE}, r AS (SELECT *, row_number() OVER (PARTITION BY diagnosis ORDER BY sha256('{B.SEED}|split|' || person_key)) AS rk, count(*) OVER (PARTITION BY diagnosis) AS n FROM people),
 c AS (SELECT *, greatest(1, floor(n * 0.7::DOUBLE)) AS t, greatest(1, floor(n * 0.15::DOUBLE)) AS v FROM r), f AS (SELECT *, CASE WHEN t + v >= n THEN greatest(1, n - v - 1) ELSE t END AS tt FROM c)
 SELECT person_key, diagnosis, CASE WHEN rk <= tt THEN 'train' WHEN rk <= tt + v THEN 'val' ELSE 'test' END AS split FROM f""")
def three_way(spark, d):
    return splits.three_way_split(B.people(spark, d), B.SEED).select("person_key", "diagnosis", "split")


@book("e2_outer_folds", f"WITH {B.PEOPLE}, {B.folds_sql('people')} SELECT person_key, diagnosis, diagnosis_id, outer_fold FROM folds")
def outer_folds(spark, d):
    return folds(spark, d).select("person_key", "diagnosis", "diagnosis_id", "outer_fold")


@book("e3_inner_splits", f"{INNER_SQL} SELECT * FROM inn")
def inner_splits(spark, d):
    return splits.inner_splits(folds(spark, d), 5, 5, B.SEED)


@book("e4_fold_audit", f"WITH {B.PEOPLE}, {B.folds_sql('people')}, c AS (SELECT diagnosis, " + ", ".join(f"count(*) FILTER (WHERE outer_fold = {k}) AS fold_{k}" for k in range(5)) + " FROM folds GROUP BY 1) SELECT *, greatest(fold_0, fold_1, fold_2, fold_3, fold_4) - least(fold_0, fold_1, fold_2, fold_3, fold_4) AS spread FROM c")
def fold_audit(spark, d):
    return splits.fold_audit(folds(spark, d), 5)


@book("e5_capped_members", f"WITH {B.MEMBERS}, r AS (SELECT *, row_number() OVER (PARTITION BY person_key ORDER BY sha256('{B.SEED}|3|' || person_key || '|' || image_key)) AS k FROM members) SELECT image_key, person_key FROM r WHERE k <= 4")
def capped(spark, d):
    return splits.capped_members(B.members(spark, d), 4, B.SEED, 3).select("image_key", "person_key")


@book("e6_class_weights", f"WITH {B.PEOPLE}, c AS (SELECT diagnosis, count(*) AS n FROM people GROUP BY 1) SELECT diagnosis, n, round(1 / n, 6) AS inverse, round(1 / n / sum(1 / n) OVER () * count(*) OVER (), 6) AS normalised, round(sum(n) OVER () / (count(*) OVER () * n), 6) AS balanced FROM c")
def class_weights(spark, d):
    return B.rounded(splits.class_weights(B.people(spark, d)))


@book("e8_padded_bags", f"WITH {B.MEMBERS} SELECT person_key, array_to_string(list_sort(list(image_key)) || list_resize(CAST([] AS VARCHAR[]), greatest(40 - count(*), 0), ''), ',') AS members, CAST(count(*) AS BIGINT) AS n_real FROM members GROUP BY 1")
def padded(spark, d):
    own = splits.padded_bags(B.members(spark, d), 40)
    return own.select("person_key", F.array_join("members", ",").alias("members"), F.size(F.filter("mask", lambda m: m)).cast("long").alias("n_real"))


@book("e9_examples", f"WITH {B.PEOPLE}, {B.folds_sql('people')} SELECT outer_fold, diagnosis, min(person_key) AS person_key FROM folds GROUP BY ALL")
def examples(spark, d):
    return splits.examples(folds(spark, d))


# member features


@book("f2_person_features", f"WITH {B.MEMBERS}, c AS (SELECT person_key, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM members) SELECT person_key, count(*) AS image_count, round(avg(cents), 3) AS cents_mean, round(stddev_pop(cents), 3) AS cents_std, CAST(min(cents) AS DOUBLE) AS cents_min, CAST(max(cents) AS DOUBLE) AS cents_max FROM c GROUP BY 1")
def person_features(spark, d):
    return B.rounded(bags.aggregated_features(B.members(spark, d).withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("long")), ["cents"]), 3)


@book("f8_mean_probabilities", f"WITH {B.predictions_sql('A')}, each AS (SELECT reference_class || '_' || (doc_id % 50) AS person_key, unnest(range(4)) AS class_id, unnest(probs) AS p FROM pred_a) SELECT person_key, CAST(class_id AS INTEGER) AS class_id, round(avg(p), 6) AS prob, round(ln(greatest(avg(p), 1e-8)), 5) AS log_prob FROM each GROUP BY ALL")
def mean_probabilities(spark, d):
    own = B.predictions(spark, d).select(F.concat_ws("_", "reference_class", (F.col("doc_id") % 50).cast("string")).alias("person_key"), "probs")
    return bags.mean_probabilities(own, 4).select("person_key", "class_id", F.round("prob", 6).alias("prob"), F.round("log_prob", 5).alias("log_prob"))


@book("f9_mean_vectors", "WITH e AS (SELECT 'L' || label AS person_key, unnest(range(64)) AS place, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) SELECT person_key, CAST(place AS INTEGER) AS place, round(avg(v), 6) AS value FROM e GROUP BY ALL")
def mean_vectors(spark, d):
    own = B.table(spark, d, "embeddings").select(F.concat(F.lit("L"), F.col("label").cast("string")).alias("person_key"), F.col("embedding").cast("array<double>").alias("v"))
    return B.rounded(bags.mean_vectors(own, "v"))


@book("f10_attention_pooling", f"{BAG}, p AS (SELECT person_key, 0 AS place, sum(aw * a) AS value FROM att GROUP BY 1 UNION ALL SELECT person_key, 1, sum(aw * e) FROM att GROUP BY 1 UNION ALL SELECT person_key, 2, sum(aw * i) FROM att GROUP BY 1) SELECT person_key, CAST(place AS INTEGER) AS place, round(value, 6) AS value FROM p")
def attention_pooling(spark, d):
    own = bags.attention(bag_members(spark, d)).withColumn("v", F.array(*(F.col(c).cast("double") for c in "aei")))
    return B.rounded(bags.pooled_vectors(own, "v"))


@book("f11_concentration", f"{BAG} SELECT person_key, round(CASE WHEN count(*) > 1 THEN (sum(aw * ln(aw)) + sum(aw) * ln(count(*))) / ln(count(*)) ELSE 0 END, 6) AS penalty FROM att GROUP BY 1")
def concentration(spark, d):
    return B.rounded(bags.concentration(bags.attention(bag_members(spark, d))))


@book("f12_attention_audit", f"{BAG}, m AS (SELECT person_key, outer_fold, max(aw) AS m, count(*) AS n FROM att GROUP BY ALL) SELECT outer_fold, count(*) AS people, count(*) FILTER (WHERE n > 1) AS multi, round(coalesce(avg(m) FILTER (WHERE n > 1), 1), 6) AS mean_max, round(coalesce(quantile_disc(m, 0.95) FILTER (WHERE n > 1), 1), 6) AS p95_max, round(coalesce(avg(CAST(m >= 0.3 AS INTEGER)) FILTER (WHERE n > 1), 0), 6) AS collapse_rate, coalesce(avg(CAST(m >= 0.3 AS INTEGER)) FILTER (WHERE n > 1), 0) <= 0.5 AS passed FROM m GROUP BY outer_fold")
def attention_audit(spark, d):
    return B.rounded(bags.attention_audit(bags.attention(bag_members(spark, d)), 0.3, 0.5, ["outer_fold"]))


@book("f12_attention_contract", f"{BAG} SELECT 'weight_sum' AS rule, CAST(0 AS BIGINT) AS n_violations UNION ALL SELECT 'count', 0 UNION ALL SELECT 'one_fold', count(*) FROM (SELECT person_key FROM att GROUP BY 1 HAVING count(DISTINCT outer_fold) > 1)")
def attention_contract(spark, d):
    return bags.attention_violations(attended(spark, d))


@book("f13_member_ranks", f"{BAG} SELECT person_key, image_key, CAST(row_number() OVER (PARTITION BY person_key ORDER BY logit DESC, image_key) AS INTEGER) AS attention_rank FROM att")
def member_ranks(spark, d):
    return bags.ranked_members(bags.attention(bag_members(spark, d))).select("person_key", "image_key", "attention_rank")
