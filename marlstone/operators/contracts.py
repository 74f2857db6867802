"""Contracts as violation tables (rule, n_violations); ``enforce`` fails closed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlstone.functions import vectors as V


class ContractError(ValueError):
    pass


def enforce(violations: DataFrame) -> None:
    """Raises if any rule is violated; the table has one row per rule."""
    bad = [f"{r.rule}: {r.n_violations}" for r in violations.where("n_violations > 0").orderBy("rule").collect()]
    if bad:
        raise ContractError("; ".join(bad))


def counted(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One pass: how many rows break each rule (true: broken; null counts as kept)."""
    sums = df.agg(*(F.coalesce(F.sum(F.coalesce(c, F.lit(False)).cast("long")), F.lit(0)).alias(f"r{k}") for k, c in enumerate(rules.values())))
    pairs = ", ".join(f"'{n}', r{k}" for k, n in enumerate(rules))
    return sums.selectExpr(f"stack({len(rules)}, {pairs}) AS (rule, n_violations)")


def prediction_violations(predictions: DataFrame, registry: DataFrame, k: int) -> DataFrame:
    """Coverage, uniqueness, probabilities, class range, class and fold against the registry, members."""
    p = F.col("probs")
    seen = predictions.groupBy("person_key").agg(F.count("*").alias("n"))
    rows = counted(predictions, {
        "finite": F.exists(p, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), "range": F.exists(p, lambda x: (x < 0) | (x > 1)), "sum": F.abs(V.total(p) - 1) > 1e-6,
        "classes": F.size(p) != k, "reference_range": (F.col("reference_id") < 0) | (F.col("reference_id") >= k), "members": F.col("image_count") < 1,
    })
    both = predictions.select("person_key", "reference_id", "outer_fold").join(registry.select("person_key", F.col("diagnosis_id").alias("__c"), F.col("outer_fold").alias("__f")), "person_key", "full")
    joined = counted(both, {"missing": F.col("reference_id").isNull(), "extra": F.col("__c").isNull(), "class": F.col("reference_id") != F.col("__c"), "fold": F.col("outer_fold") != F.col("__f")})
    return rows.unionByName(joined).unionByName(counted(seen, {"unique": F.col("n") > 1}))


def gate_violations(gate: DataFrame) -> DataFrame:
    """The prediction follows the threshold, a fold has one setting, and both kinds."""
    folds = gate.groupBy("outer_fold").agg(F.countDistinct("threshold", "temperature", "model_id").alias("s"), F.countDistinct("positive").alias("c"))
    return counted(gate, {"prediction": F.col("predicted") != (F.col("score") >= F.col("threshold"))}).unionByName(counted(folds, {"one_setting": F.col("s") > 1, "both_classes": F.col("c") < 2}))


def frozen_files(prints: DataFrame, expected: DataFrame) -> DataFrame:
    """Files against expected (path, sha256): missing, changed."""
    both = expected.select("path", F.col("sha256").alias("__e")).join(prints.select("path", "sha256"), "path", "left")
    return counted(both, {"missing": F.col("sha256").isNull(), "changed": F.col("sha256") != F.col("__e")})


def json_leaves(df: DataFrame, key: str, document: str, levels: int = 4) -> DataFrame:
    """Every scalar of a JSON text with its path: key, path, value. One level is opened at a time."""
    own = df.select(F.col(key).alias("__key"), F.try_parse_json(F.col(document)).alias("v"), F.lit("$").alias("path"))
    out = None
    for level in range(levels + 1):
        kind = F.schema_of_variant("v")
        nested = kind.startswith("OBJECT") | kind.startswith("ARRAY")
        leaves = own.where(~nested).select("__key", "path", F.expr("cast(v as string)").alias("value"))
        out = leaves if out is None else out.unionByName(leaves)
        if level < levels:
            own.createOrReplaceTempView("__marlstone_variants")
            opened = df.sparkSession.sql("SELECT s.__key, e.value AS v, concat(s.path, CASE WHEN e.key IS NULL THEN concat('[', e.pos, ']') ELSE concat('.', e.key) END) AS path FROM __marlstone_variants s, LATERAL variant_explode(s.v) e")
            own = opened
    return out.withColumnRenamed("__key", key)


# Name fragments and value patterns that must not leave the private side.
FORBIDDEN_KEYS = ["patient_name", "folder", "source_path", "secret"]
PRIVATE_VALUES = r"^(/|[A-Za-z]:[\\/])|(^|[\\/])(raw|private)([\\/]|$)"


def privacy_violations(leaves: DataFrame, key: str) -> DataFrame:
    """Leaves with a forbidden name fragment or a path-like value."""
    name = F.lower(F.col("path"))
    forbidden = F.lit(False)
    for k in FORBIDDEN_KEYS:
        forbidden = forbidden | name.contains(k)
    rule = F.when(forbidden, "forbidden_key").when(F.col("value").rlike(PRIVATE_VALUES), "private_value")
    return leaves.withColumn("rule", rule).where("rule IS NOT NULL").select(key, "path", "rule")


def ledger_violations(records: DataFrame, artifacts: DataFrame) -> DataFrame:
    """records (experiment_id, kind, revision, folds, seeds, paths, hashes) against rules, and hashes against artifacts (path, sha256)."""
    once = records.groupBy("experiment_id").agg(F.count("*").alias("n"))
    rows = counted(records, {
        "id": F.coalesce(F.trim("experiment_id"), F.lit("")) == "", "revision": ~F.coalesce(F.col("revision").rlike("^[0-9a-f]{7,64}$"), F.lit(False)),
        "folds_seeds": F.size("folds") != F.size("seeds"), "path_hash_pairs": F.size("paths") != F.size("hashes"), "hash_format": F.exists("hashes", lambda h: ~h.rlike("^[0-9a-f]{64}$")),
    })
    pairs = records.select(F.explode(F.arrays_zip("paths", "hashes")).alias("z")).select(F.col("z.paths").alias("path"), F.col("z.hashes").alias("h")).join(artifacts.select("path", "sha256"), "path", "left")
    return rows.unionByName(counted(once, {"unique": F.col("n") > 1})).unionByName(counted(pairs, {"artifact": ~F.coalesce(F.col("h") == F.col("sha256"), F.lit(False))}))


def summary_checks(folds: DataFrame, most_hours: float, most_memory: float) -> DataFrame:
    """folds (outer_fold, run_id, revision, hours, memory_gb, finished) -> failed checks per fold."""
    w = W.partitionBy("run_id")
    marked = folds.withColumn("__runs", F.count("*").over(w))
    revisions = folds.agg(F.countDistinct("revision").alias("__revisions"))
    own = marked.crossJoin(F.broadcast(revisions))  # one row
    checks = F.create_map(F.lit("finished"), F.col("finished"), F.lit("own_run"), F.col("__runs") == 1, F.lit("one_revision"), F.col("__revisions") == 1, F.lit("hours"), F.col("hours") <= most_hours, F.lit("memory"), F.col("memory_gb") <= most_memory)
    return own.select("outer_fold", F.array_join(F.array_sort(F.map_keys(F.map_filter(checks, lambda _, v: ~v))), ";").alias("failed"))


def broken_links(pages: DataFrame, key: str, html: str, targets: DataFrame) -> DataFrame:
    """Links of pages that are neither external, anchors nor mail, and whose target isn't there: key, link."""
    links = pages.select(key, F.explode(F.regexp_extract_all(html, F.lit('href="([^"]*)"'), 1)).alias("link"))
    own = links.where(~F.col("link").rlike("^([a-z]+:|//|#|$)")).distinct()
    return own.join(targets.select(F.col("target").alias("link")), "link", "left_anti").select(key, "link")


def chain_violations(steps: DataFrame) -> DataFrame:
    """steps (chain, position, input_sha256, output_sha256): each step's input must be the output before."""
    w = W.partitionBy("chain").orderBy("position")
    own = steps.withColumn("__b", F.lag("output_sha256").over(w)).withColumn("__p", F.lag("position").over(w))
    return counted(own, {"broken": F.col("__p").isNotNull() & ~F.col("input_sha256").eqNullSafe(F.col("__b")), "gap": F.col("position") != F.col("__p") + 1})
