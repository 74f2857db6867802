"""The reference's tables as views of the test tables, in Spark and in DuckDB SQL.

Both sides are written from the same description; integers are used up to the last step, so sums agree in every order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators.models import centroid_oof
from marlstone.operators.splits import outer_folds
from marlstone.sources.tables import written

#: Class orders, position = id.
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
LANGUAGES = ["de", "en", "es", "fr"]
SEED = 17


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def place(column: Column | str, values: list[str]) -> Column:
    return (F.array_position(F.array(*(F.lit(v) for v in values)), F.col(column) if isinstance(column, str) else column) - 1).cast("int")


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as people; their market segment is the class."""
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("P"), F.col("c_custkey").cast("string")).alias("person_key"), F.col("c_mktsegment").alias("diagnosis"), place("c_mktsegment", SEGMENTS).alias("diagnosis_id"))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as the images of people."""
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("I"), F.col("o_orderkey").cast("string")).alias("image_key"), F.concat(F.lit("P"), F.col("o_custkey").cast("string")).alias("person_key"), F.col("o_totalprice"), F.col("o_orderstatus"))


def letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as people: class is the language; features are letters per thousand characters."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL AND lang IS NOT NULL")

    def share(c: str) -> Column:
        less = F.length(F.replace(F.replace("text", F.lit(c)), F.lit(c.upper())))
        return F.expr("1000").cast("long") * (F.length("text") - less).cast("long")

    n = F.greatest(F.length("text"), F.lit(1)).cast("long")
    own = docs.select(F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("person_key"), F.col("doc_id"), F.col("lang").alias("diagnosis"), place("lang", LANGUAGES).alias("diagnosis_id"), n.alias("n"), *(share(c).alias(f"s_{c}") for c in "aeio"))
    # a few numbers per document from here on: the texts are read once, whatever is computed from them
    return written(own.select("person_key", "doc_id", "diagnosis", "diagnosis_id", *(F.expr(f"s_{c} div n").alias(c) for c in "aeio")), "letters")


def predictions(spark: SparkSession, sf_dir: str, model: str = "A") -> DataFrame:
    """Out-of-fold predictions of the letter models A (a, e, i) and B (o)."""
    features = ["a", "e", "i"] if model == "A" else ["o"]
    folds = outer_folds(letters(spark, sf_dir), 5, SEED)
    scored = centroid_oof(written(folds, "folds"), features, len(LANGUAGES), 1000.0)
    return scored.select("person_key", "doc_id", "outer_fold", F.col("diagnosis_id").alias("reference_id"), F.col("diagnosis").alias("reference_class"), "probs", F.lit(1).alias("image_count"), F.lit(f"letters_{model.lower()}").alias("model_id"))


def gate(spark: SparkSession, sf_dir: str, model: str = "A") -> DataFrame:
    """English or not, by the probability of English."""
    score = F.element_at("probs", 2)
    return predictions(spark, sf_dir, model).select("person_key", "outer_fold", (F.col("reference_id") == 1).alias("positive"), score.alias("score"), (score >= 0.5).alias("predicted"), "model_id")


PEOPLE = f"people AS (SELECT 'P' || c_custkey AS person_key, c_mktsegment AS diagnosis, CAST(list_position({SEGMENTS}, c_mktsegment) - 1 AS INTEGER) AS diagnosis_id FROM customer)"
MEMBERS = "members AS (SELECT 'I' || o_orderkey AS image_key, 'P' || o_custkey AS person_key, o_totalprice, o_orderstatus FROM orders)"


def folds_sql(source: str, name: str = "folds", k: int = 5) -> str:
    return f"{name} AS (SELECT *, CAST((row_number() OVER (PARTITION BY diagnosis ORDER BY sha256('{SEED}|outer|' || person_key)) - 1 + diagnosis_id) % {k} AS INTEGER) AS outer_fold FROM {source})"


LETTERS = (
    f"letters AS (SELECT 'D' || doc_id AS person_key, doc_id, lang AS diagnosis, CAST(list_position({LANGUAGES}, lang) - 1 AS INTEGER) AS diagnosis_id, "
    + ", ".join(f"(1000 * (length(text) - length(translate(text, '{c}{c.upper()}', '')))) // greatest(length(text), 1) AS {c}" for c in "aeio")
    + " FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL)"
)


def predictions_sql(model: str = "A", name: str | None = None) -> str:
    """CTEs up to ``pred_a`` or ``pred_b``."""
    m, features = model.lower(), ["a", "e", "i"] if model == "A" else ["o"]
    sums = ", ".join(f"sum({f}) AS {f}" for f in features)
    centre = ", ".join(f"CAST(t.{f} - s.{f} AS DOUBLE) / (t.n - s.n) AS {f}" for f in features)
    distance = " + ".join(f"(l.{f} - c.{f}) * (l.{f} - c.{f})" for f in features)
    return f"""{LETTERS}, {folds_sql('letters', 'lf')},
cells_{m} AS (SELECT f.outer_fold, c.diagnosis_id, count(x.person_key) AS n, {", ".join(f"coalesce(sum(x.{f}), 0) AS {f}" for f in features)} FROM (SELECT DISTINCT outer_fold FROM lf) f CROSS JOIN (SELECT DISTINCT diagnosis_id FROM lf) c LEFT JOIN lf x ON x.outer_fold = f.outer_fold AND x.diagnosis_id = c.diagnosis_id GROUP BY ALL),
totals_{m} AS (SELECT diagnosis_id, count(*) AS n, {sums} FROM lf GROUP BY diagnosis_id),
centres_{m} AS (SELECT s.outer_fold, s.diagnosis_id AS k, {centre} FROM cells_{m} s JOIN totals_{m} t USING (diagnosis_id)),
dist_{m} AS (SELECT l.person_key, l.doc_id, l.outer_fold, l.diagnosis_id, l.diagnosis, c.k, {distance} AS d FROM lf l JOIN centres_{m} c ON c.outer_fold = l.outer_fold),
soft_{m} AS (SELECT *, exp((min(d) OVER (PARTITION BY person_key) - d) / 1000.0) AS e FROM dist_{m}),
pred_{m} AS (SELECT person_key, doc_id, outer_fold, diagnosis_id AS reference_id, diagnosis AS reference_class, list(round(e / total, 9) ORDER BY k) AS probs, 1 AS image_count, 'letters_{m}' AS model_id FROM (SELECT *, sum(e) OVER (PARTITION BY person_key ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS total FROM soft_{m}) GROUP BY ALL)"""


def gate_sql(model: str = "A") -> str:
    m = model.lower()
    return predictions_sql(model) + f", gate_{m} AS (SELECT person_key, outer_fold, reference_id = 1 AS positive, probs[2] AS score, probs[2] >= 0.5 AS predicted, model_id FROM pred_{m})"


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, for comparison between engines."""
    return df.select(*(F.round(f.name, places).alias(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f.name) for f in df.schema.fields))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
