"""Clinical cells (G), dressed up from event values."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions import clinical as C
from marlstone.operators import tables
from marlstone.plans import bindings as B
from marlstone.plans.book import Book

book = Book()


def cells(spark, d):
    e = B.table(spark, d, "events")
    v = F.format_string("%.1f", F.floor(F.col("value")).cast("double"))
    k = F.col("event_id") % 8
    cell = F.when(k == 0, v).when(k == 1, F.concat(F.lit("<"), v)).when(k == 2, F.concat(F.lit(" >= "), v)).when(k == 3, F.concat(v, F.lit("岁"))).when(k == 4, "/").when(k == 5, "未查").when(k == 6, "阳性")
    return e.select("event_id", "user_id", "event_type", cell.alias("cell"), F.when(k == 6, "+").when(k == 4, "/").when(k == 1, "阴性").when(k == 2, "?").otherwise("negative").alias("marker"), F.when(k == 0, "男").when(k == 1, "F").when(k == 2, "x").otherwise(" male ").alias("sex"))


V = "floor(value)"
CELLS = f"cells AS (SELECT event_id, user_id, event_type, event_id % 8 AS k, {V} AS v FROM events)"
VALUE = "CASE WHEN k < 4 THEN v END"
CENSOR = "CAST(CASE WHEN k = 1 THEN -1 WHEN k = 2 THEN 1 ELSE 0 END AS INTEGER)"


@book("g1_numeric_cells", f"WITH {CELLS} SELECT event_id, {VALUE} AS value, {CENSOR} AS censor, CASE WHEN k = 6 THEN '阳性' END AS invalid FROM cells")
def numeric(spark, d):
    return cells(spark, d).select("event_id", C.numeric(F.col("cell")).alias("c")).select("event_id", "c.*")


@book("g2_sex", f"WITH {CELLS} SELECT CASE WHEN k = 1 THEN 0.0::DOUBLE WHEN k = 2 THEN NULL ELSE 1.0::DOUBLE END AS sex, count(*) AS n FROM cells GROUP BY 1")
def sex(spark, d):
    return cells(spark, d).groupBy(C.sex(F.col("sex")).alias("sex")).agg(F.count("*").alias("n"))


@book("g3_marker", f"WITH {CELLS} SELECT CASE WHEN k = 6 THEN 1.0::DOUBLE WHEN k IN (2, 4) THEN NULL ELSE 0.0::DOUBLE END AS value, CASE WHEN k = 2 THEN '?' END AS invalid, count(*) AS n FROM cells GROUP BY 1, 2")
def marker(spark, d):
    return cells(spark, d).groupBy(C.marker(F.col("marker")).alias("m")).agg(F.count("*").alias("n")).select("m.*", "n")


@book("g4_clinical_table", f"WITH {CELLS} SELECT event_id, {VALUE} AS lab, {VALUE} IS NULL AS lab_missing, {CENSOR} AS lab_censor, CASE WHEN k < 4 AND v > 0 AND v <= 120 THEN v END AS age, CASE WHEN k = 6 THEN 1.0::DOUBLE WHEN k IN (2, 4) THEN NULL ELSE 0.0::DOUBLE END AS marker FROM cells")
def table(spark, d):
    return tables.clinical_table(cells(spark, d))


@book("g5_input_audit", f"WITH {CELLS}, c AS (SELECT event_type, {VALUE} AS lab, {CENSOR} AS censor, k = 6 AS bad FROM cells) SELECT event_type, 'rows' AS measure, count(*) AS n FROM c GROUP BY 1 UNION ALL SELECT event_type, 'missing', count(*) FILTER (WHERE lab IS NULL) FROM c GROUP BY 1 UNION ALL SELECT event_type, 'censored', count(*) FILTER (WHERE censor <> 0) FROM c GROUP BY 1 UNION ALL SELECT event_type, 'invalid', count(*) FILTER (WHERE bad) FROM c GROUP BY 1")
def audit(spark, d):
    return tables.clinical_audit(cells(spark, d), "event_type")
