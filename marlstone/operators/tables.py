"""The clinical table and its input audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions import clinical as C


def clinical_table(cells: DataFrame) -> DataFrame:
    """(event_id, cell, marker) -> lab with missing and censor columns, age in (0, 120], marker; a negative lab is invalid."""
    own = cells.withColumn("__n", C.numeric(F.col("cell")))
    lab = F.when(F.col("__n.value") >= 0, F.col("__n.value"))
    age = F.when((F.col("__n.value") > 0) & (F.col("__n.value") <= 120), F.col("__n.value"))
    return own.select("event_id", lab.alias("lab"), lab.isNull().alias("lab_missing"), F.col("__n.censor").alias("lab_censor"), age.alias("age"), C.marker(F.col("marker"))["value"].alias("marker"))


def clinical_audit(cells: DataFrame, by: str) -> DataFrame:
    """Rows, missing, censored and invalid cells, in long form."""
    own = cells.withColumn("__n", C.numeric(F.col("cell")))
    n = lambda c: F.sum(c.cast("long"))
    sums = own.groupBy(by).agg(F.count("*").alias("a"), n(F.col("__n.value").isNull()).alias("b"), n(F.col("__n.censor") != 0).alias("c"), n(F.col("__n.invalid").isNotNull()).alias("d"))
    return sums.selectExpr(by, "stack(4, 'rows', a, 'missing', b, 'censored', c, 'invalid', d) AS (measure, n)")
