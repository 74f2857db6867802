"""Exact quantiles, ranks and Kolmogorov-Smirnov distances without a task that holds a whole feature.

Everything works on counts per distinct value. A feature's values are cut into buckets at the edges of an approximate
percentile sketch, so a bucket holds about a share of ``1 / BUCKETS`` of the values however they are spread (or one value that is
more frequent); running counts go inside buckets and over the few bucket totals. The sketch only places the edges: results are exact
and don't depend on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.draws import running_sums
from marlstone.sources.tables import written

#: Buckets of a feature; a power of two.
BUCKETS = 256


def edges(counts: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, edges): ascending bucket edges of each group, by its distinct values."""
    shares = F.array(*(F.lit(k / BUCKETS) for k in range(1, BUCKETS)))
    return counts.groupBy(*by).agg(F.percentile_approx(value, shares, F.lit(4 * BUCKETS)).alias("__edges"))


def bucket(value: Column, cuts: Column) -> Column:
    """How many of the ``BUCKETS`` - 1 ascending edges aren't above the value, by halving."""
    steps = F.array(*(F.lit(BUCKETS >> k) for k in range(1, BUCKETS.bit_length())))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(cuts, at + step - 1) <= value, at + step).otherwise(at))


def placed(counts: DataFrame, by: list[str], value: str, columns: list[str]) -> DataFrame:
    """Adds ``before_<c>``: the sum of c over the group's smaller values. One row per group and distinct value."""
    counts = written(counts, "counts")
    cuts = written(edges(counts, by, value), "edges")
    own = counts.join(cuts, by) if by else counts.crossJoin(F.broadcast(cuts))  # one row
    with_bucket = own.withColumn("__at", bucket(F.col(value), F.col("__edges"))).drop("__edges")
    return running_sums(with_bucket, by, value, F.col("__at"), columns).drop("__at")


def at_place(value: Column, before: Column, n: Column, place: Column) -> Column:
    """An aggregate: the value at a place (from 0) of the ordered rows."""
    return F.max(F.when((before <= place) & (n > 0), value))


def quantile(value: Column, before: Column, n: Column, total: Column, q: float) -> Column:
    """An aggregate over placed counts: the quantile with linear interpolation between its two places."""
    place = (total - 1) * F.lit(float(q))
    low, high = at_place(value, before, n, F.floor(place)), at_place(value, before, n, F.ceil(place))
    return low + (high - low) * (F.max(place) - F.floor(F.max(place)))


def exact_quantiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(by, a column for each share) of the rows with a value."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    own = placed(counts, by, value, ["n"])
    totals = own.groupBy(*by).agg(F.sum("n").alias("__total"))
    own = own.join(totals, by) if by else own.crossJoin(F.broadcast(totals))  # one row
    return own.groupBy(*by).agg(*(quantile(F.col(value), F.col("before_n"), F.col("n"), F.col("__total"), q).alias(name) for name, q in shares.items()))
