"""Deterministic draws: the same order and integers on any partitioning, from SHA-256 of a seed and keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def draw(seed: int | str, *parts: str | Column) -> Column:
    """64 hex digits; orders by it are random but fixed. Strings are column names."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *(F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts)), 256)


def uniform(hashed: Column, n: Column | int) -> Column:
    """An integer from 0 to n - 1 out of the first 52 bits of a draw."""
    return F.conv(F.substring(hashed, 1, 13), 16, 10).cast("long") % (F.lit(n) if isinstance(n, int) else n)


def hash_rank(df: DataFrame, groups: list[str], hashed: str, name: str, digits: int = 3) -> DataFrame:
    """Adds the rank (from 1) of each row in its group by a draw, without one task per group.

    Rows are ranked in buckets of the draw's first digits; a bucket's offset is the number of rows in those before it. The
    table of bucket counts has at most 16 ** digits rows for each group."""
    bucketed = df.withColumn("__bucket", F.substring(hashed, 1, digits))
    counts = bucketed.groupBy(*groups, "__bucket").agg(F.count("*").alias("__n"))
    offsets = counts.select(*(F.col(g).alias(f"__g{k}") for k, g in enumerate(groups)), F.col("__bucket").alias("__b"), (F.sum("__n").over(W.partitionBy(*groups).orderBy("__bucket")) - F.col("__n")).alias("__offset"))
    joined = bucketed.join(offsets, [F.col(g).eqNullSafe(F.col(f"__g{k}")) for k, g in enumerate(groups)] + [F.col("__bucket") == F.col("__b")])
    within = F.row_number().over(W.partitionBy(*groups, "__bucket").orderBy(hashed))
    return joined.withColumn(name, F.col("__offset") + within).drop("__bucket", "__b", "__offset", *(f"__g{k}" for k in range(len(groups))))


def running_sums(df: DataFrame, groups: list[str], order: str, bucket: Column, columns: list[str]) -> DataFrame:
    """Adds ``before_<c>``: the sum of c over the group's rows before this one by ``order`` (distinct in a group).

    ``bucket`` must not fall while ``order`` rises and have a bounded number of values; sums run inside buckets and over
    the few bucket totals, so no group meets in one task."""
    own = df.withColumn("__bucket", bucket)
    totals = own.groupBy(*groups, "__bucket").agg(*(F.sum(c).alias(f"__t_{c}") for c in columns))
    w = W.partitionBy(*groups).orderBy("__bucket") if groups else W.partitionBy(F.lit(0)).orderBy("__bucket")
    totals = totals.select(*(F.col(g).alias(f"__g{k}") for k, g in enumerate(groups)), F.col("__bucket").alias("__b"), *((F.sum(f"__t_{c}").over(w) - F.col(f"__t_{c}")).alias(f"__o_{c}") for c in columns))
    joined = own.join(totals, [F.col(g).eqNullSafe(F.col(f"__g{k}")) for k, g in enumerate(groups)] + [F.col("__bucket") == F.col("__b")])
    inner = W.partitionBy(*groups, "__bucket").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    for c in columns:
        joined = joined.withColumn(f"before_{c}", F.col(f"__o_{c}") + F.sum(c).over(inner) - F.col(c))
    return joined.drop("__bucket", "__b", *(f"__g{k}" for k in range(len(groups))), *(f"__o_{c}" for c in columns))
