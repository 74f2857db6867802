"""Time-ordered monitors: alerts, sustained pressure, early stopping, elapsed time, series edges."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def runtime_state(elapsed_hours: Column, memory_gb: Column, soft: float, hard: float, least_memory: float) -> Column:
    """The hard limit comes before the soft one, and both before memory."""
    return F.when(elapsed_hours >= hard, "HARD_TIME_LIMIT_REACHED").when(elapsed_hours >= soft, "TIME_BUDGET_REACHED").when(memory_gb < least_memory, "RESOURCE_GUARD_STOPPED").otherwise("CONTINUE")


def start_reasons(disk_gb: Column, memory_gb: Column, gpu_gb: Column, bounds: tuple[float, float, float]) -> Column:
    return F.array_compact(F.array(F.when(disk_gb < bounds[0], "disk_free_low"), F.when(memory_gb < bounds[1], "memory_available_low"), F.when(gpu_gb > bounds[2], "gpu_memory_used_high")))


def sustained(samples: DataFrame, limit: float, seconds: float, run: str = "run", at: str = "at", value: str = "value", order: list[str] = [], width: float = 86400) -> DataFrame:  # noqa: B006
    """Adds ``fired``: the value has been above the limit since a sample at least ``seconds`` earlier, without a break.

    Islands of high samples are numbered by the low samples before them; an island's first sample never fires. A run is cut
    into spans of ``width`` seconds, so that a long one doesn't meet in one task; what is open at a span's end is carried on
    over a table with a row per run and span."""
    span = W.partitionBy("__run", "__span").orderBy(at, *order).rowsBetween(W.unboundedPreceding, W.currentRow)
    own = samples.withColumn("__run", F.col(run)).withColumn("__span", F.floor(F.col(at) / width)).withColumn("__high", F.coalesce(F.col(value) > limit, F.lit(False)))
    own = own.withColumn("__island", F.sum((~F.col("__high")).cast("long")).over(span))
    inner = W.partitionBy("__run", "__span", "__island", "__high").orderBy(at, *order)
    own = own.withColumn("__since", F.min(at).over(inner.rowsBetween(W.unboundedPreceding, W.currentRow))).withColumn("__k", F.row_number().over(inner))
    # where a span's last sample is high, the time since when
    last = F.max_by(F.when(F.col("__high"), F.col("__since")), F.struct(at, *order))
    spans = own.groupBy("__run", "__span").agg(F.max("__island").alias("lows"), last.alias("open"))
    runs = W.partitionBy("__run").orderBy("__span")
    spans = spans.withColumn("broken", F.sum((F.col("lows") > 0).cast("long")).over(runs.rowsBetween(W.unboundedPreceding, W.currentRow)))
    spans = spans.withColumn("open", F.min("open").over(W.partitionBy("__run", "broken").orderBy("__span").rowsBetween(W.unboundedPreceding, W.currentRow)))
    spans = spans.select(F.col("__run").alias("__r"), F.col("__span").alias("__s"), F.lag("open").over(runs).alias("__open"))
    own = own.join(spans, F.col("__run").eqNullSafe(F.col("__r")) & F.col("__span").eqNullSafe(F.col("__s")))
    carried = F.when(F.col("__island") == 0, F.col("__open"))
    fired = F.col("__high") & ((F.col("__k") > 1) | carried.isNotNull()) & (F.col(at) - F.coalesce(carried, F.col("__since")) >= seconds)
    return own.withColumn("fired", fired).drop("__run", "__span", "__high", "__island", "__since", "__k", "__r", "__s", "__open")


def early_stopping(scores: DataFrame, patience: int, run: str = "run", at: str = "epoch", value: str = "score") -> DataFrame:
    """Best score so far, epochs without a better one, whether to stop (least gain 0)."""
    w = W.partitionBy(run).orderBy(at)
    before = F.max(value).over(w.rowsBetween(W.unboundedPreceding, -1))
    own = scores.withColumn("improved", before.isNull() | (F.col(value) > before)).withColumn("best", F.max(value).over(w.rowsBetween(W.unboundedPreceding, 0)))
    own = own.withColumn("__k", F.row_number().over(w)).withColumn("__last", F.max(F.when(F.col("improved"), F.col("__k"))).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return own.withColumn("stale", (F.col("__k") - F.col("__last")).cast("int")).withColumn("stop", F.col("stale") >= patience).drop("__k", "__last")


def early_stopping_gain(scores: DataFrame, patience: int, gain: float, run: str = "run", at: str = "epoch", value: str = "score") -> DataFrame:
    """With a least gain: one pass over each run's ordered scores; a run's epochs meet in one task. (run, epoch, improved, best, stale, stop)"""

    def passed(rows: pd.DataFrame) -> pd.DataFrame:
        rows, best, stale, out = rows.sort_values(["a", "s"]), float("-inf"), 0, []
        for score in rows["s"]:
            better = score > best + gain
            best, stale = (score, 0) if better else (best, stale + 1)
            out.append((better, best, stale))
        improved, bests, stales = zip(*out, strict=True)
        return pd.DataFrame({run: rows["r"], at: rows["a"], "improved": improved, "best": bests, "stale": stales})

    own = scores.select(F.col(run).alias("r"), F.col(at).cast("long").alias("a"), F.col(value).cast("double").alias("s"))
    schema = T.StructType([T.StructField(run, own.schema["r"].dataType), T.StructField(at, T.LongType()), T.StructField("improved", T.BooleanType()), T.StructField("best", T.DoubleType()), T.StructField("stale", T.IntegerType())])
    return own.groupBy("r").applyInPandas(passed, schema).withColumn("stop", F.col("stale") >= patience)


def elapsed_hours(attempts: DataFrame, run: str = "run") -> DataFrame:
    """Largest total over attempts, else largest elapsed; negative values are counted as violations."""
    h = F.coalesce("elapsed_hours_total", "elapsed_hours")
    return attempts.groupBy(run).agg(F.max(h).alias("hours"), F.sum((h < 0).cast("long")).alias("negative"))


def moving_mean(series: DataFrame, window: int, key: str = "series", at: str = "at", value: str = "value") -> DataFrame:
    """Centred mean over an odd window; missing neighbours count as zero."""
    half = window // 2
    return series.withColumn("smooth", F.sum(value).over(W.partitionBy(key).orderBy(at).rowsBetween(-half, half)) / window)


def scaled(series: DataFrame, key: str = "series", value: str = "value", out: str = "scaled") -> DataFrame:
    """Min-max scale per series; constant series are 0."""
    bounds = series.groupBy(key).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    own = series.join(bounds, key)
    return own.withColumn(out, F.coalesce(F.try_divide(F.col(value) - F.col("__lo"), F.col("__hi") - F.col("__lo")), F.lit(0.0))).drop("__lo", "__hi")


def foreground_runs(series: DataFrame, share: float, gap: int, key: str = "series", at: str = "at", value: str = "value") -> DataFrame:
    """Runs of values above a share of the series' median positive value, with gaps of up to ``gap`` places closed: first, last, n."""
    level = series.where(F.col(value) > 0).groupBy(key).agg((F.percentile(value, F.lit(0.5)) * share).alias("__level"))
    high = series.join(level, key).where(F.col(value) > F.col("__level"))
    w = W.partitionBy(key).orderBy(at)
    own = high.withColumn("__new", F.when(F.col(at) - F.lag(at).over(w) <= gap + 1, 0).otherwise(1)).withColumn("__run", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return own.groupBy(key, "__run").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n")).drop("__run")


def best_runs(runs: DataFrame, least: int, key: str = "series") -> DataFrame:
    """The longest run of each series of at least ``least`` places, else the longest; ties go to the earlier."""
    length = F.col("last") - F.col("first") + 1
    return runs.groupBy(key).agg(F.min(F.struct((length < least).alias("short"), (-length).alias("l"), "first", "last")).alias("b")).select(key, "b.first", "b.last")


def edges(series: DataFrame, ratio: float, key: str = "series", at: str = "at", value: str = "value") -> DataFrame:
    """The last place where the value jumps by at least ``ratio`` of the series' largest jump."""
    w = W.partitionBy(key).orderBy(at)
    own = series.withColumn("jump", F.abs(F.col(value) - F.lag(value).over(w)))
    top = own.groupBy(key).agg(F.max("jump").alias("__top"))
    return own.join(top, key).where((F.col("__top") > 0) & (F.col("jump") >= ratio * F.col("__top"))).groupBy(key).agg(F.max(at).alias("edge"), F.count("*").alias("candidates"))


def spaced_candidates(series: DataFrame, most: int, spacing: int, key: str = "series", at: str = "at", value: str = "value") -> DataFrame:
    """Up to ``most`` places of the largest jumps at least ``spacing`` apart, best first. The cap is the feature: a short list for a person."""
    w = W.partitionBy(key).orderBy(at)
    own = series.withColumn("jump", F.abs(F.col(value) - F.lag(value).over(w))).where("jump IS NOT NULL")
    ordered = own.groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.col("jump")).alias("j"), F.col(at).cast("long").alias("a")))).alias("x"))
    none = F.expr("cast(array() as array<bigint>)")
    chosen = F.aggregate("x", none, lambda acc, e: F.when((F.size(acc) < most) & F.forall(acc, lambda c: F.abs(c - e["a"]) >= spacing), F.array_append(acc, e["a"])).otherwise(acc))
    return ordered.select(key, chosen.alias("candidates"))
