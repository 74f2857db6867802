"""Operating thresholds, calibration, fusion and pass/fail gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import vectors as V
from marlstone.functions.draws import running_sums
from marlstone.operators import metrics as M


def thresholds(df: DataFrame, floor: float, by: list[str] = []) -> DataFrame:  # noqa: B006
    """(positive, score) -> the threshold of largest (specificity, sensitivity, threshold) whose sensitivity reaches the floor.

    Candidates are 0, 0.5, 1 and all scores; none: 0.5, not met. Fit it on validation rows only."""
    counts = df.groupBy(*by, "score").agg(F.sum(F.col("positive").cast("long")).alias("p"), F.sum((~F.col("positive")).cast("long")).alias("q"))
    groups = df.select(*by).distinct() if by else df.sparkSession.range(1).select()
    fixed = groups.select(*by, F.explode(F.array(F.lit(0.0), F.lit(0.5), F.lit(1.0))).alias("score"), F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("q"))
    own = counts.unionByName(fixed).groupBy(*by, "score").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    own = running_sums(own, by, "score", F.floor(F.col("score") * M.SCORE_BUCKETS), ["p", "q"])
    totals = own.groupBy(*by).agg(F.sum("p").alias("tp"), F.sum("q").alias("tq"))
    joined = own.join(totals, by) if by else own.crossJoin(F.broadcast(totals))  # one row
    sens, spec = F.try_divide(F.col("tp") - F.col("before_p"), F.col("tp")), F.try_divide(F.col("before_q"), F.col("tq"))
    best = joined.groupBy(*by).agg(F.max(F.when(sens >= floor, F.struct(spec.alias("specificity"), sens.alias("sensitivity"), F.col("score").alias("threshold")))).alias("b"))
    met = F.col("b").isNotNull()
    return best.select(*by, F.coalesce("b.threshold", F.lit(0.5)).alias("threshold"), F.coalesce("b.sensitivity", F.lit(0.0)).alias("sensitivity"), F.coalesce("b.specificity", F.lit(0.0)).alias("specificity"), met.alias("met"))


def tempered_score(score: Column, temperature: Column) -> Column:
    """The positive probability after temperature scaling."""
    return F.element_at(V.tempered(F.array(1 - score, score), temperature), 2)


def _nll(df: DataFrame, score: Column, by: list[str], name: str) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(-F.log(F.greatest(F.when(F.col("positive"), score).otherwise(1 - score), F.lit(1e-12)))).alias(name))


def fit_temperature(df: DataFrame, grid: list[float], by: list[str] = []) -> DataFrame:  # noqa: B006
    """The grid's temperature of least negative log likelihood; 1 if none is better. All of the grid is one aggregation."""
    each = df.withColumn("temperature", F.explode(F.array(*(F.lit(float(t)) for t in grid))))
    losses = _nll(each, tempered_score(F.col("score"), F.col("temperature")), [*by, "temperature"], "nll")
    best = losses.groupBy(*by).agg(F.min(F.struct(F.round("nll", 9).alias("nll"), "temperature")).alias("b"))
    before = _nll(df, F.col("score"), by, "before")
    own = best.join(before, by) if by else best.crossJoin(F.broadcast(before))
    better = F.col("b.nll") <= F.col("before") + 1e-12
    return own.select(*by, F.when(better, F.col("b.temperature")).otherwise(1.0).alias("temperature"), "before", F.when(better, F.col("b.nll")).otherwise(F.col("before")).alias("after"))


def log_grid(low: float = 0.05, high: float = 20.0, n: int = 25) -> list[float]:
    return [low * (high / low) ** (k / (n - 1)) for k in range(n)]


def refined_temperature(df: DataFrame, rounds: int = 3) -> DataFrame:
    """A grid over [0.05, 20], then finer ones around the best; each round brings one row to the driver."""
    low, high = 0.05, 20.0
    for _ in range(rounds):
        found = fit_temperature(df, log_grid(low, high))
        t, step = found.first().temperature, (high / low) ** (1 / 24)
        low, high = max(0.05, t / step), min(20.0, t * step)
    return found


def calibrated_predictions(test: DataFrame, validation: DataFrame, floor: float, grid: list[float]) -> DataFrame:
    """Per fold: temperature from validation rows, then the threshold on their calibrated scores; applied to the fold's test rows."""
    temps = fit_temperature(validation, grid, ["outer_fold"]).select("outer_fold", "temperature")
    scaled = lambda df: df.join(F.broadcast(temps), "outer_fold").withColumn("score", F.round(tempered_score(F.col("score"), F.col("temperature")), 9))
    cut = thresholds(scaled(validation), floor, ["outer_fold"]).select("outer_fold", "threshold")
    own = scaled(test).join(F.broadcast(cut), "outer_fold")
    return own.withColumn("predicted", F.col("score") >= F.col("threshold"))


def gate_table(values: DataFrame, bounds: list[tuple[str, str, float]]) -> DataFrame:
    """values (metric, value) against bounds (metric, '>=' or '<=', bound) -> gate, value, bound, passed; a missing value fails."""
    wanted = values.sparkSession.createDataFrame([(n, s, float(b)) for n, s, b in bounds], "gate string, sign string, bound double")
    own = F.broadcast(wanted).join(values, F.col("gate") == F.col("metric"), "left")
    ok = F.when(F.col("sign") == ">=", F.col("value") >= F.col("bound")).otherwise(F.col("value") <= F.col("bound"))
    return own.select("gate", "value", "bound", F.coalesce(ok, F.lit(False)).alias("passed"))


def shortcut_risk(macro_f1: Column, p_value: Column, strong: float = 0.6, weak: float = 0.4, alpha: float = 0.05) -> Column:
    return F.when((p_value <= alpha) & (macro_f1 >= strong), "high").when((p_value <= alpha) & (macro_f1 >= weak), "moderate").otherwise("low")


def fused(a: DataFrame, b: DataFrame, dropped: int, weight: float) -> DataFrame:
    """Two aligned tables without one class: person_key, outer_fold, reference_id (shifted), three probability vectors."""
    right = b.select("person_key", F.col("probs").alias("__b"))
    own = a.where(F.col("reference_id") != dropped).join(right, "person_key")
    ref = F.when(F.col("reference_id") > dropped, F.col("reference_id") - 1).otherwise(F.col("reference_id"))
    made = own.select("person_key", "outer_fold", ref.alias("reference_id"), V.without_place(F.col("probs"), dropped).alias("a_probs"), V.without_place(F.col("__b"), dropped).alias("b_probs"))
    return made.withColumn("probs", V.blended(F.col("a_probs"), F.col("b_probs"), weight))


def complementarity(df: DataFrame) -> DataFrame:
    """df (outer_fold, reference_id, a_probs, b_probs): errors of each, rescued by the other, folds and classes of rescues."""
    a, b, ref = V.argmax(F.col("a_probs")), V.argmax(F.col("b_probs")), F.col("reference_id")
    own = df.select("outer_fold", "reference_id", (a != ref).alias("aw"), (b != ref).alias("bw"))
    n = lambda c: F.sum(c.cast("long"))
    aw, bw = F.col("aw"), F.col("bw")
    made = own.agg(
        n(aw).alias("a_errors"), n(aw & ~bw).alias("rescued_by_b"), n(bw).alias("b_errors"), n(bw & ~aw).alias("rescued_by_a"), n(aw & bw).alias("both_wrong"), n(~aw & ~bw).alias("both_right"),
        F.array_sort(F.collect_set(F.when(aw & ~bw, F.col("outer_fold")))).alias("folds"), F.array_sort(F.collect_set(F.when(aw & ~bw, F.col("reference_id")))).alias("classes"),
    )
    return made.withColumn("rescue_fraction", F.coalesce(F.try_divide(F.col("rescued_by_b"), F.col("a_errors")), F.lit(0.0)))


def decision(gates: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Gates of two kinds, 'blend' and 'rescue': advance if all of either kind pass."""
    mapping = F.create_map(*(F.lit(x) for kv in kinds.items() for x in kv))
    own = gates.groupBy(F.element_at(mapping, F.col("gate")).alias("kind")).agg(F.min("passed").alias("ok"))
    return own.agg(F.max(F.when(F.col("kind") == "blend", F.col("ok"))).alias("blend_passed"), F.max(F.when(F.col("kind") == "rescue", F.col("ok"))).alias("rescue_passed"), F.when(F.max("ok"), "advance").otherwise("stop").alias("decision"))


def interpretations(verdicts: DataFrame) -> DataFrame:
    """verdicts (group, shift, error, association booleans) -> the names that hold."""
    names = F.array_compact(F.array(F.when(F.col("shift") & F.col("error"), "shift_with_errors"), F.when(F.col("shift") & ~F.col("error"), "shift_only"), F.when(~F.col("shift") & F.col("error"), "errors_only"), F.when(F.col("association"), "associated")))
    return verdicts.select("group", F.when(F.size(names) > 0, F.array_join(names, ";")).otherwise("none").alias("interpretation"))
