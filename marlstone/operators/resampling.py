"""Bootstrap, permutation and shift tests with hash draws.

Class metrics are resampled from the few cells of a matrix: a replicate draws a class's cell counts at once, from the
multinomial distribution that drawing its rows with replacement gives, so the work grows with replicates times cells and not
with rows. Score metrics need a weight per replicate and row: a row carries all of its weights as one value. Both kinds of
draws are made by ``operators/dealing.py``."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.functions.draws import draw, hash_rank, running_sums
from marlstone.operators import metrics as M
from marlstone.operators.dealing import CODED, PIECE, decoded, in_pieces, mixed, resampled_cells, with_draws, with_weights
from marlstone.operators.quantiles import placed, quantile
from marlstone.sources.tables import written

#: Replicates at a time; most pieces that the scores of a group are cut into.
BLOCK, EDGES = 250, 4096


def interval(values: DataFrame, observed: DataFrame | None = None, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Linear 2.5 and 97.5 percentiles of ``value`` over replicates."""
    own = values.groupBy(*by).agg(F.percentile("value", F.lit(0.025)).alias("low"), F.percentile("value", F.lit(0.975)).alias("high"), F.count("value").alias("replicates"))
    if observed is None:
        return own
    return own.join(observed, by) if by else own.crossJoin(F.broadcast(observed))  # one row each


def macro_f1(matrix: DataFrame, k: int, by: list[str]) -> DataFrame:
    """by, value from (by, reference_id, predicted_id, n)."""
    return M.per_class(matrix, k, by).groupBy(*by).agg(F.avg("f1").alias("value"))


def bootstrap_macro_f1(predictions: DataFrame, k: int, replicates: int, seed: int) -> DataFrame:
    """low, observed, high of macro-F1, resampling people inside their class."""
    matrix = M.confusion(predictions, k)
    drawn = resampled_cells(matrix.withColumn("cell", F.struct("reference_id", "predicted_id")), "reference_id", replicates, seed)
    values = macro_f1(drawn.select("replicate", "cell.*", "n"), k, ["replicate"])
    observed = macro_f1(matrix, k, []).select(F.col("value").alias("observed"))
    return interval(values, observed)


def paired_macro_f1(a: DataFrame, b: DataFrame, k: int, replicates: int, seed: int) -> DataFrame:
    """The difference b - a on the same people: observed, low, high, share of replicates above zero."""
    own = M.with_predicted(a).select("person_key", "reference_id", F.col("predicted_id").alias("pa")).join(M.with_predicted(b).select("person_key", F.col("predicted_id").alias("pb")), "person_key")
    cells = own.groupBy("reference_id", "pa", "pb").agg(F.count("*").alias("n"))
    drawn = resampled_cells(cells.withColumn("cell", F.struct("reference_id", "pa", "pb")), "reference_id", replicates, seed).select("replicate", "cell.*", "n")

    def delta(df: DataFrame, by: list[str]) -> DataFrame:
        f1 = lambda p, n: macro_f1(df.select(*by, "reference_id", F.col(p).alias("predicted_id"), "n"), k, by).withColumnRenamed("value", n)
        both = f1("pa", "fa").join(f1("pb", "fb"), by) if by else f1("pa", "fa").crossJoin(F.broadcast(f1("pb", "fb")))
        return both.select(*by, (F.col("fb") - F.col("fa")).alias("value"))

    values = delta(drawn, ["replicate"])
    share = values.agg(F.avg((F.col("value") > 0).cast("double")).alias("share_above"))
    return interval(values, delta(cells, []).select(F.col("value").alias("observed"))).crossJoin(F.broadcast(share))


def _weights_in(df: DataFrame) -> str:
    """The column that holds the weights of rows: ``draws`` (coded) or ``weights``."""
    return "draws" if "draws" in df.columns else "weights"


def _matrix(weights: pd.Series) -> np.ndarray:
    return decoded(weights) if weights.name == "draws" else np.frombuffer(b"".join(weights), dtype="<u2").reshape(len(weights), -1)


def _slices(batches):
    """Batches in slices of ``CODED`` rows, as a row's weights of all replicates are much larger than the row."""
    for batch in batches:
        for at in range(0, len(batch), CODED):
            yield batch.iloc[at : at + CODED]


def _placed_in_pieces(df: DataFrame, by: list[str]) -> DataFrame:
    """Adds ``piece`` and ``part`` to rows (by, score, ...), and leaves ``score``.

    Only scores are counted and sorted for it. The pieces' least scores, at most about ``EDGES`` for each group, go to the tasks, so
    rows aren't moved before they are in their pieces."""
    counts = df.groupBy(*by, "score").agg(F.count("*").alias("n"))
    most = counts.groupBy(*by).agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0
    size = max(PIECE, most // EDGES + 1)
    placed = running_sums(counts, by, "score", F.floor(F.col("score") * M.SCORE_BUCKETS), ["n"])
    hot = F.col("n") > size
    placed = placed.select(*by, "score", (F.floor(F.col("before_n") / size) * 2 + hot.cast("long")).alias("piece"), F.when(hot, F.ceil(F.col("n") / size)).otherwise(1).cast("long").alias("parts"))
    edges: dict[tuple, list] = {}
    for r in placed.groupBy(*by, "piece").agg(F.min("score").alias("least"), F.max("parts").alias("parts")).collect():
        edges.setdefault(tuple(r[c] for c in by), []).append((r.least, r.piece, r.parts))
    edges = {k: tuple(np.array(x) for x in zip(*sorted(v), strict=True)) for k, v in edges.items()}

    def run(batches):
        for n, batch in enumerate(batches):
            for key, rows in batch.groupby(by, sort=False) if by else [((), batch)]:
                least, piece, parts = edges[tuple(x.item() if isinstance(x, np.generic) else x for x in key)]
                at = np.searchsorted(least, rows["score"].to_numpy(), side="right") - 1
                yield rows.assign(piece=piece[at], part=(np.arange(len(rows)) + n) % parts[at])

    return df.mapInPandas(run, T.StructType([*df.schema, T.StructField("piece", T.LongType()), T.StructField("part", T.LongType())]))


def weighted_auc(df: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """(by, score, positive, weights or draws) -> (by, replicate, value): the mid-rank AUC of each replicate; null where one kind isn't drawn.

    Scores are cut into pieces of about ``PIECE`` rows in order; a score with more rows is a piece by itself, whose rows are
    dealt over several groups, as only their sums count. Pieces give three numbers a replicate. Weights move once, into their pieces."""
    keys, name = [*by, "piece", "part"], _weights_in(df)
    own = _placed_in_pieces(df.select(*by, "score", "positive", name), by)

    def summed(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("score")
        score, positive, weights = rows["score"].to_numpy(), rows["positive"].to_numpy(dtype=bool)[:, None], _matrix(rows[name])
        starts, out = np.flatnonzero(np.r_[True, score[1:] != score[:-1]]), []
        for k in range(0, weights.shape[1], BLOCK):
            w = weights[:, k : k + BLOCK].astype(np.int64)
            p, q = (np.add.reduceat(w * side, starts, axis=0) for side in (positive, ~positive))
            out.append((p.sum(0), q.sum(0), (p * (np.cumsum(q, axis=0) - q + q / 2)).sum(0)))
        p, q, won = (np.concatenate(x) for x in zip(*out, strict=True))
        return pd.DataFrame([{**{c: rows[c].iloc[0] for c in keys}, "p": p, "q": q, "won": won}])

    fields = [T.StructField(c, own.schema[c].dataType) for c in keys]
    schema = T.StructType([*fields, *(T.StructField(n, T.ArrayType(t)) for n, t in (("p", T.LongType()), ("q", T.LongType()), ("won", T.DoubleType())))])
    parts = own.groupBy(keys).applyInPandas(summed, schema).select(*by, "piece", F.posexplode(F.arrays_zip("p", "q", "won")).alias("replicate", "x"))
    pieces = parts.groupBy(*by, "piece", "replicate").agg(*(F.sum(f"x.{c}").alias(c) for c in ("p", "q", "won")))
    pieces = pieces.withColumn("won", F.when(F.col("piece") % 2 == 1, F.col("p") * F.col("q") / 2).otherwise(F.col("won")))
    below = F.sum("q").over(W.partitionBy(*by, "replicate").orderBy("piece").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("q")
    won = pieces.withColumn("won", F.col("won") + F.col("p") * below)
    return won.groupBy(*by, "replicate").agg(F.try_divide(F.sum("won"), F.sum("p").cast("double") * F.sum("q")).alias("value"))


def weighted_macro_auc(df: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """(by, reference_id, probs, weights or draws) -> (by, replicate, value): the mean of the one-vs-rest AUCs that can be told."""
    each = df.select(*by, "reference_id", _weights_in(df), F.posexplode("probs").alias("class_id", "score"))
    own = weighted_auc(each.select(*by, "class_id", "score", (F.col("reference_id") == F.col("class_id")).alias("positive"), _weights_in(df)), [*by, "class_id"])
    return own.groupBy(*by, "replicate").agg(F.avg("value").alias("value"))


def weighted_mean(df: DataFrame, column: str) -> DataFrame:
    """(replicate, value): the mean of a column of numbers in each replicate; its null rows are left out."""
    name = _weights_in(df)

    def summed(batches):
        total = None
        for batch in _slices(batches):
            if len(batch):
                w = _matrix(batch[name]).astype(np.float64)
                own = np.stack([batch[column].to_numpy(dtype=float) @ w, w.sum(0)])
                total = own if total is None else total + own
        if total is not None:
            yield pd.DataFrame({"replicate": np.arange(total.shape[1]), "s": total[0], "n": total[1]})

    own = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias(column), name)
    return own.mapInPandas(summed, "replicate int, s double, n double").groupBy("replicate").agg(F.try_divide(F.sum("s"), F.sum("n")).alias("value"))


def bootstrap(df: DataFrame, strata: list[str], key: str, replicates: int, seed: int, statistic, observed: DataFrame | None = None) -> DataFrame:
    """Interval of any statistic, resampling inside strata; replicates that can't be estimated are left out.

    ``statistic``: rows with ``draws`` -> (replicate, value)."""
    return interval(statistic(with_draws(df, strata, key, replicates, seed)).where("value IS NOT NULL"), observed)


def bootstrap_auc(df: DataFrame, replicates: int, seed: int, strata: list[str] = ["positive"]) -> DataFrame:  # noqa: B006
    """Interval of the AUC of (person_key, positive, score)."""
    observed = M.auc_of(M.score_counts(df, F.col("score"), F.col("positive"))).select(F.col("auc").alias("observed"))
    return bootstrap(df, strata, "person_key", replicates, seed, weighted_auc, observed)


def bootstrap_macro_auc(predictions: DataFrame, k: int, replicates: int, seed: int, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Interval of the macro one-vs-rest AUC, resampling people inside their class.

    With ``by``, one interval each of several predictions of the same people, for which people are drawn once."""
    observed = M.one_vs_rest(predictions, k, by).groupBy(*by).agg(F.avg("auc").alias("observed"))
    if not by:
        return bootstrap(predictions.select("person_key", "reference_id", "probs"), ["reference_id"], "person_key", replicates, seed, weighted_macro_auc, observed)
    people = predictions.groupBy("person_key", "reference_id").agg(F.collect_list(F.struct(*by, "probs")).alias("each"))
    drawn = with_draws(people, ["reference_id"], "person_key", replicates, seed)
    values = weighted_macro_auc(drawn.select("reference_id", "draws", F.explode("each").alias("x")).select("reference_id", "draws", "x.*"), by)
    return interval(values.where("value IS NOT NULL"), observed, by)


def permuted(df: DataFrame, stratum: str, key: str, target: str, seed: int) -> DataFrame:
    """``permuted``: the targets of a stratum dealt out anew, its counts kept."""
    order = hash_rank(df.withColumn("__h", F.sha2(F.col(key).cast("string"), 256)), [stratum], "__h", "__k").drop("__h")
    other = hash_rank(df.select(stratum, key, F.col(target).alias("permuted")).withColumn("__h", draw(seed, F.lit("permute"), key)), [stratum], "__h", "__k").select(F.col(stratum).alias("__s"), "__k", "permuted")
    return order.join(other, (order[stratum] == other["__s"]) & (order["__k"] == other["__k"])).drop("__k", "__s")


def benjamini_hochberg(tests: DataFrame, p: str = "p") -> DataFrame:
    """Adds ``q``; one row per test, so one window is enough."""
    order = W.partitionBy(F.lit(0)).orderBy(p)
    n = F.count("*").over(W.partitionBy(F.lit(0)))
    own = tests.withColumn("__r", F.row_number().over(order)).withColumn("__a", F.col(p) * n / F.col("__r"))
    later = W.partitionBy(F.lit(0)).orderBy(F.desc("__r")).rowsBetween(W.unboundedPreceding, 0)
    return own.withColumn("q", F.least(F.min("__a").over(later), F.lit(1.0))).drop("__r", "__a")


def smd(mean_a: Column, var_a: Column, mean_b: Column, var_b: Column) -> Column:
    """Absolute difference over the pooled population deviation; 0/0 is 0, x/0 infinite."""
    pooled, apart = F.sqrt((var_a + var_b) / 2), F.abs(mean_a - mean_b)
    return F.when(pooled > 0, apart / pooled).when(apart == 0, 0.0).otherwise(F.lit(float("inf")))


def mean_differences(long: DataFrame, folds: list[int]) -> DataFrame:
    """long (feature, outer_fold, value) -> (feature, fold, fold_mean, rest_mean, abs_smd); moments of the rest are put together from those of the other folds."""
    own = long.where("value IS NOT NULL").groupBy("feature", "outer_fold").agg(F.count("*").cast("double").alias("n"), F.avg("value").alias("mean"), F.var_pop("value").alias("var"))
    each = own.groupBy("feature").agg(F.collect_list(F.struct("outer_fold", "n", "mean", "var")).alias("m")).select("feature", "m", F.explode(F.array(*(F.lit(f) for f in folds))).alias("fold"))

    def moments(name: str, of) -> list[Column]:
        own, total = F.filter("m", of), lambda f: F.aggregate(F.filter("m", of), F.lit(0.0), lambda a, x: a + f(x))
        n = total(lambda x: x["n"])
        mean = total(lambda x: x["n"] * x["mean"]) / n
        apart = total(lambda x: x["n"] * (x["var"] + (x["mean"] - mean) * (x["mean"] - mean))) / n
        known = F.size(own) > 0
        return [F.when(known, mean).alias(f"{name}_mean"), F.when(known, apart).alias(f"__{name}_var")]

    found = each.select("feature", "fold", *moments("fold", lambda x: x["outer_fold"] == F.col("fold")), *moments("rest", lambda x: x["outer_fold"] != F.col("fold")))
    return found.select("feature", "fold", "fold_mean", "rest_mean", smd(F.col("fold_mean"), F.col("__fold_var"), F.col("rest_mean"), F.col("__rest_var")).alias("abs_smd"))


def fold_shifts(long: DataFrame, folds: list[int]) -> DataFrame:
    """long (feature, outer_fold, value) -> per feature and fold: means and quartiles inside and in the rest, SMD, two-sample KS and its p.

    One row per distinct value carries its counts in all folds; running counts over buckets of values give the exact
    quartiles and distances of every fold and rest, so no feature or fold meets in one task."""
    own = long.where("value IS NOT NULL")
    names = {f: f"n_{f}" for f in folds}
    counts = own.groupBy("feature", "value").agg(*(F.sum((F.col("outer_fold") == f).cast("long")).alias(n) for f, n in names.items()))
    found = written(placed(counts, ["feature"], "value", list(names.values())), "placed")
    totals = found.groupBy("feature").agg(*(F.sum(n).alias(f"total_{n}") for n in names.values()))
    plus = lambda cs: sum(cs, F.lit(0).cast("long"))
    stats = []
    for f, name in names.items():
        sides, parts = {"fold": [name], "rest": [n for n in names.values() if n != name]}, [F.lit(f).alias("fold")]
        n, before, total = ({side: plus([F.col(prefix + c) for c in cs]) for side, cs in sides.items()} for prefix in ("", "before_", "total_"))
        for side in sides:
            parts += [quantile(F.col("value"), before[side], n[side], total[side], q).alias(f"{side}_{label}") for label, q in (("median", 0.5), ("q25", 0.25), ("q75", 0.75))]
        share = {side: F.try_divide((before[side] + n[side]).cast("double"), total[side]) for side in sides}
        parts += [F.max(F.abs(share["fold"] - share["rest"])).alias("ks"), F.max(total["fold"]).alias("__fold_n"), F.max(total["rest"]).alias("__rest_n")]
        stats.append(F.struct(*parts))
    each = found.join(totals, "feature").groupBy("feature").agg(F.array(*stats).alias("s")).select("feature", F.explode("s").alias("s")).select("feature", "s.*")
    joined = mean_differences(own, folds).join(each, ["feature", "fold"])
    return joined.withColumn("p", ks_p_value(F.col("ks"), F.col("__fold_n"), F.col("__rest_n"))).drop("__fold_n", "__rest_n")


def ks_p_value(d: Column, n: Column, m: Column, terms: int = 20) -> Column:
    """The asymptotic two-sided p-value."""
    x = d * F.sqrt(n * m / (n + m))
    total = F.lit(0.0)
    for k in range(1, terms + 1):
        total = total + F.lit(2.0 * (-1) ** (k - 1)) * F.exp(F.lit(-2.0 * k * k) * x * x)
    return F.when(x < 0.2, 1.0).otherwise(F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)))


def shift_summary(shifts: DataFrame, large: float, broad: float, fraction: float, alpha: float) -> DataFrame:
    """Flags after one BH family, and the verdict of the group."""
    own = benjamini_hochberg(shifts).withColumn("large", (F.col("abs_smd") >= large) & (F.col("q") <= alpha)).withColumn("moderate", (F.col("abs_smd") >= broad) & (F.col("q") <= alpha))
    return own.agg(F.count("*").alias("tests"), F.sum(F.col("large").cast("long")).alias("large_shifts"), F.sum(F.col("moderate").cast("long")).alias("moderate_shifts"), (F.avg(F.col("moderate").cast("double")) >= fraction).alias("broad_shift"))


def spearman(df: DataFrame, a: str, b: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Correlation of mid-ranks; ranks come from counts per distinct value."""
    own = with_ranks(with_ranks(df, a, "__ra", by), b, "__rb", by)
    return own.groupBy(*by).agg(F.corr("__ra", "__rb").alias("rho"), F.count("*").alias("n"))


def with_ranks(df: DataFrame, column: str, name: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Adds the mid-rank of a column in its group."""
    own = placed(df.groupBy(*by, column).agg(F.count("*").alias("__n")), by, column, ["__n"])
    return df.join(own.select(*by, column, (F.col("before___n") + (F.col("__n") + 1) / 2).alias(name)), [*by, column])


def permuted_correlations(df: DataFrame, a: str, b: str, strata: list[str], key: str, permutations: int, seed: int) -> DataFrame:
    """(replicate, value): correlations of two columns of numbers with ``b`` permuted inside strata, by an order of hashed bits.

    A stratum of more than ``PIECE`` rows is cut into random pieces, and rows are permuted inside a piece: such orders are as
    likely as any other if nothing but the stratum matters."""
    ranked = in_pieces(df.select(*strata, key, a, b), strata, key, seed)
    moments = ranked.agg(F.avg(a).alias("ma"), F.avg(b).alias("mb"), (F.stddev_pop(a) * F.stddev_pop(b) * F.count("*")).alias("scale")).first()

    def summed(rows: pd.DataFrame) -> pd.DataFrame:
        rows, m = rows.sort_values("__rank"), len(rows)
        x, y = rows[a].to_numpy(dtype=float) - moments.ma, rows[b].to_numpy(dtype=float) - moments.mb
        counters = (np.arange(permutations, dtype=np.int64)[:, None] << 32) + np.arange(1, m + 1)
        order = np.argsort(mixed(f"{seed}|{rows['__s'].iloc[0]}|{rows['__piece'].iloc[0]}|order", counters), axis=1, kind="stable")
        return pd.DataFrame({"replicate": np.arange(permutations), "s": (x * y[order]).sum(1)})

    sums = ranked.groupBy("__s", "__piece").applyInPandas(summed, "replicate int, s double")
    return sums.groupBy("replicate").agg(F.try_divide(F.sum("s"), F.lit(moments.scale)).alias("value"))


def _in_score_pieces(df: DataFrame, score: str) -> DataFrame:
    """Adds ``__piece`` (neighbouring scores of about ``PIECE`` rows, even; one score with more, odd) and ``__part`` of it."""
    own = placed(df.groupBy(score).agg(F.count("*").alias("__n")), [], score, ["__n"])
    hot = F.col("__n") > PIECE
    own = own.select(score, (F.floor(F.col("before___n") / PIECE) * 2 + hot.cast("long")).alias("__piece"), F.when(hot, F.ceil(F.col("__n") / PIECE)).otherwise(1).cast("long").alias("__parts"))
    return written(df.join(own, score).withColumn("__part", F.pmod(F.xxhash64(_weights_in(df)), "__parts")).drop("__parts"), "pieces")


def weighted_ranks(df: DataFrame, score: str, name: str) -> DataFrame:
    """Rows with ``weights`` or ``draws`` get ``name``: twice their mid-rank among a replicate's rows, a whole number, for each replicate (binary, 32 bits).

    Pieces of neighbouring scores give one total a replicate; what lies below a piece is a running sum over pieces."""
    own = _in_score_pieces(df, score)
    keys, weights = ["__piece", "__part"], _weights_in(df)

    def weighed(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"__piece": rows["__piece"].iloc[0], "w": _matrix(rows[weights]).sum(0, dtype=np.int64)}])

    parts = own.select(*keys, weights).groupBy(keys).applyInPandas(weighed, "__piece long, w array<long>").select("__piece", F.posexplode("w").alias("replicate", "w"))
    totals = parts.groupBy("__piece", "replicate").agg(F.sum("w").alias("w"))
    below = totals.withColumn("below", F.sum("w").over(W.partitionBy("replicate").orderBy("__piece").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("w"))
    lists = below.groupBy("__piece").agg(F.array_sort(F.collect_list(F.struct("replicate", "below", "w"))).alias("b"))
    lists = written(own.select(keys).distinct().join(lists, "__piece").select(*keys, F.col("b.below").alias("below"), F.col("b.w").alias("w")), "below")
    columns = [c for c in own.columns if c not in keys]

    def ranked(rows: pd.DataFrame, base: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(score)
        below, total = np.asarray(base["below"].iloc[0], dtype=np.float64), np.asarray(base["w"].iloc[0], dtype=np.float64)
        if rows["__piece"].iloc[0] % 2:
            ranks = np.broadcast_to(below + (total + 1) / 2, (len(rows), len(below)))
        else:
            value = rows[score].to_numpy()
            starts = np.flatnonzero(np.r_[True, value[1:] != value[:-1]])
            same = np.add.reduceat(_matrix(rows[weights]).astype(np.float64), starts, axis=0)
            ranks = np.repeat(below + np.cumsum(same, axis=0) - same + (same + 1) / 2, np.diff(np.r_[starts, len(value)]), axis=0)
        return rows[columns].assign(**{name: [(2 * r).astype("<i4").tobytes() for r in ranks]})

    schema = T.StructType([*(own.schema[c] for c in columns), T.StructField(name, T.BinaryType())])
    return own.groupBy(keys).cogroup(lists.groupBy(keys)).applyInPandas(ranked, schema)


def weighted_spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """(replicate, value): the rank correlation of each replicate of rows with ``weights`` or ``draws``; ranks are those among its own rows."""
    weights = _weights_in(df)
    own = weighted_ranks(weighted_ranks(df.select(a, b, weights), a, "__ra"), b, "__rb")

    def summed(batches):
        total = None
        for batch in _slices(batches):
            if len(batch):
                w, x, y = _matrix(batch[weights]).astype(np.float64), *(np.frombuffer(b"".join(batch[c]), dtype="<i4").reshape(len(batch), -1) / 2 for c in ("__ra", "__rb"))
                part = np.stack([w.sum(0), (w * x).sum(0), (w * y).sum(0), (w * x * y).sum(0), (w * x * x).sum(0), (w * y * y).sum(0)])
                total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame(dict(zip(["n", "x", "y", "xy", "xx", "yy"], total, strict=True))).assign(replicate=np.arange(total.shape[1]))

    sums = own.select(weights, "__ra", "__rb").mapInPandas(summed, "n double, x double, y double, xy double, xx double, yy double, replicate int")
    own = sums.groupBy("replicate").agg(*(F.sum(c).alias(c) for c in ("n", "x", "y", "xy", "xx", "yy")))
    n, apart = F.col("n"), lambda c, d: F.col(c) * F.col("n") - F.col(d[0]) * F.col(d[1])
    return own.where(n > 0).select("replicate", F.try_divide(apart("xy", "xy"), F.sqrt(apart("xx", "xx") * apart("yy", "yy"))).alias("value"))


def rank_association(df: DataFrame, a: str, b: str, strata: list[str], key: str, permutations: int, replicates: int, seed: int, least_rho: float = 0.2, least_folds: int = 3, alpha: float = 0.05) -> DataFrame:
    """One row on the rank correlation of two scores of (key, outer_fold, strata, a, b): rho, its interval over resampled people,
    rho of each fold, the two-sided permutation p inside strata, how many folds have its direction, and the verdict."""
    own = written(with_ranks(with_ranks(df, a, "__ra"), b, "__rb"), "ranks")
    whole = own.agg(F.corr("__ra", "__rb").alias("rho"), F.count("*").alias("n"))
    null = permuted_correlations(own, "__ra", "__rb", strata, key, permutations, seed)
    exceed = null.crossJoin(F.broadcast(whole)).agg(F.sum((F.abs("value") >= F.abs("rho")).cast("long")).alias("exceed"), F.count("value").alias("permutations"))  # one row
    weights = with_draws(df.select(*{key: 0, a: 0, b: 0, **dict.fromkeys(strata)}), strata, key, replicates, seed)
    limits = weighted_spearman(weights, a, b).agg(*(F.percentile("value", F.lit(q)).alias(n) for n, q in (("rho_low", 0.025), ("rho_median", 0.5), ("rho_high", 0.975))))
    folds = spearman(df, a, b, ["outer_fold"]).agg(F.array_sort(F.collect_list(F.struct("outer_fold", "rho"))).alias("f"))
    found = whole.crossJoin(F.broadcast(exceed)).crossJoin(F.broadcast(limits)).crossJoin(F.broadcast(folds))  # one row each
    found = found.withColumn("p", (F.col("exceed") + 1) / (F.col("permutations") + 1)).withColumn("fold_rho", F.transform("f", lambda x: x["rho"]))
    same = F.size(F.filter("fold_rho", lambda x: F.signum(x) == F.signum("rho")))
    found = found.withColumn("same_direction_folds", same)
    passed = (F.abs("rho") >= least_rho) & ((F.col("rho_low") > 0) | (F.col("rho_high") < 0)) & (F.col("p") <= alpha) & (F.col("same_direction_folds") >= least_folds)
    return found.withColumn("passed", passed).select("rho", "n", "rho_low", "rho_median", "rho_high", "fold_rho", "p", "permutations", "same_direction_folds", "passed")
