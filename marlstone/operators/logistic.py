"""Logistic regressions of many targets and all folds at once, by Newton steps.

A row carries its features, a byte per target column (its class; ``ABSENT`` where the row isn't in that column) and a byte per
split (its fold). A model belongs to a column and a held-out fold: median imputation, scaling by the population deviation,
balanced class weights and an L2 penalty of 1 / (2 c), all from the other folds' rows of that column. Two classes have one logit,
more have one each, as is usual.

A step is one aggregation of the rows: each task adds up loss, gradient and Hessian of every model that isn't settled, the sums
come together by model, and the driver solves one small system a model. So 100 permutations of five folds cost as many passes over
the rows as the slowest of the 500 fits needs, and what reaches the driver depends on models and features, never on rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.operators.quantiles import exact_quantiles

#: The byte of a column or split that a row isn't in; rows handled at a time; a model is settled when its next step gains less.
ABSENT, ROWS, LEAST_GAIN = 255, 1024, 1e-10
#: Numbers of a step's largest table; scores that a task sorts at a time; scores of a bucket, and rows that place its edges.
CELLS, SORTED, BUCKET, PLACING = 1 << 21, 1 << 23, 1 << 17, 64


@dataclass
class Models:
    """Fits of every column and fold; arrays are by split or column, fold, then feature."""

    classes: int
    split_of: np.ndarray
    fill: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    theta: np.ndarray
    shared: Shared | None = None

    @property
    def folds(self) -> int:
        return self.fill.shape[1]

    def design(self, x: np.ndarray, split: int, fold: int) -> np.ndarray:
        z = (np.where(np.isnan(x), self.fill[split, fold], x) - self.centre[split, fold]) / self.scale[split, fold]
        return np.hstack([z, np.ones((len(z), 1))])

    def probabilities(self, z: np.ndarray, columns: np.ndarray, fold: int) -> np.ndarray:
        """(rows, columns, classes)"""
        theta = self.theta[columns, fold]
        free = theta.shape[1]
        logits = (z @ theta.reshape(-1, z.shape[1]).T).reshape(len(z), len(columns), free)
        if free < self.classes:
            logits = np.concatenate([np.zeros((len(z), len(columns), 1)), logits], axis=2)
        e = np.exp(logits - logits.max(axis=2, keepdims=True))
        return e / e.sum(axis=2, keepdims=True)


def byte(column: Column) -> Column:
    """A small whole number as one byte; null as ``ABSENT``."""
    return F.coalesce(F.unhex(F.lpad(F.hex(column.cast("long")), 2, "0")), F.lit(bytes([ABSENT])))


def packed(df: DataFrame, features: list[str], targets: Column, folds: Column, keep: list[str]) -> DataFrame:
    """``keep`` with ``__x`` (features in order), ``__y`` (a byte a column) and ``__f`` (a byte a split)."""
    return df.select(*keep, F.array(*(F.col(c).cast("double") for c in features)).alias("__x"), targets.alias("__y"), folds.alias("__f"))


def _arrays(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(batch)
    x = np.array([np.asarray(v, dtype=np.float64) for v in batch["__x"]], dtype=np.float64).reshape(n, -1)
    return x, *(np.frombuffer(b"".join(batch[c]), dtype=np.uint8).reshape(n, -1) for c in ("__y", "__f"))


def _sums(rows: DataFrame, run) -> dict[int, np.ndarray]:
    """The vectors that ``run`` gives for the cells of a batch of rows, added up in each task and then by cell."""

    def inside(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                for cell, v in run(*_arrays(batch.iloc[at : at + ROWS])):
                    total[cell] = total[cell] + v if cell in total else v
        yield pd.DataFrame({"cell": list(total), "v": [v.tobytes() for v in total.values()]})

    def over(part: pd.DataFrame) -> pd.DataFrame:
        total = np.frombuffer(part["v"].iloc[0])
        for v in part["v"].iloc[1:]:
            total = total + np.frombuffer(v)
        return pd.DataFrame({"cell": [part["cell"].iloc[0]], "v": [total.tobytes()]})

    schema = "cell int, v binary"
    return {r.cell: np.frombuffer(r.v) for r in rows.select("__x", "__y", "__f").mapInPandas(inside, schema).groupBy("cell").applyInPandas(over, schema).collect()}


def _medians(rows: DataFrame, missing: np.ndarray, splits: int, folds: int) -> np.ndarray:
    """Medians of the other folds' rows, for the features that have nulls; 0 for those without a value."""
    fill = np.zeros((splits, folds, len(missing)))
    holes = np.flatnonzero(missing)
    if len(holes):
        part = lambda s: F.conv(F.hex(F.substring("__f", s + 1, 1)), 16, 10).cast("int")
        each = rows.select("__x", F.explode(F.array(*(F.struct(F.lit(s).alias("split"), part(s).alias("own")) for s in range(splits)))).alias("g"))
        each = each.where(f"g.own < {folds}").select("g.*", "__x", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("fold")).where("fold != own")
        long = each.select("split", "fold", F.explode(F.array(*(F.struct(F.lit(int(k)).alias("feature"), F.col("__x")[int(k)].alias("value")) for k in holes))).alias("v")).select("split", "fold", "v.*")
        for r in exact_quantiles(long.where("value IS NOT NULL"), ["split", "fold", "feature"], "value", {"median": 0.5}).collect():
            fill[r.split, r.fold, r.feature] = r.median
    return fill


def fitted(rows: DataFrame, classes: int, split_of: list[int], c: float = 1.0, scaled: bool = True) -> Models:
    """Fits of ``packed`` rows; ``split_of`` names the split of each column. Rows of a column must be those of its split.

    Without ``scaled``, features are taken as they are."""
    split_of, splits, columns = np.asarray(split_of), max(split_of) + 1, len(split_of)
    p = _width(rows)
    whole = rows.agg(*(F.avg(F.col("__x")[k]).alias(f"m{k}") for k in range(p)), *(F.sum(F.col("__x")[k].isNull().cast("long")).alias(f"n{k}") for k in range(p)), F.count("*").alias("n")).first()[: 2 * p]
    shift, missing = np.array([v if v is not None else 0.0 for v in whole[:p]]), np.array([v or 0 for v in whole[p:]])

    def moments(x, y, f):
        """Per split and own fold: rows, values, sums and squares around the overall means, and class counts of its columns."""
        there, z = ~np.isnan(x), np.nan_to_num(x - shift)
        for s in range(splits):
            own = np.flatnonzero(split_of == s)
            for fold in np.unique(f[:, s]):
                if fold == ABSENT:
                    continue
                part = f[:, s] == fold
                counts = np.stack([(y[part][:, own] == k).sum(0) for k in range(classes)], axis=1)
                yield s * ABSENT + int(fold), np.concatenate([[part.sum()], there[part].sum(0), z[part].sum(0), (z[part] ** 2).sum(0), counts.ravel()]).astype(np.float64)

    own = _sums(rows, moments)
    folds = max((k % ABSENT for k in own), default=-1) + 1
    models = Models(classes, split_of, _medians(rows, missing, splits, folds), np.zeros((splits, folds, p)), np.ones((splits, folds, p)), np.zeros((columns, folds, classes if classes > 2 else 1, p + 1)))
    weights = np.zeros((columns, folds, 256))
    for s in range(splits):
        at = np.flatnonzero(split_of == s)
        parts = {k % ABSENT: v for k, v in own.items() if k // ABSENT == s}
        for fold in range(folds):
            total = sum((v for k, v in parts.items() if k != fold), np.zeros(1 + 3 * p + len(at) * classes))
            n, there, sums, squares = total[0], total[1 : 1 + p], total[1 + p : 1 + 2 * p], total[1 + 2 * p : 1 + 3 * p]
            counts = total[1 + 3 * p :].reshape(len(at), classes)
            if (counts == 0).any():
                raise ValueError(f"a class is missing among the training rows of fold {fold}")
            fill = models.fill[s, fold] - shift  # what missing values count as
            mean = (sums + (n - there) * fill) / n
            deviation = np.sqrt(np.maximum((squares + (n - there) * fill**2) / n - mean**2, 0))
            if scaled:
                models.centre[s, fold], models.scale[s, fold] = mean + shift, np.where(deviation > 1e-12 * np.maximum(1, np.abs(mean)), deviation, 1.0)
            weights[at, fold, :classes] = counts.sum(1, keepdims=True) / (classes * counts)
    parts = [v for k, v in own.items() if k // ABSENT == 0]
    there, sums, squares = (sum(v[1 + k * p : 1 + (k + 1) * p] for v in parts) for k in range(3))
    spread = np.sqrt(np.maximum(squares / np.maximum(there, 1) - (sums / np.maximum(there, 1)) ** 2, 0))
    models.shared = _shared(models, shift, np.where(spread > 1e-12 * np.maximum(1, np.abs(shift)), spread, 1.0), np.flatnonzero(missing))
    _newton(rows, models, weights, c)
    return models


def _width(rows: DataFrame) -> int:
    first = rows.select(F.size("__x").alias("n")).first()
    return first.n if first else 0


@dataclass
class Shared:
    """One design for all models: values around their means (0 where missing), a column of ones where a value is missing, and 1.

    A fold's own filling, centre and scale are linear in it (``to_own``: split, fold, shared feature, own feature), so products of
    features are made once a row, whatever the number of models."""

    shift: np.ndarray
    spread: np.ndarray
    holes: np.ndarray
    to_own: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([np.nan_to_num((x - self.shift) / self.spread), np.isnan(x[:, self.holes]), np.ones((len(x), 1))])


def _shared(models: Models, shift: np.ndarray, spread: np.ndarray, holes: np.ndarray) -> Shared:
    p, (splits, folds) = len(shift), models.fill.shape[:2]
    to_own = np.zeros((splits, folds, p + len(holes) + 1, p + 1))
    at = np.arange(p)
    to_own[:, :, at, at] = spread / models.scale
    to_own[:, :, p + np.arange(len(holes)), holes] = ((models.fill - shift) / models.scale)[:, :, holes]
    to_own[:, :, -1, :p] = (shift - models.centre) / models.scale
    to_own[:, :, -1, p] = 1
    return Shared(shift, spread, holes, to_own)


def _newton(rows: DataFrame, models: Models, weights: np.ndarray, c: float) -> None:
    columns, folds, free, q = models.theta.shape
    upper = [(a, b) for a in range(free) for b in range(a, free)]
    shared, first = models.shared, models.classes - free
    width = shared.to_own.shape[2]
    triangle = np.triu_indices(width)

    def step(x, y, f):
        column, fold = np.nonzero(active)
        split = models.split_of[column]
        theta = np.einsum("cuq,cjq->juc", shared.to_own[split, fold], models.theta[column, fold])
        cells, size = column * folds + fold, max(64, CELLS // (len(upper) * len(column)))
        for at in range(0, len(x), size):
            u, target, own = shared(x[at : at + size]), y[at : at + size, column], f[at : at + size, split]
            w = np.where((own != ABSENT) & (own != fold), weights[column, fold, target], 0.0)
            logits = [np.zeros_like(w)] * first + [u @ t for t in theta]
            top = np.maximum.reduce(logits)
            chance = [np.exp(v - top) for v in logits]
            total = np.add.reduce(chance)
            chance = [v / total for v in chance]
            known = [target == k for k in range(models.classes)]
            loss = (w * (np.log(total) + top - np.select(known, logits))).sum(0)
            slope = u.T @ np.hstack([w * (chance[k] - known[k]) for k in range(first, models.classes)])
            weighed = [w * v for v in chance]
            bends = (u[:, triangle[0]] * u[:, triangle[1]]).T @ np.hstack([weighed[first + a] * ((a == b) - chance[first + b]) for a, b in upper])
            found = np.vstack([loss, slope.reshape(width, free, -1).swapaxes(0, 1).reshape(free * width, -1), bends.reshape(-1, len(upper), len(column)).swapaxes(0, 1).reshape(len(upper) * len(bends), -1)])
            yield from zip(cells.tolist(), np.ascontiguousarray(found.T), strict=True)

    penalty = np.tile(np.r_[np.full(q - 1, 1 / c), 0.0], free)
    # adding the same to all intercepts changes nothing: that direction is held
    held = np.kron(np.ones((free, free)) if free > 1 else np.zeros((1, 1)), np.diag(np.r_[np.zeros(q - 1), 1.0]))
    active = np.ones((columns, folds), dtype=bool)
    settled: dict[int, tuple] = {}  # a model's best place so far: coefficients, loss, step from there, length of the last try
    while active.any():
        for cell, v in _sums(rows, step).items():
            j, fold = divmod(cell, folds)
            theta = models.theta[j, fold].ravel()
            loss = v[0] + (penalty * theta**2).sum() / 2
            before = settled.get(cell)
            if before and not loss <= before[1] + 1e-12 * abs(before[1]):
                theta, loss, move, length = *before[:3], before[3] / 2
            else:
                own, at = shared.to_own[models.split_of[j], fold], 1 + free * width
                slope, bend = (v[1:at].reshape(free, width) @ own).ravel() + penalty * theta, np.zeros((free, q, free, q))
                for a, b in upper:
                    block = np.zeros((width, width))
                    block[triangle] = v[at : at + len(triangle[0])]
                    block = own.T @ (block + np.triu(block, 1).T) @ own
                    bend[a, :, b], bend[b, :, a], at = block, block, at + len(triangle[0])
                move, length = -np.linalg.solve(bend.reshape(free * q, -1) + np.diag(penalty) + held, slope), 1.0
                if -(slope @ move) / 2 <= LEAST_GAIN * (1 + abs(loss)):
                    models.theta[j, fold], active[j, fold] = (theta + move).reshape(free, q), False
                    continue
            if length < 1e-9:  # no shorter step helps: rounding
                models.theta[j, fold], active[j, fold] = theta.reshape(free, q), False
                continue
            settled[cell] = (theta, loss, move, length)
            models.theta[j, fold] = (theta + length * move).reshape(free, q)


def predicted(rows: DataFrame, models: Models, keep: list[str], columns: list[int] | None = None) -> DataFrame:
    """``keep`` with ``column``, ``target`` and ``probs``: each row by the models of the fold it isn't trained in."""
    wanted = np.arange(len(models.split_of)) if columns is None else np.asarray(columns)

    def run(batches):
        for whole in batches:
            for at in range(0, len(whole), ROWS):
                batch = whole.iloc[at : at + ROWS]
                x, y, f = _arrays(batch)
                for s in np.unique(models.split_of[wanted]):
                    own = wanted[models.split_of[wanted] == s]
                    for fold in np.unique(f[:, s]):
                        if fold >= models.folds:
                            continue
                        part = np.flatnonzero(f[:, s] == fold)
                        chance = np.round(models.probabilities(models.design(x[part], s, fold), own, fold), 9)
                        row, column = np.nonzero(y[part][:, own] != ABSENT)
                        out = batch.iloc[part[row]][keep].reset_index(drop=True)
                        yield out.assign(column=own[column], target=y[part[row], own[column]].astype(np.int32), probs=list(chance[row, column]))

    kept = [rows.schema[c] for c in keep]
    schema = T.StructType([*kept, T.StructField("column", T.IntegerType()), T.StructField("target", T.IntegerType()), T.StructField("probs", T.ArrayType(T.DoubleType()))])
    return rows.mapInPandas(run, schema)


def confusions(rows: DataFrame, models: Models) -> DataFrame:
    """(column, reference_id, predicted_id, n) of the held-out predictions, counted in the tasks: a row isn't copied per column."""

    def run(batches):
        total = np.zeros((len(models.split_of), models.classes, models.classes), dtype=np.int64)
        for whole in batches:
            for at in range(0, len(whole), ROWS):
                x, y, f = _arrays(whole.iloc[at : at + ROWS])
                for s in range(models.split_of.max() + 1):
                    own = np.flatnonzero(models.split_of == s)
                    for fold in np.unique(f[:, s]):
                        if fold >= models.folds:
                            continue
                        part = f[:, s] == fold
                        best = np.round(models.probabilities(models.design(x[part], s, fold), own, fold), 9).argmax(2)
                        there = y[part][:, own] != ABSENT
                        np.add.at(total, (np.broadcast_to(own, best.shape)[there], y[part][:, own][there], best[there]), 1)
        column, reference, predicted_id = np.nonzero(total)
        yield pd.DataFrame({"column": column, "reference_id": reference, "predicted_id": predicted_id, "n": total[column, reference, predicted_id]})

    found = rows.select("__x", "__y", "__f").mapInPandas(run, "column int, reference_id int, predicted_id int, n long")
    return found.groupBy("column", "reference_id", "predicted_id").agg(F.sum("n").alias("n"))


def _keys(models: Models, wanted: list[int]):
    """rows -> (column, wanted class) x rows of whole numbers that order like the held-out probabilities rounded to nine places,
    times two, plus one where the row is of the class; -1 for rows that a column doesn't predict."""
    columns, folds, free, _ = models.theta.shape
    own = models.shared.to_own[models.split_of]
    theta = np.einsum("cfuq,cfjq->jucf", own, models.theta).reshape(free, own.shape[2], -1)

    def run(x, y, f):
        u, part = models.shared(x), f[:, models.split_of]
        there = (part < folds) & (y != ABSENT)
        pick = np.where(there, part, 0)[:, :, None].astype(np.int64)
        logits = [np.take_along_axis((u @ t).reshape(len(u), columns, folds), pick, 2)[:, :, 0] for t in theta]
        logits = [np.zeros(there.shape)] * (models.classes - free) + logits
        top = np.maximum.reduce(logits)
        chance = [np.exp(v - top) for v in logits]
        total = np.add.reduce(chance)
        each = [np.where(there, 2 * np.rint(chance[k] / total * 1e9) + (y == k), -1) for k in wanted]
        return np.stack(each, axis=2).astype(np.int32).reshape(len(u), -1).T

    return run


def aucs(rows: DataFrame, models: Models, wanted: list[int]) -> DataFrame:
    """(column, class_id, value): mid-rank AUCs of the held-out probabilities of the wanted classes, each against all others; null without one of both sides.

    Tasks sort the scores of many rows and cut them into buckets of neighbouring scores, which move as lists of 32-bit numbers: four
    bytes a score, fewer where scores repeat. Rows picked at random place the edges of buckets, on which no result depends."""
    n, width, run = rows.count(), len(wanted), _keys(models, wanted)
    buckets = -(-n // BUCKET)
    edges = np.zeros((len(models.split_of) * width, 0), dtype=np.int32)
    if buckets > 1:
        some = rows.select("__x", "__y", "__f").sample(fraction=min(1.0, PLACING * buckets / n), seed=1).limit(2 * PLACING * buckets).toPandas()
        placed = run(*_arrays(some)) if len(some) else edges
        edges = np.stack([np.quantile(v[v >= 0], np.arange(1, buckets) / buckets, method="lower") if (v >= 0).any() else np.zeros(buckets - 1) for v in placed]).astype(np.int32) // 2 * 2 if len(some) else edges
    chunk = max(1, SORTED // max(1, len(edges)))

    def packs(keys):
        out = []
        for series, own in enumerate(np.sort(keys, axis=1)):
            own = own[np.searchsorted(own, 0) :]
            cuts = np.r_[0, np.searchsorted(own, edges[series]), len(own)]
            for k in np.flatnonzero(np.diff(cuts)):
                part = own[cuts[k] : cuts[k + 1]]
                starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
                few = 2 * len(starts) < len(part)
                out.append((series, int(k), (part[starts] if few else part).tobytes(), np.diff(np.r_[starts, len(part)]).astype(np.int32).tobytes() if few else b""))
        return pd.DataFrame(out, columns=["series", "bucket", "scores", "times"])

    def cut(batches):
        kept, size = [], 0
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                kept.append(run(*_arrays(batch.iloc[at : at + ROWS])))
                size += kept[-1].shape[1]
                if size >= chunk:
                    yield packs(np.hstack(kept))
                    kept, size = [], 0
        if kept:
            yield packs(np.hstack(kept))

    def counted(part: pd.DataFrame) -> pd.DataFrame:
        keys = [np.frombuffer(v, dtype=np.int32) for v in part["scores"]]
        times = np.concatenate([np.frombuffer(t, dtype=np.int32) if t else np.ones(len(k), dtype=np.int32) for k, t in zip(keys, part["times"], strict=True)]).astype(np.int64)
        keys = np.concatenate(keys)
        order = np.argsort(keys, kind="stable")
        keys, times = keys[order], times[order]
        starts = np.flatnonzero(np.r_[True, keys[1:] // 2 != keys[:-1] // 2])
        p, q = (np.add.reduceat(times * side, starts) for side in (keys % 2 == 1, keys % 2 == 0))
        won = float((p * (2 * (np.cumsum(q) - q) + q)).sum()) / 2
        return pd.DataFrame({"series": [part["series"].iloc[0]], "bucket": [part["bucket"].iloc[0]], "p": [p.sum()], "q": [q.sum()], "won": [won]})

    packed = rows.select("__x", "__y", "__f").mapInPandas(cut, "series int, bucket int, scores binary, times binary")
    own = packed.groupBy("series", "bucket").applyInPandas(counted, "series int, bucket int, p long, q long, won double")
    below = F.sum("q").over(W.partitionBy("series").orderBy("bucket")) - F.col("q")
    value = F.try_divide(F.sum("won"), F.sum("p").cast("double") * F.sum("q"))
    found = own.withColumn("won", F.col("won") + F.col("p") * below).groupBy("series").agg(value.alias("value"))
    class_of = F.element_at(F.array(*(F.lit(k) for k in wanted)), (F.col("series") % width + 1).cast("int"))
    return found.select(F.floor(F.col("series") / width).cast("int").alias("column"), class_of.alias("class_id"), "value")


def coefficients(spark, models: Models, features: list[str]) -> DataFrame:
    """(column, outer_fold, class_id, feature, coef) on scaled features, the intercept as a feature of that name; a row a number."""
    rows = [
        (int(j), fold, k + models.classes - models.theta.shape[2], name, float(v))
        for j in range(len(models.split_of)) for fold in range(models.folds) for k, own in enumerate(models.theta[j, fold]) for name, v in zip([*features, "intercept"], own, strict=True)
    ]
    return spark.createDataFrame(rows, "column int, outer_fold int, class_id int, feature string, coef double")
