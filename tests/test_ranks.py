"""Exact quantiles, distances and weighted rank correlations against plain loops, with hot values and small pieces."""

import random

import numpy as np
import pytest

from marlstone.operators import dealing, quantiles, resampling


def mid_ranks(values, weights):
    """Each row's mid-rank among rows that occur as often as their weight."""
    out = []
    for v in values:
        below, same = (sum(w for u, w in zip(values, weights, strict=True) if test(u)) for test in (lambda u: u < v, lambda u: u == v))
        out.append(below + (same + 1) / 2)
    return np.array(out)


@pytest.mark.parametrize("buckets", [256, 4])
def test_quantiles_of_skewed_values(spark, monkeypatch, buckets):
    monkeypatch.setattr(quantiles, "BUCKETS", buckets)
    draw = random.Random(1)
    groups = {
        "hot": [5.0] * 300 + [draw.random() for _ in range(100)], "wide": [10.0 ** draw.randint(-300, 300) * draw.choice([-1, 1]) for _ in range(301)],
        "one": [7.0], "two": [1.0, 2.0], "few": [float(draw.randint(0, 3)) for _ in range(50)],
    }
    df = spark.createDataFrame([(g, v) for g, own in groups.items() for v in own] + [("one", None), ("none", None)], "g string, v double")
    shares = {f"q{k}": k / 8 for k in range(9)}
    found = {r.g: r for r in quantiles.exact_quantiles(df.repartition(3), ["g"], "v", shares).collect()}
    assert sorted(found) == sorted(groups)
    for g, own in groups.items():
        for name, q in shares.items():
            assert found[g][name] == pytest.approx(float(np.quantile(own, q)), rel=1e-12)
    whole = quantiles.exact_quantiles(df, [], "v", {"m": 0.5}).first()
    assert whole.m == pytest.approx(float(np.median([v for own in groups.values() for v in own])), rel=1e-12)


def test_shifts_are_those_of_plain_loops(spark):
    draw = random.Random(4)
    rows = [(f, k % 4, float(draw.choice([1, 1, 1, 2, 3, draw.random() * (5 if k % 4 == 2 else 1)]))) for f in ("x", "y") for k in range(200)] + [("x", 1, None)]
    found = {(r.feature, r.fold): r for r in resampling.fold_shifts(spark.createDataFrame(rows, "feature string, outer_fold int, value double").repartition(3), [0, 1, 2, 3]).collect()}
    assert len(found) == 8
    for (feature, fold), r in found.items():
        own = np.array([v for f, k, v in rows if f == feature and k == fold and v is not None])
        rest = np.array([v for f, k, v in rows if f == feature and k != fold and v is not None])
        points = np.unique(np.r_[own, rest])
        want = max(abs((own <= v).mean() - (rest <= v).mean()) for v in points)
        smd = abs(own.mean() - rest.mean()) / np.sqrt((own.var() + rest.var()) / 2)
        assert [r.fold_median, r.fold_q25, r.fold_q75, r.rest_median, r.rest_q25, r.rest_q75] == pytest.approx([*np.quantile(own, [0.5, 0.25, 0.75]), *np.quantile(rest, [0.5, 0.25, 0.75])])
        assert [r.ks, r.abs_smd, r.fold_mean, r.rest_mean] == pytest.approx([want, smd, own.mean(), rest.mean()])


@pytest.mark.parametrize("piece", [2048, 9])
def test_weighted_rank_correlations(spark, monkeypatch, piece):
    monkeypatch.setattr(dealing, "PIECE", piece)
    monkeypatch.setattr(resampling, "PIECE", piece)
    draw = random.Random(2)
    # a third of the rows share one score
    rows = [(f"p{k}", k % 5, k % 2, 0.5 if k % 3 == 0 else draw.gauss(0, 100), float(draw.randint(0, 9))) for k in range(60)]
    df = spark.createDataFrame(rows, "key string, outer_fold int, s int, a double, b double")
    own = resampling.with_weights(df, ["s"], "key", 30, 3)
    weights = {r.key: np.frombuffer(r.weights, "<u2").astype(int) for r in own.collect()}
    values = {r.replicate: r.value for r in resampling.weighted_spearman(own, "a", "b").collect()}
    assert len(values) == 30
    for r in range(0, 30, 5):
        w = np.array([weights[k][r] for k, *_ in rows])
        x, y = (np.repeat(mid_ranks([row[c] for row in rows], w), w) for c in (3, 4))
        assert values[r] == pytest.approx(np.corrcoef(x, y)[0, 1])
    x, y = (mid_ranks([row[c] for row in rows], [1] * 60) for c in (3, 4))
    found = resampling.rank_association(df, "a", "b", ["s"], "key", 50, 40, 3).first()
    assert found.rho == pytest.approx(np.corrcoef(x, y)[0, 1]) and found.n == 60 and found.permutations == 50 and found.rho_low <= found.rho_median <= found.rho_high and len(found.fold_rho) == 5
    null = [r.value for r in resampling.permuted_correlations(df, "a", "b", ["s"], "key", 200, 3).collect()]
    assert len(null) == 200 and abs(np.mean(null)) < 0.25 and 0.08 < np.std(null) < 0.2
    tied = resampling.rank_association(df.withColumn("b", df.a * 2), "a", "b", ["s"], "key", 50, 40, 3).first()
    assert tied.rho == pytest.approx(1) and tied.p == 1 / 51 and tied.same_direction_folds == 5 and tied.passed


def test_ranks_of_coded_draws_are_those_of_weights_in_four_bytes(spark):
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([("x", str(k), float(rng.integers(20)), float(rng.integers(30))) for k in range(300)], "s string, key string, a double, b double")
    drawn, plain = resampling.with_draws(df, ["s"], "key", 30, 3), resampling.with_weights(df, ["s"], "key", 30, 3)
    ranks = resampling.weighted_ranks(drawn.select("a", "b", "draws"), "a", "r").first()
    assert len(ranks.r) == 4 * 30
    values = [{r.replicate: r.value for r in resampling.weighted_spearman(x, "a", "b").collect()} for x in (drawn, plain)]
    assert len(values[0]) == 30 and values[0] == pytest.approx(values[1], abs=1e-12)
