"""Draws inside strata: their distribution, and the same draws in SQL, over several pieces."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.operators import dealing as D

duckdb = pytest.importorskip("duckdb")


def distribution(n, p):
    return [math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(n + 1)]


@pytest.mark.parametrize("n,p", [(1, 0.5), (7, 0.3), (40, 0.9), (300, 0.02)])
def test_binomials_are_the_inverse_of_the_distribution(n, p):
    total, draw = np.cumsum(distribution(n, p)), random.Random(n)
    uniforms = np.array([draw.random() for _ in range(500)] + [0.0, 1 - 2**-52])
    got = D.binomial(np.full(len(uniforms), n), p, uniforms)
    want = [min(n, int(np.searchsorted(total, u, side="right"))) for u in uniforms]
    assert all(a == b or abs(u - total[min(a, b)]) < 1e-12 for a, b, u in zip(got, want, uniforms, strict=True))
    assert (D.binomial(np.array([0, 5]), 1.0, np.array([0.5, 0.5])) == [0, 5]).all() and (D.binomial(np.array([0, 5]), 0.0, np.array([0.5, 0.5])) == [0, 0]).all()


def test_a_stratum_of_a_thousand_million_rows_is_split(spark):
    uniforms = np.linspace(0.001, 0.999, 400)
    got = D.binomial(np.full(400, 10**9), 0.25, uniforms)
    sd = math.sqrt(10**9 * 0.25 * 0.75)
    assert abs(got.mean() - 2.5e8) < sd / 20 and abs(got.std() / sd - 1) < 0.02 and (np.diff(got) >= 0).all()


def test_cells_are_the_same_in_sql(spark):
    rows = [(r, p, (r * 7 + p * 13) % 90) for r in range(4) for p in range(5)]
    con = duckdb.connect()
    con.execute("CREATE TABLE cell (reference_id INT, predicted_id INT, n BIGINT)")
    con.executemany("INSERT INTO cell VALUES (?, ?, ?)", rows)
    want = Counter(con.sql(f"WITH RECURSIVE {D.cells_sql('drawn', 'cell', 'reference_id', ['reference_id', 'predicted_id'], 300, 4)} SELECT replicate, reference_id, predicted_id, n FROM drawn").fetchall())
    cells = spark.createDataFrame(rows, "reference_id int, predicted_id int, n long").withColumn("cell", F.struct("reference_id", "predicted_id"))
    got = Counter(map(tuple, D.resampled_cells(cells.repartition(3), "reference_id", 300, 4).select("replicate", "cell.*", "n").collect()))
    assert got == want and sum(k[3] for k in got) == 300 * sum(n for *_, n in rows)


@pytest.mark.parametrize("piece", [2048, 32])
def test_weights_are_the_same_in_sql(spark, monkeypatch, piece):
    monkeypatch.setattr(D, "PIECE", piece)
    rows = [(f"k{k}", k % 2, None if k % 7 == 0 else k % 3) for k in range(300)]
    con = duckdb.connect()
    con.execute("CREATE TABLE own (key VARCHAR, a INT, b INT)")
    con.executemany("INSERT INTO own VALUES (?, ?, ?)", rows)
    want = con.sql(f"WITH RECURSIVE {D.weights_sql('drawn', 'own', ['a', 'b'], 'key', 60, 9)} SELECT key, replicate, w FROM drawn").fetchall()
    df = spark.createDataFrame(rows, "key string, a int, b int").repartition(3)
    got = {r.key: np.frombuffer(r.weights, "<u2") for r in D.with_weights(df, ["a", "b"], "key", 60, 9).collect()}
    assert {(k, r, int(w)) for k, own in got.items() for r, w in enumerate(own) if w} == set(want)
    every = np.stack(list(got.values()))
    assert every.sum() == 300 * 60 and abs((every == 0).mean() - math.exp(-1)) < 0.02


@pytest.mark.parametrize("piece", [2048, 16])
def test_permuted_targets_keep_the_counts_of_their_strata(spark, monkeypatch, piece):
    monkeypatch.setattr(D, "PIECE", piece)
    rows = [(f"k{k}", k % 2, (k // 2) % 5 % 3) for k in range(200)]
    df = spark.createDataFrame(rows, "key string, s int, y int")
    found = D.with_permutations(df, ["s"], "key", "y", 3, 80, 2).collect()
    again = {r.key: r.permuted for r in D.with_permutations(df.repartition(5), ["s"], "key", "y", 3, 80, 2).collect()}
    assert len(found) == 200 and all(again[r.key] == r.permuted for r in found)
    each = np.stack([np.frombuffer(r.permuted, "u1") for r in found])
    for s in range(2):
        own = np.array([r.s == s for r in found])
        for y in range(3):
            n = sum(r.y == y for r in found if r.s == s)
            assert ((each[own] == y).sum(0) == n).all()
            # any row is as likely as another to have the target
            assert abs((each[own] == y).mean(1) - n / own.sum()).max() < 0.25
    assert D.with_permutations(df.limit(0), ["s"], "key", "y", 3, 80, 2).count() == 0


@pytest.mark.parametrize("most", [1, 3, 700])
def test_coded_counts_round_trip(most):
    own = np.random.default_rng(most).integers(0, most + 1, (600, 75)).astype("<u2")
    own[5], own[6] = 0, 65535
    assert (D.decoded(D.coded(own)) == own).all() and D.decoded([]).size == 0


def test_draws_are_the_weights_in_an_eighth_of_the_bytes(spark):
    df = spark.range(500).selectExpr("concat('k', id) AS key", "id % 2 AS a")
    draws = {r.key: r.draws for r in D.with_draws(df, ["a"], "key", 2000, 9).collect()}
    weights = {r.key: np.frombuffer(r.weights, "<u2") for r in D.with_weights(df, ["a"], "key", 2000, 9).collect()}
    assert all((D.decoded([x])[0] == weights[k]).all() for k, x in draws.items())
    assert sum(map(len, draws.values())) < 500 * 2000 * 2.1 / 8
