"""Random dealing inside strata of any size: bootstrap weights, permuted targets and resampled cells, for many replicates at once.

A stratum's rows are ranked by a draw and cut into pieces of ``PIECE``. A tree halves the pieces, a level at a time: a node's
numbers of all replicates (how many draws, or how many targets of each class, fall into its rows) are split between its halves,
so no stratum and no list of its pieces meets in one task, and nothing is copied per replicate but one number a piece. The rows
of a piece are dealt last.

Draws with replacement come from hashed uniforms (SHA-256 of the node's name, then a 64-bit mix of the replicate) through
the inverse of the binomial distribution, and from hashed places inside a piece. So they are exact, the same on any partitioning, and
``weights_sql`` and ``cells_sql`` replay them in SQL.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.functions.draws import draw, hash_rank
from marlstone.sources.tables import written

#: Rows of a piece; replicates whose places are drawn at a time; standard deviations of a binomial that its inverse looks at.
PIECE, BLOCK, DEVIATIONS = 2048, 250, 12
#: Rows coded or decoded at a time.
CODED = 256
GOLDEN, FIRST, SECOND = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def mixed(name: str, counters: np.ndarray) -> np.ndarray:
    """52 random bits for each counter of a named stream."""
    base = np.uint64(int(hashlib.sha256(name.encode()).hexdigest()[:16], 16))
    with np.errstate(over="ignore"):
        z = base + counters.astype(np.uint64) * np.uint64(GOLDEN)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(FIRST)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(SECOND)
        return (z ^ (z >> np.uint64(31))) >> np.uint64(12)


def binomial(counts: np.ndarray, share: float, uniforms: np.ndarray) -> np.ndarray:
    """The inverse distribution of Binomial(count, share) at each uniform."""
    if not 0 < share < 1:
        return counts if share >= 1 else np.zeros_like(counts)
    out = np.zeros_like(counts)
    for n in np.unique(counts[counts > 0]):
        own, sd = counts == n, np.sqrt(n * share * (1 - share))
        low = max(0, int(np.floor(n * share - DEVIATIONS * sd - DEVIATIONS)))
        k = np.arange(low + 1, min(n, int(np.ceil(n * share + DEVIATIONS * sd + DEVIATIONS))) + 1)
        logs = np.r_[0.0, np.cumsum(np.log((n - k + 1) / k) + np.log(share / (1 - share)))]
        total = np.cumsum(np.exp(logs - logs.max()))
        out[own] = low + np.minimum(np.searchsorted(total / total[-1], uniforms[own], side="right"), len(k))
    return out


def halved(counts: np.ndarray, left: int, whole: int, name: str) -> np.ndarray:
    """How many of each replicate's draws fall into the first ``left`` of ``whole`` rows."""
    return binomial(counts, left / whole, mixed(name, np.arange(1, len(counts) + 1)) / 2.0**52)


def resampled_cells(cells: DataFrame, stratum: str, replicates: int, seed: int) -> DataFrame:
    """cells (stratum, cell, n) -> (replicate, cell, n) of as many draws per stratum as it has rows.

    For the few cells of a matrix: a stratum's cells are one group."""

    def drawn(part: pd.DataFrame) -> pd.DataFrame:
        part, name = part.sort_values("leaf"), part["__s"].iloc[0]
        before, out = np.r_[0, np.cumsum(part["n"])], np.zeros((len(part), replicates), dtype=np.int64)
        nodes = [(0, len(part), np.full(replicates, before[-1]))]
        while nodes:
            low, high, counts = nodes.pop()
            if high - low == 1:
                out[low] = counts
                continue
            middle = (low + high + 1) // 2
            first = halved(counts, before[middle] - before[low], before[high] - before[low], f"{seed}|{name}|{low}|{high}")
            nodes += [(low, middle, first), (middle, high, counts - first)]
        leaf, replicate = np.nonzero(out)
        return pd.DataFrame({"__s": name, "leaf": leaf, "replicate": replicate, "n": out[leaf, replicate]})

    own = cells.where("n > 0").select(F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("__s"), "cell", "n")
    lists = own.groupBy("__s").agg(F.array_sort(F.collect_list(F.struct("cell", "n"))).alias("c"))
    leaves = lists.select("__s", F.posexplode("c").alias("leaf", "x")).select("__s", "leaf", "x.cell", "x.n")
    found = leaves.drop("cell").groupBy("__s").applyInPandas(drawn, "__s string, leaf int, replicate int, n long")
    return found.join(leaves.select("__s", "leaf", "cell"), ["__s", "leaf"]).select("replicate", "cell", "n")


def _stratum(strata: list[str]):
    return F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in strata))


def in_pieces(df: DataFrame, strata: list[str], key: str, seed: int) -> DataFrame:
    """Adds ``__s``, ``__rank`` (from 0) and ``__piece`` of each row in its stratum, in the order of a draw."""
    own = df.withColumn("__s", _stratum(strata)).withColumn("__h", draw(seed, F.lit("rank"), key))
    ranked = hash_rank(own, ["__s"], "__h", "__r").withColumn("__rank", F.col("__r").cast("long") - 1)
    return written(ranked.withColumn("__piece", F.floor(F.col("__rank") / PIECE)).drop("__h", "__r"), "ranked")


def over_pieces(strata: DataFrame, start, split) -> DataFrame:
    """strata (__s, n, counts) -> (__s, __piece, state), halving the pieces level by level.

    ``start``: counts -> the state of a whole stratum; ``split``: (state, rows on the left, rows, name of the node) -> the
    states of both halves."""
    most = strata.agg(F.max("n")).first()[0] or 1

    def roots(batches):
        for batch in batches:
            yield batch.assign(low=0, high=-(-batch["n"] // PIECE), state=[start(c) for c in batch["counts"]])[["__s", "n", "low", "high", "state"]]

    nodes = strata.select("__s", "n", "counts").mapInPandas(roots, "__s string, n long, low long, high long, state binary")

    def level(batches):
        for batch in batches:
            out = []
            for s, n, low, high, state in batch.itertuples(index=False):
                if high - low < 2:
                    out.append((s, n, low, high, state))
                    continue
                middle = (low + high + 1) // 2
                a, b = split(state, (middle - low) * PIECE, min(high * PIECE, n) - low * PIECE, f"{s}|{low}|{high}")
                out += [(s, n, low, middle, a), (s, n, middle, high, b)]
            yield pd.DataFrame(out, columns=batch.columns)

    for _ in range(max(0, (-(-most // PIECE) - 1).bit_length())):
        nodes = nodes.mapInPandas(level, nodes.schema).repartition("__s", "low")
    return nodes.select("__s", F.col("low").alias("__piece"), "state")


def _dealt(ranked: DataFrame, pieces: DataFrame, columns: list[str], inside, name: str) -> DataFrame:
    """Every piece's rows with its state: ``inside(rows in order, state, name of the piece)`` gives one value a row, as ``name``."""

    def run(rows: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("__rank")
        values = inside(rows, state["state"].iloc[0], f"{rows['__s'].iloc[0]}|{rows['__piece'].iloc[0]}")
        return rows[columns].assign(**{name: values})

    keys, kept = ["__s", "__piece"], [ranked.schema[c] for c in columns]
    return ranked.groupBy(keys).cogroup(pieces.groupBy(keys)).applyInPandas(run, T.StructType([*kept, T.StructField(name, T.BinaryType())]))


def coded(weights: np.ndarray) -> list[bytes]:
    """A row's counts as bits: as many ones as a count says and a zero after it, so about two bits a count; ones fill the last byte."""
    n = weights.astype(np.int64)
    sizes = -(-(n.sum(1) + n.shape[1]) // 8)
    ends = np.cumsum(sizes)
    bits = np.ones(8 * sizes.sum(), dtype=np.uint8)
    bits[(8 * (ends - sizes)[:, None] + np.cumsum(n, axis=1) + np.arange(n.shape[1])).ravel()] = 0
    whole = np.packbits(bits).tobytes()
    return [whole[end - size : end] for end, size in zip(ends.tolist(), sizes.tolist(), strict=True)]


def decoded(rows) -> np.ndarray:
    """The counts (rows, replicates) of ``coded`` rows."""
    rows, parts = list(rows), []
    for at in range(0, len(rows), CODED):
        own = rows[at : at + CODED]
        starts = 8 * np.cumsum([0, *(len(x) for x in own[:-1])])
        zeros = np.flatnonzero(np.unpackbits(np.frombuffer(b"".join(own), dtype=np.uint8)) == 0).reshape(len(own), -1)
        parts.append((np.diff(zeros, axis=1, prepend=starts[:, None] - 1) - 1).astype("<u2"))
    return np.concatenate(parts) if parts else np.zeros((0, 0), dtype="<u2")


def with_weights(df: DataFrame, strata: list[str], key: str, replicates: int, seed: int) -> DataFrame:
    """Adds ``weights``: how often each replicate draws the row (binary, unsigned 16-bit), as many draws in each stratum as it has rows."""
    drawn, columns = with_draws(df, strata, key, replicates, seed), df.columns

    def plain(batches):
        for batch in batches:
            yield batch[columns].assign(weights=[w.tobytes() for w in decoded(batch["draws"])])

    return drawn.mapInPandas(plain, T.StructType([*(drawn.schema[c] for c in columns), T.StructField("weights", T.BinaryType())]))


def with_draws(df: DataFrame, strata: list[str], key: str, replicates: int, seed: int) -> DataFrame:
    """Adds ``draws``: the weights of ``with_weights``, an eighth as long, ``coded``."""
    ranked = in_pieces(df, strata, key, seed)

    def split(state, left, whole, name):
        counts = np.frombuffer(state, dtype="<i8")
        first = halved(counts, left, whole, f"{seed}|{name}")
        return first.tobytes(), (counts - first).tobytes()

    def inside(rows, state, name):
        counts, m, name = np.frombuffer(state, dtype="<i8"), len(rows), f"{seed}|{name}|rows"
        out = np.zeros((m, replicates), dtype="<u2")
        for at in range(0, replicates, BLOCK):
            own = counts[at : at + BLOCK]
            which = np.repeat(np.arange(len(own)), own)
            turn = np.arange(len(which)) - np.repeat(np.cumsum(own) - own, own)
            place = (mixed(name, ((which + at) << 32) + turn + 1) * np.uint64(m)) >> np.uint64(52)
            out[:, at : at + BLOCK] = np.bincount(place.astype(np.int64) * len(own) + which, minlength=m * len(own)).reshape(m, len(own))
        return [x for at in range(0, m, CODED) for x in coded(out[at : at + CODED])]

    whole = ranked.groupBy("__s").agg(F.count("*").alias("n")).withColumn("counts", F.array("n"))
    pieces = over_pieces(whole, lambda c: np.full(replicates, c[0], dtype="<i8").tobytes(), split)
    return written(_dealt(ranked, pieces, df.columns, inside, "draws"), "drawn")


def with_permutations(df: DataFrame, strata: list[str], key: str, target: str, classes: int, replicates: int, seed: int) -> DataFrame:
    """Adds ``permuted``: the row's target in each replicate (binary, a byte each), the targets dealt out anew inside strata, their counts kept."""
    ranked = in_pieces(df, strata, key, seed)

    def generator(name):
        return np.random.default_rng(int(hashlib.sha256(f"{seed}|{name}".encode()).hexdigest()[:16], 16))

    def split(state, left, whole, name):
        counts = np.frombuffer(state, dtype="<i8").reshape(-1, classes)
        rng = generator(name)
        first = np.stack([rng.multivariate_hypergeometric(c, left, method="marginals") for c in counts])
        return first.tobytes(), (counts - first).tobytes()

    def inside(rows, state, name):
        counts, rng = np.frombuffer(state, dtype="<i8").reshape(-1, classes), generator(f"{name}|rows")
        each = np.stack([np.repeat(np.arange(classes, dtype=np.uint8), c) for c in counts])
        return [x.tobytes() for x in np.ascontiguousarray(rng.permuted(each, axis=1).T)]

    counts = F.array(*(F.sum((F.col(target) == k).cast("long")) for k in range(classes)))
    whole = ranked.groupBy("__s").agg(F.count("*").alias("n"), counts.alias("counts"))
    pieces = over_pieces(whole, lambda c: np.tile(np.asarray(c, dtype="<i8"), replicates).tobytes(), split)
    return written(_dealt(ranked, pieces, df.columns, inside, "permuted"), "permuted")


# the same draws in SQL


def bits_sql(name: str, counter: str) -> str:
    """52 random bits of a counter in a named stream."""
    wrap = lambda x: f"(({x}) % 18446744073709551616::UHUGEINT)::UBIGINT"
    base = f"('0x' || substr(sha256({name}), 1, 16))::UBIGINT"
    z = wrap(f"{base}::UHUGEINT + ({counter})::UHUGEINT * {GOLDEN}::UHUGEINT")
    steps = f"list_reduce([{z}, {FIRST}::UBIGINT, {SECOND}::UBIGINT], lambda z, m: {wrap(f'xor(z, z >> (CASE WHEN m = {FIRST} THEN 30 ELSE 27 END))::UHUGEINT * m::UHUGEINT')})"
    return f"list_reduce([{steps}, 0::UBIGINT], lambda z, m: xor(z, z >> 31) >> 12)"


def tree_sql(name: str, leaves: str, replicates: int, seed: int) -> str:
    """CTEs up to ``name`` (s, low, r, c): the draws of each leaf of ``leaves`` (s, leaf, n) in each replicate. Needs WITH RECURSIVE."""
    return f"""{name}_w AS (SELECT s, leaf, n, CAST(sum(n) OVER (PARTITION BY s ORDER BY leaf) - n AS BIGINT) AS before FROM {leaves}),
{name}_s AS (SELECT s, CAST(count(*) AS BIGINT) AS leaves, CAST(sum(n) AS BIGINT) AS n FROM {leaves} GROUP BY s),
{name}_b AS (SELECT s, leaf, before FROM {name}_w UNION ALL SELECT s, leaves, n FROM {name}_s),
{name}_t AS (
  SELECT s, 0::BIGINT AS low, leaves AS high, r, n AS c FROM {name}_s CROSS JOIN range({replicates}) x(r)
  UNION ALL
  SELECT s, CASE WHEN side = 0 THEN low ELSE mid END, CASE WHEN side = 0 THEN mid ELSE high END, r, CASE WHEN side = 0 THEN f ELSE c - f END FROM (
    SELECT s, low, mid, high, r, c, min(lo) + least(count(*) FILTER (WHERE cdf <= u * total), min(hi) - min(lo)) AS f FROM (
      SELECT s, low, mid, high, r, c, u, lo, hi, sum(pm) OVER (PARTITION BY s, low, r ORDER BY k) AS cdf, sum(pm) OVER (PARTITION BY s, low, r) AS total FROM (
        SELECT *, exp(lgamma(c + 1) - lgamma(k + 1) - lgamma(c - k + 1) + k * ln(p) + (c - k) * ln(1 - p)) AS pm FROM (
          SELECT *, unnest(range(lo, hi + 1)) AS k FROM (
            SELECT *, greatest(0, floor(c * p - {DEVIATIONS} * sqrt(c * p * (1 - p)) - {DEVIATIONS}))::BIGINT AS lo, least(c, ceil(c * p + {DEVIATIONS} * sqrt(c * p * (1 - p)) + {DEVIATIONS}))::BIGINT AS hi,
                   {bits_sql(f"'{seed}|' || s || '|' || low || '|' || high", "r + 1")} / 4503599627370496.0 AS u FROM (
              SELECT t.s, low, high, (low + high + 1) // 2 AS mid, r, c, (b.before - a.before) / (z.before - a.before)::DOUBLE AS p
              FROM {name}_t AS t JOIN {name}_b AS a ON a.s = t.s AND a.leaf = low JOIN {name}_b AS b ON b.s = t.s AND b.leaf = (low + high + 1) // 2 JOIN {name}_b AS z ON z.s = t.s AND z.leaf = high
              WHERE high - low > 1))))
    ) GROUP BY ALL) CROSS JOIN range(2) y(side)),
{name} AS (SELECT s, low, r, c FROM {name}_t WHERE high - low = 1)"""


def cells_sql(name: str, source: str, stratum: str, cell: list[str], replicates: int, seed: int) -> str:
    """CTEs up to ``name`` (replicate, the columns of ``cell``, n): ``resampled_cells`` of ``source`` (stratum, cell, n)."""
    columns = ", ".join(cell)
    return f"""{name}_l AS (SELECT CAST({stratum} AS VARCHAR) AS s, {columns}, CAST(n AS BIGINT) AS n, row_number() OVER (PARTITION BY {stratum} ORDER BY {columns}) - 1 AS leaf FROM {source} WHERE n > 0),
{tree_sql(name + '_d', name + '_l', replicates, seed)},
{name} AS (SELECT r AS replicate, {columns}, c AS n FROM {name}_d JOIN {name}_l USING (s) WHERE leaf = low AND c > 0)"""


def weights_sql(name: str, source: str, strata: list[str], key: str, replicates: int, seed: int) -> str:
    """CTEs up to ``name``: the columns of ``source``, replicate and w, for the rows that a replicate draws."""
    s = " || '|' || ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in strata)
    bits = bits_sql(f"'{seed}|' || s || '|' || low || '|rows'", "(r::UBIGINT << 32) + t + 1")
    return f"""{name}_r AS (SELECT *, {s} AS s, row_number() OVER (PARTITION BY {s} ORDER BY sha256('{seed}|rank|' || {key})) - 1 AS k FROM {source}),
{name}_p AS (SELECT s, k // {PIECE} AS leaf, count(*) AS n FROM {name}_r GROUP BY ALL),
{tree_sql(name + '_d', name + '_p', replicates, seed)},
{name}_k AS (SELECT s, r, low * {PIECE} + CAST(({bits}::HUGEINT * n) // 4503599627370496 AS BIGINT) AS k, count(*) AS w FROM (SELECT s, low, r, unnest(range(c)) AS t FROM {name}_d) JOIN {name}_p USING (s) WHERE leaf = low GROUP BY ALL),
{name} AS (SELECT x.* EXCLUDE (s, k), y.r AS replicate, y.w FROM {name}_r AS x JOIN {name}_k AS y ON x.s = y.s AND x.k = y.k)"""
