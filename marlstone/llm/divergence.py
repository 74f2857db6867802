"""How far the sources of a language differ in their words.

Tokenising is one ``bytes.translate`` (capitals to small letters, every ASCII byte that is no letter to a blank) and one
``bytes.split``; a ``Counter`` a document gives occurrences and documents of each term. A task adds them up by language and
source in bounded dictionaries, so what is shuffled are sparse counts, never words of documents. One shuffle by (language,
term) gives both the counts of each source and the documents of the language, hence the kept terms.

Every group gives each kept term a smoothed probability, in billionths: ``1 + floor(10^9 (count + SMOOTH) / (N + SMOOTH V))``.
Two sources are compared over all kept terms, absent ones included. Sources and terms are dealt to blocks by hash; a task gets one
block of terms for two blocks of sources as small dense matrices and returns a partial sum for each pair, so no pairs of
rows are made and no term or source meets in one task.

All arithmetic is exact: counts are 64-bit, products are decimals of 38 digits.

Defined cases: null text, lang and source are empty strings, a language and a source like others; a document without terms still
makes its group occur; every row counts as a document, whatever its ``doc_id``; where no term is kept, all pairs have the value 0
and no term is listed; a language with one source has no pairs; texts of any length are split in bounded pieces; bytes above 127
belong to terms as they are; other columns are not read; an empty table gives no row.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Documents of a language that a kept term occurs in, at least; the smoothing count; listed terms of a group.
DOCUMENTS, SMOOTH, TOP = 30, 5, 50
#: Sources and terms of one block; dictionary entries a task holds; bytes of text split at a time.
SOURCES, TERMS, ENTRIES, PIECE = 128, 2048, 400_000, 1 << 24
LOWER = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))
COUNTS = "lang string, source string, term binary, n long, docs long"


def document_counts(text: bytes, piece: int = PIECE) -> Counter:
    """Occurrences of each term of one document."""
    if len(text) <= piece:
        return Counter(text.translate(LOWER).split())
    own, at = Counter(), 0
    plain = text.translate(LOWER)
    while at < len(plain):
        end = plain.find(b" ", at + piece)
        end = len(plain) if end < 0 else end
        own.update(plain[at:end].split())
        at = end
    return own


def term_counts(docs: DataFrame) -> DataFrame:
    """Rows (lang, source, term, n, docs): occurrences and documents, summed up within tasks; a null term counts the group's documents."""

    def run(batches):
        held: dict[tuple, tuple[Counter, Counter, list]] = {}

        def rows():
            for (lang, source), (n, seen, total) in held.items():
                terms = [None, *n]
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * len(terms), type=pa.string()), pa.array([source] * len(terms), type=pa.string()), pa.array(terms, type=pa.binary()),
                    pa.array([0, *n.values()], type=pa.int64()), pa.array([total[0], *map(seen.__getitem__, n)], type=pa.int64()),
                ], names=["lang", "source", "term", "n", "docs"])
            held.clear()

        entries = 0
        for batch in common.slices(batches, "text", PIECE):
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), common.as_bytes(batch.column("text")), strict=True):
                own, (n, seen, total) = document_counts(text), held.setdefault((lang, source), (Counter(), Counter(), [0]))
                before = len(n)
                n.update(own)
                seen.update(own.keys())
                total[0] += 1
                entries += 1 + len(n) - before
                if entries > ENTRIES:
                    yield from rows()
                    entries = 0
        yield from rows()

    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    return docs.select(*named).mapInArrow(run, COUNTS).withColumn("term", F.col("term").cast("string"))


def kept_counts(docs: DataFrame, documents: int = DOCUMENTS) -> DataFrame:
    """Rows (lang, source, term, n, lang_n) of the kept terms, and one of each group with a null term.

    All rows of a term of a language are dealt to one task, already summed up by source in the tasks before."""
    dealt = term_counts(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    found = dealt.withColumns({"lang_n": F.sum("n").over(term), "lang_docs": F.sum("docs").over(term)})
    return found.where(F.col("term").isNull() | (F.col("lang_docs") >= documents)).select("lang", "source", "term", "n", "lang_n")


def _share(n, total, terms, smooth: int):
    """The smoothed probability, in billionths."""
    return F.lit(1) + F.call_function("div", (n + smooth).cast("decimal(20,0)") * F.lit(10**9).cast("decimal(10,0)"), (total + terms * smooth).cast("decimal(20,0)"))


def _languages(kept: DataFrame) -> DataFrame:
    """Rows (lang, terms, lang_total, sources)."""
    terms = kept.where("term IS NOT NULL").groupBy("lang", "term").agg(F.first("lang_n").alias("n")).groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("lang_total"))
    groups = kept.where("term IS NULL").groupBy("lang").agg(F.count("*").alias("sources"))
    return groups.join(terms, "lang", "left").fillna(0, ["terms", "lang_total"])


def shares(kept: DataFrame, smooth: int = SMOOTH) -> DataFrame:
    """``kept`` rows with ``p``, the group's probability of the term, ``q``, the language's, and ``p0``, the group's of a term it lacks.

    The join with (lang, source) totals has one row per group on its right side; Spark splits a hot group's left rows."""
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total")).join(_languages(kept), "lang")
    t = common.written(totals.withColumn("p0", F.when(F.col("terms") > 0, _share(F.lit(0), F.col("total"), F.col("terms"), smooth)).otherwise(0)), "totals")
    found = kept.join(t, ["lang", "source"])
    return found.select(
        "lang", "source", "term", "n", "terms", "sources", "p0",
        F.when(F.col("term").isNotNull(), _share(F.col("n"), F.col("total"), F.col("terms"), smooth)).alias("p"),
        F.when(F.col("term").isNotNull(), _share(F.col("lang_n"), F.col("lang_total"), F.col("terms"), smooth)).alias("q"),
    )


def _tile(part):
    """Partial sums of one block of terms for the pairs of two blocks of sources."""
    first, block = part["first"].to_numpy(), part["terms_block"].to_numpy()[0] == 0
    head = part["term"].isna().to_numpy()
    sides = []
    for side in (True, False):
        own = part[(first == side) & head].sort_values("source")
        sides.append((own["source"].to_numpy(), own["p0"].to_numpy(dtype=np.int64), {s: k for k, s in enumerate(own["source"])}))
    columns = {t: k for k, t in enumerate(part.loc[~head, "term"].unique())}
    dense = []
    for side, (names, p0, row_of) in zip((True, False), sides, strict=True):
        cells = np.repeat(p0[:, None], len(columns), axis=1)
        own = part[(first == side) & ~head]
        cells[own["source"].map(row_of).to_numpy(dtype=np.int64), own["term"].map(columns).to_numpy(dtype=np.int64)] = own["p"].to_numpy(dtype=np.int64)
        dense.append(cells)
    (left, left_p0, _), (right, right_p0, _) = sides
    # terms that neither block has differ by as much as the probabilities of absent terms; the first block of terms adds them
    rest = (int(part["terms"].iloc[0]) if block else 0) - len(columns)
    out = []
    for k, name in enumerate(left):
        value = np.abs(dense[1] - dense[0][k]).sum(axis=1) + rest * np.abs(right_p0 - left_p0[k])
        other = right != name
        out.append((np.repeat(name, other.sum()), right[other], value[other]))
    names, items, values = (np.concatenate(x) if out else [] for x in (zip(*out) if out else ([], [], [])))
    return names, items, values


def pair_values(shared: DataFrame) -> DataFrame:
    """Rows (lang, source, item, value): the distance of every two sources of a language."""
    import pandas as pd

    def run(part):
        names, items, values = _tile(part)
        return pd.DataFrame({"lang": part["lang"].iloc[0], "source": names, "item": items, "value": np.asarray(values, dtype=np.int64)})

    blocks = {"s_blocks": F.ceil(F.col("sources") / SOURCES).cast("int"), "t_blocks": F.greatest(F.ceil(F.col("terms") / TERMS).cast("int"), F.lit(1))}
    rows = shared.withColumns(blocks).withColumn("own", F.pmod(F.xxhash64("source"), F.col("s_blocks")).cast("int"))
    # a term's rows belong to its block, a group's own row to all of them
    block = F.when(F.col("term").isNull(), F.sequence(F.lit(0), F.col("t_blocks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("term"), F.col("t_blocks")).cast("int")))
    rows = rows.withColumn("terms_block", F.explode(block))
    others = F.explode(F.sequence(F.lit(0), F.col("s_blocks") - 1))
    keep = ["lang", "terms_block", "source", "term", "terms", "p0", "p"]
    left = rows.select(*keep, F.lit(True).alias("first"), F.col("own").alias("a"), others.alias("b"))
    right = rows.select(*keep, F.lit(False).alias("first"), others.alias("a"), F.col("own").alias("b"))
    parts = left.unionByName(right).groupBy("lang", "terms_block", "a", "b").applyInPandas(run, "lang string, source string, item string, value long")
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def term_values(shared: DataFrame) -> DataFrame:
    """Rows (lang, source, item, value): terms that a source has more of than its language."""
    return shared.where("n > 0 AND p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))


def audit(docs: DataFrame, documents: int = DOCUMENTS, smooth: int = SMOOTH, top: int = TOP) -> DataFrame:
    """Rows (lang, source, part, item, value, rank): ``pair`` rows of all other sources, ``term`` rows of the ``top`` terms."""
    shared = common.written(shares(common.written(kept_counts(docs, documents), "kept"), smooth), "shares")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = pair_values(shared).withColumn("rank", rank).withColumn("part", F.lit("pair"))
    terms = term_values(shared).withColumn("rank", rank).where(F.col("rank") <= top).withColumn("part", F.lit("term"))
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", "rank")


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT k, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT k) AS docs FROM w GROUP BY ALL),
kept AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM c GROUP BY ALL HAVING sum(docs) >= {DOCUMENTS}),
l AS (SELECT lang, count(*)::HUGEINT AS v, sum(n) AS total FROM kept GROUP BY lang),
g AS (SELECT lang, source, sum(coalesce(c.n, 0))::HUGEINT AS total FROM (SELECT DISTINCT lang, source FROM d) AS d
      LEFT JOIN (SELECT c.* FROM c JOIN kept USING (lang, term)) AS c USING (lang, source) GROUP BY ALL),
p AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + {SMOOTH})::HUGEINT) // (g.total + {SMOOTH} * l.v) AS p,
             1 + (1000000000 * (kept.n + {SMOOTH})) // (l.total + {SMOOTH} * l.v) AS q
      FROM g JOIN l USING (lang) JOIN kept USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce((SELECT sum(abs(x.p - y.p)) FROM p AS x JOIN p AS y ON x.lang = y.lang AND x.term = y.term
             WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS value
          FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source),
f AS (SELECT lang, source, 'pair' AS part, item, value::BIGINT AS value FROM pairs
      UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM f)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= {TOP}
"""
