"""Registered queries against their SQL, and the pipeline against brute force stage by stage."""

import os
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marlstone.llm import decontamination, packing, queries
from tests.llm.test_llm_operators import ids_of, plain_lines, plain_shingles, plain_words, smallest_reachable

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_is_its_oracle(spark, db, name):
    df = queries.QUERIES[name](spark, DATA)
    want = db.sql(f"SELECT {', '.join(df.columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert Counter(map(tuple, df.collect())) == Counter(want)


def test_pipeline_stages_are_brute_force(spark, db):
    rows = db.sql("SELECT doc_id, text, lang, source, n_chars FROM documents ORDER BY doc_id").fetchall()
    extra = [(10_000, None, "en", "s", 0), (10_001, "12 34 !!", "en", "s", 8)]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "lines", "near_copies", "benchmark", "packing"]
    take = lambda df: {r.doc_id: r.text for r in df.collect()}

    kept = stages["language"](spark, docs, DATA)
    assert kept.columns == docs.columns and set(take(kept)) == {r[0] for r in rows}

    lines = stages["lines"](spark, kept, DATA)
    got = take(lines)
    assert lines.columns == docs.columns and got == {i: t for i, t, _, _ in plain_lines([(r[0], r[1]) for r in rows])}
    assert lines.where("n_chars != length(text)").count() == 0

    near = stages["near_copies"](spark, lines, DATA)
    sets = {i: plain_shingles(t) for i, t in got.items()}
    close = [(i, j) for i, a in sets.items() for j, b in sets.items() if i < j and len(a & b) * 5 >= 4 * len(a | b)]
    assert near.columns == docs.columns and set(take(near)) == set(smallest_reachable(sorted(sets), close).values())

    clean = stages["benchmark"](spark, near, DATA)
    windows = set()
    for (t,) in db.sql("SELECT text FROM benchmark").fetchall():
        own = plain_words(t)
        windows |= {tuple(own[k : k + decontamination.WINDOW]) for k in range(max(0, len(own) - decontamination.WINDOW) + 1 if own else 0)}
    left, sizes = take(near), {len(w) for w in windows}
    for i, t in list(left.items()):
        own, hit = plain_words(t), set()
        for n in sizes:
            for k in range(len(own) - n + 1):
                if tuple(own[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
        if hit and 20 * len(hit) >= len(own):
            del left[i]
    assert clean.columns == docs.columns and take(clean) == left

    pieces = packing.pack(clean, queries.vocabulary()).select("doc_id", "start", "ids").collect()
    ids = defaultdict(bytes)
    for r in sorted(pieces, key=lambda r: (r.doc_id, r.start)):
        ids[r.doc_id] += r.ids
    assert {i: [int.from_bytes(x[k : k + 4], "little") for k in range(0, len(x), 4)] for i, x in ids.items()} == {i: ids_of(t) for i, t in left.items()}
    out = stages["packing"](spark, clean, DATA)
    assert out.agg(F.sum("length")).first()[0] == sum(len(x) // 4 for x in ids.values())
