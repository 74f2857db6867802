"""The training-data operators against brute force, and on odd rows."""

import hashlib
import math
import random
import re
import time
import weakref
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import blobs, components, decontamination, huffman, language_id, line_dedup, media, near_copies, packing, simhash, substrings, token_files, tokens, urls, warc
from marlstone.llm.queries import vocabulary

DOCS = "doc_id long, text string, lang string, source string, n_chars long, words string, fp long, matches string, chunk int, runs string, kept string"
VOCABULARY = vocabulary()


def words(n, seed):
    own = random.Random(seed)
    return " ".join(own.choice(["the", "ring", "thon", "Stair", "élan", "über,", "of", "and.", "2024", "don't", "niño", "x%%%"]) + own.choice(["", "s", "ing", "ed"]) for _ in range(n))


def odd_texts():
    """Nulls, empties, ties, repeats, copies and a very long text; ids with a null and repeats."""
    passage = words(60, 1)
    long = "\n".join(words(9, 100 + k) for k in range(3000))
    return [
        (1, passage), (2, None), (3, ""), (4, "   \n\t "), (5, words(30, 2) + " " + passage), (6, words(200, 3)), (7, words(200, 3)), (7, words(200, 3)), (8, "one"), (9, "One"),
        (None, passage), (None, None), (10, long), (11, long[:5000]), (12, "<|endoftext|> Ünïcode İ Σας ß 漢字 \x1c q"), (13, "!!! 123 ..."), (14, "\n".join(["same line here"] * 40)), (15, words(13, 4)), (16, words(13, 4) + " more"), (17, "x" * 5000),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", len(t or ""), "w", 1, "m", 2, "r", "k") for i, t in odd_texts()]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def ids_of(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY).encode(text or "", add_special_tokens=False).ids + [2]


# packing


def test_word_encoder_is_the_plain_tokenizer():
    encoder = tokens.WordEncoder(VOCABULARY, remembered=50)
    texts = [t or "" for _, t in odd_texts()] + [words(100, k) for k in range(5)]
    for _ in range(2):
        ids, counts = encoder.encode([t.encode() for t in texts])
        end = 0
        for text, n in zip(texts, counts, strict=True):
            assert ids[end : end + n].tolist() == ids_of(text)[:-1]
            end += n


@pytest.mark.parametrize("capacity,window", [(4096, 2_000_000), (64, 500)])
def test_packing_places_every_id_once(docs, capacity, window):
    rows = packing.pack(docs, VOCABULARY, capacity, window_tokens=window).collect()
    sequences, pieces, padding = defaultdict(list), defaultdict(list), 0
    for r in rows:
        assert len(r.ids) == 4 * r.length and r.length > 0
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id, r.doc_tokens].append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    for own in sequences.values():
        end = 0
        for offset, n in sorted(own):
            assert offset == end
            end += n
        assert end <= capacity
        padding += 0 if end & (end - 1) == 0 else capacity - end
    assert padding <= packing.OPEN_SLACK * len(sequences)
    want = Counter((i, tuple(ids_of(t))) for i, t in odd_texts())
    got = Counter()
    for (i, n), own in pieces.items():
        starts = Counter(s for s, _ in own)
        copies = starts[0]
        flat = sorted(own)
        for c in range(copies):
            got[i, tuple(x for _, ids in flat[c::copies] for x in ids)] += 1 if copies == 1 else 0
        if copies > 1:
            assert sum(len(x) for _, x in own) == copies * n
    assert all(want[k] == 1 for k in got if got[k] and k[0] not in (7, None))


def test_best_fill_is_the_best():
    rng = random.Random(5)
    for _ in range(200):
        counts = Counter(rng.randint(1, 12) for _ in range(rng.randint(1, 7)))
        room = rng.randint(0, 40)
        sums = {0}
        for x in counts.elements():
            sums |= {s + x for s in sums if s + x <= room}
        chosen = packing.best_fill(sorted(counts), dict(counts), room)
        assert sum(chosen) == max(sums) and not Counter(chosen) - counts


def test_minimum_bin_slack_uses_each_once():
    rng = random.Random(6)
    lengths = [rng.randint(1, 20) for _ in range(300)]
    bins = packing.minimum_bin_slack(lengths, 50)
    assert sorted(k for b in bins for k in b) == list(range(300)) and all(sum(lengths[k] for k in b) <= 50 for b in bins)
    assert len(bins) <= -(-sum(lengths) // 50) + 1


# token files


def test_code_lengths_are_optimal_and_limited():
    rng = np.random.default_rng(1)
    for counts, most in ((rng.integers(0, 100, 40), 16), (2 ** np.arange(20), 8), (np.array([0, 5, 0]), 16), (np.zeros(4), 16)):
        lengths = huffman.code_lengths(counts, most)
        assert ((lengths > 0) == (np.asarray(counts) > 0)).all() and lengths.max(initial=0) <= most
        assert sum(0.5 ** int(n) for n in lengths if n) <= 1
    import heapq

    counts = rng.integers(1, 1000, 60)
    heap, total = counts.tolist(), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        x = heapq.heappop(heap) + heapq.heappop(heap)
        total += x
        heapq.heappush(heap, x)
    assert int((counts * huffman.code_lengths(counts, 30)).sum()) == total


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 5000])
def test_huffman_round_trip(n):
    symbols = np.random.default_rng(n).geometric(0.05, n) % 300
    lengths = huffman.code_lengths(np.bincount(symbols, minlength=300))
    data, checkpoints, _ = huffman.encode(symbols, lengths, huffman.canonical_codes(lengths), 64)
    assert (huffman.decode(data, checkpoints, n, huffman.decoding_table(lengths), 64) == symbols).all()


def test_token_files_round_trip(docs, none, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_IDS", 500)
    rows = token_files.read_token_files(token_files.write_token_files(docs, VOCABULARY)).collect()
    want = sorted(((i is not None, i or 0, len(x), x) for i, t in odd_texts() for x in [ids_of(t)]), key=lambda x: x[:3])
    rows.sort(key=lambda r: r.start)
    assert [(r.doc_id is not None, r.doc_id or 0, r.n_tokens) for r in rows] == [x[:3] for x in want]
    assert Counter(r.ids for r in rows) == Counter(np.array(x[3], "<u4").tobytes() for x in want)
    assert [r.start for r in rows] == np.cumsum([0] + [x[2] for x in want])[:-1].tolist()
    assert token_files.read_token_files(token_files.write_token_files(none, VOCABULARY)).count() == 0


# SimHash


def plain_fingerprint(text):
    import xxhash

    own = (text or "").encode().lower().split()
    shingles = [b" ".join(own[k : k + 3]) for k in range(len(own) - 2)] if len(own) >= 3 else [b" ".join(own)] * bool(own)
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def smallest_reachable(nodes, pairs):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def test_near_duplicates_are_those_of_all_pairs(docs, none):
    rows = simhash.near_duplicates(docs).collect()
    marks = [(i, plain_fingerprint(t)) for i, t in odd_texts()]
    nodes = sorted({f for _, f in marks})
    roots = smallest_reachable(nodes, [(a, b) for a in nodes for b in nodes if (a ^ b).bit_count() <= 2])
    least = defaultdict(list)
    for i, f in marks:
        if i is not None:
            least[roots[f]].append(i)
    assert Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in rows) == Counter((i, f, min(least[roots[f]], default=None)) for i, f in marks)
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert {7, 6} & set(ids) == {6} and set(ids) == {min(x) for x in least.values()}


@pytest.mark.parametrize("operator", [simhash, near_copies])
def test_near_duplicates_judge_rows_not_ids(spark, operator):
    a, b, c = words(60, 1), words(60, 2), words(60, 3)
    rows = [(1, a, 1), (5, a, 2), (5, b, 3), (None, a, 4), (None, c, 5), (7, None, 6), (8, "", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `a.b` long").withColumn("__gone", F.lit(1)).withColumn("digest", F.lit(2)).withColumn("fp", F.lit(2))
    kept = operator.deduplicated(df)
    assert kept.schema == df.schema and sorted(r["a.b"] for r in kept.collect()) == [1, 3, 5, 6]


def test_tree_finds_all_close_pairs(spark):
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 1500, dtype=np.uint64)
    near = base ^ (np.uint64(1) << rng.integers(0, 64, 1500).astype(np.uint64))
    hot = base[0] ^ (np.uint64(1) << np.arange(64, dtype=np.uint64))
    points = np.unique(np.concatenate([base, near, hot]))
    i, j = np.nonzero(np.bitwise_count(points[:, None] ^ points[None, :]) <= 2)
    want = {(a, b) for a, b in zip(i.tolist(), j.tolist(), strict=True) if a < b}
    assert set(zip(*(x.tolist() for x in simhash.close_pairs(points, 2)), strict=True)) == want
    signed = points.view(np.int64).tolist()
    roots = smallest_reachable(signed, [(signed[a], signed[b]) for a, b in want])
    for tree_levels in (14, 2):
        links = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), 2, shard=200, tree_levels=tree_levels)
        found = {r.node: r.root for r in components.components(links).collect()}
        assert {x: found.get(x, x) for x in signed} == roots


def test_components_of_paths_and_stars(spark):
    pairs = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(200, 200), (None, 3)] + [(100, 101)]
    found = {r.node: r.root for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert found == {k: 0 for k in range(1, 41)} | {100 + k: 100 for k in range(1, 30)}


# decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def benchmark_rows():
    passage = words(60, 1)
    return [(1, passage[20:200]), (2, words(13, 4)), (3, "ring thons"), (4, None), (5, ""), (6, words(50, 3)), (6, words(50, 3)), (None, words(20, 2)), (7, "!!"), (8, words(5, 9))]


@pytest.mark.parametrize("block", [8_000_000, 120])
def test_decontamination_is_brute_force(spark, docs, none, block, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_CHARS", block)
    bench = spark.createDataFrame(benchmark_rows(), "item_id long, text string")
    rows = decontamination.judged(decontamination.find_matches(docs, bench)).collect()
    windows = defaultdict(set)
    for i, t in benchmark_rows():
        own = plain_words(t)
        for k in range(max(0, len(own) - 13) + 1 if own else 0):
            windows[tuple(own[k : k + 13])].add(i)
    want = Counter()
    for i, t in odd_texts():
        own, hit, items = plain_words(t), set(), set()
        for w, at in windows.items():
            for k in range(len(own) - len(w) + 1):
                if tuple(own[k : k + len(w)]) == w:
                    hit |= set(range(k, k + len(w)))
                    items |= at
        want[i, len(own), len(hit), tuple(sorted(str(x) for x in items if x is not None)), bool(hit) and 20 * len(hit) >= len(own)] += 1
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in rows) == want
    assert decontamination.find_matches(none, bench).count() == 0
    assert decontamination.find_matches(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    kept = decontamination.decontaminated(docs, bench)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in rows if not r.contaminated)


def test_decontamination_judges_rows_not_ids(spark):
    bench = spark.createDataFrame(benchmark_rows(), "item_id long, text string")
    hit, clean = words(60, 1), words(60, 77)
    rows = [(5, hit, 1, 1), (5, clean, 2, 2), (None, hit, 3, 3), (None, clean, 4, 4), (6, None, 5, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __gone long, `a.b` long")
    kept = decontamination.decontaminated(df, bench)
    assert kept.schema == df.schema and sorted(r["a.b"] for r in kept.collect()) == [2, 4, 5]
    assert "Exchange" not in kept._jdf.queryExecution().executedPlan().toString()


def test_suffix_array_is_sorted_to_full_depth():
    rng = random.Random(1)
    for _ in range(30):
        text = [rng.choice([0, 1, 1, 2, 3]) for _ in range(rng.randint(0, 80))] + [1, 1, 2] * rng.randint(0, 20) + [0]
        ends, keyed = sum(x == 0 for x in text), []
        for k, x in enumerate(text):
            keyed.append(sum(y == 0 for y in text[:k]) if x == 0 else ends + x)
        assert decontamination.suffix_array(np.array(text)).tolist() == sorted(range(len(text)), key=lambda k: keyed[k:])


@pytest.mark.parametrize("segment", [1 << 21, 40])
def test_longest_matches_are_longest(segment, monkeypatch):
    monkeypatch.setattr(decontamination, "SEGMENT_WORDS", segment)
    own = decontamination._Judged([b"x two three four five y one two three z five six seven", b"", b"two three four"], 3)
    own.ask(decontamination.Block([("a", b"one two three four five six seven"), ("b", b"three FOUR")], 3))
    found = [{(m["item_id"], m["item_start"], m["doc_start"], m["n_words"]) for m in x} for x in own.matches().to_pylist()]
    # the suffix from "two" matches four words in the first document; three of them, in the last one, are not its longest
    assert found[0] == {("a", 0, 6, 3), ("a", 1, 1, 4), ("a", 4, 10, 3), ("b", 0, 2, 2)} and found[1] == [] or found[1] == set()
    assert {x for x in found[2]} == {("b", 0, 1, 2)}
    assert own.hits().tolist() == [10, 0, 3] and [sorted(x) for x in own.items] == [["a", "b"], [], ["a", "b"]]
    rng = random.Random(segment)
    for _ in range(20):
        texts, items = [[" ".join(rng.choices("abc", k=rng.randint(0, 60))).encode() for _ in range(n)] for n in (4, 5)]
        own = decontamination._Judged(texts, 4)
        own.ask(decontamination.Block(list(enumerate(items)), 4))
        for doc, text in enumerate(texts):
            row, hit, found = text.split(), set(), set()
            for k, item in enumerate(items):
                wanted = item.split()
                for at in range(max(0, len(wanted) - 4) + 1 if wanted else 0):
                    window = wanted[at : at + 4]
                    for p in range(len(row) - len(window) + 1):
                        if row[p : p + len(window)] == window:
                            hit |= set(range(p, p + len(window)))
                            found.add(k)
            assert own.hits()[doc] == len(hit) and own.items[doc] == found
            for m in own.matches().to_pylist()[doc]:
                assert row[m["doc_start"] : m["doc_start"] + m["n_words"]] == items[int(m["item_id"])].split()[m["item_start"] : m["item_start"] + m["n_words"]]
            if segment > 1000:  # the longest match of any item and this document is reported if no other document has a longer one
                for k, item in enumerate(items):
                    best = max((m["n_words"] for x in own.matches().to_pylist() for m in x if m["item_id"] == str(k)), default=0)
                    wanted = item.split()
                    assert best == max((n for n in range(min(4, len(wanted)), len(wanted) + 1) if n and any(wanted[a : a + n] == x.split()[p : p + n] for x in texts for a in range(len(wanted) - n + 1) for p in range(len(x.split()) - n + 1))), default=0)


def test_a_repeated_word_costs_no_pairs():
    import tracemalloc

    text, item = b"a " * 100_000, b"a " * 5_000
    tracemalloc.start()
    own = decontamination._Judged([text], 13)
    own.ask(decontamination.Block([("i", item)], 13))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert own.hits().tolist() == [100_000] and own.items == [{"i"}] and [(m["item_start"], m["n_words"]) for m in own.matches().to_pylist()[0]] == [(0, 5000)]
    assert most < 300e6


@pytest.mark.parametrize("tail", [b"", b" b%d c%d"])
def test_many_items_that_share_words_cost_no_pairs(tail):
    import tracemalloc

    text = b"a " * 100_000 + b"x"
    items = [(f"i{k:04d}", b"a " * (13 + k % 200) + (tail % (k, k) if tail else b"")) for k in range(5_000)]
    tracemalloc.start()
    own = decontamination._Judged([text, b"a " * 13, b"none"], 13)
    own.ask(decontamination.Block(items, 13))
    found = own.matches()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert own.hits().tolist() == [100_000, 13, 0] and [len(x) for x in own.items] == [5_000, 5_000, 0]
    # about one match an item, not one an item and place
    assert 5_000 <= len(found[0]) <= 10_000 and len(found[2]) == 0 and {m["n_words"].as_py() for m in found[1]} <= {13}
    assert most < 500e6


def test_a_very_long_run_of_letters_is_learnt_in_bounded_time(spark):
    rows = [(k, " ".join(["the", "ring", "thing"] * 5), "en") for k in range(20)] + [(k, " ".join(["der", "nicht", "und"] * 5), "de") for k in range(20, 40)]
    rows += [(100 + k, "thering" * 30_000, "en") for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert list(language_id._stretches(["ab", "x" * 2500])) == ["ab", "x" * 1024, "x" * 1024, "x" * 452]
    began = time.perf_counter()
    model = language_id.fit(docs, vocabulary("piece_bpe_32k.model"))
    assert time.perf_counter() - began < 60 and model.languages == ["de", "en"]
    found = {r.doc_id: r.lang_pred for r in language_id.identify(spark.createDataFrame([(1, "the thing", None), (2, "und nicht", None)], docs.schema), model).collect()}
    assert found == {1: "en", 2: "de"}


# substring dedup


def plain_substrings(rows, window=13):
    first = {}
    for i, t in rows:
        own = (t or "").encode().split()
        for k in range(len(own) - window + 1):
            if i is not None:
                key = tuple(own[k : k + window])
                first[key] = min(first.get(key, i), i)
    for i, t in rows:
        own, gone = (t or "").encode().split(), set()
        for k in range(len(own) - window + 1):
            if i is not None and first[tuple(own[k : k + window])] < i:
                gone |= set(range(k, k + window))
        yield i, len(own), len(gone), b" ".join(w for k, w in enumerate(own) if k not in gone).decode()


@pytest.mark.parametrize("batches,key_bits", [(1, 32), (2, 32), (4, 32), (3, 1)])
def test_substrings_are_brute_force(docs, none, batches, key_bits):
    rows = substrings.substring_deduplicated(docs, batches=batches, fan_in=2, key_bits=key_bits).collect()
    assert Counter(map(tuple, rows)) == Counter(plain_substrings(odd_texts()))
    assert substrings.substring_deduplicated(none, batches=batches).count() == 0


@pytest.mark.parametrize("key_bits", [32, 0])
def test_colliding_keys_remove_and_hide_nothing(spark, key_bits):
    """With keys of no bits all windows of a bucket collide; only equal words count, over all batches."""
    texts = [(k, words(30, 900 + k % 11) + " " + words(20, 1000 + k % 5)) for k in range(40)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    rows = substrings.substring_deduplicated(df, batches=4, fan_in=1, key_bits=key_bits).collect()
    assert Counter(map(tuple, rows)) == Counter(plain_substrings(texts))


def test_substrings_of_equal_ids_and_other_texts(spark):
    a, b = words(40, 1), words(40, 2)
    rows = [(1, a), (5, a), (5, b), (5, "x " + a), (9, b), (None, a)]
    found = substrings.substring_deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(map(tuple, found)) == Counter(plain_substrings(rows))


def test_substring_index_is_incremental_and_compacts(spark, tmp_path):
    texts = [(k, words(40, 50 + k % 7)) for k in range(30)]
    folder, runs, found = "file://" + str(tmp_path), None, None
    every = spark.createDataFrame(texts, "doc_id long, text string")
    for k in range(5):
        steps, runs = substrings.ingest(every.where(f"doc_id div 6 = {k}"), runs, 128, 17, folder)
        found = steps if found is None else found.unionByName(steps)
        if k == 2:
            runs = substrings.compact(runs, folder, fan_in=1)
    assert Counter(map(tuple, substrings.without_matches(every, found, 128, 17).collect())) == Counter(plain_substrings(texts))
    before = runs.groupBy("bucket").count().agg(F.max("count")).first()[0]
    files = len(list(tmp_path.iterdir()))
    small = substrings.compact(runs, folder, fan_in=1)
    assert before > 1 and small.groupBy("bucket").count().agg(F.max("count")).first()[0] == 1
    assert len(list(tmp_path.iterdir())) == small.count() < files
    keys = {(r.bucket, k) for r in small.collect() for k in (substrings.read_run(r.path) >> np.uint64(32)).tolist()}
    assert len(keys) == len({tuple(t.split()[k : k + 13]) for _, t in texts for k in range(28)})


def test_the_query_leaves_an_index_of_all_documents(spark, tmp_path):
    texts = [(k, words(40, 50 + k % 7)) for k in range(30)]
    folder = "file://" + str(tmp_path)
    substrings.substring_deduplicated(spark.createDataFrame(texts, "doc_id long, text string"), batches=5, fan_in=2, folder=folder).count()
    keys = {int(p.name.split("-")[0]): set() for p in tmp_path.iterdir()}
    for p in tmp_path.iterdir():
        keys[int(p.name.split("-")[0])] |= set((substrings.read_run("file://" + str(p)) >> np.uint64(32)).tolist())
    assert sum(map(len, keys.values())) == len({tuple(t.split()[k : k + 13]) for _, t in texts for k in range(28)})
    assert max(Counter(p.name.split("-")[0] for p in tmp_path.iterdir()).values()) <= 3


# line dedup


def plain_lines(rows, window=4, long=8, reach=8):
    """(doc_id, text, n_lines, n_removed) of each row: windows of an earlier place, and what surrounds long lines as it does at their first place."""
    docs, first, seen, gone = {}, {}, {}, {}
    for i, t in sorted({(i, t or "") for i, t in rows}, key=lambda r: (r[0] is None, r[0] or 0)):
        docs[i, t] = [line.strip(" \t\r\v\f") for line in t.split("\n") if line.strip(" \t\r\v\f")]
    for key, lines in docs.items():
        gone[key] = set()
        for k, line in enumerate(lines):
            own = tuple(lines[k : k + window])
            if len(own) == window and seen.setdefault(own, (key, k)) != (key, k):
                gone[key] |= set(range(k, k + window))
            if len(re.findall("[^ \t-\r]+", line)) < long:
                continue
            other, j = first.setdefault(line, (key, k))
            if (other, j) == (key, k):
                continue
            back = ahead = 0
            while back < reach and min(k, j) - back > 0 and lines[k - back - 1] == docs[other][j - back - 1]:
                back += 1
            while ahead < reach and k + ahead + 1 < len(lines) and j + ahead + 1 < len(docs[other]) and lines[k + ahead + 1] == docs[other][j + ahead + 1]:
                ahead += 1
            gone[key] |= set(range(k - back, k + ahead + 1))
    out = []
    for i, t in rows:
        kept, k = [], -1
        for line in (t or "").split("\n"):
            k += bool(line.strip(" \t\r\v\f"))
            if not (line.strip(" \t\r\v\f") and k in gone[i, t or ""]):
                kept.append(line)
        text = "\n".join(kept) if gone[i, t or ""] else t
        out.append((i, text, len(docs[i, t or ""]), len(gone[i, t or ""])))
    return out


def line_rows():
    rng = random.Random(4)
    short = ["a b", "c", "d e f", "g", "h i", "j k", "l"]
    lines = [words(9, k) for k in range(6)] + short
    rows = [(k, "\n".join(rng.choice([*lines, "", words(3, 500 + 7 * k + j), words(11, 900 + 7 * k + j)]) for j in range(rng.randint(1, 14)))) for k in range(60)]
    run = "\n".join(short)
    return rows + [(100, f"x y\n{run}\nz"), (101, f"q\n{run}\nr s"), (102, "c\nd e f"), (103, "\n".join(f"n{k}" for k in range(40))), (104, "k\n" + "\n".join(f"n{k}" for k in range(40)) + "\nm")]


def test_line_dedup_is_brute_force(spark, docs, none):
    for rows, df in ((odd_texts(), docs), (line_rows(), spark.createDataFrame(line_rows(), "doc_id long, text string").repartition(4))):
        found = line_dedup.deduplicated(df, counts=True)
        assert found.columns == [*df.columns, "n_lines", "n_removed"]
        assert Counter((r.doc_id, r.text, r.n_lines, r.n_removed) for r in found.collect()) == Counter(plain_lines(rows))
    assert line_dedup.deduplicated(none).count() == 0
    found = {r.doc_id: r for r in line_dedup.deduplicated(df, counts=True).collect()}
    assert found[101].n_removed == 7 and found[104].n_removed == 40 and found[102].n_removed == 0 and found[100].text.startswith("x y")


def test_line_dedup_takes_columns_of_any_name_and_rows_of_any_id(spark):
    a, b = "\n".join(words(9, k) for k in range(3)), "\n".join(words(9, 50 + k) for k in range(3))
    rows = [(1, a, 1), (5, a, 2), (5, b, 3), (5, b, 4), (None, b, 5), (None, None, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `a.b` long")
    for name in ("__runs", "digest", "n_lines", "c2", "fp"):
        df = df.withColumn(name, F.lit(7))
    kept = line_dedup.deduplicated(df)
    assert kept.schema == df.schema and {r["a.b"]: r.text for r in kept.collect()} == {1: a, 2: "", 3: b, 4: b, 5: "", 6: None}


def test_line_dedup_goes_through_its_fingerprints(spark, monkeypatch):
    """What is joined are the chosen places only: fewer than there are lines, and without them runs of short lines stay."""
    rows = [(k, "\n".join(f"{x} {(k if k > 1 else 0) * 50 + j}" for j, x in enumerate("abcdefghij" * 4))) for k in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lines = line_dedup._lines(df, 8)
    n = line_dedup._fingerprints(lines, 4).count()
    assert 8 * 40 / 4 <= n < 8 * 40 * 0.6
    removed = lambda: {r.doc_id: r.n_removed for r in line_dedup.deduplicated(df, counts=True).collect()}
    assert removed() == {0: 0, 1: 40} | dict.fromkeys(range(2, 8), 0)
    original = line_dedup._fingerprints
    monkeypatch.setattr(line_dedup, "_fingerprints", lambda lines, window: original(lines, window).limit(0))
    assert not any(removed().values())


def test_winnowing_shares_a_fingerprint_of_equal_runs():
    rng = np.random.default_rng(3)
    run = rng.integers(0, 2**63, 6, dtype=np.uint64)
    for _ in range(50):
        a, b = (np.concatenate([rng.integers(0, 2**63, rng.integers(0, 9), dtype=np.uint64), run, rng.integers(0, 2**63, rng.integers(0, 9), dtype=np.uint64)]) for _ in range(2))
        assert {int(a[k]) for k in line_dedup.winnow(a, 6)} & {int(b[k]) for k in line_dedup.winnow(b, 6)} & set(run.tolist())


# language


def test_forward_sums_all_segmentations():
    pieces = ["a", "ab", "b", "ba", "▁", "▁a"]
    probs = np.concatenate([np.random.default_rng(0).dirichlet(np.ones(6), 2).T, [[1e-8, 1e-8], [0, 0]]])

    def brute(word, lang):
        if not word:
            return 1.0
        return sum((probs[pieces.index(word[:k]), lang] if word[:k] in pieces else 1e-8 if k == 1 else 0) * brute(word[k:], lang) for k in range(1, len(word) + 1))

    own = language_id.Pieces(pieces)
    for word in ["▁abab", "▁bca", "▁a", "▁", "漢漢"]:
        spans = own.spans([word])
        (alpha, up), (beta, down) = language_id.forward(spans, probs), language_id.backward(spans, probs)
        assert np.allclose(alpha[-1][0], [brute(word, 0), brute(word, 1)]) and np.allclose(beta[0], alpha[-1]) and not up.any() and not down.any()


def exact_log(word, pieces, probs, lang):
    from fractions import Fraction

    sums = [Fraction(1)]
    for end in range(1, len(word) + 1):
        ways = [(sums[end - k], word[end - k : end]) for k in range(1, end + 1)]
        sums.append(sum(x * Fraction(float(probs[pieces.index(w), lang] if w in pieces else 1e-8 if len(w) == 1 else 0)) for x, w in ways))
    return math.log(sums[-1].numerator) - math.log(sums[-1].denominator)


def test_words_of_any_length_keep_all_segmentations(monkeypatch):
    pieces = ["a", "ab", "aba", "b", "ba", "▁", "▁a"]
    probs = np.concatenate([np.random.default_rng(0).dirichlet(np.ones(7), 2).T, [[1e-8, 1e-8], [0, 0]]])
    scorer = language_id.Scorer(language_id.Pieces(pieces), probs)
    monkeypatch.setattr(language_id, "STRETCH", 30)
    found = ["▁" + w for w in ("abba" * 15, "q" * 40, "ab" * 31, "abq" * 50, "qqqa" * 40, "ba" * 15 + "q" * 33)]
    assert np.allclose(scorer.word_logs(found), [[exact_log(w, pieces, probs, lang) for lang in (0, 1)] for w in found])
    for word in found[:3] + found[5:]:  # the raised sums of both passes give one whole posterior
        spans = scorer.pieces.spans([word])
        (alpha, up), (beta, down) = language_id.forward(spans, probs), language_id.backward(spans, probs)
        assert np.allclose(np.log(beta[0]) - down[0] * np.log(language_id.RAISE), np.log(alpha[-1]) - up[-1] * np.log(language_id.RAISE))
    assert np.isfinite(scorer.word_logs(["▁" + "ab" * 50_000])).all()


def test_only_letters_are_letters():
    assert language_id.text_words("½ ² Ⅷ ① 12 _") == [] and language_id.text_words("a²b ½Ça x1y") == ["▁a", "▁b", "▁ça", "▁x", "▁y"]


def test_language_of_whole_texts_is_the_plain_posterior(spark):
    pieces, languages = ["a", "ab", "b", "ba", "▁", "▁a"], ["x", "y"]
    probs = np.concatenate([np.random.default_rng(5).dirichlet(np.ones(6), 2).T, [[1e-8, 1e-8], [0, 0]]])
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choices("abAc", k=rng.randint(1, 9))) for _ in range(rng.randint(1, 12))) for _ in range(40)] + [None, "½", "ab " * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in language_id.identify(df, language_id.Model(pieces, languages, probs)).collect():
        own = language_id.text_words(texts[r.doc_id] or "")
        logs = [sum(exact_log(w, pieces, probs, lang) for w in own) for lang in (0, 1)] if len(own) < 1000 else [3000 * exact_log("▁ab", pieces, probs, lang) for lang in (0, 1)]
        best = int(logs[1] > logs[0])
        want = ("und", 0.0) if not own else (languages[best], 1 / (1 + math.exp(min(700, logs[1 - best] - logs[best]))))
        assert r.lang_pred == want[0] and abs(r.score - want[1]) < 1e-9


def plain_fit(words, pieces, rounds, prior=language_id.PRIOR):
    """EM over all segmentations, written out, for one language: words with counts -> probability of each piece."""

    def all_of(word):
        if not word:
            return [[]]
        return [[k, *rest] for k in range(1, len(word) + 1) if word[:k] in pieces or k == 1 for rest in all_of(word[k:])]

    p = {x: 1 / len(pieces) for x in pieces}
    for _ in range(rounds):
        uses = Counter()
        for word, n in words.items():
            ways = []
            for sizes in all_of(word):
                ends = np.cumsum(sizes)
                own = [word[e - k : e] for e, k in zip(ends, sizes, strict=True)]
                ways.append((math.prod(p.get(w, 1e-8) for w in own), own))
            total = sum(x for x, _ in ways)
            for x, own in ways:
                for w in own:
                    uses[w] += n * x / total
        whole = sum(uses[x] + prior for x in pieces)
        p = {x: (uses[x] + prior) / whole for x in pieces}
    return p


def test_fit_is_plain_expectation_maximisation(spark, monkeypatch):
    pieces = sorted(["a", "ab", "b", "ba", "▁", "▁a"])
    monkeypatch.setattr(language_id, "vocabulary_pieces", lambda path: pieces)
    rows = [(k, " ".join(random.Random(k).choices(["ab", "ba", "aab", "abc", "b"], k=5)), "x" if k % 2 else "y") for k in range(60)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "")
    for lang in "xy":
        counts = Counter(w for k, t, own in rows if own == lang and zlib.crc32(str(k).encode()) % 5 for w in language_id.text_words(t))
        want = plain_fit(counts, pieces, language_id.ROUNDS)
        assert np.allclose(model.probs[:-2, model.languages.index(lang)], [want[x] for x in pieces])


def test_fit_takes_about_as_many_documents_as_stated(spark, monkeypatch):
    vocab = vocabulary("piece_bpe_32k.model")
    df = spark.range(20_000).selectExpr("id AS doc_id", "concat('w', id % 7) AS text", "if(id % 10 = 0, 'b', 'a') AS lang")
    sizes = []
    original = language_id._word_counts
    monkeypatch.setattr(language_id, "_word_counts", lambda labelled: (sizes.append({r.lang: r["count"] for r in labelled.groupBy("lang").count().collect()}), original(labelled))[1])
    language_id.fit(df, vocab, fit_docs=400, rounds=1)
    assert all(300 < sizes[0][lang] < 500 for lang in "ab")


def test_language_identification(spark, docs, none):
    vocab = vocabulary("piece_bpe_32k.model")
    sentences = {"en": "the cat and the other thing that was in this house with them", "de": "der Hund und die Katze sind nicht mehr auf dem großen Haus", "fr": "le chat et les autres choses qui sont dans cette maison pour nous"}
    rng = random.Random(0)
    rows = [(k, " ".join(rng.choices(sentences[lang].split(), k=12)), lang) for k, lang in enumerate(list(sentences) * 40)]
    rows += [(1000, None, "en"), (1001, "123 !!", "en"), (1002, "the cat", None), (None, "und die Katze", "de"), (1003, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df, vocab)
    assert model.languages == ["de", "en", "fr"] and np.allclose(model.probs[:-2].sum(0), 1)
    found = {r.doc_id: r for r in language_id.identify(df, model).collect()}
    assert all(found[k].lang_pred == lang for k, _, lang in rows[:120]) and all(0 <= r.score <= 1 for r in found.values())
    assert [found[k].lang_pred for k in (1000, 1001, 1002, None, 1003)] == ["und", "und", "en", "de", "und"]
    other = [(k, t, "de" if k is None or zlib.crc32(str(k).encode()) % 5 == 0 else lang) for k, t, lang in rows]
    assert np.array_equal(language_id.fit(spark.createDataFrame(other, "doc_id long, text string, lang string"), vocab).probs, model.probs) or np.allclose(language_id.fit(spark.createDataFrame(other, "doc_id long, text string, lang string"), vocab).probs, model.probs)
    assert {r.lang_pred for r in language_id.identify(docs, language_id.fit(none, vocab)).collect()} == {"und"}
    kept = language_id.with_language(df, vocab)
    assert kept.columns == df.columns and Counter(r.doc_id for r in kept.collect()) == Counter(k for k, *_ in rows if k not in (1000, 1001, 1003))
    assert language_id.identify(none, model).count() == 0 and language_id.identify(docs, model).count() == docs.count()


# WARC


def test_archives_round_trip(spark):
    same, short = "<p>" + "x" * 2000, "<p>short"
    rows = [(1, "http://a/1", same, 9), (2, "http://a/ 2\r\nX: y", same, 9), (3, None, same, 9), (4, "u", short, 9), (5, "u", short, 9), (6, "u", None, 9), (7, "u", "", 9), (None, "u", same, 9), (8, "u", "é" * 3_000_000, 9), (9, "u", "\x1f\x8b\x08" * 700, 9), (9, "u", "\x1f\x8b\x08" * 700, 9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload int").repartition(3)
    manifest = warc.write_archives(pages)
    want = Counter()
    for i, _, html, _ in rows:
        body = (html or "").encode()
        peers = [j for j, _, h, _ in rows if (h or "") == (html or "") and j is not None]
        to = max(peers, default=None) if len(body) >= 1000 else None
        revisit = to is not None and i != to
        want[i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", to if revisit else None] += 1
    for n in (100, 4096, 8_000_000):
        got = warc.read_archives(manifest, range_bytes=n, read_bytes=64 if n == 100 else 4096).collect() if n > 100 else warc.read_archives(manifest.where("bytes < 5000"), range_bytes=n, read_bytes=64).collect()
        if n > 100:
            assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
        else:
            assert len(got) == manifest.where("bytes < 5000").agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0]
        assert all(hashlib.sha1(r.payload).hexdigest() == r.payload_digest for r in got if r.record_type == "response")
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0


def test_false_magic_inside_a_member_is_not_a_record(tmp_path):
    path = "file://" + str(tmp_path / "x.warc.gz")
    noise = bytes(np.random.default_rng(0).integers(0, 256, 3000, dtype=np.uint8)) + zlib.compress(b"no", wbits=31) * 3
    packer = zlib.compressobj(0, zlib.DEFLATED, 31)
    one = packer.compress(warc.record(1, "u", noise, "00" * 20, "response", None)) + packer.flush()
    with blobs.create(path) as out:
        out.write(one * 3)
    with blobs.read_at(path) as file:
        size = 3 * len(one)
        assert [sum(1 for _ in warc.Members(file, size, a, a + 500)) for a in range(0, size, 500)] == [sum(a <= k * len(one) < a + 500 for k in range(3)) for a in range(0, size, 500)]


def test_payloads_are_not_shuffled_for_the_decision(spark):
    big = "x" * 3000
    pages = spark.createDataFrame([(k, f"u{k}", big if k % 50 < 2 else "" if k % 3 else big + str(k), "p", 1) for k in range(300)], "page_id long, url string, html string, key string, kept int")
    found = warc.marked(pages)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    rows = {r.page_id: (r.record_type, r.refers_to) for r in found.collect()}
    assert all(rows[k] == (("response", None) if k == 251 or k % 50 > 1 else ("revisit", 251)) for k in range(300))


# URLs


@pytest.mark.parametrize("most", [32_000_000, 40])
def test_url_rules_and_cascade(spark, most, monkeypatch):
    monkeypatch.setattr(urls.build, "__defaults__", (most,))
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow")]
    given = ["http://A.Example.ORG/es/1?x", "https://example.org/en/12", "https://example.org/en/2#t", "http://x.com/fr/", "http://x.com/fr", "ftp://notexample.org?q/es/", "http://bad.net", "http://a.bad.net/x", "http://good.net/", "nothing", "", None, "a://b://c/d", "http://bad.net"]
    given += [f"http://h{k}.example.net/p{k}" for k in range(300)]
    listed = ["bad.net", None, "bad.net", "elsewhere.net"] + [f"h{k}.example.net" for k in range(0, 300, 3)]
    df = spark.createDataFrame([(k, u, "x", 1) for k, u in enumerate(given)], "page_id long, url string, key string, rule_at int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judged(df, spark.createDataFrame(rules, "host string, path string, action string"), spark.createDataFrame([(x,) for x in listed], "host string")).collect()}
    for k, u in enumerate(given):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0].lower()
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        fits = [(len(h + p), h + p, a) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, action = max(fits)[1:] if fits else (None, "block" if any(x and (host == x or host.endswith("." + x)) for x in listed) else "allow")
        assert got[k] == (host, path, rule, action), u
    assert urls.judged(df.limit(0), spark.createDataFrame(rules, "host string, path string, action string"), spark.createDataFrame([], "host string")).count() == 0


def test_long_urls_and_long_lists(spark, monkeypatch):
    dots, deep = "a." * 50_000 + "bad.net", ".".join(f"x{k}" for k in range(9_000)) + ".org"
    given = [f"http://{dots}/p", f"http://{deep}/" + "y" * 100_000, f"http://{deep[3:]}/", "http://" + "." * 100_000, "http://good.net/"]
    df = spark.createDataFrame(list(enumerate(given)), "page_id long, url string")
    rules = spark.createDataFrame([("com", "/fr/", "allow")], "host string, path string, action string")
    began = time.perf_counter()
    got = {r.page_id: r.verdict for r in urls.judged(df, rules, spark.createDataFrame([("bad.net",), (deep,)], "host string")).collect()}
    assert [got[k] for k in range(5)] == ["block", "block", "allow", "allow", "allow"] and time.perf_counter() - began < 60
    # one slice's cascade at a time: all others' answers are written before
    built, alive = [], []
    plain = urls._cascade

    def counted(*x):
        alive.append(sum(c() is not None for c in built))
        own = plain(*x)
        built.append(weakref.ref(own))
        return own

    monkeypatch.setattr(urls.build, "__defaults__", (4,))
    monkeypatch.setattr(urls, "_cascade", counted)
    listed = spark.createDataFrame([(f"h{k}.net",) for k in range(40)], "host string")
    pages = spark.createDataFrame([(k, f"http://www.h{k}.net/") for k in range(80)], "page_id long, url string")
    assert sorted(r.page_id for r in urls.judged(pages, rules, listed).where("verdict = 'block'").collect()) == list(range(40))
    assert len(built) > 3 and max(alive) <= 1


# media


def test_another_film_s_rate_and_no_comment(spark):
    lines = np.random.default_rng(1).integers(0, 256, (160, 64)).astype(np.uint8)
    frames = media.encode_frames(lines, np.array([64, 64, 32]))
    film = media.write_avi(frames, 64, 160 * 64)
    assert media.read_avi(film) == (frames, 160 * 64, 1 / media.RATE)
    at = film.index(b"strh") + 28
    slow = film[:at] + (1001).to_bytes(4, "little") + (24_000).to_bytes(4, "little") + film[at + 8 :]
    note = film.index(b"ICMT")
    bare = slow[:note] + b"ISFT" + slow[note + 4 :]
    assert media.read_avi(bare) == (frames, None, 1001 / 24_000)
    clips = media.clips(spark.createDataFrame([(1, bytearray(bare)), (None, bytearray(film))], "doc_id long, media binary")).collect()
    assert max(c.end_s for c in clips if c.doc_id == 1) == pytest.approx(3 * 1001 / 24_000) and max(c.end_s for c in clips if c.doc_id is None) == pytest.approx(3 / media.RATE)
    for bad in (b"no", film[: film.index(b"idx1")]):
        with pytest.raises(ValueError):
            media.read_avi(bad)


def test_lossless_frames_round_trip():
    rng = np.random.default_rng(0)
    for lines in (rng.integers(0, 256, (200, 64)), np.zeros((3, 64)), np.full((70, 64), 255), np.tile([0, 255], (64, 32))):
        lines = lines.astype(np.uint8)
        heights = np.array([64] * (len(lines) // 64) + ([len(lines) % 64] if len(lines) % 64 else []))
        got, h = media.decode_frames(media.encode_frames(lines, heights))
        assert (got == lines).all() and (h == heights).all()


def test_one_frame_by_a_plain_decoder():
    """Bit by bit, from the tables in the frame's own headers."""
    lines = np.random.default_rng(1).integers(0, 256, (5, 64)).astype(np.uint8)
    frame = media.encode_frames(lines, np.array([5]))[0]
    at = frame.index(b"\xff\xc4") + 5
    counts, values = frame[at : at + 16], frame[at + 16 : at + 25]
    codes, code, k = {}, 0, 0
    for bits in range(1, 17):
        for _ in range(counts[bits - 1]):
            codes[format(code, f"0{bits}b")] = values[k]
            code, k = code + 1, k + 1
        code *= 2
    scan = frame[len(media.jpeg_head(5)) : -2].replace(b"\xff\x00", b"\xff")
    stream, at, rows = "".join(format(b, "08b") for b in scan), 0, []
    for y in range(5):
        row = []
        for x in range(64):
            n = 1
            while stream[at : at + n] not in codes:
                n += 1
            size = codes[stream[at : at + n]]
            raw = int(stream[at + n : at + n + size] or "0", 2)
            diff = raw if not size or raw >> size - 1 else raw - (1 << size) + 1
            row.append((row[-1] if x else rows[-1][0] if y else 128) + diff)
            at += n + size
        rows.append(row)
    assert rows == lines.tolist()


def plain_frame(lines, lengths):
    """A frame coded bit by bit with code lengths of our own for the sizes of differences; sizes of equal length are in ascending order."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    codes, code, last = {}, 0, 0
    for s in order:
        code <<= lengths[s] - last
        codes[s], last = format(code, f"0{lengths[s]}b"), lengths[s]
        code += 1
    bits = ""
    for y, line in enumerate(lines.tolist()):
        for x, v in enumerate(line):
            diff = v - (line[x - 1] if x else int(lines[y - 1, 0]) if y else 128)
            size = abs(diff).bit_length()
            bits += codes[size] + (format(diff if diff > 0 else diff + (1 << size) - 1, f"0{size}b") if size else "")
    bits += "1" * (-len(bits) % 8)
    data = bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
    table = bytes([0]) + bytes(sum(n == k for n in lengths.values()) for k in range(1, 17)) + bytes(order)
    head = media.jpeg_head(len(lines))
    return head[:4] + (len(table) + 2).to_bytes(2, "big") + table + head[4 + int.from_bytes(head[4:6], "big") :] + data + b"\xff\xd9"


def test_frames_are_decoded_by_their_own_tables():
    rng = np.random.default_rng(2)
    parts = [rng.integers(0, 256, (n, 64)).astype(np.uint8) for n in (5, 64, 1, 7, 64)]
    swapped = {0: 8, 1: 9} | {s: 9 - s for s in range(2, 9)}
    swapped[8], swapped[7] = 2, 1  # the shortest two codes name each other's size
    tables = [swapped, {s: 4 for s in range(9)}, {s: 10 - s for s in range(9)}]
    frames = [plain_frame(x, tables[k % 3]) if k < 4 else media.encode_frames(x, np.array([64]))[0] for k, x in enumerate(parts)]
    got, heights = media.decode_frames(frames)
    assert heights.tolist() == [5, 64, 1, 7, 64] and (got == np.concatenate(parts)).all()


def test_unsupported_frames_are_refused():
    frame = media.encode_frames(np.random.default_rng(3).integers(0, 256, (4, 64)).astype(np.uint8), np.array([4]))[0]
    broken = {
        "a longer size": frame.replace(bytes(range(8, -1, -1)), bytes(range(9, 0, -1))), "another predictor": frame.replace(b"\xff\xda\x00\x08\x01\x01\x00\x01", b"\xff\xda\x00\x08\x01\x01\x00\x04"),
        "a baseline frame": frame.replace(b"\xff\xc3", b"\xff\xc0"), "cut": frame[:150] + b"\xff\xd9", "no code": frame[: len(media.jpeg_head(4))] + b"\xff\x00" * 288 + b"\xff\xd9",
    }
    for name, own in broken.items():
        with pytest.raises(ValueError):
            media.decode_frames([own])
            pytest.fail(name)


def test_media_columns(docs, none):
    got = media.decoded(media.stored(docs)).collect()
    want = Counter((i, len((t or "").encode()), (t or "").encode().ljust(max(1, -(-len((t or "").encode()) // 64)) * 64, b"\0")) for i, t in odd_texts())
    assert Counter((r.doc_id, r.n_bytes, bytes(r.payload)) for r in got) == want
    assert all(r.clips[0].first_frame == 0 and r.clips[-1].end_frame == r.frames and r.media[:4] == b"RIFF" for r in got)
    assert media.decoded(media.stored(none)).count() == 0
    assert media.clips(media.stored(docs)).where("end_s <= start_s").count() == 0


def test_cuts_stand_out():
    histograms = np.zeros((30, 16))
    histograms[:12, 0] = histograms[12:, 9] = 10
    assert media.cuts(histograms) == [0, 12] and media.cuts(histograms[:1]) == [0]


# near copies of the pipeline


def plain_shingles(text):
    own = [w.lower() for w in (text or "").encode().split()]
    return frozenset(tuple(own[k : k + 5]) for k in range(len(own) - 4)) if len(own) >= 5 else frozenset([tuple(own)] if own else [])


def near_texts():
    """Odd texts, a family of close variants, a chain whose ends are far apart, pairs around the limit, one passage in texts of many kinds."""
    own, rng, rows = {i: t for i, t in odd_texts() if i is not None}, random.Random(6), []
    base = [f"w{k}" for k in range(200)]
    for k in range(120):
        at = rng.sample(range(200), 1 + k % 6)
        rows.append(" ".join(f"v{k}x{p}" if p in at else w for p, w in enumerate(base)))
    rows += [" ".join(f"c{p}" for p in range(4 * k, 4 * k + 100)) for k in range(12)]
    for cut in range(2, 40, 2):
        rows += [" ".join(f"p{cut}q{p}" for p in range(150)), " ".join(f"p{cut}q{p}" for p in range(150 - cut))]
    passage = " ".join(f"h{p}" for p in range(40))
    rows += [f"{passage} " + " ".join(f"z{k}y{p}" for p in range(k % 25)) for k in range(90)]
    return list(own.items()) + [(1000 + k, t) for k, t in enumerate(rows)]


def test_near_copies_are_those_of_brute_force_jaccard(spark, docs, none, monkeypatch):
    rows = near_texts()
    df = spark.createDataFrame([*rows, (None, rows[0][1])], "doc_id long, text string").repartition(5)
    sets = {i: plain_shingles(t) for i, t in rows}
    pairs = [(i, j) for i, a in sets.items() for j, b in sets.items() if i < j and len(a & b) * 5 >= 4 * len(a | b)]
    roots = smallest_reachable(sorted(sets), pairs)
    for tile, small in ((near_copies.TILE, near_copies.SMALL), (16, 3)):
        monkeypatch.setattr(near_copies, "TILE", tile)
        monkeypatch.setattr(near_copies, "SMALL", small)
        assert {r.doc_id: r.component_id for r in near_copies.near_copies(df).collect()} == roots | {None: roots[rows[0][0]]}
    kept = near_copies.deduplicated(df)
    assert kept.columns == df.columns and Counter(r.doc_id for r in kept.collect()) == Counter(set(roots.values()))
    assert near_copies.deduplicated(none).count() == 0 and near_copies.deduplicated(docs).columns == docs.columns


def test_sketches_of_similar_sets_agree():
    rng = np.random.default_rng(3)
    hashes = lambda n: np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
    as_row = lambda x: np.frombuffer(near_copies.sketch(x), dtype=np.uint8)
    for n in (1, 4, 5, 9, 30, 146, 500, 2000, 20_000):
        for _ in range(20):
            own = hashes(n)
            less, other = own[rng.random(len(own)).argsort() >= len(own) // 5], hashes(len(own) // 9)
            more = np.unique(np.concatenate([own[len(own) // 10 :], other[: len(own) // 10]]))
            for near in (less, more):
                assert not near_copies.similar(own, near) or near_copies.agreeing(as_row(own), as_row(near)[None])[0]
            far = np.unique(np.concatenate([own[len(own) // 2 :], hashes(len(own) // 2)]))
            assert n < 30 or not near_copies.agreeing(as_row(own), as_row(far)[None])[0]
    empty = as_row(hashes(0))
    assert near_copies.agreeing(empty, np.stack([empty, as_row(hashes(30))])).tolist() == [True, False]


def test_pipeline_drops_near_copies_that_fingerprints_miss(spark):
    import corpus_pipeline

    own = [f"w{k}" for k in range(300)]
    far = " ".join(f"x{k}" if k in (40, 140, 240) else w for k, w in enumerate(own))
    assert (plain_fingerprint(" ".join(own)) ^ plain_fingerprint(far)).bit_count() > 2
    df = spark.createDataFrame([(1, " ".join(own)), (2, far)], "doc_id long, text string")
    assert [r.doc_id for r in corpus_pipeline.without_near_copies(spark, df, "").collect()] == [1]


def test_pipeline_links_fingerprints_through_the_tree(spark, monkeypatch):
    from marlstone.llm import simhash

    own = [f"w{k}" for k in range(900)]
    near = " ".join(own[:-1])
    assert 0 < (plain_fingerprint(" ".join(own)) ^ plain_fingerprint(near)).bit_count() <= 2
    df = spark.createDataFrame([(1, " ".join(own)), (2, near), (3, "other words")], "doc_id long, text string")
    asked, links = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda distinct, *rest: asked.append(distinct.count()) or links(distinct, *rest))
    # without bands the fingerprints alone find the pair
    monkeypatch.setattr(near_copies, "_meetings", lambda distinct: spark.createDataFrame([], "a long, b long, band long, n long, held long"))
    assert {r.doc_id: r.component_id for r in near_copies.near_copies(df).collect()} == {1: 1, 2: 1, 3: 3} and asked == [3]
