"""Backtracking encoder, conversation trie and source divergence against brute force, and on odd rows."""

import hashlib
import json
import os
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from itertools import pairwise

import pytest
from pyspark.sql import functions as F

from marlstone.llm import bpe, divergence, prefix_trie, queries
from marlstone.llm.tokens import BYTE_LETTERS
from tests.llm.test_llm_operators import DOCS, VOCABULARY, odd_texts

DATA = "/root/testdata/sf0.001"


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


def letters(text):
    return "".join(BYTE_LETTERS.get(b, chr(b)) for b in text.encode())


def table_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0, "w", 1, "m", 2, "r", "k") for i, t in rows], DOCS).repartition(3)


# encoding and decoding


def test_words_are_the_library_s():
    own, plain, draw = bpe.Merges(VOCABULARY), library(), random.Random(5)
    for _ in range(6000):
        of = draw.choice(["abcdefghijklmnopqrstuvwxyz", "aeinorst", "ab", "a", "thein", "äöüéñçaeist", "!?.,-", "漢字🙂é"])
        word = letters("".join(draw.choice(of) for _ in range(draw.choice([1, 2, 3, 5, 8, 13, 30, 200]))))
        assert own.encode(word) == [t.id for t in plain.model.tokenize(word)]


def test_tokens_that_merges_never_make_are_not_used(tmp_path):
    # "abc" is made of "ab" and "c", but "bc" comes first
    base = ["a", "b", "c", "d"]
    merges = [("b", "c"), ("a", "b"), ("ab", "c"), ("bc", "d"), ("a", "a"), ("aa", "b")]
    tokens = base + [a + b for a, b in merges]
    model = {"type": "BPE", "vocab": {t: i for i, t in enumerate(tokens)}, "merges": [list(m) for m in merges]}
    path = tmp_path / "small.json"
    path.write_text(json.dumps({"version": "1.0", "added_tokens": [], "normalizer": None, "pre_tokenizer": None, "post_processor": None, "decoder": None, "model": model}))
    from tokenizers import Tokenizer

    own, plain, draw = bpe.Merges(str(path)), Tokenizer.from_file(str(path)), random.Random(1)
    assert "abc" not in {"".join(tokens[ord(u)] for u in text) for text in own.ids}
    for _ in range(3000):
        word = "".join(draw.choice("abcd") for _ in range(draw.randint(1, 12)))
        assert own.encode(word) == plain.encode(word).ids


def test_merges_out_of_order_are_refused(tmp_path):
    path = tmp_path / "bad.json"
    path.write_text(json.dumps({"model": {"vocab": {"a": 0, "b": 3, "ab": 1}, "merges": ["a b"]}}))
    with pytest.raises(ValueError):
        bpe.Merges(str(path))


def test_long_words_take_linear_time():
    own, draw = bpe.Merges(VOCABULARY), random.Random(2)
    word = "".join(draw.choice("aeinorst") for _ in range(400_000))
    began = time.perf_counter()
    ids = own.encode(word)
    assert time.perf_counter() - began < 20
    assert "".join(own.texts[i] for i in ids) == word[:-1].translate(own.inner) + own.last[word[-1]]
    assert all(own.fit(a, b) for a, b in pairwise(ids))


def test_odd_texts_round_trip(spark):
    plain = library()
    rows = odd_texts() + [(18, "<|endoftext|><|startoftext|>x<|endoftext|"), (19, "a\x00b �́ é ﬁ ǅ"), (20, "don't WE'LL 12'S"), (21, " 　")]
    found = bpe.decoded(bpe.encoded(table_of(spark, rows), VOCABULARY), VOCABULARY).collect()
    want = Counter()
    for i, t in rows:
        ids = plain.encode(t or "", add_special_tokens=False).ids
        want[i, len(ids), b"".join(x.to_bytes(4, "little") for x in ids), plain.decode(ids, skip_special_tokens=False)] += 1
    assert Counter((r.doc_id, r.n_tokens, bytes(r.ids), r.text) for r in found) == want


def test_unknown_ids_and_nulls_decode_to_nothing(spark):
    some = b"".join(x.to_bytes(4, "little") for x in (518, 4_000_000, 2368, 60_000))
    rows = spark.createDataFrame([(1, 4, bytearray(some)), (2, 0, None), (None, 0, bytearray())], bpe.ENCODED)
    assert {r.doc_id: r.text for r in bpe.decoded(rows, VOCABULARY).collect()} == {1: library().decode([518, 2368]), 2: "", None: ""}


def test_no_documents_give_no_tokens(spark):
    none = bpe.encoded(spark.createDataFrame([], DOCS), VOCABULARY)
    assert none.count() == 0 and bpe.decoded(none, VOCABULARY).columns == ["doc_id", "n_tokens", "ids", "text"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_the_query_is_the_library(spark):
    plain = library()
    want = Counter()
    for r in spark.read.parquet(f"{DATA}/documents.parquet").collect():
        ids = plain.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id, len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), hashlib.sha256(plain.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter(map(tuple, queries.op11_bpe(spark, DATA).collect())) == want


# conversations

TURNS = "conv_id long, turn long, role string, text string, key string, depth long, at long, digest string"


def plain_trie(rows):
    """Nodes by walking through every prefix of every rebuilt conversation."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode()):010d}{role}{text}".encode()).hexdigest()
            own[c].append((turn is not None, turn or 0, digest, role, text))
    own = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c > 0 else -1)
        whole = tuple(own.get(base, [])[:h] + own[c][h:])
        ends[whole].append(c)
        for d in range(len(whole) + 1):
            members[whole[:d]].append(c)
    kids = Counter(p[:-1] for p in members if p)
    out = Counter()
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        digest = hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()
        out[m[0], len(p), members[p[:-1]][0] if p else None, len(m), kids[p], sum(not kids[q] for q in below), saved, digest] += 1
    return out


def nodes_of(spark, rows):
    df = spark.createDataFrame([(*r, "k", 7, 8, "d") for r in rows], TURNS).repartition(3)
    nodes, ends = prefix_trie.trie(df)
    found = nodes.join(prefix_trie.ends_digests(ends), "key", "left").withColumn("ends", F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)))
    return Counter((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends) for r in found.collect())


@pytest.mark.parametrize("seed", range(3))
def test_trie_is_brute_force(spark, seed):
    draw, rows = random.Random(seed), []
    for c in [*range(-12, 30), *draw.sample(range(30, 10_000), 30), 10**12]:
        for turn in range(draw.choice([0, 1, 2, 4, 9, 14])):
            # few texts, so that prefixes are shared; ties, nulls and equal turns
            rows.append((c, draw.choice([turn, turn, None, 3]), draw.choice(["user", None, ""]), draw.choice(["a", "bé", "", None, "ccc"])))
    rows += [(None, 1, "user", "no conversation"), (5, 1, "user", "x" * 100_000)]
    assert nodes_of(spark, rows) == plain_trie(rows)


def test_a_hot_conversation_is_one_sequence_with_all_its_ends(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 7)
    rows = [(c, t, "user", f"turn {t}") for c in range(400) for t in range(3)] + [(c, t, "user", f"{c} {t}") for c in range(1000, 1010) for t in range(2)]
    assert nodes_of(spark, rows) == plain_trie(rows)
    df = spark.createDataFrame([(*r, "k", 7, 8, "d") for r in rows], TURNS)
    _, ends = prefix_trie.trie(df)
    assert all(len(r.conv_ids) <= 7 for r in ends.collect())


def test_no_conversations_give_no_nodes(spark):
    assert nodes_of(spark, []) == Counter()


def test_a_long_conversation_is_walked_in_a_stream(spark):
    rows = [(3, t, "user", "same") for t in range(4000)]
    found = nodes_of(spark, rows)
    assert len(found) == 4001 - zlib.crc32(b"3") % 9 and max(k[1] for k in found) == 4000 - zlib.crc32(b"3") % 9


# divergence


def plain_audit(rows, documents, smooth, top):
    kept, counts, seen = {}, defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        terms = [w.decode("utf-8", "replace") for w in re.findall(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").encode().lower())]
        counts[lang or "", source or ""].update(terms)
        seen[lang or ""].update(set(terms))
    for lang, c in seen.items():
        kept[lang] = {t for t, n in c.items() if n >= documents}
    shares, whole = {}, defaultdict(Counter)
    for (lang, _), c in counts.items():
        whole[lang].update(c)

    def share(c, lang):
        total = sum(c[t] for t in kept[lang])
        return {t: 1 + 10**9 * (c[t] + smooth) // (total + smooth * len(kept[lang])) for t in kept[lang]}

    shares = {g: share(c, g[0]) for g, c in counts.items()}
    of_lang = {lang: share(c, lang) for lang, c in whole.items()}
    out = Counter()
    for (lang, source), p in shares.items():
        pairs = sorted((-sum(abs(p[t] - q[t]) for t in p), other.encode()) for (l2, other), q in shares.items() if l2 == lang and other != source)
        terms = sorted((of_lang[lang][t] - p[t], t.encode()) for t in p if counts[lang, source][t] and p[t] > of_lang[lang][t])[:top]
        for part, found in (("pair", pairs), ("term", terms)):
            for rank, (value, item) in enumerate(found, 1):
                out[lang, source, part, item.decode(), -value, rank] += 1
    return out


def audited(spark, rows, **limits):
    df = spark.createDataFrame([(k, t, lang, source, 3, "t", 5) for k, (t, lang, source) in enumerate(rows)], "doc_id long, text string, lang string, source string, n long, term string, p long")
    return Counter(map(tuple, divergence.audit(df.repartition(3), **limits).collect()))


@pytest.mark.parametrize("blocks", [(128, 2048), (3, 5)])
def test_audit_is_brute_force(spark, monkeypatch, blocks):
    for name, n in zip(("SOURCES", "TERMS"), blocks, strict=True):
        monkeypatch.setattr(divergence, name, n)
    draw = random.Random(3)
    own = ["The", "the", "élan", "ÉLAN", "x1y", "a_b", "漢字", "don't", "Ring", "ring", " ", "q", "zz", "[k]", "{m}", "@n", "`o"]
    rows = [
        (" ".join(draw.choice(own[: draw.randint(1, len(own))]) + draw.choice(["", ".", "\n", "\x00"]) for _ in range(draw.randint(0, 30))), draw.choice(["en", "fr", None, ""]), draw.choice(["s1", "s2", "é", None, *(f"t{k}" for k in range(6))]))
        for _ in range(150)
    ]
    rows += [(None, "en", "empty"), ("", "de", "alone"), ("123 ...", "nl", "a"), (None, "nl", "b"), ("the " * 50_000, "en", "s1"), ("the", "en", "s1"), ("the", "en", "s1")]
    assert audited(spark, rows, documents=4, smooth=5, top=3) == plain_audit(rows, 4, 5, 3)


def test_no_documents_give_no_audit(spark):
    assert audited(spark, []) == Counter()


def test_texts_are_counted_in_pieces_and_tasks_in_parts(spark, monkeypatch):
    assert divergence.document_counts(b"One two,one  THREE" * 50, piece=7) == Counter(re.findall(rb"[a-z]+", b"one two,one  three" * 50))
    monkeypatch.setattr(divergence, "ENTRIES", 3)
    rows = [("a b c d e f", "en", f"s{k % 3}") for k in range(40)]
    assert audited(spark, rows) == plain_audit(rows, 30, 5, 50)
