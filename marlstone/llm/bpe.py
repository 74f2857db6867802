"""Byte-pair encoding by backtracking, and decoding by an offset table.

A word's ids are found from left to right: an Aho-Corasick automaton of all tokens gives the longest one that starts at a
place, a table of pairs tells whether two neighbours would survive the merges side by side, and where they wouldn't, a shorter
token is tried, or the one before it. A place from which no token fits is never entered again, so the work is linear in the
word. The ids are those of the merges applied in their order.

Two tokens fit if no merge across their border comes before those that made them: the check takes the later-made of both
apart, again and again, and looks up each pair that meets at the border. Its answers are kept, up to a bound.

Normalisation, special tokens and the cut into words are the vocabulary file's own; a worker remembers the ids of words.

Defined cases: null text is empty (no id, empty decoded text); texts and words of any length, the latter in linear time;
special tokens in a text count as such; ids that the vocabulary lacks decode to nothing; null, repeated and equal ``doc_id``
stay rows of their own; other columns are not read; an empty table gives no row.
"""

from __future__ import annotations

import json
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .tokens import BYTE_LETTERS, WordEncoder

#: Bytes of text encoded at a time, bytes of ids decoded at a time, answers about pairs that a worker remembers.
TEXT_BYTES, ID_BYTES, REMEMBERED_PAIRS = 4_000_000, 2_000_000, 1_000_000
ENCODED = "doc_id long, n_tokens long, ids binary"


class Merges:
    """A vocabulary's tokens over an alphabet of units: a byte inside a word, or a byte that ends one."""

    def __init__(self, vocabulary: str):
        import ahocorasick

        with open(vocabulary, encoding="utf-8") as file:
            model = json.load(file)["model"]
        ids, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        size, made = 1 + max(ids.values()), {a + b for a, b in merges}
        units = {s: i for s, i in ids.items() if s not in made}
        self.left, self.right, self.pairs = list(range(size)), list(range(size)), {}
        self.texts = [""] * size
        for i in units.values():
            self.texts[i] = chr(i)
        self.kept: dict[int, bool] = {}
        # a letter's unit inside a word and at its end
        self.inner = {ord(s): chr(i) for s, i in units.items() if len(s) == 1}
        self.last = {s[0]: chr(i) for s, i in units.items() if s[1:] == suffix}
        self.ids, usable, before = {chr(i): i for i in units.values()}, [True] * size, max(units.values())
        for a, b in merges:
            i, x, y = ids[a + b], ids[a], ids[b]
            if not max(before, x, y) < i:
                raise ValueError("the ids of merged tokens don't follow the order of merges")
            before, self.left[i], self.right[i] = i, x, y
            self.texts[i] = self.texts[x] + self.texts[y]
            # a token that the merges of its own text never make isn't one
            usable[i] = usable[x] and usable[y] and self._survive(x, y, i)
            self.pairs[x, y] = i
            if usable[i]:
                self.ids[self.texts[i]] = i
        self.shorter, self.longest = [-1] * size, ahocorasick.Automaton()
        for text, i in self.ids.items():
            self.longest.add_word(text, i)
            self.shorter[i] = next((self.ids[text[:n]] for n in range(len(text) - 1, 0, -1) if text[:n] in self.ids), -1)
        self.longest.make_automaton()
        self.reach = max(map(len, self.ids))

    def _survive(self, a: int, b: int, limit: int = 1 << 62) -> bool:
        """Whether no merge across the border of ``a`` and ``b`` comes before ``limit`` or before those within them."""
        pairs, left, right = self.pairs, self.left, self.right
        while True:
            if pairs.get((a, b), limit) < limit:
                return False
            # the later-made one is taken apart; of equal ones, the merge on the left comes first
            if a > b and right[a] != a:
                limit, a = a, right[a]
            elif left[b] != b:
                limit, b = b + 1, left[b]
            elif right[a] != a:
                limit, a = a, right[a]
            else:
                return True

    def fit(self, a: int, b: int) -> bool:
        """Whether ``b`` may follow ``a``: an entry of the pair table, made when it is first asked for."""
        kept = self.kept.get(key := a << 32 | b)
        if kept is None:
            if len(self.kept) >= REMEMBERED_PAIRS:
                self.kept.clear()
            kept = self.kept[key] = self._survive(a, b)
        return kept

    def encode(self, letters: str) -> list[int]:
        """The ids of one word, given as byte letters."""
        if not letters:
            return []
        word = letters[:-1].translate(self.inner) + self.last[letters[-1]]
        whole = self.ids.get(word)
        if whole is not None:
            return [whole]
        greedy = [i for _, i in self.longest.iter_long(word)]
        if all(self.fit(a, b) for a, b in pairwise(greedy)):
            return greedy
        return self._backtracked(word)

    def _backtracked(self, word: str) -> list[int]:
        texts, shorter, fit, longest, reach = self.texts, self.shorter, self.fit, self.longest.iter_long, self.reach
        out, at, n, dead = [], 0, len(word), bytearray(len(word) + 1)
        token = next(longest(word[:reach]))[1]
        while True:
            end = at + len(texts[token])
            if not dead[end] and (not out or fit(out[-1], token)):
                out.append(token)
                at = end
                if at == n:
                    return out
                token = next(longest(word[at : at + reach]))[1]  # the automaton copies what it is given
                continue
            token = shorter[token]
            while token < 0:  # nothing fits here: back to the token before, made shorter
                dead[at] = 1
                token = out.pop()
                at -= len(texts[token])
                token = shorter[token]


class BacktrackingEncoder(WordEncoder):
    """``WordEncoder`` whose words are encoded by ``Merges``; the library only normalises and cuts."""

    def __init__(self, vocabulary: str, remembered: int | None = None):
        super().__init__(vocabulary, *([] if remembered is None else [remembered]))
        self.merges = Merges(vocabulary)
        self.special = {token.content: i for i, token in self.tokenizer.get_added_tokens_decoder().items()}
        self.cut = _cutter(list(self.special))

    def _plain(self, text: str) -> list[int]:
        out = []
        for part in self.cut(text):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                for letters, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(part)):
                    out += self.merges.encode(letters)
        return out

    def _word(self, text: str) -> list[int]:
        return self.merges.encode(text if text.isascii() else text.encode().decode("latin-1").translate(BYTE_LETTERS))


def _cutter(special: list[str]):
    """A function that cuts a text at special tokens and keeps them."""
    import re

    if not special:
        return lambda text: [text]
    return re.compile("(" + "|".join(re.escape(s) for s in sorted(special, key=len, reverse=True)) + ")").split


@lru_cache(maxsize=1)
def encoder_of(vocabulary: str) -> BacktrackingEncoder:
    """The worker's own encoder: a Python worker that Spark uses for several tasks keeps its tables and words."""
    return BacktrackingEncoder(vocabulary)


@lru_cache(maxsize=1)
def offset_table(vocabulary: str) -> pa.LargeStringArray:
    """Each id's text with a blank after it, as one run of bytes with offsets; the last entry is empty, for ids that don't exist."""
    with open(vocabulary, encoding="utf-8") as file:
        whole = json.load(file)
    if whole.get("decoder"):
        raise ValueError("only for vocabularies without a decoder, whose tokens are joined by blanks")
    texts = {i: s for s, i in whole["model"]["vocab"].items()} | {t["id"]: t["content"] for t in whole["added_tokens"]}
    return pa.array([texts[i] + " " if i in texts else "" for i in range(max(texts) + 2)], type=pa.large_string())


def encoded(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Rows (doc_id, n_tokens, ids) of every whole text; ids are little-endian unsigned 32-bit."""

    def run(batches):
        encoder = encoder_of(vocabulary)
        for batch in common.slices(batches, "text", TEXT_BYTES):
            ids, counts = encoder.encode(common.as_bytes(batch.column("text")))
            flat, ends = ids.astype("<u4").tobytes(), 4 * np.cumsum(counts)
            rows = [flat[b - 4 * n : b] for b, n in zip(ends.tolist(), counts.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, type=pa.int64()), pa.array(rows, type=pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text")).mapInArrow(run, ENCODED)


def decoded(tokens: DataFrame, vocabulary: str) -> DataFrame:
    """``encoded`` rows with ``text``, the decoded text of their ids (null ids: empty)."""

    def run(batches):
        table = offset_table(vocabulary)
        for batch in common.slices(batches, "ids", ID_BYTES):
            rows = common.as_bytes(batch.column("ids"))
            ids = np.minimum(np.frombuffer(b"".join(rows), dtype="<u4"), len(table) - 1)
            taken = table.take(pa.array(ids))
            offsets = np.frombuffer(taken.buffers()[1], dtype="<i8", count=len(ids) + 1)
            data, bounds = memoryview(taken.buffers()[2] or b""), offsets[np.cumsum([0, *(len(r) // 4 for r in rows)])].tolist()
            texts = [bytes(data[a : max(a, b - 1)]) for a, b in pairwise(bounds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, type=pa.string())], names=["doc_id", "n_tokens", "ids", "text"])

    return tokens.select("doc_id", "n_tokens", "ids").mapInArrow(run, f"{ENCODED}, text string")
