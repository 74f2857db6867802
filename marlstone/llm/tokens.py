"""Whole texts to token ids, by words: a text's ids are the ids of its white-space-separated words in a row.

The vocabulary's pre-tokenizer drops white space and never joins what stands on both sides of it, so each distinct word
is encoded once per worker and looked up afterwards. ``WordEncoder`` bounds that table and starts it anew when full.
"""

from __future__ import annotations

from array import array
from functools import lru_cache

import numpy as np

#: Words that one worker remembers at most.
REMEMBERED_WORDS = 700_000
#: How the vocabulary spells bytes as letters: printable ones as themselves, the others from U+0100 on.
BYTE_LETTERS = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}
#: Marks that may end a word; without those that can begin a contraction or belong to a special token.
MARKS = "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"
#: The id that ends each document.
END_ID = 2


class WordEncoder:
    """Encodes texts with a tokenizers file; ``encode`` gives the flat ids and the number of ids of each text."""

    def __init__(self, vocabulary: str, remembered: int = REMEMBERED_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.marks: dict[str, list[int]] = {}
        self.remembered = remembered
        self._forget()

    def _forget(self) -> None:
        self.pending: list[bytes] = []
        self.codes = _Codes(self.pending)
        self.flat, self.starts, self.counts = array("i"), array("q"), array("i")

    def _plain(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _word(self, text: str) -> list[int]:
        """The ids of one run of plain lower-case letters."""
        if not text.isascii():
            text = text.encode().decode("latin-1").translate(BYTE_LETTERS)
        return [token.id for token in self.tokenizer.model.tokenize(text)]

    def _learn(self) -> None:
        """Encodes the words seen for the first time; they have the codes that follow the known ones, in order.

        A run of letters below U+0100 is stable under the vocabulary's normalisation and goes to its model directly;
        such a word with capitals or marks at its end shares the entry of the bare word. All others take the full way.
        """
        todo, self.pending[:] = list(self.pending), []
        codes, counts, starts, flat, marks = self.codes, self.counts, self.starts, self.flat, self.marks
        word_ids, bare, n_done = self._word, [], len(starts)
        known = n_done + len(todo)
        for word in todo:
            text = word.decode("utf-8", "replace")
            base = text.rstrip(MARKS)
            if not (base.isalpha() and (base.isascii() or max(base) < "\u0100")):
                run = self._plain(text)
            elif base is text and text.islower():
                run = word_ids(text)
            else:
                tail, base = text[len(base) :], base.lower()
                code = codes.get(key := base.encode())
                if code is None:
                    dict.__setitem__(codes, key, len(codes))
                    run = word_ids(base)
                    bare.append(run)
                elif code < len(starts):
                    if not tail:
                        starts.append(starts[code])
                        counts.append(counts[code])
                        continue
                    run = flat[starts[code] : starts[code] + counts[code]].tolist()
                elif code >= known:
                    run = bare[code - known]
                else:
                    run = word_ids(base)
                if tail:
                    if tail not in marks:
                        if len(marks) > 10_000:
                            marks.clear()
                        marks[tail] = self._plain(tail)
                    run = run + marks[tail]
            starts.append(len(flat))
            counts.append(len(run))
            flat.extend(run)
        for run in bare:
            starts.append(len(flat))
            counts.append(len(run))
            flat.extend(run)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.codes) > self.remembered:
            self._forget()
        code_of = self.codes.__getitem__
        words, n_words = [], np.zeros(len(texts), dtype=np.int64)
        for k, text in enumerate(texts):
            own = text.split()
            n_words[k] = len(own)
            words += own
        codes = np.fromiter(map(code_of, words), dtype=np.int64, count=len(words))
        if self.pending:
            self._learn()
        starts, counts = np.frombuffer(self.starts, dtype=np.int64), np.frombuffer(self.counts, dtype=np.int32)
        if not len(codes):
            return np.zeros(0, dtype=np.int32), np.zeros(len(texts), dtype=np.int64)
        n = counts[codes].astype(np.int64)
        ends = np.cumsum(n)
        ids = np.frombuffer(self.flat, dtype=np.int32)[np.repeat(starts[codes] - (ends - n), n) + np.arange(ends[-1])]
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(n_words)])]
        del starts, counts
        if len(self.codes) > self.remembered:
            self._forget()
        return ids, np.diff(bounds)


@lru_cache(maxsize=1)
def encoder_of(vocabulary: str) -> WordEncoder:
    """The worker's own encoder: a Python worker that Spark uses for several tasks keeps the words it has learned."""
    return WordEncoder(vocabulary)


class _Codes(dict):
    def __init__(self, pending: list[bytes]):
        super().__init__()
        self.pending = pending

    def __missing__(self, word: bytes) -> int:
        code = self[word] = len(self)
        self.pending.append(word)
        return code


def with_ends(ids: np.ndarray, counts: np.ndarray, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """``end_id`` after the ids of each text."""
    counts = np.asarray(counts, dtype=np.int64)
    out = np.full(len(ids) + len(counts), end_id, dtype=np.int32)
    at = np.arange(len(ids)) + np.repeat(np.arange(len(counts)), counts)
    out[at] = ids
    return out, counts + 1
