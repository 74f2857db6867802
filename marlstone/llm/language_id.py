"""Language identification by segmentation-marginalised unigrams.

The pieces are those of a fixed public vocabulary; each language has its own probability for each piece. A word's
probability in a language is the sum over all its segmentations into pieces, by a forward pass; a text's is the product
over its words. The probabilities are fitted by expectation maximisation: words and their counts per language are
gathered in Spark, each round's expected piece counts are summed in Spark, and only one row per piece and language
comes to the driver, whatever the input's size.

The fit takes at most about ``FIT_DOCS`` labelled documents of each language, chosen by a hash of ``doc_id``; every
document is scored whole.

Defined cases: null text and text without a letter (Unicode category L; ``½``, ``²`` and ``Ⅷ`` are none) are ``und`` with
score 0, as is everything if no labelled document is there to learn from; a run of letters of any length is one word, with
all its segmentations, when it is scored, and is learnt in stretches of ``LEARNT_LETTERS`` letters; ties go to the smaller language value; repeated rows get a row each; a null ``doc_id`` counts as the
empty text for the fold, so it is held out; an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Labelled documents of a language that the fit takes at most (in expectation), rounds of EM, count added to each piece.
FIT_DOCS, ROUNDS, PRIOR = 1500, 3, 0.05
#: Words remembered by a worker, bytes of text at a time, letters of words of one length whose passes run side by side.
REMEMBERED_WORDS, TEXT_BYTES, LETTERS_AT_ONCE = 400_000, 4_000_000, 100_000
#: Words of more letters go through the pass one by one, in stretches of ``STRETCH`` letters.
LONG_WORD, STRETCH = 64, 1 << 14
#: The fit learns longer runs of letters in stretches of so many letters, side by side.
LEARNT_LETTERS = 1024
#: A sum below ``TINY`` is raised by ``RAISE`` = 1 / TINY, and its exponent counted, so words of any length keep their sums.
TINY, RAISE = 1e-100, 1e100
#: Probability of a letter that is no piece.
FLOOR = 1e-8
#: Runs of word characters; what among them is no letter is taken out afterwards.
LETTERS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
#: Mark of a word's beginning in the vocabulary.
BEGIN = "▁"


def vocabulary_pieces(path: str) -> list[str]:
    """The lower-case pieces of letters in a sentencepiece model."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    return sorted({p for p in found if p == p.lower() and (p.removeprefix(BEGIN) or "a").isalpha()})


class Pieces:
    """The pieces as a trie in sorted arrays."""

    def __init__(self, pieces: list[str]):
        self.n = len(pieces)
        self.letter = {c: k + 1 for k, c in enumerate(sorted(set("".join(pieces))))}
        self.width, nodes, edges = len(self.letter) + 1, {"": 0}, {}
        self.longest = max(map(len, pieces), default=1)
        for p in pieces:
            for k in range(1, len(p) + 1):
                if p[:k] not in nodes:
                    nodes[p[:k]] = len(nodes)
                    edges[nodes[p[: k - 1]] * self.width + self.letter[p[k - 1]]] = nodes[p[:k]]
        self.edge = np.array(sorted(edges), dtype=np.int64)
        self.to = np.array([edges[k] for k in self.edge.tolist()], dtype=np.int64)
        self.piece = np.full(len(nodes), -1, dtype=np.int64)
        self.piece[[nodes[p] for p in pieces]] = np.arange(self.n)

    def spans(self, words: list[str]) -> np.ndarray:
        """words of one length T -> [word, start, length - 1]: the piece there, n for an unknown letter, n + 1 for none."""
        size = len(words[0])
        letters = np.array([self.letter.get(c, 0) for w in words for c in w], dtype=np.int64).reshape(-1, size)
        depth = min(self.longest, size)
        out = np.full((len(words), size, depth), self.n + 1, dtype=np.int64)
        word, start = (x.reshape(-1) for x in np.indices(letters.shape))
        node = np.zeros(len(word), dtype=np.int64)
        for k in range(depth):
            inside = start + k < size
            word, start, node = word[inside], start[inside], node[inside]
            key = node * self.width + letters[word, start + k]
            at = np.minimum(np.searchsorted(self.edge, key), max(0, len(self.edge) - 1))
            found = self.edge[at] == key if len(self.edge) else np.zeros(len(key), dtype=bool)
            word, start, node = word[found], start[found], self.to[at[found]]
            own = self.piece[node]
            out[word, start, k] = np.where(own < 0, self.n + 1, own)
        first = out[:, :, 0]
        first[first > self.n] = self.n
        return out


def forward(spans: np.ndarray, probs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[place, word, language]: sums over all segmentations up to each place, and how often each sum was raised.

    probs: [piece, language], with the floor and zero as last rows."""
    words, size, depth = spans.shape
    alpha, raised = np.zeros((size + 1, words, probs.shape[1])), np.zeros((size + 1, words, probs.shape[1]), dtype=np.int64)
    alpha[0] = 1
    for end in range(1, size + 1):
        own = alpha[end]
        for k in range(min(depth, end)):
            # sums of a window were all raised alike, so they add up as they are
            own += alpha[end - k - 1] * probs[spans[:, end - k - 1, k]]
        raised[end] = raised[end - 1]
        small = own < TINY
        if small.any():
            _raise(alpha, raised, small, range(end, max(-1, end - depth), -1))
    return alpha, raised


def backward(spans: np.ndarray, probs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    words, size, depth = spans.shape
    beta, raised = np.zeros((size + 1, words, probs.shape[1])), np.zeros((size + 1, words, probs.shape[1]), dtype=np.int64)
    beta[size] = 1
    for start in range(size - 1, -1, -1):
        own = beta[start]
        for k in range(min(depth, size - start)):
            own += beta[start + k + 1] * probs[spans[:, start, k]]
        raised[start] = raised[start + 1]
        small = own < TINY
        if small.any():
            _raise(beta, raised, small, range(start, min(size + 1, start + depth)))
    return beta, raised


def _raise(sums: np.ndarray, raised: np.ndarray, small: np.ndarray, places: range) -> None:
    for place in places:
        sums[place][small] *= RAISE
        raised[place][small] += 1


def long_word_log(word: str, pieces: Pieces, probs: np.ndarray) -> np.ndarray:
    """Log probability of one word by language, letter by letter; memory for one stretch of letters only."""
    depth, logs = pieces.longest, np.zeros(probs.shape[1])
    ahead = np.zeros((depth, probs.shape[1]))
    ahead[0] = 1
    for begin in range(0, len(word), STRETCH):
        own = min(STRETCH, len(word) - begin)
        spans = pieces.spans([word[begin : begin + own + depth - 1]])[0]
        alpha = np.zeros((own + depth, probs.shape[1]))
        alpha[:depth] = ahead
        for at in range(own):
            alpha[at + 1 : at + 1 + spans.shape[1]] += alpha[at] * probs[spans[at]]
            small = alpha[at + 1] < TINY
            if small.any():
                alpha[at + 1 : at + 1 + depth, small] *= RAISE
                logs[small] -= np.log(RAISE)
        ahead = alpha[own : own + depth]
    return logs + np.log(ahead[0])


def text_words(text: str) -> list[str]:
    """The words of a text as the model sees them: lower-case runs of letters, marked at their beginning."""
    found = LETTERS.findall(text.lower())
    if found and not "".join(found).isalpha():  # some signs count as word characters without being letters
        found = "".join(c if c.isalpha() else " " for c in " ".join(found)).split()
    return [BEGIN + w for w in found]


def by_length(words: list[str]):
    """Positions of the words, in groups of one length."""
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    order = np.argsort(sizes, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1):
        if len(own):
            most = max(1, LETTERS_AT_ONCE // int(sizes[own[0]]))
            for k in range(0, len(own), most):
                yield own[k : k + most]


class Scorer:
    """Log probabilities of words, remembered."""

    def __init__(self, pieces: Pieces, probs: np.ndarray):
        self.pieces, self.probs, self.row, self.logs = pieces, probs, {}, np.zeros((0, probs.shape[1]))

    def word_logs(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), self.probs.shape[1]))
        for own in by_length(words):
            if len(words[own[0]]) > LONG_WORD:
                for k in own:
                    out[k] = long_word_log(words[k], self.pieces, self.probs)
            else:
                alpha, raised = forward(self.pieces.spans([words[k] for k in own]), self.probs)
                out[own] = np.log(alpha[-1]) - raised[-1] * np.log(RAISE)
        return out

    def text_logs(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """[text, language] sums of word logs, and words of each text."""
        if len(self.row) > REMEMBERED_WORDS:
            self.row, self.logs = {}, self.logs[:0]
        row, fresh, rows, counts = self.row, [], [], []
        for text in texts:
            own = text_words(text)
            counts.append(len(own))
            for w in set(own).difference(row):
                row[w] = len(row)
                fresh.append(w)
            rows += map(row.__getitem__, own)
        if fresh:
            self.logs = np.concatenate([self.logs, self.word_logs(fresh)])
        counts, logs = np.array(counts, dtype=np.int64), np.zeros((len(texts), self.probs.shape[1]))
        full = np.flatnonzero(counts)
        if len(full):
            logs[full] = np.add.reduceat(self.logs[np.array(rows, dtype=np.int64)], (np.cumsum(counts) - counts)[full], axis=0)
        return logs, counts


def held_out():
    """Whether a document's label is not for learning: crc32 of its id as text, by five."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


class Model:
    def __init__(self, pieces: list[str], languages: list[str], probs: np.ndarray):
        self.pieces, self.languages, self.probs = pieces, languages, probs


def _stretches(words: list[str]):
    for w in words:
        yield from (w,) if len(w) <= LEARNT_LETTERS else (w[k : k + LEARNT_LETTERS] for k in range(0, len(w), LEARNT_LETTERS))


def _word_counts(labelled: DataFrame) -> DataFrame:
    """(lang, word, n) of labelled documents."""

    def counted(batches):
        from collections import Counter, defaultdict

        for batch in common.slices(batches, "text", TEXT_BYTES):
            own = defaultdict(Counter)
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own[lang].update(_stretches(text_words(text)))
            rows = [(lang, w, n) for lang, x in own.items() for w, n in x.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["lang", "word", "n"])

    return labelled.select("lang", common.text_of().alias("text")).mapInArrow(counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _expected(words: DataFrame, model: Model) -> DataFrame:
    """(lang, piece, n): expected uses of each piece in each language's words."""

    def counted(batches):
        pieces, total = Pieces(model.pieces), np.zeros((len(model.languages), len(model.pieces) + 2))
        number = {lang: k for k, lang in enumerate(model.languages)}
        for batch in batches:
            langs = np.array([number[x] for x in batch.column("lang").to_pylist()], dtype=np.int64)
            words_, n = batch.column("word").to_pylist(), np.array(batch.column("n").to_pylist(), dtype=np.float64)
            for own in by_length(words_):
                spans = pieces.spans([words_[k] for k in own])
                (alpha, up), (beta, down) = forward(spans, model.probs), backward(spans, model.probs)
                lang, each = langs[own], np.arange(len(own))
                alpha, beta, up, down = (x[:, each, lang] for x in (alpha, beta, up, down))
                weight = n[own] / alpha[-1]
                for k in range(spans.shape[2]):
                    # all pieces of one length, at every place of every word
                    piece = spans[:, : spans.shape[1] - k, k].T
                    left, right = slice(0, len(piece)), slice(k + 1, k + 1 + len(piece))
                    use = weight * alpha[left] * model.probs[piece, lang] * beta[right] * RAISE ** (up[-1] - up[left] - down[right]).astype(float)
                    np.add.at(total, (np.broadcast_to(lang, piece.shape), piece), use)
        lang, piece = np.nonzero(total[:, : len(model.pieces)])
        yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(piece), pa.array(total[lang, piece])], names=["lang", "piece", "n"])

    return words.mapInArrow(counted, "lang long, piece long, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n"))


def _probabilities(counts: np.ndarray) -> np.ndarray:
    """[piece + 2, language] from [piece, language]; last rows: an unknown letter, nothing."""
    own = counts + PRIOR
    return np.concatenate([own / own.sum(0), np.full((1, counts.shape[1]), FLOOR), np.zeros((1, counts.shape[1]))])


def fit(docs: DataFrame, vocabulary: str, fit_docs: int = FIT_DOCS, rounds: int = ROUNDS) -> Model:
    """Learns from text and non-null ``lang`` of the documents that aren't held out."""
    pieces = vocabulary_pieces(vocabulary)
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang")).where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = sorted((r.lang, r["count"]) for r in labelled.groupBy("lang").count().collect())
    languages = [lang for lang, _ in counts]
    if not languages:
        return Model(pieces, [], np.zeros((len(pieces) + 2, 0)))
    share = F.create_map(*(F.lit(x) for lang, n in counts for x in (lang, min(1.0, fit_docs / n))))
    drawn = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / F.lit(2.0**53)  # as fine as a double, so any number of labels leaves a sample
    words = common.written(_word_counts(labelled.where(drawn < share[F.col("lang")])), "words")
    model = Model(pieces, languages, _probabilities(np.zeros((len(pieces), len(languages)))))
    for _ in range(rounds):
        found = np.zeros((len(pieces), len(languages)))
        for r in _expected(words, model).collect():
            found[r.piece, r.lang] = r.n
        model = Model(pieces, languages, _probabilities(found))
    return model


def _judge(model: Model):
    """A function from texts to their languages (``und`` where none can be told) and scores; remembers words."""
    scorer, languages = Scorer(Pieces(model.pieces), model.probs), model.languages

    def judge(texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        logs, counts = scorer.text_logs([x or "" for x in texts])
        if not languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        known, best = counts > 0, logs.argmax(1)
        score = 1 / np.exp(logs - logs.max(1, keepdims=True)).sum(1)
        return [languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], np.where(known, score, 0.0)

    return judge


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Rows (doc_id, lang_pred, score) for whole texts; the score is the language's posterior under equal priors."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the vocabulary and the number of languages

    def scored(batches):
        judge = _judge(sent.value)
        for batch in common.slices(batches, "text", TEXT_BYTES):
            names, scores = judge(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, type=pa.string()), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(scored, "doc_id long, lang_pred string, score double")


def with_language(docs: DataFrame, vocabulary: str, least_score: float = 0.5) -> DataFrame:
    """The documents whose language is known with at least ``least_score``, with all their columns.

    Each row is judged by its own text where it is read, whatever its ``doc_id``; nothing is shuffled."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, vocabulary))

    def kept(batches):
        judge = _judge(sent.value)
        for batch in common.slices(batches, "text", TEXT_BYTES):
            names, scores = judge(batch.column("text").to_pylist())
            stays = [name != UNKNOWN and score >= least_score for name, score in zip(names, scores.tolist(), strict=True)]
            yield batch.filter(pa.array(stays, type=pa.bool_()))

    return common.in_place(docs, kept)
