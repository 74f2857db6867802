"""Benchmark decontamination by suffix arrays over the training text.

Training documents are cut into shards of bounded bytes. All suffixes of a shard's words are sorted to full depth (by
prefix doubling), whatever the benchmark is; every benchmark suffix is then binary-searched in every shard, first for its
window, whose interval of the array has all occurrences, and, where there is one, for its longest verbatim match.

No list of (place in a document, place in an item) is ever made. Occurrences are intervals per distinct window, marked once
per place of the shard, and windows know the set of their items. A matched text of the benchmark is one interval too, however many
items have it, and an interval names each document in it once, by its first place in the array whose predecessor in the same document
lies before the interval. So a text that repeats one word costs no more than others, against one item or thousands that repeat it.

The benchmark is written to the shared folder in blocks of at most about ``BLOCK_CHARS`` characters; a task holds one block
at a time and the driver none.

Defined cases: null text has no words and no match; items without words match nothing; items with fewer words than a
window are one window; repeated items count once by ``item_id``; an item without id adds hits but no id; rows are judged
one by one, whatever their ``doc_id``, repeated or null; a text of over ``SEGMENT_WORDS`` words has several arrays, whose
parts overlap by a window (a longest match ends with its part); empty tables give no rows or no matches; other columns,
of any name, stay as they are.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blobs, common

WINDOW = 13
#: Characters of benchmark text in one block, bytes of training text in one shard, words of one array, bytes cut into words at a time.
BLOCK_CHARS, SHARD_BYTES, SEGMENT_WORDS, PIECE_BYTES = 8_000_000, 4_000_000, 1 << 21, 1 << 23
#: Words compared at a time in a search, benchmark places searched at a time.
STEP, PLACES = 16, 50_000
#: Places of an array that are passed over together.
SPAN = 512
#: A-Z to a-z, ASCII without letters and digits to space.
PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
MATCH = "struct<item_id: string, item_start: int, doc_start: int, n_words: int>"
MATCHES = pa.list_(pa.struct([("item_id", pa.string()), ("item_start", pa.int32()), ("doc_start", pa.int32()), ("n_words", pa.int32())]))
RESULT = f"doc_id long, n_words long, n_hit long, items array<string>, matches array<{MATCH}>"


def words(text: bytes) -> list[bytes]:
    return text.translate(PLAIN).split()


class _Numbers(dict):
    """Words to numbers from 1 on, in order of their first use."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self) + 1
        return number

    def of(self, text: bytes) -> np.ndarray:
        """A text's word numbers; its words are held for a piece at a time only."""
        parts, at = [], 0
        while at < len(text):
            end = min(len(text), at + PIECE_BYTES)
            while end < len(text) and PLAIN[text[end]] != 32:
                end += 1
            own = words(text[at:end])
            parts.append(np.fromiter(map(self.__getitem__, own), dtype=np.int64, count=len(own)))
            at = end
        return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)


def suffix_array(numbers: np.ndarray) -> np.ndarray:
    """Places of all suffixes in order. numbers: words from 1 on; 0 ends a document (and the last one), each end unlike all others."""
    n, ends = len(numbers), numbers == 0
    first = np.where(ends, np.cumsum(ends) - 1, numbers + ends.sum())
    order = np.argsort(first, kind="stable")
    fresh = np.ones(n, dtype=bool)
    fresh[1:] = first[order[1:]] != first[order[:-1]]
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    tied, depth = np.flatnonzero(~(fresh & np.append(fresh[1:], True))), 1
    while len(tied):
        # a rank is the number of smaller suffixes so far; suffixes that are still tied are sorted by the rank after them
        at = order[tied]
        key = rank[at] * (n + 1) + rank[at + depth]
        by = np.argsort(key)
        at, key = at[by], key[by]
        order[tied] = at
        fresh = np.ones(len(at), dtype=bool)
        fresh[1:] = key[1:] != key[:-1]
        rank[at] = tied[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))]
        tied, depth = tied[~(fresh & np.append(fresh[1:], True))], 2 * depth
    return order


class Block:
    """Benchmark items as one row of word numbers, their distinct windows, and the items of each."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int = WINDOW):
        numbers, self.item_ids = _Numbers(), [item_id for item_id, _ in items]
        rows = [numbers.of(text) for _, text in items]
        self.words, sizes = list(numbers), np.array([len(x) for x in rows], dtype=np.int64)
        starts = np.cumsum(sizes) - sizes
        self.text = np.concatenate([*rows, np.zeros(window + STEP, dtype=np.int64)])
        counts = np.where(sizes, np.maximum(sizes - window, 0) + 1, 0)
        #: every suffix that begins with a window: item, place in it, place in the text, words left in the item
        self.item = np.repeat(np.arange(len(items)), counts)
        self.item_at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        self.at = starts[self.item] + self.item_at
        self.left = sizes[self.item] - self.item_at
        self.size = np.minimum(window, sizes[self.item])
        own = self.text[self.at[:, None] + np.arange(window)] * (np.arange(window) < self.size[:, None])
        _, first, self.window = np.unique(own, axis=0, return_index=True, return_inverse=True)
        #: by distinct window: a suffix that begins with it, and the number of its set of items
        self.first, self.window = first, self.window.reshape(-1)
        pairs = np.unique(self.window * max(1, len(items)) + self.item)
        cuts, numbers_of = np.split(pairs % max(1, len(items)), np.flatnonzero(np.diff(pairs // max(1, len(items)))) + 1), {}
        self.set_of = np.array([numbers_of.setdefault(x.tobytes(), len(numbers_of)) for x in cuts] if len(pairs) else [], dtype=np.int64)
        self.sets = [np.frombuffer(x, dtype=np.int64).tolist() for x in numbers_of]


class Shard:
    """The suffix array of training words (documents end with 0) and the searches in it for a block's suffixes."""

    def __init__(self, numbers: np.ndarray):
        self.n, self.order = len(numbers), suffix_array(numbers)
        self.text = np.append(numbers, np.zeros(STEP, dtype=np.int64))
        # the document of each suffix of the array, and the suffix of the same document before it
        doc = (np.cumsum(numbers == 0) - (numbers == 0))[self.order]
        by = np.argsort(doc, kind="stable")
        self.before = np.full(self.n, -1, dtype=np.int64)
        same = doc[by[1:]] == doc[by[:-1]]
        self.before[by[1:][same]] = by[:-1][same]
        self.least = np.minimum.reduceat(self.before, np.arange(0, self.n, SPAN)) if self.n else self.before

    def documents(self, low: int, high: int) -> np.ndarray:
        """One suffix of each document that has suffixes in an interval of the array; spans without a first one are passed over."""
        spans = np.arange(low // SPAN, (high - 1) // SPAN + 1)
        spans = spans[self.least[spans] < low]
        at = (spans[:, None] * SPAN + np.arange(SPAN)).ravel()
        at = at[(at >= low) & (at < high)]
        return at[self.before[at] < low]

    def _compared(self, at: np.ndarray, wanted: np.ndarray, start: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sign of the array's suffixes ``at`` against ``limit`` words of ``wanted`` from ``start`` on, and how many words are equal."""
        sign, same, open_, done = np.zeros(len(at), dtype=np.int64), limit.copy(), np.arange(len(at)), 0
        while len(open_):
            ahead = done + np.arange(STEP)
            own, other = self.text[at[open_, None] + ahead], wanted[start[open_, None] + ahead]
            differ = (own != other) & (ahead < limit[open_, None])
            found, k = differ.any(1), differ.argmax(1)
            row = np.flatnonzero(found)
            sign[open_[row]] = np.sign(own[row, k[row]] - other[row, k[row]])
            same[open_[row]] = done + k[row]
            done += STEP
            open_ = open_[~found & (limit[open_] > done)]
        return sign, same

    def _bound(self, wanted, start, limit, low, high, after: bool) -> np.ndarray:
        """How many suffixes come before the wanted words (with ``after``: or begin with them), known to be within low .. high."""
        low, high = low.copy(), high.copy()
        while len(open_ := np.flatnonzero(low < high)):
            mid = (low[open_] + high[open_]) // 2
            sign, _ = self._compared(self.order[mid], wanted, start[open_], limit[open_])
            less = sign <= 0 if after else sign < 0
            low[open_[less]], high[open_[~less]] = mid[less] + 1, mid[~less]
        return low

    def interval(self, wanted, start, limit, low=None, high=None) -> tuple[np.ndarray, np.ndarray]:
        low = np.zeros(len(start), dtype=np.int64) if low is None else low
        high = np.full(len(start), self.n, dtype=np.int64) if high is None else high
        low = self._bound(wanted, start, limit, low, high, False)
        return low, self._bound(wanted, start, limit, low, high, True)

    def longest(self, wanted, start, limit, low, high) -> np.ndarray:
        """Words of the longest match of each wanted suffix with one of the suffixes low .. high (not empty)."""
        at = self._bound(wanted, start, limit, low, high, False)
        sames = [self._compared(self.order[np.clip(at + k, low, high - 1)], wanted, start, limit)[1] for k in (-1, 0)]
        return np.maximum(*sames)


def _members(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of intervals of the array, and the interval of each."""
    n = high - low
    return np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum()), np.repeat(np.arange(len(n)), n)


def _matched(shard: Shard, block: Block, wanted: np.ndarray):
    """(places, sizes, item sets) of all occurrences of windows; (place, item, place in it, words) of longest matches, one of each document and place of the benchmark."""
    nothing = np.zeros(0, dtype=np.int64)
    absent = np.concatenate([[0], np.cumsum(wanted < 0)])
    first = block.first
    asked = np.flatnonzero(absent[block.at[first] + block.size[first]] == absent[block.at[first]])  # all words are in the shard
    lows, highs = np.zeros(len(first), dtype=np.int64), np.zeros(len(first), dtype=np.int64)
    for k in range(0, len(asked), PLACES):
        own = asked[k : k + PLACES]
        lows[own], highs[own] = shard.interval(wanted, block.at[first[own]], block.size[first[own]])
    hit = np.flatnonzero(highs > lows)
    if not len(hit):
        return (nothing,) * 3, (nothing,) * 4
    where, row = _members(lows[hit], highs[hit])
    occurrences = shard.order[where], block.size[first[hit[row]]], block.set_of[hit[row]]
    places = np.flatnonzero(highs[block.window] > lows[block.window])
    length = np.zeros(len(places), dtype=np.int64)
    for k in range(0, len(places), PLACES):
        own = places[k : k + PLACES]
        length[k : k + PLACES] = shard.longest(wanted, block.at[own], block.left[own], lows[block.window[own]], highs[block.window[own]])
    # a match that is the rest of the one a place before says nothing new
    rest = np.zeros(len(places), dtype=bool)
    rest[1:] = (np.diff(block.at[places]) == 1) & (block.item[places[1:]] == block.item[places[:-1]]) & (length[:-1] == length[1:] + 1)
    places, length = places[~rest], length[~rest]
    low, high = shard.interval(wanted, block.at[places], length, lows[block.window[places]], highs[block.window[places]])
    # places of the benchmark that match with the same words share an interval, which is searched for its documents once
    intervals, own = np.unique(np.stack([low, high]), axis=1, return_inverse=True)
    found = [shard.documents(a, b) for a, b in intervals.T.tolist()]
    sizes, own = np.array([len(x) for x in found]), own.reshape(-1)
    row = np.repeat(np.arange(len(own)), sizes[own])
    at = np.repeat((np.cumsum(sizes) - sizes)[own], sizes[own]) + np.arange(len(row)) - np.repeat(np.cumsum(sizes[own]) - sizes[own], sizes[own])
    return occurrences, (shard.order[np.concatenate(found)[at]], block.item[places[row]], block.item_at[places[row]], length[row])


class _Judged:
    """What a slice of documents shares with the benchmark, block by block."""

    def __init__(self, texts: list[bytes], window: int):
        self.numbers = _Numbers()
        runs = [self.numbers.of(text) for text in texts]
        self.counts = np.array([len(x) for x in runs], dtype=np.int64)
        self.starts = np.cumsum(self.counts + 1) - self.counts - 1
        self.text = np.concatenate([part for own in runs for part in (own, [0])]).astype(np.int64)
        self.doc = np.repeat(np.arange(len(texts)), self.counts + 1)
        self.edges = np.zeros(len(self.text) + 1, dtype=np.int64)
        self.items: list[set] = [set() for _ in texts]
        self.item_ids: list = []
        self.found: list[np.ndarray] = []
        step = SEGMENT_WORDS - window + 1
        self.segments = range(0, max(1, len(self.text) - window + 1), step) if len(self.text) > SEGMENT_WORDS else [0]
        self.shard = None

    def _shards(self):
        if len(self.segments) > 1:
            for begin in self.segments:
                yield begin, Shard(np.append(self.text[begin : begin + SEGMENT_WORDS], 0))
        else:
            self.shard = self.shard or Shard(self.text)
            yield 0, self.shard

    def ask(self, block: Block) -> None:
        numbers = np.fromiter((self.numbers.get(w, -1) for w in block.words), dtype=np.int64, count=len(block.words))
        wanted = np.append(numbers, -1)[block.text - 1]  # ends of items and words that aren't there: -1
        for begin, shard in self._shards():
            (at, size, sets), (place, item, item_at, n) = _matched(shard, block, wanted)
            if not len(at):
                continue
            np.add.at(self.edges, begin + at, 1)
            np.add.at(self.edges, begin + at + size, -1)
            for pair in np.unique(self.doc[begin + at] * len(block.sets) + sets).tolist():
                doc, own = divmod(pair, len(block.sets))
                self.items[doc].update(block.item_ids[k] for k in block.sets[own])
            doc = self.doc[begin + place]
            self.found.append(np.stack([doc, item + len(self.item_ids), item_at, begin + place - self.starts[doc], n]))
        self.item_ids += block.item_ids

    def matches(self) -> pa.Array:
        """The matches of each document, as numbers until here."""
        doc, item, item_at, place, _ = own = np.concatenate([np.zeros((5, 0), dtype=np.int64), *self.found], axis=1)
        doc, item, item_at, place, n = own[:, np.lexsort((place, item_at, item, doc))]
        ids = pa.array(self.item_ids).cast(pa.string()).take(pa.array(item))
        each = pa.StructArray.from_arrays([ids, *(pa.array(x.astype(np.int32)) for x in (item_at, place, n))], fields=list(MATCHES.value_type))
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(self.starts) + 1)).astype(np.int32)), each)

    def hits(self) -> np.ndarray:
        """Words of each document inside an occurrence."""
        inside = np.concatenate([[0], np.cumsum(np.cumsum(self.edges[:-1]) > 0)])
        return inside[self.starts + self.counts] - inside[self.starts]


@lru_cache(maxsize=1)
def _loaded(path: str, window: int) -> Block:
    with blobs.read_at(path) as file:
        table = pa.ipc.open_stream(file.read()).read_all()
    items = set(zip(table.column("item_id").to_pylist(), common.as_bytes(table.column("text").combine_chunks()), strict=True))
    return Block(sorted(items, key=lambda x: (x[0] is None, x[0] or "", x[1])), window)


def written_blocks(benchmark: DataFrame, folder: str | None = None) -> list[str]:
    """Writes the benchmark in blocks of bounded size and returns their paths."""
    folder = folder or f"{common.shared_folder(benchmark.sparkSession)}/blocks"
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), common.text_of().alias("text"))
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, -(-chars // BLOCK_CHARS))))

    def write(table: pa.Table) -> pa.Table:
        path = blobs.attempt_name(folder, table.column("block")[0].as_py(), ".arrow")
        own = table.select(["item_id", "text"])
        with blobs.create(path) as out, pa.ipc.new_stream(out, own.schema) as stream:
            stream.write_table(own)
        return pa.table({"path": [path]})

    return sorted(r.path for r in common.written(items.withColumn("block", block).groupBy("block").applyInArrow(write, "path string"), "blocks").collect())


def _judge(batches, paths: list[str], window: int):
    """(slice, what it shares) of Arrow batches with a column ``text``."""
    for batch in common.slices(batches, "text", SHARD_BYTES):
        text = batch.column("text")
        own = _Judged(common.as_bytes(text if pa.types.is_string(text.type) or pa.types.is_binary(text.type) else text.cast(pa.string())), window)
        for path in paths:
            own.ask(_loaded(path, window))
        yield batch, own


def find_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """A row per document: its words, those inside an occurrence of a window, the items whose windows occur, and the matches.

    ``matches`` are the longest verbatim matches of benchmark suffixes in the document's shard that the document has, each at
    one of its places there; one that is the rest of another is left out."""
    paths = written_blocks(benchmark)

    def run(batches):
        for batch, own in _judge(batches, paths, window):
            items = [sorted(x for x in found if x is not None) for found in own.items]
            columns = [batch.column("doc_id"), pa.array(own.counts), pa.array(own.hits()), pa.array(items, type=pa.list_(pa.string())), own.matches()]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_hit", "items", "matches"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text")).mapInArrow(run, RESULT)


def judged(found: DataFrame) -> DataFrame:
    """Matches -> verdict: contaminated if at least a twentieth of the words is hit."""
    return found.select("doc_id", "n_words", "n_hit", "items", ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents that aren't contaminated, with all their columns; each row is judged where it is read, nothing is shuffled."""
    paths = written_blocks(benchmark)

    def kept(batches):
        for batch, own in _judge(batches, paths, window):
            hits = own.hits()
            yield batch.filter(pa.array((hits == 0) | (20 * hits < own.counts)))

    return common.in_place(docs, kept)


ORACLE = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS l FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS l FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(l), 13) AS size, array_to_string(l[k:k + least(len(l), 13) - 1], ' ') AS c FROM (SELECT item_id, l, unnest(range(1, greatest(len(l) - 12, 1) + 1)) AS k FROM b WHERE len(l) > 0)),
dw AS (SELECT doc_id, size, k, array_to_string(l[k:k + size - 1], ' ') AS c FROM (SELECT doc_id, l, size, unnest(range(1, len(l) - size + 2)) AS k FROM d CROSS JOIN (SELECT DISTINCT size FROM iw) WHERE len(l) >= size)),
o AS (SELECT doc_id, dw.size, k, item_id FROM dw JOIN iw ON dw.size = iw.size AND dw.c = iw.c),
h AS (SELECT doc_id, count(DISTINCT k + s) AS n FROM o CROSS JOIN range(13) r(s) WHERE s < size GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM o) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(l) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(i.n, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(l) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)
"""
