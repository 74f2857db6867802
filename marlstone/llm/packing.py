"""Minimum bin slack packing of documents into fixed-length token sequences.

Each task tokenizes its documents and packs them in bounded windows of tokens, so nothing is shuffled and memory stays
within a window whatever the input's size. A document's ids are cut at multiples of the capacity; full pieces are
sequences by themselves. The remainders of a window are packed by minimum bin slack: the longest remaining piece opens a
sequence, and a subset-sum dynamic program over the multiset of remaining lengths (a Python integer as bitset) finds
the fill closest to the capacity, whose counts are then backtracked. Pieces of sequences that stay short are carried
into the next window; the last ones of a task are cut into sequences of full capacity and then of powers of two, which
need no padding.

Defined cases: null text is empty (one end id); a text of any length is encoded whole and needs memory of several times
its own size; an empty table gives no row; repeated rows are packed each on its own; a null ``doc_id`` stays null; other
columns are not read. Sequence ids are unique, not dense, and depend on how the
input is split.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .tokens import END_ID, encoder_of, with_ends

CAPACITY = 4096
#: Tokens that one packing window holds at least before it is packed, and bytes of text encoded at a time.
WINDOW_TOKENS, TEXT_BYTES = 2_000_000, 4_000_000
#: A sequence with more free places than this is not closed; its pieces go on to the next window.
OPEN_SLACK = 8
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def best_fill(lengths: list[int], counts: dict[int, int], room: int) -> list[int]:
    """The lengths, with repeats, whose sum is closest to ``room`` from below. ``lengths``: ascending, distinct."""
    mask, reached, steps = (1 << room + 1) - 1, 1, []
    for k in range(bisect_right(lengths, room) - 1, -1, -1):
        length = lengths[k]
        for _ in range(min(counts[length], room // length)):
            more = reached | (reached << length) & mask
            if more == reached:
                break
            steps.append((length, reached))
            reached = more
        if reached >> room & 1:
            break
    total, chosen = reached.bit_length() - 1, []
    for length, before in reversed(steps):
        if not before >> total & 1:
            chosen.append(length)
            total -= length
    return chosen


def minimum_bin_slack(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of positions in ``lengths`` (each 1 to ``capacity``), every position once."""
    places: dict[int, list[int]] = {}
    for k, length in enumerate(lengths):
        places.setdefault(length, []).append(k)
    left, counts, bins = sorted(places), {length: len(x) for length, x in places.items()}, []

    def take(length: int) -> int:
        counts[length] -= 1
        if not counts[length]:
            left.pop(bisect_right(left, length) - 1)
        return places[length].pop()

    while left:
        longest = left[-1]
        own = [take(longest)]
        for length in best_fill(left, counts, capacity - longest):
            own.append(take(length))
        bins.append(own)
    return bins


class _Pieces:
    """Pieces on their way out, as Arrow batches of bounded size."""

    def __init__(self, part: int):
        self.next_id, self.rows = part << 33, []

    def put(self, sequence: list[tuple]) -> None:
        """sequence: pieces (doc_id, start, ids, doc_tokens) in order."""
        offset = 0
        for doc_id, start, ids, doc_tokens in sequence:
            self.rows.append((doc_id, start, len(ids), ids.astype("<u4").tobytes(), doc_tokens, self.next_id, offset))
            offset += len(ids)
        self.next_id += 1

    def batches(self, least: int = 1) -> Iterator[pa.RecordBatch]:
        if len(self.rows) >= least:
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            rows, self.rows = self.rows, []
            for at in range(0, len(rows), 2000):
                yield pa.RecordBatch.from_arrays([pa.array(x, type=k) for x, k in zip(zip(*rows[at : at + 2000], strict=True), kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])


def _pack_window(pieces: list[tuple], out: _Pieces, capacity: int) -> list[tuple]:
    """Puts the well-filled sequences out and returns the pieces of the others."""
    rest = []
    for own in minimum_bin_slack([len(x[2]) for x in pieces], capacity):
        sequence = [pieces[k] for k in own]
        if capacity - sum(len(x[2]) for x in sequence) <= OPEN_SLACK:
            out.put(sequence)
        else:
            rest += sequence
    return rest


def _cut_rest(pieces: list[tuple], out: _Pieces, capacity: int) -> None:
    """Cuts the pieces in a row into sequences of the capacity, then of falling powers of two."""
    left = sum(len(x[2]) for x in pieces)
    pieces = pieces[::-1]
    while left:
        size = capacity if left >= capacity else 1 << left.bit_length() - 1
        left -= size
        sequence = []
        while size:
            doc_id, start, ids, doc_tokens = pieces.pop()
            if len(ids) > size:
                pieces.append((doc_id, start + size, ids[size:], doc_tokens))
                ids = ids[:size]
            sequence.append((doc_id, start, ids, doc_tokens))
            size -= len(ids)
        out.put(sequence)


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, window_tokens: int = WINDOW_TOKENS) -> DataFrame:
    """Every document's ids as pieces in sequences of at most ``capacity`` ids; ``ids`` are little-endian unsigned 32-bit."""

    def packed(batches):
        encoder, out = encoder_of(vocabulary), _Pieces(TaskContext.get().partitionId())
        pieces, held = [], 0
        for batch in common.slices(batches, "text", TEXT_BYTES):
            ids, counts = with_ends(*encoder.encode(common.as_bytes(batch.column("text"))), end_id)
            end = 0
            for doc_id, n in zip(batch.column("doc_id").to_pylist(), counts.tolist(), strict=True):
                own, end = ids[end : end + n], end + n
                cut = n - n % capacity
                for start in range(0, cut, capacity):
                    out.put([(doc_id, start, own[start : start + capacity], n)])
                if cut < n:
                    pieces.append((doc_id, cut, own[cut:].copy(), n))
                    held += n - cut
            if held >= window_tokens:
                pieces = _pack_window(pieces, out, capacity)
                held = sum(len(x[2]) for x in pieces)
            yield from out.batches(500)
        _cut_rest(_pack_window(pieces, out, capacity), out, capacity)
        yield from out.batches()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text")).mapInArrow(packed, SCHEMA)
