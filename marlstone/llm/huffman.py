"""Canonical length-limited Huffman codes over integers: lengths by package-merge, encoding and table-driven decoding in NumPy."""

from __future__ import annotations

import numpy as np

MAX_BITS = 16


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Bits of each symbol's code, 0 for symbols that don't occur; optimal under ``max_bits`` (package-merge)."""
    counts = np.asarray(counts, dtype=np.int64)
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), dtype=np.uint8)
    if len(used) > 1 << max_bits:
        raise ValueError(f"{len(used)} symbols need more than {max_bits} bits")
    if len(used) < 2:
        out[used] = 1
        return out
    used = used[np.argsort(counts[used], kind="stable")]
    weights = counts[used]
    merged, leaves = weights, [np.ones(len(used), dtype=bool)]
    for _ in range(max_bits - 1):
        pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
        order = np.argsort(np.concatenate([weights, pairs]), kind="stable")
        merged = np.concatenate([weights, pairs])[order]
        leaves.append(order < len(weights))
    lengths, take = np.zeros(len(used), dtype=np.int64), 2 * len(used) - 2
    for is_leaf in reversed(leaves):
        n = int(is_leaf[:take].sum())
        lengths[:n] += 1
        take = 2 * (take - n)
    out[used] = lengths
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, symbol)."""
    codes, code, last = np.zeros(len(lengths), dtype=np.uint64), 0, 0
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    sorted_lengths = lengths[order].astype(int)
    for bits in range(1, int(sorted_lengths.max(initial=0)) + 1):
        own = order[sorted_lengths == bits]
        code <<= bits - last
        codes[own] = code + np.arange(len(own), dtype=np.uint64)
        code, last = code + len(own), bits
    return codes


def decoding_table(lengths: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """For each window of ``max_bits`` bits: symbol << 8 | bits of its code."""
    table, codes = np.zeros(1 << max_bits, dtype=np.int64), canonical_codes(lengths).astype(np.int64)
    symbols = np.flatnonzero(lengths)
    order = symbols[np.lexsort((symbols, lengths[symbols]))]
    spans = 1 << (max_bits - lengths[order].astype(np.int64))
    at = codes[order] << (max_bits - lengths[order].astype(np.int64))
    if len(order):
        table[at[0] : at[0] + spans.sum()] = np.repeat(order.astype(np.int64) << 8 | lengths[order], spans)
    return table


def encode(symbols: np.ndarray, lengths: np.ndarray, codes: np.ndarray, every: int) -> tuple[bytes, np.ndarray, int]:
    """Bits, first bit of each run of ``every`` symbols, number of bits."""
    n = lengths[symbols].astype(np.uint64)
    ends = np.cumsum(n)
    if not len(symbols):
        return b"", np.zeros(0, dtype="<u8"), 0
    starts, total = ends - n, int(ends[-1])
    word = (starts >> np.uint64(5)).astype(np.int64)
    # every code stands in a 64-bit window that begins at its 32-bit word; windows of a word add up, as bits don't overlap
    value = codes[symbols] << (np.uint64(64) - (starts & np.uint64(31)) - n)
    first = np.flatnonzero(np.diff(word, prepend=-1))
    sums = np.add.reduceat(value, first)
    out = np.zeros(int(word[-1]) + 2, dtype=np.uint64)
    out[word[first]] = sums >> np.uint64(32)
    out[word[first] + 1] += sums & np.uint64(0xFFFFFFFF)
    return out.astype(">u4").tobytes()[: (total + 7) // 8], starts[::every].astype("<u8"), total


def decode(data: bytes, checkpoints: np.ndarray, n: int, table: np.ndarray, every: int, max_bits: int = MAX_BITS) -> np.ndarray:
    """All checkpoints are decoded side by side, one symbol of each at a time."""
    if not n:
        return np.zeros(0, dtype=np.int64)
    raw = np.frombuffer(data + bytes(4), dtype=np.uint8).astype(np.uint32)
    at, lanes = checkpoints.astype(np.int64), len(checkpoints)
    wide = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
    out = np.zeros((every, lanes), dtype=np.int64)
    last, mask = n - (lanes - 1) * every, (1 << max_bits) - 1
    for k in range(every):
        if k == last:
            at = at[:-1]
        if not len(at):
            break
        entry = table[wide[at >> 3] >> (32 - max_bits - (at & 7)) & mask]
        out[k, : len(at)] = entry >> 8
        at = at + (entry & 255)
    return out.T.reshape(-1)[:n]
