"""Whole Arrow batches of texts as byte arrays: words, word hashes and word shingles without a Python loop.

Words are ``[^\\x20\\x09-\\x0D]+``; all separators are ASCII, so words can be cut on UTF-8 bytes.
Hashes are 64-bit: a random value per byte, a polynomial over the word, and a final mixer.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEPARATORS = (9, 10, 11, 12, 13, 32)
BASE = 0x9E3779B97F4A7C15  # odd, so powers have inverses modulo 2**64
STEP = 0xD6E8FEB86659FD93
PIECE_BYTES = 1 << 21
_powers: dict[str, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit words (xor-shift and multiply), in place."""
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xA0761D6478BD642F)
    x ^= x >> np.uint64(32)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if len(_powers.get("up", ())) < n:
        size = max(n, PIECE_BYTES)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[name] = np.cumprod(x, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def is_separator() -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(SEPARATORS)] = True
    return table


def lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string()).cast(pa.large_binary())
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = PIECE_BYTES, most_rows: int = 1 << 30):
    """(rows, bytes, offsets) of runs of whole rows, about ``limit`` bytes and at most ``most_rows`` each; a longer text is a
    piece of its own."""
    for batch in batches:
        data, offsets = bytes_of(batch.column(batch.schema.get_field_index(text)))
        start, n = 0, batch.num_rows
        while start < n:
            stop = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
            stop = min(n, start + most_rows, max(stop, start + 1))
            yield batch.slice(start, stop - start), data[offsets[start] : offsets[stop]], offsets[start : stop + 1] - offsets[start]
            start = stop


def word_bounds(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every word; ``separator`` tells which of the 256 byte values end one."""
    inside = ~(is_separator() if separator is None else separator)[data]
    n = len(data)
    first = np.zeros(n + 1, bool)
    last = np.zeros(n + 1, bool)
    if n:
        first[0], first[1:n] = inside[0], inside[1:] & ~inside[:-1]
        last[n], last[1:n] = inside[-1], inside[:-1] & ~inside[1:]
        cuts = offsets[(offsets > 0) & (offsets < n)]
        first[cuts] |= inside[cuts]
        last[cuts] |= inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last)
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """64-bit hash of each word; ``fold`` reads A-Z as a-z."""
    table = mixed(np.arange(1, 257, dtype=np.uint64))
    if fold:
        table = table[lower_table()]
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * up[: len(data)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts])


def shingle_hashes(words: np.ndarray, row: np.ndarray, rows: int, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles, row by row, and each row's bounds in them.  A row of one to k-1
    words has one shingle, its whole sequence."""
    step = np.uint64(STEP)
    n = max(0, len(words) - k + 1)
    x = words[:n].copy()
    for j in range(1, k):
        x *= step
        x += words[j : n + j]
    whole = row[:n] == row[k - 1 :] if n else np.zeros(0, bool)
    x, at = mixed(x[whole]), row[:n][whole]
    counts = np.bincount(row, minlength=rows)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        first = np.searchsorted(row, short)
        y = words[first].copy()
        for j in range(1, k - 1):
            more = counts[short] > j
            y[more] = y[more] * step + words[first[more] + j]
        y = mixed(y ^ mixed(counts[short].astype(np.uint64)))
        order = np.argsort(np.concatenate([at, short]), kind="stable")
        x, at = np.concatenate([x, y])[order], np.concatenate([at, short])[order]
    return x, np.searchsorted(at, np.arange(rows + 1))
