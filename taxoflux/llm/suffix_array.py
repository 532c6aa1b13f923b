"""Suffix arrays by induced sorting, on NumPy arrays.

Suffixes are classified as S or L; the leftmost S suffixes (LMS) are sorted, and one scan up and one
scan down the buckets induce the order of all others, in linear time.  A scan handles a bucket's
entries together: the entries that a bucket already holds induce their predecessors in one batch, and
only a run of one repeated character needs further batches.  LMS substrings are sorted by the same
induction, named, and the string of names is sorted recursively; a string with more names than
MAX_BUCKETS is ranked by doubling instead, since its buckets are too small to batch.

``depth`` bounds the order that the caller needs: suffixes that agree on so many characters may stand in
any order, but stand together.
"""
from __future__ import annotations

import numpy as np

MAX_BUCKETS = 1024


def _ranked_by_doubling(s: np.ndarray, depth: int) -> np.ndarray:
    rank, h, n = s.astype(np.int64), 1, len(s)
    order = np.argsort(rank, kind="stable")
    while True:
        sorted_rank = rank[order]
        fresh = np.ones(n, bool)
        fresh[1:] = sorted_rank[1:] != sorted_rank[:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh) - 1
        if h >= depth or fresh.all():
            return order
        nxt = np.zeros(n, np.int64)
        nxt[: n - h] = rank[h:] + 1
        rank = rank * np.int64(n + 1) + nxt
        order = np.argsort(rank, kind="stable")
        h *= 2


def _by_bucket(chars: np.ndarray, sigma: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stable order by char, char in that order, place within the char's group)"""
    order = np.argsort(chars, kind="stable")
    chars = chars[order]
    counts = np.bincount(chars, minlength=sigma)
    return order, chars, np.arange(len(chars)) - (np.cumsum(counts) - counts)[chars]


def _induce(s, s_type, lms, sigma, sizes) -> np.ndarray:
    ends = np.cumsum(sizes)
    starts = ends - sizes
    sa = np.full(len(s), -1, np.int32)
    order, chars, place = _by_bucket(s[lms], sigma)
    lms_count = np.bincount(chars, minlength=sigma)
    sa[ends[chars] - lms_count[chars] + place] = lms[order]
    head = starts.copy()

    def push_large(batch):
        j = batch - 1
        j = j[j >= 0]
        j = j[~s_type[j]]
        if len(j):
            order, chars, place = _by_bucket(s[j], sigma)
            sa[head[chars] + place] = j[order]
            head[:] += np.bincount(chars, minlength=sigma)

    used = np.flatnonzero(sizes)
    for c in used:
        done = starts[c]
        while done < head[c]:
            batch, done = sa[done : head[c]], head[c]
            push_large(batch)
        if lms_count[c]:
            push_large(sa[ends[c] - lms_count[c] : ends[c]])
    tail = ends.copy()
    tail[0] = ends[0] - 1  # the end mark itself

    def push_small(batch):
        j = batch - 1
        j = j[j >= 0]
        j = j[s_type[j]]
        if len(j):
            order, chars, place = _by_bucket(s[j], sigma)
            sa[tail[chars] - 1 - place] = j[order]
            tail[:] -= np.bincount(chars, minlength=sigma)

    for c in used[::-1]:
        done = ends[c]
        while tail[c] < done:
            batch, done = sa[tail[c] : done][::-1], tail[c]
            push_small(batch)
        if head[c] > starts[c]:
            push_small(sa[starts[c] : head[c]][::-1])
    return sa


def suffix_array(s: np.ndarray, sigma: int, depth: int = 1 << 60) -> np.ndarray:
    """Starts of the suffixes of ``s`` in order.  Values are below sigma; the last one is 0 and occurs once."""
    n = len(s)
    if n < 64 or sigma > MAX_BUCKETS:
        return _ranked_by_doubling(s, depth)
    s = s.astype(np.int32)
    up, same = s[:-1] < s[1:], s[:-1] == s[1:]
    at = np.where(same, n, np.arange(n - 1))
    at = np.minimum.accumulate(at[::-1])[::-1]
    s_type = np.ones(n, bool)
    s_type[:-1] = up[at]
    lms = np.flatnonzero(s_type[1:] & ~s_type[:-1]) + 1
    sizes = np.bincount(s, minlength=sigma)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    sa = _induce(s, s_type, lms, sigma, sizes)
    found = sa[is_lms[sa]].astype(np.int64)
    # equal LMS substrings have equal length and equal polynomial sums
    base = np.uint64(0x9E3779B97F4A7C15)
    weights = np.full(n + 1, base, np.uint64)
    weights[0] = 1
    weights = np.cumprod(weights, dtype=np.uint64)
    value = (s.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    value ^= value >> np.uint64(29)
    value *= np.uint64(0xA0761D6478BD642F)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(value * weights[:n], out=sums[1:])
    stop = np.empty(n, np.int64)
    stop[lms] = np.append(lms[1:], n - 1)
    a, b = found[:-1], found[1:]
    # both sums are brought to the larger start by multiplying with the difference of the starts
    low, high = np.minimum(a, b), np.maximum(a, b)
    equal = (stop[a] - a == stop[b] - b) & ((sums[stop[low] + 1] - sums[low]) * weights[high - low] == sums[stop[high] + 1] - sums[high])
    names = np.zeros(len(found), np.int64)
    names[1:] = np.cumsum(~equal)
    if names[-1] + 1 < len(found):
        by_text = np.empty(n, np.int64)
        by_text[found] = names
        inner = suffix_array(by_text[lms], int(names[-1]) + 1, depth)
        found = lms[inner]
    return _induce(s, s_type, found, sigma, sizes)


def permuted_common_prefixes(s: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """How many of its first ``length`` bytes each suffix of ``at`` (in suffix order) shares with the one before it (the
    first: none).  They are found in text order, as permuted common prefixes are, eight bytes at once.
    ``s`` holds bytes; all of at + length lie inside it."""
    shared = np.zeros(len(at), np.int64)
    if len(at) < 2:
        return shared
    words = np.zeros(len(s), np.uint64)
    for j in range(8):
        words[: len(s) - j] |= s[j:].astype(np.uint64) << np.uint64(8 * j)
    order = np.argsort(at[1:], kind="stable")
    here, before = at[1:][order], at[:-1][order]
    common = np.zeros(len(here), np.int64)  # by place in the text
    live = np.arange(len(here))
    for j in [*range(0, length - 8, 8), length - 8]:
        differ = words[here[live] + j] ^ words[before[live] + j]
        low = differ & (~differ + np.uint64(1))  # the lowest bit that differs tells the first byte that does
        common[live] = np.maximum(common[live], j + np.where(differ == 0, 8, np.floor(np.log2(np.maximum(low, 1).astype(float))).astype(np.int64) // 8))
        live = live[differ == 0]
    shared[order + 1] = common
    return shared
