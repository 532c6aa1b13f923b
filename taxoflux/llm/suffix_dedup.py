"""Operator 9: remove passages of 50 bytes or more that an earlier document has, by suffix arrays.

A byte goes if a 50-byte string that covers it also starts in a document with a smaller id; strings are
judged on the input.  The corpus is cut into shards of bounded size so that equal strings meet:

1. Texts are dealt into chunks.  Minimizers: of the SEED-byte strings inside every 50-byte window, the
   one with the least hash is taken.  Equal windows have equal minimizers, so nothing is lost; one byte in
   sixteen starts one.  A chunk gives each of its minimizers once, with its smallest and largest
   document, so a frequent passage is a row a chunk, not a row a document.
2. Rows are dealt by minimizer and sorted.  One that occurs in two documents gets the smallest
   document as its leader and goes back to its chunks.
3. There each document cuts out the bytes around its repeated minimizers, merged per leader.  If two
   documents share a window, they share its minimizer, hence its leader: the window is in both cuts.
4. The cuts of a leader make a shard.  A shard's suffix array is induced (see suffix_array), neighbours
   whose permuted common prefixes reach 50 bytes form runs, and a run's windows in other than its smallest
   document are removed.  A large leader's cuts make several shards, its blocks.  Each gives every window
   that it has once, by hash, with its smallest document, packed by range of hash; a block whose smallest document of a window
   is not the smallest of all loses that window everywhere.  No two blocks are ever compared as such.
5. The removed runs go back to the texts' chunks, where they are merged and the rest is kept.

Exact copies of an earlier text take no part in 1 to 4: all they hold is in the first copy.  Minimizers and the
windows of large leaders are compared by 48- and 64-bit hashes, what is removed within a shard by its bytes.

Defined cases: null text is empty and loses nothing, like any text below 50 bytes; a null doc_id
counts as larger than any other; rows of equal doc_id are one document's parts and don't remove
each other's bytes; an empty table gives no rows; other columns are ignored.
"""
from __future__ import annotations

import collections
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxoflux.llm.chunks import TEXTS, Chunks, by_chunk, column, values
from taxoflux.llm.runtime import Scratch, lean
from taxoflux.llm.suffix_array import permuted_common_prefixes, suffix_array
from taxoflux.llm.textbytes import mixed, pieces, powers

LENGTH = 50
SEED = 20
BLOCK_BYTES = 1_000_000
CHUNK_BYTES = 24_000_000
LAST = (1 << 63) - 1  # stands for a null doc_id


def _slide(x: np.ndarray, w: int, f) -> np.ndarray:
    """f over every w neighbouring values, by doubling."""
    size = 1
    while 2 * size <= w:
        x = f(x[:-size], x[size:])
        size *= 2
    return f(x[: len(x) - (w - size)], x[w - size :]) if size < w else x


def minimizers(data: np.ndarray, offsets: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the least seed-byte string of every window of ``length`` bytes inside a row."""
    n, w = len(data), length - seed + 1
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mixed(np.arange(1, 257, dtype=np.uint64))[data] * up[:n], out=sums[1:])
    h = mixed((sums[seed:] - sums[:-seed]) * down[: n - seed + 1])
    h >>= np.uint64(16)
    h |= np.uint64(1)  # 48 bits, never 0
    least = _slide(h, w, np.minimum)
    for edge in offsets[1:]:  # windows that cross into the next row don't count
        least[max(0, int(edge) - length + 1) : int(edge)] = 0
    pad = np.zeros(w - 1, np.uint64)
    at = np.flatnonzero(_slide(np.concatenate([pad, least, pad]), w, np.maximum) == h)
    return at, h[at]


def by_text(batches):
    """Rows by chunk, of kinds COPY, SIDE, TEXTS -> (chunk, side rows, texts that are no copies) piece by piece."""
    chunk, copies, side = None, set(), []
    for number, kind, rows in by_chunk(batches):
        if number != chunk:
            chunk, copies, side = number, set(), []
        if kind == COPY:
            copies.update(zip(values(rows, "uid").tolist(), values(rows, "doc").tolist()))
        elif kind == SIDE:
            side.append(rows)
        else:
            if copies:
                rows = rows.filter(pa.array([x not in copies for x in zip(values(rows, "uid").tolist(), values(rows, "doc").tolist())]))
            yield chunk, side, rows


COPY, SIDE = 0, 1


def seeds_of(length: int, seed: int, flush: int = 2_000_000):
    """Copies and texts by chunk -> (seed, chunk, low, high): each minimizer with its smallest and largest document."""
    schema = pa.schema([("seed", pa.int64()), ("chunk", pa.int32()), ("low", pa.int64()), ("high", pa.int64())])

    def out(chunk, parts):
        h, doc = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(h, kind="stable")
        h, doc = h[order], doc[order]
        start = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
        if len(h):
            low, high = np.minimum.reduceat(doc, start), np.maximum.reduceat(doc, start)
            for a in range(0, len(start), 100_000):
                b = slice(a, a + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(h[start[b]].view(np.int64)), pa.array(np.full(len(start[b]), chunk, np.int32)), pa.array(low[b]), pa.array(high[b])], schema=schema)

    def run(batches):
        chunk, parts, held = None, [], 0
        for number, _, rows in by_text(batches):
            if parts and (number != chunk or held > flush):
                yield from out(chunk, parts)
                parts, held = [], 0
            chunk = number
            for part, data, offsets in pieces([rows]):
                at, h = minimizers(data, offsets, length, seed)
                parts.append((h, values(part, "doc")[np.searchsorted(offsets, at, "right") - 1]))
                held += len(h)
        if parts:
            yield from out(chunk, parts)

    return run


def led(batches):
    """Rows (seed, chunk, low, high) sorted by seed -> (chunk, kind, seed, leader) of seeds that two documents have."""
    schema = pa.schema([("chunk", pa.int32()), ("kind", pa.int32()), ("seed", pa.int64()), ("leader", pa.int64())])

    def close(parts):
        seed, chunk, low, high = (np.concatenate(x) for x in zip(*parts))
        if not len(seed):
            return
        start = np.flatnonzero(np.append(True, seed[1:] != seed[:-1]))
        leader, last = np.minimum.reduceat(low, start), np.maximum.reduceat(high, start)
        size = np.diff(np.append(start, len(seed)))
        take = np.repeat(leader != last, size)
        n = int(take.sum())
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(chunk[take]), pa.array(np.full(n, SIDE, np.int32)), pa.array(seed[take]), pa.array(np.repeat(leader, size)[take])], schema=schema)

    held: list[tuple] = []
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not batch.num_rows:
            continue
        last = int(np.searchsorted(columns[0], columns[0][-1]))  # the last seed may go on in the next batch
        if last or (held and held[0][0][0] != columns[0][0]):
            yield from close([*held, tuple(c[:last] for c in columns)])
            held = []
        held.append(tuple(c[last:] for c in columns))
    if held:
        yield from close(held)


def cuts_of(length: int, seed: int):
    """Copies, repeated seeds with their leaders and texts by chunk -> (leader, chunk, uid, doc, start, bytes) cuts."""
    schema = pa.schema([("leader", pa.int64()), ("chunk", pa.int32()), ("uid", pa.int64()), ("doc", pa.int64()), ("start", pa.int64()), ("cut", pa.binary())])
    before = length - seed

    def run(batches):
        chunk, known, leads = None, None, None
        for number, side, rows in by_text(batches):
            if number != chunk:
                chunk = number
                known, leads = (np.concatenate([values(r, c) for r in side]) if side else np.zeros(0, np.int64) for c in ("seed", "leader"))
                order = np.argsort(known)
                known, leads = known[order].view(np.uint64), leads[order]
            if not len(known):
                continue
            for part, data, offsets in pieces([rows]):
                pos, h = minimizers(data, offsets, length, seed)
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                found = known[at] == h
                pos, leader = pos[found], leads[at[found]]
                if not len(pos):
                    continue
                row = np.searchsorted(offsets, pos, "right") - 1
                order = np.lexsort((pos, leader, row))
                pos, leader, row = pos[order], leader[order], row[order]
                lo, hi = np.maximum(offsets[row], pos - before), np.minimum(offsets[row + 1], pos + length)
                fresh = np.ones(len(pos), bool)
                fresh[1:] = (leader[1:] != leader[:-1]) | (row[1:] != row[:-1]) | (lo[1:] > hi[:-1])
                start = np.flatnonzero(fresh)
                stop = np.append(start[1:], len(pos)) - 1
                whole = hi[stop] - lo[start] >= length
                start, stop = start[whole], stop[whole]
                a, b, row, leader = lo[start], hi[stop], row[start], leader[start]
                cuts = pa.array([data[x:y].tobytes() for x, y in zip(a.tolist(), b.tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(leader), pa.array(np.full(len(a), chunk, np.int32)), pa.array(values(part, "uid")[row]), pa.array(values(part, "doc")[row]), pa.array(a - offsets[row]), cuts], schema=schema)

    return run


class Shard:
    """The windows of some cuts (uid, doc, start, bytes, chunk): ``at`` in suffix order, ``run`` numbers equal ones."""

    def __init__(self, cuts: list[tuple], length: int):
        self.cuts, self.length = cuts, length
        text = b"\x00".join(c[3] for c in cuts)
        sizes = np.array([len(c[3]) for c in cuts])
        self.starts = np.cumsum(sizes + 1) - sizes - 1
        self.raw = np.frombuffer(text, np.uint8)
        s = np.zeros(len(self.raw) + 1, np.int32)
        s[:-1] = self.raw
        s[:-1] += 2
        s[self.starts[1:] - 1] = 1  # between cuts
        self.owner = np.repeat(np.arange(len(cuts)), np.append(sizes[:-1] + 1, sizes[-1]))
        self.inside = np.arange(len(self.raw)) + length <= (self.starts + sizes)[self.owner]
        self.text = s

    def sort(self) -> None:
        sa = suffix_array(self.text, 258, self.length)
        sa = sa[sa < len(self.raw)]
        self.at = sa[self.inside[sa]].astype(np.int64)
        fresh = permuted_common_prefixes(self.raw, self.at, self.length) < self.length
        self.first = np.flatnonzero(fresh)
        self.run = np.cumsum(fresh) - 1
        self.doc = np.array([c[1] for c in self.cuts], np.int64)[self.owner[self.at]]
        self.least = np.minimum.reduceat(self.doc, self.first) if len(self.first) else np.zeros(0, np.int64)

    def repeated(self) -> np.ndarray:
        """Starts of the windows that a smaller document of the shard has."""
        return np.sort(self.at[self.doc > self.least[self.run]])

    def hashes(self) -> np.ndarray:
        """64-bit hashes of the strings of ``length`` bytes at every place; past the end they mean nothing."""
        up, down = powers(len(self.raw) + 1)
        sums = np.zeros(len(self.raw) + 1, np.uint64)
        np.cumsum(mixed(np.arange(1, 257, dtype=np.uint64))[self.raw] * up[: len(self.raw)], out=sums[1:])
        n = max(0, len(self.raw) - self.length + 1)
        h = np.zeros(len(self.raw), np.uint64)
        h[:n] = mixed((sums[self.length :] - sums[: n]) * down[:n])
        return h

    def spans(self, gone: np.ndarray):
        """Window starts in order -> (chunk, uid, doc, start, stop) of the runs of bytes that they cover."""
        if not len(gone):
            return
        fresh = np.ones(len(gone), bool)
        fresh[1:] = (gone[1:] > gone[:-1] + self.length) | (self.owner[gone[1:]] != self.owner[gone[:-1]])
        a = np.flatnonzero(fresh)
        b = np.append(a[1:], len(gone)) - 1
        for lo, hi in zip(gone[a].tolist(), gone[b].tolist()):
            uid, doc, start, _, chunk = self.cuts[self.owner[lo]]
            base = start - int(self.starts[self.owner[lo]])
            yield chunk, uid, doc, lo + base, hi + self.length + base


#: Removed runs; or, with a leader, the windows of a block of it whose hashes begin with ``range``: their hashes in order, and the
#: smallest document of each.
GONE = pa.schema([("chunk", pa.int32()), ("uid", pa.int64()), ("doc", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("leader", pa.int64()), ("block", pa.int32()), ("range", pa.int32()), ("hashes", pa.binary()), ("least", pa.binary())])
GONE_SQL = "chunk int, uid long, doc long, start long, stop long, leader long, block int, range int, hashes binary, least binary"


def gone_rows(spans):
    spans = list(spans)
    if spans:
        n = len(spans)
        yield pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(zip(*spans), GONE)), *(pa.nulls(n, f.type) for f in list(GONE)[5:])], schema=GONE)


def shards_of(batches, block: int):
    """Rows sorted by (leader, block) -> (leader, block, the leader's number of blocks, cuts).  Neighbouring leaders share a shard
    up to ``block`` bytes, which adds nothing wrong: equal strings are equal in any shard."""
    shard, several, cuts, held = None, 1, [], 0
    for batch in batches:
        for leader, number, blocks, chunk, uid, doc, start, cut in zip(*(column(batch, c).to_pylist() for c in ("leader", "block", "blocks", "chunk", "uid", "doc", "start", "cut"))):
            if (leader, number) != shard:
                if cuts and (several > 1 or blocks > 1 or held > block // 2):
                    yield *shard, several, cuts
                    cuts, held = [], 0
                shard, several = (leader, number), blocks
            cuts.append((uid, doc, start, cut, chunk))
            held += len(cut)
    if cuts:
        yield *shard, several, cuts


def removed_in_shards(length: int, block: int):
    """Cuts sorted by leader and block -> removed runs, and windows of large leaders."""

    def run(batches):
        for leader, number, several, cuts in shards_of(batches, block):
            if len(cuts) < 2 and several == 1:
                continue
            shard = Shard(cuts, length)
            shard.sort()
            yield from gone_rows(shard.spans(shard.repeated()))
            if several > 1 and len(shard.first):
                hashes = shard.hashes()[shard.at[shard.first]]
                order = np.argsort(hashes)
                hashes, least = hashes[order], shard.least[order]
                bits = min(MOST_RANGES, max(LEAST_RANGES, several.bit_length() + 2))
                ranges = (hashes >> np.uint64(64 - bits)).astype(np.int64)
                cuts_at = np.flatnonzero(np.append(True, ranges[1:] != ranges[:-1])).tolist()
                rows = [dict(leader=leader, block=number, range=int(ranges[a]), hashes=hashes[a:b].tobytes(), least=least[a:b].tobytes()) for a, b in zip(cuts_at, [*cuts_at[1:], len(hashes)])]
                yield pa.RecordBatch.from_pylist(rows, schema=GONE)

    return run


#: The windows of a block go out in 2 ** bits ranges of hash, more for leaders of more blocks.
LEAST_RANGES, MOST_RANGES = 6, 12


def lost_windows(batches):
    """Windows sorted by (leader, range) -> (leader, block, hash: hashes of the windows that another block has in a smaller document)."""
    schema = pa.schema([("leader", pa.int64()), ("block", pa.int32()), ("hash", pa.binary())])

    def close(rows):
        if len(rows) < 2:
            return
        hashes, least = (np.concatenate([np.frombuffer(r[i], kind) for r in rows]) for i, kind in ((1, np.uint64), (2, np.int64)))
        owner = np.repeat(np.arange(len(rows)), [len(r[1]) // 8 for r in rows])
        order = np.lexsort((least, hashes))
        hashes, least, owner = hashes[order], least[order], owner[order]
        start = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
        lost = least > np.repeat(least[start], np.diff(np.append(start, len(hashes))))
        hashes, owner = hashes[lost], owner[lost]
        order = np.argsort(owner, kind="stable")
        bounds = np.searchsorted(owner[order], np.arange(len(rows) + 1))
        out = [dict(leader=group[0], block=r[0], hash=hashes[order[a:b]].tobytes()) for r, a, b in zip(rows, bounds, bounds[1:]) if b > a]
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    group, rows = None, []
    for batch in batches:
        for leader, number, block, hashes, least in zip(*(column(batch, c).to_pylist() for c in ("leader", "range", "block", "hashes", "least"))):
            if (leader, number) != group:
                yield from close(rows)
                group, rows = (leader, number), []
            rows.append((block, hashes, least))
    yield from close(rows)


def removed_in_blocks(length: int):
    """Hashes of windows to remove, then cuts, sorted by leader and block -> removed runs."""

    def close(hashes, cuts):
        if hashes and cuts:
            shard = Shard(cuts, length)
            hit = shard.inside & np.isin(shard.hashes(), np.frombuffer(b"".join(hashes), np.uint64))
            yield from gone_rows(shard.spans(np.flatnonzero(hit)))

    def run(batches):
        shard, hashes, cuts = None, [], []
        for batch in batches:
            for leader, number, h, chunk, uid, doc, start, cut in zip(*(column(batch, c).to_pylist() for c in ("leader", "block", "hash", "chunk", "uid", "doc", "start", "cut"))):
                if (leader, number) != shard:
                    yield from close(hashes, cuts)
                    shard, hashes, cuts = (leader, number), [], []
                if h is None:
                    cuts.append((uid, doc, start, cut, chunk))
                else:
                    hashes.append(h)
        yield from close(hashes, cuts)

    return run


def kept_parts(with_text: bool):
    """Copies (COPY), removed runs (SIDE) and texts by chunk -> what is left of each text."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())] + [("kept", pa.binary())] * with_text)

    def run(batches):
        chunk, runs = None, {}
        for number, kind, rows in by_chunk(batches):
            if number != chunk:
                chunk, runs = number, collections.defaultdict(list)
            uids, docs = values(rows, "uid").tolist(), values(rows, "doc").tolist()
            if kind != TEXTS:
                for key, a, b in zip(zip(uids, docs), column(rows, "start").to_pylist(), column(rows, "stop").to_pylist()):
                    runs[key].append((0, LAST) if kind == COPY else (a, b))
                continue
            out = []
            for doc_id, key, text in zip(column(rows, "doc_id").to_pylist(), zip(uids, docs), column(rows, "text")):
                raw = text.as_buffer().to_pybytes()
                merged: list[list[int]] = []
                for a, b in sorted(runs.get(key, ())):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, min(b, len(raw))])
                edges = [0, *(x for m in merged for x in m), len(raw)]
                rest = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])) if merged else raw
                out.append((doc_id, len(raw), len(raw) - len(rest), len(merged), hashlib.sha256(rest).hexdigest(), rest)[: len(schema)])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return run


def removed_runs(chunks: Chunks, copies: DataFrame, scratch: Scratch, length: int = LENGTH, seed: int = SEED, block: int = BLOCK_BYTES) -> DataFrame:
    """Texts by chunk, and the (chunk, kind, uid, doc) of copies -> (chunk, kind, uid, doc, start, stop) removed runs."""
    met = chunks.meet(copies, ("uid", "doc", "text"))
    seeds = met.mapInArrow(lean(seeds_of(length, seed)), "seed long, chunk int, low long, high long")
    found = scratch.save(seeds.repartition("seed").sortWithinPartitions("seed").mapInArrow(lean(led), "chunk int, kind int, seed long, leader long"))
    del met, seeds
    scratch.release()
    met = chunks.meet(copies.unionByName(found, allowMissingColumns=True), ("uid", "doc", "text"))
    cuts = scratch.save(met.mapInArrow(lean(cuts_of(length, seed)), "leader long, chunk int, uid long, doc long, start long, cut binary"))
    del met
    scratch.drop(found)
    scratch.release()
    sizes = cuts.groupBy("leader").agg(F.ceil(F.sum(F.octet_length("cut")) / F.lit(block)).cast("int").alias("blocks"))
    large = scratch.save(sizes.where("blocks > 1"))
    cuts = cuts.join(large, "leader", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("uid", "doc", "start"), F.col("blocks")).cast("int"))
    dealt = cuts.repartition("leader", "block").sortWithinPartitions("leader", "block")
    gone = scratch.save(dealt.mapInArrow(lean(removed_in_shards(length, block)), GONE_SQL))
    del dealt
    scratch.release()
    runs = gone.where("leader is null").select("chunk", F.lit(SIDE).alias("kind"), "uid", "doc", "start", "stop")
    if not large.isEmpty():
        windows = gone.where("leader is not null").select("leader", "range", "block", "hashes", "least").repartition("leader", "range").sortWithinPartitions("leader", "range")
        lost = windows.mapInArrow(lean(lost_windows), "leader long, block int, hash binary")
        met = lost.unionByName(cuts.where("blocks > 1").drop("blocks"), allowMissingColumns=True).withColumn("last", F.col("hash").isNull())
        met = met.repartition("leader", "block").sortWithinPartitions("leader", "block", "last")
        more = scratch.save(met.select("leader", "block", "hash", "chunk", "uid", "doc", "start", "cut").mapInArrow(lean(removed_in_blocks(length)), GONE_SQL))
        runs = runs.unionByName(more.select("chunk", F.lit(SIDE).alias("kind"), "uid", "doc", "start", "stop"))
    return runs


def dedup(docs: DataFrame, scratch: Scratch, length: int = LENGTH, with_text: bool = False, chunk_bytes: int = CHUNK_BYTES, **limits) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the kept bytes."""
    # uid tells apart rows of one doc_id; equal rows share it and fare alike
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    base = base.select("doc_id", "text", F.coalesce("doc_id", F.lit(LAST)).alias("doc"), F.xxhash64("text").alias("uid"))
    chunks = Chunks(base, chunk_bytes)
    rows = scratch.save(chunks.texts.where(F.octet_length("text") >= length).select("chunk", "doc", "uid", F.sha2(F.col("text").cast("binary"), 256).alias("digest")))
    firsts = scratch.save(rows.groupBy("digest").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").drop("last"))
    copies = rows.join(firsts, "digest").where("doc > first").select("chunk", F.lit(COPY).alias("kind"), "uid", "doc").distinct()
    copies = scratch.save(copies)
    runs = removed_runs(chunks, copies, scratch, length, **limits)
    met = chunks.meet(copies.unionByName(runs, allowMissingColumns=True), ("doc_id", "uid", "doc", "text"))
    kept = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return met.mapInArrow(lean(kept_parts(with_text)), kept)
