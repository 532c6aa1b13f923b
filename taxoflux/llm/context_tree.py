"""Operator 4: language-model scores by context-tree weighting over bytes.

A text is read as its lower-cased words, one space between them and one end mark.  A byte is eight
binary choices; each of the 255 inner nodes of that decision tree has a context tree over the DEPTH
bytes before.  Every context keeps its zeros and ones; its Krichevsky-Trofimov estimate is mixed half
and half with the product of its children, so all depths take part, weighted by how well they told
the training text.  After training the weights stand still, and a byte's log probability depends on its
context and itself alone: one number for each (DEPTH + 1)-byte string that the corpus has.

1. Texts are dealt into chunks of about CHUNK_BYTES.  Each chunk counts its strings and words.  The chunks of a
   string meet, sorted: a row gets its total and the list of chunks, in parts of at most LIST.
2. Strings that share the two bytes before the last meet in one group, which weighs its trees
   down to depth 2.  What remains, the nodes of depth 1 and 0, is at most 256 * 255 rows.
3. Groups are weighed again, now with those top levels, and give each string its log probability.
4. Log probabilities are joined to the lists of the chunks that have the string, and sent there, with the
   texts.  A task holds the strings of one chunk, whatever the size of the corpus, and every text is read twice.

The base score (add-one unigrams) is made in the same passes.  Words are keyed by 64-bit hashes.

Defined cases: null, empty or word-less text is the end mark alone; a null doc_id is neither hashed nor
held out (it trains); repeated rows count each time; an empty table gives no rows; other columns are
ignored; without training text all counts are 0 and every bit costs one bit.  Rows of one doc_id and text share a chunk.
"""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxoflux.llm.chunks import TEXTS, Chunks, by_chunk, column, values
from taxoflux.llm.runtime import Scratch, lean
from taxoflux.llm.textbytes import lower_table, pieces, word_bounds, word_hashes

DEPTH = 5
CHUNK_BYTES = 48_000_000
STRINGS, WORDS = 0, 1
END, GAP = 10, 32
END_TOKEN = 0x0E4D  # stands for the end token among word hashes
PIECE = 1 << 20
LIST = 10_000  # chunks in a row; a string of more chunks has several rows


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma for x > 0: the recurrence up to 8, then Stirling's series."""
    y = x.astype(float).copy()
    shift = np.zeros_like(y)
    for _ in range(8):
        small = y < 8
        shift[small] += np.log(y[small])
        y[small] += 1
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1) - math.log(math.pi)


def weigh(kt: np.ndarray, children: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ln Pw = ln(Pe / 2 + prod(children) / 2), and the share of the node's own estimate in it."""
    own = math.log(0.5) + kt
    total = np.logaddexp(own, math.log(0.5) + children)
    return total, np.exp(own - total)


def read_stream(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bounds of each row): words, GAP between them, END after the last."""
    rows = len(offsets) - 1
    empty = np.flatnonzero(np.bincount(row, minlength=rows) == 0)
    at = np.concatenate([row, empty])
    order = np.argsort(at, kind="stable")
    a, b, at = np.concatenate([starts, offsets[empty]])[order], np.concatenate([ends, offsets[empty]])[order], at[order]
    size = b - a + 1
    begin = np.cumsum(size) - size
    total = int(size.sum())
    source = np.arange(total) - np.repeat(begin - a, size)
    out = lower_table()[data[np.minimum(source, max(0, len(data) - 1))]] if len(data) else np.zeros(total, np.uint8)
    last = np.ones(len(at), bool)
    last[:-1] = at[1:] != at[:-1]
    out[begin + size - 1] = np.where(last, END, GAP)
    return out, np.append(begin[np.searchsorted(at, np.arange(rows))], total)


def strings_of(stream: np.ndarray, bounds: np.ndarray, depth: int) -> np.ndarray:
    """At each byte: itself in the low byte, the byte before it next, and so on; END before the text."""
    n = len(stream)
    place = np.arange(n) - np.repeat(bounds[:-1], np.diff(bounds))
    code = stream.astype(np.uint64)
    for j in range(1, depth + 1):
        before = np.full(n, END, np.uint8)
        before[j:] = stream[: n - j] if j < n else before[j:]
        before[place < j] = END
        code |= before.astype(np.uint64) << np.uint64(8 * j)
    return code


def counts_of(depth: int):
    """Documents sorted by chunk -> (chunk, kind, key, trained): kind 0 strings, kind 1 words; trained is 0 where only
    held-out texts have the key.  A chunk gives a key once, or now and then again if it has millions."""
    schema = pa.schema([("chunk", pa.int32()), ("kind", pa.int32()), ("key", pa.int64()), ("trained", pa.int64())])

    def fold(parts):
        keys, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return [(keys, np.bincount(at, np.concatenate([p[1] for p in parts]), len(keys)).astype(np.int64))]

    def batch(chunk, kind, part):
        keys, trained = part
        for a in range(0, len(keys), 100_000):
            k = keys[a : a + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), chunk, np.int32)), pa.array(np.full(len(k), kind, np.int32)), pa.array(k.view(np.int64)), pa.array(trained[a : a + 100_000])], schema=schema)

    def run(batches):
        chunk, kept = None, {0: [], 1: []}

        def close():
            for kind in kept:
                if kept[kind]:
                    yield from batch(chunk, kind, fold(kept[kind])[0])
                kept[kind] = []

        for number, _, part in by_chunk(batches):
            if number != chunk:
                yield from close()
                chunk = number
            for rows, data, offsets in pieces([part], limit=PIECE):
                trains = ~values(rows, "held_out").astype(bool)
                starts, ends, row = word_bounds(data, offsets)
                stream, bounds = read_stream(data, offsets, starts, ends, row)
                words = np.concatenate([word_hashes(data, starts, ends), np.full(rows.num_rows, END_TOKEN, np.uint64)])
                by = (trains[np.repeat(np.arange(rows.num_rows), np.diff(bounds))], trains[np.concatenate([row, np.arange(rows.num_rows)])])
                for kind, keys, own in ((0, strings_of(stream, bounds, depth), by[0]), (1, words, by[1])):
                    at, found = pd.factorize(keys)
                    kept[kind].append((found, np.bincount(at[own], minlength=len(found))))
                    if sum(len(p[0]) for p in kept[kind]) > 2_500_000:
                        kept[kind] = fold(kept[kind])
                        if len(kept[kind][0][0]) > 1_500_000:
                            yield from batch(chunk, kind, kept[kind][0])
                            kept[kind] = []
        yield from close()

    return run


def gathered(batches):
    """Rows (kind, key, chunk, trained) sorted by key and kind -> (kind, key, trained, chunks): a key's total and chunks; beyond LIST
    chunks further rows before, without a total."""
    schema = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("trained", pa.int64()), ("chunks", pa.list_(pa.int32()))])

    def close(parts, total=0, part=False):
        kind, key, chunk, trained = (np.concatenate(x) for x in zip(*parts))
        if not len(key):
            return
        start = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (kind[1:] != kind[:-1])))
        sums = np.add.reduceat(trained, start)
        sums[0] += total
        lists = pa.ListArray.from_arrays(pa.array(np.append(start, len(key)).astype(np.int32)), pa.array(chunk))
        yield pa.RecordBatch.from_arrays([pa.array(kind[start]), pa.array(key[start]), pa.nulls(len(start), pa.int64()) if part else pa.array(sums), lists], schema=schema)

    held, total = [], 0  # rows of the last key, and the count of those of its rows that are already out
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        kind, key = columns[:2]
        if not len(key):
            continue
        fresh = (key != key[-1]) | (kind != kind[-1])
        last = int(np.flatnonzero(fresh)[-1]) + 1 if fresh.any() else 0
        if held and (last or held[0][1][0] != key[0] or held[0][0][0] != kind[0]):
            if last and held[0][1][0] == key[0] and held[0][0][0] == kind[0]:
                yield from close([*held, tuple(c[:last] for c in columns)], total)
            else:
                yield from close(held, total)
                if last:
                    yield from close([tuple(c[:last] for c in columns)])
            held, total = [], 0
        elif last:
            yield from close([tuple(c[:last] for c in columns)])
        held.append(tuple(c[last:] for c in columns))
        if sum(len(h[0]) for h in held) > LIST:
            total += int(sum(h[3].sum() for h in held))
            yield from close([tuple(c[1:] for c in h) if i == 0 else h for i, h in enumerate(held)], part=True)
            held = [tuple(c[:1] for c in held[0])]  # one row stays for the total
            total -= int(held[0][3][0])
    if held:
        yield from close(held, total)


class Trees:
    """The context trees below one pair of bytes (or below all, with top = 0)."""

    def __init__(self, codes: np.ndarray, trained: np.ndarray, depth: int, top: int):
        symbol, context = (codes & np.uint64(255)).astype(np.int64), codes >> np.uint64(8)
        shift = np.arange(8)
        self.node = ((1 << shift) | (symbol[:, None] >> (8 - shift))).ravel()
        self.bit = ((symbol[:, None] >> (7 - shift)) & 1).ravel().astype(bool)
        count, context = np.repeat(trained.astype(float), 8), np.repeat(context, 8)
        zeros_of, ones_of = np.where(self.bit, 0, count), np.where(self.bit, count, 0)
        self.p, below = None, None
        for d in range(depth, top - 1, -1):
            key = ((context & np.uint64((1 << (8 * d)) - 1)) << np.uint64(8)) | self.node.astype(np.uint64)
            at, keys = pd.factorize(key)
            zeros, ones = np.bincount(at, zeros_of, len(keys)), np.bincount(at, ones_of, len(keys))
            kt = log_kt(zeros, ones)
            estimate = (np.where(self.bit, ones[at], zeros[at]) + 0.5) / (zeros[at] + ones[at] + 1)
            if below is None:
                self.log_pw, self.p = kt, estimate
            else:
                child_at, child_pw = below
                parent = np.zeros(len(child_pw), np.int64)
                parent[child_at] = at
                self.log_pw, share = weigh(kt, np.bincount(parent, child_pw, len(keys)))
                self.p = share[at] * estimate + (1 - share[at]) * self.p
            below = (at, self.log_pw)
        self.keys, self.zeros, self.ones = keys, zeros, ones


def by_group(batches):
    """Rows (group, key, trained) sorted by group -> (group, codes, trained)."""
    group, keys, counts = None, [], []
    for batch in batches:
        g, k, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        if not len(g):
            continue
        cuts = [0, *(1 + np.flatnonzero(g[1:] != g[:-1])).tolist(), len(g)]
        for a, b in zip(cuts, cuts[1:]):
            if g[a] != group:
                if keys:
                    yield group, np.concatenate(keys).view(np.uint64), np.concatenate(counts)
                group, keys, counts = g[a], [], []
            keys.append(k[a:b])
            counts.append(n[a:b])
    if keys:
        yield group, np.concatenate(keys).view(np.uint64), np.concatenate(counts)


def summaries(depth: int):
    """Groups -> their nodes of depth 2: (byte, node, zeros, ones, log_pw), byte being the context of depth 1."""
    schema = pa.schema([("byte", pa.int32()), ("node", pa.int32()), ("zeros", pa.float64()), ("ones", pa.float64()), ("log_pw", pa.float64())])

    def run(batches):
        for group, codes, trained in by_group(batches):
            t = Trees(codes, trained, depth, 2)
            n = len(t.keys)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, group & 255, np.int32)), pa.array((t.keys & np.uint64(255)).astype(np.int32)), pa.array(t.zeros), pa.array(t.ones), pa.array(t.log_pw)], schema=schema)

    return run


def top_levels(rows: pa.Table) -> dict[str, np.ndarray]:
    """Nodes of depth 1 (sums over their children) -> what depths 1 and 0 add to a mixture, by byte * 256 + node."""
    at = rows["byte"].to_numpy() * 256 + rows["node"].to_numpy()
    dense = lambda name: np.bincount(at, rows[name].to_numpy(), 65536)
    zeros1, ones1 = dense("zeros"), dense("ones")
    pw1, share1 = weigh(log_kt(zeros1, ones1), dense("log_pw"))
    there = np.bincount(at, minlength=65536) > 0
    fold = lambda x: np.tile(np.where(there, x, 0).reshape(256, 256).sum(0), 256)
    zeros0, ones0 = fold(zeros1), fold(ones1)
    _, share0 = weigh(log_kt(zeros0, ones0), fold(pw1))
    return {"zeros1": zeros1, "ones1": ones1, "share1": share1, "zeros0": zeros0, "ones0": ones0, "share0": share0}


def prices(depth: int, top):
    """Groups -> (kind 0, key, log10 probability of the string's last byte after the others)."""
    schema = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("value", pa.float64())])

    def run(batches):
        levels = top.value
        for group, codes, trained in by_group(batches):
            t = Trees(codes, trained, depth, 2)
            at = (group & 255) * 256 + t.node
            p = t.p
            for d in ("1", "0"):
                zeros, ones, share = (levels[k + d][at] for k in ("zeros", "ones", "share"))
                p = share * ((np.where(t.bit, ones, zeros) + 0.5) / (zeros + ones + 1)) + (1 - share) * p
            value = np.log10(p).reshape(-1, 8).sum(1)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(codes), np.int32)), pa.array(codes.view(np.int64)), pa.array(value)], schema=schema)

    return run


def scores(depth: int, train_tokens: int, train_words: int):
    """By chunk its strings and words with their values, then its texts -> scores."""
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("bits_per_byte", pa.float64())])
    space = math.log10(train_tokens + train_words + 1)

    def table(parts):
        keys, numbers = (np.concatenate(x) for x in zip(*parts))
        keys, first = np.unique(keys, return_index=True)
        return pd.Index(keys), numbers[first]

    def found(table, keys):
        at = table[0].get_indexer(keys)
        if (at < 0).any():
            raise RuntimeError("a chunk's texts have changed between two reads")
        return table[1][at]

    def of(rows, data, offsets, strings, words):
        n = rows.num_rows
        starts, ends, row = word_bounds(data, offsets)
        stream, bounds = read_stream(data, offsets, starts, ends, row)
        at, keys = pd.factorize(strings_of(stream, bounds, depth))
        sums = np.concatenate([[0], np.cumsum(found(strings, keys)[at])])
        # a fresh sum for each row would be as exact; differences of one running sum lose nothing at 2**-52
        score = sums[bounds[1:]] - sums[bounds[:-1]]
        at, keys = pd.factorize(np.concatenate([word_hashes(data, starts, ends), np.full(n, END_TOKEN, np.uint64)]))
        owner = np.concatenate([row, np.arange(n)])
        count = found(words, keys)[at]
        return pa.RecordBatch.from_arrays(
            [
                column(rows, "doc_id"), column(rows, "held_out"), pa.array(np.bincount(owner, minlength=n)), pa.array(np.bincount(owner, count > 0, n).astype(np.int64)),
                pa.array(np.bincount(owner, np.log10(count + 1) - space, n)), pa.array(score), pa.array(-score / math.log10(2) / np.diff(bounds)),
            ],
            schema=schema,
        )

    def run(batches):
        chunk, parts, tables = None, None, None
        for number, kind, rows in by_chunk(batches):
            if number != chunk:
                chunk, parts, tables = number, ([], []), None
            if kind != TEXTS:
                parts[kind].append((values(rows, "key").view(np.uint64), values(rows, "value")))
                continue
            if tables is None:
                tables, parts = [table(p) for p in parts], None
            for piece, data, offsets in pieces([rows], limit=PIECE):
                yield of(piece, data, offsets, *tables)

    return run


def score(docs: DataFrame, held_out, scratch: Scratch, depth: int = DEPTH, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row a document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte (code length).
    ``held_out``: a condition on the row; its texts don't train."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col("text"))
    chunks = Chunks(texts, chunk_bytes)
    asked = chunks.meet(columns=("held_out", "text")).mapInArrow(lean(counts_of(depth)), "chunk int, kind int, key long, trained long")
    asked = asked.select("kind", "key", "chunk", "trained").repartition("key").sortWithinPartitions("key", "kind")
    lists = scratch.save(asked.mapInArrow(lean(gathered), "kind int, key long, trained long, chunks array<int>"))
    scratch.release()
    counts = lists.where("trained is not null").select("kind", "key", "trained")
    words = counts.where(F.col("kind") == WORDS)
    totals = words.where("trained > 0").agg(F.coalesce(F.sum("trained"), F.lit(0)), F.count("*")).first()
    group = F.col("key").bitwiseAND(F.lit(0xFFFF00))
    strings = counts.where(F.col("kind") == STRINGS).select(F.shiftright(group, 8).alias("group"), "key", "trained")
    strings = strings.repartition(F.col("group")).sortWithinPartitions("group")
    low = strings.mapInArrow(lean(summaries(depth)), "byte int, node int, zeros double, ones double, log_pw double")
    low = low.groupBy("byte", "node").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "log_pw")]).toArrow()  # 256 * 255 rows at most
    top = spark.sparkContext.broadcast(top_levels(low))
    valued = strings.mapInArrow(lean(prices(depth, top)), "kind int, key long, value double").unionByName(words.select("kind", "key", F.col("trained").cast("double").alias("value")))
    valued = scratch.save(valued)
    sent = lists.select("kind", "key", "chunks").join(valued, ["kind", "key"]).select(F.explode("chunks").alias("chunk"), "kind", "key", "value")
    scratch.release()
    scored = chunks.meet(sent, ("doc_id", "held_out", "text")).mapInArrow(lean(scores(depth, int(totals[0]), int(totals[1]))), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, bits_per_byte double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(totals[0])).cast("long").alias("train_tokens"), "base_score", "score", "bits_per_byte")
