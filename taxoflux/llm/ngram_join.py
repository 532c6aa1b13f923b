"""Operator 7: exact n-gram Jaccard join by prefix trees.

Two documents link when the Jaccard similarity of their sets of five-word shingles is 0.75 or more.

1. Every document's shingle set is hashed; equal sets form one class and are compared once.
2. Prefix filter: sets that link share a shingle among their first n - ceil(3n/4) + 1 in any one order.  The
   order here: even-valued shingles, rarest first; odd-valued ones by value; very common ones by rank (a
   bounded table, see ORDERED).  Half of a set's shingles nearly always fill its prefix, so only these are
   dealt out by value to count the sets that have them.  What only one set has is not sent back, and it
   fills the prefixes of all sets but those with near copies.
3. The sets of like size that have a prefix shingle are tied to the smallest of them: n - 1 rows for n.
   Components of these ties hold every link.
4. The sets of a component, cut into blocks of bounded size, each with the component's smallest set, go
   to tasks.  There a compressed trie holds the sets in one order.  A set descends it once, sharing its
   partial overlap along common prefixes; a subtree is left where the remaining lengths cannot reach
   the threshold, or where all its sets are already in the same component.  What leaves a task is a
   spanning forest of verified links.  In components of several blocks, the sets that are not yet
   connected with the smallest set then meet all others, block by block, in the same tries.
5. Components of verified links, with the classes, are the result.

Defined cases: a document without words (or null text) has no set and links with nothing; with one to
four words its whole sequence is its only shingle; repeated rows are equal sets; rows of a null doc_id are
compared like others, but name no component (component_id is the smallest doc_id that isn't null); other columns are ignored; an
empty table gives no rows.  Shingles are compared by 64-bit hashes and classes by 64 bits of a digest:
under 1e9 different sets the chance of any mix-up stays below 3 percent, and of a wrong link far less.
"""
from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxoflux.llm.components import components
from taxoflux.llm.runtime import Scratch, lean, unused
from taxoflux.llm.textbytes import pieces, shingle_hashes, word_bounds, word_hashes

SHINGLE = 5
#: Shingles with at least 1 / ORDERED of all repeated occurrences get a place at the end of the order:
#: ORDERED of them at most, 12 bytes each, whatever the size of the input.
ORDERED = 1_000_000
#: Shingles in a trie: first blocks are small, so that a group of copies is many tasks; later ones meet in pairs.
FIRST_BLOCK = 100_000
BLOCK_SHINGLES = 1_000_000
#: Sets to compare whose documents' ids (some 60 bytes a row) may go to all tasks; beyond it texts are joined by shuffle.
BROADCAST_ROWS = 500_000


def row_sets(batches, k: int):
    """(rows, [distinct sorted shingles of each row])"""
    for rows, data, offsets in pieces(batches):
        starts, ends, row = word_bounds(data, offsets)
        x, bounds = shingle_hashes(word_hashes(data, starts, ends), row, rows.num_rows, k)
        yield rows, [np.unique(x[bounds[i] : bounds[i + 1]]) for i in range(rows.num_rows)]


def set_digest(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def classes_of(k: int):
    """Documents -> their set's size and digest; and, per task, shingles in two or more different sets."""
    schema = pa.schema([("doc_id", pa.int64()), ("rid", pa.int64()), ("n_shingles", pa.int64()), ("set_id", pa.int64()), ("shingle", pa.int64()), ("times", pa.int64())])

    def often(parts: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        if not parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        keys, at = np.unique(np.concatenate(parts), return_inverse=True)
        return keys, np.bincount(at, np.concatenate(counts), len(keys)).astype(np.int64)

    def run(batches):
        seen: set[int] = set()
        parts, held = [], 0
        for rows, sets in row_sets(batches, k):
            ids = [set_digest(s) if len(s) else None for s in sets]
            for i, s in zip(ids, sets):
                if i is not None and i not in seen:
                    seen.add(i)
                    parts.append(s)
                    held += len(s)
            n = len(sets)
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id").cast(pa.int64()), rows.column("rid"), pa.array([len(s) for s in sets], pa.int64()), pa.array(ids, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], schema=schema
            )
            if held > 2_000_000:
                yield common(parts)
                parts, held = [], 0
        if parts:
            yield common(parts)

    def common(parts):
        keys, counts = often(parts, [np.ones(len(p), np.int64) for p in parts])
        keys, counts = keys[counts > 1].view(np.int64), counts[counts > 1]
        n = len(keys)
        return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64())] * 4 + [pa.array(keys), pa.array(counts)], schema=schema)

    return run


def prefix(n):
    return n - (3 * n + 3) // 4 + 1


#: Kinds of dealt rows.  A SET row's key holds the set's size and its number of counted keys.
SET, COUNTED, DIRECT = 0, 1, 2
KEYS = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("set_id", pa.int64())])


def deal(k: int, order, flush: int = 1_000_000):
    """Documents -> (kind, key, set_id), each different set of a task once.  A key is 48 bits of a shingle.

    The order of keys is: those of even shingles, by the number of sets that have them; those of odd ones, by
    value; very common shingles, by rank.  Only the first kind needs counting, so only half of a set's shingles
    are dealt; they fill its prefix, but for chance in short sets.  What the prefix needs of the other kinds
    is known here: these keys go DIRECT."""

    def batch(rows):
        kinds = np.concatenate([np.full(len(x), kind, np.int32) for kind, x, _ in rows])
        keys = np.concatenate([x for _, x, _ in rows])
        ids = np.repeat(np.array([i for _, _, i in rows], np.int64), [len(x) for _, x, _ in rows])
        at = np.argsort(keys, kind="stable")  # neighbours of one set would make shuffled bytes depend on the number of partitions
        for a in range(0, len(at), 100_000):
            part = at[a : a + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(kinds[part]), pa.array(keys[part].view(np.int64)), pa.array(ids[part])], schema=KEYS)

    def run(batches):
        last, rank = order.value
        seen: set[int] = set()
        held, amount = [], 0
        for _, sets in row_sets(batches, k):
            for s in sets:
                if not len(s) or (i := set_digest(s)) in seen:
                    continue
                seen.add(i)
                place = None
                rest = s
                if len(last):
                    at = np.minimum(np.searchsorted(last, s), len(last) - 1)
                    common = last[at] == s
                    if common.any():
                        rest, place = s[~common], rank[at[common]]
                even = (rest & np.uint64(1)) == 0
                keys = rest[even] >> np.uint64(16)
                keys = keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys
                held.append((SET, np.array([len(s) << 31 | len(keys)], np.uint64), i))
                held.append((COUNTED, keys, i))
                amount += len(keys)
                more = prefix(len(s)) - len(keys)
                if more > 0:
                    odd = rest[~even][:more] >> np.uint64(16)
                    held.append((DIRECT, odd | ODD, i))
                    if more > len(odd) and place is not None:
                        first = np.argsort(place, kind="stable")[: more - len(odd)]
                        held.append((DIRECT, s[common][first] >> np.uint64(16) | LATE, i))
            if amount > flush:
                yield from batch(held)
                held, amount = [], 0
        if held:
            yield from batch(held)

    return run


ODD, LATE = np.uint64(1 << 48), np.uint64(2 << 48)  # keys of different kinds don't meet


def shared_keys(batches):
    """Rows (kind, key, set_id) sorted by kind, key, set_id -> (set_id, place, key): SET rows with place -1, keys that two
    sets have with their number of sets, DIRECT keys with place null."""
    schema = pa.schema([("set_id", pa.int64()), ("place", pa.int64()), ("key", pa.int64())])

    def close(keys, ids):
        fresh = np.ones(len(keys), bool)
        fresh[1:] = (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])  # a set that two tasks have counts once
        keys, ids = keys[fresh], ids[fresh]
        start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        count = np.diff(np.append(start, len(keys)))
        count = np.repeat(count, count)
        two = count > 1
        if two.any():
            yield pa.RecordBatch.from_arrays([pa.array(ids[two]), pa.array(count[two]), pa.array(keys[two])], schema=schema)

    held: list[tuple] = []
    for batch in batches:
        kind, keys, ids = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        for want, place in ((SET, -1), (DIRECT, None)):
            mine = kind == want
            if (n := int(mine.sum())):
                yield pa.RecordBatch.from_arrays([pa.array(ids[mine]), pa.nulls(n, pa.int64()) if place is None else pa.array(np.full(n, place)), pa.array(keys[mine])], schema=schema)
        mine = kind == COUNTED
        keys, ids = keys[mine], ids[mine]
        if not len(keys):
            continue
        last = int(np.searchsorted(keys, keys[-1]))  # the last key may go on in the next batch
        if last or (held and held[0][0][0] != keys[0]):
            yield from close(*(np.concatenate(x) for x in zip(*held, (keys[:last], ids[:last]))))
            held = []
        held.append((keys[last:], ids[last:]))
    if held:
        yield from close(*(np.concatenate(x) for x in zip(*held)))


def prefix_rows(batches):
    """Rows (set_id, place, key) sorted by set_id, place (null last), key -> (key, set_id, size) of the keys in a set's prefix.

    Of a set's counted keys, those that are not here are its own alone and stand before all others."""
    schema = pa.schema([("key", pa.int64()), ("set_id", pa.int64()), ("size", pa.int32())])
    last, size, room = None, 0, 0  # of the set that the batch before ended in; room: keys that its prefix still takes
    shared_before = 0
    held: list = []

    def close(ids, place, keys):
        start = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        length = np.diff(np.append(start, len(ids)))
        packed = keys[start]  # the first row of a set is its SET row
        sizes, counted = packed >> 31, packed & ((1 << 31) - 1)
        key_row = place > 0
        fresh = np.ones(len(ids), bool)
        fresh[1:] = (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1]) | (place[1:] != place[:-1])
        key_row &= fresh
        shared = np.add.reduceat((key_row & (place < LAST)).astype(np.int64), start)
        run = np.cumsum(key_row) - key_row
        nth = run - np.repeat(run[start], length)
        keep = key_row & ((nth < np.repeat(prefix(sizes) - (counted - shared), length)) | (place == LAST))
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(keys[keep]), pa.array(ids[keep]), pa.array(np.repeat(sizes, length)[keep].astype(np.int32))], schema=schema)

    for batch in batches:
        ids, place, keys = (c.fill_null(LAST).to_numpy(zero_copy_only=False) for c in batch.columns)
        if not len(ids):
            continue
        cut = int(np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))[-1])
        if cut or (held and held[0][0][0] != ids[0]):
            yield from close(*(np.concatenate(x) for x in zip(*held, (ids[:cut], place[:cut], keys[:cut]))))
            held = []
        held.append((ids[cut:], place[cut:], keys[cut:]))
    if held:
        yield from close(*(np.concatenate(x) for x in zip(*held)))


LAST = (1 << 62)  # the place of DIRECT keys, which are known to be in the prefix


def candidates(heads: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, set_id, size) -> (a, b): the sets that have a key and are of like size with the smallest of them.  A set is
    in two classes of sizes, its own and the next, and sizes that link differ by one class at most.  A key of n sets
    gives 2n rows at most; its smallest sets are found by partial aggregates and joined back, so a frequent key is
    no hot group."""
    own = F.floor(F.log(F.col("size").cast("double")) / F.lit(math.log(1.34))).cast("int")
    sized = heads.select("key", "set_id", F.explode(F.array(own, own + 1)).alias("class"))
    hubs = scratch.save(sized.groupBy("key", "class").agg(F.min("set_id").alias("hub"), F.max("set_id").alias("other")).where("hub < other").drop("other"))
    pairs = sized.join(hubs, ["key", "class"]).where("set_id <> hub")
    return pairs.select(F.col("hub").alias("a"), F.col("set_id").alias("b"))


def member_sets(k: int):
    """Documents chosen to stand for a set -> (label, blocks, own, cluster, set_id, shingles as bytes)."""
    schema = MEMBERS

    def run(batches):
        for rows, sets in row_sets(batches, k):
            wanted = rows.column(rows.schema.get_field_index("set_id")).to_pylist()
            at = [i for i, s in enumerate(sets) if len(s) and set_digest(s) == wanted[i]]  # not other rows of that doc_id
            if at:
                columns = [rows.column(rows.schema.get_field_index(f.name)).take(pa.array(at)) for f in schema if f.name != "shingles"]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([sets[i].tobytes() for i in at], pa.binary())], schema=schema)

    return run


MEMBERS = pa.schema([("label", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("own", pa.int32()), ("cluster", pa.int64()), ("set_id", pa.int64()), ("shingles", pa.binary())])
MEMBERS_SQL = "label long, low int, high int, own int, cluster long, set_id long, shingles binary"


class PrefixTree:
    """A compressed trie over sets of small integers, each in ascending order.

    A node has a segment of tokens, the depth of its end, the path's last token, children, first leaf, last leaf + 1 and the
    least and most size below it.  Leaves are numbered in the order of the sets, so a subtree is a range of
    leaves.  Nodes are numbered level by level, so children are a range of nodes and a whole level is searched at once.
    """

    def __init__(self, sets: list[np.ndarray]):
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes())
        ordered = [sets[i] for i in self.order]
        sizes = np.array([len(s) for s in ordered])
        shared = np.zeros(len(sets) + 1, np.int64)  # common prefix of leaf i with leaf i - 1
        for i in range(1, len(ordered)):
            a, b = ordered[i - 1], ordered[i]
            n = min(len(a), len(b))
            differ = np.flatnonzero(a[:n] != b[:n])
            shared[i] = differ[0] if len(differ) else n
        nodes, segments = [], []  # (depth, last token, first child, last child + 1, first leaf, last leaf + 1, least, most)
        level = [(0, len(ordered), 0)]
        while level:
            below = []
            first = len(nodes) + len(level)
            for lo, hi, start in level:
                inner = hi - lo > 1
                end = int(shared[lo + 1 : hi].min()) if inner else len(ordered[lo])
                segments.append(ordered[lo][start:end])
                children = first + len(below)
                if inner:
                    cuts = [lo, *(lo + 1 + np.flatnonzero(shared[lo + 1 : hi] == end)).tolist(), hi]
                    below += [(a, b, end) for a, b in zip(cuts, cuts[1:])]
                nodes.append((end, int(ordered[lo][end - 1]) if end else -1, children, first + len(below), lo, hi, int(sizes[lo:hi].min()), int(sizes[lo:hi].max())))
            level = below
        self.depth, self.last, self.first, self.end, self.lo, self.hi, self.least, self.most = np.array(nodes, np.int64).T
        self.tokens = np.concatenate(segments)
        self.stop = np.cumsum([len(x) for x in segments])
        self.start = np.append(0, self.stop[:-1])

    def search(self, own: np.ndarray, mine: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Leaves among those wanted that link with the set ``own``, whose tokens ``mine`` marks.  Sets with a common path share
        the overlap along it."""
        n, at, overlap, found = len(own), np.zeros(1, np.int64), np.zeros(1, np.int64), []
        until = np.append(0, np.cumsum(wanted))
        while len(at):
            ok = (until[self.hi[at]] > until[self.lo[at]]) & (3 * n <= 4 * self.most[at]) & (3 * self.least[at] <= 4 * n)
            at, overlap = at[ok], overlap[ok]
            size = self.stop[at] - self.start[at]
            ends = np.cumsum(size)
            place = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[at] - ends + size, size)
            hits = np.append(0, np.cumsum(mine[self.tokens[place]]))
            overlap = overlap + hits[ends] - hits[ends - size]
            rest, depth = n - np.searchsorted(own, self.last[at], "right"), self.depth[at]
            whole = np.clip(rest + depth, self.least[at], self.most[at])  # the size that leaves most room
            ok = 7 * (overlap + np.minimum(rest, whole - depth)) >= 3 * (n + whole)
            leaf = self.first[at] == self.end[at]
            found.append(self.lo[at[ok & leaf]])
            at, overlap = at[ok & ~leaf], overlap[ok & ~leaf]
            size = self.end[at] - self.first[at]
            ends = np.cumsum(size)
            at, overlap = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.first[at] - ends + size, size), np.repeat(overlap, size)
        return np.concatenate(found)


def spanning_links(sets: list[np.ndarray], block: list[int] | None = None, cluster: list[int] | None = None) -> list[tuple[int, int]]:
    """Index pairs of verified links, enough to connect all that links connect.  With blocks given,
    only links between the two blocks are looked for; sets of one cluster are known to be connected."""
    if len(sets) < 2:
        return []
    tokens, local, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(tokens), np.int64)
    rank[np.lexsort((tokens, -counts))] = np.arange(len(tokens))  # shared tokens first, for shared paths
    local, cuts = rank[local], np.cumsum([0] + [len(s) for s in sets])
    local = [np.sort(local[a:b]) for a, b in zip(cuts, cuts[1:])]
    tree = PrefixTree(local)
    label = np.arange(len(sets)) if cluster is None else np.unique([cluster[i] for i in tree.order], return_inverse=True)[1]
    side = None if block is None else np.array([block[i] for i in tree.order])
    seekers = range(len(sets)) if side is None else np.flatnonzero(side == min(set(side.tolist()), key=lambda b: (np.count_nonzero(side == b), b)))
    mine = np.zeros(len(tokens), bool)
    links = []
    for x in seekers:
        wanted = label != label[x]
        if side is not None:
            wanted &= side != side[x]
        if not wanted.any():
            if side is None:
                break
            continue
        own = local[tree.order[x]]
        mine[own] = True
        hits = tree.search(own, mine, wanted)
        mine[own] = False
        hits = hits[wanted[hits]]
        labels, first = np.unique(label[hits], return_index=True)
        links += [(tree.order[x], tree.order[y]) for y in hits[first].tolist()]
        label[np.isin(label, labels)] = label[x]
    return links


def links_in_groups(batches):
    """Rows sorted by (label, low, high, set_id) -> (a, b) links between sets of a group."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def close(ids, sets, blocks, clusters, cross):
        found = spanning_links(sets, blocks if cross and len(set(blocks)) > 1 else None, clusters) if not cross or len(set(blocks)) > 1 else []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i, _ in found], pa.int64()), pa.array([ids[j] for _, j in found], pa.int64())], schema=schema)

    group, ids, sets, blocks, clusters, cross = None, [], [], [], [], False
    for batch in batches:
        for label, low, high, own, cluster, i, raw in zip(*(batch.column(batch.schema.get_field_index(f.name)).to_pylist() for f in MEMBERS)):
            if (label, low, high) != group:
                yield from close(ids, sets, blocks, clusters, cross)
                group, ids, sets, blocks, clusters, cross = (label, low, high), [], [], [], [], low != high
            if ids and ids[-1] == i:
                continue  # the same set from another row of that doc_id
            ids.append(i)
            sets.append(np.frombuffer(raw, np.uint64))
            blocks.append(own)
            clusters.append(cluster)
    yield from close(ids, sets, blocks, clusters, cross)


def tried(texts: DataFrame, chosen: DataFrame, k: int, broadcast_rows: int) -> DataFrame:
    """Sets (rid, label, blocks: pairs of block numbers, own, cluster, set_id) -> (a, b) links found in the tries of their blocks."""
    if chosen.count() <= broadcast_rows:  # else texts are shuffled to meet them
        chosen = F.broadcast(chosen)
    sets = texts.join(chosen, "rid").withColumn("pair", F.explode("blocks")).select("text", "label", F.col("pair.low").alias("low"), F.col("pair.high").alias("high"), "own", "cluster", "set_id")
    dealt = sets.mapInArrow(lean(member_sets(k)), MEMBERS_SQL).repartition("label", "low", "high").sortWithinPartitions("label", "low", "high", "set_id")
    return dealt.mapInArrow(lean(links_in_groups), "a long, b long").distinct()


def pairs_of_blocks(own, others):
    return F.transform(others, lambda x: F.struct(F.least(own, x).alias("low"), F.greatest(own, x).alias("high")))


def link_classes(docs: DataFrame, scratch: Scratch, k: int = SHINGLE, ordered: int = ORDERED, block: int = BLOCK_SHINGLES, first_block: int = FIRST_BLOCK, broadcast_rows: int = BROADCAST_ROWS) -> tuple[DataFrame, DataFrame]:
    """(documents: doc_id, n_shingles, set_id; links between different sets: a, b)."""
    spark = docs.sparkSession
    # rid finds a text again; rows of a null doc_id are told apart by their text
    texts = docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("rid"))
    first = scratch.save(texts.mapInArrow(lean(classes_of(k)), "doc_id long, rid long, n_shingles long, set_id long, shingle long, times long"))
    classes = first.where("shingle is null").select("doc_id", "rid", "n_shingles", "set_id")
    often = scratch.save(first.where("shingle is not null").groupBy("shingle").agg(F.sum("times").alias("times")))
    total = often.agg(F.sum("times")).first()[0] or 0
    often = often.where(F.col("times") * F.lit(ordered) >= F.lit(total)).toArrow().sort_by([("times", "descending"), ("shingle", "ascending")]).to_pandas()
    keys = often["shingle"].to_numpy(np.int64).view(np.uint64)
    place = np.argsort(keys)
    order = spark.sparkContext.broadcast((keys[place], (len(keys) - place).astype(np.int32)))  # ORDERED rows at most
    dealt = texts.select("text").mapInArrow(lean(deal(k, order)), "kind int, key long, set_id long")
    dealt = dealt.repartition(F.when(F.col("kind") == COUNTED, F.col("key")).otherwise(F.col("set_id"))).sortWithinPartitions("key", "set_id")
    shared = dealt.mapInArrow(lean(shared_keys), "set_id long, place long, key long")
    shared = shared.repartition("set_id").sortWithinPartitions("set_id", F.col("place").asc_nulls_last(), "key")
    heads = scratch.save(shared.mapInArrow(lean(prefix_rows), "key long, set_id long, size int"))
    scratch.release()
    groups = components(candidates(heads, scratch), scratch)
    scratch.drop(heads)
    scratch.release()
    # one document stands for each set that is to be compared; only these narrow rows are grouped
    chosen = classes.where("set_id is not null").groupBy("set_id").agg(F.min("rid").alias("rid"), F.min("n_shingles").alias("n"))
    chosen = scratch.save(chosen.join(groups.withColumnRenamed("node", "set_id"), "set_id"))
    sizes = scratch.save(chosen.groupBy("label").agg(F.ceil(F.sum("n") / F.lit(first_block)).cast("int").alias("parts")))
    chosen = scratch.save(chosen.join(sizes, "label"))
    # first each block for itself, with the smallest set of the group in all of them
    own = F.pmod(F.xxhash64("set_id"), F.col("parts")).cast("int")
    alone = F.when(F.col("set_id") == F.col("label"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(own))
    blocks = F.transform(alone, lambda x: F.struct(x.alias("low"), x.alias("high")))
    links = scratch.save(tried(texts, chosen.select("rid", "label", blocks.alias("blocks"), own.alias("own"), F.col("set_id").alias("cluster"), "set_id"), k, broadcast_rows))
    scratch.release()
    # then, in groups of several blocks, what is not connected with the smallest set against all others
    several = chosen.where("parts > 1").drop("parts")
    if not several.isEmpty():
        known = components(links, scratch).select(F.col("node").alias("set_id"), F.col("label").alias("cluster"))
        several = scratch.save(several.join(known, "set_id", "left").withColumn("cluster", F.coalesce("cluster", "set_id")))
        hubs = several.where("set_id = label").select("label", F.col("cluster").alias("hub"))
        several = several.join(scratch.save(hubs), "label").withColumn("open", F.col("cluster") != F.col("hub"))
        size = lambda which: F.ceil(F.sum(F.when(which, F.col("n")).otherwise(0)) / F.lit(block)).cast("int")
        counts = several.groupBy("label").agg(size(F.col("open")).alias("opens"), size(~F.col("open")).alias("rest")).where("opens > 0")
        several = several.join(scratch.save(counts), "label")
        own = F.when(F.col("open"), F.pmod(F.xxhash64("set_id"), F.col("opens"))).otherwise(F.col("opens") + F.pmod(F.xxhash64("set_id"), F.col("rest"))).cast("int")
        several = several.withColumn("own", own)
        others = F.when(F.col("open"), F.sequence(F.lit(0), F.col("opens") + F.col("rest") - 1)).otherwise(F.sequence(F.lit(0), F.col("opens") - 1))
        several = scratch.save(several.select("rid", "label", pairs_of_blocks(F.col("own"), others).alias("blocks"), "own", "cluster", "set_id"))
        if not several.isEmpty():
            links = scratch.save(links.unionByName(tried(texts, several, k, broadcast_rows)))
    return classes, links


def join(docs: DataFrame, scratch: Scratch, k: int = SHINGLE, **limits) -> DataFrame:
    """One row a document: doc_id, n_shingles, set_id, component_id."""
    classes, links = link_classes(docs, scratch, k, **limits)
    labels = components(links, scratch)
    least = classes.where("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("least"))
    named = scratch.save(least.join(labels.withColumnRenamed("node", "set_id"), "set_id", "left"))
    smallest = named.where("label is not null").groupBy("label").agg(F.min("least").alias("component"))
    # sets without a label, and rows without a set, must not meet in one task
    named = named.select(F.col("set_id").alias("own_set"), "least", F.coalesce("label", "set_id").alias("label"))
    by_set = scratch.save(named.join(smallest, "label", "left").select("own_set", F.coalesce("component", "least").alias("component")))
    columns = lambda component: ["doc_id", "n_shingles", "set_id", F.col(component).alias("component_id")]
    out = classes.where("set_id is not null").join(by_set, F.col("set_id") == F.col("own_set"), "left").select(*columns("component"))
    return out.unionByName(classes.where("set_id is null").select(*columns("doc_id")))


def representatives(docs: DataFrame, scratch: Scratch, **limits) -> DataFrame:
    """The documents, all columns, of which one of each group of links stays, that of the smallest
    doc_id.  Documents without words, or without a doc_id, link with nothing here and stay."""
    named = docs.where(F.col("doc_id").isNotNull())
    joined = join(named, scratch, **limits)
    gone = unused(docs, "gone")
    dropped = joined.where("doc_id <> component_id").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(scratch.save(dropped), F.col("doc_id") == F.col(gone), "left_anti")
