"""Connected components of an edge table by alternating large-star and small-star steps.

Each task first turns the edges it holds into a forest of stars.  If no more than FLUSH edges are left, one
task joins these; a larger graph enters the steps with fewer edges.  The steps are DataFrame functions; each
pre-aggregates the minimum of a node's neighbours and joins it back, so a node with very many
neighbours is split by adaptive skew joins.  The graph never reaches the driver: only counts and
checksums do, to see that all are stars or that a round changed nothing.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxoflux.llm.runtime import Scratch

MAX_ROUNDS = 60
FLUSH = 2_000_000  # edges that a task holds at once


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges -> (node, smallest node of its component among these edges), for all but these smallest."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != (up := root[root])).any():
            root = up
    inner = root != np.arange(len(nodes))
    return nodes[inner], nodes[root[inner]]


def forests(batches):
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def out(parts):
        u, v = stars(*(np.concatenate(x) for x in zip(*parts)))
        for i in range(0, len(u), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(u[i : i + 100_000]), pa.array(v[i : i + 100_000])], schema=schema)

    parts, held = [], 0
    for batch in batches:
        parts.append(tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns))
        held += batch.num_rows
        if held > FLUSH:
            yield from out(parts)
            parts, held = [], 0
    if held:
        yield from out(parts)


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _is_stars(e: DataFrame) -> bool:
    """Whether each node has one edge to a smaller one, or is such a smaller one, never both."""
    ends = e.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1").isEmpty()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b) links -> (node, label): label is the smallest node of the component, for every node with a link."""
    e = scratch.save(edges.where("a != b").select("a", "b").mapInArrow(forests, "u long, v long").distinct())
    if e.count() <= FLUSH:  # what one task may hold
        e = scratch.save(e.coalesce(1).mapInArrow(forests, "u long, v long"))
    elif not _is_stars(e):
        state = _state(e)
        for _ in range(MAX_ROUNDS):
            both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
            large = scratch.save(large)
            low = large.groupBy("u").agg(F.min("v").alias("m"))
            moved = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            after = scratch.save(moved.unionByName(low.withColumnRenamed("m", "v")).distinct())
            scratch.drop(e, large)
            e, before, state = after, state, _state(after)
            if state == before:
                break
        else:
            raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    )
