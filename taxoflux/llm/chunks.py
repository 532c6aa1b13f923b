"""Texts in chunks of bounded size: what a shuffle finds out about a chunk's content meets its texts again in one task.

A chunk's number follows from the row (doc_id and text), so a second read deals the texts alike; rows of
one doc_id and text share a chunk.  Each text is shuffled when it is dealt; nothing is broadcast.
"""
from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_PARTITIONS = 20_000  # of a shuffle; beyond it a partition holds several chunks, one after another
TEXTS = 3  # the kind of the texts, after the kinds 0 to 2 of what meets them


class Chunks:
    """``texts`` (with doc_id and text) and their column ``chunk``."""

    def __init__(self, texts: DataFrame, chunk_bytes: int):
        room = texts.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 8)).first()[0] or 0
        self.count = max(1, math.ceil(room / chunk_bytes))
        self.partitions = min(self.count, MAX_PARTITIONS)
        self.texts = texts.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(self.count)).cast("int"))

    def meet(self, others: DataFrame | None = None, columns: tuple[str, ...] = ()) -> DataFrame:
        """Rows (part = 4 * chunk + kind, the columns of ``others``, those of the texts), by chunk and kind, texts last.
        ``others`` have chunk and kind (0 to 2); columns that one side lacks are null there."""
        texts = self.texts.select((F.col("chunk") * 4 + TEXTS).alias("part"), *columns)
        if others is not None:
            others = others.select((F.col("chunk") * 4 + F.col("kind")).alias("part"), *[c for c in others.columns if c not in ("chunk", "kind")])
            texts = others.unionByName(texts, allowMissingColumns=True)
        return texts.withColumn("chunk", F.shiftright("part", 2)).repartitionById(self.partitions, "chunk").sortWithinPartitions("part").drop("chunk")


def runs_of(batches, column: str):
    """(value, rows) of the runs of one value in the batches' column of that name."""
    for batch in batches:
        values = batch.column(batch.schema.get_field_index(column)).to_numpy(zero_copy_only=False)
        cuts = [0, *(1 + np.flatnonzero(values[1:] != values[:-1])).tolist(), len(values)]
        for a, b in zip(cuts, cuts[1:]):
            if a < b:
                yield int(values[a]), batch.slice(a, b - a)


def by_chunk(batches):
    """Rows as ``meet`` gives them -> (chunk, kind, rows)."""
    for part, rows in runs_of(batches, "part"):
        yield part >> 2, part & 3, rows


def column(rows, name: str):
    return rows.column(rows.schema.get_field_index(name))


def values(rows, name: str) -> np.ndarray:
    return column(rows, name).to_numpy(zero_copy_only=False)
