"""Operator 6: a quality classifier of naive Bayes support vectors.

Features say which byte pairs (65,536, exact) and byte triples (hashed to 65,536) a text has, and in which
tenth the shares of its words and word triples lie that it has had before.  Each is scaled by its class log-count ratio, and a linear hinge-loss model is fitted by dual coordinate
descent, then calibrated to a probability on rows set apart.

Fitting uses at most SAMPLE labelled rows, those with the smallest hash of their id, so it is the same in any
order and at any partitioning; scoring reads every whole text once and has a fixed model of 0.5 MB.

Defined cases: null text is empty, has no feature and gets the model's bias; a null doc_id is never
fitted on and not held out; of several labels for one id the least counts; repeated rows score alike; an
empty table gives no rows; other columns are ignored.  Without labels of both classes every score is 0.5.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxoflux.llm.linear import hinge_by_dual_descent, platt, sigmoid
from taxoflux.llm.textbytes import pieces, shingle_hashes, word_bounds, word_hashes

SAMPLE = 6_000
PAIRS = 1 << 16
SHAPES = PAIRS + (1 << 16)
SHAPE_VALUES = 4 * 11  # each of two shares as "at least" steps, for word counts below and from 50
SIZE = SHAPES + SHAPE_VALUES
PIECE = 1 << 18
PIECE_ROWS = 256  # a piece has a byte for each row and feature


def repeated_share(x: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Per row, the share of its values that equal an earlier one of the row."""
    order = np.lexsort((x, row))
    again = np.zeros(len(x), bool)
    again[1:] = (x[order][1:] == x[order][:-1]) & (row[order][1:] == row[order][:-1])
    return np.bincount(row[order], again, rows) / np.maximum(1, np.bincount(row, minlength=rows))


def shapes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    rows = len(offsets) - 1
    starts, ends, row = word_bounds(data, offsets)
    words = word_hashes(data, starts, ends, fold=False)
    triples, bounds = shingle_hashes(words, row, rows, 3)
    share = np.stack([repeated_share(words, row, rows), repeated_share(triples, np.repeat(np.arange(rows), np.diff(bounds)), rows)], 1)
    steps = share[:, :, None] >= np.arange(11) / 11 + 1e-9
    large = np.bincount(row, minlength=rows) >= 50
    out = np.zeros((rows, 2, 22), bool)
    out[large, 0], out[~large, 1] = steps[large].reshape(-1, 22), steps[~large].reshape(-1, 22)
    return out.reshape(rows, SHAPE_VALUES)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of every feature that a row has, in row order."""
    rows, n = len(offsets) - 1, len(data)
    flags = np.zeros(rows * SIZE, bool)
    row = np.repeat(np.arange(rows, dtype=np.int64) * SIZE, np.diff(offsets))
    x = data.astype(np.uint32)
    if n >= 2:
        two = (x[:-1] << np.uint32(8)) | x[1:]
        same = row[:-1] == row[1:]
        flags[(row[:-1] + two)[same]] = True
        if n >= 3:
            three = ((two[:-1] << np.uint32(8)) | x[2:]) * np.uint32(2654435761) >> np.uint32(16)
            same = row[:-2] == row[2:]
            flags[(row[:-2] + PAIRS + three)[same]] = True
    flags.reshape(rows, SIZE)[:, SHAPES:] = shapes(data, offsets)
    at = np.flatnonzero(flags)
    return at // SIZE, at % SIZE


def sample_features(batches):
    """Documents with a label -> (label, features)."""
    schema = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("features", pa.list_(pa.int32()))])
    for rows, data, offsets in pieces(batches, limit=PIECE, most_rows=PIECE_ROWS):
        row, found = features(data, offsets)
        bounds = np.searchsorted(row, np.arange(rows.num_rows + 1)).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(found.astype(np.int32)))
        yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), lists], schema=schema)


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray, size: int, least: int = 1) -> np.ndarray:
    """ln of (smoothed share of a feature in class 1 / in class -1); 0 for features of fewer than ``least`` rows."""
    total = {}
    seen = np.bincount(np.concatenate(rows), minlength=size)
    for k in (1, -1):
        hits = [r for r, label in zip(rows, y) if label == k]
        counts = 1.0 + (np.bincount(np.concatenate(hits), minlength=size) if hits else np.zeros(size))
        total[k] = counts / (len(hits) + 2.0)
    return np.where(seen >= least, np.log(total[1] / total[-1]), 0.0)


def fit(rows: list[np.ndarray], y: np.ndarray, size: int, cost: float = 1.0, seed: int = 6, least: int = 1, sure: np.ndarray | None = None) -> tuple[np.ndarray, float, float, np.ndarray]:
    """(weights with the log-count ratios multiplied in and the bias last, Platt's a and b, the ratios).  ``sure``: how much
    each row's label counts, 0 to 1."""
    sure = np.ones(len(rows)) if sure is None else sure
    apart = np.arange(len(rows)) % 4 == 3
    if len(set(y[~apart].tolist())) < 2:
        return np.zeros(size + 1), 1.0, 0.0, np.ones(size)
    part = [r for r, a in zip(rows, apart) if not a]

    def model(part, label, sure):
        ratio = log_count_ratio(part, label, size, least)
        share = (label > 0).mean()
        each = np.where(label > 0, 0.5 / share, 0.5 / (1 - share)) * cost * sure
        return ratio, hinge_by_dual_descent(part, ratio, label, each, seed=seed)

    def margins(ratio, w, part):
        return np.array([w[r] @ ratio[r] / max(1e-12, np.sqrt(ratio[r] @ ratio[r])) + w[-1] for r in part])

    ratio, w = model(part, y[~apart], sure[~apart])
    a, b = platt(margins(ratio, w, [r for r, x in zip(rows, apart) if x]), y[apart])
    ratio, w = model(rows, y, sure)
    return np.append(w[:-1] * ratio, w[-1]), a, b, ratio


def scores(model):
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64())])

    def run(batches):
        w, a, b, squares = model.value
        for rows, data, offsets in pieces(batches, limit=PIECE, most_rows=PIECE_ROWS):
            row, found = features(data, offsets)
            n = rows.num_rows
            length = np.sqrt(np.bincount(row, squares[found], n))
            margin = np.bincount(row, w[found], n) / np.maximum(length, 1e-12) + w[-1]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(sigmoid(a * margin + b))], schema=schema)

    return run


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, held_out: Column, rows: int) -> DataFrame:
    """(doc_id, label, text) of at most ``rows`` labelled documents outside ``held_out``; of several texts of one id the least."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & ~held_out)
    usable = usable.groupBy("doc_id").agg(F.min(column).cast("int").alias("label"))
    # labels that have a document: only ids travel
    usable = usable.join(docs.select("doc_id"), "doc_id", "left_semi")
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def score(docs: DataFrame, labels: DataFrame, held_out: Column, sample: int = SAMPLE, threshold: float = 0.7) -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted.  labels: (doc_id, quality)."""
    spark = docs.sparkSession
    held_out = F.coalesce(held_out, F.lit(False))
    found = labelled_sample(docs, labels, "quality", held_out, sample).mapInArrow(sample_features, "doc_id long, label int, features array<int>").toArrow()
    found = found.sort_by("doc_id")
    rows = [np.asarray(x.values) for x in found["features"]]
    y = np.where(found["label"].to_numpy() > 0, 1, -1)
    rows, y = [r for r in rows if len(r)], y[[len(r) > 0 for r in rows]] if len(rows) else y
    w, a, b, ratio = fit(rows, y, SIZE) if len(rows) and len(set(y.tolist())) == 2 else (np.zeros(SIZE + 1), 1.0, 0.0, np.ones(SIZE))
    model = spark.sparkContext.broadcast((w, a, b, ratio**2))
    out = docs.select("doc_id", held_out.alias("held_out"), "text").mapInArrow(scores(model), "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
