"""Operator 10: toxicity by weak supervision.

1. On at most SAMPLE labelled rows, words far more frequent in toxic texts become lexicons.
2. Lexicon and pattern voters vote on every whole text; only counts of vote combinations are gathered
   (at most 2**voters rows, whatever the corpus).
3. A generative label model with a latent label is fitted to these counts by expectation-maximisation:
   each voter's rates given the label, and the correlations between voters that the label leaves;
   voters that go together share one vote's weight.  Labelled sample rows pin their label.
4. The model's posterior labels of the sample and of at most UNLABELLED rows without a label train a linear classifier on
   word indicators (log-count ratios, hinge loss by dual coordinate descent, calibrated), each row by how sure its
   posterior is.  It scores every text, lexicon word or not.

Words are runs of letters (ASCII letters and all non-ASCII characters), lower-cased A-Z.

Defined cases: null text is empty, has no word and gets the model's bias; a null doc_id is never
fitted on and not held out; of several labels for one id the least counts; repeated rows score alike; an
empty table gives no rows; other columns are ignored.  Without labels of both classes every score is 0.5.
"""
from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxoflux.llm.linear import sigmoid
from taxoflux.llm.quality_classifier import fit, labelled_sample
from taxoflux.llm.runtime import Scratch
from taxoflux.llm.textbytes import pieces, word_bounds, word_hashes

SAMPLE = 7_000
UNLABELLED = 2_000
LEXICONS = 6
SIZE = 1 << 18
#: Words of fewer sample rows tell nothing about the label and are left out.
RARE = 4
PIECE = 1 << 20
VOTERS = (*(f"lexicon_{i}" for i in range(LEXICONS)), "two_hits", "dense_hits", "weak_words", "shouting", "marks", "no_hit")


def letters() -> np.ndarray:
    """Which byte values separate words here."""
    table = np.ones(256, bool)
    table[65:91] = table[97:123] = table[128:] = False
    return table


def words_of(data: np.ndarray, offsets: np.ndarray):
    starts, ends, row = word_bounds(data, offsets, letters())
    return starts, ends, row, word_hashes(data, starts, ends)


def hash_words(words: list[str]) -> np.ndarray:
    if not words:
        return np.zeros(0, np.uint64)
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(w) + 1 for w in raw]) - 1
    return word_hashes(np.frombuffer(b" ".join(raw), np.uint8), np.append(0, ends[:-1] + 1), ends)


def features(hashes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of every hashed word that a row has."""
    found = np.unique((row.astype(np.int64) << 18) | (hashes >> np.uint64(46)).astype(np.int64))
    return found >> 18, found & (SIZE - 1)


def sample_words(batches):
    """(doc_id, label, text) -> (label, word) of each different word of a text."""
    schema = pa.schema([("label", pa.int32()), ("word", pa.string())])
    word = re.compile(r"[A-Za-z\x80-\U0010ffff]+")
    fold = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    for batch in batches:
        for label, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            words = sorted(set(word.findall((text or "").translate(fold))))
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(words), pa.int32()), pa.array(words, pa.string())], schema=schema)


def learn_lexicons(sample: DataFrame) -> tuple[list[list[str]], list[str]]:
    """(LEXICONS lists of strong words, weak words): by how much more often toxic texts have them.
    Only words of at least a hundredth of the toxic texts reach the driver."""
    n = {r["label"] > 0: r["n"] for r in sample.groupBy((F.col("label") > 0).cast("int").alias("label")).agg(F.count("*").alias("n")).collect()}
    least = max(3, 0.01 * n.get(True, 0))
    counts = sample.mapInArrow(sample_words, "label int, word string").groupBy("word").agg(F.sum((F.col("label") > 0).cast("int")).alias("toxic"), F.count("*").alias("n"))
    rows = counts.where(F.col("toxic") >= least).collect()
    gain = {r["word"]: math.log((r["toxic"] + 0.5) / (n.get(True, 0) + 1)) - math.log((r["n"] - r["toxic"] + 0.5) / (n.get(False, 0) + 1)) for r in rows}
    toxic = {r["word"]: r["toxic"] for r in rows}
    strong = sorted((w for w, g in gain.items() if g > math.log(20)), key=lambda w: (-gain[w] * toxic[w], w))
    weak = sorted(w for w, g in gain.items() if math.log(4) < g <= math.log(20))
    return [strong[i::LEXICONS] for i in range(LEXICONS)], weak


def sample_features(lexicons):
    """(doc_id, label, text) -> (doc_id, label, mask, features)."""
    schema = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("mask", pa.int64()), ("features", pa.list_(pa.int32()))])

    def run(batches):
        tables = lexicons.value
        for rows, data, offsets in pieces(batches, limit=PIECE):
            mask = votes(data, offsets, *tables)
            _, _, row, hashes = words_of(data, offsets)
            row, found = features(hashes, row)
            bounds = np.searchsorted(row, np.arange(rows.num_rows + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(found.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(mask), lists], schema=schema)

    return run


def votes(data: np.ndarray, offsets: np.ndarray, strong: np.ndarray, slot: np.ndarray, weak: np.ndarray) -> np.ndarray:
    """One bit a voter, in the order of VOTERS, for each row.  ``strong`` (sorted) is in lexicon ``slot``."""
    rows = len(offsets) - 1
    starts, ends, row, hashes = words_of(data, offsets)

    def member(table):
        if not len(table):
            return np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(table, hashes), len(table) - 1)
        return table[at] == hashes, at

    hit, at = member(strong)
    count = lambda mask: np.bincount(row[mask], minlength=rows)
    total = np.bincount(row, minlength=rows)
    bits = [count(hit & (slot[at] == i)) > 0 if len(strong) else np.zeros(rows, bool) for i in range(LEXICONS)]
    hits = count(hit)
    capital = (data >= 65) & (data <= 90)
    sums = np.concatenate([[0], np.cumsum(capital)])
    shouted = (sums[ends] - sums[starts] == ends - starts) & (ends - starts >= 3)
    mark = np.concatenate([[0], np.cumsum((data[1:] == 33) & (data[:-1] == 33))]) if len(data) else np.zeros(1, np.int64)
    marks = np.append(mark, mark[-1:])[offsets[1:].clip(0, len(mark))] - np.append(mark, mark[-1:])[offsets[:-1].clip(0, len(mark))]
    bits += [hits >= 2, 100 * hits >= total.clip(1), count(member(weak)[0]) >= 2, 10 * count(shouted) >= 3 * total.clip(1), marks >= 2, hits == 0]
    mask = np.zeros(rows, np.int64)
    for i, b in enumerate(bits):
        mask |= b.astype(np.int64) << i
    return mask


def vote_counts(lexicons, sample):
    """Documents -> (mask, label of a sample row or -1, n)."""
    schema = pa.schema([("mask", pa.int64()), ("label", pa.int64()), ("n", pa.int64())])

    def run(batches):
        strong, slot, weak = lexicons.value
        ids, labels = sample.value
        for rows, data, offsets in pieces(batches, limit=PIECE):
            mask = votes(data, offsets, strong, slot, weak)
            label = np.full(len(mask), -1, np.int64)
            if len(ids):
                own = rows.column(0).fill_null(-(1 << 62)).to_numpy(zero_copy_only=False)
                at = np.minimum(np.searchsorted(ids, own), len(ids) - 1)
                label = np.where(ids[at] == own, labels[at], -1)
            keys, n = np.unique(np.stack([mask, label], 1), axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(n)], schema=schema)

    return run


class LabelModel:
    """Latent binary label; voter j fires with rate[y, j].  Voters that stay correlated given the label
    form groups, and each voter's evidence counts 1 / size of its group."""

    def __init__(self, mask: np.ndarray, label: np.ndarray, n: np.ndarray, voters: int, rounds: int = 50):
        fired = ((mask[:, None] >> np.arange(voters)) & 1).astype(float)
        pinned = label >= 0
        self.weight = np.ones(voters)
        known = np.bincount(np.maximum(label, 0)[pinned], n[pinned], 2)
        self.prior = np.clip(known[1] / max(1.0, known.sum()), 0.001, 0.999)
        self.rate = np.stack([(n * (label == y) @ fired + 0.5) / ((n * (label == y)).sum() + 1) for y in (0, 1)])
        for stage in range(2):
            for _ in range(rounds):
                p = np.where(pinned, label, self._posterior(fired))
                before = self.rate
                self.rate = np.stack([((n * q) @ fired + 0.5) / ((n * q).sum() + 1) for q in (1 - p, p)])
                self.prior = float(np.clip((n @ p) / n.sum(), 1e-4, 1 - 1e-4))
                if np.abs(self.rate - before).max() < 1e-7:
                    break
            if stage == 0:
                self.correlation = self._correlation(fired, n, np.where(pinned, label, self._posterior(fired)))
                self.weight = 1 / (1 + (np.abs(self.correlation) > 0.5).sum(1) - 1)

    def _correlation(self, fired, n, p):
        """Correlation of voters given the label, averaged over both labels."""
        out = np.zeros((fired.shape[1],) * 2)
        for y, q in ((0, 1 - p), (1, p)):
            w = n * q
            centred = fired - self.rate[y]
            cov = (centred * w[:, None]).T @ centred / max(1.0, w.sum())
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-6))
            out += 0.5 * cov / np.outer(sd, sd)
        np.fill_diagonal(out, 1.0)
        return out

    def _posterior(self, fired):
        tell = np.log(self.rate[1] / self.rate[0]), np.log((1 - self.rate[1]) / (1 - self.rate[0]))
        score = fired @ (self.weight * tell[0]) + (1 - fired) @ (self.weight * tell[1])
        return sigmoid(score + math.log(self.prior / (1 - self.prior)))

    def posterior(self, mask: np.ndarray) -> np.ndarray:
        return self._posterior(((mask[:, None] >> np.arange(len(self.weight))) & 1).astype(float))


def scores(model):
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64())])

    def run(batches):
        w, a, b, squares = model.value
        for rows, data, offsets in pieces(batches, limit=PIECE):
            _, _, row, hashes = words_of(data, offsets)
            row, found = features(hashes, row)
            n = rows.num_rows
            length = np.sqrt(np.bincount(row, squares[found], n))
            margin = np.bincount(row, w[found], n) / np.maximum(length, 1e-12) + w[-1]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(sigmoid(a * margin + b))], schema=schema)

    return run


def unlabelled_sample(docs: DataFrame, labels: DataFrame, held_out: Column, rows: int) -> DataFrame:
    """(doc_id, label, text) of at most ``rows`` documents that have no label, label -1; those of the smallest id hashes."""
    ids = docs.where(F.col("doc_id").isNotNull() & ~held_out).select("doc_id").join(labels.select("doc_id").distinct(), "doc_id", "left_anti").distinct()
    chosen = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")).select("doc_id", F.lit(-1).alias("label"), "text")


def score(docs: DataFrame, labels: DataFrame, held_out: Column, scratch: Scratch, sample: int = SAMPLE, unlabelled: int = UNLABELLED, threshold: float = 0.7) -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted.  labels: (doc_id, toxic)."""
    sc = docs.sparkSession.sparkContext
    held_out = F.coalesce(held_out, F.lit(False))
    chosen = scratch.save(labelled_sample(docs, labels, "toxic", held_out, sample))
    known = chosen.groupBy("doc_id").agg(F.max((F.col("label") > 0).cast("int")).alias("label")).orderBy("doc_id").toArrow()  # SAMPLE rows at most
    ids, toxic = known["doc_id"].to_numpy(), known["label"].to_numpy().astype(np.int64)
    w, a, b, ratio = np.zeros(SIZE + 1), 1.0, 0.0, np.ones(SIZE)
    if toxic.any() and not toxic.all():
        lexicons, weak = learn_lexicons(chosen)
        strong = hash_words([x for lexicon in lexicons for x in lexicon])
        slot = np.array([i for i, lexicon in enumerate(lexicons) for _ in lexicon], np.int64)
        order = np.argsort(strong)
        sent = sc.broadcast((strong[order], slot[order], np.sort(hash_words(weak))))
        counted = docs.select("doc_id", "text").mapInArrow(vote_counts(sent, sc.broadcast((ids, toxic))), "mask long, label long, n long")
        counted = counted.groupBy("mask", "label").agg(F.sum("n").alias("n")).orderBy("mask", "label").toArrow()  # 3 * 2**len(VOTERS) rows at most
        model = LabelModel(counted["mask"].to_numpy(), counted["label"].to_numpy(), counted["n"].to_numpy().astype(float), len(VOTERS))
        more = chosen.select("doc_id", "label", "text").unionByName(unlabelled_sample(docs, labels, held_out, unlabelled))
        found = more.mapInArrow(sample_features(sent), "doc_id long, label int, mask long, features array<int>").toArrow().sort_by("doc_id")
        p = model.posterior(found["mask"].to_numpy())
        y, sure = np.where(p >= 0.5, 1, -1), np.abs(2 * p - 1)
        rows = [np.asarray(x.values) for x in found["features"]]
        use = [i for i in range(len(rows)) if len(rows[i])]
        if len(set(y[use].tolist())) == 2:
            w, a, b, ratio = fit([rows[i] for i in use], y[use], SIZE, seed=10, least=RARE, sure=sure[use])
    model = sc.broadcast((w, a, b, ratio**2))
    out = docs.select("doc_id", held_out.alias("held_out"), "text").mapInArrow(scores(model), "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
