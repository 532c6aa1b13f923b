"""Inputs made to hurt: nested and unclosed markup, seas of numbers, hot lines, many tiny rows, repeated ids, clashing names."""
import collections
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from taxoflux.llm import decontaminate, mixing, ngram_join, pii, quality_classifier, quality_rules, site_style_tree, suffix_dedup
from taxoflux.llm.textbytes import pieces
from test_text_operators import SCHEMA, brute_components, brute_dedup, texts


# ---- pages ---------------------------------------------------------------------------------------
@pytest.mark.parametrize("page, want", [
    ("<div>" * 20_000 + "deep text" + "</div>" * 20_000, "deep text"),
    ("start " + "<a " * 20_000, None),
    ("start " + "<!-- " * 20_000, "start"),
    ("start " + '<a x="' * 20_000 + ">", None),
    ("<p>one" * 5_000, "one\n" * 4_999 + "one"),
])
def test_hostile_pages_take_linear_time(page, want):
    began = time.monotonic()
    blocks, _ = site_style_tree.parse(page)
    text = "\n".join(t for _, t, _ in blocks)
    assert time.monotonic() - began < 10
    assert text.startswith("start") if want is None else text == want
    assert sum(len(p) for p in {p for p, _, _ in blocks}) < 100_000


# ---- personal data -------------------------------------------------------------------------------
def test_a_sea_of_numbers_hides_no_span_and_takes_bounded_memory():
    weights = pii.train()
    numbers = " ".join(str(i % 97) for i in range(4_000))
    text = f"{numbers} call (555) 123-4567 now {numbers} mail a(at)b.com"
    found = {text[a:b] for a, _, b in pii.find(text, weights)[1]}
    assert {"(555) 123-4567", "a(at)b.com"} <= found


def test_parts_of_a_zone_cover_it_once():
    zone = [(i, i + 1) for i in range(2 * pii.PART + 7)]
    begins = [tokens[i] for tokens, first, stop in pii.parts(zone) for i in range(first, stop)]
    assert begins == zone and all(len(tokens) <= pii.PART + 2 * pii.OVERLAP for tokens, _, _ in pii.parts(zone))


def test_long_address_is_masked_whole(spark):
    name = "a" * 300
    df = spark.createDataFrame([(1, f"write {name}(at)mail.com today")], SCHEMA)
    assert name[:50] not in pii.mask(df).first()["text"]


# ---- classifiers ---------------------------------------------------------------------------------
def test_pieces_bound_rows_and_bytes():
    batch = pa.RecordBatch.from_arrays([pa.array(["x"] * 1_000 + ["y" * 5_000] + [None] * 500)], names=["text"])
    sizes = [rows.num_rows for rows, _, _ in pieces([batch], limit=1_000, most_rows=64)]
    assert sum(sizes) == 1_501 and max(sizes) <= 64


def test_many_tiny_rows_are_scored(spark):
    docs = spark.createDataFrame([(i, "" if i % 2 else "ab") for i in range(4_000)], SCHEMA)
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, quality int")
    assert quality_classifier.score(docs, labels, F.lit(False)).where("score between 0 and 1").count() == 4_000


def test_a_sample_is_bounded_though_ids_repeat(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(2, "b")], SCHEMA)
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1)], "doc_id long, quality int")
    got = quality_classifier.labelled_sample(docs, labels, "quality", F.lit(False), 2).collect()
    assert sorted(map(tuple, got)) == [(1, 0, "text 0"), (2, 1, "b")]


# ---- items ---------------------------------------------------------------------------------------
def test_two_texts_of_one_item_are_two_items(spark, scratch):
    one = "the old harbour master counted seven grey boats and wrote their names into the long ledger before the tide"
    two = "a very different question about rivers mountains valleys and the roads that cross them in the dry season of the year"
    docs = spark.createDataFrame([(1, one), (2, two), (3, "nothing of the kind " * 10)], SCHEMA)
    items = spark.createDataFrame([(10, one), (10, two)], "item_id long, text string")
    found = {r["doc_id"]: r for r in decontaminate.contaminated(docs, items, scratch).collect()}
    assert set(found) == {1, 2} and all(r["item_id"] == 10 and r["n_matched"] == r["n_windows"] for r in found.values())


# ---- names ---------------------------------------------------------------------------------------
def test_clashing_columns_are_kept(spark, scratch):
    text = " ".join(f"word{i}" for i in range(80))
    docs = spark.createDataFrame([(1, text, "s")], f"{SCHEMA}, source string").withColumns({x: F.lit(x) for x in ("copy", "leak", "leak_id", "gone", "__row", "__leak", "__gone", "rid", "n_words", "COPY_")})
    items = spark.createDataFrame([(1, "other words")], "item_id long, text string")
    for out in (quality_rules.passing(docs), ngram_join.representatives(docs, scratch), decontaminate.clean(docs, items, scratch), pii.mask(docs)):
        assert out.columns == docs.columns and out.count() == 1
    emitted = mixing.emit(docs)
    assert emitted.columns == [*docs.columns, "copy__"] and emitted.first()["copy"] == "copy"


# ---- hot groups ----------------------------------------------------------------------------------
def with_hot_line(spark, rows=70):
    """Every document has one line; around it each has words of its own, some shared by a few."""
    rng = np.random.default_rng(9)
    line = "This work is offered under the terms of the common licence, with no promise whatever."
    words = lambda n: " ".join(f"{x:x}" for x in rng.integers(1 << 20, 1 << 28, n))
    some = [words(9) for _ in range(4)]
    out = [(i, f"{words(6)} {some[i % 4] if i % 3 else ''}{line}{some[i % 2] if i % 5 else words(8)} {words(5)}") for i in range(rows)]
    return spark.createDataFrame(out, SCHEMA)


@pytest.mark.parametrize("block", [600, 3_000, 1_000_000])
def test_hot_line_is_removed_exactly(spark, scratch, block):
    df = with_hot_line(spark)
    got = suffix_dedup.dedup(df, scratch, block=block, chunk_bytes=2_000).collect()
    assert collections.Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == brute_dedup(texts(df))


def test_hot_group_of_copies_is_joined_exactly(spark, scratch):
    """Two groups of near copies around one shared passage, in blocks that hold a few sets each."""
    rng = np.random.default_rng(2)
    shared, rows = [f"s{i}" for i in range(50)], []
    for group in range(2):
        own = [f"g{group}w{i}" for i in range(30)]
        for k in range(25):
            words = shared + own
            for _ in range(int(rng.integers(0, 4))):
                words[int(rng.integers(len(words)))] = f"x{k}"
            rows.append((len(rows), " ".join(words)))
    df = spark.createDataFrame(rows, SCHEMA)
    got = ngram_join.join(df, scratch, ordered=100_000, first_block=300, block=600).select("doc_id", "n_shingles", "component_id").collect()
    assert collections.Counter(map(tuple, got)) == brute_components(texts(df))


# ---- the field against every segmentation --------------------------------------------------------
def every_reading(n, spans):
    """All sets of (i, j) that cover no token twice, as the field reads them."""
    if n <= 0:
        yield ()
        return
    yield from every_reading(n - 1, spans)
    for i, j in spans:
        if j == n:
            for rest in every_reading(i, spans):
                yield (*rest, (i, j))


def test_field_equals_all_segmentations():
    rng = np.random.default_rng(8)
    for _ in range(12):
        n = int(rng.integers(1, 6))
        spans = [(i, j) for i in range(n) for j in range(i + 1, min(n, i + 3) + 1) if rng.random() < 0.8]
        weights = {(f"f{s}", k): float(rng.normal(0, 2)) for s in spans for k in range(len(pii.KINDS))}
        ahead, behind, score = pii.field(n, {s: [f"f{s}"] for s in spans}, weights)
        readings = [r for spans_used in every_reading(n, spans) for r in labelled(spans_used)]
        total = lambda r: sum(score[i, j, k] for i, j, k in r)
        z = np.logaddexp.reduce([total(r) for r in readings])
        assert ahead[n] == pytest.approx(z) and behind[0] == pytest.approx(z)
        for i, j, k in score:
            inside = np.logaddexp.reduce([total(r) for r in readings if (i, j, k) in r])
            assert ahead[i] + score[i, j, k] + behind[j] == pytest.approx(inside)
        assert total(pii.best_reading(n, score)) == pytest.approx(max(map(total, readings)))


def labelled(spans):
    if not spans:
        yield ()
        return
    for rest in labelled(spans[:-1]):
        for k in range(len(pii.KINDS)):
            yield (*rest, (*spans[-1], k))
