"""Each operator against a plain Python version, and its defined cases."""
import collections
import functools
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from taxoflux.llm import components as connected
from taxoflux.llm import context_tree, decontaminate, mixing, ngram_join, pii, quality_classifier, quality_rules, site_style_tree, suffix_dedup, toxicity
from taxoflux.llm.linear import hinge_by_dual_descent, platt
from taxoflux.llm.runtime import Scratch
from taxoflux.llm.suffix_array import suffix_array
from taxoflux.llm.textbytes import bytes_of, word_bounds

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
#: Nulls, emptiness, ties, repeats and odd separators; extra columns clash with the operators' own.
ODD = [(1, None), (2, ""), (3, " \t\n "), (4, "a b c"), (4, "a b c"), (5, "A B c"), (6, "x" * 3000), (None, "lost words here"), (7, "é ü ß\x0bz"), (8, "w " * 400)]
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture
def odd(spark):
    extra = {c: F.lit("clash") for c in ("n_words", "score", "kept", "size", "label", "set_id", "copies", "uid", "seed", "__row", "held_out", "gone", "copy", "leak", "rid", "part")}
    return spark.createDataFrame(ODD, SCHEMA).withColumns({"lang": F.lit(None).cast("string"), "source": F.lit(None).cast("string"), "n_chars": F.lit(0).cast("long")} | extra)


@pytest.fixture
def scratch(spark):
    return Scratch(spark)


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


# ---- quality rules -------------------------------------------------------------------------------
def metrics(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = collections.Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if count[w] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_quality_rules(which, request):
    df = request.getfixturevalue(which)
    judged = quality_rules.judge(df).collect()
    want = collections.Counter((i, *metrics(t)) for i, t in texts(df))
    assert collections.Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in judged) == want
    for r in judged:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and not (r["base_failed"] and r["kept"])
    passing = quality_rules.passing(df)
    assert passing.columns == df.columns and passing.count() == sum(r["kept"] for r in judged)


def test_rule_order_changes_no_verdict(docs):
    one = {(r[0], r[1]) for r in quality_rules.judge(docs).select("doc_id", "kept").collect()}
    two = {(r[0], r[1]) for r in quality_rules.judge(docs, tuple(reversed(quality_rules.RULES)), sample_rows=3).select("doc_id", "kept").collect()}
    assert one == two
    ordered = quality_rules.order_rules(docs)
    assert [h / c for _, h, c in ordered] == sorted((h / c for _, h, c in ordered), reverse=True)


# ---- near duplicates -----------------------------------------------------------------------------
def shingles(text):
    w = WORD.findall((text or "").translate(FOLD))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    label = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            n = len(x & y)
            if x and 100 * n >= 75 * (len(x) + len(y) - n):
                old, new = label[a], label[b]
                label = [new if v == old else v for v in label]
    out = []
    for k, (i, s) in enumerate(sets):
        ids = [sets[m][0] for m in range(len(sets)) if label[m] == label[k] and sets[m][0] is not None]
        out.append((i, len(s), min(ids) if ids and s else i))
    return collections.Counter(out)


def near_copies(spark):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, common = [], " ".join(rng.choice(vocabulary, 30))
    for group in range(6):
        base = list(rng.choice(vocabulary, int(rng.integers(40, 160))))
        for copy in range(6):
            words = list(base)
            for _ in range(copy):
                words[int(rng.integers(len(words)))] = "new" + str(rng.integers(1000))
            rows.append((len(rows), " ".join(words) + (" " + common if group % 2 else "")))
    return spark.createDataFrame(rows, SCHEMA)


def drifting_copies(spark):
    """Each row differs a little from the one before it, so most of a chain's links do not touch its smallest set."""
    rng = np.random.default_rng(5)
    rows, words = [], [f"w{i}" for i in range(90)]
    for i in range(70):
        words = list(words)
        words[int(rng.integers(len(words)))] = f"n{i}"
        rows.append((None if i % 9 == 4 else i, " ".join(words)))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("which", ["docs", "odd", "near", "drift", "drift shuffled", "drift with ranks"])
def test_ngram_join(which, request, spark, scratch):
    df = near_copies(spark) if which == "near" else drifting_copies(spark) if "drift" in which else request.getfixturevalue(which)
    # forces late shingles, blocks and block pairs
    limits = {"near": {"ordered": 20, "block": 500, "first_block": 200}, "drift": {"block": 900, "first_block": 600}, "drift shuffled": {"block": 300, "first_block": 300, "broadcast_rows": 0}, "drift with ranks": {"ordered": 100_000, "first_block": 400}}.get(which, {})
    got = ngram_join.join(df, scratch, **limits).select("doc_id", "n_shingles", "component_id").collect()
    assert collections.Counter(tuple(r) for r in got) == brute_components(texts(df))


def test_representatives(odd, scratch):
    kept = ngram_join.representatives(odd, scratch)
    assert kept.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in kept.select("doc_id").collect()) == sorted(["1", "2", "3", "4", "4", "6", "None", "7", "8"])


def test_prefix_tree_finds_all_links():
    rng = np.random.default_rng(0)
    for _ in range(60):
        base = rng.integers(0, 60, 40).astype(np.uint64)
        sets = [np.unique(np.where(rng.random(40) < rng.random() * 0.3, rng.integers(0, 300, 40), base)).astype(np.uint64) for _ in range(8)]
        found = ngram_join.spanning_links(sets)
        join = lambda pairs: [min(_reach(i, pairs)) for i in range(8)]
        want = [(a, b) for a in range(8) for b in range(a) if 7 * len(np.intersect1d(sets[a], sets[b])) >= 3 * (len(sets[a]) + len(sets[b]))]
        assert join(found) == join(want) and set(map(frozenset, found)) <= set(map(frozenset, want))


def _reach(i, pairs):
    seen = {i}
    while more := {y for a, b in pairs for x, y in ((a, b), (b, a)) if x in seen} - seen:
        seen |= more
    return seen


# ---- repeated passages ---------------------------------------------------------------------------
def brute_dedup(rows, length=50):
    by_doc = collections.defaultdict(set)
    for i, t in rows:
        raw = (t or "").encode()
        by_doc[math.inf if i is None else i] |= {raw[j : j + length] for j in range(len(raw) - length + 1)}
    first = {}
    for i in sorted(by_doc):
        for w in by_doc[i]:
            first.setdefault(w, i)
    out = []
    for i, t in rows:
        raw, own = (t or "").encode(), math.inf if i is None else i
        gone = bytearray(len(raw))
        for j in range(len(raw) - length + 1):
            if first[raw[j : j + length]] < own:
                gone[j : j + length] = b"\x01" * length
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        out.append((i, len(raw), len(raw) - len(kept), len(re.findall(b"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return collections.Counter(out)


@pytest.mark.parametrize("which", ["docs", "odd", "near"])
def test_suffix_dedup(which, request, spark, scratch):
    df = near_copies(spark) if which == "near" else request.getfixturevalue(which)
    limits = {"block": 1500} if which == "near" else {}
    got = suffix_dedup.dedup(df, scratch, with_text=True, **limits).collect()
    assert collections.Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == brute_dedup(texts(df))
    assert all(hashlib.sha256(bytes(r["kept"])).hexdigest() == r["kept_sha256"] for r in got)


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(1)
    for n, k in ((1, 1), (80, 1), (200, 2), (500, 3), (3000, 4)):
        s = np.append(rng.integers(1, k + 1, n), 0)
        assert suffix_array(s, int(s.max()) + 1).tolist() == sorted(range(n + 1), key=lambda i: s[i:].tolist())


# ---- language model ------------------------------------------------------------------------------
def unigram(rows):
    out, counts = [], collections.Counter()
    for i, t in rows:
        words = [*WORD.findall((t or "").translate(FOLD)), None]
        held = i is not None and zlib.crc32(str(i).encode()) % 7 == 2
        out.append((i, held, words))
        if not held:
            counts.update(words)
    n, v = sum(counts.values()), len(counts)
    return [(i, h, len(w), sum(counts[x] > 0 for x in w), n, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)) for i, h, w in out]


def context_tree_price(training, depth):
    """log10 probabilities by the definition: each bit's KT estimates, mixed from the longest context up."""
    counts = collections.defaultdict(lambda: [0, 0])
    children = collections.defaultdict(set)

    def bits(stream, i):
        past = bytes(stream[i - 1 - j] if i - 1 - j >= 0 else 10 for j in range(depth))
        return [((1 << k) | (stream[i] >> (8 - k)), past, (stream[i] >> (7 - k)) & 1) for k in range(8)]

    for stream in training:
        for i in range(len(stream)):
            for node, past, bit in bits(stream, i):
                for d in range(depth + 1):
                    counts[node, past[:d]][bit] += 1
                    if d < depth:
                        children[node, past[:d]].add(past[: d + 1])

    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    @functools.cache
    def pw(node, past):
        own = kt(*counts.get((node, past), (0, 0)))
        if len(past) == depth:
            return own
        return float(np.logaddexp(own, sum(pw(node, c) for c in children.get((node, past), ()))) - math.log(2))

    def probability(node, past, bit):
        p = None
        for d in range(depth, -1, -1):
            n = counts.get((node, past[:d]), (0, 0))
            estimate = (n[bit] + 0.5) / (sum(n) + 1)
            share = 1 if p is None else math.exp(math.log(0.5) + kt(*n) - pw(node, past[:d]))
            p = estimate if p is None else share * estimate + (1 - share) * p
        return p

    return lambda stream: sum(math.log10(probability(*b)) for i in range(len(stream)) for b in bits(stream, i))


def streams(rows):
    return [(i, " ".join(WORD.findall((t or "").translate(FOLD))).encode() + b"\n") for i, t in rows]


@pytest.mark.parametrize("which, chunk", [("docs", None), ("docs", 20_000), ("odd", None), ("odd", 300)])
def test_context_tree(which, chunk, request, scratch):
    df = request.getfixturevalue(which)
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    got = context_tree.score(df, held, scratch, **({"chunk_bytes": chunk} if chunk else {})).collect()
    key = lambda r: (str(r[0]), *r[1:])
    have = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got), key=key)
    want = sorted(unigram(texts(df)), key=key)
    assert [r[:5] for r in have] == [r[:5] for r in want]
    assert [r[5] for r in have] == pytest.approx([r[5] for r in want], rel=1e-9)
    assert all(r["score"] < 0 and r["bits_per_byte"] > 0 for r in got)


def test_context_tree_equals_its_definition(spark, scratch):
    rows = [(0, "abra cadabra abra"), (1, "Abra abra"), (2, None), (3, "cad ab \u00e9"), (4, "a new word"), (5, "abracad")]
    depth = 3
    price = context_tree_price([s for i, s in streams(rows) if i not in (4, 5)], depth)
    got = context_tree.score(spark.createDataFrame(rows, SCHEMA), F.col("doc_id") > 3, scratch, depth=depth, chunk_bytes=20).collect()
    want = {i: (price(s), -price(s) / math.log10(2) / len(s)) for i, s in streams(rows)}
    assert {r["doc_id"]: (r["score"], r["bits_per_byte"]) for r in got} == {i: pytest.approx(x, rel=1e-9) for i, x in want.items()}


def test_context_tree_probabilities_sum_to_one():
    text = np.frombuffer(b"abracadabra abracadabra\n", np.uint8)
    codes = context_tree.strings_of(text, np.array([0, len(text)]), 2)
    context = codes[10] & ~np.uint64(255)
    every = context | np.arange(256, dtype=np.uint64)
    known, counts = np.unique(codes, return_counts=True)
    all_codes = np.concatenate([known, every])
    t = context_tree.Trees(all_codes, np.concatenate([counts, np.zeros(256)]), 2, 0)
    assert abs(np.exp(np.log(t.p).reshape(-1, 8).sum(1))[len(known) :].sum() - 1) < 1e-9


# ---- personal data -------------------------------------------------------------------------------
PATTERNS = (
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def plain_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    ok = (lambda m: True, lambda m: all(int(x) <= 255 for x in m[0].split(".")), lambda m: 14 <= len(digits(m)) <= 19 and pii.luhn(digits(m)), lambda m: 10 <= len(digits(m)) <= 15)
    return sorted((m.start(), k, m.end()) for k, p in enumerate(PATTERNS) for m in p.finditer(text) if ok[k](m))


def test_base_patterns():
    rng = np.random.default_rng(5)
    pieces = ["a.b@c.de", "@", "x@y", "1.2.3.4", "999.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+", "12", ".", " ", "-", "a", "é", "@b.c.d", "007.010.000.255"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces, rng.integers(1, 9)))
        assert pii.base_spans(text) == plain_spans(text), text


def test_pii(docs, odd):
    for df in (docs, odd):
        got = collections.Counter(tuple(r) for r in pii.detect(df).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256").collect())
        want = []
        for i, t in texts(df):
            s = plain_spans(t or "")
            want.append((i, *(sum(k == n for _, k, _ in s) for n in range(4)), hashlib.sha256(",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in s).encode()).hexdigest()))
        assert got == collections.Counter(want)


def test_field_adds_other_spellings_and_no_lookalikes():
    weights = pii.train()
    text = "call (212) 555-0199 or jo[at]mail.com on 2024-05-06 at 10:20:30, build 1.2.3 id 00af00af00af00af00af00af00af00af00af00af"
    _, spans = pii.find(text, weights)
    assert [(pii.KINDS[k], text[a:b]) for a, k, b in spans] == [("phone", "(212) 555-0199"), ("email", "jo[at]mail.com")]
    found = missed = extra = 0
    for s, gold in pii.sentences(200, 77):
        base, every = pii.find(s, weights)
        new = set(every) - set(base)
        found, missed, extra = found + len(new & set(gold)), missed + len(set(gold) - set(every)), extra + len(new - set(gold))
    assert found > 10 * missed and extra <= found // 50


def test_field_finds_spans_glued_to_other_text():
    weights = pii.train()
    for text in ("a,555-123-4567,b", "tel:555-123-4567", '{"phone":"555-123-4567"}', "电话555-123-4567号", "x," * 60 + "555-123-4567"):
        assert [(pii.KINDS[k], text[a:b]) for a, k, b in pii.find(text, weights)[1]] == [("phone", "555-123-4567")], text


def test_mask(spark):
    df = spark.createDataFrame([(1, "mail a@b.de now", 15), (2, None, None)], "doc_id long, text string, n_chars long")
    assert {tuple(r) for r in pii.mask(df).collect()} == {(1, "mail [EMAIL] now", 16), (2, None, None)}


# ---- decontamination -----------------------------------------------------------------------------
def test_decontamination(spark, scratch):
    item = "In 2019 the farmer John sold 40 kg of apples to his neighbour, and John kept 12 kg for the long winter ahead of him"
    plain = "the quick fox jumps over the lazy dog while seven wise owls watch from an old oak tree"
    rows = [
        (1, f"noise before. {item}. noise after"), (2, "so In 1987 the farmer Mary sold 7 lb of apples to his neighbour, and Mary kept 3 lb for the long winter ahead of him"),
        (3, "so In 1987 the farmer Mary sold 7 lb of apples to his neighbour, and Peter kept 3 lb for the long winter ahead of him"), (4, "an unrelated text " * 20), (5, None), (6, ""), (7, plain.upper()), (None, plain), (None, plain),
    ]
    docs = spark.createDataFrame(rows, SCHEMA)
    items = spark.createDataFrame([(10, item), (11, plain), (12, None), (13, "5 6 7"), (14, "short question here")], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminated(docs, items, scratch).collect()}
    assert {(1, 10), (2, 10), (7, 11), (None, 11)} <= set(found) <= {(1, 10), (2, 10), (3, 10), (7, 11), (None, 11)}
    assert found[2, 10]["n_changed"] > 0 and found[1, 10]["n_changed"] == 0
    strict = decontaminate.contaminated(docs, items, scratch, inconsistent=0.0)
    assert (3, 10) not in {(r[0], r[1]) for r in strict.select("doc_id", "item_id").collect()}
    assert sorted(str(r["doc_id"]) for r in decontaminate.clean(docs, items, scratch, inconsistent=0.0).collect()) == ["3", "4", "5", "6"]
    big = decontaminate.contaminated(docs, items, scratch, broadcast_windows=0)
    assert {(r[0], r[1]) for r in big.select("doc_id", "item_id").collect()} == set(found)


def test_decontamination_finds_items_with_other_names_and_number_words(spark, scratch):
    item = "Each day John bakes four cakes. Mary sells three of them and keeps the rest."
    rows = [
        (1, item.replace("Mary", "Anna")), (2, item.replace("four", "five").replace("three", "two")), (3, "Well then. " + item.replace("John", "Mary Ann")), (4, item.replace("sells", "sells about")),
        (5, item.replace("sells", "gives")), (6, "Each day we went to the sea. Mary sells shells and keeps dogs."), (7, "and 5 6 7 is"), (8, "and 5 6 8 is"), (9, item),
    ]
    docs = spark.createDataFrame(rows, SCHEMA)
    items = spark.createDataFrame([(10, item), (13, "5 6 7")], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminated(docs, items, scratch).collect()}
    assert set(found) == {(1, 10), (2, 10), (3, 10), (4, 10), (5, 10), (7, 13), (9, 10)}
    assert found[3, 10]["n_changed"] > 0 and found[9, 10]["n_changed"] == 0


def test_decontamination_finds_every_verbatim_item(spark, docs, scratch):
    items = spark.read.parquet(f"{DATA}/benchmark.parquet")
    low = {i: " ".join(t.lower().split()) for i, t in texts(docs)}
    want = {(i, j) for i, t in low.items() for j, x in [(r["item_id"], r["text"]) for r in items.collect()] if " ".join(x.lower().split()) in t}
    assert {(r[0], r[1]) for r in decontaminate.contaminated(docs, items, scratch).select("doc_id", "item_id").collect()} == want


# ---- mixing --------------------------------------------------------------------------------------
def test_mixing_targets(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 10), ("c", 1000), (None, 5)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(sizes).collect()}
    left, open_, want = 1115.0, {"a": (5, 300), "b": (2, 30), "c": (1, 3000), None: (5, 15)}, {}
    while True:
        level = left / sum(w for w, _ in open_.values())
        over = [k for k, (w, cap) in open_.items() if level * w >= cap]
        if not over:
            break
        for k in over:
            want[k] = open_.pop(k)[1]
            left -= want[k]
    want |= {k: level * w for k, (w, _) in open_.items()}
    assert got == pytest.approx(want) and sum(got.values()) == pytest.approx(1115)


def test_mixing(docs, odd):
    for df in (docs, odd):
        mixed = mixing.mix(df).collect()
        assert collections.Counter((r["doc_id"], r["size"]) for r in mixed) == collections.Counter((i, len(WORD.findall(t or ""))) for i, t in texts(df))
        assert all(r["taken"] <= 3 * r["size"] for r in mixed) and mixed == mixing.mix(df).collect()
        emitted = mixing.emit(df)
        assert emitted.columns == [*df.columns, "copy"] and emitted.count() == sum(r["copies"] for r in mixed)


# ---- classifiers ---------------------------------------------------------------------------------
def test_dual_descent_and_calibration():
    rng = np.random.default_rng(2)
    rows = [np.unique(np.append(rng.integers(2, 40, 6), i % 2)) for i in range(200)]
    y = np.where(np.arange(200) % 2 == 0, 1, -1)
    w = hinge_by_dual_descent(rows, np.ones(40), y, np.ones(200))
    margin = np.array([w[r].sum() for r in rows]) + w[-1]
    assert (np.sign(margin) == y).all() and w[0] > 0 > w[1]
    a, b = platt(margin, y)
    assert a > 0 and abs(b) < 5


@pytest.fixture(scope="module")
def labelled(spark):
    base = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")


def test_quality_classifier(labelled, odd):
    docs, labels = labelled
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    got = quality_classifier.score(docs, labels, held)
    joined = got.join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in joined) >= 0.9 * len(joined)
    again = {r["doc_id"]: r["score"] for r in quality_classifier.score(docs.repartition(7), labels, held).collect()}
    assert all(abs(again[r["doc_id"]] - r["score"]) < 1e-9 for r in got.collect())
    assert quality_classifier.score(odd, labels, held).count() == len(ODD)
    assert {r["score"] for r in quality_classifier.score(odd, labels.limit(0), held).collect()} == {0.5}


def test_toxicity(labelled, odd, scratch):
    docs, labels = labelled
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    joined = toxicity.score(docs, labels, held, scratch).join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["toxic"] for r in joined) >= 0.9 * len(joined)
    assert toxicity.score(odd, labels, held, scratch).count() == len(ODD)
    assert {r["score"] for r in toxicity.score(odd, labels.limit(0), held, scratch).collect()} == {0.5}


def test_label_model_weighs_voters():
    rng = np.random.default_rng(4)
    y = rng.random(4000) < 0.3
    fire = lambda hit, false: np.where(y, rng.random(4000) < hit, rng.random(4000) < false)
    good, noise = [fire(0.9, 0.05), fire(0.85, 0.1), fire(0.8, 0.05)], fire(0.5, 0.5)
    bits = np.stack([*good, noise, noise], 1)
    mask = (bits.astype(np.int64) << np.arange(5)).sum(1)
    keys, n = np.unique(mask, return_counts=True)
    model = toxicity.LabelModel(np.append(keys, [7, 0]), np.append(np.full(len(keys), -1), [1, 0]), np.append(n, [50, 50]).astype(float), 5)
    assert model.rate[1, 0] > 0.8 > 0.2 > model.rate[0, 0] and model.correlation[3, 4] > 0.9
    assert ((model.posterior(mask) >= 0.5) == y).mean() > 0.93


# ---- pages ---------------------------------------------------------------------------------------
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x="</p>"</script></head><body>
<header><a href="/">Home</a></header><nav><ul><li>One<li>Two</ul></nav><div class="x9">Same box everywhere</div><article><h1>Head %d</h1><p>First&nbsp;&amp; <b>bold
 text %d</b><p>Second<br>line %d</p><div class="share">Share</div><section class="comments"><p>nice</p></section></article>
<form><input><p>Search</p></form><aside>Side</aside><footer>&copy; us</footer><!-- end --></body></html>"""


def test_pages(spark, scratch):
    pages = [(i, "http://h.example/" + str(i), PAGE % (i, i, i)) for i in range(20)]
    pages += [(50, None, None), (51, "x", ""), (52, "http://o/", "plain <i>text</i> only"), (53, "http://o/", "<p>open <!-- never closed"), (54, "http://o/", "<p>a<script>b"), (0, "http://h.example/0", PAGE % (0, 0, 0))]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = collections.defaultdict(list)
    for r in site_style_tree.extract(df, scratch).collect():
        got[r["page_id"]].append(r["text"])
    assert got[3] == ["Head 3\nFirst & bold text 3\nSecond line 3"] and len(got[0]) == 2 and got[0][0] == got[0][1]
    assert (got[50], got[51], got[52], got[53], got[54]) == ([""], [""], ["plain text only"], ["open"], ["a"])
    joined = {r["page_id"]: r["text"] for r in site_style_tree.extract(df, scratch, table_rows=0).collect()}
    assert joined[3] == got[3][0]


def test_pages_lose_whole_branches(spark, scratch):
    page = '<body><div class="q1/2"><p>Text %d of this page, and more of it to read here</p></div><div class="z7"><div class="k">The same words here</div><div class="d">Day %d</div></div></body>'
    df = spark.createDataFrame([(i, "http://h.example/", page % (i, i)) for i in range(30)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in site_style_tree.extract(df, scratch).collect()}
    assert got == {i: f"Text {i} of this page, and more of it to read here" for i in range(30)}


@pytest.mark.parametrize("page, want", [
    ('<div class="content-sidebar-wrap"><article><p>A long text</p><div class="comments"><article>me too, and at great length</article></div></article><div class="widget">W</div></div>', "A long text"),
    ('<body><form id="aspnetForm"><div id="menu">M</div><p>A long text</p></form></body>', "A long text"),
    ('<div style="overflow:hidden" title="Hidden gems" data-role="menu"><p>A long text</p></div><p>b</p>', "A long text|b"),
    ('<div hidden><p>A long text</p></div><nav>menu with many words</nav><p>b</p>', "b"),
    ('<div class="layout has-sidebar"><main><p>A long text</p></main></div>', "A long text"),
])
def test_names_spare_the_article(page, want):
    assert "|".join(t for _, t, _ in site_style_tree.parse(page)[0]) == want


def test_copies_of_a_page_vote_once(spark, scratch):
    many = "<h1>Headline</h1><article><h1>Title</h1></article>" + "".join(f"<p>Paragraph {k} of the article</p>" for k in range(10))
    df = spark.createDataFrame([(i, "http://h.example/", many if i < 200 else f"<p>Unique {i}</p>") for i in range(204)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in site_style_tree.extract(df, scratch).collect()}
    assert got[0].split("\n") == ["Headline", "Title", *(f"Paragraph {k} of the article" for k in range(10))] and got[201] == "Unique 201"


def test_paths_of_all_hosts_stand_in_only_where_pages_are_few(spark, scratch):
    # "p" repeats on the hosts with few pages and on one hot host, "own" has different ones on as many pages as it needs
    same = [(f"http://h{k}.example/", "<p>Same line</p>") for k in range(5)]
    hot = [("http://hot.example/", f"<p>Same line</p><h2>Cut</h2><div>Story {i} told at length, so that it is most of the text</div>") for i in range(400)]
    story = "<div>Story %d told at length, so that it is most of the text</div>"
    few = [(f"http://few{k}.example/", f"<h2>Cut</h2>{story % k}") for k in range(5)]
    own = [("http://own.example/", f"<p>Line {i}</p>") for i in range(10)]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(same + hot + few + own)], "page_id long, url string, html string")
    for table_rows in (site_style_tree.TABLE_ROWS, 1):
        got = {r["url"]: r["text"] for r in site_style_tree.extract(df, scratch, table_rows=table_rows).collect()}
        assert got["http://own.example/"].startswith("Line ") and got["http://h0.example/"] == ""
        assert "Cut" not in got["http://few3.example/"] and "Story 3" in got["http://few3.example/"]


def test_pages_without_rows(spark, scratch):
    assert site_style_tree.extract(spark.createDataFrame([], "page_id long, url string, html string"), scratch).count() == 0


# ---- all ----------------------------------------------------------------------------------------
def test_empty_tables(spark, scratch):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    items, labels = spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for out in (
        quality_rules.judge(none), decontaminate.contaminated(none, items, scratch), context_tree.score(none, F.lit(False), scratch), pii.detect(none), quality_classifier.score(none, labels, F.lit(False)),
        ngram_join.join(none, scratch), mixing.mix(none), mixing.emit(none), suffix_dedup.dedup(none, scratch), toxicity.score(none, labels, F.lit(False), scratch),
    ):
        assert out.count() == 0


def test_words_are_cut_on_ascii_separators_only():
    import pyarrow as pa

    rows = ["a\x0bb", "", None, "é ü", " x "]
    data, offsets = bytes_of(pa.array(rows))
    starts, ends, row = word_bounds(data, offsets)
    assert [(int(r), bytes(data[a:b]).decode()) for a, b, r in zip(starts, ends, row)] == [(0, "a"), (0, "b"), (3, "é ü"), (4, "x")]


# ---- components ----------------------------------------------------------------------------------
@pytest.mark.parametrize("flush", [3, 1_000_000])
def test_components(spark, scratch, monkeypatch, flush):
    monkeypatch.setattr(connected, "FLUSH", flush)
    rng = np.random.default_rng(flush)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))] + [(i, i + 1) for i in range(100, 130)]
    got = {r["node"]: r["label"] for r in connected.components(spark.createDataFrame(pairs, "a long, b long").repartition(3), scratch).collect()}
    assert got == {i: min(_reach(i, pairs)) for i in {x for p in pairs if p[0] != p[1] for x in p}}
