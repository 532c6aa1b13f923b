"""The pipeline's stages on small tables, each against what its operator decides on that stage's input."""
import collections
import hashlib
import re

import numpy as np

import corpus_pipeline
from taxoflux.llm import decontaminate, mixing, ngram_join, quality_rules
from taxoflux.llm.runtime import Scratch

DATA = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, seen = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        seen.append((docs, out))
        assert out.columns == (columns if k < 4 else [*columns, "copy"])
        docs = out
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    a, b = seen[0]
    assert ids(b) == ids(quality_rules.judge(a).where("kept"))
    a, b = seen[1]
    assert ids(b) == ids(ngram_join.join(a, Scratch(spark)).where("doc_id = component_id"))
    a, b = seen[2]
    gone = {r["doc_id"] for r in decontaminate.contaminated(a, spark.read.parquet(f"{DATA}/benchmark.parquet"), Scratch(spark)).collect()}
    assert ids(b) == sorted(set(ids(a)) - gone) and gone
    a, b = seen[3]
    assert ids(a) == ids(b) and not b.where("text like '%@mail%.example.com%'").count()
    a, b = seen[4]
    assert b.count() == sum(r["copies"] for r in mixing.mix(a).collect())


# ---- the whole pipeline against plain Python -------------------------------------------------------
WORD = re.compile(r"[^\x20\x09-\x0D]+")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
ITEM = "which of these old harbours lies closest to the northern lighthouse that the fishermen painted after the great storm"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, copy string, gone string, leak string, __row string"


def fixture(seed=4):
    """Prose, near and exact copies, junk, an item, addresses; null ids, texts and sources, repeated rows, clashing columns."""
    rng = np.random.default_rng(seed)
    vocabulary = [f"{a}{b}" for a in "ba ke lo mi ru sa te vo".split() for b in "ndar lto mpel rish tova wenk zul quor".split()]
    prose = lambda n: " ".join(rng.choice(vocabulary, n))
    base = prose(120).split()
    near = list(base)
    near[60] = "changed"
    far = list(base)
    far[::6] = ["other"] * len(far[::6])
    texts = [
        prose(90), prose(70) + "\n" + prose(40), " ".join(base), " ".join(near), " ".join(far), " ".join(base), "too short", "", None, "SHOUT " * 60, " ".join(["#@ word"] * 60), "\n".join([prose(12)] * 9),
        "one two three " * 40, prose(40) + " " + ITEM + " " + prose(40), prose(80) + " write to jo.doe@mail.example.com or x@y.org now", prose(64), prose(300),
    ]
    sources = ["web", "web", "web", "books", None, "web", "web", "books", None, "web", "web", "books", "web", "books", "books", None, "code"]
    rows = [(i, t, "en", s, len(t) if t else None, "c", "g", "l", "r") for i, (t, s) in enumerate(zip(texts, sources))]
    rows += [rows[0], (None, prose(66), None, "web", 1, None, None, None, None), (40, prose(75), None, "code", 2, None, None, None, None)]
    return rows


def passes(text):
    text = text or ""
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    chars = sum(map(len, words))
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = collections.Counter(windows)
    repeated = len({i + j for i, w in enumerate(windows) if count[w] > 1 for j in range(3)})
    doubled = len(lines) - len(set(lines))
    return not (len(words) < 50 or 100 * repeated > 50 * len(words) or 100 * sum(c in "#*$%&|<>" for c in text) > 5 * chars or 100 * sum(c.isupper() for c in text) > 50 * chars or doubled >= 3 and 100 * doubled > 40 * len(lines))


def shingles(text):
    words = WORD.findall(text.lower())
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def one_of_each(rows):
    sets = [shingles(r[1]) for r in rows]
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if None not in (rows[a][0], rows[b][0]) and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                label = [label[b] if x == label[a] else x for x in label]
    return [r for r, x in zip(rows, label) if r[0] is None or r[0] == min(q[0] for q, y in zip(rows, label) if x == y)]


def mixed(rows):
    size = collections.Counter()
    for r in rows:
        size[r[3]] += len(WORD.findall(r[1]))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(size, key=lambda s: (s is None, s)))}
    target, full, left = {}, set(), float(sum(size.values()))
    while True:  # what is above its cap is set to it, the excess shared anew
        rest = {s: left * weight[s] / sum(weight[t] for t in size if t not in full) for s in size if s not in full}
        over = {s for s in rest if rest[s] >= 3 * size[s]}
        if not over:
            target |= rest
            break
        full |= over
        left -= sum(3 * size[s] for s in over)
        target |= {s: 3.0 * size[s] for s in over}
    out = []
    for r in rows:
        rate = target[r[3]] / size[r[3]]
        unit = int(hashlib.md5(f"8:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:12], 16) / 2**48
        out += [(*r, k + 1) for k in range(int(rate) + (unit < rate - int(rate)))]
    return out


def test_pipeline_equals_plain_python(spark, tmp_path):
    spark.createDataFrame(fixture(), COLUMNS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, ITEM), (2, None), (None, ITEM)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = one_of_each([r for r in fixture() if passes(r[1])])
    rows = [r for r in rows if ITEM not in r[1]]
    masked = [(r[0], EMAIL.sub("[EMAIL]", r[1]), r[2], r[3], len(EMAIL.sub("[EMAIL]", r[1])), *r[5:]) for r in rows]
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == [*(x.split()[0] for x in COLUMNS.split(", ")), "copy_"]
    assert collections.Counter(map(tuple, out.collect())) == collections.Counter(mixed(masked))
    assert len(rows) >= 8 and any("[EMAIL]" in r[1] for r in masked)


def test_pipeline_over_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
