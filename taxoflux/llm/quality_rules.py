"""Operator 2: quality rules as a short-circuit cascade.  DataFrame functions only.

Each rule names the metrics it needs, a rejecting condition and the work it does (elements visited).
On a sample the operator estimates each rule's selectivity and cost and orders the rules by rejections
per unit of cost.  ``passing`` runs them in that order, each on the rows that the ones before have left, and
computes a rule's metrics only then.  ``judge`` reports all metrics of every row, so there the order decides only which
rule is named.  The order never changes the verdict.

Metrics (words are ``[^\\x20\\x09-\\x0D]+``) are computed in the row: no shuffle.
Windows of three words are compared by the 64-bit hash of their words; a row's windows are sorted, so
a long text costs n log n and never a task of its own.

Defined cases: null or empty text has no words and is rejected by the word count; null ids are kept
as they are; repeated rows are judged alike; an empty table gives no rows; other columns are ignored.
"""
from __future__ import annotations

from dataclasses import dataclass
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
NON_SPACE = r"[^\x20\x09-\x0D]"


@dataclass(frozen=True)
class Rule:
    """needs: metrics that the rule reads.  reject: when a row goes.  work: elements that evaluating the rule visits, for its cost."""

    name: str
    needs: tuple[str, ...]
    reject: Callable[[], Column]
    work: Callable[[], Column]
    base: bool = False


def _c(name: str) -> Column:
    return F.col(name)


RULES = (
    Rule("few_words", ("n_words",), lambda: _c("n_words") < 50, lambda: _c("n_words"), base=True),
    Rule("repeated_windows", ("n_words", "n_repeat_words"), lambda: 100 * _c("n_repeat_words") > 50 * _c("n_words"), lambda: 12 * _c("n_words"), base=True),
    # Thresholds below are far above what ordinary prose shows (a symbol or capital every few words).
    Rule("symbols", ("n_symbols", "word_chars"), lambda: 100 * _c("n_symbols") > 5 * _c("word_chars"), lambda: _c("word_chars")),
    Rule("shouting", ("n_upper", "word_chars"), lambda: 100 * _c("n_upper") > 50 * _c("word_chars"), lambda: _c("word_chars")),
    Rule("repeated_lines", ("n_lines", "n_dup_lines"), lambda: (_c("n_dup_lines") >= 3) & (100 * _c("n_dup_lines") > 40 * _c("n_lines")), lambda: _c("word_chars") + 4 * _c("n_lines")),
)


METRICS = ("n_words", "word_chars", "n_symbols", "n_upper", "n_lines", "n_dup_lines", "n_repeat_words")


def metrics(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), wanted: tuple[str, ...] = METRICS) -> DataFrame:
    """docs -> keep columns + the metrics that are wanted."""
    text = F.coalesce(F.col("__text"), F.lit(""))
    df = docs.select(*keep, F.col("text").alias("__text")).withColumn("__text", text)
    text = F.col("__text")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(NON_SPACE))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("long")
    repeats = "n_repeat_words" in wanted
    first = {
        "word_chars": lambda: F.char_length(text).cast("long") - count(r"[\x20\x09-\x0D]"),
        "n_symbols": lambda: count(r"[#*$%&|<>]"),
        "n_upper": lambda: count(r"\p{Lu}"),
        "n_words": lambda: count(NON_SPACE + "+"),
    }
    columns = {k: f() for k, f in first.items() if k in wanted and not (repeats and k == "n_words")}
    columns |= {"__words": F.array_remove(F.split(text, SPACE), "")} if repeats else {}
    columns |= {"__lines": lines} if {"n_lines", "n_dup_lines"}.intersection(wanted) else {}
    df = df.withColumns(columns)
    second = {"n_lines": lambda: F.size("__lines").cast("long"), "n_dup_lines": lambda: (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long")}
    columns = {k: f() for k, f in second.items() if k in wanted}
    columns |= {"n_words": F.size("__words").cast("long"), "__hash": F.transform("__words", lambda w: F.xxhash64(w))} if repeats else {}
    df = (df.withColumns(columns) if columns else df).drop("__text", "__lines", "__words")
    if not repeats:
        return df.select(*keep, *wanted)
    hashes = F.col("__hash")
    n = F.col("n_words").cast("int")
    pairs = F.zip_with(F.slice(hashes, F.lit(1), n - 2), F.slice(hashes, F.lit(2), n - 2), lambda a, b: F.xxhash64(a, b))
    triples = F.zip_with(pairs, F.slice(hashes, F.lit(3), n - 2), lambda ab, c: F.xxhash64(ab, c))
    df = df.withColumn("__win", F.when(n >= 4, triples).otherwise(F.array().cast("array<bigint>"))).drop("__hash")
    same = F.size(F.array_distinct("__win")) == F.size("__win")
    # (window, position) sorted by window: a window is repeated if a neighbour equals it
    ranked = F.sort_array(F.transform(F.col("__win"), lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    df = df.withColumn("__rank", F.when(same, None).otherwise(ranked)).drop("__win")
    r, size = F.col("__rank"), F.size("__rank")
    edge = F.array(F.lit(None).cast("struct<w:bigint,i:int>"))
    before = F.concat(edge, F.slice(r, F.lit(1), size - 1))
    after = F.concat(F.slice(r, F.lit(2), size - 1), edge)
    with_before = F.zip_with(r, before, lambda x, y: F.struct(x.alias("x"), F.coalesce(x.w == y.w, F.lit(False)).alias("d")))
    marked = F.zip_with(with_before, after, lambda x, y: F.when(x.d | F.coalesce(x.x.w == y.w, F.lit(False)), x.x.i))
    starts = F.filter(marked, lambda i: i.isNotNull())
    covered = F.size(F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(i, i + 1, i + 2)))))
    df = df.withColumn("n_repeat_words", F.when(r.isNull(), 0).otherwise(covered).cast("long"))
    return df.select(*keep, *wanted)


def order_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 1000, fraction: float = 0.2, seed: int = 2) -> list[tuple[Rule, float, float]]:
    """[(rule, selectivity, cost)], best first.  The sample only orders the rules; at most sample_rows
    narrow rows reach the driver, and Spark reads only as many partitions as they need."""
    sample = metrics(docs.select("text").sample(fraction=fraction, seed=seed), keep=())
    rows = sample.select(*[x for r in rules for x in (r.reject().cast("int").alias(f"{r.name}_hit"), r.work().cast("double").alias(f"{r.name}_work"))]).limit(sample_rows).collect()
    found = []
    for r in rules:
        hit = sum(x[f"{r.name}_hit"] for x in rows) / max(1, len(rows))
        cost = max(1.0, sum(x[f"{r.name}_work"] for x in rows) / max(1, len(rows)))
        found.append((r, hit, cost))
    return sorted(found, key=lambda x: (-x[1] / x[2], x[2], x[0].name))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, keep: tuple[str, ...] = ("doc_id",), **sample) -> DataFrame:
    """docs -> keep columns, metrics, base_failed, kept, rejected_by (null if kept)."""
    ordered = [r for r, _, _ in order_rules(docs, rules, **sample)]
    first = F.lit(None).cast("string")
    for r in reversed(ordered):
        first = F.when(r.reject(), F.lit(r.name)).otherwise(first)
    base = F.lit(False)
    for r in rules:
        base = (base | r.reject()) if r.base else base
    out = metrics(docs, keep).withColumns({"base_failed": base, "rejected_by": first})
    return out.withColumn("kept", F.col("rejected_by").isNull())


def passing(docs: DataFrame, rules: tuple[Rule, ...] = RULES, **sample) -> DataFrame:
    """The documents, all columns, that no rule rejects: rule by rule, each on what is left."""
    left = docs.select(F.struct(*docs.columns).alias("__row"), "text")
    for rule, _, _ in order_rules(docs, rules, **sample):
        # Spark would move a filter below the metrics and evaluate them again inside it, many times over; it does
        # not move one past a projection with an undetermined column that the filter reads
        judged = metrics(left.withColumn("__whole", F.col("text")), ("__row", "__whole"), rule.needs).select("__row", "__whole", rule.reject().alias("__gone"), F.monotonically_increasing_id().alias("__at"))
        left = judged.where(~F.col("__gone") & (F.col("__at") >= 0)).select("__row", F.col("__whole").alias("text"))
    return left.select("__row.*")
