"""Closure, components, reduction and paths over edge tables."""
from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from taxoflux.plans.fixpoint import Diverged
from taxoflux.plans.scratch import Scratch


def closure(edges: DataFrame, scratch: Scratch, a: str = "sub", b: str = "sup", by: tuple[str, ...] = (), reflexive: bool = False, max_rounds: int = 32) -> DataFrame:
    """Transitive closure of (by..., a, b), by doubling: paths of any length up to 2**k after k rounds.

    Each round joins the newest paths with all paths, so a chain of n edges takes log2(n) rounds; cycles
    end as all else does, when a round adds nothing."""
    keys = [*by, a, b]
    edges = edges.select(*keys)
    if (few := scratch.hold(edges)) is not None:
        pairs = closed_pairs(few._held.to_pylist() if getattr(few, "_held", None) is not None else [], keys, reflexive)
        if len(pairs) <= MOST_PAIRS:
            return scratch.constant(pa.Table.from_pylist([dict(zip(keys, r)) for r in sorted(pairs, key=repr)], _arrow_schema(edges)), edges)
        edges = few
    full = scratch.save(edges.distinct())
    fresh = full
    for k in range(max_rounds):
        left = full.select(*by, F.col(a).alias(a), F.col(b).alias("__m"))
        right = fresh.select(*by, F.col(a).alias("__m"), F.col(b).alias(b))
        one = left.join(right, [*by, "__m"]).select(*keys)
        left = fresh.select(*by, F.col(a).alias(a), F.col(b).alias("__m"))
        right = full.select(*by, F.col(a).alias("__m"), F.col(b).alias(b))
        two = left.join(right, [*by, "__m"]).select(*keys)
        both = one.unionByName(two) if k else one  # at first all is new
        fresh = scratch.save(both.distinct().join(full, keys, "left_anti"))
        if fresh.isEmpty():
            break
        full = full.unionByName(fresh)
    else:
        raise Diverged(f"closure not reached in {max_rounds} doublings")
    if reflexive:
        nodes = edges.select(*by, F.col(a).alias("__n")).unionByName(edges.select(*by, F.col(b).alias("__n"))).distinct()
        full = full.unionByName(nodes.select(*by, F.col("__n").alias(a), F.col("__n").alias(b))).distinct()
    return full


#: Pairs that the closure of held edges may have and still be held.
MOST_PAIRS = 100_000


def _arrow_schema(df: DataFrame) -> pa.Schema:
    return to_arrow_schema(df.schema)


def closed_pairs(rows: list[dict], keys: list[str], reflexive: bool = False) -> set[tuple]:
    """The closure of few edges, by a search from each node; given up beyond MOST_PAIRS pairs (the result is then too large
    by one at least)."""
    after: dict[tuple, set] = {}
    for r in rows:
        *by, x, y = (r[k] for k in keys)
        if x is not None and y is not None:
            after.setdefault((*by, x), set()).add(y)
    out: set[tuple] = set()
    for start, first in after.items():
        seen, todo = set(first), list(first)
        while todo:
            for y in after.get((*start[:-1], todo.pop()), ()):
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        out.update((*start, y) for y in seen)
        if reflexive:
            out.add((*start, start[-1]))
            out.update((*start[:-1], y, y) for y in seen)
        if len(out) > MOST_PAIRS:
            break
    return out


def components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, rep): the smallest node of each connected component, by alternating large and small stars."""
    e = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    if (few := scratch.hold(e)) is not None:
        root: dict = {}

        def find(n):
            while root.setdefault(n, n) != n:
                root[n] = n = root[root[n]]
            return n

        for r in getattr(few, "_held", None).to_pylist() if getattr(few, "_held", None) is not None else []:
            x, y = find(r["u"]), find(r["v"])
            root[max(x, y)] = min(x, y)
        out = e.select(F.col("u").alias("node"), F.col("v").alias("rep"))
        return scratch.constant(pa.Table.from_pylist([{"node": n, "rep": find(n)} for n in sorted(root)], _arrow_schema(out)), out)
    e = scratch.save(e.distinct())
    state = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = scratch.save(moved.unionByName(low.withColumnRenamed("m", "v")).distinct())
        row = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == tuple(row):
            return e.select(F.col("u").alias("node"), F.col("v").alias("rep")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("rep")).distinct())
        state = tuple(row)
    raise Diverged("components did not settle")


def mutual(closed: DataFrame, a: str = "sub", b: str = "sup") -> DataFrame:
    """(rep, member) of strongly connected classes with two members or more; the smallest member is rep."""
    back = closed.select(F.col(a).alias(b), F.col(b).alias(a))
    pairs = closed.where(F.col(a) != F.col(b)).join(back, [a, b])
    reps = pairs.groupBy(F.col(a).alias("member")).agg(F.min(b).alias("m"))
    return reps.select(F.least("member", "m").alias("rep"), "member")


def reduction(closed: DataFrame, a: str = "sub", b: str = "sup") -> DataFrame:
    """Direct edges of a closed relation: strict edges without another class strictly between.  Members
    of a cycle aren't each other's parents."""
    back = closed.select(F.col(a).alias(b), F.col(b).alias(a))
    strict = closed.where(F.col(a) != F.col(b)).join(back, [a, b], "left_anti")
    middle = strict.select(F.col(a).alias(a), F.col(b).alias("__m")).join(strict.select(F.col(a).alias("__m"), F.col(b).alias(b)), "__m")
    return strict.join(middle.select(a, b).distinct(), [a, b], "left_anti")


def reachable(edges: DataFrame, seeds: DataFrame, scratch: Scratch, a: str = "s", b: str = "o", max_rounds: int = 10_000) -> DataFrame:
    """(seed, node) reached from given nodes only: one frontier step a round, for bound endpoints."""
    full = scratch.save(seeds.select(F.col("seed"), F.col("seed").alias("node")).distinct())
    fresh = full
    for _ in range(max_rounds):
        step = fresh.join(edges.select(F.col(a).alias("node"), F.col(b).alias("next")), "node").select("seed", F.col("next").alias("node"))
        fresh = scratch.save(step.distinct().join(full, ["seed", "node"], "left_anti"))
        if fresh.isEmpty():
            return full
        full = full.unionByName(fresh)
    raise Diverged("no end of paths")


def chain_step(steps: list[DataFrame], a: str = "s", b: str = "o") -> DataFrame:
    """Pairs linked by one edge of each relation in turn (a role chain)."""
    out = steps[0].select(F.col(a), F.col(b))
    for s in steps[1:]:
        out = out.select(F.col(a), F.col(b).alias("__m")).join(s.select(F.col(a).alias("__m"), F.col(b)), "__m").select(a, b).distinct()
    return out
