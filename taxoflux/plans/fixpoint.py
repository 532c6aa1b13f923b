"""Semi-naive fixpoint of Datalog rules over DataFrames.

A rule reads relations by position and returns rows of its head.  In each round it is evaluated once for every
position whose relation changed, with that position reading only the new rows; the results are
de-duplicated, stripped of known rows and written (or held, if few), so plans stay short however many rounds there are.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from taxoflux.plans.scratch import Scratch, is_empty


c = F.col


@dataclass(frozen=True)
class Rule:
    """name, head relation, input relations, and the body: one DataFrame per input -> rows of the head.  A rule that names
    individuals lists them in ``constants``; ``renamed`` gives it with other names for them."""

    name: str
    head: str
    inputs: tuple[str, ...]
    body: Callable[..., DataFrame]
    constants: tuple[str, ...] = ()
    renamed: Callable[[dict], Rule] | None = None


@dataclass
class Result:
    relations: dict[str, DataFrame]
    #: relation -> its rows with columns rule and round (round 0: given)
    trace: dict[str, DataFrame]
    rounds: int
    counts: dict[str, int]


class Diverged(RuntimeError):
    """More rounds or rows than allowed."""


def fixpoint(relations: dict[str, DataFrame], rules: list[Rule], scratch: Scratch, max_rounds: int = 64, max_rows: int | None = None, trace: bool = False, delta: dict[str, DataFrame] | None = None) -> Result:
    """Least fixpoint of the rules.  With ``delta``, relations hold a closed set and delta the rows to add:
    only consequences of delta are derived (incremental maintenance for additions)."""
    heads = {r.head for r in rules}
    used = {n for r in rules for n in r.inputs} | heads
    full = dict(relations)
    for name in used:
        if (held := scratch.hold(relations[name])) is not None:
            full[name] = held
    # a rule over an empty relation that nothing derives can't fire: its joins need no plan
    fixed = {n for r in rules for n in r.inputs} - heads - set(delta or ())
    empty = {n for n in sorted(fixed) if is_empty(full[n])}
    every = [r.name for r in rules]
    rules = [r for r in rules if empty.isdisjoint(r.inputs)]
    fresh = {}
    for name in relations:
        if delta is None:
            start = full[name]
            if name in heads and not is_held(start):
                start = full[name] = scratch.save(start.distinct())
        else:
            if (start := delta.get(name)) is None:
                continue
            start = start.select(*full[name].columns).distinct().join(full[name], full[name].columns, "left_anti")
            start = scratch.hold(start) or scratch.save(start)
            full[name] = full[name].unionByName(start)
        if not getattr(start, "_known_empty", False):
            fresh[name] = start
    traced = {h: [full[h].withColumns({"rule": F.lit(None).cast("string"), "round": F.lit(0)})] for h in heads} if trace else {}
    counts: dict[str, int] = {name: 0 for name in every}
    rounds, total = 0, 0
    while fresh and rounds < max_rounds:
        rounds += 1
        found: dict[str, list[DataFrame]] = {}
        small: dict[str, bool] = {}
        for rule in rules:
            # in the first round all is fresh, so one position says it all; later, a rule over a relation without rows says nothing
            if any(getattr(full[n], "_known_empty", False) for n in rule.inputs):
                continue
            for i, name in enumerate(rule.inputs):
                if name in fresh and not (rounds == 1 and delta is None and i):
                    args = [fresh[n] if j == i else full[n] for j, n in enumerate(rule.inputs)]
                    found.setdefault(rule.head, []).append(rule.body(*args).select(*full[rule.head].columns).withColumn("rule", F.lit(rule.name)))
                    small[rule.head] = small.get(rule.head, is_held(full[rule.head])) and all(map(is_held, args))
        fresh = {}
        for head, parts in found.items():
            columns = full[head].columns
            rows = parts[0]
            for p in parts[1:]:
                rows = rows.unionByName(p)
            if is_held(full[head]):
                rows = rows.groupBy(*columns).agg(F.min("rule").alias("rule")).join(full[head], columns, "left_anti")
            else:  # one shuffle and no sort tell repeated and known rows from new ones
                known = full[head].select(*columns, F.lit(None).cast("string").alias("rule"), F.lit(1).alias("__old"))
                rows = rows.withColumn("__old", F.lit(0)).unionByName(known).groupBy(*columns).agg(F.min("rule").alias("rule"), F.max("__old").alias("__old")).where("__old = 0").drop("__old")
            held = scratch.hold(rows, MOST_NEW) if small[head] else None
            if held is not None:
                new = Counter(held._held["rule"].to_pylist())
                rows = held
            else:
                seen = Observation()
                rows = scratch.save(rows.observe(seen, *[F.count(F.when(c("rule") == r, 1)).alias(r) for r in every]))
                new = {k: n for k, n in seen.get.items() if n}
            if not new:
                scratch.drop(rows)
                continue
            for k, n in new.items():
                counts[k] += n
                total += n
            if trace:
                traced[head].append(rows.withColumn("round", F.lit(rounds)))
            fresh[head] = scratch.constant(rows._held.drop_columns(["rule"]), rows.drop("rule")) if held is not None else rows.drop("rule")
        if max_rows is not None and total > max_rows:
            raise Diverged(f"{total} rows derived, more than {max_rows}")
        for head, rows in fresh.items():
            if is_held(full[head]) and is_held(rows) and len(held_rows(full[head])) + len(held_rows(rows)) <= MOST_NEW:
                full[head] = scratch.constant(pa.concat_tables([held_rows(full[head]).cast(held_rows(rows).schema), held_rows(rows)]) if len(held_rows(full[head])) else held_rows(rows), full[head])
            else:
                full[head] = full[head].unionByName(rows)
    if fresh:
        raise Diverged(f"no fixpoint after {max_rounds} rounds")
    out = {}
    for head, parts in traced.items():
        out[head] = parts[0]
        for p in parts[1:]:
            out[head] = out[head].unionByName(p)
    return Result(full, out, rounds, counts)


#: Rows that a round over held relations may give and still be held.
MOST_NEW = 50_000


def is_held(df: DataFrame) -> bool:
    return getattr(df, "_held", None) is not None or getattr(df, "_known_empty", False)


def held_rows(df: DataFrame) -> pa.Table | tuple:
    found = getattr(df, "_held", None)
    return () if found is None else found
