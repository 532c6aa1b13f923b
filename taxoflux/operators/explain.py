"""Explanations: first derivations and shortest proofs of subsumptions."""
from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxoflux.plans.fixpoint import Diverged
from taxoflux.plans.scratch import Scratch

c = F.col


def shortest_proofs(edges: DataFrame, scratch: Scratch, max_rounds: int = 1000) -> DataFrame:
    """(sub, sup, steps, via): the least number of told axioms that give sup, and the class told below it
    last.  A pair enters in the round of its shortest proof, so the proof graph has no cycle."""
    told = edges.select("sub", "sup").distinct()
    fresh = scratch.save(told.select("sub", "sup", F.lit(1).cast("long").alias("steps"), c("sub").alias("via")))
    full = fresh
    for n in range(2, max_rounds):
        step = fresh.select("sub", c("sup").alias("via")).join(told.select(c("sub").alias("via"), "sup"), "via")
        step = step.groupBy("sub", "sup").agg(F.lit(n).cast("long").alias("steps"), F.min("via").alias("via"))
        fresh = scratch.save(step.join(full, ["sub", "sup"], "left_anti"))
        if fresh.isEmpty():
            return full
        full = full.unionByName(fresh)
    raise Diverged("proofs too long")


def proof(proofs: DataFrame, sub: str, sup: str) -> list[tuple[str, str]]:
    """The told axioms of one shortest proof, from sub upwards; empty if there is none.  Reads one row a step."""
    out: list[tuple[str, str]] = []
    at = sup
    while True:
        row = proofs.where((c("sub") == sub) & (c("sup") == at)).select("via").first()
        if row is None:
            return []
        out.append((row["via"], at))
        if row["via"] == sub:
            return out[::-1]
        at = row["via"]


def render(steps: list[tuple[str, str]]) -> str:
    """Text of a proof."""
    if not steps:
        return "not entailed"
    lines = [f"{i}. SubClassOf({a} {b})  [told]" for i, (a, b) in enumerate(steps, 1)]
    return "\n".join([*lines, f"therefore SubClassOf({steps[0][0]} {steps[-1][1]})"])


def as_json(steps: list[tuple[str, str]]) -> str:
    """A proof as JSON: told axioms in order, and what follows."""
    found = {"entailed": bool(steps), "steps": [{"axiom": ["SubClassOf", a, b], "rule": "told"} for a, b in steps]}
    if steps:
        found["conclusion"] = ["SubClassOf", steps[0][0], steps[-1][1]]
    return json.dumps(found, ensure_ascii=False)
