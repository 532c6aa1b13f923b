"""OWL 2 EL classification by completion rules, and what is read off a closed hierarchy.

Axioms in normal form: told(sub, sup), conj(left, right, sup), some(cls, p, filler) for cls below an
existential, some_lhs(p, filler, sup) for an existential below sup, sub_prop, chain(first, second, sup), domain(p, c)
and disjoint(a, b).  THING and NOTHING are the ids of top and bottom.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxoflux.operators.graphs import mutual, reduction
from taxoflux.plans.fixpoint import Rule, fixpoint
from taxoflux.plans.scratch import Scratch, nothing

THING, NOTHING = "owl:Thing", "owl:Nothing"
c = F.col

RULES = [
    Rule("sub_told", "sub", ("sub", "told"), lambda s, t: s.select("x", c("y").alias("sub")).join(t, "sub").select("x", c("sup").alias("y"))),
    Rule("conjunction", "sub", ("sub", "sub", "conj"), lambda a, b, k: a.join(k, a["y"] == k["left"]).select("x", "right", "sup").join(b.select("x", c("y").alias("right")), ["x", "right"]).select("x", c("sup").alias("y"))),
    Rule("existential", "edge", ("sub", "some"), lambda s, e: s.select("x", c("y").alias("cls")).join(e, "cls").select("x", "p", c("filler").alias("y"))),
    Rule("existential_lhs", "sub", ("edge", "sub", "some_lhs"), lambda e, s, k: e.join(k, "p").join(s.select(c("x").alias("y"), c("y").alias("filler")), ["y", "filler"]).select("x", c("sup").alias("y"))),
    Rule("bottom", "sub", ("edge", "sub"), lambda e, s: e.join(s.where(c("y") == NOTHING).select(c("x").alias("y")), "y").select("x", F.lit(NOTHING).alias("y"))),
    Rule("sub_property", "edge", ("edge", "sub_prop"), lambda e, sp: e.join(sp, e["p"] == sp["sub"]).select("x", c("sup").alias("p"), "y")),
    Rule("role_chain", "edge", ("edge", "edge", "chain"), lambda a, b, k: a.select("x", c("p").alias("first"), c("y").alias("__m")).join(k, "first").join(b.select(c("x").alias("__m"), c("p").alias("second"), "y"), ["__m", "second"]).select("x", c("sup").alias("p"), "y")),
    Rule("domain", "sub", ("edge", "domain"), lambda e, d: e.join(d, "p").select("x", c("c").alias("y"))),
    Rule("disjoint", "sub", ("sub", "sub", "disjoint"), lambda a, b, k: a.join(k, a["y"] == k["a"]).select("x", c("b").alias("other")).join(b.select("x", c("y").alias("other")), ["x", "other"]).select("x", F.lit(NOTHING).alias("y"))),
]


@dataclass
class Taxonomy:
    """closure(sub, sup), direct(sub, sup), equivalent(rep, member), unsatisfiable(cls), and the trace of the completion."""

    closure: DataFrame
    direct: DataFrame
    equivalent: DataFrame
    unsatisfiable: DataFrame
    edges: DataFrame | None = None
    trace: dict[str, DataFrame] | None = None
    #: whether nothing else holds, as far as the caller knows
    complete: bool = False
    #: (cls): all classes looked at
    names: DataFrame | None = None


def extract(closed: DataFrame, unsat: DataFrame) -> Taxonomy:
    """Clusters, unsatisfiable classes and direct edges of a closed relation (sub, sup)."""
    known = closed.where((c("sup") != NOTHING) & (c("sub") != NOTHING) & (c("sub") != c("sup")) & (c("sup") != THING))
    live = known.join(unsat.select(c("cls").alias("sub")), "sub", "left_anti").join(unsat.select(c("cls").alias("sup")), "sup", "left_anti").select("sub", "sup")
    return Taxonomy(live, reduction(live), mutual(live), unsat)


def classify(rel: dict[str, DataFrame], scratch: Scratch, trace: bool = False, max_rounds: int = 64) -> Taxonomy:
    """Full completion.  Missing relations are empty."""
    spark = scratch.spark
    shapes = {"told": "sub, sup", "conj": "left, right, sup", "some": "cls, p, filler", "some_lhs": "p, filler, sup", "sub_prop": "sub, sup", "chain": "first, second, sup", "domain": "p, c", "disjoint": "a, b"}
    work = {}
    for name, columns in shapes.items():
        columns = columns.split(", ")
        given = rel.get(name)
        work[name] = given.select(*columns) if given is not None and not getattr(given, "_known_empty", False) else nothing(spark, ", ".join(f"{x} string" for x in columns))
    names = None
    for name, columns in (("told", ("sub", "sup")), ("conj", ("left", "right", "sup")), ("some", ("cls", "filler")), ("some_lhs", ("filler", "sup")), ("domain", ("c",)), ("disjoint", ("a", "b"))):
        for x in columns:
            part = work[name].select(c(x).alias("x"))
            names = part if names is None else names.unionByName(part)
    names = scratch.save(names.distinct())
    work["sub"] = names.select("x", c("x").alias("y")).unionByName(names.select("x", F.lit(THING).alias("y"))).distinct()
    work["edge"] = work["some"].select(c("cls").alias("x"), "p", c("filler").alias("y")).where("false")
    done = fixpoint(work, RULES, scratch, max_rounds, trace=trace)
    closed = scratch.save(done.relations["sub"].select(c("x").alias("sub"), c("y").alias("sup")))
    unsat = closed.where(c("sup") == NOTHING).select(c("sub").alias("cls")).where(c("cls") != NOTHING).distinct()
    out = extract(closed, unsat)
    out.edges, out.trace, out.names = done.relations["edge"], done.trace, names.select(c("x").alias("cls"))
    return out
