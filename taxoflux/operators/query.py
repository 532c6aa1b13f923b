"""Conjunctive queries, instance retrieval, entailment and consistency over materialised relations."""
from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

c = F.col
ATOM = re.compile(r"\s*([A-Za-z][^\s(]*)\s*\(\s*([^\s,()]+)\s*(?:,\s*([^\s,()]+)\s*)?\)\s*(?:,|∧|$)")
MAX_QUERY = 4096


class QueryError(ValueError):
    pass


@dataclass(frozen=True)
class Atom:
    """Type(x, C), SubClassOf(x, C) or property(x, y); ?x is a variable, all else a constant."""

    predicate: str
    left: str
    right: str | None


def parse(text: str) -> list[Atom]:
    """Atoms of ``Type(?x, Order), placedBy(?x, ?y)``."""
    if len(text) > MAX_QUERY:
        raise QueryError(f"query longer than {MAX_QUERY} characters")
    atoms, at = [], 0
    text = text.strip()
    while at < len(text):
        m = ATOM.match(text, at)
        if not m:
            raise QueryError(f"cannot read an atom at {text[at : at + 40]!r}")
        atoms.append(Atom(m[1], m[2], m[3]))
        at = m.end()
    if not atoms or any(a.right is None for a in atoms):
        raise QueryError("a query needs atoms of two arguments")
    return atoms


def atom_rows(atom: Atom, rel: dict[str, DataFrame]) -> DataFrame:
    """Bindings of one atom; columns are its variables."""
    if atom.predicate == "Type":
        rows, a, b = rel["type"], "ind", "cls"
    elif atom.predicate == "SubClassOf":
        rows, a, b = rel["sub_class"], "sub", "sup"
    elif atom.predicate in ("sameAs", "SameAs"):
        rows, a, b = rel["same"], "a", "b"
    else:
        rows, a, b = rel["opa"].where(c("p") == atom.predicate), "s", "o"
    out = []
    for column, term in ((a, atom.left), (b, atom.right)):
        if term.startswith("?"):
            out.append((column, term[1:]))
        else:
            rows = rows.where(c(column) == term)
    if len(out) == 2 and out[0][1] == out[1][1]:
        rows, out = rows.where(c(out[0][0]) == c(out[1][0])), out[:1]
    return rows.select(*[c(x).alias(y) for x, y in out]).distinct()


def evaluate(query: str | list[Atom], rel: dict[str, DataFrame], answer: list[str] | None = None) -> DataFrame:
    """Distinct bindings of a conjunctive query.  Atoms are joined along shared variables; a query that
    falls apart into unconnected parts is refused, since its answers would be a cross product."""
    atoms = parse(query) if isinstance(query, str) else list(query)
    todo = [(a, atom_rows(a, rel)) for a in atoms]
    out = todo.pop(0)[1]
    while todo:
        for i, (_, rows) in enumerate(todo):
            shared = [x for x in rows.columns if x in out.columns]
            if shared:
                out = out.join(rows, shared)
                break
            if not rows.columns:  # a ground atom: all or nothing
                out = out.join(rows.limit(1).select(F.lit(1).alias("__one")), F.lit(True), "left_semi")
                break
        else:
            raise QueryError("atoms share no variable")
        todo.pop(i)
    order = dict.fromkeys(t[1:] for a in atoms for t in (a.left, a.right) if t.startswith("?"))
    return out.select(*(answer or order)).distinct()


def instances_of(types: DataFrame, sub_class: DataFrame, cls: str) -> DataFrame:
    """Individuals of a class or one of its subclasses, given asserted types and a closed hierarchy."""
    below = sub_class.where(c("sup") == cls).select(c("sub").alias("cls")).unionByName(sub_class.sparkSession.range(1).select(F.lit(cls).alias("cls"))).distinct()
    return types.join(below, "cls", "left_semi").select("ind").distinct()


def types_of(types: DataFrame, sub_class: DataFrame) -> DataFrame:
    """(ind, cls): asserted classes and all above them."""
    up = types.join(sub_class, types["cls"] == sub_class["sub"]).select("ind", c("sup").alias("cls"))
    return types.select("ind", "cls").unionByName(up).distinct()


def rewrite_unsatisfiable(atoms: list[Atom], known: DataFrame, unsat: DataFrame) -> list[Atom]:
    """Unknown classes are errors; unsatisfiable ones become owl:Nothing."""
    wanted = [a.right for a in atoms if a.predicate in ("Type", "SubClassOf") and not a.right.startswith("?")]
    have = {r[0] for r in known.where(c("cls").isin(wanted)).select("cls").distinct().collect()} if wanted else set()
    if missing := [w for w in wanted if w not in have]:
        raise QueryError(f"unknown class {missing[0]}")
    dead = {r[0] for r in unsat.where(c("cls").isin(wanted)).collect()} if wanted else set()
    return [Atom(a.predicate, a.left, "owl:Nothing") if a.right in dead else a for a in atoms]


def entailed(checks: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """A batch of checks -> + entailed: whether each row is a fact.  One join, however many checks."""
    known = facts.select(*[c(k).alias(f"__{k}") for k in keys]).distinct().withColumn("__hit", F.lit(True))
    on = [c(k) == c(f"__{k}") for k in keys]
    return checks.join(known, on, "left").select(*checks.columns, F.coalesce("__hit", F.lit(False)).alias("entailed"))


def verdict(clashes: DataFrame, complete: bool = True) -> DataFrame:
    """(consistent, complete, reason): one row; consistent is null if nothing clashes but not all was checked."""
    found = clashes.agg(F.min("kind").alias("reason"))
    ok = F.when(c("reason").isNotNull(), False).when(F.lit(complete), True)
    return found.select(ok.alias("consistent"), F.lit(complete).alias("complete"), "reason")


def property_values(opa: DataFrame, subject: str | None = None, prop: str | None = None) -> DataFrame:
    rows = opa
    if subject is not None:
        rows = rows.where(c("s") == subject)
    if prop is not None:
        rows = rows.where(c("p") == prop)
    return rows.select("s", "p", "o").distinct()
