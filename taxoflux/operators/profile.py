"""Constructs, profiles, routes and modules.

A profile is a grammar: which class expressions may stand where, and which axioms there are.  Axioms are tuples as
the functional-syntax reader gives them.
"""
from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

c = F.col
# The grammars of OWL 2 EL, QL and RL as W3C's "OWL 2 Web Ontology Language Profiles" gives them.
# Kinds of arguments: any, sub, sup and equiv are class expressions of these positions; class is a named class; thing is owl:Thing;
# role may be an inverse, prop may not; ind, literal, datatype (a data range), bit (0 or 1); * repeats the last.
_VALUES = {"ObjectHasValue": ("role", "ind"), "DataHasValue": ("prop", "literal")}
EXPRESSIONS = {
    "EL": {"any": {"ObjectIntersectionOf": ("any", "*"), "ObjectOneOf": ("ind",), "ObjectSomeValuesFrom": ("prop", "any"), "ObjectHasSelf": ("prop",), "DataSomeValuesFrom": ("prop", "datatype"), **_VALUES, "ObjectHasValue": ("prop", "ind")}},
    "QL": {
        "sub": {"ObjectSomeValuesFrom": ("role", "thing"), "DataSomeValuesFrom": ("prop", "datatype")},
        "sup": {"ObjectIntersectionOf": ("sup", "*"), "ObjectComplementOf": ("sub",), "ObjectSomeValuesFrom": ("role", "class"), "DataSomeValuesFrom": ("prop", "datatype")},
    },
    "RL": {
        "sub": {"ObjectIntersectionOf": ("sub", "*"), "ObjectUnionOf": ("sub", "*"), "ObjectOneOf": ("ind", "*"), "ObjectSomeValuesFrom": ("role", "sub|thing"), "DataSomeValuesFrom": ("prop", "datatype"), **_VALUES},
        "sup": {"ObjectIntersectionOf": ("sup", "*"), "ObjectComplementOf": ("sub",), "ObjectAllValuesFrom": ("role", "sup"), "ObjectMaxCardinality": ("bit", "role", "sub|thing"), "DataAllValuesFrom": ("prop", "datatype"), "DataMaxCardinality": ("bit", "prop", "datatype"), **_VALUES},
        "equiv": {"ObjectIntersectionOf": ("equiv", "*"), **_VALUES},
    },
}
_FACTS = {"ObjectPropertyAssertion": ("role", "ind", "ind"), "DataPropertyAssertion": ("prop", "ind", "literal"), "DifferentIndividuals": ("ind", "*")}
_MORE_FACTS = {"NegativeObjectPropertyAssertion": ("role", "ind", "ind"), "NegativeDataPropertyAssertion": ("prop", "ind", "literal"), "SameIndividual": ("ind", "*")}
_DATA = {"SubDataPropertyOf": ("prop", "prop"), "EquivalentDataProperties": ("prop", "*"), "DataPropertyRange": ("prop", "datatype"), "DatatypeDefinition": ("class", "datatype")}
_ROLES = {"SubObjectPropertyOf": ("role|chain", "role"), "EquivalentObjectProperties": ("role", "*")}
_MARKS = {f"{k}ObjectProperty": ("role",) for k in ("Symmetric", "Asymmetric", "Irreflexive")} | {"InverseObjectProperties": ("role", "role"), "DisjointObjectProperties": ("role", "*"), "DisjointDataProperties": ("prop", "*")}
AXIOMS = {
    "EL": {
        "SubClassOf": ("any", "any"), "EquivalentClasses": ("any", "*"), "DisjointClasses": ("any", "*"), "ObjectPropertyDomain": ("prop", "any"), "ObjectPropertyRange": ("prop", "any"), "DataPropertyDomain": ("prop", "any"),
        "TransitiveObjectProperty": ("prop",), "ReflexiveObjectProperty": ("prop",), "FunctionalDataProperty": ("prop",), "HasKey": ("any", "list", "*"), "ClassAssertion": ("any", "ind"), **_ROLES, **_DATA, **_FACTS, **_MORE_FACTS,
    },
    "QL": {
        "SubClassOf": ("sub", "sup"), "EquivalentClasses": ("sub", "*"), "DisjointClasses": ("sub", "*"), "ObjectPropertyDomain": ("role", "sup"), "ObjectPropertyRange": ("role", "sup"), "DataPropertyDomain": ("prop", "sup"),
        "ReflexiveObjectProperty": ("role",), "ClassAssertion": ("class", "ind"), **_ROLES, "SubObjectPropertyOf": ("role", "role"), **_MARKS, **_DATA, **_FACTS,
    },
    "RL": {
        "SubClassOf": ("sub", "sup"), "EquivalentClasses": ("equiv", "*"), "DisjointClasses": ("sub", "*"), "ObjectPropertyDomain": ("role", "sup"), "ObjectPropertyRange": ("role", "sup"), "DataPropertyDomain": ("prop", "sup"),
        "TransitiveObjectProperty": ("role",), "FunctionalObjectProperty": ("role",), "InverseFunctionalObjectProperty": ("role",), "FunctionalDataProperty": ("prop",), "HasKey": ("sub", "list", "*"), "ClassAssertion": ("sup", "ind"),
        **_ROLES, **_MARKS, **_DATA, **_FACTS, **_MORE_FACTS,
    },
}
#: Datatypes that EL and QL lack, and those that RL lacks.
NOT_EL_QL = set("xsd:float xsd:double xsd:boolean xsd:nonPositiveInteger xsd:positiveInteger xsd:negativeInteger xsd:long xsd:int xsd:short xsd:byte xsd:unsignedLong xsd:unsignedInt xsd:unsignedShort xsd:unsignedByte xsd:language".split())
DATATYPES_MISSING = {"EL": NOT_EL_QL, "QL": NOT_EL_QL, "RL": {"owl:real", "owl:rational"}}


def _misfit(x, kind: str, profile: str) -> str | None:
    """What is wrong with an argument of that kind, if anything."""
    if "|" in kind:
        found = [_misfit(x, k, profile) for k in kind.split("|")]
        return None if None in found else found[0]
    op = x[0] if isinstance(x, tuple) else None
    if kind == "thing":
        return None if x == "owl:Thing" else op or "NamedClass"
    if kind in ("class", "ind", "prop"):
        return op
    if kind == "role":
        return None if op is None or op == "ObjectInverseOf" and profile != "EL" else op
    if kind == "chain":
        return _misfits(x[1:], ("prop" if profile == "EL" else "role", "*"), profile) if op == "ObjectPropertyChain" else op or "chain"
    if kind == "list":
        return (_misfits(x[1:], ("role", "*"), profile) if len(x) > 1 else None) if op == "list" else op
    if kind == "bit":
        return None if x in (0, 1) else "Cardinality"
    if kind == "literal":
        return x[2] if op == "literal" and x[2] in DATATYPES_MISSING[profile] else None
    if kind == "datatype":
        if op is None:
            return x if x in DATATYPES_MISSING[profile] else None
        if op == "DataIntersectionOf":
            return _misfits(x[1:], ("datatype", "*"), profile)
        return None if op == "DataOneOf" and profile == "EL" and len(x) == 2 else op
    if op is None:
        return "owl:Thing" if profile == "RL" and x == "owl:Thing" else None
    if op not in (allowed := EXPRESSIONS[profile].get(kind, {})):
        return op
    return _misfits(x[1:], allowed[op], profile)


def _misfits(args, kinds, profile: str) -> str | None:
    if kinds[-1] == "*":
        kinds = (*kinds[:-1], *[kinds[-2]] * (len(args) - len(kinds) + 1))
    elif len(args) < len(kinds) and "Cardinality" not in kinds and kinds[0] == "bit":
        args = (*args, "owl:Thing")
    if len(args) != len(kinds):
        return "operands"
    return next((m for x, k in zip(args, kinds) if (m := _misfit(x, k, profile))), None)


def violations(axioms: Iterable[tuple]) -> dict[str, list[str]]:
    """By profile, what keeps the axioms out: axioms, or axiom:construct where an argument does.  Fitting profiles are left out."""
    out: dict[str, set[str]] = {}
    for axiom in axioms:
        for profile, grammar in AXIOMS.items():
            if axiom[0] not in grammar:
                out.setdefault(profile, set()).add(axiom[0])
            elif found := _misfits(axiom[1:], grammar[axiom[0]], profile):
                out.setdefault(profile, set()).add(f"{axiom[0]}:{found}")
    return {k: sorted(v) for k, v in sorted(out.items())}


def profiles(axioms: Iterable[tuple]) -> list[str]:
    """The profiles that all axioms fit."""
    bad = violations(axioms)
    return [p for p in AXIOMS if p not in bad]


#: An axiom that stands for a row of each relation.
_SOME = ("ObjectSomeValuesFrom", "p", "B")
SAMPLES = {
    "sub_class": ("SubClassOf", "A", "B"), "equiv_class": ("EquivalentClasses", "A", "B"), "disjoint": ("DisjointClasses", "A", "B"), "sub_prop": ("SubObjectPropertyOf", "p", "q"), "equiv_prop": ("EquivalentObjectProperties", "p", "q"),
    "domain": ("ObjectPropertyDomain", "p", "A"), "range": ("ObjectPropertyRange", "p", "A"), "inverse": ("InverseObjectProperties", "p", "q"), "exists_super": ("SubClassOf", "A", _SOME), "defined_by_some": ("SubClassOf", _SOME, "A"),
    "only": ("SubClassOf", "A", ("ObjectAllValuesFrom", "p", "B")), "value": ("SubClassOf", "A", ("ObjectHasValue", "p", "i")), "defined_by_value": ("SubClassOf", ("ObjectHasValue", "p", "i"), "A"),
    "conjunction": ("SubClassOf", ("ObjectIntersectionOf", "A", "B"), "C"), "chain": ("SubObjectPropertyOf", ("ObjectPropertyChain", "p", "q"), "r"), "type": ("ClassAssertion", "A", "i"), "opa": ("ObjectPropertyAssertion", "p", "i", "j"),
    "neg_opa": ("NegativeObjectPropertyAssertion", "p", "i", "j"), "dpa": ("DataPropertyAssertion", "p", "i", ("literal", "x", "xsd:string")), "neg_dpa": ("NegativeDataPropertyAssertion", "p", "i", ("literal", "x", "xsd:string")),
    "same": ("SameIndividual", "i", "j"), "different": ("DifferentIndividuals", "i", "j"), "disjoint_prop": ("DisjointObjectProperties", "p", "q"), "neg_type": ("ClassAssertion", ("ObjectComplementOf", "A"), "i"),
    "at_most": ("SubClassOf", "A", ("ObjectMaxCardinality", 1, "p", "B")), "key": ("HasKey", "A", ("list", "p"), ("list",)), "sub_data": ("SubDataPropertyOf", "p", "q"), "data_domain": ("DataPropertyDomain", "p", "A"), "data_range": ("DataPropertyRange", "p", "xsd:string"),
}


def constructs(relations: dict[str, DataFrame]) -> DataFrame:
    """(construct, n, outside_el) of the kinds of axioms in use, one count per relation."""
    out = None
    for name, rows in relations.items():
        part = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("construct"), "n")
        out = part if out is None else out.unionByName(part)
    return out.where("n > 0").withColumn("outside_el", ~c("construct").isin(list(AXIOMS["EL"])))


@dataclass(frozen=True)
class Route:
    """Which engine answers, and why."""

    engine: str
    profile: str
    violations: dict[str, list[str]]


def route(axioms: Iterable[tuple], asked: str = "auto", modules: int = 1, rules: bool = False) -> Route:
    """EL and RL have engines of their own; what fits neither goes to the tableau, module by module if there are several."""
    bad = violations(axioms)
    profile = next((p for p in ("EL", "RL", "QL") if p not in bad), "DL")
    if asked != "auto":
        return Route(asked, profile, bad)
    if rules:
        return Route("swrl", profile, bad)
    return Route({"EL": "el", "RL": "rl"}.get(profile, "hybrid" if modules > 1 else "dl"), profile, bad)


def signature(axioms: DataFrame) -> DataFrame:
    """(axiom, entities) -> (axiom, entity), each entity once."""
    return axioms.select("axiom", F.explode(F.array_distinct("entities")).alias("entity")).distinct()


def modules(signatures: DataFrame, scratch) -> DataFrame:
    """(axiom, entity) -> (axiom, module): axioms that share entities, directly or by others.  Entities tie
    their axioms to the smallest of them, so an entity of n axioms gives n links."""
    from taxoflux.operators.graphs import components

    low = signatures.groupBy("entity").agg(F.min("axiom").alias("a"))
    links = signatures.join(low, "entity").select("a", c("axiom").alias("b")).distinct()
    reps = components(links, scratch)
    return signatures.select("axiom").distinct().join(reps, c("axiom") == c("node"), "left").select("axiom", F.coalesce("rep", "axiom").alias("module"))


def partition(signatures: DataFrame, outside: DataFrame, scratch) -> DataFrame:
    """(axiom, entity) and the axioms outside EL -> (axiom, engine): a module with such an axiom is dl as a whole, all others el."""
    parts = modules(signatures, scratch)
    hard = parts.join(outside.select("axiom"), "axiom", "left_semi").select("module").distinct().withColumn("engine", F.lit("dl"))
    return parts.join(hard, "module", "left").select("axiom", F.coalesce("engine", F.lit("el")).alias("engine"))


def subontology(rows: DataFrame, signatures: DataFrame, entities: DataFrame, scratch) -> DataFrame:
    """The rows (with a column axiom) of the modules that hold any of the entities; their ids stay."""
    parts = modules(signatures, scratch)
    wanted = signatures.join(entities.select("entity"), "entity", "left_semi").join(parts, "axiom").select("module").distinct()
    return rows.join(parts.join(wanted, "module", "left_semi").select("axiom"), "axiom", "left_semi")


def merge_taxonomies(parts: list[DataFrame], scratch) -> DataFrame:
    """Closed hierarchies of modules -> the closed hierarchy of their union (closed again across modules)."""
    from taxoflux.operators.graphs import closure

    out = parts[0].select("sub", "sup")
    for p in parts[1:]:
        out = out.unionByName(p.select("sub", "sup"))
    return closure(out, scratch)
