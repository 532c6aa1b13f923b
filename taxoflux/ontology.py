"""An ontology as a set of narrow DataFrames: building, editing, looking up, and JSON snapshots."""
from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxoflux.operators.rl import SCHEMA
from taxoflux.plans.scratch import is_empty, nothing

c = F.col
# Caps on what one document may hold, and the schemes an IRI may have.
LIMITS = {"entities": 1_000_000, "axioms": 10_000_000, "iri_bytes": 8_192, "operands": 10_000, "literal_bytes": 1 << 20, "rules": 100_000}
SCHEMES = ("http", "https", "urn", "file", "internal")
KINDS = ("class", "object_property", "data_property", "individual", "datatype", "annotation_property")
#: Kinds that one IRI may have together.
PUNNING = ({"class", "individual"}, {"class", "object_property"}, {"object_property", "individual"}, {"class", "object_property", "individual"})
VERSION = 4


class OntologyError(ValueError):
    pass


def check_iri(iri: str) -> str:
    """The IRI with %23 read as #, if its scheme is allowed."""
    if len(iri.encode()) > LIMITS["iri_bytes"]:
        raise OntologyError("IRI too long")
    if (m := re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", iri)) and m[1].lower() not in SCHEMES and "/" in iri:
        raise OntologyError(f"scheme {m[1]!r} is not allowed")
    return iri.replace("%23", "#")


def ddl(relation: str) -> str:
    return ", ".join(f"{x} {'array<string>' if x == 'members' else 'string'}" for x in SCHEMA[relation])


@dataclass(frozen=True)
class Ontology:
    """Relations by name (see SCHEMA), entities(iri, kind) and a revision that every edit raises."""

    spark: SparkSession
    relations: dict[str, DataFrame]
    entities: DataFrame
    revision: int = 0

    @classmethod
    def empty(cls, spark: SparkSession) -> Ontology:
        return cls(spark, {r: nothing(spark, ddl(r)) for r in SCHEMA}, nothing(spark, "iri string, kind string"))

    @classmethod
    def of_rows(cls, spark: SparkSession, rows: dict[str, list[tuple]], entities: list[tuple[str, str]] = ()) -> Ontology:
        """From driver-side rows, as parsers of single documents give them."""
        if sum(map(len, rows.values())) > LIMITS["axioms"]:
            raise OntologyError("too many axioms")
        if len(entities) > LIMITS["entities"]:
            raise OntologyError("too many entities")
        relations = {r: spark.createDataFrame(normalized(r, rows[r]), ddl(r)) if rows.get(r) else nothing(spark, ddl(r)) for r in SCHEMA}
        return cls(spark, relations, spark.createDataFrame(sorted(set(entities)), "iri string, kind string"))

    def replace(self, **relations: DataFrame) -> Ontology:
        return Ontology(self.spark, self.relations | relations, self.entities, self.revision + 1)

    def with_rows(self, relation: str, rows: list[tuple]) -> Ontology:
        more = self.spark.createDataFrame(normalized(relation, rows), ddl(relation))
        return self.replace(**{relation: self.relations[relation].unionByName(more).distinct()})

    def without_rows(self, relation: str, rows: list[tuple]) -> Ontology:
        less = self.spark.createDataFrame(normalized(relation, rows), ddl(relation))
        return self.replace(**{relation: self.relations[relation].join(less, list(SCHEMA[relation]), "left_anti")})

    # ---- lookups: filters that reach the scan ---------------------------------------------------
    def entity(self, iri: str) -> DataFrame:
        return self.entities.where(c("iri") == iri.replace("%23", "#")).groupBy("iri").agg(F.sort_array(F.collect_set("kind")).alias("roles"))

    def super_classes(self, cls: str) -> DataFrame:
        return self.relations["sub_class"].where(c("sub") == cls).select("sup")

    def sub_classes(self, cls: str) -> DataFrame:
        return self.relations["sub_class"].where(c("sup") == cls).select("sub")

    def super_properties(self, p: str) -> DataFrame:
        return self.relations["sub_prop"].where(c("sub") == p).select("sup")

    def domains(self, p: str) -> DataFrame:
        return self.relations["domain"].where(c("p") == p).select("c")

    def ranges(self, p: str) -> DataFrame:
        return self.relations["range"].where(c("p") == p).select("c")

    def inverses(self, p: str) -> DataFrame:
        inv = self.relations["inverse"]
        return inv.where(c("p") == p).select(c("q").alias("p")).unionByName(inv.where(c("q") == p).select("p")).distinct()

    def existentials(self, cls: str) -> DataFrame:
        return self.relations["exists_super"].where(c("cls") == cls).select("p", "filler")

    def types(self, ind: str) -> DataFrame:
        return self.relations["type"].where(c("ind") == ind).select("cls")

    def members(self, cls: str) -> DataFrame:
        return self.relations["type"].where(c("cls") == cls).select("ind")

    def assertions_from(self, s: str) -> DataFrame:
        return self.relations["opa"].where(c("s") == s)

    def assertions_to(self, o: str) -> DataFrame:
        return self.relations["opa"].where(c("o") == o)

    def same_as(self, ind: str, scratch) -> DataFrame:
        from taxoflux.operators.graphs import components

        reps = components(self.relations["same"], scratch)
        return reps.join(reps.where(c("node") == ind).select("rep"), "rep").select(c("node").alias("ind"))

    def equivalents(self, cls: str) -> DataFrame:
        sets = self.relations["equiv_class"].where(F.array_contains("members", cls))
        return sets.select(F.explode("members").alias("cls")).where(c("cls") != cls).distinct()

    def _others(self, relation: str, x: str) -> DataFrame:
        rows = self.relations[relation].where((c("a") == x) | (c("b") == x))
        return rows.select(F.when(c("a") == x, c("b")).otherwise(c("a")).alias("x")).distinct()

    def disjoint_with(self, cls: str) -> DataFrame:
        return self._others("disjoint", cls)

    def different_from(self, ind: str) -> DataFrame:
        return self._others("different", ind)

    def punning_conflicts(self) -> DataFrame:
        """IRIs whose kinds may not go together."""
        sets = self.entities.groupBy("iri").agg(F.sort_array(F.collect_set("kind")).alias("roles")).where(F.size("roles") > 1)
        allowed = F.lit(False)
        for p in PUNNING:
            allowed = allowed | (c("roles") == F.array(*[F.lit(x) for x in sorted(p)]))
        return sets.where(~allowed)

    def samples(self) -> list[tuple]:
        """An axiom for each kind of axiom in use, for profile detection."""
        from taxoflux.operators.profile import SAMPLES
        from taxoflux.sources.normal import CHARACTERISTICS

        found = [SAMPLES[k] for k in SAMPLES if not is_empty(self.relations[k])]
        if not is_empty(self.relations["prop_char"]):
            kinds = {r["kind"] for r in self.relations["prop_char"].select("kind").distinct().collect()}  # at most seven
            found += [(name, "p") for name, kind in CHARACTERISTICS.items() if kind in kinds and name != "FunctionalDataProperty"]
        return found

    def axioms(self, limit: int) -> list[tuple] | None:
        """All rows as axioms of the functional syntax, or None if there are more than ``limit``; for tests on one machine."""
        out = []
        for name in SCHEMA:
            if is_empty(self.relations[name]):
                continue
            rows = self.relations[name].select(*SCHEMA[name]).limit(limit + 1 - len(out)).collect()
            if len(out) + len(rows) > limit:
                return None
            out += [axiom_of(name, tuple(r)) for r in rows]
        return out

    def told(self) -> set[str]:
        """The relations that hold rows."""
        return {k for k, v in self.relations.items() if not is_empty(v)}

    # ---- snapshots ------------------------------------------------------------------------------
    def to_json(self) -> str:
        """All asserted rows as one document.  For ontologies of document size; tables go to Parquet (save)."""
        rows = {r: sorted([list(x) for x in self.relations[r].collect()], key=str) for r in SCHEMA}
        entities = sorted([x["iri"], x["kind"]] for x in self.entities.collect())
        return json.dumps({"format": "taxoflux", "version": VERSION, "entities": entities, "relations": {k: v for k, v in rows.items() if v}}, ensure_ascii=False)

    @classmethod
    def from_json(cls, spark: SparkSession, text: str) -> Ontology:
        def once(pairs):
            keys = [k for k, _ in pairs]
            if len(set(keys)) < len(keys):
                raise OntologyError("duplicate key")
            return dict(pairs)

        data = json.loads(text, object_pairs_hook=once)
        if set(data) - {"format", "version", "entities", "relations"} or set(data.get("relations", {})) - set(SCHEMA):
            raise OntologyError("unknown field")
        if not 2 <= data.get("version", 0) <= VERSION:
            raise OntologyError("unknown version")
        return cls.of_rows(spark, {k: [tuple(x) for x in v] for k, v in data["relations"].items()}, [tuple(x) for x in data["entities"]])

    def save(self, path: str) -> None:
        for name, rows in self.relations.items():
            rows.write.mode("overwrite").parquet(f"{path}/{name}")
        self.entities.write.mode("overwrite").parquet(f"{path}/entities")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Ontology:
        return cls(spark, {r: spark.read.parquet(f"{path}/{r}") for r in SCHEMA}, spark.read.parquet(f"{path}/entities"))

    def triples(self) -> DataFrame:
        """(s, p, o, o_is_literal, datatype) of the relations that are plain triples."""
        out = None

        def add(df, s, p, o, literal=False, datatype=None):
            nonlocal out
            part = df.select(c(s).alias("s"), (p if not isinstance(p, str) else F.lit(p)).alias("p"), c(o).alias("o"), F.lit(literal).alias("o_is_literal"), (F.lit(None).cast("string") if datatype is None else c(datatype)).alias("datatype"))
            out = part if out is None else out.unionByName(part)

        r = self.relations
        add(r["sub_class"], "sub", "rdfs:subClassOf", "sup")
        add(r["sub_prop"], "sub", "rdfs:subPropertyOf", "sup")
        add(r["domain"], "p", "rdfs:domain", "c")
        add(r["range"], "p", "rdfs:range", "c")
        add(r["inverse"], "p", "owl:inverseOf", "q")
        add(r["disjoint"], "a", "owl:disjointWith", "b")
        add(r["type"], "ind", "rdf:type", "cls")
        add(r["opa"], "s", c("p"), "o")
        add(r["dpa"], "s", c("p"), "lexical", True, "datatype")
        add(r["same"], "a", "owl:sameAs", "b")
        add(r["different"], "a", "owl:differentFrom", "b")
        return out.distinct()

    @staticmethod
    def structural(triples: DataFrame) -> DataFrame:
        """The triples that of_triples does not read: restrictions, lists, chains, keys and the like.  A document
        that has any is read whole by sources.documents."""
        read = ["rdfs:subClassOf", "rdfs:subPropertyOf", "rdfs:domain", "rdfs:range", "owl:inverseOf", "owl:disjointWith", "owl:sameAs", "owl:differentFrom", "owl:equivalentClass", "owl:equivalentProperty", "owl:imports", "rdfs:label", "rdfs:comment", "rdfs:seeAlso", "rdfs:isDefinedBy", "owl:versionInfo", "rdf:type"]
        special = c("p").startswith("owl:") | c("p").startswith("rdf:") | c("p").startswith("rdfs:")
        blank = c("p").isin("rdfs:subClassOf", "owl:equivalentClass", "rdfs:domain", "rdfs:range", "owl:disjointWith") & (c("s").startswith("_:") | c("o").startswith("_:"))
        return triples.where(special & ~c("p").isin(read) | blank | c("o").isin("owl:Restriction", "owl:AllDifferent", "owl:AllDisjointClasses", "owl:AllDisjointProperties", "owl:NegativePropertyAssertion"))

    @classmethod
    def of_triples(cls, spark: SparkSession, triples: DataFrame) -> Ontology:
        """The reverse, distributed: each relation is a filter of the triples.  Triples that describe class expressions or are
        axioms of several parts have no such filter: see structural()."""
        o = cls.empty(spark)
        named = {"rdfs:subClassOf": ("sub_class", "sub", "sup"), "rdfs:subPropertyOf": ("sub_prop", "sub", "sup"), "rdfs:domain": ("domain", "p", "c"), "rdfs:range": ("range", "p", "c"), "owl:inverseOf": ("inverse", "p", "q"), "owl:disjointWith": ("disjoint", "a", "b"), "owl:sameAs": ("same", "a", "b"), "owl:differentFrom": ("different", "a", "b")}
        known = {k: triples.where(c("p") == k).select(c("s").alias(a), c("o").alias(b)).distinct() for k, (_, a, b) in named.items()}
        chars = {"owl:TransitiveProperty": "transitive", "owl:SymmetricProperty": "symmetric", "owl:AsymmetricProperty": "asymmetric", "owl:ReflexiveProperty": "reflexive", "owl:IrreflexiveProperty": "irreflexive", "owl:FunctionalProperty": "functional", "owl:InverseFunctionalProperty": "inverse_functional"}
        schema_classes = [*chars, "owl:Class", "owl:ObjectProperty", "owl:DatatypeProperty", "owl:NamedIndividual", "owl:Ontology", "rdfs:Datatype", "owl:AnnotationProperty", "owl:Restriction"]
        kinds = {"owl:Class": "class", "owl:ObjectProperty": "object_property", "owl:DatatypeProperty": "data_property", "owl:NamedIndividual": "individual", "rdfs:Datatype": "datatype", "owl:AnnotationProperty": "annotation_property"}
        typed = triples.where("p = 'rdf:type'")
        pick = lambda m: F.create_map(*[F.lit(x) for kv in m.items() for x in kv])[c("o")]
        out = {name[0]: known[k] for k, name in named.items()}
        for k, relation in (("owl:equivalentClass", "equiv_class"), ("owl:equivalentProperty", "equiv_prop")):
            out[relation] = triples.where(c("p") == k).select(F.concat_ws(" = ", "s", "o").alias("axiom_id"), F.array("s", "o").alias("members")).distinct()
        out["prop_char"] = typed.where(c("o").isin(*chars)).select(c("s").alias("p"), pick(chars).alias("kind")).distinct()
        out["type"] = typed.where(~c("o").isin(*schema_classes)).select(c("s").alias("ind"), c("o").alias("cls")).distinct()
        rest = triples.where(~c("p").isin(*named, "rdf:type") & ~c("p").startswith("rdfs:") & ~c("p").startswith("owl:") & ~c("p").startswith("rdf:"))
        out["opa"] = rest.where("not o_is_literal").select("s", "p", "o").distinct()
        out["dpa"] = rest.where("o_is_literal").select("s", "p", c("o").alias("lexical"), "datatype").distinct()
        entities = typed.where(c("o").isin(*kinds)).select(c("s").alias("iri"), pick(kinds).alias("kind")).distinct()
        return cls(spark, o.relations | out, entities, 1)


def axiom_of(relation: str, r: tuple) -> tuple:
    """A row of a relation as an axiom of the functional syntax."""
    from taxoflux.sources.normal import CHARACTERISTICS

    some = lambda p, x: ("ObjectSomeValuesFrom", p, x)
    if relation == "prop_char":
        return next((name, r[0]) for name, kind in CHARACTERISTICS.items() if kind == r[1])
    if relation in ("equiv_class", "equiv_prop"):
        return ("EquivalentClasses" if relation == "equiv_class" else "EquivalentObjectProperties", *r[1])
    if relation in ("dpa", "neg_dpa"):
        return ("DataPropertyAssertion" if relation == "dpa" else "NegativeDataPropertyAssertion", r[1], r[0], ("literal", *r[2:]))
    if relation in ("opa", "neg_opa"):
        return ("ObjectPropertyAssertion" if relation == "opa" else "NegativeObjectPropertyAssertion", r[1], r[0], r[2])
    parts = {
        "sub_class": lambda: ("SubClassOf", *r), "disjoint": lambda: ("DisjointClasses", *r), "sub_prop": lambda: ("SubObjectPropertyOf", *r), "sub_data": lambda: ("SubDataPropertyOf", *r),
        "disjoint_prop": lambda: ("DisjointObjectProperties", *r), "domain": lambda: ("ObjectPropertyDomain", *r), "range": lambda: ("ObjectPropertyRange", *r), "data_domain": lambda: ("DataPropertyDomain", *r),
        "data_range": lambda: ("DataPropertyRange", *r), "inverse": lambda: ("InverseObjectProperties", *r), "exists_super": lambda: ("SubClassOf", r[0], some(*r[1:])), "defined_by_some": lambda: ("SubClassOf", some(*r[1:]), r[0]),
        "only": lambda: ("SubClassOf", r[0], ("ObjectAllValuesFrom", *r[1:])), "value": lambda: ("SubClassOf", r[0], ("ObjectHasValue", *r[1:])), "defined_by_value": lambda: ("SubClassOf", ("ObjectHasValue", *r[1:]), r[0]),
        "at_most": lambda: ("SubClassOf", r[0], ("ObjectMaxCardinality", int(r[2]), r[1], r[3])), "key": lambda: ("HasKey", r[0], ("list", *r[1]), ("list",)), "conjunction": lambda: ("SubClassOf", ("ObjectIntersectionOf", *r[:2]), r[2]),
        "chain": lambda: ("SubObjectPropertyOf", ("ObjectPropertyChain", *r[:2]), r[2]), "type": lambda: ("ClassAssertion", r[1], r[0]), "neg_type": lambda: ("ClassAssertion", ("ObjectComplementOf", r[1]), r[0]),
        "same": lambda: ("SameIndividual", *r), "different": lambda: ("DifferentIndividuals", *r),
    }
    return parts[relation]()


def normalized(relation: str, rows: list[tuple]) -> list[tuple]:
    """Rows in canonical form: symmetric pairs ordered, operand sets sorted, repeats gone."""
    out, seen = [], set()
    for r in rows:
        if relation in ("disjoint", "same", "different", "disjoint_prop") and r[0] > r[1]:
            r = (r[1], r[0])
        if relation in ("equiv_class", "equiv_prop", "key"):
            if len(r[1]) > LIMITS["operands"]:
                raise OntologyError("too many operands")
            r = (r[0], sorted(set(r[1])))
        if relation in ("dpa", "neg_dpa") and len(r[2].encode()) > LIMITS["literal_bytes"]:
            raise OntologyError("literal too long")
        if repr(r) not in seen:
            seen.add(repr(r))
            out.append(tuple(r))
    return out


class Builder:
    """Fluent building of small ontologies: Builder().sub_class("A", "B").type("a", "A").build(spark)."""

    def __init__(self):
        self.rows: dict[str, list[tuple]] = {}
        self.entities: list[tuple[str, str]] = []
        self.sets = 0

    def declare(self, kind: str, *iris: str) -> Builder:
        if kind not in KINDS:
            raise OntologyError(f"no such kind: {kind}")
        self.entities += [(check_iri(i), kind) for i in iris]
        return self

    def add(self, relation: str, *row) -> Builder:
        if len(row) != len(SCHEMA[relation]):
            raise OntologyError(f"{relation} takes {SCHEMA[relation]}")
        self.rows.setdefault(relation, []).append(tuple(check_iri(x) if isinstance(x, str) and relation not in ("dpa", "neg_dpa") else x for x in row))
        return self

    def sub_class(self, sub: str, sup: str) -> Builder:
        return self.declare("class", sub, sup).add("sub_class", sub, sup)

    def equivalent(self, *classes: str) -> Builder:
        self.sets += 1
        return self.declare("class", *classes).add("equiv_class", f"set{self.sets}", list(classes))

    def disjoint(self, *classes: str) -> Builder:
        for i, a in enumerate(classes):
            for b in classes[i + 1 :]:
                self.add("disjoint", a, b)
        return self

    def sub_property(self, sub: str, sup: str) -> Builder:
        return self.declare("object_property", sub, sup).add("sub_prop", sub, sup)

    def characteristic(self, p: str, kind: str) -> Builder:
        return self.declare("object_property", p).add("prop_char", p, kind)

    def type(self, ind: str, cls: str) -> Builder:
        return self.declare("individual", ind).declare("class", cls).add("type", ind, cls)

    def fact(self, s: str, p: str, o: str) -> Builder:
        return self.declare("individual", s, o).declare("object_property", p).add("opa", s, p, o)

    def data(self, s: str, p: str, lexical: str, datatype: str = "xsd:string") -> Builder:
        return self.declare("individual", s).declare("data_property", p).add("dpa", s, p, lexical, datatype)

    def build(self, spark: SparkSession) -> Ontology:
        return Ontology.of_rows(spark, self.rows, self.entities)
