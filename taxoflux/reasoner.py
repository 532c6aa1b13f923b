"""The reasoner: routes an ontology to the engines that its constructs need, and answers questions.

What EL completion or RL rules derive always holds.  That nothing else does is said only where one of them decides
the constructs in use, or the tableau has looked; else an answer is unknown (None) and incomplete.
"""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxoflux.ontology import Ontology
from taxoflux.operators import el, explain, graphs, incremental, profile, query, rl, roles, swrl, tableau
from taxoflux.plans.fixpoint import Rule
from taxoflux.plans.scratch import Scratch, is_empty, nothing
from taxoflux.sources import documents, functional, normal

c = F.col
#: Relations that EL completion decides, and those that say nothing about classes as long as no class names an individual.
EL_CLASSES = {"sub_class", "equiv_class", "disjoint", "sub_prop", "equiv_prop", "domain", "range", "exists_super", "defined_by_some", "conjunction", "chain"}
FACTS = {"type", "neg_type", "opa", "neg_opa", "dpa", "neg_dpa", "same", "different", "sub_data", "data_domain", "data_range", "key"}
#: Axioms that tests on one machine may hold.
MAX_TABLEAU = 20_000


@dataclass
class Reasoner:
    """ontology; axioms that its relations don't hold in full; DL-safe rules."""

    ontology: Ontology
    rest: list[tuple] = field(default_factory=list)
    rules: list[Rule] = field(default_factory=list)
    asked: str = "auto"
    seconds: float = 10.0

    def __post_init__(self):
        self.spark = self.ontology.spark
        self.scratch = Scratch(self.spark)
        self._cache: dict[str, tuple[int, object]] = {}

    @classmethod
    def of_document(cls, spark, doc: functional.Document, **options) -> Reasoner:
        n, rules = normal.Normal(), []
        for i, axiom in enumerate(doc.axioms):
            if axiom[0] == "DLSafeRule":
                rules += swrl.rules_of_axiom(axiom, f"rule{i}", n)
            else:
                n.axiom(axiom, i)
        n.close()
        return cls(Ontology.of_rows(spark, n.rows, doc.entities), n.rest, rules, **options)

    @classmethod
    def of_text(cls, spark, text: str, lenient: bool = False, **options) -> Reasoner:
        """Any format that documents.read knows, found by how the text begins."""
        return cls.of_document(spark, documents.read_text(text, lenient=lenient), **options)

    @classmethod
    def load(cls, spark, path: str, lenient: bool = False, base: str | None = None, **options) -> Reasoner:
        """A document and what it imports from its folder."""
        return cls.of_document(spark, documents.read(path, lenient=lenient, base=base), **options)

    def _cached(self, key: str, make):
        """By revision: an edit makes earlier answers stale."""
        if self._cache.get(key, (None,))[0] != self.ontology.revision:
            self._cache[key] = (self.ontology.revision, make())
        return self._cache[key][1]

    def edit(self, ontology: Ontology) -> None:
        """From now on answers are about that ontology.  A closure of told subclasses is kept up, not made anew, where rows
        were only added to it (see told_closure)."""
        self.ontology = ontology

    # ---- profile -----------------------------------------------------------------------------------
    def _axioms(self) -> list[tuple] | None:
        """All axioms for the tableau; None if they are too many."""

        def make():
            told = self.ontology.axioms(MAX_TABLEAU)
            return None if told is None else told + self.rest

        return self._cached("axioms", make)

    def route(self) -> profile.Route:
        axioms = self._axioms()
        parts = len({m for m in modules(axioms).values()}) if axioms is not None else 1
        return profile.route(self.ontology.samples() + self.rest, self.asked, parts, bool(self.rules))

    def _told(self) -> set[str]:
        return self._cached("told", self.ontology.told)

    def _kinds(self) -> set[str]:
        """Characteristics in use."""
        if "prop_char" not in self._told():
            return set()
        return self._cached("kinds", lambda: {r[0] for r in self.ontology.relations["prop_char"].select("kind").distinct().collect()})

    def _el_decides(self) -> bool:
        """Whether completion alone gives the whole class hierarchy."""
        return not self.rest and self._told() <= EL_CLASSES | FACTS | {"prop_char"} and self._kinds() <= {"transitive"}

    def _rl_decides(self) -> bool:
        """Whether the rules alone find every clash."""
        return not self.rest and "exists_super" not in self._told()

    # ---- classification ---------------------------------------------------------------------------
    def _el_relations(self) -> dict[str, DataFrame]:
        """Axioms in normal form.  An existential over a property with ranges has its filler met with them; a transitive
        property is a chain of itself."""
        r, told = self.ontology.relations, self._told()
        up = r["sub_prop"].unionByName(rl.equivalence_edges(r["equiv_prop"]))
        out = {
            "told": r["sub_class"].unionByName(rl.equivalence_edges(r["equiv_class"])),
            "some": r["exists_super"], "some_lhs": r["defined_by_some"].select("p", "filler", c("cls").alias("sup")), "conj": r["conjunction"].select("left", "right", c("conj").alias("sup")),
            "sub_prop": graphs.closure(up, self.scratch) if told & {"sub_prop", "equiv_prop"} else up, "chain": r["chain"], "domain": r["domain"], "disjoint": r["disjoint"],
        }
        if "transitive" in self._kinds():
            chains = rl.of_kind(r["prop_char"], "transitive").select(c("p").alias("first"), c("p").alias("second"), c("p").alias("sup"))
            out["chain"] = out["chain"].unionByName(chains)
        if "range" in told:
            ranges = rl.inherit(r["range"], out["sub_prop"])
            met = out["some"].join(ranges, "p").select("cls", "p", "filler", "c", F.concat(F.lit(f"{normal.FRESH}in range of "), "p", F.lit(" "), "filler").alias("name"))
            met = self.scratch.save(met)
            plain = out["some"].join(ranges.select("p"), "p", "left_anti").select("cls", "p", "filler")
            out["some"] = plain.unionByName(met.select("cls", "p", c("name").alias("filler"))).distinct()
            out["told"] = out["told"].unionByName(met.select(c("name").alias("sub"), c("filler").alias("sup"))).unionByName(met.select(c("name").alias("sub"), c("c").alias("sup"))).distinct()
        return out

    def classify(self) -> el.Taxonomy:
        """Completion, and for the classes of modules that it can't decide the tableau, merged and closed again."""

        def make():
            taxonomy = el.classify(self._el_relations(), self.scratch)
            taxonomy.complete = self._el_decides()
            axioms = None if taxonomy.complete else self._axioms()
            if axioms:
                hard = undecided(axioms)
                k, _, left = tableau.from_axioms(axioms)
                if hard:
                    classes = self.spark.createDataFrame([(x,) for x in sorted(hard)], "cls string")
                    found = self.scratch.save(tableau.classify(self.spark, classes, k, self.seconds, bool(left)))
                    unsat = taxonomy.unsatisfiable.unionByName(found.where("status = 'unsatisfiable'").select("cls")).distinct()
                    pairs = found.where("sup is not null").select(c("cls").alias("sub"), "sup")
                    merged = el.extract(profile.merge_taxonomies([taxonomy.closure, pairs], self.scratch), self.scratch.save(unsat))
                    merged.edges, merged.trace, taxonomy = taxonomy.edges, taxonomy.trace, merged
                    taxonomy.complete = found.where("status = 'incomplete'").isEmpty()
                else:
                    taxonomy.complete = True
            return named_only(taxonomy)

        return self._cached("taxonomy", make)

    def told_closure(self) -> DataFrame:
        """(sub, sup): told subclasses, closed.  After additions only what they add is derived."""
        edges = self.ontology.relations["sub_class"].unionByName(rl.equivalence_edges(self.ontology.relations["equiv_class"])).distinct()
        old = getattr(self, "_closure", None)
        if old is not None and old[0] == self.ontology.revision:
            return old[1]
        if old is not None and old[2].join(edges, ["sub", "sup"], "left_anti").isEmpty():
            fresh = edges.join(old[2], ["sub", "sup"], "left_anti")
            closed = self.scratch.save(old[1].unionByName(incremental.added_closure(old[1], fresh, self.scratch)))
        else:
            closed = self.scratch.save(graphs.closure(edges, self.scratch))
        self._closure = (self.ontology.revision, closed, self.scratch.save(edges))
        return closed

    # ---- materialisation and consistency ------------------------------------------------------------
    def materialize(self) -> rl.Materialization:
        """The RL fixpoint with the rules; where there are existentials, with the completed class hierarchy."""

        def make():
            more = None
            if "exists_super" in self._told():
                t = el.classify(self._el_relations(), self.scratch)
                more = t.closure.unionByName(t.unsatisfiable.select(c("cls").alias("sub"), F.lit(el.NOTHING).alias("sup")))
            return rl.materialize(self.ontology.relations, self.scratch, more_rules=self.rules, closed_classes=more)

        return self._cached("materialized", make)

    def clashes(self) -> DataFrame:
        done = self.materialize()
        return rl.clashes(done.relations, done.representatives, self.ontology.relations["disjoint"])

    def consistency(self) -> tuple[bool | None, bool, str | None]:
        """(consistent, complete, reason); an unsatisfiable class alone is no inconsistency."""

        def make():
            done = self.materialize()
            found = self.clashes().agg(F.min("kind")).first()[0]
            if found:
                return False, True, found
            if self._rl_decides():
                return True, True, None
            if not self.rest and self._told() <= EL_CLASSES | {"type", "opa", "same", "different", "prop_char"} and self._kinds() <= {"transitive"}:
                return (False, True, "unsatisfiable_individual") if self._el_individuals(done) else (True, True, None)
            axioms = self._axioms()
            if axioms is None:
                return None, False, "too_large"
            k, box, left = tableau.from_axioms(axioms)
            left = [x for x in left if x != "HasKey" or not is_empty(self.ontology.relations["type"])]
            status = tableau.test(k, [], self._with_domains(box, done), self.seconds, bool(left) or bool(self.rules))
            if status == "satisfiable":
                return True, True, None
            return (False, True, "tableau") if status == "unsatisfiable" else (None, False, "incomplete")

        return self._cached("consistency", make)

    def _el_individuals(self, done: rl.Materialization) -> bool:
        """Whether completion, with individuals as classes of their own, finds one that cannot be."""
        rel = self._el_relations()
        ind = lambda x: F.concat(F.lit(f"{normal.FRESH}individual "), x)
        types, opa = done.relations["type"], done.relations["opa"]
        rel["told"] = rel["told"].unionByName(types.select(ind("ind").alias("sub"), c("cls").alias("sup"))).distinct()
        rel["some"] = rel["some"].unionByName(opa.select(ind("s").alias("cls"), "p", ind("o").alias("filler"))).distinct()
        dead = el.classify(rel, self.scratch).unsatisfiable.where(c("cls").startswith(f"{normal.FRESH}individual "))
        return not dead.isEmpty()

    def _with_domains(self, box: dict, done: rl.Materialization) -> dict:
        """Types that follow from data values, and equalities that keys give, which the tableau doesn't derive."""
        if not {"dpa", "data_domain"} <= self._told():
            return box
        rows = done.relations["dpa"].join(done.relations["data_domain"], "p").select("s", "c").distinct().limit(MAX_TABLEAU + 1).collect()
        return dict(box, types=[*box["types"], *((r["s"], tableau.concept(r["c"])) for r in rows)])

    # ---- answers ------------------------------------------------------------------------------------
    def _types(self) -> DataFrame:
        rows = self.materialize().expanded("type")
        return rows.where(~normal.is_fresh(c("cls")))

    def instances(self, cls: str) -> DataFrame:
        return self.materialize().expanded("type").where(c("cls") == cls).select("ind").distinct()

    def types(self, ind: str) -> DataFrame:
        rep = self.materialize().representative(ind)
        return self.materialize().relations["type"].where((c("ind") == rep) & ~normal.is_fresh(c("cls"))).select("cls").distinct()

    def query(self, text: str) -> DataFrame:
        done = self.materialize()
        atoms = query.rewrite_unsatisfiable(query.parse(text), self._classes(), self.classify().unsatisfiable)
        same = done.representatives.select(c("node").alias("a"), "rep").join(done.representatives.select(c("node").alias("b"), "rep"), "rep").select("a", "b")
        return query.evaluate(atoms, {"type": self._types(), "opa": done.expanded("opa"), "same": same, "sub_class": self.classify().closure})

    def _classes(self) -> DataFrame:
        """(cls): declared classes and those that axioms or facts use."""
        r = self.ontology.relations
        parts = [self.ontology.entities.where("kind = 'class'").select(c("iri").alias("cls")), self.classify().names, r["type"].select("cls")]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out.distinct()

    def property_values(self, s: str, p: str) -> DataFrame:
        done = self.materialize()
        rows = query.property_values(done.relations["opa"], done.representative(s), p)
        return rl.expand(rows.select("o"), done.representatives, ["o"])

    def classify_properties(self) -> DataFrame:
        """(sub, sup): the closed hierarchy of object properties, equivalences and mirrored edges of inverses included."""
        r = self.ontology.relations
        edges = r["sub_prop"].unionByName(rl.equivalence_edges(r["equiv_prop"]))
        return self._cached("properties", lambda: roles.taxonomy(edges, r["inverse"], self.scratch))

    def extend(self, **facts: DataFrame) -> rl.Materialization:
        """Adds facts (type, opa) to the ontology and derives only what follows from them, if nothing has been materialised that
        equalities could change; else everything is derived again."""
        done = self._cache.get("materialized", (None, None))
        current = done[1] if done[0] == self.ontology.revision else None
        self.ontology = self.ontology.replace(**{k: self.ontology.relations[k].unionByName(v.select(*rl.SCHEMA[k])).distinct() for k, v in facts.items()})
        if current is not None and (more := rl.extend(current, facts, self.scratch, self.rules)) is not None:
            self._cache["materialized"] = (self.ontology.revision, more)
        return self.materialize()

    def global_restrictions(self) -> DataFrame:
        """(p, problem): what OWL 2 DL forbids of the property hierarchy: irregular chains, and composite properties where only
        simple ones may stand."""
        r = self.ontology.relations
        up = r["sub_prop"].unionByName(rl.equivalence_edges(r["equiv_prop"])).unionByName(roles.mirrored(r["sub_prop"], r["inverse"])).distinct()
        bad = roles.irregular(up, r["chain"], self.scratch).select(c("sup").alias("p"), F.lit("irregular").alias("problem"))
        composite = roles.composite(up, r["chain"], rl.of_kind(r["prop_char"], "transitive"), self.scratch)
        return bad.unionByName(roles.need_simple(r).join(composite, "p", "left_semi").select("p", F.concat(F.lit("not simple: "), "use").alias("problem")))

    def sub_properties(self, p: str, direct: bool = False) -> DataFrame:
        """Subproperties by told edges, equivalences and mirrored edges of inverses; direct ones have none between."""
        closed = self.classify_properties()
        found = (graphs.reduction(closed) if direct else closed).where(c("sup") == p).select("sub").distinct()
        return found.where(~normal.is_fresh(c("sub")))

    def entails(self, axiom: str) -> bool | None:
        """Whether an axiom in functional syntax follows; None if unknown.  Nothing is added to the ontology."""
        op, *args = functional.parse(axiom).axioms[0]
        if op == "EquivalentClasses":
            return self._all(("SubClassOf", a, b) for a, b in zip(args, [*args[1:], args[0]]))
        if op == "DisjointClasses":
            return self._all(("SubClassOf", ("ObjectIntersectionOf", a, b), el.NOTHING) for i, a in enumerate(args) for b in args[i + 1 :])
        if op in ("ObjectPropertyDomain", "ObjectPropertyRange"):
            some, only = ("ObjectSomeValuesFrom", args[0], el.THING), ("ObjectAllValuesFrom", args[0], args[1])
            return self._entails(("SubClassOf", some, args[1]) if op.endswith("Domain") else ("SubClassOf", el.THING, only))
        return self._entails((op, *args))

    def _all(self, axioms) -> bool | None:
        found = [self._entails(a) for a in axioms]
        return False if False in found else None if None in found else True

    def _entails(self, axiom: tuple) -> bool | None:
        op, args = axiom[0], axiom[1:]
        known, decided = False, False
        if op == "SubClassOf" and all(isinstance(a, str) for a in args):
            t = self.classify()
            known = args[0] == args[1] or args[1] == el.THING or not t.closure.where((c("sub") == args[0]) & (c("sup") == args[1])).isEmpty() or not t.unsatisfiable.where(c("cls") == args[0]).isEmpty()
            decided = t.complete
        elif op == "ClassAssertion" and isinstance(args[0], str):
            known, decided = not self.instances(args[0]).where(c("ind") == args[1]).isEmpty(), self._rl_decides()
        elif op == "ObjectPropertyAssertion" and isinstance(args[0], str):
            known, decided = not self.property_values(args[1], args[0]).where(c("o") == args[2]).isEmpty(), self._rl_decides()
        elif op == "SameIndividual":
            known, decided = len({self.materialize().representative(a) for a in args}) == 1, self._rl_decides()
        elif op == "SubObjectPropertyOf" and all(isinstance(a, str) for a in args):
            known, decided = args[0] == args[1] or not self.sub_properties(args[1]).where(c("sub") == args[0]).isEmpty(), not self.rest and not self._told() & {"chain"}
        if known:
            return True
        if self.consistency()[0] is False:
            return True  # anything follows
        if decided:
            return False
        axioms = self._axioms()
        if axioms is None:
            return None
        k, box, left = tableau.from_axioms(axioms)
        box = self._with_domains(box, self.materialize())
        partial = bool(left) or bool(self.rules)
        try:
            if op == "SubClassOf":
                status = tableau.test(k, [tableau.concept(args[0]), ("not", tableau.concept(args[1]))], box, self.seconds, partial)
            elif op == "ClassAssertion":
                status = tableau.test(k, [], dict(box, types=[*box["types"], (args[1], ("not", tableau.concept(args[0])))]), self.seconds, partial)
            elif op == "ObjectPropertyAssertion":
                status = tableau.test(k, [], dict(box, types=[*box["types"], (args[1], ("all", tableau.role(args[0]), ("notone", args[2])))]), self.seconds, partial)
            elif op == "SubObjectPropertyOf" and not (isinstance(args[0], tuple) and args[0][0] == "ObjectPropertyChain"):
                x, y = f"{normal.FRESH}x", f"{normal.FRESH}y"  # linked by the one but not by the other
                apart = (x, ("all", tableau.role(args[1]), ("notone", y)))
                status = tableau.test(k, [], dict(box, facts=[*box["facts"], (x, tableau.role(args[0]), y)], types=[*box["types"], apart, (y, ("one", y))]), self.seconds, partial)
            elif op == "SameIndividual":
                status = tableau.test(k, [], dict(box, different=[*box["different"], *((args[0], b) for b in args[1:])]), self.seconds, partial) if len(args) == 2 else "incomplete"
            else:
                status = "incomplete"
        except tableau.Incomplete:
            status = "incomplete"
        return {"unsatisfiable": True, "satisfiable": False}.get(status)

    def explain(self, sub: str, sup: str, form: str = "text") -> str:
        """The told axioms of a shortest proof, as text or json."""
        edges = self.ontology.relations["sub_class"].unionByName(rl.equivalence_edges(self.ontology.relations["equiv_class"]))
        steps = explain.proof(explain.shortest_proofs(edges, self.scratch), sub, sup)
        return explain.as_json(steps) if form == "json" else explain.render(steps)


def named_only(t: el.Taxonomy) -> el.Taxonomy:
    """A taxonomy without the names that normal form made."""
    told = lambda df, *columns: df.where(" and ".join(f"not startswith({x}, '{normal.FRESH}')" for x in columns))
    closure = told(t.closure, "sub", "sup")
    out = el.Taxonomy(closure, graphs.reduction(closure), graphs.mutual(closure), told(t.unsatisfiable, "cls"), t.edges, t.trace, t.complete)
    out.names = closure.select(c("sub").alias("cls")).unionByName(closure.select(c("sup").alias("cls"))).unionByName(out.unsatisfiable).distinct() if t.names is None else told(t.names, "cls")
    return out


# ---- modules of a document: axioms that share names, directly or by others ------------------------
def entities_of(x) -> set[str]:
    """All names in an axiom but for the top and bottom class and datatypes."""
    if isinstance(x, str):
        return set() if x.startswith(("owl:", "xsd:", "rdfs:", "rdf:")) else {x}
    if not isinstance(x, tuple) or x[0] == "literal":
        return set()
    return {n for a in x[1:] for n in entities_of(a)}


def modules(axioms: list[tuple]) -> dict[str, str]:
    """Name -> the smallest name of its module.  For documents of tableau size; tables have profile.modules."""
    root: dict[str, str] = {}

    def find(n):
        while root.setdefault(n, n) != n:
            root[n] = n = root[root[n]]
        return n

    for axiom in axioms:
        names = sorted(map(find, entities_of(axiom)))
        for n in names[1:]:
            a, b = find(names[0]), find(n)
            root[max(a, b)] = min(a, b)
    return {n: find(n) for n in root}


def undecided(axioms: list[tuple]) -> set[str]:
    """Named classes of modules with an axiom outside EL.  What is said of all things concerns every module."""
    of = modules(axioms)
    hard = [a for a in axioms if "EL" in profile.violations([a]) or a[0] in ("FunctionalDataProperty", "ReflexiveObjectProperty", "HasKey") or any(x in repr(a) for x in ("ObjectOneOf", "ObjectHasValue", "ObjectHasSelf", "Data"))]
    everywhere = any(a[0] == "SubClassOf" and a[1] == el.THING and not (isinstance(a[2], tuple) and a[2][0] == "ObjectAllValuesFrom") for a in axioms)
    roots = {of[n] for a in hard for n in entities_of(a)}
    classes = {n for a in axioms for n in names_in(a)}
    return {n for n in classes if not n.startswith(normal.FRESH) and (everywhere or of[n] in roots)}


def names_in(x) -> set[str]:
    """Named classes of an axiom."""
    if x[0] in ("SubClassOf", "EquivalentClasses", "DisjointClasses", "DisjointUnion"):
        return {n for a in x[1:] for n in _names(a)}
    if x[0] in ("ObjectPropertyDomain", "ObjectPropertyRange", "DataPropertyDomain"):
        return _names(x[2])
    return _names(x[1]) if x[0] in ("ClassAssertion", "HasKey") else set()


def _names(x) -> set[str]:
    if isinstance(x, str):
        return set() if x.startswith("owl:") else {x}
    if not isinstance(x, tuple):
        return set()
    if x[0] in ("ObjectIntersectionOf", "ObjectUnionOf", "ObjectComplementOf"):
        return {n for a in x[1:] for n in _names(a)}
    if x[0] in ("ObjectSomeValuesFrom", "ObjectAllValuesFrom"):
        return _names(x[2])
    if x[0].startswith("Object") and x[0].endswith("Cardinality"):
        return _names(x[3]) if len(x) > 3 else set()
    return set()
