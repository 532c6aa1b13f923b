"""Rules, closures and classification on a few rows each; expected values are worked out by hand."""
import random

import pytest

from taxoflux.ontology import Builder, Ontology, OntologyError
from taxoflux.operators import checks, el, explain, graphs, incremental, profile, query, rl, swrl
from taxoflux.plans.fixpoint import Diverged


def rows(df):
    return {tuple(r) for r in df.collect()}


def edges(spark, pairs, names="sub string, sup string"):
    return spark.createDataFrame(pairs, names)


def test_closure_of_chain_diamond_and_cycle(spark, scratch):
    chain = [(f"c{i:02}", f"c{i + 1:02}") for i in range(20)]
    assert graphs.closure(edges(spark, chain), scratch).count() == 20 * 21 // 2
    assert rows(graphs.closure(edges(spark, [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")]), scratch)) == {("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("a", "d")}
    assert graphs.closure(edges(spark, [(0, 1), (1, 2), (2, 3), (3, 0)], "sub int, sup int"), scratch).count() == 16


def test_closure_matches_brute_force_on_random_graphs(spark, scratch):
    rng = random.Random(1)
    pairs = {(rng.randrange(12), rng.randrange(12)) for _ in range(18)}
    want = set(pairs)
    while more := {(a, d) for a, b in want for c, d in want if b == c} - want:
        want |= more
    assert rows(graphs.closure(edges(spark, sorted(pairs), "sub int, sup int"), scratch)) == want


def test_reduction_and_equivalence(spark, scratch):
    closed = graphs.closure(edges(spark, [("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "x")]), scratch)
    assert rows(graphs.reduction(closed)) == {("a", "b"), ("b", "c")}
    assert rows(graphs.mutual(closed)) == {("x", "x"), ("x", "y")}


def test_components_and_reachability(spark, scratch):
    links = edges(spark, [(1, 2), (2, 3), (9, 8)], "a int, b int")
    assert rows(graphs.components(links, scratch)) == {(1, 1), (2, 1), (3, 1), (8, 8), (9, 8)}
    seeds = spark.createDataFrame([(1,)], "seed int")
    assert rows(graphs.reachable(links.toDF("s", "o"), seeds, scratch)) == {(1, 1), (1, 2), (1, 3)}


def test_materialize_joins_all_rules(spark, scratch):
    o = (
        Builder().sub_class("Dog", "Animal").sub_property("hasPet", "owns").characteristic("ancestor", "transitive").characteristic("near", "symmetric").characteristic("mother", "functional")
        .add("domain", "owns", "Owner").add("range", "hasPet", "Animal").add("inverse", "owns", "ownedBy").equivalent("Dog", "Hound")
        .fact("ann", "hasPet", "rex").fact("a", "ancestor", "b").fact("b", "ancestor", "c").fact("x", "near", "y").fact("kid", "mother", "m1").fact("kid", "mother", "m2").type("m1", "Woman").type("fido", "Hound")
        .build(spark)
    )
    done = rl.materialize(o.relations, scratch)
    facts, types = rows(done.relations["opa"]), rows(done.relations["type"])
    assert {("ann", "owns", "rex"), ("rex", "ownedBy", "ann"), ("a", "ancestor", "c"), ("y", "near", "x")} <= facts
    assert {("ann", "Owner"), ("rex", "Animal"), ("fido", "Dog"), ("fido", "Animal")} <= types
    assert rows(done.representatives) == {("m1", "m1"), ("m2", "m1")}
    assert ("kid", "mother", "m1") in facts and ("kid", "mother", "m2") not in facts
    assert rows(rl.expand(done.relations["type"].where("cls = 'Woman'"), done.representatives, ["ind"])) == {("m1", "Woman"), ("m2", "Woman")}


def test_materialize_twice_adds_nothing(spark, scratch):
    o = Builder().sub_class("A", "B").type("i", "A").build(spark)
    first = rl.materialize(o.relations, scratch)
    again = rl.materialize(o.replace(type=first.relations["type"]).relations, scratch)
    assert sum(again.counts.values()) == 0


def test_clashes(spark, scratch):
    o = Builder().disjoint("A", "B").type("i", "A").type("i", "B").add("same", "p", "q").add("different", "p", "q").characteristic("r", "irreflexive").fact("z", "r", "z").build(spark)
    done = rl.materialize(o.relations, scratch)
    kinds = {r["kind"] for r in rl.clashes(done.relations, done.representatives, o.relations["disjoint"]).collect()}
    assert kinds == {"disjoint_classes", "same_different", "irreflexive"}


def test_el_completion(spark, scratch):
    s = lambda pairs, names: spark.createDataFrame(pairs, names)
    rel = {
        "told": s([("A", "B")], "sub string, sup string"),
        "conj": s([("B", "C", "D")], "left string, right string, sup string"),
        "some": s([("A", "r", "X"), ("X", "s", "Y"), ("U", "r", "Dead")], "cls string, p string, filler string"),
        "some_lhs": s([("t", "Y", "C"), ("q", "X", "Q")], "p string, filler string, sup string"),
        "sub_prop": s([("r", "q")], "sub string, sup string"),
        "chain": s([("r", "s", "t")], "first string, second string, sup string"),
        "disjoint": s([("M", "N")], "a string, b string"),
    }
    rel["told"] = rel["told"].union(s([("Dead", "M"), ("Dead", "N"), ("E1", "E2"), ("E2", "E1")], "sub string, sup string"))
    t = el.classify(rel, scratch)
    closed = rows(t.closure)
    # A has r.X and X has s.Y, so A has t.Y, so C; with B that is D; q is above r
    assert {("A", "B"), ("A", "C"), ("A", "D"), ("A", "Q")} <= closed
    assert rows(t.unsatisfiable) == {("Dead",), ("U",)}
    assert rows(t.equivalent) == {("E1", "E1"), ("E1", "E2")}


def test_queries(spark):
    rel = {"type": spark.createDataFrame([("o1", "Order"), ("o2", "Order"), ("c1", "Buyer")], "ind string, cls string"), "opa": spark.createDataFrame([("o1", "by", "c1"), ("o2", "by", "c2")], "s string, p string, o string")}
    assert rows(query.evaluate("Type(?x, Order), by(?x, ?y), Type(?y, Buyer)", rel)) == {("o1", "c1")}
    with pytest.raises(query.QueryError):
        query.evaluate("Type(?x, Order), Type(?y, Buyer)", rel)
    with pytest.raises(query.QueryError):
        query.parse("Type(?x)")


def test_entailment_batch_and_verdict(spark):
    facts = spark.createDataFrame([("a", "b")], "sub string, sup string")
    asked = spark.createDataFrame([("a", "b"), ("b", "a")], "sub string, sup string")
    assert rows(query.entailed(asked, facts, ["sub", "sup"])) == {("a", "b", True), ("b", "a", False)}
    none = spark.createDataFrame([], "kind string")
    assert rows(query.verdict(none)) == {(True, True, None)} and rows(query.verdict(none, False)) == {(None, False, None)}


def test_swrl_reaches_a_fixpoint_and_stops_at_caps(spark, scratch):
    opa = spark.createDataFrame([("a", "parent", "b"), ("b", "parent", "c")], "s string, p string, o string")
    rules = {"base": "parent(?x, ?y) -> anc(?x, ?y)", "step": "anc(?x, ?y) & parent(?y, ?z) -> anc(?x, ?z)"}
    done = swrl.apply_rules({"opa": opa}, rules, scratch)
    assert {("a", "anc", "c")} <= rows(done.relations["opa"]) and done.counts == {"base": 2, "step": 1}
    with pytest.raises(Diverged):
        swrl.apply_rules({"opa": opa}, rules, scratch, max_rows=1)
    with pytest.raises(swrl.RuleError):
        swrl.compile_rule("r", "parent(?x, ?y) -> anc(?x, ?z)")


def test_incremental_equals_full(spark, scratch):
    old, new = [("a", "b"), ("b", "c"), ("x", "y")], [("c", "x")]
    closed = scratch.save(graphs.closure(edges(spark, old), scratch))
    added = rows(incremental.added_closure(closed, edges(spark, new), scratch))
    full = rows(graphs.closure(edges(spark, old + new), scratch))
    assert added == full - rows(closed)
    whole = scratch.save(graphs.closure(edges(spark, old + new), scratch))
    assert rows(incremental.removed_closure(edges(spark, old + new), edges(spark, new), whole, scratch)) == rows(closed)


def test_explanations_are_shortest(spark, scratch):
    proofs = explain.shortest_proofs(edges(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("a", "c")]), scratch)
    assert explain.proof(proofs, "a", "d") == [("a", "c"), ("c", "d")]
    assert explain.proof(proofs, "d", "a") == [] and "told" in explain.render([("a", "c")])


def test_checks(spark):
    opa = spark.createDataFrame([("s", "p", "a"), ("s", "p", "b"), ("s", "p", "c")], "s string, p string, o string")
    most = spark.createDataFrame([("p", 2)], "p string, most int")
    assert rows(checks.max_cardinality(opa, most)) == {("s", "p", 3, 2)}
    apart = spark.createDataFrame([("a", "b"), ("b", "c")], "a string, b string")
    assert rows(checks.max_cardinality(opa, most, apart)) == set()  # a and c may be one
    assert rows(checks.functional_different(opa, spark.createDataFrame([("p",)], "p string"), apart)) == {("s", "p", "a", "b"), ("s", "p", "b", "c")}
    d = spark.createDataFrame([("A3", "r", "C", 3), ("A1", "r", "C", 1), ("A2", "r", "C", 2)], "cls string, p string, filler string, least int")
    assert rows(checks.cardinality_subsumption(d)) == {("A3", "A2"), ("A2", "A1")}


def test_profiles():
    some = ("ObjectSomeValuesFrom", "r", "B")
    assert profile.profiles([("SubClassOf", "A", "B"), ("ClassAssertion", "A", "i"), ("ObjectPropertyAssertion", "r", "i", "j")]) == ["EL", "QL", "RL"]
    assert profile.profiles([("SubClassOf", "A", ("ObjectIntersectionOf", "B", some))]) == ["EL", "QL"]
    assert profile.profiles([("SubClassOf", "A", ("ObjectSomeValuesFrom", "r", ("ObjectIntersectionOf", "B", "C")))]) == ["EL"]
    assert profile.profiles([("SubClassOf", ("ObjectUnionOf", "A", some), ("ObjectAllValuesFrom", ("ObjectInverseOf", "r"), "C"))]) == ["RL"]
    assert profile.violations([("SubClassOf", "A", ("ObjectUnionOf", "B", "C")), ("FunctionalObjectProperty", "r")]) == {
        "EL": ["FunctionalObjectProperty", "SubClassOf:ObjectUnionOf"], "QL": ["FunctionalObjectProperty", "SubClassOf:ObjectUnionOf"], "RL": ["SubClassOf:ObjectUnionOf"],
    }
    assert profile.route([("SubClassOf", "A", some)]).engine == "el" and profile.route([("InverseObjectProperties", "r", "s")]).engine == "rl"
    assert profile.route([("DisjointUnion", "A", "B", "C")], modules=2).engine == "hybrid" and profile.route([], rules=True).engine == "swrl"


def test_modules(spark, scratch):
    sig = spark.createDataFrame([("x1", "A"), ("x2", "A"), ("x2", "B"), ("x3", "Z")], "axiom string, entity string")
    assert rows(profile.modules(sig, scratch)) == {("x1", "x1"), ("x2", "x1"), ("x3", "x3")}


def test_ontology_edits_snapshots_and_limits(spark, tmp_path):
    o = Builder().sub_class("http://e/A", "http://e/B").data("http://e/i", "http://e/age", "7", "xsd:int").build(spark)
    back = Ontology.from_json(spark, o.to_json())
    assert rows(back.relations["sub_class"]) == {("http://e/A", "http://e/B")} and rows(back.relations["dpa"]) == {("http://e/i", "http://e/age", "7", "xsd:int")}
    edited = o.with_rows("sub_class", [("B", "C")])
    assert edited.revision == 1 and edited.without_rows("sub_class", [("B", "C")]).relations["sub_class"].count() == 1
    o.save(str(tmp_path / "o"))
    assert rows(Ontology.load(spark, str(tmp_path / "o")).super_classes("http://e/A")) == {("http://e/B",)}
    assert rows(Ontology.of_triples(spark, o.triples()).relations["dpa"]) == rows(o.relations["dpa"])
    for bad in ('{"version": 9, "entities": [], "relations": {}}', '{"version": 4, "version": 4}', '{"version": 4, "entities": [], "relations": {}, "x": 1}'):
        with pytest.raises(OntologyError):
            Ontology.from_json(spark, bad)
    with pytest.raises(OntologyError):
        Builder().sub_class("ftp://e/A", "http://e/B")
    punned = Builder().declare("class", "a").declare("data_property", "a").declare("class", "b").declare("individual", "b").build(spark)
    assert [r["iri"] for r in punned.punning_conflicts().collect()] == ["a"]
