"""Documents, datatypes, the tableau, the reasoner and streams."""
import json
import math

import pytest
from pyspark.sql import functions as F

from taxoflux.__main__ import main
from taxoflux.functions import datatypes as dt
from taxoflux.ontology import Ontology, OntologyError
from taxoflux.operators import tableau
from taxoflux.reasoner import Reasoner
from taxoflux.sources import documents, functional, rdf
from taxoflux.streaming import abox

TEXT = """Prefix(:=<http://e/>) Ontology(<http://e/o>
Declaration(Class(:A)) SubClassOf(:A :B) SubClassOf(:B ObjectSomeValuesFrom(:r :C)) # a note
EquivalentClasses(:U ObjectUnionOf(:A :D)) DisjointClasses(:C :E) SubClassOf(ObjectSomeValuesFrom(:r :C) :H)
SubClassOf(:X ObjectAllValuesFrom(:r :E)) SubClassOf(:X ObjectSomeValuesFrom(:r :C))
ClassAssertion(:A :i) ObjectPropertyAssertion(:r :i :j) DataPropertyAssertion(:age :i "7"^^xsd:int) SubObjectPropertyOf(:r :s) FunctionalObjectProperty(:f))"""


def test_functional_syntax():
    rows, rest = functional.relations(functional.parse(TEXT))
    assert ("http://e/A", "http://e/B") in rows["sub_class"] and ("http://e/B", "http://e/r", "http://e/C") in rows["exists_super"]
    assert ("http://e/i", "http://e/age", "7", "xsd:int") in rows["dpa"] and [a[0] for a in rest] == ["EquivalentClasses"]
    with pytest.raises(OntologyError):
        functional.parse("SubClassOf(:A :B)")
    assert functional.parse("Prefix(:=<http://e/>) SubClassOf(:A :B) SubClassOf(x:A :B)", lenient=True).skipped


def test_reasoner_end_to_end(spark):
    r = Reasoner.of_text(spark, TEXT)
    e = "http://e/"
    assert r.entails(f"SubClassOf(<{e}A> <{e}H>)") is True  # by completion
    assert r.entails(f"SubClassOf(<{e}A> <{e}U>)") is True  # by tableau
    assert r.entails(f"SubClassOf(<{e}U> <{e}A>)") is False
    assert e + "X" in {x[0] for x in r.classify().unsatisfiable.collect()}
    assert r.consistency() == (True, True, None)
    assert {x[0] for x in r.instances(e + "B").collect()} == {e + "i"}
    assert {x[0] for x in r.property_values(e + "i", e + "s").collect()} == {e + "j"}
    assert "told" in r.explain(e + "A", e + "B") and r.route().engine in ("dl", "hybrid")


def sat(axioms, concept, **box):
    k, _, _ = tableau.from_axioms(axioms)
    return tableau.test(k, [tableau.concept(concept)], box or None)


def test_tableau():
    some, only, most, least = "ObjectSomeValuesFrom", "ObjectAllValuesFrom", "ObjectMaxCardinality", "ObjectMinCardinality"
    both, not_ = "ObjectIntersectionOf", "ObjectComplementOf"
    assert sat([], (both, "A", (not_, "A"))) == "unsatisfiable"
    assert sat([], (both, (some, "r", "A"), (only, "r", (not_, "A")))) == "unsatisfiable"
    assert sat([], ("ObjectUnionOf", (both, "A", (not_, "A")), "B")) == "satisfiable"
    assert sat([("SubClassOf", "A", (some, "r", "A"))], "A") == "satisfiable"  # needs blocking
    assert sat([("SubObjectPropertyOf", "r", "s")], (both, (some, "r", "A"), (only, "s", (not_, "A")))) == "unsatisfiable"
    assert sat([("TransitiveObjectProperty", "r")], (both, (some, "r", (some, "r", "A")), (only, "r", (not_, "A")))) == "unsatisfiable"
    assert sat([], (both, "A", (some, "r", (only, ("ObjectInverseOf", "r"), (not_, "A"))))) == "unsatisfiable"
    assert sat([], (both, (least, 3, "r", "A"), (most, 2, "r"))) == "unsatisfiable"
    assert sat([], (both, (some, "r", "A"), (some, "r", "B"), (most, 1, "r"))) == "satisfiable"
    assert sat([("DisjointClasses", "A", "B")], (both, (some, "r", "A"), (some, "r", "B"), (most, 1, "r"))) == "unsatisfiable"
    assert sat([("FunctionalObjectProperty", "f"), ("InverseObjectProperties", "f", "g")], (both, (some, "f", "A"), (some, "f", (not_, "A")))) == "unsatisfiable"
    one = ("ObjectOneOf", "a")
    assert sat([("SubClassOf", "A", one), ("SubClassOf", "B", one), ("DisjointClasses", "A", "B")], (both, (some, "r", "A"), (some, "r", "B"))) == "unsatisfiable"
    assert sat([("SubClassOf", "A", one), ("SubClassOf", "B", one)], (both, (some, "r", "A"), (some, "r", "B"))) == "satisfiable"
    assert sat([("IrreflexiveObjectProperty", "r")], (both, "A", ("ObjectHasSelf", "r"))) == "unsatisfiable"
    assert sat([("SubObjectPropertyOf", ("ObjectPropertyChain", "r", "s"), "t")], (both, (some, "r", (some, "s", "A")), (only, "t", (not_, "A")))) == "unsatisfiable"
    assert sat([("DisjointObjectProperties", "r", "s"), ("SubObjectPropertyOf", "t", "r"), ("SubObjectPropertyOf", "t", "s")], (some, "t", "A")) == "unsatisfiable"
    for left_out in (("SubClassOf", "A", ("DataSomeValuesFrom", "p", "xsd:int")), ("HasKey", "A", ("list", "r"), ("list",)), ("SubObjectPropertyOf", ("ObjectPropertyChain", "t", "s"), "t")):
        k, _, left = tableau.from_axioms([left_out])
        assert tableau.test(k, [("name", "A")], partial=bool(left)) == "incomplete"


def test_tableau_over_an_abox_and_in_parallel(spark):
    k, box, _ = tableau.from_axioms([("FunctionalObjectProperty", "f"), ("ObjectPropertyAssertion", "f", "i", "a"), ("ObjectPropertyAssertion", "f", "i", "b"), ("DifferentIndividuals", "a", "b")])
    assert tableau.test(k, [], box) == "unsatisfiable" and tableau.test(k, [], dict(box, different=[])) == "satisfiable"
    k, _, _ = tableau.from_axioms([("SubClassOf", "A", ("ObjectUnionOf", "B", "C")), ("SubClassOf", "B", "D"), ("SubClassOf", "C", "D")])
    found = tableau.classify(spark, spark.createDataFrame([("A",), ("B",)], "cls string"), k)
    assert {(r["cls"], r["sup"]) for r in found.collect()} == {("A", "D"), ("B", "D")}
    parts = spark.createDataFrame([("c1", "fact", "i", "f", "a"), ("c1", "type", "i", "", "A"), ("c2", "type", "z", "", "D")], "component string, kind string, s string, p string, o string")
    assert {tuple(r) for r in tableau.consistent_components(spark, parts, k).collect()} == {("c1", "satisfiable"), ("c2", "satisfiable")}


def test_datatypes(spark):
    cases = [("byte", "127", True), ("byte", "128", False), ("integer", "-5", True), ("positiveInteger", "0", False), ("unsignedLong", "18446744073709551615", True), ("decimal", "1.50", True), ("decimal", "1e3", False), ("double", "1e3", True), ("double", "INF", True), ("boolean", "yes", False), ("dateTime", "2024-02-30T00:00:00", False), ("dateTime", "2024-02-29T00:00:00Z", True), ("hexBinary", "0aF", False), ("base64Binary", "YQ==", True), ("rational", "1/3", True)]
    for kind in sorted({k for k, _, _ in cases}):
        own = [(v, w) for k, v, w in cases if k == kind]
        got = {r["v"]: r["ok"] for r in spark.createDataFrame(own, "v string, w boolean").select("v", dt.in_value_space(F.col("v"), kind).alias("ok")).collect()}
        assert got == dict(own), kind
    assert dt.subsumed("byte", "decimal") and not dt.subsumed("string", "token")
    r = dt.Range(datatype="integer", facets=(("minInclusive", "3"), ("maxExclusive", "6")))
    assert dt.interval(r).count() == 3 and dt.satisfiable(r, 3) and not dt.satisfiable(r, 4)
    assert dt.interval(r & ~dt.Range("one_of", values=("4",))).count() == 2
    assert dt.interval(dt.Range(datatype="decimal", facets=(("minInclusive", "3"),))).count() == math.inf
    vals = spark.createDataFrame([("3",), ("5.0",), ("6",), ("x",)], "v string")
    assert {x["v"] for x in vals.where(dt.matches(F.col("v"), dt.Range(datatype="decimal", facets=(("minExclusive", "3"),)))).collect()} == {"5.0", "6"}
    eq = spark.createDataFrame([("1", "integer", "1.0", "decimal"), ("1", "integer", "1", "string"), ("true", "boolean", "1", "boolean")], "a string, x string, b string, y string")
    assert [r[0] for r in eq.select(dt.equal(F.col("a"), F.col("x"), F.col("b"), F.col("y"))).collect()] == [True, False, True]


def test_rdf_sources(spark, tmp_path):
    turtle = '@prefix e: <http://e/> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . e:A rdfs:subClassOf e:B , e:C ; a e:K . e:i e:age 7 ; e:name "x\\"y"@en ; e:l ( e:A ) .'
    got = set(rdf.parse_turtle(turtle))
    assert ("http://e/A", "rdfs:subClassOf", "http://e/C", False, None) in got and ("http://e/i", "http://e/age", "7", True, "xsd:integer") in got and ("http://e/i", "http://e/name", 'x"y', True, "rdf:langString") in got
    xml = '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:e="http://e/" xmlns:owl="http://www.w3.org/2002/07/owl#"><owl:Class rdf:about="http://e/A"/><e:A rdf:about="http://e/i"><e:r rdf:resource="http://e/j"/><e:age rdf:datatype="http://www.w3.org/2001/XMLSchema#int">7</e:age></e:A></rdf:RDF>'
    (tmp_path / "d.rdf").write_text(xml)
    o = Ontology.of_triples(spark, rdf.read_document(spark, str(tmp_path / "d.rdf"), base=str(tmp_path)))
    assert {tuple(r) for r in o.relations["type"].collect()} == {("http://e/i", "http://e/A")} and {tuple(r) for r in o.relations["opa"].collect()} == {("http://e/i", "http://e/r", "http://e/j")}
    with pytest.raises(OntologyError):
        rdf.read_document(spark, "/etc/hostname", base=str(tmp_path))
    (tmp_path / "d.nt").write_text('<http://e/a> <http://e/p> "v"^^<http://www.w3.org/2001/XMLSchema#int> .\n<http://e/a> <http://e/q> _:b .\nnonsense\n')
    with pytest.raises(Exception, match="no triple"):
        rdf.read_ntriples(spark, str(tmp_path / "d.nt")).collect()
    assert [r[0] for r in rdf.malformed(spark, str(tmp_path / "d.nt")).collect()] == ["nonsense"]
    assert {tuple(r) for r in rdf.read_ntriples(spark, str(tmp_path / "d.nt"), lenient=True).collect()} == {("http://e/a", "http://e/p", "v", True, "xsd:int"), ("http://e/a", "http://e/q", "_:b", False, None)}
    assert [rdf.detect(x) for x in ("<?xml version='1'?><rdf:RDF>", "Prefix(:=<x>)", "@prefix e: <x> .", "<a> <b> <c> .")] == ["rdfxml", "functional", "turtle", "ntriples"]


def test_many_files_are_parsed_where_they_are_read(spark, tmp_path):
    (tmp_path / "a.ofn").write_text("Prefix(:=<http://e/>) SubClassOf(:A :B)")
    (tmp_path / "b.ofn").write_text("SubClassOf(")
    got = functional.load_files(spark, str(tmp_path / "*.ofn")).collect()
    assert sorted((r["axiom"] is None, r["error"] is None) for r in got) == [(False, True), (True, False)]


def test_stream_equals_batch(spark, tmp_path, scratch):
    rows = spark.createDataFrame([("e1", "View", "2024-01-01 00:10:00"), ("e2", "Buy", "2024-01-01 02:00:00")], "ind string, cls string, ts string").withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    hierarchy = spark.createDataFrame([("View", "Event"), ("Buy", "Event")], "sub string, sup string")
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    got = abox.run_to_end(abox.infer_types(stream.select("ind", "cls"), hierarchy), str(tmp_path / "out"))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in abox.infer_types(rows.select("ind", "cls"), hierarchy).collect()}
    counted = abox.run_to_end(abox.windowed_counts(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))), str(tmp_path / "out2"))
    assert counted.count() == 1 and counted.first()["n"] == 1  # the watermark has passed the end of the first hour only


def test_late_rows_are_dropped(spark, tmp_path):
    """A row of a window that the watermark has closed comes in a later file and is left out; one within the delay counts."""
    source = tmp_path / "in"
    schema = "ind string, cls string, ts timestamp"
    put = lambda rows: spark.createDataFrame(rows, "ind string, cls string, ts string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(str(source))
    put([("a", "View", "2024-01-01 00:10:00"), ("b", "View", "2024-01-01 01:05:00")])
    run = lambda: abox.run_to_end(abox.windowed_counts(spark.readStream.schema(schema).parquet(str(source))), str(tmp_path / "out"))
    run()  # the watermark stands at 00:55
    put([("c", "View", "2024-01-01 00:58:00"), ("d", "View", "2024-01-01 03:30:00")])
    run()  # c still counts; now it stands at 03:20
    put([("e", "View", "2024-01-01 00:20:00"), ("f", "View", "2024-01-01 05:00:00")])
    got = {(r["start"].hour, r["n"]) for r in run().collect()}
    assert got == {(0, 2), (1, 1), (3, 1)}


PREFIX = "Prefix(:=<urn:>) Prefix(xsd:=<http://www.w3.org/2001/XMLSchema#>) Ontology("


def reasoner(spark, axioms, **options):
    return Reasoner.of_text(spark, PREFIX + axioms + ")", seconds=30, **options)


@pytest.mark.parametrize("axioms, consistent", [
    ("SubClassOf(:X ObjectAllValuesFrom(:r :E)) SubClassOf(:X ObjectSomeValuesFrom(:r :C)) DisjointClasses(:C :E) ClassAssertion(:X :i)", False),
    ("SubClassOf(:X ObjectAllValuesFrom(:r :E)) SubClassOf(:X ObjectSomeValuesFrom(:r :C)) DisjointClasses(:C :E)", True),
    ('DataPropertyAssertion(:p :i "1"^^xsd:int) NegativeDataPropertyAssertion(:p :i "01"^^xsd:integer)', False),
    ('FunctionalDataProperty(:p) DataPropertyAssertion(:p :i "1"^^xsd:int) DataPropertyAssertion(:p :i "2"^^xsd:int)', False),
    ('FunctionalDataProperty(:p) DataPropertyAssertion(:p :i "1"^^xsd:int) DataPropertyAssertion(:p :i "1.0"^^xsd:decimal)', True),
    ("DisjointObjectProperties(:p :q) ObjectPropertyAssertion(:p :a :b) ObjectPropertyAssertion(:q :a :b)", False),
    ("ClassAssertion(ObjectComplementOf(:A) :i) SubClassOf(:B :A) ClassAssertion(:B :i)", False),
    ("SubClassOf(:A ObjectMaxCardinality(0 :r)) ClassAssertion(:A :i) ObjectPropertyAssertion(:r :i :j)", False),
    ("SubClassOf(:A ObjectMaxCardinality(2 :r)) ClassAssertion(:A :i) ObjectPropertyAssertion(:r :i :a) ObjectPropertyAssertion(:r :i :b) ObjectPropertyAssertion(:r :i :c) DifferentIndividuals(:a :b :c)", False),
    ("SubClassOf(:A ObjectMaxCardinality(2 :r)) ClassAssertion(:A :i) ObjectPropertyAssertion(:r :i :a) ObjectPropertyAssertion(:r :i :b) ObjectPropertyAssertion(:r :i :c)", True),
    ("FunctionalObjectProperty(:f) ObjectPropertyAssertion(:f :i :a) ObjectPropertyAssertion(:f :i :b) DifferentIndividuals(:a :b)", False),
    ("SubClassOf(:A owl:Nothing) ClassAssertion(:A :i)", False),
    ("SubClassOf(:A ObjectSomeValuesFrom(:r :B)) ObjectPropertyRange(:r :C) DisjointClasses(:B :C) ClassAssertion(:A :i)", False),
    ("SubClassOf(:A ObjectSomeValuesFrom(:r :B)) ObjectPropertyDomain(:r :D) DisjointClasses(:A :D) SubClassOf(:Z :A) ClassAssertion(:Z :i)", False),
    ("HasKey(:P (:id) ()) ClassAssertion(:P :a) ClassAssertion(:P :b) ObjectPropertyAssertion(:id :a :x) ObjectPropertyAssertion(:id :b :x) DifferentIndividuals(:a :b)", False),
    ('DataPropertyRange(:p xsd:positiveInteger) DataPropertyAssertion(:p :i "-1"^^xsd:int)', False),
    ('DataPropertyAssertion(:p :i "x"^^xsd:int)', False),
    ("EquivalentClasses(:A ObjectUnionOf(:B :C)) ClassAssertion(:A :i) ClassAssertion(ObjectComplementOf(:B) :i) ClassAssertion(ObjectComplementOf(:C) :i)", False),
])
def test_consistency_says_what_it_knows(spark, axioms, consistent):
    assert reasoner(spark, axioms).consistency()[:2] == (consistent, True)


def test_an_undecided_answer_is_no_answer(spark):
    r = reasoner(spark, "SubClassOf(:A DataSomeValuesFrom(:p xsd:int)) ClassAssertion(:A :i)")
    assert r.consistency() == (None, False, "incomplete") and not r.classify().complete
    assert r.entails("SubClassOf(<urn:A> <urn:B>)") is None


def test_answers_go_over_equal_individuals(spark):
    r = reasoner(spark, "SameIndividual(:a :b) ClassAssertion(:A :a) SubObjectPropertyOf(ObjectPropertyChain(:p :q) :t) ObjectPropertyAssertion(:p :b :x) ObjectPropertyAssertion(:q :x :y)")
    one = lambda df: {x[0] for x in df.collect()}
    assert one(r.instances("urn:A")) == {"urn:a", "urn:b"} and one(r.types("urn:b")) == {"urn:A"}
    assert one(r.property_values("urn:a", "urn:t")) == {"urn:y"} and r.entails("ObjectPropertyAssertion(<urn:t> <urn:a> <urn:y>)") is True
    assert {tuple(x) for x in r.query("Type(?x, urn:A), urn:t(?x, ?y)").collect()} == {("urn:a", "urn:y"), ("urn:b", "urn:y")}


def test_rules_in_documents(spark):
    r = reasoner(spark, """SubClassOf(:Dog :Animal) ClassAssertion(:Dog :rex) SameIndividual(:ann :anna) ObjectPropertyAssertion(:owns :anna :rex) DataPropertyAssertion(:age :anna "20"^^xsd:int)
        DLSafeRule(Body(ClassAtom(:Animal Variable(:y)) ObjectPropertyAtom(:owns Variable(:x) Variable(:y)) DataPropertyAtom(:age Variable(:x) Variable(:n)) BuiltInAtom(<http://www.w3.org/2003/11/swrlb#greaterThan> Variable(:n) "17"^^xsd:int)) Head(ClassAtom(:Owner Variable(:x))))""")
    assert {x[0] for x in r.instances("urn:Owner").collect()} == {"urn:ann", "urn:anna"} and r.route().engine == "swrl"


def test_rules_over_equality(spark):
    """Constants of a rule stand for their cluster; sameAs in a body holds within it, in a head it makes one."""
    r = reasoner(spark, """SameIndividual(:a :b) ObjectPropertyAssertion(:p :a :x) ObjectPropertyAssertion(:q :c :y) ClassAssertion(:K :d) DifferentIndividuals(:c :d)
        DLSafeRule(Body(ObjectPropertyAtom(:p :b Variable(:v))) Head(ClassAtom(:FromB Variable(:v))))
        DLSafeRule(Body(ObjectPropertyAtom(:q Variable(:u) Variable(:v))) Head(SameIndividualAtom(Variable(:v) :x)))
        DLSafeRule(Body(ClassAtom(:FromB Variable(:u)) SameIndividualAtom(Variable(:u) Variable(:v))) Head(ClassAtom(:Same Variable(:v))))
        DLSafeRule(Body(ClassAtom(:K Variable(:u)) DifferentIndividualsAtom(Variable(:u) Variable(:v))) Head(ClassAtom(:Other Variable(:v))))""")
    one = lambda cls: {x[0] for x in r.instances(f"urn:{cls}").collect()}
    assert one("FromB") == {"urn:x", "urn:y"} == one("Same") and one("Other") == {"urn:c"}


def test_property_hierarchy(spark):
    r = reasoner(spark, "SubObjectPropertyOf(:r :s) InverseObjectProperties(:r :ri) InverseObjectProperties(:s :si) TransitiveObjectProperty(:s) FunctionalObjectProperty(:s) SubObjectPropertyOf(ObjectPropertyChain(:s :r :r) :s)")
    assert ("urn:ri", "urn:si") in {tuple(x) for x in r.classify_properties().collect()}
    assert {tuple(x) for x in r.global_restrictions().collect()} == {("urn:s", "not simple: functional")}


def test_extending_a_materialisation(spark):
    r = reasoner(spark, "SubClassOf(:A :B) TransitiveObjectProperty(:t) ObjectPropertyAssertion(:t :x :y) ClassAssertion(:A :x) FunctionalObjectProperty(:f)")
    r.materialize()
    facts = lambda rows: spark.createDataFrame(rows, "s string, p string, o string")
    done = r.extend(opa=facts([("urn:y", "urn:t", "urn:z")]))
    assert ("urn:x", "urn:t", "urn:z") in {tuple(x) for x in done.relations["opa"].collect()}
    r.extend(opa=facts([("urn:k", "urn:f", "urn:m"), ("urn:k", "urn:f", "urn:n")]))  # makes m and n equal: all is derived again
    assert {x[0] for x in r.property_values("urn:k", "urn:f").collect()} == {"urn:m", "urn:n"}


def test_lenient_reading_goes_on_after_a_bad_axiom():
    text = PREFIX + "SubClassOf(:A :B) SubClassOf(nope:x ObjectUnionOf(:C :D)) Nonsense(:A (:B)) SubClassOf(:B :C) SubClassOf(:A) SubClassOf(:C :D))"
    doc = functional.parse(text, lenient=True)
    assert [a[1] for a in doc.axioms] == ["urn:A", "urn:B", "urn:C"] and len(doc.skipped) == 3
    with pytest.raises(OntologyError):
        functional.parse(text)


TURTLE = """@prefix : <urn:> . @prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . @prefix rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
:hasChild a owl:ObjectProperty ; owl:inverseOf :hasParent . :age a owl:DatatypeProperty , owl:FunctionalProperty .
:Parent owl:equivalentClass [ a owl:Class ; owl:intersectionOf ( :Person [ a owl:Restriction ; owl:onProperty :hasChild ; owl:someValuesFrom :Person ] ) ] .
:Childless rdfs:subClassOf :Person , [ a owl:Restriction ; owl:onProperty :hasChild ; owl:maxCardinality "0"^^xsd:nonNegativeInteger ] .
:Grand owl:propertyChainAxiom ( :hasParent :hasParent ) . :Person owl:hasKey ( :number ) . :number a owl:DatatypeProperty .
[] a owl:AllDifferent ; owl:distinctMembers ( :ann :bob :cat ) . [] a owl:AllDisjointClasses ; owl:members ( :Person :Thing1 ) .
[] a owl:NegativePropertyAssertion ; owl:sourceIndividual :ann ; owl:assertionProperty :hasChild ; owl:targetIndividual :cat .
:Small a rdfs:Datatype ; owl:equivalentClass [ a rdfs:Datatype ; owl:onDatatype xsd:int ; owl:withRestrictions ( [ xsd:maxInclusive 9 ] ) ] .
:ann a :Person ; :hasChild :bob ; :age 41 . :bob a :Person ; :hasParent :ann ; :hasParent :dan . :dan :hasParent :eve .
:U owl:unionOf ( :Parent :Childless ) . :V rdfs:subClassOf [ a owl:Restriction ; owl:onProperty :hasChild ; owl:minQualifiedCardinality 2 ; owl:onClass :Person ] ."""


def test_graphs_are_read_as_axioms(spark):
    doc = documents.read_text(TURTLE)
    some = ("ObjectSomeValuesFrom", "urn:hasChild", "urn:Person")
    want = {
        ("EquivalentClasses", "urn:Parent", ("ObjectIntersectionOf", "urn:Person", some)), ("SubClassOf", "urn:Childless", ("ObjectMaxCardinality", 0, "urn:hasChild")), ("SubObjectPropertyOf", ("ObjectPropertyChain", "urn:hasParent", "urn:hasParent"), "urn:Grand"),
        ("HasKey", "urn:Person", ("list",), ("list", "urn:number")), ("DifferentIndividuals", "urn:ann", "urn:bob", "urn:cat"), ("DisjointClasses", "urn:Person", "urn:Thing1"), ("NegativeObjectPropertyAssertion", "urn:hasChild", "urn:ann", "urn:cat"),
        ("FunctionalDataProperty", "urn:age"), ("InverseObjectProperties", "urn:hasChild", "urn:hasParent"), ("EquivalentClasses", "urn:U", ("ObjectUnionOf", "urn:Parent", "urn:Childless")), ("SubClassOf", "urn:V", ("ObjectMinCardinality", 2, "urn:hasChild", "urn:Person")),
        ("DatatypeDefinition", "urn:Small", ("DatatypeRestriction", "xsd:int", "xsd:maxInclusive", ("literal", "9", "xsd:integer"))), ("DataPropertyAssertion", "urn:age", "urn:ann", ("literal", "41", "xsd:integer")),
    }
    assert want <= set(doc.axioms) and not doc.skipped
    r = Reasoner.of_document(spark, doc)
    assert "urn:ann" in {x[0] for x in r.instances("urn:Parent").collect()}
    assert {x[0] for x in r.property_values("urn:bob", "urn:Grand").collect()} == {"urn:eve"}


def test_command_line_reads_any_format(spark, tmp_path, capsys):
    (tmp_path / "base.ofn").write_text("Prefix(:=<urn:>) Ontology(<urn:base> SubClassOf(:B :C))")
    xml = "<?xml version='1.0'?><Ontology xmlns='http://www.w3.org/2002/07/owl#' ontologyIRI='urn:top'><Import>urn:base</Import><SubClassOf><Class IRI='urn:A'/><Class IRI='urn:B'/></SubClassOf></Ontology>"
    (tmp_path / "top.owx").write_text(xml)
    main(["classify", str(tmp_path / "top.owx")])
    out = json.loads(capsys.readouterr().out)
    assert out["complete"] and out["subsumptions"] == [["urn:A", "urn:B"], ["urn:B", "urn:C"]]
    main(["entail", str(tmp_path / "top.owx"), "SubClassOf(<urn:A> <urn:C>)"])
    assert json.loads(capsys.readouterr().out) == {"entailed": True}
