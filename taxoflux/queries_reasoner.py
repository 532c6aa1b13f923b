"""Registered queries that go through the reasoner, the readers and the remaining operators; part of taxoflux.queries."""
from __future__ import annotations

import json

from pyspark.sql import functions as F

from taxoflux.functions import datatypes as dt
from taxoflux.ontology import Builder, Ontology
from taxoflux.operators import checks, el, explain, graphs, incremental, profile, query, rl, roles, swrl, tableau
from taxoflux.plans.scratch import Scratch, table
from taxoflux.queries import BRANDS, GROUP, PLACES, PTYPES, UP, copies, el_axioms, found, register
from taxoflux.reasoner import Reasoner, modules
from taxoflux.sources import documents
from taxoflux.sources import tables as src
from taxoflux.streaming import abox

c = F.col


def materialized(spark, more_rules=(), **relations):
    o = Ontology.empty(spark)
    for name, rows in relations.items():
        o = o.replace(**{name: rows}) if not isinstance(rows, list) else o.with_rows(name, rows)
    return rl.materialize(o.relations, Scratch(spark), more_rules=list(more_rules))


def document(spark, d):
    """The regions and nations, few and fixed in number, as the axioms of one document: (sub, sup) class names."""
    rows = table(spark, d, "nation").join(table(spark, d, "region"), c("n_regionkey") == c("r_regionkey")).select("n_name", F.regexp_replace("r_name", " ", "_").alias("r")).collect()
    return sorted((r["n_name"], r["r"]) for r in rows)


NATIONS = "SELECT n_name AS sub, replace(r_name, ' ', '_') AS sup FROM nation JOIN region ON n_regionkey = r_regionkey"
BASE = "http://example.org/"


# ---- rules over facts -------------------------------------------------------------------------------
@register("SELECT DISTINCT 'order/' || o_orderkey AS s, 'shippedTo' AS p, 'nation/' || c_nationkey AS o FROM orders JOIN customer ON o_custkey = c_custkey")
def rl_prop_chain(spark, d):
    """prp-spo2: a chain of two properties below a third, in the joint fixpoint."""
    opa = src.placements(spark, d).unionByName(src.locations(spark, d))
    return materialized(spark, opa=opa, chain=[("placedBy", "inNation", "shippedTo")]).relations["opa"].where("p = 'shippedTo'")


@register("WITH k AS (SELECT 'customer/' || c_custkey AS ind, c_nationkey, c_mktsegment, floor(c_acctbal / 100)::BIGINT AS band FROM customer), m AS (SELECT *, min(ind) OVER (PARTITION BY c_nationkey, c_mktsegment, band) AS rep, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment, band) AS n FROM k) SELECT ind AS node, rep FROM m WHERE n > 1")
def rl_has_key(spark, d):
    """prp-key over one object and two data property values, in the joint fixpoint."""
    customers = table(spark, d, "customer").select(src.ident("customer", "c_custkey").alias("s"), "c_mktsegment", F.floor(c("c_acctbal") / 100).cast("string").alias("band"))
    dpa = customers.select("s", F.lit("segment").alias("p"), c("c_mktsegment").alias("lexical"), F.lit("xsd:string").alias("datatype")).unionByName(customers.select("s", F.lit("band").alias("p"), c("band").alias("lexical"), F.lit("xsd:integer").alias("datatype")))
    opa = src.locations(spark, d).where(c("s").startswith("customer/"))
    types = customers.select(c("s").alias("ind"), F.lit("Customer").alias("cls"))
    return materialized(spark, opa=opa, dpa=dpa, type=types, key=[("Customer", ["inNation", "segment", "band"])]).representatives


@register("WITH m AS (SELECT 'order/' || l_orderkey AS s, 'supplier/' || l_suppkey AS o FROM lineitem WHERE l_linenumber <= 2 AND l_orderkey % 40 = 0), g AS (SELECT s, min(o) AS a FROM m GROUP BY s) SELECT DISTINCT a, o AS b FROM m JOIN g USING (s) WHERE o <> a")
def rl_at_most_one(spark, d):
    """cls-maxc2: members of a class with at most one successor have equal successors, each tied to the smallest."""
    lines = table(spark, d, "lineitem").where("l_linenumber <= 2 and l_orderkey % 40 = 0")
    opa = lines.select(src.ident("order", "l_orderkey").alias("s"), F.lit("suppliedBy").alias("p"), src.ident("supplier", "l_suppkey").alias("o")).distinct()
    types = opa.select(c("s").alias("ind"), F.lit("Single").alias("cls")).distinct()
    return rl.at_most_one_same(types, opa, spark.createDataFrame([("Single", "suppliedBy", "1", rl.THING)], "cls string, p string, most string, filler string"))


PRICES = "dpa AS (SELECT 'order/' || o_orderkey AS s, 'price' AS p, o_totalprice::DECIMAL(18, 2)::VARCHAR AS lexical, 'xsd:decimal' AS datatype FROM orders)"


def prices(spark, d):
    orders = table(spark, d, "orders")
    return orders.select(src.ident("order", "o_orderkey").alias("s"), F.lit("price").alias("p"), c("o_totalprice").cast("decimal(18,2)").cast("string").alias("lexical"), F.lit("xsd:decimal").alias("datatype"))


@register(f"WITH {PRICES} SELECT s, p, lexical, datatype FROM dpa UNION ALL SELECT s, 'amount', lexical, datatype FROM dpa UNION ALL SELECT s, 'number', lexical, datatype FROM dpa")
def rl_sub_data_property(spark, d):
    return materialized(spark, dpa=prices(spark, d), sub_data=[("price", "amount"), ("amount", "number")]).relations["dpa"]


@register("SELECT 'order/' || o_orderkey AS ind, 'Priced' AS cls FROM orders")
def rl_data_domain(spark, d):
    return materialized(spark, dpa=prices(spark, d), sub_data=[("price", "amount")], data_domain=[("amount", "Priced")]).relations["type"]


@register("SELECT DISTINCT 'customer/' || c_custkey AS s, 'inNation' AS p, 'nation/3' AS o FROM customer WHERE c_mktsegment = 'BUILDING'")
def rl_has_value(spark, d):
    """Members of a class have the value it asks for."""
    types = table(spark, d, "customer").select(src.ident("customer", "c_custkey").alias("ind"), c("c_mktsegment").alias("cls"))
    return materialized(spark, type=types, value=[("BUILDING", "inNation", "nation/3")]).relations["opa"]


@register("SELECT 'customer/' || c_custkey AS ind, 'Third' AS cls FROM customer WHERE c_nationkey = 3 UNION SELECT 'supplier/' || s_suppkey, 'Third' FROM supplier WHERE s_nationkey = 3")
def rl_has_value_type(spark, d):
    return materialized(spark, opa=src.locations(spark, d), defined_by_value=[("Third", "inNation", "nation/3")]).relations["type"]


@register("SELECT 'order/' || o_orderkey AS ind, 'BigOpen' AS cls FROM orders WHERE o_orderstatus = 'O' AND o_totalprice >= 200000")
def rl_intersection(spark, d):
    big = table(spark, d, "orders").where("o_totalprice >= 200000").select(src.ident("order", "o_orderkey").alias("ind"), F.lit("Big").alias("cls"))
    types = src.order_types(spark, d).unionByName(big)
    return materialized(spark, type=types, conjunction=[("Order_O", "Big", "BigOpen")]).relations["type"].where("cls = 'BigOpen'")


@register("SELECT DISTINCT 'customer/' || o_custkey AS ind, 'Opener' AS cls FROM orders WHERE o_orderstatus = 'O'")
def rl_universal(spark, d):
    """Successors of members of a class are of the class that all of them must be of."""
    done = materialized(spark, type=src.order_types(spark, d), opa=src.placements(spark, d), only=[("Order_O", "placedBy", "Opener")])
    return done.relations["type"].where("cls = 'Opener'")


@register("SELECT DISTINCT 'order/' || o_orderkey AS ind, 'FromNation3' AS cls FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 3")
def rl_existential_type(spark, d):
    """A property to a member of a class makes the subject a member: ∃placedBy.(∃inNation.{nation/3})."""
    done = materialized(spark, opa=src.placements(spark, d).unionByName(src.locations(spark, d)), defined_by_value=[("In3", "inNation", "nation/3")], defined_by_some=[("FromNation3", "placedBy", "In3")])
    return done.relations["type"].where("cls = 'FromNation3'")


@register("SELECT DISTINCT 'brand' AS p, 'functional' AS kind UNION SELECT 'made', 'functional' UNION SELECT 'linked', 'reflexive' UNION SELECT 'linkedMore', 'reflexive'")
def rl_char_propagate(spark, d):
    """Functional goes down to subproperties, reflexive up."""
    chars = src.constants(spark, [("made", "functional"), ("linked", "reflexive")], "p string, kind string")
    return rl.propagate_characteristics(chars, src.constants(spark, [("brand", "made"), ("linked", "linkedMore")], "sub string, sup string"))


@register("SELECT 'n' || n_nationkey AS sub, 'n' || ((n_nationkey + 5) % 25) AS sup FROM nation")
def rl_equivalence_ring(spark, d):
    """Each set of equivalent classes as a ring of edges, whose closure is all pairs."""
    n = table(spark, d, "nation").select((c("n_nationkey") % 5).cast("string").alias("axiom_id"), c("n_nationkey").alias("k"))
    sets = n.groupBy("axiom_id").agg(F.transform(F.array_sort(F.collect_list("k")), lambda x: F.concat(F.lit("n"), x.cast("string"))).alias("members"))
    return rl.equivalence_edges(sets)


# ---- clashes ----------------------------------------------------------------------------------------
@register("SELECT 'order/' || o_orderkey AS a, 'price' AS b FROM orders WHERE o_orderkey % 7 = 0 AND o_totalprice <> 1")
def clash_functional_data(spark, d):
    """Two values of a functional data property; the same value in another form is no clash."""
    orders = table(spark, d, "orders").where("o_orderkey % 7 in (0, 1)")
    again = orders.select(src.ident("order", "o_orderkey").alias("s"), F.lit("price").alias("p"), F.when(c("o_orderkey") % 7 == 0, "1").otherwise(F.concat(F.lit("+0"), c("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit("00"))).alias("lexical"), F.lit("xsd:decimal").alias("datatype"))
    return found(spark, "functional_data", dpa=prices(spark, d).unionByName(again), prop_char=[("price", "functional")])


@register("SELECT 'order/' || o_orderkey AS a, 'status|string ' || o_orderstatus AS b FROM orders WHERE o_orderstatus = 'P'")
def clash_negative_data(spark, d):
    orders = table(spark, d, "orders").select(src.ident("order", "o_orderkey").alias("s"), F.lit("status").alias("p"), c("o_orderstatus").alias("lexical"), F.lit("xsd:string").alias("datatype"))
    return found(spark, "negative_data_assertion", dpa=orders, neg_dpa=orders.withColumn("lexical", F.lit("P")))


@register("SELECT 'part/' || p_partkey AS a, 'least|size' AS b FROM part WHERE p_size < 10")
def clash_disjoint_data(spark, d):
    part = table(spark, d, "part")
    value = lambda p, column: part.select(src.ident("part", "p_partkey").alias("s"), F.lit(p).alias("p"), column.cast("string").alias("lexical"), F.lit("xsd:integer").alias("datatype"))
    return found(spark, "disjoint_data", dpa=value("size", c("p_size")).unionByName(value("least", F.least("p_size", F.lit(9)))), disjoint_prop=[("least", "size")])


@register("SELECT 'part/' || p_partkey AS a, 'size|' || p_size AS b FROM part WHERE p_size > 40")
def clash_ill_typed(spark, d):
    rows = table(spark, d, "part").select(src.ident("part", "p_partkey").alias("s"), F.lit("size").alias("p"), c("p_size").cast("string").alias("lexical"), F.when(c("p_size") > 40, "xsd:boolean").otherwise("xsd:byte").alias("datatype"))
    return found(spark, "ill_typed", dpa=rows)


@register("SELECT 'part/' || p_partkey AS a, 'label|' || p_name AS b FROM part UNION ALL SELECT 'part/' || p_partkey, 'label|' || -p_size FROM part")
def clash_data_range(spark, d):
    """Strings and negative numbers where the range is a positive integer."""
    part = table(spark, d, "part").withColumn("s", src.ident("part", "p_partkey"))
    value = lambda x, kind: part.select("s", F.lit("label").alias("p"), x.cast("string").alias("lexical"), F.lit(kind).alias("datatype"))
    return found(spark, "data_range", dpa=value(c("p_name"), "xsd:string").unionByName(value(-c("p_size"), "xsd:int")).unionByName(value(c("p_size"), "xsd:decimal")), data_range=[("label", "xsd:positiveInteger")])


@register("SELECT 'order/' || o_orderkey AS a, 'avoids|placedBy|customer/' || o_custkey AS b FROM orders WHERE o_custkey % 9 = 0")
def clash_disjoint_properties(spark, d):
    avoids = src.placements(spark, d).where("cast(substring(o, 10, 20) as bigint) % 9 = 0").withColumn("p", F.lit("avoids"))
    return found(spark, "disjoint_properties", opa=src.placements(spark, d).unionByName(avoids), disjoint_prop=[("avoids", "placedBy")])


@register("SELECT 'order/' || o_orderkey AS a, 'Closed' AS b FROM orders WHERE o_orderstatus = 'F'")
def clash_complement(spark, d):
    """Individuals said not to be of a class that they are below."""
    negative = table(spark, d, "orders").select(src.ident("order", "o_orderkey").alias("ind"), F.lit("Closed").alias("cls"))
    return found(spark, "complement", type=src.order_types(spark, d), sub_class=[("Order_F", "Closed")], neg_type=negative)


@register("SELECT DISTINCT 'order/' || l_orderkey AS a, 'suppliedBy|supplier/' || l_suppkey AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P'")
def clash_at_most_none(spark, d):
    """Members of a class that may have no successor."""
    return found(spark, "at_most_none", type=src.order_types(spark, d), opa=src.line_relations(spark, d).where("p = 'suppliedBy'"), at_most=[("Order_P", "suppliedBy", "0", rl.THING)])


@register("SELECT DISTINCT 'order/' || l_orderkey AS a, 'suppliedBy owl:Thing 2' AS b FROM lineitem WHERE l_suppkey < 6 GROUP BY l_orderkey HAVING count(DISTINCT l_suppkey) > 2")
def clash_max_cardinality(spark, d):
    """More successors, all told apart, than a class allows."""
    opa = table(spark, d, "lineitem").where("l_suppkey < 6").select(src.ident("order", "l_orderkey").alias("s"), F.lit("suppliedBy").alias("p"), src.ident("supplier", "l_suppkey").alias("o")).distinct()
    apart = [(f"supplier/{i}", f"supplier/{j}") for i in range(6) for j in range(i + 1, 6)]
    return found(spark, "max_cardinality", opa=opa, type=opa.select(c("s").alias("ind"), F.lit("Order").alias("cls")).distinct(), at_most=[("Order", "suppliedBy", "2", rl.THING)], different=apart).select("a", F.concat_ws(" ", "b").alias("b"))


@register("SELECT 'order/' || o_orderkey AS ind, 'placedBy' AS p FROM orders WHERE o_orderstatus = 'P'")
def check_only_against_some(spark, d):
    """Typed so that a successor must be of two disjoint classes."""
    k = lambda *rows: src.constants(spark, list(rows), "cls string, p string, filler string")
    return checks.only_against_some(src.order_types(spark, d), k(("Order_P", "placedBy", "Person")), k(("Order_P", "placedBy", "Firm"), ("Order_F", "placedBy", "Firm")), src.constants(spark, [("Firm", "Person")], "a string, b string"))


@register("SELECT DISTINCT 'order/' || a.l_orderkey AS s, 'suppliedBy' AS p, 'supplier/1' AS a, 'supplier/2' AS b FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey WHERE a.l_suppkey = 1 AND b.l_suppkey = 2")
def check_functional_different(spark, d):
    return checks.functional_different(src.line_relations(spark, d), src.constants(spark, [("suppliedBy",)], "p string"), src.constants(spark, [("supplier/1", "supplier/2")], "a string, b string"))


@register("SELECT DISTINCT p_brand AS cls, 'made' AS p, p_size AS least, 20 AS most FROM part WHERE p_size > 20")
def check_min_above_max(spark, d):
    least = table(spark, d, "part").select(c("p_brand").alias("cls"), F.lit("made").alias("p"), c("p_size").alias("least"))
    return checks.min_above_max(least, least.select("cls", "p", F.lit(20).alias("most")).distinct())


@register("WITH s AS (SELECT DISTINCT p_size FROM part), n AS (SELECT p_size, lag(p_size) OVER (ORDER BY p_size) AS below FROM s) SELECT 'AtLeast' || p_size AS sub, 'AtLeast' || below AS sup FROM n WHERE below IS NOT NULL")
def cardinality_subsumption(spark, d):
    """At least m is below at least n for m >= n: neighbouring bounds only, by a window over each role and filler."""
    sizes = table(spark, d, "part").select(F.concat(F.lit("AtLeast"), c("p_size").cast("string")).alias("cls"), F.lit("has").alias("p"), F.lit("Part").alias("filler"), c("p_size").alias("least")).distinct()
    return checks.cardinality_subsumption(sizes)


@register(f"WITH {BRANDS} SELECT sub, sup FROM edges WHERE sup LIKE 'BrandGroup%'")
def union_subsumption(spark, d):
    groups = src.brand_hierarchy(spark, d).where(c("sup").startswith("BrandGroup")).groupBy(c("sup").alias("cls")).agg(F.collect_set("sub").alias("members"))
    return checks.union_subsumption(groups)


# ---- equality in answers ----------------------------------------------------------------------------
@register("WITH t AS (SELECT doc_id::VARCHAR AS doc, min(doc_id) OVER (PARTITION BY text) AS rep, lang FROM documents WHERE text IS NOT NULL) SELECT DISTINCT a.doc AS ind FROM t a JOIN t b ON a.rep = b.rep WHERE b.lang = 'en'")
def reasoner_instances(spark, d):
    """Members of a class, copies included: what holds of a cluster holds of each of its members."""
    types = table(spark, d, "documents").where("text is not null and lang is not null").select(c("doc_id").cast("string").alias("ind"), c("lang").alias("cls")).distinct()
    same = copies(spark, d).select(c("a").cast("string"), c("b").cast("string")).distinct()
    return Reasoner(Ontology.empty(spark).replace(type=types, same=same)).instances("en")


@register("SELECT DISTINCT 'nation/' || n_nationkey AS x FROM nation WHERE n_regionkey = 1")
def reasoner_query_constant(spark, d):
    """A query's constant stands for its whole sameAs cluster."""
    o = Ontology.empty(spark).with_rows("same", [("region/1", "zone/one")]).with_rows("sub_prop", [("inRegion", "within")]).replace(opa=src.locations(spark, d).where("p = 'inRegion'"))
    return Reasoner(o).query("within(?x, zone/one)")


@register("SELECT 'nation/' || n_nationkey AS o FROM nation WHERE n_nationkey = 7 UNION SELECT 'land/seven'")
def reasoner_property_values(spark, d):
    o = Ontology.empty(spark).with_rows("same", [("land/seven", "nation/7")]).with_rows("type", [("customer/x", "Customer")]).with_rows("opa", [("customer/x", "inNation", "nation/7")])
    return Reasoner(o).property_values("customer/x", "inNation")


@register("SELECT * FROM (VALUES ('inNation', 'told'), ('nationOf', 'mirrored')) t(a, b)")
def sub_properties_of_inverses(spark, d):
    """inNation ⊑ locatedIn, and so the inverse of the first below the inverse of the second."""
    o = Ontology.empty(spark).with_rows("sub_prop", [("inNation", "locatedIn")]).with_rows("inverse", [("inNation", "nationOf"), ("locatedIn", "contains")])
    r = Reasoner(o)
    return r.sub_properties("locatedIn").select(c("sub").alias("a"), F.lit("told").alias("b")).unionByName(r.sub_properties("contains").select(c("sub").alias("a"), F.lit("mirrored").alias("b")))


# ---- classification by the engines ------------------------------------------------------------------
@register(f"SELECT DISTINCT p_brand AS sub, 'MadeWell' AS sup FROM part")
def el_range_subsumption(spark, d):
    """brand ⊑ ∃madeAs.type, range(madeAs) = Method, ∃madeAs.Method ⊑ MadeWell."""
    some = table(spark, d, "part").select(c("p_brand").alias("cls"), F.lit("madeAs").alias("p"), c("p_type").alias("filler")).distinct()
    o = Ontology.empty(spark).with_rows("range", [("madeAs", "Method")]).with_rows("defined_by_some", [("MadeWell", "madeAs", "Method")]).replace(exists_super=some)
    return Reasoner(o).classify().closure.where("sup = 'MadeWell'")


@register("SELECT DISTINCT p_brand AS sub, 'ByWay' AS sup FROM part UNION SELECT DISTINCT p_type, 'Way' FROM part")
def el_role_chain(spark, d):
    """brand ⊑ ∃madeAs.type, type ⊑ ∃uses.Tool, madeAs∘uses ⊑ needs, ∃needs.Tool ⊑ ByWay, ∃uses.Tool ⊑ Way."""
    part = table(spark, d, "part")
    some = part.select(c("p_brand").alias("cls"), F.lit("madeAs").alias("p"), c("p_type").alias("filler")).unionByName(part.select(c("p_type").alias("cls"), F.lit("uses").alias("p"), F.lit("Tool").alias("filler"))).distinct()
    rel = {"some": some, "chain": src.constants(spark, [("madeAs", "uses", "needs")], "first string, second string, sup string"), "some_lhs": src.constants(spark, [("needs", "Tool", "ByWay"), ("uses", "Tool", "Way")], "p string, filler string, sup string")}
    return el.classify(rel, Scratch(spark)).closure.where("sup in ('ByWay', 'Way')")


@register(f"SELECT DISTINCT p_brand AS sub, 'Both' AS sup FROM part WHERE {GROUP} = 'BrandGroup_2'")
def el_conjunction(spark, d):
    """Classes below both sides of an intersection are below what it is below."""
    rel = el_axioms(spark, d)
    rel["conj"] = src.constants(spark, [("BrandGroup_2", "Made", "Both")], "left string, right string, sup string")
    return el.classify(rel, Scratch(spark)).closure.where("sup = 'Both'")


@register(f"{NATIONS} UNION SELECT n_name, 'World' FROM nation UNION SELECT replace(r_name, ' ', '_'), 'World' FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)")
def dl_union_classify(spark, d):
    """World ≡ union of the regions: subsumptions that the tableau finds, one independent test a class."""
    edges = document(spark, d)
    regions = sorted({r for _, r in edges})
    r = Reasoner(Ontology.of_rows(spark, {"sub_class": edges}), [("EquivalentClasses", "World", ("ObjectUnionOf", *regions))], seconds=60)
    return r.classify().closure


@register("SELECT n_name AS cls FROM nation WHERE n_regionkey = 2")
def dl_unsatisfiable(spark, d):
    """Classes whose every model clashes: ∃in.Cold and ∀in.Warm, Warm and Cold apart, for the nations of one region."""
    second = [r["n_name"] for r in table(spark, d, "nation").where("n_regionkey = 2").collect()]
    rows = {"sub_class": [*document(spark, d), *((n, "Odd") for n in second)], "exists_super": [("Odd", "in", "Cold")], "only": [("Odd", "in", "Warm")], "disjoint": [("Cold", "Warm")]}
    return Reasoner(Ontology.of_rows(spark, rows), seconds=60).classify().unsatisfiable.where("cls <> 'Odd'")


CASES = {
    "union": ([("SubClassOf", "A", ("ObjectUnionOf", "B", "C")), ("DisjointClasses", "A", "B"), ("DisjointClasses", "A", "C"), ("ClassAssertion", "A", "i")], False),
    "only_some": ([("SubClassOf", "X", ("ObjectAllValuesFrom", "r", "E")), ("SubClassOf", "X", ("ObjectSomeValuesFrom", "r", "C")), ("DisjointClasses", "C", "E"), ("ClassAssertion", "X", "i")], False),
    "unsatisfiable_class_only": ([("SubClassOf", "X", "Y"), ("DisjointClasses", "X", "Y")], True),
    "nominal": ([("SubClassOf", "A", ("ObjectOneOf", "a")), ("ClassAssertion", "A", "b"), ("DifferentIndividuals", "a", "b")], False),
    "nominal_open": ([("SubClassOf", "A", ("ObjectOneOf", "a")), ("ClassAssertion", "A", "b")], True),
    "self": ([("SubClassOf", "A", ("ObjectHasSelf", "r")), ("IrreflexiveObjectProperty", "r"), ("ClassAssertion", "A", "a")], False),
    "negative": ([("SubObjectPropertyOf", "r", "s"), ("ObjectPropertyAssertion", "r", "a", "b"), ("NegativeObjectPropertyAssertion", "s", "a", "b")], False),
    "chain": ([("SubObjectPropertyOf", ("ObjectPropertyChain", "r", "s"), "t"), ("SubClassOf", "A", ("ObjectSomeValuesFrom", "r", ("ObjectSomeValuesFrom", "s", "B"))), ("SubClassOf", "A", ("ObjectAllValuesFrom", "t", ("ObjectComplementOf", "B"))), ("ClassAssertion", "A", "a")], False),
    "cardinality": ([("SubClassOf", "A", ("ObjectMinCardinality", 3, "r", "B")), ("SubClassOf", "A", ("ObjectMaxCardinality", 2, "r")), ("ClassAssertion", "A", "a")], False),
    "disjoint_roles": ([("DisjointObjectProperties", "r", "s"), ("SubObjectPropertyOf", "t", "r"), ("SubObjectPropertyOf", "t", "s"), ("SubClassOf", "A", ("ObjectSomeValuesFrom", "t", "B")), ("ClassAssertion", "A", "a")], False),
    "blocking": ([("SubClassOf", "A", ("ObjectSomeValuesFrom", "r", "A")), ("SubClassOf", "A", ("ObjectUnionOf", "B", "C")), ("ClassAssertion", "A", "a")], True),
    "thing_is_nothing": ([("EquivalentClasses", "owl:Thing", "owl:Nothing")], False),
    "finite_nominal": ([("SubClassOf", "owl:Thing", ("ObjectOneOf", "a", "b")), ("DifferentIndividuals", "a", "b", "c")], False),
    "finite_nominal_open": ([("SubClassOf", "owl:Thing", ("ObjectOneOf", "a", "b")), ("DifferentIndividuals", "a", "b")], True),
    "nominal_grid": ([("EquivalentClasses", "Hole", ("ObjectOneOf", "h1", "h2")), ("SubClassOf", "Pigeon", ("ObjectSomeValuesFrom", "in", "Hole")), ("InverseFunctionalObjectProperty", "in"), ("ClassAssertion", "Pigeon", "p1"), ("ClassAssertion", "Pigeon", "p2"), ("ClassAssertion", "Pigeon", "p3"), ("DifferentIndividuals", "p1", "p2", "p3")], False),
    "union_of_nominals": ([("SubClassOf", "A", ("ObjectUnionOf", ("ObjectOneOf", "a"), "B")), ("DisjointClasses", "A", "B"), ("ClassAssertion", "A", "x"), ("ClassAssertion", "A", "y"), ("DifferentIndividuals", "x", "y")], False),
    "bottom_property": ([("ObjectPropertyDomain", "owl:bottomObjectProperty", "owl:Nothing"), ("SubObjectPropertyOf", "r", "owl:bottomObjectProperty"), ("SubClassOf", "A", ("ObjectSomeValuesFrom", "r", "B")), ("ClassAssertion", "A", "a")], False),
    "asymmetric": ([("AsymmetricObjectProperty", "r"), ("SymmetricObjectProperty", "r"), ("SubClassOf", "A", ("ObjectSomeValuesFrom", "r", "B")), ("ClassAssertion", "A", "a")], False),
}


@register("SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{ {True: 'satisfiable', False: 'unsatisfiable'}[v] }')" for k, (_, v) in CASES.items()) + ") t(name, status)")
def dl_consistency_cases(spark, d):
    """Knowledge bases whose consistency is known, each decided by the tableau."""
    out = []
    for name, (axioms, _) in CASES.items():
        k, box, left = tableau.from_axioms(axioms)
        out.append((name, tableau.test(k, [], box, 60, bool(left))))
    return spark.createDataFrame(out, "name string, status string")


@register("SELECT 'order/' || o_orderkey AS component, CASE WHEN o_totalprice < 100000 THEN 'unsatisfiable' ELSE 'satisfiable' END AS status FROM orders WHERE o_orderstatus = 'P'")
def dl_component_consistency(spark, d):
    """Each connected part of the facts is tested on its own: cheap orders may not be partial ones."""
    orders = table(spark, d, "orders").where("o_orderstatus = 'P'")
    rows = orders.select(src.ident("order", "o_orderkey").alias("component"), F.explode(F.when(c("o_totalprice") < 100000, F.array(F.lit("Partial"), F.lit("Cheap"))).otherwise(F.array(F.lit("Partial")))).alias("o"))
    rows = rows.select("component", F.lit("type").alias("kind"), c("component").alias("s"), F.lit("").alias("p"), "o")
    k, _, _ = tableau.from_axioms([("SubClassOf", "Partial", ("ObjectUnionOf", "Dear", "Fair")), ("DisjointClasses", "Cheap", "Dear"), ("DisjointClasses", "Cheap", "Fair")])
    return tableau.consistent_components(spark, rows, k)


@register("SELECT n_name AS name, min(n_name) OVER (PARTITION BY n_regionkey) AS module FROM nation UNION SELECT replace(r_name, ' ', '_'), (SELECT min(n_name) FROM nation WHERE n_regionkey = r_regionkey) FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)")
def hybrid_modules(spark, d):
    """Axioms of each region share no name with the others; a module is named by its smallest name."""
    found_modules = modules([("SubClassOf", a, b) for a, b in document(spark, d)])
    low = {}
    for n, m in found_modules.items():
        if not n.startswith("NATION"):
            continue
        low[m] = min(low.get(m, n), n)
    return spark.createDataFrame([(n, low[m]) for n, m in found_modules.items()], "name string, module string")


@register(f"WITH RECURSIVE {BRANDS}, {UP} SELECT sub || '<' || sup AS axiom, (SELECT min(sub || '<' || sup) FROM edges) AS module FROM edges")
def axiom_modules(spark, d):
    """All axioms of the hierarchy hang together by the class at its top."""
    axioms = src.brand_hierarchy(spark, d).select(F.concat_ws("<", "sub", "sup").alias("axiom"), F.array("sub", "sup").alias("entities"))
    return profile.modules(profile.signature(axioms), Scratch(spark))


PROFILE_CASES = [
    ("class", ("SubClassOf", "A", "B"), "EL QL RL"), ("assertion", ("ClassAssertion", "A", "i"), "EL QL RL"), ("existential", ("SubClassOf", "A", ("ObjectSomeValuesFrom", "r", "B")), "EL QL"),
    ("existential_left", ("SubClassOf", ("ObjectSomeValuesFrom", "r", "B"), "A"), "EL RL"), ("key", ("HasKey", "A", ("list", "r"), ("list",)), "EL RL"), ("value", ("SubClassOf", "A", ("ObjectHasValue", "r", "i")), "EL RL"),
    ("self", ("SubClassOf", "A", ("ObjectHasSelf", "r")), "EL"), ("chain", ("SubObjectPropertyOf", ("ObjectPropertyChain", "r", "s"), "t"), "EL RL"), ("inverse", ("InverseObjectProperties", "r", "s"), "QL RL"),
    ("symmetric", ("SymmetricObjectProperty", "r"), "QL RL"), ("transitive", ("TransitiveObjectProperty", "r"), "EL RL"), ("reflexive", ("ReflexiveObjectProperty", "r"), "EL QL"), ("functional", ("FunctionalObjectProperty", "r"), "RL"),
    ("only", ("SubClassOf", "A", ("ObjectAllValuesFrom", "r", "B")), "RL"), ("only_left", ("SubClassOf", ("ObjectAllValuesFrom", "r", "B"), "A"), ""), ("union", ("SubClassOf", "A", ("ObjectUnionOf", "B", "C")), ""),
    ("union_left", ("SubClassOf", ("ObjectUnionOf", "B", "C"), "A"), "RL"), ("complement", ("SubClassOf", "A", ("ObjectComplementOf", "B")), "QL RL"), ("at_most_one", ("SubClassOf", "A", ("ObjectMaxCardinality", 1, "r", "B")), "RL"),
    ("at_most_two", ("SubClassOf", "A", ("ObjectMaxCardinality", 2, "r", "B")), ""), ("same", ("SameIndividual", "i", "j"), "EL RL"), ("disjoint_union", ("DisjointUnion", "A", "B", "C"), ""), ("one_of", ("SubClassOf", "A", ("ObjectOneOf", "i")), "EL"),
    ("thing_below", ("SubClassOf", "owl:Thing", "A"), "EL QL"), ("double", ("DataPropertyRange", "p", "xsd:double"), "RL"), ("real", ("DataPropertyRange", "p", "owl:real"), "EL QL"),
]


@register("SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, _, v in PROFILE_CASES) + ") t(name, profiles)")
def profile_grammar(spark, d):
    """Axioms whose W3C profiles are known."""
    return spark.createDataFrame([(k, " ".join(profile.profiles([a]))) for k, a, _ in PROFILE_CASES], "name string, profiles string")


@register("SELECT * FROM (VALUES ('el', 'EL'), ('rl', 'RL'), ('dl', 'DL'), ('hybrid', 'DL')) t(engine, profile)")
def profile_routes(spark, d):
    some, union = ("SubClassOf", "A", ("ObjectSomeValuesFrom", "r", "B")), ("SubClassOf", "A", ("ObjectUnionOf", "B", "C"))
    routes = [profile.route([some]), profile.route([("FunctionalObjectProperty", "r")]), profile.route([union]), profile.route([union], modules=2)]
    return spark.createDataFrame([(r.engine, r.profile) for r in routes], "engine string, profile string")


# ---- entailment -------------------------------------------------------------------------------------
ENTAILMENTS = [
    ("SubClassOf(:NATION_0 :World)", True), ("SubClassOf(:World :NATION_0)", False), ("ClassAssertion(:World :home)", True), ("ObjectPropertyAssertion(:within :home :centre)", True), ("ObjectPropertyAssertion(:within :centre :home)", False),
    ("SubObjectPropertyOf(:lies :within)", True), ("SubObjectPropertyOf(:within :lies)", False), ("SameIndividual(:home :house)", True), ("DisjointClasses(:World :Void)", True), ("EquivalentClasses(:World :Void)", False),
    ("ObjectPropertyDomain(:lies :Thing1)", True), ("SubClassOf(ObjectIntersectionOf(:World :Void) owl:Nothing)", True),
]


@register("SELECT * FROM (VALUES " + ", ".join(f"('{a}', {str(v).lower()})" for a, v in ENTAILMENTS) + ") t(axiom, entailed)")
def entailment_cases(spark, d):
    """Entailments of several kinds from one document, by rules, completion or refutation."""
    edges = document(spark, d)
    text = f"Prefix(:=<{BASE}>) Ontology(" + " ".join(f"SubClassOf(:{a} :{b}) SubClassOf(:{b} :World)" for a, b in edges)
    text += " ClassAssertion(:NATION_0 :home) ObjectPropertyAssertion(:lies :home :centre) SubObjectPropertyOf(:lies :within) SameIndividual(:home :house) DisjointClasses(:World :Void) ObjectPropertyDomain(:within :Thing1) SubClassOf(:Void ObjectUnionOf(:Void1 :Void2)))"
    r = Reasoner.of_text(spark, text, seconds=60)
    prefix = f"Prefix(:=<{BASE}>) "
    return spark.createDataFrame([(a, r.entails(prefix + a)) for a, _ in ENTAILMENTS], "axiom string, entailed boolean")


# ---- rules with subclasses and equality --------------------------------------------------------------
@register("SELECT DISTINCT 'customer/' || o_custkey AS ind FROM orders UNION SELECT 'buyer/0' WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = 0)")
def swrl_over_subclasses(spark, d):
    """Order(?x), placedBy(?x, ?y) -> Buyer(?y): only statuses are told, customer 0 has another name."""
    doc = documents.read_text("Prefix(:=<urn:>) DLSafeRule(Body(ClassAtom(:Order Variable(:x)) ObjectPropertyAtom(:placedBy Variable(:x) Variable(:y))) Head(ClassAtom(:Buyer Variable(:y))))")
    from taxoflux.sources.normal import Normal

    rules = swrl.rules_of_axiom(doc.axioms[0], "r", Normal())
    status = src.order_types(spark, d).withColumn("cls", F.concat(F.lit("urn:"), "cls"))
    kinds = status.select(c("cls").alias("sub"), F.lit("urn:Order").alias("sup")).distinct()
    done = materialized(spark, rules, type=status, sub_class=kinds, opa=src.placements(spark, d).withColumn("p", F.lit("urn:placedBy")), same=[("buyer/0", "customer/0")])
    return done.expanded("type").where("cls = 'urn:Buyer'").select("ind").distinct()


# ---- lookups, edits and formats ---------------------------------------------------------------------
def places(spark, d):
    n = Builder()
    for a, b in document(spark, d):
        n.sub_class(a, b)
    return n.sub_property("inNation", "locatedIn").add("domain", "inNation", "Customer").add("inverse", "inNation", "nationOf").build(spark).replace(opa=src.locations(spark, d))


@register("SELECT 'super' AS kind, replace(r_name, ' ', '_') AS value FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_name = 'NATION_4' UNION SELECT 'sub', n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' UNION SELECT 'domain', 'Customer' UNION SELECT 'inverse', 'nationOf' UNION SELECT 'super_property', 'locatedIn' UNION SELECT 'from', 'region/' || n_regionkey FROM nation WHERE n_nationkey = 4 UNION SELECT 'to', 'customer/' || c_custkey FROM customer WHERE c_nationkey = 4 UNION SELECT 'to', 'supplier/' || s_suppkey FROM supplier WHERE s_nationkey = 4 UNION SELECT 'role', 'class'")
def ontology_lookups(spark, d):
    o = places(spark, d)
    parts = {"super": o.super_classes("NATION_4"), "sub": o.sub_classes("ASIA"), "domain": o.domains("inNation"), "inverse": o.inverses("inNation"), "super_property": o.super_properties("inNation"), "from": o.assertions_from("nation/4").select("o"), "to": o.assertions_to("nation/4").select("s"), "role": o.entity("NATION_4").select(F.explode("roles"))}
    out = None
    for kind, rows in parts.items():
        part = rows.select(F.lit(kind).alias("kind"), c(rows.columns[0]).alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


@register(f"SELECT sub AS s, 'rdfs:subClassOf' AS p, sup AS o FROM ({NATIONS}) UNION SELECT 'inNation', 'rdfs:subPropertyOf', 'locatedIn' UNION SELECT 'inNation', 'rdfs:domain', 'Customer' UNION SELECT 'inNation', 'owl:inverseOf', 'nationOf' UNION SELECT s, p, o FROM (WITH {PLACES} SELECT s, p, o FROM opa)")
def export_triples(spark, d):
    return places(spark, d).triples().select("s", "p", "o")


@register(f"WITH {PLACES} SELECT s, p, o FROM opa")
def import_triples(spark, d):
    """Triples read back as relations, each a filter."""
    return Ontology.of_triples(spark, places(spark, d).triples()).relations["opa"]


@register(NATIONS)
def snapshot_round_trip(spark, d):
    o = places(spark, d).replace(opa=spark.createDataFrame([], "s string, p string, o string"))
    return Ontology.from_json(spark, o.to_json()).relations["sub_class"]


@register(f"SELECT sub, sup FROM ({NATIONS}) WHERE sub <> 'NATION_1' UNION SELECT 'NATION_1', 'Elsewhere'")
def axiom_edits(spark, d):
    o = places(spark, d)
    old = [(a, b) for a, b in document(spark, d) if a == "NATION_1"]
    return o.without_rows("sub_class", old).with_rows("sub_class", [("NATION_1", "Elsewhere")]).relations["sub_class"]


@register("SELECT 'both' AS iri")
def punning_conflicts(spark, d):
    return Builder().declare("class", "both", "fine").declare("data_property", "both").declare("individual", "fine").build(spark).punning_conflicts().select("iri")


def in_format(d, spark, kind: str) -> str:
    """The document of regions in a format, with an existential and an intersection beside."""
    edges = document(spark, d)
    if kind == "functional":
        return f"Prefix(:=<{BASE}>) Ontology(<{BASE}o> " + " ".join(f"SubClassOf(:{a} :{b})" for a, b in edges) + " EquivalentClasses(:Coast ObjectIntersectionOf(:World ObjectSomeValuesFrom(:has :Sea))) SubClassOf(:ASIA :Coast))"
    if kind == "owlxml":
        sub = lambda a, b: f"<SubClassOf><Class IRI='{BASE}{a}'/>{b}</SubClassOf>"
        cls = lambda a: f"<Class IRI='{BASE}{a}'/>"
        body = "".join(sub(a, cls(b)) for a, b in edges) + sub("ASIA", cls("Coast"))
        body += f"<EquivalentClasses>{cls('Coast')}<ObjectIntersectionOf>{cls('World')}<ObjectSomeValuesFrom><ObjectProperty IRI='{BASE}has'/>{cls('Sea')}</ObjectSomeValuesFrom></ObjectIntersectionOf></EquivalentClasses>"
        return f"<?xml version='1.0'?><Ontology xmlns='http://www.w3.org/2002/07/owl#' ontologyIRI='{BASE}o'>{body}</Ontology>"
    if kind == "turtle":
        body = " ".join(f":{a} rdfs:subClassOf :{b} ." for a, b in edges) + " :ASIA rdfs:subClassOf :Coast . :Coast owl:equivalentClass [ a owl:Class ; owl:intersectionOf ( :World [ a owl:Restriction ; owl:onProperty :has ; owl:someValuesFrom :Sea ] ) ] ."
        return f"@prefix : <{BASE}> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . @prefix owl: <http://www.w3.org/2002/07/owl#> . {body}"
    sub = lambda a, b: f"<owl:Class rdf:about='{BASE}{a}'><rdfs:subClassOf rdf:resource='{BASE}{b}'/></owl:Class>"
    body = "".join(sub(a, b) for a, b in edges) + sub("ASIA", "Coast")
    body += f"<owl:Class rdf:about='{BASE}Coast'><owl:equivalentClass><owl:Class><owl:intersectionOf rdf:parseType='Collection'><rdf:Description rdf:about='{BASE}World'/><owl:Restriction><owl:onProperty rdf:resource='{BASE}has'/><owl:someValuesFrom rdf:resource='{BASE}Sea'/></owl:Restriction></owl:intersectionOf></owl:Class></owl:equivalentClass></owl:Class>"
    return f"<?xml version='1.0'?><rdf:RDF xmlns:rdf='http://www.w3.org/1999/02/22-rdf-syntax-ns#' xmlns:rdfs='http://www.w3.org/2000/01/rdf-schema#' xmlns:owl='http://www.w3.org/2002/07/owl#'>{body}</rdf:RDF>"


CLASSIFIED = f"SELECT sub, sup FROM ({NATIONS}) UNION SELECT sub, v.x FROM ({NATIONS}) n, (VALUES ('Coast'), ('World')) v(x) WHERE n.sup = 'ASIA' UNION SELECT 'ASIA', 'Coast' UNION SELECT 'ASIA', 'World' UNION SELECT 'Coast', 'World'"


def classified(kind):
    def run(spark, d):
        closed = Reasoner.of_text(spark, in_format(d, spark, kind)).classify().closure
        plain = lambda x: F.regexp_replace(x, f"^{BASE}", "").alias(x)
        return closed.select(plain("sub"), plain("sup"))

    run.__name__ = f"load_{kind}"
    run.__doc__ = f"A document in {kind} syntax, found by how it begins, read and classified."
    return run


for _kind in ("functional", "owlxml", "turtle", "rdfxml"):
    register(CLASSIFIED)(classified(_kind))


@register("SELECT n_name AS sub FROM nation WHERE n_nationkey <> 0")
def lenient_load(spark, d):
    """An unreadable axiom in the middle is skipped and what follows it is kept."""
    edges = [e for e in document(spark, d) if e[0] != "NATION_0"]
    text = "Prefix(:=<urn:>) Ontology(" + " ".join(f"SubClassOf(:{a} :{b})" if i != 5 else f"SubClassOf(unknown:x (:y) Nonsense(:z)) SubClassOf(:{a} :{b})" for i, (a, b) in enumerate(edges)) + ")"
    doc = documents.read_text(text, lenient=True)
    return spark.createDataFrame([(a[1].removeprefix("urn:"),) for a in doc.axioms], "sub string")


# ---- increments, explanations, traces ----------------------------------------------------------------
@register(f"WITH RECURSIVE {BRANDS}, more AS (SELECT sub, sup FROM edges UNION SELECT 'Part', 'Goods' UNION SELECT 'Goods', 'Things'), up AS (SELECT sub, sup FROM more UNION SELECT u.sub, e.sup FROM up u JOIN more e ON u.sup = e.sub) SELECT sub, sup FROM up")
def incremental_session(spark, d):
    """A reasoner's closure kept up over two edits, each deriving only what it adds."""
    o = Ontology.empty(spark).replace(sub_class=src.brand_hierarchy(spark, d))
    r = Reasoner(o)
    r.told_closure()
    for rows in ([("Part", "Goods")], [("Goods", "Things")]):
        r.edit(r.ontology.with_rows("sub_class", rows))
        r.told_closure()
    return r.told_closure()


@register(f"WITH RECURSIVE {BRANDS}, left_over AS (SELECT sub, sup FROM edges WHERE NOT (sub = 'BrandGroup_1' AND sup = 'Part')), up AS (SELECT sub, sup FROM left_over UNION SELECT u.sub, e.sup FROM up u JOIN left_over e ON u.sup = e.sub) SELECT sub, sup FROM up")
def incremental_removal(spark, d):
    edges, scratch = src.brand_hierarchy(spark, d), Scratch(spark)
    return incremental.removed_closure(edges, spark.createDataFrame([("BrandGroup_1", "Part")], "sub string, sup string"), graphs.closure(edges, scratch), scratch)


@register(f"WITH {BRANDS}, {PTYPES} SELECT ind, cls, true AS asserted FROM types UNION SELECT t.ind, e.sup, false FROM types t JOIN edges e ON t.cls = e.sub UNION SELECT t.ind, 'Part', false FROM types t")
def asserted_and_inferred(spark, d):
    """Types told, and types that a rule gave, by the fixpoint's trace."""
    from taxoflux.plans.fixpoint import fixpoint

    scratch = Scratch(spark)
    rules = [r for r in rl.ABOX_RULES if r.name == "type_subclass"]
    done = fixpoint({"type": src.part_types(spark, d), "sub_class": graphs.closure(src.brand_hierarchy(spark, d), scratch)}, rules, scratch, trace=True)
    return done.trace["type"].select("ind", "cls", (c("round") == 0).alias("asserted"))


@register(f"WITH {BRANDS} SELECT sub, sup, 1::BIGINT AS steps FROM edges WHERE sub = 'BrandGroup_3' UNION SELECT sub, 'Part', 2 FROM edges WHERE sup = 'BrandGroup_3'")
def explain_proofs(spark, d):
    """Lengths of the shortest proofs of a group's classes."""
    proofs = explain.shortest_proofs(src.brand_hierarchy(spark, d), Scratch(spark)).select("sub", "sup", "steps")
    below = src.brand_hierarchy(spark, d).where("sup = 'BrandGroup_3'").select("sub")
    return proofs.where("sub = 'BrandGroup_3'").unionByName(proofs.where("sup = 'Part'").join(below, "sub", "left_semi"))


@register("WITH RECURSIVE e AS (SELECT n_nationkey::BIGINT AS s, ((n_nationkey * 2 + 1) % 25)::BIGINT AS o FROM nation), t AS (SELECT 3::BIGINT AS node UNION SELECT e.o FROM t JOIN e ON e.s = t.node) SELECT 3::BIGINT AS seed, node FROM t")
def path_existence(spark, d):
    """What a transitive property reaches from one given individual."""
    return graphs.reachable(src.neighbours(spark, d, 2, 1).select("s", "o"), spark.createDataFrame([(3,)], "seed bigint"), Scratch(spark))


# ---- values -----------------------------------------------------------------------------------------
@register("SELECT p_partkey, true AS padded, true AS as_decimal, false AS as_string, p_size = 1 AS one FROM part")
def datatype_equality(spark, d):
    rows = table(spark, d, "part").select("p_partkey", c("p_size").cast("string").alias("x"))
    same = lambda y, kind: dt.equal(c("x"), F.lit("integer"), y, F.lit(kind))
    return rows.select("p_partkey", same(F.concat(F.lit("00"), "x"), "int").alias("padded"), same(F.concat("x", F.lit(".0")), "decimal").alias("as_decimal"), same(c("x"), "string").alias("as_string"), same(F.lit("+1"), "integer").alias("one"))


@register("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01 00:00:00' AND o_orderdate < TIMESTAMP '1998-06-01 00:00:00'")
def facet_datetime(spark, d):
    """dateTime facets; the session's time zone plays no part, as all have zones."""
    r = dt.Range(datatype="dateTime", facets=(("minInclusive", "1997-01-01T00:00:00Z"), ("maxExclusive", "1998-06-01T02:00:00+02:00")))
    orders = table(spark, d, "orders").select("o_orderkey", F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")).alias("x"))
    return orders.where(dt.matches(c("x"), r)).select("o_orderkey")


@register("SELECT p_partkey FROM part WHERE length(p_name) >= 8 AND length(p_name) <= 11 AND regexp_full_match(p_brand, 'Brand#[1-3]') AND p_type <> 'ECONOMY'")
def facet_strings(spark, d):
    """Length and pattern facets, and the complement of an enumeration."""
    name, brand = dt.Range(facets=(("minLength", "8"), ("maxLength", "11"))), dt.Range(facets=(("pattern", "Brand#[1-3]"),))
    other = ~dt.Range("one_of", values=("ECONOMY",))
    return table(spark, d, "part").where(dt.matches(c("p_name"), name) & dt.matches(c("p_brand"), brand) & dt.matches(c("p_type"), other)).select("p_partkey")


@register("SELECT DISTINCT p_size AS low, CASE WHEN 40 - p_size > 0 THEN 40 - p_size ELSE 0 END::DOUBLE AS n, 40 - p_size >= 5 AS five FROM part")
def range_counting(spark, d):
    """How many integers lie in [low, 40), and whether five do."""
    sizes = [r[0] for r in table(spark, d, "part").select("p_size").distinct().collect()]  # at most fifty
    ranges = {x: dt.Range(datatype="integer", facets=(("minInclusive", str(x)), ("maxExclusive", "40"))) for x in sizes}
    return spark.createDataFrame([(x, float(dt.interval(r).count()), dt.satisfiable(r, 5)) for x, r in ranges.items()], "low int, n double, five boolean")


# ---- aggregates over inferred facts ------------------------------------------------------------------
@register(f"WITH RECURSIVE {BRANDS}, {UP}, {PTYPES}, every AS (SELECT ind, cls FROM types UNION SELECT t.ind, u.sup FROM types t JOIN up u ON t.cls = u.sub), n AS (SELECT cls, count(DISTINCT ind)::BIGINT AS n FROM every GROUP BY cls) SELECT cls, n, row_number() OVER (ORDER BY n DESC, cls)::INT AS place FROM n ORDER BY n DESC, cls LIMIT 5")
def largest_classes(spark, d):
    """The five classes with the most members, in order."""
    every = query.types_of(src.part_types(spark, d), graphs.closure(src.brand_hierarchy(spark, d), Scratch(spark)))
    top = every.groupBy("cls").agg(F.count_distinct("ind").alias("n")).orderBy(F.desc("n"), "cls").limit(5)
    from pyspark.sql import Window

    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "cls")))


@register("SELECT 'customer/' || o_custkey AS ind, year(o_orderdate)::INT AS year, upper(substr(o_orderpriority, 3)) AS priority, count(*)::BIGINT AS n FROM orders GROUP BY ALL")
def facts_by_year(spark, d):
    """Roll-up of facts with date and string functions."""
    return table(spark, d, "orders").groupBy(src.ident("customer", "o_custkey").alias("ind"), F.year("o_orderdate").alias("year"), F.upper(F.substring("o_orderpriority", 3, 99)).alias("priority")).agg(F.count("*").alias("n"))


@register("SELECT 'event/' || event_id AS s, 'k' AS p, json_extract_string(props, '$.k') AS lexical FROM events")
def facts_from_json(spark, d):
    """Data values inside JSON as facts."""
    return table(spark, d, "events").select(src.ident("event", "event_id").alias("s"), F.lit("k").alias("p"), F.get_json_object("props", "$.k").alias("lexical"))


@register("SELECT * FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type AS cls, count(*)::BIGINT AS n FROM events GROUP BY 1, 2) WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)")
def stream_windowed_counts(spark, d):
    """Events as a stream, counted per class and hour; a window is given once the watermark has passed its end."""
    stream = abox.event_stream(spark, d).select(c("ts").cast("timestamp").alias("ts"), c("event_type").alias("cls"))
    scratch = Scratch(spark)
    return abox.run_to_end(abox.windowed_counts(stream), f"{scratch.root}/windows").withColumn("start", c("start").cast("timestamp_ntz"))


# ---- the property hierarchy ---------------------------------------------------------------------------
PROPERTY_ROWS = ", ".join(f"('{a}', '{b}')" for a, b in src.PROPERTIES)


@register(f"WITH RECURSIVE edges AS (SELECT * FROM (VALUES {PROPERTY_ROWS}, ('nationOf', 'contains')) t(sub, sup)), {UP} SELECT sub, sup FROM up")
def property_taxonomy(spark, d):
    """The object properties classified, named inverses too."""
    o = Ontology.empty(spark).with_rows("sub_prop", src.PROPERTIES).with_rows("inverse", [("inNation", "nationOf"), ("locatedIn", "contains")])
    return Reasoner(o).classify_properties()


@register("SELECT * FROM (VALUES ('t', 'irregular'), ('u', 'irregular'), ('far', 'not simple: functional'), ('above', 'not simple: at_most')) v(p, problem)")
def property_restrictions(spark, d):
    """Chains that no order of properties allows, and composite properties where only simple ones may stand."""
    o = Ontology.empty(spark).with_rows("chain", [("r", "u", "t"), ("r", "t", "u"), ("near", "near", "far"), ("own", "r", "own")]).with_rows("sub_prop", [("far", "above")])
    o = o.with_rows("prop_char", [("far", "functional"), ("near", "functional")]).with_rows("at_most", [("A", "above", "1", rl.THING), ("A", "near", "1", rl.THING)])
    return Reasoner(o).global_restrictions()


@register("SELECT 'onlyOf_' || n_nationkey AS sub, 'inRegion' AS sup FROM nation UNION SELECT 'onlyOf_' || n_nationkey, 'within' FROM nation")
def endpoint_subsumption(spark, d):
    """A property of one possible pair is below every property that links the pair; paths of transitive ones count."""
    places = src.locations(spark, d).where("p = 'inRegion'")
    done = materialized(spark, opa=places, sub_prop=[("inRegion", "within")], prop_char=[("within", "transitive")])
    endpoints = places.select(F.regexp_replace("s", "nation/", "onlyOf_").alias("p"), "s", "o")
    return roles.by_endpoints(endpoints, done.relations["opa"])


@register("SELECT DISTINCT 'Made_' || p_type AS sub, 'MadeSomehow' AS sup FROM part")
def definition_subsumption(spark, d):
    """Classes defined by an existential, compared through the closed hierarchies of properties and fillers."""
    kinds = table(spark, d, "part").select("p_type").distinct()
    definitions = kinds.select(F.concat(F.lit("Made_"), "p_type").alias("cls"), F.lit("madeAs").alias("p"), c("p_type").alias("filler")).unionByName(src.constants(spark, [("MadeSomehow", "relatesTo", "Method")], "cls string, p string, filler string"))
    return roles.by_definitions(definitions, kinds.select(c("p_type").alias("sub"), F.lit("Method").alias("sup")), src.constants(spark, [("madeAs", "relatesTo")], "sub string, sup string"))


@register("SELECT 'nation/' || n_nationkey AS s, 'owl:bottomObjectProperty' AS p FROM nation WHERE n_regionkey = 3")
def clash_bottom_chain(spark, d):
    """A chain below the bottom property: each witness is a clash."""
    text = "Prefix(:=<urn:>) SubObjectPropertyOf(ObjectPropertyChain(:inRegion :closed) owl:bottomObjectProperty)"
    from taxoflux.sources.normal import relations

    rows, _ = relations(documents.read_text(text).axioms)
    opa = src.locations(spark, d).where("p = 'inRegion'").withColumn("p", F.lit("urn:inRegion")).unionByName(spark.createDataFrame([("region/3", "urn:closed", "closed/1")], "s string, p string, o string"))
    o = Ontology.of_rows(spark, rows).replace(opa=opa)
    return Reasoner(o).clashes().where("kind = 'nothing'").select(c("a").alias("s"), F.lit("owl:bottomObjectProperty").alias("p"))


# ---- modules ------------------------------------------------------------------------------------------
def region_axioms(spark, d):
    rows = table(spark, d, "nation").join(table(spark, d, "region"), c("n_regionkey") == c("r_regionkey")).select(F.concat_ws("<", "n_name", "r_name").alias("axiom"), F.array("n_name", "r_name").alias("entities"))
    return rows, profile.signature(rows)


@register("SELECT n_name || '<' || r_name AS axiom, CASE WHEN r_name = 'ASIA' THEN 'dl' ELSE 'el' END AS engine FROM nation JOIN region ON n_regionkey = r_regionkey")
def partition_axioms(spark, d):
    """One axiom outside EL makes its whole module the tableau's; the others stay with completion."""
    rows, signature = region_axioms(spark, d)
    return profile.partition(signature, rows.where("axiom like '%<ASIA'").orderBy("axiom").limit(1), Scratch(spark))


@register("SELECT n_name || '<' || r_name AS axiom FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_regionkey = (SELECT n_regionkey FROM nation WHERE n_name = 'NATION_4')")
def subontology(spark, d):
    rows, signature = region_axioms(spark, d)
    return profile.subontology(rows.select("axiom"), signature, spark.createDataFrame([("NATION_4",)], "entity string"), Scratch(spark))


@register("SELECT 'customer/' || c_custkey AS ind, 'Located' AS cls FROM customer UNION SELECT 'supplier/' || s_suppkey, 'Located' FROM supplier UNION SELECT 'nation/' || n_nationkey, 'Located' FROM nation")
def rl_incremental(spark, d):
    """Facts added to a materialisation: only what follows from the new ones is derived."""
    places = src.locations(spark, d)
    o = Ontology.empty(spark).with_rows("sub_prop", [("inNation", "locatedIn"), ("inRegion", "locatedIn")]).with_rows("domain", [("locatedIn", "Located")])
    r = Reasoner(o.replace(opa=places.where("not startswith(s, 'customer/')")))
    r.materialize()
    return r.extend(opa=places.where("startswith(s, 'customer/')")).relations["type"]


# ---- data restrictions ----------------------------------------------------------------------------------
_int = lambda facet, n: f'DatatypeRestriction(xsd:int xsd:{facet} "{n}"^^xsd:int)'
DATA_CASES = [
    ("bounds", f"SubClassOf(:X DataSomeValuesFrom(:p {_int('minInclusive', 5)})) SubClassOf(:X DataAllValuesFrom(:p {_int('maxExclusive', 5)}))", True),
    ("touching", f"SubClassOf(:X DataSomeValuesFrom(:p {_int('minInclusive', 5)})) SubClassOf(:X DataAllValuesFrom(:p {_int('maxInclusive', 5)}))", False),
    ("families", "SubClassOf(:X DataSomeValuesFrom(:p xsd:string)) SubClassOf(:X DataAllValuesFrom(:p xsd:integer))", True),
    ("derived", "SubClassOf(:X DataSomeValuesFrom(:p xsd:byte)) SubClassOf(:X DataAllValuesFrom(:p xsd:integer))", False),
    ("subproperty", "SubDataPropertyOf(:p :q) SubClassOf(:X DataSomeValuesFrom(:p xsd:string)) SubClassOf(:X DataAllValuesFrom(:q xsd:integer))", True),
    ("superclass", "SubClassOf(:X :Y) SubClassOf(:Y DataAllValuesFrom(:p xsd:integer)) SubClassOf(:X DataHasValue(:p \"a\"))", True),
    ("functional", "FunctionalDataProperty(:p) SubClassOf(:X DataHasValue(:p \"1\"^^xsd:int)) SubClassOf(:X DataHasValue(:p \"2\"^^xsd:int))", True),
    ("functional_equal", "FunctionalDataProperty(:p) SubClassOf(:X DataHasValue(:p \"1\"^^xsd:int)) SubClassOf(:X DataHasValue(:p \"1.0\"^^xsd:decimal))", False),
    ("enumeration", "SubClassOf(:X DataSomeValuesFrom(:p DataOneOf(\"1\"^^xsd:int \"2\"^^xsd:int))) SubClassOf(:X DataAllValuesFrom(:p DataComplementOf(DataOneOf(\"1\"^^xsd:int \"2\"^^xsd:int))))", True),
    ("min_max", "SubClassOf(:X DataMinCardinality(3 :p)) SubClassOf(:X DataMaxCardinality(2 :p))", True),
    ("union", "SubClassOf(:X DataSomeValuesFrom(:p DataUnionOf(xsd:string xsd:int))) SubClassOf(:X DataAllValuesFrom(:p xsd:integer))", False),
]


@register("SELECT * FROM (VALUES " + ", ".join(f"('{k}', {str(v).lower()})" for k, _, v in DATA_CASES) + ") t(name, unsatisfiable)")
def data_restrictions(spark, d):
    """Classes whose data restrictions leave no value, by interval arithmetic over the told hierarchy."""
    from taxoflux.sources.normal import relations

    out = []
    for name, axioms, _ in DATA_CASES:
        rows, _ = relations(documents.read_text(f"Prefix(:=<urn:>) Prefix(xsd:=<http://www.w3.org/2001/XMLSchema#>) Ontology({axioms})").axioms)
        out.append((name, ("urn:X", el.NOTHING) in rows.get("sub_class", [])))
    return spark.createDataFrame(out, "name string, unsatisfiable boolean")


# ---- proofs ---------------------------------------------------------------------------------------------
@register(f"SELECT DISTINCT 1 AS step, p_brand AS sub, {GROUP} AS sup FROM part WHERE p_brand = 'Brand#7' UNION SELECT DISTINCT 2, {GROUP}, 'Part' FROM part WHERE p_brand = 'Brand#7'")
def explain_steps(spark, d):
    """The told axioms of a shortest proof, in order, read back from its JSON."""
    found = json.loads(Reasoner(Ontology.empty(spark).replace(sub_class=src.brand_hierarchy(spark, d))).explain("Brand#7", "Part", "json"))
    return spark.createDataFrame([(i, *s["axiom"][1:]) for i, s in enumerate(found["steps"], 1)], "step int, sub string, sup string")
