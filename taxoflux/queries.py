"""Registered reasoning queries over the shared tables, and DuckDB SQL that gives the same rows."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxoflux.functions import datatypes as dt
from taxoflux.ontology import Ontology, ddl
from taxoflux.operators import checks, el, graphs, incremental, profile, query, rl, swrl
from taxoflux.operators import explain as explaining
from taxoflux.plans.fixpoint import fixpoint
from taxoflux.plans.scratch import Scratch, table
from taxoflux.reasoner import Reasoner
from taxoflux.sources import tables as src
from taxoflux.streaming import abox

c = F.col
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


# ---- SQL fragments shared by the oracles -------------------------------------------------------
GROUP = "'BrandGroup_' || ((substr(p_brand, 7)::INT % 5)::VARCHAR)"
BRANDS = f"edges AS (SELECT p_brand AS sub, {GROUP} AS sup FROM part UNION SELECT {GROUP}, 'Part' FROM part UNION SELECT p_type, 'Part' FROM part)"
UP = "up AS (SELECT sub, sup FROM edges UNION SELECT u.sub, e.sup FROM up u JOIN edges e ON u.sup = e.sub)"
PTYPES = "types AS (SELECT 'part/' || p_partkey AS ind, p_brand AS cls FROM part UNION SELECT 'part/' || p_partkey, p_type FROM part)"
PROPS = "edges AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in src.PROPERTIES) + ") t(sub, sup) UNION SELECT 'did_' || event_type, 'did' FROM events UNION SELECT 'did', 'linked')"
PLACES = "opa AS (SELECT 'nation/' || n_nationkey AS s, 'inRegion' AS p, 'region/' || n_regionkey AS o FROM nation UNION SELECT 'customer/' || c_custkey, 'inNation', 'nation/' || c_nationkey FROM customer UNION SELECT 'supplier/' || s_suppkey, 'inNation', 'nation/' || s_nationkey FROM supplier)"
LINES = "opa AS (SELECT 'order/' || l_orderkey AS s, 'hasPart' AS p, 'part/' || l_partkey AS o FROM lineitem UNION SELECT 'order/' || l_orderkey, 'suppliedBy', 'supplier/' || l_suppkey FROM lineitem)"
TEXTS = "texts AS (SELECT doc_id AS doc, md5(text) AS content, lang, source, min(doc_id) OVER (PARTITION BY text) AS rep FROM documents WHERE text IS NOT NULL)"


def props(spark, d):
    return src.constants(spark, src.PROPERTIES, "sub string, sup string").unionByName(src.event_properties(spark, d))


# ---- hierarchy closures ---------------------------------------------------------------------------
@register(f"WITH RECURSIVE {BRANDS}, {UP} SELECT sub, sup FROM up")
def rdfs_subclass_closure(spark, d):
    return graphs.closure(src.brand_hierarchy(spark, d), Scratch(spark))


@register(f"WITH RECURSIVE {PROPS}, {UP} SELECT sub, sup FROM up")
def rdfs_subproperty_closure(spark, d):
    return graphs.closure(props(spark, d), Scratch(spark))


DOMAINS = [("linked", "Thing"), ("did", "Person"), ("relatesTo", "Order"), ("locatedIn", "Place")]
DOMAIN_SQL = "dom AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in DOMAINS) + ") t(p, c))"


@register(f"WITH RECURSIVE {PROPS}, {UP}, {DOMAIN_SQL} SELECT p, c FROM dom UNION SELECT u.sub, d.c FROM up u JOIN dom d ON u.sup = d.p")
def rdfs_domain_inherit(spark, d):
    return rl.inherit(src.constants(spark, DOMAINS, "p string, c string"), graphs.closure(props(spark, d), Scratch(spark)))


@register(f"WITH RECURSIVE {PROPS}, {UP}, {DOMAIN_SQL}, rng AS (SELECT p, c || 'Range' AS c FROM dom) SELECT p, c FROM rng UNION SELECT u.sub, d.c FROM up u JOIN rng d ON u.sup = d.p")
def rdfs_range_inherit(spark, d):
    ranges = src.constants(spark, [(p, x + "Range") for p, x in DOMAINS], "p string, c string")
    return rl.inherit(ranges, graphs.closure(props(spark, d), Scratch(spark)))


# ---- instance rules -------------------------------------------------------------------------------
def run_rules(spark, names, **relations):
    """The named instance rules alone, to their fixpoint."""
    rules = [r for r in rl.ABOX_RULES if r.name in names]
    empty = {"type": "ind string, cls string", "opa": "s string, p string, o string"}
    for head in {r.head for r in rules}:
        relations.setdefault(head, spark.createDataFrame([], empty.get(head)))
    return fixpoint(relations, rules, Scratch(spark)).relations


@register("SELECT DISTINCT 'order/' || o_orderkey AS ind, 'Order' AS cls FROM orders")
def rl_type_domain(spark, d):
    return run_rules(spark, {"type_domain"}, opa=src.placements(spark, d), domain=src.constants(spark, [("placedBy", "Order")], "p string, c string"))["type"]


@register("SELECT DISTINCT 'customer/' || o_custkey AS ind, 'Customer' AS cls FROM orders")
def rl_type_range(spark, d):
    return run_rules(spark, {"type_range"}, opa=src.placements(spark, d), range=src.constants(spark, [("placedBy", "Customer")], "p string, c string"))["type"]


@register(f"WITH RECURSIVE {BRANDS}, {UP}, {PTYPES} SELECT ind, cls FROM types UNION SELECT t.ind, u.sup FROM types t JOIN up u ON t.cls = u.sub")
def rl_type_subclass(spark, d):
    return query.types_of(src.part_types(spark, d), graphs.closure(src.brand_hierarchy(spark, d), Scratch(spark))).distinct()


@register(f"WITH RECURSIVE {LINES}, {PROPS}, {UP} SELECT s, p, o FROM opa UNION SELECT x.s, u.sup AS p, x.o FROM opa x JOIN up u ON x.p = u.sub")
def rl_prop_sub(spark, d):
    return run_rules(spark, {"prop_sub"}, opa=src.line_relations(spark, d), sub_prop=graphs.closure(props(spark, d), Scratch(spark)))["opa"]


@register("SELECT 'order/' || o_orderkey AS s, 'placedBy' AS p, 'customer/' || o_custkey AS o FROM orders UNION SELECT 'customer/' || o_custkey, 'placed', 'order/' || o_orderkey FROM orders")
def rl_prop_inverse(spark, d):
    both = src.constants(spark, [("placedBy", "placed"), ("placed", "placedBy")], "p string, q string")
    return run_rules(spark, {"prop_inverse"}, opa=src.placements(spark, d), inverse=both)["opa"]


@register("WITH e AS (SELECT n_nationkey::BIGINT AS s, 'near' AS p, ((n_nationkey + 1) % 25)::BIGINT AS o FROM nation) SELECT s, p, o FROM e UNION SELECT o, p, s FROM e")
def rl_prop_symmetric(spark, d):
    return run_rules(spark, {"prop_symmetric"}, opa=src.neighbours(spark, d), symmetric=src.constants(spark, [("near",)], "p string"))["opa"]


@register(f"WITH RECURSIVE {PLACES}, l AS (SELECT s, o FROM opa), t AS (SELECT s, o FROM l UNION SELECT t.s, l.o FROM t JOIN l ON t.o = l.s) SELECT s, 'locatedIn' AS p, o FROM t")
def rl_prop_transitive(spark, d):
    located = src.locations(spark, d).select("s", F.lit("locatedIn").alias("p"), "o")
    return run_rules(spark, {"prop_transitive"}, opa=located, transitive=src.constants(spark, [("locatedIn",)], "p string"))["opa"]


@register("SELECT 'supplier/' || s_suppkey AS s, 'knows' AS p, 'supplier/' || s_suppkey AS o FROM supplier UNION SELECT 'nation/' || s_nationkey, 'knows', 'nation/' || s_nationkey FROM supplier")
def rl_prop_reflexive(spark, d):
    """A reflexive property links every individual that any fact names with itself."""
    o = Ontology.empty(spark).with_rows("prop_char", [("knows", "reflexive")]).replace(opa=src.locations(spark, d).where(c("s").startswith("supplier/")))
    return rl.materialize(o.relations, Scratch(spark)).relations["opa"].where("p = 'knows'")


@register("WITH RECURSIVE e AS (SELECT conv_id AS conv, turn AS s, turn + 1 AS o FROM conversations a WHERE EXISTS (SELECT 1 FROM conversations b WHERE b.conv_id = a.conv_id AND b.turn = a.turn + 1)), t AS (SELECT conv, s, o FROM e UNION SELECT t.conv, t.s, e.o FROM t JOIN e ON t.conv = e.conv AND t.o = e.s) SELECT conv, s, o FROM t")
def turn_order_closure(spark, d):
    """A transitive property closed inside each conversation."""
    return graphs.closure(src.turns(spark, d), Scratch(spark), "s", "o", by=("conv",))


# ---- equality -------------------------------------------------------------------------------------
def copies(spark, d):
    """(a, b): each document tied to the first of its text."""
    t = src.texts(spark, d)
    first = t.groupBy("content").agg(F.min("doc").alias("a"))
    return t.join(first, "content").where("doc <> a").select("a", c("doc").alias("b"))


@register(f"WITH {TEXTS}, n AS (SELECT rep FROM texts GROUP BY rep HAVING count(DISTINCT doc) > 1) SELECT doc AS node, rep FROM texts WHERE rep IN (SELECT rep FROM n)")
def rl_sameas_clusters(spark, d):
    return graphs.components(copies(spark, d), Scratch(spark))


@register(f"WITH {TEXTS} SELECT DISTINCT a.doc AS ind, b.source AS cls FROM texts a JOIN texts b ON a.rep = b.rep WHERE b.source IS NOT NULL")
def rl_sameas_types(spark, d):
    scratch = Scratch(spark)
    reps = scratch.save(graphs.components(copies(spark, d), scratch))
    types = src.texts(spark, d).where("source is not null").select(c("doc").alias("ind"), c("source").alias("cls"))
    return rl.expand(rl.to_representatives(types, reps, ["ind"]), reps, ["ind"])


@register(f"WITH {TEXTS} SELECT DISTINCT rep AS a, doc AS b FROM texts WHERE doc <> rep")
def rl_functional_sameas(spark, d):
    opa = src.texts(spark, d).select(c("content").alias("s"), F.lit("textOf").alias("p"), c("doc").alias("o"))
    return rl.functional_same(opa, src.constants(spark, [("textOf", "functional")], "p string, kind string"))


@register(f"WITH {TEXTS} SELECT DISTINCT rep AS a, doc AS b FROM texts WHERE doc <> rep")
def rl_inverse_functional(spark, d):
    opa = src.texts(spark, d).select(c("doc").alias("s"), F.lit("hasText").alias("p"), c("content").alias("o"))
    chars = src.constants(spark, [("hasText", "inverse_functional")], "p string, kind string")
    return rl.functional_same(opa, chars, ("inverse_functional",))


@register("WITH k AS (SELECT c_custkey AS ind, c_nationkey, c_mktsegment, floor(c_acctbal / 100)::BIGINT AS band FROM customer), m AS (SELECT *, min(ind) OVER (PARTITION BY c_nationkey, c_mktsegment, band) AS a FROM k) SELECT DISTINCT a, ind AS b FROM m WHERE ind <> a")
def rl_haskey_merge(spark, d):
    rows = table(spark, d, "customer").select(c("c_custkey").alias("ind"), "c_nationkey", "c_mktsegment", F.floor(c("c_acctbal") / 100).alias("band"))
    return rl.key_same(rows, ["c_nationkey", "c_mktsegment", "band"])


# ---- clashes --------------------------------------------------------------------------------------
def found(spark, kind, **relations):
    """(a, b) clashes of one kind, of relations materialised together."""
    o = Ontology.empty(spark)
    given = {k: v if isinstance(v, DataFrame) else spark.createDataFrame(v, ddl(k)) for k, v in relations.items()}
    o = o.replace(**given)
    done = rl.materialize(o.relations, Scratch(spark))
    return rl.clashes(done.relations, done.representatives, o.relations["disjoint"]).where(c("kind") == kind).select("a", "b")


@register("SELECT 'order/' || o_orderkey AS a, 'Cheap|Finished' AS b FROM orders WHERE o_orderstatus = 'F' AND o_totalprice < 100000")
def rl_clash_disjoint(spark, d):
    """Orders of a status below a class that is disjoint with cheap ones."""
    cheap = table(spark, d, "orders").where("o_totalprice < 100000").select(src.ident("order", "o_orderkey").alias("ind"), F.lit("Cheap").alias("cls"))
    return found(spark, "disjoint_classes", type=src.order_types(spark, d).unionByName(cheap), sub_class=[("Order_F", "Finished")], disjoint=[("Cheap", "Finished")])


@register(f"WITH {TEXTS} SELECT DISTINCT rep::VARCHAR AS a, doc::VARCHAR AS b FROM texts WHERE doc <> rep AND source IS DISTINCT FROM (SELECT x.source FROM texts x WHERE x.doc = texts.rep LIMIT 1)")
def rl_clash_same_different(spark, d):
    """Documents of different sources are said to differ, yet equal texts make them the same."""
    t = src.texts(spark, d)
    pairs = copies(spark, d)
    a = t.select(c("doc").alias("a"), c("source").alias("source_a"))
    b = t.select(c("doc").alias("b"), c("source").alias("source_b"))
    different = pairs.join(a, "a").join(b, "b").where(~c("source_a").eqNullSafe(c("source_b"))).select(c("a").cast("string"), c("b").cast("string")).distinct()
    return found(spark, "same_different", same=pairs.select(c("a").cast("string"), c("b").cast("string")), different=different)


@register("SELECT DISTINCT n_nationkey::BIGINT AS s, 'near' AS p FROM nation WHERE (n_nationkey * 3 + 2) % 25 = n_nationkey")
def rl_clash_irreflexive(spark, d):
    return checks.self_loops(src.neighbours(spark, d, 3, 2), src.constants(spark, [("near",)], "p string"))


@register("WITH e AS (SELECT n_nationkey::BIGINT AS s, ((n_nationkey * 24 + 7) % 25)::BIGINT AS o FROM nation) SELECT DISTINCT e.s, 'near' AS p, e.o FROM e JOIN e f ON e.s = f.o AND e.o = f.s WHERE e.s <= e.o")
def rl_clash_asymmetric(spark, d):
    return checks.mutual_pairs(src.neighbours(spark, d, 24, 7), src.constants(spark, [("near",)], "p string"))


@register("SELECT DISTINCT 'order/' || o_orderkey AS s, 'placedBy' AS p, 'customer/' || o_custkey AS o FROM orders WHERE o_orderstatus = 'P' AND o_custkey % 2 = 0")
def rl_neg_assertion_clash(spark, d):
    negative = table(spark, d, "orders").where("o_orderstatus = 'P' and o_custkey % 2 = 0").select(src.ident("order", "o_orderkey").alias("s"), F.lit("placedBy").alias("p"), src.ident("customer", "o_custkey").alias("o"))
    return checks.both_positive_and_negative(src.placements(spark, d), negative)


@register("SELECT 'order/' || l_orderkey AS s, 'suppliedBy' AS p, count(DISTINCT l_suppkey)::BIGINT AS n, 5 AS most FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_suppkey) > 5")
def rl_maxcard_violation(spark, d):
    return checks.max_cardinality(src.line_relations(spark, d), src.constants(spark, [("suppliedBy", 5)], "p string, most int"))


@register("SELECT DISTINCT 'order/' || a.o_orderkey AS ind, 'Order_F' AS cls FROM orders a WHERE o_orderstatus = 'F'")
def check_unsatisfiable_types(spark, d):
    return checks.unsatisfiable_types(src.order_types(spark, d), src.constants(spark, [("Order_F",)], "cls string"))


@register("SELECT 'user/' || user_id AS s, 'lastSeen' AS p, count(DISTINCT event_type)::BIGINT AS n FROM events GROUP BY user_id HAVING count(DISTINCT event_type) > 1")
def check_functional_data(spark, d):
    dpa = table(spark, d, "events").select(F.concat(F.lit("user/"), c("user_id").cast("string")).alias("s"), F.lit("lastSeen").alias("p"), c("event_type").alias("lexical"))
    return checks.functional_data(dpa, src.constants(spark, [("lastSeen",)], "p string"))


@register("SELECT count(*) = 0 AS consistent, true AS complete, max(kind) AS reason FROM (SELECT 'irreflexive' AS kind FROM nation WHERE (n_nationkey * 3 + 2) % 25 = n_nationkey)")
def consistency_verdict(spark, d):
    near = src.neighbours(spark, d, 3, 2).select(c("s").cast("string"), "p", c("o").cast("string"))
    r = Reasoner(Ontology.empty(spark).with_rows("prop_char", [("near", "irreflexive")]).replace(opa=near))
    return spark.createDataFrame([r.consistency()], "consistent boolean, complete boolean, reason string")


# ---- EL classification ----------------------------------------------------------------------------
def el_axioms(spark, d):
    some = table(spark, d, "part").select(c("p_brand").alias("cls"), F.lit("madeAs").alias("p"), c("p_type").alias("filler")).distinct()
    return {
        "told": src.brand_hierarchy(spark, d),
        "some": some,
        "sub_prop": src.constants(spark, [("madeAs", "relatesTo")], "sub string, sup string"),
        "some_lhs": src.constants(spark, [("relatesTo", "Part", "Product")], "p string, filler string, sup string"),
        "domain": src.constants(spark, [("madeAs", "Made")], "p string, c string"),
    }


@register("SELECT DISTINCT p_brand AS x, 'madeAs' AS p, p_type AS y FROM part UNION SELECT DISTINCT p_brand, 'relatesTo', p_type FROM part")
def el_exists_closure(spark, d):
    return el.classify(el_axioms(spark, d), Scratch(spark)).edges.distinct()


@register("SELECT DISTINCT p_brand AS sub, 'Made' AS sup FROM part UNION SELECT DISTINCT p_brand, 'Product' FROM part")
def el_domain_subsumption(spark, d):
    return el.classify(el_axioms(spark, d), Scratch(spark)).closure.where(c("sup").isin("Made", "Product"))


@register("SELECT min(n_nationkey) OVER (PARTITION BY n_nationkey % 5)::BIGINT AS rep, n_nationkey::BIGINT AS member FROM nation")
def el_equivalence_clusters(spark, d):
    """Classes on a cycle are one cluster: each nation's class is below the one five further."""
    cycle = src.neighbours(spark, d, 1, 5).select(c("s").alias("sub"), c("o").alias("sup"))
    return graphs.mutual(graphs.closure(cycle, Scratch(spark)))


@register(f"WITH {BRANDS} SELECT sub, sup FROM edges")
def el_transitive_reduction(spark, d):
    edges = src.brand_hierarchy(spark, d)
    more = edges.select("sub", F.lit("Part").alias("sup"))
    return graphs.reduction(graphs.closure(edges.unionByName(more).distinct(), Scratch(spark)))


@register(f"SELECT DISTINCT p_brand AS cls FROM part WHERE {GROUP} = 'BrandGroup_1' AND substr(p_brand, 7)::INT > 10")
def el_unsat_classes(spark, d):
    """Brands of group 1 above 10 are also put below a class disjoint with the group."""
    rel = el_axioms(spark, d)
    odd = table(spark, d, "part").where("cast(substring(p_brand, 7, 9) as int) > 10").select(c("p_brand").alias("sub"), F.lit("Late").alias("sup")).distinct()
    rel["told"] = rel["told"].unionByName(odd)
    rel["disjoint"] = src.constants(spark, [("Late", "BrandGroup_1")], "a string, b string")
    return el.classify(rel, Scratch(spark)).unsatisfiable


# ---- queries and entailment -----------------------------------------------------------------------
@register(f"WITH RECURSIVE {BRANDS}, {UP}, {PTYPES} SELECT DISTINCT ind FROM types WHERE cls IN (SELECT sub FROM up WHERE sup = 'BrandGroup_2')")
def ql_instances(spark, d):
    return query.instances_of(src.part_types(spark, d), graphs.closure(src.brand_hierarchy(spark, d), Scratch(spark)), "BrandGroup_2")


@register("SELECT 'order/' || o_orderkey AS ind, 'Order_' || o_orderstatus AS cls FROM orders UNION SELECT 'order/' || o_orderkey, 'Order' FROM orders")
def ql_types(spark, d):
    return query.types_of(src.order_types(spark, d), graphs.closure(src.order_hierarchy(spark, d), Scratch(spark)))


@register(f"WITH {BRANDS} SELECT sub FROM edges WHERE sup = 'Part'")
def ql_direct_subclasses(spark, d):
    closed = graphs.closure(src.brand_hierarchy(spark, d), Scratch(spark))
    return graphs.reduction(closed).where("sup = 'Part'").select("sub")


@register("SELECT DISTINCT 'order/' || o_orderkey AS x, 'customer/' || o_custkey AS y FROM orders WHERE o_orderstatus = 'P'")
def ql_conjunctive_2atom(spark, d):
    return query.evaluate("Type(?x, Order_P), placedBy(?x, ?y)", {"type": src.order_types(spark, d), "opa": src.placements(spark, d)})


@register("SELECT DISTINCT 'order/' || o_orderkey AS x, 'customer/' || o_custkey AS y, 'nation/' || c_nationkey AS z FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'O'")
def ql_conjunctive_3atom(spark, d):
    opa = src.placements(spark, d).unionByName(src.locations(spark, d))
    return query.evaluate("Type(?x, Order_O), placedBy(?x, ?y), inNation(?y, ?z)", {"type": src.order_types(spark, d), "opa": opa})


@register(f"WITH RECURSIVE {BRANDS}, {UP}, k AS (SELECT DISTINCT p_brand AS sub, 'BrandGroup_' || (p_size % 5) AS sup FROM part) SELECT k.sub, k.sup, u.sub IS NOT NULL AS entailed FROM k LEFT JOIN up u ON k.sub = u.sub AND k.sup = u.sup")
def entail_batch_subclass(spark, d):
    asked = table(spark, d, "part").select(c("p_brand").alias("sub"), F.concat(F.lit("BrandGroup_"), (c("p_size") % 5).cast("string")).alias("sup")).distinct()
    return query.entailed(asked, graphs.closure(src.brand_hierarchy(spark, d), Scratch(spark)), ["sub", "sup"])


@register(f"SELECT 'part/' || p_partkey AS ind, 'BrandGroup_' || (p_size % 5) AS cls, {GROUP} = 'BrandGroup_' || (p_size % 5) AS entailed FROM part")
def entail_batch_type(spark, d):
    asked = table(spark, d, "part").select(src.ident("part", "p_partkey").alias("ind"), F.concat(F.lit("BrandGroup_"), (c("p_size") % 5).cast("string")).alias("cls"))
    return query.entailed(asked, query.types_of(src.part_types(spark, d), graphs.closure(src.brand_hierarchy(spark, d), Scratch(spark))), ["ind", "cls"])


@register("SELECT DISTINCT 'customer/' || c_custkey AS s, 'linked' AS p, 'nation/' || c_nationkey AS o FROM customer")
def property_values(spark, d):
    up = graphs.closure(props(spark, d), Scratch(spark))
    opa = src.locations(spark, d).where(c("s").startswith("customer/"))
    return query.property_values(opa.join(up, opa["p"] == up["sub"]).select("s", c("sup").alias("p"), "o"), prop="linked")


@register(f"WITH RECURSIVE {PROPS}, {UP} SELECT sub FROM up WHERE sup = 'linked'")
def sub_properties(spark, d):
    return graphs.closure(props(spark, d), Scratch(spark)).where("sup = 'linked'").select("sub")


# ---- rules ----------------------------------------------------------------------------------------
def derived(spark, rules, head, **rel):
    done = swrl.apply_rules(rel, rules, Scratch(spark), trace=True)
    return done.trace[head].where("round > 0").select(*rel[head].columns)


@register("SELECT DISTINCT 'customer/' || o_custkey AS ind, 'PartialBuyer' AS cls FROM orders WHERE o_orderstatus = 'P'")
def swrl_two_atom(spark, d):
    rule = "Type(?x, Order_P) & placedBy(?x, ?y) -> Type(?y, PartialBuyer)"
    return derived(spark, {"r": rule}, "type", type=src.order_types(spark, d), opa=src.placements(spark, d))


@register("SELECT DISTINCT 'order/' || o_orderkey AS s, 'shippedTo' AS p, 'nation/' || c_nationkey AS o FROM orders JOIN customer ON o_custkey = c_custkey")
def swrl_join_rule(spark, d):
    rule = "placedBy(?x, ?y) & inNation(?y, ?z) -> shippedTo(?x, ?z)"
    return derived(spark, {"r": rule}, "opa", opa=src.placements(spark, d).unionByName(src.locations(spark, d)))


@register("SELECT DISTINCT 'customer/' || o_custkey AS ind, 'BigBuyer' AS cls FROM orders WHERE o_totalprice >= 300000")
def swrl_data_range(spark, d):
    prices = table(spark, d, "orders").select(src.ident("order", "o_orderkey").alias("s"), F.lit("price").alias("p"), c("o_totalprice").alias("v"))
    rule = "value(?x, price, ?v) & ?v >= 300000 & placedBy(?x, ?y) -> Type(?y, BigBuyer)"
    return derived(spark, {"r": rule}, "type", type=src.order_types(spark, d), opa=src.placements(spark, d), dpa=prices)


@register(f"WITH RECURSIVE {PLACES}, t AS (SELECT s, o FROM opa UNION SELECT t.s, o2.o FROM t JOIN opa o2 ON t.o = o2.s) SELECT s, 'within' AS p, o FROM t")
def swrl_recursive(spark, d):
    rules = {"base": "locatedIn(?x, ?y) -> within(?x, ?y)", "step": "within(?x, ?y) & within(?y, ?z) -> within(?x, ?z)"}
    return derived(spark, rules, "opa", opa=src.locations(spark, d).select("s", F.lit("locatedIn").alias("p"), "o"))


@register("SELECT DISTINCT 'event/' || event_id AS s, 'nation/' || c_nationkey AS o FROM events JOIN customer ON user_id = c_custkey")
def chain_two_step(spark, d):
    done_by = src.events(spark, d).select(c("o").alias("s"), c("s").alias("o"))
    return graphs.chain_step([done_by, src.locations(spark, d).where("p = 'inNation'")])


# ---- datatypes ------------------------------------------------------------------------------------
@register("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 20 AND NOT (l_discount >= 0.05)")
def facet_filter(spark, d):
    quantity = dt.Range(datatype="decimal", facets=(("minInclusive", "10"), ("maxExclusive", "20")))
    discount = ~dt.Range(datatype="decimal", facets=(("minInclusive", "0.05"),))
    lines = table(spark, d, "lineitem")
    rows = lines.select("l_orderkey", "l_linenumber", c("l_quantity").cast("decimal(18,4)").cast("string").alias("q"), c("l_discount").cast("decimal(18,4)").cast("string").alias("x"))
    return rows.where(dt.matches(c("q"), quantity) & dt.matches(c("x"), discount)).select("l_orderkey", "l_linenumber")


@register("SELECT p_partkey, p_size::VARCHAR AS lexical, (p_size BETWEEN -128 AND 127) AS is_byte, (p_size >= 1) AS is_positive, true AS is_integer, p_size::VARCHAR IN ('0', '1') AS is_boolean FROM part")
def datatype_value_space(spark, d):
    rows = table(spark, d, "part").select("p_partkey", c("p_size").cast("string").alias("lexical"))
    kinds = {"is_byte": "byte", "is_positive": "positiveInteger", "is_integer": "integer", "is_boolean": "boolean"}
    return rows.withColumns({k: dt.in_value_space(c("lexical"), v) for k, v in kinds.items()})


# ---- profile, modules, explanation, increments, roll-up, streams -----------------------------------
@register(f"WITH k AS (SELECT 'SubClassOf' AS construct, count(*)::BIGINT AS n FROM (SELECT p_brand, p_type FROM part GROUP BY ALL) UNION ALL SELECT 'ClassAssertion', count(*)::BIGINT FROM orders UNION ALL SELECT 'InverseObjectProperties', count(*)::BIGINT FROM orders) SELECT construct, n, construct = 'InverseObjectProperties' AS outside_el FROM k")
def profile_constructs(spark, d):
    pairs = table(spark, d, "part").select("p_brand", "p_type").distinct()
    return profile.constructs({"SubClassOf": pairs, "ClassAssertion": src.order_types(spark, d), "InverseObjectProperties": src.placements(spark, d)})


@register("SELECT n_nationkey::BIGINT AS node, (n_nationkey % 5)::BIGINT AS rep FROM nation")
def hybrid_components(spark, d):
    """Axioms that share no class fall into modules."""
    links = src.neighbours(spark, d, 1, 5).select(c("s").alias("a"), c("o").alias("b"))
    return graphs.components(links, Scratch(spark))


@register(f"WITH RECURSIVE {BRANDS}, more AS (SELECT sub, sup FROM edges UNION SELECT 'Part', 'Goods'), up AS (SELECT sub, sup FROM more UNION SELECT u.sub, e.sup FROM up u JOIN more e ON u.sup = e.sub), old AS (SELECT sub, sup FROM edges UNION SELECT u.sub, e.sup FROM old u JOIN edges e ON u.sup = e.sub) SELECT sub, sup FROM up EXCEPT SELECT sub, sup FROM old")
def incremental_delta(spark, d):
    scratch = Scratch(spark)
    closed = scratch.save(graphs.closure(src.brand_hierarchy(spark, d), scratch))
    return incremental.added_closure(closed, src.constants(spark, [("Part", "Goods")], "sub string, sup string"), scratch)


@register(f"WITH RECURSIVE {BRANDS}, up AS (SELECT sub, sup, 1 AS n FROM edges UNION SELECT u.sub, e.sup, u.n + 1 FROM up u JOIN edges e ON u.sup = e.sub) SELECT sub, sup, min(n)::BIGINT AS steps FROM up GROUP BY sub, sup")
def explain_first_derivation(spark, d):
    return explaining.shortest_proofs(src.brand_hierarchy(spark, d), Scratch(spark)).select("sub", "sup", "steps")


@register(f"WITH {BRANDS}, n AS (SELECT sub || '<' || sup AS axiom, sub, sup FROM edges) SELECT axiom, sub AS entity FROM n UNION SELECT axiom, sup FROM n")
def axiom_signature(spark, d):
    axioms = src.brand_hierarchy(spark, d).select(F.concat_ws("<", "sub", "sup").alias("axiom"), F.array("sub", "sup").alias("entities"))
    return profile.signature(axioms)


@register(f"WITH RECURSIVE {BRANDS}, {UP}, {PTYPES}, every AS (SELECT ind, cls FROM types UNION SELECT t.ind, u.sup FROM types t JOIN up u ON t.cls = u.sub) SELECT cls, count(DISTINCT ind)::BIGINT AS n FROM every GROUP BY cls")
def taxonomy_rollup_counts(spark, d):
    every = query.types_of(src.part_types(spark, d), graphs.closure(src.brand_hierarchy(spark, d), Scratch(spark)))
    return every.groupBy("cls").agg(F.count_distinct("ind").alias("n"))


@register("SELECT DISTINCT 'event/' || event_id AS ind, 'Event_' || event_type AS cls FROM events UNION SELECT 'event/' || event_id, 'Event' FROM events")
def stream_types(spark, d):
    """Events read as a stream; each micro-batch is joined with the closed hierarchy and appended."""
    return abox.stream_event_types(spark, d, Scratch(spark))


@register("SELECT DISTINCT 'customer/' || c_custkey AS ind, 'Located' AS cls FROM customer UNION SELECT 'supplier/' || s_suppkey, 'Located' FROM supplier UNION SELECT 'nation/' || n_nationkey, 'Located' FROM nation UNION SELECT DISTINCT 'region/' || n_regionkey, 'Region' FROM nation UNION SELECT DISTINCT 'nation/' || c_nationkey, 'Place' FROM customer UNION SELECT DISTINCT 'nation/' || s_nationkey, 'Place' FROM supplier UNION SELECT DISTINCT 'region/' || n_regionkey, 'Place' FROM nation")
def rl_materialize(spark, d):
    """All rules together over places: domains, ranges, subproperties and subclasses."""
    o = Ontology.empty(spark)
    o = o.with_rows("sub_prop", [("inNation", "locatedIn"), ("inRegion", "locatedIn")])
    o = o.with_rows("domain", [("locatedIn", "Located")]).with_rows("range", [("inRegion", "Region")]).with_rows("sub_class", [("Region", "Place")]).with_rows("range", [("locatedIn", "Place")])
    o = o.replace(opa=src.locations(spark, d))
    return rl.materialize(o.relations, Scratch(spark)).relations["type"].distinct()


from taxoflux import queries_reasoner  # noqa: E402, F401  registers what goes through the reasoner and the readers
