"""RDFS and OWL 2 RL materialisation over narrow relations.

TBox closures come first, so that the class and property hierarchy rules need no recursion over instances; what is
left recursive runs in the semi-naive driver.  Equality is handled by representatives: facts are
rewritten to the smallest member of each sameAs cluster and expanded on output, never copied pairwise.
"""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxoflux.functions import datatypes as dt
from taxoflux.operators import checks
from taxoflux.operators.graphs import closure, components
from taxoflux.plans.fixpoint import Diverged, Rule, fixpoint
from taxoflux.plans.scratch import Scratch, is_empty, nothing

c = F.col


def equivalence_edges(equiv: DataFrame, members: str = "members", a: str = "sub", b: str = "sup") -> DataFrame:
    """Mutual edges between the members of each set (eq_class_sub, eq_prop_sub): a ring, whose closure is all pairs."""
    ring = equiv.select(F.arrays_zip(c(members).alias("x"), F.concat(F.slice(c(members), 2, F.greatest(F.size(members) - 1, F.lit(0))), F.slice(c(members), 1, 1)).alias("y")).alias("z"))
    return ring.select(F.explode("z").alias("z")).select(c("z.x").alias(a), c("z.y").alias(b)).where(c(a) != c(b)).distinct()


def inherit(values: DataFrame, sub_prop: DataFrame) -> DataFrame:
    """dom_inherit / rng_inherit: a property has the domains (ranges) of all its superproperties."""
    up = sub_prop.select(c("sub").alias("p"), c("sup").alias("__q")).join(values.select(c("p").alias("__q"), "c"), "__q").select("p", "c")
    return values.select("p", "c").unionByName(up).distinct()


def propagate_characteristics(chars: DataFrame, sub_prop: DataFrame) -> DataFrame:
    """char_propagate: functional, inverse functional, asymmetric and irreflexive go down, reflexive goes up."""
    down = chars.where(c("kind").isin("functional", "inverse_functional", "asymmetric", "irreflexive"))
    down = sub_prop.select(c("sub").alias("__s"), c("sup").alias("p")).join(down, "p").select(c("__s").alias("p"), "kind")
    up = chars.where("kind = 'reflexive'")
    up = sub_prop.select(c("sub").alias("p"), c("sup").alias("__s")).join(up, "p").select(c("__s").alias("p"), "kind")
    return chars.select("p", "kind").unionByName(down).unionByName(up).distinct()


def of_kind(chars: DataFrame, kind: str) -> DataFrame:
    return chars.where(c("kind") == kind).select("p")


def functional_same(opa: DataFrame, chars: DataFrame, kinds: tuple[str, ...] = ("functional", "inverse_functional")) -> DataFrame:
    """prp-fp and prp-ifp: (a, b) that must be equal.  Each group is tied to its smallest value, not pairwise."""
    parts = []
    for kind in kinds:
        key, value = ("s", "o") if kind == "functional" else ("o", "s")
        rows = opa.join(of_kind(chars, kind), "p")
        low = rows.groupBy("p", key).agg(F.min(value).alias("a"))
        parts.append(rows.join(low, ["p", key]).where(c(value) != c("a")).select("a", c(value).alias("b")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()


def key_same(facts: DataFrame, keys: list[str], individual: str = "ind") -> DataFrame:
    """prp-key: individuals with equal values of all key columns, tied to the smallest."""
    rows = facts.dropna(subset=keys)
    low = rows.groupBy(*keys).agg(F.min(individual).alias("a"))
    return rows.join(low, keys).where(c(individual) != c("a")).select("a", c(individual).alias("b")).distinct()


def to_representatives(df: DataFrame, reps: DataFrame, columns: list[str]) -> DataFrame:
    for name in columns:
        r = reps.select(c("node").alias(f"__{name}"), c("rep").alias(f"__rep_{name}"))
        df = df.join(r, c(name) == c(f"__{name}"), "left").withColumn(name, F.coalesce(f"__rep_{name}", name)).drop(f"__{name}", f"__rep_{name}")
    return df.distinct()


def expand(df: DataFrame, reps: DataFrame, columns: list[str]) -> DataFrame:
    """The reverse of to_representatives: every member of a cluster in place of its representative."""
    for name in columns:
        r = reps.select(c("rep").alias(f"__{name}"), c("node").alias(f"__member_{name}"))
        df = df.join(r, c(name) == c(f"__{name}"), "left").withColumn(name, F.coalesce(f"__member_{name}", name)).drop(f"__{name}", f"__member_{name}")
    return df.distinct()


ABOX_RULES = [
    Rule("type_domain", "type", ("opa", "domain"), lambda opa, dom: opa.join(dom, "p").select(c("s").alias("ind"), c("c").alias("cls"))),
    Rule("type_range", "type", ("opa", "range"), lambda opa, rng: opa.join(rng, "p").select(c("o").alias("ind"), c("c").alias("cls"))),
    Rule("type_subclass", "type", ("type", "sub_class"), lambda t, sc: t.join(sc, t["cls"] == sc["sub"]).select("ind", c("sup").alias("cls"))),
    Rule("prop_sub", "opa", ("opa", "sub_prop"), lambda opa, sp: opa.join(sp, opa["p"] == sp["sub"]).select("s", c("sup").alias("p"), "o")),
    Rule("prop_inverse", "opa", ("opa", "inverse"), lambda opa, inv: opa.join(inv, "p").select(c("o").alias("s"), c("q").alias("p"), c("s").alias("o"))),
    Rule("prop_symmetric", "opa", ("opa", "symmetric"), lambda opa, sy: opa.join(sy, "p").select(c("o").alias("s"), "p", c("s").alias("o"))),
    Rule("prop_transitive", "opa", ("opa", "opa", "transitive"), lambda x, y, tr: x.join(tr, "p").select("p", "s", c("o").alias("__m")).join(y.select("p", c("s").alias("__m"), "o"), ["p", "__m"]).select("s", "p", "o")),
    Rule("existential_type", "type", ("opa", "type", "defined_by_some"), lambda opa, t, d: opa.join(d, "p").join(t.select(c("ind").alias("o"), c("cls").alias("filler")), ["o", "filler"]).select(c("s").alias("ind"), "cls")),
    Rule("universal_type", "type", ("type", "opa", "only"), lambda t, opa, d: t.join(d, "cls").select(c("ind").alias("s"), "p", "filler").join(opa, ["s", "p"]).select(c("o").alias("ind"), c("filler").alias("cls"))),
    Rule("has_value", "opa", ("type", "value"), lambda t, v: t.join(v, "cls").select(c("ind").alias("s"), "p", "o")),
    Rule("prop_chain", "opa", ("opa", "opa", "chain"), lambda x, y, k: x.select("s", c("p").alias("first"), c("o").alias("__m")).join(k, "first").join(y.select(c("s").alias("__m"), c("p").alias("second"), "o"), ["__m", "second"]).select("s", c("sup").alias("p"), "o")),
    Rule("has_value_type", "type", ("opa", "defined_by_value"), lambda opa, v: opa.join(v, ["p", "o"]).select(c("s").alias("ind"), "cls")),
    Rule("intersection", "type", ("type", "type", "conjunction"), lambda x, y, k: x.join(k, x["cls"] == k["left"]).select("ind", "right", c("conj").alias("out")).join(y.select("ind", c("cls").alias("right")), ["ind", "right"]).select("ind", c("out").alias("cls"))),
]

#: Every individual gets a fact for each reflexive property, so these must be few; each key is a join of its own.
MAX_REFLEXIVE = MAX_KEYS = 1_000
#: Relations and their columns; all values are of one id type but for literals and lists of members.
SCHEMA = {
    "sub_class": ("sub", "sup"), "equiv_class": ("axiom_id", "members"), "disjoint": ("a", "b"), "sub_prop": ("sub", "sup"), "equiv_prop": ("axiom_id", "members"), "sub_data": ("sub", "sup"), "disjoint_prop": ("a", "b"),
    "domain": ("p", "c"), "range": ("p", "c"), "data_domain": ("p", "c"), "data_range": ("p", "datatype"), "inverse": ("p", "q"), "prop_char": ("p", "kind"), "exists_super": ("cls", "p", "filler"),
    "defined_by_some": ("cls", "p", "filler"), "only": ("cls", "p", "filler"), "value": ("cls", "p", "o"), "defined_by_value": ("cls", "p", "o"), "at_most": ("cls", "p", "most", "filler"), "key": ("cls", "members"),
    "conjunction": ("left", "right", "conj"), "chain": ("first", "second", "sup"), "type": ("ind", "cls"), "neg_type": ("ind", "cls"), "opa": ("s", "p", "o"), "neg_opa": ("s", "p", "o"),
    "dpa": ("s", "p", "lexical", "datatype"), "neg_dpa": ("s", "p", "lexical", "datatype"), "same": ("a", "b"), "different": ("a", "b"),
}
#: Columns that hold individuals.
INDIVIDUALS = {"type": ["ind"], "neg_type": ["ind"], "opa": ["s", "o"], "neg_opa": ["s", "o"], "dpa": ["s"], "neg_dpa": ["s"], "value": ["o"], "defined_by_value": ["o"]}
THING, NOTHING = "owl:Thing", "owl:Nothing"


@dataclass
class Materialization:
    """relations: closed, on representatives; representatives: (node, rep); sub_class and the other TBox relations are closed too."""

    relations: dict[str, DataFrame]
    representatives: DataFrame
    counts: dict[str, int] = field(default_factory=dict)
    rounds: int = 0

    def expanded(self, name: str) -> DataFrame:
        """A relation with every member of a sameAs cluster in place of its representative."""
        return expand(self.relations[name], self.representatives, INDIVIDUALS[name])

    def representative(self, ind: str) -> str:
        found = self.representatives.where(c("node") == ind).select("rep").first()
        return found[0] if found else ind


def close_tbox(rel: dict[str, DataFrame], scratch: Scratch) -> dict[str, DataFrame]:
    """sub_class, sub_prop and sub_data closed (equivalences included), domains and ranges inherited, inverses both ways,
    characteristics spread.  Relations known to be empty stay as they are."""
    out = dict(rel)
    none = lambda *names: all(getattr(rel[n], "_known_empty", False) for n in names)
    for name, equiv in (("sub_class", "equiv_class"), ("sub_prop", "equiv_prop"), ("sub_data", None)):
        if not none(name, *filter(None, [equiv])):
            edges = rel[name] if equiv is None or none(equiv) else rel[name].unionByName(equivalence_edges(rel[equiv]))
            out[name] = closure(edges, scratch)
    for name, up in (("domain", "sub_prop"), ("range", "sub_prop"), ("data_domain", "sub_data"), ("data_range", "sub_data")):
        if not none(name) and out[up] is not rel[up]:
            value = SCHEMA[name][1]
            out[name] = scratch.save(inherit(rel[name].select("p", c(value).alias("c")), out[up]).select("p", c("c").alias(value)))
    if not none("inverse"):
        out["inverse"] = rel["inverse"].unionByName(rel["inverse"].select(c("q").alias("p"), c("p").alias("q"))).distinct()
    if not none("prop_char"):
        ups = out["sub_prop"] if out["sub_data"] is rel["sub_data"] else out["sub_prop"].unionByName(out["sub_data"])
        out["prop_char"] = scratch.save(propagate_characteristics(rel["prop_char"], ups))
    return out


def at_most_one_same(types: DataFrame, opa: DataFrame, at_most: DataFrame) -> DataFrame:
    """cls-maxc2 and cls-maxqc3/4: (a, b) successors that must be equal, each tied to the smallest."""
    one = at_most.where("most = '1'")
    rows = types.join(one, "cls").select(c("ind").alias("s"), "p", "cls", "filler").join(opa, ["s", "p"])
    typed = rows.where(c("filler") != THING).join(types.select(c("ind").alias("o"), c("cls").alias("filler")), ["o", "filler"])
    rows = rows.where(c("filler") == THING).select("s", "p", "cls", "filler", "o").unionByName(typed.select("s", "p", "cls", "filler", "o"))
    low = rows.groupBy("s", "p", "cls", "filler").agg(F.min("o").alias("a"))
    return rows.join(low, ["s", "p", "cls", "filler"]).where(c("o") != c("a")).select("a", c("o").alias("b")).distinct()


def keys_same(work: dict[str, DataFrame]) -> DataFrame:
    """prp-key: named individuals of a class that share a value of every key property, tied to the smallest."""
    keys = work["key"].distinct().limit(MAX_KEYS + 1).collect()
    if len(keys) > MAX_KEYS:
        raise ValueError(f"more than {MAX_KEYS} keys")
    facts = work["opa"].select("s", "p", F.concat(F.lit("individual "), "o").alias("v")).unionByName(work["dpa"].select("s", "p", dt.canonical(c("lexical"), c("datatype")).alias("v")))
    out = None
    for cls, members in keys:
        rows = work["type"].select("ind") if cls == THING else work["type"].where(c("cls") == cls).select("ind")
        rows = rows.distinct()
        names = [f"v{i}" for i in range(len(members))]
        for name, p in zip(names, members):
            rows = rows.join(facts.where(c("p") == p).select(c("s").alias("ind"), c("v").alias(name)).distinct(), "ind")
        found = key_same(rows, names)
        out = found if out is None else out.unionByName(found)
    return out


def materialize(rel: dict[str, DataFrame], scratch: Scratch, rules: list[Rule] | None = None, max_rounds: int = 64, max_same_rounds: int = 16, more_rules: list[Rule] = (), closed_classes: DataFrame | None = None) -> Materialization:
    """Joint fixpoint of all rules, equalities included.  ``rel``: every relation of SCHEMA.  ``more_rules`` run along (DL-safe
    rules); ``closed_classes``: further subsumptions (sub, sup), closed, such as those of a classification."""
    tbox = close_tbox(rel, scratch)
    if closed_classes is not None:
        tbox["sub_class"] = closure(tbox["sub_class"].select("sub", "sup").unionByName(closed_classes.select("sub", "sup")), scratch)
    work = {k: v if getattr(v, "_known_empty", False) else v.select(*SCHEMA[k]) for k, v in tbox.items() if k in SCHEMA}
    none = lambda name: getattr(work[name], "_known_empty", False)
    for kind in ("symmetric", "transitive"):
        work[kind] = nothing(scratch.spark, "p string") if none("prop_char") else of_kind(tbox["prop_char"], kind)
    if not none("dpa"):
        if not none("sub_data"):
            up = work["dpa"].join(work["sub_data"], work["dpa"]["p"] == work["sub_data"]["sub"]).select("s", c("sup").alias("p"), "lexical", "datatype")
            work["dpa"] = scratch.save(work["dpa"].unionByName(up).distinct())
        if not none("data_domain"):
            work["type"] = work["type"].unionByName(work["dpa"].join(work["data_domain"], "p").select(c("s").alias("ind"), c("c").alias("cls"))).distinct()
    reflexive = [] if none("prop_char") else [r["p"] for r in of_kind(tbox["prop_char"], "reflexive").distinct().limit(MAX_REFLEXIVE + 1).collect()]
    if len(reflexive) > MAX_REFLEXIVE:
        raise ValueError(f"more than {MAX_REFLEXIVE} reflexive properties")
    if reflexive:
        people = work["type"].select(c("ind").alias("x")).unionByName(work["opa"].select(c("s").alias("x"))).unionByName(work["opa"].select(c("o").alias("x"))).distinct()
        work["opa"] = work["opa"].unionByName(people.select(c("x").alias("s"), F.explode(F.array(*map(F.lit, reflexive))).alias("p"), c("x").alias("o"))).distinct()
    same, counts, rounds = work["same"], {}, 0
    no_reps = nothing(scratch.spark, "node string, rep string")
    for _ in range(max_same_rounds):
        reps = no_reps if is_empty(same) else scratch.save(components(same, scratch))
        facts = dict(work)
        if reps is not no_reps:
            facts |= {k: to_representatives(work[k], reps, columns) for k, columns in INDIVIDUALS.items() if not none(k)}
        facts["same"] = nothing(scratch.spark, "a string, b string")
        if any("same" in r.inputs for r in more_rules):  # among representatives equal individuals are one
            people = facts["type"].select(c("ind").alias("a")).unionByName(facts["opa"].select(c("s").alias("a"))).unionByName(facts["opa"].select(c("o").alias("a")))
            facts["same"] = people.distinct().select("a", c("a").alias("b"))
        if any("different" in r.inputs for r in more_rules) and not none("different"):
            apart = work["different"] if reps is no_reps else to_representatives(work["different"], reps, ["a", "b"])
            facts["different"] = apart.unionByName(apart.select(c("b").alias("a"), c("a").alias("b"))).distinct()
        extra = list(more_rules)
        if reps is not no_reps and (named := sorted({x for r in extra for x in r.constants})):
            rep = {r["node"]: r["rep"] for r in reps.where(c("node").isin(named)).collect()}  # as many as rules name
            extra = [r.renamed(rep) if r.constants else r for r in extra]
        done = fixpoint(facts, [*(rules or ABOX_RULES), *extra], scratch, max_rounds)
        rounds += done.rounds
        for k, n in done.counts.items():
            counts[k] = counts.get(k, 0) + n
        work["type"], work["opa"], work["dpa"] = (done.relations[k] for k in ("type", "opa", "dpa"))
        more = [done.relations["same"].select("a", "b")] if any(r.head == "same" for r in more_rules) else []
        more += [] if none("prop_char") else [functional_same(work["opa"], tbox["prop_char"])]
        more += [] if none("at_most") else [at_most_one_same(work["type"], work["opa"], work["at_most"])]
        if not none("key") and (found := keys_same(work)) is not None:
            more.append(found)
        if not more:
            break
        rows = more[0]
        for part in more[1:]:
            rows = rows.unionByName(part)
        rows = scratch.save(rows.where("a <> b").distinct())
        if rows.isEmpty():
            break
        same = scratch.save(same.select("a", "b").unionByName(rows).unionByName(reps.select(c("node").alias("a"), c("rep").alias("b"))).where("a <> b").distinct())
    else:
        raise Diverged(f"equalities not settled in {max_same_rounds} rounds")
    for k, columns in INDIVIDUALS.items():
        if reps is not no_reps and not none(k) and k not in ("type", "opa"):
            work[k] = to_representatives(work[k], reps, columns)
    work |= {"same": same}
    return Materialization(work, reps, counts, rounds)


def extend(done: Materialization, facts: dict[str, DataFrame], scratch: Scratch, more_rules: list[Rule] = (), max_rounds: int = 64) -> Materialization | None:
    """What added facts bring to a materialisation: only consequences of the new ones are derived.  None where new facts make
    individuals equal, or a relation other than type and opa grows: then all has to be derived again."""
    if set(facts) - {"type", "opa"} or not is_empty(done.representatives):
        return None
    work = done.relations
    grown = fixpoint(work, [*ABOX_RULES, *more_rules], scratch, max_rounds, delta=facts)
    parts = [] if getattr(work["prop_char"], "_known_empty", False) else [functional_same(grown.relations["opa"], work["prop_char"])]
    parts += [] if getattr(work["at_most"], "_known_empty", False) else [at_most_one_same(grown.relations["type"], grown.relations["opa"], work["at_most"])]
    if not getattr(work["key"], "_known_empty", False) and (found := keys_same(grown.relations)) is not None:
        parts.append(found)
    if any(not p.where("a <> b").isEmpty() for p in parts) or not is_empty(of_kind(work["prop_char"], "reflexive") if not getattr(work["prop_char"], "_known_empty", False) else work["prop_char"]):
        return None
    counts = {k: done.counts.get(k, 0) + n for k, n in grown.counts.items()}
    return Materialization({**work, "type": grown.relations["type"], "opa": grown.relations["opa"]}, done.representatives, counts, done.rounds + grown.rounds)


def clashes(rel: dict[str, DataFrame], reps: DataFrame, disjoint: DataFrame) -> DataFrame:
    """(kind, a, b) of every contradiction in materialised relations, each found by one join or aggregate.  Relations that ``rel``
    lacks, or that are known to be empty, are not looked at."""
    parts = []
    there = lambda *names: all(n in rel and not getattr(rel[n], "_known_empty", False) for n in names)

    def add(kind, rows, a, *b):
        parts.append(rows.select(F.lit(kind).alias("kind"), c(a).cast("string").alias("a"), F.concat_ws("|", *b).alias("b")))

    types, opa = rel["type"], rel["opa"]
    add("nothing", types.where(c("cls") == NOTHING), "ind", "cls")
    pairs = types.join(disjoint, types["cls"] == disjoint["a"]).select("ind", c("b").alias("cls"), c("a").alias("one"))
    add("disjoint_classes", pairs.join(types, ["ind", "cls"]), "ind", "one", "cls")
    if there("different"):
        diff = rel["different"].withColumns({"x": c("a"), "y": c("b")})
        diff = diff if getattr(reps, "_known_empty", False) else to_representatives(diff, reps, ["x", "y"])
        add("same_different", diff.where("x = y"), "a", "b")
    if there("prop_char"):
        add("irreflexive", checks.self_loops(opa, of_kind(rel["prop_char"], "irreflexive")), "s", "p")
        add("asymmetric", checks.mutual_pairs(opa, of_kind(rel["prop_char"], "asymmetric")), "s", "p", "o")
    if there("neg_opa"):
        negative = rel["neg_opa"] if getattr(reps, "_known_empty", False) else to_representatives(rel["neg_opa"], reps, ["s", "o"])
        add("negative_assertion", checks.both_positive_and_negative(opa, negative.select("s", "p", "o")), "s", "p", "o")
    if there("neg_type"):
        add("complement", checks.complement_typing(types, rel["neg_type"]), "ind", "cls")
    if there("disjoint_prop"):
        add("disjoint_properties", checks.disjoint_properties(opa, rel["disjoint_prop"]), "s", "p", "q", "o")
    if there("at_most"):
        limits = types.join(rel["at_most"], "cls").select(c("ind").alias("s"), "p", c("most").cast("int").alias("most"), "filler")
        rows = opa.join(limits, ["s", "p"])
        typed = rows.where(c("filler") != THING).join(types.select(c("ind").alias("o"), c("cls").alias("filler")), ["o", "filler"]).select("s", "p", "o", "most", "filler")
        rows = rows.where(c("filler") == THING).select("s", "p", "o", "most", "filler").unionByName(typed)
        add("at_most_none", rows.where("most = 0"), "s", "p", "o")
        if there("different"):
            apart = rel["different"] if getattr(reps, "_known_empty", False) else to_representatives(rel["different"], reps, ["a", "b"])
            bounded = rows.where("most > 0").select("s", F.concat_ws(" ", "p", "filler", c("most").cast("string")).alias("p"), "o", "most")
            add("max_cardinality", checks.max_cardinality(bounded.select("s", "p", "o"), bounded.select("p", "most").distinct(), apart), "s", "p")
    if there("dpa"):
        value = dt.canonical(c("lexical"), c("datatype"))
        dpa = rel["dpa"].withColumn("value", value)
        add("ill_typed", dpa.where(dt.ill_typed(c("lexical"), c("datatype"))), "s", "p", "lexical")
        if there("neg_dpa"):
            add("negative_data_assertion", checks.both_positive_and_negative(dpa, rel["neg_dpa"].select("s", "p", value.alias("value"))), "s", "p", "value")
        if there("prop_char"):
            add("functional_data", checks.functional_data(dpa, of_kind(rel["prop_char"], "functional"), "value"), "s", "p")
        if there("disjoint_prop"):
            add("disjoint_data", checks.disjoint_data_values(dpa, rel["disjoint_prop"], "value"), "s", "p", "q")
        if there("data_range"):
            add("data_range", dpa.join(rel["data_range"].select("p", c("datatype").alias("wanted")), "p").where(~dt.value_in(c("lexical"), c("datatype"), c("wanted"))), "s", "p", "lexical")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()
