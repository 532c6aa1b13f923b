"""The property hierarchy: taxonomy, inverses, regularity, simplicity, and what known endpoints say about properties."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxoflux.operators.graphs import closure
from taxoflux.plans.scratch import Scratch

c = F.col


def mirrored(sub_prop: DataFrame, inverse: DataFrame) -> DataFrame:
    """(sub, sup): p ⊑ q gives inv(p) ⊑ inv(q), for every inverse that has a name; two inverses of one property are below each other."""
    both = inverse.select("p", "q").unionByName(inverse.select(c("q").alias("p"), c("p").alias("q"))).distinct()
    up = sub_prop.select("sub", "sup").unionByName(both.select(c("p").alias("sub"), c("p").alias("sup"))).distinct()
    low, high = both.select(c("p").alias("sub"), c("q").alias("x")), both.select(c("p").alias("sup"), c("q").alias("y"))
    return up.join(low, "sub").join(high, "sup").where("x <> y").select(c("x").alias("sub"), c("y").alias("sup")).distinct()


def taxonomy(sub_prop: DataFrame, inverse: DataFrame, scratch: Scratch) -> DataFrame:
    """(sub, sup): all subproperties, with those that inverses mirror; sub and sup differ or lie on a cycle."""
    edges = sub_prop.select("sub", "sup").unionByName(mirrored(sub_prop, inverse)).distinct()
    return closure(edges, scratch)


def irregular(sub_prop: DataFrame, chain: DataFrame, scratch: Scratch) -> DataFrame:
    """(sup): properties of chains that no order of properties allows (OWL 2's global restriction): a step that isn't the chain's
    property itself at its start or end has to come strictly before it, yet is not below it by some other way round."""
    whole = (c("first") == c("sup")) & (c("second") == c("sup"))
    steps = chain.where(~whole).select(F.explode(F.array(F.struct(c("first").alias("sub"), c("sup").alias("sup")), F.struct(c("second").alias("sub"), c("sup").alias("sup")))).alias("z")).select("z.sub", "z.sup")
    strict = steps.where("sub <> sup").distinct()
    up = closure(sub_prop.select("sub", "sup").unionByName(strict).distinct(), scratch)
    back = up.select(c("sub").alias("sup"), c("sup").alias("sub"))
    return strict.join(back, ["sub", "sup"], "left_semi").select("sup").distinct()


def composite(sub_prop: DataFrame, chain: DataFrame, transitive: DataFrame, scratch: Scratch) -> DataFrame:
    """(p): properties that are not simple: transitive ones, those of chains, and all above them."""
    seeds = chain.select(c("sup").alias("p")).unionByName(transitive.select("p")).distinct()
    up = closure(sub_prop, scratch)
    return seeds.unionByName(up.join(seeds, up["sub"] == seeds["p"], "left_semi").select(c("sup").alias("p"))).distinct()


def need_simple(rel: dict[str, DataFrame]) -> DataFrame:
    """(p, use): properties where only simple ones may stand: number restrictions, and characteristics that compare pairs."""
    chars = rel["prop_char"].where(c("kind").isin("functional", "inverse_functional", "irreflexive", "asymmetric")).select("p", c("kind").alias("use"))
    counted = rel["at_most"].select("p", F.lit("at_most").alias("use"))
    apart = rel["disjoint_prop"].select(F.explode(F.array("a", "b")).alias("p"), F.lit("disjoint").alias("use"))
    return chars.unionByName(counted).unionByName(apart).distinct()


def by_endpoints(endpoints: DataFrame, facts: DataFrame) -> DataFrame:
    """(sub, sup): endpoints(p, s, o) say that a property links s and o at most (a domain and a range of one individual each); every
    property that does link them is above it.  With closed facts, paths of transitive properties count."""
    hits = endpoints.join(facts.select("s", "o", c("p").alias("sup")), ["s", "o"])
    return hits.where(c("p") != c("sup")).select(c("p").alias("sub"), "sup").distinct()


def by_definitions(definitions: DataFrame, sub_class: DataFrame, sub_prop: DataFrame) -> DataFrame:
    """(sub, sup): of A ≡ ∃P.C and B ≡ ∃Q.D with P below or equal Q and C below or equal D, A is below B.  Definitions (cls, p, filler) are
    joined through the two closed hierarchies, never pairwise."""
    same = lambda edges, column: edges.select("sub", "sup").unionByName(definitions.select(c(column).alias("sub"), c(column).alias("sup"))).distinct()
    roles, fillers = same(sub_prop, "p"), same(sub_class, "filler")
    low = definitions.select(c("cls").alias("a"), "p", "filler").join(roles, c("p") == c("sub")).select("a", "filler", c("sup").alias("q"))
    low = low.join(fillers, c("filler") == c("sub")).select("a", "q", c("sup").alias("d"))
    high = definitions.select(c("cls").alias("b"), c("p").alias("q"), c("filler").alias("d"))
    return low.join(high, ["q", "d"]).where("a <> b").select(c("a").alias("sub"), c("b").alias("sup")).distinct()
