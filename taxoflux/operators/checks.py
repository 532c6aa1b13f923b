"""Consistency checks that need no tableau: each is one join or aggregate and returns its witnesses."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

c = F.col


def max_cardinality(opa: DataFrame, limits: DataFrame, different: DataFrame | None = None) -> DataFrame:
    """(s, p, n, most): subjects with more distinct successors than allowed.

    With ``different`` (no unique names), a subject counts if more than ``most`` of its successors are
    told apart from ``most`` others each; without, distinct ids are distinct things."""
    rows = opa.join(limits, "p").select("s", "p", "o", "most")
    if different is not None:
        rows = rows.distinct()
        both = different.select("a", "b").unionByName(different.select(c("b").alias("a"), c("a").alias("b"))).distinct()
        apart = rows.select("s", "p", c("o").alias("a")).join(both, "a").join(rows.select("s", "p", c("o").alias("b"), "most"), ["s", "p", "b"])
        rows = apart.groupBy("s", "p", c("a").alias("o"), "most").agg(F.count_distinct("b").alias("k")).where("k >= most").drop("k")
    return rows.groupBy("s", "p", "most").agg(F.count_distinct("o").alias("n")).where("n > most").select("s", "p", "n", "most")


def self_loops(opa: DataFrame, irreflexive: DataFrame) -> DataFrame:
    return opa.where("s = o").join(irreflexive, "p", "left_semi").select("s", "p").distinct()


def mutual_pairs(opa: DataFrame, asymmetric: DataFrame) -> DataFrame:
    rows = opa.join(asymmetric, "p", "left_semi")
    return rows.join(rows.select("p", c("o").alias("s"), c("s").alias("o")), ["p", "s", "o"]).where("s <= o").select("s", "p", "o").distinct()


def both_positive_and_negative(facts: DataFrame, negative: DataFrame) -> DataFrame:
    return facts.select(*negative.columns).intersect(negative)


def disjoint_properties(opa: DataFrame, disjoint: DataFrame) -> DataFrame:
    """(s, o, p, q) linked by two disjoint properties, or by one that is disjoint with itself."""
    one = opa.join(disjoint, opa["p"] == disjoint["a"]).select("s", "o", c("a").alias("p"), c("b").alias("q"))
    return one.join(opa.select("s", "o", c("p").alias("q")), ["s", "o", "q"]).select("s", "o", "p", "q").distinct()


def complement_typing(types: DataFrame, negative_types: DataFrame) -> DataFrame:
    return types.select("ind", "cls").intersect(negative_types.select("ind", "cls"))


def min_above_max(least: DataFrame, most: DataFrame) -> DataFrame:
    """(cls, p, least, most) whose lower bound exceeds the upper."""
    return least.join(most, ["cls", "p"]).where("least > most").select("cls", "p", "least", "most").distinct()


def functional_different(opa: DataFrame, functional: DataFrame, different: DataFrame) -> DataFrame:
    """(s, p, a, b): two successors of a functional property that are told apart.  Starts from the different
    pairs, so a subject's successors are never paired among themselves."""
    rows = opa.join(functional, "p", "left_semi")
    return different.select("a", "b").join(rows.select("s", "p", c("o").alias("a")), "a").join(rows.select("s", "p", c("o").alias("b")), ["s", "p", "b"]).select("s", "p", "a", "b").distinct()


def functional_data(dpa: DataFrame, functional: DataFrame, value: str = "lexical") -> DataFrame:
    rows = dpa.join(functional, "p", "left_semi")
    return rows.groupBy("s", "p").agg(F.count_distinct(value).alias("n")).where("n > 1")


def unsatisfiable_types(types: DataFrame, unsat: DataFrame) -> DataFrame:
    return types.join(unsat, "cls", "left_semi").select("ind", "cls").distinct()


def only_against_some(types: DataFrame, some: DataFrame, only: DataFrame, disjoint: DataFrame) -> DataFrame:
    """(ind, p): typed so that a successor must be of two disjoint classes."""
    need = types.join(some, "cls").select("ind", "p", c("filler").alias("a"))
    must = types.join(only, "cls").select("ind", "p", c("filler").alias("b"))
    both = disjoint.select("a", "b").unionByName(disjoint.select(c("b").alias("a"), c("a").alias("b")))
    return need.join(both, "a").join(must, ["ind", "p", "b"]).select("ind", "p").distinct()


def disjoint_data_values(dpa: DataFrame, disjoint: DataFrame, value: str = "lexical") -> DataFrame:
    """(s, p, q) that share a value though the properties are disjoint; ``value`` names the column that tells values apart."""
    one = dpa.join(disjoint, dpa["p"] == disjoint["a"]).select("s", value, c("a").alias("p"), c("b").alias("q"))
    return one.join(dpa.select("s", value, c("p").alias("q")), ["s", value, "q"]).select("s", "p", "q").distinct()


def cardinality_subsumption(definitions: DataFrame) -> DataFrame:
    """(cls, p, filler, least) definitions -> (sub, sup): at least m is below at least n for m >= n.

    Only neighbouring bounds of a (role, filler) are linked; the closure gives the rest."""
    from pyspark.sql import Window

    bounds = definitions.select("p", "filler", "least").distinct()
    w = Window.partitionBy("p", "filler").orderBy("least")
    bounds = bounds.withColumn("next", F.lead("least").over(w))
    up = definitions.join(bounds, ["p", "filler", "least"]).where("next is not null").select("p", "filler", c("next").alias("least"), c("cls").alias("sup"))
    steps = up.join(definitions, ["p", "filler", "least"]).select(c("cls").alias("sub"), "sup")
    low = definitions.groupBy("p", "filler", "least").agg(F.min("cls").alias("m"))
    same = definitions.join(low, ["p", "filler", "least"]).where("cls <> m")
    ring = same.select(c("cls").alias("sub"), c("m").alias("sup")).unionByName(same.select(c("m").alias("sub"), c("cls").alias("sup")))
    return steps.unionByName(ring).distinct()


def union_subsumption(unions: DataFrame) -> DataFrame:
    """A ≡ C1 ⊔ ... ⊔ Cn -> every Ci below A."""
    return unions.select(F.explode("members").alias("sub"), c("cls").alias("sup")).distinct()
