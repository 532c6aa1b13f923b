"""The shared tables read as an ontology: narrow relations with prefixed ids."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taxoflux.plans.scratch import table

c = F.col
#: Fixed hierarchy of properties: (sub, sup).
PROPERTIES = [("inNation", "locatedIn"), ("inRegion", "locatedIn"), ("hasPart", "relatesTo"), ("suppliedBy", "relatesTo"), ("relatesTo", "linked"), ("locatedIn", "linked"), ("placedBy", "linked")]


def ident(prefix: str, column: str) -> Column:
    return F.concat(F.lit(prefix + "/"), c(column).cast("string"))


def constants(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def brand_group() -> Column:
    return F.concat(F.lit("BrandGroup_"), (F.substring("p_brand", 7, 9).try_cast("int") % 5).cast("string"))


def brand_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sub, sup): brands below groups below Part, and part types below Part."""
    brands = table(spark, sf_dir, "part").select("p_brand", "p_type").distinct()
    return (
        brands.select(c("p_brand").alias("sub"), brand_group().alias("sup"))
        .unionByName(brands.select(brand_group().alias("sub"), F.lit("Part").alias("sup")))
        .unionByName(brands.select(c("p_type").alias("sub"), F.lit("Part").alias("sup")))
        .distinct()
    )


def part_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    return parts.select(ident("part", "p_partkey").alias("ind"), c("p_brand").alias("cls")).unionByName(parts.select(ident("part", "p_partkey").alias("ind"), c("p_type").alias("cls")))


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s, p, o): nations in regions, customers and suppliers in nations."""
    nation, customer, supplier = (table(spark, sf_dir, t) for t in ("nation", "customer", "supplier"))
    return (
        nation.select(ident("nation", "n_nationkey").alias("s"), F.lit("inRegion").alias("p"), ident("region", "n_regionkey").alias("o"))
        .unionByName(customer.select(ident("customer", "c_custkey").alias("s"), F.lit("inNation").alias("p"), ident("nation", "c_nationkey").alias("o")))
        .unionByName(supplier.select(ident("supplier", "s_suppkey").alias("s"), F.lit("inNation").alias("p"), ident("nation", "s_nationkey").alias("o")))
    )


def placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(ident("order", "o_orderkey").alias("s"), F.lit("placedBy").alias("p"), ident("customer", "o_custkey").alias("o"))


def order_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(ident("order", "o_orderkey").alias("ind"), F.concat(F.lit("Order_"), c("o_orderstatus")).alias("cls"))


def order_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("Order_"), c("o_orderstatus")).alias("sub"), F.lit("Order").alias("sup")).distinct()


def line_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s, p, o): parts and suppliers of orders, with repeats; what reads them makes rows distinct where it has to."""
    lines = table(spark, sf_dir, "lineitem")
    order = ident("order", "l_orderkey").alias("s")
    return lines.select(order, F.lit("hasPart").alias("p"), ident("part", "l_partkey").alias("o")).unionByName(lines.select(order, F.lit("suppliedBy").alias("p"), ident("supplier", "l_suppkey").alias("o")))


def event_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sub, sup): did_<type> below did below linked."""
    kinds = table(spark, sf_dir, "events").select(F.concat(F.lit("did_"), c("event_type")).alias("sub"), F.lit("did").alias("sup")).distinct()
    return kinds.unionByName(constants(spark, [("did", "linked")], "sub string, sup string"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(ident("customer", "user_id").alias("s"), F.concat(F.lit("did_"), c("event_type")).alias("p"), ident("event", "event_id").alias("o"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv, s, o): each turn precedes the next of its conversation."""
    rows = table(spark, sf_dir, "conversations").select(c("conv_id").alias("conv"), c("turn").alias("s"))
    return rows.join(rows.select("conv", c("s").alias("o")), "conv").where("o = s + 1").distinct()


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, content, lang, source): documents by the digest of their text."""
    return table(spark, sf_dir, "documents").where("text is not null").select(c("doc_id").alias("doc"), F.md5("text").alias("content"), "lang", "source")


def neighbours(spark: SparkSession, sf_dir: str, factor: int = 1, add: int = 1) -> DataFrame:
    """(s, p, o): an arithmetic relation over nations, for symmetric, asymmetric and cyclic cases."""
    n = table(spark, sf_dir, "nation").select("n_nationkey")
    return n.select(c("n_nationkey").cast("long").alias("s"), F.lit("near").alias("p"), ((c("n_nationkey") * factor + add) % 25).cast("long").alias("o"))
