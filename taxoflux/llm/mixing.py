"""Operator 8: mix sources to target weights.  DataFrame functions only.

Tokens are summed per source; each source's target comes from the weights, and target / size is its
repetition rate.  Every document is then taken floor(rate) times, plus one copy when a hash of its id,
read as a number in [0, 1), is below the fraction.  The rate join never needs the rows of a source
together: sizes are pre-aggregated per task and the per-source table (one row a source) is joined
back, by broadcast where Spark measures it as small and with adaptive skew splitting otherwise.

Defined cases: null or word-less text has size 0 and is taken 0 words; a null source is a source of
its own and comes last; a null doc_id hashes as the seed alone; repeated rows are decided alike; an
empty table gives no rows; other columns are ignored.  If all sizes are 0, targets are 0.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxoflux.llm.runtime import unused

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
SEED = 8


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, max_repeat=MAX_REPEAT) -> DataFrame:
    """(source, source_size) -> + target, by water filling in closed form.

    With sources ordered by cap / weight, the capped ones are a prefix: a source is capped exactly if
    what is left after capping all earlier ones, shared by the remaining weights, reaches its cap.
    Runs over one row a source, never over documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    kinds = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("weight", F.get(kinds, (F.row_number().over(by_name) - 1) % len(weights)))
    ranked = ranked.withColumns({
        "cap": F.col("source_size") * float(max_repeat),
        "total": F.sum("source_size").over(everything).cast("double"),
    })
    ranked = ranked.withColumns({
        "left": F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "open": F.sum("weight").over(after),
    })
    ranked = ranked.withColumn("level", F.col("left") / F.col("open"))
    capped = F.col("level") * F.col("weight") >= F.col("cap")
    # the levels of uncapped sources fall in this order: the first one, the highest, holds for all
    ranked = ranked.withColumn("final", F.max(F.when(~capped, F.col("level"))).over(everything))
    target = F.when(capped, F.col("cap")).otherwise(F.col("weight") * F.col("final"))
    return ranked.select("source", "source_size", target.alias("target"))


def unit_hash(key: Column, seed: int) -> Column:
    """A number in [0, 1) from the first 48 bits of the MD5 of ``seed:key``."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") * F.lit(2.0**-48)


def mix(docs: DataFrame, weights=WEIGHTS, max_repeat=MAX_REPEAT, seed=SEED, save=lambda df: df) -> DataFrame:
    """One row a document: doc_id, size, source_size, target, copies, taken.

    ``save`` may write the (doc_id, source, size) table, so that texts are counted once.
    """
    sized = save(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")))
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rates = targets(sizes, weights, max_repeat).withColumnRenamed("source", "rate_source")
    joined = sized.join(rates, F.col("source").eqNullSafe(F.col("rate_source")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(F.col("rate"))
    extra = (unit_hash(F.col("doc_id"), seed) < F.col("rate") - whole).cast("long")
    return (
        joined.withColumn("rate", rate)
        .withColumn("copies", whole + extra)
        .select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )


def emit(docs: DataFrame, weights=WEIGHTS, max_repeat=MAX_REPEAT, seed=SEED, save=lambda df: df, broadcast_sources: int = 100_000) -> DataFrame:
    """The mix itself: every document, all columns, once for each of its copies, with ``copy`` from 1
    (``copy_`` where the documents have that column).

    Texts stay where they are while sources number at most ``broadcast_sources`` (counted first); beyond,
    the join is by shuffle, which splits large sources."""
    packed = docs.select(F.struct(*docs.columns).alias("__row"), F.col("doc_id").alias("__id"), F.col("source").alias("__source"))
    sizes = docs.select("source", n_words(F.col("text")).alias("size")).groupBy("source").agg(F.sum("size").alias("source_size"))
    rates = save(targets(sizes, weights, max_repeat).select("source", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("__rate")))
    if rates.count() <= broadcast_sources:
        rates = F.broadcast(rates)
    rate, whole = F.col("__rate"), F.floor(F.col("__rate"))
    copies = (whole + (unit_hash(F.col("__id"), seed) < rate - whole).cast("long")).cast("int")
    joined = packed.join(rates, F.col("__source").eqNullSafe(rates["source"])).where(copies > 0)
    return joined.select("__row", F.explode(F.sequence(F.lit(1), copies)).alias("__copy")).select("__row.*", F.col("__copy").alias(unused(docs, "copy")))
