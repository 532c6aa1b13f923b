"""Assertions that arrive as a stream."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxoflux.operators.graphs import closure
from taxoflux.plans.scratch import Scratch, table

c = F.col


def infer_types(assertions: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """(ind, cls) as they come -> with all classes above.  A stream-static join: no state is kept, and the
    hierarchy is a TBox, closed beforehand."""
    up = hierarchy.select(c("sub").alias("cls"), c("sup")).unionByName(hierarchy.select(c("sub").alias("cls"), c("sub").alias("sup"))).distinct()
    return assertions.join(up, "cls").select("ind", c("sup").alias("cls"))


def windowed_counts(assertions: DataFrame, time: str = "ts", late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Assertions per class and event-time window; rows later than the watermark are dropped, as the feature says."""
    return assertions.withWatermark(time, late).groupBy(F.window(time, size).alias("w"), "cls").agg(F.count("*").alias("n")).select(c("w.start").alias("start"), "cls", "n")


def run_to_end(stream: DataFrame, path: str) -> DataFrame:
    """Runs a stream over all input there is and returns what it wrote, exactly once per micro-batch."""
    spark = stream.sparkSession
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def stream_event_types(spark: SparkSession, sf_dir: str, scratch: Scratch) -> DataFrame:
    """The events table as a stream of type assertions, with the classes above."""
    static = table(spark, sf_dir, "events")
    hierarchy = scratch.save(closure(static.select(F.concat(F.lit("Event_"), c("event_type")).alias("sub"), F.lit("Event").alias("sup")).distinct(), scratch))
    assertions = event_stream(spark, sf_dir).select(F.concat(F.lit("event/"), c("event_id").cast("string")).alias("ind"), F.concat(F.lit("Event_"), c("event_type")).alias("cls"))
    scratch.count += 1
    return run_to_end(infer_types(assertions, hierarchy), f"{scratch.root}/stream-{scratch.count}").distinct()


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream.  A directory of files is the source; the table may be one file, so its parent is read by name."""
    many = _is_dir(spark, f"{sf_dir}/events.parquet")
    source = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "*.parquet" if many else "events.parquet")
    return source.parquet(f"{sf_dir}/events.parquet" if many else sf_dir)


def _is_dir(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()
