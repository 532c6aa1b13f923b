"""Intermediates: written ones in the cluster's shared folder, which cut lineage and survive lost executors, and held ones.

A relation of at most SMALL rows (a hierarchy, a round's few new facts) is held by the driver and goes into later plans as a
constant: no file, no scan, and joins with it need no shuffle.  How many rows there are is looked up first, with a limit;
a larger relation is never collected.
"""
from __future__ import annotations

import atexit
import gc
import tempfile
import time
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20
SMALL = 10_000  # rows that the driver may hold of a relation


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset and all runs on one machine (tests), a fresh local one is set."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="taxoflux-checkpoint-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


class Scratch:
    """Intermediate tables of one query, as Parquet in the shared folder; ``drop`` removes what nothing reads any more."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/taxoflux-{uuid.uuid4().hex}"
        self.count = 0
        self.paths: dict[int, str] = {}
        self.tables: list[DataFrame] = []
        atexit.register(self._leave)
        # long texts would make Arrow batches of hundreds of megabytes
        if int(spark.conf.get(BATCH, str(1 << 28)).removesuffix("b")) > BATCH_BYTES:
            spark.conf.set(BATCH, str(BATCH_BYTES))

    def _leave(self) -> None:
        """What results read has to stay until the driver ends; then the folder goes, if the session still stands."""
        try:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # noqa: BLE001  the session has ended before; nothing is left to tell
            pass

    def save(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        self.tables.append(out)  # keeps its id from being given to another
        return out

    def hold(self, df: DataFrame, most: int = SMALL) -> DataFrame | None:
        """The rows, each once, as a constant; None if there are more than ``most``."""
        if getattr(df, "_held", None) is not None or getattr(df, "_known_empty", False):
            return df
        rows = df.limit(most + 1).toArrow()
        return None if rows.num_rows > most else self.constant(rows, df)

    def constant(self, rows: pa.Table, like: DataFrame) -> DataFrame:
        if not any(pa.types.is_nested(t) for t in rows.schema.types):
            rows = rows.group_by(rows.column_names).aggregate([])
        out = self.spark.createDataFrame(rows, like.schema) if rows.num_rows else self.spark.createDataFrame([], like.schema)
        out._held, out._known_empty = rows, rows.num_rows == 0
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for table in tables:
            if id(table) not in self.paths:  # held, not written
                continue
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(id(table)))
            path.getFileSystem(conf).delete(path, True)

    def release(self) -> None:
        """Lets Spark delete the shuffle files of plans that nothing refers to any more."""
        gc.collect()
        self.spark.range(1).collect()  # Spark holds on to its last job
        time.sleep(0.3)  # references to the JVM's objects are let go by a thread of their own
        self.spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nothing(spark: SparkSession, schema: str) -> DataFrame:
    """A table that is known to be empty, so that no job is run to find out."""
    out = spark.createDataFrame([], schema)
    out._known_empty = True
    return out


def is_empty(df: DataFrame) -> bool:
    return getattr(df, "_known_empty", False) or df.isEmpty()
