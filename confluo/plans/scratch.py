"""Tables between the steps of an operator, in the folder that the whole cluster shares."""

from __future__ import annotations

import gc
import os
import uuid
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no checkpoint folder and all runs in one process, as in tests.
DEFAULT_DIR = "/tmp/checkpoints"

#: Arrow batches of long texts are cut at this size, unless the session sets its own: two Python workers beside
#: an executor's heap each hold a batch more than once.
BATCH_BYTES = "8m"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

#: Rows in memory are taken to be so many times the size of their compressed files, unless the session says so itself: tables of
#: a few MB that repeat themselves would else be sent through the driver to every executor, at ten times that and more.
UNPACKED = "16.0"
_FACTOR = "spark.sql.sources.fileCompressionFactor"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a local session without one gets one."""
    context = spark.sparkContext
    place = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if place is None:
        place = context.getCheckpointDir()
    if place is None:
        if not (context.master or "").startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the whole cluster shares")
        place = DEFAULT_DIR
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(place)
    return place.rstrip("/")


def ready(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package even where it isn't installed (local runs), keeps their batches small, and large tables out of the driver."""
    if spark.conf.get(_BATCH, "64m") in ("64m", "67108864", "67108864b"):
        spark.conf.set(_BATCH, BATCH_BYTES)
    if float(spark.conf.get(_FACTOR, "1.0")) == 1.0:
        spark.conf.set(_FACTOR, UNPACKED)
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(":"):
        env["PYTHONPATH"] = f"{root}:{env['PYTHONPATH']}" if env.get("PYTHONPATH") else root
    return spark


class Scratch:
    """Parquet tables of one call, deleted at its end, or at the driver's where the call fails or its result still reads them.

    Cutting an operator into written tables bounds its lineage, survives lost
    executors (the folder is shared) and lets finished shuffles be freed.
    """

    def __init__(self, spark: SparkSession):
        self.spark = ready(spark)
        self.path = f"{checkpoint_dir(spark)}/confluo-{uuid.uuid4().hex}"
        self.count = 0
        path, files = self.place(self.path)
        files.deleteOnExit(path)

    def place(self, at: str):
        """A path and the store that it is in."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def table(self, df: DataFrame, *, partitions: int | None = None, release: bool = True) -> DataFrame:
        """Writes and reads a table; ``release`` first frees the shuffles of the tables before, whose plans the caller has let go by then."""
        if release and self.count:
            self.release()
        self.count += 1
        at = f"{self.path}/t{self.count}"
        schema = df.schema
        (df.coalesce(partitions) if partitions else df).write.option("compression", "zstd").parquet(at)
        out = self.spark.read.schema(schema).parquet(at)
        out.scratch_path = at
        return out

    def in_turns(self, parts: Iterable[DataFrame]) -> DataFrame:
        """One table of the rows of all parts, which have the same columns; the shuffles of each are freed before the next."""
        self.count += 1
        at, schema = f"{self.path}/t{self.count}", None
        for df in parts:
            self.release()
            schema = df.schema
            df.write.option("compression", "zstd").mode("append").parquet(at)
        out = self.spark.read.schema(schema).parquet(at)
        out.scratch_path = at
        return out

    def discard(self, table: DataFrame) -> None:
        """Deletes a table that nothing will read any more."""
        path, files = self.place(table.scratch_path)
        files.delete(path, True)

    def release(self) -> None:
        """Lets Spark's cleaner delete the shuffle files of plans that nothing refers to any more."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def finish(self, df: DataFrame) -> DataFrame:
        """Writes the result, so that it no longer needs this call's tables, and deletes those."""
        before = range(1, self.count + 1)
        out = self.table(df)
        for k in before:
            path, files = self.place(f"{self.path}/t{k}")
            files.delete(path, True)
        return out

    def drop(self) -> None:
        """Deletes everything."""
        path, files = self.place(self.path)
        files.delete(path, True)
