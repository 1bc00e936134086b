"""Tables written to the cluster's shared folder: they cut lineage and outlive a lost executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the folder that setCheckpointDir() named. A temporary folder only on a local master where the session names none, as in tests; elsewhere that is an error, as executors don't see the driver's disk."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    if not (known := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="terralex-"))
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
    return known.get().rstrip("/")


def kept(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table of their own."""
    return Shelf(df.sparkSession, "kept").put(df, "rows")


#: Folders of this process.
ROOTS: list[str] = []


def clear(spark: SparkSession) -> None:
    """Removes all tables that operators of this process have left in the shared folder: results that read them are no longer to be used."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    while ROOTS:
        at = path(ROOTS.pop())
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Shelf:
    """Tables of one run. `drop` removes what later steps no longer read, clear() what results still do."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root = spark, f"{shared_folder(spark)}/terralex-{name}-{uuid.uuid4().hex}"
        ROOTS.append(self.root)

    def put(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(path := f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(path)

    def measured(self, df: DataFrame, name: str, **sums: Column) -> tuple[DataFrame, dict]:
        """The table and some aggregates of its rows, taken while it is written."""
        seen = Observation()
        out = self.put(df.observe(seen, *(c.alias(k) for k, c in sums.items())), name)
        return out, seen.get

    def drop(self, *names: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        for name in names:
            at = path(f"{self.root}/{name}")
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
