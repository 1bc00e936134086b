"""Reading the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that many_to_many sends to all tasks, at most: 100 bytes each.
BROADCAST_ROWS = 1 << 20

#: Rows of a key that in_runs joins at a time.
RUN = 512


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt to all cores where a scan has fewer parts than there are cores, as with one small file; other tables stay as they are read."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def many_to_many(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Inner join whose result is much larger than its sides: left rows are dealt evenly, as few keys or a small file would leave it to few tasks.

    right should be the smaller side. If it is too large for all tasks, each of its rows goes to as many parts as a key is cut into.
    """
    n = 4 * left.sparkSession.sparkContext.defaultParallelism
    if right.count() <= BROADCAST_ROWS:
        return left.where(F.col(on).isNotNull()).repartition(n).join(F.broadcast(right), on)
    cut = F.pmod(F.xxhash64(*left.columns), F.lit(n)).cast("int")
    parts = right.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return left.withColumn("__part", cut).repartition(n, on, "__part").join(parts.repartition(n, on, "__part"), [on, "__part"]).drop("__part")


def in_order(df: DataFrame, *by: str) -> DataFrame:
    """Each part's rows in an order that a join above keeps: a sort is dropped there unless something that isn't deterministic stands between."""
    return df.sortWithinPartitions(*by).where(F.monotonically_increasing_id() >= 0)


def in_runs(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """many_to_many() in an order that takes less room when written.

    Each task takes the keys one after another, and of a key `RUN` right rows at a time: right's columns repeat within a page of a Parquet file,
    left's come in runs, and both are compressed to a fraction.
    """
    if right.count() > BROADCAST_ROWS:
        return many_to_many(left, right, on)
    right = right.withColumn("__run", F.floor((F.row_number().over(Window.partitionBy(on).orderBy(*right.columns)) - 1) / RUN).cast("int"))
    runs = right.groupBy(on).agg(F.sequence(F.lit(0), F.max("__run")).alias("__run"))
    left = left.join(F.broadcast(runs), on).repartition(4 * left.sparkSession.sparkContext.defaultParallelism)
    return in_order(left.withColumn("__run", F.explode("__run")), on, "__run").join(F.broadcast(right), [on, "__run"]).drop("__run")
