"""Duplicate places: ways of one name whose boxes hold each other, nodes inside a way of their name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import kept

BOX = ("lo_lat", "lo_lon", "hi_lat", "hi_lon")


def _folded(ways: DataFrame) -> DataFrame:
    """(key, f): f.ids are those of unique ways, f.last the box last recorded. Ways go by id: one is a duplicate if its box holds, or is held by, the box last recorded for its lower-cased name; a box that isn't held is the one recorded from then on.

    The rule depends on order, so a name's boxes are folded one after another; names are independent of each other.
    """
    held = lambda a, b: (a["lo_lat"] >= b["lo_lat"]) & (a["lo_lon"] >= b["lo_lon"]) & (a["hi_lat"] <= b["hi_lat"]) & (a["hi_lon"] <= b["hi_lon"])
    kind = "struct<lo_lat:double,lo_lon:double,hi_lat:double,hi_lon:double>"
    boxes = ways.groupBy(F.lower("name").alias("key")).agg(F.array_sort(F.collect_list(F.struct("id", *(F.col(c).cast("double").alias(c) for c in BOX)))).alias("x"))
    start = F.struct(F.lit(None).cast(kind).alias("last"), F.array().cast("array<bigint>").alias("ids"))

    def step(acc, x):
        box = F.struct(*(x[c].alias(c) for c in BOX))
        inside = F.coalesce(held(box, acc["last"]), F.lit(False))
        dup = inside | F.coalesce(held(acc["last"], box), F.lit(False))
        return F.struct(F.when(inside, acc["last"]).otherwise(box).alias("last"), F.when(dup, acc["ids"]).otherwise(F.concat(acc["ids"], F.array(x["id"].cast("bigint")))).alias("ids"))

    return boxes.select("key", F.aggregate("x", start, step).alias("f"))


def unique_ways(ways: DataFrame) -> DataFrame:
    """Ways (id, name, box, ...) without duplicates."""
    return ways.join(_folded(ways).select(F.explode("f.ids").alias("id")), "id", "left_semi")


def recorded(ways: DataFrame) -> DataFrame:
    """(key, box): the box last recorded for each lower-cased name, of all ways."""
    return _folded(ways).select("key", F.col("f.last").alias("box"))


def unique_nodes(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """Nodes (id, name, lat, lon, ...) that aren't inside the recorded box of a way of their name."""
    inside = nodes.select("id", "lat", "lon", F.lower("name").alias("key")).join(recorded(ways), "key").where(F.col("lat").between(F.col("box.lo_lat"), F.col("box.hi_lat")) & F.col("lon").between(F.col("box.lo_lon"), F.col("box.hi_lon")))
    return nodes.join(inside.select("id").distinct(), "id", "left_anti")


def numbered(places: DataFrame, *order: str, name: str = "doc_id") -> DataFrame:
    """places with dense numbers from 1 by order, without moving all rows to one task: offsets come from counts of ranges."""
    sorted_ = places.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id()).withColumn("__k", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("bigint"), 33))
    rows = kept(sorted_)
    counts = sorted((r["__p"], r["n"]) for r in rows.groupBy("__p").agg(F.count(F.lit(1)).alias("n")).collect())  # one number a partition
    before, offsets = 0, []
    for p, n in counts:
        offsets.append((p, before))
        before += n
    table = places.sparkSession.createDataFrame(offsets, "__p int, __o bigint")
    return rows.join(F.broadcast(table), "__p").withColumn(name, F.col("__o") + F.col("__k") + 1).drop("__p", "__k", "__o")
