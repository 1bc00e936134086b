"""The driver's tables in the roles that the operators work on. Coordinates are made from keys."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators.index import Index
from ..operators.service import Searcher
from ..sources.scratch import shared_folder
from ..sources.tables import spread, table


def docs(spark: SparkSession, d: str) -> DataFrame:
    """documents: the first eight tokens are the name, the others the address."""
    t = spread(table(spark, d, "documents")).select("doc_id", tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.array_join(F.slice("t", 1, 8), " ").alias("name"), F.array_join(F.slice("t", F.lit(9), F.greatest(F.size("t") - 8, F.lit(0))), " ").alias("address"))


def index(spark: SparkSession, d: str) -> Index:
    return Index.build(docs(spark, d))


def stored_index(spark: SparkSession, d: str) -> Index:
    """The index of documents as tables in the shared folder."""
    index(spark, d).save(at := f"{shared_folder(spark)}/terralex-index-{uuid.uuid4().hex}")
    return Index.load(spark, at)


def searches(spark: SparkSession, d: str) -> DataFrame:
    """benchmark: all tokens of an item are a query."""
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(tokens(F.col("text")), " ").alias("query"))


def parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("name"), F.concat("p_type", F.lit(" "), "p_brand").alias("address"))


def token_lists(docs_: DataFrame) -> DataFrame:
    return docs_.select("doc_id", tokens(F.concat_ws(" ", "name", "address")).alias("tokens"))


def part_names(spark: SparkSession, d: str) -> DataFrame:
    """(query_id, name): each part name once, with its least key."""
    return table(spark, d, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("query_id"))


def misspelt(spark: SparkSession, d: str) -> DataFrame:
    """Part names whose words of four letters or more lack the third."""
    return part_names(spark, d).select("query_id", F.regexp_replace(F.lower("name"), r"([a-z][a-z])[a-z]([a-z]+)", "$1$2").alias("query"))


def typed(spark: SparkSession, d: str) -> DataFrame:
    """Part names without their last two letters."""
    return part_names(spark, d).select("query_id", F.expr("substring(lower(name), 1, length(name) - 2)").alias("query"))


def lat(key: Column) -> Column:
    return F.lit(-6.0) - (key % 997) / 1000.0


def lon(key: Column) -> Column:
    return F.lit(106.0) + (key % 1009) / 1000.0


def places(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("id"), lat(k).alias("lat"), lon(k).alias("lon"), F.array(F.concat(F.lit("segment="), "c_mktsegment")).alias("features"), "c_nationkey", "c_name")


def points(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers, in places between those of customers."""
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(k.alias("query_id"), (lat(k * 7) - 0.0004).alias("lat"), (lon(k * 11) + 0.0003).alias("lon"), "s_nationkey", "s_name")


def circles(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(F.concat(F.lit("f"), (k % 3).cast("string")).alias("fence"), k.alias("key"), lat(k * 7).alias("lat"), lon(k * 11).alias("lon"), (0.2 + k % 20).cast("double").alias("radius"))


def moves(events: DataFrame) -> DataFrame:
    k = F.col("event_id")
    return events.select(k.alias("move_id"), F.col("user_id").alias("point_id"), "ts", lat(k).alias("lat"), lon(k * 7).alias("lon"))


#: A concave ring around a center, in degrees times a size.
RING_LAT, RING_LON = (-0.12, -0.12, 0.0, 0.12, 0.12, -0.12), (-0.12, 0.12, 0.03, 0.12, -0.12, -0.12)


def areas(spark: SparkSession, d: str) -> DataFrame:
    """Nations as level 7, regions as levels 6, 5 and 4, larger each, and the whole as level 2."""
    ring = lambda c, offs, size: F.array(*(c + o * size for o in offs))
    n = F.col("n_nationkey")
    small = table(spark, d, "nation").select(n.cast("bigint").alias("area_id"), F.col("n_name").alias("name"), F.lit(7).alias("level"), (n + 10000).cast("string").alias("postcode"), ring(-6.1 - (n % 5) * 0.2, RING_LAT, 1.0).alias("lats"), ring(106.1 + F.floor(n / 5) * 0.2, RING_LON, 1.0).alias("lons"))
    r = F.col("r_regionkey")
    large = table(spark, d, "region")
    for level, size in ((6, 2.0), (5, 3.0), (4, 4.0), (2, 9.0)):
        small = small.unionByName(large.select((r + level * 100).cast("bigint").alias("area_id"), F.concat("r_name", F.lit(f" {level}")).alias("name"), F.lit(level).alias("level"), F.lit("").alias("postcode"), ring(-6.2 - r * 0.15, RING_LAT, size).alias("lats"), ring(106.2 + r * 0.15, RING_LON, size).alias("lons")))
    return small


def tagged(spark: SparkSession, d: str) -> DataFrame:
    """Orders as tagged objects."""
    k = F.col("o_orderkey")
    pair = lambda key, value, when: F.when(when, F.struct(F.lit(key).alias("key"), value.cast("string").alias("value")))
    entries = F.array(pair("name", F.concat(F.lit("Order "), k % 50), k % 11 != 0), pair("short_name", F.concat(F.lit("O"), k % 7), k % 5 == 0), pair("amenity", F.col("o_orderpriority"), k % 3 == 0), pair("shop", F.col("o_orderstatus"), k % 2 == 0), pair("landuse", F.col("o_orderstatus"), k % 7 == 0), pair("note", F.col("o_orderstatus"), F.lit(True)))
    return table(spark, d, "orders").select(k.alias("id"), F.map_from_entries(F.filter(entries, lambda e: e.isNotNull())).alias("tags"))


def ways(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    size = 0.001 * (1 + k % 40)
    return table(spark, d, "orders").select(k.alias("id"), F.concat("o_orderpriority", F.lit(" "), (F.col("o_custkey") % 50).cast("string")).alias("name"), (lat(k % 60) - size).alias("lo_lat"), (lon(k % 60) - size).alias("lo_lon"), (lat(k % 60) + size).alias("hi_lat"), (lon(k % 60) + size).alias("hi_lon"))


def named_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Nations as ways: one box for each name. Corners are tenths of degrees, divided once: sums of tenths would miss places on a border."""
    n = F.col("n_nationkey").cast("bigint")
    tenths = {"lo_lat": -63 - n % 5, "lo_lon": 1061 + F.floor(n / 5), "hi_lat": -60 - n % 5, "hi_lon": 1065 + F.floor(n / 5)}
    return table(spark, d, "nation").select(n.alias("id"), F.col("n_name").alias("name"), *((x / 10).alias(c) for c, x in tenths.items()))


def map_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Customers as nodes; some have names, some are historic, some neither."""
    k = F.col("c_custkey")
    entries = F.array(F.when(k % 3 == 0, F.struct(F.lit("name").alias("key"), F.col("c_name").alias("value"))), F.when(k % 4 == 0, F.struct(F.lit("historic").alias("key"), F.col("c_mktsegment").alias("value"))), F.when(k % 5 == 0, F.struct(F.lit("tourism").alias("key"), F.lit("chalet").alias("value"))))
    return table(spark, d, "customer").select(k.alias("id"), lat(k).alias("lat"), lon(k).alias("lon"), F.map_from_entries(F.array_compact(entries)).alias("tags"))


def map_ways(spark: SparkSession, d: str) -> DataFrame:
    """Orders as ways over up to five nodes, some of which aren't there."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    pair = lambda key, value, when: F.when(when, F.struct(F.lit(key).alias("key"), value.cast("string").alias("value")))
    entries = F.array(pair("name", F.concat(F.lit("Way "), k % 50), k % 11 != 0), pair("amenity", F.col("o_orderpriority"), k % 3 == 0), pair("tourism", F.lit("chalet"), k % 13 == 0), pair("highway", F.when(k % 4 == 0, "primary").otherwise("path"), k % 2 == 0), pair("addr:street", F.concat(F.lit("Street "), k % 9), k % 6 == 0))
    nodes = F.concat(F.array(c, c + 1, c * 2), F.when(k % 2 == 0, F.array(c + 7, F.lit(10**9).cast("bigint"))).otherwise(F.array().cast("array<bigint>")))
    return table(spark, d, "orders").select(k.alias("id"), nodes.alias("node_ids"), F.map_from_entries(F.array_compact(entries)).alias("tags"))


def map_relations(spark: SparkSession, d: str) -> DataFrame:
    """Nations as administrative relations over some ways; some are of no level, unknown, or something else."""
    n = F.col("n_nationkey").cast("bigint")
    entries = F.array(F.struct(F.lit("boundary").alias("key"), F.when(n % 6 == 5, "forest").otherwise("administrative").alias("value")), F.struct(F.lit("name").alias("key"), F.when(n % 7 == 6, F.concat(F.lit("UNKNOWN "), "n_name")).otherwise(F.col("n_name")).alias("value")), F.struct(F.lit("admin_level").alias("key"), F.when(n % 8 == 7, "x").otherwise((n % 9).cast("string")).alias("value")), F.when(n % 2 == 0, F.struct(F.lit("postal_code").alias("key"), (n + 10000).cast("string").alias("value"))))
    member = lambda kind, ref, role: F.struct(F.lit(kind).alias("type"), ref.alias("ref"), F.lit(role).alias("role"))
    members = F.array(member("way", n * 4 + 3, "outer"), member("node", n * 4 + 1, "outer"), member("way", n * 4 + 1, "outer"), member("way", n * 4 + 2, "inner"), member("way", n * 1000000 + 999999999, "outer"))
    return table(spark, d, "nation").select(n.alias("id"), F.map_from_entries(F.array_compact(entries)).alias("tags"), members.alias("members"))


def stored(spark: SparkSession, d: str) -> Searcher:
    """Parts as places with positions: written as an index and model, and loaded."""
    k = F.col("doc_id")
    places = parts(spark, d).withColumns({"lat": lat(k), "lon": lon(k), "features": F.array(F.concat(F.lit("size="), (k % 5).cast("string")))})
    return Searcher.build(spark, places, f"{shared_folder(spark)}/terralex-engine-{uuid.uuid4().hex}")


def users(queries: DataFrame) -> DataFrame:
    k = F.col("query_id")
    return queries.withColumns({"lat": lat(k * 7), "lon": lon(k * 11)})
