"""Map extracts to place documents: nodes, ways and relations as tables, their admission and enrichment.

Input tables: nodes (id, lat, lon, tags map), ways (id, node_ids array, tags map), relations (id, tags map, members
array<struct<ref,role,type>>).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo

# The tag keys that admit ways and nodes, the keys that give a place's type (in order of preference), the
# highway classes of streets.
WAY_KEYS = (
    "amenity", "building", "sport", "tourism", "leisure", "boundary", "landuse", "craft", "aeroway", "historic", "residential", "railway",
    "shop", "junction", "route", "ferry", "highway", "motorcar", "motor_vehicle", "access", "industrial", "service", "healthcare", "office",
    "public_transport", "waterway", "water", "telecom", "power", "place", "geological", "emergency", "bulding", "aerialway", "barrier",
)
NODE_KEYS = ("historic", "name")
TYPE_KEYS = ("amenity", "highway", "historic", "sport", "tourism", "leisure", "landuse", "craft", "aeroway", "residential", "industrial", "shop")
STREETS = (
    "motorway", "trunk", "primary", "secondary", "tertiary", "unclassified", "residential", "living_street", "service",
    "motorway_link", "trunk_link", "primary_link", "secondary_link", "tertiary_link",
)


def display_name(tags: Column) -> Column:
    """name, followed by the short name in parentheses if there is one."""
    name = F.coalesce(tags["name"], F.lit(""))
    return F.when(tags["short_name"].isNotNull(), F.concat(name, F.lit(" ("), tags["short_name"], F.lit(")"))).otherwise(name)


def place_type(tags: Column) -> Column:
    return F.coalesce(*(tags[k] for k in TYPE_KEYS), F.lit(""))


def features(tags: Column) -> Column:
    """"key=value" of the admitted keys."""
    held = F.filter(F.map_entries(tags), lambda e: e["key"].isin(*WAY_KEYS))
    return F.array_sort(F.transform(held, lambda e: F.concat(e["key"], F.lit("="), e["value"])))


def admitted(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Rows with a display name and one of the tag keys."""
    return rows.where((display_name(F.col("tags")) != "") & F.arrays_overlap(F.map_keys("tags"), F.array(*(F.lit(k) for k in keys))))


def way_points(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, lats, lons) of each way in the order of its nodes; nodes that aren't in the extract are left out."""
    at = ways.select("id", F.posexplode("node_ids").alias("pos", "node"))
    known = nodes.select(F.col("id").alias("node"), "lat", "lon")
    found = at.join(known, "node").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "lat", "lon"))).alias("x"))
    return found.select("id", F.col("x.lat").alias("lats"), F.col("x.lon").alias("lons"))


def way_places(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """Admitted ways as places (id, name, lat, lon, type, street, postcode, house, features, lo_lat .. hi_lon), at the upper median of their nodes."""
    own = admitted(ways, WAY_KEYS)
    rows = own.join(way_points(own, nodes), "id")
    box = {"lo_lat": F.array_min("lats"), "lo_lon": F.array_min("lons"), "hi_lat": F.array_max("lats"), "hi_lon": F.array_max("lons")}
    return _places(rows.withColumns({"lat": geo.upper_median(F.col("lats")), "lon": geo.upper_median(F.col("lons"))} | box))


def node_places(nodes: DataFrame) -> DataFrame:
    """Admitted nodes as places; the box of a point reaches 0.0001 degrees to each side."""
    return _places(point_boxes(admitted(nodes, NODE_KEYS)))


def point_boxes(rows: DataFrame, half: float = 0.0001) -> DataFrame:
    return rows.withColumns({"lo_lat": F.col("lat") - half, "lo_lon": F.col("lon") - half, "hi_lat": F.col("lat") + half, "hi_lon": F.col("lon") + half})


def _places(rows: DataFrame) -> DataFrame:
    t = F.col("tags")
    out = rows.select("id", display_name(t).alias("name"), "lat", "lon", place_type(t).alias("type"), t["addr:street"].alias("street"), t["addr:postcode"].alias("postcode"), t["addr:housenumber"].alias("house"), features(t).alias("features"), "lo_lat", "lo_lon", "hi_lat", "hi_lon")
    return out.where("name <> '' and type <> 'chalet'")


def boundaries(relations: DataFrame, ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """(area_id, name, level, postcode, lats, lons): administrative relations of levels 2 to 7, their outer ways' nodes in order. Ways that aren't in the extract are left out."""
    t = F.col("tags")
    own = relations.where((t["boundary"] == "administrative") & (t["name"] != "") & ~t["name"].contains("UNKNOWN")).withColumn("level", F.expr("try_cast(tags['admin_level'] as int)")).where("level between 2 and 7")
    outer = own.select("id", F.posexplode(F.filter("members", lambda m: (m["type"] == "way") & (m["role"] == "outer"))).alias("pos", "m")).select(F.col("id").alias("area_id"), "pos", F.col("m.ref").alias("id"))
    rings = outer.join(way_points(ways.join(outer.select("id").distinct(), "id", "left_semi"), nodes), "id").groupBy("area_id").agg(F.array_sort(F.collect_list(F.struct("pos", "lats", "lons"))).alias("x"))
    named = own.select(F.col("id").alias("area_id"), t["name"].alias("name"), "level", F.coalesce(t["postal_code"], F.lit("")).alias("postcode"))
    return named.join(rings.select("area_id", F.flatten("x.lats").alias("lats"), F.flatten("x.lons").alias("lons")), "area_id")


def streets(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, name, lat, lon) of named ways of the street classes, at the middle of their box's diagonal."""
    own = ways.where(F.col("tags")["highway"].isin(*STREETS) & (display_name(F.col("tags")) != ""))
    rows = own.join(way_points(own, nodes), "id")
    lat, lon = geo.midpoint(F.array_min("lats"), F.array_min("lons"), F.array_max("lats"), F.array_max("lons"))
    return rows.select("id", display_name(F.col("tags")).alias("name"), lat.alias("lat"), lon.alias("lon"))
