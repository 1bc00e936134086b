"""Address assembly: street, house number and the administrative areas around a place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..sources.mapdata import point_boxes
from .spatial import box_join, nearest

#: Levels of an address, from the smallest area to the country.
LEVELS = (7, 6, 5, 4)
COUNTRY = 2


def areas_at(points: DataFrame, areas: DataFrame) -> DataFrame:
    """(id, area_id, name, level, postcode, inside): areas whose box overlaps that of the point, and whether the polygon holds the point."""
    boxes = areas.select(F.struct("area_id", "name", "level", "postcode", "lats", "lons").alias("area"), F.array_min("lats").alias("b_lo_lat"), F.array_min("lons").alias("b_lo_lon"), F.array_max("lats").alias("b_hi_lat"), F.array_max("lons").alias("b_hi_lon"))
    found = box_join(point_boxes(points.select("id", "lat", "lon")), boxes).select("id", "lat", "lon", "area.*")
    return found.select("id", "area_id", "name", "level", "postcode", geo.in_polygon(F.col("lat"), F.col("lon"), F.col("lats"), F.col("lons")).alias("inside"))


def addresses(places: DataFrame, areas: DataFrame, streets: DataFrame) -> DataFrame:
    """(id, address, city) of places (id, lat, lon, street, postcode, house).

    Parts in order: the street (the nearest one if none is given), house number, areas of levels 7 to 4 that hold the
    place, postcode, country. Of several areas of a level the first by id counts, of level 4 the last; the country is the first
    whose box holds the place; a missing postcode is that of the first level-7 box. Empty parts are left out.
    """
    near = nearest(places.where("coalesce(street, '') = ''").select(F.col("id").alias("query_id"), "lat", "lon"), streets, 1).join(streets.select("id", F.col("name").alias("near")), "id").select(F.col("query_id").alias("id"), "near")
    hits = areas_at(places, areas)
    first = lambda level: F.min_by(F.when(F.col("level") == level, F.col("name")), F.when((F.col("level") == level) & F.col("inside"), F.col("area_id")))
    found = hits.groupBy("id").agg(
        *(first(n).alias(f"l{n}") for n in LEVELS[:-1]),
        F.max_by("name", F.when((F.col("level") == LEVELS[-1]) & F.col("inside"), F.col("area_id"))).alias(f"l{LEVELS[-1]}"),
        F.min_by("name", F.when(F.col("level") == COUNTRY, F.col("area_id"))).alias("country"),
        F.min_by("postcode", F.when(F.col("level") == LEVELS[0], F.col("area_id"))).alias("code"),
    )
    empty = lambda c: F.when(F.col(c) != "", F.col(c))
    rows = places.join(near, "id", "left").join(found, "id", "left")
    parts = [F.coalesce(empty("street"), empty("near")), empty("house"), *(empty(f"l{n}") for n in LEVELS), F.coalesce(empty("postcode"), empty("code")), empty("country")]
    return rows.select("id", F.concat_ws(", ", *parts).alias("address"), F.col("l5").alias("city"))
