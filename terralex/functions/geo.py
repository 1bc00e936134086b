"""Distances, boxes, circles and polygons as column expressions. Degrees in, kilometres out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Radius of the earth in km, and in m for the planar circle test.
EARTH_KM, EARTH_M = 6371.0, 6371007.0


def num(x: float | Column) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def rounded(x: Column, digits: int = 6) -> Column:
    """round() of doubles by arithmetic, half away from zero, as DuckDB does it: Spark's goes through decimals, which takes far longer than a distance."""
    t = F.abs(x) * 10.0**digits
    up = (F.floor(t) + F.when(t - F.floor(t) >= 0.5, 1).otherwise(0)) / 10.0**digits
    return F.when(t < 2.0**52, F.when(x < 0, 0.0 - up).otherwise(up)).otherwise(x)


def haversine_square(lat1: Column, lon1: Column, lat2: Column, lon2: Column, cos1: Column | None = None, cos2: Column | None = None) -> Column:
    """Square of the sine of half the angle between two points. cos1, cos2: cosines of the latitudes, where a join's sides have them already."""
    half = lambda x: (1.0 - F.cos(x)) / 2.0
    cos1, cos2 = F.cos(F.radians(lat1)) if cos1 is None else cos1, F.cos(F.radians(lat2)) if cos2 is None else cos2
    return half(F.radians(lat2 - lat1)) + cos1 * cos2 * half(F.radians(lon2 - lon1))


def haversine_of(h: Column) -> Column:
    """Kilometres for a haversine_square."""
    # greatest() and least() pass over nulls, so rounding errors are cut off by cases
    return F.asin(F.sqrt(F.when(h > 1.0, 1.0).when(h < 0.0, 0.0).otherwise(h))) * (2.0 * EARTH_KM)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return haversine_of(haversine_square(lat1, lon1, lat2, lon2))


def equirect(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """A pseudo-distance whose arguments are degrees taken as radians; kept for parity of nearest-neighbour order."""
    x, y = (lon2 - lon1) * F.cos((lat1 + lat2) / 2.0), lat2 - lat1
    return F.sqrt(x * x + y * y) * EARTH_KM


def to_box(lat: Column, lon: Column, lo_lat: Column, lo_lon: Column, hi_lat: Column, hi_lon: Column) -> Column:
    """Least pseudo-distance of a point to a box."""
    return equirect(lat, lon, F.least(F.greatest(lat, lo_lat), hi_lat), F.least(F.greatest(lon, lo_lon), hi_lon))


def from_box(lat: Column, lon: Column, lo_lat: Column, lo_lon: Column, hi_lat: Column, hi_lon: Column) -> Column:
    """Largest pseudo-distance of a point to the corners of a box."""
    def square(a: Column, b: Column) -> Column:
        x, y = (b - lon) * F.cos((lat + a) / 2.0), a - lat
        return x * x + y * y

    # roots keep the order, so one is enough
    return F.sqrt(F.greatest(*(square(a, b) for a in (lo_lat, hi_lat) for b in (lo_lon, hi_lon)))) * EARTH_KM


def midpoint(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> tuple[Column, Column]:
    """Latitude and longitude of the middle of the great circle between two points."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    return midpoint_of(F.sin(a), F.cos(a), F.radians(lon1), F.sin(b), F.cos(b), F.cos(d), F.sin(d))


def midpoint_of(sin1: Column, cos1: Column, lon1: Column, sin2: Column, cos2: Column, cos_d: Column, sin_d: Column) -> tuple[Column, Column]:
    """midpoint() from sines and cosines of the latitudes and of the difference of longitudes, and the first longitude in radians."""
    x, y = cos2 * cos_d, cos2 * sin_d
    lat = F.atan2(sin1 + sin2, F.sqrt((cos1 + x) * (cos1 + x) + y * y))
    return F.degrees(lat), F.degrees(lon1 + F.atan2(y, cos1 + x))


def destination(lat: Column, lon: Column, bearing: Column, km: Column) -> tuple[Column, Column]:
    """The point at a distance along a bearing in degrees."""
    a, t, d = F.radians(lat), F.radians(bearing), km / EARTH_KM
    to = F.asin(F.sin(a) * F.cos(d) + F.cos(a) * F.sin(d) * F.cos(t))
    return F.degrees(to), F.degrees(F.radians(lon) + F.atan2(F.sin(t) * F.sin(d) * F.cos(a), F.cos(d) - F.sin(a) * F.sin(to)))


def overlaps(a: str, b: str) -> Column:
    """Strict overlap of two boxes with columns <prefix>lo_lat, lo_lon, hi_lat, hi_lon; boxes that touch don't overlap."""
    return (F.col(f"{a}lo_lat") < F.col(f"{b}hi_lat")) & (F.col(f"{b}lo_lat") < F.col(f"{a}hi_lat")) & (F.col(f"{a}lo_lon") < F.col(f"{b}hi_lon")) & (F.col(f"{b}lo_lon") < F.col(f"{a}hi_lon"))


def same(a: str, b: str) -> Column:
    """Whether two boxes have the same corners."""
    return (F.col(f"{a}lo_lat") == F.col(f"{b}lo_lat")) & (F.col(f"{a}lo_lon") == F.col(f"{b}lo_lon")) & (F.col(f"{a}hi_lat") == F.col(f"{b}hi_lat")) & (F.col(f"{a}hi_lon") == F.col(f"{b}hi_lon"))


def united(a: str, b: str) -> dict[str, Column]:
    """The least box around two, by column."""
    return {f"lo_{x}": F.least(f"{a}lo_{x}", f"{b}lo_{x}") for x in ("lat", "lon")} | {f"hi_{x}": F.greatest(f"{a}hi_{x}", f"{b}hi_{x}") for x in ("lat", "lon")}


def box_area(box: str = "") -> Column:
    """Square degrees of a box."""
    return (F.col(f"{box}hi_lat") - F.col(f"{box}lo_lat")) * (F.col(f"{box}hi_lon") - F.col(f"{box}lo_lon"))


def contains(lat: Column, lon: Column, box: str = "") -> Column:
    """A point in or on a box."""
    return lat.between(F.col(f"{box}lo_lat"), F.col(f"{box}hi_lat")) & lon.between(F.col(f"{box}lo_lon"), F.col(f"{box}hi_lon"))


def upper_median(values: Column) -> Column:
    """The item at half the length of the sorted list."""
    return F.try_element_at(F.array_sort(values), (F.floor(F.size(values) / 2) + 1).cast("int"))


def in_circle(lat: Column, lon: Column, c_lat: Column, c_lon: Column, radius: Column) -> Column:
    return haversine(lat, lon, c_lat, c_lon) <= radius


def crosses_circle(lat1: Column, lon1: Column, lat2: Column, lon2: Column, c_lat: Column, c_lon: Column, radius: Column) -> Column:
    """Whether the straight line from one point to another meets a circle (radius in km), on a plane around its center. A line without length meets nothing."""
    px = lambda lon: F.radians(lon - c_lon) * F.cos(F.radians(c_lat)) * EARTH_M
    py = lambda lat: F.radians(lat - c_lat) * EARTH_M
    x1, y1, x2, y2, r = px(lon1), py(lat1), px(lon2), py(lat2), radius * 1000.0
    dx, dy = x2 - x1, y2 - y1
    a, b, c = dx * dx + dy * dy, 2.0 * (x1 * dx + y1 * dy), x1 * x1 + y1 * y1 - r * r
    disc = b * b - 4.0 * a * c
    safe = F.when(a != 0.0, a).otherwise(F.lit(1.0))
    root = F.sqrt(F.when(disc >= 0.0, disc).otherwise(F.lit(0.0)))
    low, high = (-b - root) / (2.0 * safe), (-b + root) / (2.0 * safe)
    return F.coalesce((a != 0.0) & (disc >= 0.0) & (low.between(0.0, 1.0) | high.between(0.0, 1.0)), F.lit(False))


def winding(lat: Column, lon: Column, lats: Column, lons: Column) -> Column:
    """Winding number of an open ring (the edge from the last point to the first isn't closed) around a point."""
    k = F.when(F.size(lats) > 1, F.sequence(F.lit(0), F.size(lats) - 2)).otherwise(F.array().cast("array<int>"))

    def step(acc: Column, i: Column) -> Column:
        y1, x1, y2, x2 = F.get(lats, i), F.get(lons, i), F.get(lats, i + 1), F.get(lons, i + 1)
        side = (x2 - x1) * (lat - y1) - (lon - x1) * (y2 - y1)
        return acc + F.when((y1 <= lat) & (y2 > lat) & (side > 0), 1).when((y1 > lat) & (y2 <= lat) & (side < 0), -1).otherwise(0)

    return F.aggregate(k, F.lit(0), step)


def near_edge(lat: Column, lon: Column, lats: Column, lons: Column) -> Column:
    """Whether the point is in the box of one of the ring's edges."""
    k = F.when(F.size(lats) > 1, F.sequence(F.lit(0), F.size(lats) - 2)).otherwise(F.array().cast("array<int>"))
    pair = lambda a, i: (F.get(a, i), F.get(a, i + 1))
    between = lambda x, ends: x.between(F.least(*ends), F.greatest(*ends))
    return F.exists(k, lambda i: between(lat, pair(lats, i)) & between(lon, pair(lons, i)))


def in_polygon(lat: Column, lon: Column, lats: Column, lons: Column, strict: bool = False) -> Column:
    """Winding number other than 0. Unless strict, a point in the box of an edge is inside, too."""
    inside = winding(lat, lon, lats, lons) != 0
    return inside if strict else inside | near_edge(lat, lon, lats, lons)
