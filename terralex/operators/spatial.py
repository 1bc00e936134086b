"""Nearest places, radius search, box and polygon joins over a grid of cells.

Spark has no spatial join, so both sides are put into cells of a grid and joined on the cell; the exact predicate
follows. Cells are as large as the radius in question, so a query meets few of them and no side is replicated to all.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..sources.scratch import Shelf
from ..sources import tables
from ..sources.tables import many_to_many

#: Kilometres of a degree of latitude.
DEGREE = math.pi * geo.EARTH_KM / 180
#: The column of the cell that is a whole band.
BAND = -(1 << 60)
METRICS = {"equirect": geo.equirect, "haversine": geo.haversine}


def columns_around(size: float) -> int:
    """Cells around the globe: a whole number of them, each at least as wide as they are high."""
    return max(1, math.floor(360.0 / size))


def cell(lat: Column, lon: Column, size: float) -> Column:
    n = columns_around(size)
    return F.struct(F.floor((lat + 90.0) / size).alias("y"), F.pmod(F.floor((lon + 180.0) / (360.0 / n)), F.lit(n)).alias("x"))


def cells(lo_lat: Column, lo_lon: Column, hi_lat: Column, hi_lon: Column, size: float) -> Column:
    """All cells that a box meets, around the date line if it must be."""
    n = columns_around(size)
    row = F.sequence(F.floor((lo_lat + 90.0) / size), F.floor((hi_lat + 90.0) / size))
    first, last = F.floor((lo_lon + 180.0) / (360.0 / n)), F.floor((hi_lon + 180.0) / (360.0 / n))
    column = F.transform(F.sequence(F.lit(0).cast("bigint"), F.least(last - first, F.lit(n - 1).cast("bigint"))), lambda k: F.pmod(first + k, F.lit(n)))
    return F.flatten(F.transform(row, lambda y: F.transform(column, lambda x: F.struct(y.alias("y"), x.alias("x")))))


def around(lat: Column, lon: Column, km: float) -> tuple[Column, Column, Column, Column]:
    """A box that holds all points within a distance."""
    d = km / DEGREE * (1 + 1e-9)
    lo, hi = F.greatest(lat - d, F.lit(-90.0)), F.least(lat + d, F.lit(90.0))
    widest = F.cos(F.radians(F.greatest(F.abs(lo), F.abs(hi))))
    half = F.when((lo > -90.0) & (hi < 90.0) & (widest > 1e-6), F.least(F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.lit(min(d, 90.0) * math.pi / 180)) / widest))), F.lit(180.0))).otherwise(F.lit(180.0))
    return lo, lon - half, hi, lon + half


def within(queries: DataFrame, places: DataFrame, km: float, feature: str | None = None) -> DataFrame:
    """(query_id, id, dist) of places (id, lat, lon, features) within a distance (haversine) of queries (query_id, lat, lon)."""
    size = min(45.0, max(km / DEGREE, 1e-4))
    left = queries.select("query_id", F.col("lat").alias("qlat"), F.col("lon").alias("qlon")).where("qlat is not null and qlon is not null")
    left = left.select("*", F.explode(cells(*around(F.col("qlat"), F.col("qlon"), km), size)).alias("cell"))
    right = places if feature is None else places.where(F.array_contains("features", feature))
    right = right.select("id", "lat", "lon", cell(F.col("lat"), F.col("lon"), size).alias("cell"))
    dist = geo.haversine(F.col("qlat"), F.col("qlon"), F.col("lat"), F.col("lon"))
    return left.join(right, "cell").withColumn("dist", dist).where(F.col("dist") <= km).select("query_id", "id", "dist")


def page(hits: DataFrame, k: int, offset: int = 0, digits: int = 6) -> DataFrame:
    """The offset+1st to offset+kth nearest of each query, ties by id; beyond the last hit the page is empty."""
    rows = hits.withColumn("dist", F.round("dist", digits))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("dist", "id")).cast("bigint"))
    return ranked.where((F.col("rank") > offset) & (F.col("rank") <= offset + k))


def nearby(queries: DataFrame, places: DataFrame, feature: str | None, km: float = 5.0, k: int = 10, offset: int = 0) -> DataFrame:
    """(query_id, id, dist, rank): places with a feature within a radius, nearest first."""
    return page(within(queries, places, km, feature), k, offset)


def flattest(lo: Column, hi: Column) -> Column:
    """The least |cos| between two numbers."""
    zero = F.floor((lo - math.pi / 2) / math.pi) != F.floor((hi - math.pi / 2) / math.pi)
    return F.when(zero, 0.0).otherwise(F.least(F.abs(F.cos(lo)), F.abs(F.cos(hi))))


def plane(left: DataFrame, known: DataFrame, d: float, bands: bool) -> tuple[DataFrame, DataFrame]:
    """Queries (qlat, qlon) and places (lat, lon) with the cells in which those within the pseudo-distance d (in degrees) meet.

    The pseudo-distance scales longitudes by the cosine of the mean latitude taken as radians. Where that isn't near zero it
    bounds longitudes, too, and cells are squares. With `bands`, places are also in a cell for their whole band of
    latitude, which queries near a zero use.
    """
    c = flattest(F.col("qlat") - d / 2, F.col("qlat") + d / 2)
    at = lambda x: F.floor((x + 720.0) / d)
    wide = c < 0.125
    rows, half = F.sequence(at(F.col("qlat") - d), at(F.col("qlat") + d)), d / F.greatest(c, F.lit(0.125)) * (1 + 1e-9)
    columns = F.when(wide, F.array(F.lit(BAND))).otherwise(F.sequence(at(F.col("qlon") - half), at(F.col("qlon") + half)))
    a = left.withColumn("y", F.explode(rows)).withColumn("x", F.explode(columns))
    y, x = at(F.col("lat")), at(F.col("lon"))
    b = known.withColumns({"y": y, "x": F.explode(F.array(x, F.lit(BAND)))}) if bands else known.withColumns({"y": y, "x": x})
    return a, b


def sphere(left: DataFrame, known: DataFrame, km: float) -> tuple[DataFrame, DataFrame]:
    """Queries and places with the cells in which those within a distance meet."""
    size = min(45.0, max(km / DEGREE, 1e-4))
    a = left.select("*", F.explode(cells(*around(F.col("qlat"), F.col("qlon"), km), size)).alias("cell")).select("*", "cell.*").drop("cell")
    return a, known.select("*", cell(F.col("lat"), F.col("lon"), size).alias("cell")).select("*", "cell.*").drop("cell")


#: Places that are sent to all tasks, at most: 100 bytes each.
BROADCAST_PLACES = 100_000


def nearest(queries: DataFrame, places: DataFrame, k: int = 1, metric: str = "equirect", start_km: float | None = None, by: tuple[str, ...] = (), keep: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, id, dist, rank, *keep): exactly the k nearest places of each query (all of them if there are fewer). With `by`, of the places that agree with it in these columns. keep: columns of either side to carry along. Queries and places without a position have no part.

    A round joins queries with the places around them. A query that has k places within the round's radius is answered, as
    no place outside can be nearer; the others go on with four times the radius. The first radius is where k places are
    expected at the places' mean density, so most queries are answered by one round.
    """
    shelf = Shelf(queries.sparkSession, "nearest")
    dist = METRICS[metric](F.col("qlat"), F.col("qlon"), F.col("lat"), F.col("lon"))
    own = lambda df: [c for c in keep if c in df.columns]
    left = queries.select("query_id", *by, *own(queries), F.col("lat").alias("qlat"), F.col("lon").alias("qlon")).where("qlat is not null and qlon is not null")
    known = places.select("id", *by, "lat", "lon", *(c for c in own(places) if c not in ("lat", "lon"))).where("lat is not null and lon is not null")
    sums = lambda y, x: {"n": F.count(F.lit(1)), **{f"{f.__name__}_{c}": f(c) for f in (F.min, F.max) for c in (y, x)}}
    left, asked = shelf.measured(left, "queries", **sums("qlat", "qlon"))
    groups = {"groups": F.approx_count_distinct(F.struct(*by))} if by else {}
    groups["spots"] = F.approx_count_distinct(F.struct(F.floor(F.col("lat") * 100), F.floor(F.col("lon") * 100)))
    known, there = shelf.measured(known, "places", **sums("lat", "lon"), **groups)
    kind = f"query_id {left.schema['query_id'].dataType.simpleString()}"
    carried = [c for c in keep if c in left.columns or c in known.columns]
    if not asked["n"] or not there["n"]:
        empty = ", ".join([kind, f"id {known.schema['id'].dataType.simpleString()}", "dist double", *(f"`{c}` {(left if c in left.columns else known).schema[c].dataType.simpleString()}" for c in carried), "rank bigint"])
        return queries.sparkSession.createDataFrame([], empty)
    unit, most = (DEGREE, math.pi * geo.EARTH_KM) if metric == "haversine" else (geo.EARTH_KM, 800.0 * geo.EARTH_KM)
    km = start_km if start_km is not None else max(1e-3, unit * math.sqrt((2 * k + 2) / math.pi / density(there)))
    todo, done, round_ = asked["n"], None, 0
    while True:
        last = km >= most
        d = min(km, most)
        if metric == "haversine":
            a, b = sphere(left, known, d)
        else:
            lo, hi = asked["min_qlat"] - d / unit / 2, asked["max_qlat"] + d / unit / 2
            a, b = plane(left, known, d / unit, bands=hi - lo > 1 or min(abs(math.cos(lo)), abs(math.cos(hi))) < 0.5)
        b = F.broadcast(b) if there["n"] <= BROADCAST_PLACES else b
        hits = a.join(b, ["y", "x", *by]).withColumn("dist", dist)
        hits = hits if last else hits.where(F.col("dist") <= km)
        ranked, seen = shelf.measured(page(hits.select("query_id", "id", "dist", *carried), k), f"hits-{round_}", full=F.count_if(F.col("rank") == k))
        todo -= seen["full"]
        if last or not todo:
            return ranked if done is None else done.unionByName(ranked)
        full = ranked.where(F.col("rank") == k).select("query_id")
        answered = ranked.join(full, "query_id", "left_semi")
        done = answered if done is None else done.unionByName(answered)
        left = left.join(full, "query_id", "left_anti")
        km, round_ = km * 4, round_ + 1


def density(there: dict) -> float:
    """Places of a group for each square degree: of the spots of 0.01 degrees that have any, or of the whole box where places stand further apart."""
    box = max((there["max_lat"] - there["min_lat"]) * (there["max_lon"] - there["min_lon"]), 1e-6)
    area = box if 2 * there["spots"] > there["n"] else min(box, there["spots"] * 1e-4)
    return there["n"] / max(1, there.get("groups", 1)) / area


def reverse_geocode(queries: DataFrame, places: DataFrame, metric: str = "equirect") -> DataFrame:
    """(query_id, id, dist) of the nearest place; none if there are no places."""
    return nearest(queries, places, 1, metric).drop("rank")


def updated(places: DataFrame, changes: DataFrame) -> DataFrame:
    """places after changes (their columns and seq): of an id the last change counts; one without a position deletes."""
    last = Window.partitionBy("id").orderBy(F.desc("seq"))
    new = changes.withColumn("__n", F.row_number().over(last)).where("__n = 1").select(*places.columns)
    return places.join(new.select("id"), "id", "left_anti").select(*places.columns).unionByName(new.where("lat is not null and lon is not null"))


def circle_boxes(circles: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Circles (with a radius in km) with boxes b_lo_lat .. b_hi_lon that hold them with a little to spare."""
    d = F.col("radius") / DEGREE * 1.01
    flat = F.greatest(F.cos(F.radians(F.least(F.abs(F.col(lat)) + d, F.lit(90.0)))), F.lit(1e-6))
    half = F.least(d / flat, F.lit(180.0))
    return circles.withColumns({"b_lo_lat": F.col(lat) - d, "b_hi_lat": F.col(lat) + d, "b_lo_lon": F.col(lon) - half, "b_hi_lon": F.col(lon) + half})


def box_join(points: DataFrame, boxes: DataFrame, size: float = 0.05) -> DataFrame:
    """Rows of points (id, lo_lat .. hi_lon) and boxes (box_id, b_lo_lat .. b_hi_lon) that overlap strictly, once for each pair."""
    a = points.select("*", F.explode(cells(*(F.col(c) for c in ("lo_lat", "lo_lon", "hi_lat", "hi_lon")), size)).alias("cell"))
    b = boxes.select("*", F.explode(cells(*(F.col(f"b_{c}") for c in ("lo_lat", "lo_lon", "hi_lat", "hi_lon")), size)).alias("cell"))
    # of the cells that both boxes meet, one makes the pair: that of the larger lower corner
    corner = cell(F.greatest("lo_lat", "b_lo_lat"), F.greatest("lo_lon", "b_lo_lon"), size)
    return a.join(b, "cell").where(geo.overlaps("", "b_") & (F.col("cell") == corner)).drop("cell")


def in_circles(places: DataFrame, circles: DataFrame, size: float = 0.1) -> DataFrame:
    """(id, query_id) of places (id, lat, lon) and the circles (query_id, qlat, qlon, radius) they are in, as geo.in_circle() has it.

    A place is in one cell, so it meets a circle once. The chord between two points tells their distance without angles;
    only where it is too near the radius to be sure of, the distance itself is computed.
    """
    at = lambda a, o: {"x": F.cos(F.radians(a)) * F.cos(F.radians(o)), "y": F.cos(F.radians(a)) * F.sin(F.radians(o)), "z": F.sin(F.radians(a))}
    key = lambda c: F.shiftleft(c["y"].cast("bigint"), 32) + c["x"].cast("bigint")
    reach = F.when(F.col("radius") < math.pi * geo.EARTH_KM, F.pow(F.sin(F.col("radius") / (2 * geo.EARTH_KM)), 2)).otherwise(2.0)
    a = places.select("id", "lat", "lon", key(cell(F.col("lat"), F.col("lon"), size)).alias("cell")).withColumns(at("lat", "lon"))
    b = circle_boxes(circles.select("query_id", "qlat", "qlon", "radius").where("radius >= 0"), "qlat", "qlon")
    b = b.select("query_id", "qlat", "qlon", "radius", F.explode(F.transform(cells(*(F.col(f"b_{c}") for c in ("lo_lat", "lo_lon", "hi_lat", "hi_lon")), size), key)).alias("cell"))
    b = b.withColumns({f"q{k}": v for k, v in at("qlat", "qlon").items()}).withColumns({"sure": reach * (1 - 1e-9) - 1e-13, "most": reach * (1 + 1e-9) + 1e-13})
    square = lambda k: (F.col(k) - F.col(f"q{k}")) * (F.col(k) - F.col(f"q{k}"))
    h = (square("x") + square("y") + square("z")) / 4.0
    exact = geo.in_circle(F.col("lat"), F.col("lon"), F.col("qlat"), F.col("qlon"), F.col("radius"))
    return many_to_many(a, b, "cell").where((h <= F.col("most")) & ((h <= F.col("sure")) | exact)).select("id", "query_id")


def rays_and_circles(lat: float, lon: float, ends: DataFrame, circles: DataFrame, n: int = 64) -> DataFrame:
    """(id, query_id) of the straight lines from one point to ends (id, lat, lon) and the circles (query_id, qlat, qlon, radius) they cross, as geo.crosses_circle() has it.

    Lines are dealt by their direction in n sectors; a circle is in all sectors between its tangents from the point, so a line meets
    it once. Signs tell whether a line crosses: of the ends' and the nearest point's squared distance, less that of the radius.
    Only where one is too near zero to be sure of, the crossings themselves are computed; these pairs are written first, as within one
    filter the long expression would keep the JVM from compiling it.
    """
    a, o = F.lit(lat), F.lit(lon)
    turn = lambda t: F.floor((t + math.pi) * (n / (2 * math.pi))).cast("bigint")
    # on a plane around the circle's center, in metres, as crosses_circle() has it
    flat, r = F.cos(F.radians("qlat")), F.col("radius") * 1000.0
    c = circles.select("query_id", "qlat", "qlon", "radius", (flat * (geo.EARTH_M * math.pi / 180)).alias("kx"), F.lit(geo.EARTH_M * math.pi / 180).alias("ky"), r.alias("r"), flat.alias("flat"))
    c = c.withColumns({"x1": (o - F.col("qlon")) * F.col("kx"), "y1": (a - F.col("qlat")) * F.col("ky")})
    c = c.withColumn("far", F.sqrt(F.col("x1") * F.col("x1") + F.col("y1") * F.col("y1")))
    to, half = F.atan2(-F.col("y1"), -F.col("x1")), F.asin(F.least(F.lit(1.0), F.abs("r") / F.greatest("far", F.lit(1.0)))) + 1e-6
    degrees = lambda t: F.atan2(F.sin(t) * F.col("flat"), F.cos(t))  # noqa: E731  the direction in degrees, in which lines have theirs
    first, last = turn(degrees(to - half) - 1e-6), turn(degrees(to + half) + 1e-6)
    around_ = (F.col("far") <= F.abs("r") * 1.001 + 1.0) | (F.col("flat") < 1e-3) | first.isNull() | last.isNull()
    sectors = F.when(around_, F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))).otherwise(F.transform(F.sequence(F.lit(0).cast("bigint"), F.least(F.pmod(last - first, F.lit(n)), F.lit(n - 1).cast("bigint"))), lambda k: F.pmod(first + k, F.lit(n))))
    c = c.withColumn("c", F.col("x1") * F.col("x1") + F.col("y1") * F.col("y1") - F.col("r") * F.col("r"))
    c = c.withColumn("near", (F.col("far") * F.col("far") + F.col("r") * F.col("r")) * 1e-9 + 1e-3)
    c = c.where("qlat is not null and qlon is not null and radius is not null").select("query_id", "qlat", "qlon", "radius", "kx", "ky", "x1", "y1", "r", "c", "near", F.explode(sectors).alias("sector"))
    lines = ends.where("lat is not null and lon is not null").select("id", "lat", "lon", F.pmod(turn(F.atan2(F.col("lat") - a, F.col("lon") - o)), F.lit(n)).alias("sector"))
    dx, dy, at = (F.col("lon") - o) * F.col("kx"), (F.col("lat") - a) * F.col("ky"), F.col("c")
    x2, y2 = F.col("x1") + dx, F.col("y1") + dy
    end = x2 * x2 + y2 * y2 - F.col("r") * F.col("r")
    p, q = F.col("x1") * dx + F.col("y1") * dy, dx * dx + dy * dy
    unsure = (F.abs(at) <= F.col("near")) | (F.abs(end) <= F.col("near")) | (F.abs(p * p - q * at) <= p * p * 1e-8)
    exact = geo.crosses_circle(a, o, F.col("lat"), F.col("lon"), F.col("qlat"), F.col("qlon"), F.col("radius"))
    met = ((at < 0) | (end < 0)) & ((at < 0) != (end < 0)) | (at >= 0) & (end >= 0) & (p < 0) & (-p < q) & (p * p > q * at)
    pairs = many_to_many(lines, c, "sector")
    close = Shelf(ends.sparkSession, "rays").put(pairs.where(unsure).select("id", "lat", "lon", "query_id", "qlat", "qlon", "radius"), "close")
    return pairs.where(~unsure & met).select("id", "query_id").unionByName(close.where(exact).select("id", "query_id"))


#: Pairs from which by_middle() deals by middles, and pairs of a task.
MIDDLES, TASK_PAIRS = 1 << 26, 1 << 23


def by_middle(places: DataFrame, points: DataFrame, on: str) -> DataFrame:
    """many_to_many() of places (lat, lon) and points (query_id, qlat, qlon), in an order in which their middles take little room when written.

    Both are dealt to tiles of an eighth of a degree. Tiles whose rows and columns have the same sums have their middles in one cell of that size: about
    125000 different latitudes and longitudes of six digits, which a Parquet dictionary of 1 MB holds. A task gets pairs of one cell, or whole small
    cells. Where there are few pairs, or too many places for all tasks, the order isn't worth its price.
    """
    band = lambda x, n: F.coalesce(F.floor(F.col(x) * n), F.lit(0)).cast("int")
    places = places.withColumns({"py": band("lat", 8), "px": band("lon", 8)})
    points = points.withColumns({"cy": band("qlat", 8), "cx": band("qlon", 8), "sy": band("qlat", 16), "sx": band("qlon", 16)})
    tiles, corners = places.groupBy(on, "py", "px").agg(F.count("*").alias("n")), points.groupBy(on, "cy", "cx").agg(F.count("*").alias("m"))
    sums = [(F.col("cy") + F.col("py")).alias("y"), (F.col("cx") + F.col("px")).alias("x")]
    cells = tiles.join(corners, on).groupBy(*sums).agg(F.sum(F.col("n") * F.col("m")).alias("pairs")).orderBy("y", "x").collect()
    if sum(c.pairs for c in cells) < MIDDLES or places.count() > tables.BROADCAST_ROWS:
        return many_to_many(places.drop("py", "px"), points.drop("cy", "cx", "sy", "sx"), on)
    parts, n, room = [], 0, 0
    for c in cells:
        if c.pairs > room:
            n, room = n + 1, TASK_PAIRS // 8  # more small cells together would overflow a dictionary
        parts.append((c.y, c.x, n - 1, cut := -(-c.pairs // TASK_PAIRS)))
        n, room = n + cut - 1, max(0, room - c.pairs)
    part = F.col("first") + F.pmod(F.xxhash64("query_id", "qlat", "qlon"), F.col("cut")).cast("int")
    legs = points.join(F.broadcast(tiles.drop("n")), on).withColumns(dict(zip("yx", sums))).join(F.broadcast(points.sparkSession.createDataFrame(parts, "y int, x int, first int, cut int")), ["y", "x"])
    legs = tables.in_order(legs.repartitionById(n, part), "y", "x", "py", "px", "sy", "sx", on)
    return legs.drop("y", "x", "cy", "cx", "sy", "sx", "first", "cut").join(F.broadcast(places), [on, "py", "px"]).drop("py", "px")


def polygon_join(points: DataFrame, areas: DataFrame, size: float = 0.05, strict: bool = False) -> DataFrame:
    """Points (id, lat, lon) with the areas (area_id, lats, lons, ...) they are in: cells, then boxes, then the winding number."""
    boxed = areas.select("*", F.array_min("lats").alias("lo_lat"), F.array_min("lons").alias("lo_lon"), F.array_max("lats").alias("hi_lat"), F.array_max("lons").alias("hi_lon"))
    b = boxed.select("*", F.explode(cells(*(F.col(c) for c in ("lo_lat", "lo_lon", "hi_lat", "hi_lon")), size)).alias("cell"))
    a = points.select("*", cell(F.col("lat"), F.col("lon"), size).alias("cell"))
    found = a.join(b, "cell").where(geo.contains(F.col("lat"), F.col("lon")) & geo.in_polygon(F.col("lat"), F.col("lon"), F.col("lats"), F.col("lons"), strict))
    return found.drop("cell", "lo_lat", "lo_lon", "hi_lat", "hi_lon")
