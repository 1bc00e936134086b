"""Circular geofences: how a moving point's last step relates to the circles nearest to it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from .spatial import nearest

#: Circles of a fence that are judged for a position.
NEAREST = 3


def upsert(changes: DataFrame) -> DataFrame:
    """(fence, key, lat, lon, radius): the last of the changes (with column seq) to each circle; a change without radius deletes it."""
    last = Window.partitionBy("fence", "key").orderBy(F.desc("seq"))
    return changes.withColumn("n", F.row_number().over(last)).where("n = 1 and radius is not null").select("fence", "key", "lat", "lon", "radius")


def created(fences: DataFrame, names: DataFrame) -> DataFrame:
    """Fences (fence) with new ones; ValueError if a name is taken already or given twice."""
    taken = names.select("fence").unionByName(fences.select("fence").distinct()).groupBy("fence").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(5).collect()
    if taken:
        raise ValueError(f"fences exist already: {sorted(r['fence'] for r in taken)}")
    return fences.select("fence").unionByName(names.select("fence"))


def deleted(fences: DataFrame, circles: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fences and circles without those of the named fences; names that aren't there don't matter."""
    return tuple(t.join(names.select("fence"), "fence", "left_anti").select(*t.columns) for t in (fences, circles))


def known(fences: DataFrame, rows: DataFrame) -> DataFrame:
    """rows, if all their fences exist; ValueError if not."""
    missing = rows.select("fence").distinct().join(fences.select("fence"), "fence", "left_anti").limit(5).collect()
    if missing:
        raise ValueError(f"no such fence: {sorted(r['fence'] for r in missing)}")
    return rows


def positioned(positions: DataFrame, moves: DataFrame) -> DataFrame:
    """(point_id, lat, lon): stored positions after moves (move_id, point_id, ts, lat, lon), without any fence being judged."""
    last = moves.groupBy("point_id").agg(F.max_by(F.struct("lat", "lon"), F.struct("ts", "move_id")).alias("p")).select("point_id", "p.lat", "p.lon")
    return positions.select("point_id", "lat", "lon").join(last, "point_id", "left_anti").unionByName(last)


def steps(moves: DataFrame, positions: DataFrame | None = None) -> DataFrame:
    """Moves (move_id, point_id, ts, lat, lon) with the position before: null at the first sighting, unless positions (point_id, lat, lon) have one."""
    w = Window.partitionBy("point_id").orderBy("ts", "move_id")
    out = moves.withColumns({"old_lat": F.lag("lat").over(w), "old_lon": F.lag("lon").over(w)})
    if positions is None:
        return out
    stored = positions.select("point_id", F.col("lat").alias("__lat"), F.col("lon").alias("__lon"))
    first = F.row_number().over(w) == 1
    out = out.withColumn("__first", first).join(stored, "point_id", "left")
    return out.withColumns({f"old_{c}": F.when(F.col("__first"), F.col(f"__{c}")).otherwise(F.col(f"old_{c}")) for c in ("lat", "lon")}).drop("__first", "__lat", "__lon")


def classify(moved: DataFrame, circles: DataFrame, k: int = NEAREST) -> DataFrame:
    """(move_id, point_id, fence, key, status) of steps against circles: the k nearest by center of the step's fence, or of each fence if steps have no column fence.

    in, in: INSIDE. in, out: EXIT and OUTSIDE. out, in: ENTER and INSIDE. out, out: CROSS if the step meets the circle,
    else OUTSIDE. At the first sighting the position before is outside and can't cross. A step without a position
    has no events; a step after one without a position is a first sighting. Circles are found by the grid, however many there are.
    """
    own = circles.select("fence", F.col("key").alias("id"), "lat", "lon", F.col("lat").alias("c_lat"), F.col("lon").alias("c_lon"), "radius")
    if "fence" not in moved.columns:  # each step is judged against each fence: the result has that many rows
        moved = moved.crossJoin(circles.select("fence").distinct())
    steps_ = moved.select(F.struct("move_id", "fence").alias("query_id"), "point_id", "fence", "lat", "lon", "old_lat", "old_lon", F.col("lat").alias("new_lat"), F.col("lon").alias("new_lon"))
    found = nearest(steps_, own, k, by=("fence",), keep=("point_id", "old_lat", "old_lon", "new_lat", "new_lon", "c_lat", "c_lon", "radius"))
    ranked = found.select("query_id.move_id", "query_id.fence", F.col("id").alias("key"), "point_id", "old_lat", "old_lon", F.col("new_lat").alias("lat"), F.col("new_lon").alias("lon"), "c_lat", "c_lon", "radius")
    at = lambda p: (F.col(f"{p}lat"), F.col(f"{p}lon"), F.col("c_lat"), F.col("c_lon"))
    now = geo.in_circle(*at(""), F.col("radius"))
    before = F.coalesce(geo.in_circle(*at("old_"), F.col("radius")), F.lit(False))
    meets = geo.crosses_circle(F.col("old_lat"), F.col("old_lon"), F.col("lat"), F.col("lon"), F.col("c_lat"), F.col("c_lon"), F.col("radius"))
    one = lambda *names: F.array(*(F.lit(n) for n in names))
    status = F.when(before & now, one("INSIDE")).when(before, one("EXIT", "OUTSIDE")).when(now, one("ENTER", "INSIDE")).when(meets, one("CROSS")).otherwise(one("OUTSIDE"))
    return ranked.select("move_id", "point_id", "fence", "key", F.explode(status).alias("status"))
