import math
import random

import pytest
from pyspark.sql import functions as F

from terralex.functions import geo
from terralex.operators import address, dedup, geofence, spatial
from terralex.sources import mapdata


def km(a, b, c, d):
    h = (1 - math.cos(math.radians(c - a))) / 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * (1 - math.cos(math.radians(d - b))) / 2
    return 2 * 6371 * math.asin(math.sqrt(min(1, h)))


def pseudo(a, b, c, d):
    return 6371 * math.hypot((d - b) * math.cos((a + c) / 2), c - a)


@pytest.mark.parametrize("metric,f", [("haversine", km), ("equirect", pseudo)])
@pytest.mark.parametrize("box", [(-90, 90, -180, 180), (-6.2, -6.0, 106.1, 107.0), (88, 90, -180, 180), (-5, 5, 178, 180)])
def test_nearest_equals_brute_force(spark, metric, f, box):
    rng = random.Random(7)
    point = lambda: (rng.uniform(box[0], box[1]), rng.uniform(box[2], box[3]))
    places, queries = [(k, *point()) for k in range(150)], [(k, *point()) for k in range(12)] + [(99, None, 1.0)]
    places += [(200, *places[0][1:]), (201, None, None)]
    if box[2] == 178:
        places = [(k, a, o if o is None or k % 2 else o - 358) for k, a, o in places]  # on both sides of the date line
    got = spatial.nearest(spark.createDataFrame(queries, "query_id long, lat double, lon double"), spark.createDataFrame(places, "id long, lat double, lon double"), 4, metric, 50.0)
    for q, a, o in queries:
        mine = [(r.id, r.dist) for r in got.where(F.col("query_id") == q).orderBy("rank").collect()]
        want = [] if a is None else sorted((round(f(a, o, y, x), 6), k) for k, y, x in places if y is not None)[:4]
        assert [d for _, d in mine] == pytest.approx([d for d, _ in want], abs=2e-6)


@pytest.mark.parametrize("metric,f", [("haversine", km), ("equirect", pseudo)])
def test_nearest_by_groups_without_a_first_radius(spark, metric, f):
    rng = random.Random(11)
    places = [(k, "ab"[k % 2], rng.gauss(-6, 0.01) if k % 3 else rng.uniform(-80, 80), rng.gauss(106, 0.01) if k % 3 else rng.uniform(-180, 180), k * 2) for k in range(400)]
    queries = [(k, "ab"[k % 2], rng.uniform(-6.1, -5.9), rng.uniform(105.9, 106.1)) for k in range(10)] + [(k, "a", rng.uniform(-90, 90), rng.uniform(-180, 180)) for k in range(10, 20)] + [(20, "c", 0.0, 0.0)]
    got = spatial.nearest(spark.createDataFrame(queries, "query_id long, g string, lat double, lon double"), spark.createDataFrame(places, "id long, g string, lat double, lon double, more long"), 3, metric, by=("g",), keep=("more",)).collect()
    assert len(got) == 60 and all(r.more == 2 * r.id for r in got)
    for q, g, a, o in queries[:-1]:
        mine = [r.dist for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q]
        assert mine == pytest.approx(sorted(round(f(a, o, y, x), 6) for _, h, y, x, _ in places if h == g)[:3], abs=2e-6)


def test_within_and_feature(spark):
    rng = random.Random(3)
    places = [(k, rng.uniform(-6.3, -6.0), rng.uniform(106.5, 107), [f"amenity={k % 3}"]) for k in range(300)]
    q = spark.createDataFrame([(1, -6.1, 106.8)], "query_id long, lat double, lon double")
    p = spark.createDataFrame(places, "id long, lat double, lon double, features array<string>")
    got = sorted(r.id for r in spatial.within(q, p, 6.0, "amenity=1").collect())
    assert got == sorted(k for k, a, o, _ in places if k % 3 == 1 and km(-6.1, 106.8, a, o) <= 6)
    assert spatial.nearby(q, p, "amenity=1", 6.0, 5, offset=len(got)).count() == 0
    assert spatial.nearby(q, p, "amenity=9").count() == 0
    assert spatial.reverse_geocode(q, p.limit(0)).count() == 0


def test_box_join_equals_brute_force(spark):
    rng = random.Random(5)
    box = lambda k: (k, *(v := (rng.uniform(-1, 1), rng.uniform(-1, 1))), v[0] + rng.uniform(0, 0.3), v[1] + rng.uniform(0, 0.3))
    a, b = [box(k) for k in range(60)] + [(100, 0.0, 0.0, 1.0, 1.0)], [box(k) for k in range(60)] + [(100, 1.0, 0.0, 2.0, 1.0)]
    want = {(x[0], y[0]) for x in a for y in b if x[1] < y[3] and y[1] < x[3] and x[2] < y[4] and y[2] < x[4]}
    left = spark.createDataFrame(a, "id long, lo_lat double, lo_lon double, hi_lat double, hi_lon double")
    right = spark.createDataFrame(b, "box_id long, b_lo_lat double, b_lo_lon double, b_hi_lat double, b_hi_lon double")
    got = [(r.id, r.box_id) for r in spatial.box_join(left, right).collect()]
    assert len(got) == len(set(got)) and set(got) == want and (100, 100) not in want


def test_polygons(spark):
    concave = ([0.0, 0.0, 2.0, 0.5, 2.0], [0.0, 4.0, 4.0, 2.0, 0.0])
    rows = [(1, 0.3, 2.0), (2, 1.8, 2.0), (3, 1.0, 0.5), (4, 5.0, 5.0), (5, 0.0, 1.0)]
    got = {r.id: (r.strict, r.loose) for r in spark.createDataFrame(rows, "id int, lat double, lon double").select("id", *(geo.in_polygon(F.col("lat"), F.col("lon"), F.array(*map(F.lit, concave[0] + [0.0])), F.array(*map(F.lit, concave[1] + [0.0])), s).alias(n) for s, n in ((True, "strict"), (False, "loose")))).collect()}
    assert got[1][0] and not got[2][0] and got[3][0] and got[4] == (False, False) and got[5][1]
    empty = spark.range(1).select(geo.in_polygon(F.lit(0.0), F.lit(0.0), F.array().cast("array<double>"), F.array().cast("array<double>")).alias("x")).first().x
    assert empty is False


def test_circle_and_segment(spark):
    c = [F.lit(-7.56), F.lit(110.79), F.lit(1.0)]
    rows = [(1, -7.56, 110.78, -7.56, 110.80), (2, -7.50, 110.78, -7.50, 110.80), (3, -7.5, 110.7, -7.5, 110.7), (4, -7.561, 110.79, -7.50, 110.79)]
    got = {r.id: r.x for r in spark.createDataFrame(rows, "id int, a double, b double, c double, d double").select("id", geo.crosses_circle(*(F.col(k) for k in "abcd"), *c).alias("x")).collect()}
    assert got == {1: True, 2: False, 3: False, 4: True}


MOVES = [(1, 7, 1, -6.2), (2, 7, 2, -6.1), (3, 7, 3, -6.0), (4, 7, 4, -6.001), (5, 7, 5, -5.9), (6, 7, 6, -5.9), (7, 7, 7, -6.1)]


def fences(spark):
    return spark.createDataFrame([("f", 1, -6.0, 106.0, 1.0)], "fence string, key long, lat double, lon double, radius double")


def moves(spark):
    return spark.createDataFrame([(m, p, t, lat, 106.0) for m, p, t, lat in MOVES], "move_id long, point_id long, ts long, lat double, lon double").withColumn("ts", F.timestamp_seconds("ts"))


def test_transitions(spark):
    got = sorted((r.move_id, r.status) for r in geofence.classify(geofence.steps(moves(spark)), fences(spark)).collect())
    want = [(1, "OUTSIDE"), (2, "OUTSIDE"), (3, "ENTER"), (3, "INSIDE"), (4, "INSIDE"), (5, "EXIT"), (5, "OUTSIDE"), (6, "OUTSIDE"), (7, "CROSS")]
    assert got == want


def test_steps_without_a_position(spark):
    rows = [(1, 7, 1, -6.0, 106.0), (2, 7, 2, None, None), (3, 7, 3, -6.0, 106.0)]
    moved = geofence.steps(spark.createDataFrame(rows, "move_id long, point_id long, ts long, lat double, lon double").withColumn("ts", F.timestamp_seconds("ts")))
    for n in (5, 300):
        circles = spark.createDataFrame([("f", k, -6.0 + k / 10, 106.0, 1.0) for k in range(n)], "fence string, key long, lat double, lon double, radius double")
        got = sorted((r.move_id, r.key, r.status) for r in geofence.classify(moved, circles).collect())
        want = [(m, k, s) for m in (1, 3) for k, s in ((0, "ENTER"), (0, "INSIDE"), (1, "OUTSIDE"), (2, "OUTSIDE"))]
        assert got == want
    assert geofence.classify(moved, circles.limit(0)).count() == 0


def test_stream_over_batches_and_a_restart(spark, tmp_path):
    from terralex.streaming.geofence import watch

    source = tmp_path / "in"
    for k, part in enumerate((MOVES[:2], MOVES[2:5], MOVES[5:])):
        rows = moves(spark).where(F.col("move_id").isin([m[0] for m in part]))
        rows.coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(rows.schema).parquet(str(source))
        watch(stream, fences(spark), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = sorted((r.move_id, r.status) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted((r.move_id, r.status) for r in geofence.classify(geofence.steps(moves(spark)), fences(spark)).collect())


def test_upsert_and_delete(spark):
    rows = [("f", 1, 1, 0.0, 0.0, 1.0), ("f", 1, 2, 0.0, 0.0, 2.0), ("f", 2, 1, 0.0, 0.0, 1.0), ("f", 2, 2, None, None, None)]
    got = geofence.upsert(spark.createDataFrame(rows, "fence string, key long, seq long, lat double, lon double, radius double")).collect()
    assert [(r.key, r.radius) for r in got] == [(1, 2.0)]


def test_ways_are_folded_in_order(spark):
    rows = [(1, "A", 0, 0, 4, 4), (2, "a", 1, 1, 2, 2), (3, "a", 9, 9, 10, 10), (4, "a", 1, 1, 2, 2), (5, "a", 0, 0, 3, 3), (6, "b", 0, 0, 1, 1)]
    ways = spark.createDataFrame([(i, n, *map(float, b)) for i, n, *b in rows], "id long, name string, lo_lat double, lo_lon double, hi_lat double, hi_lon double")
    # 2 is in 1; 3 is apart; 4 is apart from 3; 5 holds 4 and takes its place
    assert sorted(r.id for r in dedup.unique_ways(ways).collect()) == [1, 3, 4, 6]
    nodes = spark.createDataFrame([(1, "A", 2.5, 2.5), (2, "A", 3.5, 1.0), (3, "c", 0.5, 0.5)], "id long, name string, lat double, lon double")
    assert sorted(r.id for r in dedup.unique_nodes(nodes, ways).collect()) == [2, 3]


def test_numbering_is_dense(spark):
    got = dedup.numbered(spark.range(1000).withColumn("x", (F.col("id") * 37) % 1000), "x").orderBy("doc_id").collect()
    assert [r.doc_id for r in got] == list(range(1, 1001)) and [r.x for r in got] == list(range(1000))


def test_map_extract_to_addresses(spark):
    nodes = spark.createDataFrame([(k, float(k % 10) / 10, float(k // 10) / 10, {"name": "Spot", "historic": "yes"} if k == 55 else {}) for k in range(100)], "id long, lat double, lon double, tags map<string,string>")
    ways = spark.createDataFrame([
        (1, [11, 12, 21], {"name": "Shop", "shop": "food", "addr:housenumber": "5", "short_name": "S"}), (2, [0, 9], {"note": "x"}), (3, [22, 23], {"name": "Main", "highway": "primary"}),
        (4, [0, 9, 99, 90, 0], {}), (5, [77, 1234], {"name": "Gap", "amenity": "x"}), (6, [33], {"name": "Hut", "tourism": "chalet"}),
    ], "id long, node_ids array<long>, tags map<string,string>")
    members = "array<struct<type:string,ref:long,role:string>>"
    relations = spark.createDataFrame([
        (10, {"boundary": "administrative", "name": "Ward", "admin_level": "7", "postal_code": "999"}, [("way", 4, "outer"), ("way", 2, "inner")]),
        (11, {"boundary": "administrative", "name": "Land", "admin_level": "2"}, [("way", 4, "outer")]), (12, {"boundary": "administrative", "name": "UNKNOWN x", "admin_level": "7"}, [("way", 4, "outer")]), (13, {"boundary": "administrative", "name": "Bad", "admin_level": "a"}, []),
    ], f"id long, tags map<string,string>, members {members}")
    places = mapdata.way_places(ways, nodes)
    got = {r.id: r for r in places.collect()}
    assert set(got) == {1, 3, 5} and got[1].name == "Shop (S)" and got[1].type == "shop" or got[1].type == "food"
    assert (got[1].lat, got[1].lon) == (0.1, 0.1) and got[1].features == ["shop=food"]
    assert [r.name for r in mapdata.node_places(nodes).collect()] == ["Spot"]
    areas = mapdata.boundaries(relations, ways, nodes)
    assert {r.name: len(r.lats) for r in areas.collect()} == {"Ward": 5, "Land": 5}
    streets = mapdata.streets(ways, nodes)
    found = {r.id: r.address for r in address.addresses(places, areas, streets).collect()}
    assert found[1] == "Main, 5, Ward, 999, Land"
