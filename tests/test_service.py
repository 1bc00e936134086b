import json
import math

import pytest
from pyspark.sql import functions as F

from terralex.functions import geo
from terralex.operators import geofence, lm, rank, service, spatial
from terralex.operators import index as ix

PLACES = [
    (1, "Dunia Fantasi", "Jalan Lodan Timur Ancol", -6.125, 106.833, ["tourism=park"]), (2, "Kebun Binatang Ragunan", "Jalan Harsono Ragunan", -6.312, 106.820, ["tourism=zoo"]),
    (3, "Monumen Nasional", "Gambir Jakarta Pusat", -6.175, 106.827, ["historic=monument"]), (4, "Taman Mini Indonesia", "Jalan Taman Mini", -6.302, 106.895, ["tourism=park"]), (5, "Dunia Baru", "Jalan Kebun Jeruk", -6.19, 106.77, ["shop=mall"]),
]


@pytest.fixture(scope="module")
def searcher(spark, tmp_path_factory):
    docs = spark.createDataFrame(PLACES, "doc_id long, name string, address string, lat double, lon double, features array<string>")
    return service.Searcher.build(spark, docs, f"file://{tmp_path_factory.mktemp('engine')}")


def km(a, b, c, d):
    h = (1 - math.cos(math.radians(c - a))) / 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * (1 - math.cos(math.radians(d - b))) / 2
    return 2 * 6371 * math.asin(math.sqrt(h))


@pytest.mark.parametrize("query,name", [("Dunia Fantasi", "Dunia Fantasi"), ("Duniu Fsntaso", "Dunia Fantasi"), ("Kebun Bibatqng Raginan", "Kebun Binatang Ragunan")])
def test_free_form_query_corrects_unknown_words(searcher, query, name):
    first = searcher.free_form_query(query, 10, 0, -6.2, 106.8).orderBy("rank").first()
    place = next(p for p in PLACES if p[1] == name)
    assert first.name == name and first.distance == pytest.approx(km(-6.2, 106.8, place[3], place[4]), abs=1e-5)
    assert searcher.free_form_query(query, offset=10).count() == 0


@pytest.mark.parametrize("query,name", [("Monumen Nasi", "Monumen Nasional"), ("Kebun Binatang Ra", "Kebun Binatang Ragunan"), ("Taman Min", "Taman Mini Indonesia")])
def test_autocomplete(searcher, query, name):
    assert name in [r.name for r in searcher.autocomplete(query, 10).collect()]


def test_points(searcher):
    got = searcher.reverse_geocode(-6.3, 106.83).first()
    assert got.name == "Kebun Binatang Ragunan"
    near = searcher.nearby_places(-6.3, 106.85, "tourism=park", 30).orderBy("rank").collect()
    assert [r.doc_id for r in near] == [4, 1] and near[0].dist == pytest.approx(km(-6.3, 106.85, -6.302, 106.895), abs=1e-5)
    assert [r.doc_id for r in searcher.nearby_places(-6.3, 106.85, "tourism=park", 30, 1, 1).collect()] == [1]


@pytest.mark.parametrize("call", [
    lambda s: s.free_form_query(""), lambda s: s.free_form_query("a;b"), lambda s: s.free_form_query("a", 101), lambda s: s.free_form_query("a", 10, -1), lambda s: s.free_form_query("a", 10, 0, 91.0, 0.0), lambda s: s.free_form_query("a", 10, 0, 1.0),
    lambda s: s.autocomplete(None), lambda s: s.reverse_geocode(0.0, 181.0), lambda s: s.reverse_geocode(float("nan"), 0.0), lambda s: s.nearby_places(0.0, 0.0, "a b"), lambda s: s.nearby_places(0.0, 0.0, "a=b", 1001), lambda s: s.nearby_places(0.0, 0.0, "a=b", 5, 0),
    lambda s: service.require(fence="a-b"), lambda s: service.require(fence_radius=0.1), lambda s: service.require(point=""),
])
def test_requests_are_checked(searcher, call):
    with pytest.raises(ValueError):
        call(searcher)


def test_rows_that_would_be_requests(spark):
    rows = spark.createDataFrame([(1, "ab (c), d+e.", 0.0), (2, "a;b", 0.0), (3, None, 0.0), (4, "a", 99.0), (5, "a", None), (6, "", 1.0), (7, "a\n", 1.0)], "query_id int, query string, lat double")
    assert [r.query_id for r in rows.where(service.valid(rows)).collect()] == [1]


def test_responses(searcher):
    hits = searcher.free_form_query("dunia", 10).select("query_id", "rank", "doc_id", "name")
    (r,) = service.responses(hits).collect()
    assert [x["doc_id"] for x in json.loads(r.body)["data"]] == [h.doc_id for h in hits.orderBy("rank").collect()] and len(json.loads(r.body)["data"]) == 2


def test_a_stored_index_ranks_like_a_built_one(spark, searcher):
    built = ix.Index.build(spark.createDataFrame([p[:3] for p in PLACES], "doc_id long, name string, address string"))
    q = spark.createDataFrame([(1, "dunia jalan"), (2, "taman mini jalan kebun"), (3, "nowhere")], "query_id long, query string")
    for model in rank.MODELS:
        one, two = (sorted(map(tuple, rank.search(x, q, model=model).collect())) for x in (built, searcher.index))
        assert one == two and one
    plan = rank.search(searcher.index, q)._jdf.queryExecution().toString()
    assert "postings" in plan or "piece" in plan
    one = ix.posting_list(searcher.index.postings, "dunia").where(ix.piece() == F.col("piece"))
    assert "EqualTo(term,dunia)" in one._jdf.queryExecution().toString() and one.count() == 2
    assert [r.term for r in ix.in_term_order(searcher.index.postings).collect()] == sorted(r.term for r in searcher.index.postings.collect())


def test_rare_words_are_marked(spark):
    docs = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["b", "c"]), (3, [])], "doc_id long, tokens array<string>")
    assert {r.doc_id: r.tokens for r in lm.thresholded(docs, 2).collect()} == {1: ["a", "b", "a"], 2: ["b", lm.UNK], 3: []}


def test_fences_and_positions(spark):
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "fence string")
    fences = geofence.created(names().limit(0), names("a", "b"))
    with pytest.raises(ValueError):
        geofence.created(fences, names("b"))
    with pytest.raises(ValueError):
        geofence.created(fences, names("c", "c"))
    circles = spark.createDataFrame([("a", 1, 0.0, 0.0, 1.0), ("b", 1, 0.0, 0.0, 1.0)], "fence string, key long, lat double, lon double, radius double")
    left, mine = geofence.deleted(fences, circles, names("a", "zzz"))
    assert [r.fence for r in left.collect()] == ["b"] and [r.fence for r in mine.collect()] == ["b"]
    with pytest.raises(ValueError):
        geofence.known(left, circles)
    moves = spark.createDataFrame([(1, 7, 1, 0.0, 0.0), (2, 8, 1, 5.0, 5.0), (3, 7, 2, 0.0, 0.001)], "move_id long, point_id long, ts long, lat double, lon double").withColumn("ts", F.timestamp_seconds("ts"))
    stored = geofence.positioned(spark.createDataFrame([(7, 9.0, 9.0), (9, 1.0, 1.0)], "point_id long, lat double, lon double"), moves)
    assert {r.point_id: (r.lat, r.lon) for r in stored.collect()} == {7: (0.0, 0.001), 8: (5.0, 5.0), 9: (1.0, 1.0)}
    later = spark.createDataFrame([(4, 7, 3, 0.0, 0.0)], "move_id long, point_id long, ts long, lat double, lon double").withColumn("ts", F.timestamp_seconds("ts"))
    got = geofence.classify(geofence.steps(later, stored), mine).collect()
    assert [(r.move_id, r.status) for r in got] == [(4, "INSIDE")]


def test_places_after_changes(spark):
    places = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 1.0), (3, 2.0, 2.0)], "id long, lat double, lon double")
    changes = spark.createDataFrame([(2, 5.0, 5.0, 1), (2, 6.0, 6.0, 2), (3, None, None, 3), (4, 7.0, 7.0, 1), (5, None, None, 1)], "id long, lat double, lon double, seq long")
    assert sorted(map(tuple, spatial.updated(places, changes).collect())) == [(1, 0.0, 0.0), (2, 6.0, 6.0), (4, 7.0, 7.0)]


def test_boxes(spark):
    row = spark.createDataFrame([(0.0, 0.0, 1.0, 2.0, -1.0, 1.0, 0.5, 3.0)], ", ".join(f"{x}_{c} double" for x in "ab" for c in ("lo_lat", "lo_lon", "hi_lat", "hi_lon")))
    out = row.select(geo.same("a_", "b_").alias("no"), geo.same("a_", "a_").alias("yes"), geo.box_area("a_").alias("area"), *(c.alias(n) for n, c in geo.united("a_", "b_").items())).first()
    assert (out.no, out.yes, out.area, out.lo_lat, out.lo_lon, out.hi_lat, out.hi_lon) == (False, True, 2.0, -1.0, 0.0, 1.0, 3.0)


def test_merged_field_lengths(spark):
    rows = lambda *r: spark.createDataFrame(r, "field string, doc_id long, len long")
    got = ix.merge_lengths([rows(("name", 1, 3), ("name", 2, 1)), rows(("name", 1, 2), ("address", 1, 4))])
    assert sorted(map(tuple, got.collect())) == [("address", 1, 4), ("name", 1, 5), ("name", 2, 1)]
