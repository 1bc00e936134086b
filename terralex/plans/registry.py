"""The library's own queries by name, with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.text import tokens
from ..operators import address, autocomplete, boolean, dedup, geofence, lm, rank, service, spatial, spell
from ..operators import index as ix
from ..sources import mapdata
from ..sources.tables import in_runs, many_to_many
from . import inputs as i
from . import sql as q

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None) -> Callable:
    """Registers a query under its function's name."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


# Index


@query(f"WITH {q.POS} SELECT doc_id, CAST(p - 1 AS INTEGER) AS pos, term FROM pos")
def tokens_of_documents(spark, d):
    return i.table(spark, d, "documents").select("doc_id", F.posexplode(tokens(F.col("text"))).alias("pos", "term"))


@query(f"WITH {q.INDEX} SELECT field, term, doc_id, tf FROM postings")
def term_freq(spark, d):
    return i.index(spark, d).postings


@query(f"WITH {q.INDEX} SELECT term, df FROM df")
def doc_freq(spark, d):
    return i.index(spark, d).df


@query(f"WITH {q.INDEX} SELECT term, count(*) AS df FROM postings WHERE field = 'name' GROUP BY term")
def doc_freq_name(spark, d):
    return ix.doc_freq(i.index(spark, d).postings, "name")


@query(f"WITH {q.INDEX} SELECT field, doc_id, len FROM lens")
def field_lengths(spark, d):
    return i.index(spark, d).lengths


@query(f"WITH {q.INDEX} SELECT field, n_docs, total, round(avg_len, 6) AS avg_len FROM stats")
def field_stats(spark, d):
    return i.index(spark, d).stats.withColumn("avg_len", F.round("avg_len", 6))


@query(f"WITH {q.INDEX} SELECT n, round(avgdl, 6) AS avgdl FROM corpus")
def corpus_stats(spark, d):
    return i.index(spark, d).corpus.withColumn("avgdl", F.round("avgdl", 6))


@query(f"WITH {q.INDEX} SELECT field, term, doc_id, CAST(2 * tf AS BIGINT) AS tf FROM postings")
def postings_merge(spark, d):
    """Two segments with the same documents: frequencies add up."""
    p = i.index(spark, d).postings
    return ix.merge([p, p])


@query(f"WITH {q.INDEX} SELECT field, doc_id, tf FROM postings WHERE term = 'the'")
def posting_list(spark, d):
    return ix.posting_list(i.index(spark, d).postings, "the").select("field", "doc_id", "tf")


@query(f"WITH {q.INDEX} SELECT field, doc_id, tf FROM postings WHERE term = 'and'")
def posting_list_stored(spark, d):
    """From a stored index: the filters on part and term reach the scan."""
    stored = i.stored_index(spark, d)
    return ix.posting_list(stored.postings.where(F.col("piece") == ix.piece_of("and")), "and").select("field", "doc_id", "tf")


@query(f"WITH {q.INDEX} SELECT s.field, n_docs, total, round(avg_len, 6) AS avg_len, n, round(avgdl, 6) AS avgdl, (SELECT count(*) FROM df) AS n_terms FROM stats s, corpus")
def stored_statistics(spark, d):
    stored = i.stored_index(spark, d)
    terms = stored.terms.agg(F.count(F.lit(1)).alias("n_terms"))
    return stored.stats.crossJoin(stored.corpus).crossJoin(terms).select("field", "n_docs", "total", F.round("avg_len", 6).alias("avg_len"), "n", F.round("avgdl", 6).alias("avgdl"), "n_terms")  # one row each


@query(f"WITH {q.INDEX} SELECT term, field, doc_id, row_number() OVER (ORDER BY term, field, doc_id) AS place FROM postings")
def postings_in_order(spark, d):
    """All postings in the order of terms, numbered."""
    return dedup.numbered(i.index(spark, d).postings.select("term", "field", "doc_id"), "term", "field", "doc_id", name="place")


@query("""WITH r AS (SELECT user_id, event_id, event_type,
    row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS run FROM events)
SELECT user_id, min(event_id) AS "start", event_type, count(*) AS n FROM r GROUP BY user_id, event_type, run""")
def rle_runs(spark, d):
    return ix.run_lengths(i.table(spark, d, "events"), "user_id", "event_id", "event_type")


# Ranking


@query(f"WITH {q.INDEX}, {q.SEARCHES}, {q.BM25F} {q.page()}")
def bm25f_search(spark, d):
    return rank.search(i.index(spark, d), i.searches(spark, d))


@query(f"WITH {q.INDEX}, {q.SEARCHES}, {q.BM25F} {q.page(5, 10)}")
def bm25f_paged(spark, d):
    return rank.search(i.index(spark, d), i.searches(spark, d), k=5, offset=10)


@query(f"WITH {q.INDEX}, {q.SEARCHES_TWICE}, {q.BM25F} {q.page()}")
def bm25f_repeated_term(spark, d):
    """Each query written twice: every occurrence counts."""
    return rank.search(i.index(spark, d), i.searches(spark, d).withColumn("query", F.concat_ws(" ", "query", "query")))


@query(f"WITH {q.INDEX}, {q.SEARCHES}, {q.BM25_PLUS} {q.page()}")
def bm25plus_search(spark, d):
    return rank.search(i.index(spark, d), i.searches(spark, d), model="BM25_PLUS")


@query(f"WITH {q.INDEX}, {q.SEARCHES}, {q.TF_IDF} {q.page()}")
def tfidf_search(spark, d):
    return rank.search(i.index(spark, d), i.searches(spark, d), model="TF_IDF_COSINE")


@query(f"WITH {q.INDEX}, {q.SEARCHES}, {q.BM25F} SELECT h.*, name, address FROM ({q.page()}) h JOIN docs USING (doc_id)")
def search_documents(spark, d):
    index = i.index(spark, d)
    return rank.with_documents(index, rank.search(index, i.searches(spark, d)))


# Language model


def _grams(n: int):
    return lambda spark, d: lm.counts(i.token_lists(i.docs(spark, d)), n)


for _n, _name in enumerate(("unigrams", "bigrams", "trigrams", "quadgrams"), 1):
    QUERIES[_name] = _grams(_n)
    ORACLES[_name] = f"WITH {q.TOK}, lt AS (SELECT t FROM tok), {q.grams(_n)} SELECT * FROM ng{_n}"


def _contexts(searches):
    """Every position of every query, with the three words before."""
    seq = searches.select(lm.padded(tokens(F.col("query")), lm.ORDER).alias("t"))
    at = F.transform(F.sequence(F.lit(lm.ORDER), F.size("t") - 1), lambda k: F.struct(*(F.get(F.col("t"), k - j).alias(f"h{j}") for j in (3, 2, 1)), F.get(F.col("t"), k).alias("w")))
    return seq.select(F.explode(at).alias("x")).select("x.*").distinct()


def _model(spark, d):
    return lm.Model.build(i.token_lists(i.docs(spark, d)))


_LM = f"WITH {q.TOK}, lt AS (SELECT t FROM tok), {q.SEARCHES}, sq AS (SELECT query_id AS seq_id, t FROM qtok), {q.lm()}"


@query(f"{_LM} SELECT DISTINCT h3, h2, h1, w, round(p1, 9) AS p1, round(p2, 9) AS p2, round(p3, 9) AS p3, round(p4, 9) AS p4 FROM se")
def ngram_mle(spark, d):
    return _model(spark, d).estimates(_contexts(i.searches(spark, d))).select("h3", "h2", "h1", "w", *(F.round(f"p{n}", 9).alias(f"p{n}") for n in range(1, 5)))


@query(f"{_LM} SELECT DISTINCT h3, h2, h1, w, round(p, 9) AS p FROM sb")
def stupid_backoff(spark, d):
    return _model(spark, d).backoff(_contexts(i.searches(spark, d))).withColumn("p", F.round("p", 9))


@query(f"{_LM} SELECT seq_id, round(logp, 6) AS logp FROM sl")
def sequence_logprob(spark, d):
    seq = i.searches(spark, d).select(F.col("query_id").alias("seq_id"), tokens(F.col("query")).alias("tokens"))
    return _model(spark, d).score(seq).withColumn("logp", F.round("logp", 6))


# Spelling and autocompletion, over part names


def _part_model(spark, d):
    return lm.Model.build(i.token_lists(i.parts(spark, d)))


@query(f"WITH {q.PARTS}, {q.MISSPELT} SELECT DISTINCT m.term AS word, v.term, CAST(levenshtein(m.term, v.term) AS INTEGER) AS edits FROM mterms m JOIN vocab v ON levenshtein(m.term, v.term) <= 2")
def spell_candidates(spark, d):
    index = ix.Index.build(i.parts(spark, d))
    return spell.candidates(rank.query_terms(i.misspelt(spark, d)), index.vocabulary)


@query(f"WITH {q.PARTS}, {q.MISSPELT}, {q.CORRECTED}, sq AS (SELECT struct_pack(query_id := query_id, cand := cand) AS seq_id, t FROM cands), {q.lm()}, {q.BEST} SELECT query_id, array_to_string(t, ' ') AS query, round(logp, 6) AS logp FROM best WHERE rank = 1")
def spell_best_query(spark, d):
    index = ix.Index.build(i.parts(spark, d))
    return spell.corrected(i.misspelt(spark, d), index.vocabulary, _part_model(spark, d)).withColumn("logp", F.round("logp", 6))


@query(f"WITH {q.PARTS}, {q.MISSPELT}, {q.CORRECTED}, sq AS (SELECT struct_pack(query_id := query_id, cand := cand) AS seq_id, t FROM cands), {q.lm()}, {q.BEST}, qt AS (SELECT query_id, unnest(t) AS term FROM best WHERE rank = 1), {q.BM25F} {q.page()}")
def search_with_correction(spark, d):
    index = ix.Index.build(i.parts(spark, d))
    return rank.search(index, spell.corrected(i.misspelt(spark, d), index.vocabulary, _part_model(spark, d)))


@query(f"WITH {q.PARTS} SELECT term FROM vocab WHERE starts_with(term, 'b')")
def prefix_terms(spark, d):
    return autocomplete.prefix_terms(ix.Index.build(i.parts(spark, d)).vocabulary, "b")


_COMPLETE = f"WITH {q.PARTS}, {q.TYPED}, sq AS (SELECT struct_pack(query_id := query_id, cand := cand) AS seq_id, t FROM cands), {q.lm()}, {q.BEST}"


@query(f"{_COMPLETE} SELECT query_id, array_to_string(t, ' ') AS query, rank FROM best WHERE rank <= 3")
def autocomplete_candidates(spark, d):
    index = ix.Index.build(i.parts(spark, d))
    return autocomplete.candidates(i.typed(spark, d), index.vocabulary, _part_model(spark, d)).select("query_id", F.array_join("tokens", " ").alias("query"), F.col("rank").cast("bigint").alias("rank"))


@query(f"{_COMPLETE}, {q.CONJUNCTIVE} SELECT query_id, place, doc_id, cand, score FROM placed WHERE place <= 10")
def autocomplete_search(spark, d):
    index = ix.Index.build(i.parts(spark, d))
    return autocomplete.autocomplete(index, i.typed(spark, d), _part_model(spark, d))


# Boolean queries and set operations


@query(f"WITH {q.INDEX} SELECT doc_id FROM postings WHERE term IN ('the', 'of', 'and') GROUP BY doc_id HAVING count(DISTINCT term) = 3")
def boolean_and(spark, d):
    index = i.index(spark, d)
    return boolean.matches(index.docs, index.postings, "the AND of AND and")


@query(f"WITH {q.INDEX} SELECT DISTINCT doc_id FROM postings WHERE term IN ('la', 'und')")
def boolean_or(spark, d):
    index = i.index(spark, d)
    return boolean.matches(index.docs, index.postings, "la OR und")


@query(f"WITH {q.INDEX} SELECT doc_id FROM docs EXCEPT (SELECT doc_id FROM postings WHERE term = 'the' INTERSECT SELECT doc_id FROM postings WHERE term = 'of')")
def boolean_not(spark, d):
    index = i.index(spark, d)
    return boolean.matches(index.docs, index.postings, "NOT (the AND of)")


@query(f"WITH {q.INDEX} SELECT doc_id, min(tf) AS tf FROM postings WHERE field = 'address' AND term IN ('the', 'of') GROUP BY doc_id HAVING count(*) = 2")
def posting_intersection(spark, d):
    return boolean.intersection(i.index(spark, d).postings, ["the", "of", "the"], "address")


@query(f"WITH {q.INDEX} SELECT doc_id, CAST(sum(tf) AS BIGINT) AS tf FROM postings WHERE term = 'the' GROUP BY doc_id")
def posting_union(spark, d):
    p = i.index(spark, d).postings
    return boolean.union([ix.posting_list(p, "the", f) for f in ix.FIELDS])


# Geometry


def _pairs(spark, d, of_place=None, of_point=None, join=many_to_many):
    """Places and points of a nation. of_place, of_point: columns that are made once for each of them, not for each pair."""
    places = i.places(spark, d).select("id", "lat", "lon", F.col("c_nationkey").alias("nation")).withColumns(of_place or {})
    points = i.points(spark, d).select("query_id", F.col("lat").alias("qlat"), F.col("lon").alias("qlon"), F.col("s_nationkey").alias("nation")).withColumns(of_point or {})
    return join(places, points, "nation")


def _four():
    return F.col("qlat"), F.col("qlon"), F.col("lat"), F.col("lon")


def _rounded(rows, *names):
    # on columns of a projection below: within one expression, each use would compute the distance again
    return rows.select("id", "query_id", *(geo.rounded(F.col(c)).alias(c) for c in names))


@query(f"WITH {q.GEO} SELECT id, query_id, round({q.haversine('qlat', 'qlon', 'lat', 'lon')}, 6) AS km FROM pairs")
def haversine_pairs(spark, d):
    pairs = _pairs(spark, d, {"cos2": F.cos(F.radians("lat"))}, {"cos1": F.cos(F.radians("qlat"))})
    h = pairs.select("id", "query_id", geo.haversine_square(*_four(), F.col("cos1"), F.col("cos2")).alias("h"))
    return _rounded(h.select("id", "query_id", geo.haversine_of(F.col("h")).alias("km")), "km")


@query(f"WITH {q.GEO} SELECT id, query_id, round({q.equirect('qlat', 'qlon', 'lat', 'lon')}, 6) AS km FROM pairs")
def equirect_pairs(spark, d):
    return _rounded(_pairs(spark, d).select("id", "query_id", geo.equirect(*_four()).alias("km")), "km")


@query(f"""WITH {q.GEO}, m AS (SELECT id, query_id, radians(qlon) AS l1, radians(qlat) AS a, radians(lat) AS b, radians(lon - qlon) AS dl FROM pairs),
n AS (SELECT *, cos(b) * cos(dl) AS x, cos(b) * sin(dl) AS y FROM m)
SELECT id, query_id, round(degrees(atan2(sin(a) + sin(b), sqrt((cos(a) + x) * (cos(a) + x) + y * y))), 6) AS lat, round(degrees(l1 + atan2(y, cos(a) + x)), 6) AS lon FROM n""")
def midpoint(spark, d):
    turned = lambda c, k: {f"sin{k}": F.sin(F.radians(c)), f"cos{k}": F.cos(F.radians(c))}
    pairs = _pairs(spark, d, turned("lat", 2), turned("qlat", 1) | {"rlon": F.radians("qlon")}, spatial.by_middle).withColumn("diff", F.radians(F.col("lon") - F.col("qlon")))
    la, lo = geo.midpoint_of(*(F.col(c) for c in ("sin1", "cos1", "rlon", "sin2", "cos2")), F.cos("diff"), F.sin("diff"))
    return _rounded(pairs.select("id", "query_id", la.alias("lat"), lo.alias("lon")), "lat", "lon")


@query(f"WITH {q.GEO}, g AS (SELECT c_nationkey, list_sort(list(lat)) AS a, list_sort(list(lon)) AS o FROM places GROUP BY c_nationkey) SELECT c_nationkey, round(a[len(a) // 2 + 1], 6) AS lat, round(o[len(o) // 2 + 1], 6) AS lon FROM g")
def upper_median_center(spark, d):
    return i.places(spark, d).groupBy("c_nationkey").agg(F.round(geo.upper_median(F.collect_list("lat")), 6).alias("lat"), F.round(geo.upper_median(F.collect_list("lon")), 6).alias("lon"))


_CIRCLES = "SELECT p.id, q.query_id, p.lat, p.lon, q.lat AS qlat, q.lon AS qlon, (0.2 + q.query_id % 20)::DOUBLE AS r FROM places p, points q"


def _circles(spark, d):
    return i.points(spark, d).select("query_id", F.col("lat").alias("qlat"), F.col("lon").alias("qlon"), (F.lit(0.2) + F.col("query_id") % 20).cast("double").alias("radius"))


@query(f"WITH {q.GEO} SELECT id, query_id FROM ({_CIRCLES}) WHERE {q.haversine('qlat', 'qlon', 'lat', 'lon')} <= r")
def circle_contains(spark, d):
    """Places against all circles."""
    return spatial.in_circles(i.places(spark, d), _circles(spark, d))


@query(f"WITH {q.GEO}, s AS (SELECT id, query_id, -6.5 AS a1, 106.0 AS o1, lat AS a2, lon AS o2, qlat AS ca, qlon AS co, r FROM ({_CIRCLES})) SELECT id, query_id FROM s WHERE {q.crosses('a1', 'o1', 'a2', 'o2', 'ca', 'co', 'r')}")
def segment_circle(spark, d):
    """Lines from one corner of the region to each place, against all circles."""
    return spatial.rays_and_circles(-6.5, 106.0, i.places(spark, d), _circles(spark, d))


@query(f"WITH {q.GEO} SELECT id, query_id AS box_id FROM places a, points b WHERE a.lat - 0.02 < b.lat + 0.03 AND b.lat - 0.03 < a.lat + 0.02 AND a.lon - 0.02 < b.lon + 0.03 AND b.lon - 0.03 < a.lon + 0.02")
def bbox_overlap_join(spark, d):
    a = mapdata.point_boxes(i.places(spark, d), 0.02)
    b = mapdata.point_boxes(i.points(spark, d), 0.03).select(F.col("query_id").alias("box_id"), *(F.col(c).alias(f"b_{c}") for c in dedup.BOX))
    return spatial.box_join(a, b).select("id", "box_id")


@query(f"WITH {q.GEO}, {q.AREAS}, {q.INSIDE} SELECT id, area_id FROM inside WHERE inside AND in_box")
def point_in_polygon(spark, d):
    return spatial.polygon_join(i.places(spark, d), i.areas(spark, d)).select("id", "area_id")


@query(f"WITH {q.GEO}, {q.AREAS}, {q.INSIDE} SELECT id, area_id, level, inside FROM inside WHERE near_box")
def admin_lookup(spark, d):
    return address.areas_at(i.places(spark, d), i.areas(spark, d)).select("id", "area_id", "level", "inside")


@query(f"WITH {q.GEO}, {q.AREAS}, {q.INSIDE}, {q.ADDRESS} SELECT id, address, city FROM addressed")
def address_assembly(spark, d):
    k = F.col("id")
    places = i.places(spark, d).select("id", "lat", "lon", F.when(k % 2 == 0, F.concat(F.lit("Street "), k % 9)).alias("street"), F.when(k % 3 == 0, F.lit("12345")).alias("postcode"), F.when(k % 4 != 0, (k % 100).cast("string")).alias("house"))
    streets = i.points(spark, d).select(F.col("query_id").alias("id"), F.col("s_name").alias("name"), "lat", "lon")
    return address.addresses(places, i.areas(spark, d), streets)


# Nearest places


@query(f"WITH {q.GEO} {q.nearest(q.equirect('q.lat', 'q.lon', 'p.lat', 'p.lon'), 5)}")
def knn(spark, d):
    return spatial.nearest(i.points(spark, d), i.places(spark, d), 5)


@query(f"WITH {q.GEO} {q.nearest(q.haversine('q.lat', 'q.lon', 'p.lat', 'p.lon'), 5)}")
def knn_haversine(spark, d):
    return spatial.nearest(i.points(spark, d), i.places(spark, d), 5, metric="haversine")


@query(f"WITH {q.GEO} SELECT query_id, id, dist FROM ({q.nearest(q.equirect('q.lat', 'q.lon', 'p.lat', 'p.lon'), 1)})")
def reverse_geocode(spark, d):
    return spatial.reverse_geocode(i.points(spark, d), i.places(spark, d))


_NEAR = q.haversine("q.lat", "q.lon", "p.lat", "p.lon")


@query(f"WITH {q.GEO} {q.nearest(_NEAR, 10, where=f'c_mktsegment = {chr(39)}BUILDING{chr(39)} AND {_NEAR} <= 5')}")
def nearby_places(spark, d):
    return spatial.nearby(i.points(spark, d), i.places(spark, d), "segment=BUILDING", 5.0, 10)


# Geofences


@query(f"WITH {q.GEO}, {q.FENCES} SELECT move_id, point_id, fence, key, status FROM judged")
def geofence_events(spark, d):
    return geofence.classify(geofence.steps(i.moves(i.table(spark, d, "events"))), i.circles(spark, d))


@query(f"WITH {q.GEO}, {q.FENCES} SELECT move_id, point_id, fence, key, status FROM judged")
def geofence_stream(spark, d):
    """The same events from a stream with state, written by micro-batches and read back."""
    import uuid

    from ..sources.scratch import shared_folder
    from ..streaming.geofence import watch

    at = f"{shared_folder(spark)}/terralex-stream-{uuid.uuid4().hex}"
    schema = i.table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    watch(i.moves(stream), i.circles(spark, d), f"{at}/out", f"{at}/state").awaitTermination()
    return spark.read.parquet(f"{at}/out").drop("batch")


@query("""WITH c AS (SELECT event_type AS fence, user_id AS key, event_id AS seq, -6.0 - (event_id % 997) / 1000.0 AS lat, 106.0 + (event_id % 1009) / 1000.0 AS lon,
    CASE WHEN event_id % 7 <> 0 THEN (0.2 + event_id % 20)::DOUBLE END AS radius FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY fence, key ORDER BY seq DESC) AS n FROM c)
SELECT fence, key, round(lat, 6) AS lat, round(lon, 6) AS lon, round(radius, 6) AS radius FROM r WHERE n = 1 AND radius IS NOT NULL""")
def fence_upsert(spark, d):
    k = F.col("event_id")
    changes = i.table(spark, d, "events").select(F.col("event_type").alias("fence"), F.col("user_id").alias("key"), k.alias("seq"), i.lat(k).alias("lat"), i.lon(k).alias("lon"), F.when(k % 7 != 0, (F.lit(0.2) + k % 20).cast("double")).alias("radius"))
    return geofence.upsert(changes).select("fence", "key", *(F.round(c, 6).alias(c) for c in ("lat", "lon", "radius")))


# Map objects


@query(f"WITH {q.TAGGED} SELECT id, type FROM tagged")
def place_type(spark, d):
    return i.tagged(spark, d).select("id", mapdata.place_type(F.col("tags")).alias("type"))


@query(f"WITH {q.TAGGED} SELECT id, name FROM tagged")
def display_name(spark, d):
    return i.tagged(spark, d).select("id", mapdata.display_name(F.col("tags")).alias("name"))


@query(f"WITH {q.TAGGED} SELECT id, features FROM tagged")
def feature_tags(spark, d):
    return i.tagged(spark, d).select("id", F.array_join(mapdata.features(F.col("tags")), ",").alias("features"))


@query(f"WITH {q.TAGGED} SELECT id FROM tagged WHERE name <> '' AND features <> ''")
def way_admission(spark, d):
    return mapdata.admitted(i.tagged(spark, d), mapdata.WAY_KEYS).select("id")


_HELD = "{a}.lo_lat >= {b}.lo_lat AND {a}.lo_lon >= {b}.lo_lon AND {a}.hi_lat <= {b}.hi_lat AND {a}.hi_lon <= {b}.hi_lon"


@query(f"""WITH RECURSIVE o AS (SELECT o_orderkey AS id, o_orderpriority || ' ' || (o_custkey % 50) AS name, 0.001::DOUBLE * (1 + o_orderkey % 40) AS size, -6.0::DOUBLE - ((o_orderkey % 60) % 997) / 1000.0 AS lat, 106.0::DOUBLE + ((o_orderkey % 60) % 1009) / 1000.0 AS lon FROM orders),
w AS (SELECT id, name, lower(name) AS key, lat - size AS lo_lat, lon - size AS lo_lon, lat + size AS hi_lat, lon + size AS hi_lon, row_number() OVER (PARTITION BY lower(name) ORDER BY id) AS n FROM o),
f AS (SELECT key, n, id, name, false AS dup, lo_lat, lo_lon, hi_lat, hi_lon FROM w WHERE n = 1
  UNION ALL SELECT key, n, id, name, inside OR holds, CASE WHEN inside THEN p_lo_lat ELSE lo_lat END, CASE WHEN inside THEN p_lo_lon ELSE lo_lon END, CASE WHEN inside THEN p_hi_lat ELSE hi_lat END, CASE WHEN inside THEN p_hi_lon ELSE hi_lon END
  FROM (SELECT w.*, f.lo_lat AS p_lo_lat, f.lo_lon AS p_lo_lon, f.hi_lat AS p_hi_lat, f.hi_lon AS p_hi_lon, {_HELD.format(a='w', b='f')} AS inside, {_HELD.format(a='f', b='w')} AS holds FROM f JOIN w ON w.key = f.key AND w.n = f.n + 1))
SELECT id, name FROM f WHERE NOT dup""")
def way_dedup(spark, d):
    return dedup.unique_ways(i.ways(spark, d)).select("id", "name")


@query(f"""WITH {q.GEO} SELECT p.id, n.n_name AS name FROM places p JOIN nation n ON p.c_nationkey = n.n_nationkey
WHERE NOT (p.lat BETWEEN -6.3 - (n.n_nationkey % 5) * 0.1 AND -6.0 - (n.n_nationkey % 5) * 0.1 AND p.lon BETWEEN 106.1 + (n.n_nationkey // 5) * 0.1 AND 106.5 + (n.n_nationkey // 5) * 0.1)""")
def node_dedup(spark, d):
    nodes = i.places(spark, d).join(i.table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.lower("n_name").alias("name"), F.col("n_name").alias("own")), "c_nationkey")
    return dedup.unique_nodes(nodes, i.named_boxes(spark, d)).select("id", F.col("own").alias("name"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_custkey, o_orderkey) AS doc_id FROM orders")
def dense_ids(spark, d):
    return dedup.numbered(i.table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", "o_orderkey").select("o_orderkey", "doc_id")


# Map extracts: the driver's tables as nodes, ways and relations


@query(f"""WITH {q.MAP} SELECT id, round(lat, 6) AS lat, round(lon, 6) AS lon, coalesce(nm, '') AS name, coalesce(historic, tourism, '') AS type FROM nodes
WHERE nm IS NOT NULL AND coalesce(historic, tourism, '') <> 'chalet'""")
def node_places(spark, d):
    return mapdata.node_places(i.map_nodes(spark, d)).select("id", *(F.round(c, 6).alias(c) for c in ("lat", "lon")), "name", "type")


@query(f"""WITH {q.MAP} SELECT id, nm AS name, coalesce(amenity, highway, tourism, '') AS type, street, round(a[len(a) // 2 + 1], 6) AS lat, round(o[len(o) // 2 + 1], 6) AS lon, round(a[1], 6) AS lo_lat, round(o[1], 6) AS lo_lon, round(a[-1], 6) AS hi_lat, round(o[-1], 6) AS hi_lon
FROM ways JOIN pts USING (id) WHERE nm IS NOT NULL AND coalesce(amenity, tourism, highway) IS NOT NULL AND coalesce(amenity, highway, tourism, '') <> 'chalet'""")
def way_places(spark, d):
    rows = mapdata.way_places(i.map_ways(spark, d), i.map_nodes(spark, d))
    return rows.select("id", "name", "type", "street", *(F.round(c, 6).alias(c) for c in ("lat", "lon", *dedup.BOX)))


@query(f"""WITH {q.MAP}, m AS (SELECT id, nm, radians(o[1]) AS l1, radians(a[1]) AS y1, radians(a[-1]) AS y2, radians(o[-1] - o[1]) AS dl FROM ways JOIN pts USING (id) WHERE nm IS NOT NULL AND highway = 'primary'),
n AS (SELECT *, cos(y2) * cos(dl) AS bx, cos(y2) * sin(dl) AS b_y FROM m)
SELECT id, nm AS name, round(degrees(atan2(sin(y1) + sin(y2), sqrt((cos(y1) + bx) * (cos(y1) + bx) + b_y * b_y))), 6) AS lat, round(degrees(l1 + atan2(b_y, cos(y1) + bx)), 6) AS lon FROM n""")
def street_places(spark, d):
    return mapdata.streets(i.map_ways(spark, d), i.map_nodes(spark, d)).select("id", "name", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query(f"""WITH {q.MAP}, r AS (SELECT n_nationkey::BIGINT AS area_id, n_name AS name, CAST(n_nationkey % 9 AS INTEGER) AS level, CASE WHEN n_nationkey % 2 = 0 THEN CAST(n_nationkey + 10000 AS VARCHAR) ELSE '' END AS postcode FROM nation
  WHERE n_nationkey % 6 <> 5 AND n_nationkey % 7 <> 6 AND n_nationkey % 8 <> 7 AND n_nationkey % 9 BETWEEN 2 AND 7),
mem AS (SELECT area_id, area_id * 4 + 3 AS way, 0 AS m FROM r UNION ALL SELECT area_id, area_id * 4 + 1, 2 FROM r UNION ALL SELECT area_id, area_id * 1000000 + 999999999, 4 FROM r)
SELECT area_id, any_value(name) AS name, any_value(level) AS level, any_value(postcode) AS postcode, string_agg(printf('%.6f %.6f', lat, lon), ',' ORDER BY m, pos) AS ring FROM r JOIN mem USING (area_id) JOIN stops s ON s.id = way GROUP BY area_id""")
def boundary_rings(spark, d):
    """Outer ways' nodes in the order of members and of each way."""
    rows = mapdata.boundaries(i.map_relations(spark, d), i.map_ways(spark, d), i.map_nodes(spark, d))
    ring = F.array_join(F.zip_with("lats", "lons", lambda a, o: F.format_string("%.6f %.6f", a, o)), ",")
    return rows.select("area_id", "name", "level", "postcode", ring.alias("ring"))


# Boxes and distances


@query(f"""WITH {q.GEO}, b AS (SELECT *, qlat - 0.05 AS a1, qlat + 0.05 AS a2, qlon - 0.05 AS o1, qlon + 0.05 AS o2 FROM pairs)
SELECT id, query_id, round({q.equirect('lat', 'lon', 'least(greatest(lat, a1), a2)', 'least(greatest(lon, o1), o2)')}, 6) AS near, round(greatest({', '.join(q.equirect('lat', 'lon', a, o) for a in ('a1', 'a2') for o in ('o1', 'o2'))}), 6) AS far FROM b""")
def box_distances(spark, d):
    box = {f"{k}_{c}": F.col(f"q{c}") + x for k, x in (("lo", -0.05), ("hi", 0.05)) for c in ("lat", "lon")}
    rows = _pairs(spark, d, None, box, in_runs).select("id", "query_id", *(f(F.col("lat"), F.col("lon"), *map(F.col, box)).alias(n) for f, n in ((geo.to_box, "near"), (geo.from_box, "far"))))
    return _rounded(rows, "near", "far")


@query(f"""WITH {q.GEO}, p AS (SELECT id, radians(lat) AS a, radians(lon) AS l, radians((id * 7) % 360) AS t, (1 + id % 50) / 6371.0 AS d FROM places),
t AS (SELECT *, asin(sin(a) * cos(d) + cos(a) * sin(d) * cos(t)) AS b FROM p)
SELECT id, round(degrees(b), 6) AS lat, round(degrees(l + atan2(sin(t) * sin(d) * cos(a), cos(d) - sin(a) * sin(b))), 6) AS lon FROM t""")
def destinations(spark, d):
    k = F.col("id")
    la, lo = geo.destination(F.col("lat"), F.col("lon"), ((k * 7) % 360).cast("double"), (1 + k % 50).cast("double"))
    return i.places(spark, d).select("id", F.round(la, 6).alias("lat"), F.round(lo, 6).alias("lon"))


@query("""WITH b AS (SELECT n_regionkey, -6.3::DOUBLE - (n_nationkey % 5) * 0.1 AS y1, 106.1::DOUBLE + (n_nationkey // 5) * 0.1 AS x1, -6.0::DOUBLE - (n_nationkey % 5) * 0.1 AS y2, 106.5::DOUBLE + (n_nationkey // 5) * 0.1 AS x2, n_nationkey FROM nation)
SELECT a.n_nationkey AS a, b.n_nationkey AS b, round((greatest(a.y2, b.y2) - least(a.y1, b.y1)) * (greatest(a.x2, b.x2) - least(a.x1, b.x1)), 6) AS area, a.n_nationkey = b.n_nationkey AS same FROM b a JOIN b b ON a.n_regionkey = b.n_regionkey""")
def box_unions(spark, d):
    """The box around each two nations of a region."""
    boxes = i.named_boxes(spark, d).join(i.table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"), "n_regionkey"), "id")
    a, b = (boxes.select("n_regionkey", *(F.col(c).alias(f"{x}_{c}") for c in ("id", *dedup.BOX))) for x in "ab")
    both = a.join(b, "n_regionkey").withColumns(geo.united("a_", "b_"))
    return both.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), F.round(geo.box_area(), 6).alias("area"), geo.same("a_", "b_").alias("same"))


@query(f"""WITH {q.GEO}, c AS (SELECT event_id AS seq, user_id AS id, -6.0::DOUBLE - (event_id % 997) / 1000.0 AS lat, 106.0::DOUBLE + (event_id % 1009) / 1000.0 AS lon, event_id % 5 <> 0 AS alive FROM events),
l AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS n FROM c)
SELECT id, round(lat, 6) AS lat, round(lon, 6) AS lon FROM places WHERE id NOT IN (SELECT id FROM c) UNION ALL SELECT id, round(lat, 6), round(lon, 6) FROM l WHERE n = 1 AND alive""")
def places_updated(spark, d):
    """Events move the place of their user's number, or delete it."""
    k = F.col("event_id")
    changes = i.table(spark, d, "events").select(F.col("user_id").alias("id"), F.when(k % 5 != 0, i.lat(k)).alias("lat"), i.lon(k).alias("lon"), k.alias("seq"))
    return spatial.updated(i.places(spark, d).select("id", "lat", "lon"), changes).select("id", *(F.round(c, 6).alias(c) for c in ("lat", "lon")))


@query(f"WITH {q.INDEX} SELECT field, doc_id, CAST(3 * len AS BIGINT) AS len FROM lens")
def field_lengths_merge(spark, d):
    lengths = i.index(spark, d).lengths
    return ix.merge_lengths([lengths, lengths, lengths])


@query(f"""WITH {q.PARTS}, e AS (SELECT doc_id, unnest(t) AS w, unnest(range(len(t))) AS p FROM (SELECT doc_id, regexp_extract_all(lower(name || ' ' || address), '[a-z0-9]+') AS t FROM docs)),
k AS (SELECT w FROM e GROUP BY w HAVING count(*) >= 400)
SELECT doc_id, string_agg(CASE WHEN k.w IS NULL THEN '<unk>' ELSE e.w END, ' ' ORDER BY p) AS words FROM e LEFT JOIN k ON k.w = e.w GROUP BY doc_id""")
def unknown_words(spark, d):
    """Tokens of parts that occur less than 400 times are replaced by a mark."""
    return lm.thresholded(i.token_lists(i.parts(spark, d)), 400).select("doc_id", F.array_join("tokens", " ").alias("words"))


# The engine over stored tables


_FAR = f"round({q.haversine('u.lat', 'u.lon', 'p.lat', 'p.lon')}, 6) AS distance"
_SPOTS = f"spots AS (SELECT doc_id, {q._at('doc_id')} FROM docs), users AS (SELECT query_id, {q._at('query_id', 7, 11)} FROM names)"


@query(f"WITH {q.PARTS}, {q.MISSPELT}, {q.CORRECTED}, sq AS (SELECT struct_pack(query_id := query_id, cand := cand) AS seq_id, t FROM cands), {q.lm()}, {q.BEST}, qt AS (SELECT query_id, unnest(t) AS term FROM best WHERE rank = 1), {q.BM25F}, {_SPOTS} SELECT query_id, rank, score, doc_id, name, {_FAR} FROM ({q.page()}) h JOIN docs USING (doc_id) JOIN spots p USING (doc_id) JOIN users u USING (query_id)")
def search_stored(spark, d):
    """Misspelt part names against a stored index and model, with distances from each user."""
    return i.stored(spark, d).search(i.users(i.misspelt(spark, d))).select("query_id", "rank", "score", "doc_id", "name", "distance")


@query(f"WITH {q.PARTS}, {q.MISSPELT}, {q.CORRECTED}, sq AS (SELECT struct_pack(query_id := query_id, cand := cand) AS seq_id, t FROM cands), {q.lm()}, {q.BEST}, qt AS (SELECT query_id, unnest(t) AS term FROM best WHERE rank = 1), {q.BM25F} SELECT query_id, '{{\"data\":[' || string_agg(to_json(struct_pack(rank := rank, doc_id := doc_id, name := name)), ',' ORDER BY rank) || ']}}' AS body FROM ({q.page()}) h JOIN docs USING (doc_id) GROUP BY query_id")
def search_responses(spark, d):
    """The pages of search_stored as JSON, one object a query."""
    return service.responses(i.stored(spark, d).search(i.misspelt(spark, d)).select("query_id", "rank", "doc_id", "name"))


@query("""WITH r AS (SELECT conv_id, turn, left(text, CAST(3 + conv_id % 60 AS BIGINT)) AS query, -120.0::DOUBLE + conv_id % 240 AS lat, -200.0::DOUBLE + (conv_id * 7) % 400 AS lon FROM conversations)
SELECT conv_id, turn, coalesce(regexp_full_match(query, '[A-Za-z0-9_ +,.()]+'), false) AND lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AS valid FROM r""")
def valid_requests(spark, d):
    """Beginnings of turns as queries from places on and off the globe."""
    c = F.col("conv_id")
    rows = i.table(spark, d, "conversations").select("conv_id", "turn", F.expr("left(text, cast(3 + conv_id % 60 as int))").alias("query"), (F.lit(-120.0) + c % 240).alias("lat"), (F.lit(-200.0) + (c * 7) % 400).alias("lon"))
    return rows.select("conv_id", "turn", service.valid(rows).alias("valid"))


@query(f"{_COMPLETE}, {q.CONJUNCTIVE}, {_SPOTS} SELECT query_id, place, cand, score, doc_id, name, {_FAR} FROM placed JOIN docs USING (doc_id) JOIN spots p USING (doc_id) JOIN users u USING (query_id) WHERE place <= 10")
def autocomplete_stored(spark, d):
    return i.stored(spark, d).complete(i.users(i.typed(spark, d))).select("query_id", "place", "cand", "score", "doc_id", "name", "distance")


@query(f"""WITH {q.GEO}, {q.FENCES} SELECT move_id, point_id, fence, key, status FROM judged WHERE fence <> 'f1'""")
def fence_lifecycle(spark, d):
    """Fences are made, one is deleted, and the later half of the moves is judged from stored positions after the first."""
    all_ = i.circles(spark, d)
    fences = geofence.created(all_.select("fence").distinct().limit(0), all_.select("fence").distinct())
    fences, circles = geofence.deleted(fences, all_, fences.where("fence = 'f1'"))
    circles = geofence.known(fences, circles)
    moves = i.moves(i.table(spark, d, "events"))
    early, late = moves.where("ts < timestamp'2024-01-15 00:00:00'"), moves.where("ts >= timestamp'2024-01-15 00:00:00'")
    stored = geofence.positioned(early.select("point_id", "lat", "lon").limit(0), early)
    first, second = geofence.steps(early), geofence.steps(late, stored)
    return geofence.classify(first.unionByName(second), circles)
