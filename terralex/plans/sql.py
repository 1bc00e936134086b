"""Pieces of the SQL that the queries are held against."""

from __future__ import annotations

TOK = "tok AS (SELECT doc_id, coalesce(regexp_extract_all(lower(text), '[a-z0-9]+'), []) AS t FROM documents)"
POS = f"{TOK}, pos AS (SELECT doc_id, unnest(t) AS term, unnest(range(1, len(t) + 1)) AS p FROM tok)"
_TABLES = """postings AS (SELECT field, term, doc_id, count(*) AS tf FROM occ GROUP BY ALL),
lens AS (SELECT field, doc_id, count(*) AS len FROM occ GROUP BY ALL),
stats AS (SELECT field, count(*) AS n_docs, CAST(sum(len) AS BIGINT) AS total, avg(len) AS avg_len FROM lens GROUP BY field),
df AS (SELECT term, count(DISTINCT doc_id) AS df FROM postings GROUP BY term),
corpus AS (SELECT count(*) AS n, (SELECT sum(len) FROM lens) / count(*) AS avgdl FROM docs)"""
INDEX = f"""{POS}, occ AS (SELECT CASE WHEN p <= 8 THEN 'name' ELSE 'address' END AS field, term, doc_id FROM pos),
docs AS (SELECT doc_id, array_to_string(t[1:8], ' ') AS name, array_to_string(t[9:], ' ') AS address FROM tok), {_TABLES}"""
SEARCHES = "qtok AS (SELECT item_id AS query_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM benchmark), qt AS (SELECT query_id, unnest(t) AS term FROM qtok)"
SEARCHES_TWICE = "qtok AS (SELECT item_id AS query_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM benchmark), qt AS (SELECT query_id, unnest(list_concat(t, t)) AS term FROM qtok)"

BM25F = """times AS (SELECT query_id, term, count(*) AS times FROM qt GROUP BY ALL),
parts_ AS (SELECT query_id, p.doc_id, times, df, n, (CASE p.field WHEN 'name' THEN 20.0 ELSE 1.0 END)::DOUBLE * tf / (1 + 0.95 * (len / avg_len - 1)) AS w
  FROM postings p JOIN times USING (term) JOIN df USING (term) JOIN lens l ON l.field = p.field AND l.doc_id = p.doc_id JOIN stats s ON s.field = p.field CROSS JOIN corpus),
scored AS (SELECT query_id, doc_id, sum(times * (w / (10 + w)) * (log10(n - df + 0.5) - log10(df + 0.5))) AS score FROM parts_ GROUP BY ALL)"""
_BOTH = """times AS (SELECT query_id, term, count(*) AS times FROM qt GROUP BY ALL),
freq AS (SELECT query_id, term, doc_id, times, df, n, avgdl, sum(tf)::DOUBLE AS tf FROM postings JOIN times USING (term) JOIN df USING (term) CROSS JOIN corpus GROUP BY ALL)"""
BM25_PLUS = f"""{_BOTH}, dl AS (SELECT doc_id, sum(len) AS dl FROM lens GROUP BY doc_id),
scored AS (SELECT query_id, doc_id, sum((log10(n + 1) - log10(df)) * (1.0 + (2.2 + tf) / (1.2 * (1 - 0.98 + 0.98 * dl / avgdl) + tf))) AS score FROM freq JOIN dl USING (doc_id) GROUP BY ALL)"""
TF_IDF = f"{_BOTH}, scored AS (SELECT query_id, doc_id, sum((1 + log10(tf)) * (log10(n) - log10(df)) * (1 + log10(times)) * (log10(n) - log10(df))) AS score FROM freq GROUP BY ALL)"


def page(k: int = 10, offset: int = 0) -> str:
    return f"SELECT query_id, doc_id, score, rank FROM (SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM scored) WHERE rank > {offset} AND rank <= {offset + k}"


def grams(n: int) -> str:
    """ng<n> of the token lists lt(t)."""
    pad = ", ".join(["'<s>'"] * n)
    words = ", ".join(f"p[i + {k}] AS w{k + 1}" for k in range(n))
    return f"ng{n} AS (SELECT {words}, count(*) AS c FROM (SELECT p, unnest(range(1, len(p) - {n - 2})) AS i FROM (SELECT list_concat(list_concat([{pad}], t), ['</s>']) AS p FROM lt)) GROUP BY ALL)"


def lm() -> str:
    """se (estimates), sb (backoff) and sl (log-probabilities) of the sequences sq(seq_id, t) under lt(t)."""
    return f"""{grams(1)}, {grams(2)}, {grams(3)}, {grams(4)},
sp AS (SELECT seq_id, list_concat(list_concat(['<s>', '<s>', '<s>', '<s>'], t), ['</s>']) AS p FROM sq),
sx AS (SELECT seq_id, i, p[i - 3] AS h3, p[i - 2] AS h2, p[i - 1] AS h1, p[i] AS w FROM (SELECT seq_id, p, unnest(range(5, len(p) + 1)) AS i FROM sp)),
se AS (SELECT sx.*, coalesce(n4.c / d4.c, 0) AS p4, coalesce(n3.c / d3.c, 0) AS p3, coalesce(n2.c / d2.c, 0) AS p2, coalesce(n1.c / (SELECT sum(c) FROM ng1), 0) AS p1 FROM sx
  LEFT JOIN ng4 n4 ON n4.w1 = h3 AND n4.w2 = h2 AND n4.w3 = h1 AND n4.w4 = w LEFT JOIN ng3 d4 ON d4.w1 = h3 AND d4.w2 = h2 AND d4.w3 = h1
  LEFT JOIN ng3 n3 ON n3.w1 = h2 AND n3.w2 = h1 AND n3.w3 = w LEFT JOIN ng2 d3 ON d3.w1 = h2 AND d3.w2 = h1
  LEFT JOIN ng2 n2 ON n2.w1 = h1 AND n2.w2 = w LEFT JOIN ng1 d2 ON d2.w1 = h1 LEFT JOIN ng1 n1 ON n1.w1 = w),
sb AS (SELECT *, CASE WHEN p4 > 0 THEN p4 WHEN p3 > 0 THEN 0.4 * p3 WHEN p2 > 0 THEN 0.4 * 0.4 * p2 ELSE 0.4 * 0.4 * 0.4 * p1 END::DOUBLE AS p FROM se),
sl AS (SELECT seq_id, CASE WHEN min(p) > 0 THEN sum(ln(nullif(p, 0))) END AS logp FROM sb GROUP BY seq_id)"""


PARTS = f"""docs AS (SELECT p_partkey AS doc_id, p_name AS name, p_type || ' ' || p_brand AS address FROM part),
occ AS (SELECT 'name' AS field, unnest(regexp_extract_all(lower(name), '[a-z0-9]+')) AS term, doc_id FROM docs UNION ALL SELECT 'address', unnest(regexp_extract_all(lower(address), '[a-z0-9]+')), doc_id FROM docs),
lt AS (SELECT regexp_extract_all(lower(name || ' ' || address), '[a-z0-9]+') AS t FROM docs),
vocab AS (SELECT DISTINCT term FROM occ), {_TABLES}, names AS (SELECT p_name AS name, min(p_partkey) AS query_id FROM part GROUP BY p_name)"""
MISSPELT = r"""mtok AS (SELECT query_id, regexp_extract_all(regexp_replace(lower(name), '([a-z][a-z])[a-z]([a-z]+)', '\1\2', 'g'), '[a-z0-9]+') AS t FROM names),
mterms AS (SELECT query_id, unnest(t) AS term, unnest(range(1, len(t) + 1)) AS pos FROM mtok)"""
#: Queries of two words at most, as part names are.
_TWO = """cands AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY o1, o2) - 1 AS cand, list_filter([t1, t2], lambda x: x IS NOT NULL) AS t FROM (
  SELECT a.query_id, a.ord AS o1, coalesce(b.ord, 0) AS o2, a.term AS t1, b.term AS t2 FROM opts a LEFT JOIN opts b ON b.query_id = a.query_id AND b.pos > a.pos
  WHERE a.pos = (SELECT min(pos) FROM opts m WHERE m.query_id = a.query_id)))"""
CORRECTED = f"""opts AS (SELECT query_id, pos, term, row_number() OVER (PARTITION BY query_id, pos ORDER BY far, term) AS ord FROM (
  SELECT query_id, pos, m.term, false AS far FROM mterms m JOIN vocab USING (term)
  UNION ALL SELECT query_id, pos, v.term, levenshtein(m.term, v.term) > 1 FROM mterms m JOIN vocab v ON levenshtein(m.term, v.term) <= 2 WHERE m.term NOT IN (SELECT term FROM vocab))), {_TWO}"""
TYPED = f"""ttok AS (SELECT query_id, regexp_extract_all(substring(lower(name), 1, length(name) - 2), '[a-z0-9]+') AS t FROM names),
opts AS (SELECT query_id, pos, term, row_number() OVER (PARTITION BY query_id, pos ORDER BY term) AS ord FROM (
  SELECT query_id, unnest(t[1:len(t) - 1]) AS term, unnest(range(1, len(t))) AS pos FROM ttok
  UNION ALL SELECT query_id, v.term, len(t) FROM ttok JOIN vocab v ON starts_with(v.term, t[len(t)]))), {_TWO}"""
BEST = "best AS (SELECT c.query_id, c.cand, c.t, logp, row_number() OVER (PARTITION BY c.query_id ORDER BY round(logp, 9) DESC NULLS LAST, c.cand) AS rank FROM cands c JOIN sl ON sl.seq_id.query_id = c.query_id AND sl.seq_id.cand = c.cand)"
CONJUNCTIVE = """bw AS (SELECT DISTINCT query_id, rank, unnest(t) AS term, len(list_distinct(t)) AS need FROM best WHERE rank <= 3),
ndf AS (SELECT term, count(*) AS df FROM postings WHERE field = 'name' GROUP BY term),
hit AS (SELECT query_id, rank, p.doc_id, need, tf, df, n, 20.0::DOUBLE * tf / (1 + 0.95 * (len / avg_len - 1)) AS w FROM bw JOIN postings p ON p.term = bw.term AND p.field = 'name' JOIN ndf ON ndf.term = bw.term
  JOIN lens l ON l.field = 'name' AND l.doc_id = p.doc_id JOIN stats s ON s.field = 'name' CROSS JOIN corpus),
conj AS (SELECT query_id, rank AS cand, doc_id, round(min(tf) * sum(w / (10 + w) * (log10(n - df + 0.5) - log10(df + 0.5))), 6) AS score FROM hit GROUP BY query_id, rank, doc_id, need HAVING count(*) = need),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cand, score DESC, doc_id) AS place FROM conj)"""


def _at(key: str, by_lat: int = 1, by_lon: int = 1, d_lat: str = "", d_lon: str = "") -> str:
    return f"-6.0::DOUBLE - (({key} * {by_lat}) % 997) / 1000.0{d_lat} AS lat, 106.0::DOUBLE + (({key} * {by_lon}) % 1009) / 1000.0{d_lon} AS lon"


GEO = f"""places AS (SELECT c_custkey AS id, {_at('c_custkey')}, c_nationkey, c_mktsegment FROM customer),
points AS (SELECT s_suppkey AS query_id, {_at('s_suppkey', 7, 11, ' - 0.0004', ' + 0.0003')}, s_nationkey, s_name FROM supplier),
pairs AS (SELECT id, query_id, p.lat, p.lon, q.lat AS qlat, q.lon AS qlon FROM places p JOIN points q ON c_nationkey = s_nationkey)"""


def haversine(a: str, b: str, c: str, d: str) -> str:
    h = f"((1 - cos(radians({c} - {a}))) / 2 + cos(radians({a})) * cos(radians({c})) * (1 - cos(radians({d} - {b}))) / 2)"
    return f"(asin(sqrt(CASE WHEN {h} > 1 THEN 1 WHEN {h} < 0 THEN 0 ELSE {h} END)) * 2 * 6371)"


def equirect(a: str, b: str, c: str, d: str) -> str:
    return f"(sqrt(pow(({d} - {b}) * cos(({a} + {c}) / 2), 2) + pow({c} - {a}, 2)) * 6371)"


def crosses(a1: str, o1: str, a2: str, o2: str, ca: str, co: str, r: str) -> str:
    x = lambda o: f"(radians({o} - {co}) * cos(radians({ca})) * 6371007)"
    y = lambda a: f"(radians({a} - {ca}) * 6371007)"
    dx, dy = f"({x(o2)} - {x(o1)})", f"({y(a2)} - {y(a1)})"
    a, b, c = f"({dx} * {dx} + {dy} * {dy})", f"({x(o1)} * {dx} + {y(a1)} * {dy})", f"({x(o1)} * {x(o1)} + {y(a1)} * {y(a1)} - {r} * {r} * 1000000)"
    disc = f"({b} * {b} - {a} * {c})"
    root = f"sqrt(greatest({disc}, 0))"
    return f"({a} <> 0 AND {disc} >= 0 AND ((-{b} - {root}) / nullif({a}, 0) BETWEEN 0 AND 1 OR (-{b} + {root}) / nullif({a}, 0) BETWEEN 0 AND 1))"


def nearest(dist: str, k: int, where: str = "true") -> str:
    return f"SELECT query_id, id, dist, rank FROM (SELECT query_id, id, dist, row_number() OVER (PARTITION BY query_id ORDER BY dist, id) AS rank FROM (SELECT q.query_id, p.id, round({dist}, 6) AS dist FROM points q, places p WHERE {where})) WHERE rank <= {k}"


def _ring(center: str, offsets: tuple[float, ...], size: float) -> str:
    return "[" + ", ".join(f"{center} + ({o} * {size})" for o in offsets) + "]"


_LAT, _LON = (-0.12, -0.12, 0.0, 0.12, 0.12, -0.12), (-0.12, 0.12, 0.03, 0.12, -0.12, -0.12)
AREAS = "areas AS (" + " UNION ALL ".join([
    f"SELECT n_nationkey::BIGINT AS area_id, n_name AS name, 7 AS level, CAST(n_nationkey + 10000 AS VARCHAR) AS postcode, {_ring('(-6.1::DOUBLE - (n_nationkey % 5) * 0.2)', _LAT, 1.0)}::DOUBLE[] AS lats, {_ring('(106.1::DOUBLE + (n_nationkey // 5) * 0.2)', _LON, 1.0)}::DOUBLE[] AS lons FROM nation",
    *(f"SELECT (r_regionkey + {level * 100})::BIGINT, r_name || ' {level}', {level}, '', {_ring('(-6.2::DOUBLE - r_regionkey * 0.15)', _LAT, size)}::DOUBLE[], {_ring('(106.2::DOUBLE + r_regionkey * 0.15)', _LON, size)}::DOUBLE[] FROM region" for level, size in ((6, 2.0), (5, 3.0), (4, 4.0), (2, 9.0))),
]) + ")"
INSIDE = """edges AS (SELECT area_id, lats[k] AS y1, lons[k] AS x1, lats[k + 1] AS y2, lons[k + 1] AS x2 FROM (SELECT area_id, lats, lons, unnest(range(1, len(lats))) AS k FROM areas)),
wound AS (SELECT p.id, e.area_id, sum(CASE WHEN y1 <= lat AND y2 > lat AND (x2 - x1) * (lat - y1) - (lon - x1) * (y2 - y1) > 0 THEN 1 WHEN y1 > lat AND y2 <= lat AND (x2 - x1) * (lat - y1) - (lon - x1) * (y2 - y1) < 0 THEN -1 ELSE 0 END) AS wn,
  bool_or(lat BETWEEN least(y1, y2) AND greatest(y1, y2) AND lon BETWEEN least(x1, x2) AND greatest(x1, x2)) AS edge FROM places p, edges e GROUP BY p.id, e.area_id),
inside AS (SELECT p.id, p.lat, p.lon, a.*, wn <> 0 OR edge AS inside, p.lat BETWEEN list_min(lats) AND list_max(lats) AND p.lon BETWEEN list_min(lons) AND list_max(lons) AS in_box,
  p.lat - 0.0001 < list_max(lats) AND list_min(lats) < p.lat + 0.0001 AND p.lon - 0.0001 < list_max(lons) AND list_min(lons) < p.lon + 0.0001 AS near_box
  FROM places p JOIN wound w ON w.id = p.id JOIN areas a ON a.area_id = w.area_id)"""
_EQ = equirect("p.lat", "p.lon", "q.lat", "q.lon")
ADDRESS = f"""street1 AS (SELECT id, s_name FROM (SELECT p.id, s_name, row_number() OVER (PARTITION BY p.id ORDER BY round({_EQ}, 6), query_id) AS n FROM places p, points q) WHERE n = 1),
found AS (SELECT id, arg_min(name, area_id) FILTER (level = 7 AND inside) AS l7, arg_min(name, area_id) FILTER (level = 6 AND inside) AS l6, arg_min(name, area_id) FILTER (level = 5 AND inside) AS l5, arg_max(name, area_id) FILTER (level = 4 AND inside) AS l4,
  arg_min(name, area_id) FILTER (level = 2) AS country, arg_min(postcode, area_id) FILTER (level = 7) AS code FROM inside WHERE near_box GROUP BY id),
addressed AS (SELECT p.id, concat_ws(', ', CASE WHEN p.id % 2 = 0 THEN 'Street ' || (p.id % 9) ELSE s_name END, CASE WHEN p.id % 4 <> 0 THEN CAST(p.id % 100 AS VARCHAR) END, l7, l6, l5, l4, CASE WHEN p.id % 3 = 0 THEN '12345' ELSE code END, country) AS address, l5 AS city
  FROM places p JOIN street1 USING (id) LEFT JOIN found USING (id))"""
_IN = haversine("lat", "lon", "clat", "clon")
_WAS = haversine("olat", "olon", "clat", "clon")
FENCES = f"""circles AS (SELECT 'f' || (s_suppkey % 3) AS fence, s_suppkey AS key, {_at('s_suppkey', 7, 11).replace('AS lat', 'AS clat').replace('AS lon', 'AS clon')}, (0.2 + s_suppkey % 20)::DOUBLE AS radius FROM supplier),
moves AS (SELECT event_id AS move_id, user_id AS point_id, ts, {_at('event_id', 1, 7)} FROM events),
moved AS (SELECT *, lag(lat) OVER w AS olat, lag(lon) OVER w AS olon FROM moves WINDOW w AS (PARTITION BY point_id ORDER BY ts, move_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY move_id, fence ORDER BY round({equirect('lat', 'lon', 'clat', 'clon')}, 6), key) AS n FROM moved, circles),
judged AS (SELECT move_id, point_id, fence, key, unnest(CASE WHEN coalesce({_WAS} <= radius, false) THEN CASE WHEN {_IN} <= radius THEN ['INSIDE'] ELSE ['EXIT', 'OUTSIDE'] END
  WHEN {_IN} <= radius THEN ['ENTER', 'INSIDE'] WHEN coalesce({crosses('olat', 'olon', 'lat', 'lon', 'clat', 'clon', 'radius')}, false) THEN ['CROSS'] ELSE ['OUTSIDE'] END) AS status FROM ranked WHERE n <= 3)"""
TAGGED = """raw AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 <> 0 THEN 'Order ' || (o_orderkey % 50) END AS nm, CASE WHEN o_orderkey % 5 = 0 THEN 'O' || (o_orderkey % 7) END AS sn,
  CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS amenity, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS shop, CASE WHEN o_orderkey % 7 = 0 THEN o_orderstatus END AS landuse FROM orders),
tagged AS (SELECT id, coalesce(amenity, landuse, shop, '') AS type, CASE WHEN sn IS NOT NULL THEN coalesce(nm, '') || ' (' || sn || ')' ELSE coalesce(nm, '') END AS name,
  concat_ws(',', 'amenity=' || amenity, 'landuse=' || landuse, 'shop=' || shop) AS features FROM raw)"""

MAP = f"""nodes AS (SELECT c_custkey AS id, {_at('c_custkey')}, CASE WHEN c_custkey % 3 = 0 THEN c_name END AS nm, CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment END AS historic, CASE WHEN c_custkey % 5 = 0 THEN 'chalet' END AS tourism FROM customer),
ways AS (SELECT o_orderkey AS id, list_concat([o_custkey, o_custkey + 1, o_custkey * 2], CASE WHEN o_orderkey % 2 = 0 THEN [o_custkey + 7, 1000000000] ELSE [] END) AS refs,
  CASE WHEN o_orderkey % 11 <> 0 THEN 'Way ' || (o_orderkey % 50) END AS nm, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS amenity, CASE WHEN o_orderkey % 13 = 0 THEN 'chalet' END AS tourism,
  CASE WHEN o_orderkey % 2 = 0 THEN CASE WHEN o_orderkey % 4 = 0 THEN 'primary' ELSE 'path' END END AS highway, CASE WHEN o_orderkey % 6 = 0 THEN 'Street ' || (o_orderkey % 9) END AS street FROM orders),
stops AS (SELECT w.id, pos, n.lat, n.lon FROM (SELECT id, unnest(refs) AS ref, unnest(range(len(refs))) AS pos FROM ways) w JOIN nodes n ON n.id = w.ref),
pts AS (SELECT id, list_sort(list(lat)) AS a, list_sort(list(lon)) AS o FROM stops GROUP BY id)"""
