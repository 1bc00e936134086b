"""SQL (DuckDB) for the operators that SQL can express."""

from __future__ import annotations

from .rules import BOILERPLATE

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLACK = r"'[^\x20\x09-\x0D]+'"
_WORD = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

MINHASH = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOW}, {_BLACK}) AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
both_ AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, other) AS (SELECT a, b FROM both_ UNION SELECT r.doc_id, k.b FROM reach r JOIN both_ k ON k.a = r.other),
least AS (SELECT doc_id, min(other) AS m FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id, d.doc_id <= coalesce(m, d.doc_id) AS kept FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN least USING (doc_id)"""

SUFFIX = """WITH b AS (SELECT doc_id, encode(coalesce(text, '')) AS raw FROM documents),
win AS (SELECT doc_id, p, raw[p:p + 99] AS s FROM (SELECT doc_id, raw, unnest(range(1, octet_length(raw) - 98)) AS p FROM b)),
gone AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS n FROM win) WHERE n > 1),
isle AS (SELECT doc_id, p, sum(CASE WHEN p <= before + 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM gone)),
spans AS (SELECT doc_id, k, min(p) AS a, max(p) + 100 AS z FROM isle GROUP BY doc_id, k),
per AS (SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id),
cuts AS (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 1) AS f, a AS t FROM spans UNION ALL SELECT doc_id, max(z), NULL FROM spans GROUP BY doc_id),
parts AS (SELECT b.doc_id, f, CASE WHEN t IS NULL THEN hex(raw[f:]) WHEN t > f THEN hex(raw[f:t - 1]) ELSE '' END AS h FROM cuts JOIN b USING (doc_id)),
kept AS (SELECT doc_id, sha256(unhex(string_agg(h, '' ORDER BY f))) AS d FROM parts GROUP BY doc_id)
SELECT b.doc_id, octet_length(raw) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, coalesce(d, sha256(raw)) AS kept_sha256 FROM b LEFT JOIN per USING (doc_id) LEFT JOIN kept USING (doc_id)"""

WARC = """WITH d AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(encode(coalesce(html, ''))) AS payload_digest FROM pages),
r AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS m FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> m THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN payload_bytes >= 100 AND page_id <> m THEN m END AS refers_to FROM r"""

DECONTAM = f"""WITH i AS (SELECT item_id, regexp_extract_all({_LOW}, {_WORD}) AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[k:k + 9], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
d AS (SELECT doc_id, regexp_extract_all({_LOW}, {_WORD}) AS w FROM documents),
dw AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM iw))),
m AS (SELECT doc_id, dw.n, k, item_id FROM dw JOIN iw ON iw.n = dw.n AND iw.g = dw.g),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM m WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""

_BOILER = ", ".join(f"'{w}'" for w in BOILERPLATE)
RULES = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), {_BLACK}) AS w FROM documents),
g AS (SELECT doc_id, k, array_to_string(w[k:k + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS k FROM d)),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(k, k + 8)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1) GROUP BY doc_id),
l AS (SELECT doc_id, line, regexp_extract_all(line, {_BLACK}) AS w FROM (SELECT doc_id, unnest(string_split(x, chr(10))) AS line FROM d)),
f AS (SELECT doc_id, line, len(w) AS n, length(array_to_string(w, '')) AS chars, len(list_filter(w, lambda s: right(s, 1) IN ('.', '!', '?', ':', ';', '"', '''', ')', ']'))) AS closed,
  length(regexp_replace(line, '[^A-Z]', '', 'g')) AS up, length(regexp_replace(line, '[^A-Za-z]', '', 'g')) AS letters, length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) AS symbols, len(list_filter(w, lambda s: s IN ('|', '>', '/', '-', '*'))) AS links,
  len(list_filter(w, lambda s: translate(regexp_replace(s, '[.!?:;"'')\],]$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') IN ({_BOILER}))) AS known FROM l WHERE len(w) > 0),
j AS (SELECT *, n >= 40 AND closed = 0 OR n >= 5 AND up > 0.7 * letters OR links > 0.15 * n OR links >= 8 OR symbols > 0.08 * chars OR known >= 2 AND 5 * known >= n AS bad FROM f),
s AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (bad) AS n_bad, count(*) - count(DISTINCT line) AS dup, CAST(coalesce(sum(chars) FILTER (NOT bad), 0) AS BIGINT) AS good FROM j GROUP BY doc_id),
o AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(dup, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
  len(w) < 20 OR 100 * coalesce(rep.n, 0) > 30 * len(w) AS base_failed, coalesce(n_lines, 0) AS n_lines, coalesce(n_bad, 0) AS n_bad_lines, coalesce(good, 0) AS good FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN s USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 2 * good >= word_chars AS kept, n_lines, n_bad_lines FROM o"""

SQL = {"op3_minhash": MINHASH, "op4_suffix": SUFFIX, "op5_warc": WARC, "op7_decontam": DECONTAM, "op8_rules": RULES}
