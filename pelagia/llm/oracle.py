"""DuckDB SQL for the queries that SQL can express as a whole."""

HEX = "0123456789abcdef"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

#: 20 bits of a hex digest, as four characters of five bits each
_BITS = "list_sum(list_transform(range(0, 5), lambda k: (instr('" + HEX + "', substr(h, cast(5 * j + k + 1 AS bigint), 1)) - 1) * cast(pow(16, 4 - k) AS bigint)))"
_CHARS = " || ".join(f"substr('{BASE32}', cast(floor(v / {1 << shift}) AS bigint) % 32 + 1, 1)" for shift in (15, 10, 5, 0))

WARC = f"""
WITH digests AS (SELECT page_id, url, encode(coalesce(html, '')) AS payload, sha1(encode(coalesce(html, ''))) AS h FROM pages),
named AS (SELECT *, array_to_string(list_transform(list_transform(range(0, 8), lambda j: {_BITS}), lambda v: {_CHARS}), '') AS digest, count(*) OVER same AS n, min(page_id) OVER same AS first_id FROM digests WINDOW same AS (PARTITION BY h))
SELECT page_id, octet_length(payload) AS payload_bytes, digest AS payload_digest, CASE WHEN n > 1 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n > 1 AND page_id <> first_id THEN first_id END AS refers_to, replace(replace(url, chr(13), '%0D'), chr(10), '%0A') AS url FROM named"""

EMBEDDINGS = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: cast(x AS double)) AS e FROM embeddings),
good AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) >= 0.95 * a.norm * b.norm),
reach AS (SELECT vec_id AS id, vec_id AS other FROM v UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM (SELECT id AS vec_id, min(other) AS component_id FROM reach GROUP BY id)"""

NEAR_DOCUMENTS = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
rows AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS both_ FROM rows a JOIN rows b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common WHERE 100 * both_ >= 75 * (na + nb - both_)),
reach AS (SELECT doc_id AS id, doc_id AS other FROM sets UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT s.doc_id, len(s.s) AS n_shingles, component_id, s.doc_id = component_id AS kept FROM sets s JOIN (SELECT id, min(other) AS component_id FROM reach GROUP BY id) c ON c.id = s.doc_id"""

LINES = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, unnest(range(1, len(lines) + 1)) AS pos, unnest(lines) AS line FROM d),
k AS (SELECT *, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM l),
s AS (SELECT key, min(doc_id) AS first_id FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.*, coalesce(k.doc_id > s.first_id, false) AS gone FROM k LEFT JOIN s USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY r"""

NEGATIVES = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: cast(floor(256 * cast(x AS double)) AS bigint)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
d AS (SELECT v.*, x FROM v, unnest(range(1, len(e) + 1)) u(x)),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, any_value(a.label) = any_value(b.label) AS same, cast(sum(a.e[a.x] * b.e[b.x]) AS bigint) AS score
  FROM d a JOIN d b ON a.x = b.x AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0 GROUP BY a.vec_id, b.vec_id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.other_id AS positive_id, cast(row_number() OVER w AS integer) AS rank, n.other_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
WINDOW w AS (PARTITION BY p.anchor_id, p.other_id ORDER BY n.score DESC, n.other_id) QUALIFY row_number() OVER w <= 10"""

COLLOCATIONS = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM t),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, unnest(flatten(list_transform(range(1, 6), lambda k: list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))))) AS phrase FROM w WHERE len(w) > 0),
f AS (SELECT lang, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
n AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
c AS (SELECT lang, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE contains(phrase, ' ')),
cuts AS (SELECT c.*, k, n.n, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:len(w)], ' ') AS tail FROM c JOIN n USING (lang), unnest(range(1, 5)) u(k) WHERE k < len(w)),
scored AS (SELECT cuts.*, l.a AS l, r.a AS r, cast((1000::hugeint * cuts.a * cuts.n) // (l.a::hugeint * r.a) AS bigint) AS score FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = head JOIN f r ON r.lang = cuts.lang AND r.phrase = tail),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, max(a) AS a FROM c, unnest(range(1, 5)) u(i), unnest(range(2, 5)) x(k) WHERE k < len(w) AND i + k - 1 <= len(w) GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN longer ON longer.lang = best.lang AND longer.phrase = best.phrase WHERE longer.a IS NULL OR 100 * longer.a < 100 * best.a)
SELECT lang, cast(row_number() OVER o AS bigint) AS rank, phrase, a, l, r, cast(n AS bigint) AS n, score FROM kept WINDOW o AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) QUALIFY row_number() OVER o <= 2000"""
