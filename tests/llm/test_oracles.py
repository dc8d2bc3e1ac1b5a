"""Queries against DuckDB: whole results where SQL can express them, base columns elsewhere."""

import duckdb
import pytest

from pelagia.llm import registry

SF = "/root/testdata/sf0.001"
WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

QUALITY = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
x AS (SELECT *, CASE WHEN len(w) < 5 THEN [] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END AS s FROM d),
g AS (SELECT doc_id, list(win) AS again FROM (SELECT doc_id, unnest(s) AS win FROM x) GROUP BY doc_id, win HAVING count(*) > 1),
r AS (SELECT doc_id, flatten(list(list_distinct(again))) AS again FROM g GROUP BY doc_id),
c AS (SELECT x.doc_id, count(DISTINCT j) AS n FROM (SELECT x.doc_id, unnest(range(p, p + 5)) AS j FROM (SELECT x.doc_id, unnest(range(1, len(s) + 1)) AS p, s FROM x) x JOIN r USING (doc_id) WHERE list_contains(r.again, s[p])) x GROUP BY 1),
l AS (SELECT doc_id, sum(n - 1) AS n FROM (SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY ALL) GROUP BY doc_id)
SELECT x.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda a: length(a))), 0) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(l.n, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, len(w) < 10 OR 100 * coalesce(c.n, 0) > 20 * len(w) AS base_failed
FROM x LEFT JOIN c USING (doc_id) LEFT JOIN l USING (doc_id)"""

LM = f"""
WITH d AS (SELECT doc_id, list_append({WORDS.format(LOWER)}, chr(10)) AS w FROM documents),
t AS (SELECT doc_id, unnest(w) AS token FROM d),
c AS (SELECT token, count(*) AS n FROM t SEMI JOIN (SELECT unnest({{training}}) AS doc_id) k USING (doc_id) GROUP BY token),
s AS (SELECT sum(n) AS total, count(*) AS distinct_ FROM c)
SELECT t.doc_id, count(*) AS n_tokens, count(c.n) AS n_known, any_value(total) AS train_tokens, sum(log10((coalesce(c.n, 0) + 1) / (total + distinct_ + 1))) AS base_score
FROM t LEFT JOIN c USING (token), s GROUP BY t.doc_id"""

URLS = r"""
WITH p AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, lower(regexp_extract(rest, '^([^/?#]*)', 1)) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r AS (SELECT h.*, x.rule, x.verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(x.rule) DESC) AS place FROM h LEFT JOIN (VALUES ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'), ('www.example.com/en/', 'www.example.com', '/en/', 'allow'), ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')) x(rule, host, path, verdict)
  ON (h.host = x.host OR ends_with(h.host, '.' || x.host)) AND starts_with(h.path, x.path))
SELECT page_id, host, path, rule, verdict FROM r WHERE place = 1"""


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(result):
    return sorted(result, key=repr)


@pytest.mark.parametrize("name", ["op1_warc", "op6_embedding_dedup", "op7_near_dedup", "op11_line_dedup", "op12_hard_negatives", "op13_collocations"])
def test_whole_results(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    found = duck.execute(registry.ORACLE_SQL[name])
    assert df.columns == [d[0] for d in found.description]
    assert rows(map(tuple, df.collect())) == rows(found.fetchall())


def test_quality_base(spark, duck):
    found = duck.execute(QUALITY)
    names = [d[0] for d in found.description]
    assert rows(map(tuple, registry.QUERIES["op2_quality_rules"](spark, SF).select(*names).collect())) == rows(found.fetchall())


def test_language_model_base(spark, duck):
    got = registry.QUERIES["op4_ppm"](spark, SF).collect()
    training = [r["doc_id"] for r in got if not r["held_out"]]
    found = {r[0]: r[1:] for r in duck.execute(LM.replace("{training}", str(training))).fetchall()}
    assert len(found) == len(got)
    for r in got:
        n_tokens, n_known, total, score = found[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n_tokens, n_known, total)
        assert abs(r["base_score"] - score) < 1e-6 * max(1, abs(score))


def test_url_base(spark, duck):
    got = registry.QUERIES["op8_url_filter"](spark, SF).collect()
    found = {r[0]: r[1:] for r in duck.execute(URLS).fetchall()}
    assert len(found) == len(got)
    for r in got:
        host, path, rule, verdict = found[r["page_id"]]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if rule else r["verdict"] in ("allow", "block")
