"""DuckDB twins of the registered queries that SQL can express, over the same whole tables."""

from __future__ import annotations

from leafmill.llm import quality

WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

def _quoted(x: str) -> str:
    return x.replace("'", "''")


_fails = " OR ".join(
    [
        f"menu >= {quality.MENU_LINKS}",
        f"menu > CAST({quality.MENU_SHARE} AS DOUBLE) * n",
        rf"len(regexp_extract_all(x, '[#*$%&|<>{{}}~^=\\]{{2,}}')) > CAST({quality.SYMBOL_SHARE} AS DOUBLE) * n",
        f"len(regexp_extract_all(x, '!{{2,}}')) > CAST({quality.SHOUT_SHARE} AS DOUBLE) * n",
        f"(phrases > 0 AND phrases * {quality.PHRASE_WORDS} >= n)",
        r"NOT regexp_matches(x, '[\p{L}\p{N}]')",
        f"regexp_matches(x, '{quality.TEASER}')",
        f"(n < {quality.FRAGMENT_WORDS} AND NOT regexp_matches(x, '{_quoted(quality.CLOSED)}'))",
    ]
)
QUALITY = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {WORDS} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
p AS (SELECT r, unnest(range(1, len(w) + 1)) AS i, w FROM d),
g AS (SELECT r, i, CASE WHEN i + 2 <= len(w) THEN [w[i], w[i + 1], w[i + 2]] END AS g FROM p),
c AS (SELECT r, i, g IS NOT NULL AND count(*) OVER (PARTITION BY r, g) > 1 AS twice FROM g),
m AS (SELECT r, twice OR coalesce(lag(twice, 1) OVER o, false) OR coalesce(lag(twice, 2) OVER o, false) AS marked FROM c WINDOW o AS (PARTITION BY r ORDER BY i)),
n AS (SELECT r, count(*) FILTER (WHERE marked) AS n_repeat_words FROM m GROUP BY r),
x AS (SELECT r, unnest(l) AS x FROM d),
y AS (SELECT r, x, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS n, len(regexp_extract_all(lower(x), '{_quoted(quality.PHRASES)}')) AS phrases, len(list_filter(string_split_regex(x, '[\x20\x09-\x0D]+'), lambda t: regexp_matches(t, '^[|»›•·>/]+$'))) AS menu FROM x),
z AS (SELECT r, count(*) AS n_good_lines, sum(length(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g'))) AS good_chars FROM y WHERE NOT ({_fails}) GROUP BY r),
b AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(len(l) AS BIGINT) AS n_lines,
  CAST(coalesce(n_good_lines, 0) AS BIGINT) AS n_good_lines, CAST(coalesce(good_chars, 0) AS BIGINT) AS good_chars FROM d LEFT JOIN n USING (r) LEFT JOIN z USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT *, NOT base_failed AND good_chars >= CAST({1 - quality.LOST_SHARE} AS DOUBLE) * word_chars AS kept FROM f"""

WARC = r"""
WITH p AS (SELECT page_id, regexp_replace(coalesce(url, ''), '\s+', '', 'g') AS url, coalesce(html, '') AS html FROM pages),
h AS (SELECT *, sha1(html) AS sha, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, url, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST(('0x' || substr(sha, CAST(1 + 10 * (i // 8) AS BIGINT), 10)) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS BIGINT)) & 31) AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to
FROM h"""

SUBSTRING = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
p AS (SELECT r, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x FROM d),
g AS (SELECT r, unnest(range(1, len(w) - 33)) AS i, w FROM d WHERE len(w) >= 35),
s AS (SELECT r, i, array_to_string(w[i : i + 34], ' ') AS s FROM g),
t AS (SELECT r, i FROM s QUALIFY count(*) OVER (PARTITION BY s) > 1),
q AS (SELECT p.r, p.i, p.x, max(t.i) OVER (PARTITION BY p.r ORDER BY p.i ROWS UNBOUNDED PRECEDING) AS start FROM p LEFT JOIN t ON t.r = p.r AND t.i = p.i),
k AS (SELECT r, count(*) FILTER (WHERE start IS NOT NULL AND i < start + 35) AS n_removed, string_agg(x, ' ' ORDER BY i) FILTER (WHERE start IS NULL OR i >= start + 35) AS kept FROM q GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r)"""

_words = WORDS.replace("coalesce(text, '')", LOWER)
NGRAMS = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_words} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + 4], ' ') END AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
c AS (SELECT a AS doc_id, a AS reached FROM e UNION SELECT c.doc_id, e.b FROM c JOIN e ON e.a = c.reached),
m AS (SELECT doc_id, min(reached) AS component_id FROM c GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(m.component_id, d.doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)"""

_items = rf"regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
CONTAMINATION = f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_items} AS w FROM benchmark WHERE item_id IS NOT NULL),
v AS (SELECT DISTINCT item, k, array_to_string(w[i : i + k - 1], ' ') AS s FROM (SELECT item, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT *, least(10, len(w)) AS k FROM b WHERE len(w) > 0))),
d AS (SELECT row_number() OVER () AS r, doc_id, {_items} AS w FROM documents),
g AS (SELECT r, k, unnest(range(1, len(w) - k + 2)) AS i, w FROM d, (SELECT DISTINCT k FROM v) WHERE len(w) >= k),
h AS (SELECT g.r, g.k, g.i, v.item FROM g JOIN v ON v.k = g.k AND v.s = array_to_string(g.w[g.i : g.i + g.k - 1], ' ')),
c AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + k)) AS j FROM h) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)"""

ORACLES: dict[str, str] = {
    "op1_quality_rules": QUALITY,
    "op4_warc": WARC,
    "op5_substring_dedup": SUBSTRING,
    "op6_ngram_jaccard": NGRAMS,
    "op7_decontamination": CONTAMINATION,
}
