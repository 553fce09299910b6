"""Structure, section and quality queries (H, W, R, G, Q)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.operators import quality_gate, sections, structure, verify
from leafmill.plans.inline import Inline
from leafmill.plans.library import chapters
from leafmill.plans.texts import CANON_LIST_SQL, CONTROL_SQL, RANK_SQL, collapse_sql, count_sql, fold_sql
from leafmill.session import table
from leafmill.sources import readers

QUERIES, ORACLES = {}, {}


def add(name: str, duck: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if duck:
            ORACLES[name] = duck
        return f

    return keep


#: Heading trees: a preface, gaps in levels, repeated titles, empty sections, a heading without a level.
TREES = Inline(
    "doc int, pos int, kind string, level int, text string",
    [
        (1, 0, "para", None, "words before any heading at all"),
        (1, 1, "heading", 2, "Part One"), (1, 2, "heading", 4, "Chapter A"), (1, 3, "para", None, "alpha beta gamma"), (1, 4, "heading", 4, "Chapter B"), (1, 5, "para", None, "delta"),
        (1, 6, "heading", 6, "Section b1"), (1, 7, "para", None, "epsilon zeta"), (1, 8, "heading", 2, "Part Two"), (1, 9, "para", None, "eta theta iota kappa"), (1, 10, "heading", 6, "Deep under two"), (1, 11, "para", None, "lambda"),
        (2, 0, "heading", 1, "Only"), (2, 1, "heading", 1, "Only"), (2, 2, "para", None, "mu nu"), (2, 3, "heading", None, "No level"), (2, 4, "para", None, "xi"),
        (3, 0, "para", None, "no headings here"), (3, 1, "para", None, "still none"),
        (4, 0, "heading", 1, "Book"), (4, 1, "heading", 2, "Book"), (4, 2, "heading", 3, "Leaf"), (4, 3, "para", None, " ".join(["long"] * 600)), (4, 4, "heading", 2, "Empty"), (4, 5, "heading", 2, "Last"), (4, 6, "para", None, " ".join(["text"] * 700)),
    ],
)
WORDS_SQL = r"CAST(len(regexp_extract_all(text, '[^ \t\n\r]+')) AS BIGINT)"
RANKED = f"(SELECT doc, pos, kind, CASE WHEN kind = 'heading' THEN dense_rank() OVER (PARTITION BY doc, kind = 'heading' ORDER BY level ASC NULLS LAST) END AS level, text FROM {TREES.sql})"
PREFACED = f"(SELECT * FROM {RANKED} UNION ALL SELECT doc, -1, 'heading', 1, '{structure.PREFACE}' FROM {RANKED} GROUP BY doc HAVING arg_min(kind, pos) <> 'heading')"
_over = "OVER (PARTITION BY doc ORDER BY pos ROWS UNBOUNDED PRECEDING)"
_last = ", ".join(f"max(CASE WHEN level = {k} THEN pos END) {_over} AS p{k}, last_value(CASE WHEN level = {k} THEN text END IGNORE NULLS) {_over} AS t{k}" for k in range(1, 7))
_open = {k: f"(p{k} IS NOT NULL AND p{k} > greatest(-2, {', '.join(f'coalesce(p{j}, -2)' for j in range(1, k)) or '-2'}))" for k in range(1, 7)}
_path = "list_filter([" + ", ".join(f"CASE WHEN {_open[k]} THEN t{k} END" for k in range(1, 7)) + "], lambda x: x IS NOT NULL)"
_parent = "greatest(0, " + ", ".join(f"CASE WHEN {_open[k]} AND level > {k} THEN {k} ELSE 0 END" for k in range(1, 7)) + ")"
PATHS = f"(SELECT doc, pos, kind, level, text, {_path} AS path, CASE WHEN kind = 'heading' THEN {_parent} END AS parent FROM (SELECT *, {_last} FROM {PREFACED}))"
_title = "array_to_string(list_filter(path, lambda x, i: i = 1 OR path[i - 1] <> x), ' · ')"


def chapters_sql(cut: str, blocks: str = PATHS, keys: str = "doc") -> str:
    starts = f"(SELECT *, kind = 'heading' AND parent < {cut} AS begins, level < {cut} AS is_above FROM {blocks})"
    spans = f"(SELECT *, max(CASE WHEN begins THEN pos END) OVER (PARTITION BY {keys} ORDER BY pos ROWS UNBOUNDED PRECEDING) AS start FROM {starts})"
    return f"(SELECT {keys}, start, max(CASE WHEN begins THEN {_title} END) AS title, CAST(sum(CASE WHEN begins THEN 0 ELSE {WORDS_SQL} END) AS BIGINT) AS tokens, CAST(count(*) FILTER (WHERE NOT begins) AS BIGINT) AS n_blocks FROM {spans} GROUP BY {keys}, start HAVING NOT (bool_or(begins AND is_above) AND count(*) FILTER (WHERE NOT begins) = 0))"


def tree(spark: SparkSession) -> DataFrame:
    return structure.with_paths(structure.with_preface(structure.ranked(TREES.df(spark))))


@add("w01_level_rank", f"SELECT doc, pos, CAST(level AS BIGINT) AS level FROM {RANKED} WHERE kind = 'heading'")
def _(spark, d):
    return structure.ranked(TREES.df(spark)).filter("kind = 'heading'").select("doc", "pos", F.col("level").cast("bigint").alias("level"))


QUERIES["h01_heading_levels"], ORACLES["h01_heading_levels"] = QUERIES["w01_level_rank"], ORACLES["w01_level_rank"]


_headed = "'Volume 1' || chr(10) || chr(10) || 'Chapter 2. Begin' || chr(10) || chr(10) || text || chr(10) || chr(10) || 'CAPITALS' || chr(10) || chr(10) || 'Part two'"


def _pattern_levels(text: str) -> list[tuple[int, int]]:
    """(place, level) of the paragraphs that become headings."""
    blocks = readers.by_patterns([readers.Block("para", p) for p in text.split("\n\n")])
    return [(k, b.level) for k, b in enumerate(blocks) if b.kind == "heading"]


@add("f08_pattern_pass", f"WITH t AS (SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split({_headed}, chr(10) || chr(10)) AS l FROM documents)), r AS (SELECT doc_id, pos, {RANK_SQL} AS rank FROM t WHERE NOT contains(line, chr(10))) SELECT doc_id, CAST(pos AS BIGINT) AS pos, CAST(dense_rank() OVER (PARTITION BY doc_id ORDER BY rank) AS BIGINT) AS level FROM r WHERE rank IS NOT NULL")
def _(spark, d):
    text = F.concat(F.lit("Volume 1\n\nChapter 2. Begin\n\n"), "text", F.lit("\n\nCAPITALS\n\nPart two"))
    found = F.pandas_udf(lambda x: x.map(_pattern_levels), "array<struct<pos:bigint,level:bigint>>")(text)
    return table(spark, d, "documents").select("doc_id", F.explode(found).alias("x")).select("doc_id", "x.pos", "x.level")


QUERIES["w02_pattern_levels"], ORACLES["w02_pattern_levels"] = QUERIES["f08_pattern_pass"], ORACLES["f08_pattern_pass"]


@add("w03_paths", f"SELECT doc, pos, array_to_string(path, ' / ') AS path, CAST(parent AS BIGINT) AS parent FROM {PATHS}")
def _(spark, d):
    return tree(spark).select("doc", "pos", F.array_join("path", " / ").alias("path"), F.col("parent").cast("bigint").alias("parent"))


QUERIES["h02_tree"], ORACLES["h02_tree"] = QUERIES["w03_paths"], ORACLES["w03_paths"]


@add("h03_segments", "SELECT doc, cut, start, tokens FROM (" + " UNION ALL ".join(f"SELECT *, {k} AS cut FROM {chapters_sql(str(k))}" for k in range(1, 5)) + ")")
def _(spark, d):
    parts = [structure.chapters(tree(spark), F.lit(k)).select("doc", F.lit(k).alias("cut"), "start", "tokens") for k in range(1, 5)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


_medians = "(" + " UNION ALL ".join(f"SELECT doc, {k} AS cut, median(tokens) AS m FROM {chapters_sql(str(k))} GROUP BY doc" for k in range(1, 5)) + ")"


@add("g03_level_medians", f"SELECT doc, cut, m FROM {_medians}")
def _(spark, d):
    return structure.level_medians(tree(spark))


_m = lambda k: f"coalesce(max(m) FILTER (WHERE cut = {k}), 0)"
CUTS = f"(SELECT doc, CASE WHEN deepest >= 2 THEN CASE WHEN m2 > 12000 AND deepest >= 3 THEN CASE WHEN m3 > 12000 AND deepest >= 4 THEN 4 ELSE 3 END WHEN m2 < 500 THEN 1 ELSE 2 END ELSE 1 END AS cut FROM (SELECT doc, {_m(1)} AS m1, {_m(2)} AS m2, {_m(3)} AS m3 FROM {_medians} GROUP BY doc) JOIN (SELECT doc, max(level) AS deepest FROM {PREFACED} GROUP BY doc) USING (doc))"


@add("h04_cut_level", f"SELECT doc, CAST(cut AS BIGINT) AS cut FROM {CUTS}")
def _(spark, d):
    return structure.cut_levels(tree(spark)).select("doc", F.col("cut").cast("bigint").alias("cut"))


@add("h05_cut_chapters", f"SELECT doc, start, title, tokens, n_blocks FROM {chapters_sql('cut', f'(SELECT * FROM {PATHS} JOIN {CUTS} USING (doc))')}")
def _(spark, d):
    t = tree(spark)
    return structure.chapters(t.join(structure.cut_levels(t).withColumnRenamed("cut", "cut_level"), "doc"), F.col("cut_level")).select("doc", "start", "title", "tokens", "n_blocks")


LINES = r"(SELECT doc_id AS doc, unnest(range(len(l))) AS pos, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"
BINS = f"""
WITH RECURSIVE l AS (SELECT doc, pos, {WORDS_SQL} AS t FROM {LINES}),
r AS (SELECT doc, pos, t, 0 AS bin, t AS run FROM l WHERE pos = 0
      UNION ALL SELECT l.doc, l.pos, l.t, CASE WHEN r.run + l.t > 100 THEN r.bin + 1 ELSE r.bin END, CASE WHEN r.run + l.t > 100 THEN l.t ELSE r.run + l.t END FROM r JOIN l ON l.doc = r.doc AND l.pos = r.pos + 1)
"""


def lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("pos", "text"))


@add("w05_greedy_bins", BINS + "SELECT doc, CAST(pos AS BIGINT) AS pos, CAST(bin AS BIGINT) AS bin FROM r")
def _(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.transform(F.split("text", "\n"), lambda x: T.word_count(x)).alias("t"))
    return rows.select("doc", F.posexplode(structure.greedy_bins(F.col("t"), 100)).alias("pos", "bin")).select("doc", F.col("pos").cast("bigint").alias("pos"), F.col("bin").cast("bigint").alias("bin"))


@add("h06_fallback_cut", BINS + "SELECT doc, CAST(bin + 1 AS BIGINT) AS part, CAST(max(bin) OVER (PARTITION BY doc) + 1 AS BIGINT) AS parts, CAST(sum(t) AS BIGINT) AS tokens, CAST(count(*) AS BIGINT) AS n_blocks FROM r GROUP BY doc, bin")
def _(spark, d):
    return structure.parts(lines(spark, d), 100)


SECTIONS = Inline(
    "doc int, n int, title string, text string",
    [
        (1, 1, "Imprint", "ISBN 5-02 and\n\nAll rights reserved"),
        (1, 2, "Contents", "Start 1\nMiddle 7\nEnd 12"),
        (1, 3, "Start", "once upon a time " * 12),
        (1, 4, "Middle", "tiny one"),
        (1, 5, "End", "the end of it " * 10),
        (2, 1, "Book · Contents", "Alpha\nBeta\nGamma\nmore text"),
        (2, 2, "Book · Alpha", "first words here"),
        (2, 3, "Beta", "second words. " * 30),
        (2, 4, "Gamma", ""),
        (2, 5, "Long", "A sentence of six plain words. " * 40),
    ],
)


def section_rows(spark: SparkSession) -> DataFrame:
    return SECTIONS.df(spark).withColumn("tokens", T.word_count(F.col("text")))


SECTION_SQL = f"(SELECT *, {WORDS_SQL} AS tokens FROM {SECTIONS.sql})"
_marks = " OR ".join(f"contains({fold_sql('text')}, {fold_sql(chr(39) + m + chr(39))})" for m in sections.META_MARKS)


@add("r01_meta", f"SELECT doc, n, title, tokens FROM {SECTION_SQL} WHERE tokens < 150 AND ({_marks}) UNION ALL SELECT -1, doc_id, source, {WORDS_SQL} FROM documents WHERE {WORDS_SQL} < 150 AND ({_marks})")
def _(spark, d):
    docs = table(spark, d, "documents").select(F.lit(-1).alias("doc"), F.col("doc_id").alias("n"), F.col("source").alias("title"), "text", T.word_count(F.col("text")).alias("tokens"))
    own = section_rows(spark).select("doc", F.col("n").cast("bigint").alias("n"), "title", "text", "tokens")
    return own.unionByName(docs).filter(sections.is_meta(F.col("text"), F.col("tokens"))).drop("text")


ORACLES["r01_meta"] = ORACLES["r01_meta"].replace("SELECT doc, n, title", "SELECT doc, CAST(n AS BIGINT) AS n, title", 1)
_key = lambda x: fold_sql(collapse_sql(x))
TOC = f"""
WITH c AS (SELECT * FROM {SECTION_SQL}), k AS (SELECT DISTINCT doc, {_key('title')} AS key FROM c),
l AS (SELECT doc, n, title, line, {_key('line')} AS key FROM (SELECT doc, n, title, unnest(string_split(text, chr(10))) AS line FROM c) WHERE trim(line) <> ''),
m AS (SELECT l.doc, l.n, count(*) AS lines, count(*) FILTER (WHERE regexp_matches(line, '[0-9]\\s*$')) AS numeric_, count(*) FILTER (WHERE k.key IS NOT NULL AND NOT list_contains(list_transform(string_split(title, ' · '), lambda s: {_key('s')}), l.key)) AS repeated FROM l LEFT JOIN k ON k.doc = l.doc AND k.key = l.key GROUP BY l.doc, l.n)
SELECT c.doc, c.n, c.title, coalesce(tokens <= 2000 AND (numeric_ / lines > 0.60 OR repeated / lines >= 0.80), false) AS is_toc FROM c LEFT JOIN m USING (doc, n)"""


@add("r02_toc", TOC)
def _(spark, d):
    return sections.toc_flags(section_rows(spark)).select("doc", "n", "title", "is_toc")


QUERIES["g11_toc_ratios"], ORACLES["g11_toc_ratios"] = QUERIES["r02_toc"], ORACLES["r02_toc"]
QUERIES["j06_toc_lines"], ORACLES["j06_toc_lines"] = QUERIES["r02_toc"], ORACLES["r02_toc"]


@add("r03_merge_tiny")
def _(spark, d):
    rows = chapters(spark, d).select(F.col("book").alias("doc"), "n", "title", "text", "tokens")
    return sections.merged_tiny(rows).select("doc", "n", "title", "tokens")


QUERIES["w11_tiny_fold"] = QUERIES["r03_merge_tiny"]


@add("r04_split_giants")
def _(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.lit(1).alias("n"), F.col("source").alias("title"), "text", T.word_count(F.col("text")).alias("tokens"))
    return sections.split_giants(rows, 400, 300).select("doc", "title", "tokens", "part")


@add("r05_empty", f"SELECT doc, n FROM {SECTION_SQL} WHERE text <> ''")
def _(spark, d):
    return sections.not_empty(section_rows(spark)).select("doc", "n")


@add("r00_section_passes")
def _(spark, d):
    rows = section_rows(spark)
    rows = sections.toc_flags(rows.filter(~sections.is_meta(F.col("text"), F.col("tokens")))).filter(~F.col("is_toc")).drop("is_toc")
    rows = sections.not_empty(sections.split_giants(sections.merged_tiny(rows), 100, 60).drop("part", "i"))
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("doc").orderBy("n", "title"))).select("doc", "n", "title", "tokens")


_more = "text || chr(10) || chr(10) || '12' || chr(10) || chr(10) || 'x' || chr(10) || '7' || chr(10) || ' 1999 '"
_lines = rf"list_transform(string_split({_more}, chr(10)), lambda x: regexp_replace(x, '^[ \t\r]+|[ \t\r]+$', '', 'g'))"


@add("w06_lone_numbers", f"SELECT doc_id, CAST(len(list_filter(range(1, len(l) + 1), lambda i: regexp_matches(l[i], '^[0-9]{{1,4}}$') AND (i = 1 OR l[i - 1] = '') AND (i = len(l) OR l[i + 1] = ''))) AS BIGINT) AS lone FROM (SELECT doc_id, {_lines} AS l FROM documents)")
def _(spark, d):
    more = F.concat("text", F.lit("\n\n12\n\nx\n7\n 1999 "))
    flags = F.get(F.transform(F.array(quality_gate.trimmed_lines(more)), quality_gate.lone_numbers), 0)
    return table(spark, d, "documents").select("doc_id", F.size(F.filter(flags, lambda x: x)).cast("bigint").alias("lone"))


@add("w14_windows", r"SELECT item_id, CAST(len(s) AS BIGINT) AS windows, array_to_string(s, ',') AS starts FROM (SELECT item_id, CASE WHEN n <= 8 THEN [0] ELSE list_sort(list_distinct(list_concat(range(0, n - 8 + 1, 2), [n - 8]))) END AS s FROM (SELECT item_id, CAST(len(regexp_extract_all(text, '[^ \t\n\r]+')) AS BIGINT) AS n FROM benchmark))")
def _(spark, d):
    starts = F.pandas_udf(lambda n: n.map(lambda k: verify.window_starts(k, 8).tolist()), "array<bigint>")(T.word_count(F.col("text")))
    rows = table(spark, d, "benchmark").select("item_id", starts.alias("s"))
    return rows.select("item_id", F.size("s").cast("bigint").alias("windows"), F.array_join(F.transform("s", lambda x: x.cast("string")), ",").alias("starts"))


def _segments(text: str | None) -> list[tuple[int, int]]:
    """(segment, tokens) of a text."""
    return sorted(verify.segment_sizes(text or "").items())


@add("w15_segments", f"SELECT * FROM (SELECT doc_id, unnest([1, 2]) AS seg, CAST(len({CANON_LIST_SQL}) AS BIGINT) AS n FROM (SELECT doc_id, regexp_replace(text, '(?m)^(> |- |[0-9]+\\. )+', '', 'g') AS text FROM documents)) WHERE n > 0")
def _(spark, d):
    both = F.concat(F.lit("# Head\n"), "text", F.lit("\n---\n"), "text")
    each = F.pandas_udf(lambda x: x.map(_segments), "array<struct<seg:int,n:bigint>>")(both)
    return table(spark, d, "documents").select("doc_id", F.explode(each).alias("x")).select("doc_id", "x.seg", "x.n")


_bare = r"regexp_replace(x, '^[ \t\r]+|[ \t\r]+$', '', 'g')"
_short = f"(length(s) <= 2 AND s NOT IN ({', '.join(repr(x) for x in quality_gate.SHORT_OK)}))"
METRICS = f"""
WITH l AS (SELECT doc_id AS doc, pos, {_bare} AS s FROM (SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))),
w AS (SELECT *, coalesce(lag(s) OVER o, '') AS a, coalesce(lead(s) OVER o, '') AS b FROM l WINDOW o AS (PARTITION BY doc ORDER BY pos)),
c AS (SELECT doc, count(*) FILTER (WHERE s <> '') AS lines, count(*) FILTER (WHERE s <> '' AND ({_short} OR (regexp_matches(s, '^[0-9]{{1,4}}$') AND a = '' AND b = ''))) AS garbage, count(*) FILTER (WHERE regexp_matches(s, '\\p{{L}}-$')) AS residue FROM w GROUP BY doc),
t AS (SELECT doc_id AS doc, lang, n_chars, {WORDS_SQL} AS tokens, {count_sql('text', chr(0xFFFD))} + {count_sql('text', 'Ñ')} + {count_sql('text', CONTROL_SQL)} AS bad, length(text) AS chars FROM documents),
m AS (SELECT doc, CAST(tokens AS DOUBLE) / greatest(1, CASE WHEN lang = 'de' THEN CAST(tokens * 2 AS BIGINT) ELSE tokens END) AS coverage,
      CASE WHEN lines > 0 THEN CAST(garbage AS DOUBLE) / lines ELSE 0 END AS garbage_ratio, CASE WHEN chars > 0 THEN CAST(bad AS DOUBLE) / chars ELSE 0 END AS encoding_score,
      CAST(CASE WHEN tokens BETWEEN 300 AND 20000 THEN 1.0 ELSE 0.7 END AS DOUBLE) AS structure, CASE WHEN lines > 0 THEN CAST(residue AS DOUBLE) / lines ELSE 0 END AS dehyphen_residue, CAST(tokens AS DOUBLE) AS median_tokens FROM t JOIN c USING (doc))
"""


def measured(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", spread=True)
    rows = docs.select(F.col("doc_id").alias("doc"), "text", T.word_count(F.col("text")).alias("tokens"))
    ref = T.word_count(F.col("text")) * F.when(F.col("lang") == "de", 2).otherwise(1)
    none = F.lit(0).cast("bigint")
    refs = docs.select(F.col("doc_id").alias("doc"), ref.alias("ref_tokens"), none.alias("removed_tokens"), T.control_count(F.col("text")).alias("control_chars"), F.lit(True).alias("found"), none.alias("pages"), none.alias("wide_pages"), F.lit(True).alias("hyphenated"))
    return quality_gate.metrics(rows, refs)


_r = lambda c: f"round(CAST({c} AS DOUBLE), 9) AS {c}"
_names = ("coverage", "garbage_ratio", "encoding_score", "structure", "dehyphen_residue", "median_tokens")


@add("q01_metrics", METRICS + f"SELECT doc, {', '.join(map(_r, _names))} FROM m")
def _(spark, d):
    return measured(spark, d).select("doc", *[F.round(c, 9).alias(c) for c in _names])


_down = lambda x, a, b: f"round(CAST(CASE WHEN {x} <= {a} THEN 1.0 WHEN {x} >= {b} THEN 0.0 ELSE (CAST({b} AS DOUBLE) - {x}) / (CAST({b} AS DOUBLE) - CAST({a} AS DOUBLE)) END AS DOUBLE), 4)"
_trap = "round(CAST(CASE WHEN coverage BETWEEN 0.70 AND 1.02 THEN 1.0 WHEN coverage <= 0.40 OR coverage >= 1.15 THEN 0.0 WHEN coverage < 0.70 THEN (coverage - CAST(0.40 AS DOUBLE)) / (CAST(0.70 AS DOUBLE) - CAST(0.40 AS DOUBLE)) ELSE (CAST(1.15 AS DOUBLE) - coverage) / (CAST(1.15 AS DOUBLE) - CAST(1.02 AS DOUBLE)) END AS DOUBLE), 4)"
SCORED = f"""{METRICS}, s AS (SELECT *, round(CAST(0.30 AS DOUBLE) * {_trap} + CAST(0.10 AS DOUBLE) * {_down('dehyphen_residue', 0.002, 0.03)} + CAST(0.15 AS DOUBLE) * {_down('encoding_score', 0.0, 0.02)} + CAST(0.20 AS DOUBLE) * {_down('garbage_ratio', 0.005, 0.05)} + CAST(0.25 AS DOUBLE) * structure, 4) AS score,
  CAST(coverage < 0.60 OR coverage > 1.02 AS BIGINT) + CAST(garbage_ratio > 0.02 AS BIGINT) + CAST(encoding_score > 0.005 AS BIGINT) + CAST(dehyphen_residue > 0.01 AS BIGINT) AS triggers FROM m),
z AS (SELECT *, CASE WHEN score < 0.60 THEN 'failed' WHEN score < 0.90 OR triggers > 0 THEN 'review' ELSE 'ok' END AS status FROM s)
"""


@add("q02_score_status", SCORED + "SELECT doc, score, triggers, status FROM z")
def _(spark, d):
    return quality_gate.scored(measured(spark, d)).select("doc", "score", F.size("triggers").cast("bigint").alias("triggers"), "status")


QUERIES["g13_weighted_score"], ORACLES["g13_weighted_score"] = QUERIES["q02_score_status"], ORACLES["q02_score_status"]
QUERIES["g04_coverage"] = lambda spark, d: measured(spark, d).select("doc", F.round("coverage", 9).alias("coverage"))
ORACLES["g04_coverage"] = METRICS + "SELECT doc, round(coverage, 9) AS coverage FROM m"
QUERIES["g05_line_counters"] = lambda spark, d: table(spark, d, "documents").select(F.col("doc_id").alias("doc"), quality_gate.line_counts(F.col("text")).alias("c")).select("doc", "c.*")
ORACLES["g05_line_counters"] = METRICS + "SELECT doc, CAST(lines AS BIGINT) AS lines, CAST(garbage AS BIGINT) AS garbage, CAST(residue AS BIGINT) AS residue FROM c"
QUERIES["g06_bad_chars"] = lambda spark, d: measured(spark, d).select("doc", F.round("encoding_score", 9).alias("encoding_score"))
ORACLES["g06_bad_chars"] = METRICS + "SELECT doc, round(CAST(encoding_score AS DOUBLE), 9) AS encoding_score FROM m"


@add("q03_report", SCORED + "SELECT doc, status, score, round(coverage, 4) AS coverage, round(CAST(garbage_ratio AS DOUBLE), 4) AS garbage_ratio, round(CAST(encoding_score AS DOUBLE), 4) AS encoding_score, structure FROM z")
def _(spark, d):
    s = quality_gate.scored(measured(spark, d))
    return s.select("doc", "status", "score", *[F.round(c, 4).alias(c) for c in ("coverage", "garbage_ratio", "encoding_score")], "structure")


@add("q04_status_override", SCORED + "SELECT doc, CASE WHEN status = 'ok' AND lang = 'de' AND NOT n_chars > 5000 THEN 'review' ELSE status END AS status FROM z JOIN t USING (doc)")
def _(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "lang", "n_chars")
    return quality_gate.with_repair(quality_gate.scored(measured(spark, d)).join(docs, "doc"), F.col("lang") == "de", F.col("n_chars") > 5000).select("doc", "status")


@add("q05_stored", SCORED + "SELECT doc, status FROM z WHERE status <> 'failed'")
def _(spark, d):
    return quality_gate.stored_only(quality_gate.scored(measured(spark, d))).select("doc", "status")


@add("n01_n03_block_passes", f"SELECT doc_id, regexp_replace({'W'}, '{CONTROL_SQL}', '', 'g') AS text FROM documents")
def _(spark, d):
    c = T.control_strip(T.whitespace(T.unicode_clean(F.col("text"))))
    return table(spark, d, "documents").select("doc_id", c.alias("text"))


_uni = r"regexp_replace(regexp_replace(text, '[\x{00AD}\x{200B}\x{200C}\x{200D}\x{FEFF}]', '', 'g'), '\r\n?', chr(10), 'g')"
_ws = rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_uni}, '[ \t]+', ' ', 'g'), '[ \t]+\n', chr(10), 'g'), '[ \t]+$', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\n+|\n+$', '', 'g')"
ORACLES["n01_n03_block_passes"] = f"SELECT doc_id, regexp_replace({_ws}, '{CONTROL_SQL}', '', 'g') AS text FROM documents"
