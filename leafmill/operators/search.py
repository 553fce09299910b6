"""Full-text search as relations: postings, corpus statistics, prefix terms, BM25, AND with fallback to OR.

An index row has key columns, a title and a text. Tokens are runs of letters and digits, lower-cased,
Latin diacritics removed. Terms match as prefixes. Statistics are of the whole index, whatever filter
is put on the hits. Query terms are a small table (their number is checked) and are broadcast.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.session import stored

# Parameters of the ranking, and Latin letters with their plain forms.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāēīōūčďěňřšťůžąćęłńśźżğışőű"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyaeioucdenrstuzacelnszzgisou"
MOST_TERMS = 10_000


def folded(c: Column) -> Column:
    return F.translate(F.lower(c), ACCENTED, PLAIN)


def terms_of(c: Column) -> Column:
    return F.regexp_extract_all(folded(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def postings(docs: DataFrame, keys: list[str], columns: list[str], length: bool = False) -> DataFrame:
    """keys, col, pos, term: one row per token; with ``length`` also the tokens of the row over all columns, ``len``. Texts are taken apart once."""
    lists = [terms_of(F.coalesce(F.col(c), F.lit(""))).alias(f"_{i}") for i, c in enumerate(columns)]

    def placed(i: int, c: str) -> Column:
        return F.transform(F.col(f"_{i}"), lambda t, p: F.struct(F.lit(c).alias("col"), p.alias("pos"), t.alias("term")))

    each = F.flatten(F.array(*[placed(i, c) for i, c in enumerate(columns)]))
    size = sum((F.size(f"_{i}") for i in range(len(columns))), F.lit(0)).cast("double").alias("len")
    return docs.select(*keys, *lists).select(*keys, *[size] * length, F.explode(each).alias("t")).select(*keys, "t.col", "t.pos", "t.term", *["len"] * length)


def lengths(docs: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """keys and the tokens of each row over all columns."""
    n = F.lit(0)
    for c in columns:
        n = n + F.coalesce(F.size(terms_of(F.col(c))), F.lit(0))
    return docs.select(*keys, n.cast("double").alias("len"))


def words_of(query: str) -> list[list[str]]:
    """The words of a query as it is typed, each as the tokens that the index has of it: a word with a hyphen is a phrase; one without letters or digits is none."""
    fold = str.maketrans(ACCENTED, PLAIN)
    return [t for w in query.split() if (t := re.findall(r"[^\W_]+", w.lower().translate(fold)))]


def query_terms(spark: SparkSession, queries: list[tuple[int, str]]) -> DataFrame:
    """The tokens of the words of each query: qid, idx (the word), n_terms (the query's words), j and k (place and number of the token in its word), term.

    The last token of a word matches as a prefix, those before it whole and next to each other.
    """
    rows = []
    for qid, text in queries:
        words = words_of(text)
        rows += [(qid, i, len(words), j, len(w), t) for i, w in enumerate(words) for j, t in enumerate(w)]
    if len(rows) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} query terms in one call")
    return spark.createDataFrame(rows, "qid int, idx int, n_terms int, j int, k int, term string")


def _matches(token: Column) -> Column:
    return F.when(F.col("j") == F.col("k") - 1, token.startswith(F.col("term"))).otherwise(token == F.col("term"))


def bm25(docs: DataFrame, keys: list[str], weights: dict[str, float], terms: DataFrame, many: bool = False) -> DataFrame:
    """qid, keys, score (larger is better), matched: number of the query's words found. ``many``: single tokens of any number, joined with the prefixes of all tokens."""
    columns = list(weights)
    weight = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    tokens = postings(docs, keys, columns, length=True).withColumnRenamed("term", "token")
    if many:
        begins = F.transform(F.sequence(F.lit(1), F.length("token")), lambda i: F.substring(F.col("token"), F.lit(1), i))
        known = tokens.select("token").distinct().select("token", F.explode(begins).alias("term")).join(terms.select("term").distinct(), "term")
        found = tokens.join(known, "token").join(terms, "term").withColumn("w", weight[F.col("col")])
    else:  # the terms are few and bounded: what matches none of them is dropped before anything is shuffled
        hits = tokens.join(F.broadcast(terms), _matches(F.col("token")))
        same = ["qid", "idx", "n_terms", "k", *keys, "col", (F.col("pos") - F.col("j")).alias("at")]
        found = hits.groupBy(*same).agg(F.count("*").alias("m"), F.max("len").alias("len")).filter("m = k").withColumn("w", weight[F.col("col")])
    hits = found.groupBy("qid", "idx", "n_terms", *keys).agg(F.sum("w").alias("f"), F.max("len").alias("len"))
    return ranked(hits, keys, lengths(docs, keys, columns).agg(F.count("*").alias("n_docs"), F.avg("len").alias("avgdl")))


def ranked(hits: DataFrame, keys: list[str], corpus: DataFrame) -> DataFrame:
    """Scores of hits (qid, idx, n_terms, keys, f: weighted times, len: tokens of the row); ``corpus``: one row, n_docs and avgdl."""
    df = hits.groupBy("qid", "idx").agg(F.count("*").alias("df"))
    idf = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(idf <= 0, LEAST_IDF).otherwise(idf)
    part = idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("len") / F.col("avgdl")))
    scored = hits.join(F.broadcast(df), ["qid", "idx"]).crossJoin(F.broadcast(corpus))
    return scored.groupBy("qid", "n_terms", *keys).agg(F.round(F.sum(part), 9).alias("score"), F.count("*").alias("matched"))


# --- the best rows of many queries ---------------------------------------------------------------

#: Rows scored together, terms of queries that are looked for in one pass over the rows, and tokens whose terms a task remembers.
ROWS, TERMS, KNOWN = 1024, 500_000, 200_000


def repeated(docs: DataFrame, keys: list[str]) -> bool:
    """Whether several rows have the same key; only the keys are read."""
    return bool(docs.groupBy(*keys).count().filter("count > 1").head(1))


class _Terms:
    """Terms with what must be known to find them in tokens: a token has all terms that it begins with."""

    def __init__(self, terms: list[str]):
        self.of = {t: i for i, t in enumerate(terms)}
        self.sizes = sorted({len(t) for t in terms})
        self.known: dict[str, list[int]] = {}

    def begun(self, token: str) -> list[int]:
        own = self.known[token] = [k for n in self.sizes if n <= len(token) and (k := self.of.get(token[:n])) is not None]
        return own

    def hits(self, batch: pa.RecordBatch, weights: list[float]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row, term and weighted times of each term in each row, by row and term; the rows' lengths."""
        rows, terms, times = [], [], []
        length = np.zeros(batch.num_rows)
        for i, weight in enumerate(weights):
            lists = batch.column(f"_{i}")
            sizes = np.diff(lists.offsets.to_numpy())
            length += sizes
            flat = lists.flatten().dictionary_encode()
            if len(self.known) > KNOWN:
                self.known.clear()
            own = [self.begun(t) if (x := self.known.get(t)) is None else x for t in flat.dictionary.to_pylist()]
            n_own = np.fromiter(map(len, own), np.int64, len(own))
            begins = np.append(0, np.cumsum(n_own))
            code = flat.indices.to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(batch.num_rows), sizes)
            kept = n_own[code] > 0
            code, row = code[kept], row[kept]
            rows.append(np.repeat(row, n_own[code]))
            terms.append(np.fromiter((k for x in own for k in x), np.int64, begins[-1])[spans(begins[code], n_own[code])])
            times.append(np.full(len(rows[-1]), weight))
        row, term, times = map(np.concatenate, (rows, terms, times))
        both, at = np.unique(row * len(self.of) + term, return_inverse=True)
        return both // len(self.of), both % len(self.of), np.bincount(at, times, len(both)), length


def spans(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of each span, one span after the other."""
    return np.repeat(begins - np.append(0, np.cumsum(sizes)[:-1]), sizes) + np.arange(sizes.sum())


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            yield pa.concat_batches([b.slice(at, ROWS)])  # without the offsets of a slice


def best(docs: DataFrame, keys: list[str], weights: dict[str, float], terms: DataFrame, k: int) -> DataFrame:
    """qid, keys, score, rank: what ``bm25`` with ``many``, the best form of each query and ``top`` give, without a row per token.

    ``terms``: qid, form, idx, n_terms, term; a query counts with its best form. Where each row has a key of its own, the
    terms that a row holds are put down beside its key, and only the ``k`` best rows of each task go on.
    """
    if repeated(docs, keys):  # rows of one key count together
        found = bm25(docs, keys, weights, terms.select(F.struct("qid", "form").alias("qid"), "idx", "n_terms", "term"), many=True)
        return top(found.groupBy(F.col("qid.qid").alias("qid"), *keys).agg(F.max("score").alias("score")), keys, k)
    lists = docs.select(*keys, *[terms_of(F.coalesce(F.col(c), F.lit(""))).alias(f"_{i}") for i, c in enumerate(weights)])
    terms = terms.filter("qid IS NOT NULL")
    pieces = -(-terms.count() // TERMS)
    out = None
    for piece in range(pieces):  # one at a time; each holds whole queries
        own = terms.filter(F.pmod(F.xxhash64("qid"), F.lit(pieces)) == piece).groupBy("qid", "form", "term").count()
        some = _best(lists, keys, list(weights.values()), own, k)
        out = some if out is None else out.unionByName(some)
    return out if out is not None else docs.limit(0).select(F.lit(None).cast(terms.schema["qid"].dataType).alias("qid"), *keys, F.lit(0.0).alias("score"), F.lit(1).alias("rank"))


def _best(lists: DataFrame, keys: list[str], weights: list[float], own: DataFrame, k: int) -> DataFrame:
    spark = lists.sparkSession
    rows = own.collect()
    words = _Terms(sorted({r.term for r in rows}))
    n_terms = len(words.of)

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lists.select(*keys).schema)

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _sliced(batches):
            row, term, f, length = words.hits(b, weights)
            begins = pa.array(np.searchsorted(row, np.arange(b.num_rows + 1)).astype(np.int32))
            each = [pa.ListArray.from_arrays(begins, pa.array(x)) for x in (term.astype(np.int32), f)]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keys], pa.array(length), *each], [*keys, "len", "terms", "f"])

    found = stored(lists.mapInArrow(held, f"{types}, len double, terms array<int>, f array<double>"), "terms")
    corpus = found.agg(F.count("*").alias("n"), F.avg("len").alias("mean")).first()
    told = {r.term: r.n for r in found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect()}
    n_docs, mean = corpus.n, corpus.mean
    df = np.array([told.get(i, 0) for i in range(n_terms)], float)
    idf = np.log((n_docs - df + 0.5) / (df + 0.5), out=np.full(n_terms, LEAST_IDF), where=df <= n_docs / 2)
    idf = np.where(idf <= 0, LEAST_IDF, idf)
    # the forms of each term, and the query of each form; forms of a query are next to each other
    forms = sorted({(r.qid, r.form) for r in rows})
    place = {f: i for i, f in enumerate(forms)}
    queries = sorted({q for q, _ in forms})
    first = np.flatnonzero([i == 0 or f[0] != forms[i - 1][0] for i, f in enumerate(forms)])
    by_term = sorted((words.of[r.term], place[r.qid, r.form], r["count"]) for r in rows)
    term_of, form_of, times_of = (np.array(x) for x in zip(*by_term, strict=True))
    n_forms = np.bincount(term_of, minlength=n_terms)
    begins = np.append(0, np.cumsum(n_forms)[:-1])
    width = len(forms)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = np.full((len(queries), k), -1.0)  # the best scores of each query so far
        for b in _sliced(batches):
            b = b.sort_by([(c, "ascending") for c in keys])
            row = np.repeat(np.arange(b.num_rows), np.diff(b.column("terms").offsets.to_numpy()))
            term, f = (b.column(c).flatten().to_numpy() for c in ("terms", "f"))
            part = idf[term] * f * (K1 + 1) / (f + K1 * (1 - B + B * b.column("len").to_numpy()[row] / mean))
            each = spans(begins[term], n_forms[term])
            at = np.repeat(row * width, n_forms[term]) + form_of[each]
            score = np.bincount(at, np.repeat(part, n_forms[term]) * times_of[each], b.num_rows * width)
            score = np.maximum.reduceat(np.round(score, 9).reshape(-1, width), first, axis=1).T  # a row per query
            order = np.argsort(-score, axis=1, kind="stable")[:, :k]
            high = np.take_along_axis(score, order, 1)
            query, j = np.nonzero((high > 0) & (high >= least[:, -1:]))
            least = -np.sort(-np.concatenate([least, high], axis=1), axis=1)[:, :k]
            yield pa.RecordBatch.from_arrays([pa.array(query), *[b.column(c).take(pa.array(order[query, j])) for c in keys], pa.array(high[query, j])], ["q", *keys, "score"])

    best_found = found.mapInArrow(scored, f"q bigint, {types}, score double")
    names = spark.createDataFrame(list(enumerate(queries)), T.StructType([T.StructField("q", T.LongType()), T.StructField("qid", own.schema["qid"].dataType)]))
    return top(best_found.withColumnRenamed("q", "qid"), keys, k).withColumnRenamed("qid", "q").join(F.broadcast(names), "q").drop("q")


# --- a stored index ------------------------------------------------------------------------------

#: Partitions of the index, by the first character of a term.
LEADS = 64
INDEX = "term string, first int, rest int, len double, at array<int>, lead int"


def index_rows(docs: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """keys and one row per term: how often the first column has it, how often the others, where (columns after one another, with a gap between), and the row's length.

    A row with a key of its own is sorted into its terms where it lies; only rows of one key have to meet.
    """
    if repeated(docs, keys):
        rows = _met(docs, keys, columns)
    else:
        lists = [terms_of(F.coalesce(F.col(c), F.lit(""))).alias(f"_{i}") for i, c in enumerate(columns)]
        size = sum((F.size(f"_{i}") for i in range(len(columns))), F.lit(0)).alias("size")

        def placed(i: int) -> Column:
            return F.transform(F.col(f"_{i}"), lambda t, p: F.struct(t.alias("term"), (p + i * (F.col("size") + 1)).alias("at"), F.lit(int(i == 0)).alias("first")))

        every = F.sort_array(F.flatten(F.array(*map(placed, range(len(columns))))))
        begins = F.filter(F.sequence(F.lit(1), F.col("size")), lambda i: (i == 1) | (F.get("every", i - 1)["term"] != F.get("every", i - 2)["term"]))
        each = F.transform("begins", lambda b, i: F.slice("every", b, F.coalesce(F.get("begins", i + 1), F.col("size") + 1) - b))
        rows = docs.select(*keys, *lists).select("*", size).filter("size > 0").select(*keys, "size", every.alias("every")).select("*", begins.alias("begins")).select(*keys, "size", F.explode(each).alias("own"))
        first = F.size(F.filter("own", lambda x: x["first"] == 1))
        rows = rows.select(*keys, F.get("own", 0)["term"].alias("term"), first.alias("first"), (F.size("own") - first).alias("rest"), F.col("size").cast("double").alias("len"), F.col("own.at").alias("at"))
    return rows.withColumn("lead", F.pmod(F.ascii("term"), F.lit(LEADS)).cast("int"))


def _met(docs: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """The rows of ``index_rows``, put together from a row per token."""
    tokens = postings(docs, keys, columns, length=True)
    gap = F.col("len").cast("int") + 1
    place = F.coalesce(*[F.when(F.col("col") == c, i) for i, c in enumerate(columns)], F.lit(0))
    first = (F.col("col") == columns[0]).cast("int")
    return tokens.groupBy(*keys, "term").agg(F.sum(first).cast("int").alias("first"), F.sum(1 - first).cast("int").alias("rest"), F.max("len").alias("len"), F.sort_array(F.collect_list((F.col("pos") + gap * place).cast("int"))).alias("at"))


def synced(index: DataFrame, known: DataFrame, docs: DataFrame, keys: list[str], columns: list[str], current: DataFrame) -> DataFrame:
    """The index brought up to date: rows of what is gone or changed go, what is new or changed is indexed; the rest is not looked at again.

    ``known`` and ``current``: id and fingerprint then and now; ``id`` is the first of ``keys``.
    """
    same = current.join(known, ["id", "fingerprint"], "left_semi").select(F.col("id").alias(keys[0]))
    fresh = docs.join(same, keys[0], "left_anti")
    return index.join(same, keys[0], "left_semi").unionByName(index_rows(fresh, keys, columns))


def from_index(index: DataFrame, keys: list[str], weights: tuple[float, float], spark: SparkSession, queries: list[tuple[int, str]], corpus: DataFrame) -> DataFrame:
    """The scores that ``bm25`` gives, from an index: only the partitions and ranges of the queries' terms are read."""
    terms = query_terms(spark, queries)
    tokens = sorted({t for _, q in queries for w in words_of(q) for t in w})
    if not tokens:
        return ranked(spark.createDataFrame([], f"qid int, idx int, n_terms int, {', '.join(f'{f.name} {f.dataType.simpleString()}' for f in index.select(*keys).schema)}, f double, len double"), keys, corpus)
    own = F.lit(False)
    for t in tokens:
        own = own | F.col("term").startswith(t)
    rows = index.filter(F.col("lead").isin(sorted({ord(t[0]) % LEADS for t in tokens}))).filter(own).withColumnRenamed("term", "token")
    hits = rows.join(F.broadcast(terms), _matches(F.col("token")))
    f = F.sum(weights[0] * F.col("first") + weights[1] * F.col("rest"))
    single = hits.filter("k = 1").groupBy("qid", "idx", "n_terms", *keys).agg(f.alias("f"), F.max("len").alias("len"))
    if any(len(w) > 1 for _, q in queries for w in words_of(q)):
        at = hits.filter("k > 1").select("qid", "idx", "n_terms", "k", "j", *keys, "len", F.explode("at").alias("at"))
        whole = at.groupBy("qid", "idx", "n_terms", "k", *keys, (F.col("at") - F.col("j")).alias("at")).agg(F.count("*").alias("m"), F.max("len").alias("len")).filter("m = k")
        # a phrase lies in the first column if it begins before the gap
        weight = F.when(F.col("at") <= F.col("len"), weights[0]).otherwise(weights[1])
        single = single.unionByName(whole.groupBy("qid", "idx", "n_terms", *keys).agg(F.sum(weight).alias("f"), F.max("len").alias("len")))
    return ranked(single, keys, corpus)


def all_or_any(scored: DataFrame) -> DataFrame:
    """Hits with all terms of their query; where there are none and there are several terms, those with any, as ``partial``."""
    both = F.max((F.col("matched") == F.col("n_terms")).cast("int")).over(Window.partitionBy("qid"))
    flagged = scored.withColumn("has_all", both == 1)
    keep = (F.col("has_all") & (F.col("matched") == F.col("n_terms"))) | (~F.col("has_all") & (F.col("n_terms") > 1))
    return flagged.filter(keep).withColumn("partial", ~F.col("has_all")).drop("has_all")


def top(scored: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k best of each query, ties by key, with their rank."""
    order = Window.partitionBy("qid").orderBy(F.desc("score"), *keys)
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def phrases(post: DataFrame, keys: list[str], words: list[str]) -> DataFrame:
    """Rows that hold the words next to each other in one column, the last as a prefix."""
    out = None
    for i, w in enumerate(words):
        last = i == len(words) - 1
        hit = F.col("term").startswith(w) if last else F.col("term") == w
        here = post.filter(hit).select(*keys, "col", (F.col("pos") - i).alias("at"))
        out = here if out is None else out.join(here, [*keys, "col", "at"], "left_semi")
    return out.select(*keys).distinct()


def stem_guard(word: str, stem: str) -> str:
    """The stem, if it is the beginning of the word and has three letters or more."""
    return stem if len(stem) >= 3 and word.startswith(stem) else word


#: Endings that the light stemmers take off, longest first.
ENDINGS = {"en": ("ations", "ation", "ings", "ing", "ies", "ed", "es", "s", "ly"), "ru": ("иями", "ями", "ами", "ого", "его", "ому", "ыми", "ими", "ах", "ях", "ов", "ев", "ой", "ей", "ый", "ий", "ая", "яя", "ом", "ем", "ам", "ям", "ы", "и", "а", "я", "у", "ю", "о", "е", "ь")}


def light_stem(word: str) -> str:
    """A query word without a common ending of its alphabet, under the guard; the index isn't stemmed."""
    w = word.lower()
    for e in ENDINGS["ru" if re.search("[а-яё]", w) else "en"]:
        if w.endswith(e):
            return stem_guard(w, w[: -len(e)])
    return w


def yo_variants(words: list[str], most: int = 8) -> list[list[str]]:
    """The words with one ye written as yo, at each place, up to ``most``."""
    out = [words]
    for i, w in enumerate(words):
        for k, ch in enumerate(w):
            if ch == "е" and len(out) <= most:
                out.append([*words[:i], w[:k] + "ё" + w[k + 1 :], *words[i + 1 :]])
    return out


def highlight(c: Column, prefix: str) -> Column:
    """Words that begin with ``prefix`` between guillemets."""
    return F.regexp_replace(c, rf"(?iu)(?<![\p{{L}}\p{{N}}])({re.escape(prefix)}[\p{{L}}\p{{N}}]*)", "«$1»")


def snippet(text: str, prefixes: list[str], most: int = 12) -> str:
    """The first run of ``most`` words with the most hits, hits marked, cuts shown."""
    words = text.split()
    hit = [any(re.sub(r"\W", "", w.lower()).startswith(p) for p in prefixes) for w in words]
    starts = range(max(1, len(words) - most + 1))
    at = max(starts, key=lambda s: (sum(hit[s : s + most]), -s))
    body = " ".join(f"«{w}»" if h else w for w, h in zip(words[at : at + most], hit[at : at + most], strict=True))
    return ("…" if at else "") + body + ("…" if at + most < len(words) else "")


def _snippets(text: pd.Series, prefixes: pd.Series) -> pd.Series:
    return text.combine(prefixes, lambda t, p: snippet(t or "", p.split(" ")))


def with_snippets(hits: DataFrame, text: str, prefixes: str) -> DataFrame:
    """Hits (the few that are shown) with a snippet of ``text``."""
    return hits.withColumn("snippet", F.pandas_udf(_snippets, "string")(F.col(text), F.lit(prefixes)))
