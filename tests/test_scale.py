"""Steps whose cost has to grow no faster than their input."""

from __future__ import annotations

import random
from collections import Counter
from difflib import SequenceMatcher

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

from leafmill.functions import batches
from leafmill.library import Library
from leafmill.operators import search, sections, verify
from leafmill.plans import catalogue
from leafmill.session import written
from leafmill.sources import extract


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def rows_of(df, columns):
    return sorted(str(r) for r in df.select(*columns).collect())


def texts(n: int, seed: int = 3) -> list[str]:
    r = random.Random(seed)
    words = ["".join(r.choices("abcdeё", k=r.randint(1, 4))) for _ in range(60)]
    return [" ".join(r.choices(words, k=r.randint(0, 40))) for _ in range(n)]


# --- F2-F7: attribution ---------------------------------------------------------------------------


def test_windows_are_compared_without_counting_anew(monkeypatch):
    """F2-F7: moves of a window's ends don't each run SequenceMatcher, and give its similarity."""
    r = random.Random(2)
    for _ in range(60):
        words = ["".join(r.choices("abc𝔸ж", k=r.randint(1, 5))) for _ in range(r.randint(1, 30))]
        quote = " ".join(r.choice(words) if r.random() < 0.7 else "zz" for _ in range(r.randint(1, 20)))
        low = r.randrange(len(words))
        high = r.randint(low + 1, len(words))
        a = r.randrange(low, high)
        b = r.randint(a + 1, high)
        assert verify.comparer(words, quote, low, high)(a, b) == SequenceMatcher(None, " ".join(words[a:b]), quote, autojunk=False).ratio()
        monkeypatch.setattr(verify.Runs, "MOST", 0)  # texts too long for a table
        assert verify.comparer(words, quote, low, high)(a, b) == SequenceMatcher(None, " ".join(words[a:b]), quote, autojunk=False).ratio()
        monkeypatch.undo()
    monkeypatch.setattr(verify, "SequenceMatcher", None)
    found = verify.best_window("x y z one two three four five six seven w".split(), "one two three fours five six".split(), verify.DISTORTED)
    assert (found.low, found.high) == (3, 9)


def test_best_rows(spark):
    """F2-F7: the best rows of each query are those of a row per token, also where keys repeat; no row per token is dealt out."""
    docs = spark.createDataFrame([(i // 2 * 2 if i > 70 else i, f"t{i % 3}", t or None) for i, t in enumerate(texts(90))], "k int, title string, text string")
    asked = [(q, form, i, len(t.split()), w) for q, t in enumerate(texts(12, 5)) for form in range(1 + q % 3) for i, w in enumerate(t.split()[form:][:9])]
    terms = spark.createDataFrame(asked, "qid int, form int, idx int, n_terms int, term string")
    weights = {"title": 5.0, "text": 1.0}

    def slow(d):
        found = search.bm25(d, ["k"], weights, terms.select(F.struct("qid", "form").alias("qid"), "idx", "n_terms", "term"), many=True)
        return search.top(found.groupBy(F.col("qid.qid").alias("qid"), "k").agg(F.max("score").alias("score")), ["k"], 5)

    single = docs.dropDuplicates(["k"])
    for d in (docs, single):
        assert rows_of(search.best(d, ["k"], weights, terms, 5), ["qid", "k", "rank"]) == rows_of(slow(d), ["qid", "k", "rank"])
    assert "explode" not in plan_of(search.best(single, ["k"], weights, terms, 5))
    assert search.best(single, ["k"], weights, terms.filter("qid < 0"), 5).count() == 0
    assert search.best(single.filter("k < 0"), ["k"], weights, terms, 5).count() == 0


# --- F10, F16: the index --------------------------------------------------------------------------


def test_index_rows_stay_where_they_are(spark):
    """F10, F16: texts are sorted into their terms without a shuffle of a row per token; rows of one key are put together."""
    docs = spark.createDataFrame([(i, f"t{i % 3} a" if i % 4 else None, t or None) for i, t in enumerate(texts(40))], "k int, title string, text string")
    columns = ["k", "term", "first", "rest", "len", "at"]
    found = search.index_rows(docs, ["k"], ["title", "text"])
    assert "Exchange" not in plan_of(found)
    assert rows_of(found, columns) == rows_of(search._met(docs, ["k"], ["title", "text"]), columns)
    twice = docs.unionByName(docs.withColumn("text", F.lit("a b a")))
    assert rows_of(search.index_rows(twice, ["k"], ["title", "text"]), columns) == rows_of(search._met(twice, ["k"], ["title", "text"]), columns)


# --- F11: segments --------------------------------------------------------------------------------


def test_segment_sizes():
    """tokens of segments are counted without making them, and are those that ``normalized`` gives, whatever the characters."""
    r = random.Random(4)
    alphabet = "aZé1２⑴_-'’[] \n#>.²ß０—\t" + "".join(chr(c) for c in range(0xFE6F, 0xFE80)) + "\ufc5e\uff9e"
    for k in range(3000):
        text = "".join(r.choices(alphabet if k % 3 else alphabet[:22], k=r.randint(0, 30)))
        text = text if k % 2 else f"# h\n{text}\n---\n[12] a[3]b\n> - 1. {text}"
        assert verify.segment_sizes(text) == dict(Counter(t.segment for t in verify.normalized(text)))
    hollow = {chr(c) for c in range(0x110000) if chr(c).isalnum() and not verify.canon(chr(c))}
    assert all(verify._ODD.search(c) for c in hollow)


# --- F8, F20, F21: slugs --------------------------------------------------------------------------


def twins_differ(spark, tmp_path, names, texts_, **more):
    """Names of the queries that don't give their twins' rows over these texts."""
    rows = [(i, t, "en", "" if i % 5 == 0 else None if i % 7 == 0 else "src X", len(t or "")) for i, t in enumerate(texts_)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0, 0) for i in range(0, len(rows), 3)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    con, out = duckdb.connect(), []
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    for name in names:
        df = catalogue.QUERIES[name](spark, str(tmp_path))
        twin = con.execute(catalogue.ORACLES[name])
        order = [[c[0] for c in twin.description].index(c) for c in df.columns]
        if Counter(map(tuple, df.collect())) != Counter(tuple(r[i] for i in order) for r in twin.fetchall()):
            out.append(name)
    return out


def test_ids_of_odd_texts(spark, tmp_path):
    """F8, F20, F21: ids of null and empty texts, of long ones with little to keep, and of those cut where the first part ends."""
    r = random.Random(1)
    odd = [None, "", " ", "---", "İstanbul İ", "x" * 500, "é" * 390 + "abc def" * 20, "-" * 395 + "word-" * 40, " " * 1000 + "tail words here", "ы" * 450, "щ" * 61, "a" * 60 + "-b", "a" * 61 + "-b", "a-" * 31]
    odd += ["".join(r.choices("ab -щЩß漢éΣς\n", [5, 5, 2, 1, 1, 1, 2, 2, 1, 1, 1, 1], k=r.randint(1, 900))) for _ in range(100)]
    assert twins_differ(spark, tmp_path, ["f02_make_id", "f01_slug", "f09_placeholder", "snk8_file_name", "j10_identity"], odd) == []


# --- F9, F12-F15, F17-F19: memory of Python workers -----------------------------------------------


def test_pieces():
    """F9, F12-F15, F17-F19: rows are worked on in pieces of few bytes, in order and none lost, nulls and long ones included."""
    values = [None, "a" * 700, "", "b" * 700, "c" * 5000, None, "d", "e" * 999]
    batch = pa.RecordBatch.from_pydict({"k": list(range(8)), "text": values})
    found = list(batches.pieces(iter([batch, batch.slice(0, 0), batch]), "text", 1000))
    assert [v for p in found for v in p.column("text").to_pylist()] == values * 2
    assert max(sum(map(len, filter(None, p.column("text").to_pylist()[:-1]))) for p in found) < 1000


def test_extraction_hands_on_few_bytes_at_once(monkeypatch):
    """F12-F15, F17-F19: sources of one batch go back in many, whatever its size."""
    n = 30
    rows = pa.RecordBatch.from_pydict({"path": [f"{i}.txt" for i in range(n)], "content": [b"One line.\n\nAnother. " * 20_000 for _ in range(n)], "sha256": [str(i) for i in range(n)]})
    found = list(extract._all(iter([rows]), True))
    assert [p for b in found for p in b.column("path").to_pylist()] == [f"{i}.txt" for i in range(n)]
    assert len(found) > 5 and all(b.nbytes < 8 << 20 for b in found)


def test_giants_are_cut_in_pieces(spark):
    """cutting keeps other columns, null ones too, and what a grouped or row function would give."""
    rows = [(k, k % 3 or None, f"t{k}", " ".join(f"w{i}." for i in range(k * 40)), k * 40) for k in range(12)]
    out = sections.split_giants(spark.createDataFrame(rows, "doc int, n int, title string, text string, tokens bigint"), 100, 60)
    assert "MapInArrow" in plan_of(out)
    wanted = []
    for doc, n, title, text, tokens in rows:
        own = sections._cut(title, text, 100, 60) if tokens > 100 else [{"title": title, "text": text, "part": None}]
        wanted += [(doc, n, p["title"], p["text"], len(p["text"].split()), p["part"], i) for i, p in enumerate(own)]
    found = [tuple(r) for r in out.select("doc", "n", "title", "text", "tokens", "part", "i").collect()]
    assert sorted(map(str, found)) == sorted(map(str, wanted))


# --- F1: ingest -----------------------------------------------------------------------------------


def test_ingest_leaves_no_copies(spark, tmp_path):
    """of what an ingest writes between its steps only the outcomes stay, and outcomes and library can be read afterwards."""
    before = written()
    lib = Library(spark, f"{tmp_path}/lib")
    said = ["A well-known harbour, they said, and well they might.", "It was known as well as any other place by the sea."]
    texts_ = [f"Chapter 1\n\n{said[0] * 30} Ship {k % 4}.\n\nChapter 2\n\n{(said[1] + ' ') * 30}" for k in range(6)]
    found = lib.ingest_files(spark.createDataFrame([(f"in/{9 - k}.txt", bytearray(t.encode())) for k, t in enumerate(texts_)], "path string, content binary"))
    assert written() - before == 1
    assert found.count() == 6 and lib.table("books").count() == 4
    assert sorted(r.path for r in lib.table("sources").collect()) == ["in/4.txt", "in/5.txt", "in/6.txt", "in/7.txt"]  # of copies the least path
    assert sorted(r.id for r in lib.table("books").collect()) == ["4", "5", "6", "7"]
    assert lib.find("harbour").count() > 0
