"""A library of books on any store Spark writes: parts that are only added, a manifest of them, ingest, reads, search, verification.

Each change adds one new part, ``<root>/<table>/part=<name>``, to the tables it has rows for, and then names
it in ``<root>/manifest``: readers see the state before or after. A book's newest row is in force, and says
which part holds its chapters, its source and its rows of the search index; rows of other parts are passed
over. After ``MOST_PARTS`` changes what is in force is written as one part. One writer at a time.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from leafmill.config import digest, load
from leafmill.functions import text as T
from leafmill.functions import tokens
from leafmill.operators import catalog, quality_gate, render, search, sections, structure, verify
from leafmill.plans.reads import budget_read
from leafmill.session import drop, freed, stored, written
from leafmill.sources import extract

VERSION = "2.5"
BOOKS = "id string, title string, author string, lang string, fmt string, sha256 string, cache_key string, meta_locked boolean, score double, status string, triggers string, total_tokens bigint, ingested_at string"
CHAPTERS = "book string, n bigint, title string, text string, tokens bigint, summary string"
SOURCES = "sha256 string, path string, content binary"
OUTCOMES = "path string, id string, status string, score double, error string"
INDEX = f"book string, n bigint, {search.INDEX}"
SIZES = "book string, n bigint, len double"
SCHEMAS = {"books": BOOKS, "chapters": CHAPTERS, "outcomes": OUTCOMES, "sources": SOURCES, "index": INDEX, "sizes": SIZES}
#: Columns of all rows besides their own: the part they were written with. Of books also the part of their data, and whether they are gone.
OWN, OF_BOOKS = ", part string", ", data string, gone boolean"
#: Seconds to wait for another writer; seconds after which a lock whose writer has died may be taken.
LOCK_SECONDS, LEASE_SECONDS = 30, 6 * 3600
#: Parts of a library before they are written as one.
MOST_PARTS = 64
SEARCHED = (5.0, 1.0)
#: Compression of what is written between the steps of an ingest.
STEP = "zstd"


class Library:
    """Books of a folder; ``config`` (see ``leafmill.config``) is what results depend on, its digest part of each book's key."""

    def __init__(self, spark: SparkSession, root: str, config: dict | None = None):
        self.spark, self.root, self.config = spark, root.rstrip("/"), config or load()

    # --- storage ---------------------------------------------------------------------------------

    def _parts(self) -> list:
        """(name, tables) of the parts in force."""
        try:
            rows = self.spark.read.schema("at bigint, parts array<struct<name:string,tables:array<string>>>").json(f"{self.root}/manifest").orderBy(F.desc("at")).limit(1).collect()
        except AnalysisException:
            return []
        return list(rows[0].parts) if rows else []

    def _rows(self, name: str) -> DataFrame:
        """All rows of a table in all parts."""
        schema = SCHEMAS[name] + OWN + OF_BOOKS * (name == "books")
        parts = [p.name for p in self._parts() if name in p.tables]
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}").filter(F.col("part").isin(parts))

    def _books(self) -> DataFrame:
        """The newest row of each book that isn't gone; names of parts grow."""
        newest = Window.partitionBy("id").orderBy(F.desc("part"))
        return self._rows("books").withColumn("newest", F.row_number().over(newest)).filter("newest = 1 AND NOT gone").drop("newest")

    def table(self, name: str) -> DataFrame:
        """A table as it is in force."""
        columns = [f.split()[0] for f in SCHEMAS[name].replace("array<int>", "array").split(", ")]
        rows = self._books() if name == "books" else self._rows(name)
        if name not in ("books", "outcomes"):
            key = "sha256" if name == "sources" else "book"
            rows = rows.join(self._books().select(F.col("sha256" if name == "sources" else "id").alias(key), F.col("data").alias("part")), [key, "part"], "left_semi")
        return rows.select(*columns)

    @contextmanager
    def lock(self) -> Iterator[None]:
        """One writer at a time: a file that only one can create, and that may be taken over once its lease has run out."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/writer.lock")
        fs, began, self._token = path.getFileSystem(self.spark._jsc.hadoopConfiguration()), time.time(), uuid.uuid4().hex
        while True:
            try:
                out = fs.create(path, False)
                out.write(bytearray(self._token.encode()))
                out.close()
                break
            except Py4JJavaError as e:
                try:
                    age = time.time() - fs.getFileStatus(path).getModificationTime() / 1000
                except Py4JJavaError as gone:
                    if "FileNotFound" not in str(gone.java_exception):
                        raise e from gone  # not a held lock: the folder can't be written
                    if time.time() - began > LOCK_SECONDS:
                        raise e from gone
                    continue
                if age > LEASE_SECONDS:
                    fs.delete(path, False)
                elif time.time() - began > LOCK_SECONDS:
                    raise TimeoutError(f"{self.root} is locked by another writer") from e
                else:
                    time.sleep(0.2)
        try:
            yield
        finally:
            if self._held():
                fs.delete(path, False)

    def _held(self) -> bool:
        """Whether the lock is still this writer's."""
        try:
            return self.spark.read.text(f"{self.root}/writer.lock").first()[0] == self._token
        except (AnalysisException, TypeError):
            return False

    def _write(self, name: str, tables: dict[str, DataFrame]) -> None:
        for table, df in tables.items():
            to, writer = f"{self.root}/{table}/part={name}", df
            if table == "books":
                writer = writer.withColumn("data", F.coalesce("data", F.lit(name)) if "data" in df.columns else F.lit(name)).withColumn("gone", F.col("gone") if "gone" in df.columns else F.lit(False))
            if table == "index":
                writer.repartition("lead", F.pmod(F.xxhash64("term"), F.lit(8))).sortWithinPartitions("lead", "term").write.partitionBy("lead").parquet(to)
            else:
                writer.write.parquet(to)

    def _publish(self, tables: dict[str, DataFrame], written_out: Callable[[], None] | None = None) -> None:
        """A new part with these rows, then the manifest; a crash before that leaves the old state in force. ``written_out`` is called once nothing reads what the rows were made of."""
        parts = self._parts()
        at = max(int(time.time() * 1000), int(parts[-1].name.split("-")[0]) + 1 if parts else 0)
        name = f"{at:015d}-{uuid.uuid4().hex[:8]}"
        self._write(name, tables)
        if written_out:
            written_out()
        names = sorted(tables)
        if "chapters" in tables:
            chapters = self.spark.read.schema(CHAPTERS).parquet(f"{self.root}/chapters/part={name}")
            keys, columns = ["book", "n"], ["title", "text"]
            self._write(name, {"index": search.index_rows(chapters, keys, columns), "sizes": search.lengths(chapters, keys, columns)})
            names += ["index", "sizes"]
        new = [*((p.name, list(p.tables)) for p in parts), (name, names)]
        self._point(at, new)
        if len(new) >= MOST_PARTS:
            self._compact(at + 1)

    def _point(self, at: int, parts: list[tuple[str, list[str]]]) -> None:
        if not self._held():
            raise TimeoutError(f"the lock of {self.root} was taken over by another writer")
        row = self.spark.createDataFrame([(at, parts)], "at bigint, parts array<struct<name:string,tables:array<string>>>")
        row.coalesce(1).write.mode("append").json(f"{self.root}/manifest")

    def _compact(self, at: int) -> None:
        """What is in force as one part; parts that no manifest of the last two states names are deleted."""
        name, before = f"{at:015d}-{uuid.uuid4().hex[:8]}", {p.name for p in self._parts()}
        books = self._books().drop("part").withColumn("data", F.lit(name))
        self._write(name, {"books": books} | {t: self.table(t) for t in SCHEMAS if t != "books"})
        self._point(at, [(name, sorted(SCHEMAS))])
        for table in SCHEMAS:
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}")
            fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
            for f in fs.listStatus(folder) if fs.exists(folder) else ():
                if f.getPath().getName().removeprefix("part=") not in before | {name}:
                    fs.delete(f.getPath(), True)

    # --- ingest ----------------------------------------------------------------------------------

    def cache_key(self, sha: Column) -> Column:
        return F.concat_ws(":", sha, F.lit(VERSION), F.lit(digest(self.config)))

    def ingest(self, *paths: str) -> DataFrame:
        """Reads files into the library; the outcomes, one row per file. Files whose key is known are skipped."""
        return self.ingest_files(extract.files(self.spark, *paths))

    def reingest(self) -> DataFrame:
        """All kept sources once more, under the present settings; ids and locked metadata stay."""
        return self.ingest_files(self.table("sources").select("path", "content"), force=True)

    def ingest_files(self, files: DataFrame, force: bool = False) -> DataFrame:
        with self.lock():
            return self._ingest(files, force)

    def _ingest(self, files: DataFrame, force: bool) -> DataFrame:
        files = files.withColumn("key", self.cache_key(F.sha2("content", 256)))
        known = self.table("books").filter(F.lit(not force)).select(F.col("cache_key").alias("key"), F.col("id").alias("known_id"))
        fresh = catalog.fresh(files, known)
        done = files.select("path", "key").join(known, "key").select("path", F.col("known_id").alias("id"), F.lit("skipped").alias("status"), F.lit(None).cast("double").alias("score"), F.lit("already in the library").alias("error"))
        # the bytes are read once: extraction hands them on with what it has read, and of the plain text what is asked of it
        began, count = written(), tokens.counter(self.config["tokens"]["ranks"])
        ref = F.col("ref_text")
        read = extract.extract(fresh, content=True).withColumn("ref_tokens", count(ref)).withColumn("control_chars", T.control_count(ref)).withColumn("ref_lang", T.language(ref))
        read = stored(read.drop("ref_text"), "extracted", STEP)
        since = written()
        books, chapters = self._built(read.drop("content"))
        until = written()
        books, chapters = stored(books, "books", STEP), stored(chapters, "chapters", STEP)
        drop(self.spark, since, until)
        status = read.select("path", "sha256", "status", "error").join(books.select("sha256", "id", F.col("status").alias("verdict"), "score"), "sha256", "left")
        out = status.select("path", "id", F.coalesce("verdict", F.when(F.col("status") == "skipped", "skipped").otherwise("failed")).alias("status"), "score", "error")
        steps = written()
        outcomes = stored(out.unionByName(done), "outcomes")
        kept = quality_gate.stored_only(books)
        own = chapters.join(kept.select(F.col("id").alias("book")), "book", "left_semi")
        content = read.filter("content IS NOT NULL").select("sha256", "path", "content").join(kept.select("sha256"), "sha256", "left_semi")
        content = _one_each(content)
        self._publish({"books": kept, "chapters": own, "outcomes": outcomes, "sources": content}, lambda: drop(self.spark, began, steps))
        return outcomes

    def _built(self, read: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Books and chapters of what was extracted; the same content twice is one book."""
        count = tokens.counter(self.config["tokens"]["ranks"])
        read = _one_each(read)
        raw = extract.blocks(read).withColumn("text", T.control_strip(T.whitespace(T.unicode_clean(F.col("text"))))).filter("text <> '' OR kind = 'code'")
        ranked = stored(structure.with_paths(structure.with_preface(structure.ranked(raw))).withColumn("size", count(F.col("text"))), "ranked", STEP)
        freed(self.spark)
        headed = ranked.filter("kind = 'heading' AND pos >= 0").select("doc").distinct()
        size = lambda _: F.col("size")
        cut = structure.cut_levels(ranked, size).withColumnRenamed("cut", "cut_level")
        cut_blocks = ranked.join(headed, "doc", "left_semi").join(cut, "doc")
        begins = (F.col("kind") == "heading") & (F.col("parent") < F.col("cut_level"))
        marked = cut_blocks.withColumn("begins", begins).withColumn("start", F.max(F.when(begins, F.col("pos"))).over(structure.so_far()))
        body = marked.filter(~F.col("begins")).withColumn("level", F.when(F.col("kind") == "heading", F.col("level") - F.col("cut_level")))
        starts = structure.chapters(cut_blocks, F.col("cut_level"), size).select("doc", "start", "title")
        texts = render.body_md(body, ["doc", "start"])
        whole = starts.join(texts, ["doc", "start"], "left").select("doc", F.row_number().over(Window.partitionBy("doc").orderBy("start")).alias("n"), "title", F.coalesce("text", F.lit("")).alias("text"))
        flat = render.body_md(ranked.filter("pos >= 0").join(headed, "doc", "left_anti"), ["doc"]).select("doc", F.lit(1).alias("n"), F.lit(structure.PREFACE).alias("title"), "text")
        chapters = whole.withColumn("found", F.lit(True)).unionByName(flat.withColumn("found", F.lit(False))).withColumn("tokens", count(F.col("text")))
        flagged = stored(sections.toc_flags(chapters).withColumn("removed", F.col("is_toc") | sections.is_meta(F.col("text"), F.col("tokens"))).drop("is_toc"), "chapters", STEP)
        freed(self.spark)
        kept = sections.merged_tiny(flagged.filter("NOT removed").drop("removed").withColumn("n", F.col("n").cast("bigint")), self.config["sections"]["tiny"])
        # a book without headings is cut by size as soon as it is longer than one part
        limit = F.when(F.col("found"), self.config["sections"]["giant"]).otherwise(self.config["sections"]["part"])
        kept = sections.not_empty(sections.split_giants(kept, self.config["sections"]["giant"], self.config["sections"]["part"], limit))
        kept = stored(kept.withColumn("n", F.row_number().over(Window.partitionBy("doc").orderBy("n", "i")).cast("bigint")).withColumn("tokens", count(F.col("text"))), "kept", STEP)
        freed(self.spark)
        removed = flagged.filter("removed").groupBy("doc").agg(F.sum("tokens").alias("removed_tokens"))
        ok = read.filter("status = 'read'")
        refs = ok.select(F.col("sha256").alias("doc"), "ref_tokens", "control_chars", F.col("fmt").isin("txt", "md", "pdf").alias("hyphenated"))
        refs = refs.join(removed, "doc", "left").join(headed.withColumn("found", F.lit(True)), "doc", "left")
        refs = refs.fillna({"removed_tokens": 0, "found": False}).withColumn("pages", F.lit(0)).withColumn("wide_pages", F.lit(0))
        m = quality_gate.scored(quality_gate.metrics(kept, refs))
        named = ok.select(F.col("sha256").alias("doc"), T.repaired_title(F.col("title")).alias("title"), "author", F.coalesce("lang", "ref_lang").alias("lang"), "fmt", "path", (F.col("title").isNotNull() & T.repaired_title(F.col("title")).isNull()).alias("repaired")).dropDuplicates(["doc"])
        stem = F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", "")
        named = named.withColumn("slug", T.book_id(F.col("title"), F.when(F.col("title").isNotNull(), F.col("author")), stem, self.config["ids"]["most"])).withColumn("title", F.coalesce("title", stem))
        # of several new books of one slug the least hash has it
        order = Window.partitionBy("slug").orderBy("doc")
        named = named.withColumn("slug", F.when(F.row_number().over(order) == 1, F.col("slug")).otherwise(F.concat_ws("-", "slug", F.substring("doc", 1, 6))))
        old = self.table("books")
        ids = catalog.identities(named.select(F.col("doc").alias("sha256"), "slug"), old.select("id", "sha256")).select(F.col("sha256").alias("doc"), "id")
        locked = old.filter("meta_locked").select("id", F.col("title").alias("own_title"), F.col("author").alias("own_author"))
        totals = kept.groupBy("doc").agg(F.sum("tokens").cast("bigint").alias("total_tokens"))
        b = quality_gate.with_repair(m.join(named, "doc").join(ids, "doc").join(locked, "id", "left").join(totals, "doc"), F.col("repaired"), F.col("own_title").isNotNull())
        books = b.select("id", F.coalesce("own_title", "title").alias("title"), F.coalesce("own_author", "author").alias("author"), "lang", "fmt", F.col("doc").alias("sha256"), self.cache_key(F.col("doc")).alias("cache_key"), F.col("own_title").isNotNull().alias("meta_locked"), "score", "status", F.array_join("triggers", "; ").alias("triggers"), "total_tokens", T.iso_time(F.unix_timestamp()).alias("ingested_at"))
        out = kept.join(ids, "doc").select(F.col("id").alias("book"), "n", "title", "text", "tokens", T.summary(F.col("text")).alias("summary"))
        return books, out

    def remove(self, book: str) -> None:
        """A row that says the book is gone; its data go when parts are next put together."""
        catalog.lookup(self.table("books"), catalog.validate_book_id(book))
        with self.lock():
            self._publish({"books": stored(self._books().filter(F.col("id") == book).drop("part").withColumn("gone", F.lit(True)), "gone")})

    def lock_metadata(self, book: str, title: str, author: str) -> None:
        """Sets title and author by hand; later ingests keep them."""
        with self.lock():
            new = self._books().filter(F.col("id") == book).drop("part").withColumn("title", F.lit(title)).withColumn("author", F.lit(author)).withColumn("meta_locked", F.lit(True))
            self._publish({"books": stored(new, "named")})

    # --- reads -----------------------------------------------------------------------------------

    def list_books(self) -> DataFrame:
        chapters = self.table("chapters").groupBy("book").agg(F.count("*").alias("chapters"))
        return self.table("books").join(chapters, F.col("id") == F.col("book"), "left").select("id", "title", "author", F.coalesce("chapters", F.lit(0)).alias("chapters"), "total_tokens", "status").orderBy("id")

    def list_chapters(self, book: str) -> DataFrame:
        catalog.lookup(self.table("books"), catalog.validate_book_id(book))
        return self.table("chapters").filter(F.col("book") == book).select("n", "title", "tokens", "summary").orderBy("n")

    def info(self, book: str) -> DataFrame:
        return catalog.lookup(self.table("books"), catalog.validate_book_id(book))

    def review(self) -> DataFrame:
        return self.table("books").filter("status = 'review'").select("id", "score", "triggers").orderBy("id")

    def get_chapters(self, book: str, spec: str | None = None, budget: int | None = None, start: int = 1) -> dict:
        """Texts by chapter spec, or as many whole chapters from ``start`` as the budget holds."""
        if spec is not None and budget is not None:
            raise ValueError("either a spec or a budget")
        rows = self.list_chapters(book)
        if spec is not None:
            n = rows.count()
            wanted = catalog.parse_spec(spec, n)
        else:
            b = budget_read(self.table("chapters").filter(F.col("book") == book), self.config["read"]["budget"] if budget is None else budget, start).collect()
            if not b:
                return {"text": "", "chapters": [], "next_from": None, "message": "no chapters from there"}
            wanted = list(range(start, start + b[0].chapters_read))
            if not wanted:
                return {"text": "", "chapters": [], "next_from": b[0].next_from, "message": f"chapter {b[0].next_from} alone is over the budget"}
        own = self.table("chapters").filter((F.col("book") == book) & F.col("n").isin(wanted)).select("n", render_text().alias("text"))
        texts = {r.n: r.text for r in own.collect()}  # what the caller asked to read
        out = {"text": "\n\n".join(texts[n].rstrip("\n") for n in wanted), "chapters": wanted}
        return out if spec is not None else out | {"next_from": b[0].next_from}

    # --- search and verification -----------------------------------------------------------------

    def find(self, query: str, limit: int = 10, book: str | None = None) -> DataFrame:
        """src (book or chapter), id, n, title, score, partial, snippet."""
        words = [" ".join([*w[:-1], search.light_stem(w[-1])]) for w in search.words_of(query)]
        typed = [(0, " ".join(w.replace(" ", "-") for w in words))]
        hits = search.all_or_any(self._scored(typed))
        hits = hits.filter(F.col("book") == book) if book else hits
        hits = search.top(hits, ["book", "n"], limit).join(self.table("chapters").select("book", "n", "title", "text"), ["book", "n"])
        hits = search.with_snippets(hits, "text", " ".join(words)).select(F.lit("chapter").alias("src"), F.col("book").alias("id"), "n", "title", "score", "partial", "snippet")
        if book:
            return hits.orderBy(F.desc("score"), "id", "n")
        books = self.table("books").select("id", "title", F.coalesce("author", F.lit("")).alias("author"))
        own = search.top(search.all_or_any(search.bm25(books, ["id"], {"title": 2.0, "author": 1.0}, search.query_terms(self.spark, typed))), ["id"], 3).join(books, "id")
        own = own.select(F.lit("book").alias("src"), "id", F.lit(None).cast("bigint").alias("n"), "title", "score", "partial", search.highlight(F.col("title"), words[0].split()[-1] if words else "").alias("snippet"))
        return own.unionByName(hits).orderBy("src", F.desc("score"), "id", "n").limit(limit)

    def _scored(self, queries: list[tuple[int, str]]) -> DataFrame:
        """Scores of the chapters from the stored index."""
        corpus = self.table("sizes").agg(F.count("*").alias("n_docs"), F.avg("len").alias("avgdl"))
        return search.from_index(self.table("index"), ["book", "n"], SEARCHED, self.spark, queries, corpus)

    def verify(self, quote: str, book: str | None = None) -> DataFrame:
        """The best windows of the chapters for a quote, most similar first."""
        words = [t.canon for t in verify.normalized(quote)]
        strong = [w for w in words if w not in T.STOP_WORDS]
        chapters = self.table("chapters")
        refused = verify.refusal(quote)
        if refused and (not words or not book):
            raise ValueError(f"{refused}: it can't be looked for" + " in all books; name one" * bool(words))
        if book:
            pairs = chapters.filter(F.col("book") == book)
        else:
            forms = [" ".join(v) for v in search.yo_variants(strong)]
            found = self._scored(list(enumerate(forms))).groupBy("book", "n").agg(F.max("score").alias("score")).withColumn("qid", F.lit(0))
            pairs = chapters.join(search.top(found, ["book", "n"], verify.CANDIDATES).select("book", "n"), ["book", "n"])
        out = verify.compared(pairs.withColumn("quote", F.lit(quote)), "text", "quote")
        return out.select("book", "n", "title", "similarity", "verdict", "passage", "diff").filter("verdict <> 'not_found'").orderBy(F.desc("similarity"), "book", "n")


def _one_each(read: DataFrame) -> DataFrame:
    """Of files of the same content the one of the least path, whichever task comes first."""
    order = Window.partitionBy("sha256").orderBy("path")
    return read.withColumn("nth", F.row_number().over(order)).filter("nth = 1").drop("nth")


def render_text() -> Column:
    """A chapter as it is read: its title, then its text."""
    return F.concat(F.lit("# "), F.col("title"), F.lit("\n\n"), F.col("text"))
